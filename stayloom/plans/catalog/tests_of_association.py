"""Rank correlation, rank tests, false-discovery control, information, redundancy, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import assoc
from ...operators.ranks import percent_rank_average
from ...session import load, row_count, widened, written
from ..statistics import association_report, select_and_fence
from .base import STAY_SQL, rounded, stays

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register


NUMBERS = ["n_lines", "sum_qty", "avg_qty", "avg_price", "avg_discount"]
CATEGORIES = ["admission_type", "gender"]

# Some values of two columns are made NULL, so that the pairs are not all complete.
GAPS_SQL = f"""{STAY_SQL},
gaps AS (SELECT stay_id, n_lines, sum_qty, CASE WHEN gender <> 'P' THEN avg_qty END AS avg_qty, avg_price,
                CASE WHEN admission_type <> '5-LOW' THEN avg_discount END AS avg_discount,
                admission_type, nullif(gender, 'O') AS gender, los FROM stays)"""


def _gaps(spark, d):
    """Stored once, as each test scans it several times."""
    with widened(spark, row_count(load(spark, d, "lineitem"))):
        return written(stays(spark, d).withColumns({
            "avg_qty": F.when(F.col("gender") != "P", F.col("avg_qty")),
            "avg_discount": F.when(F.col("admission_type") != "5-LOW", F.col("avg_discount")),
            "gender": F.nullif("gender", F.lit("O")),
        }), "associations")


def _avg_rank(order: str, within: str) -> str:
    """Average rank of ``order`` within a group."""
    return (f"(rank() OVER (PARTITION BY {within} ORDER BY {order})"
            f" + (count(*) OVER (PARTITION BY {within}, {order}) - 1) / 2.0)")


LONG_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, los AS y FROM gaps WHERE {c} IS NOT NULL" for c in NUMBERS)

RHO_SQL = f"""{GAPS_SQL},
long AS ({LONG_SQL}),
ranked AS (SELECT feature, {_avg_rank('x', 'feature')} AS rx, {_avg_rank('y', 'feature')} AS ry FROM long),
rho AS (SELECT feature, corr(rx, ry) AS rho, count(*) AS n FROM ranked GROUP BY feature)"""


@query(f"WITH {RHO_SQL} SELECT feature, round(rho, 8) AS rho, n FROM rho WHERE n >= 30")
def spearman_features(spark, d):
    """Rank correlation of every number with the length of stay over complete pairs."""
    return rounded(assoc.spearman_with_target(_gaps(spark, d), NUMBERS, "los"), 8, "rho").drop("p_value")


# Step-up adjustment of a table ``tested`` with one row per feature.
FDR_SQL = """
placed AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS place, count(*) OVER () AS m FROM tested),
adjusted AS (SELECT * EXCLUDE (place, m), least(1.0, min(p * m / place) OVER (
               ORDER BY place DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS adj FROM placed)"""
# Simpson's rule. With t = sqrt(n - 2) tan(a), the density of Student's distribution is cos(a)^(n - 3) up to a factor.
NODES_SQL = "nodes AS (SELECT i / 20000.0 AS part, CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(20001) AS t(i))"


P_SQL = f"""{RHO_SQL}, {NODES_SQL},
tested AS (
  SELECT feature, rho, n, (pi() / 2 - asin(abs(rho))) * sum(w * pow(cos(asin(abs(rho)) + (pi() / 2 - asin(abs(rho))) * part), n - 3))
         / (pi() / 2 * sum(w * pow(cos(pi() / 2 * part), n - 3))) AS p
  FROM rho CROSS JOIN nodes WHERE n >= 30 GROUP BY feature, rho, n), {FDR_SQL}"""


@query(f"""WITH {P_SQL}
SELECT feature, round(rho, 8) AS rho, n, round(p, 7) AS p_value, round(adj, 7) AS p_adj, adj <= 0.05 AS significant FROM adjusted""")
def spearman_p_values(spark, d):
    """Tail probabilities against quadrature of Student's density, with false-discovery control."""
    table = assoc.fdr_bh(assoc.spearman_with_target(_gaps(spark, d), NUMBERS, "los"))
    return rounded(rounded(table, 8, "rho"), 7, "p_value", "p_adj")


def _groups_sql(columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS g, los AS y FROM gaps WHERE {c} IS NOT NULL" for c in columns)


TEST_SQL = f"""{GAPS_SQL},
long AS ({_groups_sql(CATEGORIES)}),
ranked AS (SELECT feature, g, {_avg_rank('y', 'feature')} AS r FROM long),
grp AS (SELECT feature, g, count(*) AS ng, sum(r) AS rs FROM ranked GROUP BY ALL),
tot AS (SELECT feature, sum(ng) AS n, count(*) AS n_groups FROM grp GROUP BY feature),
tie AS (SELECT feature, sum(c * c * c - c) AS t FROM (
          SELECT feature, count(*)::DOUBLE AS c FROM long GROUP BY feature, y) GROUP BY feature)"""


@query(f"""WITH {TEST_SQL}
SELECT feature, 'Mann-Whitney U' AS test, arg_min(rs - ng * (ng + 1) / 2.0, g)::DOUBLE AS statistic,
       CAST(max(n_groups) AS INTEGER) AS n_groups
FROM grp JOIN tot USING (feature) WHERE n_groups = 2 GROUP BY feature""")
def mann_whitney_stat(spark, d):
    return assoc.rank_tests(_gaps(spark, d), ["gender"], "los").drop("p_value")


# Five groups are four degrees of freedom, for which the tail is exp(-h/2) (1 + h/2).
@query(f"""WITH {TEST_SQL},
kw AS (SELECT feature, CAST(max(n_groups) AS INTEGER) AS n_groups,
       (12 / (max(n) * (max(n) + 1)) * sum((rs / ng - (n + 1) / 2.0) ^ 2 * ng))
       / (1 - max(t) / (max(n)::DOUBLE * max(n) * max(n) - max(n))) AS h
FROM grp JOIN tot USING (feature) JOIN tie USING (feature) WHERE n_groups = 5 GROUP BY feature)
SELECT feature, 'Kruskal-Wallis' AS test, n_groups, round(h, 7) AS statistic,
       round(exp(-h / 2) * (1 + h / 2), 8) AS p_value FROM kw""")
def kruskal_stat(spark, d):
    """Statistic and tail probability over five groups."""
    table = assoc.rank_tests(_gaps(spark, d), ["admission_type"], "los")
    return rounded(rounded(table, 7, "statistic"), 8, "p_value")


@query(f"""WITH {TEST_SQL}, {NODES_SQL},
two AS (
  SELECT feature, arg_min(rs - ng * (ng + 1) / 2.0, g)::DOUBLE AS u, arg_min(ng, g)::DOUBLE AS n1, max(n)::DOUBLE AS n, max(t) AS t
  FROM grp JOIN tot USING (feature) JOIN tie USING (feature) WHERE n_groups = 2 GROUP BY feature),
z AS (
  SELECT feature, u, (greatest(u, n1 * (n - n1) - u) - n1 * (n - n1) / 2 - 0.5)
         / sqrt(n1 * (n - n1) / 12 * ((n + 1) - t / (n * (n - 1)))) AS z FROM two),
kw AS (SELECT feature, (12 / (max(n) * (max(n) + 1)) * sum((rs / ng - (n + 1) / 2.0) ^ 2 * ng))
       / (1 - max(t) / (max(n)::DOUBLE * max(n) * max(n) - max(n))) AS h
FROM grp JOIN tot USING (feature) JOIN tie USING (feature) WHERE n_groups = 5 GROUP BY feature),
tested AS (
  SELECT feature, 'Mann-Whitney U' AS test, u AS statistic, 2 AS n_groups,
         CASE WHEN z <= 0 THEN 1 ELSE 2 * 12 * sum(w * exp(-0.5 * (z + 12 * part) * (z + 12 * part))) / sqrt(2 * pi()) / 60000 END AS p
  FROM z CROSS JOIN nodes GROUP BY feature, u, z
  UNION ALL
  SELECT feature, 'Kruskal-Wallis', h, 5, exp(-h / 2) * (1 + h / 2) FROM kw), {FDR_SQL}
SELECT feature, test, round(statistic, 7) AS statistic, n_groups, round(p, 7) AS p_value, round(adj, 7) AS p_adj, adj <= 0.05 AS significant
FROM adjusted""")
def rank_test_p_values(spark, d):
    """Tail probabilities against quadrature of the normal density and the closed form of four degrees of freedom."""
    table = assoc.fdr_bh(assoc.rank_tests(_gaps(spark, d), CATEGORIES, "los"))
    return rounded(rounded(table, 7, "statistic"), 7, "p_value", "p_adj")


# A p-value both engines can compute: logistic form of the normal tail for each brand's mean size.
BRAND_SQL = """
z AS (SELECT p_brand AS feature, (avg(p_size) - (SELECT avg(p_size) FROM part))
             / ((SELECT stddev_samp(p_size) FROM part) / sqrt(count(*))) AS z FROM part GROUP BY 1),
tested AS (SELECT feature, 2 / (1 + exp(1.5976 * abs(z) + 0.07056 * abs(z) ^ 3)) AS p_value FROM z),
ranked AS (SELECT *, row_number() OVER (ORDER BY p_value, feature) AS r, count(*) OVER () AS m FROM tested),
adjusted AS (SELECT feature, p_value, least(1.0, min(p_value * m / r) OVER (
               ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adj FROM ranked)"""


def _brands(spark, d):
    part = load(spark, d, "part")
    whole = part.agg(F.avg("p_size").alias("m"), F.stddev_samp("p_size").alias("s")).first()
    z = F.abs((F.avg("p_size") - F.lit(whole["m"])) / (F.lit(whole["s"]) / F.sqrt(F.count(F.lit(1)))))
    tested = part.groupBy(F.col("p_brand").alias("feature")).agg(z.alias("z"))
    return assoc.fdr_bh(tested.select(
        "feature", (2 / (1 + F.exp(1.5976 * F.col("z") + 0.07056 * F.pow("z", F.lit(3))))).alias("p_value")))


@query(f"""WITH {BRAND_SQL}
SELECT feature, round(p_value, 9) AS p_value, round(p_adj, 9) AS p_adj, p_adj <= 0.05 AS significant FROM adjusted""")
def bh_fdr(spark, d):
    return rounded(_brands(spark, d), 9, "p_value", "p_adj")


@query(f"""WITH {BRAND_SQL}
SELECT count(*) AS n_tested, count(*) FILTER (WHERE p_value < 0.05) AS n_raw,
       count(*) FILTER (WHERE p_adj <= 0.05) AS n_fdr FROM adjusted""")
def significant_counts(spark, d):
    return assoc.test_counts(_brands(spark, d))


@query("""
WITH b AS (SELECT p_brand, round(avg(p_size), 1) AS size FROM part GROUP BY 1)
SELECT p_brand, round((rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2.0)
                      / count(*) OVER (), 9) AS pct FROM b""")
def rank_pct_score(spark, d):
    """Average rank over the number of rows, on a one-row-per-brand table."""
    b = load(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_size"), 1).alias("size"))
    return b.select("p_brand", F.round(percent_rank_average("size"), 9).alias("pct"))


MI_SQL = f"""{GAPS_SQL},
imp AS (SELECT n_lines, sum_qty, avg_price, los, coalesce(avg_qty, (SELECT quantile_cont(avg_qty, .5) FROM gaps)) AS avg_qty,
               coalesce(avg_discount, (SELECT quantile_cont(avg_discount, .5) FROM gaps)) AS avg_discount FROM gaps),
ilong AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, los AS y FROM imp" for c in NUMBERS)}),
binned AS (SELECT feature, (rank() OVER (PARTITION BY feature ORDER BY x) - 1) * 10 // count(*) OVER (PARTITION BY feature) AS bx,
                  (rank() OVER (PARTITION BY feature ORDER BY y) - 1) * 10 // count(*) OVER (PARTITION BY feature) AS by_
           FROM ilong),
joint AS (SELECT feature, bx, by_, count(*)::DOUBLE AS c FROM binned GROUP BY ALL),
marg AS (SELECT *, sum(c) OVER (PARTITION BY feature, bx) AS cx, sum(c) OVER (PARTITION BY feature, by_) AS cy,
                sum(c) OVER (PARTITION BY feature) AS n FROM joint),
mi AS (SELECT feature, sum(c / n * ln(c * n / (cx * cy))) AS MI FROM marg GROUP BY feature)"""


@query(f"WITH {MI_SQL} SELECT feature, round(MI, 9) AS MI FROM mi")
def binned_mi(spark, d):
    """Information about the length of stay after median imputation, ten equal-frequency bins."""
    return rounded(assoc.mutual_information(_gaps(spark, d), NUMBERS, "los"), 9, "MI")


@query(f"""WITH {MI_SQL}, long AS ({LONG_SQL}),
ranked AS (SELECT feature, {_avg_rank('x', 'feature')} AS rx, {_avg_rank('y', 'feature')} AS ry FROM long),
rho AS (SELECT feature, corr(rx, ry) AS rho FROM ranked GROUP BY feature),
both_ AS (SELECT feature, MI, rho, rank() OVER (ORDER BY MI) / 5.0 AS a, rank() OVER (ORDER BY abs(rho)) / 5.0 AS b
         FROM mi JOIN rho USING (feature))
SELECT feature, round(MI, 9) AS MI, round(rho, 8) AS rho, round((a + b) / 2, 9) AS score FROM both_""")
def feature_ranking(spark, d):
    """Mean of the percentile ranks by information and by correlation."""
    gaps = _gaps(spark, d)
    table = assoc.combined_ranking(
        assoc.mutual_information(gaps, NUMBERS, "los"), assoc.spearman_with_target(gaps, NUMBERS, "los"))
    return rounded(rounded(table.select("feature", "MI", "rho", "score"), 9, "MI", "score"), 8, "rho")


def _pair_sql() -> str:
    parts = []
    for a in NUMBERS:
        for b in NUMBERS:
            if a < b:
                parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, CAST({a} AS DOUBLE) AS x, "
                             f"CAST({b} AS DOUBLE) AS y FROM gaps WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
    return " UNION ALL ".join(parts)


MATRIX_SQL = f"""{GAPS_SQL},
pairs AS ({_pair_sql()}),
pr AS (SELECT feature_a, feature_b, {_avg_rank('x', 'feature_a, feature_b')} AS rx,
              {_avg_rank('y', 'feature_a, feature_b')} AS ry FROM pairs),
half AS (SELECT feature_a, feature_b, coalesce(corr(rx, ry), 0) AS rho FROM pr GROUP BY ALL)"""


@query(f"""WITH {MATRIX_SQL}
SELECT feature_a, feature_b, round(rho, 8) AS rho FROM half
UNION ALL SELECT feature_b, feature_a, round(rho, 8) FROM half
UNION ALL SELECT f, f, 1.0 FROM (VALUES {", ".join(f"('{c}')" for c in NUMBERS)}) AS v(f)""")
def spearman_matrix(spark, d):
    """Pairwise complete rank correlations; two of the five columns have NULLs."""
    return rounded(assoc.spearman_matrix(_gaps(spark, d), "stay_id", NUMBERS), 8, "rho")


@query(f"WITH {MATRIX_SQL} SELECT feature_a, feature_b, round(rho, 8) AS rho FROM half WHERE abs(rho) > 0.7")
def redundant_pairs(spark, d):
    matrix = assoc.spearman_matrix(_gaps(spark, d), "stay_id", NUMBERS)
    return rounded(assoc.redundant_pairs(matrix, 0.7), 8, "rho")


@query(f"""WITH {P_SQL} SELECT feature, round(rho, 8) AS rho FROM adjusted
WHERE abs(rho) > 0.05 AND adj <= 0.05 ORDER BY abs(rho) DESC, feature LIMIT 50""")
def strong_features(spark, d):
    """Features kept by strength and by significance under false-discovery control."""
    # One row a feature, read twice.
    table = written(assoc.fdr_bh(assoc.spearman_with_target(_gaps(spark, d), NUMBERS, "los")), "adjusted")
    names = assoc.strong_features(table)
    return rounded(table.filter(F.col("feature").isin(names)).select("feature", "rho"), 8, "rho")


@query(f"""WITH {P_SQL}
SELECT feature, round(rho, 8) AS rho, n, round(p, 7) AS p_value, round(adj, 7) AS p_adj, adj <= 0.05 AS significant FROM adjusted""")
def reported_associations(spark, d):
    """The numeric table of the whole report, which takes its columns by type."""
    df = _gaps(spark, d).select("los", *NUMBERS, *CATEGORIES)
    return rounded(rounded(association_report(df, "los").numeric, 8, "rho"), 7, "p_value", "p_adj")


@query(f"""WITH {STAY_SQL},
fence AS (SELECT greatest(0, quantile_cont(los, 0.25) - 1.5 * (quantile_cont(los, 0.75) - quantile_cont(los, 0.25))) AS lo,
                 quantile_cont(los, 0.99) AS hi FROM stays)
SELECT stay_id, n_lines, avg_price, round(los, 9) AS los, round(ln(1 + los), 9) AS los_log FROM stays, fence WHERE los BETWEEN lo AND hi""")
def selected_and_fenced(spark, d):
    """The job after the report: wanted columns that exist, rows within the fence, the log target."""
    clean, missing = select_and_fence(stays(spark, d), ["stay_id", "n_lines", "avg_price", "los", "lactate_latest"], "los")
    if missing != ["lactate_latest"]:
        raise ValueError(f"columns not found: {missing}")
    return rounded(clean, 9, "los", "los_log")
