"""Split, baselines, ridge, likelihood and tree models, search, importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.numbers import log_target
from ...operators import boost, evaluate, learn
from ...operators.gradient import ridge_by_gradients
from ...session import written
from ..training import compare_models, encode_split, fit_trees, refit_on_important
from ..training import tree_search as search_trees
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


@query(f"""WITH {STAY_SQL}
SELECT stay_id, CASE WHEN subject_id % 10 < 8 THEN 'train' ELSE 'test' END AS side FROM stays""")
def split_by_subject(spark, d):
    train, test = learn.split_by_subject(stays(spark, d).select("subject_id", "stay_id"), "subject_id")
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test"))).drop("subject_id")


def _labelled(spark, d):
    return written(stays(spark, d).withColumn("label", log_target(F.col("los"), learn.TARGET_CAP_DAYS)), "labelled")


METRICS = ["r2_log", "mae_log", "rmse_log", "r2", "mae", "rmse", "mape", "median_ae"]
METRICS_SQL = """
SELECT round(1 - sum((y - p) ^ 2) / (var_pop(y) * count(*)), 9) AS r2_log, round(avg(abs(y - p)), 9) AS mae_log,
       round(sqrt(avg((y - p) ^ 2)), 9) AS rmse_log, count(*) AS n,
       round(1 - sum(e ^ 2) / (var_pop(yd) * count(*)), 9) AS r2, round(avg(abs(e)), 9) AS mae,
       round(sqrt(avg(e ^ 2)), 9) AS rmse, round(avg(abs(e / CASE WHEN yd = 0 THEN 1 ELSE yd END)) * 100, 6) AS mape,
       round(median(abs(e)), 9) AS median_ae, {name} AS model
FROM (SELECT y, p, exp(y) - 1 AS yd, (exp(y) - 1) - (exp(greatest(p, 0)) - 1) AS e FROM scored)"""


def _rounded_metrics(table):
    return rounded(rounded(table, 9, *[m for m in METRICS if m != "mape"]), 6, "mape")


@query(f"""WITH {STAY_SQL},
labelled AS (SELECT *, ln(1 + least(los, 30)) AS y FROM stays),
scored AS (SELECT y, (SELECT quantile_cont(y, 0.5) FROM labelled WHERE subject_id % 10 < 8) AS p
           FROM labelled WHERE subject_id % 10 >= 8)
{METRICS_SQL.format(name="'median'")}""")
def baseline_metrics(spark, d):
    """Error measures of the constant training median."""
    train, test = learn.split_by_subject(_labelled(spark, d), "subject_id")
    return _rounded_metrics(evaluate.metrics(learn.median_baseline(train, test), "median"))


# Ridge with two columns has a closed form: centred sums, penalty on the diagonal, free intercept.
RIDGE_SQL = f"""{STAY_SQL},
labelled AS (SELECT *, ln(1 + least(los, 30)) AS y, avg_price AS a, avg_discount AS b FROM stays),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, count(*) AS n, var_pop(a) * count(*) + 1 AS saa,
             var_pop(b) * count(*) + 1 AS sbb, covar_pop(a, b) * count(*) AS sab,
             covar_pop(a, y) * count(*) AS say, covar_pop(b, y) * count(*) AS sby
      FROM labelled WHERE subject_id % 10 < 8),
w AS (SELECT (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS wa,
             (sby * saa - say * sab) / (saa * sbb - sab * sab) AS wb, ma, mb, my FROM m),
scored AS (SELECT y, my + wa * (a - ma) + wb * (b - mb) AS p FROM labelled, w WHERE subject_id % 10 >= 8)
"""


RIDGE_METRICS_SQL = METRICS_SQL.format(name="'ridge'").replace(", 9)", ", 5)").replace(", 6)", ", 4)")


def _ridge_scored(spark, d):
    train, test = learn.split_by_subject(_labelled(spark, d), "subject_id")
    encoder = learn.encoder(["avg_price", "avg_discount"], []).fit(train)
    model = learn.ridge(encoder.transform(train))
    return train, model.transform(encoder.transform(test))


def _coarse_metrics(table):
    return rounded(rounded(table, 5, *[m for m in METRICS if m != "mape"]), 4, "mape")


@query(f"WITH {RIDGE_SQL} {RIDGE_METRICS_SQL}")
def ridge_metrics(spark, d):
    """Two columns, against the closed form."""
    return _coarse_metrics(evaluate.metrics(_ridge_scored(spark, d)[1], "ridge"))


@query(f"""WITH {RIDGE_SQL},
base AS (SELECT y, (SELECT quantile_cont(y, 0.5) FROM labelled WHERE subject_id % 10 < 8) AS p
         FROM labelled WHERE subject_id % 10 >= 8)
{RIDGE_METRICS_SQL} UNION ALL BY NAME {RIDGE_METRICS_SQL.replace("'ridge'", "'median'").replace("FROM scored", "FROM base")}""")
def model_comparison(spark, d):
    train, scored = _ridge_scored(spark, d)
    median = learn.median_baseline(train, scored.drop("prediction"))
    return _coarse_metrics(evaluate.comparison([evaluate.metrics(median, "median"), evaluate.metrics(scored, "ridge")]))


@query(f"""WITH {RIDGE_SQL}
SELECT round(greatest(0, least(yd, 30)), 9) AS actual, round(greatest(0, least(pd, 30)), 5) AS predicted,
       round(greatest(-30, least(yd - pd, 30)), 5) AS residual
FROM (SELECT exp(y) - 1 AS yd, exp(greatest(p, 0)) - 1 AS pd FROM scored)""")
def residual_table(spark, d):
    table = evaluate.residuals(_ridge_scored(spark, d)[1])
    return rounded(rounded(table, 9, "actual"), 5, "predicted", "residual")


def _fitted(spark, d):
    df = stays(spark, d).withColumnsRenamed(
        {"subject_id": "SUBJECT_ID", "admission_type": "ADMISSION_TYPE", "gender": "GENDER", "los": "LOS",
         "avg_qty": "heart_rate_avg", "avg_price": "systolic_bp_avg", "avg_discount": "diastolic_bp_avg"})
    return encode_split(df, keep=["stay_id"])


@query()
def gbt_metrics(spark, d):
    """Boosted trees under the Tweedie loss, with the encoded categories and derived columns: the full 500 trees."""
    f = _fitted(spark, d)
    return evaluate.metrics(boost.predict(f.test, fit_trees(f.train, f.names)), "trees")


@query()
def tweedie_metrics(spark, d):
    f = _fitted(spark, d)
    model = learn.tweedie(regularisation=0.01).fit(f.train)
    return evaluate.metrics(model.transform(f.test), "tweedie")


# Fisher scoring under a log link: weights mu^(2 - power), working response eta + (y - mu) / mu.
@query(f"""WITH RECURSIVE {STAY_SQL},
labelled AS (SELECT *, ln(1 + least(los, 30)) AS y, avg_price AS x FROM stays),
data AS (SELECT x, y FROM labelled WHERE subject_id % 10 < 8),
fit(k, a, b) AS (
  SELECT 0, (SELECT ln(avg(y)) FROM data), 0.0::DOUBLE
  UNION ALL
  SELECT k + 1, (sxx * sz - sx * sxz) / (s * sxx - sx * sx), (s * sxz - sx * sz) / (s * sxx - sx * sx)
  FROM (SELECT k, sum(w) AS s, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * z) AS sz, sum(w * x * z) AS sxz
        FROM (SELECT k, x, exp(0.5 * (a + b * x)) AS w, a + b * x + (y - exp(a + b * x)) / exp(a + b * x) AS z FROM fit, data)
        GROUP BY k)
  WHERE k < 25)
SELECT stay_id, round(exp(a + b * x), 4) AS prediction FROM labelled, fit WHERE subject_id % 10 >= 8 AND k = 25""")
def tweedie_one_column(spark, d):
    """The likelihood model on one column, against scoring steps in SQL."""
    train, test = learn.split_by_subject(_labelled(spark, d), "subject_id")
    encoder = learn.encoder(["avg_price"], []).fit(train)
    model = learn.tweedie().setTol(1e-13).setMaxIter(60).fit(encoder.transform(train))
    return rounded(model.transform(encoder.transform(test)).select("stay_id", "prediction"), 4, "prediction")


LIKELIHOOD_STEPS = """
fit(p, k, a, b) AS (
  SELECT p, 0, (SELECT ln(avg(y)) FROM data), 0.0::DOUBLE FROM powers
  UNION ALL
  SELECT p, k + 1, (sxx * sz - sx * sxz) / (s * sxx - sx * sx), (s * sxz - sx * sz) / (s * sxx - sx * sx)
  FROM (SELECT p, k, sum(w) AS s, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * z) AS sz, sum(w * x * z) AS sxz
        FROM (SELECT p, k, x, exp((2 - p) * (a + b * x)) AS w, a + b * x + (y - exp(a + b * x)) / exp(a + b * x) AS z FROM fit, data)
        GROUP BY p, k)
  WHERE k < 25)"""


@query(f"""WITH RECURSIVE {STAY_SQL},
labelled AS (SELECT *, ln(1 + least(los, 30)) AS y, avg_price AS x FROM stays),
data AS (SELECT x, y FROM labelled WHERE subject_id % 10 < 7),
powers AS (SELECT * FROM (VALUES (0, 1.3::DOUBLE), (1, 1.5::DOUBLE), (2, 1.7::DOUBLE)) AS v(i, p)), {LIKELIHOOD_STEPS},
errors AS (
  SELECT i, p, avg(abs(y - exp(a + b * x))) AS log, avg(abs((exp(y) - 1) - (exp(exp(a + b * x)) - 1))) AS days
  FROM labelled, fit JOIN powers USING (p) WHERE subject_id % 10 = 7 AND k = 25 GROUP BY i, p)
SELECT i AS setting, 'variancePower=' || p || ', regParam=0.0' AS parameters, round(log, 6) AS mae_log, round(days, 6) AS mae_days,
       row_number() OVER (ORDER BY log, i) = 1 AS best FROM errors""")
def likelihood_search(spark, d):
    """Three powers of the likelihood model on one column by validation error, and the best of them."""
    train, _ = learn.split_by_subject(_labelled(spark, d), "subject_id")
    rest, validation = learn.validation_split(train, "subject_id")
    encoder = learn.encoder(["avg_price"], []).fit(rest)
    estimator = learn.tweedie().setTol(1e-13).setMaxIter(60)
    grid = learn.tweedie_grid(estimator, penalties=(0.0,))
    table, best = learn.search(estimator, grid, encoder.transform(rest), encoder.transform(validation))
    return rounded(table, 6, "mae_log", "mae_days").withColumn("best", F.col("setting") == grid.index(best))


@query(f"""WITH RECURSIVE {STAY_SQL},
labelled AS (SELECT *, ln(1 + least(los, 30)) AS y, avg_price AS x FROM stays),
data AS (SELECT x, y FROM labelled WHERE subject_id % 10 < 8),
powers AS (SELECT 1.5::DOUBLE AS p), {LIKELIHOOD_STEPS},
scored AS (SELECT y, exp(a + b * x) AS p FROM labelled, fit WHERE subject_id % 10 >= 8 AND k = 25)
{METRICS_SQL.format(name="'tweedie'").replace(", 9)", ", 5)").replace(", 6)", ", 4)")}""")
def tweedie_column_metrics(spark, d):
    """All error measures of the likelihood model on one column."""
    train, test = learn.split_by_subject(_labelled(spark, d), "subject_id")
    encoder = learn.encoder(["avg_price"], []).fit(train)
    model = learn.tweedie().setTol(1e-13).setMaxIter(60).fit(encoder.transform(train))
    return _coarse_metrics(evaluate.metrics(model.transform(encoder.transform(test)), "tweedie"))


# Rows in the order of MD5s, each paired with the rows one to five places on.
ROTATIONS = [(1, r) for r in range(1, learn.PERMUTATION_REPEATS + 1)]
IMPORTANCE_SQL = f"""{STAY_SQL},
labelled AS (SELECT *, ln(1 + least(los, 30)) AS y, avg_price AS a, avg_discount AS b FROM stays WHERE subject_id % 10 < 8),
rest AS (SELECT * FROM labelled WHERE subject_id % 10 < 7),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) + 1 AS saa, var_pop(b) * count(*) + 1 AS sbb,
             covar_pop(a, b) * count(*) AS sab, covar_pop(a, y) * count(*) AS say, covar_pop(b, y) * count(*) AS sby FROM rest),
w AS (SELECT (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS wa,
             (sby * saa - say * sab) / (saa * sbb - sab * sab) AS wb, ma, mb, my FROM m),
placed AS (
  SELECT y, a, b, row_number() OVER (ORDER BY md5('{learn.SEED}:' || stay_id)[:15], stay_id) - 1 AS i, count(*) OVER () AS n
  FROM labelled WHERE subject_id % 10 = 7),
pairs AS (
  SELECT r, o.y, o.a, o.b, p.a AS oa, p.b AS ob FROM placed o CROSS JOIN range(1, {learn.PERMUTATION_REPEATS + 1}) AS t(r)
  JOIN placed p ON p.i = (o.i + r) % o.n),
deltas AS (
  SELECT r, avg(abs(y - (my + wa * (oa - ma) + wb * (b - mb))) - abs(y - (my + wa * (a - ma) + wb * (b - mb)))) AS da,
            avg(abs(y - (my + wa * (a - ma) + wb * (ob - mb))) - abs(y - (my + wa * (a - ma) + wb * (b - mb)))) AS db
  FROM pairs, w GROUP BY r),
importance AS (
  SELECT 'avg_price' AS feature, avg(da) AS importance, stddev_samp(da) AS std FROM deltas
  UNION ALL SELECT 'avg_discount', avg(db), stddev_samp(db) FROM deltas)"""


def _ridge_importance(spark, d):
    train, test = learn.split_by_subject(_labelled(spark, d), "subject_id")
    rest, validation = learn.validation_split(train, "subject_id")
    encoder = learn.encoder(["avg_price", "avg_discount"], []).fit(train)
    model = learn.ridge(encoder.transform(rest))
    table = learn.permutation_importance(
        model, encoder.transform(validation), "stay_id", ["avg_price", "avg_discount"], steps=ROTATIONS)
    return encoder.transform(train), encoder.transform(test), table


@query(f"""WITH {IMPORTANCE_SQL}
SELECT feature, round(importance, 6) AS importance, round(std, 6) AS std FROM importance""")
def ridge_importance(spark, d):
    """Permutation importance of two columns on the validation digit, with the partners given."""
    return rounded(_ridge_importance(spark, d)[2], 6, "importance", "std")


@query(f"""WITH {IMPORTANCE_SQL},
kept AS (SELECT bool_or(feature = 'avg_price' AND importance > 0) AS ka, bool_or(feature = 'avg_discount' AND importance > 0) AS kb FROM importance),
every AS (SELECT *, ln(1 + least(los, 30)) AS y, avg_price AS a, avg_discount AS b FROM stays),
m2 AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) + 1 AS saa, var_pop(b) * count(*) + 1 AS sbb,
              covar_pop(a, b) * count(*) AS sab, covar_pop(a, y) * count(*) AS say, covar_pop(b, y) * count(*) AS sby
       FROM every WHERE subject_id % 10 < 8),
w2 AS (SELECT CASE WHEN ka AND kb THEN (say * sbb - sby * sab) / (saa * sbb - sab * sab) WHEN ka THEN say / saa ELSE 0 END AS wa,
              CASE WHEN ka AND kb THEN (sby * saa - say * sab) / (saa * sbb - sab * sab) WHEN kb THEN sby / sbb ELSE 0 END AS wb,
              ma, mb, my FROM m2, kept),
scored AS (SELECT y, my + wa * (a - ma) + wb * (b - mb) AS p FROM every, w2 WHERE subject_id % 10 >= 8)
{METRICS_SQL.format(name="'selected'").replace(", 9)", ", 5)").replace(", 6)", ", 4)")}""")
def ridge_selected(spark, d):
    """Error measures after a refit on the columns of positive importance."""
    train, test, table = _ridge_importance(spark, d)
    names = ["avg_price", "avg_discount"]
    kept = learn.kept_features(table)
    model = learn.ridge(learn.select_slots(train, names, kept))
    return _coarse_metrics(evaluate.metrics(model.transform(learn.select_slots(test, names, kept)), "selected"))


@query()
def grid_search(spark, d):
    """Settings by validation error, chosen without the test side."""
    f = _fitted(spark, d)
    train, validation = learn.validation_split(f.train)
    estimator = learn.tweedie()
    table, _ = learn.search(estimator, learn.tweedie_grid(estimator), train, validation)
    return table


@query()
def final_metrics(spark, d):
    """The best tree setting by validation error, refitted on the training side, scored once on the test side."""
    f = _fitted(spark, d)
    _, model = search_trees(f)
    return evaluate.metrics(boost.predict(f.test, model), "final")


@query()
def tree_search(spark, d):
    """All 27 tree settings by validation error, chosen without the test side; ``final_metrics`` scores the refit."""
    f = _fitted(spark, d)
    return learn.tree_search(*learn.validation_split(f.train), f.names, learn.tree_grid())[0]


@query()
def all_models(spark, d):
    """Median, ridge, Tweedie likelihood and boosted trees side by side; ``model_comparison`` has the two with SQL."""
    return compare_models(_fitted(spark, d))


@query(f"""WITH {STAY_SQL},
labelled AS (SELECT *, ln(1 + least(los, 30)) AS y FROM stays),
train AS (SELECT n_lines, y FROM labelled WHERE subject_id % 10 < 8),
cuts AS (SELECT DISTINCT n_lines AS cut FROM train),
sides AS (SELECT cut, n_lines <= cut AS below, count(*) AS n, avg(y) AS p FROM train CROSS JOIN cuts GROUP BY ALL),
best AS (SELECT cut FROM sides GROUP BY cut HAVING count(*) = 2 ORDER BY sum(n * p * p) DESC, cut LIMIT 1)
SELECT stay_id, round(p, 6) AS prediction
FROM labelled JOIN best ON true JOIN sides ON sides.cut = best.cut AND below = (n_lines <= best.cut)
WHERE subject_id % 10 >= 8""")
def one_split(spark, d):
    """One boosted tree with one split, against the best split by its squared error."""
    train, test = learn.split_by_subject(_labelled(spark, d), "subject_id")
    encoder = learn.encoder(["n_lines"], []).fit(train)
    model = learn.boosted_trees(1, depth=1).fit(encoder.transform(train))
    return rounded(model.transform(encoder.transform(test)).select("stay_id", "prediction"), 6, "prediction")


@query()
def native_importance(spark, d):
    f = _fitted(spark, d)
    return boost.split_shares(fit_trees(f.train, f.names), spark)


@query()
def permutation_importance(spark, d):
    """Increase of the error on the validation digit when one column is shuffled, five repeats."""
    f = _fitted(spark, d)
    train, validation = learn.validation_split(f.train)
    return learn.permutation_importance(learn.ridge(train), validation, "stay_id", f.names)


@query()
def refit_selected(spark, d):
    """Error on the test side after a refit on the features with positive importance on the validation digit."""
    f = _fitted(spark, d)
    rest, validation = learn.validation_split(f.train)
    kept = learn.kept_features(learn.permutation_importance(learn.ridge(rest), validation, "stay_id", f.names))
    train, test = (learn.select_slots(x, f.names, kept) for x in (f.train, f.test))
    return evaluate.metrics(learn.ridge(train).transform(test), "selected")


# One column, trees of one split: the cut of greatest gain and Newton steps, round after round.
def _round_sql(k: int, power: float, rate: float) -> str:
    a, b = f"y * exp({1 - power} * s)", f"exp({2 - power} * s)"
    return f"""
gradients{k} AS (SELECT *, {b} - {a} AS g, {power - 1} * {a} + {2 - power} * {b} AS h FROM scores{k - 1}),
cuts{k} AS (
  SELECT cut, sum(g) FILTER (x <= cut) AS gl, sum(h) FILTER (x <= cut) AS hl, sum(g) FILTER (x > cut) AS gr,
         sum(h) FILTER (x > cut) AS hr, sum(g) AS ga, sum(h) AS ha
  FROM gradients{k} CROSS JOIN (SELECT DISTINCT n_lines AS cut FROM labelled WHERE subject_id % 10 < 8)
  WHERE train GROUP BY cut
  HAVING least(count(*) FILTER (x <= cut), count(*) FILTER (x > cut)) >= {boost.LEAST_ROWS}),
best{k} AS (SELECT * FROM cuts{k} ORDER BY gl * gl / hl + gr * gr / hr - ga * ga / ha DESC, cut LIMIT 1),
scores{k} AS (
  SELECT stay_id, x, y, train, s - {rate} * CASE WHEN x <= cut THEN gl / hl ELSE gr / hr END AS s FROM scores{k - 1}, best{k})"""


def _boosted_sql(rounds: int, power: float, rate: float) -> str:
    return f"""WITH {STAY_SQL},
labelled AS (SELECT *, ln(1 + least(los, 30)) AS y FROM stays),
scores0 AS (SELECT stay_id, n_lines AS x, y, subject_id % 10 < 8 AS train,
                   ln((SELECT avg(y) FROM labelled WHERE subject_id % 10 < 8)) AS s FROM labelled),
{",".join(_round_sql(k, power, rate) for k in range(1, rounds + 1))}
SELECT stay_id, round(exp(s), 6) AS prediction FROM scores{rounds} WHERE NOT train"""


def _boosted(spark, d, rounds, setting):
    train, test = learn.split_by_subject(_labelled(spark, d), "subject_id")
    encoder = learn.encoder(["n_lines"], []).fit(train)
    model = boost.boost(encoder.transform(train), ["n_lines"], [setting], rounds)[0]
    return rounded(boost.predict(encoder.transform(test), model).select("stay_id", "prediction"), 6, "prediction")


@query(_boosted_sql(1, 1.5, 1.0))
def tweedie_split(spark, d):
    """One tree of one split under the Tweedie loss, with whole Newton steps."""
    return _boosted(spark, d, 1, boost.Setting(1, 1.0, 1.5))


@query(_boosted_sql(2, 1.3, 0.1))
def tweedie_two_rounds(spark, d):
    """Two rounds of one split, at another power and rate."""
    return _boosted(spark, d, 2, boost.Setting(1, 0.1, 1.3))


@query(f"""WITH {RIDGE_SQL}
SELECT stay_id, round(my + wa * (a - ma) + wb * (b - mb), 6) AS prediction FROM labelled, w WHERE subject_id % 10 >= 8""")
def ridge_gradients(spark, d):
    """Ridge without the matrix of the normal equations, against the closed form."""
    train, test = learn.split_by_subject(_labelled(spark, d), "subject_id")
    encoder = learn.encoder(["avg_price", "avg_discount"], []).fit(train)
    model = ridge_by_gradients(encoder.transform(train), 2, learn.RIDGE_ALPHA)
    return rounded(model.transform(encoder.transform(test)).select("stay_id", "prediction"), 6, "prediction")


@query()
def tree_importance(spark, d):
    """Increase of the trees' error on the validation digit when one column is shuffled; all 500 trees, five repeats."""
    f = _fitted(spark, d)
    rest, validation = learn.validation_split(f.train)
    return learn.tree_permutation_importance(fit_trees(rest, f.names), validation, "stay_id")


@query()
def trees_selected(spark, d):
    """Error on the test side of the trees refitted on the features with positive importance on the validation digit."""
    f = _fitted(spark, d)
    _, model, kept = refit_on_important(f, "stay_id")
    return evaluate.metrics(boost.predict(learn.select_slots(f.test, f.names, kept), model), "selected")
