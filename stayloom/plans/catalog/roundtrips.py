"""Tables through every source and sink, and the whole cohort build on stand-ins."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators import codemap, features, learn, profile
from ...session import load, shared_dir
from ...sources import readers, writers
from ...streaming.features import follow
from ..cohort import build_cohort, extract_in_windows, stay_windows, windowed_events
from .base import EVENTS_SQL, events, rounded
from .learning import RIDGE_SQL, _labelled

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn
    return register


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table_name() -> str:
    return f"roundtrip_{uuid.uuid4().hex}"


def unlisted(spark: SparkSession, name: str) -> DataFrame:
    """A table stored under a path of its own, taken out of the catalogue again; its files stay."""
    df = readers.read_table(spark, name)
    spark.sql(f"DROP TABLE {name}")
    return df


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
ORDERS_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
       o_orderpriority FROM orders"""


def as_text(df: DataFrame) -> DataFrame:
    return writers.timestamps_as_text(df)


@query(ORDERS_SQL)
def csv_file(spark, d):
    """CSV files with declared types, each scanned by its own path."""
    path = folder(spark, "csv-file")
    writers.write_csv(load(spark, d, "orders").repartition(3, "o_orderkey"), path)
    # One name per part.
    files = [r[0] for r in spark.read.text(path).select(F.input_file_name()).distinct().collect()]
    scans = [as_text(readers.read_csv(spark, f, ORDERS)) for f in sorted(files)]
    return reduce(DataFrame.unionByName, scans)


@query("SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders")
def csv_folder_columns(spark, d):
    """Some columns of a folder of CSV files, dates parsed."""
    path = folder(spark, "csv-folder")
    writers.write_csv(load(spark, d, "orders").repartition(4, "o_orderkey"), path)
    return as_text(readers.read_csv(spark, path, ORDERS, ["o_orderkey", "o_totalprice", "o_orderdate"]))


@query("SELECT o_orderkey, o_custkey::DOUBLE AS o_custkey, NULL::VARCHAR AS o_comment FROM orders")
def csv_other_columns(spark, d):
    """A declared column that the file lacks is NULL, one that is not declared is left out."""
    path = folder(spark, "csv-other")
    writers.write_csv(load(spark, d, "orders"), path)
    return readers.nullable_doubles(readers.read_csv(spark, path, "o_custkey int, o_comment string, o_orderkey string")).withColumn(
        "o_orderkey", F.col("o_orderkey").cast("long"))


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def csv_preview(spark, d):
    """Scan without a schema, with its preview printed."""
    path = folder(spark, "csv-preview")
    writers.write_csv(load(spark, d, "nation"), path)
    return readers.describe(readers.read_csv(spark, path), 2)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem")
def parquet_roundtrip(spark, d):
    path = folder(spark, "parquet")
    writers.write_parquet(load(spark, d, "lineitem"), path)
    return spark.read.parquet(path).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query(ORDERS_SQL)
def first_available(spark, d):
    """Parquet is missing, the CSV folder is read."""
    path = folder(spark, "fallback")
    writers.write_csv(load(spark, d, "orders"), f"{path}-csv")
    return as_text(readers.read_first_available(spark, [("parquet", f"{path}.parquet"), ("csv", f"{path}-csv")], ORDERS))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey < 5")
def table_replaced(spark, d):
    """A catalogue table written twice: the second write replaces the first."""
    customer, name, path = load(spark, d, "customer"), table_name(), folder(spark, "table")
    writers.write_table(customer, name, path)
    writers.write_table(customer.filter("c_nationkey < 5"), name, path)
    return unlisted(spark, name).select("c_custkey", "c_name", "c_acctbal")


@query("""
WITH ref AS (SELECT user_id, min(ts) AS s FROM events GROUP BY 1)
SELECT e.user_id AS "ICUSTAY_ID", count(*) AS n, round(sum(value), 6) AS total
FROM events e JOIN ref r ON e.user_id = r.user_id WHERE ts BETWEEN s AND s + INTERVAL 24 HOUR GROUP BY 1""")
def window_tables(spark, d):
    """Windows and events inside them as two stored tables, the second bucketed by stay."""
    rows = load(spark, d, "events").select(F.col("user_id").alias("ICUSTAY_ID"), "ts", "value", F.lit(1).alias("ITEMID"))
    stays = rows.groupBy("ICUSTAY_ID").agg(F.min("ts").alias("INTIME"))
    windows, inside = table_name(), table_name()
    writers.write_table(stay_windows(stays), windows, folder(spark, "windows"))
    hits = windowed_events(rows.withColumnsRenamed({"ts": "CHARTTIME", "value": "VALUENUM"}), unlisted(spark, windows))
    writers.write_events_table(hits, inside, "ICUSTAY_ID", 4, folder(spark, "inside"))
    return unlisted(spark, inside).groupBy("ICUSTAY_ID").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("VALUENUM"), 6).alias("total"))


def _extract(spark, d) -> tuple[DataFrame, DataFrame]:
    """Events as charted ones, and a window of each user: the day after the first purchase above 300, if there is one."""
    rows = load(spark, d, "events")
    stays = rows.filter("event_type = 'purchase' AND value > 300").groupBy(F.col("user_id").alias("ICUSTAY_ID")).agg(
        F.min("ts").cast("timestamp").alias("INTIME"))
    charted = rows.select(F.col("user_id").alias("ICUSTAY_ID"), F.col("ts").cast("timestamp").alias("CHARTTIME"),
                          F.col("value").alias("VALUENUM"))
    return charted, stay_windows(stays)


EXTRACT_SQL = """
WITH ref AS (SELECT user_id, min(ts) AS s FROM events WHERE event_type = 'purchase' AND value > 300 GROUP BY 1)
SELECT e.user_id AS "ICUSTAY_ID", count(*) AS n, round(sum(value), 6) AS total
FROM events e JOIN ref r ON e.user_id = r.user_id WHERE ts BETWEEN s AND s + INTERVAL 24 HOUR GROUP BY 1"""


def _per_stay(hits: DataFrame) -> DataFrame:
    return hits.groupBy("ICUSTAY_ID").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("VALUENUM"), 6).alias("total"))


@query(EXTRACT_SQL)
def dated_extract(spark, d):
    """An extract stored by day, of which only the days of the windows are read."""
    charted, windows = _extract(spark, d)
    path = folder(spark, "dated")
    writers.write_dated(charted, path, "CHARTTIME")
    return _per_stay(extract_in_windows(path, windows))


@query(EXTRACT_SQL)
def bucketed_join(spark, d):
    """Events and windows stored in buckets of the same ids, joined bucket by bucket."""
    charted, windows = _extract(spark, d)
    names = table_name(), table_name()
    for df, name in zip((charted, windows), names):
        writers.write_events_table(df, name, "ICUSTAY_ID", 8, folder(spark, "bucketed"))
    hits = unlisted(spark, names[0]).join(unlisted(spark, names[1]).hint("merge"), "ICUSTAY_ID")
    return _per_stay(hits.filter("CHARTTIME BETWEEN INTIME AND END_FIRST_24H"))


@query("""
SELECT p_type AS diagnosis, max_by(p_name, p_partkey) AS category FROM part GROUP BY 1""")
def appended_answers(spark, d):
    """Answers appended in two loads; the last of each text counts."""
    path = folder(spark, "answers")
    part = load(spark, d, "part").select(
        F.col("p_type").alias("diagnosis"), F.col("p_name").alias("category"), F.col("p_partkey").alias("seq"))
    for k in (0, 1):
        writers.append_answers(part.filter(F.col("seq") % 2 == k), path)
    return profile.keep_last(spark.read.parquet(path), "diagnosis", "seq").drop("seq")


@query("""
SELECT p_type AS diagnosis, max_by(p_name, p_partkey) AS category FROM part GROUP BY 1""")
def upserted_answers(spark, d):
    """Answers of three loads kept with one row per text; a load that comes late changes no newer answer."""
    path = folder(spark, "upserted")
    part = load(spark, d, "part").select(
        F.col("p_type").alias("diagnosis"), F.col("p_name").alias("category"), F.col("p_partkey").alias("seq"))
    for k in (0, 2, 1):
        writers.upsert_answers(part.filter(F.col("seq") % 3 == k), path, "diagnosis", "seq", 8)
    return spark.read.parquet(path).select("diagnosis", "category")


@query("""
SELECT user_id, event_type, count(*) AS num, count(value) AS count, round(sum(value), 6) AS sum, min(value) AS min, max(value) AS max,
       arg_max(value, {'t': ts, 'v': value}) AS latest
FROM events GROUP BY 1, 2""")
def streamed_features(spark, d):
    """Events as files that come in two lots, the second with old events and a file that was there before; then one table."""
    source, target, state = (folder(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    rows = load(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    lot = F.pmod(F.xxhash64("event_id"), F.lit(3))
    schema = "event_id long, user_id long, event_type string, ts timestamp, value double"
    for lots in ((0, 1), (1, 2)):
        rows.filter(lot.isin(*lots)).write.mode("append").parquet(source)
        table = follow(spark, source, schema, target, state, ["user_id", "event_type"], "event_id", "ts", "value", "60 days")
    return rounded(table, 6, "sum")


def _dictionary(spark, d) -> DataFrame:
    path = folder(spark, "dictionary")
    part = load(spark, d, "part").select(
        F.col("p_partkey").alias("itemid"), F.col("p_name").alias("label"), F.col("p_type").alias("category"), F.col("p_brand").alias("dbsource"))
    writers.write_csv(part, f"{path}/D_ITEMS.csv")
    return readers.read_items(spark, path)


@query("""
SELECT p_partkey::INT AS "ITEMID", lower(p_name) AS "LABEL", lower(p_type) AS "CATEGORY", lower(p_brand) AS "DBSOURCE",
       lower(p_brand) = 'brand#1' AS exact
FROM part WHERE contains(lower(p_brand), 'brand#1')""")
def dictionary_source(spark, d):
    """Dictionary rows of one source, by substring, and those of them that match exactly."""
    rows = _dictionary(spark, d)
    exact = codemap.source_filtered(rows, "brand#1", exact=True).select("ITEMID").withColumn("exact", F.lit(True))
    return codemap.source_filtered(rows, "brand#1").join(exact, "ITEMID", "left").fillna(False, ["exact"])


@query("SELECT lower(p_type) AS \"CATEGORY\", count(*) AS n_items FROM part WHERE lower(p_brand) = 'brand#2' GROUP BY 1")
def dictionary_source_categories(spark, d):
    return codemap.category_counts(_dictionary(spark, d), "brand#2")


@query(f"""
WITH {EVENTS_SQL}
SELECT user_id AS "ICUSTAY_ID", max(value) FILTER (WHERE code < 20) AS pulse_rate_max,
       max(value) FILTER (WHERE code BETWEEN 20 AND 49) AS pressure_arm_max
FROM events_coded WHERE code < 50 GROUP BY 1""")
def keyword_feature_table(spark, d):
    """A map that is a table and names its features as people write them."""
    rows = spark.range(50).select(
        F.col("id").alias("code"), F.when(F.col("id") < 20, F.lit(" Pulse Rate")).otherwise(F.lit("Pressure (arm)")).alias("feature_name"),
        F.lit(0).alias("map_order"))
    e = events(spark, d).select(
        F.col("user_id").alias("ICUSTAY_ID"), F.col("code").alias("ITEMID"), F.col("ts").alias("CHARTTIME"), F.col("value").alias("VALUENUM"))
    return features.numeric_feature_table(e, (rows, ["Pulse Rate", "Pressure (arm)"]), metrics=("max",))


@query(f"""WITH {RIDGE_SQL}
SELECT stay_id, round(my + wa * (a - ma) + wb * (b - mb), 5) AS prediction FROM labelled, w WHERE subject_id % 10 >= 8""")
def model_saved_and_loaded(spark, d):
    """A fitted model written to the shared folder, loaded and applied."""
    train, test = learn.split_by_subject(_labelled(spark, d), "subject_id")
    encoder = learn.encoder(["avg_price", "avg_discount"], []).fit(train)
    path = folder(spark, "model")
    learn.save_model(learn.ridge(encoder.transform(train)), path)
    scored = LinearRegressionModel.load(path).transform(encoder.transform(test))
    return rounded(scored.select("stay_id", "prediction"), 5, "prediction")


@query("""
SELECT p_partkey, 'ECONOMY' = p_type AS "ECONOMY", 'LARGE' = p_type AS "LARGE", 'MEDIUM' = p_type AS "MEDIUM",
       'PROMO' = p_type AS "PROMO", 'SMALL' = p_type AS "SMALL", 'STANDARD' = p_type AS "STANDARD"
FROM part""")
def encoded_slots(spark, d):
    """Slots of the model encoder: one for each category seen in training and no other."""
    part = load(spark, d, "part").select("p_partkey", "p_type", "p_size")
    model = learn.encoder(["p_size"], ["p_type"]).fit(part)
    done = model.transform(part)
    from pyspark.ml.functions import vector_to_array

    names = learn.vector_names(done)
    return done.select("p_partkey", *[
        (F.get(vector_to_array("features"), F.lit(i)) == 1).alias(n.split("__hot_")[-1]) for i, n in enumerate(names) if n != "p_size"])


# Five event types play the five event tables; a user is a person with one admission and one stay of ten days.
COHORT_MAP = {"low": list(range(0, 40)), "high": list(range(40, 90))}


def _cohort_tables(spark, d) -> dict[str, DataFrame]:
    e = events(spark, d)
    user = e.groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("first")).withColumn("SUBJECT_ID", F.col("user_id"))
    own = {"SUBJECT_ID": F.col("user_id"), "ICUSTAY_ID": F.col("user_id") * 100, "ITEMID": F.col("code"), "at": F.col("ts").cast("timestamp"), "v": F.col("value")}

    def table(kind: str, time: str, value: str) -> DataFrame:
        rows = e.filter(F.col("event_type") == kind).select(*[c.alias(n) for n, c in own.items()])
        return rows.withColumnsRenamed({"at": time, "v": value})

    return {
        "PATIENTS": user.select("SUBJECT_ID", F.lit("F").alias("GENDER"), F.col("first").alias("DOB"), (F.col("user_id") % 2).alias("EXPIRE_FLAG")),
        "ADMISSIONS": user.select("SUBJECT_ID", (F.col("user_id") * 10).alias("HADM_ID"), F.lit("URGENT").alias("ADMISSION_TYPE"),
                                  F.lit("x").alias("DIAGNOSIS"), F.col("first").alias("ADMITTIME")),
        "ICUSTAYS": user.filter("user_id % 7 <> 0").select(
            (F.col("user_id") * 10).alias("HADM_ID"), (F.col("user_id") * 100).alias("ICUSTAY_ID"),
            (F.col("first") + F.expr("INTERVAL 12 HOURS")).alias("INTIME"), F.lit(1.0).alias("LOS")),
        "CHARTEVENTS": table("click", "CHARTTIME", "VALUENUM"), "DATETIMEEVENTS": table("view", "CHARTTIME", "VALUE"),
        "LABEVENTS": table("error", "CHARTTIME", "VALUENUM").drop("ICUSTAY_ID"), "OUTPUTEVENTS": table("signup", "CHARTTIME", "VALUE"),
        "INPUTEVENTS_MV": table("purchase", "STARTTIME", "AMOUNT"), "INPUTEVENTS_CV": table("purchase", "CHARTTIME", "AMOUNT"),
    }


def _metric_sql(metrics: dict[str, str], kind: str, suffix: str, start: str) -> str:
    columns = ", ".join(
        f"{sql.format(f=f)} AS {f}_{m}" for f in COHORT_MAP for m, sql in metrics.items())
    return f"""{suffix} AS (SELECT e.user_id, {columns} FROM coded e JOIN stay s ON e.user_id = s.user_id
  WHERE event_type = '{kind}' AND feature IS NOT NULL AND ts BETWEEN {start} AND intime + INTERVAL 240 HOUR GROUP BY 1)"""


ON = " FILTER (WHERE feature = '{f}')"
COHORT_SQL = f"""
WITH {EVENTS_SQL},
coded AS (SELECT *, CASE WHEN code < 40 THEN 'low' WHEN code < 90 THEN 'high' END AS feature FROM events_coded),
people AS (SELECT user_id, min(ts) AS first FROM events GROUP BY 1),
stay AS (SELECT user_id, first, first + INTERVAL 12 HOUR AS intime FROM people WHERE user_id % 7 <> 0),
{_metric_sql({"min": "min(value)" + ON, "avg": "round(avg(value)" + ON + ", 6)", "max": "max(value)" + ON}, "click", "charted", "intime")},
{_metric_sql({"num": "count(*)" + ON, "had": "CAST(count(*)" + ON + " > 0 AS INTEGER)"}, "view", "dated", "intime")},
{_metric_sql({"latest": "arg_max(value, {{'t': ts, 'v': value}})" + ON}, "error", "labs", "first")},
{_metric_sql({"sum": "round(sum(value)" + ON + ", 6)", "count": "count(value)" + ON}, "signup", "outputs", "intime")}
SELECT p.user_id AS "SUBJECT_ID", p.user_id * 10 AS "HADM_ID", p.user_id % 2 AS "EXPIRE_FLAG", s.user_id * 100 AS "ICUSTAY_ID",
       charted.* EXCLUDE (user_id), dated.* EXCLUDE (user_id), labs.* EXCLUDE (user_id),
       outputs.low_sum, outputs.high_sum, nullif(outputs.low_count, 0) AS low_count, nullif(outputs.high_count, 0) AS high_count
FROM people p LEFT JOIN stay s ON p.user_id = s.user_id LEFT JOIN charted ON s.user_id = charted.user_id
LEFT JOIN dated ON s.user_id = dated.user_id LEFT JOIN labs ON s.user_id = labs.user_id LEFT JOIN outputs ON s.user_id = outputs.user_id"""


@query(COHORT_SQL)
def cohort_wide(spark, d):
    """The whole build with four presets: base table, windows, maps, pivots and joins, one row per stay."""
    presets = ("charted", "dated", "labs", "outputs")
    wide = build_cohort(_cohort_tables(spark, d), {p: COHORT_MAP for p in presets}, presets, hours=240)
    wide = rounded(wide, 6, *[c for c in wide.columns if c.endswith(("_avg", "_sum"))])
    return wide.drop("GENDER", "DOB", "ADMISSION_TYPE", "DIAGNOSIS", "ADMITTIME", "INTIME", "LOS", "END_FIRST_24H")


def _inputs_sql(time: str) -> str:
    return f"""
WITH {EVENTS_SQL},
coded AS (SELECT *, CASE WHEN code < 40 THEN 'low' WHEN code < 90 THEN 'high' END AS feature FROM events_coded),
people AS (SELECT user_id, min(ts) AS first FROM events GROUP BY 1),
stay AS (SELECT user_id, first, first + INTERVAL 12 HOUR AS intime FROM people WHERE user_id % 7 <> 0),
{_metric_sql({"sum": "round(sum(value)" + ON + ", 6)", "count": "count(value)" + ON}, "purchase", "inputs", "intime")}
SELECT p.user_id AS "SUBJECT_ID", s.user_id * 100 AS "ICUSTAY_ID", low_sum, high_sum,
       nullif(low_count, 0) AS low_count, nullif(high_count, 0) AS high_count
FROM people p LEFT JOIN stay s ON p.user_id = s.user_id LEFT JOIN inputs ON s.user_id = inputs.user_id"""


def _inputs(spark, d, preset):
    wide = build_cohort(_cohort_tables(spark, d), {preset: COHORT_MAP}, (preset,), hours=240)
    return rounded(wide, 6, "low_sum", "high_sum").select("SUBJECT_ID", "ICUSTAY_ID", "low_sum", "high_sum", "low_count", "high_count")


@query(_inputs_sql("STARTTIME"))
def cohort_inputs(spark, d):
    return _inputs(spark, d, "inputs")


@query(_inputs_sql("CHARTTIME"))
def cohort_inputs_older(spark, d):
    return _inputs(spark, d, "inputs_older")
