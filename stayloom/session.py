"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKAGE = "stayloom"
TASK_ROWS = 250_000


def get_session(app: str = "stayloom", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session in UTC. Shuffle width, memory and storage are left to the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors once, so that their Python finds it wherever the driver started."""
    context = spark.sparkContext
    if any(name.endswith(f"/{PACKAGE}.zip") for name in context.listFiles):
        return
    root = Path(__file__).parent
    # Spark serves the file from the driver to every executor, so its place on the driver does not matter.
    archive = Path(tempfile.mkdtemp(prefix="stayloom-package-")) / f"{PACKAGE}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, f"{root.name}/{source.relative_to(root)}")
    context.addPyFile(str(archive))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A machine-local folder is taken only where the cluster names none and the master is local.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="stayloom-")
    return _LOCAL[application]


_LOCAL: dict[str, str] = {}
_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what ``written`` stored meanwhile. Results must be stored or collected before."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors.

    What is written stays until the folder is cleared or an enclosing ``scratch`` ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _SCOPES:
        scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, own: dict) -> Iterator[None]:
    """Settings of the session that hold meanwhile, put back at the end."""
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def task_count(spark: SparkSession, rows: int) -> int | None:
    """Tasks of TASK_ROWS rows, if that is more than the session's shuffle width."""
    tasks = math.ceil(rows / TASK_ROWS)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


@contextmanager
def widened(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run meanwhile reads and shuffles ``rows`` rows in tasks of about TASK_ROWS, so that a task's memory does not grow with them.

    Narrower tables keep the session's settings. Results must be stored or collected inside.
    """
    tasks = task_count(spark, rows)
    with settings(spark, {} if tasks is None else {
            "spark.sql.shuffle.partitions": tasks, "spark.sql.files.minPartitionNum": tasks,
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        yield


def row_count(df: DataFrame) -> int:
    """Rows of a table as it is read (action). One sum needs no plan that adapts, so it is one job."""
    with settings(df.sparkSession, {"spark.sql.adaptive.enabled": "false"}):
        return df.count()


def by_rows(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """Partition by keys into tasks of about TASK_ROWS rows, for plans that run later. Few or unknown rows stay where they are.

    A following join, window or group-by on the keys reuses it.
    """
    tasks = task_count(df.sparkSession, rows or 0)
    return df if tasks is None else df.repartition(tasks, *keys)


@dataclass(frozen=True)
class Measure:
    """What was seen while a table was written: its rows, and their payload in bytes."""

    rows: int
    bytes: int


def measured(df: DataFrame, name: str, **aggregates: Column) -> tuple[DataFrame, Measure, dict]:
    """As ``written``, with the size of the table and further aggregates taken in the same pass over the rows."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    fixed, variable = row_bytes(df)
    sizes = [F.count(F.lit(1)).alias("__rows"), F.sum(variable).alias("__bytes")]
    stored = written(df.observe(seen, *sizes, *[c.alias(n) for n, c in aggregates.items()]), name)
    found = dict(seen.get)
    rows, payload = found.pop("__rows"), found.pop("__bytes") or 0
    return stored, Measure(rows, rows * (fixed + 16) + payload), found


def row_bytes(df: DataFrame) -> tuple[int, Column]:
    """Bytes of the columns of fixed width, and a column with those of the others."""
    fixed, variable = 0, F.lit(0)
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            variable = variable + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            variable = variable + F.length(F.to_json(F.struct(c)))
        else:
            fixed += 8
    return fixed, variable.cast("long")


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")
