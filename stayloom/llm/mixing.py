"""Mixing sources to target weights by capped water-filling.

Targets are proportional to weights; a source whose share would exceed ``epochs`` times its size is clamped
there and the excess goes to the others by weight, until none is above. A source is then taken a whole number
of times, and one further fraction: its documents in a seeded random order, as far as they fit, plus the one
remaining document that comes nearest to what is still missing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .common import WORD, draw

SEED = "mix-7"
CELL_BITS = 44  # a draw has 60 bits: a source is cut into at most 2^16 cells


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_sizes(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"))


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Weights for sources in code-point order, null last, repeating ``cycle``.

    The order is a distributed sort; places come from row numbers within the sorted parts plus the parts' offsets.
    """
    numbered = written(
        sources.orderBy(F.col("source").asc_nulls_last()).withColumn("n", F.monotonically_increasing_id()), "sources")
    split = numbered.withColumn("part", F.shiftright("n", 33)).withColumn("at", F.col("n").bitwiseAND((1 << 33) - 1))
    parts = split.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per part of the sort
    offsets = parts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    place = (F.col("at") + F.col("offset")) % len(cycle)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (place + 1).cast("int"))
    return split.join(offsets, "part").select("source", "source_size", weight.alias("weight"))


def water_fill(sources: DataFrame, share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """Add ``target``: ``share`` of all sizes dealt by ``weight``, no source above ``epochs`` times its size.

    Each round clamps every source above its limit at the present level and reshares the rest; the level only
    rises, so the rounds end when no further source is clamped. A round moves four numbers to the driver.
    Weights that are null or not above zero get nothing.
    """
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(0.0))
    sources = sources.withColumn("weight", weight).withColumn("limit", F.lit(float(epochs)) * F.col("source_size"))
    level, clamped = 0.0, -1
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = (F.col("weight") * F.lit(level) >= F.col("limit")) & (F.col("weight") > 0)
        row = sources.agg(
            F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("limit"))).alias("used"),
            F.sum(F.when(~full, F.col("weight"))).alias("rest")).first()
        if row["n"] == clamped:
            break
        clamped = row["n"]
        if not row["rest"]:
            level = math.inf
            break
        level = (share * total - (row["used"] or 0.0)) / row["rest"]
    even = F.col("weight") * F.lit(level)
    target = F.when(F.col("weight") == 0, F.lit(0.0)).when(even >= F.col("limit"), F.col("limit")).otherwise(even)
    return sources.withColumn("target", target).drop("limit")


def plan_repetitions(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source ``(whole, last_draw, extra_draw)``: how often all of it is taken, and the two limits of the fraction.

    Words are summed by cells of the draw, so that only the one cell in which the fraction ends is sorted.
    """
    units = written(sized.groupBy("source", "draw").agg(F.sum("size").alias("size")), "units")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    room = targets.withColumn("whole", whole.cast("long")).withColumn(
        "room", F.col("target") - F.col("whole") * F.col("source_size"))
    cell = F.shiftright("draw", CELL_BITS)
    so_far = W.partitionBy("source").orderBy("cell")
    cells = units.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"))
    cells = cells.withColumn("through", F.sum("words").over(so_far))
    ends = (
        cells.alias("c").join(room.alias("r"), F.expr("c.source <=> r.source"))
        .filter(F.col("through") > F.col("room"))
        .groupBy("c.source").agg(F.min_by(F.struct("cell", (F.col("through") - F.col("words")).alias("before")), "cell").alias("e"))
        .select("source", "e.cell", "e.before")
    )
    limits = room.alias("r").join(ends.alias("e"), F.expr("r.source <=> e.source"), "left").select(
        "r.source", "source_size", "target", "whole", "room", "cell", F.coalesce("before", F.lit(0)).alias("before"))
    limits = written(limits, "limits")
    inside = units.alias("u").join(limits.alias("l"), F.expr("u.source <=> l.source") & (cell == F.col("cell"))).select(
        "u.source", "draw", "size", "room", "before")
    through = F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("draw"))
    reached = (
        inside.withColumn("through", through).filter(F.col("through") <= F.col("room"))
        .groupBy("source").agg(F.max("draw").alias("draw"), F.max("through").alias("through"))
    )
    # A source without words has no end cell: nothing of it is taken.
    first = F.when(F.col("cell").isNull(), F.lit(-1)).otherwise(F.shiftleft("cell", CELL_BITS) - 1)
    fraction = limits.alias("l").join(reached.alias("t"), F.expr("l.source <=> t.source"), "left").select(
        "l.source", "source_size", "target", "whole",
        F.coalesce("draw", first).alias("last_draw"),
        (F.col("room") - F.coalesce("through", "before")).alias("gap"))
    fraction = written(fraction, "fraction")
    off = F.abs(F.col("gap") - F.col("size"))
    nearest = (
        units.alias("u").join(fraction.alias("f"), F.expr("u.source <=> f.source"))
        .filter((F.col("draw") > F.col("last_draw")) & (off < F.col("gap")))
        .groupBy("u.source").agg(F.min(F.struct(off.alias("off"), F.col("draw"))).alias("best"))
    )
    return fraction.alias("f").join(nearest.alias("n"), F.expr("f.source <=> n.source"), "left").select(
        "f.source", "source_size", "target", "whole", "last_draw", F.col("best.draw").alias("extra_draw"))


def mix(docs: DataFrame, weights=cyclic_weights, share: float = 1.5, epochs: float = 2.0,
        size: Column | None = None, seed: str = SEED) -> DataFrame:
    """Documents with ``size, source_size, target, copies, taken``: how often the mix takes each.

    ``docs`` needs ``doc_id``, ``source`` and ``text`` (or ``size``, a column of whole numbers); other columns are
    kept, except those named like an added one. A null text has size 0, a null source is a source. The draw hangs on doc_id alone: rows
    with the same id and source are taken together, rows without an id too. Empty tables and sources
    without words give targets and copies of 0. ``copies`` never exceeds ``epochs`` rounded up.
    ``weights`` maps ``(source, source_size)`` to the same with ``weight``.
    """
    size = words(F.col("text")) if size is None else size
    full = docs.withColumn("size", size).withColumn("__draw", draw(seed, F.col("doc_id")))
    sized = written(full.select("source", "size", F.col("__draw").alias("draw")), "sized")
    targets = water_fill(weights(source_sizes(sized)), share, epochs)
    plan = written(plan_repetitions(sized, written(targets, "targets")), "repetitions")
    added = ["source_size", "target", "copies", "taken"]
    keep = [c for c in full.columns if c not in added and c != "__draw"]
    again = (F.col("__draw") <= F.col("last_draw")) | F.coalesce(F.col("__draw") == F.col("extra_draw"), F.lit(False))
    copies = (F.col("whole") + again.cast("long"))
    return full.drop(*added).alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source")).select(
        *[F.col(f"d.`{c}`") for c in keep], F.col("p.source_size"), F.col("p.target"), copies.alias("copies"),
        (F.col("size") * copies).alias("taken"))


def expand(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as many times as it is taken."""
    return mixed.filter(F.col("copies") > 0).withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)
