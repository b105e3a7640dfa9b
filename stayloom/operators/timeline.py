"""Dose timeline of a stay: relative time, local-linear trend, bootstrap band."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import DAY_SECONDS, days_between
from .skew import lookup_join, spread

# Share of neighbours for the trend and for the resampled trends, resamples, seed, band.
TREND_FRACTION = 0.35
BAND_FRACTION = 0.75
DRAWS = 200
SEED = 42
BAND = (0.05, 0.95)

# A step of the time grid is one second, the resolution of the source, whatever the span.
STEPS = DAY_SECONDS
# How work is laid out; results do not hang on these. Stays up to this many steps are refitted in one run, others in
# blocks of draws; trends are fitted in slices of this many points.
WHOLE_STEPS = 8_640
DRAWS_PER_BLOCK = 20
SLICE_POINTS = 2_048
BATCH_ROWS = 5_000
POISSON_LEVELS = 16
MATRIX_CELLS = 4_000_000
EXPANDED_ROWS = 100_000
CACHE_CELLS = 12_000


def relative_events(
    inputs: DataFrame, stays: DataFrame, stay: str = "ICUSTAY_ID", time: str = "STARTTIME",
    start: str = "INTIME", day: int = 1, span_days: float = 1.0,
) -> DataFrame:
    """Events of one window of each stay, with ``Relative_Day`` in [0, span_days] from the window start."""
    origin = stays.select(stay, F.col(start).alias("__in"))
    rel = days_between(F.col(time), F.col("__in")) - F.lit(float(day - 1))
    joined = lookup_join(inputs.filter(F.col(stay).isNotNull()), origin, [stay])
    return joined.withColumn("Relative_Day", rel).drop("__in").filter(
        F.col("Relative_Day").between(0.0, span_days))


def one_stay(events: DataFrame, stay_id, items: DataFrame | None = None, stay: str = "ICUSTAY_ID",
             item: str = "ITEMID", label: str = "LABEL") -> DataFrame:
    """The table behind one stay's figure, labelled, in time order."""
    rows = events.filter(F.col(stay) == F.lit(stay_id))
    if items is not None:
        rows = lookup_join(rows, items.select(item, label), [item], "left")
    return rows.orderBy("Relative_Day")


def _positive(events: DataFrame, stay: str, amount: str) -> DataFrame:
    step = F.round(F.col("Relative_Day") * F.lit(float(STEPS))).cast("int")
    return events.filter(F.col(amount) > 0).select(
        F.col(stay).alias("stay"), step.alias("step"), F.col(amount).cast("double").alias("amount"))


def _neighbourhoods(x: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """First row of the k nearest rows of each x: leftmost window whose middle is not left of x."""
    n = int(ends[-1])
    if n <= EXPANDED_ROWS:
        rows = np.repeat(x, np.diff(ends, prepend=0))
        return np.searchsorted((rows[:n - k] + rows[k:]) / 2.0, x)
    value_at = lambda row: x[np.searchsorted(ends, row, side="right")]
    low, high = np.zeros(len(x), dtype=np.int64), np.full(len(x), n - k, dtype=np.int64)
    while np.any(low < high):
        mid = (low + high) // 2
        move = (low < high) & (x > (value_at(mid) + value_at(np.minimum(mid + k, n - 1))) / 2.0)
        low, high = np.where(move, mid + 1, low), np.where(move, high, np.minimum(high, mid))
    return low


def local_lines(x: np.ndarray, counts: np.ndarray, means: np.ndarray, fraction: float,
                part: slice = slice(None)) -> np.ndarray:
    """Tricube-weighted local line at each x over the ``fraction`` nearest rows, for several samples.

    ``x`` is sorted and distinct; in sample d, ``counts[d]`` rows share each x and ``means[d]`` is their
    mean. A line depends on rows at one x only through these, so this equals a fit over single rows.
    Only the points of ``part`` are fitted; the others keep their mean.
    """
    fits = np.empty(counts.shape)
    # Small arrays stay in the processor cache: a few samples at a time.
    some = max(1, CACHE_CELLS // len(x) ** 2)
    for d in range(0, len(counts), some):
        fits[d:d + some] = _lines(x, counts[d:d + some], means[d:d + some], fraction, part)
    return fits


def _lines(x: np.ndarray, counts: np.ndarray, means: np.ndarray, fraction: float, part: slice) -> np.ndarray:
    ends = np.cumsum(counts, axis=1)
    starts = ends - counts
    k = (fraction * ends[:, -1] + 1e-10).astype(np.int64)
    left, first, last = (np.zeros(counts.shape, dtype=np.int64) for _ in range(3))
    for d in np.flatnonzero(k >= 2):
        left[d] = _neighbourhoods(x, ends[d], k[d])
        first[d] = np.searchsorted(ends[d], left[d], side="right")
        last[d] = np.searchsorted(ends[d], left[d] + k[d] - 1, side="right")
    radius = np.maximum(x - x[first], x[last] - x)
    fits = means.astype(float).copy()
    chunk = max(1, MATRIX_CELLS // (len(x) * len(counts)))
    begin, end, _ = part.indices(len(x))
    for a in range(begin, end, chunk):
        at = slice(a, min(a + chunk, end))
        near = slice(first[:, at].min(), last[:, at].max() + 1)
        row, r = left[:, at, None], radius[:, at, None]
        used = np.minimum(ends[:, None, near], row + k[:, None, None]) - np.maximum(starts[:, None, near], row)
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = x[near] - x[at, None]
            u = np.abs(gap) / r
            t = np.maximum(1 - u * u * u, 0)
            w = np.maximum(used, 0) * (t * t * t)
            # Moments around the point itself.
            y = means[:, near, None]
            total, m1 = w.sum(axis=2), np.einsum("dps,ps->dp", w, gap)
            m2, q = np.einsum("dps,ps->dp", w, gap * gap), w * gap
            mean_x, mean_y = m1 / total, (w @ y)[:, :, 0] / total
            spread_x = m2 - mean_x * m1
            slope = ((q @ y)[:, :, 0] - m1 * mean_y) / spread_x
            line = mean_y - slope * mean_x
        r = r[:, :, 0]
        line = np.where(spread_x > 1e-12 * total * r * r, line, mean_y)
        fits[:, at] = np.where((k[:, None] >= 2) & (r > 0) & (total > 0), line, fits[:, at])
    return fits


def local_linear(x: np.ndarray, count: np.ndarray, y: np.ndarray, fraction: float) -> np.ndarray:
    """The same for one sample."""
    return local_lines(x, count[None, :], y[None, :], fraction)[0]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of each run of equal keys in sorted batches; only one run is held at a time."""
    held: list[dict[str, np.ndarray]] = []
    current = None
    for batch in batches:
        columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        n = batch.num_rows
        if n == 0:
            continue
        fresh = np.any([columns[k][1:] != columns[k][:-1] for k in keys], axis=0)
        cuts = [0, *(np.flatnonzero(fresh) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(columns[k][a] for k in keys)
            if held and key != current:
                yield {c: np.concatenate([h[c] for h in held]) for c in columns}
                held = []
            held.append({c: v[a:b] for c, v in columns.items()})
            current = key
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}


def _gathered(parts: Iterator[dict[str, np.ndarray]], build) -> Iterator[pa.RecordBatch]:
    """Small results together in one record batch."""
    kept, rows = [], 0
    for part in parts:
        kept.append(part)
        rows += len(part["stay"])
        if rows >= BATCH_ROWS:
            yield build({c: np.concatenate([k[c] for k in kept]) for c in part})
            kept, rows = [], 0
    if kept:
        yield build({c: np.concatenate([k[c] for k in kept]) for c in kept[0]})


def _by_run(df: DataFrame, keys: list[str], order: list[str], function, build, schema: str) -> DataFrame:
    """Apply ``function`` to each run of keys, in Arrow batches; cheaper than a Python call per group."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered((function(run) for run in _runs(source, keys)), build)

    return spread(df, *keys).sortWithinPartitions(*keys, *order).mapInArrow(batches, schema)


def trend(events: DataFrame, stay: str = "ICUSTAY_ID", amount: str = "AMOUNT",
          fraction: float = TREND_FRACTION) -> DataFrame:
    """``(stay, x, trend)`` of every stay. Rows are summed per grid step first, which bounds a run by the seconds of
    the span; the points of a long one are fitted in slices, each in a task of its own with the stay's sums.
    """
    points = _positive(events, stay, amount).groupBy("stay", "step").agg(
        F.count(F.lit(1)).alias("c"), F.avg("amount").alias("y"))
    slices = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("stay")) / SLICE_POINTS).cast("int")
    points = points.withColumn("slices", slices).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    stay_type = points.schema["stay"].dataType.simpleString()

    def fit(run: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x = run["step"] / STEPS
        first = int(run["slice"][0]) * SLICE_POINTS
        part = slice(first, first + SLICE_POINTS)
        fits = local_lines(x, run["c"][None, :], run["y"][None, :], fraction, part)[0]
        return {"stay": run["stay"][part], "x": x[part], "trend": fits[part]}

    def build(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c["stay"]), pa.array(c["x"]), pa.array(c["trend"])],
                               names=["stay", "x", "trend"])

    fitted = _by_run(points, ["stay", "slice"], ["step"], fit, build,
                     f"stay {stay_type}, x double, trend double")
    return fitted.withColumnRenamed("stay", stay)


def poisson_one(u):
    """Poisson(1) count of a uniform draw, by its cumulative probabilities."""
    levels, p, total = [], float(np.exp(-1.0)), 0.0
    for i in range(POISSON_LEVELS):
        total += p
        levels.append(total)
        p /= i + 1
    return sum(((u >= F.lit(c)).cast("int") for c in levels[1:]), (u >= F.lit(levels[0])).cast("int"))


def poisson_draws(who: str, steps: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) counts, one row per draw, from a hash of stay, step, draw and seed: no layout changes them."""
    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    own = mixed(np.array([zlib.crc32(who.encode()) + (seed << 32)], dtype=np.uint64))
    h = mixed(mixed(own + steps.astype(np.uint64))[None, :] + mixed(draws.astype(np.uint64) + np.uint64(1))[:, None])
    levels = np.cumsum([math.exp(-1.0) / math.factorial(i) for i in range(POISSON_LEVELS)])
    return np.searchsorted(levels, (h >> np.uint64(11)) / float(1 << 53), side="right")


def _middle(values, p: float):
    """Interpolated quantile of a short sorted array column."""
    position = (F.size(values) - 1) * F.lit(p)
    low, part = F.floor(position).cast("int"), position - F.floor(position)
    high = F.ceil(position).cast("int")
    return F.get(values, low) * (1 - part) + F.get(values, high) * part


def bootstrap_band(events: DataFrame, stay: str = "ICUSTAY_ID", amount: str = "AMOUNT",
                   draws: int = DRAWS, fraction: float = BAND_FRACTION,
                   seed: int = SEED) -> DataFrame:
    """``(stay, x, lower, upper)``: percentiles of refits on resamples, on the trend's grid.

    A resample gives each row a Poisson(1) count. A grid step with one row is drawn where the line
    is fitted; a step shared by several rows is drawn row by row and summed per (stay, step, draw)
    before the shuffle. So one Python run, a stay and some of its draws, is bounded by the grid
    however many rows the stay has; stays with many steps are cut into blocks of few draws. All draws come from
    hashes of what they are for (equal rows are numbered), so the band does not hang on partitions or blocks.
    """
    rows = _positive(events, stay, amount)
    width = F.when(F.count(F.lit(1)).over(Window.partitionBy("stay")) <= WHOLE_STEPS, F.lit(draws)).otherwise(
        F.lit(min(draws, DRAWS_PER_BLOCK)))
    # A stay has at most STEPS cells, which bounds the window.
    cells = rows.groupBy("stay", "step").agg(
        F.count(F.lit(1)).alias("n"), F.max("amount").alias("amount")).withColumn("width", width)
    last_block = F.ceil(F.lit(draws) / F.col("width")).cast("int") - 1
    single = cells.filter("n = 1").select(
        "stay", F.explode(F.sequence(F.lit(0), last_block)).alias("block"), "step", "width",
        F.lit(-1).alias("slot"), F.lit(0).cast("long").alias("c"), F.col("amount").alias("cy"))
    shared = (
        lookup_join(rows, cells.filter("n > 1").select("stay", "step", "width"), ["stay", "step"])
        .groupBy("stay", "step", "amount", "width").agg(F.count(F.lit(1)).cast("int").alias("rows"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        .withColumn("u", F.shiftrightunsigned(F.xxhash64("stay", "step", "amount", "copy", "draw", F.lit(seed)), 11) / float(1 << 53))
        .withColumn("c", poisson_one(F.col("u")))
        .groupBy("stay", F.floor(F.col("draw") / F.col("width")).cast("int").alias("block"), "step", "width",
                 F.pmod("draw", "width").alias("slot"))
        .agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("amount")).alias("cy"))
    )
    stay_type = rows.schema["stay"].dataType.simpleString()

    def refit(run: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        who, block, width = run["stay"][0], int(run["block"][0]), int(run["width"][0])
        step, at = np.unique(run["step"], return_inverse=True)
        slot, y = run["slot"], run["cy"]
        samples = min(width, draws - block * width)
        count, total = np.zeros((2, samples, len(step)))
        own = slot < 0
        count[:, at[own]] = poisson_draws(str(who), run["step"][own], np.arange(samples) + block * width, seed)
        total[:, at[own]] = count[:, at[own]] * y[own]
        count[slot[~own], at[~own]] = run["c"][~own]
        total[slot[~own], at[~own]] = y[~own]
        x = step / STEPS
        lines = local_lines(x, count.astype(np.int64), total / np.maximum(count, 1), fraction)
        fits = np.full((samples, len(step)), np.nan)
        for i in range(samples):
            hit = count[i] > 0
            if hit.any():
                fits[i] = np.interp(x, x[hit], lines[i, hit])
        values = np.empty(len(step), dtype=object)
        values[:] = list(fits.T)
        return {"stay": np.repeat(run["stay"][:1], len(step)), "step": step, "fits": values}

    def build(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, c["fits"])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(list(c["fits"]))))
        return pa.record_batch([pa.array(c["stay"]), pa.array(c["step"].astype(np.int32)), lists],
                               names=["stay", "step", "fits"])

    fits = _by_run(single.unionByName(shared), ["stay", "block"], ["step", "slot"], refit, build,
                   f"stay {stay_type}, step int, fits array<double>")
    # One array per block: at most ``draws`` values per (stay, step).
    values = F.array_sort(F.filter(F.flatten(F.collect_list("fits")), lambda v: ~F.isnan(v)))
    return (
        fits.groupBy("stay", "step").agg(values.alias("v")).filter(F.size("v") > 0)
        .select(F.col("stay").alias(stay), (F.col("step") / F.lit(float(STEPS))).alias("x"),
                _middle(F.col("v"), BAND[0]).alias("lower"), _middle(F.col("v"), BAND[1]).alias("upper"))
    )
