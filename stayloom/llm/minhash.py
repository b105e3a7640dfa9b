"""Near-duplicate documents by SuperMinHash signatures.

Each shingle draws a random permutation of the signature's places, one place per step, and offers there the step
number plus a random fraction; a place keeps the smallest offer. The ranks of one shingle are thus correlated, which
lowers the variance, and once all places of a document are below the next step it is finished. Steps run over all
shingles of many documents at once. Bands of the signature give buckets; a bucket's members meet its hub, later
those of other components; candidates are confirmed on full shingle sets, and components name the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..session import written
from .common import give_back, giving_back, small_batches
from .components import components

BANDS, ROWS = 32, 5
PLACES = BANDS * ROWS
BLOCK = 512
BLOCK_BYTES = 8_000_000  # of the full sets on either side of a block
SLICE_BYTES = 1_000_000
REPLAY = 8  # from this step on the permutations of the few shingles left are kept whole
MISS = 0.13  # an estimate this far below the threshold rules a pair out: more than four standard deviations
BASE = np.uint64(0x100000001B3)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
# Fixed values of the contract: the six white-space bytes that part words, and A-Z taken as a-z.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            inverse = np.uint64(pow(int(BASE), -1, 2**64))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, inverse)], dtype=np.uint64)
        return self.up, self.down


def shingle_sets(texts: list[str | None], size: int, powers: Powers) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text. Fewer words than ``size`` are one shingle, no word none."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
    begins = np.cumsum([0, *[len(r) + 1 for r in raw]])
    up, down = powers.upto(len(data))
    space = SPACE[data]
    before = np.r_[True, space[:-1]] if len(data) else space
    start = np.flatnonzero(~space & before)
    stop = np.flatnonzero(space & ~before)  # every word is followed by white space
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((LOWER[data] + np.uint64(1)) * up[:len(data)], out=sums[1:])
    words = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * GOLDEN)
    bounds = np.searchsorted(start, begins)
    rolled = np.full(max(len(words) - size + 1, 0), np.uint64(size))
    for k in range(size):
        rolled = mix(rolled * BASE + words[k:k + len(rolled)])
    sets = []
    for a, b in zip(bounds, bounds[1:]):
        n = b - a
        if n >= size:
            sets.append(np.unique(rolled[a:b - size + 1]))
        elif n:
            one = np.full(1, np.uint64(n))
            for w in words[a:b]:
                one = mix(one * BASE + w)
            sets.append(one)
        else:
            sets.append(np.empty(0, dtype=np.uint64))
    return sets


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """SuperMinHash signatures; an offer is ``step << 32 | fraction``. Rows of empty sets hold the largest value."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    best = np.full(len(sets) * places, np.iinfo(np.uint64).max, dtype=np.uint64)
    element = np.concatenate(sets) if len(sets) else np.empty(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    picks: list[np.ndarray] = []
    whole: np.ndarray | None = None
    for step in range(places):
        if not len(element):
            break
        draw = mix(element + np.uint64((step + 1) * int(GOLDEN) % 2**64))
        pick = step + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(places - step)) >> np.uint64(32)).astype(np.int64)
        if whole is None:
            place = pick.copy()
            for k in range(step - 1, -1, -1):  # where the swaps so far have put what the pick finds
                place = np.where(picks[k] == place, k, place)
            picks.append(pick)
        else:
            every = np.arange(len(element))
            place = whole[every, pick]
            whole[every, pick] = whole[:, step]
        np.minimum.at(best, owner * places + place, (np.uint64(step) << np.uint64(32)) | (draw >> np.uint64(32)))
        finished = best.reshape(-1, places).max(axis=1) < np.uint64((step + 1) << 32)
        going = ~finished[owner]
        if not going.all():
            element, owner = element[going], owner[going]
            picks = [p[going] for p in picks]
            whole = whole[going] if whole is not None else None
        if step + 1 == REPLAY:
            whole = np.tile(np.arange(places, dtype=np.int16), (len(element), 1))
            every = np.arange(len(element))
            for k, p in enumerate(picks):
                moved = whole[every, p]
                whole[every, p] = whole[:, k]
                whole[:, k] = moved
            picks = []
    return best.reshape(-1, places)


def short(signature: np.ndarray) -> np.ndarray:
    """16 bits of each place, enough to compare places for equality."""
    return (mix(signature) >> np.uint64(48)).astype(np.uint16)


def slices(batch: pd.Series) -> Iterator[list[str | None]]:
    part: list[str | None] = []
    size = 0
    for text in batch:
        part.append(text)
        size += len(text or "")
        if size >= SLICE_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def sign(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, digest, signature``; equal sets have equal digests."""

    @F.pandas_udf("n long, digest binary, signature binary")
    @giving_back
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for batch in batches:
            out = []
            for part in slices(batch):
                sets = shingle_sets(part, size, powers)
                for s, row in zip(sets, short(signatures(sets))):
                    out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), row.tobytes()))
            yield pd.DataFrame(out, columns=["n", "digest", "signature"])
            give_back()

    return docs.select("doc_id", signed("text").alias("s")).select(
        "doc_id", F.col("s.n").alias("n_shingles"), "s.digest", "s.signature")


def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal places of two signatures."""
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (np.frombuffer(b"".join(s), dtype=np.uint16).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


def shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two sorted sets."""
    return pd.Series([
        common(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) for x, y in zip(a, b)], dtype="int64")


def common(x: np.ndarray, y: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def full_sets(docs: DataFrame, ids: DataFrame, size: int, repeated: bool) -> DataFrame:
    """``doc_id, elements`` of the documents named in ``ids``.

    The ids are broadcast while they are measured to be few, so that texts are not shuffled to find them.
    """

    @F.pandas_udf("binary")
    @giving_back
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        powers = Powers()
        for batch in batches:
            yield pd.Series([s.tobytes() for part in slices(batch) for s in shingle_sets(part, size, powers)], dtype=object)

    own = lookup_join(docs.select("doc_id", "text"), written(ids, "ids"), ["doc_id"], "left_semi")
    sets = own.select("doc_id", packed("text").alias("elements"))
    return sets.dropDuplicates(["doc_id"]) if repeated else sets


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int, repeated: bool) -> DataFrame:
    """The pairs ``(u, v)`` whose full sets are similar enough."""
    ids = pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct()
    sets = written(full_sets(docs, ids, size, repeated), "sets")
    one = sets.select(F.col("doc_id").alias("u"), F.col("elements").alias("a"))
    two = sets.select(F.col("doc_id").alias("v"), F.col("elements").alias("b"))
    both = F.col("both")
    sizes = (F.octet_length("a") + F.octet_length("b")) / 8
    return (
        pairs.join(one, "u").join(two, "v").select("u", "v", sizes.cast("long").alias("sum"), F.pandas_udf(shared, "long")("a", "b").alias("both"))
        .filter(both * 100 >= (F.col("sum") - both) * percent).select("u", "v"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``(doc_id, text)``; other columns are ignored.

    Two documents are linked if ``100 * intersection >= percent * union`` of their sets of distinct ``size``-word
    shingles; a group is a component of links, named by its smallest id, and only that document is kept. Texts
    that are null, empty or without words have an empty set, link with nothing and are kept, and so are rows without id. Rows with
    one id are one document and expected to have one text. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    signed = written(sign(docs, size), "signed")
    able = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = written(
        signed.filter(able).groupBy("digest").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")),
        "classes")
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    banded = classes.select("rep", "n", "signature", band).select(
        F.xxhash64("band", F.expr(f"substring(signature, band * {2 * ROWS} + 1, {2 * ROWS})")).alias("bucket"), "rep", "n")
    hubs = banded.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count(F.lit(1)).alias("members"))
    buckets = written(banded.join(hubs.filter("members > 1").drop("members"), "bucket"), "buckets")
    least = 1.0 * percent / 100 - MISS
    sizes_fit = F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent
    met = buckets.filter((F.col("rep") != F.col("hub.rep")) & sizes_fit).select(
        F.col("rep").alias("u"), F.col("hub.rep").alias("v")).distinct()
    one = classes.select(F.col("rep").alias("u"), F.col("signature").alias("a"))
    two = classes.select(F.col("rep").alias("v"), F.col("signature").alias("b"))
    likely = met.join(one, "u").join(two, "v").filter(F.pandas_udf(alike, "double")("a", "b") >= least).select("u", "v")
    ids = signed.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count()
    repeated = ids.filter("count > 1").limit(1).count() > 0
    links = written(confirm(written(likely, "hub-pairs"), docs, size, percent, repeated), "hub-links")
    known = components(links, "hub-components").withColumnRenamed("node", "rep")
    placed = buckets.join(known, "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    late = written(late_links(written(placed, "placed"), classes, docs, size, percent, least, repeated), "late-links")
    if late.limit(1).count():
        known = components(links.unionByName(late), "all-components").withColumnRenamed("node", "rep")
    named = classes.select("digest", "rep").join(known, "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component"))
    grouped = signed.filter(able).select("doc_id", "n_shingles", "digest").join(named, "digest").select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = signed.filter(~able).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def late_links(placed: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, least: float,
               repeated: bool) -> DataFrame:
    """Links ``(u, v)`` between different components that share a bucket.

    A bucket's largest component is its main one, the members outside it (few, after the hubs) its strays. All strays
    of a main component meet all its members and each other, both sides in blocks: first by size and signature,
    which only marks who has a likely partner, then those by their full sets. Neither step sends pairs that fail.
    """
    counts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("bucket").agg(
        F.max(F.struct("n", "component"))["component"].alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")
    ).filter("all > most").select("bucket", "main")
    strays = placed.join(main, "bucket").filter("component <> main").select("main", "rep", "component").distinct()
    strays = written(strays.withColumn("stray", F.lit(True)), "strays")
    members = placed.select("rep", "component").distinct().join(
        strays.select(F.col("main").alias("component")).distinct(), "component").select(
        F.col("component").alias("main"), "rep", "component", F.lit(False).alias("stray"))
    sides = strays.unionByName(members).join(classes.select("rep", "n", "signature"), "rep")
    likely = blocks(sides, block_counts(sides, F.lit(0))).groupBy("main", "left", "right").applyInPandas(
        lambda rows: marked(rows, percent, least), "main long, rep long").distinct()
    likely = written(likely, "likely")
    sets = full_sets(docs, likely.select(F.col("rep").alias("doc_id")).distinct(), size, repeated).withColumnRenamed("doc_id", "rep")
    open_sides = sides.join(likely, ["main", "rep"])
    return blocks(open_sides, block_counts(open_sides, 8 * F.col("n"))).join(sets, "rep").groupBy("main", "left", "right").applyInPandas(
        lambda rows: linked(rows, percent, least), "u long, v long").distinct()


def block_counts(sides: DataFrame, size: Column) -> DataFrame:
    """Number of blocks of strays and of all rows of each main component: by rows, and by ``size``, the bytes of a row's set."""
    per = lambda n, of: F.ceil(F.greatest(n / BLOCK, F.coalesce(F.sum(of), F.lit(0)) / BLOCK_BYTES, F.lit(1.0))).cast("int")
    stray = F.col("stray")
    return written(sides.groupBy("main").agg(
        per(F.count(F.when(stray, 1)), F.when(stray, size)).alias("lefts"), per(F.count(F.lit(1)), size).alias("rights")), "blocks")


def blocks(sides: DataFrame, sizes: DataFrame) -> DataFrame:
    """Strays dealt to a ``left`` block and all ``right`` ones (``side`` 0), all rows the other way round (``side`` 1)."""
    number = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["main", "left", "right", "side", "rep", "component", "n", "signature"]
    sized = sides.join(sizes, "main")
    left = sized.filter("stray").withColumn("left", number("lefts")).withColumn("right", every("rights"))
    right = sized.withColumn("right", number("rights")).withColumn("left", every("lefts"))
    return left.withColumn("side", F.lit(0)).select(*columns).unionByName(right.withColumn("side", F.lit(1)).select(*columns))


def partners(rows: pd.DataFrame, percent: int, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Row number of each stray of a block and those of the rows of other components that may be linked with it."""
    side = rows["side"].to_numpy()
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(a) or not len(b):
        return
    places = np.frombuffer(b"".join(rows["signature"]), dtype=np.uint16).reshape(len(rows), -1)
    component, n = rows["component"].to_numpy(), rows["n"].to_numpy()
    for i in a:
        at = b[(component[b] != component[i]) & (np.minimum(n[b], n[i]) * 100 >= np.maximum(n[b], n[i]) * percent)]
        at = at[(places[at] == places[i]).mean(axis=1) >= least]
        if len(at):
            yield i, at


def marked(rows: pd.DataFrame, percent: int, least: float) -> pd.DataFrame:
    seen = np.zeros(len(rows), dtype=bool)
    for i, at in partners(rows, percent, least):
        seen[i] = seen[at] = True
    return rows.loc[seen, ["main", "rep"]].drop_duplicates()


def linked(rows: pd.DataFrame, percent: int, least: float) -> pd.DataFrame:
    """Links confirmed on full sets. One link of a stray to a component is enough."""
    rep, component = rows["rep"].to_numpy(), rows["component"].to_numpy()
    sets = [np.frombuffer(e, dtype=np.uint64) for e in rows["elements"]]
    out = set()
    for i, at in partners(rows, percent, least):
        done = set()
        for j in at:
            if component[j] not in done:
                both = common(sets[i], sets[j])
                if both * 100 >= (len(sets[i]) + len(sets[j]) - both) * percent:
                    done.add(component[j])
                    out.add((max(rep[i], rep[j]), min(rep[i], rep[j])))
    return pd.DataFrame(sorted(out), columns=["u", "v"], dtype="int64")
