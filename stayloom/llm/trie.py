"""Prefix trie of conversations, screened by a count-min sketch.

Each turn becomes a digest of its role and text, each prefix the exclusive-or of its turns' digests mixed with their
places; from then on no text moves. A count-min sketch counts all prefixes. Where it estimates one, the prefix belongs
to one conversation alone: that node and all below it are written down where they are. Only the prefixes that may
be shared are grouped exactly. A conversation owns the nodes of which it is the smallest member, which are all of its
path from some depth on; so sums over a subtree are sums over its members of what lies on their own paths.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..session import written
from .common import small_batches
from .mixing import words

ROWS = 4  # of the sketch
MAX_CELLS = 1 << 24  # of each row: two megabytes of bits
CELLS_PER_PREFIX = 4
CHUNK = 1 << 18
BLOCK = 4096  # conversation ids that may stand in one block of ids
NODE = ["a", "b"]


def turn_digests(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, x, y, words, copies`` of the different turns; rows without ``conv_id`` are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    number = lambda start: F.conv(F.substring(F.col("digest"), start, 15), 16, 10).cast("long")
    slim = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), words(text).cast("long").alias("words"),
        digest.alias("digest"))
    return slim.select("conv_id", "turn", "role", "words", number(1).alias("x"), number(16).alias("y")).groupBy(
        "conv_id", "turn", "role", "x", "y", "words").agg(F.count(F.lit(1)).alias("copies"))


def running(rows: DataFrame, key: str, order: list[str], sums: dict[str, str], xors: dict[str, str], name: str) -> DataFrame:
    """Add running sums and exclusive-ors of columns within each key, up to and with each row, and ``last``.

    Rows are dealt by ranges of key and order, so a key with many rows lies in several parts; what came before
    in other parts is added at the end. Only keys at the edges of parts can do so: at most two a part.
    """
    spark = rows.sparkSession
    parts = written(rows.repartitionByRange(key, *order).withColumn("part", F.spark_partition_id()), name)
    edges = parts.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()
    seen: dict[int, int] = {}
    for e in edges:
        for k in {e["low"], e["high"]}:
            seen[k] = seen.get(k, 0) + 1
    divided = spark.createDataFrame([(k,) for k, n in seen.items() if n > 1], f"{key} long")
    totals = parts.join(F.broadcast(divided), key, "left_semi").groupBy(key, "part").agg(
        *[F.sum(c).alias(c) for c in sums.values()], *[F.bit_xor(c).alias(c) for c in xors.values()])
    earlier = W.partitionBy(key).orderBy("part")
    so_far = earlier.rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(
        key, "part", *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"before_{n}") for n, c in sums.items()],
        *[F.coalesce(F.bit_xor(c).over(so_far), F.lit(0)).alias(f"before_{n}") for n, c in xors.items()],
        F.lead(F.lit(True), 1, False).over(earlier).alias("more"))
    within = W.partitionBy(key, "part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    local = within.rowsBetween(W.unboundedPreceding, 0)
    counted = parts.select(
        "*", *[F.sum(c).over(local).alias(n) for n, c in sums.items()], *[F.bit_xor(c).over(local).alias(n) for n, c in xors.items()],
        F.lead(F.lit(False), 1, True).over(within).alias("last"))
    earlier_of = lambda n: F.coalesce(F.col(f"before_{n}"), F.lit(0))
    return counted.join(F.broadcast(before), [key, "part"], "left").select(
        *rows.columns, *[(F.col(n) + earlier_of(n)).alias(n) for n in sums],
        *[F.col(n).bitwiseXOR(earlier_of(n)).alias(n) for n in xors],
        (F.col("last") & ~F.coalesce("more", F.lit(False))).alias("last"))


def positions(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, x, y, words`` of each turn, ``place`` from 0 by turn (null first); ties go by role, then digest."""
    counted = running(turn_digests(conversations), "conv_id", ["turn", "role", "x", "y"], {"reached": "copies"}, {}, "turns")
    place = F.explode(F.sequence(F.col("reached") - F.col("copies"), F.col("reached") - 1)).alias("place")
    return counted.select("conv_id", place, "x", "y", "words")


def as_they_are(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return placed, placed.select("conv_id").limit(0)


def cells(a: np.ndarray, b: np.ndarray, width: int) -> list[np.ndarray]:
    """Cell of each prefix in each row of the sketch. ``width`` is a power of two."""
    a, b = a.astype(np.int64).view(np.uint64), b.astype(np.int64).view(np.uint64) | np.uint64(1)
    return [((a + np.uint64(r) * b) >> np.uint64(5)) & np.uint64(width - 1) for r in range(ROWS)]


def sketch(prefixes: DataFrame, width: int) -> np.ndarray:
    """For each row of the sketch and cell, whether it counts two or more prefixes.

    Tasks count their own prefixes in two bits a cell (none, one, more); chunks of cells are then merged as they
    come in, and one bit a cell reaches the driver: ROWS x ``width`` bits, at most 8 MB.
    """
    small_batches(prefixes.sparkSession)
    size = min(CHUNK, width)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros((ROWS, width), dtype=np.uint8)
        for batch in batches:
            for r, at in enumerate(cells(batch["a"].to_numpy(), batch["b"].to_numpy(), width)):
                once, n = np.unique(at.astype(np.int64), return_counts=True)
                count[r, once] = np.minimum(count[r, once] + np.minimum(n, 2), 2)
        for k, own in enumerate(count.reshape(-1, size)):
            if own.any():
                yield pd.DataFrame({"chunk": [k], "once": [packed(own > 0)], "more": [packed(own > 1)]})

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, once, more in zip(batch["chunk"], batch["once"], batch["more"]):
                one, two = unpacked(once), unpacked(more)
                if k in found:
                    had, had_two = found[k]
                    one, two = had | one, had_two | two | (had & one)
                found[k] = one, two
        for k, (_, two) in found.items():
            yield pd.DataFrame({"chunk": [k], "more": [zlib.compress(two.tobytes(), 1)]})

    per_task = prefixes.mapInPandas(counted, "chunk int, once binary, more binary")
    whole = np.zeros((ROWS * width // size, max(size // 8, 1)), dtype=np.uint8)
    for r in per_task.repartition("chunk").mapInPandas(merged, "chunk int, more binary").toLocalIterator():
        whole[r["chunk"]] = np.frombuffer(zlib.decompress(r["more"]), dtype=np.uint8)
    return whole.reshape(ROWS, -1)


def packed(bits: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=np.uint8)


def alone(bits: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether the sketch proves that a prefix it has counted occurs once."""
    found = np.zeros(len(a), dtype=bool)
    for r, at in enumerate(cells(a, b, width)):
        at = at.astype(np.int64)
        found |= ((bits[r][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1) == 0
    return found


def screened(prefixes: DataFrame, width: int) -> DataFrame:
    """Add ``single`` (proven to be of one conversation) and ``follows`` (its parent is proven to be so too)."""
    shared = prefixes.sparkSession.sparkContext.broadcast(sketch(prefixes.select(*NODE), width))

    @F.pandas_udf("single boolean, follows boolean")
    def judged(a: pd.Series, b: pd.Series, u: pd.Series, v: pd.Series, depth: pd.Series) -> pd.DataFrame:
        a, b, u, v = (c.to_numpy(dtype=np.int64) for c in (a, b, u, v))
        follows = alone(shared.value, a ^ u, b ^ v, width) & (depth.to_numpy() > 1)
        return pd.DataFrame({"single": alone(shared.value, a, b, width) | follows, "follows": follows})

    return prefixes.withColumn("s", judged("a", "b", "u", "v", "depth")).select("*", "s.single", "s.follows").drop("s", "u", "v")


def trie(conversations: DataFrame, rearrange: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = as_they_are,
         max_cells: int = MAX_CELLS) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie of ``(conv_id, turn, role, text)``, and who ends at the shared ones.

    A node is a sequence of first turns (role, text) of some conversation, of ``depth`` 0 or more. Nodes have ``a, b`` (the
    digest), ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends`` (members
    that end there) and ``single`` (found by the sketch). The other table holds ``a, b, conv_id`` for the ends at other nodes.

    Null roles and texts count as empty, null turns come first, turns that tie go by role, then by digest, and a repeated row
    is a repeated turn. Rows without ``conv_id`` are left out; other columns are ignored. An empty table has no node.
    ``rearrange`` may change the placed turns (see ``positions``) and returns them, with places from 0 without gaps, and the ids
    of conversations without turns. The sketch has at most ``max_cells`` cells a row; beyond some four times as many prefixes
    it proves little, and more is grouped exactly with the same result.
    """
    placed, turnless = rearrange(written(positions(conversations), "places"))
    mixed = placed.select(
        "conv_id", (F.col("place") + 1).alias("depth"), "words",
        F.xxhash64("x", "y", "place").alias("u"), F.xxhash64(F.lit(1), "y", "place", "x").alias("v"))
    paths = running(mixed, "conv_id", ["depth"], {"reached": "words"}, {"a": "u", "b": "v"}, "turn-digests")
    paths = written(paths, "paths")
    width = 1 << max(10, int(CELLS_PER_PREFIX * max(paths.count(), 1) - 1).bit_length())
    marked = written(screened(paths, min(width, max_cells)), "marked")
    columns = ["conv_id", "depth", "words", "reached", "a", "b", "last"]
    zero = F.lit(0).cast("long")
    root = lambda ids, last: ids.select(
        "conv_id", zero.alias("depth"), zero.alias("words"), zero.alias("reached"), zero.alias("a"), zero.alias("b"), F.lit(last).alias("last"))
    shared = marked.filter(~F.col("single")).select(*columns).unionByName(
        root(marked.filter("depth = 1"), False)).unionByName(root(turnless, True))
    shared = written(shared, "shared")
    owners = written(shared.groupBy(*NODE).agg(
        F.min("conv_id").alias("owner"), (F.count(F.lit(1)) == F.sum(F.col("last").cast("int"))).alias("childless")), "owners")
    tails = marked.filter("single")
    owned = written(lookup_join(shared, owners, NODE), "owned").unionByName(
        tails.select(*columns, F.col("conv_id").alias("owner"), F.col("last").alias("childless")))
    own = F.col("owner") == F.col("conv_id")
    convs = written(owned.groupBy("conv_id").agg(
        F.min(F.when(own, F.col("depth"))).alias("since"),
        F.max(F.when(~own, F.struct("depth", "owner")))["owner"].alias("above"),
        F.coalesce(F.max(F.when(~own, F.col("reached"))), zero).alias("borrowed"),
        F.max((own & F.col("last") & F.col("childless")).cast("long")).alias("leaf")), "conversations")
    above = F.when(F.col("since") < F.col("depth"), F.col("conv_id")).otherwise(F.col("above"))
    known = lookup_join(shared, convs, ["conv_id"])
    saved = F.greatest(F.col("borrowed") - F.col("reached") + F.col("words"), zero)
    exact = known.withColumn("parent", above).groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min_by("parent", "conv_id").alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum((~F.col("last") & (F.coalesce("since", F.col("depth") + 2) <= F.col("depth") + 1)).cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"), F.sum(F.col("last").cast("long")).alias("n_ends"),
    ).withColumn("single", F.lit(False))
    exact = exact.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id")))
    local = lambda rows, parent: rows.select(
        *NODE, "conv_id", "depth", parent.alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        (~F.col("last")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"),
        F.col("last").cast("long").alias("n_ends"), F.lit(True).alias("single"))
    first = lookup_join(tails.filter(~F.col("follows")), convs, ["conv_id"])
    nodes = exact.unionByName(local(tails.filter("follows"), F.col("conv_id"))).unionByName(local(first, above))
    return nodes, shared.filter("last").select(*NODE, "conv_id")


def end_digests(ends: DataFrame) -> DataFrame:
    """``a, b, ends_sha256``: SHA-256 of the decimal conversation ids that end at a node, ascending, joined by commas.

    Ids are joined in blocks of BLOCK possible ids; a node's blocks then pass in order through one hash, which
    no more than one task can do, but which holds one batch of them at a time.
    """
    small_batches(ends.sparkSession)
    block = F.expr(f"conv_id div {BLOCK} - int(conv_id % {BLOCK} < 0)").alias("block")  # rounded down
    joined = ends.groupBy(*NODE, block).agg(F.array_sort(F.collect_list("conv_id")).alias("ids")).select(
        *NODE, "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(batch["a"], batch["b"], batch["ids"]):
                if (a, b) == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(done, columns=["a", "b", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=["a", "b", "ends_sha256"])

    ordered = joined.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids")
    return ordered.mapInPandas(hashed, "a long, b long, ends_sha256 string")
