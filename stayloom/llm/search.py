"""Nearest neighbours by vantage-point trees, one or a few per shard.

The largest inner product becomes the smallest distance once every vector is divided by the longest norm and gets one more
component that lifts it to norm one (queries are scaled to norm one, with 0 there). A tree splits its points at the median
distance from a vantage point; a side is skipped if the triangle inequality puts all of it beyond ``factor`` times the
query's distance to its k-th best. Factor one is exact, smaller ones skip more. A block of queries walks a tree together.

Products of whole blocks only rule points out, with a margin for their rounding; what is left is compared by the product
added in order, then by id. Vectors of very different norms are in different trees, so that the margin stays small.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .vectors import matrix, usable

SHARD = 8192
QUERIES = 4096
LEAF = 128


NORMS = 8  # powers of two of the norm in one tree
CHUNK = 2_000_000  # components multiplied at once
EPS = float(np.finfo(float).eps)


@dataclass
class Tree:
    """Points in tree order. A node spans some, its vantage point first; a leaf has no ``inner`` and ``outer``."""

    points: np.ndarray  # different vectors
    longest: float  # norm
    ids: np.ndarray  # of all points in turn, the smallest of each in order
    first: np.ndarray  # place of each point's ids, and the end
    nodes: list[dict] = field(default_factory=list)


def norms(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1)
    return top * np.linalg.norm(x / top[:, None], axis=1)


def forest(vectors: np.ndarray, ids: np.ndarray, keep: int, seed: int) -> list[Tree]:
    """A tree for each class of norms, longest first."""
    size = np.frexp(norms(vectors))[1] // NORMS
    return [build(vectors[size == c], ids[size == c], keep, seed) for c in np.unique(size)[::-1]]


def build(vectors: np.ndarray, ids: np.ndarray, keep: int, seed: int) -> Tree:
    """Equal vectors are one point with its ``keep`` smallest ids, more of which no answer can hold."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    different, place = np.unique(vectors, axis=0, return_inverse=True)
    place = place.ravel()
    members = np.split(np.argsort(place, kind="stable"), np.cumsum(np.bincount(place))[:-1])
    longest = float(norms(different).max())
    x = different / longest
    x = np.c_[x, np.sqrt(np.maximum(1.0 - np.einsum("ij,ij->i", x, x), 0.0))]
    random = np.random.default_rng(seed)
    line = np.arange(len(x))
    nodes: list[dict] = []
    todo = [(0, len(x), -1, "")]
    while todo:
        start, stop, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][side] = me
        if stop - start <= LEAF:
            nodes.append({"start": start, "stop": stop})
            continue
        pick = start + int(random.integers(stop - start))
        line[[start, pick]] = line[[pick, start]]
        rest = line[start + 1:stop]
        d = np.linalg.norm(x[rest] - x[line[start]], axis=1)
        by = np.argsort(d, kind="stable")
        line[start + 1:stop], d = rest[by], d[by]
        half = len(d) // 2
        nodes.append({"start": start, "stop": stop, "far": float(d[half - 1]), "near": float(d[half]),
                      "border": float((d[half - 1] + d[half]) / 2)})
        todo += [(start + 1, start + 1 + half, me, "inner"), (start + 1 + half, stop, me, "outer")]
    own = [ids[members[i]][:keep] for i in line]
    return Tree(different[line], longest, np.concatenate(own), np.cumsum([0, *map(len, own)]), nodes)


class Search:
    """Best ``k`` ids of trees for a block of queries, without the queries' own ids: by product, then the smaller id."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float):
        self.queries, self.own, self.k, self.factor = queries, own, k, factor
        self.norm = norms(queries)
        self.unit = queries / self.norm[:, None]
        self.margin = 4.0 * (queries.shape[1] + 8) * EPS  # of a product of two vectors of norm one, both ways of adding
        self.score = np.full((len(queries), k), -np.inf)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max)

    def over(self, tree: Tree) -> None:
        self.tree = tree
        self.walk(0, np.arange(len(self.queries)))

    def bound(self, who: np.ndarray) -> np.ndarray:
        """Product of the k-th best so far, in the tree's scale."""
        return self.score[who, -1] / self.norm[who] / self.tree.longest

    def products(self, who: np.ndarray, start: int, stop: int) -> np.ndarray:
        return self.unit[who] @ (self.tree.points[start:stop].T / self.tree.longest)

    def offer(self, who: np.ndarray, product: np.ndarray, start: int) -> None:
        least = self.bound(who)
        if product.shape[1] > self.k:  # one more than k: a query may find itself
            least = np.maximum(least, np.partition(product, -(self.k + 1), axis=1)[:, -(self.k + 1)])
        row, column = np.nonzero(product >= least[:, None] - 2.0 * self.margin)
        step = max(1, CHUNK // self.queries.shape[1])
        for at in range(0, len(row), step):
            self.merge(who[row[at:at + step]], start + column[at:at + step])

    def merge(self, row: np.ndarray, point: np.ndarray) -> None:
        """Ties at the k-th place are decided by id among all points offered."""
        score = in_order(self.queries[row], self.tree.points[point])
        able = score >= self.score[row, -1]
        row, point, score = row[able], point[able], score[able]
        first, many = self.tree.first[point], self.tree.first[point + 1] - self.tree.first[point]
        each = np.repeat(np.arange(len(row)), many)
        ids = self.tree.ids[first[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)]
        row, score = row[each], score[each]
        able = (ids != self.own[row]) & ((score > self.score[row, -1]) | (ids < self.id[row, -1]))
        if not able.any():
            return
        queries, line = np.unique(row[able], return_inverse=True)
        line = np.r_[np.repeat(np.arange(len(queries)), self.k), line.ravel()]
        score = np.r_[self.score[queries].ravel(), score[able]]
        ids = np.r_[self.id[queries].ravel(), ids[able]]
        order = np.lexsort((ids, -score, line))
        place = np.arange(len(order)) - np.searchsorted(line[order], np.arange(len(queries)))[line[order]]
        kept = order[place < self.k].reshape(len(queries), self.k)
        self.score[queries], self.id[queries] = score[kept], ids[kept]

    def walk(self, node: int, who: np.ndarray) -> None:
        # No vector of the tree has a larger product than the longest in the query's direction.
        who = who[self.bound(who) <= 1.0 + 2.0 * self.margin]
        if not len(who):
            return
        here = self.tree.nodes[node]
        product = self.products(who, here["start"], here["start"] + 1 if "inner" in here else here["stop"])
        self.offer(who, product, here["start"])
        if "inner" not in here:
            return
        square = np.maximum(2.0 - 2.0 * product[:, 0], 0.0)
        within = square < here["border"] ** 2
        self.walk(here["inner"], who[within])
        self.walk(here["outer"], who[~within])
        # A lower bound on the distance to the other side; rounding of the squares gets a margin.
        slack = 8.0 * self.margin
        reach = np.sqrt(np.maximum(2.0 - 2.0 * self.bound(who), 0.0) * self.factor ** 2 + slack)
        self.walk(here["outer"], who[within & (here["near"] - np.sqrt(square + slack) <= reach)])
        self.walk(here["inner"], who[~within & (np.sqrt(np.maximum(square - slack, 0.0)) - here["far"] <= reach)])


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from the first component to the last."""
    return np.add.accumulate(a * b, axis=1)[:, -1] if len(a) else np.empty(0)


def search_shard(trees: list[Tree], queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> pd.DataFrame:
    found = Search(queries, own, k, factor)
    for tree in trees:
        found.over(tree)
    row, place = np.nonzero(found.score > -np.inf)
    return pd.DataFrame({"query_id": own[row], "vec_id": found.id[row, place], "score": found.score[row, place]})


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product for each query, its own id left out.

    Both tables need ``vec_id`` and ``embedding``; other columns are ignored. Vectors that are null, empty, zero or hold null or
    non-finite components and rows without id take no part, nor do queries of another length than a shard's vectors.
    Rows with one id are one vector, the smallest. Ties go to the smaller id. Fewer candidates give fewer rows, empty
    tables none. With ``factor`` 1 the answer is exact; below it sides are skipped that might hold one.
    """
    def clean(df: DataFrame) -> DataFrame:
        return (
            df.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
            .groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding")))

    base, asked = written(clean(embeddings), "vectors"), written(clean(queries), "queries")
    by_dim = base.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    shards = by_dim.withColumn("shards", F.ceil(F.col("n") / SHARD).cast("int"))
    blocks = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
    size = shards.join(blocks, "dim")
    part = F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")

    def grown(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        trees = forest(matrix(rows["embedding"]), rows["vec_id"].to_numpy(), k + 1, key[1])
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "trees": [pickle.dumps(trees)]})

    index = written(
        base.join(size, "dim").withColumn("shard", part).groupBy("dim", "shard")
        .applyInPandas(grown, "dim int, shard int, trees binary"), "index")
    # Every block of queries meets every shard: each side is dealt to the blocks of the other.
    trees = index.join(size.select("dim", "blocks"), "dim").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("dim", "shard", "block", "trees")
    dealt = asked.join(size.select("dim", "shards", "blocks"), "dim").withColumn(
        "block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("dim", "shard", "block", "vec_id", "embedding")

    def searched(key: tuple, rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or trees.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return search_shard(pickle.loads(trees["trees"].iat[0]), matrix(rows["embedding"]), rows["vec_id"].to_numpy(), k, factor)

    keys = ["dim", "shard", "block"]
    found = dealt.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInPandas(
        searched, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
