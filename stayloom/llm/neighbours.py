"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the unit sphere again and again near the sample's median along a random direction, beside dense
clusters rather than through them. Vectors close to
a border go down both sides (spill), so that a near pair rarely parts, and several trees make up for the rest. Pairs
are compared only within a leaf, exactly and in double precision; a pair that meets in several leaves counts in
the first one only. Leaves send back link counts and a star per local component, never the pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..session import written
from .common import draw
from .components import components
from .vectors import matrix, usable

TREES = 6
LEAF = 256
LARGE = 4  # times LEAF: leaves above are split again
DEEP = 8  # levels of one round of splits
SAMPLE = 8192  # vectors that borders are fitted on, of each label, and of each leaf that is split again
GROUP = 16_384  # vectors that one task places together
ROUNDS = 6  # of splits: 48 levels
CROWDED = 0.6  # share of a leaf's vectors that go down one side all the way, or of a node's that go down both: splitting does not help there
CUTS = [0.5, 0.4, 0.6, 0.3, 0.7]  # shares of a node's sample that may lie below its border
CLEAR = 0.2  # share of a node's sample that goes down both sides of a border that needs no better one
PLACED = 2048  # vectors that go down a tree together
BLOCK = 4096
PART = 256  # vectors of a block that are compared with another block at a time
CELLS = 4_000_000  # of a table of vectors by leaves
SPILL = 0.5  # overlap on each side of a border, in standard deviations of a threshold pair's difference
PATH, FINAL = 56, 1 << 55  # a code is the tree, whether the leaf is final, and the path from the root with a one before it


@dataclass
class Forest:
    """Borders of complete binary trees: ``borders[tree][node]``, children of node i at 2i+1 and 2i+2."""

    borders: np.ndarray
    depth: int
    spill: float
    seed: list[int]

    def direction(self, tree: int, level: int, dim: int) -> np.ndarray:
        """Random directions of all nodes of a level, made anew from the seed where they are needed."""
        random = np.random.default_rng([*self.seed, tree, level, dim])
        d = random.standard_normal((2**level, dim))
        return d / np.linalg.norm(d, axis=1, keepdims=True)


def overlap(threshold: float, dim: int) -> float:
    return SPILL * float(np.sqrt(2 - 2 * threshold) / np.sqrt(dim))


def border(z: np.ndarray, spill: float) -> float:
    """The first cut that sends few of a node's sample down both sides, else that which sends fewest; infinite, so that all go one
    way, if even these are most of it.

    Cut at the median, a dense cluster goes down both sides of node after node, and each of its vectors ends in hundreds of leaves.
    """
    cuts = np.quantile(z, CUTS)
    both = [np.mean((z - c < spill) & (z - c >= -spill)) for c in cuts]
    best = next((k for k, share in enumerate(both) if share <= CLEAR), int(np.argmin(both)))
    return float(cuts[best]) if both[best] <= CROWDED else np.inf


def fit_forest(sample: np.ndarray, depth: int, threshold: float, trees: int = TREES, seed: tuple[int, ...] = (23,)) -> Forest:
    """Borders from a bounded sample of unit vectors; zero where the sample has run out."""
    dim = sample.shape[1] if sample.size else 1
    forest = Forest(np.zeros((trees, max(2**depth - 1, 1))), depth, overlap(threshold, dim), list(seed))
    for t in range(trees):
        at = np.zeros(len(sample), dtype=np.int64)
        for level in range(depth):
            directions = forest.direction(t, level, dim)
            z = np.einsum("ij,ij->i", sample, directions[at]) if len(sample) else np.empty(0)
            for node in np.unique(at):
                forest.borders[t, 2**level - 1 + node] = border(z[at == node], forest.spill)
            at = 2 * at + (z >= forest.borders[t, 2**level - 1 + at])
    return forest


def descend(unit: np.ndarray, forest: Forest, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the leaves they reach, a row once for each."""
    who, at = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64)
    for level in range(forest.depth):
        directions = forest.direction(tree, level, unit.shape[1])
        z = np.einsum("ij,ij->i", unit[who], directions[at]) - forest.borders[tree, 2**level - 1 + at]
        low, high = z < forest.spill, z >= -forest.spill
        who, at = np.r_[who[low], who[high]], np.r_[2 * at[low], 2 * at[high] + 1]
    return who, at


def codes_below(unit: np.ndarray, forest: Forest, leaf: int) -> list[np.ndarray]:
    """Codes of the leaves of each vector: of all trees from their roots (``leaf`` 0), or below one leaf."""
    row, code = [], []
    for t in range(len(forest.borders)):
        who, at = descend(unit, forest, t)
        row.append(who)
        code.append((((leaf or (t << PATH) | 1) << forest.depth) & ((1 << PATH) - 1)) + at + ((leaf >> PATH or t) << PATH))
    rows, codes = np.concatenate(row), np.concatenate(code)
    order = np.lexsort((codes, rows))
    return np.split(codes[order], np.cumsum(np.bincount(rows, minlength=len(unit)))[:-1])


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, so that their squares neither overflow nor vanish; nothing is rounded."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def units(rows) -> np.ndarray:
    x = scaled(matrix(rows))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def split(rows: DataFrame, sizes: DataFrame, threshold: float, trees: int, leaf: int, turn: int) -> DataFrame:
    """Add ``codes``, the leaves below its own of each row of ``(label, dim, leaf, …, embedding)``.

    ``sizes`` has the rows ``n`` of each ``(label, dim, leaf)``. Each is fitted on a sample of its own, in one task, and placed
    in tasks of GROUP rows. A leaf that no split would thin out, as in a dense cluster, becomes final.
    """
    key = ["label", "dim", "leaf"]
    label = rows.schema["label"].dataType.simpleString()
    sizes = written(sizes, "leaf-sizes")
    sized = written(lookup_join(rows, sizes, key), "splitting")
    sample = sized.filter(draw(f"forest{turn}", F.col("rep")) <= F.lit(float(2**60 * SAMPLE)) / F.col("n"))

    def fitted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable").head(2 * SAMPLE)
        depth = min(DEEP, max(0, int(np.ceil(np.log2(max(rows["n"].iloc[0], 1) / leaf)))))
        forest = fit_forest(x := units(rows["embedding"]), depth, threshold, trees, (23, turn))
        if turn and np.bincount(descend(x, forest, 0)[1]).max() > CROWDED * len(x):
            depth = 0
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "leaf": [key[2]], "depth": [depth], "borders": [forest.borders.tobytes()]})

    borders = written(sample.select(*key, "rep", "n", "embedding").groupBy(*key).applyInPandas(
        fitted, f"label {label}, dim int, leaf long, depth int, borders binary"), "borders")
    parts = F.ceil(F.col("n") / GROUP).cast("int")
    columns = [c for c in sized.columns if c != "n"]

    def placed(key: tuple, rows: pd.DataFrame, borders: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[*columns, "codes"])
        code, x = int(key[2]), units(rows["embedding"])
        depth = int(borders["depth"].iloc[0]) if len(borders) else 0
        if not depth:
            own = [np.array([code | FINAL if code else 1])] * len(rows)
        else:
            table = np.frombuffer(borders["borders"].iloc[0]).reshape(trees, -1)
            forest = Forest(table, depth, overlap(threshold, x.shape[1]), [23, turn])
            own = [c for k in range(0, len(x), PLACED) for c in codes_below(x[k:k + PLACED], forest, code)]
        out = rows[columns].copy()
        out["codes"] = pd.Series(own, index=out.index, dtype=object)
        return out

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sized.schema.fields if f.name != "n")
    left = sized.withColumn("task", F.pmod(F.xxhash64("rep"), parts).cast("int")).groupBy(*key, "task")
    right = lookup_join(borders, sizes, key).withColumn("task", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n").groupBy(*key, "task")
    return left.cogroup(right).applyInPandas(placed, f"{types}, codes array<bigint>")


def routed_classes(classes: DataFrame, threshold: float, trees: int, leaf: int) -> DataFrame:
    """``classes`` with ``leaves``, the sorted codes of the leaves of each vector over all trees.

    Labels of at most ``leaf`` vectors are one leaf. In other labels every tree is split by a forest of the label's own;
    leaves that are still large after that are split again by themselves.
    """
    own = ["label", "dim"]
    groups = written(classes.groupBy(*own).agg(F.count(F.lit(1)).alias("n")), "labels")
    whole = classes.withColumn("leaf", F.lit(0).cast("long"))
    large = groups.filter(F.col("n") > leaf).withColumn("leaf", F.lit(0).cast("long"))
    one = lookup_join(classes, written(groups.filter(F.col("n") <= leaf).drop("n"), "small-labels"), own)
    routed = split(whole, large, threshold, trees, leaf, 0).drop("leaf").withColumnRenamed("codes", "leaves").unionByName(
        one.withColumn("leaves", F.array(F.lit(1).cast("long"))))
    routed = written(routed.select(*classes.columns, "leaves"), "routed")
    for turn in range(1, ROUNDS):
        sizes = routed.select(*own, F.explode("leaves").alias("leaf")).groupBy(*own, "leaf").agg(F.count(F.lit(1)).alias("n"))
        again = written(sizes.filter((F.col("n") > LARGE * leaf) & (F.col("leaf").bitwiseAND(FINAL) == 0)), "large-leaves")
        if not again.limit(1).count():
            break
        rows = routed.select(*own, "h1", "h2", "rep", "embedding", F.explode("leaves").alias("leaf"))
        new = split(rows, again, threshold, 1, leaf, turn).groupBy("label", "h1", "h2").agg(
            F.flatten(F.collect_list("codes")).alias("codes"), F.collect_list("leaf").alias("gone"))
        rest = F.array_except("leaves", F.coalesce("gone", F.array().cast("array<long>")))
        moved = F.array_sort(F.array_distinct(F.concat(rest, F.coalesce("codes", F.array().cast("array<long>")))))
        routed = written(routed.join(new, ["label", "h1", "h2"], "left").withColumn("leaves", moved).select(*classes.columns, "leaves"), "routed")
    return routed


def meets_before(codes: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows ``a`` by rows ``b``, whether any code is in both; some codes after the other, so that little is held."""
    size = np.array([len(c) for c in codes])
    both = np.intersect1d(np.concatenate([codes[i] for i in a]), np.concatenate([codes[i] for i in b]))
    met = np.zeros((len(a), len(b)), dtype=bool)
    some = max(1, CELLS // (len(a) + len(b)))
    for k in range(0, len(both), some):
        part = both[k:k + some]

        def holds(rows: np.ndarray) -> np.ndarray:
            flat, row = np.concatenate([codes[i] for i in rows]), np.repeat(np.arange(len(rows)), size[rows])
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            known = part[at] == flat
            table = np.zeros((len(rows), len(part)), dtype=np.float32)
            table[row[known], at[known]] = 1
            return table

        met |= holds(a) @ holds(b).T > 0
    return met


def joined(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Roots after ``p`` and ``q`` are linked, the smallest row of each component."""
    while True:
        a, b = root[p], root[q]
        differ = a != b
        if not differ.any():
            return root
        p, q, a, b = p[differ], q[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def compare(rows: pd.DataFrame, leaf: int, left: int, right: int, threshold: float) -> pd.DataFrame:
    """Links between two blocks of a leaf (or within one): per vector the copies linked, and its local root.

    A pair that also meets in a leaf of smaller code is left to that one.
    """
    rows = rows.sort_values("rep", kind="stable")
    x = scaled(matrix(rows["embedding"]))
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    block = rows["block"].to_numpy()
    a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
    before = [np.asarray(own)[np.asarray(own) < leaf] for own in rows["leaves"]]
    copies = rows["copies"].to_numpy()
    links, root = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
    for part in np.array_split(a, max(1, -(-len(a) // PART))):
        if not len(part) or not len(b):
            continue
        cos = x[part] @ x[b].T
        cos /= norm[part][:, None] * norm[b][None, :]
        near = cos >= threshold
        if left == right:
            near &= part[:, None] < b[None, :]
        some, other = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(some):
            continue
        one, two = part[some], b[other]
        near = near[some][:, other] & ~meets_before(before, one, two)
        p, q = np.nonzero(near)
        links += np.bincount(one[p], copies[two[q]], len(rows)).astype(np.int64) + np.bincount(two[q], copies[one[p]], len(rows)).astype(np.int64)
        root = joined(root, one[p], two[q])
    rep = rows["rep"].to_numpy()
    found = links > 0
    return pd.DataFrame({"rep": rep[found], "links": links[found], "root": rep[root[found]]})


def link(embeddings: DataFrame, threshold: float = 0.98, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``(vec_id, embedding, label)``; other columns are ignored.

    Only vectors of one label and one length are compared. Rows without label, unusable vectors (null, empty, zero,
    with null or non-finite components) and rows without id link with nothing and are their own component. Equal
    vectors are one class, linked among themselves; repeated rows count as copies. An empty table gives an empty one.
    Every label has a forest of its own, fitted on a sample of some ``SAMPLE`` vectors; every vector is indexed.
    """
    joined = (F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit("second"), "embedding").alias("h2"))
    able = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    base = embeddings.select("vec_id", "label", "embedding")
    classes = written(
        base.filter(able).select("vec_id", "label", "embedding", *joined).groupBy("label", "h1", "h2")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
        .withColumn("dim", F.size("embedding")), "classes")
    key = ["label", "dim", "leaf"]
    routed = routed_classes(classes, threshold, trees, leaf)
    rows = routed.select("label", "dim", "rep", "copies", "embedding", "leaves", F.explode("leaves").alias("leaf"))
    sizes = routed.select("label", "dim", F.explode("leaves").alias("leaf")).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    several = sizes.filter("n > 1").select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    # A leaf above BLOCK vectors is compared block against block, each pair of blocks in a task of its own.
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    laid = rows.join(several, key).withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *key, "rep", "copies", "embedding", "leaves", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def compared(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return compare(rows, key[2], key[3], key[4], threshold)

    found = written(
        laid.groupBy(*key, "low", "high").applyInPandas(compared, "rep long, links long, root long"), "found")
    labels = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    result = classes.select("label", "h1", "h2", "rep", "copies").join(links, "rep", "left").join(
        labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    alone = base.filter(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    members = base.filter(able).select("vec_id", "label", *joined).join(result, ["label", "h1", "h2"]).select(
        "vec_id", "n_links", "component_id")
    return members.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
