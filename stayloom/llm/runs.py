"""Stretches of words that repeat with a short period, by maximal pairs.

Two equal stretches of l words at distance d, which the words before and after them tell apart, are a maximal pair;
if d is at most l / 2, the text from the first to the end of the second has period d and cannot be extended. So the
maximal pairs whose distance is short enough are the runs, and nothing is extended afterwards. Pairs come from the
tree of LCP intervals over the suffix order of a text, walked bottom-up: where the children of an interval of depth l
meet, each occurrence of the smaller one looks for partners of another left word in the larger one. Occurrences of one
stretch at distances up to l / 2 form an arithmetic progression, whose first alone may have another left word and whose
last alone may belong to another child; so the nearest occurrence after, and the nearest before that has another
left word, are all there is to find.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, give_back, small_batches

LEAST = 24  # words of a run
TIMES = 3  # periods of a run
SLICE_CHARS = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
WORDS = re.compile(WORD)
Run = tuple[int, int, int]  # start, length, period


def shortest(least: int, times: int) -> int:
    """Words that the two parts of a pair have at least: a run of period d has ``max(least, times * d) - d``."""
    return -(-least * (times - 1) // times)


def repeating(ids: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """Texts that may hold some ``size`` words twice, by hashes: texts that do are never left out."""
    if len(ids) < size:
        return np.empty(0, dtype=np.int64)
    word = (ids.astype(np.uint64) + np.uint64(1)) * BASE
    word ^= word >> np.uint64(29)
    window = owner[:len(owner) - size + 1].astype(np.uint64)
    for k in range(size):
        window = (window * BASE) ^ (window >> np.uint64(31))
        window += word[k:k + len(window)]
    window = window[owner[:len(window)] == owner[size - 1:]]
    own = owner[:len(owner) - size + 1][owner[:len(owner) - size + 1] == owner[size - 1:]]
    order = np.argsort(window)
    again = order[1:][window[order[1:]] == window[order[:-1]]]
    return np.unique(own[again])


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and the common words of each with the one before, by doubling of ranks."""
    n = len(ids)
    levels = [np.unique(ids, return_inverse=True)[1].astype(np.int32)]
    width = 1
    while True:
        rank = levels[-1].astype(np.int64)
        after = np.zeros(n, dtype=np.int64)
        after[:max(n - width, 0)] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.r_[False, key[order[1:]] != key[order[:-1]]]
        ranks = np.empty(n, dtype=np.int32)
        ranks[order] = np.cumsum(new)
        if new.sum() == n - 1:
            break
        levels.append(ranks)
        width *= 2
    common = np.zeros(n, dtype=np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, dtype=bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        step = same.astype(np.int64) << k
        a, b, common[1:] = a + step, b + step, common[1:] + step
    return order, common


class Occurrences:
    """Places of one stretch in order, and those of them whose place before has another left word."""

    __slots__ = ("places", "turns")

    def __init__(self, place: int):
        self.places, self.turns = [place], [place]

    def partners(self, p: int, reach: int, left: list[int]) -> Iterator[tuple[int, int]]:
        """Nearest place after ``p``, and nearest before it with another left word, within ``reach``."""
        places = self.places
        k = bisect_left(places, p)
        if k < len(places) and places[k] - p <= reach and left[places[k]] != left[p]:
            yield p, places[k]
        if k and p - places[k - 1] <= reach:
            k -= 1
            if left[places[k]] == left[p]:
                k = bisect_left(places, self.turns[bisect_right(self.turns, places[k]) - 1]) - 1
            if k >= 0 and p - places[k] <= reach:
                yield places[k], p

    def add(self, p: int, left: list[int]) -> None:
        places, turns = self.places, self.turns
        k = bisect_left(places, p)
        if k == 0 or left[places[k - 1]] != left[p]:
            insort(turns, p)
        if k < len(places):
            after, at = places[k], bisect_left(turns, places[k])
            is_turn = at < len(turns) and turns[at] == after
            if left[after] != left[p]:
                if not is_turn:
                    turns.insert(at, after)
            elif is_turn:
                del turns[at]
        places.insert(k, p)


def maximal_pairs(order: list[int], common: list[int], left: list[int], least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """``(first, second, words)`` of the maximal pairs of at least ``least`` words and at most words / (times - 1) apart."""
    found: list[tuple[int, int, int]] = []

    def meet(a: Occurrences, b: Occurrences, depth: int) -> Occurrences:
        if len(a.places) < len(b.places):
            a, b = b, a
        reach = depth // (times - 1)
        for p in b.places:
            found.extend((i, j, depth) for i, j in a.partners(p, reach, left))
        for p in b.places:
            a.add(p, left)
        return a

    open_: list[tuple[int, Occurrences]] = []
    for place, depth in zip(order, [*common[1:], 0]):
        if depth < least and not open_:
            continue
        child = Occurrences(place)
        while open_ and open_[-1][0] > depth:
            below, own = open_.pop()
            child = meet(own, child, below)
        if depth >= least:
            if open_ and open_[-1][0] == depth:
                child = meet(open_.pop()[1], child, depth)
            open_.append((depth, child))
        yield from found
        found.clear()


def runs_of(texts: list[list[str]], least: int = LEAST, times: int = TIMES) -> list[list[Run]]:
    """Runs of each text by start, then period. ``times`` is 3 or more, so that pairs lie within half their length.

    Works on all texts together: their words get different numbers, so that no stretch is common to two texts.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not maximal pairs within half their length")
    out: list[list[Run]] = [[] for _ in texts]
    number: dict[str, int] = {}
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    ids = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), dtype=np.int64, count=len(owner))
    size = shortest(least, times)
    again = repeating(ids, owner, size)
    if not len(again):
        return out
    starts = np.cumsum(np.r_[0, sizes])
    parts, begin, fresh = [], [], count(-1, -1)
    at = 0
    for t in again:
        begin.append(at + 1)
        parts += [np.array([next(fresh)]), ids[starts[t]:starts[t + 1]] + t * len(number)]
        at += 1 + sizes[t]
    joined = np.concatenate([*parts, [next(fresh)]])
    order, common = suffix_order(joined)
    left = np.r_[joined[0], joined[:-1]].tolist()
    period: dict[tuple[int, int], int] = {}
    for i, j, words in maximal_pairs(order.tolist(), common.tolist(), left, size, times):
        d = j - i
        if words + d >= max(least, times * d):
            key = (i, words + d)
            period[key] = min(d, period.get(key, d))
    for (start, length), d in period.items():
        k = bisect_right(begin, start) - 1
        out[again[k]].append((start - begin[k], length, d))
    for own in out:
        own.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[str], runs: list[Run]) -> str:
    """The words joined by spaces, without those of a run after its first period."""
    if not runs:
        return " ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return " ".join([w for w, g in zip(words, np.cumsum(gone).tolist()) if not g])


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Add ``runs`` and ``collapsed`` to documents with ``text``.

    ``runs`` holds ``start, length, period`` (in words, from 0) of every stretch of words with smallest period
    ``period`` and at least ``max(least, times * period)`` words that no neighbouring word extends, by start, then period.
    ``collapsed`` is the words joined by single spaces, without those that a run contains after its first period. Texts that
    are null, empty or without words have no run and an empty ``collapsed``. Rows are judged one by one, so repeated rows and
    ids do not matter; an empty table gives an empty one. Columns of these names are replaced, all others kept. A task holds
    some SLICE_CHARS characters at a time, or one longer text, of whose words about 100 bytes each are held if it repeats.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("runs array<struct<start:long,length:long,period:long>>, collapsed string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs: list[list[dict]] = []
            collapsed: list[str] = []
            for texts in slices(batch):
                words = [WORDS.findall(t) if t else [] for t in texts]
                for own, found_runs in zip(words, runs_of(words, least, times)):
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found_runs])
                    collapsed.append(collapse(own, found_runs))
            yield pd.DataFrame({"runs": pd.Series(runs, dtype=object), "collapsed": pd.Series(collapsed, dtype=object)})
            give_back()

    kept = [c for c in docs.columns if c not in ("runs", "collapsed", "__runs")]
    return docs.withColumn("__runs", found("text")).select(*[F.col(f"`{c}`") for c in kept], "__runs.runs", "__runs.collapsed")


def slices(batch: pd.Series) -> Iterator[list[str | None]]:
    part: list[str | None] = []
    chars = 0
    for text in batch:
        part.append(text)
        chars += len(text or "")
        if chars >= SLICE_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part
