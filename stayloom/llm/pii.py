"""Personal data by rules and a semi-Markov conditional random field.

Four rules (mail addresses, IP addresses, card and phone numbers) give the base spans. The rules drop what does not
pass whole, such as a phone number followed by a card number, which read as one number with too many digits. There a
segment model takes over: candidate spans are scored by features of the whole span (digits, grouping, separators,
check digit, surroundings), and dynamic programming over the boundaries of a stretch of text chooses boundaries and kinds
together. Spans are bounded: at most GROUPS groups of digits, or the longest mail address. The model is trained on the
base spans of a bounded sample; where a rule dropped a match for too many digits, nothing is known and nothing learned.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import draw, give_back, small_batches

# Fixed values of the contract: kinds in their order, and the rules. Digits before a match never belong to a longer one,
# so looking back for them changes nothing but spares quadratic work on long runs.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = 1, 2, 3, 4
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP_RULE = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD_RULE = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_RULE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (12, 19), (9, 15)

STRETCH = re.compile(r"[0-9]++(?:[\x20().\[\]+-]{1,3}+[0-9]++)*+")
DIGITS = re.compile(r"[0-9]+")
GROUPS = 8
LEAST_DIGITS = 7
LONGEST_LOCAL, LONGEST_DOMAIN = 64, 255  # limits of the mail standard
STOPS = frozenset(" \t\n\r\x0b\x0c<>\"'()[]{},;:@")
DOTS = (".", "[.]", "(.)", " . ")  # between the parts of an IP address
SAMPLE = 3000  # documents
ZONES = 2000  # stretches to learn from
ZONE_CHARS = 200
EPOCHS = 12
MARGIN = 1.0  # log-odds by which a span must be likelier than none

Span = tuple[int, int, int]  # kind, start, end
Edge = tuple[int, int, int, tuple]  # start, end, kind (0: none), features


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def small_parts(address: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in address.split("."))


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Spans of the rules by start, then kind, and the matches that were dropped for too many digits."""
    found: list[Span] = []
    unsure: list[tuple[int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((EMAIL, start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in IP_RULE.finditer(text):
        if small_parts(m[0]):
            found.append((IP, *m.span()))
    for m in CARD_RULE.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0]:
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) > CARD_DIGITS[1]:
                unsure.append(m.span())
            elif len(digits) >= CARD_DIGITS[0] and luhn(digits):
                found.append((CARD, *m.span()))
    if "+" in text:
        for m in PHONE_RULE.finditer(text):
            n = sum(map(str.isdigit, m[0]))
            if n > PHONE_DIGITS[1]:
                unsure.append(m.span())
            elif n >= PHONE_DIGITS[0]:
                found.append((PHONE, *m.span()))
    found.sort(key=lambda s: (s[1], s[0]))
    return found, unsure


def side(text: str, at: int) -> str:
    """Class of the character at a place: outside, space, letter, digit or the mark itself."""
    if not 0 <= at < len(text):
        return "|"
    c = text[at]
    return "s" if c.isspace() else "a" if c.isalpha() else "0" if c.isdigit() else c


def features(text: str, start: int, end: int, kind: int) -> tuple:
    """Indicators of a whole span as one of a kind. Its surroundings also count alike for all kinds."""
    span, left, right = text[start:end], side(text, start - 1), side(text, end)
    out = [(kind,), (kind, "left", left), (kind, "right", right), ("any", "left", left), ("any", "right", right)]
    if kind == EMAIL:
        local, _, domain = span.rpartition("@")
        parts = domain.split(".")
        out += [(kind, "parts", min(len(parts), 4)), (kind, "top", min(len(parts[-1]), 5), parts[-1].isalpha()),
                (kind, "plain", local.isascii()), (kind, "ends", span[:1].isalnum(), span[-1:].isalnum())]
        return tuple(out)
    groups = DIGITS.findall(span)
    gaps = DIGITS.split(span)
    digits = "".join(groups)
    out += [(kind, "digits", len(digits)), (kind, "begin", gaps[0]), (kind, "gaps", "".join(sorted(set(gaps[1:-1])))),
            (kind, "groups", *map(len, groups)), (kind, "luhn", luhn(digits))]
    return tuple(out)


def outside(text: str, start: int, end: int) -> tuple:
    """Indicators of a piece that belongs to no span."""
    piece = text[start:end]
    digits = sum(map(str.isdigit, piece))
    return ((0, "digits", min(digits, 20)),) + (((0, "@"),) if "@" in piece else ()) + (((0, "+"),) if "+" in piece else ())


def candidates(text: str) -> list[Edge]:
    """Spans that could be personal data, whatever the rules say."""
    out: list[Edge] = []
    add = lambda s, e, k: out.append((s, e, k, features(text, s, e, k)))
    for m in STRETCH.finditer(text):
        if m.end() - m.start() < LEAST_DIGITS:
            continue
        groups = [g.span() for g in DIGITS.finditer(text, *m.span())]
        for a, (start, stop) in enumerate(groups):
            before = text[max(start - 2, 0):start]
            begins = [start] + [start - 1] * (before[-1:] in ("+", "(")) + [start - 2] * (before == "+(")
            n, gaps = stop - start, []
            for b in range(a, min(a + GROUPS, len(groups))):
                if b > a:
                    gaps.append(text[groups[b - 1][1]:groups[b][0]])
                    n += groups[b][1] - groups[b][0]
                    if "+" in gaps[-1]:
                        break
                if n > CARD_DIGITS[1]:
                    break
                end = groups[b][1]
                brackets = any("[" in g or "]" in g for g in gaps)
                if LEAST_DIGITS <= n <= PHONE_DIGITS[1] and not brackets:
                    for begin in begins:
                        add(begin, end, PHONE)
                if n >= CARD_DIGITS[0] and all(g in (" ", "-") for g in gaps):
                    add(start, end, CARD)
                if len(gaps) == 3 and len(set(gaps)) == 1 and gaps[0] in DOTS and small_parts(".".join(DIGITS.findall(text, start, end))):
                    add(start, end, IP)
    at = text.find("@")
    while at >= 0:
        start, end = at, at + 1
        while start > max(at - LONGEST_LOCAL, 0) and text[start - 1] not in STOPS:
            start -= 1
        while end < min(at + LONGEST_DOMAIN, len(text)) and text[end] not in STOPS:
            end += 1
        tight = end
        while tight > at + 1 and not text[tight - 1].isalnum():
            tight -= 1
        if start < at and tight > at + 1:
            for e in {tight, end}:
                add(start, e, EMAIL)
        at = text.find("@", at + 1)
    return out


def zones(edges: list[Edge]) -> Iterator[list[Edge]]:
    """Edges that overlap, directly or through others, by start."""
    own: list[Edge] = []
    reach = -1
    for e in sorted(edges, key=lambda e: e[:3]):
        if own and e[0] >= reach:
            yield own
            own = []
        own.append(e)
        reach = max(reach, e[1]) if len(own) > 1 else e[1]
    if own:
        yield own


Lattice = list[list[tuple[int, int, tuple]]]


def lattice(text: str, edges: list[Edge]) -> tuple[list[int], Lattice]:
    """Boundaries of a zone, and for each the segments that end there: boundary they begin at, kind, features.

    Between neighbouring boundaries lies a piece that may belong to no span.
    """
    bounds = sorted({p for s, e, *_ in edges for p in (s, e)})
    place = {p: i for i, p in enumerate(bounds)}
    ends: Lattice = [[] for _ in bounds]
    for i in range(1, len(bounds)):
        ends[i].append((i - 1, 0, outside(text, bounds[i - 1], bounds[i])))
    for s, e, k, f in edges:
        ends[place[e]].append((place[s], k, f))
    return bounds, ends


STATES = range(len(KINDS) + 1)


def best_path(ends: Lattice, weight: dict, margin: float = 0.0) -> list[tuple[int, int, int]]:
    """Kind and boundaries of the spans of the segmentation of highest score, where each span costs ``margin``."""
    get = weight.get
    score = [[-math.inf] * len(STATES) for _ in ends]
    back: list[list] = [[None] * len(STATES) for _ in ends]
    score[0][0] = 0.0
    for j in range(1, len(ends)):
        for i, k, f in ends[j]:
            own = sum([get(x, 0.0) for x in f]) - margin * (k > 0)
            for p in STATES:
                if score[i][p] > -math.inf:
                    s = score[i][p] + own + get(("t", p, k), 0.0)
                    if s > score[j][k]:
                        score[j][k], back[j][k] = s, (i, p)
    j, k = len(ends) - 1, max(STATES, key=lambda k: score[-1][k])
    spans = []
    while j > 0:
        i, p = back[j][k]
        if k:
            spans.append((k, i, j))
        j, k = i, p
    return spans[::-1]


def log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum([math.exp(v - top) for v in values])) if top > -math.inf else top


def expectations(ends: Lattice, weight: dict) -> tuple[float, dict]:
    """Logarithm of the sum over all segmentations, and the expected count of each feature under the model."""
    get = weight.get
    arcs = [[] for _ in ends]  # by end: begin, state before, state after, score, features
    forward = [[-math.inf] * len(STATES) for _ in ends]
    forward[0][0] = 0.0
    for j in range(1, len(ends)):
        sums: dict[int, list[float]] = defaultdict(list)
        for i, k, f in ends[j]:
            own = sum([get(x, 0.0) for x in f])
            for p in STATES:
                if forward[i][p] > -math.inf:
                    s = own + get(("t", p, k), 0.0)
                    arcs[j].append((i, p, k, s, f))
                    sums[k].append(forward[i][p] + s)
        for k, values in sums.items():
            forward[j][k] = log_sum(values)
    total = log_sum(forward[-1])
    backward = [[-math.inf] * len(STATES) for _ in ends]
    backward[-1] = [0.0] * len(STATES)
    expected: dict = defaultdict(float)
    for j in range(len(ends) - 1, 0, -1):
        for i, p, k, s, f in arcs[j]:
            if backward[j][k] == -math.inf:
                continue
            through = s + backward[j][k]
            backward[i][p] = log_sum([backward[i][p], through])
            share = math.exp(forward[i][p] + through - total)
            for x in f:
                expected[x] += share
            expected["t", p, k] += share
    return total, expected


def observed(bounds: list[int], ends: Lattice, gold: list[Span]) -> dict | None:
    """Counts of the features of a given segmentation, or None if its spans overlap or are no segments."""
    counts: dict = defaultdict(float)
    at, before = 0, 0
    place = {p: i for i, p in enumerate(bounds)}
    wanted = {place.get(s): (k, place.get(e)) for k, s, e in gold}
    if len(wanted) < len(gold) or None in wanted:
        return None
    while at < len(bounds) - 1:
        k, end = wanted.pop(at, (0, at + 1))
        f = next((f for i, kind, f in ends[end or 0] if i == at and kind == k), None)
        if f is None:
            return None
        for x in f:
            counts[x] += 1
        counts["t", before, k] += 1
        at, before = end, k
    return None if wanted else counts


def fit(examples: list[tuple[str, list[Span]]], epochs: int = EPOCHS, rate: float = 0.3, l2: float = 0.002, seed: int = 3) -> dict:
    """Weights by adaptive stochastic gradient steps on the log-likelihood of the given segmentations."""
    known = []
    for text, gold in examples:
        edges = candidates(text)
        had = {e[:3] for e in edges}
        edges += [(s, e, k, features(text, s, e, k)) for k, s, e in gold if (s, e, k) not in had]
        for own in zones(edges):
            bounds, ends = lattice(text, own)
            inside = [g for g in gold if bounds[0] <= g[1] and g[2] <= bounds[-1]]
            counts = observed(bounds, ends, inside)
            if counts is not None:
                known.append((ends, counts))
    weight: dict = defaultdict(float)
    square: dict = defaultdict(lambda: 1e-6)
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(known)
        for ends, counts in known:
            expected = expectations(ends, weight)[1]
            for x in counts.keys() | expected.keys():
                g = counts.get(x, 0.0) - expected.get(x, 0.0) - l2 * weight[x]
                square[x] += g * g
                weight[x] += rate * g / math.sqrt(square[x])
    return {x: w for x, w in weight.items() if w}


def examples_of(text: str) -> Iterator[dict]:
    """Stretches of a text to learn from: with their surroundings, and the base spans in them."""
    base, unsure = base_spans(text)
    edges = candidates(text)
    had = {e[:3] for e in edges}
    edges += [(s, e, k, ()) for k, s, e in base if (s, e, k) not in had]
    for own in zones(edges):
        start, end = own[0][0], max(e[1] for e in own)
        if end - start > ZONE_CHARS or any(s < end and e > start for s, e in unsure):
            continue
        low = max(start - 2, 0)
        gold = [(k, s - low, e - low) for k, s, e in base if start <= s and e <= end]
        yield {"text": text[low:end + 2], "gold": json.dumps(gold)}


def train(docs: DataFrame, sample: int = SAMPLE, most: int = ZONES) -> dict:
    """Fit on at most ``most`` stretches of at most ``sample`` documents that hold digits or an at sign.

    Both are drawn by hashes, so reruns agree. Rows without ``doc_id`` or ``text`` are not learned from; an empty table
    gives a model without weights. Only ids and the short stretches move.
    """
    small_batches(docs.sparkSession)
    telling = F.col("text").rlike("@|[0-9]{3}|[0-9][.][0-9]") & F.col("doc_id").isNotNull()
    drawn = docs.select("doc_id", "text").filter(telling)
    ids = drawn.select("doc_id", draw("pii", F.col("doc_id")).alias("draw")).orderBy("draw", "doc_id").limit(sample)

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([x for t in batch["text"] for x in examples_of(t)], columns=["text", "gold"])
            give_back()

    # At most ``sample`` ids of eight bytes, so they may be broadcast.
    texts = drawn.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id").select("text")
    found = texts.mapInPandas(stretches, "text string, gold string").distinct().withColumn(
        "draw", draw("pii-zone", F.col("text"))).orderBy("draw", "text").limit(most).collect()
    examples = [(r["text"], [tuple(g) for g in json.loads(r["gold"])]) for r in found]
    return fit(examples + list(broken(examples)))


def broken(examples: list[tuple[str, list[Span]]]) -> Iterator[tuple[str, list[Span]]]:
    """The card numbers of examples with a wrong check digit, which makes them no card number."""
    for text, gold in examples:
        cards = [g for g in gold if g[0] == CARD]
        for _, _, end in cards:
            text = f"{text[:end - 1]}{(int(text[end - 1]) + 5) % 10}{text[end:]}"
        if cards:
            yield text, [g for g in gold if g[0] != CARD]


def added_spans(text: str, base: list[Span], weight: dict) -> list[Span]:
    """Spans of the model that touch no base span."""
    edges = candidates(text)
    if base and edges:
        taken = sorted((s, e) for _, s, e in base)
        blocks = [taken[0]]
        for s, e in taken[1:]:
            if s < blocks[-1][1]:
                blocks[-1] = (blocks[-1][0], max(e, blocks[-1][1]))
            else:
                blocks.append((s, e))
        free, b = [], 0
        for edge in sorted(edges, key=lambda e: e[:3]):
            while b < len(blocks) and blocks[b][1] <= edge[0]:
                b += 1
            if b == len(blocks) or blocks[b][0] >= edge[1]:
                free.append(edge)
        edges = free
    out = []
    for own in zones(edges):
        bounds, ends = lattice(text, own)
        out += [(k, bounds[i], bounds[j]) for k, i, j in best_path(ends, weight, MARGIN)]
    return out


def find(docs: DataFrame, weight: dict) -> DataFrame:
    """Add ``spans``, the personal data of each ``text`` by start, then kind: ``kind, start, stop, base``.

    Places are code points, ``stop`` is exclusive, ``base`` tells the spans of the rules, which are always there and may
    overlap each other; those of the model touch none of them. Null, empty and plain texts have no span. Rows are judged
    one by one, so repeated rows do not matter, and texts of any length in time in proportion to it. An existing column
    of this name is replaced, all others are kept.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weight)

    def spans_of(text: str | None) -> list[dict]:
        if not text or not ("@" in text or DIGITS.search(text)):
            return []
        base, _ = base_spans(text)
        own = [(s, k, e, True) for k, s, e in base]
        if shared.value:
            own += [(s, k, e, False) for k, s, e in added_spans(text, base, shared.value)]
        return [{"kind": KINDS[k - 1], "start": s, "stop": e, "base": b} for s, k, e, b in sorted(own)]

    @F.pandas_udf("array<struct<kind:string,start:long,stop:long,base:boolean>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([spans_of(t) for t in batch], dtype=object)
            give_back()

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "spans"], found("text").alias("spans"))
