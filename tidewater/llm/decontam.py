"""Benchmark decontamination by the q-gram lemma.

Texts are folded (lower case, white space runs to one space).  An item of length L with edit budget
k = 5 % of L that occurs in a text shares at least L + 1 - q - k*q of its q-grams with it, on at most
k+1 neighbouring diagonals.  Shared q-grams are counted in overlapping bands of 2(k+1) diagonals, so
that some band holds them all; bands that reach the bound are verified by banded alignment.  Where L is
too short for the bound to be positive, k is lowered; items shorter than q must occur exactly.

A q-gram that an item holds more than OFTEN times counts once for each place of the text, in all bands from its first to
its last diagonal, so repetitive texts and items make no more pairs than others.  Counting goes through
the text in stretches that overlap by the longest item, PAIRS pairs at a time, so memory follows neither the text's length nor its repeats.

Items of one pass are limited to BLOCK characters, so what is broadcast has a fixed bound; larger
benchmarks take several passes over the text.  Null and empty texts, items that fold to nothing: no match.
Repeated items each match.  Repeated rows: one result row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh, mix64

Q = 12
#: Places of a q-gram in an item that are told apart, pairs laid out at once, and least q-grams of a stretch.
OFTEN, PAIRS, STRETCH = 8, 1 << 19, 1 << 15
BUDGET = 0.05
BLOCK = 4_000_000
_BITS = 22
_SHIFT = 1 << 30  # keeps diagonals positive
_M = np.uint64(0x9E3779B97F4A7C15)


def fold(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray) -> np.ndarray:
    """64-bit hash of each q-gram (q = 12), by doubling: 1, 2, 4, 8, then 8 + 4."""
    h = c.astype(np.uint64) + np.uint64(1)
    m, four = _M, None
    for width in (1, 2, 4):
        h = h[:-width] * m + h[width:] if len(h) > width else h[:0]
        m = np.uint64(int(m) ** 2 % 2**64)
        if width == 2:
            four, m4 = h, m
    if len(c) < Q:
        return np.zeros(0, np.uint64)
    n = len(c) - Q + 1
    return mix64(h[:n] * m4 + four[8 : 8 + n])


def summed(key: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with the sum of its changes; those of 0 left out."""
    order = np.argsort(key, kind="stable")
    key, change = key[order], change[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(change, first) if len(first) else change
    return key[first][total != 0], total[total != 0]


class Index:
    """q-grams of the items, with where they occur."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.texts = [i for i, _ in items], [fold(t) for _, t in items]
        self.codes = [codes(t) for t in self.texts]
        self.short = [i for i, t in enumerate(self.texts) if 0 < len(t) < Q]
        self.k, self.need = [], []
        for t in self.texts:
            n = len(t)
            k = max(0, min(int(BUDGET * n), (n - Q) // Q))
            self.k.append(k)
            self.need.append(n + 1 - Q - k * Q)
        parts = [(grams(c), i) for i, c in enumerate(self.codes) if len(c) >= Q]
        h = np.concatenate([g for g, _ in parts]) if parts else np.zeros(0, np.uint64)
        item = np.concatenate([np.full(len(g), i) for g, i in parts]) if parts else np.zeros(0, np.int64)
        pos = np.concatenate([np.arange(len(g)) for g, _ in parts]) if parts else np.zeros(0, np.int64)
        order = np.lexsort((pos, item, h))
        h, item, self.pos = h[order], item[order].astype(np.int64), pos[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1])
        self.begin = np.flatnonzero(new)
        self.n = np.diff(np.append(self.begin, len(h)))
        # a group for each q-gram of an item
        self.h, self.item, self.first, self.last = h[self.begin], item[self.begin], self.pos[self.begin], self.pos[self.begin + self.n - 1] if len(h) else self.pos
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.least = min((self.need[i] for _, i in parts), default=1)
        self.width = np.asarray(self.k, np.int64) + 1
        self.span = max((len(c) + k for c, k in zip(self.codes, self.k, strict=True)), default=0)

    def events(self, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places and groups as (key, change): where in the order of side, item and band the count of shared q-grams rises and falls."""
        few = self.n[group] <= OFTEN
        a, g = at[few], group[few]
        n = self.n[g]
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[g], n)
        low = np.repeat(a, n) - self.pos[rank]
        item = np.concatenate([np.repeat(self.item[g], n), self.item[group[~few]]])
        high = np.concatenate([low, at[~few] - self.first[group[~few]]])
        low = np.concatenate([low, at[~few] - self.last[group[~few]]])
        w, keys = self.width[item], []
        for side in (0, 1):  # bands [b*2w, (b+1)*2w) and the same moved by w
            band = lambda d: (d + _SHIFT + side * w) // (2 * w)  # noqa: B023, E731
            top = (item * 2 + side) << 32
            keys += [top + band(low), top + band(high) + 1]
        change = np.tile(np.repeat([1, -1], len(item)), 2)
        return summed(np.concatenate(keys), change)

    def bands(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> set[tuple[int, int, int]]:
        """(item, side, band) that reach the bound with the given places."""
        n = hi - lo
        ends = np.cumsum(n)
        key = change = np.zeros(0, np.int64)
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
            m = n[i:j]
            for part in range(0, int(m.sum()), PAIRS):  # more than one only if a single place has that many groups
                flat = np.arange(part, min(part + PAIRS, int(m.sum())))
                row = np.searchsorted(np.cumsum(m), flat, "right")
                group = flat - (np.cumsum(m) - m)[row] + lo[i:j][row]
                k, c = self.events(at[i:j][row], group)
                key, change = summed(np.concatenate([key, k]), np.concatenate([change, c]))
            i = j
        count = np.cumsum(change)
        item, side = (key >> 33).astype(np.int64), (key >> 32) & 1
        out = set()
        for x in np.flatnonzero(count >= np.asarray(self.need, np.int64)[item]) if len(key) else ():
            for band in range(int(key[x] & 0xFFFFFFFF), int(key[x + 1] & 0xFFFFFFFF)):
                out.add((int(item[x]), int(side[x]), band))
        return out

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) in the folded text, the best region of each item and band."""
        t = fold(text)
        out = [(self.ids[i], at, at + len(self.texts[i]), 0) for i in self.short if (at := t.find(self.texts[i])) >= 0]
        if len(t) < Q or not len(self.h):
            return out
        c = codes(t)
        g = grams(c)
        at = np.flatnonzero(self.table[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
        if len(at) < self.least:
            return out
        lo, hi = np.searchsorted(self.h, g[at], "left"), np.searchsorted(self.h, g[at], "right")
        real = hi > lo
        at, lo, hi = at[real], lo[real], hi[real]
        if len(at) < self.least:
            return out
        found: set[tuple[int, int, int]] = set()
        size = max(STRETCH, 2 * self.span)
        for begin in range(0, len(g), size - self.span):
            x, y = np.searchsorted(at, [begin, begin + size])
            if y - x >= self.least:
                found |= self.bands(at[x:y], lo[x:y], hi[x:y])
            if begin + size >= len(g):
                break
        for i, side, band in sorted(found):
            low = (2 * band - side) * int(self.width[i]) - _SHIFT
            got = align(self.codes[i], c, low, low + 2 * int(self.width[i]), self.k[i])
            if got:
                out.append((self.ids[i], *got))
        return sorted(set(out))


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """Least edits of the whole item against text on diagonals low-k .. high+k; (start, end, edits) if at most k."""
    for d in range(max(0, low), min(high, len(text) - len(item) + 1)):
        if text[d] == item[0] and np.array_equal(text[d : d + len(item)], item):
            return d, d + len(item), 0
    if not k:
        return None
    a, b = low - k, high + k
    width = b - a + 1
    big = np.int64(1 << 30)
    diag = np.arange(a, b + 1)
    row = np.where((diag >= 0) & (diag <= len(text)), 0, big).astype(np.int64)  # row 0: free start
    start = diag.copy()
    for r in range(1, len(item) + 1):
        col = diag + r - 1  # the text character matched at this row and diagonal
        ok = (col >= 0) & (col < len(text))
        miss = np.ones(width, np.int64)
        miss[ok] = text[col[ok]] != item[r - 1]
        sub = np.where(ok, row + miss, big)
        skip = np.concatenate([row[1:] + 1, [big]])  # item character left out: diagonal + 1 of the row above
        new = np.minimum(sub, skip)
        s = np.where(sub <= skip, start, np.concatenate([start[1:], [0]]))
        ramp = new - np.arange(width)  # a text character left out: the run from the left costs one each
        low_ramp = np.minimum.accumulate(ramp)
        src = np.maximum.accumulate(np.where(ramp == low_ramp, np.arange(width), 0))
        new, s = low_ramp + np.arange(width), s[src]
        end = diag + r
        new = np.where((end >= 0) & (end <= len(text)), new, big)
        row, start = new, s
        if row.min() > k:
            return None
    j = int(row.argmin())
    return int(start[j]), int(diag[j] + len(item)), int(row[j])


def blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most `limit` characters (a longer item stands alone)."""
    block, size = [], 0
    for r in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").orderBy("i", "t").toLocalIterator():
        if block and size + len(r["t"]) > limit:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    if block:
        yield block


MATCHES = "array<struct<item:bigint,start:int,end:int,edits:int>>"


def finder(held):
    @F.pandas_udf(MATCHES)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"item": i, "start": s, "end": e, "edits": d} for i, s, e, d in held.value.find(t)] for t in texts], dtype=object)

    return find


def with_matches(docs: DataFrame, benchmark: DataFrame, column: str = "matches", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs and a column of matches; start and end count characters of the folded text."""
    out, parts = bound_batches(docs), []
    for n, block in enumerate(blocks(benchmark, item_id, item_text)):
        find = finder(docs.sparkSession.sparkContext.broadcast(Index(block)))
        parts.append(fresh(out, f"matches_of_block{n}"))
        out = out.withColumn(parts[-1], find(F.col(text_col)))
    every = F.concat(*[F.col(p) for p in parts]) if parts else F.array().cast(MATCHES)
    return out.withColumn(column, every).drop(*parts)


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    d = with_matches(docs.select("doc_id", "text"), benchmark).drop("text")
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda x: x["item"])))
    spans = F.array_join(F.transform("matches", lambda x: F.concat_ws(":", x["item"], x["start"], x["end"], x["edits"])), ",")
    return d.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("items"), spans.alias("spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The input rows in which no item occurs, all their columns unchanged."""
    found = fresh(docs, "matches")
    return with_matches(docs, benchmark, found).where(F.size(found) == 0).select(*docs.columns)
