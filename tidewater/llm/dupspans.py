"""Removal of long repeated byte strings by sparse suffix buckets.

Suffixes are kept at anchors only: each 400-byte window names as its anchor the least of the 16-gram hashes in its
first ANCHORS bytes, so equal windows, wherever they are, name the same place.  The suffixes are
refined like buckets of a suffix array, each level sorting on identifiers of longer strings and only
for suffixes that the level before left in company:

  1. the q-gram bucket: the 201 bytes from the anchor on, which all windows of the anchor hold;
  2. the cover: the string from the first to the last byte of the anchor's windows; suffixes with an equal
     cover have all their windows repeated, and one of them stands for all from here on;
  3. for buckets with a lone cover and company: runs of up to RUN windows at one distance from the anchor, bucketed
     by the string that all windows of such a run share and told apart by their own cover, as above;
  4. for those buckets with a lone cover and company: the identifiers of the single windows.

Counts combine before shuffles, and the rows of a very common string meet its count by broadcast, so it is no hot task; copies
of one text count as copies.  Identifiers are 64-bit hashes.  Null and empty texts, and texts under the length: nothing is
removed.  Repeated rows are copies of each other.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, flag_keys, join_counted, key_bitmap, materialize, mix64, text_key

LENGTH = 400
ANCHORS = 200
GRAM = 16
RUN = 16  # windows refined together before single ones
BUCKET = LENGTH - ANCHORS + 1
_B = 0x9E3779B97F4A7C15 | 1
_BI = pow(_B, -1, 2**64)
_T = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Powers:
    """Powers of the base and of its inverse, as far as asked for."""

    def __init__(self):
        self.b = self.i = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        while len(self.b) < n:
            m = len(self.b)
            self.b = np.concatenate([self.b, self.b * np.uint64(pow(_B, m, 2**64))])
            self.i = np.concatenate([self.i, self.i * np.uint64(pow(_BI, m, 2**64))])


class Hasher:
    """64-bit identifiers of substrings of one text."""

    def __init__(self, raw: bytes, powers: Powers):
        self.n = len(raw)
        powers.upto(self.n + 1)
        self.inv = powers.i
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_T[np.frombuffer(raw, np.uint8)] * powers.b[: self.n], out=self.sums[1:])

    def ids(self, start, end) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inv[start])

    def covers(self, at, lo, hi) -> np.ndarray:
        """Identifiers of the strings from the first to the last byte of windows lo to hi, with their place at the anchor."""
        return self.ids(lo, hi + LENGTH) ^ mix64(((at - lo) * 4096 + hi - at + 2048).astype(np.uint64))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first window, last window) of every run of windows with one anchor."""
        m = self.n - GRAM + 1
        g = (self.sums[GRAM:] - self.sums[:m]) * self.inv[:m]
        g = (mix64(g) & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
        width = 1
        while width * 2 <= ANCHORS:
            g = np.minimum(g[:-width], g[width:])
            width *= 2
        if ANCHORS > width:
            g = np.minimum(g[: len(g) - (ANCHORS - width)], g[ANCHORS - width :])
        at = (g[: self.n - LENGTH + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        return at[first], first, np.append(first[1:] - 1, len(at) - 1)


def suffix_rows(batches):
    """(text, key) -> (bucket, cover, key, lo, hi, at) for each anchor."""
    powers = Powers()
    for b in batches:
        held, n = [], 0
        for text, key in zip(b.column("text"), b.column("key").to_numpy()):
            raw = text.as_buffer().to_pybytes()
            if len(raw) < LENGTH:
                continue
            h = Hasher(raw, powers)
            at, lo, hi = h.anchors()
            held.append((h.ids(at, at + BUCKET), h.covers(at, lo, hi), np.full(len(at), key), lo, hi, at))
            n += len(at)
            if n > 100_000:
                yield suffix_batch(held)
                held, n = [], 0
        if held:
            yield suffix_batch(held)


def suffix_batch(held):
    c = [np.concatenate(x) for x in zip(*held)]
    return pa.RecordBatch.from_arrays(
        [pa.array(c[0].view(np.int64)), pa.array(c[1].view(np.int64)), pa.array(c[2], pa.int64()), pa.array(c[3].astype(np.int32)), pa.array(c[4].astype(np.int32)), pa.array(c[5].astype(np.int32))],
        names=["bucket", "cover", "key", "lo", "hi", "at"],
    )


def run_rows(batches):
    """(key, text, todo array<struct<lo,hi,at,alone>>) -> (bucket, cover, key, lo, hi, at, alone) for runs of windows.

    A run's windows start RUN * i to RUN * i + RUN - 1 bytes before the anchor; all of them hold the bucket's string.
    """
    powers = Powers()
    for b in batches:
        for key, text, todo in zip(b.column("key").to_numpy(), b.column("text"), b.column("todo").to_pylist()):
            h = Hasher(text.as_buffer().to_pybytes(), powers)
            t = np.array([(x["lo"], x["hi"], x["at"], x["alone"]) for x in todo], np.int64)
            first, last = (t[:, 2] - t[:, 1]) // RUN, (t[:, 2] - t[:, 0]) // RUN
            n = last - first + 1
            which = np.repeat(np.arange(len(t)), n)
            i = np.arange(len(which)) - np.repeat(np.cumsum(n) - n - first, n)
            lo, hi, at, alone = t[which].T
            near = at - RUN * i  # the run's last window, were it whole
            lo, hi = np.maximum(lo, near - RUN + 1), np.minimum(hi, near)
            bucket = h.ids(near, near - RUN + 1 + LENGTH) ^ mix64((i + 1).astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.view(np.int64)), pa.array(h.covers(at, lo, hi).view(np.int64)), pa.array(np.full(len(at), key), pa.int64()), *(pa.array(x.astype(np.int32)) for x in (lo, hi, at)), pa.array(alone.astype(bool))],
                names=["bucket", "cover", "key", "lo", "hi", "at", "alone"],
            )


def window_rows(batches):
    """(key, text, todo array<struct<lo,hi,at,alone>>) -> (window, key, at, alone), a row for each window of todo."""
    powers = Powers()
    for b in batches:
        for key, text, todo in zip(b.column("key").to_numpy(), b.column("text"), b.column("todo").to_pylist()):
            h = Hasher(text.as_buffer().to_pybytes(), powers)
            at = np.concatenate([np.arange(t["lo"], t["hi"] + 1) for t in todo])
            alone = np.concatenate([np.full(t["hi"] - t["lo"] + 1, t["alone"]) for t in todo])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.ids(at, at + LENGTH).view(np.int64)), pa.array(np.full(len(at), key), pa.int64()), pa.array(at.astype(np.int32)), pa.array(alone.astype(bool))],
                names=["window", "key", "at", "alone"],
            )


def cut_rows(batches):
    """(doc_id, text, spans array<struct<lo,hi>>) -> result rows; spans are of window starts."""
    for b in batches:
        out = []
        for text, spans in zip(b.column("text"), b.column("spans").to_pylist()):
            raw = text.as_buffer().to_pybytes()
            gone = np.zeros(len(raw) + 1, np.int64)
            for s in spans or ():
                gone[s["lo"]] += 1
                gone[s["hi"] + LENGTH] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out.append((len(raw), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), ",".join(f"{i}:{j}" for i, j in edge.reshape(-1, 2))))
        c = list(zip(*out)) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, c, kinds)], names=RESULT)


RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]


def told_apart(d: DataFrame, rows: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """rows (bucket, cover, key, lo, hi, at, alone) -> windows of equal covers (key, lo, hi); texts to refine (key, text, todo).

    Rows not alone are known to be repeated and only keep others company.
    """
    lone = F.col("n") == 1
    covers = rows.groupBy("bucket", "cover").agg(F.count("*").alias("n"), F.max("alone").alias("alone"), F.min(F.struct("key", "lo", "hi", "at")).alias("rep"))
    covers = materialize(covers.withColumn("alone", F.col("alone") & lone), tag + "-covers")
    again = materialize(covers.where("n > 1").select("bucket", "cover", "n"), tag + "-again")
    spans = join_counted(rows.where("alone"), again, ["bucket", "cover"]).select("key", "lo", "hi")
    mixed = covers.groupBy("bucket").agg(F.count("*").alias("n"), F.max("alone").alias("alone")).where("n > 1 and alone").select("bucket", "n")
    todo = join_counted(covers.drop("n"), materialize(mixed, tag + "-mixed"), ["bucket"]).select("rep.key", F.struct("rep.lo", "rep.hi", "rep.at", "alone").alias("t"))
    todo = materialize(todo.groupBy("key").agg(F.collect_list("t").alias("todo")), tag + "-todo")
    near = flag_keys(d.select("key", "text"), "key", key_bitmap(todo, "key"), "maybe").where("maybe").drop("maybe")
    return spans, near.dropDuplicates(["key"]).join(todo, "key").select("key", "text", "todo")


def repeated_windows(d: DataFrame) -> DataFrame:
    """d (text, key) -> (key, spans array<struct<lo,hi>>): runs of window starts whose window occurs again."""
    rows = materialize(bound_batches(d).select("text", "key").mapInArrow(suffix_rows, "bucket long, cover long, key long, lo int, hi int, at int"), "dup-suffixes")
    many = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "dup-buckets")
    rows = materialize(join_counted(rows, many, ["bucket"]).drop("n").withColumn("alone", F.lit(True)), "dup-company")
    spans, near = told_apart(d, rows, "dup-level-2")
    runs = materialize(near.mapInArrow(run_rows, "bucket long, cover long, key long, lo int, hi int, at int, alone boolean"), "dup-runs")
    more, near = told_apart(d, runs, "dup-level-3")
    spans = spans.unionByName(more)
    wins = materialize(near.mapInArrow(window_rows, "window long, key long, at int, alone boolean"), "dup-windows")
    twice = materialize(wins.groupBy("window").agg(F.count("*").alias("n")).where("n > 1"), "dup-twice")
    single = join_counted(wins.where("alone"), twice, ["window"]).select("key", F.col("at").alias("lo"), F.col("at").alias("hi"))
    every = spans.unionByName(single).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return materialize(every, "dup-spans")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), a row for each input row; spans has start:end of the removed runs, in bytes."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    spans = repeated_windows(d)
    flagged = flag_keys(d, "key", key_bitmap(spans, "key"), "maybe")
    zero = F.lit(0).cast("long")
    size = F.octet_length("text").cast("long")
    whole = flagged.where(~F.col("maybe")).select("doc_id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.lit("").alias("spans"))
    copies = materialize(flagged.where("maybe").groupBy("key").agg(F.count("*").alias("n")).join(spans, "key", "left"), "dup-copies")
    part = join_counted(flagged.where("maybe"), copies, ["key"]).select("doc_id", "text", "spans")
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"
    return whole.unionByName(part.mapInArrow(cut_rows, schema))
