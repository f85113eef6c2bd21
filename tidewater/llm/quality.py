"""Quality rules with risk-controlled thresholds.

Every rule is a rate that junk has more of.  Its cutoff is fitted per stratum (language) on labelled
documents: from the loosest cutoff down, each is tested with an exact (Clopper-Pearson) upper bound on the
share of good documents it would reject; testing stops at the first failure (fixed sequence), and
the error level is divided among all stratum x rule pairs (Bonferroni).  So with probability 1 - delta
no stratum loses more than `risk` of its good documents to all rules together.  Counts behind the bounds
are histograms over all labelled documents, at most strata x rules x BINS rows; cutoffs are joined by stratum.

Null or empty text: no words, base_failed.  Null languages are a stratum of their own.  A stratum without
labels, or with too few for any bound, has no learned cutoff: only the base rules reject there.  A text counts once in its stratum,
however many copies and labels it has, and is good if none of its labels is 0; labels of other values than 0 and 1 are ignored.
Repeated rows: one result row each.  An empty table gives an empty result; without labels nothing is learned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, fresh, materialize, mix64, text_key

WINDOW = 8
SYMBOLS = "#*$%&|<>"
RULES = ("symbol_rate", "upper_rate", "dup_line_rate", "repeat_rate", "mark_rate")
BINS = 512
RISK = 0.05
DELTA = 0.05

FEATURES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(n, T.DoubleType()) for n in RULES]
)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(WINDOW)], dtype=np.uint64)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in an 8-word window found at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    x = mix64(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words)) + np.uint64(1))
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h += x[k : k + n] * _POWERS[k]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def features_of(text: str | None) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # ASCII white space, as in the contract
    n = len(words)
    chars = len(text) - sum(raw.count(c) for c in b" \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen, lines, dup = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeats = repeat_words(words)
    a = np.frombuffer(raw, np.uint8)
    upper = int(((a >= 65) & (a <= 90)).sum())
    marks = raw.count(b"!") + raw.count(b"?")
    rate = lambda x, y: x / y if y else 0.0
    return (n, chars, symbols, dup, repeats, rate(symbols, chars), rate(upper, chars), rate(dup, lines), rate(repeats, n), rate(marks, chars))


@F.pandas_udf(FEATURES)
def text_features(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([features_of(t) for t in texts], columns=FEATURES.names)


def base_failed(f: str = "") -> Column:
    return (F.col(f + "n_words") < 20) | (100 * F.col(f + "n_repeat_words") > 30 * F.col(f + "n_words"))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact binomial upper bound: the p at which k or fewer of n has probability delta."""
    if n == 0 or k >= n:
        return 1.0

    def log_tail(p: float) -> float:  # log P(X <= k), summed down from k until terms vanish
        term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
        total, t, i = 1.0, 1.0, k
        while i > 0 and t > 1e-17 * total:
            t *= i * (1 - p) / ((n - i + 1) * p)
            total += t
            i -= 1
        return term + math.log(total)

    lo, hi, goal = max(k / n, 1e-12), 1.0 - 1e-12, math.log(delta)
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if log_tail(mid) > goal else (lo, mid)
    return hi


def fit_cutoffs(hist: dict[tuple[str, str], np.ndarray], risk: float = RISK, delta: float = DELTA) -> dict[tuple[str, str], int]:
    """hist: counts of good documents by bin for each (stratum, rule). The least bin from which a rule rejects; BINS: never."""
    level = delta / max(1, len(hist))
    out = {}
    for key, good in hist.items():
        n, k, cut = int(good.sum()), 0, BINS
        for b in range(BINS - 1, 0, -1):
            k += int(good[b])
            if upper_bound(k, n, level) > risk / len(RULES):
                break
            cut = b
        out[key] = cut
    return out


def bin_of(rate: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.ceil(rate * (BINS - 1))).cast("int")


def learn(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang") -> dict[tuple[str | None, str], int]:
    """measured: id, stratum, key of the text and the rates; labels: doc_id, quality. Cutoffs of every stratum with labels of good documents."""
    y = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_y"))
    j = measured.select(F.col(id_col).alias("_id"), F.col(stratum).alias("_s"), "key", *[bin_of(F.col(r)).alias(r) for r in RULES]).join(y, "_id")
    j = j.groupBy("_s", "key").agg(F.min("_y").alias("_y"), *[F.first(r).alias(r) for r in RULES]).where("_y = 1")
    long = j.select("_s", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("bin")) for r in RULES])).alias("x"))
    hist: dict[tuple[str | None, str], np.ndarray] = {}
    for r in long.groupBy("_s", "x.rule", "x.bin").count().collect():
        hist.setdefault((r["_s"], r["rule"]), np.zeros(BINS, np.int64))[r["bin"]] += r["count"]
    return fit_cutoffs(hist)


def with_cutoffs(df: DataFrame, cutoffs: dict[tuple[str | None, str], int], column: str, stratum: str = "lang") -> DataFrame:
    """df and the least rejected bin of each rule in the row's stratum, null where nothing was learned."""
    cuts: dict[str | None, list[int]] = {}
    for (name, rule), cut in cutoffs.items():
        cuts.setdefault(name, [BINS] * len(RULES))[RULES.index(rule)] = cut
    of = fresh(df, "stratum_of_cuts")
    schema = f"{of} string, {column} struct<" + ",".join(f"{r}:int" for r in RULES) + ">"
    rows = df.sparkSession.createDataFrame([(k, tuple(v)) for k, v in cuts.items() if min(v) < BINS], schema)
    return df.join(F.broadcast(rows), F.col(stratum).cast("string").eqNullSafe(F.col(of)), "left").drop(of)


def passes(cuts: str, f: str = "") -> Column:
    """Verdict of base rules and learned cutoffs, of rows that with_cutoffs has seen."""
    ok = ~base_failed(f)
    for rule in RULES:
        ok = ok & (bin_of(F.col(f + rule)) < F.coalesce(F.col(cuts)[rule], F.lit(BINS)))
    return ok


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    d = bound_batches(docs).select("doc_id", "lang", text_key(F.col("text")).alias("key"), text_features(F.col("text")).alias("f")).select("doc_id", "lang", "key", "f.*")
    d = materialize(d, "quality-features")
    return with_cutoffs(d, learn(d, labels), "cuts").select("doc_id", *FEATURES.names[:5], base_failed().alias("base_failed"), passes("cuts").alias("kept"), *RULES)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The input rows that pass, all their columns unchanged."""
    f, cuts = fresh(docs, "features"), fresh(docs, "cuts")
    measured = bound_batches(docs).select("doc_id", "lang", text_key(F.col("text")).alias("key"), text_features(F.col("text")).alias("f")).select("doc_id", "lang", "key", "f.*")
    cutoffs = learn(measured, labels)
    once = text_features.asNondeterministic()  # else the filter is pushed below the join and a second worker a task computes it again
    return with_cutoffs(docs.withColumn(f, once(F.col("text"))), cutoffs, cuts).where(passes(cuts, f + ".")).select(*docs.columns)
