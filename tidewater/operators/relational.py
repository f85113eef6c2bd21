"""Joins, aggregates, windows, sorts and set operations on event tables; survey ids in docstrings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import scalars as S
from ..functions import vocab


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key by a total order (A-12, W-06 with descending order)."""
    return least_per(df, keys, order, 1)


def least_per(df: DataFrame, keys: list[str], order: list, k: int, rank: str | None = None) -> DataFrame:
    """The k first rows of each key by a total order, with their rank if it has a name; every task keeps k rows a key before the shuffle."""
    r = rank or fresh_name(df, "nth")
    d = df.withColumn(r, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(r) <= k)
    return d if rank else d.drop(r)


def samples(df: DataFrame, keys: list[str], item: str, k: int, out: str = "samples") -> DataFrame:
    """A-15, A-16: (keys, out): the k least items of each key in order, without a list of all of them."""
    d = least_per(df.select(*keys, item), keys, [item], k)
    return d.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias(out))


def fresh_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def translate_codes(df: DataFrame, book: DataFrame, code: str, text: str, out: str) -> DataFrame:
    """J-02: code book lookup; a miss is the code itself."""
    b = book.select(F.col(code).alias("_c"), F.col(text).alias("_t"))
    return df.join(b, df[code] == F.col("_c"), "left").withColumn(out, F.coalesce("_t", code)).drop("_c", "_t")


def program_text(df: DataFrame, book: DataFrame, program: str, out: str) -> DataFrame:
    """J-02 with fallback to the part before '-'."""
    b1 = book.select(F.col("code").alias("_c1"), F.col("text").alias("_t1"))
    b2 = book.select(F.col("code").alias("_c2"), F.col("text").alias("_t2"))
    head = F.split_part(F.col(program), F.lit("-"), F.lit(1))
    d = df.join(b1, F.col(program) == F.col("_c1"), "left").join(b2, head == F.col("_c2"), "left")
    return d.withColumn(out, F.coalesce("_t1", "_t2", program)).drop("_c1", "_c2", "_t1", "_t2")


def ground_tickers(nodes: DataFrame, listed: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """J-06: the ticker of a node by name, then by canonical name; a miss clears it. Of equal names the last listed wins.

    listed: name, ticker, code, pos.
    """
    canon = S.canonical_name(F.col("name"), aliases)
    keys = listed.select(F.explode(F.array_distinct(F.array("name", canon, "code"))).alias("_k"), "ticker", "pos").where("_k is not null")
    book = keys.groupBy("_k").agg(F.max_by("ticker", "pos").alias("_t"))
    one, two = book.toDF("_k1", "_t1"), book.toDF("_k2", "_t2")
    d = nodes.withColumn("_canon", S.canonical_name(F.col("name"), aliases))
    d = d.join(one, d["name"] == one["_k1"], "left").join(two, F.col("_canon") == two["_k2"], "left")
    return d.withColumn("ticker", F.coalesce("_t1", "_t2")).drop("_canon", "_k1", "_k2", "_t1", "_t2")


def first_source_with_rows(df: DataFrame, priority: Column) -> DataFrame:
    """J-18, J-19: rows of the best priority that has any."""
    best = df.agg(F.min(priority).alias("_best"))
    return df.withColumn("_p", priority).join(F.broadcast(best), F.col("_p") == F.col("_best")).drop("_p", "_best")


def insert_or_ignore(new: DataFrame, old: DataFrame, key: str, order: list) -> DataFrame:
    """J-14, U-04, A-03: rows of new keys only, the first of each within the batch."""
    return first_per(new.join(old.select(key), key, "left_anti"), [key], order)


def dedup_hash_then_url(df: DataFrame, digest: str, url: str, pos: str) -> DataFrame:
    """W-03: keep the first row of each hash, then of the kept the first of each url; blank urls all stay."""
    kept = first_per(df, [digest], [pos])
    with_url = kept.where(f"coalesce({url}, '') <> ''")
    return first_per(with_url, [url], [pos]).unionByName(kept.where(f"coalesce({url}, '') = ''"))


def top_urls(mentions: DataFrame, event: str, url: str, confidence: str, pos: list, k: int = 3) -> DataFrame:
    """W-02: the first arrival of each url, then the k most confident in stable order (quirk Q3)."""
    first = first_per(mentions, [event, url], [F.col(p) for p in pos])
    w = Window.partitionBy(event).orderBy(F.desc(confidence), *pos)
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def latest_and_previous(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """W-01, M-01: newest observation of a series with the one before, its change and direction."""
    w = Window.partitionBy(key).orderBy(F.desc(at))
    d = df.withColumns({"_r": F.row_number().over(w), "previous_value": F.lead(value).over(w)}).where("_r = 1").drop("_r")
    d = d.withColumn("delta", F.col(value) - F.col("previous_value"))
    return d.withColumn("direction", S.direction(F.col("delta")))


def diverse_sample(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """W-04: the first of each group, then the rest in order, n in all."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_first", (F.row_number().over(w) == 1).cast("int")).orderBy(F.desc("_first"), *order).limit(n).drop("_first")


def error_streaks(df: DataFrame, key: str, at: list, ok: str) -> DataFrame:
    """W-09, A-21: errors since the last success; none ok, to five degraded, from six down."""
    w = Window.partitionBy(key).orderBy(*at)
    d = df.withColumn("_isle", F.sum(F.col(ok).cast("int")).over(w))
    d = d.groupBy(key).agg(F.max("_isle").alias("_last"), F.count("*").alias("runs"), F.count_if(~F.col(ok)).alias("errors")).join(
        d.groupBy(key, "_isle").agg(F.count_if(~F.col(ok)).alias("streak")), key).where("_isle = _last")
    status = F.when(F.col("streak") == 0, "ok").when(F.col("streak") < 6, "degraded").otherwise("down")
    return d.select(key, "runs", "errors", "streak", status.alias("status"))


def keyword_counts(df: DataFrame, key: str, text: Column, n: int = 8, least: int = 3, title: Column | None = None) -> DataFrame:
    """A-10: most frequent words, ties by first occurrence, stop words out; words of a title count twice.

    Counts combine before the shuffle.  Sorting each row's words within the row spares it, but such nested functions are
    interpreted: five times slower on sf0.1.
    """
    text = text if title is None else F.concat_ws(" ", title, title, text)
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z\\u4e00-\\u9fff]{%d,}" % least), F.lit(0))
    d = df.select(key, F.posexplode(words).alias("pos", "word")).where(~F.col("word").isin(vocab.STOP_WORDS))
    d = d.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return least_per(d.withColumn("less", -F.col("n")), [key], ["less", "first"], n, "rank").select(key, "word", "n", "rank")


def dominant(df: DataFrame, keys: list[str], value: str, order: str, out: str) -> DataFrame:
    """A-07: the most frequent value, ties by first seen."""
    d = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_p"))
    return d.groupBy(*keys).agg(F.max_by(value, F.struct("_n", -F.col("_p"))).alias(out))


def risk_score(severity: Column, digits: int = 4) -> dict[str, Column]:
    """A-08: counts and score, 0.1 without rows; levels from 0.7 and 0.4."""
    c, h, m = (F.count_if(severity == s) for s in ("critical", "high", "medium"))
    n = F.count("*")
    score = F.when(n == 0, 0.1).otherwise(F.least(F.lit(1.0), (c + 0.7 * h + 0.3 * m) / n))
    return {"n": n, "risk_score": F.bround(score, digits), "risk_level": F.when(score >= 0.7, "HIGH").when(score >= 0.4, "MEDIUM").otherwise("LOW")}


def severity_summary(avg: Column) -> dict[str, Column]:
    """A-06: label of a mean weight and the sentiment."""
    label = F.when(avg >= 3.5, "critical").when(avg >= 2.5, "high").when(avg >= 1.5, "medium").otherwise("low")
    return {"avg_severity": label, "sentiment": F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (avg - 1) / 3)), 2)}


def coverage(flag: Column) -> Column:
    """A-14: percent."""
    return F.count_if(flag) * 100.0 / F.count("*")


def fingerprint(item: Column, length: int = 16) -> Column:
    """A-17: the same for any order of rows."""
    return F.left(F.sha2(F.array_join(F.array_sort(F.collect_list(item)), "|"), 256), F.lit(length))


def pack(df: DataFrame, key: str, order: str, size: str, most_rows: int = 8, budget: int = 24_000) -> DataFrame:
    """W-07: (key, order, chunk) of rows of a key packed in order into chunks of at most most_rows rows and budget characters.

    A chunk depends on all rows before it, so a key's rows pass through one task in order, a batch at a time; none are held.
    """
    d = df.select(F.col(key), F.col(order).cast("long").alias(order), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("packed_size"))
    out = StructType([d.schema[key], d.schema[order], StructField("chunk", IntegerType())])
    fields = to_arrow_schema(out)

    def run(batches):
        now, chunk, rows, used = (False, None), 0, 0, 0
        for b in batches:
            chunks = []
            for k, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if now != (True, k):
                    now, chunk, rows, used = (True, k), 0, 0, 0
                elif rows >= most_rows or used + s > budget:
                    chunk, rows, used = chunk + 1, 0, 0
                rows, used = rows + 1, used + s
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(chunks, pa.int32())], schema=fields)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(parts, key).sortWithinPartitions(key, order, "packed_size").mapInArrow(run, out)


def first_severity(df: DataFrame, sectors: str, severity: str, order: list[str], default: str = "综合") -> DataFrame:
    """A-09: (sector, level): the severity of each sector's first row; rows without sectors count for the default one."""
    named = F.when(F.coalesce(F.size(sectors), F.lit(0)) > 0, F.col(sectors)).otherwise(F.array(F.lit(default)))
    d = df.select(F.explode(named).alias("sector"), severity, *order)
    return d.groupBy("sector").agg(F.min_by(severity, F.struct(*order)).alias("level"))


def graph_counts(nodes: DataFrame, edges: DataFrame, episodes: DataFrame, created: str, now: Column) -> DataFrame:
    """A-19: (what, n) for nodes, relations, and episodes created since midnight of `now`."""
    n = lambda d, what: d.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    today = episodes.where(F.col(created) >= F.date_trunc("day", now))
    return n(nodes, "nodes").union(n(edges, "relations")).union(n(today, "episodes_today"))
