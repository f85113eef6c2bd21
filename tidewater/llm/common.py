"""Shared helpers of the training-data operators: scratch tables, bitmaps, hashing."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a key bitmap.  2 MB whatever the input; a full bitmap only prunes less.
BITMAP_BITS = 24
_WORD = 15  # bitmap_construct_agg makes bitmaps of 2**15 bits

#: Bytes of an Arrow batch.  Spark's bound of 10,000 rows alone lets a batch of long texts grow to hundreds of MB.
BATCH_BYTES = 4 << 20

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster; where none is set, one in the warehouse, which executors share as well."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return found.rstrip("/")


def bound_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of its session held to BATCH_BYTES; a bound that the user has set stays."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{scratch(df.sparkSession)}/tidewater/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """64-bit identity of a whole text; null counts as empty."""
    return F.xxhash64(F.lit("tidewater"), F.coalesce(text, F.lit("")))


def key_bitmap(df: DataFrame, key: str) -> DataFrame:
    """At most 2**(BITMAP_BITS-15) rows of 4 KB that tell which keys may be present."""
    slot = F.col(key).bitwiseAND((1 << BITMAP_BITS) - 1)
    return (
        df.select(slot.alias("_slot"))
        .groupBy(F.shiftright("_slot", _WORD).alias("_word"))
        .agg(F.bitmap_construct_agg(F.col("_slot").bitwiseAND((1 << _WORD) - 1)).alias("_bits"))
    )


def flag_keys(df: DataFrame, key: str, bitmap: DataFrame, flag: str) -> DataFrame:
    """Adds boolean `flag`: false only if the key is surely absent from the bitmap's keys."""
    slot = F.col(key).bitwiseAND((1 << BITMAP_BITS) - 1)
    at = slot.bitwiseAND((1 << _WORD) - 1)
    joined = df.join(F.broadcast(bitmap), F.shiftright(slot, _WORD) == F.col("_word"), "left")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0, F.lit(False))
    return joined.withColumn(flag, hit).drop("_word", "_bits")


def join_counted(rows: DataFrame, side: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """rows joined with side, which has one row a key and tells in column n how many of the rows have it.

    A key of more rows than a partition has on average is joined by broadcast, so its rows stay where they are; there are
    fewer such keys than shuffle partitions.  side is read several times and should be a written table.
    """
    parts = int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, most = side.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    if most * parts <= total or not total:
        return rows.join(side, on)
    heavy = F.col(n) * parts > total
    often = F.broadcast(side.where(heavy))
    return rows.join(often, on).unionByName(rows.join(F.broadcast(side.where(heavy).select(*on)), on, "left_anti").join(side.where(~heavy), on))


def integer_id(docs: DataFrame, id_col: str) -> Column:
    """The id as a long; other than whole numbers are refused, as they would turn to null."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"{id_col} must be a whole number")
    return F.col(id_col).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 over uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of undirected edges (a, b) of longs as (node, root), root the smallest node.

    Each round takes the least label among neighbours, hooks the old root to it, and shortens paths.
    All aggregates combine before the shuffle, so a node with very many edges is no hot task.
    """
    e = edges.where("a <> b").select("a", "b")
    e = materialize(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), tag + "-e")
    labels = materialize(e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), tag + "-l")
    while True:
        near = (
            e.join(labels.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .groupBy("a").agg(F.min("rb").alias("low"))
            .withColumnRenamed("a", "node")
        )
        seen = labels.join(near, "node").select("node", "root", F.least("root", "low").alias("low"))
        seen = materialize(seen, tag + "-s")
        changed = seen.where("low < root")
        if changed.isEmpty():
            return labels
        hooks = changed.groupBy(F.col("root").alias("old")).agg(F.min("low").alias("new"))
        hooked = seen.select("node", F.col("low").alias("root"), F.col("root").alias("old"))
        hooks = materialize(hooks, tag + "-h")
        hooked = hooked.join(hooks, "old", "left").select("node", F.least("root", F.coalesce("new", "root")).alias("root"))
        hooked = materialize(hooked, tag + "-k")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        labels = materialize(
            hooked.join(up, "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root")), tag + "-l"
        )
