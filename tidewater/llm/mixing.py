"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in SQL functions only.

A source's documents are dealt into blocks by hash.  A mix takes whole blocks in a random order of the
source (the second copy of a block is a slot of its own), and a part of one last block, so that the
words taken meet the source's target.  Which shard gets how many of each source's slots is drawn by
a binary tree over shards: every node splits its vector of slot counts by a multivariate
hypergeometric draw, so each shard has its exact share of slots and each source its exact number.  A shard
then owns a run of the permuted slots, disjoint from all others, and `order_key` shuffles it locally.

Nothing is collected and no Python runs on executors.  Draws hash ids and a seed, so reruns agree.
Null text: size 0, taken 0.  Null sources form one source, last.  Repeated rows are separate rows of
equal fate or adjacent order.  Empty table: empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BLOCKS = 1024  # of a source at most; a source of few documents has fewer
SHARDS = 16
_BIG = 2**62


def uniform(*parts) -> Column:
    """A number in (0, 1) from the hash of parts."""
    h = F.xxhash64(*[F.lit(p) if not isinstance(p, Column) else p for p in parts])
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(2**53)


def source_targets(sized: DataFrame) -> DataFrame:
    """(skey, source_size, n_docs, target): the totals shared by weight, capped, the excess reshared until none is above.

    At the end the uncapped sources share what the capped ones leave, in proportion to weight.  Sources with the
    least cap per unit of weight reach their cap first, so one pass in that order finds who is capped.
    """
    s = sized.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    one = Window.orderBy("skey")
    w = F.array(*map(F.lit, WEIGHTS))
    s = s.withColumn("w", F.get(w, (F.row_number().over(one) - 1) % len(WEIGHTS)))
    by_cap = Window.orderBy(F.col("source_size") / F.col("w"), "skey")
    every = Window.partitionBy(F.lit(1))
    s = s.withColumns(
        {
            "total": F.sum("source_size").over(every) * SHARE,
            "before": F.coalesce(F.sum(F.col("source_size") * MOST).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "w_left": F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    s = s.withColumn("level", (F.col("total") - F.col("before")) / F.col("w_left"))
    s = s.withColumn("capped", F.col("level") * F.col("w") > F.col("source_size") * MOST)
    level = F.min(F.when(~F.col("capped"), F.struct("before", "level"))).over(every)["level"]
    return s.select(
        "skey", "source_size", "n_docs",
        F.when(F.col("capped"), F.col("source_size") * MOST).otherwise(F.least(F.col("source_size") * MOST, F.coalesce(level, F.lit(0.0)) * F.col("w"))).alias("target"),
    )


def let(value: Column, body) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """Number of good items among `draws` out of `total`, by inverting the distribution function at u.

    Outcomes are taken from the mode down, then from the mode up, with weights relative to the mode's by the ratio
    of neighbours, so nothing under- or overflows.  They end 20 deviations from the mode, beyond what a double tells.
    """
    start = F.struct(good.alias("g"), total.alias("t"), draws.alias("d"), u.alias("u"))

    def with_mode(s):
        lo, hi = F.greatest(F.lit(0.0), s["g"] + s["d"] - s["t"]), F.least(s["g"], s["d"])
        mode = F.least(hi, F.greatest(lo, F.floor((s["d"] + 1) * (s["g"] + 1) / (s["t"] + 2)).cast("double")))
        far = F.ceil(20 * F.sqrt(s["g"])) + 20
        return F.struct(s["g"].alias("g"), s["t"].alias("t"), s["d"].alias("d"), s["u"].alias("u"), mode.alias("mode"), F.least(mode - lo, far).cast("int").alias("below"), F.least(hi - mode, far).cast("int").alias("above"))

    def ratio(s, k):  # p(k+1) / p(k)
        return (s["g"] - k) * (s["d"] - k) / ((k + 1) * (s["t"] - s["g"] - s["d"] + k + 1))

    def walk(s, n, factor, goal):
        """(p, sum, number of outcomes whose sum stays under goal) over n outcomes beside the mode."""
        seed = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("c"), F.lit(0).alias("n"))
        steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

        def one(a, i):
            return let(a["p"] * factor(i), lambda p: F.struct(p.alias("p"), (a["c"] + p).alias("c"), (a["n"] + F.when(a["c"] + p < goal, 1).otherwise(0)).alias("n")))

        return F.aggregate(steps, seed, one)

    down = lambda s, goal: walk(s, s["below"], lambda i: 1 / ratio(s, s["mode"] - i), goal)
    up = lambda s, goal: walk(s, s["above"], lambda i: ratio(s, s["mode"] + i - 1), goal)

    def invert(s):
        sums = F.struct(down(s, F.lit(0.0))["c"].alias("below"), up(s, F.lit(0.0))["c"].alias("above"))

        def pick(m):
            at = s["u"] * (1 + m["below"] + m["above"])
            lower = s["mode"] - F.least(s["below"], down(s, at - 1)["n"] + 1)
            upper = s["mode"] + F.least(s["above"], up(s, at - 1 - m["below"])["n"] + 1)
            return F.when(at <= 1, s["mode"]).when(at <= 1 + m["below"], lower).otherwise(upper)

        return let(sums, pick)

    return let(start, lambda s: let(with_mode(s), invert))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas (skey, slots) -> (shard, skey, n): the splitting tree, `shards` a power of two."""
    node = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("skey", F.col("slots").cast("double").alias("n")))).alias("q"))
    node = node.where(F.size("q") > 0).select(F.lit(0).alias("shard"), "q")
    depth = shards.bit_length() - 1
    for level in range(depth):
        total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x["n"])
        start = F.struct(total.alias("left_total"), F.ceil(total / 2).cast("double").alias("draws"), F.array().cast("array<double>").alias("got"))

        draw = uniform(seed, level, F.col("shard"))

        def one(a, x):
            u = uniform(draw, x["skey"])
            drawn = hypergeometric(x["n"], a["left_total"], a["draws"], u)
            return let(drawn, lambda k: F.struct((a["left_total"] - x["n"]).alias("left_total"), (a["draws"] - k).alias("draws"), F.concat(a["got"], F.array(k)).alias("got")))

        node = node.withColumn("got", F.aggregate("q", start, one, lambda a: a["got"]))
        left = F.zip_with("q", "got", lambda x, k: F.struct(x["skey"].alias("skey"), k.alias("n")))
        right = F.zip_with("q", "got", lambda x, k: F.struct(x["skey"].alias("skey"), (x["n"] - k).alias("n")))
        sides = F.array(F.struct(F.lit(0).alias("side"), left.alias("q")), F.struct(F.lit(1).alias("side"), right.alias("q")))
        node = node.select("shard", F.explode(sides).alias("c")).select((F.col("shard") * 2 + F.col("c.side")).alias("shard"), F.col("c.q").alias("q"))
    return node.select("shard", F.explode("q").alias("x")).select("shard", F.col("x.skey").alias("skey"), F.col("x.n").cast("long").alias("n"))


def plan_mix(sized: DataFrame, shards: int = SHARDS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """sized (skey, size, spin) -> (targets, slots); slots (skey, block, copy, words, quota, shard), quota the words to take of the slot."""
    targets = materialize(source_targets(sized), "mix-targets")
    n_blocks = F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.floor(F.col("n_docs") / 8)))
    blocked = sized.join(targets, "skey").withColumn("block", F.pmod("spin", n_blocks))
    blocks = materialize(blocked.groupBy("skey", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    turn = Window.partitionBy("skey").orderBy("copy", F.xxhash64(F.lit(seed), "skey", "block", "copy"), "block")
    slots = (
        blocks.join(targets, "skey")
        .withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("pos", F.row_number().over(turn))
        .withColumn("so_far", F.sum("words").over(turn.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("goal", F.floor(F.col("target") + 0.5))
        .withColumn("quota", F.least("words", F.greatest(F.lit(0), F.col("goal") - F.coalesce("so_far", F.lit(0)))).cast("long"))
        .where("quota > 0")
    )
    slots = materialize(slots.select("skey", "block", "copy", "words", "quota", "pos"), "mix-slots")
    shares = split_quotas(slots.groupBy("skey").agg(F.count("*").alias("slots")), shards, seed)
    runs = Window.partitionBy("skey").orderBy("shard")
    shares = shares.withColumn("upto", F.sum("n").over(runs)).where("n > 0")
    owned = slots.join(shares, "skey").where("pos > upto - n and pos <= upto")
    return targets, materialize(owned.select("skey", "block", "copy", "words", "quota", "shard"), "mix-owned")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """(id, spin, size, source_size, target, placements array<struct<shard,copy,words,order_key>>), a row for each input row.

    words < size in a placement asks for that many of the document's first words: at most one document
    of a source and copy is cut so.  Sort a shard by order_key to get its shuffled stream.
    """
    skey = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col(source_col)))
    sized = docs.select(
        F.col(id_col).alias("id"), skey.alias("skey"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("spin"),
    )
    sized = materialize(sized, "mix-sized")
    targets, slots = plan_mix(sized, shards, seed)
    n_blocks = F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.floor(F.col("n_docs") / 8)))
    doc = sized.join(targets, "skey").withColumn("block", F.pmod("spin", n_blocks))
    per_block = slots.groupBy("skey", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "words", "quota", "shard"))).alias("slots"))
    doc = materialize(doc.join(per_block, ["skey", "block"], "left"), "mix-docs")
    cut = F.exists("slots", lambda s: s["quota"] < s["words"])
    order = F.xxhash64(F.lit(seed + 1), "spin")
    before = F.sum("size").over(Window.partitionBy("skey", "block").orderBy(order, "id", "size").rowsBetween(Window.unboundedPreceding, -1))
    part = doc.where(cut).withColumn("before", F.coalesce(before, F.lit(0)))
    whole = doc.where(~F.coalesce(cut, F.lit(False))).withColumn("before", F.lit(0).cast("long"))
    every = whole.unionByName(part)
    words = lambda s: F.when(s["quota"] >= s["words"], F.col("size")).otherwise(F.least(F.col("size"), F.greatest(F.lit(0), s["quota"] - F.col("before"))))
    placed = F.filter(
        F.transform("slots", lambda s: F.struct(s["shard"].alias("shard"), s["copy"].alias("copy"), words(s).cast("long").alias("words"), F.xxhash64(F.lit(seed + 2), "spin", s["copy"]).alias("order_key"))),
        lambda x: x["words"] > 0,
    )
    none = F.array().cast("array<struct<shard:int,copy:int,words:bigint,order_key:bigint>>")
    return every.select("id", "spin", "size", "source_size", "target", F.coalesce(placed, none).alias("placements"))


def mixing_report(docs: DataFrame) -> DataFrame:
    taken = F.aggregate("placements", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return mix_sources(docs).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"),
        F.array_join(F.transform("placements", lambda x: x["shard"].cast("string")), ",").alias("shards"),
    )
