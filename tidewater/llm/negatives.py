"""Hard negatives of anchors by a full sort of their scores.

Every anchor is scored against every row, in blocks.  Rows and anchors are packed once into written blocks; a cell
holds one chunk of anchors and the row blocks of one slot, which pass through it one by one.  In a block the
integer scores of an anchor are sorted by score and id; a first pass reads the best of its label, which are the positives,
and a second searches each positive's upper limit in the sorted scores by bisection and reads the first `k` of
other labels down to the lower limit.  What a cell keeps of an anchor is bounded, and the cells' reads are merged
by the same order, so the outcome is that of one sort over all rows.

Rows with a null label or vector, or a null or non-finite component, take no part.  Vectors of different lengths: missing
components are zero.  Ties: smaller id first, null ids last.  Repeated rows: each takes part; an anchor passes over one row
equal to itself.  No anchor, or an empty table: an empty result.  Scores beyond 64 bits count as the nearest
long.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, integer_id, materialize

SCALE = 256
#: Anchors of a chunk, rows of a block, bytes of either, and anchors scored at once.
CHUNK, ROWS, BYTES, AT_ONCE = 16_384, 8_192, 1 << 23, 64
#: Below it, sums of products are exact in doubles.
EXACT = 2.0**53
_LONG = 2**63 - 1

BLOCKS = "part int, nth int, n int, width int, ids binary, no_id binary, labels binary, vectors binary"
SAME = "anchor long, id long, score long, own boolean"
OTHER = "anchor long, p int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def usable(rows: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """(id, label, v) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(integer_id(rows, id_col).alias("id"), label.cast("long").alias("label"), v.alias("v")).where(F.col("label").isNotNull() & F.col("v").isNotNull() & ~odd)


def block_of(rows: pa.Table, part: int, nth: int) -> pa.RecordBatch:
    ids, lists = rows["id"].combine_chunks(), rows["v"].combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    width = int(size.max(initial=0))
    v = np.zeros((rows.num_rows, width))
    v[np.arange(width) < size[:, None]] = lists.flatten().to_numpy()
    with np.errstate(over="ignore"):
        narrow = v.astype("<f4")
    v = narrow if (narrow == v).all() else v
    parts = [ids.fill_null(0).to_numpy().astype("<i8"), ids.is_null().to_numpy(zero_copy_only=False), rows["label"].to_numpy().astype("<i8"), v]
    cells = [pa.array([x], pa.int32()) for x in (part, nth, rows.num_rows, width)] + [pa.array([x.tobytes()], pa.binary()) for x in parts]
    return pa.RecordBatch.from_arrays(cells, names=["part", "nth", "n", "width", "ids", "no_id", "labels", "vectors"])


def pack(most: int, most_bytes: int):
    """Blocks of a partition's rows in the order that they come, of at most `most` rows and about most_bytes."""

    def run(batches):
        part, nth, held, n, size = TaskContext.get().partitionId(), 0, [], 0, 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                few = b.slice(at, 256)
                held.append(few)
                n, size = n + few.num_rows, size + 8 * len(few.column("v").flatten())
                if n + 256 > most or size >= most_bytes:
                    yield block_of(pa.Table.from_batches(held), part, nth)
                    held, n, size, nth = [], 0, 0, nth + 1
        if n:
            yield block_of(pa.Table.from_batches(held), part, nth)

    return run


class Block:
    """Rows or anchors: ids, no_id, labels, and q, the whole numbers, in doubles or, where large, as Python's integers."""

    def __init__(self, r: dict):
        self.part, self.n = r["part"], r["n"]
        self.ids, self.labels, self.no_id = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8"), np.frombuffer(r["no_id"], bool)
        kind = "<f4" if len(r["vectors"]) == 4 * r["n"] * r["width"] else "<f8"
        v = np.frombuffer(r["vectors"], kind).reshape(r["n"], r["width"]).astype(float)
        self.top = float(np.abs(v).max(initial=0)) * SCALE + 1
        if self.top < EXACT:
            self.q = np.floor(v * SCALE)
        else:  # a double from 2**44 on is a whole number
            self.q = np.array([math.floor(x * SCALE) if abs(x) < 2.0**44 else int(x) * SCALE for x in v.ravel()], object).reshape(v.shape)


def scores(a: Block, b: Block, low: int, high: int) -> np.ndarray:
    """Integer inner products of a's rows low to high with b's rows."""
    w = min(a.q.shape[1], b.q.shape[1])
    x, y = a.q[low:high, :w], b.q[:, :w]
    if a.top * b.top * w < EXACT:
        return (x @ y.T).astype(np.int64)
    whole = lambda m: np.array([int(c) for c in m.ravel()], object).reshape(m.shape)
    return np.array([[max(-_LONG, min(_LONG, int(c))) for c in r] for r in whole(x).dot(whole(y).T)], np.int64)


def in_order(b: Block, score: np.ndarray) -> np.ndarray:
    """b's rows by falling score, then id, then those without one."""
    return np.lexsort((b.ids, b.no_id, -score))


def add(kept: dict, key, found: list[tuple], most: int) -> None:
    """found: (score, id, ...); the first `most` by the order of rows stay."""
    best = kept.setdefault(key, [])
    best += found
    best.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    del best[most:]


def rows_of(b: Block, at: np.ndarray, score: np.ndarray) -> list[tuple]:
    return [(int(score[j]), None if b.no_id[j] else int(b.ids[j])) for j in at.tolist()]


def read_same(most: int):
    """The first `most` rows of each anchor's label; own: the anchor itself, or a row like it."""

    def step(a: Block, b: Block, low: int, s: np.ndarray, kept: dict) -> None:
        for i, score in enumerate(s, low):
            order = in_order(b, score)
            add(kept, i, rows_of(b, order[b.labels[order] == a.labels[i]][:most], score), most)

    def close(a: Block, kept: dict):
        for i, found in kept.items():
            own = (int(scores(a, a, i, i + 1)[0, i]), int(a.ids[i]))
            for score, j in found:
                yield (a.part << 32) + i, j, score, (score, j) == own

    return step, close


def read_other(k: int, low_pct: int, high_pct: int):
    """For every positive of an anchor, the first k rows of other labels between its limits."""

    def step(a: Block, b: Block, low: int, s: np.ndarray, kept: dict) -> None:
        for i, score in enumerate(s, low):
            if not a.positives[i]:
                continue
            order = in_order(b, score)
            order = order[b.labels[order] != a.labels[i]]
            falling = -score[order]
            for p, _, positive in a.positives[i]:
                at = int(np.searchsorted(falling, -((high_pct * positive) // 100)))
                found = [x for x in rows_of(b, order[at : at + k], score) if 100 * x[0] >= low_pct * positive]
                if found:
                    add(kept, (i, p), found, k)

    def close(a: Block, kept: dict):
        for (i, p), found in kept.items():
            _, positive_id, positive = next(x for x in a.positives[i] if x[0] == p)
            for score, j in found:
                yield (a.part << 32) + i, p, int(a.ids[i]), positive_id, positive, j, score

    return step, close


def through_cells(how, schema: str):
    """Streams cells: the anchors of one come first, then its row blocks."""
    step, close = how
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])

    def run(batches):
        a, kept, cell = None, {}, None

        def out():
            found = list(close(a, kept)) if a else []
            for at in range(0, len(found), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[at : at + 50_000], strict=True), fields, strict=True)], schema=fields)

        for batch in batches:
            for r in batch.to_pylist():
                if r["side"] == 0:
                    yield from out()
                    a, kept, cell = Block(r), {}, (r["slot"], r["chunk"])
                    a.positives = [[] for _ in range(a.n)]
                    for x in r["positives"] or ():
                        a.positives[x["i"]].append((x["p"], x["id"], x["score"]))
                elif (r["slot"], r["chunk"]) == cell:  # else the chunk has no anchor
                    b = Block(r)
                    for low in range(0, a.n, AT_ONCE):
                        step(a, b, low, scores(a, b, low, min(a.n, low + AT_ONCE)), kept)
        yield from out()

    return run


def cells(anchors: DataFrame, blocks: DataFrame, chunks: int, slots: int) -> DataFrame:
    """Every chunk of anchors beside every row block, dealt out by (slot, chunk) and sorted."""
    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.col("part").alias("chunk"), F.lit(0).alias("side"), "*")
    slot = F.pmod(F.xxhash64("part", "nth"), F.lit(slots)).cast("int")
    b = blocks.select(slot.alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(1).alias("side"), "*", F.lit(None).cast(anchors.schema["positives"].dataType).alias("positives"))
    key = ["slot", "chunk"]
    return a.union(b).repartition(parts, *key).sortWithinPartitions(*key, "side", "part", "nth")


def hard_negatives(
    rows: DataFrame, anchor: Column, label: Column | None = None, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = 5, k: int = 3, low_pct: int = 50, high_pct: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchor: condition on `id`, the row's id.  label: the label to use, by default label_col's.  The positives of an anchor are the first rows of its label, itself apart; the
    negatives of a positive are the first k rows of other labels with low_pct * positive <= 100 * score <= high_pct * positive.
    """
    d = bound_batches(usable(rows, id_col, F.col(label_col) if label is None else label, vector_col))
    n, width = d.where(anchor).agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    chunks = max(1, math.ceil(n / CHUNK), math.ceil(8 * width / BYTES))
    # dealt out evenly, so each partition is one chunk
    packed = materialize(d.where(anchor).repartition(chunks).mapInArrow(pack(1 << 31, 1 << 62), BLOCKS), "negatives-anchors")
    blocks = materialize(d.mapInArrow(pack(ROWS, BYTES), BLOCKS), "negatives-rows")
    slots = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks.count()))

    none = F.lit(None).cast("array<struct<i:int,p:int,id:bigint,score:bigint>>").alias("positives")
    same = cells(packed.select("*", none), blocks, chunks, slots).mapInArrow(through_cells(read_same(positives + 1), SAME), SAME)
    per = Window.partitionBy("anchor")
    r = F.row_number().over(per.orderBy(F.desc("score"), F.asc_nulls_last("id"), F.desc("own")))
    same = same.withColumn("r", r).where(F.col("r") <= positives + 1).withColumn("at", F.coalesce(F.min(F.when(F.col("own"), F.col("r"))).over(per), F.lit(positives + 2)))
    same = same.where("r <> at").withColumn("p", F.col("r") - (F.col("r") > F.col("at")).cast("int")).where(F.col("p") <= positives)
    i = F.col("anchor").bitwiseAND(0xFFFFFFFF).cast("int").alias("i")
    of_chunk = same.groupBy(F.shiftright("anchor", 32).cast("int").alias("part")).agg(F.collect_list(F.struct(i, "p", "id", "score")).alias("positives"))
    limited = materialize(packed.join(of_chunk, "part").select(*packed.columns, "positives"), "negatives-limits")

    other = cells(limited, blocks, chunks, slots).mapInArrow(through_cells(read_other(k, low_pct, high_pct), OTHER), OTHER)
    rank = F.row_number().over(Window.partitionBy("anchor", "p").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id")))
    return other.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def negatives_report(rows: DataFrame) -> DataFrame:
    """Labels of ids divisible by 7 are moved on by one; ids divisible by 50 are anchors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(rows, F.col("id") % 50 == 0, label)


NEGATIVES_SQL = """
with r as (
  select row_number() over () as n, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as l,
    list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.n, a.vec_id as anchor_id, b.vec_id as id, a.l = b.l as same, list_dot_product(a.q, b.q)::bigint as score
  from r a join r b on a.n <> b.n where a.vec_id % 50 = 0),
p as (
  select *, row_number() over (partition by n order by score desc, id nulls last) as p from s where same qualify p <= 5),
m as (
  select p.anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.n, p.p order by s.score desc, s.id nulls last) as rank
  from p join s on p.n = s.n and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from m where rank <= 3
"""
