"""N-gram Jaccard self-join by prefix trees, down to connected components.

A document's set is its distinct 5-word shingles as 64-bit hashes, in one global order: shingles that a
fixed-size bitmap marks as common come last, else by hash.  Two sets with Jaccard >= 0.8 share a
shingle among the first n - ceil(0.8 n) + 1 of each (prefix filter), and k + 1 of them if k more are looked at, so a
set with fewer shared ones there takes no further part.  Sets that share a prefix
shingle meet in the group of that shingle's pivot, the smallest key of its posting run; a set is sent
once to each pivot it has, not once per shingle, and no pairs are written.

In a group, sets are stored in a path-compressed trie.  A set traverses the trie of those before it; partial
overlaps are shared along common paths, and a subtree is pruned once the overlap so far plus what remains on the
shorter side can't reach the threshold, or all its sets are already linked to the one that searches.  Groups above
BLOCK sets are split into blocks by hash, each with the pivot.  Only sets that the pivot doesn't
link, few among near copies, are searched in all other blocks too, so no link between blocks is lost.

Equal texts are one set from the start.  64-bit keys of texts and shingles stand for them.  Null or empty texts, or
texts of white space alone: empty set, linked with nothing, component_id is the own doc_id.  A null doc_id
takes part; it is never the smallest unless alone.  Repeated rows: one result row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, components, flag_keys, fresh, integer_id, key_bitmap, materialize, mix64, text_key

WORDS = 5
NUM, DEN = 4, 5  # the threshold 0.8
BLOCK = 512
SAMPLE = 16  # one text in so many is looked at to learn which shingles are common; affects speed alone
COMMON = 3
STEP = 64
SLICE = 512  # rows of a batch that are worked on at once
WORDS_HELD = 100_000  # hashes of words that a task keeps at a time
_P = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 2**64) for k in range(WORDS)], np.uint64)
_HALF = np.uint64(1) << np.uint64(63)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, known: Hashes) -> np.ndarray:
    """Sorted distinct 63-bit shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    x = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    if n < 1:
        h = (x * _P[: len(x)]).sum(keepdims=True) + np.uint64(len(x))
    else:
        h = x[:n] * _P[0]
        for k in range(1, WORDS):
            h = h + x[k : k + n] * _P[k]
    return np.unique(mix64(h) >> np.uint64(1))


class CommonBits:
    """Which shingle hashes may be common: a bitmap of 2**24 bits from key_bitmap rows."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.bits = np.zeros(1 << 24, bool)
        for word, raw in rows:
            at = int(word) << 15
            self.bits[at : at + (1 << 15)] = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little").astype(bool)

    def order(self, s: np.ndarray) -> np.ndarray:
        """Shingles in the global order: rare by hash, then common by hash."""
        late = self.bits[(s & np.uint64((1 << 24) - 1)).astype(np.int64)]
        return np.sort(np.where(late, s | _HALF, s))


def need(n: int) -> int:
    """Least overlap that a set of n shingles has with any set it links to."""
    return -(-NUM * n // DEN)


def extra(n: int) -> int:
    """Shingles beyond the prefix that are looked at."""
    return n // 10


def shared_least(n: int) -> int:
    """Of prefix and extra, those a linked pair has in common: one more than extra, by the smaller set's size."""
    return extra(need(n)) + 1


def linked(overlap: int, a: int, b: int) -> bool:
    return DEN * overlap >= NUM * (a + b - overlap)


class Node:
    __slots__ = ("edge", "kids", "sets", "low", "high", "members")

    def __init__(self, edge: np.ndarray):
        self.edge, self.kids, self.sets, self.low, self.high, self.members = edge, {}, [], 1 << 60, 0, []


class Trie:
    """Ordered sets as root paths, each node's edge a run of shingles."""

    def __init__(self):
        self.root, self.sizes = Node(np.zeros(0, np.uint64)), []

    def add(self, s: np.ndarray) -> int:
        me = len(self.sizes)
        self.sizes.append(len(s))
        node, at = self.root, 0
        while True:
            node.low, node.high = min(node.low, len(s)), max(node.high, len(s))
            node.members.append(me)
            if at == len(s):
                node.sets.append(me)
                return me
            kid = node.kids.get(int(s[at]))
            if kid is None:
                kid = Node(s[at:])
                node.kids[int(s[at])] = kid
                kid.low = kid.high = len(s)
                kid.members.append(me)
                kid.sets.append(me)
                return me
            rest = s[at : at + len(kid.edge)]
            same = kid.edge[: len(rest)] == rest
            n = len(rest) if same.all() else int(same.argmin())
            if n < len(kid.edge):
                top = Node(kid.edge[:n])
                top.low, top.high, top.members = kid.low, kid.high, list(kid.members)
                top.kids[int(kid.edge[n])] = kid
                kid.edge = kid.edge[n:]
                node.kids[int(s[at])] = top
                kid = top
            node, at = kid, at + n

    def search(self, q: np.ndarray, skip) -> Iterator[int]:
        """Sets that q links to. skip(members): true if the subtree's sets needn't be told."""
        todo = [(self.root, 0, 0, 0)]
        size = len(q)
        while todo:
            node, depth, over, at = todo.pop()
            if skip(node.members):
                continue
            ok, edge = True, node.edge
            for i in range(0, len(edge), STEP):
                piece = edge[i : i + STEP]
                pos = np.searchsorted(q, piece)
                hit = pos < size
                hit[hit] = q[pos[hit]] == piece[hit]
                over += int(hit.sum())
                depth += len(piece)
                at = int(np.searchsorted(q, piece[-1], "right"))
                most = over + min(size - at, node.high - depth)
                if (NUM + DEN) * most < NUM * (size + node.low):
                    ok = False
                    break
            if not ok:
                continue
            for i in node.sets:
                if linked(over, size, self.sizes[i]):
                    yield i
            todo += [(kid, depth, over, at) for kid in node.kids.values()]


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def join_group(sets: list[np.ndarray], probe: list[bool] | None = None) -> Union:
    """Components of the link graph of sets. With probe, only those marked search; the others are just stored."""
    u, trie = Union(len(sets)), Trie()
    order = range(len(sets)) if probe is None else sorted(range(len(sets)), key=lambda i: probe[i])
    place = []  # set of each trie entry
    for i in order:
        if probe is None or probe[i]:
            roots: dict[int, None] = {}

            def skip(members, i=i):
                r = u.find(i)
                return all(u.find(place[m]) == r for m in members)

            for j in trie.search(sets[i], skip):
                u.join(i, place[j])
        trie.add(sets[i])
        place.append(i)
    return u


# --- distributed part -----------------------------------------------------------------------------------


def slices(batches):
    """The batches in pieces of SLICE rows, so that what is made of a piece stays small."""
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


ROWS = ["doc_id", "key", "n", "shingle", "core"]


def prefix_rows(held):
    """docs (doc_id, text, key) -> header rows (shingle null) and a row for each prefix (core) and extra shingle."""

    def run(batches):
        known = Hashes()
        for b in slices(batches):
            ids, texts, keys = b.column("doc_id"), b.column("text"), b.column("key").to_numpy()
            at_keys, at_sh, at_core, sizes = [], [], [], []
            for text, key in zip(texts, keys):
                s = held.value.order(shingles(text.as_py(), known))
                sizes.append(len(s))
                if len(s):
                    core = len(s) - need(len(s)) + 1
                    p = s[: core + extra(len(s))]
                    at_sh.append(p)
                    at_core.append(np.arange(len(p)) < core)
                    at_keys.append(np.full(len(p), key, np.int64))
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], names=ROWS)
            if at_sh:
                k, sh = np.concatenate(at_keys), np.concatenate(at_sh).view(np.int64)
                size = np.repeat(np.array([x for x in sizes if x], np.int32), [len(p) for p in at_sh])
                c = np.concatenate(at_core)
                for i in range(0, len(k), 100_000):
                    z = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(k[z]), pa.int64()), pa.array(k[z]), pa.array(size[z]), pa.array(sh[z]), pa.array(c[z])], names=ROWS)

    return run


def common_rows(batches):
    """Sampled docs (text, key) -> (shingle, key)."""
    known = Hashes()
    for b in slices(batches):
        keys, sh = [], []
        for text, key in zip(b.column("text"), b.column("key").to_numpy()):
            s = shingles(text.as_py(), known)
            sh.append(s)
            keys.append(np.full(len(s), key, np.int64))
        if sh:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sh).view(np.int64)), pa.array(np.concatenate(keys))], names=["shingle", "key"])


def whole_runs(batches, names):
    """Columns of sorted batches, cut only where the first column changes."""
    held = None
    for b in batches:
        now = [b.column(c).to_numpy() for c in names]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1], "left"))
        held = [x[cut:] for x in now]
        if cut:
            yield [x[:cut] for x in now]
    if held is not None:
        yield held


def shared_counts(batches):
    """Rows (shingle, key) sorted so -> (key, n): how many of a key's shingles other keys have too."""
    for sh, key in whole_runs(batches, ("shingle", "key")):
        first = np.flatnonzero(np.append(True, sh[1:] != sh[:-1]))
        size = np.diff(np.append(first, len(sh)))
        both = np.repeat(np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first), size)
        once = np.append(True, (sh[1:] != sh[:-1]) | (key[1:] != key[:-1]))  # copies send the same rows
        u, n = np.unique(key[both & once], return_counts=True)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], names=["key", "shared"])


def pivots_of_runs(batches):
    """Rows (shingle, n, key) sorted so -> distinct (key, pivot) of runs of at least two sets.

    A run of one shingle is cut where no two neighbours by size can link; its pivot is its smallest key.
    """
    for sh, n, key in whole_runs(batches, ("shingle", "n", "key")):
        yield from emit_runs(sh, n, key)


def emit_runs(sh, n, key):
    if not len(sh):
        return
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (DEN * n[:-1].astype(np.int64) < NUM * n[1:].astype(np.int64))
    first = np.flatnonzero(new)
    low = np.minimum.reduceat(key, first)
    high = np.maximum.reduceat(key, first)
    size = np.diff(np.append(first, len(sh)))
    keep = np.repeat(low != high, size)
    pair = np.unique(np.stack([key[keep], np.repeat(low, size)[keep]], 1), axis=0)
    if len(pair):
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["key", "pivot"])


def groups(batches, cols):
    """Runs of equal cols of sorted batches, as lists of rows."""
    now, rows = None, []
    for b in slices(batches):
        for r in b.to_pylist():
            k = tuple(r[c] for c in cols)
            if k != now:
                if rows:
                    yield rows
                now, rows = k, []
            rows.append(r)
    if rows:
        yield rows


def block_links(held):
    """Rows (pivot, block, key, text) sorted by group -> (pivot, key, root, to_pivot)."""

    def run(batches):
        known = Hashes()
        for rows in groups(batches, ("pivot", "block")):
            rows = sorted({r["key"]: r for r in rows}.values(), key=lambda r: (r["key"] != r["pivot"], r["key"]))
            u = join_group([held.value.order(shingles(r["text"], known)) for r in rows])
            keys = [r["key"] for r in rows]
            root = [u.find(i) for i in range(len(rows))]
            least = {}
            for k, r in zip(keys, root):
                least[r] = min(k, least.get(r, k))
            lone = rows[0]["key"] != rows[0]["pivot"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["pivot"] for r in rows], pa.int64()), pa.array(keys, pa.int64()), pa.array([least[r] for r in root], pa.int64()), pa.array([not lone and r == root[0] for r in root], pa.bool_())],
                names=["pivot", "key", "root", "to_pivot"],
            )

    return run


def probe_links(held):
    """Rows (pivot, block, part, key, text, probe) sorted by group -> edges (a, b)."""

    def run(batches):
        known = Hashes()
        for rows in groups(batches, ("pivot", "block", "part")):
            by = {}
            for r in rows:
                if r["key"] not in by or r["probe"]:
                    by[r["key"]] = r
            rows = list(by.values())
            u = join_group([held.value.order(shingles(r["text"], known)) for r in rows], [r["probe"] for r in rows])
            edges = [(rows[i]["key"], rows[u.find(i)]["key"]) for i in range(len(rows)) if u.find(i) != i]
            if edges:
                a, b = zip(*edges)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def classed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, n, component_id, stays), a row for each input row; stays: key of the component's text with its least id."""
    spark = docs.sparkSession
    d = bound_batches(docs).select(integer_id(docs, id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    sample = d.where(F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(SAMPLE)) == 0).select("text", "key")
    often = sample.mapInArrow(common_rows, "shingle long, key long").groupBy("shingle", "key").agg(F.lit(1).alias("x")).groupBy("shingle").count().where(F.col("count") >= COMMON)
    bits = key_bitmap(often, "shingle").collect()  # at most 512 rows of 4 KB
    held = spark.sparkContext.broadcast(CommonBits([(r["_word"], r["_bits"]) for r in bits]))

    rows = materialize(d.select("doc_id", "text", "key").mapInArrow(prefix_rows(held), "doc_id long, key long, n int, shingle long, core boolean"), "join-prefixes")
    heads = rows.where("shingle is null").select("doc_id", "key", "n")
    found = rows.where("shingle is not null").select("shingle", "key").repartition(parts, "shingle").sortWithinPartitions("shingle", "key")
    shared = found.mapInArrow(shared_counts, "key long, shared long").groupBy("key").agg(F.sum("shared").alias("shared"))
    # ceil(0.8 n) div 10 + 1, see shared_least
    able = heads.groupBy("key").agg(F.first("n").alias("n")).join(shared, "key").where(f"shared >= ((n * {NUM} + {DEN - 1}) div {DEN}) div 10 + 1")
    able = materialize(able.select("key"), "join-able")
    runs = flag_keys(rows.where("core"), "key", key_bitmap(able, "key"), "maybe").where("maybe").select("shingle", "n", "key")
    runs = runs.repartition(parts, "shingle").sortWithinPartitions("shingle", "n", "key")
    pairs = materialize(runs.mapInArrow(pivots_of_runs, "key long, pivot long").distinct(), "join-pivots")

    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = materialize(sizes, "join-sizes")
    own = pairs.join(sizes, "pivot").withColumn("block", F.when(F.col("key") == F.col("pivot"), F.lit(None).cast("int")).otherwise(F.pmod(F.xxhash64(F.lit(2), "key"), F.col("blocks")).cast("int")))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    spread = own.withColumn("block", F.explode(F.when(F.col("block").isNull(), every).otherwise(F.array("block")))).select("pivot", "block", "key", "blocks")
    spread = materialize(spread, "join-spread")

    # one row of each text that meets another
    wanted = flag_keys(d.select("key", "text", "doc_id"), "key", key_bitmap(pairs, "key"), "maybe").where("maybe")
    once = heads.groupBy("key").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("rep"))
    once = pairs.select("key").distinct().join(once, "key")
    texts = wanted.withColumn("rep", F.coalesce("doc_id", F.lit(-(2**63)))).join(once, ["key", "rep"]).select("key", "text")
    texts = materialize(texts, "join-texts")

    sent = spread.join(texts, "key").select("pivot", "block", "key", "text").repartition(parts, "pivot", "block").sortWithinPartitions("pivot", "block", "key")
    found = materialize(sent.mapInArrow(block_links(held), "pivot long, key long, root long, to_pivot boolean"), "join-links")
    edges = found.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b"))

    # sets of split groups that their pivot doesn't link are searched in all blocks of the group
    stray = found.where("not to_pivot and key <> pivot").select("pivot", "key").join(sizes.where("blocks > 1"), "pivot")
    if not stray.isEmpty():
        n_parts = materialize(stray.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_parts")), "join-parts")
        stray = stray.join(n_parts, "pivot").withColumn("part", F.pmod(F.xxhash64(F.lit(3), "key"), F.col("n_parts")).cast("int"))
        probes = stray.select("pivot", F.explode(every).alias("block"), "part", "key", F.lit(True).alias("probe"))
        stored = spread.join(n_parts, "pivot").select("pivot", "block", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), "key", F.lit(False).alias("probe"))
        meet = materialize(probes.union(stored), "join-meet").join(texts, "key")
        meet = meet.repartition(parts, "pivot", "block", "part").sortWithinPartitions("pivot", "block", "part", "key")
        more = meet.select("pivot", "block", "part", "key", "text", "probe").mapInArrow(probe_links(held), "a long, b long")
        edges = edges.union(more)

    roots = components(materialize(edges.distinct(), "join-edges"), "join-cc")
    by_text = heads.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("low"))
    by_text = materialize(by_text.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "low", F.coalesce("root", "key").alias("root")), "join-roots")
    first = F.min(F.struct(F.coalesce("low", F.lit(2**63 - 1)), "key"))["key"]
    least = materialize(by_text.groupBy("root").agg(F.min("low").alias("component_id"), first.alias("stays")), "join-least")
    final = materialize(by_text.join(least, "root").select("key", "component_id", "stays"), "join-final")
    out = heads.join(final, "key", "left")
    return out.select("doc_id", "key", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "stays")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each input row. Ids are whole numbers; an empty table gives an empty result; other columns are not read."""
    return classed(docs, id_col, text_col).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that hold the text with the smallest id of its component, one of equal rows, all columns unchanged.

    A row is judged by its id and its text, so rows that share an id but not a text are judged apart; of several texts
    of a component with its smallest id one stays.  Rows without an id stay, but for repeats of one text.
    """
    key = fresh(docs, "text_key")
    seen = classed(docs, id_col, text_col)
    gone = seen.where("n > 0 and (doc_id <> component_id or key <> stays)").select(F.col("doc_id").alias(id_col), F.col("key").alias(key)).distinct()
    out = docs.withColumn(key, text_key(F.col(text_col)))
    return out.join(materialize(gone, "join-gone"), [id_col, key], "left_anti").dropDuplicates([id_col, key]).select(*docs.columns)
