"""LM scoring by logistic context mixing, beside a counted unigram base.

A text is its words, lower-cased, and one end sign.  Every word is coded in bits, and a bit's probability mixes what several
hashed contexts have counted before it, with weights that a gate selects.  There are two alphabets:

  text   the HEADS most frequent words, the end sign and an escape, in a Huffman tree.  Contexts of a bit: none, the word
         before, the two words before, and the tree symbols of both (of other words their last byte).
  spell  a word behind an escape, byte by byte, bytes in a Huffman tree too.  Contexts: the last 2, 3 and 4 bytes, counted
         over different words, and the word so far, counted over the text.

Contexts are counted over all training texts, and an occurrence never counts for itself.  Weights of the text's bits are learned
online within a document, from START: it is read in at most SEGMENTS pieces, each piece is scored before the weights follow its
errors, and an adaptive map of the document corrects the mixed odds; the plain and the corrected odds compete by what they have
predicted so far.  A word is too short for that; its weights come from a Newton step over all training words.  Nothing depends on
how rows are dealt to tasks.

A word is spelled once for the whole corpus, however often it occurs, which is why its contexts end at its start.  Chunks of CHUNK
tokens list their distinct words, which meet by value to be counted; the words of a chunk come back to it for the score.
Context tables take as many slots as there are training tokens (or words), up to 2**MOST_BITS each, so that a worker can hold
them; slots have no check bits.

Null text counts as empty: one token, the end.  A null doc_id counts as the empty string.  Repeated rows: one result row each.
Without training texts all predictions are even.  An empty table gives an empty result.  Words of any length are
taken whole.  Other columns are not read; ids are whole numbers.
"""

from __future__ import annotations

import heapq
import math
import pickle
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, integer_id, join_counted, materialize

END = b"\n"  # no word holds it
ESCAPE, STOP, FIRST = 0, 1, 2  # symbols of the text's tree; words from FIRST on
CHUNK = 3_000_000  # tokens
HEADS = 511
MOST_BITS = 20
ROUNDS = 1  # Newton steps for the weights of letters
WORD_GATES, LETTER_GATES = 4, 6
START = (0.5, 0.3, 0.2, 0.15, 0.0)  # a document's first weights of the text's contexts and of a constant
GROUP = 150_000  # tokens scored together
SEGMENTS, LEAST = 8, 32  # pieces of a document, tokens of a piece
PRIOR = 0.4
RATE = 0.002
BUCKETS = 24  # of log odds in the adaptive map
CELLS = 1 << 14  # slots of a table block on its way
FAN_IN = 32  # blocks that one task adds up
_M, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def is_held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


# --- chunks ---------------------------------------------------------------------------------------------

NAMES = ["chunk", "idx", "word", "train", "head"]


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def chunk_rows(batches):
    """docs (doc_id, text) -> a row (chunk, idx, word, train) for each distinct word of a chunk, and one with `head`, its documents as word numbers."""
    part, seq, known, docs, ids, size = TaskContext.get().partitionId(), 0, Numbers({END: 0}), [], [], 0
    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
            ws = words_of(text.as_py())
            docs.append(doc_id)
            ids.append(np.fromiter(map(known.__getitem__, [*ws, END]), np.int32, len(ws) + 1))
            size += len(ids[-1])
            if size >= CHUNK:
                yield from one_chunk((part << 32) | seq, known, docs, ids)
                known, docs, ids, size, seq = Numbers({END: 0}), [], [], 0, seq + 1
    if docs:
        yield from one_chunk((part << 32) | seq, known, docs, ids)


def hashes(words) -> np.ndarray:
    """40-bit hashes of words, which tell contexts and the head words; counting goes by the words themselves."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) & np.uint64((1 << 40) - 1)


def one_chunk(chunk: int, known: dict, docs: list, ids: list):
    size = np.array(list(map(len, ids)))
    held = np.array(list(map(is_held_out, docs)))
    tokens, words = np.concatenate(ids), list(known)
    often = np.bincount(tokens)
    often[0] = len(tokens) + 1
    order = np.argsort(-often, kind="stable")  # the end sign, then frequent words: small numbers take less room
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    tokens, words = rank[tokens], [words[i] for i in order]
    count = np.bincount(tokens[np.repeat(~held, size)], minlength=len(words)).astype(np.int64)
    about = {
        "ids": docs, "held": held, "size": size, "tokens": tokens.view(np.uint8).reshape(-1, 4).T.tobytes(),
        "hash": hashes(words).view(np.uint8).reshape(-1, 8)[:, :5].tobytes(),
        "last": np.frombuffer(b"".join(w[-1:] for w in words), np.uint8), "len": np.fromiter(map(len, words), np.int32, len(words)),
    }
    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([-1], pa.int32()), pa.array([None], pa.binary()), pa.array([0]), pa.array([zlib.compress(pickle.dumps(about), 1)], pa.binary())], names=NAMES)
    for i in range(0, len(words), 50_000):
        w = words[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), chunk)), pa.array(np.arange(i, i + len(w)), pa.int32()), pa.array(w, pa.binary()), pa.array(count[i : i + len(w)]), pa.nulls(len(w), pa.binary())], names=NAMES)


def opened(head: bytes) -> dict:
    about = pickle.loads(zlib.decompress(head))
    about["tokens"] = np.frombuffer(about["tokens"], np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()
    five = np.frombuffer(about["hash"], np.uint8).reshape(-1, 5)
    about["hash"] = np.concatenate([five, np.zeros((len(five), 3), np.uint8)], 1).view(np.uint64).ravel()
    return about


# --- trees, contexts and tables -------------------------------------------------------------------------


class Code:
    """Huffman code of symbols 0..n-1: for each its path of inner nodes and bits."""

    def __init__(self, counts):
        heap = [(float(c), i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        up, n = {}, len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a[1]], up[b[1]] = (n, 0), (n, 1)
            heapq.heappush(heap, (a[0] + b[0], n))
            n += 1
        paths = []
        for i in range(len(counts)):
            path = []
            while i in up:
                i, bit = up[i]
                path.append((i - len(counts), bit))
            paths.append(path[::-1])
        self.nodes = max(1, len(counts) - 1)
        self.length = np.array([len(p) for p in paths])
        self.start = np.cumsum(self.length) - self.length
        flat = np.array([x for p in paths for x in p], np.int64).reshape(-1, 2)
        self.node, self.bit = flat[:, 0].copy(), flat[:, 1].astype(np.float32)
        self.mark = self.node.astype(np.uint64) * _M

    def events(self, symbols: np.ndarray):
        """(which symbol, place in the paths, bit) of all bits of the symbols in order."""
        n = self.length[symbols]
        of = np.repeat(np.arange(len(symbols)), n)
        at = np.arange(len(of)) + np.repeat(self.start[symbols] - (np.cumsum(n) - n), n)
        return of, at, self.bit[at]


class Table:
    """Counted zeros and ones; context 0 of `plain` contexts has an exact slot for each node, others are hashed."""

    def __init__(self, code: Code, contexts: int, bits: int, plain: bool):
        self.code, self.plain, self.bits = code, plain, bits
        sizes = [code.nodes if plain and c == 0 else 1 << bits for c in range(contexts)]
        self.first = np.cumsum([0, *sizes])
        self.counts = None

    def slots(self, c: int, context: np.ndarray | None, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.plain and c == 0:
            return self.code.node[at]
        h = context[of]
        h += self.code.mark[at]
        h *= _S
        h ^= h >> np.uint64(29)
        h *= _M
        h >>= np.uint64(64 - self.bits)
        out = h.view(np.int64)
        out += self.first[c]
        return out

    def empty(self) -> np.ndarray:
        return np.zeros(2 * int(self.first[-1]), np.int64)

    def __getstate__(self):
        return self.__dict__ | {"counts": None if self.counts is None else zlib.compress(self.counts.tobytes(), 1)}

    def __setstate__(self, state):
        self.__dict__.update(state)
        if self.counts is not None:
            self.counts = np.frombuffer(zlib.decompress(self.counts), np.int64)

    def hold(self, blocks: dict[int, np.ndarray]) -> None:
        out = np.zeros((int(self.first[-1]), 2), np.float32)
        for i, raw in blocks.items():
            cut = raw.reshape(-1, 2)
            out[i * CELLS : i * CELLS + len(cut)] = cut
        self.counts = out.view(np.int64).ravel()  # zeros and ones of a slot in one read

    def read(self, slots: np.ndarray) -> np.ndarray:
        return self.counts.take(slots).view(np.float32).reshape(-1, 2)


def odds(n: np.ndarray, own0, own1) -> tuple[np.ndarray, np.ndarray]:
    """(log odds, how many) of counts without own zeros and ones."""
    n0, n1 = n[:, 0] - own0, n[:, 1] - own1
    total = n0 + n1
    n0 += np.float32(PRIOR)
    n1 += np.float32(PRIOR)
    n1 /= n0
    return np.log(n1, out=n1), total


def add_counts(total: np.ndarray, slots: np.ndarray, bit: np.ndarray, times=None) -> None:
    at = 2 * slots
    at += bit.astype(np.int64)
    if times is not None:
        np.add.at(total, at, times)
        return
    low = int(at.min()) & -2
    got = np.bincount(at - low)
    total[low : low + len(got)] += got


def block_rows(total: np.ndarray):
    """A table's blocks that hold something, as rows (block, lane, raw)."""
    for i in range(0, len(total), 2 * CELLS):
        if (cut := total[i : i + 2 * CELLS]).any():
            yield raw_row(i // (2 * CELLS), cut)


def raw_row(block: int, values: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([TaskContext.get().partitionId()]), pa.array([packed(values)], pa.binary())], names=["block", "lane", "raw"])


def packed(values: np.ndarray) -> bytes:
    if values.dtype == np.int64 and values.max() < 2**31:
        values = values.astype(np.int32)
    return values.dtype.char.encode() + zlib.compress(values.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    values = np.frombuffer(zlib.decompress(raw[1:]), raw[:1].decode())
    return values.astype(np.int64) if values.dtype == np.int32 else values


RAW = "block int, lane long, raw binary"


def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    total = 0
    for raw in pdf.sort_values("lane")["raw"]:
        total = total + unpacked(raw)
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "lane": [pdf["lane"].iloc[0]], "raw": [packed(total)]})


def gathered(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sums by block, on the driver: as many as a table of bounded size has. Tasks add up FAN_IN blocks at a time."""
    lanes = rows.rdd.getNumPartitions()
    while lanes > FAN_IN:
        lanes = -(-lanes // FAN_IN)
        rows = rows.withColumn("lane", F.floor(F.col("lane") / FAN_IN)).groupBy("block", "lane").applyInPandas(add_up, RAW)
    return {r["block"]: unpacked(r["raw"]) for r in rows.groupBy("block").applyInPandas(add_up, RAW).toLocalIterator()}


# --- mixing ---------------------------------------------------------------------------------------------


def fitted(rows: DataFrame, fit, model, gates: int, contexts: int) -> np.ndarray:
    """Weights by gate after ROUNDS Newton steps over all training rows; zeros without any."""
    w = np.full((gates, contexts + 1), 1 / contexts, np.float32)
    for _ in range(ROUNDS):
        sums = gathered(rows.mapInArrow(fit(model, w), RAW))
        w = stepped(sums[0], w) if sums else 0 * w
    return w


def newton_sums(x: np.ndarray, gate: np.ndarray, bit: np.ndarray, w: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
    """By gate: curvature and gradient of the log likelihood at weights w."""
    p = chance(mixed(x, gate, w))
    err, v = bit - p, p * (1 - p)
    if weight is not None:
        err, v = err * weight, v * weight
    out = np.empty((len(w), len(x), len(x) + 1))
    for g in range(len(w)):
        at = np.flatnonzero(gate == g)
        xg = x[:, at]
        out[g, :, :-1], out[g, :, -1] = (xg * v[at]) @ xg.T, xg @ err[at]
    return out


def stepped(sums: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights after a Newton step, to three digits: the order in which sums were added doesn't show."""
    sums = sums.reshape(len(w), w.shape[1], w.shape[1] + 1)
    step = [np.linalg.solve(s[:, :-1] + np.eye(len(s)), s[:, -1]) for s in sums]
    return np.round(np.clip(w + np.array(step), -2, 3), 3).astype(np.float32)


def mixed(x: np.ndarray, gate: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x[0] * w[:, 0].take(gate)
    for c in range(1, len(x)):
        z += x[c] * w[:, c].take(gate)
    return np.clip(z, np.float32(-14), np.float32(14), out=z)


def chance(z: np.ndarray) -> np.ndarray:
    p = np.exp(-z)
    p += np.float32(1)
    return np.divide(np.float32(1), p, out=p)


# --- the text's words -----------------------------------------------------------------------------------


def symbols_of(about: dict, heads: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each word's symbol, and what tells its kind: the symbol, or the last byte behind an escape."""
    (order, symbol), h = heads, about["hash"]
    at = np.minimum(np.searchsorted(order, h), max(0, len(order) - 1))
    sym = np.where(order[at] == h, symbol[at], ESCAPE) if len(order) else np.zeros(len(h), np.int64)
    sym[0] = STOP
    return sym, np.where(sym == ESCAPE, about["last"] + np.int64(HEADS + FIRST), sym).astype(np.uint64)


class Words:
    """Symbols and contexts of a group of documents' tokens."""

    def __init__(self, about: dict, heads: tuple[np.ndarray, np.ndarray], tokens: np.ndarray, size: np.ndarray):
        if "symbol" not in about:
            about["symbol"], about["kind"] = symbols_of(about, heads)
        h, kind, sym = about["hash"], about["kind"], about["symbol"]
        n = len(tokens)
        self.symbol = sym[tokens]
        self.doc = np.repeat(np.arange(len(size)), size)
        place = np.arange(n) - np.repeat(np.cumsum(size) - size, size)

        def back(values: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros(n, np.uint64)
            out[k:] = values[tokens[: max(0, n - k)]]
            out[place < k] = 0
            return out

        one, two = back(h, 1), back(h, 2)
        self.contexts = [None, one * _S + np.uint64(1), (one + two * _M) * _S + np.uint64(2), (back(kind, 1) * np.uint64(8192) + back(kind, 2)) * _M + np.uint64(3)]


def word_groups(about: dict, training: bool, least: int = GROUP):
    """(documents, tokens, sizes) of about `least` tokens each."""
    size, first = about["size"], np.cumsum(about["size"]) - about["size"]
    take = np.flatnonzero(~about["held"]) if training else np.arange(len(size))
    ends, i = np.cumsum(size[take]), 0
    while i < len(take):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - size[take[i]] + least)) + 1)
        docs = take[i:j]
        yield docs, np.concatenate([about["tokens"][first[d] : first[d] + size[d]] for d in docs]), size[docs]
        i = j


def count_words(held):
    def run(batches):
        code, heads, table = held.value
        total, some = table.empty(), False
        for b in batches:
            for head in b.column("head"):
                about = opened(head.as_py())
                for _, tokens, size in word_groups(about, True, 2 * GROUP):
                    t, some = Words(about, heads, tokens, size), True
                    of, at, bit = code.events(t.symbol)
                    for c, context in enumerate(t.contexts):
                        add_counts(total, table.slots(c, context, of, at), bit)
        if some:
            yield from block_rows(total)

    return run


def word_inputs(table: Table, t: Words, of, at, bit, own) -> tuple[np.ndarray, np.ndarray]:
    """(log odds of all contexts, gate): the gate is 0 to 3 as the two words before, the word before or neither have been seen."""
    x = np.empty((len(t.contexts) + 1, len(of)), np.float32)
    own1 = own * bit
    own0, seen = own - own1, []
    for c, context in enumerate(t.contexts):
        x[c], n = odds(table.read(table.slots(c, context, of, at)), own0, own1)
        seen.append(n)
    x[-1] = 0.3
    both = seen[2]
    return x, (both > 3.5).astype(np.int64) + (both > 0.5) + ((both > 0.5) | (seen[1] > 0.5))


def score_words(about: dict, code: Code, heads, table: Table) -> np.ndarray:
    """log10 probabilities of each document's symbols, learned online within the document."""
    out = np.zeros(len(about["size"]))
    for docs, tokens, size in word_groups(about, False):
        t = Words(about, heads, tokens, size)
        step = np.maximum(LEAST, -(-size // SEGMENTS))
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
        piece = place // step[t.doc]
        w = np.tile(np.array(START, np.float32), (len(docs) * WORD_GATES, 1))  # by document and gate
        own = (~about["held"][docs]).astype(np.float32)
        middle = 1 / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS / 2 + 0.5)))
        ones, alls = np.tile(8 * middle, len(docs)), np.full(len(docs) * BUCKETS, 8.0)
        sums = np.zeros((2, len(docs)))
        order = np.argsort(piece, kind="stable")
        ends = np.cumsum(np.bincount(piece))
        for i, j in zip(np.append(0, ends[:-1]), ends):
            now = order[i:j]
            of, at, bit = code.events(t.symbol[now])
            of = now[of]
            doc = t.doc[of]
            x, gate = word_inputs(table, t, of, at, bit, own[doc])
            gate += doc * WORD_GATES
            z = mixed(x, gate, w)
            p = chance(z)
            cell = doc * BUCKETS + np.clip((z + np.float32(BUCKETS / 2)).astype(np.int64), 0, BUCKETS - 1)
            err = bit - p
            got = 1 - np.abs(err)  # the probability of what came
            first = np.flatnonzero(np.diff(doc, prepend=-1))  # a piece has its documents in order
            sums[0, doc[first]] += np.add.reduceat(np.log10(got), first, dtype=np.float64)
            q = (ones / alls).astype(np.float32)[cell]
            got += 1 - np.abs(bit - q)
            got *= np.float32(0.5)
            sums[1, doc[first]] += np.add.reduceat(np.log10(got, out=got), first, dtype=np.float64)
            for c in range(len(x)):
                w[:, c] += np.float32(RATE) * np.bincount(gate, err * x[c], len(w)).astype(np.float32)
            ones += np.bincount(cell, bit, len(ones))
            alls += np.bincount(cell, minlength=len(alls))
        top = sums.max(0)
        out[docs] = top + np.log10((10 ** (sums[0] - top) + 10 ** (sums[1] - top)) / 2)
    return out


# --- spelled words --------------------------------------------------------------------------------------


def spelled(batches, limit: int = 40_000):
    """Batches (word, c, n) without head words, in pieces."""
    for b in batches:
        for i in range(0, b.num_rows, limit):
            s = b.slice(i, limit)
            yield s, s.column("word").to_pylist(), s.column("c").to_numpy().astype(np.float32)


class Letters:
    """Bytes of words, each ended by a space, and their contexts."""

    def __init__(self, words: list[bytes]):
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        a = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        n = len(a)
        self.symbol, self.word = a.astype(np.int64), np.repeat(np.arange(len(words)), size)
        first = np.cumsum(size) - size
        place = np.arange(n) - first[self.word]
        b = a.astype(np.uint64) + np.uint64(1)
        back = []
        for k in range(1, 5):
            v = np.zeros(n, np.uint64)
            v[k:] = b[: max(0, n - k)]
            v[place < k] = 0
            back.append(v)
        power = np.array([1], np.uint64)
        while len(power) <= place.max():
            power = np.concatenate([power, power * np.uint64(pow(int(_M), len(power), 2**64))])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(b * power[place])])
        key = np.zeros(n, np.uint64)
        self.contexts = []
        for k, v in enumerate(back):
            key = key * np.uint64(512) + v
            if k:
                self.contexts.append(key * _S + np.uint64(k))
        self.contexts.append((sums[:-1] - sums[first[self.word]]) * _S + np.uint64(9))


def letter_counts(batches):
    total = np.zeros(256, np.int64)
    for _, words, c in spelled(batches):
        total += np.bincount(np.frombuffer(b" ".join(w for w, k in zip(words, c) if k) + b" ", np.uint8), minlength=256)
    yield raw_row(0, total)


def count_letters(held):
    """Contexts of the last bytes count different words, the word so far counts tokens."""

    def run(batches):
        code, table = held.value
        total, some = table.empty(), False
        for _, words, c in spelled(batches):
            at = np.flatnonzero(c > 0)
            if not len(at):
                continue
            t, some = Letters([words[i] for i in at]), True
            of, path, bit = code.events(t.symbol)
            times = c[at][t.word[of]].astype(np.int64)
            for k, context in enumerate(t.contexts):
                add_counts(total, table.slots(k, context, of, path), bit, times if k == len(t.contexts) - 1 else None)
        if some:
            yield from block_rows(total)

    return run


def letter_inputs(counts: list, bit: np.ndarray, c: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(log odds of all contexts, gate) of bits whose contexts have these counts; c, by bit, how often its word occurs in training: one of them doesn't count."""
    x = np.empty((len(counts) + 1, len(bit)), np.float32)
    whole = len(counts) - 1  # the word so far counts tokens
    seen = None
    for k, n in enumerate(counts):
        own = np.float32(0) if c is None else ((c > 0.5) if k == whole else (c > 0.5) & (c < 1.5)).astype(np.float32)
        own1 = own * bit
        before, (x[k], seen) = seen, odds(n, own - own1, own1)
    x[-1] = 0.3
    gate = (seen > 0.5).astype(np.int64) + (seen > 1.5) + (seen > 5.5) + (seen > 30.5)
    return x, np.where(gate > 0, gate + 1, before > 0.5)


def letter_counts_of(table: Table, t: Letters, of, at) -> list[np.ndarray]:
    return [table.read(table.slots(k, context, of, at)) for k, context in enumerate(t.contexts)]


def fit_letters(held, w):
    def run(batches):
        code, table = held.value
        total = 0
        for _, words, c in spelled(batches):
            at = np.flatnonzero(c > 0)
            if len(at):
                t, own = Letters([words[i] for i in at]), c[at]
                of, path, bit = code.events(t.symbol)
                x, gate = letter_inputs(letter_counts_of(table, t, of, path), bit, own[t.word[of]])
                total = total + newton_sums(x, gate, bit, w, own[t.word[of]])
        if not np.isscalar(total):
            yield raw_row(0, total.ravel())

    return run


def score_letters(held, w):
    """(word, c, n) -> the same and s, the log10 probability of the spelled word, and own_s, that where one occurrence doesn't count."""

    def run(batches):
        code, table = held.value
        for b, words, c in spelled(batches):
            t = Letters(words)
            of, at, bit = code.events(t.symbol)
            word = t.word[of]
            counts = letter_counts_of(table, t, of, at)

            def score(c) -> np.ndarray:
                p = chance(mixed(*letter_inputs(counts, bit, c), w))
                return np.bincount(word, np.log10(1 - np.abs(bit - p)), len(words))  # noqa: B023

            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score(None), pa.float32()), pa.array(score(c[word]), pa.float32())], names=["word", "c", "n", "s", "own_s"])

    return run


# --- documents ------------------------------------------------------------------------------------------

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def document_rows(held, n_train: int, n_words: int):
    """Rows (chunk, idx, c, s, own_s, head) sorted by chunk and idx, the head first -> documents' scores."""

    def finish(head: bytes, parts: list):
        about = opened(head)
        c, s, own_s = (np.concatenate(x).astype(np.float64) for x in zip(*parts))
        tokens, size = about["tokens"], about["size"]
        first = np.cumsum(size) - size
        add = lambda v: np.add.reduceat(v, first)  # noqa: E731  every document has its end sign
        base = add(np.log10(c + 1.0)[tokens]) - size * math.log10(n_train + n_words + 1)
        score = score_words(about, *held.value) + np.where(about["held"], add(s[tokens]), add(own_s[tokens]))
        n_bytes = add((about["len"] + 1)[tokens])
        cols = [pa.array(about["ids"], pa.int64()), pa.array(about["held"]), pa.array(size.astype(np.int64)), pa.array(add((c > 0)[tokens].astype(np.int64))), pa.array(np.full(len(size), n_train)), pa.array(base), pa.array(score), pa.array(n_bytes.astype(np.int64)), pa.array(-score * math.log2(10) / n_bytes)]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in RESULT.split(", ")])

    def run(batches):
        head, now, parts = None, None, []
        for b in batches:
            chunk = b.column("chunk").to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, [len(chunk)]]) if len(chunk) else []
            for i, j in zip(cut[:-1], cut[1:]):
                s = b.slice(i, j - i)
                if chunk[i] != now:
                    if head is not None:
                        yield finish(head, parts)
                    now, parts, head = chunk[i], [], s.column("head")[0].as_py()
                    s = s.slice(1)
                if s.num_rows:
                    parts.append([s.column(k).to_numpy(zero_copy_only=False) for k in ("c", "s", "own_s")])
        if head is not None:
            yield finish(head, parts)

    return run


def size_bits(n: int) -> int:
    return min(MOST_BITS, max(12, math.ceil(math.log2(max(1, n)))))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte), a row for each input row.

    n_bytes counts every word's bytes and one for what follows it, and the end sign's; bits_per_byte is the score over them.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    d = bound_batches(docs).select(integer_id(docs, id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = materialize(d.mapInArrow(chunk_rows, "chunk long, idx int, word binary, train long, head binary"), "lm-chunks")
    chunks = rows.where("head is not null").select("head")
    words = rows.where("word is not null").select("chunk", "idx", "word", "train")
    vocab = materialize(words.groupBy("word").agg(F.sum("train").alias("c"), F.count("*").alias("n")), "lm-vocab")
    n_train, n_words = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()

    top = vocab.where((F.col("c") > 1) & (F.col("word") != F.lit(END)) & (F.length("word") <= 256)).orderBy(F.desc("c"), "word").limit(HEADS).select("word", "c").collect()
    stops = vocab.where(F.col("word") == F.lit(END)).select("c").first()
    stops = stops[0] if stops else 0
    heads = {bytes(r["word"]): r["c"] for r in top}
    code = Code([n_train - stops - sum(heads.values()) + 0.5, stops + 0.5, *heads.values()])
    marks = hashes(heads)
    order = np.argsort(marks)
    found = (marks[order], order + FIRST)
    table = Table(code, 4, size_bits(n_train), True)
    table.hold(gathered(chunks.mapInArrow(count_words(share((code, found, table))), RAW)))
    text_model = share((code, found, table))

    known = spark.createDataFrame([(bytearray(w),) for w in [END, *heads]], "word binary")
    other = vocab.join(F.broadcast(known), "word", "left_anti")
    letters = gathered(other.mapInArrow(letter_counts, RAW))
    code = Code((letters[0] if letters else np.zeros(256)) + 0.5)
    table = Table(code, 4, size_bits(8 * n_words), False)
    table.hold(gathered(other.mapInArrow(count_letters(share((code, table))), RAW)))
    spell_model = share((code, table))
    weights = fitted(other, fit_letters, spell_model, LETTER_GATES, 4)
    key = F.xxhash64(F.lit("word"), "word").alias("key")
    scored = other.mapInArrow(score_letters(spell_model, weights), "word binary, c long, n long, s float, own_s float")
    scored = materialize(scored.unionByName(vocab.join(F.broadcast(known), "word").withColumns({"s": F.lit(0.0).cast("float"), "own_s": F.lit(0.0).cast("float")})).select(key, "c", "n", "s", "own_s"), "lm-scored")

    spell_model.destroy()
    back = join_counted(words.select("chunk", "idx", key), scored, ["key"]).select("chunk", "idx", "c", "s", "own_s", F.lit(None).cast("binary").alias("head"))
    none = F.lit(0.0).cast("float")
    front = rows.where("head is not null").select("chunk", "idx", F.lit(0).cast("long").alias("c"), none.alias("s"), none.alias("own_s"), "head")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = back.unionByName(front).repartition(parts, "chunk").sortWithinPartitions("chunk", "idx")
    return every.mapInArrow(document_rows(text_model, int(n_train), int(n_words)), RESULT)
