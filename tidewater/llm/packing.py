"""Packing of tokenized documents into windows of at most `size` tokens, in order, by dynamic programming.

Documents are taken in the order of their partition.  Windows may end at the end of a document, behind a sentence, or, where
a sentence is longer than GRID tokens, at every GRID tokens of it.  A window costs its padding (`size` less its
length, none at a power of two) and a penalty for a cut inside a document; the cheapest cuts are found from left to
right.  best[j] + j decides among all starts j at most `size` back, so a monotone queue holds the candidates;
windows of exactly a power of two are tried besides.  A block of documents of some BLOCK tokens is solved at a time, so memory is
bounded by the block and the longest text; a longer document is solved in stretches of BLOCK tokens.

Text is encoded word by word: the tokenizer never joins tokens across white space, nor a letter with the
sign behind it, so each distinct word is encoded once and looked up from then on.  Texts that hold a string of an added token,
in whichever case, are encoded whole.

Null or empty text: only the end token.  Null id: stays null.  Repeated rows: packed each for itself.  Empty table: no piece.
Ties: the longest window of equally cheap ones, powers of two only where cheaper.  Other columns are not read.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, integer_id

SIZE, END = 4096, 2
#: Costs of a cut, in tokens of padding.
AT_SENTENCE, IN_SENTENCE = 2, 8
GRID, BLOCK = 64, 1 << 19
#: Distinct words that a worker remembers, and how many tokens of them.
REMEMBERED, REMEMBERED_TOKENS = 600_000, 4_000_000
#: Letters that are one letter each in every normal form and lower-case to one; what the model takes for their bytes.
LETTERS = re.compile("[a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
BYTES = {c: "".join(chr(b if b in range(0xA1, 0xAD) or b >= 0xAE else 0x121 + b - 0x7F if b < 0xA1 else 0x143) for b in chr(c).encode()) for c in range(0xC0, 0x100)}
#: A letter before a sign other than the apostrophe: no token spans both.
LETTER_SIGN = "([a-z\xdf-\xf6\xf8-\xff])([!-&(-/:-@\\[-`{-~])"

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first[i] to first[i] + n[i] - 1 of each i, one after another."""
    before = np.cumsum(n) - n
    return np.repeat(first - before, n) + np.arange(n.sum())


class Encoder:
    """Tokens of whole texts, equal to the tokenizer's own; distinct words are encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.added = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()]
        self.forget()
        signs, letters = set(".!?"), self.whole.get_vocab()
        self.ends_sentence = np.zeros(max(letters.values()) + 1, bool)
        for s, i in letters.items():
            s = s.removesuffix("</w>")
            self.ends_sentence[i] = bool(s) and not any(c.isalnum() for c in s) and bool(signs & set(s))

    def forget(self) -> None:
        """Known words; the tokens of word i are flat[first[i] : first[i] + n[i]]; which were met again."""
        self.known, self.flat = pa.array([], pa.large_string()), np.zeros(0, np.uint32)
        self.first, self.n, self.again = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def bound(self) -> None:
        """Beyond the bounds, words that were met again stay, if they fill no more than half of them."""
        if len(self.known) <= REMEMBERED and len(self.flat) <= REMEMBERED_TOKENS:
            return
        keep = np.flatnonzero(self.again)
        n = self.n[keep]
        if 2 * len(keep) > REMEMBERED or 2 * n.sum() > REMEMBERED_TOKENS:
            return self.forget()
        self.flat, self.known = self.flat[ranges(self.first[keep], n)], self.known.take(pa.array(keep))
        self.first, self.n, self.again = np.cumsum(n) - n, n, np.zeros(len(keep), bool)

    def encode(self, words: list[str]) -> list[list[int]]:
        out, odd = [], []
        for i, w in enumerate(words):
            if LETTERS.fullmatch(w):
                out.append([t.id for t in self.model.tokenize(w if w.isascii() else w.lower().translate(BYTES))])
            else:
                out.append([])
                odd.append(i)
        for i, e in zip(odd, self.whole.encode_batch_fast([words[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def of_words(self, words: pa.Array) -> np.ndarray:
        """Where the words stand among the known ones, to which new ones are added."""
        self.bound()
        at = pc.index_in(words, value_set=self.known)
        new = at.is_null()
        fresh = words.filter(new).dictionary_encode()
        new, at = new.to_numpy(zero_copy_only=False), pc.fill_null(at, 0).to_numpy().astype(np.int64)
        self.again[at[~new]] = True
        at[new] = len(self.known) + fresh.indices.to_numpy()
        ids = self.encode(fresh.dictionary.to_pylist())
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        self.known = pa.concat_arrays([self.known, fresh.dictionary])
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(n) - n])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum()))])
        self.n, self.again = np.concatenate([self.n, n]), np.concatenate([self.again, np.zeros(len(n), bool)])
        return at

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each text's end among them)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = pc.ascii_lower(texts)
        special = np.zeros(len(texts), bool)
        for s in self.added:
            special |= pc.match_substring(plain, s).to_numpy(zero_copy_only=False)
        if special.any():
            plain = pc.if_else(pa.array(special), "", plain)
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, LETTER_SIGN, r"\1 \2"))
        at = self.of_words(lists.flatten())
        n = self.n[at]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[ranges(self.first[at], n)]
        ends = before[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()]
        if special.any():
            parts = np.split(ids, ends[:-1])
            for i in np.flatnonzero(special):
                parts[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, ends


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def places(ids: np.ndarray, ends: np.ndarray, ends_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end, from 0 on, and what a cut costs there. ends: each document's end."""
    cost = np.zeros(len(ids) + 1, np.int8)
    cost[1 + np.flatnonzero(ends_sentence[ids])] = AT_SENTENCE
    cost[ends] = -1
    cost[0] = -1
    at = np.flatnonzero(cost)
    gap = np.diff(at)
    more = (gap - 1) // GRID
    k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    inner = np.repeat(at[:-1], more) + k * GRID
    cost[inner] = IN_SENTENCE
    at = np.flatnonzero(cost)
    return at, np.maximum(cost[at], 0)


def cuts(at: np.ndarray, cost: np.ndarray, size: int) -> list[int]:
    """The places of at, its last one included, where the cheapest windows end. at begins with 0 and has no gap over `size`."""
    n, powers = len(at), [1 << k for k in range(size.bit_length()) if 1 << k <= size]
    place = np.full(at[-1] + 1, -1, np.int32)
    place[at] = np.arange(n)
    ends, starts = [], []
    for w in powers:
        from_ = int(np.searchsorted(at, w))
        j = place[at[from_:] - w]
        hit = np.flatnonzero(j >= 0)
        ends.append(hit + from_)
        starts.append(j[hit])
    ends, starts = np.concatenate(ends), np.concatenate(starts)
    order = np.argsort(ends, kind="stable")
    starts, begin = starts[order].tolist(), np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    pos, cost = at.tolist(), cost.tolist()
    best, back, head = [0] * n, [0] * n, 0
    keys, queue = [0], [0]  # best + place, and index, of the candidates from head on, best first
    for i in range(1, n):
        p = pos[i]
        least = p - size
        while pos[queue[head]] < least:
            head += 1
        j, low = queue[head], keys[head] - least
        for k in starts[begin[i] : begin[i + 1]]:
            if best[k] < low:
                low, j = best[k], k
        low += cost[i]
        best[i], back[i] = low, j
        key = low + p
        while len(keys) > head and keys[-1] > key:
            keys.pop()
            queue.pop()
        keys.append(key)
        queue.append(i)
    out, i = [], n - 1
    while i:
        out.append(pos[i])
        i = back[i]
    return out[::-1]


def windows(ids: np.ndarray, ends: np.ndarray, ends_sentence: np.ndarray, size: int) -> np.ndarray:
    """Ends of the windows over a block; stretches of BLOCK tokens are solved one after another."""
    at, cost = places(ids, ends, ends_sentence)
    out, a = [], 0
    while a < len(at) - 1:
        b = len(at) - 1 if at[-1] - at[a] < 2 * BLOCK else int(np.searchsorted(at, at[a] + BLOCK, "right")) - 1
        out += [x + int(at[a]) for x in cuts(at[a : b + 1] - at[a], cost[a : b + 1], size)]
        a = b
    return np.array(out, np.int64)


def pieces(doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray, cut: np.ndarray, sequence: int) -> pa.RecordBatch:
    """A row for each run of one document in one window; sequence: number of the first window."""
    stops = np.union1d(ends, cut)
    starts = np.concatenate([[0], stops[:-1]])
    doc, window = np.searchsorted(ends, starts, "right"), np.searchsorted(cut, starts, "right")
    doc_start, first = np.concatenate([[0], ends[:-1]]), np.concatenate([[0], cut[:-1]])
    raw = np.ascontiguousarray(ids, "<u4")
    binary = pa.Array.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(np.concatenate([[0], stops * 4]).astype("<i8")), pa.py_buffer(raw)])
    columns = [doc_ids.take(pa.array(doc)), starts - doc_start[doc], stops - starts, binary.cast(pa.binary()), (ends - doc_start)[doc], sequence + window, starts - first[window], (cut - first)[window]]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(np.int64)) for c in columns], names=names)


def packer(path: str, size: int, end: int):
    def run(batches):
        enc, sequence = encoder(path), TaskContext.get().partitionId() << 33
        held, n = [], 0

        def flush():
            nonlocal sequence, held, n
            ids = np.concatenate([x[1] for x in held])
            ends = np.cumsum(np.concatenate([x[2] for x in held]))
            cut = windows(ids, ends, enc.ends_sentence, size)
            out = pieces(pa.concat_arrays([x[0] for x in held]), ids, ends, cut, sequence)
            sequence += len(cut)
            held, n = [], 0
            return out

        for b in batches:
            if not b.num_rows:
                continue
            ids, ends = enc.texts(b.column(1))
            ids = np.insert(ids, ends, end).astype(np.uint32)
            held.append((b.column(0), ids, np.diff(ends, prepend=0) + 1))
            n += len(ids)
            if n >= BLOCK:
                yield flush()
        if held:
            yield flush()

    return run


def pack_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """PIECES: a row for each piece of a document in a sequence; ids are little-endian unsigned 32-bit.

    sequence_id numbers the sequences within a partition, as monotonically increasing ids do.
    """
    assert size >= GRID
    d = bound_batches(docs).select(integer_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(packer(tokenizer or default_tokenizer(), size, end), PIECES)


def packing_report(docs: DataFrame) -> DataFrame:
    p = pack_windows(docs)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")
