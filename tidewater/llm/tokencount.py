"""Token counts by section, from one encoding of each whole text.

A byte-pair tokenizer encodes the text once; its tokens' byte offsets are joined with the byte spans of the
sections (fields or paragraphs), both sorted, and a token that crosses a boundary goes, by an explicit
rule, to the section of its first byte (`start`), of its last byte (`end`) or of most of its bytes
(`most`, the first of equals).  So the sections' counts add up to the text's.

Sections of a text are its paragraphs: a line with its line break, and the empty lines after it.
Several fields are encoded as one text, joined by line breaks.  Null text or field: empty, no token.  Repeated rows: one result row each.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Where the tokenizer's files are; the same folder on every executor, or a file added with addFile.
TOKENIZERS = os.environ.get("TIDEWATER_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "end", "most")
SECTION = re.compile(rb"[^\n]*\n+|[^\n]+\Z")


@lru_cache(4)
def encoding(folder: str, name: str):
    """(encoding, bytes of each token)."""
    import tiktoken

    path = os.path.join(folder, name)
    if not os.path.exists(path):
        path = SparkFiles.get(name)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def allocate(ends: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section. ends: each token's end byte; starts: each section's first byte, from 0 on."""
    if not len(starts):
        return np.zeros(0, np.int64)
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    if rule == "start":
        to = first
    elif rule == "end":
        to = last
    else:
        to = first.copy()
        for i in np.flatnonzero(first != last):
            cuts = np.concatenate([[begins[i]], starts[first[i] + 1 : last[i] + 1], [ends[i]]])
            to[i] = first[i] + int(np.diff(cuts).argmax())
    return np.bincount(to, minlength=len(starts))


def counts(text: str | None, enc, size: np.ndarray, rule: str) -> tuple[int, int, np.ndarray]:
    """(tokens, tokens that cross a boundary, tokens per section)."""
    raw = (text or "").encode("utf-8", "replace")
    ids = np.asarray(enc.encode_ordinary(text or ""), np.int64)
    ends = np.cumsum(size[ids])
    assert (int(ends[-1]) if len(ends) else 0) == len(raw), "tokens don't add up to the text"
    starts = np.fromiter((m.start() for m in SECTION.finditer(raw)), np.int64)
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    cross = int((np.searchsorted(starts, begins, "right") != np.searchsorted(starts, ends - 1, "right")).sum())
    return len(ids), cross, allocate(ends, starts, rule)


def counter(folder: str, name: str, rule: str):
    assert rule in RULES

    @F.pandas_udf("struct<n_tokens:bigint,n_crossing:bigint,section_tokens:array<bigint>>")
    def count(texts: pd.Series) -> pd.DataFrame:
        enc, size = encoding(folder, name)
        return pd.DataFrame([counts(t, enc, size, rule) for t in texts], columns=["n_tokens", "n_crossing", "section_tokens"])

    return count


def token_counts(text: Column, folder: str = TOKENIZERS, name: str = NAME, rule: str = "start") -> Column:
    return counter(folder, name, rule)(text)


def token_report(docs: DataFrame) -> DataFrame:
    d = bound_batches(docs).select("doc_id", token_counts(F.col("text")).alias("t"))
    return d.select("doc_id", "t.n_tokens", F.size("t.section_tokens").cast("long").alias("n_sections"), "t.n_crossing", F.array_join(F.col("t.section_tokens").cast("array<string>"), ",").alias("section_tokens"))
