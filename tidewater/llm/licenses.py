"""License scans by a trained paragraph classifier.

A sparse multinomial logistic regression over word 1- to 3-grams, trained here on license statements and
variations of them, names the licence family of a paragraph.  A cut on the winning probability, set on
held-out variations and on held-out paragraphs without a license, sends doubtful ones to `unknown`; a prediction
is confirmed only if enough of some template of its family is found in order (longest common subsequence of words).

Paragraphs are lines, and blocks of several lines between blank lines as well, so that wrapped notices count as
one; a block is reported for a family that none of its lines shows, in place of its `unknown` lines.  Skipped unseen is
only what cannot be confirmed for any family, as it holds too few words of every template, and has no sign of a
license either: neither a cue nor, for two words and half of all at least, words of licenses' names that each alone speak for one.  Without such a sign nothing
is `unknown`.  One pass of an automaton over the text finds the lines that can pass this test: of every template it knows
so many words that no paragraph without one of them reaches its share.  n_paragraphs counts lines.  Null and empty texts: no paragraph.  Repeated rows: one result row each.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

# Statements by which public licences are usually declared.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license", "apache license version 2.0 january 2004", "spdx license identifier apache 2.0"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "licensed under the mit license", "spdx license identifier mit"],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3", "gnu general public license version 3 29 june 2007", "spdx license identifier gpl 3.0"],
    "gpl-2.0": ["this work is licensed under the gnu general public license version 2", "this program is free software you can redistribute it under the terms of the gnu general public license version 2", "spdx license identifier gpl 2.0"],
    "lgpl": ["licensed under the gnu lesser general public license", "this library is free software under the terms of the gnu lesser general public license version 2.1", "spdx license identifier lgpl 2.1"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted", "released under the bsd 3 clause license", "licensed under the bsd license", "spdx license identifier bsd 3 clause"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license version 2.0", "licensed under the mozilla public license version 2.0", "spdx license identifier mpl 2.0"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc0": ["released under cc0 1.0", "to the extent possible under law the author has waived all copyright and related rights to this work", "dedicated to the public domain under cc0 1.0 universal"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "licensed under the isc license"],
    "proprietary": ["all rights reserved", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential", "copyright all rights reserved no part may be reproduced without permission"],
}
NONE, UNKNOWN = "none", "unknown"
FAMILIES = [NONE, *sorted(TEMPLATES)]
CUE = re.compile(r"licen[sc]|copyright|warrant|permi(?:ssion|tted)|rights|public domain|creative commons|spdx|redistribut|\bcc[ -]?(?:by|0)|proprietary|free software", re.I)
DIM = 1 << 13
EXAMPLES = 60  # variations of each family, and 8 times as many without a license: the bound of the fit
SHARE = 0.6  # of a template's words, in order
_TOKEN = re.compile(r"[a-z0-9.]*[a-z0-9]", re.I)
_PLAIN = "the of and to in is that for it with as was on be at by this have from or one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know get through back much before go good new write our used me man too any day same right look think also around another came come work three word must because does part even place well such here take why things help put years different away again off went old number great tell men say small every found still between name should home big give air line set own under read last never us left end along while might next sound below saw something thought both few those always show large often together asked house don world going want school important until form food keep children feet land side without boy once animal life enough took four head above kind began almost live page got earth need far hand high year mother light country father let night picture being study second soon story since white ever paper hard near sentence better best across during today however sure knew try told young sun thing whole hear example heard several change answer room sea against top turned learn point city play toward five himself usually money seen car morning permission license copyright reserved version software".split()

_MENTIONS = "rights permission permitted license licensed copyright warranty public free terms source reserved law author".split()


def words(text: str) -> list[str]:
    return [w.lower() for w in _TOKEN.findall(text.replace("-", " "))]


def features(ws: list[str]) -> np.ndarray:
    """Slots of the distinct word 1- to 3-grams."""
    grams = {" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)}
    return np.fromiter({xxhash.xxh32_intdigest(g) % DIM for g in grams}, np.int64)


def variations(seed: int, each: int) -> list[tuple[list[str], int]]:
    """Labelled paragraphs: templates with words left out and other words around, and paragraphs of plain words."""
    r = np.random.default_rng(seed)
    out = []
    noise = lambda k: list(r.choice(_PLAIN, k))
    for y, f in enumerate(FAMILIES):
        if f == NONE:  # half of them with words that licenses use too
            for i in range(8 * each):
                ws = noise(r.integers(1, 40))
                for _ in range(r.integers(1, 3) if i % 2 and len(ws) > 3 else 0):
                    ws.insert(r.integers(0, len(ws)), str(r.choice(_MENTIONS)))
                out.append((ws, y))
            continue
        for i in range(each):
            t = words(TEMPLATES[f][i % len(TEMPLATES[f])])
            kept = [w for w in t if r.random() > 0.04] or t
            out.append((noise(r.integers(0, 4)) * (r.random() < 0.5) + kept + noise(r.integers(0, 12)) * (r.random() < 0.5), y))
    return out


@lru_cache(1)
def trained(each: int = EXAMPLES, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights DIM x families, bias, cut)."""
    data = [(features(w), y) for w, y in variations(seed, each)]
    r = np.random.default_rng(seed)
    w, b = np.zeros((DIM, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    g2 = np.full(DIM, 1e-6, np.float32)
    for _ in range(6):
        for i in r.permutation(len(data)):
            x, y = data[i]
            p = softmax(w[x].sum(0) + b)
            p[y] -= 1
            g2[x] += (p * p).sum()
            w[x] -= 0.3 * p / np.sqrt(g2[x])[:, None]
            b -= 0.01 * p
    held = [(softmax(w[features(ws)].sum(0) + b), y) for ws, y in variations(seed + 1, each // 2)]
    wrong = [p.max() for p, y in held if p.argmax() != y or y == 0 and p.argmax()]
    right = sorted(p.max() for p, y in held if p.argmax() == y and y)
    cut = max(min(right[len(right) // 50], 0.9), min(max(wrong, default=0.5), 0.6), 0.5)
    return w, b, float(cut)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def in_order(template: list[str], ws: list[str]) -> float:
    """Longest common subsequence of words over the template's length."""
    row = np.zeros(len(ws) + 1, np.int64)
    for t in template:
        hit = row[:-1] + np.array([w == t for w in ws], np.int64)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], hit))
    return row[-1] / len(template)


_SPLIT = {f: [words(t) for t in ts] for f, ts in TEMPLATES.items()}


_COUNTS = [Counter(t) for ts in _SPLIT.values() for t in ts]
_HOLDS: dict[str, list[tuple[int, int]]] = {}  # word -> (template, how often)
for _i, _c in enumerate(_COUNTS):
    for _w, _n in _c.items():
        _HOLDS.setdefault(_w, []).append((_i, _n))
_NEED = [SHARE * c.total() for c in _COUNTS]
_WORDS = frozenset(_HOLDS)


def within_reach(held: set[str]) -> bool:
    """Whether these words can be SHARE of some template in order: no family is confirmed without."""
    sums = [0] * len(_NEED)
    for w in held:
        for i, n in _HOLDS[w]:
            sums[i] += n
    return any(a >= n - 1e-9 for a, n in zip(sums, _NEED))


@lru_cache(1)
def telling() -> frozenset[str]:
    """Words of licenses' names, not of plain paragraphs, that alone speak more for some license than for none."""
    w, b, _ = trained()
    names = {"gnu", "mozilla", *(x for f in TEMPLATES for x in words(f)), *(x for ts in _SPLIT.values() for t in ts if t[0] == "spdx" for x in t[3:])}
    return frozenset(t for t in names.difference(_PLAIN) if softmax(w[features([t])].sum(0) + b)[0] < 0.5)


def needed_words() -> set[str]:
    """Words one of which stands in every paragraph that is within reach: of each template the longest of its words, until the others are too few."""
    out: set[str] = set()
    for c, need in zip(_COUNTS, _NEED):
        rest = c.total()
        for w in sorted(c, key=lambda w: (w in _PLAIN, -len(w), w)):
            if rest < need - 1e-9:
                break
            out.add(w)
            rest -= c[w]
    return out


# What every match of CUE holds, lower-cased, other signs than letters, digits and points as spaces.
CUE_PARTS = ["licens", "licenc", "copyright", "warrant", "permission", "permitted", "rights", "public domain", "creative commons", "spdx", "redistribut", " ccby", " cc by", " cc0", " cc 0", "proprietary", "free software"]
_PLAINLY = bytes(c if chr(c).islower() or chr(c).isdigit() or c in b".\n" else c + 32 if 65 <= c <= 90 else 32 for c in range(128)) + b" " * 128


@lru_cache(1)
def gate() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for w in {*needed_words(), *telling()}:
        for end in (" ", "."):  # whole words
            found.add_word(f" {w}{end}")
    for w in CUE_PARTS:
        found.add_word(w)
    found.make_automaton()
    return found


def lines_to_see(text: str) -> set[int] | None:
    """Numbers of the lines that can hold a license; None: all."""
    if "\u017f" in text or "\u212a" in text:  # letters that stand for s and k where case doesn't count
        return None
    plain = text.encode("utf-8", "surrogatepass").translate(_PLAINLY).decode("ascii")
    plain = " " + plain.replace("\n", " \n ") + " "
    out, line, last, end = set(), 0, 0, -1
    for at, _ in gate().iter(plain):
        if at > end:
            line += plain.count("\n", last, at)
            out.add(line)
            last, end = at, plain.find("\n", at)
            if end < 0:
                break
    return out


def classify(model, paragraph: str) -> tuple[str, float]:
    """(family, probability): NONE, a family, or UNKNOWN."""
    w, b, cut = model
    ws = words(paragraph)
    held = _WORDS.intersection(ws)
    told = bool(ws) and (2 * sum(x in telling() for x in ws) >= max(4, len(ws)) or CUE.search(paragraph) is not None)
    if not told and not within_reach(held):
        return NONE, 1.0
    p = softmax(w[features(ws)].sum(0) + b)
    y = int(p.argmax())
    if y == 0 and p[0] >= cut:
        return NONE, float(p[0])
    if y and p[y] >= cut and max(in_order(t, ws) for t in _SPLIT[FAMILIES[y]]) >= SHARE:
        return FAMILIES[y], float(p[y])
    return (UNKNOWN if told else NONE), float(p[y])


def hits_of(model, text: str, known: dict) -> tuple[int, list[dict]]:
    """(number of lines with text, hits in order)."""
    seen = lines_to_see(text)
    if seen is not None and not seen:
        return sum(bool(line.strip()) for line in text.split("\n")), []
    at, n, hits, block = 0, 0, [], []

    def one(paragraph: str, start: int, end: int) -> dict | None:
        if paragraph not in known:
            if len(known) > 50_000:
                known.clear()
            known[paragraph] = classify(model, paragraph)
        family, score = known[paragraph]
        return None if family == NONE else {"family": family, "start": start, "end": end, "score": round(score, 6)}

    def close():
        near = [(s, e) for s, e, to_see in block if to_see]
        found = [h for s, e in near if (h := one(text[s:e], s, e))]
        if len(block) > 1 and near:
            s, e = block[0][0], block[-1][1]
            family, score = classify(model, text[s:e])
            if family not in (NONE, UNKNOWN) and family not in {h["family"] for h in found}:
                found = [h for h in found if h["family"] != UNKNOWN] + [{"family": family, "start": s, "end": e, "score": round(score, 6)}]
        hits.extend(sorted(found, key=lambda h: h["start"]))
        block.clear()

    for i, line in enumerate(text.split("\n")):
        if line.strip():
            n += 1
            block.append((at, at + len(line), seen is None or i in seen))
        else:
            close()
        at += len(line) + 1
    close()
    return n, hits


FOUND = "struct<n_paragraphs:bigint,hits:array<struct<family:string,start:int,end:int,score:double>>>"


def finder(held):
    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        known: dict = {}
        return pd.DataFrame([hits_of(held.value, text or "", known) for text in texts], columns=["n_paragraphs", "hits"])

    return find


def scan_licenses(docs: DataFrame, text_col: str = "text", column: str = "licenses") -> DataFrame:
    return bound_batches(docs).withColumn(column, finder(docs.sparkSession.sparkContext.broadcast(trained()))(F.col(text_col)))


def license_report(docs: DataFrame) -> DataFrame:
    d = scan_licenses(docs.select("doc_id", "text")).drop("text")
    h = F.col("licenses.hits")
    family = F.array_join(F.array_sort(F.array_distinct(F.transform(h, lambda x: x["family"]))), ",")
    spans = F.array_join(F.transform(h, lambda x: F.concat_ws(":", x["family"], x["start"], x["end"])), ",")
    return d.select("doc_id", "licenses.n_paragraphs", F.size(h).cast("long").alias("n_licenses"), family.alias("families"), spans.alias("spans"))
