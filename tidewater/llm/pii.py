"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The tagger is trained in numpy from labelled spans that `labelled` makes by rule: written-out
addresses, phone numbers without a country code and the like, among plain words and look-alikes (dates,
prices, versions).  It reads overlapping windows; their scores are averaged, weighted towards each
window's middle, over the whole stretch of text, and one Viterbi pass over the stretch decides all
spans of it together.  Windows are laid wherever the text holds a character or cue that every labelled
span holds (a digit, '@', or a written '@'); elsewhere the tagger's answer is `no span` by construction.

Base spans always stay; the tagger adds spans that overlap none and pass the kind's plain check.
Null text counts as empty, an empty table gives no rows, columns of the input stay as they are.  Repeated rows: one result row each.  Offsets count code points, end exclusive.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9]|@|[\[({] ?at ?[\])}]|\bdot\b", re.I)
_PART, _DOT = r"[\w%+-]+", r"\s?(?:\.|[\[({] ?(?:dot|\.) ?[\])}]|\bdot\b)\s?"
WRITTEN = re.compile(rf"{_PART}(?:{_DOT}{_PART})*\s?(?:@|[\[({{] ?at ?[\])}}]|\bat\b)\s?{_PART}(?:{_DOT}{_PART})+", re.I)

TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
HIDDEN = 20
WIN, STRIDE = 64, 32
TRAIN = 2400  # labelled texts, the bound of what the tagger is fitted on
EPOCHS = 10
_CHARS = "etaoinsrhldcumfpgwybvkxjqz"


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    out, last = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > last and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                last = m.end()
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# --- the tagger -----------------------------------------------------------------------------------------


def symbol(text: str) -> np.ndarray:
    """Character classes: letters apart, all digits one, common marks apart, any other letter or sign one."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32) if len(text.lower()) == len(text) else np.array([ord(c) for c in text], np.uint32)
    return _TABLE[np.minimum(a, 128)]


_TABLE = np.full(129, 40, np.int64)
for _i, _c in enumerate(_CHARS):
    _TABLE[ord(_c)] = _i
for _c in "0123456789":
    _TABLE[ord(_c)] = 26
for _i, _c in enumerate(" .@-()[]{}+:,/"):
    _TABLE[ord(_c)] = 27 + min(_i, 12)
_TABLE[10] = 27
SYMBOLS = 41
_ONE = np.eye(SYMBOLS, dtype=np.float32)


def labelled(n: int, seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with labelled spans (kind, start, end), made by rule."""
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list(_CHARS[:16]), r.integers(2, 9)))
    num = lambda k: "".join(map(str, r.integers(0, 10, k)))
    pick = lambda *x: x[r.integers(len(x))]

    def email():
        at = pick(" (at) ", " [at] ", "(at)", "[at]", " {at} ", "@", " at ", " at ", " at ")
        # with a plain '@' or 'at', only a written dot tells an address from a base span or from prose
        dot = pick(" dot ", "[dot]", " [dot] ", "(dot)", " (dot) ") if at in ("@", " at ") else pick(" dot ", "[dot]", " [dot] ", "(dot)", " (dot) ", ".", ".")
        local = word() + pick("", ".", "_", " dot " if "dot " in dot else ".") + pick(word(), word(), num(2))
        return pick(local, local, word()) + at + word() + pick("", "", "", "-" + word(), dot + word()) + dot + pick("com", "org", "net", "io", "de", "edu", "co.uk")

    def card():
        digits = pick("4", "5", "6", "37") + num(pick(13, 14, 14, 14))
        digits += next(x for x in "0123456789" if luhn(digits + x))
        sign = pick(".", "/", "_", "  ", " . ")
        cuts = (0, 4, 10, 16) if len(digits) == 15 else (0, 4, 8, 12, 17)
        return sign.join(digits[a:b] for a, b in zip(cuts, cuts[1:]) if digits[a:b])

    makers = [
        (0, email),
        (1, lambda: pick("[.]", "(.)", " dot ", "[dot]").join(str(r.integers(0, 256)) for _ in range(4))),
        (2, card),
        (3, lambda: pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"00{num(2)} {num(3)} {num(7)}")),
    ]
    plain = [
        lambda: f"{r.integers(1900, 2030)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}", lambda: num(r.integers(1, 7)), lambda: f"{num(2)}:{num(2)}",
        lambda: f"{num(1)}.{num(1)}.{num(2)}", lambda: f"{num(3)},{num(3)}", lambda: f"({num(4)})", lambda: "the dot", lambda: f"v{num(1)}.{num(1)}", lambda: num(r.integers(12, 40)), lambda: "@" + word(),
        lambda: f"{num(3)}-{num(2)}-{num(4)}", lambda: f"{num(r.integers(3, 5))}-{num(r.integers(5, 8))}", lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"{num(2)}.{num(2)}.{num(4)}",
        lambda: f"{word()} at {word()}", lambda: f"at the dot {word()}", lambda: f"{word()} dot {word()}",
        lambda: "".join(r.choice(list("0123456789abcdef"), 40)),
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.integers(3, 9)):
            u = r.random()
            if u < 0.22:
                kind, make = makers[max(0, r.integers(-1, 4))]
                piece = make()
                spans.append((kind, len(text), len(text) + len(piece)))
            elif u < 0.5:
                piece = plain[r.integers(len(plain))]()
            else:
                piece = pick(word(), word(), pick("to", "by", "at", "from", "is", "and", "the", "write to", "sent from"))
            text += piece + pick(" ", " ", " ", ", ", ". ", "\n")
        out.append((text, spans))
    return out


def _sig(x):
    return 1 / (1 + np.exp(-x))


def lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool = False):
    """x (T, N) symbols -> h (T, N, H); with keep also what the backward pass needs."""
    steps, n = x.shape
    h = np.zeros((n, HIDDEN), np.float32)
    c = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((steps, n, HIDDEN), np.float32)
    kept = []
    for t in range(steps):
        z = wx[x[t]] + h @ wh + b
        s = _sig(z[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        c2 = f * c + i * g
        tc = np.tanh(c2)
        if keep:
            kept.append((h, c, i, f, o, g, tc))
        h, c = o * tc, c2
        out[t] = h
    return (out, kept) if keep else out


def lstm_back(x, wx, wh, dh_out, kept, gwx, gwh, gb) -> None:
    dh = np.zeros_like(dh_out[0])
    dc = np.zeros_like(dh)
    for t in range(len(x) - 1, -1, -1):
        h0, c0, i, f, o, g, tc = kept[t]
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        gwx += _ONE[x[t]].T @ dz
        gwh += h0.T @ dz
        gb += dz.sum(0)
        dh, dc = dz @ wh.T, dc * f


def emissions(p: dict, x: np.ndarray) -> np.ndarray:
    """x (T, N) -> scores (T, N, TAGS)."""
    fw = lstm(x, p["fx"], p["fh"], p["fb"])
    bw = lstm(x[::-1], p["bx"], p["bh"], p["bb"])[::-1]
    return np.concatenate([fw, bw], 2) @ p["w"] + p["b"]


def allowed() -> np.ndarray:
    """CRF transitions that spans permit: an inside tag follows its own begin or inside."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


def _lse(a, axis):
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


def crf_grad(e: np.ndarray, y: np.ndarray, trans: np.ndarray):
    """Gradient of minus log likelihood by e (T, N, K) and trans, from forward and backward sums."""
    steps, n, k = e.shape
    a = np.empty_like(e)
    a[0] = e[0]
    for t in range(1, steps):
        a[t] = e[t] + _lse(a[t - 1][:, :, None] + trans, 1)
    z = _lse(a[-1], 1)
    b = np.zeros((n, k), np.float32)
    ge, gt = np.empty_like(e), np.zeros_like(trans)
    rows = np.arange(n)
    for t in range(steps - 1, -1, -1):
        ge[t] = np.exp(a[t] + b - z[:, None])
        ge[t][rows, y[t]] -= 1
        if t:
            right = e[t] + b
            pair = np.exp(a[t - 1][:, :, None] + trans + right[:, None, :] - z[:, None, None])
            gt += pair.sum(0)
            np.add.at(gt, (y[t - 1], y[t]), -1)
            b = _lse(trans[None] + right[:, None, :], 2)
    return ge, gt


def windows_of(texts) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for text, spans in texts:
        s = symbol(text)
        y = np.zeros(len(s), np.int64)
        for kind, a, b in spans:
            y[a], y[a + 1 : b] = 1 + 2 * kind, 2 + 2 * kind
        for at in range(0, max(1, len(s) - STRIDE), STRIDE):
            x1, y1 = np.full(WIN, 27), np.zeros(WIN, np.int64)
            x1[: len(s[at : at + WIN])], y1[: len(s[at : at + WIN])] = s[at : at + WIN], y[at : at + WIN]
            xs.append(x1)
            ys.append(y1)
    return np.array(xs).T, np.array(ys).T


@lru_cache(1)
def trained(n: int = TRAIN, epochs: int = EPOCHS, seed: int = 5) -> dict:
    """Parameters after Adam over the labelled texts; the same for the same arguments."""
    r = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[d + "x"] = (r.standard_normal((SYMBOLS, 4 * HIDDEN)) * 0.3).astype(np.float32)
        p[d + "h"] = (r.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float32)
        p[d + "b"] = np.zeros(4 * HIDDEN, np.float32)
        p[d + "b"][HIDDEN : 2 * HIDDEN] = 1
    p["w"] = (r.standard_normal((2 * HIDDEN, TAGS)) * 0.3).astype(np.float32)
    p["b"] = np.zeros(TAGS, np.float32)
    p["b"][0] = 1
    p["t"] = np.zeros((TAGS, TAGS), np.float32)
    never = ~allowed()
    x, y = windows_of(labelled(n))
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    step, size = 0, 64
    for epoch in range(epochs):
        order = r.permutation(x.shape[1])
        for at in range(0, len(order) - size // 2, size):
            xb, yb = x[:, order[at : at + size]], y[:, order[at : at + size]]
            fw, fk = lstm(xb, p["fx"], p["fh"], p["fb"], True)
            bw, bk = lstm(xb[::-1], p["bx"], p["bh"], p["bb"], True)
            both = np.concatenate([fw, bw[::-1]], 2)
            trans = np.where(never, np.float32(-1e4), p["t"])
            ge, gt = crf_grad(both @ p["w"] + p["b"], yb, trans)
            n_b = xb.shape[1]
            g = {k: np.zeros_like(v) for k, v in p.items()}
            g["w"], g["b"], g["t"] = np.einsum("tnh,tnk->hk", both, ge), ge.sum((0, 1)), np.where(never, 0, gt)
            dh = ge @ p["w"].T
            lstm_back(xb, p["fx"], p["fh"], dh[:, :, :HIDDEN], fk, g["fx"], g["fh"], g["fb"])
            lstm_back(xb[::-1], p["bx"], p["bh"], dh[::-1, :, HIDDEN:], bk, g["bx"], g["bh"], g["bb"])
            step += 1
            rate = 0.02 * (1 - 0.8 * epoch / epochs)
            for k in p:
                d = g[k] / n_b
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.99 * m2[k] + 0.01 * d * d
                p[k] = (p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    p["t"] = np.where(never, np.float32(-1e4), p["t"])
    return p


def stretches(text: str) -> list[tuple[int, int]]:
    """Where windows are laid: half a window to both sides of every trigger, neighbours merged."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - STRIDE), min(len(text), m.end() + STRIDE)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    back = np.empty((len(e), TAGS), np.int8)
    v = e[0].copy()
    v[2::2] = -1e4  # no span begins inside
    for t in range(1, len(e)):
        m = v[:, None] + trans
        back[t] = m.argmax(0)
        v = m.max(0) + e[t]
    tags = np.empty(len(e), np.int64)
    tags[-1] = v.argmax()
    for t in range(len(e) - 1, 0, -1):
        tags[t - 1] = back[t][tags[t]]
    return tags


def tag(p: dict, texts: list[str], batch: int = 512) -> list[list[tuple[int, int, int]]]:
    """Spans (kind, start, end) of each text as the tagger alone sees them."""
    jobs = [(n, a, b) for n, t in enumerate(texts) for a, b in stretches(t)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    weight = (np.minimum(np.arange(WIN) + 1, WIN - np.arange(WIN)) / (WIN / 2)).astype(np.float32)[:, None]
    at = 0
    while at < len(jobs):
        part, windows = [], []  # stretches of a batch, and their windows
        while at < len(jobs) and (not part or len(windows) < batch):
            n, a, b = jobs[at]
            s = symbol(texts[n][a:b])
            first = len(windows)
            for w in range(0, max(1, len(s) - STRIDE), STRIDE):
                x = np.full(WIN, 27)
                x[: len(s[w : w + WIN])] = s[w : w + WIN]
                windows.append(x)
            part.append((n, a, len(s), first, len(windows)))
            at += 1
        x = np.array(windows).T
        e = np.concatenate([emissions(p, x[:, i : i + batch]) for i in range(0, x.shape[1], batch)], 1)
        for n, a, size, first, last in part:
            total = np.zeros((size + WIN, TAGS), np.float32)
            mass = np.zeros((size + WIN, 1), np.float32)
            for i, w in enumerate(range(first, last)):
                total[i * STRIDE : i * STRIDE + WIN] += e[:, w] * weight
                mass[i * STRIDE : i * STRIDE + WIN] += weight
            tags = viterbi(total[:size] / mass[:size], p["t"])
            begin = np.flatnonzero(tags % 2 == 1)
            for s0 in begin:
                kind, s1 = (tags[s0] - 1) // 2, s0 + 1
                while s1 < size and tags[s1] == tags[s0] + 1:
                    s1 += 1
                out[n].append((int(kind), a + int(s0), a + int(s1)))
    return out


def plausible(kind: int, piece: str) -> bool:
    digits = sum(c.isdigit() for c in piece)
    if kind == 0:
        return bool(WRITTEN.fullmatch(piece))
    if kind == 1:
        parts = re.findall("[0-9]+", piece)
        return len(parts) == 4 and all(int(x[:4]) <= 255 and len(x) <= 3 for x in parts)
    if kind == 2:
        return 13 <= digits <= 19 and luhn("".join(c for c in piece if c.isdigit()))
    return 7 <= digits <= 15 and bool(re.fullmatch(r"[0-9(][0-9 ().-]*[0-9]", piece)) and not piece.isdigit()


def whole(kind: int, text: str, a: int, b: int) -> tuple[int, int]:
    """The span without white space at its ends, and with the rest of a word or number that it cuts."""
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    inside = (lambda c: c.isalnum() or c in "_%+-") if kind == 0 else str.isdigit
    before = (lambda c: inside(c) or c == ".") if kind == 0 else inside
    reach = 64  # no part of a name or number is longer
    while a > 0 and reach and a < b and before(text[a]) and before(text[a - 1]):
        a, reach = a - 1, reach - 1
    while b < len(text) and reach and a < b and inside(text[b - 1]) and inside(text[b]):
        b, reach = b + 1, reach - 1
    if kind == 0 and (m := WRITTEN.search(text, a, b)):  # words before or after the address aren't part of it
        a, b = m.span()
    return a, b


def find_all(p: dict, texts: list[str]) -> list[tuple[list, list]]:
    """(base, added) of each text."""
    out = []
    for text, more in zip(texts, tag(p, texts)):
        base = base_spans(text)
        near = sorted((a, b) for _, a, b in base)
        added = []
        for kind, a, b in more:
            a, b = whole(kind, text, a, b)
            if plausible(kind, text[a:b]) and not any(s < b and a < e for s, e in near):
                added.append((kind, a, b))
        out.append((base, added))
    return out


FOUND = "struct<base:array<struct<kind:int,start:int,end:int>>,added:array<struct<kind:int,start:int,end:int>>>"


def finder(held):
    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        rows = []
        for at in range(0, len(texts), 1000):
            some = [t or "" for t in texts.iloc[at : at + 1000]]
            rows += [(as_rows(b), as_rows(m)) for b, m in find_all(held.value, some)]
        return pd.DataFrame(rows, columns=["base", "added"])

    return find


def with_spans(docs: DataFrame, column: str = "pii", text_col: str = "text") -> DataFrame:
    """docs and a column of base and added spans."""
    return bound_batches(docs).withColumn(column, finder(docs.sparkSession.sparkContext.broadcast(trained()))(F.col(text_col)))


def pii_report(docs: DataFrame) -> DataFrame:
    name = F.array(*map(F.lit, KINDS))
    written = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"])), ",")
    base, every = F.array_sort("pii.base"), F.array_sort(F.concat("pii.base", "pii.added"))
    count = lambda i: F.size(F.filter("pii.base", lambda x: x["kind"] == i)).cast("long")
    d = with_spans(docs.select("doc_id", "text")).drop("text")
    return d.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(written(base), 256).alias("base_sha256"), written(every).alias("spans"))


def redactor(held):
    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), 1000):
            some = list(texts.iloc[at : at + 1000])
            for text, (base, more) in zip(some, find_all(held.value, [t or "" for t in some])):
                last, parts = 0, []
                for a, b, kind in sorted((a, b, k) for k, a, b in base + more):
                    if b <= last:
                        continue
                    if a >= last:
                        parts += [text[last:a], f"<{KINDS[kind]}>"]
                    last = b
                out.append(text if not parts else "".join(parts) + text[last:])
        return pd.Series(out, dtype=object)

    return redact


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input rows with every span replaced by its kind; n_chars, if there, follows."""
    held = docs.sparkSession.sparkContext.broadcast(trained())
    out = bound_batches(docs).withColumn(text_col, redactor(held)(F.col(text_col)))
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
