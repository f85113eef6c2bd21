"""Packing, conversation repair and hard negatives against brute force, with nulls, ties, repeats and long rows."""

import collections
import math
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tidewater.llm import dialogue, negatives, packing


def table(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# packing

ODD = ["", None, "   ", "Hello, World! it's o'clock.It'S 'tis a.'s", "É é é Σ ΑΣ. İ ß", "x" * 5000, "a<|endoftext|>b <|STARTOFTEXT|> ok", "日本語。テキスト!!", "tab\tnew\r\nline\x0b\x0c 　  end?", "1234 5,6;7:8!?", "can't WON'T we'LL", "\x00\x01 z"]


def test_encoder_is_the_tokenizer():
    r = random.Random(1)
    letters = "abcXYZ éÉ.,!?;:'<|> \t\n12日́"
    texts = ODD + ["".join(r.choice(letters) for _ in range(r.randint(0, 120))) for _ in range(300)]
    enc = packing.encoder(packing.default_tokenizer())
    ids, ends = enc.texts(pa.array(texts, pa.string()))
    assert [p.tolist() for p in np.split(ids, ends[:-1])] == [enc.whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def as_tokenized(enc, texts):
    ids, ends = enc.texts(pa.array(texts, pa.string()))
    return [p.tolist() for p in np.split(ids, ends[:-1])] == [enc.whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_added_tokens_in_another_case():
    assert all(as_tokenized(packing.Encoder(packing.default_tokenizer()), [t, "ok"]) for t in ("<|STARTOFTEXT|>", "a <|EndOfText|>b", "x<|startoftext|>"))


def test_letters_skip_the_whole_tokenizer():
    enc, asked = packing.Encoder(packing.default_tokenizer()), []
    letters = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
    texts = ["tionété, Èonai. réré; elle*** ai%% a(b", " ".join(letters), letters, " ".join(f"a{s} é{s}{s}" for s in map(chr, range(0x21, 0x7F)) if not s.isalnum())]
    assert as_tokenized(enc, texts)

    class Counted:
        encode_batch_fast = staticmethod(lambda words, **k: asked.extend(words) or [])

    enc.whole = Counted
    enc.texts(pa.array(["eté, Éons. néné; elles*** air%% ab(b", "x" * 60 + " " + "é" * 60] + texts))
    assert asked == []


def test_words_met_again_stay_known(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    enc, r = packing.Encoder(packing.default_tokenizer()), random.Random(4)
    often = ["the", "été", "x1y", "it's"]
    for _ in range(30):
        assert as_tokenized(enc, [" ".join(often + ["".join(r.choice("abcdé7") for _ in range(6)) for _ in range(9)]) for _ in range(2)] + [None])
        assert len(enc.known) <= 40 + 24 and len(enc.known) == len(set(enc.known.to_pylist())) == len(enc.first) == len(enc.n) == len(enc.again)
        assert set(often) <= set(enc.known.to_pylist())


def test_cuts_are_the_cheapest():
    r = random.Random(2)
    for _ in range(60):
        at = np.cumsum([0] + [r.randint(1, 9) for _ in range(r.randint(1, 40))])
        cost, size = np.array([0] + [r.choice([0, 2, 8]) for _ in at[1:]]), 24
        best = [0] + [10**9] * (len(at) - 1)
        pad = lambda n: 0 if n & (n - 1) == 0 else size - n
        for i in range(1, len(at)):
            best[i] = min(best[j] + pad(int(at[i] - at[j])) + int(cost[i]) for j in range(i) if at[i] - at[j] <= size)
        got = packing.cuts(at, cost, size)
        where = dict(zip(at.tolist(), cost.tolist()))
        assert got[-1] == at[-1] and sum(pad(b - a) + where[b] for a, b in zip([0, *got], got)) == best[-1]


def test_packing(spark):
    r = random.Random(3)
    texts = ODD + [" ".join(r.choice(["ab", "the", "zq.", "no!"]) for _ in range(r.choice([3, 50, 3000]))) for _ in range(40)] + ["word " * 1_200_000]
    rows = [(None if i == 5 else 7 if i in (8, 9) else i, t, "x", 1, "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids string, start int, offset string").repartition(3)
    got = packing.packing_report(df).collect()
    enc = packing.encoder(packing.default_tokenizer())
    whole = collections.defaultdict(list)
    for i, t, *_ in rows:
        whole[i].append(enc.whole.encode(t or "", add_special_tokens=False).ids + [2])
    of = collections.defaultdict(list)
    for x in got:
        of[x.doc_id].append(x)
    for i, docs in whole.items():
        if len(docs) == 1:
            parts = sorted(of[i], key=lambda x: x.start)
            assert [p.start for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1]] and {p.doc_tokens for p in parts} == {len(docs[0])} and sum(p.length for p in parts) == len(docs[0])
            assert all(p.ids_crc32 == zlib.crc32(np.array(docs[0][p.start : p.start + p.length], "<u4").tobytes()) for p in parts)
    assert sum(p.length for p in of[7]) == sum(map(len, whole[7]))
    sequences = collections.defaultdict(list)
    for x in got:
        sequences[x.sequence_id].append((x.offset, x.length))
    used = []
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1]]
        used.append(sum(n for _, n in s))
    assert max(used) <= 4096 and sum(0 if n & (n - 1) == 0 else 4096 - n for n in used) < 0.01 * sum(used)
    assert packing.packing_report(df.limit(0)).collect() == []


# conversations


def sql(query, **tables):
    db = duckdb.connect()
    for name, df in tables.items():
        db.register(name, df)
    return db.execute(query).df()


def cheapest(rows):
    """(cost, audit) by trying every edit list, cheapest first lists only."""
    best = {dialogue.START: (0, "")}
    grow = lambda b: [(q, c, a) for q, (c, a) in b.items()]

    def inserted(b):
        out = dict(b)
        for _ in range(3):
            for q, c, a in grow(out):
                to = dialogue.USER if q != dialogue.USER else dialogue.ASSISTANT
                out[to] = min(out.get(to, (10**9, "")), (c + 5, a + "I"))
        return out

    for role, fault in rows:
        new = {}
        for q, c, a in grow(inserted(best)):
            options = [(q, 2, "D")]
            if fault in (0, 3):
                more = 5 if fault == 3 else 0
                options.append((dialogue.USER if q != dialogue.USER else dialogue.ASSISTANT, 1 + more, "R"))
                if role in dialogue.NEXT[q]:
                    options.append((dialogue.NEXT[q][role], more, "K"))
            for to, cost, edit in options:
                new[to] = min(new.get(to, (10**9, "")), (c + cost, a + edit))
        best = new
    return min(inserted(best)[q] for q in dialogue.ACCEPTED if q in inserted(best))


def test_search_is_the_cheapest():
    r = random.Random(5)
    for _ in range(800):
        rows = [(r.choice(["s", "u", "a", "x", ""]), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(r.randint(0, 9))]
        assert dialogue.solve(rows, dialogue.START, dialogue.ACCEPTED) == [(dialogue.solve(rows, dialogue.START, dialogue.ACCEPTED)[0][0], *cheapest(rows))]


def conversations():
    r = random.Random(6)
    text = lambda: r.choice(["Yes.", "No", "  ", "", None, "What? ", "é!", "Long text. " * 3, f"t{r.random()}."])
    role = lambda: r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
    rows = [(c, t if r.random() < 0.9 else None, role(), text()) for c in range(60) for t in range(r.randint(0, 7))]
    rows += [(None, t, role(), text()) for t in range(9)] + [(70, 5, "user", "same.")] * 40 + [(71, t, "user", "same.") for t in range(300)]
    rows += [(72, r.choice([None, t, t // 2]), role(), f"row {t}" + r.choice([".", "", "!"])) for t in range(1500)]
    rows += [(73, 1, "user", "x" * 1_500_000 + "."), (73, 2, "assistant", "y" * 1_500_000), (74, None, None, None), (75, 3, "s", "?")]
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_conversations(spark, parts):
    rows = conversations()
    df = spark.createDataFrame([(*x, "a", 1, 2.0) for x in rows], "conv_id long, turn long, role string, text string, audit string, fault int, first double").repartition(5)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = dialogue.conversation_report(df).toPandas()
        empty = dialogue.conversation_report(df.limit(0)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    want = sql(dialogue.CONVERSATION_SQL, conversations=pa.Table.from_pandas(frame))
    cells = lambda d: sorted(repr([None if pd.isna(v) else int(v) if isinstance(v, (int, float, np.integer)) else v for v in r]) for r in d[list(want.columns)].astype(object).values.tolist())
    assert cells(got) == cells(want) and empty == []


# negatives


def vectors():
    r = random.Random(7)
    rows = [(i if i % 97 else None, [r.choice([-1.0, -0.3, 0.0, 0.2, 0.25, 1.0]) for _ in range(r.choice([6, 6, 6, 4, 0]))], r.choice([0, 1, 1, 1, 2, 9, None])) for i in range(400)]
    rows += [(50, [1.0] * 6, 1)] * 3 + [(50, [0.5] * 6, 1), (100, None, 1), (150, [1.0, None], 1), (200, [float("nan")], 1), (250, [float("inf")], 2), (301, [0.1] * 9, 3)]
    return rows


def brute(rows, big=False):
    kept = [(i, (l + 1) % 10 if i is not None and i % 7 == 0 else l, [math.floor(256 * x) for x in v]) for i, v, l in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for n, (i, l, q) in enumerate(kept):
        if i is None or i % 50:
            continue
        found = [(max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(q, p)))), j, m) for k, (j, m, p) in enumerate(kept) if k != n]
        for score, j, _ in sorted((x for x in found if x[2] == l), key=key)[:5]:
            other = sorted((x for x in found if x[2] != l and 50 * score <= 100 * x[0] <= 95 * score), key=key)[:3]
            out += [(i, j, rank, x[1], score, x[0]) for rank, x in enumerate(other, 1)]
    return sorted(out, key=repr)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_negatives(spark):
    rows = vectors()
    df = spark.createDataFrame([(*x, 0, "p") for x in rows], "vec_id long, embedding array<float>, label int, p int, slot string").repartition(6)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]
    assert table(negatives.negatives_report(df), *COLUMNS) == brute(exact)
    assert negatives.negatives_report(df.limit(0)).collect() == [] and negatives.negatives_report(df.where("vec_id = 1")).collect() == []


def test_large_components(spark):
    r = random.Random(8)
    rows = [(i, [r.choice([1e300, -3e15, 2.5, 7e8, 0.1]) * r.choice([1, 1, -1]) for _ in range(3)], r.choice([1, 2])) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = lambda x: int(x) * 256 if abs(x) >= 2.0**44 else math.floor(256 * x)
    scaled = [(i, [whole(x) for x in v], l) for i, v, l in rows]
    kept = [(i, v, l) for i, v, l in scaled]
    want = []
    for i, q, l in kept:
        l = (l + 1) % 10 if i % 7 == 0 else l
        if i % 50:
            continue
        found = [(max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(q, p)))), j, (m + 1) % 10 if j % 7 == 0 else m) for j, p, m in kept if j != i]
        for s, j, _ in sorted((x for x in found if x[2] == l), key=lambda x: (-x[0], x[1]))[:5]:
            want += [(i, j, k, x[1], s, x[0]) for k, x in enumerate(sorted((x for x in found if x[2] != l and 50 * s <= 100 * x[0] <= 95 * s), key=lambda x: (-x[0], x[1]))[:3], 1)]
    assert table(negatives.negatives_report(df), *COLUMNS) == sorted(want, key=repr)
