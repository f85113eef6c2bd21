"""Bounds that must not depend on what a text repeats or how many rules there are."""

import random
import tracemalloc

from tidewater.llm import decontam, secrets


def edits(item, text):
    """Least edits of the item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, e in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != e), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_is_a_full_search():
    r = random.Random(1)
    for trial in range(120):
        signs = "ab" if trial % 3 == 0 else "abcdefgh "
        n = r.choice([13, 40, 60, 120])
        item = "".join(r.choice(signs) for _ in range(n)) if trial % 4 else ("".join(r.choice(signs) for _ in range(r.randint(1, 5))) * n)[:n]
        body = list(item)
        for _ in range(r.randint(0, n // 20 + 2)):
            at = r.randrange(len(body))
            body[at : at + r.randint(0, 1)] = r.choice(["x", "", "yz"])
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 90))) + "".join(body) + "".join(r.choice(signs) for _ in range(r.randint(0, 90)))
        index = decontam.Index([(1, item)])
        folded = index.texts[0]
        if folded:
            want = edits(folded, decontam.fold(text)) <= index.k[0] if len(folded) >= decontam.Q else folded in decontam.fold(text)
            assert bool(index.find(text)) == want


def test_decontamination_of_repetitive_texts():
    index = decontam.Index([(1, "ab" * 1000), (2, "-" * 500), (3, "a quite ordinary sentence of a benchmark item")])
    tracemalloc.start()
    found = index.find("ab" * 200_000 + "-" * 300_000 + " A quite ordinary sentense of a benchmark item")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {m[0] for m in found} == {1, 2, 3} and most < 500e6
    assert index.find("| - " * 100_000) == []


def test_more_rules_than_bits(spark):
    rules = secrets.RULES + tuple(secrets.Rule(f"rule{i}", f"key{i:03d}x[a-z]{{4}}", 0, 1, False) for i in range(90))
    rows = [(i, f"say key{i:03d}xabcd here") for i in range(0, 90, 7)] + [(100, "key001x key002xab"), (101, None)]
    got = {r.id: [s.kind for s in r.spans] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), rules=rules).collect()}
    assert got == {i: [f"rule{i}"] for i in range(0, 90, 7)} | {100: [], 101: []}
