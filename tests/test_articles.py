"""Article extraction on small pages."""

import json

from pyspark.sql import functions as F

from tidewater.functions import articles as A

LONG, LONGER = "a" * 200, "b" * 300


def page(state=None, linked=()):
    s = "" if state is None else f'<script id="__NEXT_DATA__" type="application/json">{state}</script>'
    return "<html>" + s + "".join(f"<script type='application/ld+json'>{x}</script>" for x in linked) + "</html>"


def nested(depth):
    x = LONG
    for _ in range(depth):
        x = {"k": x}
    return json.dumps(x)


def test_extract(spark):
    cases = {
        "body key wins": (page(json.dumps({"x": LONGER, "articleBody": LONG})), LONG, "next_data"),
        "held body": (page(json.dumps({"x": LONGER, "post": {"content": LONG}})), LONG, "next_data"),
        "longest": (page(json.dumps({"x": LONG, "y": [LONGER]})), LONGER, "next_data"),
        "short": (page(json.dumps({"x": LONG[1:]})), None, None),
        "depth 8": (page(nested(8)), LONG, "next_data"),
        "depth 9": (page(nested(9)), None, None),
        "bad state, then linked": (page("{oops", [json.dumps({"@type": "NewsArticle", "articleBody": LONG})]), LONG, "json_ld"),
        "graph": (page(None, ["{bad", json.dumps({"@graph": [{"@type": ["Thing", "Article"], "description": LONG}]})]), LONG, "json_ld"),
        "wrong type": (page(None, [json.dumps([{"@type": "Person", "articleBody": LONG}])]), None, None),
        "page": ("<p>" + LONG + "</p>", LONG, "page"),
        "empty": ("", None, None),
        "null": (None, None, None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "name string, html string")
    got = {r.name: (r.e.text, r.e.engine) if r.e else (None, None) for r in df.select("name", A.extract(F.col("html")).alias("e")).collect()}
    assert got == {k: v[1:] for k, v in cases.items()}


def test_front_matter(spark):
    rows = [("---\ntitle: 'A: b'\nn: 1\nn: 2\nlist:\n  - x\n---\nbody\n",), ("no fence",), ("",), (None,)]
    got = [r.m for r in spark.createDataFrame(rows, "t string").select(A.front_matter(F.col("t")).alias("m")).collect()]
    assert got[0].body == "body\n" and got[0].metadata == {"title": "A: b", "n": "2"}
    assert [g.body for g in got[1:]] == ["no fence", "", None] and all(g.metadata == {} for g in got[1:])
