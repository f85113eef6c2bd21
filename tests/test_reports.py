"""Fallback, briefings, watch counters, composed answers and vocabularies on small tables."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tidewater.functions import vocab
from tidewater.operators import answers as W
from tidewater.operators import briefings as B
from tidewater.operators import graph as G
from tidewater.operators import records as C
from tidewater.operators import relational as R
from tidewater.sources import tables as T
from tidewater.streaming import watch as M


def test_briefings_follow_their_events(spark, tmp_path):
    schema = "sector string, event_id long, title string, severity string, first_seen string, last_updated string, source_count int, summary string, tickers array<string>, keywords array<string>, created_at timestamp"
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
    rows = [(s, i, f"t{i}", "high", "a", "b", 1, None, ["T1", f"T{i % 3}"], list("abcdefg"), at(i)) for s in ("x", "y") for i in range(25)]
    path, day = str(tmp_path / "b"), lambda n: F.lit(f"2024-02-0{n} 00:00:00").cast("timestamp")
    refresh = lambda rows, n: sorted(r.sector for r in B.refresh(spark, path, spark.createDataFrame(rows, schema), day(n)).collect())
    assert refresh(rows, 1) == ["x", "y"] and refresh(rows, 2) == []
    old = [(*r[:5], "new", *r[6:]) if (r[0], r[1]) == ("x", 2) else r for r in rows]  # not among the newest 20
    new = [(*r[:5], "new", *r[6:]) if (r[0], r[1]) == ("x", 20) else r for r in rows]
    assert refresh(old, 3) == [] and refresh(new, 4) == ["x"] and refresh(new, 5) == [] and refresh([r for r in new if r[0] == "x"], 6) == []
    text = B.cached(spark, path, "x").collect()[0].briefing
    assert text.startswith("## 行业: x\n## 统计: 总事件 20 个, 涉及 3 只标的\n\n## 事件列表:\n\n### [🟠] t24\n") and "- 摘要: 无\n" in text and "a, b, c, d, e\n" in text and "f" not in text.split("关键词: ")[1].split("\n")[0]
    assert B.cached(spark, path, "z").isEmpty() and B.cached(spark, path, "y").count() == 1


def test_last_good_result(spark, tmp_path):
    shots = T.Snapshots(str(tmp_path / "s"))
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    none, e, g = make([], "id long, a string"), make([(1, "x")], "id long, a string"), make([(2, "z")], "id long, b string")
    empty = make([], "id long, b string")
    get = lambda a, b: [(r.id, r.tier, r.degraded) for r in T.fetch_or_last_good(a, b, shots).collect()]
    assert get(none, empty) == [] and get(e, g) == [(1, 1, False)] and get(none, empty) == [(1, 3, True)]
    assert get(none, g) == [(2, 2, True)] and get(none, empty) == [(2, 3, True)]


def test_samples_hold_k_rows_a_task(spark):
    d = spark.range(2000).selectExpr("id % 3 as g", "concat('x', lpad(id, 5, '0')) as x")
    found = R.samples(d, ["g"], "x", 2)
    assert sorted(map(tuple, found.collect())) == [(0, ["x00000", "x00003"]), (1, ["x00001", "x00004"]), (2, ["x00002", "x00005"])]
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_high_water(spark, tmp_path):
    told = []
    listener = M.HighWater(5, told.append)
    spark.streams.addListener(listener)
    schema = "content_hash string, status string"
    try:
        for n, rows in enumerate(([("a", "pending")] * 3, [("b", "pending")] * 3, [("a", "processing")] * 4, [("c", "pending")] * 4)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = M.with_level(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
            stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if listener.pending == 6 and len(told) == 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert told == [6, 6] and listener.pending == 6


def test_graph_of_an_answer(spark):
    nodes = spark.createDataFrame([(n, ["Stock"], t) for n, t in (("a", "A"), ("b", None), ("c", None), ("d", "D"), ("a2", "A"))], "name string, labels array<string>, ticker string")
    edges = spark.createDataFrame([(1, "a", "b", "X", "f"), (2, "c", "b", "X", "g"), (3, "c", "c", "Y", None), (4, "a2", "a", "Z", "h"), (5, "b", "a", "x", "i"), (6, "a", "b", "x", "later")], "id long, src string, dst string, name string, fact string")
    ids = lambda t, h: sorted(r.pos for r in W.graph_records(nodes, edges, t, h).collect())
    assert ids("A", 1) == [-1, 1, 4, 5, 6] and ids("A", 2) == [-1, 1, 2, 4, 5, 6] and ids("A", 3) == [-1, 1, 2, 3, 4, 5, 6] and ids("D", 3) == [-1] and ids("none", 1) == []
    got = W.graph_edges(W.graph_records(nodes, edges, "A", 1)).collect()
    assert sorted(map(tuple, got)) == [("a", "b", "X", "f"), ("a2", "a", "Z", "h"), ("b", "a", "X", "i")]
    assert [(r.id, r.type) for r in W.graph_nodes(W.graph_records(nodes, edges, "D", 2)).collect()] == [("d", "stock")]
    with pytest.raises(ValueError):
        W.graph_records(nodes, edges, "A", 4)
    assert sorted(r.id for r in G.khop(edges, "b", 1).collect()) == [1, 2, 5, 6]


def test_vocabularies_and_bodies(spark):
    assert len(vocab.FEED_WORDS) == 128 and len(vocab.MEDIA_HOSTS) == 34
    d = spark.createDataFrame([("E1", "2024-01-01", "Riot", "X", None, "b", 3, "n" * 600)], "event_id_cnty string, event_date string, event_type string, country string, actor1 string, actor2 string, fatalities int, notes string")
    lines = d.select(C.conflict_body()).collect()[0][0].split("\n")
    assert lines[:3] == ["## ACLED: Riot in X", "", "- Event ID: E1"] and lines[6] == "- Fatalities: 3" and lines[7] == "- Actor 2: b" and lines[8] == "- Notes: " + "n" * 497 + "..."
