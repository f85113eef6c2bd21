"""Operators with order or state."""

import datetime as dt

from pyspark.sql import functions as F

from tidewater.operators import filters as X
from tidewater.operators import graph as G
from tidewater.operators import relational as R
from tidewater.operators import state as Q


def test_filter_config_falls_back_part_by_part():
    c = X.FilterConfig.of({"cameo_filter": {"mode": "odd", "codes": ["1"]}, "goldstein": {"min_abs_value": -1}, "mentions": 3})
    assert (c.mode, c.codes, c.min_abs, c.min_count) == ("prefix_match", ("1",), 5.0, 5)


def test_codes(spark):
    d = spark.createDataFrame([("141",), (" 14",), ("1",), (None,), ("",)], "c string")
    assert d.where(X.code_matches(F.col("c"), "prefix_match", ("14",))).count() == 2
    assert d.where(X.code_matches(F.col("c"), "exact", ("14",))).count() == 1
    assert d.where(X.code_matches(F.col("c"), "contains", ())).count() == 0


def test_top_urls_first_arrival_counts(spark):
    m = spark.createDataFrame([("e", "a", 10, 0), ("e", "a", 99, 1), ("e", "b", 20, 2), ("e", "c", 5, 3), ("e", "d", 7, 4)], "e string, u string, c int, p int")
    assert [r.u for r in R.top_urls(m, "e", "u", "c", ["p"]).orderBy("rank").collect()] == ["b", "a", "d"]


def test_pack(spark):
    d = spark.createDataFrame([("k", i, s) for i, s in enumerate([10, 10, 30_000, 5, 23_999, 1, 1])] + [("m", i, 1) for i in range(9)], "k string, o int, s int")
    got = {(r.k, r.o): r.chunk for r in R.pack(d, "k", "o", "s").collect()}
    assert [got["k", i] for i in range(7)] == [0, 0, 1, 2, 3, 3, 4]
    assert [got["m", i] for i in range(9)] == [0] * 8 + [1]


def test_khop(spark):
    e = spark.createDataFrame([("1", "a", "b"), ("2", "b", "c"), ("3", "c", "d"), ("4", "a", "a"), ("5", "b", "c")], "id string, src string, dst string")
    ids = lambda k: sorted(r.id for r in G.khop(e, "a", k).collect())
    assert ids(1) == ["1", "4"] and ids(2) == ["1", "2", "4", "5"] and ids(3) == ["1", "2", "3", "4", "5"]
    assert G.khop(e, "z", 2).count() == 0


def test_queue(spark):
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp")
    batch = spark.createDataFrame([("x", dt.datetime(2024, 1, 1)), ("y", dt.datetime(2024, 1, 2))], "content_hash string, captured_at timestamp")
    log = Q.capture(batch, spark.createDataFrame([], Q.LOG), t0)
    assert log.count() == 2 and Q.capture(batch, log, t0).count() == 0
    log = log.union(Q.claim(log, batch, "w", t0, 60, 1))
    assert {r.content_hash: r.status for r in Q.current(log).collect()} == {"x": "processing", "y": "pending"}
    keys = batch.select("content_hash")
    assert Q.finish(log, keys, "other", t0).count() == 0
    assert [r.status for r in Q.recover(log, t0 + F.expr("interval 2 minutes")).collect()] == ["pending"]
    failed = log.union(Q.fail(log, keys, t0, 2))
    assert Q.retry(failed, t0 + F.expr("interval 19 minutes"), 2).count() == 0
    assert [r.status for r in Q.retry(failed, t0 + F.expr("interval 20 minutes"), 2).collect()] == ["pending"]
    assert {r.status: r.n for r in Q.summary(Q.current(failed), F.lit(False)).collect()}["failed"] == 1


def test_hash_then_url(spark):
    d = spark.createDataFrame([(0, "h", "u"), (1, "h", "v"), (2, "i", "u"), (3, "j", ""), (4, "k", None)], "p int, h string, u string")
    assert sorted(r.p for r in R.dedup_hash_then_url(d, "h", "u", "p").collect()) == [0, 3, 4]


def test_khop_over_all_suppliers(spark, tmp_path):
    from tidewater.plans import registry as catalogue

    items = [(s, p) for s in range(1, 31) for p in ((s, 1) if s > 20 else (s + 100, s % 2 + 1))]
    for name, rows, schema in (
        ("nation", [(0, "N0"), (1, "N1")], "n_nationkey long, n_name string"),
        ("supplier", [(i, f"Supplier#{i:09}", i % 2) for i in range(1, 31)], "s_suppkey long, s_name string, s_nationkey long"),
        ("lineitem", items + items, "l_suppkey long, l_partkey long"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    edges = {(f"sn{i}", f"Supplier#{i:09}", f"N{i % 2}") for i in range(1, 31)} | {(f"ps{s}-{p}", f"part{p}", f"Supplier#{s:09}") for s, p in items}
    for k in (1, 2, 3):
        near, want = {"Supplier#000000001"}, set()
        for _ in range(k):
            step = {e for e in edges if near & {e[1], e[2]}}
            want |= step
            near |= {x for e in step for x in e[1:]}
        got = catalogue.queries()[f"q40_khop_edges_{k}"](spark, str(tmp_path)).collect()
        assert sorted(map(tuple, got)) == sorted(want)
        assert k < 3 or any(e[0].startswith("ps2") and int(e[0][2:].split("-")[0]) > 20 for e in want)
