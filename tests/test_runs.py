"""Runs, health, dry runs, leak plans and replies: nulls, ties, empty tables, edge cases."""

from pyspark.sql import functions as F

from tidewater.operators import runs as R

RUNS = "source string, at timestamp, pos int, ok boolean, error string"


def test_sources():
    assert len(R.sources()) == len(R.sources(None)) == 10 and R.sources("rss") == ["rss"]


def test_health_edges(spark):
    now = F.expr("timestamp '2025-01-01 01:00:00'")
    t = lambda m: f"2025-01-01 00:{m:02d}:00"
    rows = [("a", t(0), 1, True, None), ("a", t(0), 2, False, "tie"), ("b", t(1), 1, False, "x")] + [("c", t(m), m, None, f"e{m}") for m in range(6)] + [("d", t(5), 1, False, "old"), ("d", t(6), 1, True, None), (None, t(9), 1, True, None)]
    d = spark.createDataFrame(rows, "source string, at string, pos int, ok boolean, error string").withColumn("at", F.to_timestamp("at"))
    got = {r.source: (r.status, r.latency_minutes, r.error) for r in R.health(d, now, ["a", "z"]).collect()}
    assert got == {"a": ("degraded", 60, "tie"), "b": ("degraded", 59, "x"), "c": ("down", 55, "e5"), "d": ("ok", 54, None), None: ("ok", 51, None), "z": ("down", 0, R.NEVER_RAN)}
    assert R.health(spark.createDataFrame([], RUNS), now).collect() == []
    assert [r.status for r in R.health(spark.createDataFrame([], RUNS), now, ["a"]).collect()] == ["down"]


def test_totals_of_nothing_and_of_failures(spark):
    schema = "day int, source string, success boolean, episodes int, fetched int, filtered int, seconds double"
    empty = spark.createDataFrame([], schema)
    assert R.cycle_summary(empty, "day").collect() == []
    assert [tuple(r) for r in R.dry_run_summary(empty).collect()] == [("TOTAL", 0, 0, 0, 0.0, 0)]
    d = spark.createDataFrame([(1, "a", None, None, None, None, 1.5), (1, "b", True, 3, 0, 1, 2.0), (2, "a", False, 1, 1, 1, 0.5)], schema)
    assert {r.day: (r.runs, r.episodes, r.failed, r.failed_sources, r.level) for r in R.cycle_summary(d, "day").collect()} == {1: (2, 3, 1, "a", "partial"), 2: (1, 1, 1, "a", "all failed")}
    assert {tuple(r) for r in R.dry_run_summary(d).collect()} == {("a", None, None, None, 2.0, 2), ("b", 3, 1, 3, 2.0, 0), ("TOTAL", 3, 1, 3, 4.0, 2)}


def test_written_rows_are_registered_once(spark):
    d = spark.createDataFrame([("x", "ok"), ("x", "ok"), ("y", "error"), ("z", "skipped_duplicate"), ("", "ok"), (None, "ok"), ("old", "ok")], "content_hash string, status string")
    seen = spark.createDataFrame([("old",)], "content_hash string")
    assert sorted(r[0] for r in R.newly_written(d, seen).collect()) == ["x", "z"]


def test_leaks_planned_and_applied(spark):
    d = spark.createDataFrame([(1, '"kept" [END OF CONTENT] x', "fine"), (2, "[end of content]", None), (3, "clean", "")], "id int, summary string, note string")
    plan = {(r.id, r.property, r.new, r.action) for r in R.leak_plan(d, "id", ["summary", "note"]).collect()}
    assert plan == {(1, "summary", "kept", "set"), (2, "summary", None, "removed")}
    assert {tuple(r) for r in R.without_leaks(d, ["summary", "note"]).collect()} == {(1, "kept", "fine"), (2, None, None), (3, "clean", "")}


def test_replies(spark):
    said = ['[{"a":1}]', '{"properties":{"edges":[1]},"type":"object"}', '{"properties":{"edges":{"type":"array"}},"type":"object"}', '{"properties":{},"type":"object"}', '{"edges":[1]}', '{"edges":[2],"n":"3"}', "no", "", None, "{broken"]
    d = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    got = {r.i: r.m for r in d.select("i", R.repaired_reply(F.col("s"), {"edges": "[]", "n": "0"}).alias("m")).collect()}
    assert got[0] == {"edges": '[{"a":1}]'} and got[1] == {"edges": "[1]"} and got[2] == got[3] == {"edges": "[]", "n": "0"}
    assert got[4] == {"edges": "[1]", "n": "0"} and got[5] == {"edges": "[2]", "n": "3"} and got[6] is got[7] is got[8] is None
    assert got[9] is None or got[9] == {"edges": "[]", "n": "0"}
    two = d.select("i", R.repaired_reply(F.col("s"), {"a": "[]", "b": "[]"}).alias("m")).where("i = 0").collect()
    assert two[0].m == {"a": "[]", "b": "[]"}  # two lists: which one is meant can't be told


def test_suffix_of_nothing(spark):
    kind = "array<struct<name:string,type:string,ticker:string,sector:string,exchange:string>>"
    d = spark.createDataFrame([(1, None), (2, []), (3, [("A", "country", None, None, None), ("B", "stock", "TB", "", None), (None, None, None, None, None)])], f"i int, e {kind}")
    got = {r.i: r.s for r in d.select("i", R.entity_suffix(F.col("e")).alias("s")).collect()}
    assert got[1] == got[2] == "" and got[3].endswith("\n- Country: A\n- Stock: B (TB)\n- : ")
