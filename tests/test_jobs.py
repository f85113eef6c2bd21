"""Remaining bodies, nested front matter, the pushed whitelist and the command line: nulls, ties, empty tables, edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater import __main__ as CLI
from tidewater.functions import articles as A
from tidewater.operators import records as C
from tidewater.operators import runs as R
from tidewater.operators import state as Q
from tidewater.operators import upkeep as U
from tidewater.sources import register as G
from tidewater.sources import tables as T
from tidewater.sources import whitelist as W


def test_curve_edges(spark):
    rows = [(1, {"2yr": 4.5, "10yr": 4.3}), (2, {"2yr": 4.0, "10yr": 4.0}), (3, {"30yr": 5.0, "2yr": None}), (4, {}), (5, None), (6, {"1.5mo": 4.0}), (7, {"2yr": 4.0, "10yr": 3.7})]
    d = spark.createDataFrame(rows, "i int, r map<string,double>")
    got = {x.i: (x.t, x.b) for x in d.select("i", C.curve_text(F.col("r"), F.lit("D")).alias("t"), C.curve_list(F.col("r"), F.lit("D")).alias("b")).collect()}
    assert got[1][0] == "美国国债收益率曲线（D）：2年期4.50%，10年期4.30%。2s10s利差-20bp，收益率曲线形态趋平，接近倒挂区间。"
    assert got[1][1] == "## US Treasury Yield Curve — D\n\n- 2yr: 4.50%\n- 10yr: 4.30%\n\nSpread (2s10s): -20.0 bp | Shape: flat"
    assert "2s10s利差0bp" in got[2][0] and got[7][1].endswith("Shape: inverted")
    assert got[3] == ("美国国债收益率曲线（D）：30年期5.00%。", "## US Treasury Yield Curve — D\n\n- 30yr: 5.00%\n")
    assert got[4] == got[5] == (None, None) and got[6][0] == "美国国债收益率曲线（D）：。"


def test_china_edges(spark):
    d = spark.createDataFrame([("cpi", None), ("cpi", float("nan")), ("cpi", 3.0), ("cpi", -0.1), ("ppi", 0.0), ("pmi", 50.0), ("x", 1.0), (None, 1.0), ("own", 2.0)], "i string, v double")
    told = {"own": ("", "点", "已知。")}
    got = [(r.a, r.b) for r in d.select(C.china_body(F.col("i"), F.col("v"), F.lit("D")).alias("a"), C.china_body(F.col("i"), F.col("v"), F.lit("D"), told).alias("b")).collect()]
    assert got[0] == got[1] == (None, None)
    assert got[2][1].endswith("Moderate inflation") and got[3][1].endswith("Deflation (negative CPI)") and got[4][1].endswith("deflation") and got[5][1].endswith("(below 50 threshold)")
    assert got[6][0] == "## China x — D\n\n- Value: 1.00\n- Frequency: unknown\n" and got[8][1] == "中国own，D：2.00点。已知。"
    assert got[5][0] == "中国PMI（官方制造业采购经理指数），D：50.00。50以上为扩张区间，以下为收缩区间。"


def test_notices_and_rules(spark):
    d = spark.createDataFrame([("t", "tt"), ("tt", "tt"), (None, None), (None, "c"), ("t", None)], "t string, c string")
    assert [r.b for r in d.select(C.notice_body(F.col("t"), F.col("c")).alias("b")).collect()] == ["t\n\ntt", "tt", "", "\n\nc", "t"]
    e = spark.createDataFrame([(True, None), (False, []), (None, [("A", ""), (None, "T")])], "s boolean, e array<struct<name:string,ticker:string>>")
    got = [r.r for r in e.select(R.extraction_rules(F.col("s"), F.lit("S"), F.lit("O"), F.col("e")).alias("r")).collect()]
    assert got[:2] == ["S", "O"] and got[2].startswith("O\n\nENTITY RESOLUTION RULES:") and got[2].endswith("NAMES:\n- A\n-  (T)")
    n = spark.createDataFrame([([("a", None), ("b", ["é", "x", "y"])],), ([],), (None,)], "s array<struct<name:string,aliases:array<string>>>")
    assert [r.n for r in n.select(R.sector_names(F.col("s")).alias("n")).collect()] == ["a, b (x)", "", None]


def test_nested_front_matter(spark):
    pytest.importorskip("yaml")
    texts = ["---\na:\n  b: [1, {c: 2.5}]\n---\nbody", "---\n- a\n---\nx", "---\na: [\n---\nx", "---\na: .nan\n2024-01-05: {1: x}\n---\n", "no", "", None, "---\na: &x [*x]\n---\nz", "---\r\nk: v\r\n---\r\nw", "---\n---\n"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: tuple(r.x) for r in d.select("i", A.front_matter_tree(F.col("t")).alias("x")).collect()}
    assert got[0] == ("body", '{"a": {"b": [1, {"c": 2.5}]}}') and got[1] == got[2] == ("x", "{}") and got[3] == ("", '{"a": "nan", "2024-01-05": {"1": "x"}}')
    assert got[4] == ("no", "{}") and got[5] == ("", "{}") and got[6] == (None, "{}") and got[7] == ("z", "{}") and got[8] == ("w", '{"k": "v"}') and got[9][1] == "{}"


def test_whitelist_pushes(spark, tmp_path):
    shots, now = T.Snapshots(str(tmp_path / "w")), F.expr("timestamp '2025-06-01 20:30:00.9'")
    push = lambda rows, schema="ticker string, sector string, biz_code string, name string": tuple(W.push(spark.createDataFrame(rows, schema), shots, now).first())
    names = lambda: sorted(r.name for r in W.latest(spark, shots).collect())
    assert names() == []
    assert push([("a", "s", "1", "A"), ("a", "s", "1", "A"), ("b", "", "2", None)]) == ("ok", 3, "2025-06-02T04:30:00+08:00") and names() == ["", "A", "A"]
    assert push([("a", None, "1", "A"), ("b", "s", "2", "B")])[:2] == ("invalid", 1) and names() == ["", "A", "A"]
    assert push([("c", "s", "3", 7)], "ticker string, sector string, biz_code string, source int")[:2] == ("ok", 1) and names() == [""]
    assert push([]) == ("ok", 0, "2025-06-02T04:30:00+08:00") and names() == []


def test_moments():
    utc = dt.timezone.utc
    assert U.moment("2024-01-05") == dt.datetime(2024, 1, 5, tzinfo=utc) and U.moment("2024-01-05", True) == dt.datetime(2024, 1, 6, tzinfo=utc)
    assert U.moment("2024-01-05T10:00:00+08:00", True) == dt.datetime(2024, 1, 5, 2, tzinfo=utc)
    for args in (["--stats", "--replay"], ["--rebuild-index"], ["--replay", "--since", "yesterday"], []):
        with pytest.raises(SystemExit):
            CLI.arguments(["--queue", "q", *args])


def test_upkeep_of_empty_and_odd_rows(spark, tmp_path):
    now, none = F.expr("timestamp '2025-01-01 00:00:00'"), (spark.createDataFrame([], G.INDEX), spark.createDataFrame([], Q.LOG))
    assert U.stats(*none).isEmpty() and U.replay(*none, now).isEmpty() and U.missing_states(*none, now).isEmpty()
    at = lambda day: dt.datetime(2024, 1, day)
    index = spark.createDataFrame([(h, None, s, "f", 0, None, t, None, "pending", 0) for h, s, t in (("a", "x", at(1)), ("b", None, None), ("c", "x", at(2)), ("d", "y", at(2)))], G.INDEX)
    log = spark.createDataFrame([("a", 1, "done", 1, None, None, at(3)), ("b", 1, "skipped", 1, None, None, at(3)), ("c", 1, "dead", 5, None, None, at(3)), ("z", 1, "done", 0, None, None, at(3))], Q.LOG)
    keys = lambda d: sorted(r.content_hash for r in d.collect())
    assert keys(U.replay(index, log, now)) == ["a", "b"] and keys(U.replay(index, log, now, F.lit(U.moment("2024-01-01")))) == ["a"] and keys(U.replay(index, log, now, source="y")) == []
    assert keys(U.retry_dead(log, now)) == ["c"] and keys(U.missing_states(index, log, now)) == ["d"]
    got = {(r.kind, r.value): r.n for r in U.stats(index, log).collect()}
    assert got == {("status", "done"): 1, ("status", "skipped"): 1, ("status", "dead"): 1, ("status", "pending"): 1, ("source_type", "x"): 2, ("source_type", "y"): 1, ("source_type", None): 1, ("day", "2024-01-01"): 1, ("day", "2024-01-02"): 2, ("day", None): 1, ("total", None): 4}
    base = str(tmp_path)
    index.write.parquet(base + "/index")
    log.write.parquet(base + "/log")
    did = lambda *args: CLI.run(spark, CLI.arguments(["--queue", base, *args])).first().n
    assert did("--replay", "--until", "2024-01-01") == 1 and did("--replay", "--until", "2024-01-01") == 0 and did("--retry-dead") == 1 and did("--replay-all", "--source", "none") == 1
