"""Scalar rules at their bounds."""

import pytest
from pyspark.sql import functions as F

from tidewater.functions import scalars as S


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


@pytest.mark.parametrize(
    "name,want",
    [("CAUSED_BY", "TRIGGERS"), ("in", "HAPPENED_IN"), ("INFLUENCES", "AFFECTS"), ("involves", "INVOLVES"), ("CEO_OF", "INVOLVES"), ("CHAIRMAN_OF", "INVOLVES"), ("SUBSIDIARY_OF", "PART_OF"), ("REPORTS", "RELATES_TO"), ("EXPOSED_TO", "RELATES_TO"), (None, "RELATES_TO"), ("LISTED_ON", "TRADED_ON"), ("LOCATED_IN", "PART_OF"), ("INVESTS_IN", "RELATES_TO")],
)
def test_edge_type(spark, name, want):
    assert one(spark, S.edge_type(F.lit(name).cast("string"))) == [want]


@pytest.mark.parametrize(
    "fact,want",
    [("X is a subsidiary of Y", "PART_OF"), ("Nvidia's chips are part of the ongoing race to build AI", None), ("Z is part of the group", "PART_OF"), ("A became the largest firm", None), ("A became the CEO", "INVOLVES"), ("B impacts C", "AFFECTS"), ("impacts of B", None), ("it led to losses", "TRIGGERS"), ("X partners with Y", None)],
)
def test_edge_type_of_fact(spark, fact, want):
    assert one(spark, S.edge_type_of_fact(F.lit(fact))) == [want]


def test_severities(spark):
    g = [S.severity_goldstein(F.lit(v).cast("double")) for v in (8.0, -8.0, 6.0, 5.99, 4.0, 3.9, None)]
    assert one(spark, *g) == ["critical", "critical", "high", "medium", "medium", "low", "medium"]
    t = [S.severity_tone(F.lit(v)) for v in ("5.1,0", "5", "-5", "-5.1", "-10", "-10.1", "x")]
    assert one(spark, *t) == ["low", "medium", "medium", "high", "high", "critical", "medium"]
    c = [S.curve_shape(F.lit(4.0), F.lit(v)) for v in (4.01, 4.0, 3.76, 3.75)]
    assert one(spark, *c) == ["normal", "flat", "flat", "inverted"]
    f = [S.severity_fatalities(F.lit(n), F.lit(k)) for n, k in ((100, "x"), (25, "x"), (1, "x"), (0, "Battles"), (0, "x"))]
    assert one(spark, *f) == ["critical", "high", "medium", "medium", "low"]
    s = [S.severity_series(F.lit(n), F.lit(a), F.lit(b)) for n, a, b in (("UNRATE", 5.0, 4.0), ("DFF", 1.0, 1.75), ("CES0000000001", 100.0, 600.0), ("GDP", 9.0, 1.0))]
    assert one(spark, *s) == ["high", "high", "high", "medium"]


def test_severity_words(spark):
    w = [S.severity_by_words(F.lit(t), F.lit(n)) for t, n in (("股市暴跌", 0), ("违约", 0), ("新高", 0), ("回购", 0), ("x", 0), ("暴跌", 5))]
    assert one(spark, *w) == ["critical", "high", "medium", "low", "medium", "high"]


def test_names_and_text(spark):
    alias = {"acme": "ACME Corporation"}
    names = [S.canonical_name(F.lit(n), alias) for n in (" Acme Inc. ", "Beta  Holdings Ltd", "Group Co.", "Acme", "中国 公司")]
    assert one(spark, *names) == ["ACME Corporation", "Beta", "Group Co.", "ACME Corporation", "中国"]
    assert one(spark, S.strip_html_telegraph(F.lit("<b>a</b>&amp;lt;")), S.strip_html(F.lit("<p>a &amp; b</p>")), S.strip_control(F.lit("a\x01b\tc"))) == ["a<", "a & b", "ab\tc"]
    assert one(spark, S.truncate_leaked(F.lit('"news [END OF CONTENT] rest')), S.truncate_leaked(F.lit("[end of content]"))) == ["news", None]
    assert one(spark, S.programs(F.lit("SDGT] [IFSR")), S.persons(F.lit("A; KILL#2##0 ;B;"))) == [["SDGT", "IFSR"], ["A", "B"]]
    assert one(spark, S.locations(F.lit("1#2#x#Beijing,Beijing,China#CN|1#2#x#Paris#FR"))) == [["Beijing, China", "Paris"]]


def test_dates(spark):
    d = [S.period_date(F.lit("2024"), F.lit(p)).cast("string") for p in ("M01", "M12", "M13", "Q1")]
    assert one(spark, *d) == ["2024-01-01", "2024-12-01", "2024-12-31", None]
    c = [S.chinese_date(F.lit(t)).cast("string") for t in ("2024年03月份", "2024年第1季度", "2024年第1-3季度", "2024-05-06")]
    assert one(spark, *c) == ["2024-03-01", "2024-03-01", "2024-09-01", "2024-05-06"]
    assert one(spark, S.day(F.lit("20240230")), S.safe_int(F.lit("1,234.9")), S.safe_int(F.lit("x")), S.safe_double(F.lit(""))) == [None, 1234, 0, None]
    assert one(spark, *[S.backoff(F.lit(n)) for n in (0, 1, 9)]) == [600.0, 1200.0, 21600.0]
