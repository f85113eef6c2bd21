"""Registered queries of the readers: each writes whole tables in a landed form to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as IO
from .registry import folder, q
from .registry import table as _t


def _tabbed(n: int, at: dict):
    """n tab-separated fields, those of `at` given, the rest empty."""
    return F.concat_ws("\t", *[F.coalesce(at.get(i, F.lit("")).cast("string"), F.lit("")) for i in range(n)])


def _lines(df, spark, tag: str, *lines):
    """Written text files of the given lines of each row, nulls left out."""
    path = folder(spark, tag)
    df.select(F.explode(F.array_compact(F.array(*lines))).alias("value")).write.text(path)
    return path


def _events_file(spark, sf):
    k = F.col("o_orderkey")
    day = F.when(k % 11 == 0, "someday").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    at = {0: k, 1: day, 5: F.lit("USA"), 26: F.concat(F.lit(" 14"), (k % 9).cast("string"), F.lit(" ")), 30: F.when(k % 5 == 0, "abc").otherwise((F.col("o_custkey") % 21 - 10).cast("string")), 60: F.concat(F.lit("https://e/"), k.cast("string"))}
    line = F.when(k % 13 == 0, _tabbed(60, at)).when(k % 3 == 0, _tabbed(62, at)).otherwise(_tabbed(61, at))
    return _lines(_t(spark, sf, "orders"), spark, "events-tsv", line, F.when(k % 17 == 0, "  "))


@q("""select cast(o_orderkey as varchar) as event_id, strftime(o_orderdate, '%Y-%m-%d') as day, concat('14', o_orderkey % 9) as cameo_code, case when o_orderkey % 5 <> 0 then cast(o_custkey % 21 - 10 as double) end as goldstein_scale, concat('https://e/', o_orderkey) as source_url
from orders where o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0""")
def q90_read_events(spark, sf):
    """IO-01, IO-02, IO-04: short rows and bad dates go, long rows are cut, bad numbers are null."""
    d = IO.read_events(spark, _events_file(spark, sf))
    return d.select("event_id", F.date_format("event_date", "yyyy-MM-dd").alias("day"), "cameo_code", "goldstein_scale", "source_url")


@q("""select cast(o_orderkey as varchar) as event_id, 'someday' as event_date from orders where o_orderkey % 11 = 0 and o_orderkey % 13 <> 0""")
def q91_rejected_events(spark, sf):
    """IO-03."""
    return IO.split_events(spark, _events_file(spark, sf))[1].select("event_id", "event_date")


@q("""select cast(l_orderkey as varchar) as event_id, concat('s', l_suppkey) as source_common_name, case when l_linenumber = 3 then 0 else l_partkey % 100 end as mention_confidence from lineitem where l_linenumber <> 4 and l_linenumber <> 5""")
def q92_read_mentions(spark, sf):
    """IO-05, IO-06: rows without an event and short rows go."""
    n = F.col("l_linenumber")
    at = {0: F.when(n == 4, "").otherwise(F.col("l_orderkey").cast("string")), 4: F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), 11: F.when(n == 3, "high").otherwise((F.col("l_partkey") % 100).cast("string"))}
    path = _lines(_t(spark, sf, "lineitem"), spark, "mentions-tsv", F.when(n == 5, _tabbed(15, at)).otherwise(_tabbed(16, at)))
    return IO.read_mentions(spark, path).select("event_id", "source_common_name", "mention_confidence")


@q("""select cast(doc_id as varchar) as global_event_id, coalesce(lang, '') as domain, concat('ECON_', coalesce(source, '')) as themes from documents where doc_id % 6 <> 0""")
def q93_read_gkg(spark, sf):
    """IO-07: 16 columns or more."""
    k = F.col("doc_id")
    at = {0: k, 3: F.col("lang"), 7: F.concat(F.lit("ECON_"), F.coalesce("source", F.lit("")))}
    path = _lines(_t(spark, sf, "documents"), spark, "gkg-tsv", F.when(k % 6 == 0, _tabbed(15, at)).when(k % 6 == 1, _tabbed(16, at)).otherwise(_tabbed(27, at)))
    return IO.read_gkg(spark, path).select("global_event_id", "domain", "themes")


@q("""with d as (select distinct cast(o_orderdate as date) d from orders) select strftime(d, '%Y-%m-%d') as day, case when day(d) % 5 > 0 then cast(day(d) as double) end as two, case when month(d) <> 2 then month(d) + 0.5 end as ten from d where day(d) % 5 > 0 or month(d) <> 2""")
def q94_read_curve(spark, sf):
    """IO-10: N/A and empty cells are left out, rows without a rate or a date go."""
    d = _t(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    two = F.when(F.day("d") % 5 > 0, F.day("d").cast("string"))
    ten = F.when(F.month("d") == 2, "N/A").otherwise(F.concat(F.month("d").cast("string"), F.lit(".5")))
    path = folder(spark, "curve-csv")
    rows = d.select(F.date_format("d", "MM/dd/yyyy").alias("Date"), two.alias("2 Yr"), ten.alias("10 Yr"))
    rows.unionByName(spark.createDataFrame([("soon", "1", "1")], rows.schema)).write.option("header", True).csv(path)
    return IO.read_curve(spark, path).select(F.date_format("fetch_time", "yyyy-MM-dd").alias("day"), F.col("term_rates")["2yr"].alias("two"), F.col("term_rates")["10yr"].alias("ten"))


@q("""select cast(s_suppkey as varchar) as ent_num, s_name as name, case when s_suppkey % 2 = 0 then 'person' else 'legalEntity' end as target_type, concat('P', s_nationkey, ',IFSR') as programs, case when s_suppkey % 3 > 0 then concat('C', s_nationkey) else '' end as country
from supplier where s_suppkey % 7 > 0 order by s_suppkey desc limit 500""")
def q95_read_sanctions(spark, sf):
    """IO-11, IO-12, J-04, S-26, S-27: the last 500, each with the first real country."""
    s = _t(spark, sf, "supplier")
    k = F.col("s_suppkey")
    num, nation = k.cast("string"), F.col("s_nationkey").cast("string")
    names, places = folder(spark, "sdn-csv"), folder(spark, "add-csv")
    kind = F.when(k % 2 == 0, "individual").otherwise("-0-")
    n = s.orderBy("s_suppkey").select(F.when(k % 7 == 0, "x").otherwise(num).alias("a"), "s_name", kind.alias("c"), F.concat(F.lit("P"), nation, F.lit("] [IFSR")).alias("d"), *[F.lit("-0-").alias(f"e{i}") for i in range(8)])
    n.write.csv(names)
    real = F.when(k % 3 > 0, F.concat(F.lit("C"), nation)).otherwise("-0- ")
    two = F.explode(F.array(F.lit("-0- "), real, F.when(k % 3 > 0, "later").otherwise("-0-")))
    s.select(num.alias("a"), F.lit("1").alias("b"), F.lit("-").alias("c"), F.lit("-").alias("d"), two.alias("e"), F.lit("-").alias("f")).write.csv(places)
    return IO.read_sanctions(spark, names, places, 500).withColumn("programs", F.array_join("programs", ","))


@q("""with d as (select o_custkey, cast(o_orderdate as date) d, max(o_orderkey) v from orders group by 1, 2)
select cast(o_custkey as varchar) as series_id, strftime(d, '%Y-%m-%d') as date, case when v % 4 > 0 then cast(v as double) end as value from d qualify row_number() over (partition by o_custkey order by d desc) <= 3""")
def q96_read_observations(spark, sf):
    """IO-14, IO-15."""
    d = _t(spark, sf, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("d")).agg(F.max("o_orderkey").alias("v"))
    path = folder(spark, "observations-json")
    d.select(F.col("o_custkey").cast("string").alias("series_id"), F.date_format("d", "yyyy-MM-dd").alias("date"), F.when(F.col("v") % 4 == 0, ".").otherwise(F.col("v").cast("string")).alias("value")).write.json(path)
    return IO.read_observations(spark, path).select("series_id", "date", "value")


@q("""select o_orderpriority as series_id, strftime(min(o_orderdate), '%Y-%m-01') as date, cast(count(*) as double) as value from orders group by o_orderpriority, date_trunc('month', o_orderdate)
union all select o_orderpriority, concat(year(o_orderdate), '-12-31'), cast(count(*) as double) from orders group by o_orderpriority, year(o_orderdate)""")
def q97_read_period_series(spark, sf):
    """IO-16, D-03: months, and M13 for a year's total."""
    o = _t(spark, sf, "orders").withColumn("year", F.date_format("o_orderdate", "yyyy"))
    month = o.groupBy("o_orderpriority", "year", F.date_format("o_orderdate", "'M'MM").alias("period")).count()
    d = month.unionByName(o.groupBy("o_orderpriority", "year").count().withColumn("period", F.lit("M13")))
    point = F.struct("year", "period", F.col("count").cast("string").alias("value"))
    series = d.groupBy(F.col("o_orderpriority").alias("seriesID")).agg(F.collect_list(point).alias("data"))  # one point a month
    path = folder(spark, "series-json")
    series.select(F.struct(F.array(F.struct("seriesID", "data")).alias("series")).alias("Results")).write.json(path)
    return IO.read_bls(spark, path).select("series_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "value")


def _feeds(spark, sf, tag: str, root: str, item):
    """A document for each region with an item for each of its nations."""
    path = folder(spark, tag)
    items = F.array_join(F.array_sort(F.collect_list(item)), "")
    d = _t(spark, sf, "nation").groupBy("n_regionkey").agg(F.concat(F.lit(f"<{root}>"), items, F.lit(f"</{root}>")).alias("value"))
    d.write.partitionBy("n_regionkey").text(path)
    return path


@q("""select n_name as title, concat('https://f/', n_nationkey) as link, concat('id', n_nationkey) as id, case when n_nationkey % 2 = 0 then 'full' else 'short' end as body, '2024-01-01' as published from nation""")
def q98_read_rss(spark, sf):
    """IO-19, D-08: RSS items."""
    k, n = F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")
    item = F.concat(F.lit("<item><title>"), "n_name", F.lit("</title><link>https://f/"), n, F.lit("</link>"), F.when(k, F.concat(F.lit("<guid>id"), n, F.lit("</guid>"))).otherwise(F.concat(F.lit("<id>id"), n, F.lit("</id>"))),
                    F.when(k, "<content>full</content>").otherwise(""), F.lit("<description>short</description>"), F.when(k, "<pubDate>2024-01-01</pubDate>").otherwise("<updated>2024-01-01</updated>"), F.lit("</item>"))
    return IO.read_feed(spark, _feeds(spark, sf, "rss-xml", "rss", item))


@q("""select n_name as title, concat('https://f/', n_nationkey) as link, concat('id', n_nationkey) as id, case when n_nationkey % 2 = 0 then 'full' else 'short' end as body, case when n_nationkey % 2 = 0 then '2024-01-01' else '2024-01-02' end as published from nation""")
def q99_read_atom(spark, sf):
    """IO-19, D-08: Atom entries."""
    k, n = F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")
    entry = F.concat(F.lit("<entry><title type='text'>"), "n_name", F.lit("</title><link href='https://f/"), n, F.lit("'/><id>id"), n, F.lit("</id><summary type='text'>short</summary>"),
                     F.when(k, "<content type='html'>full</content><published>2024-01-01</published>").otherwise(""), F.lit("<updated>2024-01-02</updated></entry>"))
    return IO.read_atom(spark, _feeds(spark, sf, "atom-xml", "feed", entry))


@q("""select concat('T', n_nationkey) as ticker, n_name as name, concat('S', n_regionkey) as sector from nation""")
def q100_read_whitelist(spark, sf):
    """IO-26, of nations."""
    n = _t(spark, sf, "nation")
    item = F.struct(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("ticker"), F.col("n_name").alias("name"), F.concat(F.lit("S"), F.col("n_regionkey").cast("string")).alias("sector"))
    path = _lines(n.agg(F.collect_list(item).alias("tickers")), spark, "whitelist-json", F.to_json(F.struct("tickers")))  # 25 nations
    return IO.read_whitelist(spark, path).select("ticker", "name", "sector")


@q("""select n_name as name, concat('https://f/', n_nationkey) as url from nation where n_nationkey % 3 <> 0 and n_nationkey % 5 <> 0""")
def q101_read_feed_list(spark, sf):
    """IO-36: enabled by default; without a url left out."""
    k = F.col("n_nationkey")
    feed = F.struct(F.col("n_name").alias("name"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("https://f/"), k.cast("string"))).alias("url"), F.when(k % 3 == 0, False).when(k % 3 == 1, True).alias("enabled"))
    path = _lines(_t(spark, sf, "nation").agg(F.collect_list(feed).alias("feeds")), spark, "feeds-json", F.to_json(F.struct("feeds")))
    return IO.read_feeds(spark, path).select("name", "url")


def _landing(spark, sf):
    d = _t(spark, sf, "documents")
    path = folder(spark, "landing-json")
    at = F.to_timestamp(F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 3 + 1).cast("string")))
    episode = F.struct(F.coalesce("text", F.lit("")).alias("episode_body"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.col("source").alias("source_type"))
    rows = d.select(F.lit(1).alias("v"), at.alias("captured_at"), F.col("doc_id").cast("string").alias("cycle_id"), episode.alias("episode"))
    IO.write_landing(rows, path, F.col("captured_at"))
    d.where("doc_id % 10 = 0").select(F.concat(F.lit('{"v": oops '), F.col("doc_id").cast("string")).alias("value")).write.mode("append").text(path + "/date=2024-01-01")
    return path


@q("""select cast(doc_id as varchar) as cycle_id, sha256(coalesce(text, '')) as content_hash, coalesce(text, '') as body, concat('2024-01-0', doc_id % 3 + 1) as day from documents""")
def q102_landing_round_trip(spark, sf):
    """IO-29: written by day and read back."""
    good, _ = IO.read_envelopes(spark, _landing(spark, sf))
    return good.select("cycle_id", "content_hash", F.col("episode_body").alias("body"), F.date_format("captured_at", "yyyy-MM-dd").alias("day"))


@q("""select concat('{"v": oops ', doc_id) as line from documents where doc_id % 10 = 0""")
def q103_landing_corrupt_lines(spark, sf):
    """X-07: lines that can't be read."""
    return IO.read_envelopes(spark, _landing(spark, sf))[1].select(F.col("_corrupt").alias("line"))


@q("""select concat('E', event_id) as event_id_cnty, strftime(ts, '%Y-%m-%d') as event_date, case when event_id % 4 > 0 then cast(event_id % 40 as integer) else 0 end as fatalities from events where cast(ts as date) >= date '2024-01-02' order by cast(ts as date) desc, concat('E', event_id) limit 500""")
def q104_read_conflicts(spark, sf):
    """IO-17; the limit is the feature."""
    k = F.col("event_id")
    item = F.struct(F.concat(F.lit("E"), k.cast("string")).alias("event_id_cnty"), F.date_format("ts", "yyyy-MM-dd").alias("event_date"), F.when(k % 4 == 0, "many").otherwise((k % 40).cast("string")).alias("fatalities"))
    path = folder(spark, "conflicts-json")
    _t(spark, sf, "events").select(F.array(item).alias("data")).write.json(path)
    return IO.read_conflicts(spark, path, F.lit("2024-01-02").cast("date")).select("event_id_cnty", "event_date", "fatalities")


@q("""select event_id as id, strftime(make_timestamp((1700000000 + event_id) * 1000000), '%Y-%m-%d %H:%M:%S') as ctime, event_type as title from events where event_id % 6 <> 0""")
def q105_read_telegraph(spark, sf):
    """IO-20: responses with an error number give nothing."""
    k = F.col("event_id")
    item = F.struct(k.alias("id"), F.col("event_type").alias("title"), (k + 1_700_000_000).alias("ctime"))
    path = folder(spark, "telegraph-json")
    _t(spark, sf, "events").select(F.when(k % 6 == 0, 7).otherwise(0).alias("errno"), F.struct(F.array(item).alias("roll_data")).alias("data")).write.json(path)
    return IO.read_telegraph(spark, path).select("id", F.date_format("ctime", "yyyy-MM-dd HH:mm:ss").alias("ctime"), "title")


@q("""select concat('N', o_orderkey) as code, o_orderpriority as title from orders where o_orderkey % 8 <> 0""")
def q106_read_jsonp(spark, sf):
    """IO-22: lines that aren't name({...}) give nothing."""
    body = F.to_json(F.struct(F.concat(F.lit("N"), F.col("o_orderkey").cast("string")).alias("code"), F.col("o_orderpriority").alias("title")))
    path = _lines(_t(spark, sf, "orders"), spark, "jsonp", F.when(F.col("o_orderkey") % 8 == 0, F.concat(F.lit("error "), body)).otherwise(F.concat(F.lit("jQuery_1("), body, F.lit(");"))))
    return IO.read_jsonp(spark, path, "code string, title string")
