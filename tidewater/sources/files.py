"""Readers and writers of landed files, all with explicit schemas."""

from __future__ import annotations

import io
import itertools
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .positions import with_position

LINES = 10_000

# Positions of the columns used.
EVENT_COLUMNS = {"event_id": 0, "event_date": 1, "actor1_code": 5, "actor1_name": 6, "actor2_code": 15, "actor2_name": 16, "cameo_code": 26, "goldstein_scale": 30, "avg_tone": 34, "lat": 40, "lon": 41, "source_url": 60}
MENTION_COLUMNS = {"event_id": 0, "mention_time": 2, "mention_type": 3, "source_common_name": 4, "document_identifier": 5, "mention_confidence": 11}
GKG_COLUMNS = {"global_event_id": 0, "valid_at": 1, "source_collection": 2, "domain": 3, "source_url": 4, "counts": 5, "themes": 7, "locations": 9, "persons": 11, "organizations": 13, "tone": 15}
CURVE_COLUMNS = {"1 Mo": "1mo", "2 Mo": "2mo", "3 Mo": "3mo", "4 Mo": "4mo", "6 Mo": "6mo", "1 Yr": "1yr", "2 Yr": "2yr", "3 Yr": "3yr", "5 Yr": "5yr", "7 Yr": "7yr", "10 Yr": "10yr", "20 Yr": "20yr", "30 Yr": "30yr"}
ENVELOPE = "v int, captured_at timestamp, cycle_id string, episode struct<episode_body:string,name:string,source_type:string,source_url:string,valid_at:timestamp,content_hash:string,severity:string,keywords:array<string>,metadata:map<string,string>>"


def _tsv(spark: SparkSession, path: str, columns: dict[str, int], least: int) -> DataFrame:
    """Rows of at least `least` fields; longer rows are cut, blank and short ones dropped. Zips are read in place."""
    f = F.split("value", "\t", -1)
    lines = zipped_lines(spark, path) if path.lower().endswith(".zip") else spark.read.text(path)
    raw = lines.where(F.trim("value") != "").withColumn("_f", f).where(F.size("_f") >= least)
    return raw.select(*[F.trim(F.get("_f", F.lit(i))).alias(n) for n, i in columns.items()])


ARCHIVE = "path string, line_no bigint, value string, error string"


def _unzip(batches):
    """(path, content) -> the lines of the first .csv in each archive, and a row with the error for one that can't be read to its end."""
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            row = lambda lines, at, error: pa.RecordBatch.from_arrays(
                [pa.array([path] * len(lines), pa.string()), pa.array(at, pa.int64()), pa.array(lines, pa.string()), pa.array([error] * len(lines), pa.string())], names=["path", "line_no", "value", "error"])  # noqa: B023
            n = 0
            try:
                z = zipfile.ZipFile(io.BytesIO(content.as_py() or b""))
                name = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
                if name is None:
                    yield row([None], [None], "no csv")
                    continue
                with z.open(name) as f:
                    lines = io.TextIOWrapper(f, "utf-8", errors="replace", newline="\n")
                    while part := [x.rstrip("\r\n") for x in itertools.islice(lines, LINES)]:
                        yield row(part, range(n, n + len(part)), None)
                        n += len(part)
            except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
                yield row([None], [None], type(e).__name__)


def archive_lines(archives: DataFrame) -> DataFrame:
    """IO-09: (path, line_no, value, error) of archives (path, content); one task holds an archive's compressed bytes, never its whole text.

    An archive that fails gives a row with its error; lines read before a fault in its middle are given too, and a user who wants
    whole archives only drops those of paths with an error.
    """
    return archives.select("path", "content").mapInArrow(_unzip, ARCHIVE)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return archive_lines(spark.read.format("binaryFile").load(path))


def archive_report(lines: DataFrame) -> DataFrame:
    """IO-09: (path, n_lines, error), a row for each archive that gave lines or an error."""
    return lines.groupBy("path").agg(F.count("value").alias("n_lines"), F.max("error").alias("error"))


def zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """IO-09: column value, the lines of landed zips that can be read."""
    return read_archives(spark, path).where("error is null").select("value")


def read_manifest_archives(spark: SparkSession, manifest: str, folder: str) -> dict[str, DataFrame]:
    """IO-08, IO-09: archive_lines of the three archives that a manifest lists, by kind, from where they have landed.

    The kinds are those of the names' middle parts: export, mentions and gkg.
    """
    names = [u.rsplit("/", 1)[-1] for u in read_manifest(spark, manifest)]
    kind = lambda n: next((k for k in ("export", "mentions", "gkg") if f".{k}." in n.lower()), n)
    return {kind(n): read_archives(spark, f"{folder.rstrip('/')}/{n}") for n in names}


def read_manifest(spark: SparkSession, path: str) -> list[str]:
    """IO-08: the urls of the first three lines of at least three fields, third a url; ValueError if there are fewer lines or one is bad.

    A manifest is three lines, so it comes to the driver.
    """
    lines = [r.value.split() for r in spark.read.text(path).where(F.trim("value") != "").limit(3).collect()]
    ok = len(lines) == 3 and all(len(x) >= 3 and x[2].startswith("http") for x in lines)
    if not ok:
        raise ValueError(f"not a manifest: {path}")
    return [x[2] for x in lines]


def split_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """IO-03: events, and the rows whose date can't be read, all their fields as text."""
    d = _tsv(spark, path, EVENT_COLUMNS, 61).withColumn("_day", S.day(F.col("event_date")))
    good = d.where("_day is not null").withColumns({c: S.safe_double(F.col(c)) for c in ("goldstein_scale", "avg_tone", "lat", "lon")} | {"event_date": F.col("_day")})
    return good.drop("_day"), d.where("_day is null").drop("_day")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """IO-01 to IO-04: 61 columns; rows with a bad date go."""
    return split_events(spark, path)[0]


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    """IO-05, IO-06: 16 columns; rows without event go, bad numbers are 0."""
    d = _tsv(spark, path, MENTION_COLUMNS, 16).where("event_id <> ''")
    return d.withColumns({c: S.safe_int(F.col(c)) for c in ("mention_type", "mention_confidence")})


def read_gkg(spark: SparkSession, path: str) -> DataFrame:
    """IO-07: 16 columns or more."""
    return _tsv(spark, path, GKG_COLUMNS, 16)


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    """IO-10: (fetch_time, term_rates); N/A and empty cells left out, rows of a bad date or no rate go."""
    head = spark.read.option("header", True).option("inferSchema", False).csv(path)
    there = [c for c in CURVE_COLUMNS if c in head.columns]
    rates = F.map_from_arrays(F.array(*[F.lit(CURVE_COLUMNS[c]) for c in there]), F.array(*[S.safe_double(F.col(f"`{c}`")) for c in there]))
    d = head.select(F.try_to_timestamp(F.col("Date"), F.lit("MM/dd/yyyy")).alias("fetch_time"), F.map_filter(rates, lambda k, v: v.isNotNull()).alias("term_rates"))
    return d.where(F.col("fetch_time").isNotNull() & (F.size("term_rates") > 0)).orderBy(F.desc("fetch_time"))


def read_sanctions(spark: SparkSession, names: str, addresses: str, most: int = 3000) -> DataFrame:
    """IO-11, IO-12, J-04: the last `most` entities in the order of the files, the last first, with programs and the first real country."""
    n = spark.read.schema("ent_num string, name string, kind string, program string, " + ", ".join(f"x{i} string" for i in range(8))).csv(names)
    n = with_position(n, "line").where(F.rlike("ent_num", F.lit("^[0-9]+$")) & (F.coalesce("name", F.lit("")) != ""))
    n = n.orderBy(F.desc("line")).limit(most)
    a = spark.read.schema("ent_num string, add_num string, address string, city string, country string, remarks string").csv(addresses)
    a = with_position(a, "line").where("trim(country) not in ('-0-', '')")
    a = a.groupBy("ent_num").agg(F.min_by(F.trim("country"), "line").alias("country"))
    d = n.join(a, "ent_num", "left").orderBy(F.desc("line"))
    return d.select("ent_num", "name", S.target_type(F.col("kind")).alias("target_type"), S.programs(F.col("program")).alias("programs"), F.coalesce("country", F.lit("")).alias("country"))


def read_observations(spark: SparkSession, path: str, n: int = 3) -> DataFrame:
    """IO-14, IO-15: JSON observations of series, the newest n of each."""
    from pyspark.sql import Window

    d = spark.read.schema("series_id string, date string, value string, units string, name string, topic string").json(path)
    w = Window.partitionBy("series_id").orderBy(F.desc("date"))
    return d.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r").withColumn("value", S.safe_double(F.col("value")))


def read_bls(spark: SparkSession, path: str) -> DataFrame:
    """IO-16, D-03."""
    schema = "Results struct<series:array<struct<seriesID:string,data:array<struct<year:string,period:string,value:string>>>>>"
    d = spark.read.schema(schema).json(path).select(F.explode("Results.series").alias("s")).select(F.col("s.seriesID").alias("series_id"), F.explode("s.data").alias("x"))
    return d.select("series_id", S.period_date(F.col("x.year"), F.col("x.period")).alias("date"), S.safe_double(F.col("x.value")).alias("value"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """IO-19, D-08: feed items; content before summary, published before updated."""
    schema = "title string, link string, guid string, id string, description string, summary string, content string, pubDate string, published string, updated string"
    d = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return d.select("title", "link", F.coalesce("guid", "id").alias("id"), F.coalesce("content", "description", "summary").alias("body"), F.coalesce("pubDate", "published", "updated").alias("published"))


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """IO-19, D-08: Atom entries; content before summary, published before updated."""
    text = "struct<_VALUE:string,_type:string>"
    schema = f"title {text}, link struct<_href:string>, id string, summary {text}, content {text}, published string, updated string"
    d = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    return d.select(F.col("title._VALUE").alias("title"), F.col("link._href").alias("link"), "id", F.coalesce("content._VALUE", "summary._VALUE").alias("body"), F.coalesce("published", "updated").alias("published"))


def read_conflicts(spark: SparkSession, path: str, since: Column, most: int = 500) -> DataFrame:
    """IO-17: conflict events from a day on, the newest `most`."""
    item = "struct<event_id_cnty:string,event_date:string,event_type:string,country:string,admin1:string,actor1:string,actor2:string,fatalities:string,notes:string,latitude:string,longitude:string>"
    d = spark.read.schema(f"data array<{item}>").json(path).select(F.inline("data"))
    d = d.where(F.to_date("event_date") >= since).withColumn("fatalities", S.safe_int(F.col("fatalities")))
    return d.orderBy(F.desc("event_date"), "event_id_cnty").limit(most)


def read_telegraph(spark: SparkSession, path: str) -> DataFrame:
    """IO-20, D-07: items of responses without an error number."""
    item = "struct<id:bigint,title:string,brief:string,content:string,shareurl:string,ctime:bigint,level:string>"
    d = spark.read.schema(f"errno int, data struct<roll_data:array<{item}>>").json(path).where("errno = 0")
    return d.select(F.inline("data.roll_data")).withColumn("ctime", S.from_epoch(F.col("ctime")))


def read_jsonp(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """IO-22: responses of the form name({...}), one a line."""
    inner = F.regexp_extract("value", r"^[^({\[]*\((.*)\)\s*;?\s*$", 1)
    return spark.read.text(path).select(F.from_json(inner, schema).alias("x")).where("x is not null").select("x.*")


def read_listed_sanctions(spark: SparkSession, path: str, now: Column, days: int) -> DataFrame:
    """IO-13: results of search responses, the first of each list; entries listed more than `days` days ago go, those without a day stay."""
    lists = ("countries", "programs", "topics", "first_seen", "start_date")
    item = "struct<id:string,caption:string,schema:string,properties:struct<" + ",".join(f"{c}:array<string>" for c in lists) + ">>"
    d = spark.read.schema(f"results array<{item}>").json(path).select(F.inline("results"))
    some = lambda c: F.when(F.size(f"properties.{c}") > 0, F.col(f"properties.{c}"))
    first = lambda *cs: F.get(F.coalesce(*[some(c) for c in cs]), F.lit(0))
    listed = first("first_seen", "start_date")
    url = F.when(F.coalesce("id", F.lit("")) != "", F.concat(F.lit("https://www.opensanctions.org/entities/"), "id", F.lit("/")))
    d = d.select(
        F.coalesce("caption", F.lit("")).alias("entity_name"), F.when(F.lower("schema") == "person", "person").otherwise("legalEntity").alias("target_type"), F.coalesce(first("countries"), F.lit("")).alias("country"),
        F.coalesce(first("programs", "topics"), F.lit("")).alias("sanction_program"), listed.alias("listing_date"), url.alias("source_url"), F.lit("opensanctions").alias("source"),
    )
    day = F.try_to_timestamp(F.left("listing_date", F.lit(10)), F.lit("yyyy-MM-dd"))
    return d.where(day.isNull() | (day >= now - F.make_dt_interval(F.lit(days))))


def read_announcements(spark: SparkSession, path: str, listed: DataFrame) -> DataFrame:
    """IO-21: announcements of responses (asked, announcements); what a response lacks comes from the list (biz_code, name) by the code asked for."""
    item = "struct<announcementId:string,announcementTitle:string,secCode:string,secName:string,announcementTime:string,adjunctUrl:string,announcementType:string>"
    d = spark.read.schema(f"asked string, announcements array<{item}>").json(path).select("asked", F.inline("announcements"))
    d = d.join(listed.select(F.col("biz_code").alias("asked"), "name").dropDuplicates(["asked"]), "asked", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias
    return d.select(
        F.col("announcementId").alias("ann_id"), text("announcementTitle")("title"), F.coalesce("secCode", "asked").alias("sec_code"), F.coalesce("secName", "name", F.lit("")).alias("sec_name"),
        text("announcementTime")("ann_date"), text("adjunctUrl")("adjunct_url"), text("announcementType")("category"), S.exchange_of(F.col("asked")).alias("exchange"),
    )


def read_research(spark: SparkSession, path: str, now: Column, days: int = 30) -> DataFrame:
    """IO-23: reports of responses (asked, data) published in the last `days` days, to the microsecond where the time has a fraction."""
    names = {"infoCode": "info_code", "title": "title", "stockName": "stock_name", "stockCode": "stock_code", "orgSName": "org_name", "researcher": "author", "emRatingName": "rating", "publishDate": "publish_date", "encodeUrl": "encode_url", "abstract": "abstract"}
    d = spark.read.schema("asked string, data array<struct<" + ",".join(f"{c}:string" for c in names) + ">>").json(path).select("asked", F.inline("data"))
    d = d.select(*[F.coalesce(c, F.col("asked") if c == "stockCode" else F.lit("")).alias(n) for c, n in names.items()])
    day = F.try_to_timestamp(F.regexp_extract("publish_date", r"^.{19}(?:\.\d{1,6})?", 0), F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS]"))
    return d.where((day >= now - F.make_dt_interval(F.lit(days))) & (day <= now))


def read_stock_news(spark: SparkSession, path: str, listed: DataFrame) -> DataFrame:
    """IO-24: news frames (symbol and Chinese or English columns) as CSV, with the listed share's names by its code."""
    columns = {"title": "新闻标题", "content": "新闻内容", "time": "发布时间", "source": "文章来源", "link": "新闻链接"}
    d = spark.read.option("header", True).option("escape", '"').csv(path)
    of = lambda en, zh: F.coalesce(*[F.col(f"`{c}`") for c in (zh, en) if c in d.columns], F.lit("")).alias(en)
    d = d.select(*[of(en, zh) for en, zh in columns.items()], "symbol")
    share = listed.select(F.col("biz_code").alias("symbol"), F.col("name").alias("ticker_name"), F.col("ticker").alias("ticker_full"), "sector", "exchange").dropDuplicates(["symbol"])
    return d.join(share, "symbol", "inner")


def duplicate_listings(listed: DataFrame) -> DataFrame:
    """IO-26: names that the whitelist has more than once, with how often and the ticker that counts, the last."""
    return listed.groupBy("name").agg(F.count("*").alias("n"), F.max_by("ticker", "pos").alias("ticker")).where("n > 1")


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """IO-26: {"tickers": [...]} or [...]."""
    item = "struct<ticker:string,sector:string,biz_code:string,name:string,exchange:string>"
    t = spark.read.option("wholetext", True).text(path).select(F.trim("value").alias("v"))
    listed = F.coalesce(F.from_json("v", f"struct<tickers:array<{item}>>")["tickers"], F.when(F.startswith("v", F.lit("[")), F.from_json("v", f"array<{item}>")))
    return t.select(F.posexplode(listed).alias("pos", "x")).select("x.*", "pos")


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """IO-36: enabled feeds with a url."""
    d = spark.read.schema("feeds array<struct<name:string,url:string,enabled:boolean>>").option("multiLine", True).json(path)
    return d.select(F.inline("feeds")).where("coalesce(enabled, true) and coalesce(url, '') <> ''").drop("enabled")


def read_envelopes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """IO-29, X-07: landed episodes, and the lines that can't be read."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where("trim(value) <> ''")
    e = F.from_json("value", ENVELOPE + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    d = lines.withColumn("e", e)
    return d.where("e._corrupt is null").select("e.v", "e.captured_at", "e.cycle_id", "e.episode.*", "file"), d.where("e._corrupt is not null").select("e._corrupt", "file")


def write_landing(df: DataFrame, path: str, day: Column) -> None:
    """IO-29: append by capture day."""
    df.withColumn("date", F.date_format(day, "yyyy-MM-dd")).write.mode("append").partitionBy("date").json(path)


def write_table(df: DataFrame, path: str) -> None:
    """IO-27, IO-31: replace as a whole."""
    df.write.mode("overwrite").parquet(path)
