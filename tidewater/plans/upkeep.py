"""Registered queries of the queue's upkeep: the stream of its states, the register of landed files, file order and archives."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators import state as Q
from ..sources import files as IO
from ..sources import positions as P
from ..sources import register as G
from .registry import folder, q
from .registry import table as _t

START = "timestamp '2024-01-01 00:00:00'"
# by the remainder of the key: what happens, at which minute, by whom, until when
PHASES = (
    ((None, 0, "capture", None, None), (None, 1, "claim", "w1", 16), (0, 2, "done", "w1", None), (1, 2, "skip", "w1", None), (2, 2, "fail", "w1", None), (4, 2, "done", "w2", None), (5, 2, "fail", "w1", None)),
    ((None, 30, "claim", "w2", 45), (2, 31, "done", "w2", None), (3, 31, "done", "w1", None), (4, 31, "skip", "w2", None), (5, 31, "fail", "w2", None)),
    ((5, 80, "claim", "w3", 95), (5, 81, "fail", "w3", None)),
)


def _commands(customers, phase):
    at = lambda m: F.expr(f"{START} + interval {m} minutes")
    kinds = F.array(*[
        F.struct(F.lit(k).cast("int").alias("k"), at(m).alias("at"), F.lit(kind).alias("kind"), F.lit(owner).cast("string").alias("owner"), (at(until) if until else F.lit(None).cast("timestamp")).alias("until"))
        for k, m, kind, owner, until in phase
    ])
    d = customers.select("c_custkey", F.explode(kinds).alias("x")).where("x.k is null or x.k = c_custkey % 6")
    return d.select(F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("content_hash"), "x.at", "x.kind", "x.owner", "x.until")


@q("""select concat('h', c_custkey) as content_hash, case c_custkey % 6 when 0 then 2 when 1 then 2 when 2 then 5 when 3 then 4 when 4 then 4 else 8 end as seq,
case c_custkey % 6 when 0 then 'done' when 1 then 'skipped' when 2 then 'done' when 3 then 'pending' when 4 then 'skipped' else 'dead' end as status, case c_custkey % 6 when 2 then 1 when 5 then 3 else 0 end as attempts from customer""")
def q117_queue_as_stream(spark, sf):
    """X-02 to X-06, §2.11: claims, outcomes, lapsed leases and back-offs as a stream with timers, in two runs from one checkpoint."""
    from ..streaming.queue import COMMAND, run_queue

    base, keys = folder(spark, "queue-stream"), _t(spark, sf, "customer")

    def run():
        return run_queue(spark.readStream.schema(COMMAND).option("maxFilesPerTrigger", 8).parquet(f"{base}/in"), f"{base}/state", f"{base}/log", most=3, late="10 minutes")

    _commands(keys, PHASES[0]).write.parquet(f"{base}/in")
    run()
    for phase in PHASES[1:]:
        _commands(keys, phase).write.mode("append").parquet(f"{base}/in")
    tick = spark.range(1).selectExpr("cast(null as string) content_hash", f"{START} + interval 1 day as at", "'tick' as kind", "cast(null as string) owner", "cast(null as timestamp) until")
    tick.write.mode("append").parquet(f"{base}/in")
    return Q.current(run()).select("content_hash", "seq", "status", "attempts")


# landed files: three days, four cycles; every tenth line can't be read, every seventh has an empty line behind it
_FILES = """docs as (select doc_id, sha256(coalesce(text, '')) as h, concat('2024-01-0', doc_id % 3 + 1, '/S', doc_id % 2, '-c', doc_id % 4, '.jsonl') as batch_file, doc_id % 4 as c, doc_id % 10 = 0 as bad from documents),
lines as (select *, coalesce(sum(case when doc_id % 7 = 0 then 2 else 1 end) over (partition by batch_file order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as line_no from docs),
known as (select h, min({'f': batch_file, 'n': line_no}) as p from lines where not bad and c < 2 group by h),
added as (select h, min({'f': batch_file, 'n': line_no}) as p from lines where not bad and c >= 2 and h not in (select h from known) group by h),
idx as (select *, 'done' as status from known union all select *, 'pending' from added)"""


def _landed(spark, sf):
    d, k = _t(spark, sf, "documents"), F.col("doc_id")
    n = lambda m: (k % m).cast("string")
    text = F.coalesce("text", F.lit(""))
    episode = F.struct(F.lit("b").alias("episode_body"), F.concat(F.lit("n"), k.cast("string")).alias("name"), F.concat(F.lit("S"), n(2)).alias("source_type"), F.sha2(text, 256).alias("content_hash"))
    date = F.concat(F.lit("2024-01-0"), (k % 3 + 1).cast("string"))
    envelope = F.to_json(F.struct(F.lit(1).alias("v"), F.concat(date, F.lit("T00:00:00Z")).alias("captured_at"), F.concat(F.lit("c"), n(4)).alias("cycle_id"), episode.alias("episode")))
    line = F.concat(F.when(k % 10 == 0, F.concat(F.lit('{"v": oops '), k.cast("string"))).otherwise(envelope), F.when(k % 7 == 0, "\n").otherwise(""))
    path = folder(spark, "landed-jsonl")
    rows = d.select("doc_id", date.alias("date"), F.concat(F.lit("S"), n(2), F.lit("-c"), n(4), F.lit(".jsonl")).alias("batch"), line.alias("value"))
    rows.repartition("date", "batch").sortWithinPartitions("date", "batch", "doc_id").drop("doc_id").write.partitionBy("date", "batch").text(path)
    return path


def _registered(spark, path):
    """(all lines, index and runs of the first two cycles); the index's rows have been written."""
    lines = G.landed_lines(spark, path)
    none = spark.createDataFrame([], G.INDEX)
    index, runs = G.register(lines.where("batch_file like '%-c0.jsonl' or batch_file like '%-c1.jsonl'"), none, F.expr(START))
    return lines, index.withColumn("status", F.lit("done")), runs


@q(f"with {_FILES} select h as content_hash, p.f as batch_file, p.n as line_no from known")
def q118_register_files(spark, sf):
    """X-07, IO-30: every hash at the first line that has it, with its number in the file."""
    return _registered(spark, _landed(spark, sf))[1].select("content_hash", "batch_file", "line_no")


@q(f"""with {_FILES}, n as (select p.f as f, count(*) as n from added group by 1)
select batch_file, concat('c', any_value(c)) as cycle_id, split_part(split_part(batch_file, '/', 2), '-', 1) as source_type, count(*) as total, coalesce(any_value(n.n), 0) as new_rows, count(*) - coalesce(any_value(n.n), 0) as dup_rows
from lines left join n on n.f = batch_file where c >= 2 group by batch_file""")
def q119_orphan_files(spark, sf):
    """X-07, J-13: files that no run names are registered; lines that can't be read count in total."""
    lines, index, runs = _registered(spark, _landed(spark, sf))
    return G.register(G.orphans(lines, runs), index, F.expr(START))[1].drop("captured_at")


@q(f"with {_FILES} select h as content_hash, p.f as batch_file, p.n as line_no, status from idx")
def q120_rebuilt_index_keeps_status(spark, sf):
    """X-07 (quirk Q20)."""
    lines, index, _ = _registered(spark, _landed(spark, sf))
    return G.rebuild(lines, index, F.expr(START))[0].select("content_hash", "batch_file", "line_no", "status")


@q(f"""with {_FILES}, kept as (select p.f as f from idx where not (p.f < '2024-01-03' and (status = 'done' or h[1:2] <> '00')))
select batch_file, count(*) as n from lines where batch_file >= '2024-01-03' or batch_file in (select f from kept) group by 1""")
def q121_retention_of_files(spark, sf):
    """X-10, J-16: what is left on disk; a file with one row still to be written stays."""
    path = _landed(spark, sf)
    lines, index, _ = _registered(spark, path)
    index = G.rebuild(lines, index, F.expr(START))[0].withColumn("status", F.expr("case when status = 'pending' and left(content_hash, 2) <> '00' then 'skipped' else status end"))
    cutoff = F.expr("timestamp '2024-01-03 00:00:00'")
    gone = G.unreferenced(lines.select("batch_file").distinct(), G.sweep(index, cutoff), cutoff)
    G.delete_paths(spark, gone.select(F.concat(F.lit(f"{path}/date="), F.regexp_replace("batch_file", "/", "/batch="))))
    return G.landed_lines(spark, path).groupBy("batch_file").agg(F.count("*").alias("n"))


@q(f"""with {_FILES}, n as (select p.f as f, count(*) as n from added group by 1), r as (select batch_file, c, count(*) as total from lines group by 1, 2 qualify row_number() over (partition by c order by batch_file desc) = 1)
select concat('c', c) as cycle_id, concat('S', c % 2) as source_type, batch_file, total, case when c < 2 then 0 else coalesce(n.n, 0) end as new_rows, total - case when c < 2 then 0 else coalesce(n.n, 0) end as dup_rows from r left join n on n.f = r.batch_file""")
def q122_run_rollup_upsert(spark, sf):
    """A-03, X-01: two captures of the first cycles, each written twice, leave one row for a cycle and source."""
    lines, index, runs = _registered(spark, _landed(spark, sf))
    path = folder(spark, "capture-runs")
    again = G.register(lines, index, F.expr(START))[1]
    for r in (runs, runs, again, again):
        out = G.upsert_runs(spark, path, r)
    return out.drop("captured_at")


@q("""select concat('P', p_partkey % 5000) as code, arg_max(concat(p_name, case when p_partkey % 3 = 0 then concat(' more ', p_partkey) else '' end), p_partkey) as text from part group by 1""")
def q123_codebook_records(spark, sf):
    """IO-35: records over several lines; of equal codes the last in file order."""
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    path = folder(spark, "codebook-txt")
    entry = F.concat(F.lit("P"), (k % 5000).cast("string"), F.lit("\t "), "p_name")
    lines = F.array_compact(F.array(F.when(k % 4 == 0, "# note"), entry, F.when(k % 5 == 0, "[see below]"), F.when(k % 3 == 0, F.concat(F.lit("  more "), n)), F.when(k % 7 == 0, "")))
    _t(spark, sf, "part").orderBy("p_partkey").select(F.array_join(lines, "\n").alias("value")).write.text(path)
    return P.read_codebook(spark, path)


_FRAME = """select '{i}' as indicator, strftime({date}, '%Y-%m-%d') as date, {value} as value, {raw} as raw_value, {text} as date_str from (select *, o_orderkey as k from orders order by o_orderkey {way} limit {n}) where k % 5 <> 1"""
_YM = "make_date(2000 + k % 25, k % 12 + 1, 1)"


@q(" union all ".join([
    _FRAME.format(i="gdp", date="make_date(2000 + k % 25, 3 * (k % 4 + 1), 1)", value="cast(k % 10 as double)", raw="cast(k as double)", text="concat(2000 + k % 25, '年第', k % 4 + 1, '季度')", way="", n=8),
    *[_FRAME.format(i=i, date=_YM, value="cast(k % 10 as double)", raw="null", text="concat(2000 + k % 25, '年', lpad(cast(k % 12 + 1 as varchar), 2, '0'), '月份')", way="", n=12) for i in ("cpi", "pmi")],
    *[_FRAME.format(i=i, date="o_orderdate", value="case when k % 9 > 0 then cast(k % 10 as double) end", raw="null", text="strftime(o_orderdate, '%Y-%m-%d')", way="desc", n=12) for i in ("ppi", "caixin_pmi")],
]))
def q124_macro_frames(spark, sf):
    """IO-18, U-01, T-08: the newest rows at the head or the tail of files in many splits; rows without a date go, 0 stays."""
    o, k = _t(spark, sf, "orders").orderBy("o_orderkey"), F.col("o_orderkey")
    year, value = (k % 25 + 2000).cast("string"), (k % 10).cast("string")
    dates = {
        "季度": F.concat(year, F.lit("年第"), (k % 4 + 1).cast("string"), F.lit("季度")),
        "月份": F.concat(year, F.lit("年"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("月份")), "日期": F.date_format("o_orderdate", "yyyy-MM-dd"),
    }
    paths = {}
    for indicator, (day, number, raw, end, _) in P.FRAMES.items():
        paths[indicator] = folder(spark, f"frame-{indicator}")
        shown = F.when(k % 9 == 0, "").otherwise(value) if end == "tail" else value
        columns = [F.when(k % 5 == 1, "soon").otherwise(dates[day]).alias(day), shown.alias(number)] + ([k.cast("string").alias(raw)] if raw else [])
        o.select(*columns).write.option("header", True).csv(paths[indicator])
    return P.read_macro_frames(spark, paths).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def _zipped(lines: pd.Series) -> pd.Series:
    def one(x: list) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("readme.txt", "no")
            z.writestr("data.CSV", "\r\n".join(x))
        return out.getvalue()

    return lines.map(one)


@q("""select concat('a', c_custkey // 50) as path, case when (c_custkey // 50) % 3 = 0 then 0 else count(*) end as n_lines, case when (c_custkey // 50) % 3 = 0 then 'BadZipFile' end as error,
case when (c_custkey // 50) % 3 <> 0 then min(c_name) end as first from customer group by c_custkey // 50""")
def q125_archives(spark, sf):
    """IO-09: an archive that can't be read costs its own rows only, and is told."""
    k = F.floor(F.col("c_custkey") / 50)
    groups = _t(spark, sf, "customer").groupBy(k.alias("k")).agg(F.array_sort(F.collect_list("c_name")).alias("lines"))  # 50 an archive
    zipped = F.pandas_udf(_zipped, "binary")("lines")
    archives = groups.select(F.concat(F.lit("a"), F.col("k").cast("string")).alias("path"), F.when(F.col("k") % 3 == 0, F.substring(zipped, 1, 40)).otherwise(zipped).alias("content"))
    lines = IO.archive_lines(archives)
    return IO.archive_report(lines).join(lines.where("line_no = 0").select("path", F.col("value").alias("first")), "path", "left")
