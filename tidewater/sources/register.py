"""The index of landed files: registering, orphans, rebuilding, roll-ups by run, and retention of rows and files.

The landed JSON lines are the truth and the index follows from them.  All operations return tables; what they write can be
written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import ENVELOPE
from .positions import numbered_lines
from .tables import upsert

INDEX = "content_hash string, name string, source_type string, batch_file string, line_no bigint, valid_at timestamp, captured_at timestamp, cycle_id string, status string, attempts int"
RUNS = "cycle_id string, source_type string, captured_at timestamp, batch_file string, total bigint, new_rows bigint, dup_rows bigint"
ENDED = ("done", "skipped", "dead")


def batch_of(file: Column) -> Column:
    """The part of a path from its date folder on: `yyyy-MM-dd/source-cycle.jsonl`, written as date=.../batch=... by partitioned writers."""
    return F.concat_ws("/", F.regexp_extract(file, r"(?:date=)?(\d{4}-\d{2}-\d{2})/", 1), F.regexp_extract(file, r"\d{4}-\d{2}-\d{2}/(?:batch=)?([^/]+)", 1))


def landed_lines(spark: SparkSession, path: str, batch: Callable[[Column], Column] = batch_of) -> DataFrame:
    """(batch_file, line_no, v, captured_at, cycle_id, episode, bad): every line that isn't blank."""
    e = F.from_json("value", ENVELOPE + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    d = numbered_lines(spark, path).where("trim(value) <> ''").select(batch(F.col("file")).alias("batch_file"), "line_no", e.alias("e"))
    bad = F.col("e._corrupt").isNotNull() | F.col("e.episode.content_hash").isNull()
    return d.select("batch_file", "line_no", "e.v", "e.captured_at", "e.cycle_id", "e.episode", bad.alias("bad"))


def orphans(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """J-13: lines of files that no run names."""
    return lines.join(runs.select("batch_file").distinct(), "batch_file", "left_anti")


def register(lines: DataFrame, index: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """X-07: (new index rows, a run for each file). Of equal hashes the first line of the first file counts, and known ones stay as they are.

    Lines that can't be read count in total, and so among the repeats.  A file without one that can be read has cycle and source from its name.
    """
    good = lines.where("not bad")
    place = F.struct("batch_file", "line_no")
    row = F.struct(F.col("episode.name").alias("name"), F.col("episode.source_type").alias("source_type"), "batch_file", "line_no", F.col("episode.valid_at").alias("valid_at"), "captured_at", "cycle_id")
    first = good.groupBy(F.col("episode.content_hash").alias("content_hash")).agg(F.min_by(row, place).alias("r"))
    new = first.select("content_hash", "r.*").join(index.select("content_hash"), "content_hash", "left_anti").withColumns({"status": F.lit("pending"), "attempts": F.lit(0)})
    told = F.min_by(F.struct("cycle_id", "captured_at", F.col("episode.source_type").alias("source_type")), F.when(~F.col("bad"), F.col("line_no")))
    files = lines.groupBy("batch_file").agg(F.count("*").alias("total"), told.alias("t"))
    counts = new.groupBy("batch_file").agg(F.count("*").alias("new_rows"))
    stem = F.regexp_extract("batch_file", r"([^/]+?)(?:\.jsonl)?$", 1)
    cycle, source = F.regexp_extract(stem, r"-([^-]*)$", 1), F.regexp_extract(stem, r"^(.*)-[^-]*$", 1)
    n = F.coalesce("new_rows", F.lit(0).cast("long"))
    runs = files.join(counts, "batch_file", "left").select(
        F.coalesce("t.cycle_id", cycle).alias("cycle_id"), F.coalesce("t.source_type", source).alias("source_type"), F.coalesce("t.captured_at", now).alias("captured_at"),
        "batch_file", "total", n.alias("new_rows"), (F.col("total") - n).alias("dup_rows"),
    )
    return new, runs


def rebuild(lines: DataFrame, index: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """X-07: (index, runs) from all files; rows that the index has keep their status (quirk Q20)."""
    new, runs = register(lines, index, now)
    return index.unionByName(new), runs


def upsert_runs(spark: SparkSession, path: str, runs: DataFrame) -> DataFrame:
    """A-03: replaces the runs of equal (cycle_id, source_type) in a table partitioned by cycle_id; only cycles that changed are rewritten.

    Of several new runs of one key the last file counts.  Writing the same runs again changes nothing.  The table so far.
    """
    key = ["cycle_id", "source_type"]
    rest = [c for c in runs.columns if c not in key]
    new = runs.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_file").alias("x")).select(*key, "x.*")
    return upsert(spark, path, new.select(*runs.columns), key, "cycle_id")


def sweep(index: DataFrame, cutoff: Column) -> DataFrame:
    """X-10: the index without rows captured before the cut-off that have ended; rows still to be written stay."""
    return index.where(~((F.col("captured_at") < cutoff) & F.col("status").isin(*ENDED)))


def unreferenced(files: DataFrame, index: DataFrame, cutoff: Column) -> DataFrame:
    """X-10, J-16: files (batch_file, ...) of days before the cut-off's that no row of the swept index names."""
    old = files.where(F.split_part("batch_file", F.lit("/"), F.lit(1)) < F.date_format(cutoff, "yyyy-MM-dd"))
    return old.join(index.select("batch_file").distinct(), "batch_file", "left_anti")


def delete_paths(spark: SparkSession, paths: DataFrame) -> int:
    """Deletes the paths of the first column, folders with what is in them; how many there were. Names come to the driver one partition at a time."""
    jvm, n = spark._jvm, 0
    conf = spark._jsc.hadoopConfiguration()
    for (p,) in paths.select(paths.columns[0]).toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(p)
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def remove_leftovers(spark: SparkSession, root: str, pattern: str = "*/*.tmp") -> int:
    """X-08: deletes what writers have left half-written; how many."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{pattern}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(bool(fs.delete(s.getPath(), True)) for s in fs.globStatus(path) or ())
