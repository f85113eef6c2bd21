"""Order of rows in files: by file, split and row, the same however files are cut into splits and dealt to tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def with_position(scan: DataFrame, name: str = "position") -> DataFrame:
    """T-08: adds (file, block, row) to a fresh scan of files; rows in this order are in the order of the sorted files.

    One task reads a split from its start to its end, so ids grow within it.
    """
    m = F.col("_metadata")
    return scan.withColumn(name, F.struct(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row")))


def head(placed: DataFrame, n: int, name: str = "position") -> DataFrame:
    """The first n rows of all files."""
    return placed.orderBy(name).limit(n)


def tail(placed: DataFrame, n: int, name: str = "position") -> DataFrame:
    """The last n rows of all files."""
    return placed.orderBy(F.desc(name)).limit(n)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, line_no): every line of text files with its number in the file, from 0.

    Splits are counted, the counts added up along each file, and only these sums meet the lines again.
    """
    lines = with_position(spark.read.text(path)).select("value", "position.*")
    w = Window.partitionBy("file").orderBy("block")
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first")).withColumn("before", F.sum("n").over(w) - F.col("n"))
    return lines.join(splits, ["file", "block"]).select("value", "file", "block", (F.col("before") + F.col("row") - F.col("first")).alias("line_no"))


def joined_records(lines: DataFrame, starts: Column, glue: str = " ") -> DataFrame:
    """IO-35: (file, line_no, value): each line that starts a record with the lines after it up to the next start; lines before the first start go.

    A line's record is the last start in its split, or else the last one in an earlier split, so no file is ordered in one task.
    """
    d = lines.withColumn("start", F.when(starts, F.col("line_no")))
    within = Window.partitionBy("file", "block").orderBy("line_no")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = d.groupBy("file", "block").agg(F.max("start").alias("last")).select("file", "block", F.max("last").over(before).alias("carried"))
    d = d.withColumn("own", F.last("start", ignorenulls=True).over(within)).join(carried, ["file", "block"]).withColumn("record", F.coalesce("own", "carried"))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "value")))
    d = d.where("record is not null").groupBy("file", "record").agg(parts.alias("parts"))
    return d.select("file", F.col("record").alias("line_no"), F.array_join(F.col("parts")["value"], glue).alias("value"))


def read_codebook(spark: SparkSession, path: str, continued: bool = True) -> DataFrame:
    """IO-35: (code, text) of tab-separated lines; blank lines, comments and headings go, the last of equal codes wins.

    A line without a tab continues the text before it, unless it opens or closes with a bracket; as the published builder never
    joins such lines, continued=False drops them.
    """
    d = numbered_lines(spark, path).withColumn("value", F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")))
    d = d.where("value <> '' and not startswith(value, '#') and not startswith(value, 'CAMEO')")
    entry = F.contains("value", F.lit("\t"))
    kept = d.where(entry | (F.lit(continued) & ~F.startswith("value", F.lit("[")) & ~F.endswith("value", F.lit("]"))))
    r = joined_records(kept, entry)
    part = lambda i: F.trim(F.get(F.split("value", "\t", 2), F.lit(i)))
    r = r.select(part(0).alias("code"), part(1).alias("text"), "file", "line_no").where("code <> '' and text <> ''")
    return r.groupBy("code").agg(F.max_by("text", F.struct("file", "line_no")).alias("text"))


#: IO-18: of each frame, the indicator, its date and value columns, and whether its first or its last rows are the newest.
FRAMES = {
    "gdp": ("季度", "国内生产总值-同比增长", "国内生产总值-绝对值", "head", 8),
    "cpi": ("月份", "全国-同比增长", None, "head", 12),
    "ppi": ("日期", "今值", None, "tail", 12),
    "pmi": ("月份", "制造业-指数", None, "head", 12),
    "caixin_pmi": ("日期", "今值", None, "tail", 12),
}


def read_macro_frames(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """IO-18, U-01: (indicator, date, value, raw_value, date_str) of the newest rows of each frame; rows without a date go.

    paths: a CSV folder for each indicator of FRAMES. A value of 0 stays (quirk Q21).
    """
    from ..functions import scalars as S

    def one(indicator: str, path: str) -> DataFrame:
        day, value, raw, end, n = FRAMES[indicator]
        d = with_position(spark.read.option("header", True).csv(path))
        d = (head if end == "head" else tail)(d, n)
        number = lambda c: S.safe_double(F.col(f"`{c}`")) if c else F.lit(None).cast("double")
        text = F.coalesce(F.col(f"`{day}`"), F.lit(""))
        return d.select(F.lit(indicator).alias("indicator"), S.chinese_date(text).alias("date"), number(value).alias("value"), number(raw).alias("raw_value"), text.alias("date_str"))

    return reduce(DataFrame.unionByName, [one(k, p) for k, p in paths.items()]).where("date is not null")
