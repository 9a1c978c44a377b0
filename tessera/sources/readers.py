"""Text readers: lines, delimited records, edges, rectangles, split points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """One row (value) a line of the files, folders or globs named."""
    return spark.read.text(list(paths))


def read_by_name(spark: SparkSession, prefixes: list[str], *paths: str) -> dict[str, DataFrame]:
    """The lines of all paths, by the prefix that their file's name has; files of other names are left out."""
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_name").alias("file"))
    return {p: lines.where(F.col("file").startswith(p)).select("value") for p in prefixes}


def read_key_value(spark: SparkSession, *paths: str) -> DataFrame:
    """key and value, split at the first tab; value is empty where there is none."""
    parts = F.split("value", "\t", 2)
    return read_lines(spark, *paths).select(parts[0].alias("key"), F.coalesce(tx.field(parts, 1), F.lit("")).alias("value"))


def parse_edges(lines: DataFrame, exact: bool = True, strict: bool = True) -> DataFrame:
    """u and v of lines of two numbers.

    exact: lines with another number of fields are skipped, a leading blank counts as a field;
    else further fields are ignored. strict: a field that is no number raises, else it skips.
    """
    parts = F.split(F.regexp_replace("value", r"\s+\z", ""), r"\s+")
    rows = lines.select(parts.alias("f")).where(F.size("f") == 2 if exact else F.size("f") >= 2)
    out = rows.select(tx.to_long(tx.field(F.col("f"), 0), strict).alias("u"), tx.to_long(tx.field(F.col("f"), 1), strict).alias("v"))
    return out if strict else out.dropna()


def parse_rectangles(lines: DataFrame) -> DataFrame:
    """rel, id, xl, yb, xr, yt of lines `rel,xl,yb,xr,yt` or `rel,id,xl,yb,xr,yt`; other lines are skipped.

    A line is of the second kind where its second field is no number, or where it has six
    numbers. Where there is no id, the line itself is the id.
    """
    f = F.col("f")
    numbers = F.transform(f, lambda x: tx.to_double(x))
    rows = lines.select("value", tx.split_trailing(F.col("value"), ",").alias("f")).withColumn("n", numbers)
    named = (F.size("f") >= 6) & (tx.field(F.col("n"), 1).isNull() | (tx.field(F.col("n"), 5).isNotNull()))
    at = lambda i: F.when(named, tx.field(F.col("n"), i + 1)).otherwise(tx.field(F.col("n"), i))
    out = rows.select(
        tx.trim_control(tx.field(f, 0)).alias("rel"),
        F.when(named, tx.trim_control(tx.field(f, 1))).otherwise(F.col("value")).alias("id"),
        *[at(i + 1).alias(b) for i, b in enumerate(("xl", "yb", "xr", "yt"))],
    )
    return out.dropna()


def read_split_points(spark: SparkSession, path: str, most: int = 100_000) -> list[int]:
    """The ascending split points of a side file, one integer a line; other lines are skipped.

    The file is a parameter of a partitioning, so its size is checked: beyond `most` lines it raises.
    """
    rows = read_lines(spark, path).select(tx.to_int(tx.trim_control(F.col("value"))).alias("p")).dropna().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} split points")
    return sorted(r["p"] for r in rows)
