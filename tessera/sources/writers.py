"""Text writers. An output folder that exists is an error unless the mode says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_key_value(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The first column, a tab and the second column of each row."""
    key, value = df.columns[:2]
    df.select(F.concat_ws("\t", F.col(key).cast("string"), F.col(value).cast("string")).alias("value")).write.mode(mode).text(path)


def write_records(df: DataFrame, path: str, separator: str = ",", mode: str = "errorifexists") -> None:
    """All columns of each row, joined by a separator; nulls are empty."""
    df.select(_record(df, separator).alias("value")).write.mode(mode).text(path)


def _record(df: DataFrame, separator: str) -> Column:
    return F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])


def write_named(outputs: dict[str, DataFrame], path: str, separator: str = ",", mode: str = "errorifexists") -> None:
    """Several outputs in one job, each in the folder output=<name> under path.

    In one plan what the outputs have in common is computed once, where Spark reuses its exchanges.
    """
    parts = [df.select(F.lit(name).alias("output"), _record(df, separator).alias("value")) for name, df in outputs.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionAll(part)
    rows.write.mode(mode).partitionBy("output").text(path)
