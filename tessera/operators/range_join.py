"""Joins whose output partitions are given by explicit split points."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx


def range_bucket(key: Column, splits: list[int]) -> Column:
    """The number of split points that are not above key: a key equal to a point goes to its right.

    Keys that are no integers are dealt out by hash. There is one more bucket than split points.
    """
    points = sorted(splits)
    number = tx.to_long(key.cast("string"), strict=False)
    if len(points) <= 64:
        out = F.lit(0)
        for p in points:
            out = out + (number >= p).cast("int")
    else:
        out = F.size(F.filter(F.array(*map(F.lit, points)), lambda p: p <= number))
    return F.when(number.isNotNull(), out).otherwise(F.pmod(F.hash(key), F.lit(len(points) + 1))).cast("int")


def bucket_of(number: int, splits: list[int]) -> int:
    """The bucket of a number, on the driver."""
    return bisect_right(sorted(splits), number)


def range_partition(df: DataFrame, key: str, splits: list[int], bucket: str = "bucket") -> DataFrame:
    """df with its bucket, and bucket i in partition i."""
    return df.withColumn(bucket, range_bucket(F.col(key), splits)).repartitionById(len(splits) + 1, F.col(bucket))


def parse_customers(lines: DataFrame) -> DataFrame:
    """customer_id, name, city of rows of three fields or more."""
    return _parse(lines, ["customer_id", "name", "city"])


def parse_orders(lines: DataFrame) -> DataFrame:
    """order_id, customer_id, product of rows of three fields or more."""
    return _parse(lines, ["order_id", "customer_id", "product"])


def _parse(lines: DataFrame, names: list[str]) -> DataFrame:
    rows = lines.select(tx.split_trailing(F.col("value"), ",").alias("f")).where(F.size("f") >= len(names))
    return rows.select(*[tx.trim_control(tx.field(F.col("f"), i)).alias(n) for i, n in enumerate(names)])


def range_join(customers: DataFrame, orders: DataFrame, splits: list[int], place: bool = True) -> DataFrame:
    """customer_id, name, city, order_id, product and bucket of the inner join, placed by bucket.

    The join itself is planned freely, so a hot customer or bucket is split like in any join;
    the placing comes last, over the result.
    """
    joined = customers.join(orders, "customer_id").select("customer_id", "name", "city", "order_id", "product")
    if place:
        return range_partition(joined, "customer_id", splits)
    return joined.withColumn("bucket", range_bucket(F.col("customer_id"), splits))


def join_record(joined: DataFrame) -> DataFrame:
    """customer_id and value `name,city,order_id,product`, for a key-value writer."""
    return joined.select("customer_id", F.concat_ws(",", "name", "city", "order_id", "product").alias("value"))
