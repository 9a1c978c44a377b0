"""Inputs of the queries, derived from the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.spatial import Grid

GRID = Grid(4, 4, 1000.0, 1000.0)
SPLITS = [500, 1000]
LETTERS = ["EX", "A", "b", "C", "d", "P", "F"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "text").select(F.explode(tx.lines(F.col("text"))).alias("value"))


def letter(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LETTERS)), (number % len(LETTERS)).cast("int") + 1)


def grade_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Registrations from orders, grades from line items, subjects from parts."""
    regs = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(
        F.col("o_orderkey").cast("string").alias("registration_id"), F.col("o_custkey").cast("string").alias("student_id"), (F.col("o_orderkey") % 2000).cast("string").alias("subject_id")
    )
    grades = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").select(F.col("l_orderkey").cast("string").alias("registration_id"), letter(F.col("l_partkey")).alias("grade"))
    subjects = table(spark, sf_dir, "part", "p_partkey", "p_size").select(
        F.col("p_partkey").cast("string").alias("subject_id"), (2010 + F.col("p_partkey") % 5).cast("string").alias("year"), (1 + F.col("p_partkey") % 12).cast("string").alias("semester"), F.col("p_size").cast("string").alias("credits")
    )
    return regs, grades, subjects


def customers_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("city"))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("product"))
    return customers, orders


def dense_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey").select((F.col("l_partkey") % 100).alias("u"), F.col("l_suppkey").alias("v"))


def thin_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey").where("l_suppkey < 60").select((F.col("l_partkey") % 60).alias("u"), F.col("l_suppkey").alias("v"))
    low, high = tx.canonical_pair(F.col("u"), F.col("v"))
    return e.where((low * 7 + high * 13) % 5 < 2)


def whole_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item's part and supplier, ids as they are and in one id space."""
    return table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"))


def rectangles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    def of(name: str, key: str, a: int, b: int) -> DataFrame:
        k = F.col(key)
        x, y = (37 * k) % 950, (53 * k + 11) % 950
        rows = table(spark, sf_dir, name, key).where(k < 400)
        return rows.select(k.alias("id"), x.cast("double").alias("xl"), y.cast("double").alias("yb"), (x + 5 + k % a).cast("double").alias("xr"), (y + 5 + k % b).cast("double").alias("yt"))

    return of("customer", "c_custkey", 31, 23), of("supplier", "s_suppkey", 47, 41), of("part", "p_partkey", 29, 37), of("orders", "o_orderkey", 43, 19)


def rectangles_whole(spark: SparkSession, sf_dir: str) -> tuple[tuple[DataFrame, ...], Grid]:
    """A rectangle for every row of the four tables, and a grid over a plane whose area grows with the orders."""
    m = max(1, math.ceil(math.sqrt(table(spark, sf_dir, "orders", "o_orderkey").count() / 15000)))

    def of(name: str, key: str, a: int, b: int) -> DataFrame:
        k = F.col(key)
        x, y = (37 * k) % (950 * m), (53 * k + 11) % (950 * m + 1)
        return table(spark, sf_dir, name, key).select(k.alias("id"), x.cast("double").alias("xl"), y.cast("double").alias("yb"), (x + 5 + k % a).cast("double").alias("xr"), (y + 5 + k % b).cast("double").alias("yt"))

    relations = of("customer", "c_custkey", 31, 23), of("supplier", "s_suppkey", 47, 41), of("part", "p_partkey", 29, 37), of("orders", "o_orderkey", 43, 19)
    return relations, Grid(4 * m, 4 * m, 1000.0 * m, 1000.0 * m)


def chain_relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_partkey")
    r = items.where("l_orderkey < 300").select(F.col("l_orderkey").alias("A"), F.col("l_suppkey").alias("B"))
    s = items.where("l_orderkey >= 300 and l_orderkey < 400").select(F.col("l_suppkey").alias("B"), F.col("l_orderkey").alias("E"), (F.col("l_partkey") % 5).alias("C"))
    t = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").where("c_custkey < 300").select((F.col("c_nationkey") % 5).cast("long").alias("C"), F.col("c_custkey").alias("D"))
    return r, s, t


def chain_relations_whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All line items by order, all orders by customer, and each customer's orders: the chain grows in proportion to the tables."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    r = table(spark, sf_dir, "lineitem", "l_partkey", "l_orderkey").select(F.col("l_partkey").alias("A"), F.col("l_orderkey").alias("B"))
    s = orders.select(F.col("o_orderkey").alias("B"), F.col("o_orderkey").alias("E"), F.col("o_custkey").alias("C"))
    return r, s, orders.select(F.col("o_custkey").alias("C"), F.col("o_orderkey").alias("D"))
