from pyspark.sql import functions as F

from tessera.operators import range_join as rj

CUSTOMERS = ["101,Ann,Oslo", "255,Bo,Rome", "301,Cy,Nice", "404,Di,Bonn", "7,x", "abc,Ed,Kiel"]
ORDERS = ["901,101,pen", "902,102x,ink", "903,101,cap", "904,301,hat", "905,999,mug", "906,abc,box", "908"]


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_rows_and_places(spark):
    joined = rj.range_join(rj.parse_customers(lines(spark, CUSTOMERS)), rj.parse_orders(lines(spark, ORDERS)), [300, 200])
    got = joined.select("customer_id", "order_id", "bucket", F.spark_partition_id().alias("at")).collect()
    assert {(r["customer_id"], r["order_id"]) for r in got} == {("101", "901"), ("101", "903"), ("301", "904"), ("abc", "906")}
    assert all(r["at"] == r["bucket"] for r in got)
    assert {r["customer_id"]: r["bucket"] for r in got if r["customer_id"] != "abc"} == {"101": 0, "301": 2}
    assert joined.rdd.getNumPartitions() == 3
    assert ("101", "Ann,Oslo,901,pen") in {tuple(r) for r in rj.join_record(joined).collect()}


def test_key_equal_to_a_point_goes_right(spark):
    df = spark.createDataFrame([(k,) for k in (199, 200, 299, 300, -5)], "k long").withColumn("b", rj.range_bucket(F.col("k"), [200, 300]))
    assert {r["k"]: r["b"] for r in df.collect()} == {199: 0, 200: 1, 299: 1, 300: 2, -5: 0}
    assert [rj.bucket_of(k, [300, 200]) for k in (199, 200, 300)] == [0, 1, 2]


def test_many_points(spark):
    points = list(range(0, 1000, 10))
    df = spark.range(-5, 1010).withColumn("b", rj.range_bucket(F.col("id"), points))
    assert all(r["b"] == rj.bucket_of(r["id"], points) for r in df.collect())
