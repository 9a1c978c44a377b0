from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import words


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_tokens_keep_inner_and_leading_empty_ones(spark):
    values = ["", "   ", " a", "a  b ", "A,b\tC"]
    assert column(spark, values, lambda v: tx.split_trailing(v, " ")) == [[""], [], ["", "a"], ["a", "", "b"], ["A,b\tC"]]
    counts = {r["word"]: r["n"] for r in words.word_count(spark.createDataFrame([(v,) for v in values] + [(None,)], "value string")).collect()}
    assert counts == {"": 3, "a": 2, "b": 1, "a,b\tc": 1}


def test_sample_line(spark):
    got = words.word_count(spark.createDataFrame([("hello world",)], "value string")).collect()
    assert sorted(map(tuple, got)) == [("hello", 1), ("world", 1)]


def test_lines(spark):
    assert column(spark, ["", "a", "a\n", "a\r\nb\rc\n", "\n", "a\n\n"], tx.lines) == [[], ["a"], ["a"], ["a", "b", "c"], [""], ["a", ""]]


def test_comma_split_drops_trailing_fields(spark):
    assert column(spark, ["a,b,,", "a,,b", ",", "", ",a"], lambda v: tx.split_trailing(v, ",")) == [["a", "b"], ["a", "", "b"], [], [""], ["", "a"]]


def test_two_decimals(spark):
    assert column(spark, [4.125, 1.005, 2.675, 0.125, 0.0], tx.two_decimals, "double") == ["4.13", "1.01", "2.68", "0.13", "0.00"]


def test_numbers(spark):
    assert column(spark, ["12", "+3", "-4", " 5", "1.0", "99999999999", None], tx.to_int) == [12, 3, -4, None, None, None, None]
    assert column(spark, [" 1.5 ", "x", "1e3"], tx.to_double) == [1.5, None, 1000.0]
    assert column(spark, ["\t a b\x00 "], tx.trim_control) == ["a b"]


def test_grade_points(spark):
    assert column(spark, ["EX", "ex", "a", "B", "c", "D", "p", "F", None], tx.grade_points) == [10, 10, 9, 8, 7, 6, 5, 0, 0]


def test_pairs_among(spark):
    assert column(spark, [0, 1, 2, 3, 4, 4294967296], tx.pairs_among, "long") == [0, 0, 1, 3, 6, 9223372034707292160]
