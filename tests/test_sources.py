import pytest
from pyspark.errors import AnalysisException

from tessera.operators import graph
from tessera.sources import readers, writers


def write(path, text):
    path.write_text(text)
    return f"file://{path}"


def test_files_by_name(spark, tmp_path):
    write(tmp_path / "customers.csv", "1,a,b\n")
    write(tmp_path / "orders_1.csv", "9,1,x\n8,1,y\n")
    write(tmp_path / "other.csv", "z\n")
    got = readers.read_by_name(spark, ["customers", "orders"], f"file://{tmp_path}/*.csv")
    assert {k: df.count() for k, df in got.items()} == {"customers": 1, "orders": 2}


def test_edges_skip_lines_of_other_widths(spark, tmp_path):
    path = write(tmp_path / "e", "1 2\n\n2\t3 \n 3 4\n1 2 3\n1 3\n")
    got = readers.parse_edges(readers.read_lines(spark, path))
    assert sorted(map(tuple, got.collect())) == [(1, 2), (1, 3), (2, 3)]
    assert graph.triangles(got).count() == 1
    wide = readers.parse_edges(readers.read_lines(spark, write(tmp_path / "w", "1 2 x\n5\nx 1\n")), exact=False, strict=False)
    assert [tuple(r) for r in wide.collect()] == [(1, 2)]
    with pytest.raises(Exception):
        readers.parse_edges(readers.read_lines(spark, write(tmp_path / "b", "a b\n"))).collect()


def test_split_points(spark, tmp_path):
    path = write(tmp_path / "p", "300\n200\n\nx\n")
    assert readers.read_split_points(spark, path) == [200, 300]
    with pytest.raises(ValueError):
        readers.read_split_points(spark, path, most=1)


def test_key_value_round_trip_and_existing_folder(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    out = f"file://{tmp_path}/out"
    writers.write_key_value(df, out)
    assert sorted(map(tuple, readers.read_key_value(spark, out).collect())) == [("a", "1"), ("b", "2")]
    with pytest.raises(AnalysisException):
        writers.write_key_value(df, out)
    writers.write_records(df, out, mode="overwrite")
    assert sorted(r["value"] for r in readers.read_lines(spark, out).collect()) == ["a,1", "b,2"]
    writers.write_named({"early": df, "late": df}, f"file://{tmp_path}/named")
    assert readers.read_lines(spark, f"file://{tmp_path}/named/output=*").count() == 4
