"""A query's rows against its SQL's, as bags of values by column name."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


def rows(frame, names):
    return sorted(repr(tuple(plain(r[n]) for n in names)) for r in frame)


def compare(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = query(spark, sf_dir)
    table = con.execute(sql).to_arrow_table()
    assert sorted(got.columns) == sorted(table.column_names)
    names = sorted(got.columns)
    want = rows(table.to_pylist(), names)
    assert rows([r.asDict() for r in got.collect()], names) == want
    return want
