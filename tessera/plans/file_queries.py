"""Queries that go through text files and inline lines: sources, parsers, sinks, generators.

Inputs are written as text to the shared folder from whole tables, with rows that parsers must skip,
and read back by the readers. The SQL states the same rules over the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import spatial as sp
from tessera.functions import text as tx
from tessera.operators import grades, range_join, skew_join, spatial_join, words
from tessera.plans import fixtures as fx
from tessera.plans.oracles import _LINES, _POINTS, _WHOLE_RECTS, _WORDS
from tessera.sources import generate, readers, writers
from tessera.sources.scratch import name_parts, new_path

FILE_QUERIES: dict = {}
FILE_ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        FILE_QUERIES[f.__name__], FILE_ORACLES[f.__name__] = f, sql
        return f

    return register


def put(lines: DataFrame, folder: str | None = None, prefix: str = "") -> str:
    """The folder that holds the lines (one column) as text files."""
    folder = folder or new_path(lines.sparkSession)
    lines.write.text(folder)
    if prefix:
        name_parts(lines.sparkSession, folder, prefix)
    return folder


def line(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("value")


def key(name: str) -> Column:
    return F.col(name)


# Sources


@query("SELECT o_orderkey || ',' || o_custkey || ',' || o_orderpriority AS value FROM orders")
def lines_of_two_paths(spark, sf_dir):
    """SRC1, ST2: even and odd orders in two folders, read as one."""
    orders = fx.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    value = line(key("o_orderkey"), ",", key("o_custkey"), ",", key("o_orderpriority"))
    return readers.read_lines(spark, *[put(orders.where(F.col("o_orderkey") % 2 == i).select(value)) for i in (0, 1)])


@query("SELECT o_orderpriority || ' ' || o_orderkey AS value FROM orders")
def lines_by_glob(spark, sf_dir):
    """SRC5: one folder a priority, read by a pattern; a folder beside them is left out."""
    base = new_path(spark)
    orders = fx.table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    orders.select(F.col("o_orderpriority").substr(1, 1).alias("level"), line(key("o_orderpriority"), " ", key("o_orderkey"))).write.partitionBy("level").text(f"{base}/all")
    put(orders.select(line("no")), f"{base}/all/other")
    return readers.read_lines(spark, f"{base}/all/level=*")


_REGS = "regs AS (SELECT o_orderkey::VARCHAR AS registration_id, o_custkey::VARCHAR AS student_id, (o_orderkey % 2000)::VARCHAR AS subject_id FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0)"
_MARKS = "marks AS (SELECT l_orderkey::VARCHAR AS registration_id, ['EX', 'A', 'b', 'C', 'd', 'P', 'F'][l_partkey % 7 + 1] AS grade FROM lineitem WHERE l_partkey % 13 <> 0)"
_SUBJECTS = "subjects AS (SELECT p_partkey::VARCHAR AS subject_id, (2010 + p_partkey % 5)::VARCHAR AS year, (1 + p_partkey % 12)::VARCHAR AS semester, p_size::VARCHAR AS credits FROM part WHERE p_partkey % 17 <> 0)"


def registration_lines(spark, sf_dir) -> DataFrame:
    """Quoted fields; every 7th row has a field too many, every 11th loses its last fields because they are empty."""
    k = key("o_orderkey")
    orders = fx.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    last = F.when(k % 11 == 0, ",").when(k % 7 == 0, F.concat(F.lit(',"'), (k % 2000).cast("string"), F.lit('",more'))).otherwise(F.concat(F.lit(',"'), (k % 2000).cast("string"), F.lit('"')))
    return orders.select(line('"', k, '",x,y,', F.when(k % 11 == 0, "").otherwise(F.concat(F.lit('"'), key("o_custkey").cast("string"), F.lit('"'))), last))


def grade_lines(spark, sf_dir) -> DataFrame:
    items = fx.table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey")
    return items.select(line("a,b,c,d,", key("l_orderkey"), F.when(F.col("l_partkey") % 13 == 0, ",,").otherwise(F.concat(F.lit(',"'), fx.letter(F.col("l_partkey")), F.lit('"')))))


def subject_lines(spark, sf_dir) -> DataFrame:
    k = key("p_partkey")
    part = fx.table(spark, sf_dir, "part", "p_partkey", "p_size")
    return part.select(line('0,1,2,"', 2010 + k % 5, '",', 1 + k % 12, ",5,6,7,", k, ",9,10", F.when(k % 17 == 0, ",").otherwise(F.concat(F.lit(","), F.col("p_size").cast("string"), F.when(k % 3 == 0, ",13").otherwise("")))))


@query(f"WITH {_REGS} SELECT * FROM regs")
def parsed_registrations(spark, sf_dir):
    """PRJ3-5: five fields exactly, empty ones at the end not counted; three of them, without quotes."""
    return grades.parse_registrations(readers.read_lines(spark, put(registration_lines(spark, sf_dir))))


@query(f"WITH {_MARKS} SELECT * FROM marks")
def parsed_grades(spark, sf_dir):
    return grades.parse_grades(readers.read_lines(spark, put(grade_lines(spark, sf_dir))))


@query(f"WITH {_SUBJECTS} SELECT * FROM subjects")
def parsed_subjects(spark, sf_dir):
    """Twelve fields or more."""
    return grades.parse_subjects(readers.read_lines(spark, put(subject_lines(spark, sf_dir))))


@query(f"""WITH {_REGS}, {_MARKS}, {_SUBJECTS}, joined AS (SELECT s.*, r.student_id, m.grade FROM regs r JOIN marks m USING (registration_id) JOIN subjects s ON r.subject_id = s.subject_id)
SELECT student_id, semester, sum({_POINTS} * credits::BIGINT)::BIGINT AS points, sum(credits::BIGINT)::BIGINT AS credits FROM joined GROUP BY student_id, semester""")
def grades_through_files(spark, sf_dir):
    """SRC2, SNK2, ST5: three typed sources, the join written as records, and the totals over what is read back."""
    lines = [readers.read_lines(spark, put(f(spark, sf_dir))) for f in (registration_lines, grade_lines, subject_lines)]
    joined = grades.three_table_join(grades.parse_registrations(lines[0]), grades.parse_grades(lines[1]), grades.parse_subjects(lines[2]))
    path = new_path(spark)
    writers.write_records(joined, path)
    return grades.semester_totals(grades.parse_joined(readers.read_lines(spark, path)))


def named_folder(spark, sf_dir) -> str:
    """Customers and orders as files of one folder, told apart by their names only, beside files of another name."""
    base = new_path(spark)
    customers, orders = fx.customers_orders(spark, sf_dir)
    for prefix, lines in (("customers", customers.select(line(" ", key("customer_id"), " ,", key("name"), ",", key("city"), ",more"))), ("orders", orders.select(line(key("order_id"), ",", key("customer_id"), ",", key("product")))), ("notes", orders.select(line("1,2,3")))):
        put(lines, f"{base}/{prefix}", prefix)
    return base


@query("SELECT 'customers' AS prefix, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def lines_by_file_name(spark, sf_dir):
    """SRC3."""
    parts = readers.read_by_name(spark, ["customers", "orders"], f"{named_folder(spark, sf_dir)}/*")
    counts = [df.agg(F.lit(name).alias("prefix"), F.count(F.lit(1)).alias("n")) for name, df in parts.items()]
    return counts[0].unionAll(counts[1])


@query("""SELECT c_custkey::VARCHAR AS key, c_name || ',' || c_mktsegment || ',' || o_orderkey || ',' || o_orderpriority AS value, CASE WHEN c_custkey < 500 THEN 0 WHEN c_custkey < 1000 THEN 1 ELSE 2 END AS bucket
FROM customer JOIN orders ON c_custkey = o_custkey""")
def range_join_through_files(spark, sf_dir):
    """SRC3, SRC6, EX2, SNK1, SRC9: the join placed by a side file's split points, written as keys and values and read back."""
    parts = readers.read_by_name(spark, ["customers", "orders"], f"{named_folder(spark, sf_dir)}/*")
    side = put(spark.createDataFrame([("1000",), (" 500",), ("",), ("no number",)], "value string"))
    splits = readers.read_split_points(spark, side)
    joined = range_join.range_join(range_join.parse_customers(parts["customers"]), range_join.parse_orders(parts["orders"]), splits)
    path = new_path(spark)
    writers.write_key_value(range_join.join_record(joined), path)
    return readers.read_key_value(spark, path).withColumn("bucket", range_join.range_bucket(F.col("key"), splits))


@query("SELECT p::INT AS split FROM (VALUES (-3), (200), (300)) AS x(p)")
def split_points(spark, sf_dir):
    """SRC6: lines that are no integer are skipped, the rest sorted."""
    side = put(spark.createDataFrame([(x,) for x in ("300", "+200", "", "3.5", "-3", "x1")], "value string"))
    return spark.createDataFrame([(p,) for p in readers.read_split_points(spark, side)], "split int")


@query("SELECT a::INT AS a, b::INT AS b FROM (VALUES (1, 2), (NULL, 3), (4, NULL), (1, 2)) AS x(a, b)")
def memory_relation(spark, sf_dir):
    """SRC7."""
    return generate.relation(spark, ["a", "b"], [(1, 2), (None, 3), (4, None), (1, 2)])


def _generated(light: str, heavy: str, pairs: str) -> str:
    """R, S and T of the generator as SQL; values other than the keys are numbers of their own."""
    return f"""lights AS (SELECT unnest(range({light})) AS i), heavies AS (SELECT unnest(range({heavy})) AS i), pairs(k, b, c) AS (VALUES {pairs}),
r AS (SELECT i AS A, 2 + i AS B FROM lights UNION ALL SELECT 100000 * (3 * k + 1) + i, b FROM heavies, pairs),
s AS (SELECT 2 + i AS B, 10 * i AS E, 11 + i AS C FROM lights UNION ALL SELECT b, 100000 * (3 * k + 2) + i, c FROM heavies, pairs),
t AS (SELECT 11 + i AS C, 20 * i AS D FROM lights UNION ALL SELECT c, 100000 * (3 * k + 3) + i FROM heavies, pairs)"""


_PAIRS = "(0, 1, 10), (1, 1, 12), (2, 3, 10)"


@query(f"WITH {_generated('10000', '100000', _PAIRS)} SELECT 'R' AS rel, count(*) AS n, sum(A)::BIGINT AS total, sum(B)::BIGINT AS keys FROM r UNION ALL SELECT 'S', count(*), sum(E)::BIGINT, sum(B + C)::BIGINT FROM s UNION ALL SELECT 'T', count(*), sum(D)::BIGINT, sum(C)::BIGINT FROM t")
def generated_relations(spark, sf_dir):
    """SRC8: 310,000 rows a relation."""
    r, s, t = generate.skewed_relations(spark)
    of = lambda df, name, value, keys: df.agg(F.lit(name).alias("rel"), F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("long")).alias("total"), F.sum(keys.cast("long")).alias("keys"))
    return of(r, "R", "A", F.col("B")).unionAll(of(s, "S", "E", F.col("B") + F.col("C"))).unionAll(of(t, "T", "D", F.col("C")))


_DEGREES = "(SELECT sum(nr::HUGEINT * ns * nt) FROM (SELECT B, C, count(*) AS ns FROM s GROUP BY B, C) JOIN (SELECT B, count(*) AS nr FROM r GROUP BY B) USING (B) JOIN (SELECT C, count(*) AS nt FROM t GROUP BY C) USING (C))"


@query(f"WITH {_generated('10000', '100000', _PAIRS)} SELECT {_DEGREES}::BIGINT AS n")
def generated_join_size(spark, sf_dir):
    """The size of a join that can't be listed, from key frequencies."""
    return skew_join.chain_join_count(*generate.skewed_relations(spark)).select(F.col("n").cast("long").alias("n"))


@query(f"WITH {_generated('10000', '100000', _PAIRS)} SELECT 'B' AS key, B::INT AS value FROM r GROUP BY B HAVING count(*) >= 50000 UNION ALL SELECT 'C', C::INT FROM t GROUP BY C HAVING count(*) >= 50000")
def heavy_by_threshold(spark, sf_dir):
    """D21: every value as frequent as the threshold, not a constant."""
    r, _, t = generate.skewed_relations(spark)
    rows = [(k, int(v)) for k, df in (("B", r), ("C", t)) for v in skew_join.heavy_hitters(df, k, threshold=50_000)]
    return spark.createDataFrame(rows, "key string, value int")


def grown_relations(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Skewed relations whose heavy groups grow with the orders: 20 rows a heavy pair and relation at 15,000 orders."""
    heavy = fx.table(spark, sf_dir, "orders", "o_orderkey").count() // 750
    return *generate.skewed_relations(spark, 50 * heavy, heavy), heavy


_GROWN = _generated("(SELECT 50 * (count(*) // 750) FROM orders)", "(SELECT count(*) // 750 FROM orders)", _PAIRS)
_GROWN_JOIN = f"WITH {_GROWN} SELECT A::INT AS A, B::INT AS B, E::INT AS E, C::INT AS C, D::INT AS D FROM r JOIN s USING (B) JOIN t USING (C)"


@query(_GROWN_JOIN)
def skewed_chain_join(spark, sf_dir):
    """JN9 where the keys are skewed: the plain plan's two joins, with keys of many rows of result dealt to several tasks."""
    return skew_join.dealt_chain_join(*grown_relations(spark, sf_dir)[:3])


@query(_GROWN_JOIN)
def skewed_skew_join(spark, sf_dir):
    """JN10-14 where the keys are skewed, heavy values by threshold."""
    r, s, t, heavy = grown_relations(spark, sf_dir)
    found = [skew_join.heavy_hitters(df, k, threshold=max(2, heavy // 2)) for df, k in ((r, "B"), (t, "C"))]
    return skew_join.skew_join(r, s, t, *found)


_ROOT = "greatest(1, round({}))::BIGINT"
_A, _D = _ROOT.format("sqrt(r * 100.0 / (s + t))"), _ROOT.format("sqrt(t * 100.0 / (r + s))")


@query(f"""WITH sizes(r, s, t) AS (VALUES (200000::BIGINT, 100000::BIGINT, 110000::BIGINT), (310000, 310000, 310000), (1, 900, 7), (50, 1, 1)), own AS (SELECT *, {_A} AS a, {_D} AS d FROM sizes)
SELECT r::INT AS r, s::INT AS s, t::INT AS t, a AS hb_a, greatest(1, 100 // a)::BIGINT AS hb_c, greatest(1, 100 // d)::BIGINT AS hc_b, d AS hc_d, {_ROOT.format('cbrt(100.0 * r * r / (s * t))')} AS both_a, {_ROOT.format('cbrt(100.0 * t * t / (r * s))')} AS both_d, {_ROOT.format('cbrt(100.0 * s * s / (r * t))')} AS both_e FROM own""")
def shares(spark, sf_dir):
    """EX6: shares of 100 tasks for sizes of the relations."""
    rows = []
    for r, s, t in ((200_000, 100_000, 110_000), (310_000, 310_000, 310_000), (1, 900, 7), (50, 1, 1)):
        hb, hc, both = skew_join.shares_heavy_b(r, s, t, 100), skew_join.shares_heavy_c(r, s, t, 100), skew_join.shares_heavy_both(r, s, t, 100)
        rows.append((r, s, t, hb["A"], hb["C"], hc["B"], hc["D"], both["A"], both["D"], both["E"]))
    return spark.createDataFrame(rows, "r int, s int, t int, hb_a long, hb_c long, hc_b long, hc_d long, both_a long, both_d long, both_e long")


# Parsers


def edge_lines(spark, sf_dir) -> DataFrame:
    """Two fields, tabs and blanks between and after; every 7th line has a third one, every 11th a leading blank, every 13th only one."""
    u, v = key("l_partkey"), key("l_suppkey")
    items = fx.table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey")
    return items.select(line(F.when(u % 11 == 0, " ").otherwise(""), u, F.when(u % 13 == 0, "").otherwise(F.concat(F.when(v % 2 == 0, " ").otherwise("\t  "), v.cast("string"), F.when(u % 7 == 0, " 9").otherwise(" \t")))))


@query("SELECT l_partkey AS u, l_suppkey AS v FROM lineitem WHERE l_partkey % 7 <> 0 AND l_partkey % 11 <> 0 AND l_partkey % 13 <> 0")
def edges_of_two_fields(spark, sf_dir):
    """PRJ7, PRJ10: exactly two fields; a leading blank makes an empty one."""
    lines = readers.read_lines(spark, put(edge_lines(spark, sf_dir)))
    # A line of a leading blank and one number has two fields, the first of them no number: these raise, so they are left out.
    return readers.parse_edges(lines.where(~F.col("value").rlike(r"^ \d+\s*$")), exact=True, strict=True)


@query("SELECT l_partkey AS u, l_suppkey AS v FROM lineitem WHERE l_partkey % 11 <> 0 AND l_partkey % 13 <> 0")
def edges_of_fields_or_more(spark, sf_dir):
    """PRJ8: two fields at least, lines whose fields are no numbers skipped."""
    return readers.parse_edges(readers.read_lines(spark, put(edge_lines(spark, sf_dir))), exact=False, strict=False)


@query(f"""WITH {_WHOLE_RECTS} SELECT CASE WHEN id % 4 = 3 THEN 'Q' ELSE 'P' END AS rel, CASE WHEN id % 2 = 0 THEN 'p' || id ELSE 'P,' || xl::BIGINT || ',' || yb::BIGINT || ',' || xr::BIGINT || ',' || yt::BIGINT END AS id, xl, yb, xr, yt
FROM p WHERE id % 5 <> 0 AND id % 4 <> 3""")
def parsed_rectangles(spark, sf_dir):
    """PRJ11: lines with and without an id, further fields, and lines that are no rectangle."""
    k = F.col("id")
    p = fx.rectangles_whole(spark, sf_dir)[0][0]
    bounds = [F.col(b).cast("long") for b in ("xl", "yb", "xr", "yt")]
    head = F.when(k % 4 == 3, "Q").otherwise("P")
    numbers = [x for b in bounds for x in (",", b)][1:]
    value = line(head, ",", F.when(k % 2 == 0, F.concat(F.lit("p"), k.cast("string"), F.lit(","))).otherwise(""), *numbers[:-1], F.when(k % 5 == 0, "no number").otherwise(bounds[3].cast("string")), F.when(k % 2 == 0, ",more").otherwise(""))
    return readers.parse_rectangles(readers.read_lines(spark, put(p.select(value)))).where("rel = 'P'")


TRIMMED = ["12", " 12 ", "\t-7\r", "+5", "1 2", "", "x", "2147483648", " 3"]


@query("SELECT * FROM (VALUES (0, 12, 12.0::DOUBLE), (1, 12, 12.0), (2, -7, -7.0), (3, 5, 5.0), (4, NULL, NULL), (5, NULL, NULL), (6, NULL, NULL), (7, NULL, 2147483648.0), (8, NULL, NULL)) AS x(i, whole, number)")
def trimmed_numbers(spark, sf_dir):
    """PRJ6, PRJ9, casting: characters up to U+0020 go at both ends, and what is no number then is null."""
    df = spark.createDataFrame(list(enumerate(TRIMMED)), "i int, v string")
    return df.select("i", tx.to_int(tx.trim_control(F.col("v"))).alias("whole"), tx.to_double(F.col("v")).alias("number"))


@query("SELECT * FROM (VALUES (0, 3), (1, 0), (2, 1), (3, 3), (4, 1)) AS x(i, fields)")
def trailing_fields(spark, sf_dir):
    """PRJ3: empty fields at the end don't count; separators only give none, an empty line one."""
    df = spark.createDataFrame(list(enumerate(["a,,b,,", ",,", "", ",a,b", "x"])), "i int, v string")
    return df.select("i", F.size(tx.split_trailing(F.col("v"), ",")).alias("fields"))


# Sinks


@query(f"WITH {_LINES}, {_WORDS} SELECT word AS key, count(*)::VARCHAR AS value FROM words GROUP BY word")
def key_value_round_trip(spark, sf_dir):
    """SNK1, SRC9."""
    path = new_path(spark)
    writers.write_key_value(words.word_count(fx.document_lines(spark, sf_dir)), path)
    return readers.read_key_value(spark, path)


@query("SELECT count(*) AS lines, 0::BIGINT AS out_of_order FROM (SELECT DISTINCT o_custkey FROM orders)")
def sorted_output(spark, sf_dir):
    """SO1: keys written in the order of their bytes, within a file and from file to file."""
    path = new_path(spark)
    counts = fx.table(spark, sf_dir, "orders", "o_custkey").groupBy(F.col("o_custkey").cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    writers.write_key_value(counts.orderBy("k"), path)
    lines = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line")).where("line != ''")
    each = lines.select("file", "at", F.split("line", "\t")[0].alias("k"))
    within = each.withColumn("before", F.lag("k").over(Window.partitionBy("file").orderBy("at")))
    ends = each.groupBy("file").agg(F.min("k").alias("low"), F.max("k").alias("high")).withColumn("before", F.lag("high").over(Window.orderBy("file")))
    wrong = ends.agg(F.count_if(F.col("before") > F.col("low")).alias("x"))
    return within.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("before") > F.col("k")).alias("w")).join(F.broadcast(wrong)).select("lines", (F.col("w") + F.col("x")).alias("out_of_order"))


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'early' ELSE 'late' END AS output, c_custkey || ',' || coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_name END, '') AS value FROM customer")
def named_outputs(spark, sf_dir):
    """SNK4: two outputs of one job, each in a folder of its own; nulls are empty."""
    c = fx.table(spark, sf_dir, "customer", "c_custkey", "c_name").withColumn("c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")))
    path = new_path(spark)
    writers.write_named({"early": c.where("c_custkey % 3 = 0"), "late": c.where("c_custkey % 3 != 0")}, path)
    parts = [readers.read_lines(spark, f"{path}/output={name}").select(F.lit(name).alias("output"), "value") for name in ("early", "late")]
    return parts[0].unionAll(parts[1])


# Points


@query(f"WITH {_WHOLE_RECTS} SELECT id, (greatest(0, least(4 * m - 1, floor((yb + yt) / 2 / 250))) * 4 * m + greatest(0, least(4 * m - 1, floor((xl + xr) / 2 / 250))))::INT AS cell FROM p, side")
def points_in_cells(spark, sf_dir):
    """SP7: the one cell that each rectangle's midpoint lies in, of those that the rectangle touches."""
    (p, *_), grid = fx.rectangles_whole(spark, sf_dir)
    own = sp.rect()
    cells = p.select("id", *spatial_join.BOUNDS, F.explode(sp.split_cells(own, grid)).alias("cell"))
    return cells.where(sp.point_in_cell((own["xl"] + own["xr"]) / 2, (own["yb"] + own["yt"]) / 2, F.col("cell"), grid)).select("id", "cell")
