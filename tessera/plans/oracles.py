"""DuckDB SQL over the driver's tables, by query."""

from __future__ import annotations

_LINES = r"""lines AS (
  SELECT unnest(CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n$', ''), chr(10)) END) AS line
  FROM documents WHERE text IS NOT NULL)"""
_WORDS = r"words AS (SELECT lower(unnest(string_split(rtrim(line, ' '), ' '))) AS word FROM lines WHERE NOT regexp_matches(line, '^ +$'))"

_GRADES = """regs AS (SELECT o_orderkey::VARCHAR AS registration_id, o_custkey::VARCHAR AS student_id, (o_orderkey % 2000)::VARCHAR AS subject_id FROM orders),
marks AS (SELECT l_orderkey::VARCHAR AS registration_id, ['EX', 'A', 'b', 'C', 'd', 'P', 'F'][l_partkey % 7 + 1] AS grade FROM lineitem),
subjects AS (SELECT p_partkey::VARCHAR AS subject_id, (2010 + p_partkey % 5)::VARCHAR AS year, (1 + p_partkey % 12)::VARCHAR AS semester, p_size::VARCHAR AS credits FROM part)"""
_JOINED = f"{_GRADES}, joined AS (SELECT s.subject_id, r.student_id, m.grade, s.year, s.semester, s.credits FROM regs r JOIN marks m USING (registration_id) JOIN subjects s ON r.subject_id = s.subject_id)"
_POINTS = "CASE upper(grade) WHEN 'EX' THEN 10 WHEN 'A' THEN 9 WHEN 'B' THEN 8 WHEN 'C' THEN 7 WHEN 'D' THEN 6 WHEN 'P' THEN 5 ELSE 0 END"
_TOTALS = f"{_JOINED}, totals AS (SELECT student_id, semester, sum({_POINTS} * credits::BIGINT)::BIGINT AS p, sum(credits::BIGINT)::BIGINT AS c FROM joined GROUP BY student_id, semester)"

_DENSE = """raw AS (SELECT l_partkey % 100 AS u, l_suppkey AS v FROM lineitem),
e AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM raw WHERE u <> v)"""
_THIN = """raw AS (SELECT l_partkey % 60 AS u, l_suppkey AS v FROM lineitem WHERE l_suppkey < 60),
e AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM raw WHERE u <> v AND (least(u, v) * 7 + greatest(u, v) * 13) % 5 < 2)"""
_WHOLE = """raw AS (SELECT l_partkey AS u, l_suppkey AS v FROM lineitem),
e AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM raw WHERE u <> v)"""
_TRIANGLES = "tri AS (SELECT x.u AS a, x.v AS b, y.v AS c FROM e x JOIN e y ON x.u = y.u AND x.v < y.v JOIN e z ON z.u = x.v AND z.v = y.v)"
_SIDES = "sides AS (SELECT a AS u, b AS v, c AS w FROM tri UNION ALL SELECT a, c, b FROM tri UNION ALL SELECT b, c, a FROM tri)"
_PER_EDGE = f"{_TRIANGLES}, {_SIDES}, n AS (SELECT u, v, count(*) AS n FROM sides GROUP BY u, v)"
_WINGS = f"""{_TRIANGLES}, {_SIDES},
dia AS (SELECT x.u, x.v, x.w, y.w AS x FROM sides x JOIN sides y ON x.u = y.u AND x.v = y.v AND x.w < y.w)"""


def _rects(name: str, table: str, key: str, a: int, b: int) -> str:
    x, y = f"((37 * {key}) % 950)", f"((53 * {key} + 11) % 950)"
    return f"{name} AS (SELECT {key} AS id, {x}::DOUBLE AS xl, {y}::DOUBLE AS yb, ({x} + 5 + {key} % {a})::DOUBLE AS xr, ({y} + 5 + {key} % {b})::DOUBLE AS yt FROM {table} WHERE {key} < 400)"


_RECTS = ", ".join([_rects("p", "customer", "c_custkey", 31, 23), _rects("q", "supplier", "s_suppkey", 47, 41), _rects("r", "part", "p_partkey", 29, 37), _rects("s", "orders", "o_orderkey", 43, 19)])


def _meet(a: str, b: str) -> str:
    return f"{a}.xl <= {b}.xr AND {a}.xr >= {b}.xl AND {a}.yb <= {b}.yt AND {a}.yt >= {b}.yb"


def _slot(value: str) -> str:
    return f"greatest(0, least(3, floor({value} / 250)))::INT"


def _home(a: str) -> str:
    return f"({_slot(a + '.yb')} * 4 + {_slot(a + '.xl')})"


def _within(a: str) -> str:
    return f"({a}.xr <= ({_slot(a + '.xl')} + 1) * 250 AND {a}.yt <= ({_slot(a + '.yb')} + 1) * 250 AND {a}.xl >= {_slot(a + '.xl')} * 250 AND {a}.yb >= {_slot(a + '.yb')} * 250)"


_INSIDE = f"({_home('q')} = {_home('r')} AND {_within('q')} AND {_within('r')})"
_CHAIN = f"SELECT p.id AS p_id, q.id AS q_id, r.id AS r_id, s.id AS s_id FROM p JOIN q ON {_meet('p', 'q')} JOIN r ON {_meet('q', 'r')} JOIN s ON {_meet('r', 's')}"
_ALL_CHAINS = f"WITH {_RECTS} {_CHAIN}"

_RST = """r AS (SELECT l_orderkey AS A, l_suppkey AS B FROM lineitem WHERE l_orderkey < 300),
s AS (SELECT l_suppkey AS B, l_orderkey AS E, l_partkey % 5 AS C FROM lineitem WHERE l_orderkey >= 300 AND l_orderkey < 400),
t AS (SELECT (c_nationkey % 5)::BIGINT AS C, c_custkey AS D FROM customer WHERE c_custkey < 300),
hb AS (SELECT B FROM r GROUP BY B ORDER BY count(*) DESC, B LIMIT 2), hc AS (SELECT C FROM t GROUP BY C ORDER BY count(*) DESC, C LIMIT 2)"""
_RST_JOIN = f"WITH {_RST} SELECT A, B, E, C, D FROM r JOIN s USING (B) JOIN t USING (C)"

ORACLES: dict[str, str] = {
    "word_count": f"WITH {_LINES}, {_WORDS} SELECT word, count(*) AS n FROM words GROUP BY word",
    "word_count_total": f"WITH {_LINES}, {_WORDS} SELECT count(DISTINCT word) AS distinct_words, count(*) AS tokens FROM words",
    "token_edge_cases": f"WITH lines(line) AS (VALUES (''), ('   '), (' a'), ('a  b '), ('A,b' || chr(9) || 'C'), ('x'), ('Hello  World'), (' ')), {_WORDS} SELECT word, count(*) AS n FROM words GROUP BY word",
    "join_reg_grades": f"WITH {_GRADES} SELECT r.registration_id, r.student_id, r.subject_id, m.grade FROM regs r JOIN marks m USING (registration_id)",
    "three_table_join": f"WITH {_JOINED} SELECT * FROM joined",
    "grade_points": f"SELECT grade, ({_POINTS})::INT AS points FROM (VALUES ('EX'), ('ex'), ('A'), ('b'), ('C'), ('d'), ('P'), ('F'), (''), ('a+')) AS x(grade)",
    "semester_gpa": f"WITH {_TOTALS} SELECT student_id, semester, CASE WHEN c > 0 THEN p::DOUBLE / c ELSE 0.0::DOUBLE END AS sgpa FROM totals",
    "cumulative_gpa": f"WITH {_TOTALS} SELECT student_id, CASE WHEN sum(c) > 0 THEN sum(p)::DOUBLE / sum(c)::DOUBLE ELSE 0.0::DOUBLE END AS cgpa FROM totals GROUP BY student_id",
    "grade_report": f"""WITH {_TOTALS}, h AS (SELECT student_id, semester, p, c, CASE WHEN c > 0 THEN (200 * p + c) // (2 * c) ELSE 0 END AS h FROM totals),
texts AS (SELECT student_id, string_agg('sgpa_' || semester || ':' || (h // 100)::VARCHAR || '.' || lpad((h % 100)::VARCHAR, 2, '0'), ',' ORDER BY semester) AS t, sum(p)::BIGINT AS p, sum(c)::BIGINT AS c FROM h GROUP BY student_id),
g AS (SELECT *, CASE WHEN c > 0 THEN (200 * p + c) // (2 * c) ELSE 0 END AS g FROM texts)
SELECT student_id, t || ',cgpa:' || (g // 100)::VARCHAR || '.' || lpad((g % 100)::VARCHAR, 2, '0') AS report FROM g""",
    "range_join": "SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS city, o_orderkey AS order_id, o_orderpriority AS product, CASE WHEN c_custkey < 500 THEN 0 WHEN c_custkey < 1000 THEN 1 ELSE 2 END AS bucket FROM customer JOIN orders ON c_custkey = o_custkey",
    "range_join_partition_counts": "SELECT bucket, bucket AS partition, count(*) AS n FROM (SELECT CASE WHEN c_custkey < 500 THEN 0 WHEN c_custkey < 1000 THEN 1 ELSE 2 END AS bucket FROM customer JOIN orders ON c_custkey = o_custkey) GROUP BY bucket",
    "edges_canonical": f"WITH {_DENSE} SELECT u, v FROM e",
    "wedges": f"WITH {_THIN} SELECT x.u AS apex, x.v AS v, y.v AS w FROM e x JOIN e y ON x.u = y.u AND x.v < y.v",
    "triangles": f"WITH {_THIN}, {_TRIANGLES} SELECT a, b, c FROM tri",
    "triangle_edge_counts": f"WITH {_THIN}, {_PER_EDGE} SELECT u, v, n FROM n",
    "diamonds_per_edge": f"WITH {_DENSE}, {_PER_EDGE} SELECT u, v, n * (n - 1) // 2 AS diamonds FROM n WHERE n > 1",
    "diamond_total": f"WITH {_DENSE}, {_PER_EDGE} SELECT 'Total Diamonds Found:' AS label, sum(n * (n - 1) // 2)::BIGINT AS total FROM n HAVING sum(n * (n - 1) // 2) > 0",
    "diamond_partitioned": f"WITH {_THIN}, {_WINGS} SELECT len(list_distinct([u % 6, v % 6, w % 6, x % 6]))::INT AS parts, count(*) AS diamonds FROM dia GROUP BY 1",
    "diamond_partitioned_total": f"WITH {_THIN}, {_PER_EDGE} SELECT 'Total Diamonds Found (Weighted Sum):' AS label, sum(n * (n - 1) // 2)::BIGINT AS total FROM n HAVING sum(n * (n - 1) // 2) > 0",
    "rect_cells_split": f"WITH {_RECTS}, cells AS (SELECT (y * 4 + x)::INT AS cell, x, y FROM range(4) a(x), range(4) b(y)) SELECT p.id, cell FROM p, cells WHERE x BETWEEN {_slot('p.xl')} AND {_slot('p.xr')} AND y BETWEEN {_slot('p.yb')} AND {_slot('p.yt')}",
    "rect_cells_first_quadrant": f"WITH {_RECTS}, cells AS (SELECT (y * 4 + x)::INT AS cell, x, y FROM range(4) a(x), range(4) b(y)) SELECT q.id, cell FROM q, cells WHERE x >= {_slot('q.xl')} AND y >= {_slot('q.yb')}",
    "rect_crossing": f"WITH {_RECTS} SELECT r.id, {_home('r')} AS cell, NOT {_within('r')} AS crosses FROM r",
    "rect_overlap_pairs": f"WITH {_RECTS} SELECT q.id AS q_id, r.id AS r_id, (greatest(q.xl, r.xl) + least(q.xr, r.xr)) / 2 AS mid_x, (greatest(q.yb, r.yb) + least(q.yt, r.yt)) / 2 AS mid_y FROM q JOIN r ON {_meet('q', 'r')}",
    "rect_chain": _ALL_CHAINS,
    "rect_all_replicate": _ALL_CHAINS,
    "rect_early_output": f"{_ALL_CHAINS} WHERE {_INSIDE}",
    "rect_marked": f"""WITH {_RECTS}, late AS (SELECT q.id AS q_id, r.id AS r_id FROM q JOIN r ON {_meet('q', 'r')} WHERE NOT {_INSIDE})
SELECT 'P' AS rel, id FROM p WHERE EXISTS (SELECT 1 FROM q JOIN late ON q.id = late.q_id WHERE {_meet('p', 'q')})
UNION ALL SELECT 'Q', id FROM q WHERE id IN (SELECT q_id FROM late) UNION ALL SELECT 'R', id FROM r WHERE id IN (SELECT r_id FROM late)
UNION ALL SELECT 'S', id FROM s WHERE EXISTS (SELECT 1 FROM r JOIN late ON r.id = late.r_id WHERE {_meet('r', 's')})""",
    "rect_controlled_replicate": _ALL_CHAINS,
    "chain_join": _RST_JOIN,
    "skew_join": _RST_JOIN,
    "chain_join_count": f"SELECT count(*) AS n FROM ({_RST_JOIN})",
    "heavy_hitters": f"""WITH {_RST} SELECT 'B' AS key, B AS value, place FROM (SELECT B, row_number() OVER (ORDER BY n DESC, B) - 1 AS place FROM (SELECT B, count(*) AS n FROM r GROUP BY B)) WHERE place < 2
UNION ALL SELECT 'C', C, place FROM (SELECT C, row_number() OVER (ORDER BY n DESC, C) - 1 AS place FROM (SELECT C, count(*) AS n FROM t GROUP BY C)) WHERE place < 2""",
    "residual_light": f"{_RST_JOIN} WHERE B NOT IN (SELECT B FROM hb) AND C NOT IN (SELECT C FROM hc)",
    "residual_hb": f"{_RST_JOIN} WHERE B IN (SELECT B FROM hb) AND C NOT IN (SELECT C FROM hc)",
    "residual_hc": f"{_RST_JOIN} WHERE B NOT IN (SELECT B FROM hb) AND C IN (SELECT C FROM hc)",
    "residual_hbhc": f"{_RST_JOIN} WHERE B IN (SELECT B FROM hb) AND C IN (SELECT C FROM hc)",
}

#: The same over the whole of lineitem.
ORACLES |= {f"{name}_whole": ORACLES[name].replace(_THIN, _WHOLE) for name in ("wedges", "triangles", "triangle_edge_counts", "diamond_partitioned", "diamond_partitioned_total")}


def _whole_rects(name: str, table: str, key: str, a: int, b: int) -> str:
    x, y = f"((37 * {key}) % (950 * m))", f"((53 * {key} + 11) % (950 * m + 1))"
    return f"{name} AS (SELECT {key} AS id, {x}::DOUBLE AS xl, {y}::DOUBLE AS yb, ({x} + 5 + {key} % {a})::DOUBLE AS xr, ({y} + 5 + {key} % {b})::DOUBLE AS yt FROM {table}, side)"


_SIDE = "side AS (SELECT greatest(1, ceil(sqrt(count(*) / 15000.0)))::BIGINT AS m FROM orders)"
_WHOLE_RECTS = ", ".join([_SIDE, _whole_rects("p", "customer", "c_custkey", 31, 23), _whole_rects("q", "supplier", "s_suppkey", 47, 41), _whole_rects("r", "part", "p_partkey", 29, 37), _whole_rects("s", "orders", "o_orderkey", 43, 19)])
_M = "(SELECT m FROM side)"


def _grown(sql: str) -> str:
    """The SQL over whole tables: 4m x 4m cells, still 250 wide."""
    for old, new in ((_RECTS, _WHOLE_RECTS), ("least(3, ", f"least(4 * {_M} - 1, "), (" * 4 + ", f" * 4 * {_M} + "), ("range(4)", f"(SELECT unnest(range(4 * {_M})))")):
        sql = sql.replace(old, new)
    return sql


ORACLES |= {f"{name}_whole": _grown(sql) for name, sql in ORACLES.items() if name.startswith("rect_")}

_WHOLE_RST = """r AS (SELECT l_partkey AS A, l_orderkey AS B FROM lineitem),
s AS (SELECT o_orderkey AS B, o_orderkey AS E, o_custkey AS C FROM orders),
t AS (SELECT o_custkey AS C, o_orderkey AS D FROM orders),
""" + _RST[_RST.index("hb AS") :]
ORACLES |= {f"{name}_whole": ORACLES[name].replace(_RST, _WHOLE_RST) for name in ("chain_join", "skew_join", "chain_join_count", "heavy_hitters", "residual_light", "residual_hb", "residual_hc", "residual_hbhc")}
