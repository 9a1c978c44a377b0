"""Queries over whole tables, against plain Python."""

from itertools import combinations

from tessera.plans import fixtures as fx
from tessera.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def small(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_graph_is_whole(spark, tmp_path):
    pairs = [(900, 70), (900, 71), (71, 70), (901, 70), (901, 71), (5, 5), (70, 71)]
    d = small(spark, tmp_path, lineitem=(pairs, "l_partkey long, l_suppkey long"))
    edges = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    nodes = sorted({x for e in edges for x in e})
    found = {t for t in combinations(nodes, 3) if all(e in edges for e in combinations(t, 2))}
    assert {tuple(r) for r in QUERIES["triangles_whole"](spark, d).collect()} == found == {(70, 71, 900), (70, 71, 901)}
    wedges = {(a, v, w) for a in nodes for v, w in combinations(nodes, 2) if (a, v) in edges and (a, w) in edges}
    assert {tuple(r) for r in QUERIES["wedges_whole"](spark, d).collect()} == wedges
    sides = {}
    for t in found:
        for e in combinations(t, 2):
            sides[e] = sides.get(e, 0) + 1
    assert {(r["u"], r["v"]): r["n"] for r in QUERIES["triangle_edge_counts_whole"](spark, d).collect()} == sides
    assert sum(r["diamonds"] for r in QUERIES["diamond_partitioned_whole"](spark, d).collect()) == 1
    assert QUERIES["diamond_partitioned_total_whole"](spark, d).first()["total"] == 1
    suppliers = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey")
    assert fx.whole_graph(spark, SF).count() == suppliers.count()


def test_rectangles_are_whole(spark, tmp_path):
    """Keys beyond 400, and a plane of more than one side."""
    n = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
    few = {"customer": range(380, 440), "supplier": range(390, 430), "part": range(380, 450), "orders": range(20000)}
    d = small(spark, tmp_path, **{t: ([(k,) for k in few[t]], f"{c} long") for t, c in n.items()})
    (p, q, r, s), grid = fx.rectangles_whole(spark, d)
    assert [x.count() for x in (p, q, r, s)] == [60, 40, 70, 20000] and (grid.rows, grid.width) == (8, 2000.0)

    def meet(a, b):
        return a["xl"] <= b["xr"] and a["xr"] >= b["xl"] and a["yb"] <= b["yt"] and a["yt"] >= b["yb"]

    p, q, r, s = (x.collect() for x in (p, q, r, s))
    qr = [(b, c) for b in q for c in r if meet(b, c)]
    at_p, at_s = {b["id"]: [a["id"] for a in p if meet(a, b)] for b in q}, {c["id"]: [e["id"] for e in s if meet(c, e)] for c in r}
    want = sorted((a, b["id"], c["id"], e) for b, c in qr for a in at_p[b["id"]] for e in at_s[c["id"]])
    assert want and max(b["id"] for b, _ in qr) > 400
    for name in ("rect_chain_whole", "rect_all_replicate_whole", "rect_controlled_replicate_whole"):
        assert sorted(tuple(x) for x in QUERIES[name](spark, d).collect()) == want


def test_chain_is_whole(spark, tmp_path):
    """Keys beyond those of the cut: 300 and 400."""
    items, orders = [(k % 7, 1000 + k % 50) for k in range(120)], [(1000 + k, 500 + k % 9) for k in range(60)]
    d = small(spark, tmp_path, lineitem=(items, "l_partkey long, l_orderkey long"), orders=(orders, "o_orderkey long, o_custkey long"))
    want = sorted((a, b, b, c, e) for a, b in items for o, c in orders if o == b for e, c2 in orders if c2 == c)
    for name in ("chain_join_whole", "skew_join_whole"):
        assert sorted(tuple(x) for x in QUERIES[name](spark, d).collect()) == want
    assert QUERIES["chain_join_count_whole"](spark, d).first()["n"] == len(want)
