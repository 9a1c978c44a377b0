import random
from threading import Timer

import pytest
from pyspark.sql import functions as F

from tessera.functions.spatial import Grid, first_col, first_row, home_cell, overlaps, point_in_cell, rect, split_cells
from tessera.operators import spatial_join as sj
from tessera.sources.readers import parse_rectangles

G = Grid(2, 2, 100.0, 100.0)


def frame(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, xl double, yb double, xr double, yt double")


def theta(p, q, r, s):
    p, q, r, s = (sj.named(d, f"{x}_") for d, x in zip((p, q, r, s), sj.RELATIONS))
    pq = p.join(q, overlaps(rect("p_"), rect("q_")))
    return pq.join(r, overlaps(rect("q_"), rect("r_"))).join(s, overlaps(rect("r_"), rect("s_"))).select(*sj.IDS)


def test_partner_beyond_the_midpoint_cell_is_found(spark):
    p, q, r, s = (frame(spark, [x]) for x in ([10, 10, 30, 45], [20, 40, 25, 45], [20, 40, 60, 60], [55, 55, 70, 70]))
    for f in (sj.all_replicate, sj.controlled_replicate, sj.chain_join):
        assert f(p, q, r, s, G).count() == 1


@pytest.mark.parametrize("seed,grid", [(1, G), (2, Grid(3, 5, 100.0, 100.0)), (3, Grid())])
def test_all_strategies_equal_the_plain_join(spark, seed, grid):
    rng = random.Random(seed)

    def rects(n):
        out = []
        for _ in range(n):
            x, y = rng.choice([0, 25, 50, 75, -10, 100, 120, 33]), rng.choice([0, 20, 50, 100, -5, 60])
            out.append((x, y, x + rng.choice([0, 5, 25, 50, 200]), y + rng.choice([0, 10, 50, 200])))
        return frame(spark, [*out, out[0]])

    parts = [rects(n) for n in (7, 6, 6, 7)]
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(theta(*parts))
    assert want
    for f in (sj.all_replicate, sj.chain_join):
        assert rows(f(*parts, grid)) == want
    early, late = sj.outputs(*parts, grid)
    assert sorted(rows(early) + rows(late)) == want


def test_cells_are_clamped_on_both_sides(spark):
    df = frame(spark, [[-10, -10, 10, 10], [100, 100, 150, 150], [0, 0, 100, 100], [50, 0, 50, 49]])
    got = df.select("id", home_cell(rect(), G).alias("h"), split_cells(rect(), G).alias("c")).orderBy("id").collect()
    assert [(r["h"], sorted(r["c"])) for r in got] == [(0, [0]), (3, [3]), (0, [0, 1, 2, 3]), (1, [1])]
    inside = df.select(point_in_cell(F.col("xl"), F.col("yb"), first_row(rect(), G) * 2 + first_col(rect(), G), G).alias("x")).collect()
    assert all(r["x"] for r in inside)


def test_lines_with_and_without_id(spark):
    lines = spark.createDataFrame([(x,) for x in ["P,p1,10,20,30,40", "Q,1,2,3,4", "R,7,1,2,3,4", "S,x", "S,1,2,three,4", "S,1,2,3,4,note"]], "value string")
    got = {(r["rel"], r["id"]): (r["xl"], r["yt"]) for r in parse_rectangles(lines).collect()}
    assert got == {("P", "p1"): (10.0, 40.0), ("Q", "Q,1,2,3,4"): (1.0, 4.0), ("R", "7"): (1.0, 4.0), ("S", "S,1,2,3,4,note"): (1.0, 4.0)}


def test_relations_and_record(spark):
    rows = spark.createDataFrame([("P", "a", 0.0, 0.0, 1.0, 1.0), ("x", "b", 0.0, 0.0, 1.0, 1.0)], "rel string, id string, xl double, yb double, xr double, yt double")
    assert [d.count() for d in sj.relations_of(rows)] == [1, 0, 0, 0]
    chain = spark.createDataFrame([("a", "b", "c", "d")], sj.IDS)
    assert sj.chain_record(chain).first()[0] == "<a | b | c | d>"


def few_links(spark, n):
    """n small rectangles a relation in a row of squares that only meet their namesakes, in one cell of G."""
    at = spark.range(n).select("id", (F.pmod("id", F.lit(300)) / 8.0).alias("x"), (F.floor(F.col("id") / 300) / 8.0).alias("y"))
    return [at.select("id", F.col("x").alias("xl"), F.col("y").alias("yb"), (F.col("x") + 0.05).alias("xr"), (F.col("y") + 0.05).alias("yt")) for _ in sj.RELATIONS]


def in_a_minute(spark, name, df):
    spark.sparkContext.setJobGroup(name, name, True)
    stop = Timer(60, lambda: spark.sparkContext.cancelJobGroup(name))
    stop.start()
    try:
        return df().where("p_id = q_id and q_id = r_id and r_id = s_id").count()
    finally:
        stop.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_cell_of_many_is_joined_by_tiles(spark):
    """in a cell, each join compared all with all."""
    n = 90_000
    assert in_a_minute(spark, "F2", lambda: sj.all_replicate(*few_links(spark, n), G)) == n


def test_tiles(spark):
    parts = few_links(spark, 100)
    tiles = sj.tiling(G, *parts)
    assert (tiles.width, tiles.height) == (100.0, 100.0) and 1 <= tiles.rows <= 21 and 1 <= tiles.cols <= 21
    none = frame(spark, [[0, 0, 1, 1]]).where("false")
    assert sj.tiling(G, none) == Grid(1, 1, 100.0, 100.0)
    assert sj.tiling(G, frame(spark, [[5, 5, 5, 5]])).rows >= 1
    assert sj.tiling(G, frame(spark, [[0, 0, 1e9, 1e9]])).rows == 1


def test_controlled_replication_of_a_full_cell(spark):
    """the pairs, the early output and the marks compared all with all in a cell."""
    n = 90_000
    assert in_a_minute(spark, "F4", lambda: sj.controlled_replicate(*few_links(spark, n), G)) == n


def test_marks_leave_out_what_is_far_from_borders(spark, monkeypatch):
    """every p and s was dealt to tiles, however far from the late pairs."""
    far = [[10, 10, 15, 15], [30, 30, 35, 35], [70, 80, 75, 85], [20, 75, 22, 80]]
    late = [[48, 10, 52, 12]]
    p, q, r, s = (frame(spark, rows) for rows in (far, far + late, far + late, far + [[51, 11, 53, 13]]))
    dealt, join = {}, sj.overlap_pairs

    def watched(left, right, a, b, *more):
        for x, df in ((a, left), (b, right)):
            dealt.setdefault(x, []).append(df.count())
        return join(left, right, a, b, *more)

    pairs = sj.inside_pairs(q, r, G)
    monkeypatch.setattr(sj, "overlap_pairs", watched)
    _, tagged, _ = sj.marked(p, q, r, s, G, pairs, sj.tiling(G, p, q, r, s))
    assert sorted(map(tuple, tagged.collect())) == [("Q", 4), ("R", 4), ("S", 4)]
    assert dealt["p_"] == [0] and dealt["s_"] == [1]


@pytest.mark.parametrize("seed,grid", [(1, G), (2, Grid(3, 5, 100.0, 100.0)), (3, Grid())])
def test_all_that_is_marked_is_at_a_border(spark, seed, grid):
    """Long rectangles, reversed, empty and endless ones, on borders and outside the plane."""
    rng = random.Random(seed)
    at = [-1e300, -10, 0, 20, 24.9, 25, 25.1, 33, 50, 66, 100, 120, 1e300, float("nan"), float("inf"), None]

    def rects(n):
        own = [(x, y, x + rng.choice([0, 1, 5, 25]), y + rng.choice([0, 1, 5, 40])) for x, y in ((rng.uniform(-5, 105), rng.uniform(-5, 105)) for _ in range(n))]
        own += [(x2, y, x, y) for x, y, x2, _ in own[:3]]
        return [*own, *((at[rng.randrange(12)], 20, 25, 50) for _ in range(3))], [(rng.choice(at), 5, 30, rng.choice(at)) for _ in range(25)]

    (q, _), (r, _), (x, odd) = rects(12), rects(12), rects(40)
    q, r = frame(spark, q), frame(spark, r)
    s = spark.createDataFrame([(i, *(None if v is None else float(v) for v in row)) for i, row in enumerate(x + odd)], "id long, xl double, yb double, xr double, yt double")
    late = sj.inside_pairs(q, r, grid).where("not inside")
    wide, high = late.selectExpr("max(abs(q_xr - q_xl) + abs(r_xr - r_xl))", "max(abs(q_yt - q_yb) + abs(r_yt - r_yb))").first()
    near = {x["id"] for x in sj.at_border(s, grid, wide, high).collect()}
    meets = sj.named(s, "s_").join(late, overlaps(rect("r_"), rect("s_"))).select("s_id").distinct()
    meets_q = sj.named(s, "s_").join(late, overlaps(rect("q_"), rect("s_"))).select("s_id").distinct()
    assert {x[0] for x in meets.collect()} | {x[0] for x in meets_q.collect()} <= near
