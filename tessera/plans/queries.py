"""One query for each operator: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import spatial as sp
from tessera.functions import text as tx
from tessera.functions.spatial import Grid
from tessera.operators import grades, graph, range_join, skew_join, spatial_join, words
from tessera.plans import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Lines that show the token rules.
TOKEN_LINES = ["", "   ", " a", "a  b ", "A,b\tC", "x", "Hello  World", " "]
#: Letters that show the points.
LETTERS = ["EX", "ex", "A", "b", "C", "d", "P", "F", "", "a+"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def word_count(spark, sf_dir):
    return words.word_count(fx.document_lines(spark, sf_dir))


@query
def word_count_total(spark, sf_dir):
    return words.word_totals(fx.document_lines(spark, sf_dir))


@query
def token_edge_cases(spark, sf_dir):
    lines = spark.createDataFrame([(x,) for x in TOKEN_LINES], "value string")
    return words.word_count(lines)


@query
def join_reg_grades(spark, sf_dir):
    regs, marks, _ = fx.grade_tables(spark, sf_dir)
    return grades.join_grades(regs, marks)


@query
def three_table_join(spark, sf_dir):
    return grades.three_table_join(*fx.grade_tables(spark, sf_dir))


@query
def grade_points(spark, sf_dir):
    letters = spark.createDataFrame([(x,) for x in LETTERS], "grade string")
    return letters.select("grade", tx.grade_points(F.col("grade")).alias("points"))


@query
def semester_gpa(spark, sf_dir):
    return grades.semester_gpa(three_table_join(spark, sf_dir))


@query
def cumulative_gpa(spark, sf_dir):
    return grades.cumulative_gpa(three_table_join(spark, sf_dir))


@query
def grade_report(spark, sf_dir):
    return grades.grade_report(three_table_join(spark, sf_dir))


@query
def range_join_rows(spark, sf_dir):
    return range_join.range_join(*fx.customers_orders(spark, sf_dir), fx.SPLITS)


@query
def range_join_partition_counts(spark, sf_dir):
    placed = range_join.range_join(*fx.customers_orders(spark, sf_dir), fx.SPLITS)
    return placed.groupBy("bucket", F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n"))


@query
def edges_canonical(spark, sf_dir):
    return graph.edges_canonical(fx.dense_graph(spark, sf_dir))


@query
def wedges(spark, sf_dir):
    return graph.wedges(fx.thin_graph(spark, sf_dir))


@query
def triangles(spark, sf_dir):
    return graph.triangles(fx.thin_graph(spark, sf_dir))


@query
def triangle_edge_counts(spark, sf_dir):
    return graph.triangle_edge_counts(fx.thin_graph(spark, sf_dir))


@query
def diamonds_per_edge(spark, sf_dir):
    return graph.diamonds_per_edge(fx.dense_graph(spark, sf_dir))


@query
def diamond_total(spark, sf_dir):
    return graph.diamond_total(fx.dense_graph(spark, sf_dir))


@query
def diamond_partitioned(spark, sf_dir):
    return graph.diamonds_by_partition(fx.thin_graph(spark, sf_dir), 6)


@query
def diamond_partitioned_total(spark, sf_dir):
    return graph.diamond_total_partitioned(fx.thin_graph(spark, sf_dir), 6)


@query
def wedges_whole(spark, sf_dir):
    return graph.wedges(fx.whole_graph(spark, sf_dir))


@query
def triangles_whole(spark, sf_dir):
    return graph.triangles(fx.whole_graph(spark, sf_dir))


@query
def triangle_edge_counts_whole(spark, sf_dir):
    return graph.triangle_edge_counts(fx.whole_graph(spark, sf_dir))


@query
def diamond_partitioned_whole(spark, sf_dir):
    return graph.diamonds_by_partition(fx.whole_graph(spark, sf_dir), 6)


@query
def diamond_partitioned_total_whole(spark, sf_dir):
    return graph.diamond_total_partitioned(fx.whole_graph(spark, sf_dir), 6)


def over_rectangles(f: Callable[[tuple[DataFrame, ...], Grid], DataFrame]) -> Callable:
    """Register f over the rectangles that the SQL fixes, and as *_whole over all rows."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(fx.rectangles(spark, sf_dir), fx.GRID)
    QUERIES[f"{f.__name__}_whole"] = lambda spark, sf_dir: f(*fx.rectangles_whole(spark, sf_dir))
    return f


def _coarse(grid: Grid) -> Grid:
    """For replication: the last cell gets every row whatever the grid, so more cells only make more copies. Tiles join what meets in one."""
    return Grid(4, 4, grid.width, grid.height)


@over_rectangles
def rect_cells_split(relations, grid):
    return relations[0].select("id", F.explode(sp.split_cells(sp.rect(), grid)).alias("cell"))


@over_rectangles
def rect_cells_first_quadrant(relations, grid):
    return relations[1].select("id", F.explode(sp.quadrant_cells(sp.rect(), grid)).alias("cell"))


@over_rectangles
def rect_crossing(relations, grid):
    own = sp.rect()
    row, col = sp.first_row(own, grid), sp.first_col(own, grid)
    return relations[2].select("id", sp.home_cell(own, grid).alias("cell"), sp.crosses(own, row, col, grid).alias("crosses"))


@over_rectangles
def rect_overlap_pairs(relations, grid):
    _, q, r, _ = relations
    pairs = spatial_join.overlap_pairs(spatial_join.named(q, "q_"), spatial_join.named(r, "r_"), "q_", "r_", grid)
    x, y = sp.overlap_midpoint(sp.rect("q_"), sp.rect("r_"))
    return pairs.select("q_id", "r_id", x.alias("mid_x"), y.alias("mid_y"))


@over_rectangles
def rect_chain(relations, grid):
    return spatial_join.chain_join(*relations, grid)


@over_rectangles
def rect_all_replicate(relations, grid):
    return spatial_join.all_replicate(*relations, _coarse(grid))


@over_rectangles
def rect_early_output(relations, grid):
    return spatial_join.early_output(*relations, grid)


@over_rectangles
def rect_marked(relations, grid):
    return spatial_join.marked(*relations, grid)[1]


@over_rectangles
def rect_controlled_replicate(relations, grid):
    return spatial_join.controlled_replicate(*relations, _coarse(grid))


Relations = tuple[DataFrame, DataFrame, DataFrame]


def over_chain(name: str) -> Callable:
    """Register a plan over the relations that the SQL fixes, and as *_whole over all rows."""

    def register(f: Callable[[SparkSession, Relations], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(spark, fx.chain_relations(spark, sf_dir))
        QUERIES[f"{name}_whole"] = lambda spark, sf_dir: f(spark, fx.chain_relations_whole(spark, sf_dir))
        return f

    return register


@over_chain("chain_join")
def chain_join(spark, relations):
    return skew_join.chain_join(*relations)


@over_chain("chain_join_count")
def chain_join_count(spark, relations):
    return skew_join.chain_join_count(*relations).select(F.col("n").cast("long").alias("n"))


@over_chain("heavy_hitters")
def heavy_hitters(spark, relations):
    r, _, t = relations
    rows = [("B", int(v), i) for i, v in enumerate(skew_join.heavy_hitters(r, "B", top=2))] + [("C", int(v), i) for i, v in enumerate(skew_join.heavy_hitters(t, "C", top=2))]
    return spark.createDataFrame(rows, "key string, value long, place long")


def _residual(name: str) -> None:
    @over_chain(f"residual_{name}")
    def run(spark, relations):
        r, s, t = relations
        b, c = skew_join.heavy_hitters(r, "B", top=2), skew_join.heavy_hitters(t, "C", top=2)
        return skew_join.residual_join(name, skew_join.residuals(r, s, t, b, c)[name], skew_join.sizes(r, s, t, b, c)[name], 100)


for _name in ("light", "hb", "hc", "hbhc"):
    _residual(_name)


@over_chain("skew_join")
def skew_join_rows(spark, relations):
    r, s, t = relations
    return skew_join.skew_join(r, s, t, skew_join.heavy_hitters(r, "B", top=2), skew_join.heavy_hitters(t, "C", top=2))


QUERIES["range_join"] = QUERIES.pop("range_join_rows")
