"""Chain joins of overlapping rectangles: P with Q, Q with R, R with S.

Inputs have a unique id and the bounds xl, yb, xr, yt; results name them p_id, q_id and so on.
A grid turns each overlap into an equality of cells, so no plan falls back to a nested loop. Where the
cells of a method are large, what meets in one of them is joined by tiles, so that no join is quadratic in a cell.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.spatial import BOUNDS, Grid, closed_cells, crosses, first_col, first_row, home_cell, overlaps, quadrant_cells, rect, split_cells
from tessera.sources.scratch import written

RELATIONS = ("p", "q", "r", "s")
IDS = [f"{x}_id" for x in RELATIONS]


def relations_of(rectangles: DataFrame) -> tuple[DataFrame, ...]:
    """The rectangles (rel, id, bounds) of P, Q, R and S; other relations are left out."""
    return tuple(rectangles.where(F.col("rel") == x.upper()).select("id", *BOUNDS) for x in RELATIONS)


def named(df: DataFrame, prefix: str) -> DataFrame:
    """df with its id and bounds under a prefix."""
    return df.select(F.col("id").alias(f"{prefix}id"), *[F.col(b).alias(f"{prefix}{b}") for b in BOUNDS])


def tiling(g: Grid, *relations: DataFrame) -> Grid:
    """Tiles for joins of the relations over the plane of g.

    They are four times as wide and high as the rectangles' root mean squares, so that a rectangle touches
    1.6 tiles on average at most. One pass over the bounds.
    """
    sides = reduce(DataFrame.unionAll, [df.select((F.col("xr") - F.col("xl")).alias("w"), (F.col("yt") - F.col("yb")).alias("h")) for df in relations])
    n, w, h = sides.agg(F.count("w"), F.sum(F.col("w") * F.col("w")), F.sum(F.col("h") * F.col("h"))).first()
    most = min(30_000, math.isqrt(n) + 1)

    def slots(size: float, squares: float | None) -> int:
        side = 4 * math.sqrt(squares / n) if n and squares is not None and 0 <= squares < math.inf else size
        return max(1, min(most, int(size / side) if side * most > size else most))

    return Grid(slots(g.height, h), slots(g.width, w), g.width, g.height)


def overlap_pairs(left: DataFrame, right: DataFrame, a: str, b: str, g: Grid, within: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of overlapping rectangles, once each.

    Both sides are dealt to the cells they touch, and a pair is taken in the cell that holds the
    lower left corner of what they share, so nothing needs to be made distinct. left and right
    carry their bounds under the prefixes a and b; other columns are kept. Columns named in `within` must agree.
    Neither side is broadcast by its estimated size, which leaves out that its rows are dealt to many cells.
    """
    ra, rb = rect(a), rect(b)
    x = left.withColumn("tile", F.explode(split_cells(ra, g)))
    y = right.withColumn("tile", F.explode(split_cells(rb, g)))
    owner = F.greatest(first_row(ra, g), first_row(rb, g)) * g.cols + F.greatest(first_col(ra, g), first_col(rb, g))
    return x.join(y.hint("merge"), [*within, "tile"]).where(overlaps(ra, rb) & (F.col("tile") == owner)).drop("tile")


def chain_join(p: DataFrame, q: DataFrame, r: DataFrame, s: DataFrame, g: Grid) -> DataFrame:
    """p_id, q_id, r_id, s_id of the chain, by three grid joins; the plan for large inputs."""
    p, q, r, s = (named(df, f"{x}_") for df, x in zip((p, q, r, s), RELATIONS))
    pq = overlap_pairs(p, q, "p_", "q_", g).drop(*[f"p_{b}" for b in BOUNDS])
    pqr = overlap_pairs(pq, r, "q_", "r_", g).drop(*[f"q_{b}" for b in BOUNDS])
    return overlap_pairs(pqr, s, "r_", "s_", g).select(*IDS)


def all_replicate(p: DataFrame, q: DataFrame, r: DataFrame, s: DataFrame, g: Grid, tiles: Grid | None = None) -> DataFrame:
    """The chain in one round: every rectangle goes to all cells of its first quadrant.

    A chain is taken in the cell of its members' largest home row and home column, to which each
    of them is sent. The last cell gets every rectangle, so in a cell they meet by tiles (tiling(), if not given);
    chain_join, which makes no copies, is the plan for many.
    """
    tiles = tiling(g, p, q, r, s) if tiles is None else tiles
    parts = []
    for df, x in zip((p, q, r, s), RELATIONS):
        own, at = named(df, f"{x}_"), rect(f"{x}_")
        parts.append(own.withColumn("cell", F.explode(quadrant_cells(at, g))))
    home = lambda x: (first_row(rect(f"{x}_"), g), first_col(rect(f"{x}_"), g))
    out = parts[0].withColumns(dict(zip(("row", "col"), home("p"))))
    for i in range(1, 4):
        a, b = RELATIONS[i - 1], RELATIONS[i]
        out = overlap_pairs(out, parts[i], f"{a}_", f"{b}_", tiles, ("cell",)).drop(*[f"{a}_{c}" for c in BOUNDS])
        row, col = home(b)
        out = out.withColumns({"row": F.greatest("row", row), "col": F.greatest("col", col)})
    return out.where(F.col("cell") == F.col("row") * g.cols + F.col("col")).select(*IDS)


def inside_pairs(q: DataFrame, r: DataFrame, g: Grid, tiles: Grid | None = None) -> DataFrame:
    """q and r pairs that overlap, with inside: both lie in one cell. They are found by tiles, or by the cells of g if none are given."""
    pairs = overlap_pairs(named(q, "q_"), named(r, "r_"), "q_", "r_", g if tiles is None else tiles)
    inside = home_cell(rect("q_"), g) == home_cell(rect("r_"), g)
    for x in ("q_", "r_"):
        inside = inside & ~crosses(rect(x), first_row(rect(x), g), first_col(rect(x), g), g)
    return pairs.withColumn("inside", inside)


def early_output(p: DataFrame, q: DataFrame, r: DataFrame, s: DataFrame, g: Grid, pairs: DataFrame | None = None, tiles: Grid | None = None) -> DataFrame:
    """Chains whose q and r lie in one cell. pairs: inside_pairs(), if there already.

    p and s only need to touch that cell, the upper or right edge included, and meet q and r by its tiles.
    """
    tiles = tiling(g, p, q, r, s) if tiles is None else tiles
    pairs = inside_pairs(q, r, g, tiles) if pairs is None else pairs
    pairs = pairs.where("inside").withColumn("cell", home_cell(rect("q_"), g))
    p, s = (named(df, f"{x}_").withColumn("cell", F.explode(closed_cells(rect(f"{x}_"), g))) for df, x in ((p, "p"), (s, "s")))
    out = overlap_pairs(pairs, p, "q_", "p_", tiles, ("cell",)).drop(*[f"{x}_{c}" for x in "pq" for c in BOUNDS])
    return overlap_pairs(out, s, "r_", "s_", tiles, ("cell",)).select(*IDS)


def at_border(df: DataFrame, g: Grid, wide: float, high: float) -> DataFrame:
    """Rectangles that do not lie within one cell when they are extended by wide and high on both sides; no shuffle."""

    def within(a: str, b: str, more: float, size: float, count: int) -> Column:
        more += size / 1e6  # for rounding
        low, up = F.least(a, b) - F.lit(more), F.greatest(a, b) + F.lit(more)
        slot = F.floor(low / size).cast("double")
        return (slot >= 0) & (slot < count) & (up < (slot + 1) * size)

    return df.where(~(within("xl", "xr", wide, g.cell_width, g.cols) & within("yb", "yt", high, g.cell_height, g.rows)))


def marked(p: DataFrame, q: DataFrame, r: DataFrame, s: DataFrame, g: Grid, pairs: DataFrame | None = None, tiles: Grid | None = None) -> tuple[DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """The late pairs (q_id, r_id), and what must be replicated of each relation.

    Late pairs are those not inside one cell. Of Q and R their members are marked, of P and S what
    overlaps a marked q or r. A late pair leaves its cell, so a p or s that is further from the border than
    the pairs are long is left out before anything is shuffled. The pairs are written down if they are not there,
    as all that follows reads them.
    """
    tiles = tiling(g, p, q, r, s) if tiles is None else tiles
    late = (written(inside_pairs(q, r, g, tiles)) if pairs is None else pairs).where("not inside")
    own = lambda x: late.select(F.col(f"{x}_id").alias("id"), *[F.col(f"{x}_{b}").alias(b) for b in BOUNDS]).distinct()
    mq, mr = own("q"), own("r")
    length = lambda a, b: F.coalesce(F.max(sum(F.abs(F.col(f"{x}_{b}") - F.col(f"{x}_{a}")) for x in "qr")), F.lit(0.0))
    wide, high = late.agg(length("xl", "xr"), length("yb", "yt")).first()
    p, s = (at_border(df, g, wide, high) for df in (p, s))
    mp = p.join(overlap_pairs(named(p, "p_"), named(mq, "q_"), "p_", "q_", tiles).select(F.col("p_id").alias("id")), "id", "left_semi")
    ms = s.join(overlap_pairs(named(mr, "r_"), named(s, "s_"), "r_", "s_", tiles).select(F.col("s_id").alias("id")), "id", "left_semi")
    tagged = [df.select(F.lit(x.upper()).alias("rel"), "id") for df, x in zip((mp, mq, mr, ms), RELATIONS)]
    return late.select("q_id", "r_id"), tagged[0].unionAll(tagged[1]).unionAll(tagged[2]).unionAll(tagged[3]), (mp, mq, mr, ms)


def late_output(p: DataFrame, q: DataFrame, r: DataFrame, s: DataFrame, g: Grid, pairs: DataFrame | None = None, tiles: Grid | None = None) -> DataFrame:
    """Chains of late pairs: all_replicate over what is marked."""
    tiles = tiling(g, p, q, r, s) if tiles is None else tiles
    late, _, parts = marked(p, q, r, s, g, pairs, tiles)
    return all_replicate(*parts, g, tiles).join(late, ["q_id", "r_id"], "left_semi").select(*IDS)


def outputs(p: DataFrame, q: DataFrame, r: DataFrame, s: DataFrame, g: Grid) -> tuple[DataFrame, DataFrame]:
    """Early and late output of controlled replication; the q and r pairs are joined once for both."""
    tiles = tiling(g, p, q, r, s)
    pairs = written(inside_pairs(q, r, g, tiles))
    return early_output(p, q, r, s, g, pairs, tiles), late_output(p, q, r, s, g, pairs, tiles)


def controlled_replicate(p: DataFrame, q: DataFrame, r: DataFrame, s: DataFrame, g: Grid) -> DataFrame:
    """The chain in two rounds: early output, and late output over marked rectangles only."""
    early, late = outputs(p, q, r, s, g)
    return early.unionAll(late)


def chain_record(chains: DataFrame) -> DataFrame:
    """value, `<p | q | r | s>`, for a record writer."""
    return chains.select(F.format_string("<%s | %s | %s | %s>", *IDS).alias("value"))
