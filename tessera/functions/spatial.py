"""Column functions over rectangles (xl, yb, xr, yt) and a grid of equal cells.

Cells are numbered row by row from the lower left, cell = row * cols + col. Coordinates outside
the plane count to the nearest cell, on both sides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDS = ("xl", "yb", "xr", "yt")


@dataclass(frozen=True)
class Grid:
    """rows x cols equal cells over [0, width] x [0, height]."""

    rows: int = 1
    cols: int = 1
    width: float = 1.0
    height: float = 1.0

    def __post_init__(self) -> None:
        if self.rows < 1 or self.cols < 1 or self.width <= 0 or self.height <= 0:
            raise ValueError("a grid has at least one row and column and a positive size")

    @property
    def cell_width(self) -> float:
        return self.width / self.cols

    @property
    def cell_height(self) -> float:
        return self.height / self.rows


def rect(prefix: str = "") -> dict[str, Column]:
    """The bounds of a rectangle in columns named with a prefix."""
    return {b: F.col(f"{prefix}{b}") for b in BOUNDS}


def overlaps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two closed rectangles have a common point."""
    return (a["xl"] <= b["xr"]) & (a["xr"] >= b["xl"]) & (a["yb"] <= b["yt"]) & (a["yt"] >= b["yb"])


def _slot(value: Column, size: float, count: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(count - 1), F.floor(value / size).cast("int")))


def first_row(r: dict[str, Column], g: Grid) -> Column:
    return _slot(r["yb"], g.cell_height, g.rows)


def first_col(r: dict[str, Column], g: Grid) -> Column:
    return _slot(r["xl"], g.cell_width, g.cols)


def last_row(r: dict[str, Column], g: Grid) -> Column:
    return _slot(r["yt"], g.cell_height, g.rows)


def last_col(r: dict[str, Column], g: Grid) -> Column:
    return _slot(r["xr"], g.cell_width, g.cols)


def home_cell(r: dict[str, Column], g: Grid) -> Column:
    """The cell of the lower left corner."""
    return first_row(r, g) * g.cols + first_col(r, g)


def _cells(rows: Column, cols: Column, g: Grid) -> Column:
    return F.flatten(F.transform(rows, lambda y: F.transform(cols, lambda x: y * g.cols + x)))


def split_cells(r: dict[str, Column], g: Grid) -> Column:
    """All cells that a rectangle touches."""
    return _cells(F.sequence(first_row(r, g), last_row(r, g)), F.sequence(first_col(r, g), last_col(r, g)), g)


def closed_cells(r: dict[str, Column], g: Grid) -> Column:
    """All cells that a rectangle touches, also those of which it only touches the upper or right edge."""
    row, col = _slot(F.ceil(r["yb"] / g.cell_height) - 1, 1.0, g.rows), _slot(F.ceil(r["xl"] / g.cell_width) - 1, 1.0, g.cols)
    return _cells(F.sequence(row, last_row(r, g)), F.sequence(col, last_col(r, g)), g)


def quadrant_cells(r: dict[str, Column], g: Grid) -> Column:
    """All cells whose row and column are not before those of the home cell."""
    return _cells(F.sequence(first_row(r, g), F.lit(g.rows - 1)), F.sequence(first_col(r, g), F.lit(g.cols - 1)), g)


def crosses(r: dict[str, Column], row: Column, col: Column, g: Grid) -> Column:
    """Whether a rectangle reaches beyond the cell (row, col)."""
    return (r["xl"] < col * g.cell_width) | (r["xr"] > (col + 1) * g.cell_width) | (r["yb"] < row * g.cell_height) | (r["yt"] > (row + 1) * g.cell_height)


def overlap_midpoint(a: dict[str, Column], b: dict[str, Column]) -> tuple[Column, Column]:
    """The midpoint of the region that two rectangles share."""
    x = (F.greatest(a["xl"], b["xl"]) + F.least(a["xr"], b["xr"])) / 2
    y = (F.greatest(a["yb"], b["yb"]) + F.least(a["yt"], b["yt"])) / 2
    return x, y


def point_in_cell(x: Column, y: Column, cell: Column, g: Grid) -> Column:
    """Whether a point lies in a cell; cells are half-open, the plane's far edges belong to the last ones."""
    return _slot(y, g.cell_height, g.rows) * g.cols + _slot(x, g.cell_width, g.cols) == cell
