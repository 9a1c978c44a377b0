"""Column functions with the text rules of line-oriented jobs: Java's split, trim and number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grade letters and their points; all other letters count 0. Fixed values.
GRADE_POINTS = {"EX": 10, "A": 9, "B": 8, "C": 7, "D": 6, "P": 5}


def lines(text: Column) -> Column:
    """The lines of a text, ended by LF, CR or CRLF; a final line end opens no further line."""
    body = F.regexp_replace(text, r"(\r\n|\r|\n)\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r\n|\r|\n"))


def split_trailing(value: Column, separator: str) -> Column:
    """Split at a literal one-character separator; empty fields at the end are dropped.

    A value of separators only has no fields; the empty value has one, the empty field.
    """
    quoted = f"\\Q{separator}\\E"
    parts = F.split(F.regexp_replace(value, f"(?:{quoted})+\\z", ""), quoted)
    return F.when(value.rlike(f"\\A(?:{quoted})+\\z"), F.array().cast("array<string>")).otherwise(parts)


def field(fields: Column, position: int) -> Column:
    """Field at a position from 0, null beyond the end."""
    return F.try_element_at(fields, F.lit(position + 1))


def unquote(value: Column) -> Column:
    """Without any double quote."""
    return F.replace(value, F.lit('"'), F.lit(""))


def trim_control(value: Column) -> Column:
    """Without characters up to U+0020 at either end."""
    return F.regexp_replace(value, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def to_int(value: Column) -> Column:
    """A 32-bit integer written with an optional sign and digits only; null for anything else."""
    return F.when(value.rlike(r"\A[+-]?[0-9]+\z"), value.try_cast("int"))


def to_long(value: Column, strict: bool = True) -> Column:
    """A 64-bit integer; bad input raises if strict, else gives null."""
    return value.cast("long") if strict else F.when(value.rlike(r"\A[+-]?[0-9]+\z"), value.try_cast("long"))


def to_double(value: Column) -> Column:
    """A double; null for bad input. Blanks at either end are allowed."""
    return trim_control(value).try_cast("double")


def grade_points(letter: Column) -> Column:
    """Points of a grade letter in either case; 0 for an unknown one or null."""
    upper, out = F.upper(letter), None
    for name, points in GRADE_POINTS.items():
        out = F.when(upper == name, points) if out is None else out.when(upper == name, points)
    return out.otherwise(0)


def two_decimals(value: Column) -> Column:
    """With two decimals, halves rounded up on the shortest decimal form."""
    return F.format_string("%.2f", value)


def pairs_among(n: Column) -> Column:
    """n (n - 1) / 2, in integers only: one of n and n - 1 is halved first."""
    even = F.shiftright(n, 1) * (n - 1)
    odd = n * F.shiftright(n - 1, 1)
    return F.when(n % 2 == 0, even).otherwise(odd)


def canonical_pair(u: Column, v: Column) -> tuple[Column, Column]:
    """The smaller and the larger of two values."""
    return F.least(u, v), F.greatest(u, v)
