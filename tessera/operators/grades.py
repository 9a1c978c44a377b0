"""Registrations, grades and subjects: the three-table join and credit-weighted averages.

Identifiers are strings, as their files have them. Quotation marks are removed from all three
inputs; rows with another number of fields than their file's are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx

JOINED = ["subject_id", "student_id", "grade", "year", "semester", "credits"]


def _fields(lines: DataFrame) -> DataFrame:
    return lines.select(tx.split_trailing(F.col("value"), ",").alias("f"))


def _named(rows: DataFrame, positions: dict[str, int]) -> DataFrame:
    return rows.select(*[tx.unquote(tx.field(F.col("f"), i)).alias(name) for name, i in positions.items()])


def parse_registrations(lines: DataFrame) -> DataFrame:
    """registration_id, student_id, subject_id of rows of five fields."""
    return _named(_fields(lines).where(F.size("f") == 5), {"registration_id": 0, "student_id": 3, "subject_id": 4})


def parse_grades(lines: DataFrame) -> DataFrame:
    """registration_id, grade of rows of six fields."""
    return _named(_fields(lines).where(F.size("f") == 6), {"registration_id": 4, "grade": 5})


def parse_subjects(lines: DataFrame) -> DataFrame:
    """subject_id, year, semester, credits of rows of twelve fields or more."""
    return _named(_fields(lines).where(F.size("f") >= 12), {"subject_id": 8, "year": 3, "semester": 4, "credits": 11})


def parse_joined(lines: DataFrame) -> DataFrame:
    """The columns of the three-table join, of rows of six fields."""
    return _fields(lines).where(F.size("f") == 6).select(*[tx.field(F.col("f"), i).alias(c) for i, c in enumerate(JOINED)])


def join_grades(registrations: DataFrame, grades: DataFrame) -> DataFrame:
    """registration_id, student_id, subject_id, grade: inner and many-to-many."""
    return registrations.join(grades, "registration_id").select("registration_id", "student_id", "subject_id", "grade")


def join_subjects(graded: DataFrame, subjects: DataFrame) -> DataFrame:
    """JOINED columns: inner and many-to-many on the subject."""
    return graded.join(subjects, "subject_id").select(*JOINED)


def three_table_join(registrations: DataFrame, grades: DataFrame, subjects: DataFrame) -> DataFrame:
    """Both joins in one plan; which side is broadcast is decided by measured sizes."""
    return join_subjects(join_grades(registrations, grades), subjects)


def semester_totals(joined: DataFrame) -> DataFrame:
    """student_id, semester, points and credits, each summed; rows whose credits are no integer are skipped.

    The year is not looked at. An unknown grade adds no points but its credits.
    """
    clean = joined.select(
        tx.trim_control(F.col("student_id").cast("string")).alias("student_id"),
        tx.trim_control(F.col("semester").cast("string")).alias("semester"),
        tx.grade_points(tx.trim_control(F.col("grade"))).alias("points"),
        tx.to_int(tx.trim_control(F.col("credits").cast("string"))).cast("long").alias("credits"),
    ).where(F.col("credits").isNotNull())
    return clean.groupBy("student_id", "semester").agg(F.sum(F.col("points") * F.col("credits")).alias("points"), F.sum("credits").alias("credits"))


def _mean():
    return F.when(F.col("credits") > 0, F.col("points") / F.col("credits")).otherwise(F.lit(0.0))


def semester_gpa(joined: DataFrame) -> DataFrame:
    """student_id, semester, sgpa; 0 where there are no credits."""
    return semester_totals(joined).select("student_id", "semester", _mean().alias("sgpa"))


def cumulative_gpa(joined: DataFrame) -> DataFrame:
    """student_id, cgpa: the ratio of all points to all credits, not the mean of semesters."""
    total = semester_totals(joined).groupBy("student_id").agg(F.sum("points").alias("points"), F.sum("credits").alias("credits"))
    return total.select("student_id", _mean().alias("cgpa"))


def grade_report(joined: DataFrame) -> DataFrame:
    """student_id and report, `sgpa_<semester>:<x.xx>,...,cgpa:<x.xx>`, semesters in the order of their strings.

    One pass: a student's few semester totals give both averages.
    """
    each = semester_totals(joined)
    entry = F.struct("semester", F.concat(F.lit("sgpa_"), "semester", F.lit(":"), tx.two_decimals(_mean())).alias("text"))
    of = each.groupBy("student_id").agg(F.array_sort(F.collect_list(entry)).alias("semesters"), F.sum("points").alias("points"), F.sum("credits").alias("credits"))
    parts = F.concat(F.col("semesters.text"), F.array(F.concat(F.lit("cgpa:"), tx.two_decimals(_mean()))))
    return of.select("student_id", F.array_join(parts, ",").alias("report"))
