"""Command line over text files: python -m tessera [-D KEY=VALUE]... PROGRAM ARGUMENT...

wordcount IN OUT                                    key-value counts of words
gradejoin REGISTRATIONS GRADES SUBJECTS TEMP OUT    first join to TEMP, three-table join to OUT
gpa IN OUT                                          grade reports of a three-table join's output
rangejoin CUSTOMERS ORDERS SPLITS OUT               join placed by the split points of a file
diamonds IN OUT                                     number of diamonds of an edge list
diamondsp IN OUT P                                  the same by partition replication, P parts
replicate IN OUT ROWS COLS WIDTH HEIGHT             rectangle chains by full replication
controlled IN OUT ROWS COLS WIDTH HEIGHT            rectangle chains by controlled replication, early and late apart
skew [LIGHT HEAVY THRESHOLD]                        counts and times of the skew-aware and the plain join on generated relations
vanilla [LIGHT HEAVY]                               count and time of the plain join on the larger generated relations

OUT must not exist. -D sets a Spark setting, or grid.rows, grid.cols, grid.width, grid.height and partitions.p, which
stand in for arguments left out at the end. The counts of skew and vanilla come from key frequencies; with LIGHT
and HEAVY the joins are also listed and timed, which suits up to some hundred heavy rows.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.spatial import Grid
from tessera.operators import grades, graph, range_join, skew_join, spatial_join, words
from tessera.sources import generate, readers, writers


def wordcount(spark: SparkSession, source: str, out: str) -> None:
    writers.write_key_value(words.word_count(readers.read_lines(spark, source)).orderBy("word"), out)


def gradejoin(spark: SparkSession, registrations: str, marks: str, subjects: str, temp: str, out: str) -> None:
    graded = grades.join_grades(grades.parse_registrations(readers.read_lines(spark, registrations)), grades.parse_grades(readers.read_lines(spark, marks)))
    writers.write_records(graded, temp)
    writers.write_records(grades.join_subjects(graded, grades.parse_subjects(readers.read_lines(spark, subjects))), out)


def gpa(spark: SparkSession, source: str, out: str) -> None:
    writers.write_key_value(grades.grade_report(grades.parse_joined(readers.read_lines(spark, source))).orderBy("student_id"), out)


def rangejoin(spark: SparkSession, customers: str, orders: str, splits: str, out: str) -> None:
    joined = range_join.range_join(range_join.parse_customers(readers.read_lines(spark, customers)), range_join.parse_orders(readers.read_lines(spark, orders)), readers.read_split_points(spark, splits))
    writers.write_key_value(range_join.join_record(joined), out)


def diamonds(spark: SparkSession, source: str, out: str) -> None:
    writers.write_key_value(graph.diamond_total(readers.parse_edges(readers.read_lines(spark, source))), out)


def diamondsp(spark: SparkSession, source: str, out: str, parts: str = "10") -> None:
    writers.write_key_value(graph.diamond_total_partitioned(readers.parse_edges(readers.read_lines(spark, source), exact=False), int(parts)), out)


def _rectangles(spark: SparkSession, source: str, grid: tuple[str, ...]):
    rows, cols, width, height = grid
    return spatial_join.relations_of(readers.parse_rectangles(readers.read_lines(spark, source))), Grid(int(rows), int(cols), float(width), float(height))


def replicate(spark: SparkSession, source: str, out: str, *grid: str) -> None:
    parts, g = _rectangles(spark, source, grid)
    writers.write_records(spatial_join.chain_record(spatial_join.all_replicate(*parts, g)), out)


def controlled(spark: SparkSession, source: str, out: str, *grid: str) -> None:
    parts, g = _rectangles(spark, source, grid)
    early, late = spatial_join.outputs(*parts, g)
    writers.write_named({"early": spatial_join.chain_record(early), "late": spatial_join.chain_record(late)}, out)


def _timed(name: str, df: DataFrame) -> None:
    start = time.perf_counter()
    n = df.agg(F.count(F.lit(1))).first()[0]
    print(f"{name}: {n} rows in {1000 * (time.perf_counter() - start):.0f} ms")


def _counts(r: DataFrame, s: DataFrame, t: DataFrame) -> None:
    for name, df in (("R", r), ("S", s), ("T", t)):
        print(f"{name}: {df.count()} rows")
    start = time.perf_counter()
    n = skew_join.chain_join_count(r, s, t).first()["n"]
    print(f"size of the join by key frequencies: {n} rows in {1000 * (time.perf_counter() - start):.0f} ms")


def skew(spark: SparkSession, light: str = "10000", heavy: str = "", threshold: str = "") -> None:
    r, s, t = generate.skewed_relations(spark, int(light), int(heavy or 100_000))
    _counts(r, s, t)
    least = int(threshold or int(heavy or 100_000) // 2)
    heavy_b, heavy_c = skew_join.heavy_hitters(r, "B", threshold=least), skew_join.heavy_hitters(t, "C", threshold=least)
    print(f"heavy values of B: {heavy_b}, of C: {heavy_c}")
    for name, part in skew_join.residuals(r, s, t, heavy_b, heavy_c).items():
        print(f"residual {name}: {skew_join.chain_join_count(part.r, part.s, part.t).first()['n']} rows")
    if heavy:
        _timed("skew-aware join", skew_join.skew_join(r, s, t, heavy_b, heavy_c))
        _timed("plain join", skew_join.chain_join(r, s, t))


def vanilla(spark: SparkSession, light: str = "100000", heavy: str = "") -> None:
    r, s, t = generate.plain_skewed_relations(spark, int(light), int(heavy or 1_000_000))
    _counts(r, s, t)
    if heavy:
        _timed("plain join", skew_join.chain_join(r, s, t))


#: What settings stand in for, by program and place.
DEFAULTS = {"diamondsp": {2: ("partitions.p", "10")}} | {name: {2: ("grid.rows", "1"), 3: ("grid.cols", "1"), 4: ("grid.width", "1.0"), 5: ("grid.height", "1.0")} for name in ("replicate", "controlled")}


#: The programs and how many arguments they take.
PROGRAMS = {"wordcount": (wordcount, 2, 2), "gradejoin": (gradejoin, 5, 5), "gpa": (gpa, 2, 2), "rangejoin": (rangejoin, 4, 4), "diamonds": (diamonds, 2, 2), "diamondsp": (diamondsp, 2, 3), "replicate": (replicate, 2, 6), "controlled": (controlled, 2, 6), "skew": (skew, 0, 3), "vanilla": (vanilla, 0, 2)}


def main(arguments: list[str]) -> int:
    settings, rest = {}, list(arguments)
    while rest[:1] == ["-D"] and len(rest) > 1 and "=" in rest[1]:
        key, _, value = rest[1].partition("=")
        settings[key] = value
        rest = rest[2:]
    name, rest = (rest or [""])[0], rest[1:]
    if name not in PROGRAMS or not PROGRAMS[name][1] <= len(rest) <= PROGRAMS[name][2]:
        print(__doc__, file=sys.stderr)
        return 2
    for place, (key, value) in DEFAULTS.get(name, {}).items():
        if place == len(rest):
            rest.append(settings.get(key, value))
    builder = SparkSession.builder.appName(f"tessera {name}")
    for key, value in settings.items():
        if key.startswith("spark."):
            builder = builder.config(key, value)
    PROGRAMS[name][0](builder.getOrCreate(), *rest)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
