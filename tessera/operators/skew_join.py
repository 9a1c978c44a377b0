"""The chain join R(A,B), S(B,E,C), T(C,D) with heavy keys treated apart.

Heavy values of B and C split each relation into four disjoint residual joins. The light one is
planned as usual; in the others each relation is dealt to a hypercube of buckets over the
attributes that are not heavy, with shares from the relations' sizes, so that a heavy key's rows
meet in many tasks. Null keys join nothing, in all residuals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUT = ["A", "B", "E", "C", "D"]


def chain_join(r: DataFrame, s: DataFrame, t: DataFrame) -> DataFrame:
    """A, B, E, C, D: two joins, planned as usual."""
    return r.join(s, "B").join(t, "C").select(*OUT)


def chain_join_count(r: DataFrame, s: DataFrame, t: DataFrame) -> DataFrame:
    """One row (n): the size of the chain, from the keys' frequencies, without listing it; up to 38 digits, beyond which it raises."""
    nr, nt = r.groupBy("B").agg(F.count(F.lit(1)).alias("nr")), t.groupBy("C").agg(F.count(F.lit(1)).alias("nt"))
    ns = s.groupBy("B", "C").agg(F.count(F.lit(1)).alias("ns"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    product = (wide("nr") * wide("ns")).cast("decimal(38,0)") * wide("nt")
    return ns.join(nr, "B").join(nt, "C").agg(F.coalesce(F.sum(product), F.lit(0)).cast("decimal(38,0)").alias("n"))


def frequencies(df: DataFrame, key: str, name: str) -> DataFrame:
    """key, name: how often each value of the key occurs; null is left out."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).cast("double").alias(name))


def dealt_join(left: DataFrame, right: DataFrame, key: str, left_sizes: DataFrame | None = None, most_rows: int = 1 << 22, most: int = 1000) -> DataFrame:
    """left.join(right, key); a key with more than `most_rows` rows of result is dealt to rectangles of about that many.

    Its rows on the left are cut into parts by their hash, those on the right too (equal rows stay together), and each part
    meets each of the other side, so copies are about 2 / sqrt(most_rows) of the result. left_sizes (key, nl) spares counting the
    left. At most `most` keys are dealt, those with most rows of result; one beyond these keeps one task, with the same rows.
    """
    nl, nr = F.col("nl"), F.col("nr")
    pairs = (left_sizes if left_sizes is not None else frequencies(left, key, "nl")).join(frequencies(right, key, "nr"), key)
    heavy = pairs.where(nl * nr > most_rows).orderBy(F.desc(nl * nr), key).limit(most).collect()
    kinds = [df.schema[key].dataType for df in (left, right)]
    whole = all(isinstance(x, T.IntegralType) for x in kinds)
    if not heavy or not whole and kinds[0] != kinds[1]:  # equal values of two types have two hashes
        return left.join(right, key)
    cut, every = {}, 0
    for x in heavy:
        parts = x["nl"] * x["nr"] / most_rows
        i = min(max(1.0, math.sqrt(parts * x["nl"] / x["nr"])), parts)
        n_i, n_j = math.ceil(i), math.ceil(parts / i)
        cut[x[key]] = (n_i, n_j, every)
        every += n_i * n_j
    spark = left.sparkSession
    fields = [left.schema[key], T.StructField("n_i_", T.IntegerType()), T.StructField("n_j_", T.IntegerType()), T.StructField("from_", T.LongType())]
    found = F.broadcast(spark.createDataFrame([(k, *v) for k, v in cut.items()], T.StructType(fields)))
    part = lambda df, n: F.pmod(F.xxhash64(*df.columns), n).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    n_i, n_j = F.coalesce("n_i_", F.lit(1)), F.coalesce("n_j_", F.lit(1))
    # A number of tasks of its own, four rectangles each: few rows that give many would else be gathered in few tasks. Rectangles
    # are numbered through and dealt in turn, as by their hash some tasks would get several times what others get.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(10_000, math.ceil(every / 4)))
    number = F.coalesce(F.col("from_") + F.col("i_") * F.col("n_j_").cast("long") + F.col("j_"), F.hash(F.col(key).cast("long") if whole else key))
    task = F.pmod(number, F.lit(tasks)).cast("int").alias("task_")
    one = left.join(found, key, "left").select("*", part(left, n_i).alias("i_"), to(n_j).alias("j_")).select(*left.columns, "i_", "j_", task)
    other = right.join(found, key, "left").select("*", to(n_i).alias("i_"), part(right, n_j).alias("j_")).select(*right.columns, "i_", "j_", task)
    at = ["i_", "j_", "task_"]
    return one.repartitionById(tasks, "task_").join(other.repartitionById(tasks, "task_"), [key, *at]).drop(*at)


def dealt_chain_join(r: DataFrame, s: DataFrame, t: DataFrame, most_rows: int = 1 << 22) -> DataFrame:
    """chain_join in the same two joins, each dealt; the sizes of the second come from frequencies, without listing the first."""
    ns = s.groupBy("B", "C").agg(F.count(F.lit(1)).cast("double").alias("ns"))
    middle = ns.join(frequencies(r, "B", "nr"), "B").where(F.col("C").isNotNull()).groupBy("C").agg(F.sum(F.col("ns") * F.col("nr")).alias("nl"))
    rs = dealt_join(r, s, "B", most_rows=most_rows)
    return dealt_join(rs, t, "C", middle, most_rows).select(*OUT)


def heavy_hitters(df: DataFrame, column: str, threshold: int | None = None, top: int | None = None, most: int = 1000) -> list:
    """Values of a column that occur at least `threshold` times, or the `top` most frequent (smaller values first among equals).

    At most `most` values are returned, the most frequent; a value beyond these is treated as
    light, which is slower for it but gives the same rows.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if threshold is not None:
        counts = counts.where(F.col("n") >= threshold)
    return [x[0] for x in counts.orderBy(F.desc("n"), column).limit(min(top, most) if top is not None else most).collect()]


def is_heavy(column: str, values: list) -> Column:
    return F.col(column).isin(values) if values else F.lit(False)


def is_light(column: str, values: list) -> Column:
    """Not heavy and not null."""
    return ~F.col(column).isin(values) if values else F.col(column).isNotNull()


@dataclass(frozen=True)
class Residual:
    """The parts of the relations for one combination of heavy and light."""

    r: DataFrame
    s: DataFrame
    t: DataFrame


def residuals(r: DataFrame, s: DataFrame, t: DataFrame, heavy_b: list, heavy_c: list) -> dict[str, Residual]:
    """light (neither key heavy), hb (B heavy), hc (C heavy) and hbhc (both)."""
    b = {True: is_heavy("B", heavy_b), False: is_light("B", heavy_b)}
    c = {True: is_heavy("C", heavy_c), False: is_light("C", heavy_c)}
    cases = {"light": (False, False), "hb": (True, False), "hc": (False, True), "hbhc": (True, True)}
    return {name: Residual(r.where(b[x]), s.where(b[x] & c[y]), t.where(c[y])) for name, (x, y) in cases.items()}


def counts(r: DataFrame, s: DataFrame, t: DataFrame, heavy_b: list, heavy_c: list) -> dict[str, tuple[int, int, int]]:
    """Rows of R, S and T in each residual: one pass over each relation."""

    def count(df: DataFrame, **conditions: Column) -> dict[str, int]:
        return df.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in conditions.items()]).first().asDict()

    hb, lb, hc, lc = is_heavy("B", heavy_b), is_light("B", heavy_b), is_heavy("C", heavy_c), is_light("C", heavy_c)
    nr, nt = count(r, h=hb, l=lb), count(t, h=hc, l=lc)
    ns = count(s, light=lb & lc, hb=hb & lc, hc=lb & hc, hbhc=hb & hc)
    return {"light": (nr["l"], ns["light"], nt["l"]), "hb": (nr["h"], ns["hb"], nt["l"]), "hc": (nr["l"], ns["hc"], nt["h"]), "hbhc": (nr["h"], ns["hbhc"], nt["h"])}


def sizes(r: DataFrame, s: DataFrame, t: DataFrame, heavy_b: list, heavy_c: list) -> dict[str, tuple[int, int, int]]:
    """counts(), 1 at least, as the share formulas need them."""
    return {name: tuple(max(1, n) for n in own) for name, own in counts(r, s, t, heavy_b, heavy_c).items()}


def shares_heavy_b(r: int, s: int, t: int, k: int) -> dict[str, int]:
    """Shares of A and C whose product is about k and that replicate least: a = sqrt(rk / (s + t))."""
    a = max(1, round(math.sqrt(r * k / (s + t))))
    return {"A": a, "C": max(1, k // a)}


def shares_heavy_c(r: int, s: int, t: int, k: int) -> dict[str, int]:
    """Shares of B and D: d = sqrt(tk / (r + s))."""
    d = max(1, round(math.sqrt(t * k / (r + s))))
    return {"B": max(1, k // d), "D": d}


def shares_heavy_both(r: int, s: int, t: int, k: int) -> dict[str, int]:
    """Shares of A, D and E: the cube roots of k times each relation's square over the others' product."""
    root = lambda own, x, y: max(1, round(math.cbrt(k * own * own / (x * y))))
    return {"A": root(r, s, t), "D": root(t, r, s), "E": root(s, r, t)}


def deal(df: DataFrame, shares: dict[str, int]) -> DataFrame:
    """df in a hypercube, with the number of its cell: its own attributes by hash, the others replicated to all buckets."""
    cell, buckets = F.lit(0), []
    for name, share in shares.items():
        if name in df.columns:
            # Two relations have a key, and integers of two types have two hashes.
            wide = name in ("B", "C") and isinstance(df.schema[name].dataType, T.IntegralType)
            bucket = F.pmod(F.hash(F.col(name).cast("long") if wide else name), F.lit(share))
        else:
            bucket = F.explode(F.sequence(F.lit(0), F.lit(share - 1)))
        buckets.append(f"bucket_{name}")
        df = df.withColumn(buckets[-1], bucket)
        cell = cell * share + F.col(buckets[-1])
    return df.withColumn("cell_", cell).drop(*buckets)


def shares_join(part: Residual, shares: dict[str, int]) -> DataFrame:
    """The chain over one residual, dealt by shares: cells and keys must agree.

    Each cell is a task, in which both joins are done: by the hash of cells some tasks would get several and others none.
    What is dealt is merged, as a broadcast would bring each task the rows of all cells.
    """
    tasks = math.prod(shares.values())
    r, s, t = (deal(df, shares).repartitionById(tasks, "cell_") for df in (part.r, part.s, part.t))
    return r.join(s.hint("merge"), ["cell_", "B"]).join(t.hint("merge"), ["cell_", "C"]).select(*OUT)


def residual_join(name: str, part: Residual, size: tuple[int, int, int], k: int) -> DataFrame:
    """One of the four residual joins."""
    if name == "light":
        return chain_join(part.r, part.s, part.t)
    shares = {"hb": shares_heavy_b, "hc": shares_heavy_c, "hbhc": shares_heavy_both}[name](*size, k)
    return shares_join(part, shares)


def skew_join(r: DataFrame, s: DataFrame, t: DataFrame, heavy_b: list, heavy_c: list, k: int = 100) -> DataFrame:
    """A, B, E, C, D: the union of the residual joins, equal to chain_join; those with an empty side are left out."""
    size = counts(r, s, t, heavy_b, heavy_c)
    parts = residuals(r, s, t, heavy_b, heavy_c)
    own = [residual_join(name, part, size[name], k) for name, part in parts.items() if min(size[name])]
    if not own:
        return chain_join(*vars(parts["light"]).values())
    out = own[0]
    for more in own[1:]:
        out = out.unionAll(more)
    return out
