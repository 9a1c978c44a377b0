"""What the operators of this subpackage share: shared-folder tables, Arrow column maps, training samples."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tessera

#: Functions of this package travel to the executors by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(tessera)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A driver table, pruned to the columns named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir.

    Where that is unset, one JVM (master local) gets a folder of its own for the session; on a cluster
    it is an error, as executors would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def discard(*stashes: DataFrame) -> None:
    """Delete what stash() wrote; nothing that is still to be computed may read it."""
    for df in stashes:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(df.stashed_at)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


#: Bits of one row of a filter table.
FILTER_ROW = 1 << 15


def passing(df: DataFrame, column: str, ids: DataFrame, bits_an_id: int = 16, most_bits: int = 1 << 31, others: bool = False) -> DataFrame:
    """Rows of df whose column (a long) may be in ids (one column of longs): all that are, and few others.

    With others, the rest, which are certainly not in ids. A bitmap of the ids' hashes is broadcast, so what is
    shuffled afterwards follows the ids. Its size is set by their number and bounded by most_bits (256 MB);
    beyond it more rows pass, none is lost.
    """
    n = ids.count()
    rows = max(1, min(-(-n * bits_an_id // FILTER_ROW), most_bits // FILTER_ROW))
    at = lambda c: F.pmod(F.xxhash64(c, F.lit("filter")), F.lit(rows * FILTER_ROW))
    place, bucket, bits = fresh(df, "place"), fresh(df, "bucket"), fresh(df, "bits")
    own = ids.select(at(F.col(ids.columns[0]).cast("long")).alias("at"))
    table = own.groupBy(F.shiftright("at", 15).alias(bucket)).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(FILTER_ROW))).alias(bits))
    marked = df.withColumn(place, at(F.col(column).cast("long"))).withColumn(bucket, F.shiftright(place, 15)).join(F.broadcast(table), bucket, "left" if others else "inner")
    inside = F.pmod(F.col(place), F.lit(FILTER_ROW)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(inside, 3) + 1, 1)), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, F.pmod(inside, F.lit(8))) == 1, F.lit(False))
    return marked.where(~may if others else may).select(*[F.col(f"`{c}`") for c in df.columns])


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without the columns named (in any case of letters)."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def fresh(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; kept for at most `most` words at a time."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, 0x9E3779B97F4A7C15 ^ width, np.uint64)
    for i in range(width):
        h = (h ^ words[i : i + n]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


#: Bytes of a batch that map_columns hands over at a time, or one row.
PART_BYTES = 4 << 20


def map_columns(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    fields: list[T.StructField],
    drop: Iterable[str] = (),
) -> DataFrame:
    """df with the columns that a batch function computes; columns of the same name are replaced.

    make() runs once in each task and returns the batch function. Columns in drop are
    read by the function and not returned.
    """
    gone = {f.name.lower() for f in fields} | {c.lower() for c in drop}
    kept = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in gone]
    schema = T.StructType([df.schema.fields[i] for i in kept] + fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            # In parts of some MB, so that what a batch becomes in Python stays small beside it.
            rows = max(1, whole.num_rows * PART_BYTES // max(PART_BYTES, whole.nbytes))
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + work(batch), names=names)

    return df.mapInArrow(run, schema)


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def sample_hash(*columns: str) -> Column:
    """A number in [0, 1) that depends on the columns alone, to draw samples that no run changes."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns], F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int, classes: tuple[int, ...] | None = None) -> DataFrame:
    """doc_id, text, y and h of at most `limit` labelled rows, drawn by h, a hash of doc_id; the same however the rows lie.

    Labels are one row per doc_id (the largest where several exist), before any choice; null labels
    and null ids are left out. With classes, each label in it gets an equal share of the limit. Of
    texts that share a doc_id, the one with the least hash is taken. The chosen ids are
    bounded by `limit` (TakeOrdered), so they are broadcast; only chosen texts are shuffled.
    """
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).alias("y"))
    one = one.select("doc_id", "y", sample_hash("doc_id").alias("h"))
    parts = [one] if classes is None else [one.where(F.col("y") == c) for c in classes]
    drawn = [p.orderBy("h", "doc_id").limit(limit // len(parts)) for p in parts]
    chosen = drawn[0]
    for more in drawn[1:]:
        chosen = chosen.unionAll(more)
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    order = F.struct(F.xxhash64("text"), "text")
    return found.groupBy("doc_id", "y", "h").agg(F.min_by("text", order).alias("text"))
