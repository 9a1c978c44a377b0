"""A training corpus from documents: five stages, each written to the shared folder before the next.

Each stage works on all rows that its predecessor kept, and its decisions take effect: language
ID drops what it rejects, near-duplicate detection keeps one document of each group,
decontamination drops documents that hold a window of a benchmark item, personal data is
replaced by surrogates in the text, and the last stage returns token ids. All stages but the
last return the columns of documents.

Columns of any names pass through unchanged: while an operator works, all that it doesn't read have
other names. Nulls and empty texts: language ID rejects texts without a letter, so later stages see neither;
given such rows, near-duplicate detection and decontamination keep them, personal data leaves them as they are
and they have no tokens. Verdicts are by row: of rows that repeat a doc_id and text one stays, and of
one doc_id's texts each has its own verdict. A null doc_id is larger than any other. Empty tables give empty
tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, langid, minhash, surrogates
from tessera.llm.common import discard, passing, remainder, stash, table

#: Language ID rejects texts without letters, and those whose score is less than this share of the way from 1 / C,
#: the least that the best of C languages can have (the margins add up to 2 - C), to 1. Gibberish and other
#: languages stay below it, texts in two learned languages above; with one language nothing can be told apart.
LEAST_LANGUAGE_SHARE = 0.35


def least_score(languages: int) -> float:
    """The score below which language ID rejects a text."""
    return 1 / languages + LEAST_LANGUAGE_SHARE * (1 - 1 / languages) if languages > 1 else 0.0


def aside(docs: DataFrame, *read: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but those read under names that nothing else has, and what puts them back."""
    names = [c if c in read else f"aside {i}" for i, c in enumerate(docs.columns)]
    back = lambda df: df.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns)])
    return docs.toDF(*names), back


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told; learnt from the rows that op8 learns from."""
    model = langid.train(docs.select("doc_id", "text", "lang"), remainder("doc_id", 5) != 0)
    df, back = aside(docs, "doc_id", "text")
    return back(langid.identify(df, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least_score(len(model.names)))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: that of the smallest doc_id, and of its texts the one with the least MD5."""
    found = minhash.near_duplicates(docs.select("doc_id", "text")).where("group is not null")
    grouped = stash(found.select("group", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark").alias("row")).groupBy("group", "row").agg(F.count(F.lit(1)).alias("copies")))
    first = grouped.groupBy("group").agg(F.min("row").alias("first"))
    verdicts = grouped.join(first, "group").select(F.col("row.doc_id").alias("own id"), F.col("row.mark").alias("own mark"), (F.col("row") == F.col("first")).alias("stays"), "copies")
    verdicts = stash(verdicts)
    discard(grouped)
    df, back = aside(docs, "doc_id", "text")
    key = lambda doc_id, mark: F.xxhash64(F.col(doc_id).cast("long"), mark).alias("key")
    marked = df.withColumn("mark", F.md5("text")).withColumn("key", key("doc_id", "mark"))
    # Only what may be dropped is shuffled with its text.
    dropped = verdicts.where("not stays or copies > 1")
    keys = dropped.select(key("own id", "own mark"))
    joined = passing(marked, "key", keys).join(dropped, F.col("doc_id").eqNullSafe(F.col("own id")) & (F.col("mark") == F.col("own mark")), "left")
    out = back(passing(marked, "key", keys, others=True)).unionAll(back(joined.where(F.col("stays").isNull())))
    if dropped.where("stays").isEmpty():
        return out
    alike = joined.where("stays").groupBy("own id", "own mark").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"))
    return out.unionAll(back(alike.select("row.*")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    df, back = aside(docs, "doc_id", "text")
    return back(decontaminate.decontaminate(df, table(spark, sf_dir, "benchmark", "item_id", "text")).where("n_hit = 0"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; n_chars, where it is a column, follows the new text."""
    df, back = aside(docs, "doc_id", "text")
    done = back(surrogates.pseudonymise(df))
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    marked = docs.select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
    done = bpe.round_trip(marked, path)
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids",
        "text_sha256",
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"),
    )


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL expresses neither the kernel classifier nor the surrogates; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs)
    return docs
