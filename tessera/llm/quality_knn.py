"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes a vector of log counts over hashed columns: the shapes of its words (runs of
upper case, lower case, digits and each other sign), the words themselves, and a few marks for
words that follow themselves and lines that repeat. Singular vectors of a labelled sample's
matrix project that to a small latent space. The labelled vectors are sent to every task, each
batch of documents takes exact cosine products with them in blocks, and the nearest ones vote,
weighted by similarity.

The labelled sample is at most `max_train` rows (default 4,096), which bounds what is
broadcast: max_train x rank floats. Every document is scored over its whole text.

Defined cases: a text that is null or without words has no neighbour and gets the share of
label 1 among the labelled rows; without labelled rows every score is 0.5; an empty table of
documents gives no rows. Null labels don't count; several labels of one id count as the largest, and
of several texts of one labelled id one is learnt from (the least by a hash). Of labelled rows equally
near, those that come first in the order of the sample's hash and doc_id vote. Repeated rows get
equal scores. Texts are read whole, whatever their length. A column named score is replaced, other
columns are passed on.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import labelled, map_columns, remainder, table

#: Columns for marks, word shapes and words.
MARKS, SHAPES, WORDS = 8, 504, 1536
WIDTH = MARKS + SHAPES + WORDS
CACHE_ENTRIES = 500_000
_RUN = re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    """Runs of letters and digits by kind: Ab-12!! has the shape Xx-9!."""
    if word.isalpha():
        if word.islower():
            return "x"
        if word[1:].islower():
            return "Xx"
    kinds = "".join("x" if c.islower() else "X" if c.isupper() else "9" if c.isdigit() else "a" if c.isalpha() else c for c in word)
    return _RUN.sub(r"\1", kinds)[:12]


class Columns(dict):
    """Word -> column of its shape times 2^16 plus its own column."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        at = MARKS + zlib.crc32(shape(word).encode()) % SHAPES
        own = MARKS + SHAPES + zlib.crc32(word.lower().encode()) % WORDS
        self[word] = out = at << 16 | own
        return out


def counts(text: str | None, columns: Columns) -> np.ndarray:
    """Log counts over the columns, with each of the three parts scaled to the same length."""
    out = np.zeros(WIDTH, np.float32)
    words = text.split() if text else []
    if not words:
        return out
    both = np.fromiter(map(columns.__getitem__, words), np.int64, len(words))
    all_counts = np.bincount(both >> 16, minlength=WIDTH) + np.bincount(both & 0xFFFF, minlength=WIDTH)
    out[:] = np.log1p(all_counts)
    again = int((both[1:] == both[:-1]).sum())
    lines = [x for x in text.split("\n") if x.strip()]
    same = len(lines) - len(set(lines))
    out[0], out[1] = again / len(words), same / max(1, len(lines))
    out[2] = len(set(both.tolist())) / len(words)
    for a, b, weight in ((0, MARKS, 1.0), (MARKS, MARKS + SHAPES, 1.0), (MARKS + SHAPES, WIDTH, 0.35)):
        size = np.linalg.norm(out[a:b])
        if a and size:
            out[a:b] *= weight / size
    return out


def vectors(df: DataFrame, text: str = "text") -> DataFrame:
    """df with counts, the count vector of text."""
    at = df.columns.index(text)

    def make():
        columns = Columns()

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [counts(t.as_py(), columns).astype(np.float32).tobytes() for t in batch.column(at)]
            return [pa.array(rows, pa.binary())]

        return work

    return map_columns(df, make, [T.StructField("counts", T.BinaryType())], drop=[text])


class Voters:
    """The projection, the labelled unit vectors and their labels."""

    def __init__(self, projection: np.ndarray, points: np.ndarray, labels: np.ndarray):
        self.projection, self.points, self.labels = projection, points, labels
        self.prior = float(labels.mean()) if len(labels) else 0.5


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def project(x: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The right singular vectors of the largest values of x, and the Gram matrix that has them as eigenvectors."""
    gram = (x.T @ x).astype(np.float64)
    _, vector = np.linalg.eigh(gram)
    return np.ascontiguousarray(vector[:, ::-1][:, :rank], np.float32), gram


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", max_train: int = 4096, rank: int = 64) -> Voters:
    """Fit on at most max_train of the labelled rows for which learn holds, in the order of a hash of doc_id."""
    rows = vectors(labelled(docs, labels, label, learn, max_train)).select("h", "doc_id", "y", "counts").collect()
    rows.sort(key=lambda r: (r["h"], r["doc_id"]))  # so that sums and ties don't depend on the partitions
    if not rows:
        return Voters(np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32))
    x = np.frombuffer(b"".join(r["counts"] for r in rows), np.float32).reshape(len(rows), WIDTH)
    y = np.array([r["y"] for r in rows], np.float32)
    projection, _ = project(x, rank)
    return Voters(projection, unit(x @ projection), y)


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest values of each row; among equals the first places win."""
    least = np.partition(near, near.shape[1] - k, axis=1)[:, [-k]]
    over, level = near > least, near == least
    room = k - over.sum(1, keepdims=True)
    return np.nonzero(over | (level & (np.cumsum(level, axis=1) <= room)))[1].reshape(len(near), k)


def vote(docs: DataFrame, voters: Voters, text: str = "text", neighbours: int = 12, block: int = 256, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with score, the similarity-weighted share of label 1 among the nearest labelled rows."""
    at = docs.columns.index(text)
    projection, points, labels, prior = voters.projection, voters.points, voters.labels, voters.prior

    def make():
        columns = Columns()
        k = min(neighbours, len(labels))

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts, score = batch.column(at), []
            for start in range(0, len(texts), block):
                x = np.stack([counts(t.as_py(), columns) for t in texts.slice(start, block)])
                if not k:
                    score.append(np.full(len(x), prior))
                    continue
                near = unit(x @ projection) @ points.T
                top = nearest(near, k)
                weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** 8
                total = weight.sum(1)
                score.append(np.where(total > 0, (weight * labels[top]).sum(1) / np.where(total > 0, total, 1), prior))
            return [pa.array(np.clip(np.concatenate(score), 0, 1) if score else [], pa.float64())]

        return work

    return map_columns(docs, make, [T.StructField("score", T.DoubleType())], drop=drop)


def query(spark, sf_dir):
    """op2: quality of every whole text, learnt from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    voters = train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    scored = vote(docs, voters, drop=("text",))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
