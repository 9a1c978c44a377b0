"""Language identification by a string kernel.

The kernel of two texts is the mean over n of |A_n & B_n| / sqrt(|A_n| |B_n|), where A_n is the
set of character n-grams present (a blended spectrum of presences, hashed into a block of
columns for each n). Landmarks drawn from the training rows give the Nystroem features
K(x, L) K(L, L)^(-1/2), and one-versus-rest ridge regression over these gives a weight vector
for each language. The kernel is an inner product of scaled presence vectors, so L' times the
weights is one small matrix: each batch of documents is scored by one matrix product with it.

Training rows are a sample of at most `max_train` rows (default 4,096), drawn evenly over the
`max_languages` most frequent languages (default 200) by a hash; only their packed presence bits
reach the driver. Everything else covers every row and whole texts.

Defined cases: a text that is null or has no letter gives `und` with score 0; without training
rows every document does; an empty table gives no rows. Ties go to the language that sorts first.
Repeated rows get equal results. A text is read whole, whatever its length; its presences take
constant memory. Columns named lang_pred or score are replaced; others are passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_columns, remainder, sample_hash, table

#: log2 of the columns for 1-grams, 2-grams and so on.
BLOCKS = (9, 11, 12, 13)
WIDTH = sum(1 << b for b in BLOCKS)
STARTS = np.cumsum([0, *(1 << b for b in BLOCKS)])
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """For each UTF-16-plane character its lower-case letter, or a space if it is none."""
    out = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def presence(text: str, letters: np.ndarray, row: np.ndarray) -> bool:
    """Mark the n-grams of text in row (booleans); whether the text has a letter.

    Characters that are no letters count as one kind, and a blank is put at both ends.
    """
    code = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    a = letters[np.minimum(code, 0xFFFF)]
    if code.max() > 0xFFFF:
        import regex

        for i in np.flatnonzero(code > 0xFFFF):
            a[i] = code[i] if regex.match(r"\p{L}", chr(code[i])) else 32
    if not (a != 32).any():
        return False
    if len(a) > 2:  # runs of blanks shrink to one
        a = a[np.concatenate(([True], (a[1:] != 32) | (a[:-1] != 32)))]
    h = a * np.uint32(0x9E3779B1)
    for n, bits in enumerate(BLOCKS):
        if n:
            if len(h) < 2:
                break
            h = (h[:-1] ^ (a[n:] + np.uint32(n))) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        row[STARTS[n] + (h >> np.uint32(32 - bits))] = True
    return True


def scaled(bits: np.ndarray) -> np.ndarray:
    """Rows whose inner products are the kernel."""
    out = bits.astype(np.float32)
    for n in range(len(BLOCKS)):
        block = out[:, STARTS[n] : STARTS[n + 1]]
        block /= np.sqrt(np.maximum(block.sum(1, keepdims=True), 1) * len(BLOCKS))
    return out


def packed(df: DataFrame, text: str = "text") -> DataFrame:
    """df with bits, the packed presences of text (null where it has no letter)."""
    at = df.columns.index(text)

    def make():
        letters = letter_table()

        def one(t: str | None) -> bytes | None:
            row = np.zeros(WIDTH, bool)
            return np.packbits(row).tobytes() if t and presence(t, letters, row) else None

        return lambda batch: [pa.array([one(t.as_py()) for t in batch.column(at)], pa.binary())]

    return map_columns(df, make, [T.StructField("bits", T.BinaryType())], drop=[text])


class Model:
    """Language names in order, and the matrix that scores scaled presences."""

    def __init__(self, names: list[str], matrix: np.ndarray):
        self.names, self.matrix = names, matrix


def train(docs: DataFrame, learn: Column, max_train: int = 4096, landmarks: int = 320, ridge: float = 1e-3, max_languages: int = 200) -> Model:
    """Fit on at most max_train rows of docs (doc_id, text, lang) for which learn holds and lang is not null.

    Languages are those of the `max_languages` most frequent values of lang. Each has an equal
    share of the rows, where it has so many, by a hash of doc_id.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    if not sizes:
        return Model([], np.zeros((WIDTH, 0), np.float32))
    share = max(1, max_train // len(sizes))
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 1.25 * share / n))])
    # A row's place within its language, in shares, so that a limit cuts all languages alike.
    place = rows.select("lang", "text", "doc_id", (sample_hash("doc_id") / rate[F.col("lang")]).alias("place")).where("place < 1")
    few = place.orderBy("place", "doc_id", "lang", F.xxhash64("text"), "text").limit(max_train)
    drawn = sorted(((r["place"], r["doc_id"] is not None, r["doc_id"] or 0, r["lang"], r["bits"]) for r in packed(few).collect() if r["bits"] is not None))
    got = [(k, bits) for *_, k, bits in drawn]
    if not got:
        return Model([], np.zeros((WIDTH, 0), np.float32))
    names = sorted({k for k, _ in got})
    x = np.unpackbits(np.frombuffer(b"".join(b for _, b in got), np.uint8).reshape(len(got), -1), axis=1)[:, :WIDTH]
    y = np.array([names.index(k) for k, _ in got])
    by_class = [np.flatnonzero(y == i)[: max(1, landmarks // len(names))] for i in range(len(names))]
    lands = scaled(x[np.concatenate(by_class)])
    inner = (lands @ lands.T).astype(np.float64)
    value, vector = np.linalg.eigh(inner)
    use = value > 1e-6 * value.max()
    root = (vector[:, use] / np.sqrt(value[use])) @ vector[:, use].T
    phi = np.concatenate([scaled(x[i : i + 512]) @ lands.T for i in range(0, len(x), 512)]).astype(np.float64) @ root
    phi = np.column_stack([phi, np.ones(len(phi))])
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    penalty = ridge * len(phi) * np.eye(phi.shape[1])
    penalty[-1, -1] = 0
    weight = np.linalg.solve(phi.T @ phi + penalty, phi.T @ target)
    matrix = (lands.T @ (root @ weight[:-1])).astype(np.float32)
    return Model(names, np.vstack([matrix, weight[-1:].astype(np.float32)]))


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def identify(docs: DataFrame, model: Model, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with lang_pred and score, (1 + margin of the winning class) / 2 within 0 and 1."""
    at, names, matrix = docs.columns.index(text), model.names, model.matrix

    def make():
        letters = letter_table()

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts, label, score = batch.column(at), [], []
            for start in range(0, len(texts), 256):
                part = texts.slice(start, 256)
                bits = np.zeros((len(part), WIDTH), bool)
                known = [bool(names) and t.is_valid and presence(t.as_py(), letters, bits[i]) for i, t in enumerate(part)]
                if not names:
                    label += [UNKNOWN] * len(part)
                    score += [0.0] * len(part)
                    continue
                out = scaled(bits) @ matrix[:-1] + matrix[-1]
                best = out.argmax(1)
                top = np.clip((1 + out[np.arange(len(part)), best]) / 2, 0, 1)
                label += [names[b] if k else UNKNOWN for b, k in zip(best, known)]
                score += [float(s) if k else 0.0 for s, k in zip(top, known)]
            return [pa.array(label, pa.string()), pa.array(score, pa.float64())]

        return work

    return map_columns(docs, make, FIELDS, drop=drop)


def query(spark, sf_dir):
    """op8: the language of every whole text, learnt from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(docs, remainder("doc_id", 5) != 0)
    return identify(docs.select("doc_id", "text"), model, drop=("text",)).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
