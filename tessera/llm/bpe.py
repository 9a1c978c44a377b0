"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

The model holds one piece per rank: the token's bytes, each mapped to a printable
character, scored by the negative rank. Normalisation is the identity, so a pre-token of
mapped characters goes through sentencepiece's merges in rank order, which is what a
byte-level BPE encoder does. Decoding looks pieces up by id and maps characters back to bytes.

Defined cases: null text gives no ids and empty bytes; empty text likewise; an empty table gives no rows;
repeated rows get equal ids; extra columns are passed on; columns named token_ids or decoded are
replaced. Texts and pre-tokens are encoded whole, whatever their length. Of merges of equal rank there are none.
"""

from __future__ import annotations

import base64
import struct
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_columns, table

#: Pre-tokens kept with their ids in each task, and the longest of them in characters.
CACHE_ENTRIES, CACHE_CHARS = 150_000, 48
NORMAL, UNKNOWN, BPE = 1, 2, 2


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is visible Latin-1, else the next from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, rank), in the order of their ranks 0, 1, 2..."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0 to n-1")
    return [token for _, token in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float | bool) -> bytes:
    """One field of a protocol-buffer message."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value) & (1 << 64) - 1)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model: piece i is the mapped token of rank i, and the unknown piece comes last."""
    alphabet = byte_alphabet()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(alphabet[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, NORMAL))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, UNKNOWN))
    trainer = _field(3, BPE) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        alphabet = byte_alphabet()
        self.n = self.model.get_piece_size() - 1
        back = {c: b for b, c in enumerate(alphabet)}
        self.tokens = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(self.n)]
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.mapping = dict(enumerate(alphabet))
        self.cache: dict[str, tuple[int, ...]] = {}

    def pre_token(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        one = self.whole.get(raw)
        ids = (one,) if one is not None else tuple(self.model.encode(raw.decode("latin-1").translate(self.mapping)))
        if len(piece) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        pieces = self.split(text)
        found = list(map(self.cache.get, pieces, repeat(None)))
        if None in found:
            slow = self.pre_token
            found = [ids if ids is not None else slow(p) for ids, p in zip(found, pieces)]
        return list(chain.from_iterable(found))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _id_array(rows: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


IDS = T.StructField("token_ids", T.ArrayType(T.IntegerType(), True))
DECODED = T.StructField("decoded", T.BinaryType())


def _codec(tokens_path: str, pattern: str | None):
    """The model's bytes, made once on the driver, and a function that opens it in a task."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    model = serialise_model(read_ranks(tokens_path))
    return lambda: Codec(model, pattern)


def encode(docs: DataFrame, tokens_path: str, pattern: str | None = None, text: str = "text") -> DataFrame:
    """docs with token_ids, the ids of each whole text."""
    opened, at = _codec(tokens_path, pattern), docs.columns.index(text)

    def make():
        codec = opened()
        return lambda batch: [_id_array([codec.encode(t) for t in batch.column(at).to_pylist()])]

    return map_columns(docs, make, [IDS])


def decode(df: DataFrame, tokens_path: str, pattern: str | None = None) -> DataFrame:
    """df with decoded, the bytes that token_ids stand for (null ids: empty)."""
    opened, at = _codec(tokens_path, pattern), df.columns.index("token_ids")

    def make():
        codec = opened()
        return lambda batch: [pa.array([codec.decode(x or ()) for x in batch.column(at).to_pylist()], pa.binary())]

    return map_columns(df, make, [DECODED])


def round_trip(docs: DataFrame, tokens_path: str, pattern: str | None = None, text: str = "text") -> DataFrame:
    """docs with token_ids and with decoded, made from those ids in the same pass; the text itself is not returned."""
    opened, at = _codec(tokens_path, pattern), docs.columns.index(text)

    def make():
        codec = opened()

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows, raw = [], []
            for t in batch.column(at):
                ids = codec.encode(t.as_py())
                raw.append(codec.decode(ids))
                rows.append(np.array(ids, np.int32))
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(raw, pa.binary())]

        return work

    return map_columns(docs, make, [IDS, DECODED], drop=[text])


def query(spark, sf_dir):
    """op10: ids of every whole text of documents and the bytes decoded from them, as digests."""
    import public_tokenizers

    done = round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
