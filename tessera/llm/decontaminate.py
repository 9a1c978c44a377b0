"""Benchmark decontamination by a prefix-filtered set join with exact containment.

A window is `window` consecutive words of an item, or the whole of a shorter item; a document
that holds a window word for word is contaminated, and the words of that occurrence are hit.
As a set, a window is its shingles of `shingle` words (shorter windows: one shingle). Shingles
are ordered by rarity, the number of their occurrences in all documents. Containment of the
whole set is asked for, so the necessary prefix is one token: the rarest shingle. Documents are
probed for prefix tokens only; the token's place in its window gives the one start that the
window can have (the positional bound), which must lie in the document with the window's
length (the length bound), and then the words themselves are compared.

Items go through in blocks of about `block_chars` characters (default 8 million), so what
reaches the driver and the tasks is bounded: a second block is probed on what the first
returned, and after every `blocks_a_pass` blocks that is written down, so a task holds no more of them at
once. Items longer than a quarter of a block are cut into pieces that overlap by all but one of a window's
words. Rarity is counted over all documents, by one scan of the input a block. Documents are never
shuffled. Candidate windows are verified some ten thousand at a time.

Words are the runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased. Defined
cases: null and empty texts have no words and no hits; null and empty items no windows; items of
one id count as one; an item without id counts as `null`; empty tables give no hits. Equally rare
shingles are taken by the smallest key. Repeated rows get equal results; texts are worked on whole. Columns
named n_words, hit_spans, item_ids or n_hit are replaced, others passed on.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import discard, map_columns, stash, table

#: Bytes of words, A-Z in lower case; every other byte becomes a blank.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BITMAP = 1 << 22
#: Candidate windows that are verified at once.
CANDIDATES = 50_000


def words_of(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(TO_WORDS).split()


def mix(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit key of each run of `width` ids; equal runs have equal keys."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    a = ids.astype(np.uint64) + np.uint64(1)
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = (h ^ a[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Items:
    """The windows of a block of items: words as ids from 1, distinct windows, and their items."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items})
        at = {name: i for i, name in enumerate(self.names)}
        found: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for s in range(len(ids) - size + 1 if ids else 0):
                found.setdefault(tuple(ids[s : s + size]), set()).add(at[name])
        self.windows = list(found)
        self.holders = [np.array(sorted(h), np.int64) for h in found.values()]
        self.shingle = shingle
        self.widths = sorted({min(shingle, len(w)) for w in self.windows})
        keys = [mix(np.array(w, np.int64), min(shingle, len(w))) for w in self.windows]
        self.keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        self.window_keys = keys

    def __len__(self) -> int:
        return len(self.windows)


class Probe:
    """Sorted keys behind a bitmap that turns most others away."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bitmap = np.zeros(BITMAP, bool)
        self.bitmap[(keys >> np.uint64(20)) % np.uint64(BITMAP)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h of known keys, and the places of these keys."""
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(20)) % np.uint64(BITMAP)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[place] == h[at]
        return at[same], place[same]


def chunks(texts, vocabulary: dict[bytes, int], gap: int, words: int = 400_000):
    """Groups of texts as one array of ids with `gap` zeros after each, the starts, and the numbers of words."""
    arrays, starts, sizes, first, total = [], [], [], 0, 0
    for i, t in enumerate(texts):
        own = words_of(t.as_py())
        starts.append(total)
        sizes.append(len(own))
        arrays.append(np.fromiter(map(vocabulary.get, own, repeat(0)), np.int32, len(own)))
        arrays.append(np.zeros(gap, np.int32))
        total += len(own) + gap
        if total >= words:
            yield first, np.concatenate(arrays), np.array(starts), np.array(sizes)
            arrays, starts, sizes, first, total = [], [], [], i + 1, 0
    if starts:
        yield first, np.concatenate(arrays), np.array(starts), np.array(sizes)


def rarity(docs: DataFrame, items: Items, text: str) -> np.ndarray:
    """How often each of the items' shingles occurs in all documents; one number a shingle and task is shuffled."""
    keys, vocabulary, widths = items.keys, items.vocabulary, items.widths

    def run(batches):
        probe, seen = Probe(keys), np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, ids, _, _ in chunks(batch.column(0), vocabulary, 1):
                for width in widths:
                    _, place = probe.find(mix(ids, width))
                    seen += np.bincount(place, minlength=len(keys))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["place", "n"])

    out = np.zeros(len(keys), np.int64)
    for r in docs.select(text).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r["place"]] = r["n"]
    return out


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("n_hit", T.LongType()),
]


def probe_block(docs: DataFrame, items: Items, n_of: np.ndarray, text: str, again: bool) -> DataFrame:
    """docs with the hits of one block of items, joined to those of the blocks before if again. n_of: rarity()."""
    # Each window's prefix: its rarest shingle, the smallest key among equals.
    prefix: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for w, keys in enumerate(items.window_keys):
        place = np.searchsorted(items.keys, keys)
        best = int(np.lexsort((keys, n_of[place]))[0])
        prefix.setdefault((min(items.shingle, len(items.windows[w])), int(keys[best])), []).append((w, best))
    by_width = {}
    for width in items.widths:
        own = sorted(k for q, k in prefix if q == width)
        entries = [prefix[width, k] for k in own]
        flat = [e for x in entries for e in x]
        by_width[width] = (np.array(own, np.uint64), np.cumsum([0, *map(len, entries)]), np.array([w for w, _ in flat], np.int64), np.array([o for _, o in flat], np.int64))
    longest = max(map(len, items.windows))
    padded = np.zeros((len(items), longest), np.int32)
    for w, ids in enumerate(items.windows):
        padded[w, : len(ids)] = ids
    sizes_of = np.array([len(w) for w in items.windows])
    vocabulary, names, holders = items.vocabulary, items.names, items.holders
    at = docs.columns.index(text)
    old = [docs.columns.index(c) for c in ("hit_spans", "item_ids")] if again else []

    def make():
        probes = {width: (Probe(keys), first, window, offset) for width, (keys, first, window, offset) in by_width.items()}

        def occurrences(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Starts and windows of all occurrences in ids."""
            starts, found = [], []
            for width, (probe, first, window, offset) in probes.items():
                pos, place = probe.find(mix(ids, width))
                n = first[place + 1] - first[place]
                until = np.cumsum(n)
                for low in range(0, int(until[-1]) if len(until) else 0, CANDIDATES):
                    # The candidates low, low + 1 and so on of all positions' windows in a row.
                    row = np.arange(low, min(low + CANDIDATES, int(until[-1])))
                    i = np.searchsorted(until, row, "right")
                    entry = first[place[i]] + row - (until[i] - n[i])
                    start, w = pos[i] - offset[entry], window[entry]
                    inside = (start >= 0) & (start + sizes_of[w] <= len(ids))
                    start, w = start[inside], w[inside]
                    reach = np.arange(longest)
                    same = ((ids[np.minimum(start[:, None] + reach, len(ids) - 1)] == padded[w]) | (reach >= sizes_of[w][:, None])).all(1)
                    starts.append(start[same])
                    found.append(w[same])
            return (np.concatenate(starts), np.concatenate(found)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            n_words, spans, ids_out, n_hit = [], [], [], []
            before = [batch.column(i).to_pylist() for i in old]
            for first, ids, starts, sizes in chunks(batch.column(at), vocabulary, 1):
                where, which = occurrences(ids)
                order = np.argsort(where, kind="stable")
                where, which = where[order], which[order]
                bounds = np.searchsorted(where, np.append(starts, len(ids)))
                for i, size in enumerate(sizes):
                    a, b = bounds[i], bounds[i + 1]
                    own = [(int(s - starts[i]), int(s - starts[i] + sizes_of[w])) for s, w in zip(where[a:b], which[a:b])]
                    named = {names[x] for w in set(which[a:b].tolist()) for x in holders[w]}
                    if before:
                        own = sorted(own + [(x["first"], x["last"] + 1) for x in before[0][first + i]])
                        named |= set(before[1][first + i])
                    joined: list[list[int]] = []
                    for s, e in own:
                        if joined and s <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], e)
                        else:
                            joined.append([s, e])
                    n_words.append(int(size))
                    spans.append([{"first": s, "last": e - 1} for s, e in joined])
                    ids_out.append(sorted(named))
                    n_hit.append(sum(e - s for s, e in joined))
            span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            return [pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(ids_out, pa.list_(pa.string())), pa.array(n_hit, pa.int64())]

        return work

    return map_columns(docs, make, FIELDS)


def pieces(items: DataFrame, window: int, chars: int) -> DataFrame:
    """items (item, text) with those longer than chars cut into pieces that have all their windows."""

    def run(batches):
        for batch in batches:
            names, texts = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py()) if len(text.as_py()) > chars else []
                if len(words) <= window:
                    names.append(name), texts.append(text.as_py())
                    continue
                size = max(1, len(words) * chars // len(text.as_py()))
                for a in range(0, len(words) - window + 1, size):
                    names.append(name), texts.append(b" ".join(words[a : a + size + window - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["item", "text"])

    return items.mapInArrow(run, "item string, text string")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10, shingle: int = 5, block_chars: int = 8_000_000, blocks_a_pass: int = 4) -> DataFrame:
    """docs with n_words, hit_spans (first and last word of each run of hit words), item_ids (sorted) and n_hit."""
    named = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").distinct()
    items = stash(pieces(named, window, max(1, block_chars // 4)))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    # Blocks are drawn by hash; twice as many as fill them exactly keep each within its size.
    n_blocks = 1 if chars <= block_chars else -(-2 * chars // block_chars)
    out, probed = docs, 0
    for b in range(n_blocks if chars else 0):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b).collect()
        block = Items([(r["item"], r["text"]) for r in rows], window, shingle)
        if len(block):
            if probed and not probed % blocks_a_pass:
                out = stash(out)
            out = probe_block(out, block, rarity(docs, block, text), text, probed > 0)
            probed += 1
    discard(items)
    if not probed:  # no windows at all: count the words
        empty = Items([], window, shingle)
        empty.windows, empty.holders, empty.widths = [(-1,)], [np.zeros(0, np.int64)], [1]
        empty.window_keys = [np.array([1], np.uint64)]
        empty.keys = empty.window_keys[0]
        out = probe_block(docs, empty, np.zeros(1, np.int64), text, False)
    return out


def query(spark, sf_dir):
    """op3: documents against the benchmark, by 10-word windows."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH lower_docs AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lower_items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM lower_items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM wins),
doc_wins AS (
  SELECT doc_id, size, s, array_to_string(list_slice(w, s, s + size - 1), ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM lower_docs, sizes WHERE len(w) >= size)),
hits AS (SELECT d.doc_id, d.s, d.size, i.item_id FROM doc_wins d JOIN wins i ON d.win = i.win AND d.size = i.size),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM lower_docs d LEFT JOIN words_hit h ON d.doc_id = h.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
"""
