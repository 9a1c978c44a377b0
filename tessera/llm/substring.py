"""Substring deduplication with suffix automata of reference shards.

A window is `window` consecutive words of one document. Words are removed that a window covers
whose word sequence also starts in a document with a smaller doc_id; windows are judged on the
input. Everything is exact up to 128-bit hashes of word sequences.

Copies. Documents with one word sequence form a class. In all but its smallest doc_id every
window repeats, so only the smallest, the class's representative, is looked at further.

Anchors. Of each representative's runs of `anchor` words, those with the least hash within a
window's reach are kept (winnowing), so every window holds an anchor, and equal windows hold
equal ones. An anchor that occurs in one document proves that its windows occur nowhere else. For
an anchor in several, the smallest of them is its reference document.

Reference shards. The reference documents' suffix automata (over 64-bit word hashes) are the shards;
of documents longer than `shard_words` they are made of overlapping pieces, each a shard of its own, so memory
stays bounded. A shard is sent to the tasks that get the documents which share an anchor within it, in
blocks of bounded size, and never to all: that would be quadratic in the corpus. A task builds it once
a block and streams those documents' spans through it; the matching statistics say where a match of at
least a window's length ends, and all windows within maximal matches repeat.

The rest. A window that holds a shared anchor, but does not occur in the anchor's reference
document, may still occur in a third one. Its 128-bit hash and doc_id are dealt out by hash, the smallest
doc_id of each hash is kept (pre-aggregated), and larger ones are removed as well. Since all
documents with the window hold the anchor, no occurrence is missed.

Defined cases: null and empty texts have no words and nothing is removed; rows that repeat a
doc_id with one text keep their words, as no smaller doc_id has them; a null doc_id is larger
than any other; other columns are not read; an empty table gives no rows. Texts are worked on whole.
Of two texts of one doc_id neither is before the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import WordHashes, discard, map_columns, passing, run_hashes, stash, table

LAST = (1 << 63) - 1


def words_of(text: str | None) -> list[bytes]:
    """Words are what bytes.split() gives: runs of other bytes than the six ASCII blanks."""
    return text.encode().split() if text else []


def hashed(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def winnow(h: np.ndarray, reach: int) -> np.ndarray:
    """Positions of the least value (the last of equals) in each run of `reach` values."""
    if len(h) <= reach:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h[::-1], reach)
    best = np.concatenate([np.argmin(view[i : i + 8192], axis=1) for i in range(0, len(view), 8192)])
    return np.unique(len(h) - 1 - (np.arange(len(view)) + best))


def pairs_of(words: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the windows at starts."""
    first = run_hashes(words, window)
    second = run_hashes(words ^ np.uint64(0xA5A5A5A5A5A5A5A5), window)
    return first[starts].astype(np.int64), second[starts].astype(np.int64)


class SuffixAutomaton:
    """Suffix automaton of a sequence of hashable letters."""

    def __init__(self, letters: list):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        last, nxt, link, length = 0, self.next, self.link, self.length
        for c in letters:
            new = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new

    def spans(self, letters: list, least: int) -> list[tuple[int, int]]:
        """Maximal spans [a, b) of letters of at least `least` letters, each of which occurs in the automaton's sequence."""
        out: list[tuple[int, int]] = []
        nxt, link, length = self.next, self.link, self.length
        state, size = 0, 0
        for i, c in enumerate(letters):
            while state and c not in nxt[state]:
                if size >= least:
                    out.append((i - size, i))
                    size = -1
                state = link[state]
                size = min(size, length[state]) if size >= 0 else length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                size += 1
            else:
                size = 0
        if size >= least:
            out.append((len(letters) - size, len(letters)))
        return out


def anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """doc_id, the hash of the words (node), n_words, and the winnowed anchors (hash, first and last position), of each row."""
    reach = window - anchor + 1

    def run(batches):
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            n, node, keys, places, lasts = [], [], [], [], []
            for t in batch.column(1):
                words = words_of(t.as_py())
                n.append(len(words))
                node.append(xxhash.xxh3_128_digest(b" ".join(words)))
                if len(words) < window:
                    keys.append([]), places.append([]), lasts.append([])
                    continue
                h = run_hashes(hashed(words, hashes), anchor)
                at = winnow(h, reach)
                # Equal anchors in a row (one word again and again) are one, with its first and last place.
                first = np.concatenate(([True], h[at[1:]] != h[at[:-1]]))
                keys.append(h[at[first]].astype(np.int64))
                places.append(at[first].astype(np.int32))
                lasts.append(at[np.append(first[1:], True)].astype(np.int32))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(places, ints), pa.array(lasts, ints)], names=["doc_id", "n_words", "node", "keys", "places", "lasts"]
            )

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, node binary, keys array<long>, places array<int>, lasts array<int>")


SPAN = "array<struct<first:int,last:int>>"


def stream(rows: DataFrame, window: int, anchor: int, shard_words: int) -> DataFrame:
    """id, doc_id, whether the reference comes before it, the asked window starts and the repeated ones (spans), of each partner and piece.

    rows (ref_id, piece, block, role, id, doc_id, ref, places, text) come sorted, the reference (role 0) first.
    """

    def run(batches):
        hashes = WordHashes()
        shard, automaton = None, None
        for batch in batches:
            out: dict[str, list] = {"id": [], "asked": [], "spans": []}
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6)]
            for ref_id, piece, role, own_id, doc_id, ref, at, t in zip(*columns, batch.column(7), batch.column(8)):
                if role == 0:
                    # Pieces overlap by all but one of a window's words, so each window is in one.
                    words = words_of(t.as_py())[piece * shard_words : (piece + 1) * shard_words + window - 1]
                    shard, automaton = (ref_id, piece), SuffixAutomaton(hashed(words, hashes).tolist())
                    continue
                if (ref_id, piece) != shard:
                    raise ValueError("a partner came without its reference")
                h = hashed(words_of(t.as_py()), hashes)
                # The windows that hold one of these anchors, as runs of starts.
                width = len(h) - window + 1
                asked = np.zeros(width + 1, np.int64)
                own = np.array(at.as_py(), np.int64)
                np.add.at(asked, np.clip(own[:, 0] + anchor - window, 0, width), 1)
                np.add.at(asked, np.clip(own[:, 1] + 1, 0, width), -1)
                asked = np.cumsum(asked[:-1]) > 0
                found = np.zeros(width, bool)
                if doc_id > ref:
                    for a, b in runs(asked):
                        for s, e in automaton.spans(h[a : b + window - 1].tolist(), window):
                            found[a + s : a + e - window + 1] = True
                out["id"].append(own_id)
                out["asked"].append([{"first": a, "last": b - 1} for a, b in runs(asked)])
                out["spans"].append([{"first": a, "last": b - 1} for a, b in runs(found)])
            span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), (pa.int64(), span, span))], names=list(out))

    return rows.mapInArrow(run, f"id long, asked {SPAN}, spans {SPAN}")


def left_over(rows: DataFrame, window: int) -> DataFrame:
    """id, doc_id, and place and hash of each window that was asked for and found in no piece. rows: id, doc_id, asked, spans, text."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, docs, starts, ones, twos = [], [], [], [], []
            for own_id, doc_id, asked, spans, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), batch.column(4)):
                h = hashed(words_of(t.as_py()), hashes)
                open_ = np.zeros(len(h) - window + 1, bool)
                for case, value in ((asked, True), (spans, False)):
                    for s in case.as_py():
                        open_[s["first"] : s["last"] + 1] = value
                rest = np.flatnonzero(open_)
                if len(rest):
                    one, two = pairs_of(h, rest, window)
                    ids.append(np.full(len(rest), own_id)), docs.append(np.full(len(rest), doc_id))
                    starts.append(rest), ones.append(one), twos.append(two)
            if ids:
                columns = [np.concatenate(c) for c in (ids, docs, starts, ones, twos)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["id", "doc_id", "start", "one", "two"])

    return rows.mapInArrow(run, "id long, doc_id long, start int, one long, two long")


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Where flags are set, as [a, b)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def repeated(docs: DataFrame, text: str, window: int, anchor: int, block_words: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """Every row's (doc_id, node, n_words), and the repeated window starts (spans) of the representatives that have some."""
    sketched = stash(anchors(docs.select("doc_id", F.col(text).alias("text")), window, anchor))
    long = sketched.where(F.col("n_words") >= window)
    one = long.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("keys").alias("keys"), F.first("places").alias("places"), F.first("lasts").alias("lasts"))
    # The numbers stand in what is written, so whatever reads it again finds the same ones.
    reps = stash(one.withColumn("id", F.monotonically_increasing_id()))
    each = reps.select("doc_id", "id", F.explode(F.arrays_zip("keys", "places", "lasts")).alias("k")).select("doc_id", "id", F.col("k.keys").alias("key"), F.col("k.places").alias("first"), F.col("k.lasts").alias("last"))
    shared = stash(each.groupBy("key").agg(F.min(F.struct("doc_id", "id")).alias("r"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key", F.col("r.doc_id").alias("ref"), F.col("r.id").alias("ref_id")))
    held = stash(each.join(shared, "key"))
    # Which pieces of the reference hold a window with the anchor.
    pieces = held.where("id = ref_id").select("key", F.explode(F.sequence(F.expr(f"greatest(first + {anchor - window}, 0) div {shard_words}"), F.expr(f"last div {shard_words}"))).alias("piece")).distinct()
    several = stash(pieces.where("piece > 0").select("key").distinct().join(pieces, "key"))
    apart = held.where("id != ref_id").join(several, "key", "left").withColumn("piece", F.coalesce("piece", F.lit(0).cast("long")))
    referred = apart.groupBy("ref_id", "ref", "piece", "id", "doc_id").agg(F.collect_list(F.array("first", "last")).alias("places"))
    referred = stash(referred.join(reps.select("id", "n_words"), "id"))
    leads = stash(referred.groupBy("ref_id", "ref", "piece").agg(F.ceil(F.sum("n_words") / block_words).alias("blocks")))
    needed = referred.select("id").union(leads.select("ref_id")).distinct()
    fetched = of_node(docs, stash(reps.select("id", "doc_id", "node", "n_words").join(needed, "id")), text)
    partners = referred.join(leads.select("ref_id", "piece", "blocks"), ["ref_id", "piece"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).select("ref_id", "piece", "block", F.lit(1).alias("role"), "id", "doc_id", "ref", "places")
    first = leads.select("ref_id", "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("ref_id").alias("id"), F.col("ref").alias("doc_id"), "ref", F.lit(None).cast("array<array<int>>").alias("places"))
    rows = first.unionByName(partners).join(fetched, "id").select("ref_id", "piece", "block", "role", "id", "doc_id", "ref", "places", "text")
    streamed = stash(stream(rows.repartition("ref_id", "piece", "block").sortWithinPartitions("ref_id", "piece", "block", "role"), window, anchor, shard_words))
    met = streamed.groupBy("id").agg(F.flatten(F.collect_list("asked")).alias("asked"), F.flatten(F.collect_list("spans")).alias("spans"))
    joined = met.join(reps.select("id", "doc_id"), "id").join(fetched, "id").select("id", "doc_id", "asked", "spans", "text")
    rest = stash(left_over(joined, window))
    least = stash(rest.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("one", "two", "least"))
    late = rest.join(least, ["one", "two"]).where("doc_id > least").select("id", F.struct(F.col("start").alias("first"), F.col("start").alias("last")).alias("span"))
    found = streamed.select("id", F.explode("spans").alias("span")).union(late).groupBy("id").agg(F.collect_list("span").alias("spans"))
    out = stash(found.join(reps.select("id", "node"), "id").select("node", "spans"))
    discard(reps, shared, held, several, referred, leads, fetched, streamed, rest, least)
    return sketched, out


def of_node(docs: DataFrame, needed: DataFrame, text: str) -> DataFrame:
    """id and text for the rows needed (id, doc_id, node), one each; rows of a doc_id that have other words drop out."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.col(text).alias("text"))
    got = passing(own, "doc_id", needed.select("doc_id")).join(needed, "doc_id").select("id", "node", "text")

    def run(batches):
        import xxhash

        for batch in batches:
            keep = [i for i, (node, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))) if xxhash.xxh3_128_digest(b" ".join(words_of(t.as_py()))) == node]
            yield batch.select([0, 2]).take(pa.array(keep, pa.int64()))

    out = stash(got.mapInArrow(run, "id long, text string").groupBy("id").agg(F.first("text").alias("text")))
    discard(needed)
    return out


def deduplicate(docs: DataFrame, text: str = "text", window: int = 50, anchor: int = 12, block_words: int = 400_000, shard_words: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text, the words kept, joined by one blank; a row for each row of docs."""
    sketched, spans = repeated(docs, text, window, anchor, block_words, shard_words)
    long = sketched.where(F.col("n_words") >= window)
    # What is not kept whole: representatives with spans, and copies, which are removed whole.
    # Written down, so that the join with a text of many copies can be split.
    least = stash(long.groupBy("node").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")).join(spans, "node", "left").where("copies > 1 or spans is not null"))
    decided = sketched.select("doc_id", "node", "n_words").join(least, "node").where("spans is not null or doc_id > low")
    decided = stash(decided.select("doc_id", "node", F.when(F.col("doc_id") == F.col("low"), F.col("spans")).alias("spans")).distinct())
    discard(sketched, spans, least)
    own = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id_"), F.col(text).alias("text"))
    by_id = decided.groupBy(F.col("doc_id").alias("id_")).agg(F.collect_list(F.struct("node", "spans")).alias("cases"))
    return keep(own.join(by_id, "id_", "left").select("doc_id", "text", "cases"), window)


def keep(rows: DataFrame, window: int) -> DataFrame:
    """What is left of each text after its case: no case, all words (null spans), or the windows in its spans."""
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]

    def make():
        import xxhash

        def one(t: str | None, cases: list | None) -> tuple[int, int, str]:
            words = words_of(t)
            case = None
            if cases:
                node = xxhash.xxh3_128_digest(b" ".join(words))
                case = next((c for c in cases if c["node"] == node), None)
            if case is None:
                return len(words), 0, b" ".join(words).decode()
            if case["spans"] is None:
                return len(words), len(words), ""
            gone = np.zeros(len(words) + 1, np.int64)
            for s in case["spans"]:
                gone[s["first"]] += 1
                gone[s["last"] + window] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode()

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            done = [one(t.as_py(), c.as_py()) for t, c in zip(batch.column(1), batch.column(2))]
            return [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())]

        return work

    return map_columns(rows, make, fields, drop=("text", "cases"))


def query(spark, sf_dir):
    """op9: what is left of every document after windows of 50 words that a smaller doc_id has."""
    done = deduplicate(table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, s, sha256(array_to_string(list_slice(w, s, s + 49), ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM w WHERE len(w) >= 50)),
firsts AS (SELECT win, min(doc_id) AS low FROM wins GROUP BY win),
hit AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM wins JOIN firsts USING (win) WHERE doc_id > low),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM pos ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, coalesce(len(w.w), 0)::BIGINT AS n_words, (coalesce(len(w.w), 0) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.k, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
