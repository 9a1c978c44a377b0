"""Near duplicates by MinHash with tensored banding, verified on full shingle sets.

Hashing. Two collections of `bands` band values are made, each value from `rows` minhashes: the
table keys are all pairs of a value of the one and a value of the other collection, so
bands x bands tables of 2 x rows minhashes each cost 2 x bands x rows minhashes. Two sets of
similarity s meet in some table with probability (1 - (1 - s^rows)^bands)^2; with the defaults
(18 bands of 3 rows) that is 0.9999 at s = 0.75 and nearly 1 from 0.8 on.

Classes. Documents with one shingle set are one class from the start (by a 128-bit hash of the
sorted set), so copies cost nothing further, however many there are. Classes are numbered when they are
written: each number is a file's place and a row's, so no two classes share one at any size.

Candidates are pairs of classes that share a table key. Keys are not written out for classes that
are alone with each value of the first collection. The others form a bucket for each such value; in
each of two rounds, every class is compared with one leader of its buckets with which it shares a
table key (the leader's values of the second collection travel with the bucket) and whose component it is not
in, a number of pairs that is linear in the classes; leaders are the classes with the
fullest buckets in the first round, and the least by a hash in the second. What is linked is
contracted.

Tables. Buckets that still hold several components are split into the tensored tables. Each
table that still holds several has a pivot p, and its classes are compared with it, which gives
x - p and p - x for each class x. From these lists the intersection of any two classes x and y of
the pivot is known exactly: |p| - |(p - x) or (p - y)| + |(x - p) and (y - p)|. So classes of other
components than the pivot's are put in blocks of bounded size with an index of their lists, all
classes of the pivot stream by, and what each shares with the block is counted by look-ups. A link
is emitted only if it joins components that no earlier link of the task has joined, so pairs
inside a large group are never listed. No pair of a table is lost.

Verification counts the shingles that both whole texts have, on executors: pairs are dealt by
leader and by blocks of bounded size, sorted so that the leader's text comes first, and
streamed; only the leader's set is held. Texts are fetched for the classes in buckets only: a bitmap
of their doc_ids, sized by their number, keeps most others out of the shuffle.

Components are found by passing on the least label and by pointer jumping, in the shared
folder's tables; nothing of them reaches the driver but counts.

Defined cases: null and empty texts and texts without words have an empty set and are linked
with nothing; fewer words than `width` make one shingle. Rows that repeat a doc_id share its
fate if their texts are alike; a null doc_id is larger than any other. Other columns are not read. An empty
table gives no rows. Texts are read whole; a task holds the shingle hashes of one long text at a time.
Among leaders of equal rank the class of the least number is taken; results don't depend on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, discard, passing, run_hashes, stash, table

#: Bytes of words: A-Z in lower case; blanks are what bytes.split() splits at.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WIDTH, BANDS, ROWS = 5, 18, 3
#: Stands for a null doc_id where texts are looked up.
LAST = (1 << 63) - 1


def shingles(text: str | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return np.unique(run_hashes(h, min(width, len(words))))


def band_values(sets: np.ndarray, factors: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The values of both collections, the first's before the second's."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(sets), 2048):
        part = sets[i : i + 2048, None] * factors
        np.minimum(low, part.min(0), out=low)
    out = np.zeros(2 * bands, np.uint64)
    for r in low.reshape(2 * bands, rows).T:
        out = (out ^ r) * np.uint64(0xC4CEB9FE1A85EC53)
        out ^= out >> np.uint64(29)
    return out


def sketch(docs: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set (hash of the shingles; null if there are none), the two collections a and b, and mark, the text's MD5."""
    rng = np.random.default_rng(20)
    factors = rng.integers(0, 1 << 63, 2 * bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            n, node, a, b = [], [], [], []
            for t in batch.column(1):
                s = shingles(t.as_py(), hashes)
                n.append(len(s))
                if not len(s):
                    node.append(None), a.append(None), b.append(None)
                    continue
                node.append(xxhash.xxh3_128_digest(s.tobytes()))
                both = band_values(s, factors, bands, rows).astype(np.int64)
                a.append(both[:bands])
                b.append(both[bands:])
            long_list = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(a, long_list), pa.array(b, long_list), batch.column(2)], names=["doc_id", "n_shingles", "set", "a", "b", "mark"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.md5(F.col(text)).alias("mark"))
    return own.mapInArrow(run, "doc_id long, n_shingles long, set binary, a array<long>, b array<long>, mark string")


def compare(pairs: DataFrame, texts: DataFrame, similarity: int, lists: bool = False, block_shingles: int = 50_000) -> DataFrame:
    """A stash of x, y, k and m (their sizes), linked, and the lists of differences, for the pairs (x, y).

    linked: 100 * |both| >= similarity * |either|; without lists only linked pairs are returned.
    lists: extra are the shingles of y that x has not, missing the places in x's sorted set of
    those that y has not. texts has node, n and text. Each leader x gets as many blocks as its
    partners' sizes call for.
    """
    sizes = pairs.join(texts.select(F.col("node").alias("y"), "n"), "y")
    # Written down, so that the join with a leader of many partners can be split.
    blocks = stash(sizes.groupBy("x").agg(F.ceil(F.sum("n") / block_shingles).alias("blocks")))
    dealt = pairs.join(blocks, "x").withColumn("block", F.pmod(F.xxhash64("y"), F.col("blocks")))
    partners = dealt.select("x", "block", F.col("y").alias("node")).join(texts.select("node", "text"), "node").select("x", "block", F.lit(1).alias("role"), "node", "text")
    leaders = blocks.select("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    leaders = leaders.join(texts.select(F.col("node").alias("x"), "text"), "x").select("x", "block", F.lit(0).alias("role"), F.col("x").alias("node"), "text")
    rows = leaders.unionByName(partners).repartition("x", "block").sortWithinPartitions("x", "block", "role")

    def run(batches):
        hashes = WordHashes()
        leader, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            out: dict[str, list] = {"x": [], "y": [], "k": [], "m": [], "linked": [], "extra": [], "missing": []}
            for x, role, node, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                if role == 0:
                    leader, own = x, shingles(t.as_py(), hashes)
                elif x == leader:
                    other = shingles(t.as_py(), hashes)
                    place = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    same = own[place] == other
                    both = int(same.sum())
                    linked = 100 * both >= similarity * (len(own) + len(other) - both)
                    if linked or lists:
                        gone = np.ones(len(own), bool)
                        gone[place[same]] = False
                        extra, missing = (other[~same].astype(np.int64), np.flatnonzero(gone).astype(np.int32)) if lists else ([], [])
                        for c, v in zip(out.values(), (x, node, len(own), len(other), linked, extra, missing)):
                            c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    out = stash(rows.mapInArrow(run, "x long, y long, k long, m long, linked boolean, extra array<long>, missing array<int>"))
    discard(blocks)
    return out


class Index:
    """Lists of several owners, to count how many entries a list shares with each."""

    def __init__(self, lists: list[np.ndarray]):
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner, self.n = flat[order], owner[order], len(lists)

    def shared(self, entries: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.flat, entries, "left"), np.searchsorted(self.flat, entries, "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=self.n)


#: What looking up one class costs besides its entries, in entries.
ROW_COST = 2000


def pivot_links(met: DataFrame, labels: DataFrame, similarity: int, block: int = 200_000, stretch: int = 1_000_000) -> DataFrame:
    """A stash of x and y of links that join all components that similar classes of one pivot are in.

    met has the pivot x, the class y, k, m, extra and missing. Classes outside the pivot's component
    form blocks of about `block` list entries; every class of the pivot meets each of them, dealt in
    stretches of about `stretch` entries. A class counts as `ROW_COST` entries besides its own.
    """
    named = stash(met.join(labels.select(F.col("node").alias("y"), "label"), "y").join(labels.select(F.col("node").alias("x"), F.col("label").alias("own")), "x"))
    size = F.size("extra") + F.size("missing") + ROW_COST
    outside = F.when(F.col("label") != F.col("own"), size)
    shape = stash(named.groupBy("x").agg(F.ceil(F.coalesce(F.sum(outside), F.lit(0)) / block).alias("blocks"), F.ceil(F.sum(size) / stretch).alias("stretches")).where("blocks > 0"))
    dealt = named.join(shape, "x")
    columns = ["x", "block", "stretch", "role", "y", "label", "k", "m", "extra", "missing"]
    last = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    inner = dealt.where("label != own").withColumn("block", F.pmod(F.xxhash64("y"), F.col("blocks"))).withColumn("stretch", F.explode(last("stretches"))).withColumn("role", F.lit(0))
    passing = dealt.withColumn("stretch", F.pmod(F.xxhash64("y", F.lit(1)), F.col("stretches"))).withColumn("block", F.explode(last("blocks"))).withColumn("role", F.lit(1))
    rows = inner.select(*columns).unionByName(passing.select(*columns)).repartition("x", "block", "stretch").sortWithinPartitions("x", "block", "stretch", "role")

    def run(batches):
        group, held, ready = None, [], None
        joined: dict[int, int] = {}

        def root(label: int) -> int:
            while joined.get(label, label) != label:
                label = joined[label]
            return label

        for batch in batches:
            xs, ys = [], []
            extras, missings = batch.column(8), batch.column(9)
            cells = [batch.column(i).to_pylist() for i in range(8)]
            for i, (x, b, stretch, role, y, label, k, m) in enumerate(zip(*cells)):
                if (x, b, stretch) != group:
                    group, held, ready = (x, b, stretch), [], None
                extra, missing = extras[i].values.to_numpy(), missings[i].values.to_numpy()
                if role == 0:
                    held.append((y, label, m, extra, missing))
                    continue
                if ready is None:
                    ready = Index([h[3] for h in held]), Index([h[4] for h in held]), np.array([h[2] for h in held]), np.array([len(h[4]) for h in held])
                plus, minus, sizes, gone = ready
                both = k - (gone + len(missing) - minus.shared(missing)) + plus.shared(extra)
                for j in np.flatnonzero(100 * both >= similarity * (sizes + m - both)).tolist():
                    p, q = root(held[j][1]), root(label)
                    if p != q:
                        joined[max(p, q)] = min(p, q)
                        xs.append(held[j][0])
                        ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    out = stash(rows.mapInArrow(run, "x long, y long"))
    discard(named, shape)
    return out


def components(links: DataFrame) -> DataFrame:
    """node and label, the least node of its component, for the nodes of links (x, y)."""
    edges = stash(links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = stash(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = stash(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        discard(labels)
        labels = after
        if after.where("label != old").isEmpty():
            discard(edges)
            return after


def link(classes: DataFrame, docs: DataFrame, text: str, similarity: int) -> DataFrame:
    """node and label for the classes that share a bucket. classes: set, node, rep, n, a, b."""
    each = classes.select("node", F.posexplode("a").alias("i", "v")).select("node", F.xxhash64("i", "v").alias("value"))
    shared = each.groupBy("value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = stash(each.join(shared, "value"))
    inside = stash(rows.groupBy("node").agg(F.sum("size").alias("weight")).join(classes.select("node", "set", "rep", "n"), "node"))
    one = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rep"), F.col(text).alias("text"))
    few = inside.select("node", "set", "n", F.coalesce("rep", F.lit(LAST)).alias("rep"))
    texts = stash(of_node(passing(one, "rep", few.select("rep")).join(few, "rep").select("node", "set", "n", "text")))
    each_value = rows
    rows = stash(rows.drop("size").join(inside.select("node", "weight"), "node").join(classes.select("node", "b"), "node"))
    discard(each_value)
    labels = stash(inside.select("node", F.col("node").alias("label")))
    discard(inside)
    for order in (-F.col("weight"), F.xxhash64("node")):
        now = rows.join(labels, "node").select("value", "node", "label", "b", F.struct(order.alias("o"), "node").alias("rank"))
        leader = now.groupBy("value").agg(F.min_by(F.struct("rank", "label", "b"), "rank").alias("leader"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        # A bucket's value and an equal value of the second collection are one table key.
        one_key = F.exists(F.zip_with("b", "leader.b", lambda p, q: p == q), lambda same: same)
        led = now.join(leader, "value").where("label != leader.label").where(one_key)
        pairs = stash(led.groupBy("node").agg(F.min("leader.rank").alias("rank")).select(F.col("rank.node").alias("x"), F.col("node").alias("y")))
        if not pairs.isEmpty():
            linked = compare(pairs, texts, similarity)
            labels = contract(labels, linked.select("x", "y"))
            discard(linked)
        discard(pairs)
    # What is still mixed is dealt to the tables by their keys, and is compared with their pivots there.
    now = rows.join(labels, "node").select("value", "node", "label", "weight", "b")
    mixed = now.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("value")
    tensored = now.join(mixed, "value").select("node", "label", "weight", "value", F.posexplode("b").alias("j", "other"))
    tensored = stash(tensored.select("node", "label", "weight", F.xxhash64("value", "j", "other").alias("key")))
    discard(rows)
    pivots = tensored.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("pivot"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key", "pivot")
    pairs = stash(tensored.join(pivots, "key").where("node != pivot").groupBy(F.col("pivot").alias("x"), F.col("node").alias("y")).agg(F.count(F.lit(1)).alias("tables")).select("x", "y"))
    discard(tensored)
    if not pairs.isEmpty():
        met = compare(pairs, texts, similarity, lists=True)
        labels = contract(labels, met.where("linked").select("x", "y"))
        more = pivot_links(met, labels, similarity)
        labels = contract(labels, more)
        discard(met, more)
    discard(pairs, texts)
    return labels


def of_node(fetched: DataFrame) -> DataFrame:
    """One text a node: rows of a doc_id that belongs to another set drop out."""

    def run(batches):
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            keep = [i for i, (own, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3))) if xxhash.xxh3_128_digest(shingles(t.as_py(), hashes).tobytes()) == own]
            yield batch.select([0, 2, 3]).take(pa.array(keep, pa.int64()))

    own = fetched.mapInArrow(run, "node long, n long, text string")
    return own.groupBy("node").agg(F.first("n").alias("n"), F.first("text").alias("text"))


def contract(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (a stash, which goes) after the components that links join have become one."""
    own = links.join(labels.select(F.col("node").alias("x"), F.col("label").alias("u")), "x").join(labels.select(F.col("node").alias("y"), F.col("label").alias("v")), "y")
    between = stash(own.where("u != v").select(F.col("u").alias("x"), F.col("v").alias("y")).distinct())
    joined = components(between)
    new = joined.select(F.col("node").alias("label"), F.col("label").alias("new"))
    out = stash(labels.join(new, "label", "left").select("node", F.coalesce("new", "label").alias("label")))
    discard(labels, between, joined)
    return out


def near_duplicates(docs: DataFrame, text: str = "text", similarity: int = 75) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id (the least doc_id of the component) and kept.

    Beside these, group (a number of the component; null for a class alone with its one row) and mark (the
    text's MD5), by which rows of one doc_id can be told apart.
    """
    sketched = stash(sketch(docs, text))
    grouped = sketched.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    # The numbers stand in what is written, so whatever reads it again finds the same ones.
    classes = stash(grouped.withColumn("node", F.monotonically_increasing_id()))
    labels = link(classes, docs, text, similarity)
    labelled = classes.select("set", "node", "rep", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.where("label != node or copies > 1").select("label").distinct()
    ids = stash(labelled.join(least, "label").select("label", "set", "rep"))
    discard(classes, labels)
    known = ids.join(ids.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("set", "component_id", F.col("label").alias("group"))
    out = sketched.select("doc_id", "n_shingles", "set", "mark").join(known, "set", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "group", "mark")


def query(spark, sf_dir):
    """op6: the near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).drop("group", "mark")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + least(5, len(w)) - 1), ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS s FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
few AS (SELECT sh FROM sh GROUP BY sh HAVING count(*) > 1),
own AS (SELECT sh.doc_id, sh.sh FROM sh JOIN few ON sh.sh = few.sh),
pair_counts AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM own a JOIN own b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pair_counts JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, e.y FROM reach r JOIN edges e ON r.other = e.x),
comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp c ON c.node = d.doc_id
"""
