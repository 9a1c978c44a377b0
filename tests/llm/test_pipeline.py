"""The pipeline, stage by stage against brute-force versions."""

from pyspark.sql import functions as F
from test_surrogates import brute as brute_surrogates
from test_text_operators import brute_components, brute_hits

import corpus_pipeline
from tessera.llm import langid, surrogates
from tessera.llm.common import remainder, stash

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute_languages(docs):
    """The doc_ids that language ID keeps, by one text and one inner product with the model after another."""
    np, letters = langid.np, langid.letter_table()
    model = langid.train(docs, remainder("doc_id", 5) != 0)
    c = len(model.names)
    kept = set()
    for r in docs.collect():
        row = np.zeros(langid.WIDTH, bool)
        if r["text"] and any(ch.isalpha() for ch in r["text"]):
            assert langid.presence(r["text"], letters, row)
            parts = [row[a:b] / (max(1, row[a:b].sum()) * len(langid.BLOCKS)) ** 0.5 for a, b in zip(langid.STARTS, langid.STARTS[1:])]
            best = max(float(np.concatenate(parts) @ model.matrix[:-1, k] + model.matrix[-1, k]) for k in range(c))
            if (1 + best) / 2 >= 1 / c + corpus_pipeline.LEAST_LANGUAGE_SHARE * (1 - 1 / c):
                kept.add(r["doc_id"])
    return kept


def test_stages(spark, monkeypatch):
    import test_surrogates

    monkeypatch.setattr(surrogates, "session_key", lambda spark: test_surrogates.KEY)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        before, now_before = {r["doc_id"]: r["text"] for r in now.collect()}, now
        now = stash(stage(spark, now, SF))
        kept[name] = now
        after = {r["doc_id"]: r for r in now.collect()}
        assert set(after) <= set(before)
        if name != "tokens":
            assert now.columns == COLUMNS
        if name == "language_id":
            assert set(after) == brute_languages(now_before) and len(after) >= 0.95 * len(before)
        elif name == "near_dedup":
            want = {i for i, (_, c) in brute_components(list(before.items())).items() if i == c}
            assert set(after) == want
        elif name == "decontamination":
            hits = {i: n for i, _, n, _ in brute_hits(list(before.items()), items)}
            assert set(after) == {i for i, n in hits.items() if n == 0}
        elif name == "personal_data":
            assert set(after) == set(before)
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
            assert {i: r["text"] for i, r in after.items()} == {i: brute_surrogates(t)[0] for i, t in before.items()}
        else:
            assert set(after) == set(before) and all(r["round_trip"] for r in after.values())
    whole = corpus_pipeline.run(spark, SF)
    assert whole.exceptAll(kept["tokens"]).isEmpty() and whole.count() == kept["tokens"].count()


def test_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "123 456", None, "s", 7), (4, "Der Hund und die Katze " * 3, "de", None, None), (4, "Der Hund und die Katze " * 3, "de", None, None), (None, "Mail an x@y.example.de bitte", "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, SF))
        if name == "language_id":
            assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["4", "4", "None"]
        if name == "near_dedup":
            assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["4", "None"]
    assert docs.count() == 2
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stash(stage(spark, empty, SF))
    assert empty.count() == 0


def test_no_language(spark):
    """Texts with letters in no learned language are dropped, all others stay."""
    import random

    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9)))
    planted = [" ".join(word() for _ in range(n)) for n in (50, 200, 1000)]
    planted += ["Koira ja kissa leikkivät puutarhassa, ja lapset juoksevat metsässä illalla. " * 3, "A kutya és a macska a kertben játszik, a gyerekek este az erdőben szaladnak. " * 3]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    odd = spark.createDataFrame([(10**6 + 5 * i, t, None, "planted", len(t)) for i, t in enumerate(planted)], docs.schema)
    kept = corpus_pipeline.language_id(spark, docs.union(odd), SF)
    assert kept.where("source = 'planted'").isEmpty()
    assert kept.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()


def test_least_score():
    assert all(1 / c < corpus_pipeline.least_score(c) < 1 for c in range(2, 100)) and corpus_pipeline.least_score(1) == 0


CLASHING = ["kept_id", "n_entities", "n_hit", "N_Words", "item_ids", "lang_pred", "score", "hit_spans", "group", "mark", "stays", "copies", "own id", "aside 3", "ring", "parts", "set", "a.b"]


def test_clashing_columns_pass_unchanged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, c in enumerate(CLASHING):
        docs = docs.withColumn(c, F.concat(F.lit(f"{i} "), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, SF))
        assert docs.columns == COLUMNS + CLASHING, name
        assert all(r[c] == f"{i} {r['doc_id']}" for r in docs.collect() for i, c in enumerate(CLASHING)), name
        assert docs.count() > 100


def test_near_dedup_by_row(spark):
    """Of repeated rows one stays; each text of one doc_id has its own verdict; rows without words stay."""
    a, b = "a b c d e f g h", "one two three four five six seven"
    rows = [(5, a), (5, a), (5, b), (7, a.upper()), (3, b), (9, None), (9, None), (10, ""), (None, "alone here"), (None, "and this too"), (11, "x y z"), (11, "x y z")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(str((r["doc_id"], r["text"])) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert kept == sorted(map(str, [(5, a), (3, b), (9, None), (9, None), (10, ""), (None, "alone here"), (None, "and this too"), (11, "x y z")]))


def shuffled_bytes(spark):
    """What all stages of the session have written to shuffles."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = store.stageList(None, False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_that_stay_are_not_shuffled(spark):
    """Pipeline: where verdicts are too many to broadcast, near_dedup shuffles the texts that may be dropped only."""
    import random

    rng = random.Random(3)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(1000)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(300, texts[0]), (301, texts[1]), (1, texts[1]), (None, texts[2]), (400, None), (401, "")]
    docs = stash(spark.createDataFrame(rows, "doc_id long, text string"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = corpus_pipeline.near_dedup(spark, docs, SF)
        before = shuffled_bytes(spark)
        kept = stash(found)
        assert shuffled_bytes(spark) - before < 1_000_000 < sum(map(len, texts)) / 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([*enumerate(texts), (400, None), (401, "")])
