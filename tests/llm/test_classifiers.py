"""Held-out accuracy and edge cases of the three classifiers."""

import random

import pytest

from pyspark.sql import functions as F

from tessera.llm import langid, quality_knn, toxicity
from tessera.llm.common import remainder

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "12 !? 34"), (5, "word " * 30_000), (5, "word " * 30_000), (None, "der die das und"), (7, "\U0001f600 \U00020000")]


def odd(spark):
    return spark.createDataFrame([(i, t, "x", "y", 0.5) for i, t in ODD], "doc_id long, text string, score string, lang_pred string, extra double")


def held_out(spark, query, label, rest):
    docs = query(spark, SF)
    assert docs.count() == 1000
    assert docs.where("score < 0 or score > 1 or score is null").isEmpty()
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    rows = docs.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > rest
    return sum(r["predicted"] == r[label] for r in rows) / len(rows)


def test_quality_held_out(spark):
    assert held_out(spark, quality_knn.query, "quality", 50) > 0.93


def test_toxicity_held_out(spark):
    assert held_out(spark, toxicity.query, "toxic", 80) > 0.93


def test_language_held_out(spark):
    got = langid.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98


def test_language_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, remainder("doc_id", 5) != 0, max_train=200, landmarks=60)
    got = langid.identify(odd(spark), model).orderBy("doc_id").collect()
    assert len(got) == len(ODD) and set(got[0].asDict()) == {"doc_id", "text", "extra", "lang_pred", "score"}
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1, 2, 3, 4))
    assert by_id[None]["lang_pred"] == "de" and by_id[7]["lang_pred"] != "und"
    empty = langid.train(docs.where("false"), remainder("doc_id", 5) != 0)
    assert {r["lang_pred"] for r in langid.identify(odd(spark), empty).collect()} == {"und"}
    assert langid.identify(odd(spark).where("false"), model).count() == 0


def test_kernel_is_the_mean_share_of_common_ngrams():
    letters = langid.letter_table()
    rows = langid.np.zeros((2, langid.WIDTH), bool)
    for row, t in zip(rows, ("abc", "abd")):
        assert langid.presence(t, letters, row)
    x = langid.scaled(rows)
    grams = [{(" " + t + " ")[i : i + n] for i in range(len(t) + 3 - n)} for n in (1, 2, 3, 4) for t in ("abc", "abd")]
    want = sum(len(a & b) / (len(a) * len(b)) ** 0.5 for a, b in zip(grams[::2], grams[1::2])) / 4
    assert float(x[0] @ x[1]) == pytest.approx(want, abs=1e-6)


def test_quality_odd_texts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    voters = quality_knn.train(docs, labels, remainder("doc_id", 5) != 0, max_train=100)
    got = {r["doc_id"]: r["score"] for r in quality_knn.vote(odd(spark), voters).collect()}
    assert all(0 <= v <= 1 for v in got.values()) and got[1] == got[2] == pytest.approx(voters.prior)
    none = quality_knn.train(docs, labels.where("false"), remainder("doc_id", 5) != 0)
    assert {r["score"] for r in quality_knn.vote(odd(spark), none).collect()} == {0.5}


def test_votes_equal_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    voters = quality_knn.train(docs, labels, remainder("doc_id", 5) != 0, max_train=150, rank=16)
    got = {r["doc_id"]: r["score"] for r in quality_knn.vote(docs.where("doc_id < 60").select("doc_id", "text"), voters, neighbours=5).collect()}
    for r in docs.where("doc_id < 60").collect():
        v = quality_knn.counts(r["text"], quality_knn.Columns()) @ voters.projection
        near = voters.points @ (v / quality_knn.np.linalg.norm(v))
        top = sorted(range(len(near)), key=lambda i: -near[i])[:5]
        w = [max(float(near[i]), 0.0) ** 8 for i in top]
        assert got[r["doc_id"]] == pytest.approx(sum(a * voters.labels[i] for a, i in zip(w, top)) / sum(w), abs=1e-3)


def distance(a, b):
    """Edits, and swaps of neighbours that nothing else touches."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@pytest.mark.parametrize("bounds", [toxicity.BOUNDS, ((4, 1), (5, 2))])
def test_automaton_equals_edit_distance(bounds):
    rng = random.Random(5)
    lexicon = {"idiot$": 3.0, "abcab": 2.0, "abc$": 1.0, "caba": 1.5, "abcabcabc$": 2.5}
    automaton = toxicity.Automaton(lexicon, max_states=50, bounds=bounds)

    def errors(word, entry):
        term = entry.rstrip("$")
        bound = max([0, *(e for n, e in bounds if len(term) >= n)])
        best = distance(word, term) if entry.endswith("$") else min(distance(word[:n], term) for n in range(len(word) + 1))
        return best if best <= bound else None

    words = ["idiot", "idoit", "idit", "xidiot", "idiots", "idi0t", "abc", "abcd", "abcabxyz", "abxabq", "caba", "cabazz", "", "abcbacabc", "abcbacacb", "bacabcabx"]
    words += ["".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(500)]
    for w in words:
        found = {e: errors(w, e) for e in lexicon if errors(w, e) is not None}
        weight, n = automaton.match(w)
        assert bool(weight) == bool(found), w
        if found:
            assert n == min(found.values()), (w, n, found)
            assert weight == max(lexicon[e] for e in found if found[e] == n), w


def brute_lexicon(documents, max_entries, least, least_odds, cover):
    """The greedy choice, counted afresh at each step."""
    entries = lambda w: [w[:n] for n in range(4, 11) if n <= len(w)] + ([w + "$"] if len(w) > 2 else [])
    uses = [({p: min(8, sum(k for w, k in words.items() if p in entries(w))) for p in {p for w in words for p in entries(w)}}, y) for words, y in documents]
    n = [sum(y == c for _, y in documents) for c in (0, 1)]
    total = lambda p, c: sum(u.get(p, 0) for u, y in uses if y == c)
    open_ = {}
    for p in {p for u, y in uses if y for p in u}:
        odds = ((total(p, 1) + 0.5) / n[1]) / ((total(p, 0) + 0.5) / max(1, n[0]))
        held = [i for i, (u, y) in enumerate(uses) if y and p in u]
        if total(p, 1) >= least and odds >= least_odds and len(held) >= least:
            open_[p] = (odds, held)
    covered, lexicon = [0] * len(uses), {}
    while open_ and len(lexicon) < max_entries:
        worth = {p: sum(covered[i] < cover for i in held) for p, (_, held) in open_.items()}
        best = max(open_, key=lambda p: (worth[p] * (1 - 2 / (2 + open_[p][0])), len(p), p))
        odds, held = open_.pop(best)
        if worth[best] < least:
            break
        a = best.rstrip("$")
        if any(t.rstrip("$").startswith(a) or a.startswith(t.rstrip("$")) for t in lexicon):
            continue
        lexicon[best] = toxicity.math.log(odds)
        for i in held:
            covered[i] += 1
    return lexicon


def test_lexicon_equals_brute_force():
    rng = random.Random(13)
    rude = ["idiot", "idiots", "moron", "scumbag", "scumbags", "stinker", "bah"]
    for round_ in range(6):
        documents = []
        for i in range(60):
            words = [rng.choice(["good", "morning", "stint", "people", "moral", "walking"]) for _ in range(20)]
            words += [rng.choice(rude) for _ in range(rng.randrange(12) if i % 3 == 0 else rng.random() < 0.1)]
            documents.append((toxicity.Counter(words), int(i % 3 == 0)))
        got = toxicity.learn_lexicon(documents, 10, 2, 3.0, 2)
        assert got == pytest.approx(brute_lexicon(documents, 10, 2, 3.0, 2)) and (round_ or got)


def test_score_equals_brute_force(spark, disagreeing):
    docs, labels = disagreeing
    model = toxicity.train(docs, labels, F.lit(True))
    matches = toxicity.Matches(toxicity.Automaton(model.lexicon))
    for r in toxicity.score(docs.where("doc_id < 30"), model).collect():
        x = toxicity.features(r["text"], matches, model.window)
        z = sum(float(a) * float(b) for a, b in zip(x, model.weights)) + float(model.weights[-1])
        assert r["score"] == pytest.approx(1 / (1 + toxicity.math.exp(-z)), abs=1e-9)


def test_projection_keeps_the_largest_singular_values():
    np = quality_knn.np
    rng = random.Random(4)
    columns = quality_knn.Columns()
    x = np.stack([quality_knn.counts(" ".join(rng.choice(["a", "Bc", "12", "d-e", "word", "LOUD", "x!"]) for _ in range(40)), columns) for _ in range(50)])
    projection, gram = quality_knn.project(x, 5)
    values = np.linalg.svd(x.astype(float), compute_uv=False)
    assert np.linalg.norm(x @ projection) ** 2 == pytest.approx(float((values[:5] ** 2).sum()), rel=1e-4)
    assert np.allclose(projection.T @ projection, np.eye(5), atol=1e-4) and gram.shape == (quality_knn.WIDTH,) * 2


def test_signs_between_letters():
    matches = toxicity.Matches(toxicity.Automaton({"idiot$": 3.0}))
    assert matches["id!ot"] == (3.0, 1) and matches["i.d-i_o*t!"] == (3.0, 1) and matches["idiot!"] == (3.0, 0) and matches["it's"] is None


@pytest.fixture
def disagreeing(spark):
    """Labels of which some ids have both, in two orders, and texts of which one id has two."""
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice(["you", "are", "fine", "good", "day"] + ["idiot", "moron", "scum"] * (i % 2)) for _ in range(60))) for i in range(120)]
    texts += [(0, "another text"), (None, "no id"), (7, None), (121, ""), (122, "x " * 50_000)]
    labels = [(i, i % 2, i % 2) for i in range(125)] + [(i, 1 - i % 2, 1 - i % 2) for i in range(6)] + [(3, None, None), (None, 1, 1)]
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module", [quality_knn, toxicity])
def test_models_do_not_depend_on_partitions(spark, disagreeing, module):
    docs, labels = disagreeing
    apply = quality_knn.vote if module is quality_knn else toxicity.score
    scores = []
    for n in (1, 50):
        model = module.train(docs.repartition(n), labels.repartition(n), F.lit(True))
        scores.append({(r["doc_id"], r["text"]): r["score"] for r in apply(docs, model).collect()})
    assert scores[0] == scores[1]
    assert apply(docs.where("false"), model).count() == 0


def test_labels_of_one_id_count_as_the_largest(disagreeing):
    from tessera.llm.common import labelled

    docs, labels = disagreeing
    for classes in (None, (0, 1)):
        rows = labelled(docs, labels, "toxic", F.lit(True), 1000, classes).collect()
        got = {r["doc_id"]: r["y"] for r in rows}
        assert len(rows) == len(got) and all(got[i] == 1 for i in range(6)) and None not in got
        assert set(got) == set(range(120)) | {121, 122}
    few = labelled(docs, labels, "toxic", F.lit(True), 20, (0, 1)).collect()
    assert len(few) <= 20 and {r["y"] for r in few} == {0, 1}


def test_language_equals_kernel_ridge(spark):
    """With every training row a landmark, the Nystroem features give kernel ridge regression itself."""
    np = langid.np
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60 and lang is not null")
    rows = [r for r in docs.orderBy("doc_id").collect() if r["text"] and any(c.isalpha() for c in r["text"])]
    model = langid.train(spark.createDataFrame(rows, docs.schema), F.lit(True), landmarks=10**6, ridge=1e-2)
    letters = langid.letter_table()
    grams = []
    for r in rows:
        row = np.zeros(langid.WIDTH, bool)
        langid.presence(r["text"], letters, row)
        grams.append([set(np.flatnonzero(row[langid.STARTS[n] : langid.STARTS[n + 1]]).tolist()) for n in range(len(langid.BLOCKS))])
    kernel = np.array([[sum(len(a & b) / (len(a) * len(b)) ** 0.5 for a, b in zip(x, y)) / len(langid.BLOCKS) for y in grams] for x in grams])
    names = sorted({r["lang"] for r in rows})
    target = np.array([[1.0 if r["lang"] == n else -1.0 for n in names] for r in rows])
    m = len(rows)
    system = np.block([[kernel + 1e-2 * m * np.eye(m), np.ones((m, 1))], [np.ones((1, m)), np.zeros((1, 1))]])
    weight = np.linalg.solve(system, np.vstack([target, np.zeros((1, len(names)))]))
    out = kernel @ weight[:-1] + weight[-1]
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for r, o in zip(rows, out):
        assert got[r["doc_id"]]["lang_pred"] == names[int(o.argmax())]
        assert got[r["doc_id"]]["score"] == pytest.approx(min(1.0, (1 + o.max()) / 2), abs=2e-3)


def test_language_model_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rare = spark.createDataFrame([(10**6 + i, "Koira ja kissa leikkivät puutarhassa ja lapset juoksevat", "fi", "x", 0) for i in range(3)], docs.schema)
    both = [langid.train(docs.union(rare).repartition(n), F.lit(True), max_train=200, landmarks=50) for n in (1, 30)]
    assert both[0].names == both[1].names and "fi" in both[0].names
    assert langid.np.array_equal(both[0].matrix, both[1].matrix)
    assert langid.train(docs.union(rare), F.lit(True), max_train=200, max_languages=2).names == sorted(r["lang"] for r in docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(2).collect())


def test_quotation_is_told_from_abuse():
    matches = toxicity.Matches(toxicity.Automaton({"idiot$": 3.0}))
    plain = toxicity.features("you are an idiot and more", matches, 4)
    quoted = toxicity.features("they said the word idiot was used", matches, 4)
    misspelt = toxicity.features("you idi0t", matches, 4)
    assert plain[0] > 0 and plain[1] == 0
    assert quoted[0] == 0 and quoted[1] > 0
    assert misspelt[2] > 0 and misspelt[0] == 0


def test_toxicity_odd_texts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels, remainder("doc_id", 3) != 1, max_train=300)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(odd(spark), model).collect()}
    assert all(0 <= v <= 1 for v in got.values()) and got[1] == got[2] == got[3]
    none = toxicity.train(docs, labels.where("toxic = 0"), remainder("doc_id", 3) != 1)
    assert {r["score"] for r in toxicity.score(odd(spark), none).collect()} == {0.5}


def test_held_out_remainder_of_null(spark):
    df = spark.createDataFrame([(None,), (0,), (5,)], "doc_id long")
    assert all(r[0] is not None for r in df.select(remainder("doc_id", 5)).collect())
    assert df.where(F.col("doc_id") == 0).select(remainder("doc_id", 5)).first()[0] == __import__("zlib").crc32(b"0") % 5
