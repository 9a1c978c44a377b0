"""Operators on texts against brute-force versions, with nulls, empty, long and repeated rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import bpe, decontaminate, minhash, quality_rules, substring, warc

SCHEMA = "doc_id long, text string, node string, n_words string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def words_of_length(rng, n, vocabulary=40):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# op3


def brute_hits(docs, items, window=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for k, (i, t) in enumerate(docs):
        w, hit, named = find(t), set(), set()
        for item, text in items:
            v = find(text)
            n = min(window, len(v))
            windows = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if v else set()
            for s in range(len(w) - n + 1 if n else 0):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    named.add(str(item) if item is not None else "null")
        out[k] = (i, len(w), len(hit), sorted(named))
    return sorted(out.values(), key=repr)


@pytest.mark.parametrize("block", [8_000_000, 60])
def test_decontamination(spark, block):
    rng = random.Random(block)
    items = [(1, "Alpha beta gamma"), (2, None), (3, "!!"), (10, " ".join(words_of_length(rng, 14))), (9, " ".join(words_of_length(rng, 12))), (9, "éa b"), (None, "solo")]
    long = words_of_length(rng, 5000)
    docs = [(1, None), (2, ""), (3, "x alpha, BETA; gamma-delta ÉA éa B solo"), (4, " ".join(long[:900] + items[3][1].split() + long[900:] + items[4][1].split()[:11])), (4, "solo"), (4, "solo"), (None, "SOLO solo")]
    got = decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_chars=block, blocks_a_pass=2)
    assert {"node", "key", "text"} <= set(got.columns)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got.collect()), key=repr) == brute_hits(docs, items)


def test_pieces_have_all_windows(spark):
    rng = random.Random(7)
    text = " ".join(words_of_length(rng, 300, 1000))
    items = spark.createDataFrame([("a", text), ("b", "x y"), ("c", "A" * 500), ("d", "")], "item string, text string")
    got = [(r["item"], r["text"]) for r in decontaminate.pieces(items, 10, 200).collect()]
    windows = lambda t: {tuple(t.split()[i : i + 10]) for i in range(len(t.split()) - 9)}
    own = [t for i, t in got if i == "a"]
    assert len(own) > 5 and set().union(*map(windows, own)) == windows(text) and all(len(t.split()) >= 10 and len(t) < 400 for t in own)
    assert sorted(x for x in got if x[0] != "a") == [("b", "x y"), ("c", "A" * 500), ("d", "")]


def test_many_windows_of_one_prefix(spark, monkeypatch):
    """Candidates beyond one verification: every window begins alike, and documents hold the beginning over and over."""
    monkeypatch.setattr(decontaminate, "CANDIDATES", 7)
    items = [(i, "p q r s t " + " ".join(f"e{i}x{j}" for j in range(5))) for i in range(30)]
    docs = [(1, "p q r s t " * 40 + items[3][1] + " " + items[29][1]), (2, "p q r s t e1x0")]
    got = decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got.collect()), key=repr) == brute_hits(docs, items)


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.decontaminate(frame(spark, [(1, "a b"), (2, None)]), none).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], len(r["item_ids"])) for r in got) == [(1, 2, 0, 0), (2, 0, 0, 0)]
    assert decontaminate.decontaminate(frame(spark, []), none).count() == 0


# op6


def brute_components(docs):
    sets = []
    for _, t in docs:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        n = min(5, len(w))
        sets.append({tuple(w[s : s + n]) for s in range(len(w) - n + 1)} if w else set())
    at = list(range(len(docs)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                at[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs)}


def mutated(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"m{rng.randrange(10**6)}"
    return out


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(11)
    texts = [None, "", " \n ", "One two", "one TWO", "one two three"]
    for _ in range(4):
        base = words_of_length(rng, 90, 1000)
        texts += [" ".join(mutated(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 4]))) for _ in range(40)]
        texts += [" ".join(base[: rng.randrange(50, 90)]) for _ in range(10)]
    texts += [" ".join(words_of_length(rng, 60, 1000)) for _ in range(30)]
    texts += [texts[20]] * 20
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    got = minhash.near_duplicates(frame(spark, docs)).collect()
    want = brute_components(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_odd_rows(spark):
    text = "a b c d e f g h"
    got = minhash.near_duplicates(frame(spark, [(7, text), (7, text), (None, text), (8, text.upper()), (9, None)])).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in got) == [("7", 7, True), ("7", 7, True), ("8", 7, False), ("9", 9, True), ("None", 7, False)]
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


# op9


def brute_substrings(docs, window):
    ws = [(d, (t or "").split()) for d, t in docs]
    first = {}
    for d, w in ws:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in ws:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < d:
                gone |= set(range(s, s + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("seed,shard", [(1, 200_000), (2, 30)])
def test_substrings_equal_all_windows(spark, seed, shard):
    rng = random.Random(seed)
    passages = [words_of_length(rng, n, 5) for n in (12, 25, 60)] + [["x"] * 40]
    docs = [(1, None), (2, ""), (3, "short text")]
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += p[a : a + rng.randrange(5, 60)] + words_of_length(rng, rng.randrange(15), 1000)
        docs.append((i + 4, " ".join(parts)))
    docs += [(100, docs[10][1]), (101, docs[10][1]), (102, docs[11][1] + " end"), (102, docs[12][1]), (104, docs[13][1]), (104, docs[13][1])]
    rng.shuffle(docs)
    got = substring.deduplicate(frame(spark, docs), window=12, anchor=4, block_words=300, shard_words=shard).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == brute_substrings(docs, 12)


def test_substrings_of_odd_tables(spark):
    assert substring.deduplicate(frame(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    got = substring.deduplicate(frame(spark, [(None, text), (5, text)])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("5", 0), ("None", 60)]


def test_suffix_automaton_spans():
    rng = random.Random(4)
    for _ in range(200):
        ref, own, least = [rng.choice("ab") for _ in range(rng.randrange(20))], [rng.choice("abc") for _ in range(rng.randrange(25))], rng.randrange(1, 6)
        held = {tuple(ref[i : i + least]) for i in range(len(ref) - least + 1)}
        want = {i for i in range(len(own) - least + 1) if tuple(own[i : i + least]) in held}
        got = {i for a, b in substring.SuffixAutomaton(ref).spans(own, least) for i in range(a, b - least + 1)}
        assert got == want


# op7


def test_quality_rules_equal_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", " \n\n", "a b c a b c a", "x x x x", "l1\nl1\n \nl2\nl1", "# $5 | é ü\x0b tab\tend", " ".join(words_of_length(rng, 20_000, 30)), "\n".join(["same line here"] * 60)]
    texts += [" ".join(words_of_length(rng, n, v)) for n, v in ((49, 900), (50, 900), (300, 12), (120, 60))]
    docs = spark.createDataFrame([(i, t, ["en", "de", None][i % 3], "e") for i, t in enumerate(texts)], "doc_id long, text string, lang string, words_ string")
    refs = quality_rules.references(docs, least_documents=4)
    assert refs.names == ["", "de", "en"]
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, refs).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c, again = Counter(zip(w, w[1:], w[2:])), set()
        for j, k in enumerate(zip(w, w[1:], w[2:])):
            if c[k] > 1:
                again |= {j, j + 1, j + 2}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
        assert (r["char_distance"] is None) == (len(t) < 200) and (r["word_distance"] is None) == (len(w) < 60)
        if r["word_distance"] is not None:
            counts = [sum(x == v for x in t.lower().split()) for v in refs.listed]
            p = [x / len(w) for x in [*counts, len(w) - sum(counts)]]
            best = min(math.sqrt(max(0.0, js(p, q))) for _, q in refs.rows)
            assert r["word_distance"] == pytest.approx(best, abs=1e-9)


def test_repeated_windows_equal_brute_force(spark):
    rng = random.Random(31)
    texts = [" ".join(rng.choice(["aa", "b", "C"][:k] + [f"w{i}" for i in range(v)]) for _ in range(n)) for n in (2, 3, 4, 40, 700, 30_000) for k, v in ((1, 0), (2, 0), (3, 3), (3, 40), (0, 4000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.judge(docs, quality_rules.References([], [], [])).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        windows = list(zip(w, w[1:], w[2:]))
        c = Counter(windows)
        assert got[i] == len({j + k for j, x in enumerate(windows) if c[x] > 1 for k in range(3)}), (i, len(w))


def test_texts_and_words_are_not_carried_to_the_sort(spark):
    docs = spark.createDataFrame([(1, "a b c a b c", "en")], "doc_id long, text string, lang string")
    plan = quality_rules.judge(docs, quality_rules.references(docs, least_documents=1))._jdf.queryExecution().optimizedPlan().toString()
    steps = [x for x in plan.splitlines() if " AS sorted_#" in x]
    assert steps and not any(re.search(r"\b(text|words_)#", x) for x in steps)
    assert "translate(" not in plan


def js(p, q):
    half = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b) if x > 0)
    return (half(p, q) + half(q, p)) / 2


SAMPLES = ["aAé0 .#–", "Война и мир", "Ὅμηρος λόγος", "日本語カナ한글", "שלום ٣٤ नमस्ते", "e\u0301 ½ ☃ \U0001f600", ""]


def test_character_classes(spark):
    import regex

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(SAMPLES)] + [(99, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["classes"] for r in quality_rules.class_counts(docs).collect()}
    scripts = [regex.compile(x) for x in (r"\p{Latin}", r"\p{Cyrillic}", r"\p{Greek}", r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]", r"\p{L}", r"[\p{M}\p{N}]")]
    for i, t in enumerate(SAMPLES):
        want = [0] * quality_rules.ALL_CLASSES
        for c in t:
            own = next((j for j, k in enumerate(quality_rules.CLASSES) if c in k), None)
            want[own if own is not None else 6 + next((j for j, p in enumerate(scripts) if p.match(c)), 6)] += 1
        assert got[i] == want, t
    assert sum(got[99]) == 0


def test_small_languages_are_not_judged(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(words_of_length(rng, 80, 20)), "en") for i in range(30)] + [(100 + i, " ".join(f"слово{rng.randrange(900)}" for _ in range(80)), "ru") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, quality_rules.references(docs)).collect()}
    assert all(got[100 + i]["char_distance"] is None and got[100 + i]["kept"] != got[100 + i]["base_failed"] for i in range(3))
    all_of_them = quality_rules.references(docs, least_documents=1)
    assert all_of_them.names == ["en", "ru"] and all(r["char_distance"] is not None for r in quality_rules.judge(docs, all_of_them).collect())


def test_quality_rules_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    refs = quality_rules.references(empty)
    assert quality_rules.judge(empty, refs).count() == 0
    one = spark.createDataFrame([(1, " ".join(map(str, range(60))))], "doc_id long, text string")
    assert quality_rules.judge(one, refs).first()["kept"]


# op5


def test_archives(spark, tmp_path):
    rows = [(1, "http://www.B.example/x#f", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "https://a.example/?q", None), (4, " ", ""), (5, "http://a.example/", "WARC/1.1\r\n\r\nWARC/1.1\r\n"), (None, "u\nv", "null id"), (7, "http://b.example/x", "<p>é</p>")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")
    index = warc.capture_history(pages, f"file://{tmp_path}/warc").collect()
    got = {r["page_id"]: r for r in index}
    assert len(index) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("revisit", 7), 2: ("revisit", 7), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("response", None), 7: ("response", None)}
    assert got[1]["url_key"] == got[7]["url_key"] == "example,b)/x" and got[2]["url_key"] == got[4]["url_key"] == "-"
    keys = [(r["url_key"].encode(), r["stamp"]) for r in index]
    assert keys == sorted(keys)


def test_members_can_be_sought_and_read_by_others(spark, tmp_path):
    import gzip

    rng = random.Random(12)
    noise = "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(3000))
    rows = [(i, f"http://h{i % 3}.example/{i}", noise[: rng.randrange(3000)] + str(i % 7)) for i in range(40)] + [(99, "http://big.example", "long " * 4_000_000), (99, "http://big.example", "long " * 4_000_000), (3, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.capture_history(pages.withColumn("captured_at", warc.F.lit("no time")), f"file://{tmp_path}/warc", few=0).collect()
    assert sorted(r["page_id"] for r in index) == sorted(r[0] for r in rows)
    files = {f.name: f.read_bytes() for f in (tmp_path / "warc").glob("*/part-*")}
    assert len(files) > 1
    for data in files.values():
        whole = gzip.decompress(data)
        assert sum(1 for _ in warc.parse(whole)) == sum(sum(1 for _ in warc.parse(m)) for _, m in warc.unpacked(data))
    for r in index:
        unpack = zlib.decompressobj(31)
        headers, block, at = next(warc.parse(unpack.decompress(files[r["archive"]][r["offset"] :])))
        assert at == 0 and unpack.eof and int(headers["X-Page-ID"]) == r["page_id"] and headers["WARC-Type"] == r["record_type"]
        if r["record_type"] == "response":
            assert base64.b32encode(hashlib.sha1(block).digest()).decode() == r["payload_digest"]
    assert any(len(m) > 1 << 24 for d in files.values() for _, m in warc.unpacked(d))


def test_archives_of_other_writers(spark, tmp_path):
    def record(kind, url, block, extra=""):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2021-03-04T05:06:07Z\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    records = [record("warcinfo", "", b"software: x"), record("response", "https://www.B.example:443/x?y#f", b"\xff\x00 bytes"), record("request", "https://b.example", b"GET"), record("resource", "http://a.example/", b"")]
    (tmp_path / "two.warc.gz").write_bytes(b"".join(zlib.compress(r, 9, 31) for r in records))
    (tmp_path / "one.warc.gz").write_bytes(zlib.compress(b"".join(records), 9, 31))
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = warc.merge_index(warc.read_runs(warc.read_archives(spark, f"file://{tmp_path}"))).collect()
    assert [r["url_key"] for r in got] == ["example,a)/"] * 3 + ["example,b)/x?y"] * 3
    assert {r["payload_bytes"] for r in got[3:]} == {8} and all(r["page_id"] is None and r["record_type"] == "response" for r in got)
    (tmp_path / "cut.warc.gz").write_bytes(zlib.compress(records[1], 9, 31)[:-9])
    with pytest.raises(Exception, match="cut off"):
        warc.read_runs(warc.read_archives(spark, f"file://{tmp_path}")).collect()


def test_url_keys_agree(spark):
    urls = ["http://www.B.example/x#f", "https://www2.a.example:443/?q=1", "ftp://h", " x.example/Ü ", "", "a?b/c", "HTTP://A.B.C:80"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", warc.url_key(warc.F.col("url")).alias("k")).collect()
    assert all(r["k"] == warc.key_of(r["url"]) for r in rows)


def test_archives_without_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.capture_history(pages, f"file://{tmp_path}/warc").count() == 0


def test_loser_tree_merges_runs_in_order():
    rng = random.Random(3)
    for _ in range(100):
        k = rng.randrange(9)
        rows = [(rng.choice("abc"), str(rng.randrange(4)), rng.choice([None, 1, 2]), "", None, 0, "", rng.choice("xy"), i) for i in range(rng.randrange(60) if k else 0)]
        runs = [[] for _ in range(k)]
        for r in rows:
            runs[rng.randrange(k)].append(r)
        runs = [sorted(r, key=warc.order) for r in runs]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(rows, key=warc.order)
        flat = [x for r in runs for x in r]
        assert [x for r in warc.natural_runs(iter(flat)) for x in r] == flat


# op10

def test_bpe_of_repeated_rows_and_a_very_long_text(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(path))}, special_tokens={})
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(200_000))
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, long), (3, "x" * 20_000)], "doc_id long, text string")
    got = bpe.round_trip(docs, path).collect()
    assert len(long) > 10**6 and sorted(len(r["token_ids"]) for r in got)[:3] == [2, 2, 2]
    for r in got:
        want = {2: long, 3: "x" * 20_000}.get(r["doc_id"], "a b")
        assert r["token_ids"] == library.encode_ordinary(want) and bytes(r["decoded"]).decode() == want
    assert bpe.round_trip(docs.where("false"), path).count() == 0


HARD = ["", "日本語テキスト", "😀😀 a\u0000b\r\n\t  x", "a" * 2000, "▁x ▁▁ <unk> <s>", "é́" * 30, " \xa0 ", "12345" * 40, "it's we'll  \n\n end "]


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(path))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = [None, *HARD, *["".join(chr(rng.choice([32, 97, 101, 233, 0x4E00, 0x1F600, 10]) + rng.randrange(3)) for _ in range(80)) for _ in range(40)]]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, decoded string")
    done = {r["doc_id"]: r for r in bpe.round_trip(docs, path).collect()}
    apart = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    for i, t in enumerate(texts):
        assert done[i]["token_ids"] == apart[i]["token_ids"] == library.encode_ordinary(t or "")
        assert bytes(done[i]["decoded"]) == bytes(apart[i]["decoded"]) == (t or "").encode()
