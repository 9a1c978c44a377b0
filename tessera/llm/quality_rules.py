"""Quality rules with a distribution-divergence verdict, in DataFrame functions only.

Base figures of a text, over words that are runs of other characters than blank, tab and line
ends: characters in words, symbols of `#*$%&|<>`, lines that equal an earlier line, and words in
three-word windows that occur twice or more. They give the base verdict.

The method's verdict compares two histograms of a text with references of each language, made
from all documents: classes of characters (ASCII ones by kind, all others by script), and common words (the
`common` most frequent words of each language in lower case, and all other words as one bin). The Jensen-Shannon
distance (base 2, square root) to the nearest language must not exceed `char_limit` and
`word_limit`; a text with fewer than `min_chars` or `min_words` is too short for the one or
the other and is not judged by it.

Every language of at least `least_documents` documents gives a reference (rows whose language is null make one of
their own); a text of a language without one is not judged by the method. References and listed words are
literals of the plan, which suits some hundred languages.
Windows are compared as 64-bit hashes within one text.

Defined cases: null and empty texts have no words and fail the base rule; without any language
reference the method keeps; an empty table gives no rows. Repeated rows count each in the references and get equal
verdicts. Of words equally frequent the first in byte order is listed. Long texts are worked on whole, inside
their row. Input columns other than doc_id, text and lang are not read or returned, so their names can't clash.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, stash, table

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
POINTS = ".,;:!?'\"()-"
#: ASCII characters of each class, lower-case letters first.
CLASSES = (string.ascii_lowercase, string.ascii_uppercase, string.digits, BLANKS, SYMBOLS, POINTS)
#: Classes of what is left: letters by script, other letters, marks and digits; what is in none is the last class.
SCRIPTS = (r"\p{IsLatin}", r"\p{IsCyrillic}", r"\p{IsGreek}", r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]", r"\p{L}", r"[\p{M}\p{N}]")
#: Runs of each class, ASCII ones first.
RUNS = (*[f"[{re.escape(c)}]+" for c in CLASSES], *[f"{p}+" for p in SCRIPTS])
ALL_CLASSES = len(CLASSES) + len(SCRIPTS) + 1
SPLIT = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPLIT), "")


def class_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_chars_ and classes, the number of characters in each class.

    Classes are taken out one after the other, lower-case letters and blanks first, so that each is looked for in
    what is left only; a class has the characters by which the text gets shorter.
    """
    left, sizes = "left_", {}
    df = df.withColumn(left, F.coalesce(F.col(text), F.lit(""))).withColumn("n_chars_", F.length(left))
    first = (0, CLASSES.index(BLANKS))
    for i in (*first, *[i for i in range(len(RUNS)) if i not in first]):
        less = f"left{i}_"
        df = df.withColumn(less, F.when(F.col(left) == "", "").otherwise(F.regexp_replace(left, RUNS[i], "")))
        sizes[i], left = F.length(left) - F.length(less), less
    return df.withColumn("classes", F.array(*[sizes[i] for i in range(len(RUNS))], F.length(left))).drop("left_", *[f"left{i}_" for i in sizes])


def repeated_words(df: DataFrame, array: str = "words_") -> DataFrame:
    """df with n_repeat_words, the words in three-word windows that occur twice or more."""
    far, place = F.lit(1 << 30), (1 << 31) - 1
    three = F.transform(array, lambda w, i: F.xxhash64(w, F.get(array, i + 1), F.get(array, i + 2)))
    df = df.withColumn("three_", F.slice(three, F.lit(1), F.greatest(F.size(array) - 2, F.lit(0))))
    # The upper bits of a hash and its place in one number sort quickly. Equal hashes have neighbours with equal upper bits; only such are sorted whole.
    packed = F.sort_array(F.transform("three_", lambda h, i: h.bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("long"))))
    df = df.withColumn("packed_", F.when(F.size(F.array_distinct("three_")) < F.size("three_"), packed))
    upper = lambda p: F.shiftright(p, 31)
    df = df.withColumn("near_", F.filter("packed_", lambda p, i: (upper(p) == upper(F.get("packed_", i + 1))) | (upper(p) == upper(F.get("packed_", i - 1)))))
    at = F.transform("near_", lambda p: p.bitwiseAND(F.lit(place)).cast("int"))
    df = df.withColumn("sorted_", F.sort_array(F.transform(at, lambda i: F.struct(F.get("three_", i).alias("h"), i.alias("i")))))
    df = df.withColumn("same_", F.zip_with("sorted_", F.slice("sorted_", F.lit(2), far), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    df = df.withColumn("flag_", F.zip_with("same_", F.concat(F.array(F.lit(False)), F.slice("same_", F.lit(1), F.greatest(F.size("same_") - 1, F.lit(0)))), lambda a, b: a | b))
    starts = F.zip_with("flag_", "sorted_", lambda f, s: F.when(f, s["i"]))
    df = df.withColumn("starts_", F.sort_array(F.filter(starts, lambda x: x.isNotNull())))
    covered = F.aggregate(F.zip_with("starts_", F.slice("starts_", F.lit(2), far), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("three_", "packed_", "near_", "sorted_", "same_", "flag_", "starts_")


class References:
    """For each language its name, class shares and the shares of the listed words, the last of these for all others."""

    def __init__(self, names: list[str], listed: list[str], rows: list[tuple[list[float], list[float]]]):
        self.names, self.listed, self.rows = names, listed, rows


def references(docs: DataFrame, common: int = 12, least_documents: int = 20) -> References:
    """Counted over all documents (lang, text); one row a language and task is shuffled for classes, one a language, word and task for words."""
    lang = F.coalesce(F.col("lang"), F.lit("")).alias("lang")
    each_class = [F.col("classes")[i].alias(f"c{i}") for i in range(ALL_CLASSES)]
    sums = class_counts(docs.select(lang, "text")).select("lang", *each_class).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(ALL_CLASSES)])
    chars = sum((F.col(f"c{i}") for i in range(1, ALL_CLASSES)), F.col("c0"))
    chosen = sums.withColumn("chars", chars).where((F.col("chars") > 0) & (F.col("n") >= least_documents)).orderBy("lang").collect()
    if not chosen:
        return References([], [], [])
    names = [r["lang"] for r in chosen]
    each = docs.where(F.col("text").isNotNull()).select(lang, F.explode(F.split(F.lower("text"), SPLIT)).alias("w")).where(F.col("w") != "")
    counted = stash(each.where(F.col("lang").isin(names)).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "w")
    listed = sorted({r["w"] for r in counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= common).select("w").collect()})
    total = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    count = {(r["lang"], r["w"]): r["n"] for r in counted.where(F.col("w").isin(listed)).collect()}
    discard(counted)
    rows = []
    for r in chosen:
        shares = [count.get((r["lang"], w), 0) / max(1, total.get(r["lang"], 0)) for w in listed]
        rows.append(([r[f"c{i}"] / r["chars"] for i in range(ALL_CLASSES)], [*shares, max(0.0, 1 - sum(shares))]))
    return References(names, listed, rows)


def divergence(counts: Column, n: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of counts / n from a reference; both sum to 1."""

    def term(x: Column, q: Column) -> Column:
        p = x / n
        m = (p + q) / 2
        half = lambda v: F.when(v > 0, v * F.log(v / m)).otherwise(0.0)
        return (half(p) + half(q)) / (2 * math.log(2))

    terms = F.zip_with(counts, F.array(*[F.lit(float(v)) for v in reference]), term)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def judge(docs: DataFrame, refs: References, char_limit: float = 0.29, word_limit: float = 0.36, min_chars: int = 200, min_words: int = 60) -> DataFrame:
    """docs (doc_id, text, lang) with the base figures, char_distance, word_distance and the verdicts."""
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    df = class_counts(docs.select("doc_id", "text", lang.isin(refs.names).alias("judged_")))
    # Texts and words are read here; what follows has only what is made of them, so rows stay short.
    common = F.filter(F.split(F.lower("text"), SPLIT), lambda w: w.isin(refs.listed)) if refs.rows else F.lit(None).cast("array<string>")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"words_": words(F.col("text")), "lines_": lines, "common_": F.coalesce(common, F.array().cast("array<string>"))})
    df = df.withColumn("n_words", F.size("words_").cast("long"))
    df = df.withColumn("word_chars", (F.col("n_chars_") - F.col("classes")[CLASSES.index(BLANKS)]).cast("long"))
    df = df.withColumn("n_symbols", F.col("classes")[CLASSES.index(SYMBOLS)].cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"))
    df = repeated_words(df)
    figures = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    if refs.rows:
        df = df.withColumn("joined_", F.concat(F.lit(" "), F.array_join("common_", "  "), F.lit(" ")))
        whole = F.length("joined_")
        counts = [((whole - F.length(F.replace(F.col("joined_"), F.lit(f" {w} "), F.lit("")))) / len(f" {w} ")) for w in refs.listed]
        df = df.withColumn("counts_", F.array(*counts, (F.col("n_words") - F.size("common_")).cast("double")))
        chars = F.transform("classes", lambda x: x.cast("double"))
        df = df.withColumn("char_distance", F.when(F.col("judged_") & (F.col("n_chars_") >= min_chars), nearest([divergence(chars, F.col("n_chars_"), c) for c, _ in refs.rows])))
        df = df.withColumn("word_distance", F.when(F.col("judged_") & (F.col("n_words") >= min_words), nearest([divergence(F.col("counts_"), F.col("n_words"), w) for _, w in refs.rows])))
    else:
        df = df.withColumn("char_distance", F.lit(None).cast("double")).withColumn("word_distance", F.lit(None).cast("double"))
    bad = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = F.coalesce(F.col("char_distance") > char_limit, F.lit(False)) | F.coalesce(F.col("word_distance") > word_limit, F.lit(False))
    return df.select(*figures, bad.alias("base_failed"), "char_distance", "word_distance", (~bad & ~far).alias("kept"))


def nearest(distances: list[Column]) -> Column:
    return F.least(*distances) if len(distances) > 1 else distances[0]


def query(spark, sf_dir):
    """op7: base figures and verdicts of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return judge(docs, references(docs)).drop("char_distance", "word_distance")


#: The same by plain SQL, with the defaults of judge() and references().
ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS lang, text, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (
  SELECT *, length(t) AS n, [length(regexp_replace(t, '[^a-z]', '', 'g')), length(regexp_replace(t, '[^A-Z]', '', 'g')), length(regexp_replace(t, '[^0-9]', '', 'g')),
    length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')), length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')), length(regexp_replace(t, '[^.,;:!?''"()-]', '', 'g'))] AS six,
    regexp_replace(t, '[a-zA-Z0-9\x20\x09-\x0D#*$%&|<>.,;:!?''"()-]', '', 'g') AS l0 FROM w),
c1 AS (SELECT *, regexp_replace(l0, '\p{Latin}', '', 'g') AS l1 FROM c),
c2 AS (SELECT *, regexp_replace(l1, '\p{Cyrillic}', '', 'g') AS l2 FROM c1),
c3 AS (SELECT *, regexp_replace(l2, '\p{Greek}', '', 'g') AS l3 FROM c2),
c4 AS (SELECT *, regexp_replace(l3, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]', '', 'g') AS l4 FROM c3),
c5 AS (SELECT *, regexp_replace(l4, '\p{L}', '', 'g') AS l5 FROM c4),
c6 AS (SELECT *, regexp_replace(l5, '[\p{M}\p{N}]', '', 'g') AS l6 FROM c5),
d AS (SELECT *, list_concat(six, [length(l0) - length(l1), length(l1) - length(l2), length(l2) - length(l3), length(l3) - length(l4), length(l4) - length(l5), length(l5) - length(l6), length(l6)]) AS classes FROM c6),
langs AS (SELECT lang FROM d GROUP BY lang HAVING sum(n) > 0 AND count(*) >= 20),
judged AS (SELECT doc_id FROM d WHERE lang IN (SELECT lang FROM langs)),
ref_chars AS (SELECT lang, i, sum(classes[i])::DOUBLE / sum(n)::DOUBLE AS q FROM d, range(1, 14) r(i) WHERE lang IN (SELECT lang FROM langs) GROUP BY lang, i),
js_chars AS (
  SELECT doc_id, lang, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / (2 * ln(2)), 0)) AS js
  FROM (SELECT d.doc_id, r.lang, d.classes[r.i] / d.n::DOUBLE AS p, r.q FROM d, ref_chars r WHERE d.n >= 200) GROUP BY doc_id, lang),
far_chars AS (SELECT doc_id FROM js_chars WHERE doc_id IN (SELECT doc_id FROM judged) GROUP BY doc_id HAVING min(js) > 0.29),
short AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+')) AS x FROM w),
counted AS (SELECT lang, x, count(*) AS n FROM short WHERE lang IN (SELECT lang FROM langs) GROUP BY lang, x),
top AS (SELECT DISTINCT x FROM (SELECT x, row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) AS r FROM counted WHERE x <> '') WHERE r <= 12),
total AS (SELECT lang, sum(n)::DOUBLE AS n FROM counted GROUP BY lang),
listed AS (SELECT t.lang, top.x, coalesce(c.n, 0) / t.n AS q FROM total t CROSS JOIN top LEFT JOIN counted c ON c.lang = t.lang AND c.x = top.x),
ref_words AS (SELECT * FROM listed UNION ALL SELECT lang, '', 1 - sum(q) FROM listed GROUP BY lang),
doc_listed AS (SELECT doc_id, x, count(*) AS n FROM short WHERE x IN (SELECT x FROM top) GROUP BY doc_id, x),
doc_words AS (
  SELECT w.doc_id, v.x, coalesce(n.n, 0) / len(w.w)::DOUBLE AS p FROM w CROSS JOIN top v LEFT JOIN doc_listed n ON n.doc_id = w.doc_id AND n.x = v.x WHERE len(w.w) >= 60
  UNION ALL SELECT w.doc_id, '', 1 - coalesce(s.n, 0) / len(w.w)::DOUBLE FROM w LEFT JOIN (SELECT doc_id, sum(n) AS n FROM doc_listed GROUP BY doc_id) s ON s.doc_id = w.doc_id WHERE len(w.w) >= 60),
js_words AS (
  SELECT doc_id, lang, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / (2 * ln(2)), 0)) AS js
  FROM doc_words JOIN ref_words USING (x) GROUP BY doc_id, lang),
far_words AS (SELECT doc_id FROM js_words WHERE doc_id IN (SELECT doc_id FROM judged) GROUP BY doc_id HAVING min(js) > 0.36),
wins AS (SELECT doc_id, s, [w[s], w[s + 1], w[s + 2]] AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM w WHERE len(w) > 2)),
twice AS (SELECT doc_id, v FROM wins GROUP BY doc_id, v HAVING count(*) > 1),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + 3)) AS p FROM wins JOIN twice USING (doc_id, v)) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (d.n - d.classes[4])::BIGINT AS word_chars, d.classes[5]::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN again ON again.doc_id = d.doc_id)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND doc_id NOT IN (SELECT doc_id FROM far_chars) AND doc_id NOT IN (SELECT doc_id FROM far_words) AS kept
FROM base
"""
