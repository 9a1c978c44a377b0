"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

Learning. A labelled sample gives the lexicon: whole words (written with a final "$") and
stems (beginnings of words) that occur much more often in toxic documents than in others, chosen
greedily until they cover the toxic documents that they can. The entries form a trie.

Matching. For each entry a Levenshtein automaton accepts the words within its error bound, which
grows with its length (`bounds`: one error from five letters on, two from nine). An error is a
letter changed, left out or put in, or two neighbours swapped. The product of these automata with
the trie is explored lazily: a state is a set of (trie node, errors so far, first letter of a swap under
way), transitions are kept, and the empty state ends a word's reading at once. So each distinct word costs
a few table look-ups. A token with signs between its letters (`i.d-iot`) is read once more without
them, as a misspelling.

Scoring. Each hit falls in a class: exact or misspelt, and abuse or quotation, the latter where
the window of `window` words to either side holds a quotation mark or a verb of reporting.
A logistic model over log counts of the four classes and the summed evidence of the entries, as
such and by the number of words, is fitted on the sample and scores every whole text.

Bounds: at most `max_train` labelled rows (default 3,000, at most half of them per label), entries of
`stems` letters (default 4 to 10) or whole words, `max_entries` entries and `max_states` kept automaton
states; a word's uses count up to `most_uses` in a document when entries are learnt. The rest covers all rows.

Defined cases: null and empty texts are scored as a document without hits; without labelled
rows of both labels every score is 0.5; an empty table gives no rows. Several labels of one id count as the
largest; of several texts of one labelled id one is learnt from. Among entries of equal worth the longer and
then the later in the alphabet is taken; among equal matches of a word the fewest errors, then the first
in the automaton's reading. Repeated rows get equal scores. Texts are read whole, whatever their length;
a task keeps at most `CACHE_ENTRIES` words. A column named score is replaced, others are passed on.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import labelled, map_columns, remainder, table

#: Fixed lists: verbs of reporting and quotation marks that mark a quoted term.
REPORTING = frozenset(
    "said says say wrote writes called calls quote quoted quotes word term sagte sagt schrieb nannte zitat wort "
    "dit disait écrit appelé cite mot terme dijo dice escribió llamó cita palabra término".split()
)
QUOTES = frozenset("\"“”„«»‹›'‘’")
STEM_LETTERS = range(4, 11)
CACHE_ENTRIES = 500_000
_WORD = re.compile(r"[^\W_]+")
FEATURES = 9


def prefixes(word: str, stems: range = STEM_LETTERS) -> list[str]:
    """The entries that would match word exactly: its stems, and itself as a whole word."""
    return [word[:n] for n in stems if n <= len(word)] + ([word + "$"] if len(word) > 2 else [])


def occurrences(words: Counter, stems: range, most_uses: int) -> Counter:
    """How often a document has each entry, up to most_uses."""
    out: Counter = Counter()
    for w, k in words.items():
        for p in prefixes(w, stems):
            out[p] = min(out[p] + k, most_uses)
    return out


def learn_lexicon(documents: list[tuple[Counter, int]], max_entries: int = 200, least: int = 3, least_odds: float = 8.0, cover: int = 5, stems: range = STEM_LETTERS, most_uses: int = 8) -> dict[str, float]:
    """Entries with their log odds, from (counts of words, label) of each document.

    An entry's odds compare its occurrences a document in toxic and in other documents. Of
    those with odds of at least `least_odds`, the one that covers most toxic documents not yet
    covered `cover` times is taken, again and again; one that a taken entry begins, or that begins a
    taken one, adds nothing new and is passed over.
    """
    used, n = [Counter(), Counter()], [0, 0]
    for words, y in documents:
        n[y] += 1
        used[y].update(occurrences(words, stems, most_uses))
    if not n[1]:
        return {}
    odds = {p: ((k + 0.5) / n[1]) / ((used[0][p] + 0.5) / max(1, n[0])) for p, k in used[1].items() if k >= least}
    odds = {p: o for p, o in odds.items() if o >= least_odds}
    holders: dict[str, list[int]] = {p: [] for p in odds}
    for i, (words, y) in enumerate(documents):
        if y:
            for p in occurrences(words, stems, most_uses):
                if p in holders:
                    holders[p].append(i)
    holders = {p: held for p, held in holders.items() if len(held) >= least}
    odds = {p: odds[p] for p in holders}
    entries_of: dict[int, list[str]] = {}
    for p in odds:
        for i in holders[p]:
            entries_of.setdefault(i, []).append(p)
    open_holders = {p: len(holders[p]) for p in odds}
    covered: Counter = Counter()
    lexicon: dict[str, float] = {}
    while open_holders and len(lexicon) < max_entries:
        best = max(open_holders, key=lambda p: (open_holders[p] * (1 - 2 / (2 + odds[p])), len(p), p))
        if open_holders.pop(best) < least:
            break
        stem = best.rstrip("$")
        if any(t.rstrip("$").startswith(stem) or stem.startswith(t.rstrip("$")) for t in lexicon):
            continue
        lexicon[best] = math.log(odds[best])
        for i in holders[best]:
            covered[i] += 1
            if covered[i] == cover:  # several each, so that a misspelt term does not hide a document
                for p in entries_of[i]:
                    if p in open_holders:
                        open_holders[p] -= 1
    return lexicon


#: (letters, errors): entries from so many letters on are matched with so many errors.
BOUNDS = ((5, 1), (9, 2))


class Automaton:
    """The lazily built product of the entries' Levenshtein automata and their trie."""

    def __init__(self, lexicon: dict[str, float], max_states: int = 200_000, bounds: tuple[tuple[int, int], ...] = BOUNDS):
        self.max_states = max_states
        self.children: list[dict[str, int]] = [{}]
        self.stem: list[tuple[float, int] | None] = [None]  # evidence and error bound at a stem's last node
        self.whole: list[tuple[float, int] | None] = [None]
        self.reach = [0]  # the largest error bound below a node
        for entry, weight in lexicon.items():
            term = entry.rstrip("$")
            node, bound = 0, max([0, *(errors for letters, errors in bounds if len(term) >= letters)])
            self.reach[0] = max(self.reach[0], bound)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.stem.append(None)
                    self.whole.append(None)
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], bound)
            (self.whole if entry.endswith("$") else self.stem)[node] = (weight, bound)
        self.reset()

    def reset(self) -> None:
        self.start = self.close({(0, ""): 0})
        self.step: dict[tuple[frozenset, str], frozenset] = {}

    def close(self, states: dict[tuple[int, str], int]) -> frozenset:
        """With the nodes reached by letters that the word leaves out; the fewest errors for each."""
        todo = [n for n, swap in states if not swap]
        while todo:
            node = todo.pop()
            errors = states[node, ""] + 1
            for child in self.children[node].values():
                if errors <= self.reach[child] and errors < states.get((child, ""), errors + 1):
                    states[child, ""] = errors
                    todo.append(child)
        return frozenset((node, errors, swap) for (node, swap), errors in states.items())

    def read(self, state: frozenset, c: str) -> frozenset:
        out: dict[tuple[int, str], int] = {}

        def add(node: int, errors: int, swap: str = "") -> None:
            if errors <= self.reach[node] and errors < out.get((node, swap), errors + 1):
                out[node, swap] = errors

        for node, errors, swap in state:
            if swap:  # the entry's next letter was read before this one
                if swap == c:
                    add(node, errors)
                continue
            add(node, errors + 1)
            for letter, child in self.children[node].items():
                add(child, errors + (letter != c))
                if letter != c and c in self.children[child]:
                    add(self.children[child][c], errors + 1, letter)
        return self.close(out) if out else frozenset()

    def match(self, word: str) -> tuple[float, int]:
        """The evidence of the best entry for word and its errors; (0, 0) for none."""
        state, found = self.start, (0.0, 0)
        for c in word:
            key = (state, c)
            nxt = self.step.get(key)
            if nxt is None:
                if len(self.step) >= self.max_states:
                    self.reset()
                self.step[key] = nxt = self.read(state, c)
            state = nxt
            if not state:
                return found
            for node, errors, swap in state:
                hit = self.stem[node]
                if hit and not swap and errors <= hit[1] and (not found[0] or (errors, -hit[0]) < (found[1], -found[0])):
                    found = (hit[0], errors)
        for node, errors, swap in state:
            hit = self.whole[node]
            if hit and not swap and errors <= hit[1] and (not found[0] or (errors, -hit[0]) < (found[1], -found[0])):
                found = (hit[0], errors)
        return found


class Matches(dict):
    """Token -> None, or evidence and errors of its best word."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, token: str):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        best = None
        words = _WORD.findall(token.lower())
        for word in [*words, "".join(words)] if len(words) > 1 else words:
            weight, errors = self.automaton.match(word)
            if word not in words:
                errors = max(errors, 1)
            if weight and (best is None or (errors, -weight) < (best[1], -best[0])):
                best = (weight, errors)
        self[token] = best
        return best


def features(text: str | None, matches: Matches, window: int) -> list[float]:
    """Log counts of hits (exact abuse, exact quotation, misspelt abuse, misspelt quotation), the evidence of the exact and of the misspelt hits, and the latter three as shares of the words."""
    tokens = text.split() if text else []
    found = list(map(matches.__getitem__, tokens))
    out, evidence = [0, 0, 0, 0], [0.0, 0.0]
    if any(found):
        for i, hit in enumerate(found):
            if hit:
                around = tokens[max(0, i - window) : i + window + 1]
                quoted = any(t[0] in QUOTES or t[-1] in QUOTES or t.lower().strip(".,:;") in REPORTING for t in around)
                misspelt = hit[1] > 0
                out[2 * misspelt + quoted] += 1
                evidence[misspelt] += hit[0] * (0.5 if quoted else 1.0)
    per_word = 100 / max(20, len(tokens))
    return [math.log1p(x) for x in (*out, *evidence, per_word * evidence[0], per_word * evidence[1], per_word * (out[1] + out[3]))]


class Model:
    def __init__(self, lexicon: dict[str, float], weights: np.ndarray, window: int, bounds: tuple[tuple[int, int], ...] = BOUNDS):
        self.lexicon, self.weights, self.window, self.bounds = lexicon, weights, window, bounds


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", max_train: int = 3000, window: int = 6, max_entries: int = 200, stems: range = STEM_LETTERS, most_uses: int = 8, bounds: tuple[tuple[int, int], ...] = BOUNDS) -> Model:
    """Fit on at most max_train of the labelled rows for which learn holds, in the order of a hash of doc_id."""
    drawn = labelled(docs, labels, label, learn, max_train, (0, 1)).collect()
    rows = [(Counter(_WORD.findall(r["text"].lower())), r["text"], r["y"]) for r in sorted(drawn, key=lambda r: (r["h"], r["doc_id"]))]
    if len({y for *_, y in rows}) < 2:
        return Model({}, np.zeros(FEATURES + 1), window, bounds)
    learnt = lambda part: learn_lexicon([(words, y) for words, _, y in part], max_entries, stems=stems, most_uses=most_uses)
    lexicon = learnt(rows)
    # Entries that only chance puts into the lexicon should not look better than they are: score held-back halves.
    x, y = [], []
    for half in (0, 1):
        matches = Matches(Automaton(learnt(rows[1 - half :: 2]), bounds=bounds))
        for _, t, c in rows[half::2]:
            x.append(features(t, matches, window))
            y.append(c)
    return Model(lexicon, logistic(np.array(x), np.array(y, float)), window, bounds)


def score(docs: DataFrame, model: Model, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with score, the model's probability that text is toxic."""
    at, lexicon, weights, window, bounds = docs.columns.index(text), model.lexicon, model.weights, model.window, model.bounds

    def make():
        matches = Matches(Automaton(lexicon, bounds=bounds))

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            x = np.array([features(t.as_py(), matches, window) for t in batch.column(at)], float).reshape(-1, FEATURES)
            z = np.clip(x @ weights[:-1] + weights[-1], -30, 30)
            return [pa.array(1 / (1 + np.exp(-z)), pa.float64())]

        return work

    return map_columns(docs, make, [T.StructField("score", T.DoubleType())], drop=drop)


def query(spark, sf_dir):
    """op4: toxicity of every whole text, learnt from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    scored = score(docs, model, drop=("text",))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
