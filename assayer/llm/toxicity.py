"""Toxicity: a lexicon trie intersected with Levenshtein automata, scored in the context of every hit.

The lexicon is learned from a bounded sample of labelled texts: words, and stems with open endings, that toxic texts have and others
do not. A word is read once through the product of the trie and the automaton of the allowed edits; its states are sets of (trie node,
edits so far), made when first met and kept, so that most words leave the product after a few letters. Words of the lexicon may be
misspelled by one edit from five letters on, by two from nine on; stems match exactly. Around every hit a window of words decides
whether the term is quoted or reported, or addressed to somebody. A logistic regression over a few counts gives the score.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

STEMS = (4, 5, 6, 7, 8)
LEAST_TOXIC, LEAST_SHARE, MOST_TERMS = 5, 0.9, 2_000
WINDOW = 4
REMEMBERED = 400_000
#: Words that report speech, and words that address somebody.
REPORTING = frozenset("""word words term terms said says called calls calling quote quoted quotes means meaning spelled insult insults slur
 wort begriff sagte genannt bedeutet mot terme dit appelé signifie palabra término dijo llamado significa""".split())
ADDRESS = frozenset("you your you're youre u du dich dir dein ihr euch tu te toi ton vous votre tú ti usted eres".split())
_QUOTES = "\"'«»“”„‘’`"
_STRIP = _QUOTES + ".,;:!?()[]{}<>|*#$%&-_~/\\…¡¿"
FEATURES = ("exact", "stems", "fuzzy", "quoted", "addressed", "share")
PRIOR = (6.0, 6.0, 8.0, 0.0, 0.5, 0.0)
#: Share of a sample's texts that may have misspellings of a word without being toxic.
INNOCENT = 0.0003


@dataclass(frozen=True)
class Lexicon:
    """Closed words, stems with open endings, and the words that must be spelled right because misspellings of them are innocent words."""
    words: frozenset[str]
    stems: frozenset[str]
    rigid: frozenset[str] = frozenset()

    def edits(self, term: str) -> int:
        return 0 if term in self.rigid or len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Product of the lexicon trie and the Levenshtein automata of its words, made deterministic as it is used."""

    def __init__(self, lexicon: Lexicon):
        self.edits = lexicon.edits
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.spare: list[int] = [0]  # edits that some word below a node still allows
        for term in sorted(lexicon.words | lexicon.stems):
            node, path = 0, [0]
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.stem.append(None)
                    self.spare.append(0)
                node = self.children[node][letter]
                path.append(node)
            if term in lexicon.stems:
                self.stem[node] = term
            if term in lexicon.words:
                self.word[node] = term
                for x in path:
                    self.spare[x] = max(self.spare[x], lexicon.edits(term))
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[str, int] | None] = []
        self.stems: list[str | None] = []
        self.start = self._state(self._closed({(0, 0)}))
        self.known: dict[str, tuple[str, int, bool] | None] = {}

    def _closed(self, members: set) -> frozenset:
        """With letters of the term left out of the word."""
        todo = list(members)
        while todo:
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits < self.spare[child] and (child, edits + 1) not in members:
                    members.add((child, edits + 1))
                    todo.append((child, edits + 1))
        return frozenset(members)

    def _state(self, members: frozenset) -> int:
        if members not in self.states:
            self.states[members] = len(self.members)
            self.members.append(members)
            self.moves.append({})
            hits = [(e, self.word[n]) for n, e in members if self.word[n] is not None and e <= self.edits(self.word[n])]
            self.ends.append(min(hits)[::-1] if hits else None)
            self.stems.append(next((self.stem[n] for n, e in sorted(members) if e == 0 and self.stem[n] is not None), None))
        return self.states[members]

    def _move(self, state: int, letter: str) -> int:
        out = set()
        for node, edits in self.members[state]:
            child = self.children[node].get(letter)
            if child is not None:
                out.add((child, edits))
            if edits < self.spare[node]:
                out.add((node, edits + 1))  # a letter too many
            for other in self.children[node].values():
                if edits < self.spare[other]:
                    out.add((other, edits + 1))  # another letter
        # of one node the fewest edits are enough
        best: dict[int, int] = {}
        for node, edits in out:
            best[node] = min(edits, best.get(node, edits))
        target = self.moves[state][letter] = self._state(self._closed(set(best.items()))) if best else -1
        return target

    def match(self, word: str) -> tuple[str, int, bool] | None:
        """Term, edits and whether it is a stem; None for an innocent word. Exact words go before stems, stems before misspellings."""
        if word in self.known:
            return self.known[word]
        state, stem = self.start, None
        for letter in word:
            state = self.moves[state].get(letter) if letter in self.moves[state] else self._move(state, letter)
            if state < 0:
                break
            stem = stem or self.stems[state]
        end = self.ends[state] if state >= 0 else None
        found = (*end, False) if end and end[1] == 0 else (stem, 0, True) if stem else (*end, False) if end else None
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = found
        return found


def hits(text: str, automaton: Automaton) -> list[tuple[int, str, int, bool, bool, bool]]:
    """Place of the word, term, edits, stem, quoted, addressed for each hit."""
    raw = text.lower().split()
    match, known = automaton.match, automaton.known
    out = []
    for i, token in enumerate(raw):
        word = token.strip(_STRIP)
        found = known[word] if word in known else match(word)
        if found:
            near = [t.strip(_STRIP) for t in raw[max(0, i - WINDOW):i + WINDOW + 1]]
            marked = token[0] in _QUOTES and token.rstrip(".,;:!?")[-1] in _QUOTES
            opened = not marked and _between_quotes(raw, i)
            out.append((i, *found, marked or opened or any(w in REPORTING for w in near), any(w in ADDRESS for w in near)))
    return out


def _between_quotes(raw: list[str], i: int) -> bool:
    """Whether a quotation opens in the window before the word and closes in the one after it."""
    before = any(t[0] in _QUOTES for t in raw[max(0, i - WINDOW):i + 1])
    return before and any(t.rstrip(".,;:!?")[-1:] in set(_QUOTES) for t in raw[i:i + WINDOW + 1])


def measure(text: str, automaton: Automaton) -> list[float]:
    """Values of ``FEATURES``: logs of counts, and the share of words that are hits."""
    found = hits(text, automaton)
    if not found:
        return [0.0] * len(FEATURES)
    plain = [h for h in found if not h[4]]
    exact = sum(h[2] == 0 and not h[3] for h in plain)
    stems = sum(h[3] for h in plain)
    counts = (exact, stems, len(plain) - exact - stems, len(found) - len(plain), sum(h[5] for h in plain))
    return [math.log1p(c) for c in counts] + [len(plain) / (1 + text.count(" "))]


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms of a bounded sample ``id, text, label`` that mark label 1.

    A term needs five toxic texts and nine tenths of all its texts toxic. From a stem the longest extension that keeps 95 % of its toxic
    texts is taken, so that closed words stay words. Counts are aggregated in the tasks before they are shuffled; at most 2,000 terms
    come back, those with the most toxic texts.
    """
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("toxic", T.LongType()), T.StructField("other", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {t.strip(_STRIP) for t in text.lower().split()}
                terms = {w + "$" for w in words if w} | {w[:k] for w in words for k in STEMS if len(w) >= k}
                counts[label < 0.5].update(terms)
            both = sorted(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([counts[0][t] for t in both], pa.int64()),
                                              pa.array([counts[1][t] for t in both], pa.int64())], schema.names)

    counted = sample.select("text", "label").mapInArrow(run, schema).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    rows = counted.filter((F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("other")))) \
        .orderBy(F.desc("toxic"), "term").limit(MOST_TERMS).collect()
    toxic = {r["term"]: r["toxic"] for r in rows}
    words, stems = set(), set()
    for term, n in toxic.items():
        if term.endswith("$"):
            stem = term[:-1]
            # a word below a chosen stem is found by the stem
            if not any(toxic.get(stem[:k], 0) * 0.95 > n for k in STEMS if k <= len(stem)):
                words.add(stem)
            continue
        shorter = any(toxic.get(term[:k], 0) >= n for k in STEMS if k < len(term) and toxic.get(term[:k], 0) * 0.95 > n)
        longer = any(t != term and t.startswith(term) and m >= 0.95 * n for t, m in toxic.items())
        if not shorter and not longer:
            stems.add(term)
    return Lexicon(frozenset(words), frozenset(stems))


def stiffen(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    """The lexicon with those words made rigid whose misspellings stand in more than a few of the texts without the label."""
    def misspelled(text: str, automaton: Automaton) -> list[str]:
        return sorted({h[1] for h in hits(text, automaton) if h[2]})

    found = _map_texts(sample.select("text", "label"), lexicon, misspelled, T.ArrayType(T.StringType()), "terms")
    other = found.filter(F.col("label") < 0.5)
    limit = 1 + INNOCENT * sample.count()
    rigid = other.select(F.explode("terms").alias("term")).groupBy("term").count().filter(F.col("count") > limit).collect()
    return Lexicon(lexicon.words, lexicon.stems, frozenset(r["term"] for r in rigid))


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    intercept: float
    weights: tuple[float, ...]

    def probability(self, values: list[float]) -> float:
        total = self.intercept + sum(w * v for w, v in zip(self.weights, values))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, total))))


def _map_texts(df: DataFrame, lexicon: Lexicon, row, kind: T.DataType, name: str) -> DataFrame:
    """One value per row from ``row(text, automaton)``; the other columns of ``df`` go along."""
    schema = T.StructType([f for f in df.schema.fields if f.name != "text"] + [T.StructField(name, kind)])
    from pyspark.sql.pandas.types import to_arrow_type
    place, arrow = df.columns.index("text"), to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(lexicon)
        for batch in batches:
            values = [row(v.as_py() or "", automaton) for v in batch.column(place)]
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != place] + [pa.array(values, arrow)], schema.names)

    return df.mapInArrow(run, schema)


def fit(sample: DataFrame) -> Model:
    """Model from a bounded sample ``id, text, label``; its few numbers per row are fitted on the driver.

    Without two classes in the sample the score is constant: one half without rows, otherwise near the one label.
    """
    sample = materialise(sample, "toxicity")
    lexicon = stiffen(sample, learn_lexicon(sample))
    rows = _map_texts(sample.select("text", "label"), lexicon, measure, T.ArrayType(T.DoubleType()), "x").collect()
    if not rows:
        return Model(lexicon, 0.0, (0.0,) * len(FEATURES))
    x = np.array([r["x"] for r in rows])
    y = np.array([r["label"] >= 0.5 for r in rows], dtype=float)
    order = np.lexsort((*x.T, y))  # the fit does not depend on the order of arrival
    x, y = np.column_stack([np.ones(len(x)), x])[order], y[order]
    # a ridge around what the counts should say before any text is seen
    ridge, prior = np.diag([1e-6] + [0.3] * len(FEATURES)), np.array([0.0, *PRIOR])
    w = prior.copy()
    for _ in range(30):  # Newton steps with a little ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ (w - prior))
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    w = np.clip(w, -30, 30)
    return Model(lexicon, float(w[0]), tuple(float(v) for v in w[1:]))


def score(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """``id_col, score`` for every row: the probability of label 1. Null and empty texts score as texts without a hit.

    Repeated rows stay, other columns are not read. The lexicon that goes to every task has at most 2,000 terms.
    """
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return _map_texts(source, model.lexicon, lambda text, a: model.probability(measure(text, a)), T.DoubleType(), "score") \
        .withColumnRenamed("id", id_col)


def find(df: DataFrame, id_col: str, text_col: str, lexicon: Lexicon) -> DataFrame:
    """``id_col, hits``: place of the word, term, edits, stem, quoted, addressed for every hit of every row."""
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("term", T.StringType()),
                                     T.StructField("edits", T.IntegerType()), T.StructField("stem", T.BooleanType()),
                                     T.StructField("quoted", T.BooleanType()), T.StructField("addressed", T.BooleanType())]))
    names = [f.name for f in kind.elementType.fields]
    return _map_texts(source, lexicon, lambda text, a: [dict(zip(names, h)) for h in hits(text, a)], kind, "hits").withColumnRenamed("id", id_col)
