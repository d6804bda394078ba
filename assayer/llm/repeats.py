"""Removal of passages that stand in the corpus before: suffix automata of reference shards and matching statistics.

A window is ``window`` consecutive words of a text. The reference is every place of the corpus whose window may stand elsewhere, and it is
cut into shards by content: a window belongs to the shard of its anchor, the smallest hash of the runs of six words inside it. Equal
windows have equal anchors, so whatever repeats meets in one shard, and an anchor that the corpus has once needs no look. Neighbouring
windows with one anchor travel as one stretch of text, and a stretch that many documents share travels once.

A shard's stretches, in the order of documents, make up a generalised suffix automaton whose states remember where their words first
ended. Stretches are then streamed through it: of the longest match that ends at a word the statistics keep the last ``window`` words, and
a window whose state was first reached elsewhere is a repeat. Words of repeated windows are removed; overlapping windows make one span.

Automata are built where their shard's stretches are, not sent to all tasks: a corpus-wide reference grows with the corpus, and every
broadcast shard would be one more pass over all documents. An anchor with very many different stretches is split by whole windows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .words import NOT_SPACE, find_words, flat, groups, hash_words, mix

#: Words of an anchor; bytes and words that are looked at together.
ANCHOR, TOGETHER, STEP = 6, 1 << 20, 1 << 20
#: Different stretches of an anchor beyond which they are split by windows.
HOT = 2_000
#: Repeated anchors that still go to every task (8 bytes each); beyond it texts meet their anchors in a shuffle.
MOST_SENT = 4_000_000
#: Hot anchors that are still broadcast (8 bytes each).
MOST_HOT = 1_000_000
#: Words of an automaton.
SHARD = 20_000

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """Generalised suffix automaton; ``first`` of a state is the earliest (text, place of its last word) that was added."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [(-1, -1)]

    def _state(self, length: int, first: tuple[int, int], edges: dict, link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.length) - 1

    def _split(self, p: int, word, q: int) -> int:
        """A copy of state ``q`` for its words up to those that ``p`` and ``word`` spell."""
        copy = self._state(self.length[p] + 1, self.first[q], dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, text: int, words: list) -> None:
        """Texts have to be added in their order."""
        last, length = 0, self.length
        for at, word in enumerate(words):
            q = self.next[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
                continue
            state = self._state(length[last] + 1, (text, at), {}, 0)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[state] = q if length[q] == length[p] + 1 else self._split(p, word, q)
            last = state

    def match(self, words: list, window: int) -> Iterator[tuple[int, int, tuple[int, int]]]:
        """Matching statistics: for each word its place, the length of the longest match that ends there, at most ``window``, and where
        that match first ended."""
        state = matched = 0
        for at, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched = min(matched + 1, window)
                while self.length[self.link[state]] >= matched:
                    state = self.link[state]
            yield at, matched, self.first[state]


def stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of neighbouring windows with one anchor: first and last window (by their first word) and the anchor's hash.

    Windows with fewer words than an anchor are their own anchor.
    """
    size = min(ANCHOR, window)
    span = window - size + 1
    for lo in range(0, len(starts), STEP):
        part = slice(lo, min(len(starts), lo + STEP + window - 1))
        hashes = hash_words(data, starts[part], ends[part])
        n = len(hashes) - window + 1
        if n <= 0:
            continue
        low = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
        for i in range(size):
            low = low * _MULTIPLY + hashes[i:i + len(low)]
        low, at, width = mix(low), np.arange(len(low)), 1
        while width < span:  # the first smallest hash among the next ``width`` ones
            ahead = min(width, span - width)
            left, right = low[:len(low) - ahead], low[ahead:]
            at = np.where(left <= right, at[:len(left)], at[ahead:])
            low = np.minimum(left, right)
            width += ahead
        of = text[part]
        whole = of[:n] == of[window - 1:]
        begins = whole.copy()
        begins[1:] &= ~whole[:-1] | (at[1:n] != at[:n - 1])
        ended = whole.copy()
        ended[:-1] &= ~whole[1:] | (at[1:n] != at[:n - 1])
        first, last = np.flatnonzero(begins), np.flatnonzero(ended)
        yield first + lo, last + lo, low[first]


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def anchor_counts(docs: DataFrame, window: int) -> DataFrame:
    """``anchor, n``: the places of every anchor in the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, dtype=np.uint64)]
            texts = _texts(batch.column(0))
            for a, b in groups([len(t) for t in texts], TOGETHER):
                data, offsets = flat(texts[a:b])
                if len(data):
                    found += [x[2] for x in stretches(data, *find_words(data, offsets, NOT_SPACE), window)]
            anchors, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(n)], ["anchor", "n"])

    return docs.select("text").mapInArrow(run, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, repeated: DataFrame, window: int, most_sent: int) -> DataFrame:
    """Stretches of repeated anchors: ``key, piece, content, id, row, at, n`` (n windows from word ``at`` on; words joined by a space)."""
    sent, source = None, docs
    if repeated.count() <= most_sent:
        sent = docs.sparkSession.sparkContext.broadcast(np.sort(repeated.toArrow()["anchor"].to_numpy().view(np.uint64)))
        source = docs.withColumn("anchors", F.lit(None).cast("array<bigint>"))
    else:
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = _texts(batch.column(1))
                for a, b in groups([len(t) for t in texts], TOGETHER):
                    data, offsets = flat(texts[a:b])
                    if not len(data):
                        continue
                    starts, ends, text = find_words(data, offsets, NOT_SPACE)
                    for first, _, anchor in stretches(data, starts, ends, text, window):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text[first] + a)), pa.array(anchor.view(np.int64))], ["row", "anchor"])

        mine = docs.select("row", "text").mapInArrow(own, "row bigint, anchor bigint").join(repeated, "anchor") \
            .groupBy("row").agg(F.collect_set("anchor").alias("anchors"))
        source = docs.join(mine, "row").select(*docs.columns, "anchors")

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("piece", T.BinaryType()), T.StructField("id", docs.schema["id"].dataType),
                           T.StructField("row", T.LongType()), T.StructField("at", T.LongType()), T.StructField("n", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column("text"))
            for a, b in groups([len(t) for t in texts], TOGETHER):
                data, offsets = flat(texts[a:b])
                if not len(data):
                    continue
                starts, ends, text = find_words(data, offsets, NOT_SPACE)
                keys = sent.value if sent is not None else np.unique(batch.column("anchors").slice(a, b - a).flatten().to_numpy().view(np.uint64))
                if not len(keys):
                    continue
                begins = np.searchsorted(text, np.arange(b - a + 1))
                for first, last, anchor in stretches(data, starts, ends, text, window):
                    known = keys[np.searchsorted(keys, anchor).clip(0, len(keys) - 1)] == anchor
                    first, last, anchor = first[known], last[known], anchor[known]
                    if not len(first):
                        continue
                    pieces = [b" ".join(data[s:e].tobytes().split()) for s, e in zip(starts[first].tolist(), ends[last + window - 1].tolist())]
                    of = text[first]
                    rows = pa.array(of + a)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor.view(np.int64)), pa.array(pieces, pa.binary()), batch.column("id").take(rows), batch.column("row").take(rows),
                         pa.array(first - begins[of]), pa.array((last - first + 1).astype(np.int32))], schema.names)

    return source.select("id", "row", "text", "anchors").mapInArrow(run, schema).withColumn("content", F.xxhash64("piece"))


def _distinct(places: DataFrame) -> DataFrame:
    """Different stretches of every key with their first place and the number of places."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row", "at")
    return places.groupBy("key", "piece", "content").agg(F.min(order).alias("o"), F.count("*").alias("times")) \
        .select("key", "piece", "content", "times", "o.*")


def _later(places: DataFrame, distinct: DataFrame) -> DataFrame:
    """``row, at, n``: all places of a stretch but its first; every window of them stands before."""
    first = distinct.filter("times > 1").select("key", "content", F.col("row").alias("row0"), F.col("at").alias("at0"))
    return places.select("key", "content", "row", "at", "n").join(first, ["key", "content"]) \
        .filter("row <> row0 or at <> at0").select("row", "at", "n")


def _split(distinct: DataFrame, window: int) -> DataFrame:
    """Stretches window by window, as places of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, at, pieces = [], [], []
            for i, (piece, begin) in enumerate(zip(batch.column("piece").to_pylist(), batch.column("at").to_pylist())):
                words = piece.split()
                for k in range(len(words) - window + 1):
                    line.append(i)
                    at.append(begin + k)
                    pieces.append(b" ".join(words[k:k + window]))
            lines = pa.array(line, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary()), batch.column("id").take(lines), batch.column("row").take(lines),
                                              pa.array(at, pa.int64())], ["piece", "id", "row", "at"])

    schema = T.StructType([distinct.schema[c] for c in ("piece", "id", "row", "at")])
    return distinct.select("piece", "id", "row", "at").mapInArrow(run, schema) \
        .withColumns({"n": F.lit(1), "key": F.xxhash64("piece"), "content": F.lit(0).cast("bigint")})


def _runs(flags: list[int]) -> list[tuple[int, int]]:
    """Neighbouring numbers as ranges."""
    out: list[list[int]] = []
    for i in flags:
        if out and out[-1][1] == i - 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return [tuple(x) for x in out]


def repeated_windows(pieces: list[bytes], window: int) -> list[list[tuple[int, int]]]:
    """For every piece of a shard, in their order, the ranges of windows that an earlier place has."""
    numbers: dict[bytes, int] = {}
    words = [[numbers.setdefault(w, len(numbers)) for w in p.split()] for p in pieces]
    automaton = Automaton()
    for i, w in enumerate(words):
        automaton.add(i, w)
    return [_runs([at - window + 1 for at, matched, first in automaton.match(w, window) if matched == window and first != (i, at)])
            for i, w in enumerate(words)]


def _searched(distinct: DataFrame, window: int) -> DataFrame:
    """``row, at, n``: ranges of windows at the first places of stretches that stand before in another stretch of the shard."""
    together = distinct.repartition("key").sortWithinPartitions("key")  # the stretches of an anchor are neighbours

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def search() -> pa.RecordBatch:
            held.sort(key=lambda x: (x["none"], 0 if x["none"] else x["id"], x["row"], x["at"]))
            found = [(x["row"], x["at"] + a, b - a + 1) for x, runs in zip(held, repeated_windows([x["piece"] for x in held], window)) for a, b in runs]
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                                               pa.array([f[2] for f in found], pa.int32())], ["row", "at", "n"])

        for batch in batches:
            for line in batch.to_pylist():
                if size > SHARD and line["key"] != held[-1]["key"]:
                    yield search()
                    held, size = [], 0
                held.append(line)
                size += line["piece"].count(b" ") + 1
        if held:
            yield search()

    return together.select("key", "piece", "none", "id", "row", "at").mapInArrow(run, "row bigint, at bigint, n int")


def repeats(docs: DataFrame, window: int, most_sent: int = MOST_SENT, hot: int = HOT, most_hot: int = MOST_HOT) -> DataFrame:
    """``row, ranges`` of the rows of ``id, row, text`` with something to remove; ``ranges`` holds (first window, windows), in no order."""
    repeated = materialise(anchor_counts(docs, window).filter("n > 1").select("anchor"), "anchors")
    places = materialise(_places(docs, repeated, window, most_sent), "places")
    distinct = materialise(_distinct(places), "stretches")
    heavy = materialise(distinct.groupBy("key").count().filter(F.col("count") > hot).select("key"), "hot")
    heavy = F.broadcast(heavy) if heavy.count() <= most_hot else heavy
    windows = _split(distinct.join(heavy, "key", "left_semi"), window)
    found = _later(places, distinct).unionByName(_searched(distinct.join(heavy, "key", "left_anti"), window)) \
        .unionByName(_later(windows, _distinct(windows)))
    return found.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("ranges"))


def remove(df: DataFrame, id_col: str, text_col: str, window: int = 20, stable: bool = False, most_sent: int = MOST_SENT, hot: int = HOT,
           most_hot: int = MOST_HOT) -> DataFrame:
    """``id_col, n_words, n_removed, spans, kept`` for every row: the text without repeated windows, its words joined by a space.

    Words are runs of anything but ASCII white space. A word goes if it lies in a window of ``window`` words whose sequence starts earlier
    in the corpus: in a row with a smaller id or, in one row, before. ``spans`` are the ranges of words that go (first, last; from 0).
    Rows without an id come last; rows of one id stand in the order of the table, so of equal rows one keeps its text. Null and empty
    texts have no words; texts shorter than a window stay whole; other columns are not read.
    ``stable`` says that ``df`` is read from files as it is, so that its rows can be numbered; otherwise it is written first.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    docs = (docs if stable else materialise(docs, "texts")).withColumn("row", F.monotonically_increasing_id())
    found = repeats(docs, window, most_sent, hot, most_hot)
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("spans", span), T.StructField("kept", T.StringType())])
    arrow_span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lines = []
                for text, ranges in zip(_texts(part.column(1)), part.column(2).to_pylist()):
                    words, covered = text.split(), []
                    for first, n in sorted((r["at"], r["n"]) for r in ranges or []):
                        last = first + n + window - 2
                        if covered and covered[-1][1] >= first - 1:
                            covered[-1][1] = max(last, covered[-1][1])
                        else:
                            covered.append([first, last])
                    total = len(words)
                    for first, last in reversed(covered):
                        del words[first:last + 1]
                    lines.append((total, total - len(words), [{"first": a, "last": b} for a, b in covered], b" ".join(words)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x[0] for x in lines], pa.int64()), pa.array([x[1] for x in lines], pa.int64()),
                     pa.array([x[2] for x in lines], arrow_span), pa.array([x[3] for x in lines], pa.binary()).cast(pa.string())], schema.names)

    return docs.join(found, "row", "left").select("id", "text", "ranges").mapInArrow(run, schema).withColumnRenamed("id", id_col)
