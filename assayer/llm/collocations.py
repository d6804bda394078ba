"""Collocations by set-oriented mining: relations of occurrences, sorted by piece and place, that grow by one word a round.

The relation of round k holds every occurrence of a frequent phrase of k words: its place, the number of its first word and the number of
the phrase. A round joins it with the relation of single words on piece and adjacent place, which is a merge of two sorted columns, and
counts the groups that come out; phrases that are frequent get a number, and a semi-join with them leaves the next relation, which is
written to the shared folder. Only words that some frequent phrase still covers go on: all parts of a frequent phrase are frequent.

A relation has one row for a run of pieces, with the occurrences as arrays, so a round shuffles partial counts only. Numbers of phrases go
to every task while they are few; otherwise occurrences meet them in a shuffle.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .words import LOWER, find_words, flat, groups, hash_words

#: Bytes of text that are cut into words at once, words of a row of a relation, and keys that are counted at once.
TOGETHER, RUN, COUNTED = 1 << 20, 250, 1_000_000
#: Frequent phrases of a round that still go to every task (12 bytes each; words with their letters).
MOST_SENT = 2_000_000
#: Numbers of phrases have 31 bits.
MOST_PHRASES = (1 << 31) - 1

_ENDS = np.zeros(256, dtype=bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_ENDS
_INSIDE[[0x20, 0x09]] = False

_RELATION = T.StructType([T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("step", "word", "phrase")])


def _cut(text: bytes) -> Iterator[bytes]:
    """Parts of a long text that end with a piece."""
    first = 0
    while len(text) - first > TOGETHER:
        ends = np.flatnonzero(_ENDS[np.frombuffer(text, dtype=np.uint8, count=TOGETHER, offset=first)])
        if len(ends):
            last = first + int(ends[-1]) + 1
        else:  # one long piece: it ends at the next sign
            last = first + TOGETHER
            while last < len(text) and not _ENDS[text[last]]:
                last += 1
        yield text[first:last]
        first = last
    yield text[first:]


def _small(batches: Iterator[pa.RecordBatch], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """Words and places of the texts of a batch, by language; places of neighbouring words of one piece differ by one, others by more."""
    parts: list[tuple[str, bytes]] = []
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
        if text.is_valid:
            text = text.as_buffer().to_pybytes()
            parts += [(lang, t) for t in ([text] if len(text) <= TOGETHER else _cut(text))]
    parts.sort(key=lambda p: p[0])
    for first, last in groups([len(t) for _, t in parts], TOGETHER):
        langs = [lang for lang, _ in parts[first:last]]
        data, offsets = flat([t for _, t in parts[first:last]])
        if not len(data):
            continue
        data = LOWER[data]
        starts, ends, text = find_words(data, offsets, _INSIDE)
        if not len(starts):
            continue
        passed = np.concatenate([[0], np.cumsum(_ENDS[data])])
        joined = np.concatenate([[False], (text[1:] == text[:-1]) & (passed[starts[1:]] == passed[ends[:-1]])])
        place = np.cumsum(np.where(joined, 1, 2))
        bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[_INSIDE[data]]))
        for lang in dict.fromkeys(langs):
            a, b = langs.index(lang), len(langs) - langs[::-1].index(lang)
            lo, hi = np.searchsorted(text, [a, b])
            if hi > lo:
                yield lang, words.slice(lo, hi - lo), place[lo:hi]


def _keyed(words: pa.Array, lang: str) -> pa.Array:
    """A word with its language; words hold no space."""
    return pc.binary_join_element_wise(words, lang, " ")


def _texts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """``key, n`` of every word (with its language after a space); the key of a language alone holds the number of all its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            tables = []
            for lang, words, _ in _pieces(batch):
                coded = words.dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                tables.append(pa.table({"key": _keyed(coded.dictionary, lang), "n": n}))
                tables.append(pa.table({"key": pa.array([" " + lang]), "n": np.array([len(words)])}))
            if tables:
                yield from pa.concat_tables(tables).group_by("key", use_threads=False).aggregate([("n", "sum")]).rename_columns(["key", "n"]) \
                    .cast(pa.schema([("key", pa.string()), ("n", pa.int64())])).to_batches()

    return texts.mapInArrow(run, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows, written, with numbers from 0 on without gaps; fails where 31 bits do not hold them."""
    rows = materialise(df, name).withColumn("__at", F.monotonically_increasing_id())
    sizes = rows.groupBy(F.shiftright("__at", 33).alias("p")).count().orderBy("p").collect()  # a row for each part of the table
    if sum(r["count"] for r in sizes) > MOST_PHRASES:
        raise ValueError("more frequent phrases than 31 bits number")
    before, total = [0] * (sizes[-1]["p"] + 1 if sizes else 1), 0
    for r in sizes:
        before[r["p"]], total = total, total + r["count"]
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    base = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), (F.shiftright("__at", 33) + 1).cast("int"))
    return materialise(rows.withColumn("id", (within + base).cast("int")).drop("__at"), name)


class _Words:
    """Numbers of frequent words, looked up for the distinct words of a batch: by a hash, then compared."""

    def __init__(self, keys: pa.Array, ids: np.ndarray):
        hashes = self._hash(keys)
        order = np.argsort(hashes)
        self.keys, self.ids, self.hashes = keys.take(pa.array(order)), ids[order], hashes[order]
        twin = np.zeros(len(order) + 1, dtype=bool)
        twin[1:-1] = self.hashes[1:] == self.hashes[:-1]
        self.twins = {self.keys[i].as_py(): int(self.ids[i]) for i in np.flatnonzero(twin[1:] | twin[:-1])}

    @staticmethod
    def _hash(keys: pa.Array) -> np.ndarray:
        data, offsets = flat([k.encode("utf-8") for k in keys.to_pylist()])
        return hash_words(data, offsets[:-1], offsets[1:])

    def find(self, keys: pa.Array) -> np.ndarray:
        if not len(self.ids) or not len(keys):
            return np.full(len(keys), -1, dtype=np.int32)
        at = np.searchsorted(self.hashes, self._hash(keys)).clip(0, len(self.ids) - 1)
        same = pc.equal(keys, self.keys.take(pa.array(at))).to_numpy(zero_copy_only=False)
        out = np.where(same, self.ids[at], -1).astype(np.int32)
        if self.twins:
            for i in np.flatnonzero(~same):
                out[i] = self.twins.get(keys[int(i)].as_py(), -1)
        return out


def _rows(place: np.ndarray, word: np.ndarray, phrase: np.ndarray) -> pa.RecordBatch:
    """Rows of a relation from its occurrences, cut where a piece ends; the first step of a row joins nothing."""
    n = len(place)
    step = np.empty(n, dtype=np.int32)
    step[0], step[1:] = 2, np.diff(place)
    cuts = np.flatnonzero(step != 1)
    after = np.searchsorted(cuts, np.arange(RUN, n, RUN))
    begins = np.unique(np.concatenate([[0], cuts[after[after < len(cuts)]], [n]]))
    step[begins[:-1]] = 2
    offsets = pa.array(begins, pa.int32())
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (step, word, phrase)], _RELATION.names)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, words and phrases of the rows of a batch, one after the other."""
    step, word, phrase = (pc.list_flatten(batch.column(c)).to_numpy() for c in _RELATION.names)
    return np.cumsum(step.astype(np.int64)), word, phrase


def first_relation(texts: DataFrame, words: DataFrame, most_sent: int) -> DataFrame:
    """Occurrences of frequent words (``key, n, id``)."""
    if words.count() <= most_sent:
        table = words.select("key", "id").toArrow()
        sent = texts.sparkSession.sparkContext.broadcast((table["key"].combine_chunks(), table["id"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = _Words(*sent.value)
            for batch in _small(batches):
                for lang, found, place in _pieces(batch):
                    coded = found.dictionary_encode()
                    ids = table.find(_keyed(coded.dictionary, lang))[coded.indices.to_numpy()]
                    known = ids >= 0
                    if known.any():
                        yield _rows(place[known], ids[known], ids[known])

        return materialise(texts.mapInArrow(run, _RELATION), "relation")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            for lang, found, place in _pieces(batch):
                rows, keys = _rows(place, place, place), _keyed(found, lang)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(rows.column(0).offsets, keys)], ["step", "key"])

    spelled = materialise(texts.mapInArrow(spell, "step array<int>, key array<string>"), "spelled").withColumn("row", F.monotonically_increasing_id())
    met = _met(spelled, "key", words)
    labelled = spelled.join(met, "row").select("step", F.col("step").alias("word"), "ids")
    return _relabel(labelled, 1)


def _met(rows: DataFrame, column: str, phrases: DataFrame) -> DataFrame:
    """``row, ids``: for every row the places in its array whose key is a frequent phrase, with the number; by a shuffle of occurrences."""
    keys = rows.select("row", F.posexplode(column).alias("at", "key")).filter("key is not null")
    return keys.join(phrases.select("key", "id"), "key").groupBy("row").agg(F.collect_list(F.struct("at", "id")).alias("ids"))


def _relabel(labelled: DataFrame, k: int) -> DataFrame:
    """The relation after a join by shuffle: ``step, word, ids``; in the first round the words are the numbers found."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step, word = (pc.list_flatten(batch.column(c)).to_numpy() for c in ("step", "word"))
            place = np.cumsum(step.astype(np.int64))
            begins = batch.column("word").offsets.to_numpy()[:-1] - batch.column("word").offsets[0].as_py()
            ids = pc.list_flatten(batch.column("ids"))
            at = ids.field("at").to_numpy() + begins[pc.list_parent_indices(batch.column("ids")).to_numpy()]
            phrase = np.full(len(word), -1, dtype=np.int32)
            phrase[at] = ids.field("id").to_numpy()
            yield from _kept(place, phrase if k == 1 else word, phrase, k)

    return materialise(labelled.mapInArrow(run, _RELATION), "relation")


def _kept(place: np.ndarray, word: np.ndarray, phrase: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The occurrences that a frequent phrase of k words covers."""
    starts = np.flatnonzero(phrase >= 0)
    cover = np.zeros(len(place), dtype=bool)
    for j in range(k):
        cover[starts + j] = True
    if cover.any():
        yield _rows(place[cover], word[cover], phrase[cover])


def extended(place: np.ndarray, word: np.ndarray, phrase: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of occurrences of k words with single words at the next place: where they start, and their keys."""
    n = len(place) - k
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    # words in between are all there, so the next place can only be k lines further
    at = np.flatnonzero((phrase[:n] >= 0) & (phrase[1:n + 1] >= 0) & (place[k:] == place[:n] + k))
    return at, phrase[at].astype(np.int64) << 32 | word[at + k].astype(np.int64)


def group_counts(relation: DataFrame, k: int) -> DataFrame:
    """``key, n`` of the phrases of k + 1 words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for at in range(0, len(keys), 100_000):  # small batches for the way back
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(n[part])], ["key", "n"])

        for batch in _small(batches):
            held.append(extended(*_columns(batch), k)[1])
            if sum(map(len, held)) > COUNTED:
                yield from counted()
        if held:
            yield from counted()

    return relation.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def next_relation(relation: DataFrame, phrases: DataFrame, k: int, most_sent: int) -> DataFrame:
    """Semi-join with the frequent phrases of k + 1 words (``key, n, id``)."""
    if phrases.count() <= most_sent:
        table = phrases.select("key", "id").toArrow()
        order = np.argsort(table["key"].to_numpy())
        sent = relation.sparkSession.sparkContext.broadcast((table["key"].to_numpy()[order], table["id"].to_numpy()[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, ids = sent.value
            if not len(keys):
                return
            for batch in _small(batches):
                place, word, phrase = _columns(batch)
                starts, found = extended(place, word, phrase, k)
                at = np.searchsorted(keys, found).clip(0, len(keys) - 1)
                new = np.full(len(place), -1, dtype=np.int32)
                new[starts] = np.where(keys[at] == found, ids[at], -1)
                yield from _kept(place, word, new, k + 1)

        return materialise(relation.mapInArrow(run, _RELATION), "relation")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, word, phrase = _columns(batch)
            starts, found = extended(place, word, phrase, k)
            missing = np.ones(len(place), dtype=bool)
            missing[starts] = False
            keys = np.zeros(len(place), dtype=np.int64)
            keys[starts] = found
            offsets = batch.column(0).offsets
            shifted = pc.subtract(offsets, offsets[0])
            yield pa.RecordBatch.from_arrays([batch.column("step"), batch.column("word"),
                                              pa.ListArray.from_arrays(shifted, pa.array(keys, mask=missing))], ["step", "word", "key"])

    rows = materialise(relation.mapInArrow(spell, "step array<int>, word array<int>, key array<bigint>"), "spelled") \
        .withColumn("row", F.monotonically_increasing_id())
    return _relabel(rows.join(_met(rows, "key", phrases), "row").select("step", "word", "ids"), k + 1)


def _decoded(levels: list[DataFrame]) -> list[DataFrame]:
    """``words, n`` of the frequent phrases of every length; ``words`` are the numbers of their words."""
    out = [levels[0].select("id", F.array("id").alias("words"), "n")]
    for level in levels[1:]:
        split = level.select(F.col("id").alias("__id"), F.shiftright("key", 32).cast("int").alias("id"),
                             F.col("key").bitwiseAND(F.lit(MOST_PHRASES)).cast("int").alias("__word"), F.col("n").alias("__n"))
        joined = split.join(out[-1].select("id", "words"), "id")
        out.append(joined.select(F.col("__id").alias("id"), F.concat("words", F.array("__word")).alias("words"), F.col("__n").alias("n")))
    return [x.select("words", "n") for x in out]


def mine(df: DataFrame, text_col: str, lang_col: str, least: int = 30, longest: int = 4, share: int = 80, most: int = 2_000,
         most_sent: int = MOST_SENT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``most`` phrases of 2 to ``longest`` words of every language.

    Texts are lower-cased in ASCII, cut at ``.,;:!?`` and line ends into pieces and at spaces and tabs into words. A phrase has ``a``
    occurrences within pieces, at least ``least``; of its cuts into two parts with ``l`` and ``r`` occurrences the one with the lowest
    ``floor(2000000 * a / (l + r))`` counts, of several the first. A phrase inside a longer one of ``share`` percent of its
    occurrences is left out. Ties stand in the order of score, occurrences, then UTF-8 bytes.
    Null texts hold nothing; a null language is ``und``; repeated rows count each time; other columns, ids included, are not read. Without
    frequent phrases the result is empty.
    """
    texts = _texts(df, text_col, lang_col)
    counts = materialise(word_counts(texts), "words")
    words = _numbered(counts.filter((F.col("n") >= least) & ~F.col("key").startswith(" ")), "phrases")
    levels, relation = [words], first_relation(texts, words, most_sent)
    for k in range(1, longest):
        levels.append(_numbered(group_counts(relation, k).filter(F.col("n") >= least), "phrases"))
        if k + 1 < longest:
            relation = next_relation(relation, levels[-1], k, most_sent)
    lengths = _decoded(levels)
    found = lengths[0]
    for x in lengths[1:]:
        found = found.unionByName(x)
    found = materialise(found, "found")
    size = F.size("words")
    longer = found.filter(size > 2).select(F.col("n").alias("__n"), F.explode(F.expr(
        "flatten(transform(sequence(2, size(words) - 1), w -> transform(sequence(1, size(words) - w + 1), i -> slice(words, i, w))))")).alias("words")) \
        .groupBy("words").agg(F.max("__n").alias("__n"))
    kept = found.filter(size > 1).join(longer, "words", "left") \
        .filter(F.col("__n").isNull() | (F.col("__n") * 100 < F.col("n") * share)).select("words", F.col("n").alias("a"))
    cuts = kept.select("words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    part = found.select(F.col("words").alias("part"), F.col("n").alias("f"))
    cuts = cuts.withColumn("part", F.expr("slice(words, 1, k)")).join(part, "part").withColumnRenamed("f", "l") \
        .withColumn("part", F.expr("slice(words, k + 1, size(words) - k)")).join(part, "part").withColumnRenamed("f", "r")
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div cast(l + r as decimal(20,0))"))
    # words follow from the phrase, so each phrase has a few cuts only
    scored = cuts.groupBy("words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("words", "a", "c.score", "c.l", "c.r")
    spelled = words.select(F.col("id"), F.col("key"))
    for i in range(longest):
        scored = scored.withColumn("id", F.get("words", F.lit(i))).join(spelled.withColumnRenamed("key", f"w{i}"), "id", "left").drop("id")
    scored = scored.withColumn("lang", F.expr("substring(w0, instr(w0, ' ') + 1)")) \
        .withColumn("phrase", F.concat_ws(" ", *[F.substring_index(f"w{i}", " ", 1) for i in range(longest)]))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = scored.select("lang", F.row_number().over(order).alias("rank"), "phrase", "a", "l", "r", "score").filter(F.col("rank") <= most)
    totals = counts.filter(F.col("key").startswith(" ")).select(F.expr("substring(key, 2)").alias("lang"), F.col("n"))
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
