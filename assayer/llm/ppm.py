"""Language-model scores: prediction by partial matching over bytes, beside a unigram of words.

The trie of contexts of up to four bytes is a table of five-byte grams with their counts; shorter contexts are sums over it. A symbol's
probability blends the orders from the longest context down: PPMC escape estimates (distinct symbols over their number plus all counts),
and symbols that a longer context has seen are excluded from the shorter ones. As the symbols of a context are among those of every
shorter one, the exclusion at an order is fixed by the next longer context alone, so each gram's log probability is computed once, in
one distributed pass over the table grouped by the last two context bytes. Below order 0 all unseen symbols are equally likely.

A text is its bytes and an end symbol, after four start symbols; both are bytes that UTF-8 never has.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .words import groups

START, END, SYMBOLS = 0xFE, 0xFF, 255
_PAD, _STOP = bytes([START]) * 4, bytes([END])
#: Grams of a table that still goes to every worker (12 MB a million); beyond it texts meet the table in a join.
MOST_SENT = 8_000_000
#: Words whose counts go to every worker, the most frequent ones; the others are looked up in a join.
FREQUENT = 200_000
_TOGETHER = 1 << 20
_HELD_ROWS = 500_000


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Five-byte grams of the texts in order, and where each text's grams begin (with the end at last)."""
    data = np.frombuffer(b"".join([_PAD + t + _STOP for t in texts]), dtype=np.uint8)
    keys = np.zeros(max(0, len(data) - 4), dtype=np.uint64)
    for i in range(5):
        keys <<= np.uint64(8)
        keys |= data[i:len(data) - 4 + i]
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=first[1:])
    return keys[data[4:] != START], first


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    unique, place = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(place, np.concatenate(counts)).astype(np.int64)


def _encoded(column: pa.Array) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def log_probabilities(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram's last byte after its first four.

    ``keys`` are distinct grams with all grams that share their last two context bytes; ``pairs`` counts (byte, next byte).
    """
    symbol = (keys & np.uint64(255)).astype(np.int64)
    last = ((keys >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
    singles = pairs.sum(axis=0)
    # per order: count of the row's symbol, and of its context: total, distinct symbols, total of these symbols one order down
    levels = []
    key, place, n = keys, np.arange(len(keys)), counts.astype(np.float64)
    for order in (4, 3, 2):
        shorter = key & np.uint64((1 << 8 * order) - 1) if order > 2 else None
        context, member = np.unique(key >> np.uint64(8), return_inverse=True)
        if order > 2:
            below, down = np.unique(shorter, return_inverse=True)
            fewer = np.bincount(down, n, len(below))
            next_count = fewer[down]
        else:
            next_count = pairs[((key >> np.uint64(8)) & np.uint64(255)).astype(np.int64), (key & np.uint64(255)).astype(np.int64)]
        seen = n > 0
        total, distinct = np.bincount(member, n, len(context)), np.bincount(member, seen, len(context))
        lost = np.bincount(member, np.where(seen, next_count, 0), len(context))
        levels.append((n[place], total[member][place], distinct[member][place], lost[member][place]))
        if order > 2:
            key, place, n = below, down[place], fewer
    row = pairs[last]
    levels.append((pairs[last, symbol], row.sum(axis=1), (row > 0).sum(axis=1), ((row > 0) * singles).sum(axis=1)))
    everywhere = np.ones(len(keys))
    levels.append((singles[symbol], singles.sum() * everywhere, (singles > 0).sum() * everywhere, 0 * everywhere))

    out, open_ = np.zeros(len(keys)), np.ones(len(keys), dtype=bool)
    excluded_total = excluded = np.zeros(len(keys))
    for count, total, distinct, lost in levels:
        rest, new = total - excluded_total, distinct - excluded
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = open_ & (count > 0)
            out[hit] += np.log10(count[hit] / (rest + new)[hit])
            open_ = open_ & ~hit
            escape = open_ & (new > 0)
            out[escape] += np.log10(new[escape] / (rest + new)[escape])
        excluded_total, excluded = lost, distinct
    out[open_] -= math.log10(max(1, SYMBOLS - int((singles > 0).sum())))
    return out


@dataclass
class Model:
    """``grams``: gram, n, logp for all grams met; ``words``: word, n; ``tokens`` and ``distinct``: words and ends, and how many kinds."""
    grams: DataFrame
    words: DataFrame
    n_grams: int
    texts: int
    tokens: int
    distinct: int


def _counted(source: DataFrame) -> DataFrame:
    """``gram, word, n`` over the rows of ``id, text, learn``; grams of texts that are not learned count zero."""
    schema = T.StructType([T.StructField("gram", T.LongType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def emit(keys, counts, words) -> Iterator[pa.RecordBatch]:
        if keys:
            unique, n = _merged(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(unique.astype(np.int64)), pa.nulls(len(unique), pa.string()), pa.array(n)], schema.names)
        if words:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.string()),
                                              pa.array(list(words.values()), pa.int64())], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, words, held = [], [], Counter(), 0
        for batch in batches:
            texts, learn = _encoded(batch.column(1)), batch.column(2).to_pylist()
            for first, last in groups([len(t) for t in texts], _TOGETHER):
                part = texts[first:last]
                found, begins = grams(part)
                weight = np.repeat(np.array(learn[first:last], dtype=np.int64), np.diff(begins))
                unique, n = _merged([found], [weight])
                keys.append(unique)
                counts.append(n)
                held += len(unique)
                for text, yes in zip(part, learn[first:last]):
                    if yes:
                        words.update(text.lower().split())
                if held > 8 * _HELD_ROWS:
                    unique, n = _merged(keys, counts)
                    keys, counts, held = [unique], [n], len(unique)
                if held > 4 * _HELD_ROWS or len(words) > _HELD_ROWS:
                    yield from emit(keys, counts, words)
                    keys, counts, words, held = [], [], Counter(), 0
        yield from emit(keys, counts, words)

    return source.select("id", "text", "learn").mapInArrow(run, schema).groupBy("gram", "word").agg(F.sum("n").alias("n"))


def _source(df: DataFrame, id_col: str, text_col: str, learn: Column) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
                     F.coalesce(learn, F.lit(True)).alias("learn"))


def train(df: DataFrame, id_col: str, text_col: str, learn: Column) -> Model:
    """Count grams and words of the rows where ``learn`` holds (null counts as true), over whole texts.

    Null texts are empty, repeated rows count each time. Grams of the other rows are listed with their learned count, mostly from shared
    context, so that the table answers for every text of ``df``. The counts are aggregated in the tasks, shuffled and written.
    """
    source = _source(df, id_col, text_col, learn)
    counted = materialise(_counted(source), "counts")
    texts = source.filter("learn").count()
    table = counted.filter("gram is not null").select("gram", "n")
    words = counted.filter("word is not null").select("word", "n")
    pairs = np.zeros((256, 256))
    for r in table.groupBy(F.expr("cast((gram >> 8) & 255 as int)").alias("a"), F.expr("cast(gram & 255 as int)").alias("b")) \
            .agg(F.sum("n").alias("n")).collect():  # at most 65,536 lines
        pairs[r["a"], r["b"]] = r["n"]
    schema = T.StructType([T.StructField("gram", T.LongType()), T.StructField("n", T.LongType()), T.StructField("logp", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def scored(k, n):
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n), pa.array(log_probabilities(k.astype(np.uint64), n, pairs))], schema.names)

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            counts = np.concatenate([counts, batch.column(1).to_numpy()])
            if len(keys) > _HELD_ROWS:  # up to the last group, which may go on
                context = (keys >> 8) & 0xFFFF
                cut = int(np.flatnonzero(context != context[-1])[-1]) + 1 if context[0] != context[-1] else 0
                if cut:
                    yield scored(keys[:cut], counts[:cut])
                    keys, counts = keys[cut:], counts[cut:]
        if len(keys):
            yield scored(keys, counts)

    context = F.expr("cast((gram >> 8) & 65535 as int)")
    logged = materialise(table.withColumn("c", context).repartition("c").sortWithinPartitions("c").select("gram", "n").mapInArrow(run, schema), "grams")
    tokens, kinds = words.agg(F.sum("n"), F.count("*")).first()
    return Model(logged, words, logged.count(), texts, (tokens or 0) + texts, kinds + (texts > 0))


def score(df: DataFrame, id_col: str, text_col: str, learn: Column, model: Model, most_sent: int = MOST_SENT,
          frequent: int = FREQUENT) -> DataFrame:
    """``id_col, learned, n_tokens, n_known, base_score, score`` for every row of the table that the model was trained beside.

    ``score`` is log10 of the text's probability under the byte model, end symbol included; ``base_score`` that of its words and end
    under add-one unigrams; ``n_known`` counts tokens that were learned. Null texts are empty; repeated rows stay (they are told apart
    by a row number that the write fixes); other columns are not read.
    """
    source = _source(df, id_col, text_col, learn)
    spark = df.sparkSession
    top = model.words.orderBy(F.desc("n"), "word").limit(frequent).collect()
    known = spark.sparkContext.broadcast({r["word"].encode("utf-8", "surrogatepass"): r["n"] for r in top})
    sent = model.n_grams <= most_sent
    if sent:
        rows = model.grams.select("gram", "logp").toArrow()
        keys, values = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        order = np.argsort(keys)
        table = spark.sparkContext.broadcast((keys[order].astype(np.uint64), values[order]))
    pair = T.ArrayType(T.StructType([T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("learned", T.BooleanType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                           T.StructField("known_log", T.DoubleType()), T.StructField("rare", T.ArrayType(T.StringType())),
                           T.StructField("score", T.DoubleType()), T.StructField("grams", pair)])
    arrow_pair = pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            texts = _encoded(batch.column(1))
            for first, last in groups([len(t) for t in texts], _TOGETHER):
                part, n = texts[first:last], last - first
                n_tokens, n_known, logs, rare = [], [], [], []
                for text in part:
                    words = text.lower().split()
                    counts = [get(w) for w in words]
                    missed = [w for w, c in zip(words, counts) if c is None]
                    counts = np.array([c for c in counts if c is not None] if missed else counts, dtype=np.float64)
                    n_tokens.append(len(words) + 1)
                    n_known.append(len(counts))
                    logs.append(float(np.log10(counts + 1).sum()))
                    rare.append(missed)
                found, begins = grams(part)
                if sent:
                    keys, values = table.value
                    total = np.add.reduceat(values[np.searchsorted(keys, found)], begins[:-1])
                    scores, lists = pa.array(total), pa.nulls(n, arrow_pair)
                else:
                    each = [np.unique(found[a:b].astype(np.int64), return_counts=True) for a, b in zip(begins, begins[1:])]
                    scores = pa.nulls(n, pa.float64())
                    lists = pa.array([[dict(gram=int(k), n=int(c)) for k, c in zip(*x)] for x in each], arrow_pair)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
                     pa.array(logs, pa.float64()), pa.array(rare, pa.list_(pa.string())), scores, lists], schema.names)

    rows = materialise(source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = rows.select("row", F.explode("rare").alias("word"))
    others = model.words.filter(F.col("n") <= (top[-1]["n"] if top else 0))  # holds all words that were not sent
    met = rare.join(others, "word") \
        .groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_log"))
    out = rows.drop("rare", "grams").join(met, "row", "left")
    if not sent:
        joined = rows.select("row", F.inline("grams")).withColumnRenamed("n", "times").join(model.grams.select("gram", "logp"), "gram") \
            .groupBy("row").agg(F.sum(F.col("times") * F.col("logp")).alias("score"))
        out = out.drop("score").join(joined, "row", "left")
    end = math.log10(model.texts + 1)
    whole = math.log10(model.tokens + model.distinct + 1)
    return out.select(
        F.col("id").alias(id_col), "learned", "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0)) + F.lit(int(model.texts > 0))).cast("long").alias("n_known"),
        (F.col("known_log") + F.coalesce("more_log", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(whole)).alias("base_score"), "score")
