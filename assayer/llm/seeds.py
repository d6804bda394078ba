"""Benchmark decontamination with spaced seeds.

A seed is the hash of a few words at fixed distances; a mask says which positions count, so that a substituted word at an ignored
position changes nothing. Seeds of the benchmark meet the seeds of the documents; around every hit the item is laid over the document
and of all stretches of the diagonal that match at three quarters of their places the one with the most matches is taken.

An item of fewer than four words says little by itself: it overlaps only a text that holds these words and no others.

The benchmark is a stated set of queries. It is taken in blocks of bounded size, each block's seeds go to all tasks, and the documents
are read once per block without a shuffle.
"""
from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import ALPHANUMERIC, find_words, flat, groups, hash_words, mix

#: Positions that count; every two neighbouring substitutions at least four words apart leave one mask a hit.
MASKS = ("11011011", "1101000111", "110010100101")
#: Words that must match in a stretch (or eight tenths of a shorter item), and their least share of the stretch.
LEAST_WORDS, LEAST_SHARE = 12, 0.75
#: Words from which on an item is looked for inside texts.
SHORTEST = 4
#: Characters of the benchmark in one block.
BLOCK_CHARS = 4_000_000
_TOGETHER = 1 << 20
_STEPS = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) | 1 for i in range(64)], dtype=np.uint64)


def _offsets(mask: str, length: int) -> list[int]:
    """Counting positions; a mask longer than an item is cut to its length."""
    return [i for i, c in enumerate(mask[:length]) if c == "1"]


def _seeds(words: np.ndarray, offsets: list[int], mark: int) -> np.ndarray:
    span = offsets[-1] + 1
    n = max(0, len(words) - span + 1)
    out = np.full(n, mark, dtype=np.uint64)
    for k, o in enumerate(offsets):
        out += words[o:o + n] * _STEPS[k + 1]
    return mix(out)


@cache
def _signs() -> tuple[re.Pattern, re.Pattern]:
    """Punctuation, symbols, spaces and controls beyond ASCII, as classes of ranges: of the first plane, which are looked up at once, and
    of the others."""
    ranges: list[list[int]] = []
    for c in range(0x80, sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] in "PSZ" or 0x80 <= c < 0xA0:
            if ranges and ranges[-1][1] == c - 1 and c != 0x10000:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    low, high = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges if (a < 0x10000) == first) for first in (True, False))
    return re.compile(f"[{low}]"), re.compile(f"[{high}]")


def plain(text: str | None) -> bytes:
    """Lower case, with signs beyond ASCII as spaces; the others are no bytes of words anyway."""
    text = (text or "").lower()
    if not text.isascii():
        low, high = _signs()
        text = low.sub(" ", text)
        if max(text) > "\uffff":
            text = high.sub(" ", text)
    return text.encode("utf-8", "surrogatepass")


def _texts(column: pa.Array) -> list[bytes]:
    return [plain(t) for t in column.to_pylist()]


class Index:
    """Seeds of a block of items."""

    def __init__(self, texts: list[bytes]):
        data, starts = flat(texts)
        a, b, item = find_words(data, starts, ALPHANUMERIC)
        hashes = hash_words(data, a, b)
        self.items = np.split(hashes, np.searchsorted(item, np.arange(1, len(texts)))) if texts else []
        # masks by length: whole ones, and those cut to short items
        shapes: dict[tuple[int, ...], list[int]] = {}
        self.short: dict[bytes, list[int]] = {}
        for i, words in enumerate(self.items):
            if 0 < len(words) < SHORTEST:
                self.short.setdefault(words.tobytes(), []).append(i)
            for mask in MASKS:
                if len(words) >= SHORTEST:
                    shapes.setdefault(tuple(_offsets(mask, len(words))), []).append(i)
        self.shapes = []
        for offsets, members in shapes.items():
            found = [(_seeds(self.items[i], list(offsets), len(offsets)), i) for i in sorted(set(members))]
            keys = np.concatenate([s for s, _ in found])
            items = np.concatenate([np.full(len(s), i) for s, i in found])
            places = np.concatenate([np.arange(len(s)) for s, _ in found])
            order = np.argsort(keys, kind="stable")
            bitmap = np.zeros(1 << 18, dtype=bool)
            bitmap[keys >> np.uint64(46)] = True
            self.shapes.append((list(offsets), keys[order], items[order], places[order], bitmap))

    def hits(self, words: np.ndarray, text: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, diagonal) of every seed that the two share; ``text`` numbers the words' texts."""
        out: set[tuple[int, int, int]] = set()
        for offsets, keys, items, places, bitmap in self.shapes:
            seeds = _seeds(words, offsets, len(offsets))
            at = np.flatnonzero(bitmap[seeds >> np.uint64(46)])
            at = at[text[at] == text[at + offsets[-1]]]
            low, high = np.searchsorted(keys, seeds[at]), np.searchsorted(keys, seeds[at], side="right")
            for p, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                out.update(zip([int(text[p])] * (b - a), items[a:b].tolist(), (p - places[a:b]).tolist()))
        return out


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """Start, end and matches of the stretch with the most matches among those with the least share; the first of equals.

    Of the stretches that end at a place, the longest with the share has the most matches: it starts where the running sum of what the
    matches are over the share first was as low as at the end. Substitutions at both ends are left out afterwards.
    """
    matches = np.concatenate([[0], np.cumsum(same)])
    over = matches - LEAST_SHARE * np.arange(len(matches))
    starts = np.searchsorted(-np.minimum.accumulate(over), -over)
    end = int(np.argmax(matches - matches[starts]))
    inside = np.flatnonzero(same[starts[end]:end]) + starts[end]
    if not len(inside):
        return 0, 0, 0
    return int(inside[0]), int(inside[-1]) + 1, len(inside)


def overlaps(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """Overlaps of documents and benchmark items: ``id_col, item_id, word_start, word_end, n_matched, n_item_words``.

    One row for every row of ``docs`` and item that overlap, with the best stretch in words of the document (end exclusive). Words are
    runs of letters and digits in lower case; signs of any script end them. A stretch counts with twelve matching words, or eight tenths of the item if that is
    fewer, and matches at three quarters of its places; an item under four words counts where it is the whole text. Null and empty texts on either side overlap nothing; repeated rows and repeated
    items each have their own rows; empty tables give an empty result; other columns are not read.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    wanted = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text")).filter("text is not null")
    kinds = [source.schema["id"].dataType, wanted.schema["item"].dataType]
    schema = T.StructType([T.StructField("id", kinds[0]), T.StructField("item_id", kinds[1]), *[
        T.StructField(n, T.LongType()) for n in ("word_start", "word_end", "n_matched", "n_item_words")]])
    size = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    out = None
    for block in range(blocks):
        part = wanted.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text").collect()
        found = source.mapInArrow(_scan([r["item"] for r in part], [r["text"] for r in part], schema), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def _scan(names: list, texts: list[str], schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(f.dataType) for f in schema.fields]
    kept: list[Index] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Index([plain(t) for t in texts]))
        index = kept[0]
        for batch in batches:
            lower = _texts(batch.column(1))
            for first, last in groups([len(t) for t in lower], _TOGETHER):
                rows = _matches(index, lower[first:last])
                if rows:
                    ids = batch.column(0).slice(first, last - first).take(pa.array([r[0] for r in rows]))
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([names[i] for i in columns[1]], types[1])]
                        + [pa.array(c, t) for c, t in zip(columns[2:], types[2:])], schema.names)

    return run


def _matches(index: Index, texts: list[bytes]) -> list[tuple[int, int, int, int, int, int]]:
    data, offsets = flat(texts)
    if not len(data):
        return []
    starts, ends, text = find_words(data, offsets, ALPHANUMERIC)
    words = hash_words(data, starts, ends)
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for t, item, diagonal in sorted(index.hits(words, text)):
        target, low, high = index.items[item], int(first[t]), int(first[t + 1])
        a, b = max(low, diagonal), min(high, diagonal + len(target))
        if (t, item) in best and b - a <= best[t, item][2]:
            continue
        start, end, matched = best_stretch(words[a:b] == target[a - diagonal:b - diagonal])
        if matched >= min(LEAST_WORDS, -(-len(target) * 4 // 5)) and ((t, item) not in best or matched > best[t, item][2]):
            best[t, item] = (a + start - low, a + end - low, matched)
    if index.short:
        for t in np.flatnonzero((first[1:] > first[:-1]) & (first[1:] - first[:-1] < SHORTEST)).tolist():
            for item in index.short.get(words[first[t]:first[t + 1]].tobytes(), []):
                n = len(index.items[item])
                best[t, item] = (0, n, n)
    return [(t, item, a, b, matched, len(index.items[item])) for (t, item), (a, b, matched) in sorted(best.items())]
