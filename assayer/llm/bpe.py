"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All pre-tokens that a worker meets for the first time stand in one linked list of tokens, with barriers between them; a single
pre-token of any length is no different. The positions of pairs that can merge wait in one bucket per merge rank. A bitmap of three
levels marks the buckets in use, so the lowest rank is found with three find-first-set steps. A bucket is emptied at a time: entries
that an earlier merge has made stale are skipped, the others are merged, and the new pairs on both sides go to their buckets. Merges in
different pre-tokens do not touch each other, so taking ranks in order over all of them takes each one's in order.
"""
from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import groups

#: Pre-tokens and characters of pre-tokens that a worker remembers; beyond either the memory starts anew.
REMEMBERED = 200_000
REMEMBERED_CHARS = 8_000_000
#: Characters of text that are encoded together, and rows of a batch that a worker returns.
TOGETHER = 1_000_000
ROWS = 256
#: Bytes of new pre-tokens that share a list, but for a longer single one.
SHARED = 150_000


class RankQueue:
    """Positions by rank. ``low`` has the bits of the ranks in use by words of 64, ``middle`` a bit for each such word, ``top`` a bit
    for each word of ``middle``."""

    def __init__(self):
        self.top, self.middle, self.low, self.buckets = 0, {}, {}, {}

    def push(self, ranks: Sequence[int], positions: Sequence) -> None:
        """Put each position (a number, or an array of numbers) under its rank."""
        buckets = self.buckets
        for rank, position in zip(ranks, positions):
            if rank in buckets:
                buckets[rank].append(position)
                continue
            buckets[rank] = [position]
            word, group = rank >> 6, rank >> 12
            self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
            self.middle[group] = self.middle.get(group, 0) | 1 << (word & 63)
            self.top |= 1 << group

    def pop(self) -> tuple[int, list] | None:
        """Lowest rank and all that waits under it."""
        if not self.top:
            return None
        group = (self.top & -self.top).bit_length() - 1
        bits = self.middle[group]
        word = (group << 6) + (bits & -bits).bit_length() - 1
        bits = self.low[word]
        first = bits & -bits
        rank = (word << 6) + first.bit_length() - 1
        self.low[word] = bits ^ first
        if bits == first:
            self.middle[group] ^= 1 << (word & 63)
            if not self.middle[group]:
                self.top ^= 1 << group
        return rank, self.buckets.pop(rank)


class Merges:
    """Vocabulary: ids of single bytes, and the id that two neighbouring tokens merge into, which is also the merge's rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {v: k for k, v in ranks.items()}
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k] for k in sorted(pairs)], dtype=np.int64)
        self.whole = ranks

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the two do not merge; a barrier is a negative token."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0), self.ranks[at], -1)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token."""
        out: list[list[int] | None] = [None] * len(pieces)
        chosen, size = [], 0
        for i, piece in enumerate(pieces):
            whole = self.whole.get(piece)
            if whole is not None:
                out[i] = [whole]
                continue
            chosen.append(i)
            size += len(piece)
            if size >= SHARED:
                self._merge(pieces, chosen, out)
                chosen, size = [], 0
        if chosen:
            self._merge(pieces, chosen, out)
        return out

    def _merge(self, pieces: list[bytes], chosen: list[int], out: list) -> None:
        lengths = np.array([len(pieces[i]) + 1 for i in chosen])
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        token = np.full(n + 1, -1, dtype=np.int64)  # a barrier after every pre-token, and one slot more
        flat = np.frombuffer(b"\0".join([pieces[i] for i in chosen]) + b"\0", dtype=np.uint8)
        token[:n] = self.bytes[flat]
        token[ends - 1] = -1
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        before[0] = n
        current = np.full(n + 1, -1, dtype=np.int64)
        current[:n] = self.rank(token[:-1], np.where(token[1:] >= 0, token[1:], (1 << 31) - 1))
        queue = RankQueue()
        waiting = np.flatnonzero(current >= 0)
        waiting = waiting[np.argsort(current[waiting], kind="stable")]
        ranks, starts = np.unique(current[waiting], return_index=True)
        queue.push(ranks.tolist(), np.split(waiting, starts[1:]) if len(starts) else [])
        while (found := queue.pop()) is not None:
            rank, bucket = found
            at = np.array(bucket) if type(bucket[0]) is int else bucket[0] if len(bucket) == 1 else np.concatenate(
                [np.atleast_1d(x) for x in bucket])
            at = at[current[at] == rank]  # the others are stale
            if not len(at):
                continue
            if len(bucket) > 1:
                at = np.unique(at)
            gone = after[at]
            if len(at) > 1:
                overlaps = np.flatnonzero(gone[:-1] == at[1:])
                if len(overlaps):  # a a a: every second one of a chain, from the left
                    chained = np.zeros(len(at), dtype=bool)
                    chained[overlaps + 1] = True
                    place = np.arange(len(at))
                    start = np.maximum.accumulate(np.where(chained, 0, place))
                    at = at[(place - start) % 2 == 0]
                    gone = after[at]
            end = after[gone]
            after[at], before[end] = end, at
            token[at], token[gone], current[gone] = rank, -2, -1
            left = before[at]
            # right pairs, then left ones, once all merges of the bucket are done
            pair = np.concatenate([at, left])
            following = np.concatenate([end, at])
            second = token[following]
            new = self.rank(token[pair], np.where(second >= 0, second, (1 << 31) - 1))
            current[pair] = new
            there = new >= 0
            if there.any():
                queue.push(new[there].tolist(), pair[there].tolist())
        kept = np.flatnonzero(token[:n] >= 0)
        ids = token[kept].tolist()
        cuts = np.searchsorted(kept, ends).tolist()
        at = 0
        for i, cut in zip(chosen, cuts):
            out[i] = ids[at:cut]
            at = cut


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of base64 token and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class _Numbers(dict):
    """Numbers its keys as they come; ``new`` holds those that are not encoded yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        self.new.append(key)
        return number


class Codec:
    """Encoder and decoder for one rank file and one pattern. Ids of remembered pre-tokens stand one after the other in one array."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        self.merges, self.find = Merges(ranks), regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.ids, self.begins, self.chars = _Numbers(), np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64), 0

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and where each text's begin (with the end at last)."""
        if len(self.numbers) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._forget()
        number, codes, upto = self.numbers.__getitem__, array("i"), [0]
        for text in texts:
            codes.extend(map(number, self.find(text)))
            upto.append(len(codes))
        new, self.numbers.new = self.numbers.new, []
        if new:
            self.chars += sum(map(len, new))
            found = self.merges.encode([p.encode("utf-8") for p in new])
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(sizes.sum()))])
        codes = np.frombuffer(codes, dtype=np.int32) if len(codes) else np.zeros(0, dtype=np.int32)
        first, sizes = self.begins[codes], self.begins[codes + 1] - self.begins[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.repeat(first - ends[:-1], sizes) + np.arange(int(ends[-1]))], ends[np.array(upto)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.merges.tokens.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(name: str, pattern: str) -> Codec:
    key = (name, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(read_ranks(SparkFiles.get(name)), pattern)
    return _CODECS[key]


def _ship(df: DataFrame, path: str) -> str:
    """Send the rank file to the executors; its size is that of a vocabulary."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str, with_bytes: bool = False) -> DataFrame:
    """Token ids of every text: ``id_col, ids`` and, if asked for, ``decoded``: the bytes that the ids stand for.

    Special tokens have no meaning. A null or empty text has no ids. Ids of rows, ties and repeated rows are kept as they are, and
    other columns are not read.
    """
    name = _ship(df, path)
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    fields = [T.StructField("id", source.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if with_bytes:
        fields.append(T.StructField("decoded", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, pattern)
        for batch in batches:
            for first, last in groups(pc.utf8_length(batch.column(1)).to_pylist(), TOGETHER):
                for at in range(first, last, ROWS):
                    part = batch.slice(at, min(ROWS, last - at))
                    ids, begins = codec.encode_all(part.column(1).to_pylist())
                    columns = [part.column(0), pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids))]
                    if with_bytes:
                        columns.append(pa.array([codec.decode(ids[a:b].tolist()) for a, b in zip(begins, begins[1:])], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str, ids_col: str, path: str) -> DataFrame:
    """Bytes that ids stand for: ``id_col, decoded``. Null ids decode to no bytes; an unknown id is an error."""
    name = _ship(df, path)
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, r"\s+")
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [codec.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], ["id", "decoded"])

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
