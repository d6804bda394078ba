"""Document fingerprints: a Merkle tree over sections, paragraphs and short passages of every text.

A paragraph is a line. A section ends at a blank line, before a heading, and after a paragraph whose digest says so (one in eight), so
that no node has many children. Passages are the leaves: a paragraph is cut after spaces that follow the end of a sentence, two signs, or
any character but the seven commonest letters, after two spaces, and after 24 characters at the latest. Texts of every length are cut
by this one rule; cuts depend on the text around them only, so an edit changes the leaves it touches.
Every node's digest covers its children's, so equal roots mean equal texts, and of two trees only differing branches need a look.

Leaves of many texts are cut and digested at once, as arrays of code points: the digest of a leaf is two polynomial hashes of 64 bits.
Paragraphs, sections and roots are BLAKE2b over the digests below them.

The printed fingerprint is ``root.sections.paragraphs.leaves``: 32 hex digits, then in base64 a record for every section and paragraph
(eight bytes of digest, four for the number of children) and for every leaf (four of digest, one for its length).
"""
from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import groups, mix

LONGEST = 24
#: Characters of texts whose leaves are cut together.
TOGETHER = 1 << 19
_HEADING = re.compile(r"#{1,6} |\d+(?:\.\d+)* [A-Z]")
_FAN_OUT = 8
_HASHED = 1 << 17

# what a character says about a cut after it: 1 ends a sentence, 2 is a letter but for the commonest, 4 is a sign
_KIND = np.full(129, 2, dtype=np.uint8)  # all beyond ASCII count as letters
_KIND[:128] = 4
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 2
_KIND[[ord(c) for c in "aenorstAENORST_"]] = 0
_KIND[[0x20, 0x09, 0x0A]] = 0
_KIND[[ord(c) for c in ".!?|"]] = 5
_SALTS = np.random.default_rng(20_250_301).integers(1, 1 << 63, (2, LONGEST), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTH = np.uint64(0x2545F4914F6CDD1D)


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def _leaves(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the leaves of texts that stand one after the other, each followed by a line end."""
    kind, space, line = _KIND[np.minimum(codes, 128)], codes == 0x20, codes == 0x0A
    # a cut may follow the last of a run of spaces
    last = space.copy()
    last[:-1] &= ~space[1:]
    ended = np.zeros(len(codes), dtype=bool)
    if len(codes) > 2:
        one, two = kind[1:-1], kind[:-2]
        ended[2:] = (one & 3 > 0) | ((codes[1:-1] == 0x2C) & (two & 2 > 0)) | ((one & 4 > 0) & (two & 4 > 0)) | space[1:-1]
    if len(codes) > 1:
        ended[1] = kind[0] & 3 > 0
    ended[1:] |= line[:-1]  # spaces at the start of a line
    ends = np.flatnonzero((last & ended) | line)
    # a line end is part of no leaf; those of no characters are none
    stops = np.where(line[ends], ends, ends + 1)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    some = stops > starts
    starts, stops = starts[some], stops[some]
    parts = -(-(stops - starts) // LONGEST)
    inner = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    begins = np.repeat(starts, parts) + inner * LONGEST
    return begins, np.minimum(begins + LONGEST, np.repeat(stops, parts))


def _hashed(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two hashes of every leaf."""
    if not len(starts):
        return [np.zeros(0, dtype=np.uint64)] * 2
    out = [np.empty(len(starts), dtype=np.uint64) for _ in _SALTS]
    for lo in range(0, len(starts), _HASHED):
        first, sizes = starts[lo:lo + _HASHED], (ends - starts)[lo:lo + _HASHED]
        firsts = np.cumsum(sizes) - sizes
        inner = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
        value = mix(codes[np.repeat(first, sizes) + inner].astype(np.uint64) + np.uint64(1))
        for hashes, salt in zip(out, _SALTS):
            hashes[lo:lo + _HASHED] = mix(np.add.reduceat(value * salt[inner], firsts) + sizes.astype(np.uint64) * _LENGTH)
    return out


class Tree:
    """Digests of a text by level, with the code points that each node covers."""

    __slots__ = ("starts", "ends", "first", "second", "paragraphs", "sections", "root")

    def __init__(self, text: str):
        self._grow(text, *_cut([text]), 0)

    def _grow(self, text: str, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, second: np.ndarray, begin: int) -> None:
        self.starts, self.ends, self.first, self.second = starts - begin, ends - begin, first, second
        self.paragraphs: list[tuple[bytes, int, int, int]] = []
        self.sections: list[tuple[bytes, int, int, int]] = []
        lines = text.split("\n")
        bounds = np.cumsum([len(x) + 1 for x in lines])
        upto = [0, *np.searchsorted(self.starts, bounds).tolist()]
        below = np.column_stack([first, second]).astype(">u8").tobytes()
        open_section = at = 0
        for i, (line, end) in enumerate(zip(lines, bounds.tolist())):
            if open_section < i and _HEADING.match(line):
                open_section = self._close(open_section)
            digest = _digest(b"p" + below[16 * upto[i]:16 * upto[i + 1]])
            end = min(end, len(text))
            self.paragraphs.append((digest, at, end, upto[i]))
            at = end
            if digest[0] % _FAN_OUT == 0 or not line.strip():
                open_section = self._close(open_section)
        if open_section < len(self.paragraphs):
            self._close(open_section)
        self.root = _digest(b"r" + b"".join(x[0] for x in self.sections))

    def _close(self, first: int) -> int:
        covered = self.paragraphs[first:]
        self.sections.append((_digest(b"s" + b"".join(x[0] for x in covered)), covered[0][1], covered[-1][2], first))
        return len(self.paragraphs)

    @property
    def leaves(self) -> list[tuple[bytes, int, int]]:
        below = np.column_stack([self.first, self.second]).astype(">u8").tobytes()
        return [(below[16 * i:16 * i + 16], a, b) for i, (a, b) in enumerate(zip(self.starts.tolist(), self.ends.tolist()))]

    def levels(self) -> Levels:
        def upper(nodes: list[tuple[bytes, int, int, int]], below: int) -> tuple[np.ndarray, np.ndarray]:
            return (np.frombuffer(b"".join(x[0][:8] for x in nodes), dtype=">u8").astype(np.uint64),
                    np.diff([*(x[3] for x in nodes), below]).astype(np.int64))
        return Levels(self.root, *upper(self.sections, len(self.paragraphs)), *upper(self.paragraphs, len(self.starts)),
                      self.first >> np.uint64(32), self.ends - self.starts)

    def fingerprint(self) -> str:
        return self.levels().printed()

    def nodes(self) -> Iterator[tuple[str, int, int | None, int, int, bytes]]:
        """Level, place, place of the parent, start, end, digest."""
        yield "root", 0, None, 0, self.sections[-1][2], self.root
        for i, (digest, start, end, first) in enumerate(self.sections):
            yield "section", i, 0, start, end, digest
        parent = 0
        for i, (digest, start, end, _) in enumerate(self.paragraphs):
            while parent + 1 < len(self.sections) and self.sections[parent + 1][3] <= i:
                parent += 1
            yield "paragraph", i, parent, start, end, digest
        parent = 0
        for i, (digest, start, end) in enumerate(self.leaves):
            while parent + 1 < len(self.paragraphs) and self.paragraphs[parent + 1][3] <= i:
                parent += 1
            yield "passage", i, parent, start, end, digest


class Levels:
    """Digests of a tree by level, with the number of children of sections and paragraphs and the characters of leaves."""

    __slots__ = ("root", "sections", "in_section", "paragraphs", "in_paragraph", "leaves", "chars")

    def __init__(self, root: bytes, *levels: np.ndarray):
        self.root = root
        self.sections, self.in_section, self.paragraphs, self.in_paragraph, self.leaves, self.chars = levels

    def printed(self) -> str:
        def upper(digest, n):
            out = np.empty(len(digest), dtype=[("d", ">u8"), ("n", ">u4")])
            out["d"], out["n"] = digest, n
            return out.tobytes()
        low = np.empty(len(self.leaves), dtype=[("d", ">u4"), ("n", "u1")])
        low["d"], low["n"] = self.leaves, self.chars
        return ".".join([self.root.hex(), *(base64.b64encode(x).decode() for x in (
            upper(self.sections, self.in_section), upper(self.paragraphs, self.in_paragraph), low.tobytes()))])

    @staticmethod
    def read(fingerprint: str) -> Levels:
        root, sections, paragraphs, leaves = fingerprint.split(".")
        up = [np.frombuffer(base64.b64decode(x), dtype=[("d", ">u8"), ("n", ">u4")]) for x in (sections, paragraphs)]
        low = np.frombuffer(base64.b64decode(leaves), dtype=[("d", ">u4"), ("n", "u1")])
        return Levels(bytes.fromhex(root), *(y for x in up for y in (x["d"].astype(np.uint64), x["n"].astype(np.int64))),
                      low["d"].astype(np.uint64), low["n"].astype(np.int64))


def _cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of the texts, which stand one after the other with a line end between them, and their hashes."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts, ends = _leaves(codes)
    return starts, ends, *_hashed(codes, starts, ends)


def grow(texts: list[str]) -> Iterator[Tree]:
    """Trees of many texts."""
    for a, b in groups([len(t) for t in texts], TOGETHER):
        part = texts[a:b]
        columns, begin = _cut(part), 0
        for text in part:
            lo, hi = np.searchsorted(columns[0], [begin, begin + len(text)])
            tree = Tree.__new__(Tree)
            tree._grow(text, *(c[lo:hi] for c in columns), begin)
            yield tree
            begin += len(text) + 1


def likeness(a: str, b: str) -> float:
    """Share of characters that two fingerprints have in common, 0 to 1 (twice the common over the sum).

    Walks down from the roots: a branch that both trees have counts as a whole, and only branches that differ are opened, sections
    into paragraphs and paragraphs into leaves. Equal roots give 1; two empty texts are equal; an empty and a non-empty text give 0.
    """
    return alike(Levels.read(a), Levels.read(b))


def _shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which digests of either side the other has too, each as often as both have it."""
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    x, y = a[order_a], b[order_b]

    def met(one, other, order):
        nth = np.arange(len(one)) - np.searchsorted(one, one)
        out = np.empty(len(one), dtype=bool)
        out[order] = nth < np.searchsorted(other, one, side="right") - np.searchsorted(other, one)
        return out
    return met(x, y, order_a), met(y, x, order_b)


def alike(a: Levels, b: Levels) -> float:
    """The likeness of two trees."""
    if a.root == b.root:
        return 1.0
    total = int(a.chars.sum() + b.chars.sum())
    if not total:
        return 0.0
    at, bt = _shared(a.sections, b.sections)
    common, open_a, open_b = 0, np.repeat(~at, a.in_section), np.repeat(~bt, b.in_section)
    if at.any():
        common += int(a.chars[np.repeat(np.repeat(at, a.in_section), a.in_paragraph)].sum())
    at, bt = _shared(a.paragraphs[open_a], b.paragraphs[open_b])
    if at.any():
        mine = np.zeros(len(a.paragraphs), dtype=bool)
        mine[np.flatnonzero(open_a)[at]] = True
        common += int(a.chars[np.repeat(mine, a.in_paragraph)].sum())
        open_a[np.flatnonzero(open_a)[at]], open_b[np.flatnonzero(open_b)[bt]] = False, False
    in_a, in_b = np.repeat(open_a, a.in_paragraph), np.repeat(open_b, b.in_paragraph)
    eight = np.uint64(8)
    x, y = (t.leaves[m] << eight | t.chars[m].astype(np.uint64) for t, m in ((a, in_a), (b, in_b)))
    # common leaves: those of one side that the other has, each as often as both have it
    x, y = np.sort(x), np.sort(y)
    nth = np.arange(len(x)) - np.searchsorted(x, x)
    there = nth < np.searchsorted(y, x, side="right") - np.searchsorted(y, x)
    common += int((x[there] & np.uint64(0xFF)).sum())
    return min(1.0, 2 * common / total)


def differing(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Spans that an edit has touched: start and end in the first text, start and end in the second, in code points.

    Walks the two trees from their roots into the branches that differ only. Sections are matched by digest in order, then the leaves
    of what is left; each unmatched stretch is one span.
    """
    left, right = Tree(a), Tree(b)
    if left.root == right.root:
        return []
    kept = _common([x[0] for x in left.sections], [x[0] for x in right.sections])
    spans, i, j = [], 0, 0
    for x, y in [*kept, (len(left.sections), len(right.sections))]:
        if i < x or j < y:
            spans += _branch(left, right, _below(left, i, x), _below(right, j, y))
        i, j = x + 1, y + 1
    return spans


def _below(tree: Tree, first: int, last: int) -> tuple[int, int]:
    """Leaves below the sections from ``first`` up to ``last``."""
    def start(section: int) -> int:
        if section >= len(tree.sections):
            return len(tree.starts)
        return tree.paragraphs[tree.sections[section][3]][3]
    return start(first), start(last)


def _branch(left: Tree, right: Tree, a: tuple[int, int], b: tuple[int, int]) -> list[tuple[int, int, int, int]]:
    x, y = left.leaves[a[0]:a[1]], right.leaves[b[0]:b[1]]

    def place(leaves, tree, base, k):
        k += base
        return int(tree.starts[k]) if k < len(tree.starts) else tree.sections[-1][2]
    spans, i, j = [], 0, 0
    for p, q in [*_common([d for d, _, _ in x], [d for d, _, _ in y]), (len(x), len(y))]:
        if i < p or j < q:
            spans.append((place(x, left, a[0], i), place(x, left, a[0], p), place(y, right, b[0], j), place(y, right, b[0], q)))
        i, j = p + 1, q + 1
    if not spans:  # only line ends differ
        spans.append((place(x, left, a[0], 0), place(x, left, a[0], len(x)), place(y, right, b[0], 0), place(y, right, b[0], len(y))))
    return spans


def _common(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Places of equal digests in an order that rises in both: the common head and tail, and between them digests that both have once
    (patience)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head:len(a) - tail], b[head:len(b) - tail]
    once_x, once_y = Counter(x), Counter(y)
    there = {d: j for j, d in enumerate(y) if once_y[d] == 1}
    pairs = [(i, there[d]) for i, d in enumerate(x) if once_x[d] == 1 and d in there]
    tails, at, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        t = bisect_left(tails, j)
        tails[t:t + 1], at[t:t + 1] = [j], [k]
        back.append(at[t - 1] if t else -1)
    middle, k = [], at[-1] if at else -1
    while k >= 0:
        middle.append((pairs[k][0] + head, pairs[k][1] + head))
        k = back[k]
    return [(i, i) for i in range(head)] + middle[::-1] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, root, fingerprint`` for every row; null texts count as empty, repeated rows stay, other columns are not read."""
    source = _source(df, id_col, text_col)
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("root", T.StringType()),
                           T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [t.fingerprint() for t in grow(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[:32] for p in prints], pa.string()),
                                              pa.array(prints, pa.string())], ["id", "root", "fingerprint"])

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


_NODE = T.StructType([T.StructField("level", T.StringType()), T.StructField("place", T.IntegerType()),
                      T.StructField("parent", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                      T.StructField("digest", T.StringType())])


def trees(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All nodes: ``id_col, level, place, parent, start, end, digest``; join two versions on id, level and digest to find what changed."""
    source = _source(df, id_col, text_col)
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), *_NODE.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                level, place, parent, start, end, digest = zip(*Tree(value.as_py()).nodes())
                yield pa.RecordBatch.from_arrays([
                    pa.array([key.as_py()] * len(level), batch.column(0).type), pa.array(level, pa.string()), pa.array(place, pa.int32()),
                    pa.array(parent, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
                    pa.array([d.hex() for d in digest], pa.string())], schema.names)

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones of the following text, or all of it if it is shorter."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third] if third else text


def _slices(source: DataFrame, slices: int) -> tuple[F.Column, dict[int, tuple]]:
    """The slice of a row in the order of descending ids, nulls last, and of hashes of texts within an id; and the head of each slice.

    An id that stands at several of the bounds, and the rows without one, are cut by the hash, so no id needs to fit one task.
    """
    kind = source.schema["id"].dataType
    found = source.agg(F.percentile_approx("id", [i / slices for i in range(1, slices)], 100 * slices), F.count("*"), F.count("id")).first()
    at = Counter(found[0] or [])
    bounds = sorted(at, reverse=True)
    empty = F.array().cast(T.ArrayType(kind))
    literal = F.array(*[F.lit(b) for b in bounds]).cast(T.ArrayType(kind)) if bounds else empty
    most = max([1, *at.values(), -(-(found[1] - found[2]) * slices // max(1, found[1]))])
    times = F.create_map(*[x for b in bounds if at[b] > 1 for x in (F.lit(b).cast(kind), F.lit(at[b]))]) if any(n > 1 for n in at.values()) else None
    cuts = F.when(F.col("id").isNull(), most).otherwise(F.coalesce(times[F.col("id")], F.lit(1)) if times is not None else F.lit(1))
    # two numbers for each bound, so that an id at a bound is apart from those between bounds
    place = F.when(F.col("id").isNull(), 2 * len(bounds) + 1).otherwise(
        F.size(F.filter(literal, lambda b: b > F.col("id"))) + F.size(F.filter(literal, lambda b: b >= F.col("id"))))
    part = F.least(cuts - 1, F.floor((F.shiftrightunsigned("hash", 1) / F.lit(float(1 << 63))) * cuts)).cast("int")
    return place * most + F.when(cuts > 1, part).otherwise(0)


def edit_test(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Fingerprint every text, its edited text and, for comparison, the next one in descending order of id.

    Returns ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. After the last document comes
    the first. Null ids come last; rows of equal id follow each other in order of a hash of the text, then of the text, so repeated
    rows are fine; null texts are empty; a single row is its own next. Other columns are not read.

    Rows are cut into slices of the order and sorted inside them; the first row of each slice is also sent, as a guard, to the slice
    before it. Only those first ids and hashes (one per slice) reach the driver.
    """
    from hashlib import sha256
    spark = df.sparkSession
    source = _source(df, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    kind = source.schema["id"].dataType
    own = _slices(source, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # within an id hashes rise as unsigned numbers, like the parts that they are cut into
    unsigned = F.col("hash").bitwiseXOR(F.lit(-1 << 63))
    heads = source.select(own.alias("slice"), F.struct("id", (F.lit(-1) - unsigned).alias("v")).alias("h")) \
        .groupBy("slice").agg(F.max("h").alias("h")).select("slice", "h.id", (F.lit(-1) - F.col("h.v")).alias("u")).orderBy("slice").collect()
    guards = F.array(*[F.struct(F.lit(h["id"]).cast(kind).alias("id"), F.lit(h["u"]).cast("long").alias("u"), F.lit(heads[i - 1]["slice"]).alias("to"))
                       for i, h in enumerate(heads)]) if heads else None
    targets = F.array(F.struct(own.cast("int").alias("slice"), F.lit(0).alias("guard")))
    if guards is not None:
        targets = F.concat(targets, F.transform(
            F.filter(guards, lambda g: g["id"].eqNullSafe(F.col("id")) & (g["u"] == unsigned)),
            lambda g: F.struct(g["to"].cast("int").alias("slice"), F.lit(1).alias("guard"))))
    # a head that repeats is sent once for every repetition; only the first in order is used
    placed = source.select("id", "text", unsigned.alias("u"), F.explode(targets).alias("t")).select("t.slice", "t.guard", "id", "text", "u")
    placed = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "slice").sortWithinPartitions(
        "slice", "guard", F.col("id").desc_nulls_last(), "u", "text").drop("u")
    out = T.StructType([T.StructField("id", kind), T.StructField("n_chars", T.LongType()), *[
        T.StructField(n, T.StringType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[
        T.StructField(n, T.DoubleType()) for n in ("near_edited", "near_next")]])

    def rows(keys: list, texts: list[str]) -> pa.RecordBatch:
        """Results of the keys; one more text than keys."""
        new = [edited(x, y) for x, y in zip(texts, texts[1:])]
        trees = [t.levels() for t in grow(texts + new)]
        old, changed = trees[:len(texts)], trees[len(texts):]
        columns = [keys, [len(t) for t in texts[:-1]], [sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new],
                   [t.printed() for t in old[:-1]], [t.printed() for t in changed],
                   [alike(x, y) for x, y in zip(old, changed)], [alike(x, y) for x, y in zip(old, old[1:])]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, guarded, keys, texts, size = None, False, [], [], 0
        for batch in batches:
            for slice_, guard, key, text in zip(*(batch.column(i) for i in range(4))):
                slice_, guard = slice_.as_py(), guard.as_py()
                if guard and (guarded or now != slice_):
                    continue  # a further copy of the guard
                if slice_ != now:
                    now, guarded = slice_, False
                text = text.as_py()
                keys.append(key.as_py())
                texts.append(text)
                size += len(text)
                if guard:
                    guarded = True
                if guard or size > TOGETHER:
                    if len(texts) > 1:
                        yield rows(keys[:-1], texts)
                    keys, texts = ([], []) if guard else (keys[-1:], texts[-1:])
                    size = sum(map(len, texts))

    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(f.dataType) for f in out.fields]
    return placed.mapInArrow(run, out).withColumnRenamed("id", id_col)
