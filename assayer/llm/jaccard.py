"""Similarity join of documents by the Jaccard index of their word shingles, exact.

Documents are sets of 64-bit shingle hashes; equal sets are one class. T-occurrence search finds, for a set, all sets that share at
least T shingles with it: the lists of documents that hold a shingle are split by length, the short ones are merged and counted, the few
longest are only probed by binary search for the candidates that the short ones leave (DivideSkip).

For that search, sets that can link must be in one task. Two sets of n <= m shingles with index t or more differ in at most
(1 - t) / (1 + t) * (n + m) shingles. Sets are therefore graded by size so that linked ones are in the same or neighbouring grades, and for
a grade the space of shingles is cut into more parts than there can be differences: one part at least is then equal in both, and so
are the signatures of that part. Signatures of nearly empty parts would be shared by chance; they are left out where the spare parts make
up for it, see ``signatures``.

Where they cannot be left out in large sets either (``chancy``), sets that share a common shingle share a signature. So a sketch is compared next: one bit for about every
shingle, flipped by each shingle that falls on it. Two sketches differ in no more bits than their sets do in shingles, so sets whose
sketches differ in more bits than linked sets may are not linked. What is left of a signature's sets is put into one block by connected
components, grade by grade, and every block is searched. A block of many shingles is cut into tiles and searched in pairs of tiles.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .components import components
from .words import LOWER, NOT_SPACE, find_words, flat, groups, hash_words, mix

_TOGETHER = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
#: Ways of cutting the space of shingles that a set tries in turn.
ROUNDS = 4
#: Shingles of a tile: 16 MB of hashes.
TILE = 2_000_000
#: Bytes of sketches of a tile of sets that share a signature.
SKETCH_TILE = 1 << 21
#: Class numbers that still go to every task (16 MB); beyond it they are joined by a shuffle.
MOST_SENT = 1_000_000


@dataclass(frozen=True)
class Join:
    """Shingles of ``words`` words; sets link with an index of ``num / den`` or more."""
    words: int
    num: int
    den: int

    def need(self, n, m):
        """Least common shingles of linked sets of n and m."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def grades(self, most: int) -> list[int]:
        """Smallest size of each grade; a linked set is at most one grade larger."""
        out = [1]
        while out[-1] <= most:
            out.append(out[-1] * self.den // self.num + 1)
        return out

    def parts(self, bounds: list[int], grade: int) -> tuple[int, int, int]:
        """For linked sets whose smaller one is of the grade: parts, spare parts, and shingles below which a part says little."""
        largest = bounds[grade + 1] - 1
        differ = (self.den - self.num) * (largest + largest * self.den // self.num) // (self.num + self.den)
        spare = -(-(differ + 1) // 10) + 1
        parts = differ + 1 + spare
        return parts, spare, 2 if bounds[grade] >= 3.5 * parts else 1

    def chancy(self) -> bool:
        """Whether signatures of large sets, too, may stand for a single shingle."""
        bounds = self.grades(1 << 20)
        return self.parts(bounds, len(bounds) - 2)[2] < 2


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within it, and where each text's begin (with the end at last).

    Words are runs of anything but ASCII white space, in ASCII lower case. A text of fewer words is one shingle, one without words none.
    """
    data, offsets = flat(texts)
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    starts, ends, text = find_words(data, offsets, NOT_SPACE)
    hashes = hash_words(LOWER[data], starts, ends)
    counts = np.bincount(text, minlength=len(texts))
    begins = np.concatenate([[0], np.cumsum(counts)])
    n = max(0, len(hashes) - words + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for i in range(words):
        rolled = rolled * _STEP + hashes[i:i + n]
    inside = text[:n] == text[words - 1:words - 1 + n] if n else np.zeros(0, dtype=bool)
    rolled, owner = mix(rolled[inside]), text[:n][inside]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        extra = []
        for t in short.tolist():
            value = int(counts[t])
            for h in hashes[begins[t]:begins[t + 1]].tolist():
                value = value * int(_STEP) + h & _MASK
            extra.append(value)
        rolled, owner = np.concatenate([rolled, mix(np.array(extra, dtype=np.uint64))]), np.concatenate([owner, short])
    order = np.lexsort((rolled, owner))
    rolled, owner = rolled[order], owner[order]
    first = np.ones(len(rolled), dtype=bool)
    first[1:] = (rolled[1:] != rolled[:-1]) | (owner[1:] != owner[:-1])
    rolled, owner = rolled[first], owner[first]
    return rolled, np.searchsorted(owner, np.arange(len(texts) + 1))


def signatures(sets: np.ndarray, begins: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of every set, the number of the set and the grade it signs for, in no order.

    A set signs for its own grade, where it may be the smaller one, and for the grade below. Of the equal parts of linked sets at most as
    many are nearly empty as either has nearly empty ones; if that is no more than the spare parts, some other part is equal. So a set
    signs its other parts only, and if it has more nearly empty ones than spare parts, it goes on with another cut of the space,
    where it may meet sets that went on as well; after the last it signs all parts.
    """
    sizes = np.diff(begins)
    if not len(sets):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    bounds = join.grades(int(sizes.max()))
    bounds.append(bounds[-1] * join.den // join.num + 1)
    grade = np.searchsorted(bounds, sizes, side="right") - 1
    table = np.array([join.parts(bounds, g) for g in range(len(bounds) - 1)], dtype=np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out, who, where = [], [], []
    for lower in (0, 1):
        scheme = grade - lower
        going = (sizes > 0) & (scheme >= 0)
        for turn in range(ROUNDS):
            if not going.any():
                break
            mine = going[owner]
            element, holder = sets[mine], owner[mine]
            of = scheme[holder]
            parts, spare, least = (table[scheme.clip(0), k] for k in range(3))
            part = (mix(element + np.uint64((turn + 1) * int(_STEP) & _MASK)) % parts[holder].astype(np.uint64)).astype(np.int64)
            base = np.concatenate([[0], np.cumsum(np.where(going, parts, 0))])
            cell = base[holder] + part
            full = np.bincount(cell, minlength=base[-1])
            total = np.zeros(base[-1], dtype=np.uint64)
            np.add.at(total, cell, mix(element ^ np.uint64(0x5851F42D4C957F2D)))
            cell_of = np.repeat(np.arange(len(sizes)), np.where(going, parts, 0))
            place = np.arange(base[-1]) - base[cell_of]
            says = full >= least[cell_of]
            poor = np.bincount(cell_of, ~says, minlength=len(sizes)) > spare
            if turn == ROUNDS - 1:
                says |= poor[cell_of]
            label = (scheme[cell_of].astype(np.uint64) << np.uint64(40)) ^ (np.uint64(turn) << np.uint64(36)) ^ place.astype(np.uint64)
            out.append(mix(total[says] + mix(label[says] * _STEP)))
            who.append(cell_of[says])
            where.append(scheme[cell_of[says]])
            going = going & poor
    return np.concatenate(out), np.concatenate(who), np.concatenate(where)


def sketches(sets: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """The sketch of every set: bits to a power of two, 64 at least and not fewer than shingles; none of an empty set."""
    out = []
    for first, last in zip(begins[:-1].tolist(), begins[1:].tolist()):
        n = max(64, 1 << (last - first - 1).bit_length()) if last > first else 0
        flips = np.bincount((sets[first:last] & np.uint64(max(n, 1) - 1)).astype(np.int64), minlength=n)
        out.append(np.packbits((flips & 1).astype(bool)).tobytes() if n else b"")
    return out


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of the same set with fewer bits: shingles that met in none of its bits may meet in one."""
    out = np.frombuffer(sketch, dtype=np.uint8)
    while len(out) > size:
        out = out[:len(out) // 2] ^ out[len(out) // 2:]
    return out.view(np.uint64)


def near(sizes: list[int], found: list[bytes], join: Join) -> list[tuple[int, int]]:
    """Pairs that span every component of the sets that may link by size and sketch."""
    least = min(len(x) for x in found)
    bits, n = np.stack([folded(x, least) for x in found]), np.array(sizes)
    rest, out = np.arange(len(n)), []
    while len(rest) > 1:
        queries, rest = [int(rest[0])], rest[1:]
        while queries and len(rest):
            query = queries.pop()
            most = n[rest] + n[query] - 2 * join.need(n[rest], n[query])
            may = (np.bitwise_count(bits[rest] ^ bits[query]).sum(axis=1) <= most) & (np.abs(n[rest] - n[query]) <= most)
            queries += rest[may].tolist()
            out += [(query, x) for x in rest[may].tolist()]
            rest = rest[~may]
    return out


def _set_keys(sets: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set; empty sets have zeros."""
    keys = []
    for salt in (0xA24BAED4963EE407, 0x9FB21C651E98DF25):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets ^ np.uint64(salt)))])
        keys.append(mix(total[begins[1:]] - total[begins[:-1]] + np.diff(begins).astype(np.uint64) * _STEP) * (np.diff(begins) > 0))
    return keys[0].astype(np.int64), keys[1].astype(np.int64)


def _encoded(column: pa.Array) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def _described(source: DataFrame, join: Join) -> DataFrame:
    """``id, n, k1, k2, sigs, sketch`` for every row; equal sets of one task sign once, and only there they have a sketch."""
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("k1", T.LongType()),
                           T.StructField("k2", T.LongType()), T.StructField("sigs", T.ArrayType(T.StructType([
                               T.StructField("sig", T.LongType()), T.StructField("grade", T.IntegerType())]))),
                           T.StructField("sketch", T.BinaryType())])

    sketched = join.chancy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: set[int] = set()
        for batch in batches:
            texts = _encoded(batch.column(1))
            for first, last in groups([len(t) for t in texts], _TOGETHER):
                sets, begins = shingles(texts[first:last], join.words)
                k1, k2 = _set_keys(sets, begins)
                if len(signed) > 1_000_000:
                    signed.clear()
                new = np.array([k not in signed and not signed.add(k) for k in k1.tolist()], dtype=bool)
                sizes = np.where(new, np.diff(begins), 0)
                keep = np.repeat(new, np.diff(begins))
                signing = sets[keep], np.concatenate([[0], np.cumsum(sizes)])
                sigs, who, where = signatures(*signing, join)
                order = np.argsort(who, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=last - first))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(np.diff(begins)), pa.array(k1), pa.array(k2),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                         [pa.array(sigs[order].astype(np.int64)), pa.array(where[order].astype(np.int32))], ["sig", "grade"])),
                     pa.array(sketches(*signing), pa.binary()) if sketched else pa.nulls(last - first, pa.binary())], schema.names)
        pa.default_memory_pool().release_unused()  # the worker stays for tasks of other stages

    return source.mapInArrow(run, schema)


class Lists:
    """Inverted lists over the sets of one task."""

    def __init__(self, sets: list[np.ndarray], join: Join):
        self.sets, self.join = sets, join
        tokens = np.concatenate(sets)
        docs = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")  # lists come out sorted by set
        tokens, self.docs = tokens[order], docs[order]
        first = np.ones(len(tokens), dtype=bool)
        first[1:] = tokens[1:] != tokens[:-1]
        self.begin = np.append(np.flatnonzero(first), len(tokens))
        place = np.empty(len(tokens), dtype=np.int64)
        place[order] = np.cumsum(first) - 1
        self.lists = np.split(place, np.cumsum([len(s) for s in sets])[:-1])
        self.length = np.diff(self.begin)
        self.key = self.docs + np.repeat(np.arange(len(self.length)), self.length) * len(sets)
        self.sizes = np.array([len(s) for s in sets])

    def search(self, query: int, skip) -> Iterator[int]:
        """Sets behind the query in number that link with it, the most promising first; ``skip(sets)`` tells which are not wanted any more."""
        lists = self.lists[query]
        n, length = len(lists), self.length[lists]
        lists, length = lists[length > 1], length[length > 1]
        need = self.join.need(n, -(-n * self.join.num // self.join.den))
        if len(lists) < need:
            return
        # T / (mu log M + 1) long lists, as DivideSkip has it
        long = min(need - 1, int(need / (0.05 * np.log2(length.max()) + 1)), len(lists))
        order = np.argsort(length, kind="stable")
        lists, length = lists[order], length[order]
        short = len(lists) - long
        spans = [self.docs[self.begin[x]:self.begin[x + 1]] for x in lists[:short].tolist()]
        if not spans:
            return
        found, count = np.unique(np.concatenate(spans), return_counts=True)  # merge of the short lists
        keep = (found > query) & (count >= need - long)
        found, count = found[keep], count[keep]
        wanted = self.join.need(n, self.sizes[found])
        keep = (count + long >= wanted) & (self.sizes[found] * self.join.num <= n * self.join.den) & (n * self.join.num <= self.sizes[found] * self.join.den)
        found, count, wanted = found[keep], count[keep], wanted[keep]
        best = np.argsort(-count, kind="stable")
        probes = lists[short:] * len(self.sets)
        for i in best.tolist():
            doc = int(found[i])
            if skip(doc):
                continue
            at = np.searchsorted(self.key, probes + doc)  # binary probes of the long lists
            at[at == len(self.key)] = 0
            if count[i] + int((self.key[at] == probes + doc).sum()) >= wanted[i]:
                yield doc


def linked(sets: list[np.ndarray], tiles: list[int], join: Join) -> list[tuple[int, int]]:
    """Links that span every component of the sets; with two tiles only links between them are looked for, and those inside them skipped."""
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index, out = Lists(sets, join), []
    two = len(set(tiles)) > 1
    for query in range(len(sets)):
        for other in index.search(query, lambda d: root(d) == root(query) or (two and tiles[d] == tiles[query])):
            parent[root(other)] = root(query)
            out.append((query, other))
    return out


def links(df: DataFrame, id_col: str, text_col: str, join: Join) -> tuple[DataFrame, DataFrame]:
    """Sets of all rows, ``id, n, k1, k2``, and spanning links between classes, ``a, b``: the smallest ids of two classes.

    Every component of the whole link graph is spanned, though not every link is listed.
    """
    source = _source(df, id_col, text_col)
    kind = source.schema["id"].dataType
    described = materialise(_described(source, join), "sets")
    classes = described.filter("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("n").alias("n"))
    # a set stands once in the graph for each grade it signs for, so that blocks do not chain through the grades
    node = F.xxhash64("k1", "grade")
    signed = described.select("k1", F.inline("sigs")).select(node.alias("b"), "sig")
    hub = Window.partitionBy("sig").orderBy("b")
    first = F.min("b").over(hub.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if join.chancy():
        # the place of a row and whether one follows tell signatures of two rows, which need no name
        several = (F.row_number().over(hub) > 2) | F.lead("b").over(hub).isNotNull()
        stars = signed.withColumns({"a": first, "several": several}).filter("a <> b")
        stars = materialise(stars.select(F.when(F.col("several"), F.col("sig")).alias("sig"), "a", "b"), "stars")
        shown = described.filter("size(sigs) > 0").select("k1", "n", "sketch", F.explode(F.array_distinct("sigs.grade")).alias("grade"))
        blocks = components(_may_link(stars, shown.select(node.alias("node"), "n", "sketch"), join))
    else:
        blocks = components(signed.withColumn("a", first).filter("a <> b").select("a", "b"))
    bounds = F.array(*[F.lit(x) for x in join.grades(classes.agg(F.max("n")).first()[0] or 0)])
    grade = F.size(F.filter(bounds, lambda x: x <= F.col("n"))) - 1
    graded = classes.filter("rep is not null").withColumn("grade", F.explode(F.array(grade, grade - 1)))
    members = materialise(graded.withColumn("node", node).join(blocks, "node").select("component", "rep", "k1", "k2", "n"), "blocks")
    sizes = members.groupBy("component").agg(F.sum("n").alias("all"), F.count("*").alias("members")).filter("members > 1") \
        .select("component", F.ceil(F.col("all") / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    placed = members.join(sizes, "component").withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))) \
        .select("rep", "k1", "k2", F.struct("component", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile").alias("unit"))
    placed = materialise(placed.groupBy("rep", "k1", "k2").agg(F.collect_list("unit").alias("units")), "units")
    small = placed.count() <= MOST_SENT
    found = source.join(F.broadcast(placed) if small else placed, source["id"] == placed["rep"]) \
        .select("id", "text", "units", "k1", "k2")
    return described.drop("sigs", "sketch"), _searched(found, kind, join)


def _may_link(stars: DataFrame, shown: DataFrame, join: Join) -> DataFrame:
    """Links ``a, b`` that connect sets of one signature which may link by their sketches.

    ``stars`` has ``sig, a, b``: the first set of a signature, null if it has two sets only, and each other one. Where all others may link
    with the first, that is all; the sets of any other signature are compared with each other.
    """
    used = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    shown = materialise(shown.join(used, "node").dropDuplicates(["node"]), "sketches")
    one, two = (shown.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")
    pairs = stars.select("a", "b").distinct().join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    judged = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("may", T.BooleanType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in range(2, 6)))
            may = [bool(near([n, m], [x, y], join)) for n, m, x, y in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(may, pa.bool_())], judged.names)

    pairs = materialise(pairs.mapInArrow(judge, judged), "judged")
    # signatures of two sets are settled by their pair
    stars = stars.filter("sig is not null")
    told = stars.join(pairs, ["a", "b"]).groupBy("sig").agg(F.count("*").alias("others"), F.bool_and("may").alias("all"))
    unsettled = stars.join(told.filter("others > 1 and not all").select("sig"), "sig")
    members = unsettled.select("sig", F.col("b").alias("node")).unionByName(unsettled.select("sig", F.col("a").alias("node"))).distinct().join(shown, "node")
    members = materialise(members, "members")
    sizes = members.groupBy("sig").agg(F.ceil(F.sum(F.length("sketch")) / SKETCH_TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    met = members.join(sizes, "sig").withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))) \
        .select(F.struct("sig", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")).alias("unit"), "node", "n", "sketch")
    result = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def done():
            nodes, sizes, found = zip(*held)
            links = near(list(sizes), list(found), join)
            return pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in links], pa.int64()) for k in (0, 1)], result.names)

        for batch in batches:
            units = zip(*(x.to_pylist() for x in batch.column(0).flatten()))
            for row in zip(units, *(c.to_pylist() for c in batch.columns[1:])):
                if row[0] != unit:
                    if held:
                        yield done()
                    unit, held = row[0], []
                held.append(row[1:])
        if held:
            yield done()

    met = met.repartition("unit").sortWithinPartitions("unit").mapInArrow(compare, result)
    return pairs.filter("may").select("a", "b").unionByName(met)


def _searched(found: DataFrame, kind: T.DataType, join: Join) -> DataFrame:
    """Links from the texts of all block members, ``id, text, units, k1, k2``; rows of another text under a repeated id are passed over."""
    shipped = T.StructType([T.StructField("unit", T.ArrayType(T.LongType())), T.StructField("id", kind), T.StructField("tile", T.IntegerType()),
                            T.StructField("tokens", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_type

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _encoded(batch.column(1))
            for first, last in groups([len(t) for t in texts], _TOGETHER):
                sets, begins = shingles(texts[first:last], join.words)
                own = zip(*(x.tolist() for x in _set_keys(sets, begins)))
                wanted = zip(*(batch.column(c).slice(first, last - first).to_pylist() for c in (3, 4)))
                right = [t for t, (x, y) in enumerate(zip(own, wanted)) if x == y]
                rows = [([u["component"], u["i"], u["j"]], batch.column(0)[first + t].as_py(), u["tile"],
                         sets[begins[t]:begins[t + 1]].tobytes())
                        for t in right for u in batch.column(2)[first + t].as_py()]
                for at in range(0, len(rows), 512):
                    yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*rows[at:at + 512]), shipped)],
                                                     shipped.names)
        pa.default_memory_pool().release_unused()

    result = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def done():
            rows = sorted({(r[0], r[2]): r for r in held}.values(), key=lambda r: (len(r[2]), r[0]))
            ids = [r[0] for r in rows]
            pairs = linked([np.frombuffer(r[2], dtype=np.uint64) for r in rows], [r[1] for r in rows], join) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[p[k]] for p in pairs], to_arrow_type(kind)) for k in (0, 1)], result.names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != unit:
                    if held:
                        yield done()
                    unit, held = row[0], []
                held.append(row[1:])
        if held:
            yield done()

    units = found.mapInArrow(cut, shipped)
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(search, result)


def join_components(df: DataFrame, id_col: str, text_col: str, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``id_col, n_shingles, component_id`` for every row: the smallest id that links reach, its own included.

    Shingles of ``words`` words; links join sets with ``den * common >= num * all``. Rows with equal sets are linked. Null, empty and
    wordless texts have no shingle and no link. Repeated ids share a component through their equal id; null ids never are a
    component's name unless the row stands alone. Other columns are not read; an empty table gives an empty result.
    """
    join = Join(words, num, den)
    sets, found = links(df, id_col, text_col, join)
    joined = components(materialise(found, "links"))
    classes = sets.filter("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    named = classes.join(joined, classes["rep"] == joined["node"], "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    # classes of one row need no name; the others are few, and a class with many rows is split by the join
    return sets.join(named, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"))
