"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

The tokens of a batch are Arrow lists. They are flattened, parent indices say which text a token is of, and a cumulative sum of the
tokens' byte lengths, started anew for every text, gives the place where each ends. A hash join of the two sides on (text, end) then
aligns them: ends that both sides have are cuts between groups; every end of either side closes a stretch that one token of each side
covers, and that is a link. Links are counted once a document with ``Table.group_by``; Spark adds the partial counts.

Both tokenizers never merge across a space that stands between two other characters (the second's vocabulary is looked at when it is
loaded; if it has a piece that could, nothing is cut). Texts are therefore cut there, and a stretch that a worker has met is not encoded
again. Tokens whose bytes do not add up to the text have no place in it; such a text counts as one without tokens.
"""
from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

#: Characters that are aligned at once, stretches that a worker remembers, and their characters.
TOGETHER, REMEMBERED, REMEMBERED_CHARS = 1 << 20, 400_000, 8_000_000
#: Pairs that still go to every task (20 bytes each); beyond it links meet their counts in a shuffle.
MOST_SENT = 2_000_000

_CUT = re.compile(r"(?<=\S) (?=\S)")


def _byte_alphabet() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Numbers(dict):
    """Numbers of stretches in the order in which they come; ``new`` holds those that are not encoded yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        self.new.append(key)
        return number


class _Side:
    """A tokenizer's remembered stretches as an Arrow list array, and its tokens' bytes; tokens that stand for no bytes have none."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = pa.array(tokens, pa.binary())
        self.lengths = pa.array([len(t) for t in tokens], pa.int64())
        self.forget()

    def forget(self) -> None:
        self.lists = pa.array([], pa.list_(pa.int32()))

    def add(self, found: list[list[int]], texts: pa.Array) -> np.ndarray:
        """Keeps the ids of new stretches; says whose bytes are those of the text."""
        new = pa.array(found, self.lists.type)
        self.lists = pa.concat_arrays([self.lists, new])
        joined = pc.binary_join(pa.ListArray.from_arrays(new.offsets, self.tokens.take(new.values)), b"")
        return pc.equal(joined, texts).to_numpy(zero_copy_only=False)


class Aligner:
    """Encodes texts by a byte-level BPE file (first side) and a piece model (second side) and aligns the tokens."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.first = Tokenizer.from_file(byte_level)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        alphabet = _byte_alphabet()
        written = [self.first.id_to_token(i) for i in range(self.first.get_vocab_size())]
        self.a = _Side([bytes(alphabet[c] for c in t) if t is not None and all(c in alphabet for c in t) else b"" for t in written])
        names = [self.second.id_to_piece(i) for i in range(self.second.vocab_size())]
        other = [self.second.is_control(i) or self.second.is_unknown(i) or self.second.is_unused(i) for i in range(len(names))]
        self.b = _Side([b"" if x else bytes([int(p[1:-1], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode("utf-8")
                        for i, (p, x) in enumerate(zip(names, other))])
        self.cuts = not any(re.search("[^▁]▁", p) for p, x in zip(names, other) if not x)
        self.known, self.exact, self.chars = _Numbers(), np.zeros(0, dtype=bool), 0
        marks = [str(i) for i in range(max(len(written), len(names)))]
        # a token's number with what follows it: "," within its side of a group, "|" or ";" after the side, nothing at the end
        self.written = [m + after for m in marks for after in (",", "|", ";", "")]

    def stretches(self, text: str) -> list[str]:
        """The text in stretches that are encoded on their own; each begins with a space, which is left out."""
        return _CUT.split(text) if self.cuts else [text]

    def encode(self, stretches: list[str]) -> np.ndarray:
        """Numbers of the stretches among the remembered ones."""
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.known, self.exact, self.chars = _Numbers(), np.zeros(0, dtype=bool), 0
            self.a.forget()
            self.b.forget()
        out = np.fromiter(map(self.known.__getitem__, stretches), dtype=np.int64, count=len(stretches))
        if self.known.new:
            new, self.known.new = self.known.new, []
            full = [" " + s for s in new]
            texts = pa.array(full).cast(pa.binary())
            first = self.a.add([e.ids for e in self.first.encode_batch_fast(full, add_special_tokens=False)], texts)
            second = self.b.add(self.second.encode(new, num_threads=1), texts)
            self.exact = np.concatenate([self.exact, first & second])
            self.chars += sum(map(len, new))
        return out

    def chunk(self, stretches: list[str], of: np.ndarray, n: int) -> list[tuple] | None:
        """Alignment of the stretches of ``n`` texts (``of`` says of which); None stands for a text whose bytes do not add up."""
        codes = self.encode(stretches)
        bad = np.zeros(n, dtype=bool)
        bad[of[~self.exact[codes]]] = True
        if bad.any():
            codes, of = codes[~bad[of]], of[~bad[of]]
        sides = []
        for side in (self.a, self.b):
            lists = side.lists.take(pa.array(codes))
            ids, doc = pc.list_flatten(lists), pa.array(of).take(pc.list_parent_indices(lists))
            running, doc_np = pc.cumulative_sum(side.lengths.take(ids)).to_numpy(), doc.to_numpy()
            begins = np.searchsorted(doc_np, np.arange(n + 1))
            before = np.concatenate([[0], running])[begins]
            ends = running - before[doc_np]  # the sum starts anew with every text
            sides.append((pa.table({"doc": doc, "end": ends, "id": ids, "at": np.arange(len(ids))}), begins))
        (a, begins_a), (b, begins_b) = sides
        met = a.join(b, ["doc", "end"], join_type="full outer", right_suffix="_b", use_threads=False).sort_by([("doc", "ascending"), ("end", "ascending")])
        both = pc.and_(pc.is_valid(met["id"]), pc.is_valid(met["id_b"]))
        # an end of one side lies in the token of the other that ends next
        links = pa.table({"doc": met["doc"], "a": pc.fill_null_backward(met["id"]), "b": pc.fill_null_backward(met["id_b"])})
        counted = links.group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
        n_links = np.bincount(met["doc"].to_numpy(), minlength=n)
        cuts = met.filter(both)
        n_groups = np.bincount(cuts["doc"].to_numpy(), minlength=n)
        written = self._groups(a["id"].to_numpy(), b["id"].to_numpy(), cuts["at"].to_numpy(), cuts["at_b"].to_numpy())
        begins = begins_a + begins_b
        bounds = np.searchsorted(counted["doc"].to_numpy(), np.arange(n + 1))
        pairs = [counted[c].combine_chunks().cast(pa.int32()) for c in ("a", "b", "count_all")]
        out = []
        for t in range(n):
            if bad[t]:
                out.append(None)
                continue
            text = "".join(map(self.written.__getitem__, written[begins[t]:begins[t + 1]].tolist()))
            lo, size = int(bounds[t]), int(bounds[t + 1] - bounds[t])
            out.append((int(begins_a[t + 1] - begins_a[t]), int(begins_b[t + 1] - begins_b[t]), int(n_groups[t]), int(n_links[t]), text,
                        [p.slice(lo, size) for p in pairs]))
        return out

    @staticmethod
    def _groups(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> np.ndarray:
        """Tokens in the order in which groups are written, as places in ``written``; texts end with a group, its last mark is ``;``."""
        out = np.empty(len(a) + len(b), dtype=np.int64)
        group_a = np.searchsorted(last_a, np.arange(len(a)))
        group_b = np.searchsorted(last_b, np.arange(len(b)))
        sizes_b = np.diff(np.concatenate([[-1], last_b]))
        mark_a, mark_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        mark_a[last_a], mark_b[last_b] = 1, 2
        out[np.arange(len(a)) + (np.cumsum(sizes_b) - sizes_b)[group_a]] = a.astype(np.int64) * 4 + mark_a
        out[np.arange(len(b)) + (last_a + 1)[group_b]] = b.astype(np.int64) * 4 + mark_b
        return out

    def align(self, texts: list[str | None]) -> Iterator[tuple]:
        """``n_a, n_b, n_groups, n_links, digest, a ids, b ids, times`` of every text, in order; links are distinct pairs with a number."""
        pieces: list[tuple[int, list[str], bool]] = []  # text number, stretches, whether they are its last
        size, state = 0, None

        def flush() -> Iterator[tuple]:
            nonlocal state, size
            numbers = sorted({t for t, _, _ in pieces})
            stretches = [s for _, part, _ in pieces for s in part]
            place = {t: i for i, t in enumerate(numbers)}
            of = np.repeat([place[t] for t, _, _ in pieces], [len(part) for _, part, _ in pieces]).astype(np.int64)
            ended = {t for t, _, last in pieces if last}
            for t, found in zip(numbers, self.chunk(stretches, of, len(numbers)) if stretches else [None] * len(numbers)):
                state = state or _State()
                state.add(found)
                if t in ended:
                    yield state.result()
                    state = None
            pieces.clear()
            size = 0

        for t, text in enumerate(texts):
            if not text:
                if pieces:
                    yield from flush()
                yield _State().result()
                continue
            part: list[str] = []
            if size + len(text) < TOGETHER:
                pieces.append((t, self.stretches(text), True))
                size += len(text) + 1
                continue
            for stretch in self.stretches(text):
                part.append(stretch)
                size += len(stretch) + 1
                if size >= TOGETHER:
                    pieces.append((t, part, False))
                    yield from flush()
                    part = []
            pieces.append((t, part, True))
        if pieces:
            yield from flush()


class _State:
    """What has been found of a text that may span several chunks."""

    def __init__(self):
        self.counts, self.bad = [0, 0, 0, 0], False
        self.digest, self.pairs, self.held = hashlib.sha256(), [], ""

    def add(self, found: tuple | None) -> None:
        if found is None:
            self.bad = True
            return
        *counts, text, pairs = found
        self.counts = [x + y for x, y in zip(self.counts, counts)]
        text = self.held + text
        self.digest.update(text[:-1].encode())
        self.held = text[-1:]  # the mark after the last group is not written
        self.pairs.append(pairs)

    def result(self) -> tuple:
        none = pa.array([], pa.int32())
        if self.bad or not self.pairs:
            return 0, 0, 0, 0, "", none, none, none
        if len(self.pairs) == 1:
            pairs = self.pairs[0]
        else:
            table = pa.concat_tables(pa.table(p, ["a", "b", "n"]) for p in self.pairs)
            table = table.group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")])
            pairs = [table[c].combine_chunks().cast(pa.int32()) for c in ("a", "b", "n_sum")]
        return *self.counts, self.digest.hexdigest(), *pairs


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(first: str, second: str) -> Aligner:
    key = (first, second)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(SparkFiles.get(first), SparkFiles.get(second))
    return _ALIGNERS[key]


def tokens(df: DataFrame, id_col: str, text_col: str, byte_level: str, pieces: str) -> DataFrame:
    """Alignment of every text: ``id, n_a, n_b, n_groups, n_links, groups_sha256`` and its distinct links ``pa, pb, pn`` (ids, times)."""
    names = []
    for path in (byte_level, pieces):
        df.sparkSession.sparkContext.addFile(path)
        names.append(path.rsplit("/", 1)[-1])
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    long, lists = T.LongType(), T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), *[T.StructField(c, long) for c in ("n_a", "n_b", "n_groups", "n_links")],
                           T.StructField("groups_sha256", T.StringType()), *[T.StructField(c, lists) for c in ("pa", "pb", "pn")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*names)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = list(aligner.align(part.column(1).to_pylist()))
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)] + [pa.array([r[4] for r in rows], pa.string())]
                for k in (5, 6, 7):
                    offsets = np.concatenate([[0], np.cumsum([len(r[k]) for r in rows])])
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays([r[k] for r in rows])))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema.names)

    return source.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, n, best``: the documents that hold a pair linked, and whether no pair of the same first id is in more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table({"a": pc.list_flatten(batch.column(0)), "b": pc.list_flatten(batch.column(1))})
            yield from table.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")]).to_batches()

    counts = materialise(aligned.select("pa", "pb").mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    top = counts.groupBy("a").agg(F.max("n").alias("__top"))  # a row for each id of a vocabulary
    return counts.join(F.broadcast(top), "a").select("a", "b", "n", (F.col("n") == F.col("__top")).alias("best"))


def align(df: DataFrame, id_col: str, text_col: str, byte_level: str, pieces: str, most_sent: int = MOST_SENT) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row.

    The first side is a byte-level BPE file, which gets a space and the text; the second a piece model that adds the space itself. Groups
    are written ``a1,a2|b1;a3|b2,b3``. A pair's count is the number of rows that hold it linked: ``count_sum`` adds the counts of a
    row's links, ``n_best`` counts those whose count is the highest of their first id.
    A null or empty text, or one whose tokens do not give back its bytes, has zeros and an empty string. Rows with one id, or with none,
    and equal rows are documents of their own; other columns are not read. A stretch without spaces is encoded as a whole.
    """
    spark = df.sparkSession
    aligned = materialise(tokens(df, id_col, text_col, byte_level, pieces), "aligned").withColumn("row", F.monotonically_increasing_id())
    counts = materialise(pair_counts(aligned), "counts")
    kept = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    if counts.count() > most_sent:
        links = aligned.select("row", F.inline(F.arrays_zip("pa", "pb", "pn"))).toDF("row", "a", "b", "times").join(counts, ["a", "b"])
        summed = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                          F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        out = aligned.select("row", *kept).join(summed, "row", "left")
    else:
        rows = counts.toArrow()
        key = rows["a"].to_numpy().astype(np.int64) << 32 | rows["b"].to_numpy()
        order = np.argsort(key)
        sent = spark.sparkContext.broadcast((key[order], rows["n"].to_numpy()[order], rows["best"].to_numpy(zero_copy_only=False)[order]))
        fields = aligned.schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, n, best = sent.value
            for batch in batches:
                a, b, times = (pc.list_flatten(batch.column(c)).to_numpy().astype(np.int64) for c in ("pa", "pb", "pn"))
                row = pc.list_parent_indices(batch.column("pa")).to_numpy()
                at = np.searchsorted(keys, a << 32 | b)
                begins = np.searchsorted(row, np.arange(batch.num_rows + 1))
                sums = []
                for value in (np.where(best[at], times, 0), times * n[at]):
                    total = np.concatenate([[0], np.cumsum(value)])
                    sums.append(pa.array(total[begins[1:]] - total[begins[:-1]]))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *sums], [*kept, "n_best", "count_sum"])

        schema = T.StructType([fields[c] for c in kept] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
        out = aligned.select(*kept, "pa", "pb", "pn").mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")],
                      "groups_sha256")
