"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware control of false discoveries.

A candidate is a run of at least twenty token characters that no fixed pattern has claimed. Its encoding is inferred from its
alphabet. Three tests ask whether it could be random in that encoding: chi-squared uniformity over groups of symbols, the number of
runs above and below the middle symbol, and the serial correlation of neighbours; Fisher's method joins them. A fourth figure is the
probability that ordinary writing would look as random, from the likelihood ratio of the two. The Benjamini-Hochberg rule, applied to
the latter within classes of length over the whole corpus, decides which candidates are findings; of these only the ones that pass for
random are kept. A class's p-values are counted in bins, so the rule needs a small table whatever the size of the corpus.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
SHORTEST = 20
_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST)
#: Lower bounds of the length classes within which discoveries are counted.
LENGTHS = (20, 24, 32, 48, 80)
FALSE_DISCOVERIES = 0.001
#: A candidate less likely than this to be random in its encoding is none.
RANDOM_AT_LEAST = 0.001
_BINS_PER_DECADE = 20

# Letters from frequent to rare in European writing, and their rough shares in percent.
_LETTERS = "eatinosrlhdcumfpgwbyvkxjqz"
_SHARES = (12.5, 8.5, 7.8, 7.5, 7.2, 7.2, 6.8, 6.5, 4.5, 4.2, 4.2, 3.5, 3.5, 3.0, 2.0, 2.0, 1.8, 1.4, 1.4, 1.2, 1.2, 0.7, 0.3, 0.3, 0.2, 0.2)
_UPPER, _DIGIT, _OTHER = 0.03, 0.02, 0.01  # shares of the other characters inside a run of writing
_RANK = {c: i for i, c in enumerate(_LETTERS)}
_WRITING = {c: (1 - _UPPER - _DIGIT - _OTHER) * s / sum(_SHARES) for c, s in zip(_LETTERS, _SHARES)}
_WRITING |= {c.upper(): _UPPER * s / sum(_SHARES) for c, s in zip(_LETTERS, _SHARES)}
_WRITING |= {c: _DIGIT / 10 for c in "0123456789"} | {c: _OTHER / 5 for c in "+/_-="}

# Encodings from narrow to wide: symbols in an order in which ordinary writing is uneven.
ENCODINGS = {
    "decimal": "0123456789", "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "lower": _LETTERS, "upper": _LETTERS.upper(),
    "base32": _LETTERS.upper() + "234567", "base36": _LETTERS + "0123456789", "BASE36": _LETTERS.upper() + "0123456789",
    "letters": _LETTERS + _LETTERS.upper(), "base62": _LETTERS + _LETTERS.upper() + "0123456789",
    "base64": _LETTERS + _LETTERS.upper() + "0123456789+/", "base64url": _LETTERS + _LETTERS.upper() + "0123456789-_",
    "token": _LETTERS + _LETTERS.upper() + "0123456789+/-_",
}
_SETS = {k: frozenset(v) for k, v in ENCODINGS.items()}
_PLACES = {k: {c: i for i, c in enumerate(v)} for k, v in ENCODINGS.items()}


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution (Wilson-Hilferty; exact for even degrees up to 12)."""
    if x <= 0:
        return 1.0
    if df % 2 == 0 and df <= 12:
        term = total = 1.0
        for i in range(1, df // 2):
            term *= x / 2 / i
            total += term
        return min(1.0, math.exp(-x / 2) * total)
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return normal_tail(z)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer_encoding(run: str) -> str:
    """Narrowest encoding that has all symbols of the run.

    >>> infer_encoding("00ff"), infer_encoding("Zm9v")
    ('hex', 'base62')
    """
    symbols = set(run)
    return next((k for k, s in _SETS.items() if symbols <= s), "token")


def battery(run: str) -> tuple[float, float]:
    """How likely a random run in its encoding would look at least as uneven, and ordinary writing at least as random."""
    body = run.rstrip("=")
    name = infer_encoding(body)
    place, width, n = _PLACES[name], len(ENCODINGS[name]), len(body)
    codes = [place[c] for c in body]
    groups = max(2, min(width, n // 5))
    counts = [0] * groups
    for c in codes:
        counts[c * groups // width] += 1
    shares = [0] * groups
    for c in range(width):
        shares[c * groups // width] += 1
    chi = sum((got - n * s / width) ** 2 / (n * s / width) for got, s in zip(counts, shares))
    p_uniform = chi2_tail(chi, groups - 1) if groups > 2 else math.erfc(math.sqrt(chi / 2))

    high = [c >= width / 2 for c in codes]
    ups = sum(high)
    downs = n - ups
    if ups and downs:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 1 + 2 * ups * downs / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * spread)) if spread > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    middle = sum(codes) / n
    spread = sum((c - middle) ** 2 for c in codes)
    if spread:
        serial = sum((a - middle) * (b - middle) for a, b in zip(codes, codes[1:])) / spread
        p_serial = math.erfc(abs(serial * math.sqrt(n)) / math.sqrt(2))
    else:
        p_serial = 0.0
    joint = -2 * sum(math.log(max(p, 1e-300)) for p in (p_uniform, p_runs, p_serial))
    p_random = chi2_tail(joint, 6)

    # under writing the log likelihood ratio is a sum of n terms; a normal tail with the moments of one term
    terms = {c: -math.log(width * p) for c, p in _WRITING.items()}
    mean = sum(p * terms[c] for c, p in _WRITING.items())
    spread = sum(p * (terms[c] - mean) ** 2 for c, p in _WRITING.items())
    score = sum(terms[c] for c in (body.lower() if body.isalpha() and body.isupper() else body))  # shouted words are writing, too
    return p_random, max(normal_tail((score - n * mean) / math.sqrt(n * spread)), 1e-300)


def fixed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and non-overlapping within a kind."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if max(map(len, text.split()), default=0) >= SHORTEST:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
        found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int, float, float]]:
    """Runs that no fixed span touches: start, end and the two probabilities."""
    if max(map(len, text.split()), default=0) < SHORTEST:
        return []
    out = []
    for m in _RUN.finditer(text):
        start, end = m.span()
        if not any(a < end and start < b for _, a, b in taken):
            out.append((start, end, *battery(m[0])))
    return out


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                      T.StructField("p_random", T.DoubleType()), T.StructField("p_writing", T.DoubleType())])
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("p_random", pa.float64()),
                         ("p_writing", pa.float64())])


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def _measured(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All fixed spans and all candidates of every text."""
    source = _source(df, id_col, text_col)
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("spans", T.ArrayType(_SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for value in batch.column(1):
                text = value.as_py()
                fixed = fixed_spans(text)
                spans.append([dict(kind=k, start=a, end=b, p_random=None, p_writing=None) for k, a, b in fixed]
                             + [dict(kind="random", start=a, end=b, p_random=p, p_writing=q) for a, b, p, q in candidates(text, fixed)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_ARROW_SPAN))], ["id", "spans"])

    return source.mapInArrow(run, schema)


def length_class(length: int) -> int:
    return sum(length >= x for x in LENGTHS) - 1


def _bin(p: float) -> int:
    """Bin of a p-value; all of a bin are at most its upper edge."""
    return int(-math.log10(p) * _BINS_PER_DECADE)


def discovery_bins(counts: list[tuple[int, int, int]], rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """Benjamini-Hochberg per length class over binned p-values: class -> least bin that is a discovery."""
    least: dict[int, int] = {}
    for group in {g for g, _, _ in counts}:
        rows = sorted(((b, n) for g, b, n in counts if g == group), reverse=True)
        total, seen = sum(n for _, n in rows), 0
        for b, n in rows:
            seen += n
            if 10 ** (-b / _BINS_PER_DECADE) <= rate * seen / total:
                least[group] = b
    return least


def _thresholds(measured: DataFrame) -> dict[int, int]:
    """Counts per length class and bin reach the driver: at most 6,000 lines for each class."""
    found = measured.select(F.explode("spans").alias("s")).filter(F.col("s.kind") == "random").select(
        _class_column(F.col("s.end") - F.col("s.start")).alias("g"),
        F.floor(-F.log10("s.p_writing") * _BINS_PER_DECADE).cast("int").alias("b"))
    return discovery_bins([(r["g"], r["b"], r["count"]) for r in found.groupBy("g", "b").count().collect()])


def _class_column(length):
    out = F.lit(-1)
    for x in LENGTHS:
        out = out + (length >= x).cast("int")
    return out


def scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Secrets of every text: ``id_col, spans`` with ``kind, start, end, p_random, p_writing`` in code points, end exclusive.

    Spans are ordered by start and then kind (assign, access, hex, random); random ones touch no span of a fixed pattern. A null or
    empty text has none. Repeated rows give repeated rows; the discovery rule counts every row. Other columns are not read.
    """
    measured = materialise(_measured(df, id_col, text_col), "secrets")
    least = _thresholds(measured)
    limits = F.array(*[F.lit(least.get(g, 1 << 30)) for g in range(len(LENGTHS))])
    kept = F.filter("spans", lambda s: (s["kind"] != "random") | (
        (s["p_random"] >= RANDOM_AT_LEAST) & (F.floor(-F.log10(s["p_writing"]) * _BINS_PER_DECADE)
                                              >= F.get(limits, _class_column(s["end"] - s["start"])))))
    order = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("at"), F.array_position(order, s["kind"]).alias("rank"),
                                                               s.alias("span"))))
    return measured.select(F.col("id").alias(id_col), F.transform(ranked, lambda r: r["span"]).alias("spans"))


def span_text(spans):
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(df: DataFrame, id_col: str, text_col: str, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``df`` with every secret replaced by ``mark``; overlapping spans become one mark, null texts stay null.

    Two passes over the texts: the first measures candidates for the discovery rule, the second replaces.
    """
    least = _thresholds(_measured(df, id_col, text_col))

    def clean(text: str) -> str:
        fixed = fixed_spans(text)
        spans = [(a, b) for _, a, b in fixed] + [
            (a, b) for a, b, p, q in candidates(text, fixed)
            if p >= RANDOM_AT_LEAST and _bin(q) >= least.get(length_class(b - a), 1 << 30)]
        if not spans:
            return text
        out, at = [], 0
        for a, b in sorted(spans):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join(out) + text[at:]

    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([None if (t := v.as_py()) is None else clean(t) for v in batch.column(place)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == place else c for i, c in enumerate(batch.columns)], batch.schema.names)

    # columns travel by number, whatever their names are
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*df.columns)
