"""Delimited files with the reader conventions of the analysis: all text, NA tokens as null, long lines dropped."""
from __future__ import annotations

import csv as _csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import null_if_missing
from .records import read_records
from .tables import ROW_ID, quoted

CANDIDATES = [",", ";", "\t", "|"]
SAMPLE_LINES = 200
_OVERFLOW, _RAW = "_overflow", "_corrupt_record"
_ROWS_PER_SPLIT = 1 << 33


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 when every line is valid UTF-8, otherwise Latin-1; stops at the first invalid line."""
    lines = spark.read.text(path)
    return "UTF-8" if lines.where(~F.is_valid_utf8("value")).isEmpty() else "ISO-8859-1"


def sample_lines(spark: SparkSession, path: str, encoding: str, n: int = SAMPLE_LINES) -> list[str]:
    rows = spark.read.text(path).select(F.encode(F.col("value"), "utf-8") if encoding == "UTF-8"
                                        else F.col("value").cast("binary")).limit(n).collect()
    codec = "utf-8" if encoding == "UTF-8" else "latin-1"
    lines = [bytes(r[0]).decode(codec, "replace") for r in rows]
    if lines:
        lines[0] = lines[0].removeprefix("﻿").removeprefix("ï»¿")
    return lines


def _split(line: str, delimiter: str) -> list[str]:
    return next(_csv.reader(io.StringIO(line), delimiter=delimiter), [])


def detect_delimiter(lines: list[str]) -> str:
    """The candidate that cuts most sampled lines into as many fields as the header."""
    lines = [ln for ln in lines if ln.strip()]
    if not lines:
        return ","

    def score(d: str) -> tuple[int, int]:
        width = len(_split(lines[0], d))
        if width < 2:
            return (0, 0)
        return (sum(len(_split(ln, d)) == width for ln in lines), width)

    return max(CANDIDATES, key=score)


def header_names(line: str, delimiter: str) -> list[str]:
    """Trimmed header; blank names get a position, repeated ones a counter."""
    seen: dict[str, int] = {}
    names = []
    for i, raw in enumerate(_split(line, delimiter)):
        name = raw.strip() or f"Unnamed: {i}"
        if name in seen:
            seen[name] += 1
            name = f"{name}.{seen[name]}"
        else:
            seen[name] = 0
        names.append(name)
    return names


def _file_headers(spark: SparkSession, path: str, encoding: str) -> list[tuple[str, str]]:
    """First line that is not blank of every file, in order of file names.

    Places are compared before texts are read, so that the first pass keeps a number per file only.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                                         F.monotonically_increasing_id().alias("_at"), "value")
    lines = lines.where((F.col("_start") == 0) & (F.trim("value") != ""))
    firsts = lines.groupBy("_file").agg(F.min("_at").alias("_at"))
    found = lines.join(F.broadcast(firsts), ["_file", "_at"]).select("_file", F.col("value").cast("binary").alias("value")).collect()
    codec = "utf-8" if encoding == "UTF-8" else "latin-1"
    return sorted((r["_file"], bytes(r["value"]).removeprefix(b"\xef\xbb\xbf").decode(codec, "replace")) for r in found)


def _layouts(heads: list[tuple[str, str]], delimiter: str) -> tuple[list[str], dict[tuple[int, ...], list[str]]]:
    """Names of the first file, and for every order of them the files that have it: the place of each name among a file's fields."""
    names = header_names(heads[0][1], delimiter)
    orders: dict[tuple[int, ...], list[str]] = {}
    for file, line in heads:
        own = header_names(line, delimiter)
        if sorted(own) != sorted(names):
            raise ValueError(f"{file} has the columns {own}, {heads[0][0]} has {names} (separator {delimiter!r})")
        orders.setdefault(tuple(own.index(n) for n in names), []).append(file)
    return names, orders


def trim_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def _count(line: Column, delimiter: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(delimiter), F.lit("")))


def separators(line: Column, delimiter: str) -> Column:
    """Separators outside quoted fields; a quote opens a field at its start only."""
    # doubled quotes go first: a pattern with a choice inside its loop overruns the stack on a long field
    bare = F.regexp_replace(F.replace(line, F.lit('""'), F.lit("")), f'(^|\\Q{delimiter}\\E)"[^"]*+"', "$1")
    # most lines have no quote at all: the pattern is not tried on them
    return F.when(F.contains(line, F.lit('"')), _count(bare, delimiter)).otherwise(_count(line, delimiter))


def na_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[null_if_missing(quoted(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType)
                       else quoted(f.name) for f in df.schema.fields])


def _number_rows(raw: DataFrame) -> DataFrame:
    """Row ids in the order of file names and positions, however the scan packs its splits into tasks; ``_file`` stays.

    A split's rows are consecutive in its task, so the place of a row is that of its split and its distance from the split's first row.
    One line per split is counted in a first pass over the file.
    """
    split, at = ["_file", "_start"], F.col("_at")
    placed = raw.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"),
                              "_at": F.monotonically_increasing_id()})
    firsts = placed.groupBy(*split).agg(F.min(at).alias("_first")).orderBy(*split).collect()
    listing = raw.sparkSession.createDataFrame([(r["_file"], r["_start"], r["_first"], i) for i, r in enumerate(firsts)],
                                               "_file string, _start bigint, _first bigint, _place bigint")
    # a line per split: past a size no executor should hold, Spark joins it by shuffle
    joined = placed.join(F.broadcast(listing) if len(firsts) <= 200_000 else listing, split)
    return joined.withColumn(ROW_ID, F.col("_place") * F.lit(_ROWS_PER_SPLIT) + at - F.col("_first")).drop("_start", "_at", "_first", "_place")


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None,
             multi_line: bool = False) -> DataFrame:
    """All columns as text with ``_row_id``; lines with too many fields are dropped, short ones padded with null.

    An extra column catches overflow: a line is too long when it fills that column, when it parses with exactly
    one field too many (nothing is reported as malformed), or when it has more separators than the header.
    Quoted line breaks need ``multi_line``: two passes over the files, in which every split is a task of its own (``records``).

    The files of a folder may have their columns in different orders: each is read by its own header, and columns come in the order of
    the first file by name. A file with other columns or another separator is refused. The separator is found on the first 200 lines.
    """
    encoding = encoding or detect_encoding(spark, path)
    lines = sample_lines(spark, path, encoding)
    if not lines:
        raise ValueError(f"{path} is empty")
    delimiter = delimiter or detect_delimiter(lines)
    heads = _file_headers(spark, path, encoding) if len(spark.read.text(path).inputFiles()) > 1 else []
    names, orders = _layouts(heads, delimiter) if heads else (header_names(lines[0], delimiter), {})
    fields = [T.StructField(f"f{i}", T.StringType()) for i in range(len(names))]
    schema = T.StructType([*fields, T.StructField(_OVERFLOW, T.StringType()), T.StructField(_RAW, T.StringType())])
    options = {"sep": delimiter, "mode": "PERMISSIVE", "quote": '"', "escape": '"', "columnNameOfCorruptRecord": _RAW,
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    if multi_line:
        text = F.col("record").cast("string") if encoding == "UTF-8" else F.decode("record", encoding)
        found = read_records(spark, path, delimiter).where("not header").select("file", "place", text.alias("record")).where(F.trim("record") != "")
        columns = ", ".join(f"{f.name} string" for f in schema)
        numbered = found.select(F.col("file").alias("_file"), F.col("place").alias(ROW_ID), F.from_csv("record", columns, options).alias("r")) \
            .select("r.*", "_file", ROW_ID)
    else:
        numbered = _number_rows(spark.read.schema(schema).options(**options, header=True, encoding=encoding, columnPruning=False).csv(path))
    fits = F.col(_OVERFLOW).isNull() & F.col(_RAW).isNotNull() & (separators(F.col(_RAW), delimiter) <= len(names) - 1)
    kept = numbered.where(fits)
    if len(orders) < 2:
        order = next(iter(orders), range(len(names)))
        return na_to_null(kept.select(*[F.col(f"f{i}").alias(n) for i, n in zip(order, names)], ROW_ID))
    listing = spark.createDataFrame([(f, k) for k, files in enumerate(orders.values()) for f in files], "_file string, _order int")
    placed = kept.join(F.broadcast(listing), "_file")
    # the field of a column by the order that its file has
    own = [F.coalesce(*[F.when(F.col("_order") == k, F.col(f"f{order[i]}")) for k, order in enumerate(orders)]) for i in range(len(names))]
    return na_to_null(placed.select(*[c.alias(n) for c, n in zip(own, names)], ROW_ID))


def write_csv(df: DataFrame, path: str, mode: str = "error", rows_per_file: int = 0) -> None:
    """Header, UTF-8, no row ids; a file for each task, or several of at most ``rows_per_file`` rows."""
    df.drop(ROW_ID).write.mode(mode).options(
        maxRecordsPerFile=rows_per_file, header=True, encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"').csv(path)
