"""Tables out of text payloads.

Input is a table (payload_id, text); output is one row per cell (payload_id, shape, row_no, position, column, value), so
payloads of every shape and size are parsed by the same distributed plan. Values are text; a payload that holds no table is
kept with the reason.
"""
from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import null_if_missing
from ..functions.text import strip
from ..session import materialise

# fixed values: keys that usually wrap the row array, in order of preference
ROW_KEYS = ["data", "rows", "records", "result", "results", "items", "hits", "value", "entries", "content"]
_PREFERRED = {k: i for i, k in enumerate(ROW_KEYS, 1)}
# texts, brackets, separators, and numbers or words of a JSON document
_SIGNS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+', re.S)
_BATCH_CHARS = 4_000_000
# a sign that no delimited text holds
_CUT = "\x1c\x00\x1c"
SEPARATORS = [",", "\t", ";"]
# fixed value: the line under a table's head, by the grammar of markdown tables
_RULE = r"^\s*\|?[\s:|-]+\|?\s*$"
_ARRAY, _OBJECT = "array<variant>", "map<string,variant>"
CELLS = ["payload_id", "shape", "row_no", "position", "column", "value"]


def strip_fence(text: Column) -> Column:
    """Payload without a surrounding markdown code fence."""
    t = strip(text)
    bare = F.regexp_replace(t, "^`+|`+$", "")
    body = F.regexp_replace(bare, r"^[^\n]*\n", "")
    return F.when(t.startswith("```"), strip(F.regexp_replace(body, r"(?s)```(?!.*```).*$", ""))).otherwise(t)


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", _ARRAY)


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", _OBJECT)


def _first(v: Column) -> Column:
    return F.try_variant_get(v, "$[0]", "variant")


def _holds_rows(v: Column) -> Column:
    first = _first(v)
    return _array(v).isNotNull() & (_object(first).isNotNull() | _array(first).isNotNull())


def _scalar_text(v: Column) -> Column:
    nested = _array(v).isNotNull() | _object(v).isNotNull()
    return F.when(nested, F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))


def prepare(payloads: DataFrame) -> DataFrame:
    """(payload_id, body, json): fence removed, JSON parsed where the text is JSON."""
    body = strip_fence(F.coalesce(F.col("text"), F.lit("")))
    return payloads.select("payload_id", body.alias("body")).withColumn("json", F.try_parse_json("body"))


def _documents(batches: Iterable[pa.RecordBatch], schema: pa.Schema, read: Callable[[str], Iterable[tuple]]) -> Iterator[pa.RecordBatch]:
    """Rows (payload_id, *what ``read`` finds in its JSON text), in batches of bounded size."""
    for batch in batches:
        out: list[tuple] = []
        size = 0
        for i, text in enumerate(batch.column(1)):
            for found in read(text.as_py()):
                out.append((i, *found))
                size += len(found[-1]) + 50
                if size > _BATCH_CHARS:
                    yield _emit(batch, out, schema)
                    out, size = [], 0
        if out:
            yield _emit(batch, out, schema)


def _emit(batch: pa.RecordBatch, out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    places, *values = zip(*out)
    ids = batch.column(0).take(pa.array(places, pa.int64()))
    return pa.RecordBatch.from_arrays([ids, *(pa.array(v, f.type) for v, f in zip(values, schema))],
                                      names=[batch.schema.names[0], *schema.names])


def first_rows(text: str) -> Iterable[tuple[str]]:
    """JSON text of the first array of objects or arrays, in one pass over the signs of a document.

    Objects are opened, arrays are not. The path to an array holds the place of each key: preferred wrapper keys come before
    the others, which keep their written order; the smallest path is the first in depth-first order.
    """
    path: list[int] = []     # place of the current key in each open object
    written: list[int] = []  # keys seen so far in each open object
    inside = 0               # open brackets within an array
    start, candidate, best, rows = 0, False, None, None
    expects_key = False
    signs = _SIGNS.finditer(text)
    for sign in signs:
        s = sign.group()
        if inside:
            if inside == 1 and candidate is None:
                candidate = s in "{[" and (best is None or path < best)
            if s in "{[":
                inside += 1
            elif s in "}]":
                inside -= 1
                if not inside and candidate:
                    best, rows = list(path), text[start:sign.end()]
        elif s == "[":
            inside, start, candidate = 1, sign.start(), None
        elif s == "{":
            path.append(0)
            written.append(0)
            expects_key = True
        elif s == "}":
            path.pop()
            written.pop()
            expects_key = False
        elif s == ",":
            expects_key = True
        elif expects_key and s[0] == '"':
            written[-1] += 1
            path[-1] = _PREFERRED.get(json.loads(s), written[-1] + len(_PREFERRED))
            expects_key = False
    return [] if rows is None else [(rows,)]


def row_cells(text: str) -> Iterator[tuple[int, str, str]]:
    """(row, dotted name, JSON text of the value) for every value that is not an object, in an array of objects."""
    names: list[str] = []
    row, depth, inside, start = 0, 0, 0, -1
    after_colon = False
    for sign in _SIGNS.finditer(text):
        s = sign.group()
        if inside:  # an array as a value, or an element of the outer array that is not an object
            inside += (s in "{[") - (s in "}]")
            if not inside and depth:
                yield row, ".".join(names), text[start:sign.end()]
        elif s == "[" and not depth and start < 0:
            start = 0  # the outer array
        elif s == "[":
            inside, start, after_colon = 1, sign.start(), False
        elif s == "{":
            depth += 1
            names.append("")
            after_colon = False
        elif s == "}":
            depth -= 1
            names.pop()
        elif s == ":":
            after_colon = True
        elif s == ",":
            row += not depth
        elif s == "]":
            return
        elif after_colon:
            yield row, ".".join(names), s
            after_colon = False
        elif depth:
            names[-1] = json.loads(s).encode("utf-8", "replace").decode()  # half a surrogate pair is no text


def _walked(documents: DataFrame, text: str, fields: str, read: Callable[[str], Iterable[tuple]]) -> DataFrame:
    schema = T.StructType.fromDDL(fields)
    arrow = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in schema])
    found = T.StructType([documents.schema["payload_id"], *schema.fields])
    return documents.select("payload_id", text).mapInArrow(lambda batches: _documents(batches, arrow, read), found)


def find_rows(documents: DataFrame) -> DataFrame:
    """(payload_id, rows, json): first array of objects or arrays in depth-first order, as text and parsed.

    Every document is walked once, whatever its depth. Documents are valid JSON (their ``json`` is not null).
    """
    return _walked(documents, "body", "rows string", first_rows).withColumn("json", F.parse_json("rows"))


def _cells(df: DataFrame, shape: str) -> DataFrame:
    return df.select("payload_id", F.lit(shape).alias("shape"), F.col("row_no").cast("bigint").alias("row_no"),
                     F.col("position").cast("int").alias("position"), "column", "value")


def object_rows(found: DataFrame) -> DataFrame:
    """Cells with dotted names for nested objects; each row array is walked once."""
    flat = _walked(found, "rows", "row_no bigint, column string, value string", row_cells)
    return _cells(flat.select("payload_id", "row_no", F.lit(None).alias("position"), "column", _scalar_text(F.parse_json("value")).alias("value")), "objects")


def array_rows(found: DataFrame, shape: str) -> DataFrame:
    """Rows given as arrays, with names from ``columns`` or numbered; rows given as objects have a cell for each of ``columns``."""
    rows = found.select("payload_id", "columns", F.posexplode(_array(F.col("json"))).alias("row_no", "row")) \
        .withColumn("fields", F.when(F.size("columns") > 0, _object(F.col("row"))))
    cells = rows.where("fields is null").select("payload_id", "columns", "row_no", F.posexplode(_array(F.col("row"))).alias("position", "cell"))
    name = F.coalesce(F.try_element_at("columns", F.col("position") + 1), F.col("position").cast("string"))
    cells = cells.select("payload_id", "row_no", "position", name.alias("column"), "cell")
    named = rows.where("fields is not null").select("payload_id", "row_no", "fields", F.posexplode("columns").alias("position", "column"))
    cells = cells.unionByName(named.select("payload_id", "row_no", "position", "column", F.try_element_at("fields", F.col("column")).alias("cell")))
    return _cells(cells.select("payload_id", "row_no", "position", "column", _scalar_text(F.col("cell")).alias("value")), shape)


def _text_columns(v: Column) -> Column:
    return F.transform(F.try_variant_get(v, "$.columns", _ARRAY), lambda c: F.try_variant_get(c, "$", "string"))


def _is_listed(json: Column) -> Column:
    """An object with a list of column names next to a list of rows."""
    return F.coalesce(_text_columns(json).isNotNull() & F.try_variant_get(json, "$.rows", _ARRAY).isNotNull(), F.lit(False))


def _is_flat(json: Column) -> Column:
    entries = F.map_entries(_object(json))
    return F.coalesce(F.forall(entries, lambda e: _array(e["value"]).isNull() & _object(e["value"]).isNull())
                      & (F.size(entries) > 0), F.lit(False))


def json_cells(listed: DataFrame, others: DataFrame, found: DataFrame) -> DataFrame:
    """Cells of the payloads that are JSON and hold a table."""
    json = F.col("json")
    names = _text_columns(json)
    tabular = listed.select("payload_id", names.alias("columns"), F.try_variant_get(json, "$.rows", "variant").alias("json"))
    of_objects = found.where(_object(_first(json)).isNotNull())
    of_arrays = (found.where(_array(_first(json)).isNotNull())
                 .join(others.select("payload_id", names.alias("columns")), "payload_id"))
    # a flat object holds no nested array, so it is never among the found ones
    one = (others.where(_is_flat(json)).select("payload_id", F.posexplode(F.map_entries(_object(json))).alias("position", "e"))
           .select("payload_id", F.lit(0).alias("row_no"), "position", F.col("e")["key"].alias("column"),
                   _scalar_text(F.col("e")["value"]).alias("value")))
    return reduce(DataFrame.unionByName, [
        array_rows(tabular, "columns_rows"), object_rows(of_objects), array_rows(of_arrays, "arrays"), _cells(one, "flat_object")])


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\r\n|\r|\n"), lambda ln: strip(ln) != "")


def _bar_cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(strip(line), r"^\|+|\|+$", ""), r"\|"), strip)


def markdown_table(lines: Column) -> Column:
    """First pipe table among a text's lines as struct(header, rows); null if there is none. ``lines`` should be worked out already.

    A header line with a bar is followed by a line of dashes; rows run to the first line without a bar, and rows with a
    different number of cells are left out.
    """
    def starts(i: Column) -> Column:
        rule = F.element_at(lines, i + 1)
        return F.element_at(lines, i).contains("|") & rule.rlike(_RULE) & rule.contains("-")

    def read(i: Column) -> Column:
        header = _bar_cells(F.element_at(lines, i))
        rest = F.slice(lines, i + 2, F.greatest(F.size(lines) - i - 1, F.lit(0)))
        stop = F.array_position(F.transform(rest, lambda ln: ln.contains("|")), False)
        body = F.when(stop > 0, F.slice(rest, F.lit(1), (stop - 1).cast("int"))).otherwise(rest)
        rows = F.filter(F.transform(body, _bar_cells), lambda r: F.size(r) == F.size(header))
        return F.struct(header.alias("header"), rows.alias("rows"))

    places = F.when(F.size(lines) >= 2, F.filter(F.sequence(F.lit(1), F.size(lines) - 1), starts))
    return F.try_element_at(F.filter(F.transform(places, read), lambda t: F.size(t["rows"]) > 0), F.lit(1))


def _fields(line: Column, sep: str) -> Column:
    """Fields of a line, split at separators with an even number of quotes after them; linear in the line."""
    def cut(pieces: Column) -> Column:
        # the quotes after a piece are those of the line less its place
        return F.array_join(F.transform(pieces, lambda p, i: F.when(
            (F.size(pieces) - 1 - i) % 2 == 0, F.replace(p, F.lit(sep), F.lit(_CUT))).otherwise(p)), '"')

    # within a lambda the pieces are worked out once
    quoted = F.split(F.transform(F.array(F.split(line, '"')), cut)[0], _CUT)
    quoted_aware = F.when(line.contains('"'), quoted).otherwise(F.split(line, sep))
    return F.transform(quoted_aware, lambda f: F.when(
        f.rlike('(?s)^".*"$'), F.regexp_replace(F.regexp_replace(f, '^"|"$', ""), '""', '"')).otherwise(f))


def delimited_table(lines: Column) -> Column:
    """struct(header, rows) for the first separator that gives two or more columns and at least one row, none too long.

    The other lines are cut only where the first one has the separator. ``lines`` should be worked out already.
    """
    def read(sep: str) -> Column:
        header = _fields(F.element_at(lines, F.lit(1)), sep)

        def fitting(split: Column) -> Column:
            own, rows = split[0], F.slice(split, F.lit(2), F.size(split) - 1)
            fits = (F.size(own) > 1) & F.forall(rows, lambda r: F.size(r) <= F.size(own))
            return F.when(fits, F.struct(own.alias("header"), rows.alias("rows")))

        split = F.transform(lines, lambda ln: _fields(ln, sep))
        return F.when((F.size(lines) > 1) & F.element_at(lines, F.lit(1)).contains(sep) & (F.size(header) > 1), _once(split, fitting))

    return F.coalesce(*[read(s) for s in SEPARATORS])


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of an expression that is worked out once, however often it is named; lambdas work out anew what they name from outside."""
    return F.transform(F.array(c), use)[0]


def text_table(text: Column) -> Column:
    """struct(shape, header, rows) of a text's first pipe table, else of delimited lines; null for a text without bar and separator."""
    def read(lines: Column) -> Column:
        def shaped(shape: str, found: Column) -> Column:
            return _once(found, lambda t: F.when(t.isNotNull(), F.struct(F.lit(shape).alias("shape"), t["header"].alias("header"), t["rows"].alias("rows"))))
        return F.coalesce(shaped("markdown", F.when(F.exists(lines, lambda ln: ln.contains("|")), markdown_table(lines))),
                          shaped("delimited", delimited_table(lines)))

    marked = text.contains("|")
    for sep in SEPARATORS:
        marked = marked | text.contains(sep)
    return F.when(marked, _once(_lines(text), read))


def _table_cells(df: DataFrame) -> DataFrame:
    rows = df.select("payload_id", F.col("t.shape").alias("shape"), F.col("t.header").alias("header"), F.posexplode_outer("t.rows").alias("row_no", "row"))
    cells = rows.where("row_no is not null").select("payload_id", "shape", "row_no", "row", F.posexplode("header").alias("position", "column"))
    value = F.try_element_at("row", F.col("position") + 1)
    value = F.when(F.col("shape") == "delimited", null_if_missing(value)).otherwise(value)
    return cells.select("payload_id", "shape", F.col("row_no").cast("bigint").alias("row_no"), F.col("position").cast("int").alias("position"),
                        "column", value.alias("value"))


def parse(payloads: DataFrame) -> DataFrame:
    """Cells of all payloads: JSON first, then a pipe table, then delimited text.

    The parsed documents and the found row arrays each feed several branches and are written once.
    """
    json = F.col("json")
    prepared = materialise(prepare(payloads))
    documents = prepared.where("json is not null")
    listed, others = documents.where(_is_listed(json)), documents.where(~_is_listed(json))
    found = materialise(find_rows(others))
    cells = json_cells(listed, others, found)
    is_table = json.isNotNull() & (_is_listed(json) | _is_flat(json))
    unsolved = prepared.where(F.col("body") != "").where(~F.coalesce(is_table, F.lit(False))).join(
        found.select("payload_id"), "payload_id", "left_anti")
    # a condition on the table would move below it and read every text again, so texts without one leave after their rows are laid out
    tables = unsolved.select("payload_id", text_table(F.col("body")).alias("t"))
    return cells.unionByName(_table_cells(tables)).select(*CELLS)


def status(payloads: DataFrame, cells: DataFrame) -> DataFrame:
    """(payload_id, status, shape, rows, columns): what was found, or why a payload was set aside."""
    found = cells.groupBy("payload_id", "shape", "column").agg(F.max("row_no").alias("last")).groupBy("payload_id", "shape").agg(
        (F.max("last") + 1).alias("rows"), F.count("*").alias("columns"))
    # texts stay where they are: only whether they are blank meets the cells
    blank = strip(F.coalesce(F.col("text"), F.lit(""))) == ""
    return payloads.select("payload_id", blank.alias("blank")).join(found, "payload_id", "left").select(
        "payload_id", F.when(F.col("shape").isNotNull(), "parsed").when(F.col("blank"), "empty payload").otherwise("no table found").alias("status"),
        "shape", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("columns", F.lit(0)).alias("columns"))


def as_table(cells: DataFrame, payload_id) -> DataFrame:
    """One payload as a wide all-text table with its row number."""
    own = cells.where(F.col("payload_id") == payload_id)
    names = [r["column"] for r in own.groupBy("column").agg(F.min("position").alias("p")).orderBy("p", "column").collect()]
    return own.groupBy("row_no").pivot("column", names).agg(F.first("value"))


def flatten_struct(df: DataFrame) -> DataFrame:
    """Nested struct columns as dotted flat columns."""
    def leaves(fields, prefix):
        for f in fields:
            path = [*prefix, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType.fields, path)
            else:
                yield path

    return df.select(*[F.col(".".join("`" + p.replace("`", "``") + "`" for p in path)).alias(".".join(path))
                       for path in leaves(df.schema.fields, [])])
