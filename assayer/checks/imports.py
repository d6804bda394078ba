"""Text payloads and file admission."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import slug
from ..session import scratch_path
from ..sources import catalogue as K
from ..sources import csv as C
from ..sources import payloads as P
from . import check, table

# every conversation becomes one payload; turn, role and length survive any shape
TURNS = """(select conv_id as payload_id, (row_number() over (partition by conv_id order by turn) - 1)::bigint as row_no, turn, role, length(text) as chars, text from conversations)"""
WIDE = f"""select payload_id, '%s' as shape, row_no, "column", value from (
  select payload_id, row_no, 'turn' as column, turn::varchar as value from {TURNS} union all select payload_id, row_no, 'role', role from {TURNS}
  union all select payload_id, row_no, 'chars', chars::varchar from {TURNS})"""


def conversations(s, d):
    """(payload_id, turns): a conversation holds a handful of turns."""
    turn = F.struct("turn", "role", F.char_length("text").alias("chars"), "text")
    return (table(s, d, "conversations").groupBy(F.col("conv_id").alias("payload_id"))
            .agg(F.array_sort(F.collect_list(turn)).alias("turns")))


def short(c):
    return F.transform(c, lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["chars"].alias("chars")))


def lines(c, sep):
    return F.array_join(F.transform(c, lambda t: F.concat_ws(sep, t["turn"].cast("string"), t["role"], t["chars"].cast("string"))), "\n")


def rows_json(c):
    return F.to_json(F.transform(c, lambda t: F.array(t["turn"].cast("string"), t["role"], t["chars"].cast("string"))))


def T():
    return F.col("turns")


MAKERS = {
    "objects": lambda: F.to_json(short(T())),
    "fenced": lambda: F.concat(F.lit("```json\n"), F.to_json(short(T())), F.lit("\n```")),
    "columns_rows": lambda: F.concat(F.lit('{"columns": ["turn", "role", "chars"], "rows": '), rows_json(T()), F.lit("}")),
    "wrapped": lambda: F.concat(F.lit('{"zzz": [], "total": 3, "other": {"x": 1, "payload": {"items": '), F.to_json(short(T())), F.lit("}}}")),
    "preferred": lambda: F.concat(F.lit('{"aaa": [{"no": 1}], "results": '), F.to_json(short(T())), F.lit("}")),
    "named_arrays": lambda: F.concat(F.lit('{"columns": ["turn", "role", "chars"], "data": '), rows_json(T()), F.lit("}")),
    "markdown": lambda: F.concat(F.lit("Here it is:\n\n| turn | role | chars |\n|---|:---:|---|\n| "), F.regexp_replace(lines(T(), " | "), "\n", " |\n| "), F.lit(" |\n| too | short |\n\nDone.")),
    "comma": lambda: F.concat(F.lit("turn,role,chars\n"), lines(T(), ",")),
    "tab": lambda: F.concat(F.lit("turn\trole\tchars\n"), lines(T(), "\t")),
    "semicolon": lambda: F.concat(F.lit("turn;role;chars\n"), lines(T(), ";")),
}
SHAPES = {"objects": "objects", "fenced": "objects", "columns_rows": "columns_rows", "wrapped": "objects", "preferred": "objects",
          "named_arrays": "arrays", "markdown": "markdown", "comma": "delimited", "tab": "delimited", "semicolon": "delimited"}


def payloads(s, d, kind):
    return conversations(s, d).select("payload_id", MAKERS[kind]().alias("text"))


for _kind, _shape in SHAPES.items():
    check(f"payload_{_kind}", WIDE % _shape)(
        lambda s, d, k=_kind: P.parse(payloads(s, d, k)).select("payload_id", "shape", "row_no", "column", "value"))

check("payload_unnamed_arrays", f"""select payload_id, row_no, position::int as position, "column", value from (
  select payload_id, row_no, 0 as position, '0' as column, turn::varchar as value from {TURNS} union all select payload_id, row_no, 1, '1', role from {TURNS} union all select payload_id, row_no, 2, '2', chars::varchar from {TURNS})""")(
    lambda s, d: P.parse(conversations(s, d).select("payload_id", rows_json(T()).alias("text"))).select("payload_id", "row_no", "position", "column", "value"))
check("payload_nested_objects", f"""select payload_id, row_no, 'who.role' as column, role as value from {TURNS} union all select payload_id, row_no, 'who.said.md5', md5(text) from {TURNS}
  union all select payload_id, row_no, 'turn', turn::varchar from {TURNS}""")(
    lambda s, d: P.parse(conversations(s, d).select("payload_id", F.to_json(F.transform(T(), lambda t: F.struct(
        t["turn"].alias("turn"), F.struct(t["role"].alias("role"), F.struct(F.md5(F.encode(t["text"], "utf-8")).alias("md5")).alias("said")).alias("who")))).alias("text")))
    .select("payload_id", "row_no", "column", "value"))
check("payload_whole_texts", f"select payload_id, row_no, text as value from {TURNS}")(
    lambda s, d: P.parse(conversations(s, d).select("payload_id", F.to_json(F.transform(T(), lambda t: F.struct(t["text"].alias("text")))).alias("text"))).select("payload_id", "row_no", "value"))
check("payload_flat_object", "select event_id as payload_id, 'flat_object' as shape, 0::bigint as row_no, 0 as position, 'k' as column, json_extract_string(props, '$.k') as value from events")(
    lambda s, d: P.parse(table(s, d, "events").select(F.col("event_id").alias("payload_id"), F.col("props").alias("text"))))
check("payload_prose_refused", "select doc_id as payload_id, case when trim(text, ' ' || chr(10) || chr(13)) = '' then 'empty payload' else 'no table found' end as status from documents")(
    lambda s, d: _refused(s, d))


def _refused(s, d):
    # every text, with the signs that could make it a table blotted out
    prose = table(s, d, "documents").select(F.col("doc_id").alias("payload_id"), F.regexp_replace("text", r"[,|;\t{\[]", ".").alias("text"))
    return P.status(prose, P.parse(prose)).select("payload_id", "status")


check("payload_status", f"select payload_id, 'parsed' as status, 'objects' as shape, count(*) as rows, 3::bigint as columns from {TURNS} group by 1")(
    lambda s, d: P.status(payloads(s, d, "objects"), P.parse(payloads(s, d, "objects"))))
check("payload_fence", "select doc_id, md5(trim(replace(text, '`', chr(39)), ' ' || chr(9) || chr(10) || chr(13))) as body from documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.md5(F.encode(P.strip_fence(F.concat(
        F.lit("```text\n"), F.replace(F.col("text"), F.lit("`"), F.lit("'")), F.lit("\n```"))), "utf-8")).alias("body")))
check("struct_flatten", "select c_custkey as \"id\", c_name as \"who.name\", c_mktsegment as \"who.segment.code\" from customer")(
    lambda s, d: P.flatten_struct(table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.struct(
        F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("code")).alias("segment")).alias("who"))))
check("import_slug", "select page_id, coalesce(nullif(left(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 60), ''), 'import') as slug from pages")(
    lambda s, d: table(s, d, "pages").select("page_id", slug(F.col("url")).alias("slug")))


@check("file_catalogue", "select 'uploaded' as status, true as hashed from orders having count(*) > 0")
def _(s, d):
    path = scratch_path(s, "catalogue")
    C.write_csv(table(s, d, "orders"), path, rows_per_file=1_000_000)
    found = K.catalogue(s, path).where("name like '%.csv'")
    return found.select("status", (F.length("sha256") == 64).alias("hashed")).distinct()


@check("payload_to_csv", f"""select payload_id::varchar as payload_id, row_no::varchar as row_no, turn::varchar as turn, role, chars::varchar as chars from {TURNS}""")
def _(s, d):
    """The cells of all payloads, put out as one file set and read back."""
    path = scratch_path(s, "import")
    cells = P.parse(payloads(s, d, "objects"))
    C.write_csv(cells.groupBy("payload_id", "row_no").pivot("column", ["turn", "role", "chars"]).agg(F.first("value")), path)
    return C.read_csv(s, path).drop("_row_id").select("payload_id", "row_no", "turn", "role", "chars")


check("payload_columns_rows_of_objects", f"""select payload_id, 'columns_rows' as shape, row_no, 0 as position, 'role' as column, role as value from {TURNS}
  union all select payload_id, 'columns_rows', row_no, 1, 'turn', turn::varchar from {TURNS} union all select payload_id, 'columns_rows', row_no, 2, 'nothing', null from {TURNS}""")(
    lambda s, d: P.parse(conversations(s, d).select("payload_id", F.concat(
        F.lit('{"columns": ["role", "turn", "nothing"], "rows": '), F.to_json(short(T())), F.lit("}")).alias("text"))))


# --- reader conventions, on exports written from the tables
@check("csv_bad_lines", "select o_orderkey::varchar as a, case when o_orderkey % 7 = 0 and o_orderkey % 10 <> 0 then null else o_custkey::varchar end as b from orders where o_orderkey % 10 <> 0")
def _(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    line = F.when(k % 10 == 0, F.concat_ws(",", k.cast("string"), c, F.lit("extra"))).when(k % 7 == 0, k.cast("string")).otherwise(
        F.concat_ws(",", k.cast("string"), c))
    path = scratch_path(s, "bad-lines")
    _with_header(table(s, d, "orders").select(line.alias("line")), "a,b", path)
    return C.read_csv(s, path).drop("_row_id")


def _with_header(lines, header, path):
    """Every written file starts with the header."""
    def add(batches):
        import pyarrow as pa
        first = True
        for batch in batches:
            if first:
                yield pa.RecordBatch.from_pydict({"line": [header]})
                first = False
            yield batch

    lines.mapInArrow(add, "line string").write.text(path)


for _sep, _name in ((";", "semicolon"), ("\t", "tab"), ("|", "pipe")):
    def _delimited(s, d, sep=_sep, name=_name):
        path = scratch_path(s, f"delimiter-{name}")
        table(s, d, "part").select(F.col("p_partkey").cast("string"), "p_name", F.col("p_retailprice").cast("string")).write.option("header", True).option("sep", sep).csv(path)
        return C.read_csv(s, path).drop("_row_id")
    check(f"csv_delimiter_{_name}", "select p_partkey::varchar as p_partkey, p_name, p_retailprice::varchar as p_retailprice from part")(_delimited)


@check("csv_latin1", r"""select doc_id::varchar as doc_id, md5('.' || regexp_replace(text, '[^\x20-\x7e\xa0-\xff]', '?', 'g') || '.') as t from documents""")
def _(s, d):
    path = scratch_path(s, "latin1")
    # every text, quotes included; what Latin-1 lacks stands as a question mark
    text = F.concat(F.lit("."), F.regexp_replace("text", r"[^\x20-\x7e\xa0-\xff]", "?"), F.lit("."))
    (table(s, d, "documents").select("doc_id", text.alias("t"))
     .write.options(header=True, encoding="ISO-8859-1", sep=";", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path))
    read = C.read_csv(s, path, delimiter=";")
    return read.select("doc_id", F.md5(F.encode("t", "utf-8")).alias("t"))


@check("csv_header_trim", "select c_custkey::varchar as id, c_mktsegment as segment from customer")
def _(s, d):
    path = scratch_path(s, "header")
    (table(s, d, "customer").select(F.col("c_custkey").alias(" id "), F.col("c_mktsegment").alias("segment  "))
     .write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path))
    return C.trim_header(C.read_csv(s, path).drop("_row_id"))
