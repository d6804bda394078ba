import json
import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import roles
from assayer.sources import catalogue, csv, payloads, records
from assayer.sources.tables import read_parquet


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def rows(df):
    return [tuple(r) for r in df.orderBy("_row_id").drop("_row_id").collect()]


def test_plain_csv(spark, tmp_path):
    df = csv.read_csv(spark, write(tmp_path / "a.csv", ' a ,b,b,\n1,"x, y",n/a,z\n2,"say ""hi""",NULL,\n'))
    assert df.columns == ["a", "b", "b.1", "Unnamed: 3", "_row_id"]
    assert rows(df) == [("1", "x, y", None, "z"), ("2", 'say "hi"', None, None)]


def test_long_lines_are_dropped_and_short_ones_padded(spark, tmp_path):
    text = "a,b,c\n1,2,3\n1,2\n1,2,3,4\n1,2,3,4,5\n1,2,3,\n1,2,3,,\n\n4,5,6\n"
    assert rows(csv.read_csv(spark, write(tmp_path / "a.csv", text))) == [("1", "2", "3"), ("1", "2", None), ("4", "5", "6")]


def test_long_quoted_fields(spark, tmp_path):
    long = 'a, ""b"" ' * 20_000
    got = rows(csv.read_csv(spark, write(tmp_path / "a.csv", f'k,v\n1,"{long}"\n2,"x,""y"\n3,""\n'), delimiter=","))
    assert got == [("1", long.replace('""', '"')), ("2", 'x,"y'), ("3", None)]


def test_rows_of_several_files_keep_the_order_of_names(spark, tmp_path):
    write(tmp_path / "a.csv", "k\n1\n2\n3\n")
    write(tmp_path / "b.csv", "k\n" + "".join(f"{i}\n" for i in range(10, 4000)))
    write(tmp_path / "c.csv", "k\n5000\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "4k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = [int(r["k"]) for r in csv.read_csv(spark, str(tmp_path)).orderBy("_row_id").collect()]
            assert got == [1, 2, 3, *range(10, 4000), 5000]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiter_is_found(spark, tmp_path, sep):
    text = "\n".join(sep.join(r) for r in (["name", "note", "n"], ["a", "x y", "1"], ["b", "z", "2"])) + "\n"
    assert rows(csv.read_csv(spark, write(tmp_path / "a.csv", text))) == [("a", "x y", "1"), ("b", "z", "2")]


def test_encodings(spark, tmp_path):
    assert rows(csv.read_csv(spark, write(tmp_path / "u.csv", "é,b\nü,1\n"))) == [("ü", "1")]
    bom = csv.read_csv(spark, write(tmp_path / "m.csv", b"\xef\xbb\xbfa,b\n1,2\n"))
    assert bom.columns[:2] == ["a", "b"]
    latin = csv.read_csv(spark, write(tmp_path / "l.csv", "é,b\nü,1\n".encode("latin-1")))
    assert latin.columns[0] == "é" and rows(latin) == [("ü", "1")]


def test_dirty_orders(spark, tmp_path):
    """Ten orders: one revenue missing, one a word, one extreme."""
    values = ["61.5", "17.25", "40", "", "unknown yet", "23.75", "70000.5", "8.5", "55.125", "31"]
    text = "order_id,region,order_date,units,revenue\n" + "".join(
        f"{1001 + i},{'North South East West'.split()[i % 4]},2024-01-{3 + i:02d},{i % 7 + 1},{v}\n" for i, v in enumerate(values))
    df = csv.read_csv(spark, write(tmp_path / "o.csv", text))
    known = roles.infer_and_clean(df, reader_types=True)
    assert known.roles == {"order_id": "id", "region": "categorical", "order_date": "datetime", "units": "numeric", "revenue": "numeric"}
    revenue = next(f for f in known.raw_facts if f["column"] == "revenue")
    assert (revenue["numeric_ok"], revenue["non_null"]) == (8, 9)
    assert known.clean.where("revenue is null").count() == 2


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", " x "), ('q"q', "1,2")], "k string, v string")
    csv.write_csv(df, str(tmp_path / "out"))
    assert sorted(rows(csv.read_csv(spark, str(tmp_path / "out")))) == [("a", " x "), ('q"q', "1,2")]


def test_catalogue_reasons(spark, tmp_path):
    write(tmp_path / "a.csv", "a\n1\n"), write(tmp_path / "b.txt", "x"), write(tmp_path / "c.csv", ""), write(tmp_path / "d.csv", "x" * 50)
    got = {r["name"]: (r["status"], r["sha256"]) for r in catalogue.catalogue(spark, str(tmp_path), max_bytes=40).collect()}
    assert got["a.csv"][0] == "uploaded" and len(got["a.csv"][1]) == 64
    assert got["b.txt"][0].startswith("only") and got["c.csv"][0] == "file is empty" and got["d.csv"][0].startswith("file exceeds")


def test_row_position_over_several_files(spark, tmp_path):
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).coalesce(1).write.parquet(str(tmp_path / "t" / f"p={part}"))
    df = read_parquet(spark, str(tmp_path / "t"), row_id=True)
    ids = [r["_row_id"] for r in df.collect()]
    assert len(set(ids)) == 30
    assert [r["id"] for r in df.orderBy("_row_id").collect()] == [r["id"] for r in df.repartition(4).orderBy("_row_id").collect()]


CASES = {
    "rows": ('[{"city": "Oslo", "pop": 709}, {"city": "Bergen", "pop": 291}, {"city": "Voss", "pop": 16}]', "objects", 3, 2),
    "columns of objects": ('{"columns": ["b", "a", "z"], "rows": [{"a": 1, "b": "x", "c": 2}, {"b": "y"}]}', "columns_rows", 2, 3),
    "columns": ('{"columns": ["lat", "lon", "name"], "rows": [[59.9, 10.7, "Oslo"], [60.4, 5.3, "Bergen"]]}', "columns_rows", 2, 3),
    "csv": ("depot,shelf\nnorth,12\nsouth,7\nwest,31\n", "delimited", 3, 2),
    "wrapped": ('{"page": 1, "items": [{"part": "bolt", "maker": {"town": "Ulm"}}, {"part": "nut", "maker": {"town": "Graz"}}]}', "objects", 2, 2),
    "markdown": ("Stock today\n\n| part | left |\n|:--|--:|\n| bolt | 40 |\n| nut | 9 | extra |\n| washer | 3 |\n\nthat is all", "markdown", 2, 2),
    "fenced": ('```json\n[{"left": 40}, {"left": 9}, {"left": 3}]\n```', "objects", 3, 1),
    "prose": ("We counted the shelves on Monday and found nothing missing", None, 0, 0),
    "arrays": ("[[1,2],[3,4]]", "arrays", 2, 2),
    "named arrays": ('{"columns":["p","q"],"data":[[1,"z"],[2,null]]}', "arrays", 2, 2),
    "flat": ('{"a":1,"b":"two","c":true,"d":null}', "flat_object", 1, 4),
    "semicolon": ("a;b\n1;2", "delimited", 1, 2),
    "tab": ('a\tb\n1\t"x y"\n2', "delimited", 2, 2),
    "empty": ("  ", None, 0, 0),
    "null": (None, None, 0, 0),
    "deep": ('{"m":{"x":[1,2]},"z":{"deep":{"er":{"list":[{"k":1}]}}},"alpha":[{"no":1},{"no":2}]}', "objects", 1, 1),
    "preferred": ('{"alpha":[{"no":1}],"hits":{"hits":[{"k":1},{"k":2}]}}', "objects", 2, 1),
    "backtrack": ('{"data":{"rows":[]},"other":{"rows":[[1]]}}', "arrays", 1, 1),
    "json in text": ('{"s":"[{\\"a\\":1}]","n":1}', "flat_object", 1, 2),
    "too many fields": ("a,b\n1,2,3", None, 0, 0),
}


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "payload_id string, text string")
    cells = payloads.parse(df).cache()
    return {r["payload_id"]: r for r in payloads.status(df, cells).collect()}, cells


@pytest.mark.parametrize("name", CASES)
def test_payload(parsed, name):
    got = parsed[0][name]
    _, shape, n, cols = CASES[name]
    assert (got["shape"], got["rows"], got["columns"]) == (shape, n, cols)
    assert got["status"] == ("parsed" if shape else "empty payload" if name in ("empty", "null") else "no table found")


def test_payload_as_table(parsed):
    t = payloads.as_table(parsed[1], "wrapped").orderBy("row_no")
    assert set(t.columns) == {"row_no", "part", "maker.town"}
    assert [tuple(r) for r in t.select("part", "`maker.town`").collect()] == [("bolt", "Ulm"), ("nut", "Graz")]
    deep = payloads.as_table(parsed[1], "deep").collect()
    assert [r.asDict() for r in deep] == [{"row_no": 0, "k": "1"}]


def test_files_of_a_folder_are_read_by_their_own_headers(spark, tmp_path):
    write(tmp_path / "a.csv", "k,v,w\n1,x,p\n")
    write(tmp_path / "b.csv", "\nw,k,v\n" + "q,2,\n" * 3)
    write(tmp_path / "c.csv", b"\xef\xbb\xbfv,w,k\n" + b"z,r,3\n" * 9)
    write(tmp_path / "d.csv", "")
    df = csv.read_csv(spark, str(tmp_path))
    got = [tuple(r) for r in df.orderBy("_row_id").select("k", "v", "w").collect()]
    assert df.columns[:3] == ["k", "v", "w"] and got == [("1", "x", "p")] + [("2", None, "q")] * 3 + [("3", "z", "r")] * 9


@pytest.mark.parametrize("other", ["k;v\n3;z\n", "k,u\n3,z\n", "k,v,w\n3,z,1\n", "3,z\n4,z\n"])
def test_files_with_other_columns_or_separators_are_refused(spark, tmp_path, other):
    write(tmp_path / "a.csv", "k,v\n1,x\n2,y\n" * 5)
    write(tmp_path / "b.csv", other)
    with pytest.raises(ValueError, match="b.csv"):
        csv.read_csv(spark, str(tmp_path))


def _dealt(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    yield lambda size: _dealt(spark, size)
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def _odd_records(seed, n=250):
    """Records as fields and as text: line breaks, separators and quotes inside fields, quotes inside bare fields, blank lines."""
    rng, out, text = random.Random(seed), [], []
    pieces = ["a", "b,", '""', "\n", "\n\n", "é", "\r\n", " ", "x" * 40, ',"', "'"]
    for i in range(n):
        bare = rng.choice(["x", 'in"ch', "5'", "é", 'q""q'])
        quoted = "".join(rng.choice(pieces) for _ in range(rng.choice([1, 2, 3, 12]))).replace('""', '"')
        out.append((str(i), bare, quoted))
        text.append(f'{i},{bare},"{quoted.replace(chr(34), chr(34) * 2)}"' + rng.choice(["\n", "\r\n", "\n\n"]))
    return out, "k,bare,text\n" + "".join(text)


@pytest.mark.parametrize("size", ["37", "200", "1m"])
@pytest.mark.parametrize("sent", [200_000, 0])
def test_quoted_line_breaks_across_splits(spark, tmp_path, small_splits, size, sent, monkeypatch):
    monkeypatch.setattr(csv, "read_records", lambda *a: records.read_records(*a, most_sent=sent))
    small_splits(size)
    for seed in (1, 2) if size != "37" else (1,):
        want, text = _odd_records(seed, 60 if size == "37" else 250)
        path = write(tmp_path / f"{seed}.csv", text)
        df = csv.read_csv(spark, path, delimiter=",", encoding="UTF-8", multi_line=True)
        if size != "1m":
            assert spark.read.text(path).rdd.getNumPartitions() > 10
        assert rows(df) == [tuple(v or None for v in r) for r in want]
        assert [r["text"] for r in df.orderBy("_row_id").collect()] == [r[2] or None for r in csv_rows(text)]


def csv_rows(text):
    """The same by the standard library, as a check of the made text."""
    import csv as standard
    import io
    return [r for r in list(standard.reader(io.StringIO(text, newline="")))[1:] if r]


def test_records_of_several_files_and_a_latin_one(spark, tmp_path, small_splits):
    small_splits("64")
    (tmp_path / "d").mkdir()
    write(tmp_path / "d" / "a.csv", 'k,t\n1,"a\nb"\n' + "".join(f'{i},"{"line" + chr(10)}{i}"\n' for i in range(2, 60)))
    write(tmp_path / "d" / "b.csv", '\n\nk,t\n100,"x\n\ny"\n101,plain\n')
    got = rows(csv.read_csv(spark, str(tmp_path / "d"), delimiter=",", multi_line=True))
    assert got == [("1", "a\nb"), *((str(i), f"line\n{i}") for i in range(2, 60)), ("100", "x\n\ny"), ("101", "plain")]
    latin = csv.read_csv(spark, write(tmp_path / "l.csv", 'k,t\n1,"é\nü"\n'.encode("latin-1")), multi_line=True)
    assert rows(latin) == [("1", "é\nü")]


def test_a_quote_that_is_never_closed_is_refused(spark, tmp_path, small_splits):
    small_splits("64")
    path = write(tmp_path / "a.csv", "k,t\n" + "1,x\n" * 50 + '2,"open\n' + "3,y\n" * 50)
    with pytest.raises(Exception, match="never closed"):
        csv.read_csv(spark, path, delimiter=",", encoding="UTF-8", multi_line=True).count()


def test_state_of_a_line():
    assert not records.open_after(b'a,"b"', False, b",") and records.open_after(b'a,"b', False, b",")
    assert records.open_after(b'a,""b', True, b",") and not records.open_after(b'a"', True, b",")
    assert not records.open_after(b'5" pipe,x"y', False, b",") and records.open_after(b'a"b;"c', True, b";")


def _rows_by_hand(node):
    """First array of objects or arrays, preferred keys first, by recursion."""
    if isinstance(node, list):
        return node if node and isinstance(node[0], (dict, list)) else None
    if isinstance(node, dict):
        rank = {k: i for i, k in enumerate(payloads.ROW_KEYS)}
        for k in sorted(node, key=lambda k: rank.get(k, 100)):
            found = _rows_by_hand(node[k])
            if found is not None:
                return found
    return None


def _cells_by_hand(rows):
    def walk(value, name):
        if isinstance(value, dict):
            for k, v in value.items():
                yield from walk(v, [*name, k])
        else:
            yield ".".join(name), value

    return [(i, n, v) for i, r in enumerate(rows) if isinstance(r, dict) for n, v in walk(r, [])]


def test_documents_are_walked_once_and_as_by_recursion():
    draw = random.Random(5)
    keys = ["data", "items", "value", "rows", "a", "b", 'q"}[', "\\", "naïve", "", "x.y", "\n"]

    def node(depth):
        kind = draw.random()
        if depth and kind < 0.45:
            return {k: node(depth - 1) for k in draw.sample(keys, draw.randrange(4))}
        if depth and kind < 0.75:
            return [node(depth - 1) for _ in range(draw.randrange(4))]
        return draw.choice([None, True, 0, -1.5e30, "", "text", ']"[{', "a,b:c", "\\\\\"", "é "])

    solved = 0
    for k in range(3000):
        document = node(6)
        text = json.dumps(document, ensure_ascii=bool(k % 2), indent=k % 3 or None)
        want = _rows_by_hand(document)
        got = [json.loads(r) for r, in payloads.first_rows(text)]
        assert got == ([] if want is None else [want]), text
        if want is not None:
            solved += 1
            rows = json.dumps(want, indent=k % 3 or None)
            assert [(i, n, json.loads(v)) for i, n, v in payloads.row_cells(rows)] == _cells_by_hand(want), rows
    assert solved > 500


def test_payloads_of_any_depth_need_no_job_for_a_level(spark):
    deep = '{"k": ' * 60 + '[{"n": ' + '{"m": ' * 60 + "1.50" + "}" * 60 + ', "half": {"\\ud800": [1, {"z": null}]}, "none": null, "empty": {}}, 7, {"n": "x"}]' + "}" * 60
    df = spark.createDataFrame([("deep", deep), ("none", "[]"), ("scalar", "3"), (None, '[{"a": 1}]')], "payload_id string, text string")
    got = sorted((r["payload_id"] or "", r["row_no"], r["column"], r["value"]) for r in payloads.parse(df).collect())
    assert got == [("", 0, "a", "1"), ("deep", 0, "half.?", '[1,{"z":null}]'), ("deep", 0, "n" + ".m" * 60, "1.5"),
                   ("deep", 0, "none", None), ("deep", 2, "n", "x")]


def test_fields_of_lines_with_any_quotes_are_as_by_counting(spark):
    draw = random.Random(3)
    lines = ["".join(draw.choice('ab,;"" ') for _ in range(draw.randrange(14))) for _ in range(400)] + ["a," * 30_000 + '"x,y"']

    def by_hand(line):
        out, field = [], ""
        after = line.count('"')
        for c in line:
            after -= c == '"'
            if c == "," and after % 2 == 0:
                out.append(field)
                field = ""
            else:
                field += c
        return [f[1:].removesuffix('"').replace('""', '"') if len(f) > 1 and f[0] == f[-1] == '"' else f for f in [*out, field]]

    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", payloads._fields(F.col("line"), ",").alias("f")).collect()
    for r in got:
        assert r["f"] == by_hand(r["line"]), r["line"]


def test_long_texts_are_cut_into_lines_once(spark):
    """Thousands of lines that might begin a table; a text was cut into lines again for each of them."""
    import time
    bars = "\n".join(f"line {i} | more" for i in range(6_000))
    table = bars + "\n| a | b |\n|---|---|\n| 1 | 2 |\n\nend"
    df = spark.createDataFrame([("bars", bars), ("table", table), ("commas", "\n".join(["a, b"] * 6_000)), ("late", "title\n" + "a, b\n" * 6_000)],
                               "payload_id string, text string")
    start = time.time()
    status = payloads.status(df, payloads.parse(df))
    got = {r["payload_id"]: tuple(r)[1:] for r in status.collect()}
    assert got == {"bars": ("no table found", None, 0, 0), "table": ("parsed", "markdown", 1, 2),
                   "commas": ("parsed", "delimited", 5_999, 2), "late": ("no table found", None, 0, 0)}
    assert time.time() - start < 60
    # whole texts are not shuffled to meet the cells
    assert "text#" not in "".join(ln for ln in status._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in ln)


def test_files_are_cut_by_rows(spark, tmp_path):
    csv.write_csv(spark.range(1_000, numPartitions=1).selectExpr("id", "'a\nb' as t"), str(tmp_path / "x"), rows_per_file=300)
    found = catalogue.catalogue(spark, str(tmp_path / "x")).where("name like '%.csv'").collect()
    assert [r["status"] for r in found] == ["uploaded"] * 4 and len({r["sha256"] for r in found}) == 4
    read = csv.read_csv(spark, str(tmp_path / "x"), delimiter=",", encoding="UTF-8", multi_line=True)
    assert sorted(int(r["id"]) for r in read.collect()) == list(range(1_000)) and {r["t"] for r in read.collect()} == {"a\nb"}


def test_separators_are_counted_with_and_without_quotes(spark):
    """Lines without a quote are counted plainly; separators inside a quoted field do not count."""
    from pyspark.sql import functions as F

    from assayer.sources.csv import separators
    lines = {"a,b,c": 2, '"a,b",c': 1, 'a,"b ""x"", y",c': 2, 'a"b,c': 1, "": 0, "abc": 0, '"': 0, None: None}
    found = spark.createDataFrame([(x,) for x in lines], "line string").select("line", separators(F.col("line"), ",").alias("n")).collect()
    assert {r["line"]: r["n"] for r in found} == lines
