import datetime as dt
import os
import sys

from assayer.llm import queries, revisits

SCHEMA = "record_id bigint, url string, captured timestamp, status int, headers map<string,string>, payload_digest string, url_key string"


def at(hour):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


def brute(rows):
    out = []
    for key, host, time, status, headers, _ in rows:
        if status != 304:
            continue
        earlier = [r for r in rows if r[3] == 200 and r[1] is not None and r[1] == host and time is not None and r[2] is not None and r[2] < time]
        if not earlier:
            out.append((key, "orphan", None, None))
            continue
        r = max(earlier, key=lambda x: (x[2], x[0]))
        a, b = (r[4] or {}), (headers or {})
        if "etag" in a and "etag" in b:
            good = a["etag"].removeprefix("W/") == b["etag"].removeprefix("W/")
        elif "last-modified" in a and "last-modified" in b:
            good = a["last-modified"] == b["last-modified"]
        else:
            good = True
        out.append((key, "resolved" if good else "changed", r[0], r[5] if good else None))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return sorted(((r["record_id"], r["state"], r["response_id"], r["payload_digest"]) for r in revisits.resolve(df, **kw).collect()), key=str)


def test_random_captures(spark):
    import random
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot"] * 6 + ["b", "c", None]), at(rng.randint(0, 60)) if rng.random() > 0.03 else None, rng.choice([200, 304, 304, 404]),
             rng.choice([None, {}, {"etag": "1"}, {"etag": "W/1"}, {"etag": "2"}, {"last-modified": "x"}, {"last-modified": "y", "etag": "2"}]), f"d{i}")
            for i in range(600)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, slices=3) == brute(rows)


def test_ties_repeats_and_nothing(spark):
    rows = [(1, "a", at(1), 200, {"etag": "1"}, "d1"), (2, "a", at(1), 200, {"etag": "1"}, "d2"), (3, "a", at(1), 304, {"etag": "1"}, None),
            (4, "a", at(2), 304, {"etag": "1"}, None), (4, "a", at(2), 304, {"etag": "1"}, None)]
    assert run(spark, rows) == [(3, "orphan", None, None), (4, "resolved", 2, "d2"), (4, "resolved", 2, "d2")]
    assert run(spark, []) == []


def test_headers_and_urls(spark):
    df = spark.sql("""select map('etag', '1', 'content-length', '9', 'cache-control', 'a', 'x', '1') as s,
                      map('content-length', '0', 'cache-control', 'b', 'y', '2') as f""")
    assert df.select(revisits.header_text(revisits.merge_headers(df.s, df.f))).first()[0] == "cache-control: b; content-length: 9; etag: 1; x: 1; y: 2"
    urls = ["HTTP://WWW.Example.com:80/a/b/?utm_source=x&b=2&a=1#top", "https://example.com/a/b?a=1&b=2", "example.com/a/b/?a=1&b=2&ref=q"]
    keys = spark.createDataFrame([(u,) for u in urls], "u string").select(revisits.canonical_url(revisits.F.col("u")).alias("k")).distinct().collect()
    assert [r["k"] for r in keys] == ["example.com/a/b?a=1&b=2"]
    block = spark.sql(r"select 'HTTP/1.1 304\r\nETag: \"x\"\r\nA: 1\r\na:2\r\n' as b")
    assert block.select(revisits.parse_headers(revisits.F.col("b"))).first()[0] == {"etag": '"x"', "a": "2"}


def test_payloads(spark):
    rows = [(1, "a", at(1), 200, {}, "d1", "k"), (2, "a", at(2), 304, {}, None, "k"), (3, "b", at(2), 304, {}, None, "k")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = revisits.attach_payload(revisits.resolve(df), df.withColumn("body", revisits.F.concat(revisits.F.lit("body"), "record_id")), "record_id", "body")
    assert {r["record_id"]: r["payload"] for r in out.collect()} == {2: "body1", 3: None}


def test_query_agrees_with_sql(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
    from compare import connect, differences
    sf = "/root/testdata/sf0.001"
    assert differences(connect(sf), queries.SQL["op10_revisits"], queries.QUERIES["op10_revisits"](spark, sf)) == ""
