import zlib

from cases import TEXTS, edge, empty

from assayer.llm import labelled, queries, rules
from pyspark.sql import functions as F


def test_statistics(spark):
    df = spark.createDataFrame([(1, "Aa bb bb |"), (2, None), (3, "x\nx\ny")], "i int, text string")
    out = {r["i"]: r for r in rules.statistics(df).collect()}
    assert out[1]["__repeated_words"] == 0.25 and out[1]["__distinct_words"] == 0.75 and out[1]["__bars"] == 0.25
    assert out[1]["__upper"] == 0.1 and out[1]["__symbols"] == 0.1
    assert out[2]["__distinct_words"] == 1 and out[2]["__mean_word"] == 0
    assert abs(out[3]["__distinct_lines"] - 2 / 3) < 1e-12


def brute(rule, row):
    return all((low is None or row[f"__{k}"] > low) and (high is None or row[f"__{k}"] <= high) for k, low, high in rule.bounds)


def test_fit_and_compiled_score(spark):
    sf = "/root/testdata/sf0.01"
    docs = queries.table(spark, sf, "documents")
    model = queries.quality_model(spark, docs, sf)
    assert 0 < len(model.weights) < 80
    import math
    stats = {r["doc_id"]: r for r in rules.statistics(docs.select("doc_id", "text")).collect()}
    for r in model.score(docs.select("doc_id", "text")).collect():
        total = model.intercept + sum(w for rule, w in model.weights if brute(rule, stats[r["doc_id"]]))
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9
    rows = queries.QUERIES["op3_rules"](spark, sf).collect()
    truth = {r["doc_id"]: r["quality"] for r in queries.table(spark, sf, "labels").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_odd_rows_and_one_class(spark):
    docs = edge(spark)
    labels = spark.createDataFrame([(i, 1) for i in range(1, 9)], "doc_id bigint, quality int")
    model = rules.fit(labelled.sample(docs, "doc_id", "text", labels, "doc_id", "quality", 4, 2))
    assert not model.weights and model.intercept > 2
    scored = model.score(docs, "text", "found")
    assert scored.columns == docs.columns + ["found"]
    assert scored.count() == len(TEXTS)
    assert model.score(empty(spark), "text", "found").count() == 0
    none = rules.fit(labelled.sample(docs, "doc_id", "text", labels.limit(0), "doc_id", "quality", 4, 2))
    assert none.score(docs, "text", "found").select(F.min("found"), F.max("found")).first() == (0.5, 0.5)
