import os

import pytest

import corpus_pipeline
from assayer.llm import jaccard, queries, seeds
from assayer.session import materialise

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet"))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF), "test"))
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"] and df.schema == stages[0].schema
    assert stages[-1].columns == ["doc_id", "n_tokens", "ids"]


def test_each_decision_against_brute_force(spark, stages):
    from test_bpe import THEIRS
    from test_jaccard import brute
    from test_secret_scan import brute as spans
    docs, good, single, clean, masked, coded = stages
    labels = {r["doc_id"]: r["quality"] for r in queries.table(spark, SF, "labels").collect()}
    rejected = ids(docs) - ids(good)
    assert all(labels.get(i, 0) == 0 for i in rejected) and rejected
    assert sum(labels.get(i) == 0 for i in ids(good)) <= 0.1 * sum(v == 0 for v in labels.values()) + 1
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert ids(single) == {c for _, _, c in brute(rows, 5, 80, 100)}
    found = {r["doc_id"] for r in seeds.overlaps(single, "doc_id", "text", queries.table(spark, SF, "benchmark"), "item_id", "text").collect()}
    assert ids(clean) == ids(single) - found
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in masked.collect():
        assert r["n_chars"] == len(r["text"]) and not spans(r["text"])
        if not spans(before[r["doc_id"]]) and r["text"] != before[r["doc_id"]]:
            raise AssertionError("a clean text was changed")
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert {r["doc_id"]: list(r["ids"]) for r in coded.collect()} == {k: THEIRS.encode_ordinary(t) for k, t in texts.items()}


def test_run(spark, stages, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_SENT", 0)  # the ways for many rows
    monkeypatch.setattr(corpus_pipeline, "MOST_SENT", 0)
    out = corpus_pipeline.run(spark, SF)
    assert {(r["doc_id"], tuple(r["ids"])) for r in out.collect()} == {(r["doc_id"], tuple(r["ids"])) for r in stages[-1].collect()}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "x y", None, None, None), (3, "x y z", "en", "s", 5), (3, "x y z", "en", "s", 5)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for frame in (docs, docs.limit(0)):
        kept = frame
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, SF)
        assert kept.count() == 0 or kept.columns == ["doc_id", "n_tokens", "ids"]


def test_rows_are_dropped_by_place_whatever_their_ids_are(spark, tmp_path):
    item = queries.table(spark, SF, "benchmark").orderBy("item_id").first()["text"]
    long = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"else{i}" for i in range(60))
    rows = [(7, long), (7, other), (7, long), (None, long), (None, item), (8, item), (8, "a clean text of its own"), (None, "nothing else here"),
            (None, "nothing else here"), (9, None), (9, None), (10, ""), (5, other + " end")]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint") \
        .coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)

    def texts(df):
        return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    single = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert texts(single) == sorted([(5, other + " end"), (7, long), (8, item), (8, "a clean text of its own"), (None, "nothing else here"), (9, None), (9, None), (10, "")],
                                   key=str)
    clean = corpus_pipeline.decontaminate(spark, docs, SF)
    assert texts(clean) == sorted([(i, t) for i, t in rows if t != item], key=str)


def test_stages_send_small_batches_and_leave_the_session_as_it_was(spark, monkeypatch):
    setting, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(setting)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("look", lambda s, docs, _: seen.append(int(s.conf.get(setting))) or docs)])
    corpus_pipeline.run(spark, SF)
    assert seen == [corpus_pipeline.ROWS_SENT] and spark.conf.get(setting) == before
