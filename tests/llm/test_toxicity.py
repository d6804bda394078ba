import random
import zlib

from cases import TEXTS, edge, empty

from assayer.llm import labelled, queries, toxicity
from assayer.llm.toxicity import Automaton, Lexicon


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_distances():
    rng = random.Random(3)
    words = ["stupid", "trash", "scum", "disgusting", "worthless", "abcabcabc", "aaaaa"]
    lexicon = Lexicon(frozenset(words), frozenset(["lowei", "zq"]), frozenset(["trash"]))
    automaton = Automaton(lexicon)
    tried = 0
    for _ in range(6000):
        word = list(rng.choice(words + ["loweia", "zqx"]))
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(word))
            word[k:k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "s"])
        word = "".join(word)
        near = sorted((d, w) for w in words if (d := distance(word, w)) <= lexicon.edits(w))
        stem = next((s for s in ("lowei", "zq") if word.startswith(s)), None)
        found = automaton.match(word)
        if near and near[0][0] == 0:
            assert found == (near[0][1], 0, False)
        elif stem:
            assert found == (stem, 0, True)
        else:
            assert found == ((near[0][1], near[0][0], False) if near else None), word
        tried += bool(near)
    assert tried > 2000


def test_quotation_and_address():
    automaton = Automaton(Lexicon(frozenset(["idiot"]), frozenset()))
    hit = toxicity.hits("You are an idiot today, my friend.", automaton)[0]
    assert hit[1:] == ("idiot", 0, False, False, True)
    for text in ('the word "idiot" is old', "he said idiot to them", 'they wrote "what an idiot" there'):
        assert toxicity.hits(text, automaton)[0][4], text
    assert toxicity.hits("an idi0t", automaton)[0][2] == 1


def learned(spark):
    rng = random.Random(4)
    plain = ["alpha", "beta", "gamma", "delta", "and", "the"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            words[rng.randint(0, 29)] = rng.choice(["stupid", "moron", "vequ" + rng.choice(["a", "e", "i", "on"])])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs, spark.createDataFrame(labels + labels[:3] + [(None, 1), (5000, 1), (1, None)], "doc_id bigint, toxic int")


def test_learning(spark):
    docs, labels = learned(spark)
    model = toxicity.fit(labelled.sample(docs, "doc_id", "text", labels, "doc_id", "toxic", 3, 1))
    assert model.lexicon.words >= {"stupid", "moron"} and "vequ" in model.lexicon.stems
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, "doc_id", "text", model).collect()}
    assert all((s >= 0.7) == (i % 4 == 0) for i, s in scores.items())
    again = spark.createDataFrame([(1, "a stupit thing"), (2, 'the word "stupid" is one'), (3, "beta alpha"), (4, None)], "doc_id bigint, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(again, "doc_id", "text", model).collect()}
    assert scores[1] >= 0.7 and scores[2] < 0.7 and scores[3] == scores[4] < 0.1
    found = {r["doc_id"]: r["hits"] for r in toxicity.find(again, "doc_id", "text", model.lexicon).collect()}
    assert found[1][0]["term"] == "stupid" and found[1][0]["edits"] == 1 and found[4] == []
    assert toxicity.score(edge(spark), "doc_id", "text", model).count() == len(TEXTS)
    assert toxicity.score(empty(spark), "doc_id", "text", model).count() == 0


def test_nothing_to_learn_from(spark):
    docs, labels = learned(spark)
    model = toxicity.fit(labelled.sample(docs, "doc_id", "text", labels.limit(0), "doc_id", "toxic", 3, 1))
    assert model.probability([0.0] * 6) == 0.5
    one = toxicity.fit(labelled.sample(docs, "doc_id", "text", labels.withColumn("toxic", labels.toxic * 0), "doc_id", "toxic", 3, 1))
    assert one.probability([0.0] * 6) < 0.05


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op2_toxicity"](spark, sf).collect()
    truth = {r["doc_id"]: r["toxic"] for r in queries.table(spark, sf, "labels").collect()}
    assert len(rows) == queries.table(spark, sf, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc > 0.8
    assert sum(s >= 0.7 for s in neg) <= 0.03 * len(neg)
