import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import edge, empty

from assayer.llm import collocations


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def brute(rows, least, longest=4, share=80, most=2_000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in words_of(text):
            n[lang] += len(piece)
            for k in range(1, longest + 1):
                f.update((lang, tuple(piece[i:i + k])) for i in range(len(piece) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                key = lang, w[i:i + k]
                inside[key] = max(inside[key], a)
    out = []
    for (lang, w), a in found.items():
        if inside[lang, w] and 100 * inside[lang, w] >= share * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    result = []
    for lang in n:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:most]
        result += [(x[0], i, *x[1:]) for i, x in enumerate(mine, 1)]
    return sorted(result)


def texts(seed, n=250):
    rng = random.Random(seed)
    some = ["Alpha", "beta", "GAMMA", "delta", "é\U0001f600", "x\x1fy", "don't", "\u00a0", "z-z"]
    phrases = ["new york city hall", "alpha beta", "in spite of", "a a a a a"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.3 else rng.choice(some) for _ in range(rng.randint(0, 30))]
        rows.append((rng.choice(["en", "fr", None, "x y", ""]), "".join(p + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ; "]) for p in parts)))
    return rows + [("en", None), ("en", ""), ("de", "only once here")]


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    out = collocations.mine(df, "text", "lang", **more)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("sent,together,run", [(1 << 20, 1 << 20, 1_000), (0, 1 << 20, 7), (20, 64, 5)])
def test_equal_to_brute_force(spark, monkeypatch, sent, together, run):
    monkeypatch.setattr(collocations, "TOGETHER", together)
    monkeypatch.setattr(collocations, "RUN", run)
    monkeypatch.setattr(collocations, "COUNTED", 50)
    rows = texts(run)
    want = brute(rows, 8)
    assert any(len(x[2].split()) == 4 for x in want) and len({x[0] for x in want}) > 3
    assert mined(spark, rows, least=8, most_sent=sent) == want


def test_first_phrases_of_a_language_and_ties(spark):
    rows = [("en", f"a{i} b{i}.") for i in range(40)] * 3 + [("en", "c d, c d; c d")]
    got = mined(spark, rows, least=3, most=5)
    assert got == brute(rows, 3, most=5) and [r[2] for r in got] == ["a0 b0", "a1 b1", "a10 b10", "a11 b11", "a12 b12"]


def test_score_needs_more_than_64_bits(spark):
    score = spark.sql("select (cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div cast(l as decimal(20,0)) as s "
                      "from values (9000000000000000000, 9000000000000000001) as t(a, l)").first()["s"]
    assert score == 2_000_000 * 9_000_000_000_000_000_000 // 9_000_000_000_000_000_001


def test_odd_rows_and_empty_tables(spark):
    df = edge(spark).withColumnRenamed("spans", "lang")
    rows = [(r["lang"], r["text"]) for r in df.collect()]
    got = sorted(tuple(r) for r in collocations.mine(df, "text", "lang").collect())
    assert got == brute(rows, 30) and got
    assert collocations.mine(empty(spark), "text", "word").count() == 0


def test_words_whose_hashes_are_equal_are_told_apart(monkeypatch):
    monkeypatch.setattr(collocations._Words, "_hash", staticmethod(lambda keys: np.array([len(k) for k in keys.to_pylist()], dtype=np.uint64)))
    table = collocations._Words(pa.array(["aa x", "bb x", "c x"]), np.array([5, 6, 7]))
    assert table.find(pa.array(["bb x", "c x", "dd x", "aa x", "e x"])).tolist() == [6, 7, -1, 5, -1]
