import collections
import math
import zlib

import numpy as np
from cases import TEXTS, edge, empty
from pyspark.sql import functions as F

from assayer.llm import labelled, ppm, queries


class Brute:
    """Contexts in dictionaries, symbol by symbol."""

    def __init__(self, texts):
        self.tables = [collections.defaultdict(collections.Counter) for _ in range(5)]
        self.words = collections.Counter()
        for t in texts:
            s = b"\xfe" * 4 + t.encode() + b"\xff"
            for p in range(4, len(s)):
                for o in range(5):
                    self.tables[o][s[p - o:p]][s[p]] += 1
            self.words.update(t.encode().lower().split())
            self.words[b"\n"] += 1

    def symbol(self, s, p):
        out, excluded = 0.0, set()
        for o in range(4, -1, -1):
            seen = self.tables[o].get(s[p - o:p])
            if not seen:
                continue
            left = {k: v for k, v in seen.items() if k not in excluded}
            if s[p] in left:
                return out + math.log10(left[s[p]] / (sum(left.values()) + len(left)))
            if left:
                out += math.log10(len(left) / (sum(left.values()) + len(left)))
            excluded |= set(seen)
        return out - math.log10(255 - len(self.tables[0].get(b"", ())))

    def score(self, t):
        s = b"\xfe" * 4 + t.encode() + b"\xff"
        return sum(self.symbol(s, p) for p in range(4, len(s)))

    def base(self, t):
        words = t.encode().lower().split() + [b"\n"]
        n, v = sum(self.words.values()), len(self.words)
        return len(words), sum(self.words[w] > 0 for w in words), sum(math.log10((self.words[w] + 1) / (n + v + 1)) for w in words)


def agree(rows, texts, brute):
    assert len(rows) == len(texts)
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 4)) for r in rows), key=str)
    want = []
    for i, t in texts:
        n, k, b = brute.base(t or "")
        want.append((i is None, i, n, k, round(b, 5), round(brute.score(t or ""), 4)))
    for a, b in zip(got, sorted(want, key=str)):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-3 and abs(a[5] - b[5]) < 2e-3 * (1 + abs(b[5]) * 1e-4), (a, b)


def run(df, **kw):
    learn = labelled.fold(F.col("doc_id"), 7) != 2
    model = ppm.train(df, "doc_id", "text", learn)
    return ppm.score(df, "doc_id", "text", learn, model, **kw).collect(), model


def learned(rows):
    return [t or "" for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]


def test_odd_rows(spark):
    brute = Brute(learned(TEXTS))
    rows, model = run(edge(spark))
    agree(rows, TEXTS, brute)
    assert model.tokens == sum(brute.words.values())
    assert run(empty(spark))[0] == []


def test_both_ways_of_meeting_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents").filter("doc_id < 60")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    brute = Brute(learned(texts))
    agree(run(docs)[0], texts, brute)
    agree(run(docs, most_sent=10, frequent=20)[0], texts, brute)


def test_nothing_learned(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    df = spark.createDataFrame([(held, "ab")], "doc_id bigint, text string")
    row = run(df)[0][0]
    assert row["n_known"] == 0 and row["base_score"] == 0 and abs(row["score"] + 3 * math.log10(255)) < 1e-9


def test_probabilities_add_up():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 100, 30).tolist()) for _ in range(20)]
    keys, counts = np.unique(ppm.grams(texts)[0], return_counts=True)
    pairs = np.zeros((256, 256))
    for k, n in zip(keys.tolist(), counts.tolist()):
        pairs[(k >> 8) & 255, k & 255] += n
    for context in (0x61626361, 0x7A7A7A7A, 0x7A7A6161):
        asked = np.array([context << 8 | s for s in range(256) if s != ppm.START], dtype=np.uint64)
        every = np.unique(np.concatenate([keys, asked]))
        weights = np.zeros(len(every), dtype=np.int64)
        weights[np.searchsorted(every, keys)] = counts
        logs = ppm.log_probabilities(every, weights, pairs)
        assert abs((10 ** logs[np.searchsorted(every, asked)]).sum() - 1) < 1e-9
