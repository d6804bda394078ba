import random
import re

import pytest
from cases import TEXTS, edge, empty

from assayer.llm import repeats


def brute(rows, window):
    """Rows in order; of every text its words, whether each goes, and what stays."""
    seen, out = set(), []
    for _, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i:i + window])
            if w in seen:
                gone[i:i + window] = [True] * window
            seen.add(w)
        out.append((len(words), sum(gone), [i for i, g in enumerate(gone) if g], " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def texts(seed, n=120, window=20):
    rng, rows = random.Random(seed), []
    few, many = ["a", "b", "é"], [f"w{i}" for i in range(400)]
    passages = [[rng.choice(many) for _ in range(rng.choice([window - 1, window, window + 1, 3 * window]))] for _ in range(6)]
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            words += rng.choice(passages) if kind < 0.5 else [rng.choice(few if kind < 0.6 else many) for _ in range(rng.randint(0, 3 * window))]
        rows.append((i * 3, "".join(w + rng.choice([" ", " ", "  ", "\n", "\t"]) for w in words)))
        if rng.random() < 0.2:
            rows.append((i * 3 + 1, rows[-1][1]))
    rng.shuffle(rows)
    return rows


def removed(spark, rows, window, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = repeats.remove(df, "doc_id", "text", window, **more).collect()
    return [(r["n_words"], r["n_removed"], [i for s in r["spans"] for i in range(s["first"], s["last"] + 1)], r["kept"])
            for r in sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))]


@pytest.mark.parametrize("window,more", [(20, {}), (20, {"most_sent": 0}), (20, {"hot": 2}), (6, {"hot": 1, "most_hot": 0, "most_sent": 0}), (3, {}), (1, {})])
def test_equal_to_brute_force(spark, monkeypatch, window, more):
    monkeypatch.setattr(repeats, "TOGETHER", 3_000)
    monkeypatch.setattr(repeats, "STEP", 97)
    monkeypatch.setattr(repeats, "SHARD", 50)
    rows = texts(window + len(more), window=window)
    want = brute(rows, window)
    assert removed(spark, rows, window, **more) == want and sum(w[1] for w in want) > 100 and any(0 < w[1] < w[0] for w in want)


def test_repeats_within_a_text_and_overlapping_windows(spark):
    run = " ".join("xy"[i % 2] for i in range(50))
    rows = [(1, run), (2, run + " z"), (3, "z " + run), (4, "a " * 40), (5, "A " * 40)]
    assert removed(spark, rows, 20) == brute(rows, 20)


def test_hub_of_copies_and_a_shared_passage(spark):
    """One text in many rows, and one passage between different words in many others."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(f"c{j}" for j in range(60))) for i in range(300)]
    rows += [(1_000 + i, " ".join(f"l{i}_{j}" for j in range(25)) + " " + passage + " " + " ".join(f"r{i}_{j}" for j in range(25))) for i in range(300)]
    want = brute(rows, 20)
    assert removed(spark, rows, 20) == want == removed(spark, rows, 20, hot=50)


def test_automaton_gives_matching_statistics():
    rng = random.Random(7)
    for _ in range(200):
        known = [[rng.randrange(3) for _ in range(rng.randint(0, 12))] for _ in range(4)]
        automaton = repeats.Automaton()
        for i, w in enumerate(known):
            automaton.add(i, w)
        probe, window = [rng.randrange(4) for _ in range(15)], rng.randint(1, 6)
        for at, matched, first in automaton.match(probe, window):
            best = max(k for k in range(min(window, at + 1) + 1)
                       if k == 0 or any(w[j:j + k] == probe[at - k + 1:at + 1] for w in known for j in range(len(w) - k + 1)))
            assert matched == best
            if best:
                assert first == min((i, j + best - 1) for i, w in enumerate(known) for j in range(len(w) - best + 1) if w[j:j + best] == probe[at - best + 1:at + 1])


def test_odd_rows_and_empty_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in edge(spark).collect()]
    out = repeats.remove(edge(spark), "doc_id", "text").collect()
    assert len(out) == len(TEXTS)
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out), key=lambda r: (*key(r), r[2]))
    want = [(i, n, gone, kept) for (i, _), (n, gone, _, kept) in zip(sorted(rows, key=key), brute(rows, 20))]
    assert got == want
    assert repeats.remove(empty(spark), "doc_id", "text").count() == 0
