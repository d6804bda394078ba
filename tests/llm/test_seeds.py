import random
import re
import unicodedata

import numpy as np
from cases import edge, empty

from assayer.llm import queries, seeds


def words_of(text):
    lower = "".join(" " if ord(c) > 127 and (unicodedata.category(c)[0] in "PSZ" or ord(c) < 160) else c for c in (text or "").lower())
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower)


def brute(text, item):
    """Best stretch over all diagonals; of an unchanged item it is the whole."""
    a, b = words_of(text), words_of(item)
    if len(b) < 4:
        return len(b) if a == b else 0
    best = 0
    for d in range(-len(b) + 1, len(a)):
        same = [a[i] == b[i - d] for i in range(max(0, d), min(len(a), d + len(b)))]
        run, start = 0.0, 0
        top = (0.0, 0, 0)
        for k, s in enumerate(same):
            if run < 0 or k == 0:
                run, start = 0.0, k
            run += 1 if s else -2
            if run > top[0]:
                top = (run, start, k + 1)
        n = sum(same[top[1]:top[2]])
        if n >= min(12, -(-len(b) * 4 // 5)) and n >= 0.75 * (top[2] - top[1]):
            best = max(best, n)
    return best


VOCABULARY = [f"w{i}" for i in range(400)]


def made(seed, rate):
    rng = random.Random(seed)
    items = [(k, " ".join(rng.choice(VOCABULARY) for _ in range(n))) for k, n in enumerate([3, 6, 8, 12, 20, 35, 60, 20])]
    rows = []
    for i in range(60):
        words = [rng.choice(VOCABULARY) for _ in range(rng.randint(0, 120))]
        if i % 2:
            passage = [rng.choice(VOCABULARY) if rng.random() < rate else w for w in items[i // 2 % len(items)][1].split()]
            at = rng.randint(0, len(words))
            words[at:at] = passage
        rows.append((i, ", ".join(words).title() if i % 3 else " ".join(words)))
    return rows, items


def test_exact_passages_are_all_found(spark):
    rows, items = made(1, 0.0)
    out = seeds.overlaps(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text",
                         spark.createDataFrame(items, "item_id int, text string"), "item_id", "text").collect()
    want = sorted((i, k, n) for i, t in rows for k, x in items if (n := brute(t, x)))
    assert sorted((r["doc_id"], r["item_id"], r["n_matched"]) for r in out) == want and len(want) >= 26
    texts = dict(rows)
    for r in out:
        words = re.findall(r"\w+", texts[r["doc_id"]].lower())[r["word_start"]:r["word_end"]]
        assert sum(w in dict(items)[r["item_id"]].split() for w in words) >= r["n_matched"]


def test_substitutions_near_the_ends_do_not_hide_an_item(spark):
    item = [f"i{k}" for k in range(15)]
    changed = [f"x{k}" if k in (1, 13) else w for k, w in enumerate(item)]  # 13 of 15 match, 11 of them in a row
    rows = [(1, " ".join(["before", "it", *changed, "after", "it"])), (2, " ".join(changed[2:13]))]
    out = seeds.overlaps(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text",
                         spark.createDataFrame([(7, " ".join(item))], "item_id int, text string"), "item_id", "text").collect()
    assert [tuple(r) for r in out] == [(1, 7, 2, 17, 13, 15)]


def test_best_stretch_has_the_most_matches_of_all_with_the_share():
    rng = random.Random(4)
    for _ in range(500):
        same = [rng.random() < rng.choice([0.3, 0.7, 0.9]) for _ in range(rng.randint(0, 30))]
        spans = [(a, b) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if sum(same[a:b]) >= 0.75 * (b - a)]
        start, end, matched = seeds.best_stretch(np.array(same, dtype=bool))
        assert matched == max((sum(same[a:b]) for a, b in spans), default=0) == sum(same[start:end])
        assert (start, end) in spans or not matched


def stated(text, item):
    """Whether any stretch of any diagonal meets both bounds."""
    a, b = words_of(text), words_of(item)
    if len(b) < 4:
        return bool(b) and a == b
    for d in range(-len(b) + 1, len(a)):
        runs = np.cumsum([0, *(a[i] == b[i - d] for i in range(max(0, d), min(len(a), d + len(b))))])
        matched, length = runs[None, :] - runs[:, None], np.arange(len(runs))[None, :] - np.arange(len(runs))[:, None]
        if ((length > 0) & (matched >= min(12, -(-len(b) * 4 // 5))) & (matched >= 0.75 * length)).any():
            return True
    return False


def test_substituted_passages_are_those_of_the_stated_rule(spark, monkeypatch):
    monkeypatch.setattr(seeds, "BLOCK_CHARS", 300)  # several blocks
    found = total = 0
    for seed in (2, 3):
        rows, items = made(seed, 0.08)
        out = seeds.overlaps(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text",
                             spark.createDataFrame(items, "item_id int, text string"), "item_id", "text").collect()
        want = {(i, k) for i, t in rows for k, x in items if stated(t, x)}
        got = {(r["doc_id"], r["item_id"]) for r in out}
        assert got <= want
        found, total = found + len(got), total + len(want)
    assert found >= 0.97 * total


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "the same words here and there again", "x"), (2, None, "y"), (3, "", "z"), (3, "the same words here and there again", "z")],
                                  "item_id int, text string, id string")
    out = seeds.overlaps(edge(spark), "doc_id", "text", items, "item_id", "text")
    assert sorted((r["doc_id"], r["item_id"]) for r in out.collect()) == [(8, 1), (8, 3), (9, 1), (9, 3)]
    assert seeds.overlaps(empty(spark), "doc_id", "text", items, "item_id", "text").count() == 0
    assert seeds.overlaps(edge(spark), "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_query_finds_the_planted_passages(spark):
    sf = "/root/testdata/sf0.01"
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    docs = {r["doc_id"]: plain(r["text"]) for r in queries.table(spark, sf, "documents").collect()}
    items = {r["item_id"]: plain(r["text"]) for r in queries.table(spark, sf, "benchmark").collect()}
    whole = {(i, k) for i, t in docs.items() for k, x in items.items() if f" {x} " in f" {t} "}
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op5_decontamination"](spark, sf).collect()}
    assert whole and whole <= got


def test_signs_of_any_script_end_words_and_short_items_are_whole_texts(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (2, "\u201calpha beta\u201d \u2014 gamma\u2026delta epsilon\u3000zeta\u3002"), (3, "The one"), (4, "the"),
            (5, "so the one goes"), (6, "THE, one!"), (7, "caf\u00e9 \u0939\u093f\u0928\u094d\u0926\u0940 x y")]
    items = [(1, "\u201calpha beta gamma delta epsilon zeta\u201d"), (2, "the"), (3, "the one"), (4, "caf\u00e9 \u0939\u093f\u0928\u094d\u0926\u0940 x y")]
    out = seeds.overlaps(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text",
                         spark.createDataFrame(items, "item_id int, text string"), "item_id", "text").collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_matched"]) for r in out) == [(1, 1, 6), (2, 1, 6), (3, 3, 2), (4, 2, 1), (6, 3, 2), (7, 4, 4)]
