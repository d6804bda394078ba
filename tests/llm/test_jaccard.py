import os
import random
import re
import sys

import numpy as np
import pytest
from cases import TEXTS, edge, empty, frame

from assayer.llm import components, jaccard, queries
from assayer.llm.jaccard import Join


def shingle_set(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1)))


def brute(rows, words, num, den):
    """Smallest id reachable by links, per row."""
    sets = [shingle_set(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * den >= num * max(len(a), len(b)) and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), key), key)
    return sorted((key, len(sets[i]), least[root(i)]) for i, (key, _) in enumerate(rows))


def near_copies(seed, groups=25, members=12):
    """Groups around the threshold: copies with a few words replaced, added or cut, of texts from 1 to 200 words."""
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 20, 40, 80, 200]))]
        if g % 3 == 0:
            base = passage + base
        for _ in range(members):
            text = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                k = rng.randrange(len(text) + 1)
                text[k:k + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
            rows.append((0, " ".join(text) if rng.random() < 0.9 else "\n".join(text).upper()))
    rng.shuffle(rows)
    return [(i * 2 + 1, t) for i, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("words,num,den,seed", [(4, 85, 100, 1), (5, 80, 100, 2), (1, 85, 100, 3), (4, 50, 100, 4)])
def test_components_against_brute_force(spark, words, num, den, seed):
    rows = near_copies(seed)
    out = jaccard.join_components(frame(spark, rows).repartition(6), "doc_id", "text", words, num, den)
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, words, num, den)


def test_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 200)
    monkeypatch.setattr(jaccard, "MOST_SENT", 0)
    rows = near_copies(9, groups=6, members=40)
    out = jaccard.join_components(frame(spark, rows), "doc_id", "text", 4, 85, 100)
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, 4, 85, 100)


def test_linked_sets_share_a_signature():
    join, rng = Join(4, 85, 100), random.Random(5)
    for size in (*range(1, 60), 100, 150, 333, 1000):
        for _ in range(6):
            a = {rng.getrandbits(63) for _ in range(size)}
            b = set(a)
            for _ in range(200):
                c = set(b)
                if rng.random() < 0.5 and len(c) > 1:
                    c.remove(rng.choice(sorted(c)))
                if rng.random() < 0.5:
                    c.add(rng.getrandbits(63))
                if 100 * len(a & c) < 85 * len(a | c):
                    break
                b = c
            sets = [np.array(sorted(x), dtype=np.uint64) for x in (a, b)]
            sigs, who, _ = jaccard.signatures(np.concatenate(sets), np.array([0, len(a), len(a) + len(b)]), join)
            assert set(sigs[who == 0].tolist()) & set(sigs[who == 1].tolist()), (size, len(a), len(b))


def test_sketches_of_linked_sets_are_near():
    join, rng = Join(5, 80, 100), random.Random(8)
    for n in (1, 2, 4, 5, 63, 64, 65, 127, 128, 200, 900):
        for _ in range(40):
            whole = [rng.getrandbits(63) for _ in range(n + n // 4)]
            a, b = set(rng.sample(whole, rng.randint(max(1, n * 9 // 10), n))), set(whole[:rng.randint(max(1, n * 9 // 10), len(whole))])
            sets = [np.array(sorted(x), dtype=np.uint64) for x in (a, b)]
            found = jaccard.sketches(np.concatenate(sets), np.array([0, len(a), len(a) + len(b)]))
            if 100 * len(a & b) >= 80 * len(a | b):
                assert jaccard.near([len(a), len(b)], found, join) == [(0, 1)], (n, len(a), len(b))
    strangers = [np.array([rng.getrandbits(63) for _ in range(300)], dtype=np.uint64) for _ in range(30)]
    found = jaccard.sketches(np.concatenate(strangers), np.arange(0, 30 * 300 + 1, 300))
    assert jaccard.near([300] * 30, found, join) == []


@pytest.mark.parametrize("tile", [1 << 21, 100])
def test_a_shared_passage_makes_no_block(spark, monkeypatch, tile):
    """Texts of one common passage share signatures of a single shingle; only near copies among them reach the search."""
    monkeypatch.setattr(jaccard, "SKETCH_TILE", tile)
    rng, rows = random.Random(3), []
    passage = [f"p{i}" for i in range(30)]
    for i in range(150):
        own = passage + [f"w{rng.randrange(10 ** 9)}" for _ in range(70)]
        rows.append((3 * i, " ".join(own)))
        if i % 10 == 0:
            rows.append((3 * i + 1, " ".join([*own[:-2], "end"])))
    kept, whole = [], jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, name="stage": kept.append((name, whole(df, name))) or kept[-1][1])
    out = jaccard.join_components(frame(spark, rows), "doc_id", "text", 5, 80, 100)
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, 5, 80, 100)
    assert dict(kept)["units"].count() == 30


def test_search_finds_all_pairs():
    rng, join = random.Random(6), Join(4, 80, 100)
    sets = []
    for _ in range(12):
        base = rng.sample(range(10_000), rng.randint(3, 60))
        for _ in range(6):
            sets.append(np.array(sorted(set(base[:rng.randint(len(base) * 3 // 4, len(base))] + rng.sample(range(10_000), rng.randint(0, 4)))), dtype=np.uint64))
    index = jaccard.Lists(sets, join)
    found = {(q, d) for q in range(len(sets)) for d in index.search(q, lambda d: False)}
    truth = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
             if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert found == truth and truth


def test_odd_rows(spark):
    out = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_components(edge(spark), "doc_id", "text").collect()}
    assert {(1, 0, 1), (2, 0, 2), (7, 0, 7), (9, 3, 8), (8, 3, 8), (None, 2, None)} <= out
    assert jaccard.join_components(edge(spark), "doc_id", "text").count() == len(TEXTS)
    assert jaccard.join_components(empty(spark), "doc_id", "text").count() == 0


def test_hash_ignores_layout():
    texts = [b"A b  c\td", b"a B\nc d", b"a b c d e", b"ab c d"]
    sets, begins = jaccard.shingles(texts, 4)
    one, two, three, four = (sets[begins[i]:begins[i + 1]].tolist() for i in range(4))
    assert one == two and len(three) == 2 and one[0] in three and four != one


def test_graph_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(rng.randint(300, 360), rng.randint(300, 360)) for _ in range(50)] \
        + [(7, 7), (None, 3), (4, None), (9, 8), (8, 9), (9, 8)]
    out = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert out[node] == min(seen)
    assert set(out) == set(near)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_query_agrees_with_sql(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
    from compare import connect, differences
    sf = "/root/testdata/sf0.001"
    assert differences(connect(sf), queries.SQL["op4_jaccard"], queries.QUERIES["op4_jaccard"](spark, sf)) == ""
