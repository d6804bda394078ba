import random
import zlib
from collections import Counter

from cases import TEXTS, edge, empty, frame

from assayer.llm import sharding


def check(rows, out, shards):
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out if r["doc_id"] is not None) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
    counts = Counter(r["shard"] for r in out)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    for s in range(shards):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))


def test_odd_rows(spark):
    check(TEXTS, sharding.shuffle_to_shards(edge(spark), "doc_id", "text").collect(), 16)
    assert sharding.shuffle_to_shards(empty(spark), "doc_id", "text").count() == 0


def test_many_partitions_and_repeatable(spark):
    rng = random.Random(3)
    rows = [(i, "w" * rng.randint(0, 9)) for i in range(3000)]
    one = sharding.shuffle_to_shards(frame(spark, rows), "doc_id", "text", rows_per_partition=40).collect()
    check(rows, one, 16)
    two = sharding.shuffle_to_shards(frame(spark, rows[::-1]).repartition(5), "doc_id", "text", rows_per_partition=40).collect()
    assert sorted(one) == sorted(two)
    # neighbours of the input are spread over the shards as by chance
    place = {r["doc_id"]: r["shard"] for r in one}
    same = sum(place[i] == place[i + 1] for i in range(2999))
    assert 130 < same < 245


def test_matrix_has_exact_margins():
    rng = random.Random(4)
    for seed in range(20):
        shards = [rng.randint(0, 30) for _ in range(6)]
        left, parts = sum(shards), []
        while left:
            parts.append(rng.randint(0, left))
            left -= parts[-1]
        m = sharding.communication_matrix(parts, shards, seed)
        assert [sum(x) for x in m] == parts and [sum(c) for c in zip(*m)] == shards if m else not sum(shards)


def test_matrix_is_hypergeometric():
    drawn = [sharding.communication_matrix([5, 5], [5, 5], s)[0][0] for s in range(3000)]
    expected = [1 / 252, 25 / 252, 100 / 252, 100 / 252, 25 / 252, 1 / 252]
    for k, p in enumerate(expected):
        assert abs(drawn.count(k) / 3000 - p) < 0.03


def test_huge_populations():
    import numpy as np
    rng = np.random.default_rng(1)
    draws = [sharding._hypergeometric(rng, 4_000_000_000, 6_000_000_000, 1_000_000) for _ in range(200)]
    assert abs(np.mean(draws) - 400_000) < 120 and 380 < np.std(draws) < 620
    assert sharding._hypergeometric(rng, 0, 2_000_000_000, 5) == 0
