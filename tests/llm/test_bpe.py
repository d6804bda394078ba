import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from cases import TEXTS, edge, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def coded(codec, texts):
    ids, begins = codec.encode_all(texts)
    return [ids[a:b].tolist() for a, b in zip(begins, begins[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_any_text(texts):
    ids = coded(CODEC, texts)
    assert ids == [THEIRS.encode_ordinary(t) for t in texts]
    assert [CODEC.decode(x) for x in ids] == [t.encode() for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aabcé 1'", max_size=200))
def test_chains_of_equal_letters(text):
    assert CODEC.encode(text) == THEIRS.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 30_001, "ab" * 9_000, "".join(random.Random(1).choice("etaoinshr") for _ in range(60_000)), " " * 3000 + "x"])
def test_very_long_pre_tokens(text):
    assert CODEC.encode(text) == THEIRS.encode_ordinary(text)


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    monkeypatch.setattr(bpe, "TOGETHER", 50)
    monkeypatch.setattr(bpe, "SHARED", 30)
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(20)) for _ in range(40)]
    for a in range(0, 40, 3):  # parts, as the memory starts anew between them only
        assert coded(codec, texts[a:a + 3]) == [THEIRS.encode_ordinary(t) for t in texts[a:a + 3]] and len(codec.numbers) < 100


def test_frames(spark):
    from assayer.llm import queries
    out = bpe.encode(edge(spark), "doc_id", "text", PATH, public_tokenizers.PATTERN, with_bytes=True).collect()
    expected = sorted(((i, THEIRS.encode_ordinary(t or ""), (t or "").encode()) for i, t in TEXTS), key=str)
    assert sorted(((r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in out), key=str) == expected
    assert bpe.encode(empty(spark), "doc_id", "text", PATH, public_tokenizers.PATTERN).count() == 0
    back = bpe.decode(spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "k int, ids array<int>"), "k", "ids", PATH)
    assert {r["k"]: bytes(r["decoded"]) for r in back.collect()} == {1: THEIRS.decode_bytes([1, 2]), 2: b"", 3: b""}
    rows = queries.QUERIES["op9_bpe"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = THEIRS.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
