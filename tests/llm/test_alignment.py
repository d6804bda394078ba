import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from cases import TEXTS, edge, empty, frame
from tokenizers import Tokenizer

from assayer.llm import alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SIGNS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {chr(b): b for b in SIGNS} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in SIGNS)}


@pytest.fixture(scope="module")
def tokenizers():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


def coded(tokenizers, text):
    """Ids and bytes of both sides for a whole text, encoded in one go."""
    first, second = tokenizers
    a = first.encode(" " + text, add_special_tokens=False).ids
    b = second.encode(text)
    bytes_a = [bytes(BYTES[c] for c in first.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(second.id_to_piece(i)[3:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
    return a, b, bytes_a, bytes_b


def brute(tokenizers, texts):
    """Every pair of token occurrences is looked at."""
    rows, holding = [], Counter()
    for text in texts:
        a, b, bytes_a, bytes_b = coded(tokenizers, text) if text else ([], [], [], [])
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            rows.append((0, 0, 0, [], ""))
            continue
        spans = [[], []]
        for side, tokens in zip(spans, (bytes_a, bytes_b)):
            at = 0
            for t in tokens:
                side.append((at, at + len(t)))
                at += len(t)
        links = [(x, y) for x, (s, e) in zip(a, spans[0]) for y, (u, v) in zip(b, spans[1]) if s < v and u < e]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [["", ""] for _ in cuts]
        for k, ids in enumerate((a, b)):
            parts = defaultdict(list)
            for i, (_, e) in zip(ids, spans[k]):
                parts[next(g for g, c in enumerate(cuts) if e <= c)].append(str(i))
            for g, ids_of in parts.items():
                groups[g][k] = ",".join(ids_of)
        holding.update(set(links))
        rows.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (x, _), n in holding.items():
        best[x] = max(best[x], n)
    return [(a, b, g, len(links), sum(holding[p] == best[p[0]] for p in links), sum(holding[p] for p in links), digest) for a, b, g, links, digest in rows]


ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b", "two words", "tabs\tand \n lines \n\n\nend", "don't we'll I'M", "naïve café — “quoted” 東京タワー \U0001f600\U0001f600",
       "literal \u2581 mark", "\u2581x", "x\u2581 y", "<|endoftext|> and <s> and <0x41> and </s> <unk>", "\x00 nul \x1c sep\x1c x", "   indented    code    here",
       "1234567 12 34,5", "\u00a0nbsp \u3000 wide", "e\u0301 combining", "\ufeffbom", "\r\n crlf \r\n", "zero\u200bwidth \u200b x", "x" * 300, "\u0085 next \u0085line", "ﬁ ligature ２３ ½"]


def got(out):
    return [tuple(r)[1:7] + (r["groups_sha256"],) for r in sorted(out.collect(), key=lambda r: r["doc_id"])]


def order(out):
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("together,sent", [(1 << 20, 1 << 20), (7, 1 << 20), (40, 0)])
def test_equal_to_brute_force_on_odd_texts(spark, tokenizers, monkeypatch, together, sent):
    monkeypatch.setattr(alignment, "TOGETHER", together)
    texts = ODD + ODD[5:12]
    out = order(alignment.align(frame(spark, list(enumerate(texts))).repartition(3), "doc_id", "text", A, B, sent))
    assert got(out) == brute(tokenizers, texts)


def test_equal_to_brute_force_on_documents(spark, tokenizers):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40).collect()
    rows = [(i, r["text"][:3000]) for i, r in enumerate(rows)]
    out = order(alignment.align(frame(spark, rows), "doc_id", "text", A, B))
    assert got(out) == brute(tokenizers, [t for _, t in rows])


def test_stretches_are_encoded_as_within_the_whole_text(tokenizers):
    aligner = alignment.Aligner(A, B)
    assert aligner.cuts
    for text in ODD:
        if text:
            parts = aligner.stretches(text)
            assert " ".join(parts) == text
            codes = aligner.encode(parts)
            a, b, *_ = coded(tokenizers, text)
            assert [i for c in codes for i in aligner.a.lists[c].as_py()] == a
            if "\u2581 " not in text:
                assert [i for c in codes for i in aligner.b.lists[c].as_py()] == b


def test_odd_rows_and_empty_table(spark):
    out = order(alignment.align(edge(spark), "doc_id", "text", A, B)).collect()
    assert len(out) == len(TEXTS)
    zero = [r for r in out if r["n_a"] == 0]
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in zero) and {r["doc_id"] for r in zero} == {1, 2}
    twice = [tuple(r)[1:] for r in out if r["doc_id"] is None]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0][0] > 0
    assert alignment.align(empty(spark), "doc_id", "text", A, B).count() == 0


def test_memory_of_stretches_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED_CHARS", 100)
    aligner = alignment.Aligner(A, B)
    first = list(aligner.align([" ".join(f"w{i}" for i in range(50)), "x y z"]))
    again = list(aligner.align(["x y z"]))
    assert first[1][:5] == again[0][:5] and len(aligner.known) == 3
