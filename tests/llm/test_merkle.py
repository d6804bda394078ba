import hashlib
import random
import time

import pytest
from cases import TEXTS, edge, empty, frame
from pyspark.sql import functions as F

from assayer.llm import merkle


def brute(rows):
    """The contract on a list of (id, text)."""
    rows = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (key, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        third = len(text) // 3
        new = text[:len(text) - third] + following[:third]
        out.append((key, len(text), hashlib.sha256(new.encode()).hexdigest(), merkle.Tree(text).fingerprint(), merkle.Tree(new).fingerprint(),
                    round(merkle.likeness(merkle.Tree(text).fingerprint(), merkle.Tree(new).fingerprint()), 9),
                    round(merkle.likeness(merkle.Tree(text).fingerprint(), merkle.Tree(following).fingerprint()), 9)))
    return out


def collected(df):
    return [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in df.collect()]


def order(rows):
    return sorted(rows, key=str)


def test_edit_test_on_odd_rows(spark):
    assert order(collected(merkle.edit_test(edge(spark), "doc_id", "text"))) == order(brute(TEXTS))
    assert merkle.edit_test(empty(spark), "doc_id", "text").count() == 0
    assert collected(merkle.edit_test(frame(spark, [(5, "alone here")]), "doc_id", "text")) == brute([(5, "alone here")])


def test_edit_test_over_many_slices(spark):
    rng = random.Random(1)
    rows = [(i * 3, " ".join(rng.choice(["ab", "cd.", "efg", "hi\n"]) for _ in range(rng.randint(0, 300)))) for i in range(400)]
    rng.shuffle(rows)
    assert order(collected(merkle.edit_test(frame(spark, rows), "doc_id", "text"))) == order(brute(rows))


def test_tree_covers_the_text_and_tells_texts_apart():
    seen = {}
    for text in ["", "\n", "\n\n", "a", "a\n", "a\nb", "a b", "ab", "# h\nx", "x\n# h", "a" * 500, "a" * 501]:
        tree = merkle.Tree(text)
        assert "".join(text[a:b] for _, a, b in tree.leaves) == text.replace("\n", "")
        assert seen.setdefault(tree.fingerprint(), text) == text
        levels = list(tree.nodes())
        assert levels[0][3:5] == (0, len(text))
    assert merkle.likeness(merkle.Tree("").fingerprint(), merkle.Tree("x y").fingerprint()) == 0


def test_differing_locates_edits():
    text = "".join(f"This is line number {i} of the text, with a few words in it.\n" for i in range(200))
    at = text.index("number 77")
    new = text[:at] + "NUMBER 77" + text[at + 9:]
    spans = merkle.differing(text, new)
    assert len(spans) == 1 and spans[0][0] <= at and at + 9 <= spans[0][1] and spans[0][1] - spans[0][0] < 200
    assert merkle.differing(text, text) == []
    near = merkle.likeness(merkle.Tree(text).fingerprint(), merkle.Tree(new).fingerprint())
    assert 0.97 < near < 1


def test_tables_of_nodes(spark):
    nodes = merkle.trees(edge(spark), "doc_id", "text")
    assert nodes.filter("level = 'root'").count() == len(TEXTS)
    prints = merkle.fingerprints(edge(spark), "doc_id", "text")
    assert prints.select("root").distinct().count() == len({t or "" for _, t in TEXTS})


@pytest.mark.parametrize("text", ["word " * 30, "Sentence one. Sentence two. " * 40])
def test_equal_prefix_keeps_leaves(text):
    a, b = merkle.Tree(text), merkle.Tree(text + "And an end.")
    assert merkle.likeness(a.fingerprint(), b.fingerprint()) > 0.4


def test_likeness_does_not_jump_with_the_length():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    for length in (120, 380, 399, 400, 430, 800):
        text = " ".join(rng.choice(words) for _ in range(300))[:length]
        for kept in (length * 2 // 3, length * 9 // 10, length - 40):
            near = merkle.likeness(merkle.Tree(text).fingerprint(), merkle.Tree(text[:kept]).fingerprint())
            assert 2 * kept / (length + kept) >= near > 2 * (kept - merkle.LONGEST) / (length + kept)


@pytest.mark.parametrize("sign", [" ", "!", "-", "x", "\n", "é", ". "])
def test_long_runs_of_a_sign_take_little_time(sign):
    text = "a." + sign * 100_000 + "b"
    began = time.time()
    tree = merkle.Tree(text)
    near = merkle.likeness(tree.fingerprint(), merkle.Tree(text + "c").fingerprint())
    assert time.time() - began < 2 and near > (0.99 if sign != "\n" else 0)
    assert max(b - a for _, a, b in tree.leaves) <= merkle.LONGEST and "".join(text[a:b] for _, a, b in tree.leaves) == text.replace("\n", "")


def test_one_id_for_many_texts_is_cut_into_slices(spark):
    rng = random.Random(4)
    rows = [(7 if i % 3 else i if i % 2 else None, " ".join(rng.choice("abcdef") for _ in range(8))) for i in range(900)]
    df = frame(spark, rows)
    out = merkle.edit_test(df, "doc_id", "text").select("doc_id", "n_chars", "edited_sha256").collect()
    hashed = {(r["doc_id"], r["text"]): r["h"] & (1 << 64) - 1 for r in df.withColumn("h", F.xxhash64("text")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r], r[1]))
    want = [(k, len(t), hashlib.sha256(merkle.edited(t, ordered[(i + 1) % len(ordered)][1]).encode()).hexdigest()) for i, (k, t) in enumerate(ordered)]
    assert order(tuple(r) for r in out) == order(want)
    source = merkle._source(df, "doc_id", "text").withColumn("hash", F.xxhash64("text"))
    sizes = source.groupBy(merkle._slices(source, 32)).count().collect()
    assert max(r["count"] for r in sizes) < 150


def test_likeness_opens_only_branches_that_differ():
    """Equal to the overlap of bags of leaves where no leaf moves between branches; a moved section still counts."""
    parts = [f"# part {i}\n" + "".join(f"Line {i} {j} says something of its own.\n" for j in range(30)) for i in range(6)]
    a, b = "".join(parts), "".join(parts[3:] + parts[:3])
    assert merkle.likeness(merkle.Tree(a).fingerprint(), merkle.Tree(b).fingerprint()) > 0.9
    tree = merkle.Tree(a).levels()
    read = merkle.Levels.read(merkle.Tree(a).fingerprint())
    assert all((getattr(tree, n) == getattr(read, n)).all() if n != "root" else tree.root == read.root for n in merkle.Levels.__slots__)


def test_trees_of_many_texts_are_those_of_single_ones(monkeypatch):
    monkeypatch.setattr(merkle, "TOGETHER", 50)
    texts = ["", "\n", "a b", "", "one. two, three!\n\n# x\n y", "z" * 99, " ", "é\U0001f600 \x00"]
    assert [t.fingerprint() for t in merkle.grow(texts)] == [merkle.Tree(t).fingerprint() for t in texts]
