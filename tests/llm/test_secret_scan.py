import hashlib
import random
import re
import string

from cases import TEXTS, edge, empty, frame

from assayer.llm import queries, secret_scan

KEY = "".join("[%s%s]" % (c.lower(), c.upper()) if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")


def brute(text):
    text = text or ""
    found = []
    for m in re.finditer("(" + KEY + r""")["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def test_fixed_patterns():
    rng = random.Random(6)
    bits = ["password", "Token", "api_key", "apikey", "ſecret", "=", ":", " ", '"', "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef01234567", "x", "abc", "é", "abcdef", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        order = {k: i for i, k in enumerate(secret_scan.KINDS)}
        assert sorted(secret_scan.fixed_spans(text), key=lambda s: (s[1], order[s[0]])) == brute(text)


def test_battery_tells_random_from_writing():
    rng = random.Random(7)
    for alphabet in (string.ascii_letters + string.digits, string.ascii_uppercase + "234567"):
        found = [secret_scan.battery("".join(rng.choice(alphabet) for _ in range(40))) for _ in range(300)]
        assert sum(p >= secret_scan.RANDOM_AT_LEAST and q < 1e-15 for p, q in found) >= 295
    for word in ("internationalizationandlocalization", "THEQUICKBROWNFOXJUMPSOVERTHELAZYDOG", "wohnungsbaugesellschaftsvertreter", "a" * 40, "ab" * 20):
        p, q = secret_scan.battery(word)
        assert q > 1e-4 or p < secret_scan.RANDOM_AT_LEAST


def test_discoveries():
    assert secret_scan.discovery_bins([]) == {}
    assert secret_scan.discovery_bins([(0, 0, 1000)]) == {}
    assert secret_scan.discovery_bins([(0, 0, 1000), (0, 200, 3)])[0] == 200
    assert 1 not in secret_scan.discovery_bins([(0, 200, 3), (1, 1, 10)])


def test_scan_and_mask(spark):
    rng = random.Random(9)
    secret = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(44))
    rows = [(100 + i, f"plain words and {'longish' * 4} ones {i}") for i in range(50)] + [(1, f"see {secret} there"), (2, f"token={secret}")]
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secret_scan.scan(frame(spark, rows), "doc_id", "text").collect()}
    assert found[1] == [("random", 4, 48)] and found[2] == [("assign", 0, 50)]
    assert all(not v for k, v in found.items() if k >= 100)
    masked = {r["doc_id"]: r["text"] for r in secret_scan.mask(frame(spark, rows), "doc_id", "text").collect()}
    assert masked[1] == "see [SECRET] there" and masked[2] == "[SECRET]" and masked[100] == rows[0][1]


def test_odd_rows(spark):
    out = secret_scan.scan(edge(spark), "doc_id", "text").collect()
    assert len(out) == len(TEXTS)
    assert {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in out}[10] == ["assign", "access"]
    assert secret_scan.scan(empty(spark), "doc_id", "text").count() == 0
    masked = secret_scan.mask(edge(spark), "doc_id", "text")
    assert masked.columns == edge(spark).columns
    texts = [r["text"] for r in masked.collect()]
    assert None in texts and "[SECRET] and [SECRET]" in texts and len(texts) == len(TEXTS)
    assert secret_scan.mask(empty(spark), "doc_id", "text").count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").collect()}
    for r in queries.QUERIES["op7_secrets"](spark, sf).collect():
        spans = brute(texts[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
        assert ",".join(s for s in r["spans"].split(",") if not s.startswith("random")) == text
