"""Secret and personal-data spans: planted cases, odd inputs, the ledger."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from hubflow.llm import pii, secrets


def _pii(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in pii.pii_digest(pii.find_pii(df)).collect()}


def _luhn(d):
    return sum(x if i % 2 == 0 else (2 * x) // 10 + (2 * x) % 10
               for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def _brute_pii(t):
    out = []
    for k, (kind, rx) in enumerate((
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(rx, t):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")),
                  "card": 14 <= len(d) <= 19 and _luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii_base_equals_plain_regex_on_random_text(spark):
    rnd = random.Random(3)
    bits = ["a@b.co", "x.y+z@q-r.example.org", "@", ".", "1.2.3.4", "999.1.1.1", "10.0.0.256", "é🙂", " ",
            "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567 8", "+1", "-", "7", "0012.3.4.5",
            "a_b%c", "\n", "+", "12345678901234567890", "1.2.3.4.5.6.7.8", "u@h", "_d@e.f"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 25))) for _ in range(400)]
    got = _pii(spark, texts)
    for i, t in enumerate(texts):
        base = _brute_pii(t)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), (t, base, got[i]["spans"])


def test_pii_iban_and_context(spark):
    df = spark.createDataFrame([(1, "bank transfer to DE89370400440532013000 now"),
                                (2, "x DE89370400440532013001 y"), (3, "DE89370400440532013000")],
                               "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find_pii(df).collect()}
    kinds = lambda i: {s["kind"]: s["score"] for s in found[i]}
    assert kinds(1)["iban"] > kinds(3)["iban"] and "iban" not in kinds(2)


def test_long_runs_stay_linear(spark):
    texts = ["1" * 50_000, "a" * 200_000 + "@", "1 " * 30_000, "+1" + "-" * 50_000, "a." * 50_000 + "@b"]
    assert len(_pii(spark, texts)) == 5


def test_odd_inputs(spark, odd_docs, no_docs):
    empty = hashlib.sha256(b"").hexdigest()
    for out in (pii.pii_digest(pii.find_pii(odd_docs)),
                secrets.secret_digest(secrets.scan_history(
                    odd_docs, secrets.new_ledger_path(spark), ["doc_id"]))):
        rows = out.collect()
        assert len(rows) == odd_docs.count()
        assert all(r["base_sha256"] == empty for r in rows if r["doc_id"] in (0, 1, 2))
    assert pii.find_pii(no_docs).count() == 0
    assert secrets.scan_history(no_docs, secrets.new_ledger_path(spark), ["doc_id"]).count() == 0


def _brute_secrets(t):
    out = []
    assign = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
              r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for k, (kind, rx, g, n) in enumerate((("assign", assign, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20),
                                          ("hex", "[0-9a-f]+", 0, 24))):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(rx, t)
                if len(m.group(g)) >= n]
    return ",".join(x[2] for x in sorted(out))


def test_secret_base_equals_plain_regex_on_random_text(spark):
    rnd = random.Random(5)
    bits = ["password", "PassWd", "token", "api_key", "APIKEY", "secret", "=", ": ", "'", '"', " ", "abc123", "Zz/+",
            "AKIA", "ABCDEFGHIJKLMNOP", "deadbeef01", "0" * 24, "é", "K", "ſecret", "\n"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 30))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = secrets.secret_digest(secrets.scan_history(df, secrets.new_ledger_path(spark), ["doc_id"]))
    for r in got.collect():
        base = _brute_secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), (texts[r["doc_id"]], r["spans"])


def test_ledger_scans_only_unseen_pairs(spark):
    path = secrets.new_ledger_path(spark)
    key = "token = " + "a1" * 16
    v = "path string, version long, text string"
    first = spark.createDataFrame([("a", 1, key), ("b", 1, key), ("c", 1, "none")], v)
    found = secrets.scan_history(first, path, ["path", "version"])
    assert {r["path"] for r in found.filter(F.size("spans") > 0).collect()} == {"a", "b"}
    assert secrets.open_ledger(spark, path).count() == 2          # two blobs behind three paths
    second = first.union(spark.createDataFrame([("a", 2, "new " + key), ("d", 1, key)], v))
    found = secrets.scan_history(second, path, ["path", "version"])
    assert found.filter(F.size("spans") > 0).count() == 4
    assert secrets.open_ledger(spark, path).count() == 3          # one new blob only
    secrets.scan_history(second, path, ["path", "version"], rule_version="next")
    assert secrets.open_ledger(spark, path).count() == 6          # a new rule version scans all blobs


@pytest.mark.parametrize("text", ["-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 10, "xoxb-123456789012"])
def test_added_kinds(spark, text):
    df = spark.createDataFrame([(1, "see " + text)], "doc_id long, text string")
    rows = secrets.scan_history(df, secrets.new_ledger_path(spark), ["doc_id"]).collect()
    assert any(s["k"] >= secrets.BASE_KINDS for s in rows[0]["spans"])
