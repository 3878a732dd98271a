"""Work linear in a text's length, and bounds that hold when ids repeat."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from hubflow.llm import decontaminate, graph, linededup, pii, quality, sample, secrets, toxicity


def _within(seconds, work):
    work()                                         # the first run compiles
    t0 = time.perf_counter()
    out = work()
    assert time.perf_counter() - t0 < seconds
    return out


def test_many_personal_data_in_one_text(spark):
    text = " ".join(f"a{i}@b.co" for i in range(70_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = _within(10, lambda: pii.find_pii(df).first())
    want = [(m.start(), m.end()) for m in re.finditer(r"a[0-9]+@b\.co", text)]
    assert [(s["start"], s["end"]) for s in row["spans"]] == want


def test_context_is_the_text_around_a_span(spark):
    rnd = random.Random(6)
    bits = ["a@b.co", "1.2.3.4", " ", "mail ", "host", "x" * 30, "é", "4111 1111 1111 1111", "\n", "login "]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {k.name: k for k in pii.KINDS}
    for r in pii.find_pii(df).collect():
        for s in r["spans"]:
            kind, t = kinds[s["kind"]], texts[r["doc_id"]]
            near = t[max(0, s["start"] - 40):s["end"] + 40].lower()
            assert s["score"] == pytest.approx(kind.score + 0.2 * bool(re.search(kind.context, near)))


@pytest.mark.parametrize("html", ["<" * 1_000_000, "<!--" * 250_000, "<script " * 120_000, "<style>" * 140_000 + ">",
                                  "<!-- a --> b <!-- " * 50_000])
def test_markup_without_end(spark, html):
    df = spark.createDataFrame([(html,)], "html string")
    _within(5, lambda: df.select(F.length(linededup.html_lines(F.col("html")))).first())


def test_markup_equals_the_plain_pattern(spark):
    rnd = random.Random(7)
    bits = ["<", ">", "<!--", "-->", "<script", "</script>", "</SCRIPT \n>", "<style a>", "</style>", "text", " ", "\n",
            "<b>", "--", "é🙂", "<scripts>", "﷐"]
    pages = ["".join(rnd.choice(bits[:-1] if i % 9 else bits) for _ in range(rnd.randint(0, 25))) for i in range(3000)]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    plain = F.regexp_replace("html", linededup._MARKUP, "\n")
    assert df.filter(linededup.html_lines(F.col("html")) != plain).count() == 0


def test_tokens_without_end():
    text = "eyJ" * 300_000
    t0 = time.perf_counter()
    assert list(secrets.jwt_spans(text)) == []
    assert time.perf_counter() - t0 < 5


def test_token_spans_equal_the_pattern():
    rx = next(r[1] for r in secrets.RULES if r[0] == "jwt")
    rnd = random.Random(9)
    bits = ["eyJ", "abcdefgh", "x", ".", "12345", "-_", " ", "..", "eyJabcdefgh."]
    for _ in range(20_000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14)))
        assert list(secrets.jwt_spans(t)) == [m.span() for m in re.finditer(rx, t, re.ASCII)], t


def test_path_columns_with_any_name(spark):
    df = spark.createDataFrame([(1, "token = abcdef123", "x", "y")], "id long, text string, blob string, `a b` string")
    out = secrets.scan_history(df.withColumn("spans", F.lit("z")), secrets.new_ledger_path(spark), ["id", "spans", "a b"])
    assert out.columns == ["id", "spans", "a b", "blob", "spans"] and out.count() == 1


# ------------------------------------------------------------------ samples
def test_smallest_takes_the_least_digests_whatever_the_size(spark):
    ids = spark.range(30_000).withColumn("m", F.md5(F.col("id").cast("string")))
    got = [r["id"] for r in sample.smallest(ids, "m", 500, "id").collect()]
    want = [r["id"] for r in ids.orderBy("m", "id").limit(500).collect()]
    assert got == want


def test_samples_count_rows_where_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 3 if i < 4000 else i, f"some words {i % 7} here") for i in range(6000)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6000)], "doc_id long, toxic int")
    got = toxicity.training_sample(docs, labels, "doc_id", "text", "toxic", 100)
    assert got.count() <= 200 and got.select("id").distinct().count() == got.count()
    assert quality.score_quality(docs, max_train=50).count() == 6000


# --------------------------------------------------------------- hot groups
def test_components_of_a_node_with_very_many_edges(spark):
    edges = spark.range(1, 60_000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    out = graph.components(edges, block=5_000)
    assert out.count() == 59_999 and out.filter("component <> 0").count() == 0


def test_broadcasts_are_bounded_by_bytes(spark, monkeypatch):
    table = spark.createDataFrame([("x" * 1000,)] * 10, "t string")
    hint = lambda t: "ResolvedHint" in t._jdf.queryExecution().analyzed().toString()
    assert hint(decontaminate.bounded(table, ("t",)))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 5000)
    assert not hint(decontaminate.bounded(table, ("t",))) and hint(decontaminate.bounded(table))
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "nothing of it at all here"), (None, "a b c d e f g")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(9, "a b c d e f g")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert sorted(decontaminate.decontaminate(docs, items).select("doc_id").collect(), key=repr) == [(2,), (None,)]
