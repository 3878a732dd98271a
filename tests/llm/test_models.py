"""Toxicity, quality, language model, packing, line dedup and the pipeline."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hubflow.llm import linededup, lm_score, packing, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


# ---- toxicity

def _segments_by_definition(x):
    """Ruzzo and Tompa: the best segment, then the same left and right of it."""
    best = None
    for i, j in itertools.combinations(range(len(x) + 1), 2):
        s = sum(x[i:j])
        if s > 1e-9 and (best is None or s > best[0] + 1e-9 or abs(s - best[0]) <= 1e-9 and j - i < best[2] - best[1]):
            best = (s, i, j)
    if best is None:
        return []
    s, i, j = best
    return _segments_by_definition(x[:i]) + [(i, j, s)] + [
        (a + j, b + j, v) for a, b, v in _segments_by_definition(x[j:])]


def test_maximal_segments():
    rnd = random.Random(1)
    for _ in range(150):
        x = [rnd.choice([-1, 1]) * (rnd.randint(1, 10**6) / 1e5) for _ in range(rnd.randint(0, 14))]
        got = toxicity.maximal_segments(np.array(x, float))
        want = _segments_by_definition(x)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_toxicity_on_held_out_rows(spark):
    out = queries.op4_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    out = out[out.held_out]
    toxic, clean = out[out.toxic == 1], out[out.toxic == 0]
    assert (toxic.predicted == 1).mean() > 0.7 and (clean.predicted == 1).mean() < 0.02
    assert out.score.between(0, 1).all() and toxic.score.mean() > clean.score.mean() + 0.4


def test_toxic_passages_are_marked(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).join(docs.select("doc_id", "text"), "doc_id")
    rows = scored.filter(F.size("passages") > 0).limit(20).collect()
    assert rows
    for r in rows:
        for p in r["passages"]:
            assert 0 <= p["start"] < p["end"] <= len(r["text"]) and p["e_value"] < toxicity.E_MOST
            assert r["text"][p["start"]].isalpha() and r["text"][p["end"] - 1].isalpha()


def test_toxicity_odd_inputs(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (3, 0), (6, None), (None, 1), (99, 1), (7, 0), (8, 1)],
                                   "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.filter_clean(odd_docs, model).columns == odd_docs.columns
    for m in (toxicity.fit(no_docs, labels), toxicity.fit(odd_docs, labels.limit(0))):
        assert {r["score"] for r in toxicity.score(odd_docs, m).collect()} == {0.0}
    assert toxicity.score(no_docs, model).count() == 0


# ---- quality

def test_quality_agrees_with_labels(spark):
    out = queries.op10_quality(spark, SF).join(
        spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("quality", "gold"), "doc_id").toPandas()
    assert (out.keep == (out.gold == 1)).mean() > 0.97
    assert out[out.gold == 1].keep.mean() > 0.98


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    accuracy = [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.9, 0.85, 0.8]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.3, 0, np.where(
        rng.random(len(truth)) < a, np.where(truth, 2, 1), np.where(truth, 1, 2))) for a in accuracy], axis=1)
    names = ["".join("?01"[x] for x in row) for row in votes]
    post = quality.label_model(dict(Counter(names)))
    got = np.array([post[x] > 0.5 for x in names])
    majority = (votes == 2).sum(axis=1) >= (votes == 1).sum(axis=1)
    assert (got == truth).mean() > (majority == truth).mean() and (got == truth).mean() > 0.95
    assert quality.label_model({}) == {}


def test_quality_odd_inputs(spark, odd_docs, no_docs):
    rows = quality.score_quality(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["quality"] <= 1 for r in rows)
    assert quality.score_quality(no_docs).count() == 0


# ---- language model

def _backoff(texts, order, least, alpha):
    words = [[w for w in (t or "").lower().split()] for t in texts]
    c = Counter(tuple(w[i:i + n]) for w in words for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, words))

    def one(w, i):
        for n in range(order, 0, -1):
            if i - n + 1 >= 0 and c[tuple(w[i - n + 1:i + 1])] >= least:
                below = c[tuple(w[i - n + 1:i])] if n > 1 else total
                return (order - n) * math.log(alpha) + math.log(c[tuple(w[i - n + 1:i + 1])] / below)
        return (order - 1) * math.log(alpha) - math.log(total)
    return [sum(one(w, i) for i in range(len(w))) for w in words]


@pytest.mark.parametrize("order,chunk,part", [(1, 1 << 20, 1 << 20), (2, 300, 200), (3, 200, 150), (4, 1 << 20, 100)])
def test_backoff_equals_brute_force(spark, order, chunk, part):
    rnd = random.Random(order)
    texts = [" ".join(rnd.choice("a b c d e f g hh ii jj".split()) for _ in range(rnd.randint(0, 40)))
             for _ in range(60)] + [None, "", "zz", "the the the the"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_score.stupid_backoff(
        df, order=order, chunk_bytes=chunk, part_bytes=part).collect()}
    for i, x in enumerate(_backoff(texts, order, lm_score.MIN_COUNT, lm_score.ALPHA)):
        assert math.isclose(got[i]["log_score"], x, abs_tol=1e-8)
        assert (got[i]["mean_log_score"] is None) == (got[i]["n_words"] == 0)


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 1000):
        x = np.unique(rng.integers(0, 1 << 54, n).astype(np.uint64))
        c = rng.integers(1, 9, len(x))
        y, d = lm_score.unpack_sorted(lm_score.pack_sorted(x, c))
        assert (x == y).all() and (c == d).all()


def test_packed_counts_above_32_bits():
    for c in ([(1 << 32) - 1], [1 << 32], [3, (1 << 32) + 1, 7 << 40, 2]):
        assert lm_score.unpack_counts(lm_score.pack_counts(np.array(c, np.int64))).tolist() == c
    # a word on 2^32 places of some chunks keeps its count in every chunk's reply
    x = np.array([5, 9], np.uint64)
    import pyarrow as pa
    sent = pa.record_batch([pa.array([0, 1, 2], pa.int32()), pa.array([0, 0, 0], pa.int32()),
                            pa.array([lm_score.pack_sorted(x, np.array([(1 << 31) + k, 1])) for k in range(3)],
                                     pa.binary())], names=["chunk", "part", "grams"])
    for back in lm_score._answers(iter([sent])):
        for b in back.column("counts").to_pylist():
            assert lm_score.unpack_counts(b).tolist() == [(3 << 31) + 3, 3]


def test_lm_odd_inputs(spark, odd_docs, no_docs):
    rows = lm_score.stupid_backoff(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["log_score"] <= 1e-9 for r in rows)
    assert lm_score.stupid_backoff(no_docs).count() == 0


# ---- packing

def test_optimal_bounds_equal_brute_force():
    rnd = random.Random(2)
    for _ in range(60):
        hist = [(x, rnd.randint(1, 9)) for x in rnd.sample(range(1, 60), rnd.randint(1, 9))]
        k = rnd.randint(1, 4)
        lengths = sorted(x for x, _ in hist)
        cost = lambda b: sum(min(y for y in b if y >= x) * c for x, c in hist)
        least = min(cost(b + (lengths[-1],)) for n in range(k) for b in itertools.combinations(lengths[:-1], n))
        got = packing.optimal_bounds(hist, k)
        assert len(got) <= k and cost(got) == least


def test_packing_places_every_row_once(spark):
    rnd = random.Random(6)
    texts = [" ".join(["w"] * int(rnd.paretovariate(0.7))) for _ in range(600)] + ["w " * 50] * 300 + [None, ""]
    df = spark.createDataFrame([(i % 850, t, "x") for i, t in enumerate(texts)],
                               "doc_id long, text string, bucket string")
    old, packing.ROWS_PER_BLOCK = packing.ROWS_PER_BLOCK, 4
    try:
        split = packing.pack(df, n_buckets=5, token_budget=1000).collect()
    finally:
        packing.ROWS_PER_BLOCK = old
    rows = packing.pack(df, n_buckets=5, token_budget=1000).collect()
    place = lambda rs: Counter((r["doc_id"], r["n_tokens"], r["bucket"]) for r in rs)
    assert place(rows) == place(split) and len(rows) == len(texts)
    batches = defaultdict(list)
    for r in split:
        assert r["padding"] >= 0 and (r["n_tokens"] <= 4096 and r["padding"] == r["bucket_len"] - r["n_tokens"] or
                                      r["bucket_len"] >= r["n_tokens"])
        batches[r["bucket"], r["batch"]].append(r)
    for (b, _), rs in batches.items():
        cap = max(1, 1000 // rs[0]["bucket_len"])
        assert sorted(r["slot"] for r in rs) == list(range(len(rs))) and len(rs) <= cap
    for b in {k[0] for k in batches}:
        assert sum(len(rs) < max(1, 1000 // rs[0]["bucket_len"]) for k, rs in batches.items() if k[0] == b) <= 1


def test_packing_odd_inputs(spark, odd_docs, no_docs):
    assert packing.pack(odd_docs).count() == odd_docs.count()
    assert packing.pack(no_docs).count() == 0


# ---- line dedup

def test_line_dedup_drops_what_a_host_repeats(spark):
    rows = [(i, "h1", f"Menu\nown line {i}\n  Menu  \nfoot") for i in range(20)]
    rows += [(100 + i, "h2", f"Menu\nown line {i}" if i == 0 else f"text {i}") for i in range(20)]
    rows += [(200, "small", "Menu\nx"), (201, None, None), (202, "h1", "")]
    df = spark.createDataFrame([(*r, 7, "keep") for r in rows],
                               "doc_id long, host string, text string, lost long, lines string")
    got = {r["doc_id"]: r for r in linededup.drop_boilerplate(
        df, "doc_id", F.col("host"), F.col("text")).collect()}
    assert got[3]["text"] == "own line 3" and got[3]["n_lines"] == 4 and got[3]["n_dropped"] == 3
    assert got[100]["text"] == "Menu\nown line 0" and got[200]["text"] == "Menu\nx"
    assert got[201]["text"] == "" and got[202]["text"] == ""
    assert {r["lost"] for r in got.values()} == {7} and {r["lines"] for r in got.values()} == {"keep"}


def test_line_dedup_really_drops_on_pages(spark):
    out = queries.op7_line_dedup(spark, SF)
    assert out.filter("n_dropped > 0").count() > 0


def test_line_dedup_odd_inputs(spark, odd_docs, no_docs):
    args = ("doc_id", F.col("source"), F.col("text"))
    assert linededup.drop_boilerplate(odd_docs, *args).count() == odd_docs.count()
    assert linededup.drop_boilerplate(no_docs, *args).count() == 0


def test_line_dedup_verbatim_keeps_white_space(spark):
    code = "def f(x):\n    if x:\n\treturn 1  \n\n    return 2\n"
    rows = [(i, f"  Menu \n\n    own {i}\n\n\tfoot {i}  \n Menu") for i in range(20)] + [(50, code), (51, None), (52, " Menu\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.drop_boilerplate(
        df, "doc_id", F.lit("h"), F.col("text"), keep_whole=True, verbatim=True).collect()}
    assert got[3]["text"] == "\n    own 3\n\n\tfoot 3  " and (got[3]["n_lines"], got[3]["n_dropped"]) == (4, 2)
    assert got[50]["text"] == code and got[50]["n_dropped"] == 0
    assert got[51]["text"] == "" and got[52]["text"] == " Menu\n" and got[52]["n_dropped"] == 0


def test_line_dedup_stage_keeps_white_space(spark):
    code = "def f(x):\n    if x:\n\treturn 1  \n\n    return 2\n"
    df = spark.createDataFrame([(1, code, "s", len(code))], "doc_id long, text string, source string, n_chars long")
    got = corpus_pipeline.line_dedup_stage(spark, df, SF).first()
    assert got["text"] == code and got["n_chars"] == len(code)


def test_line_dedup_stage_drops_whatever_the_share(spark):
    menu = "menu line that every page of this source repeats at its very top"
    copy = "\n".join(f"passage {j} of a long text that was copied with few changes into other pages" for j in range(30))
    rows = [(i, f"{menu}\nown words {i} {i * 7}", "s", 0) for i in range(20)]
    rows += [(100 + i, f"{copy}\nending {i}", "s", 0) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.line_dedup_stage(spark, df, SF).collect()}
    assert len(got) == 32
    assert all(got[i]["text"] == f"own words {i} {i * 7}" and got[i]["n_chars"] == len(got[i]["text"]) for i in range(20))
    assert all(got[100 + i]["text"] == f"{copy}\nending {i}" for i in range(12))   # near copies are one page


def test_html_lines_as_the_plain_markup(spark):
    parts = ["<p>", "a b", "<", ">", "<!--", "-->", "<SCRIPT x>", "</Script >", "<style>", "</style\n>", "<scripty>", "</script",
             linededup._NOT_HERE, "\n", "<!-->"]
    rng = np.random.default_rng(5)
    rows = [("".join(rng.choice(parts, size=rng.integers(0, 12))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "html string")
    plain = F.regexp_replace("html", linededup._MARKUP, "\n")
    assert df.filter(linededup.html_lines(F.col("html")) != plain).count() == 0


def test_html_lines(spark):
    df = spark.createDataFrame([("<p>a<br>b</p><!-- <p>x --><script>var t='</p>';</script><STYLE>q{}</style>c", )], "h string")
    text = df.select(linededup.html_lines(F.col("h")).alias("t")).first()["t"]
    assert [x for x in text.split("\n") if x] == ["a", "b", "c"]


# ---- pipeline

def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, SF)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        assert after.count() == after.select("doc_id").distinct().count() <= before.count()
        if name == "toxicity":
            gone = before.join(after.select("doc_id"), "doc_id", "left_anti")
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            toxic = gone.join(labels, "doc_id").agg(F.avg("toxic")).first()[0]
            assert toxic > 0.9
        if name == "near_duplicates":
            again = corpus_pipeline.near_duplicate_stage(spark, after, SF)
            assert again.count() == after.count() < before.count()
        if name == "decontamination":
            again = corpus_pipeline.decontamination_stage(spark, after, SF)
            assert again.count() == after.count() < before.count()
        before = after
    assert {"bucket", "batch", "slot"} <= set(before.columns)


def test_pipeline_on_odd_documents(spark, odd_docs, no_docs, tmp_path):
    odd = odd_docs.withColumn("n_chars", F.length("text").cast("long"))
    for k, d in enumerate((odd, odd.limit(0))):
        if not k:
            ids = [r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, d, SF).collect()]
            # one row of the repeated id, one of each group of copies, all empty texts
            assert sorted(x for x in ids if x is not None) == [0, 1, 2, 3, 5, 6, 8, 11] and None in ids
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, SF)
            assert d.count() >= 0


def test_pipeline_keeps_one_whole_text_of_every_group_of_copies(spark):
    rnd = random.Random(11)
    line = lambda: " ".join(f"w{rnd.randint(0, 9000)}" for _ in range(30))
    exact = [line() for _ in range(4)]
    near = [line() for _ in range(9)]
    rows = [("s", "\n".join(exact))] * 40
    near_texts = set()
    for _ in range(40):                   # edits in most lines: what copies share is less than half a text
        t = [x.split() for x in near]
        for i in rnd.sample(range(9), 6):
            t[i][rnd.choice([0, 29])] = f"e{rnd.randint(0, 9000)}"
        near_texts.add("\n".join(" ".join(x) for x in t))
    near_texts = sorted(near_texts)
    rows += [("s", t) for t in near_texts]
    rows += [("s", "\n".join([line(), line(), "foot of the page"])) for _ in range(40)]
    rows += [("s", "foot of the page")] * 5
    few = line()
    rows += [("small", few)] * 3 + [("small", line()) for _ in range(26)]
    df = spark.createDataFrame([(i, t, s, len(t)) for i, (s, t) in enumerate(rows)],
                               "doc_id long, text string, source string, n_chars long")
    lines = corpus_pipeline.line_dedup_stage(spark, df, SF)
    got = [r["text"] for r in corpus_pipeline.near_duplicate_stage(spark, lines, SF).collect()]
    assert "" not in got
    assert got.count("\n".join(exact)) == 1 and got.count(few) == 1
    assert sum(t in near_texts for t in got) == 1
    assert sum("foot of the page" in t for t in got) == 1     # off all pages but the one it is the whole of
    assert len(got) == 1 + 1 + 40 + 1 + 1 + 26


def test_pipeline_rows_without_id(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    item = max((r["text"] for r in items), key=lambda t: len(t.split()))
    one, two, three, four = (" ".join(f"{p}{i}" for i in range(40)) for p in "pquv")
    rows = [(7, one), (None, one), (None, two), (None, two), (None, four + " " + item), (None, None), (None, ""),
            (4, "y y y y y"), (4, three), (9, three)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    kept = corpus_pipeline.near_duplicate_stage(spark, df, SF)
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    once = [rows[0], (None, two), (None, four + " " + item), (None, None), (None, "")]
    assert [x for x in got if x[0] not in (4, 9)] == sorted(once, key=repr)
    # of the rows with id 4 one stays, and what only the other had stays with its copy
    assert sum(x[0] == 4 for x in got) == 1 and three in [x[1] for x in got]
    clean = [r["text"] for r in corpus_pipeline.decontamination_stage(spark, df, SF).collect()]
    assert len(clean) == len(rows) - 1 and four + " " + item not in clean
