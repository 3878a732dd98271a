"""Near-duplicate joins and decontamination against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hubflow.llm import decontaminate, embed_dedup, graph, ngram_join, textnp


def _groups(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]


def _shingles(t):
    w = _words(t)
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def _near(a, b):
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


def _corpus(seed=1):
    """Chains of edits, a passage in most texts, hot groups, texts of all sizes."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 5000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for size in (1, 3, 5, 6, 9, 14, 19, 25, 33, 70, 130, 260, 600):
        for _ in range(3):
            base = [word() for _ in range(size)]
            texts.append(base)
            for _ in range(4):                          # a chain: each edits the one before
                base = list(base)
                for _ in range(rnd.randint(0, max(1, size // 25))):
                    base[rnd.randrange(len(base))] = word()
                base += [word() for _ in range(rnd.randint(0, max(1, size // 12)))]
                texts.append(base)
    hub = [word() for _ in range(120)]
    for _ in range(60):                                 # near copies of one text
        t = list(hub)
        for _ in range(2):
            t[rnd.randrange(120)] = word()
        texts.append(t)
    for _ in range(60):                                 # far texts around one passage
        texts.append([word() for _ in range(rnd.randint(5, 90))] + passage)
    texts += [list(hub)] * 30
    return [" ".join(t) for t in texts]


def _check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngram_join.link_components(df).collect()}
    sets = [_shingles(t) for t in texts]
    want = _groups(len(texts), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2)
                                if _near(sets[i], sets[j])])
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == want


def test_ngram_join_equals_brute_force(spark):
    _check(spark, _corpus())


def test_ngram_join_with_split_buckets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SPLIT_ABOVE", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 256)
    _check(spark, _corpus(2))


def test_parity_sketch_bounds_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 3000))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 63, n // 8 + 1).astype(np.uint64)]))
        x, y = (np.frombuffer(ngram_join.parity_sketch(s), np.uint8) for s in (a, b))
        size = min(len(x), len(y))
        ham = int(np.bitwise_count(ngram_join.fold_sketch(x, size) ^ ngram_join.fold_sketch(y, size)).sum())
        inter = len(np.intersect1d(a, b))
        assert ham <= len(a) + len(b) - 2 * inter
        if ngram_join._linked(inter, len(a) + len(b) - inter):
            assert ngram_join.may_link(len(a), len(b), ham)
            assert np.intersect1d(ngram_join.set_keys(a), ngram_join.set_keys(b)).size


def test_ngram_join_odd_inputs(spark, odd_docs, no_docs):
    rows = ngram_join.link_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    comp = {r["doc_id"]: r["component_id"] for r in rows}
    assert [comp[i] for i in (0, 1, 2, 3, 4, 7, 9, 10)] == [0, 1, 2, 3, 3, 6, 8, 8]
    assert ngram_join.link_components(no_docs).count() == 0


def test_words_match_the_definition():
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("aAbBÉé\x1fz \t\n\x0b\x0c\r\x85 🙂") for _ in range(rnd.randint(0, 60)))
             for _ in range(300)]
    import pyarrow as pa
    h, first = textnp.words(*textnp.text_buffers(pa.array(texts)))
    seen = {}
    for i, t in enumerate(texts):
        mine = h[first[i]:first[i + 1]].tolist()
        assert len(mine) == len(_words(t))
        for w, x in zip(_words(t), mine):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("block", [7, 10_000])
def test_components_in_small_blocks(spark, block):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randint(100, 300), rnd.randint(100, 300)) for _ in range(90)]
    edges += [(500, i) for i in range(501, 560)] + [(9, 9)]
    got = {r["id"]: r["component"] for r in graph.components(
        spark.createDataFrame(edges, "a long, b long"), block).collect()}
    want = _groups(600, edges)
    nodes = {x for e in edges for x in e}
    assert {x: got.get(x, x) for x in nodes} == {x: want[x] for x in nodes}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 24))
    v = [(b + rng.normal(scale=s, size=24)).tolist() for b in base for s in (0.0, 0.1, 0.2, 0.3)]
    v += [v[0]] * 5 + [[2 * x for x in v[1]]] + [None, [0.0] * 24, [float("nan")] * 24, [1.0] * 23, [1.0] * 23,
                                                 [None] + [1.0] * 23, [], [float("inf")] + [1.0] * 23]
    df = spark.createDataFrame([(i, x, "z") for i, x in enumerate(v)],
                               "vec_id long, embedding array<double>, rep string")
    ok = [x is not None and len(x) > 0 and None not in x and np.isfinite(x).all() and any(x) for x in v]
    links = [(i, j) for i, j in itertools.combinations(range(len(v)), 2) if ok[i] and ok[j] and len(v[i]) == len(v[j])
             and np.dot(v[i], v[j]) / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) >= 0.95]
    want = _groups(len(v), links)
    for tile in (16, 4096):
        got = {r["vec_id"]: r for r in embed_dedup.vector_components(df, tile=tile).collect()}
        for i in range(len(v)):
            assert got[i]["n_links"] == sum(i in p for p in links)
            assert got[i]["component_id"] == want[i] and got[i]["kept"] == (want[i] == i)
    assert embed_dedup.vector_components(df.limit(0)).count() == 0


def test_tile_bound_is_rigorous():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(300, 32))
    u[150:] = u[:150] + rng.normal(scale=0.25, size=(150, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.95)) if i < j}
    got = {(int(i), int(j)) for a, b in embed_dedup.tile_links(u, u, 0.95, True) for i, j in zip(a, b)}
    assert got == want


def test_contamination_equals_brute_force(spark):
    rnd = random.Random(9)
    word = lambda: f"q{rnd.randint(0, 300)}"
    items = [" ".join(word() for _ in range(n)) for n in (3, 4, 5, 8, 15, 20, 31, 32, 57)] + [None, ""]
    docs = []
    for k in range(120):
        body = [word() for _ in range(rnd.randint(0, 300))]
        item = (items[rnd.randrange(9)]).split()
        for _ in range(rnd.randint(0, 2)):
            item[rnd.randrange(len(item))] = word()
        at = rnd.randint(0, len(body))
        docs.append(" ".join(body[:at] + item + body[at:]) if k % 4 else " ".join(item))
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, h string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"])
           for r in decontaminate.contaminated(d, b).collect()}
    want = {}
    for i, t in enumerate(docs):
        for j, x in enumerate(items):
            s = _shingles(x)
            if s and len(_shingles(t) & s) >= 0.75 * len(s):
                want[i, j] = (len(_shingles(t) & s), len(s))
    assert got == want and len(want) > 10
    assert decontaminate.decontaminate(d, b).count() == len(docs) - len({i for i, _ in want})
    # the lookup without broadcast gives the same
    old, decontaminate.BROADCAST_BYTES = decontaminate.BROADCAST_BYTES, 0
    try:
        assert decontaminate.contaminated(d, b).count() == len(want)
    finally:
        decontaminate.BROADCAST_BYTES = old


def test_contamination_odd_inputs(spark, odd_docs, no_docs):
    items = odd_docs.select(F.col("doc_id").alias("item_id"), "text")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd_docs, items).collect()}
    assert (7, 6) in found and (3, 4) in found and not any(i in (0, 1, 2) for i, _ in found)
    assert decontaminate.contaminated(no_docs, items).count() == 0
    assert decontaminate.contaminated(odd_docs, items.limit(0)).count() == 0
