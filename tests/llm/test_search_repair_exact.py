"""Ranked search, conversation repair and exact dedup against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from hubflow.llm import conversation, exactdup, minplus, ranked


# ------------------------------------------------------------- ranked search
def _terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def _ranked(docs, items, k=10):
    tf = [(i, {t: w.count(t) for t in set(w)}, len(w)) for i, w in ((i, _terms(t)) for i, t in docs) if w]
    n_docs, n_words = len(tf), sum(n for _, _, n in tf)
    df = {}
    for _, c, _ in tf:
        for t in c:
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, c, n in tf:
            m = 25 + 75 * n * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in _terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def _found(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("i", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("q", F.lit(None).cast("int"))
    return sorted((tuple(r) for r in ranked.search(d, b, **kw).select("item_id", "rank", "doc_id", "score").collect()),
                  key=repr)


def test_search_equals_brute_force_in_one_block_and_in_many(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Äpfel", "ÄPFEL", "漢字", "x1", "X1"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice(" .,-\n\t_") for _ in range(n))
    docs = [(i, text(rnd.randint(0, 40))) for i in range(150)]
    docs += [(200 + i, docs[7][1]) for i in range(25)]          # ties beyond the tenth rank
    docs += [(None, docs[7][1]), (None, ""), (300, None), (301, " .,;\n"), (302, text(6000))]
    common = text(12)
    items = [(i, common + text(rnd.randint(1, 10))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "nowhere to be found"), (53, "w1 w1 w1 W2"), (54, docs[7][1]), (54, "w3")]
    want = _ranked(docs, items)
    assert _found(spark, docs, items) == want
    assert _found(spark, docs, items, block_terms=40) == want


def test_search_on_empty_tables(spark):
    assert _found(spark, [], [(1, "a b")]) == []
    assert _found(spark, [(1, "a b")], []) == []
    assert _found(spark, [(1, "--"), (2, None)], [(1, "a")]) == []


def test_shared_term_sets_keep_sums_and_save_additions():
    rnd = random.Random(5)
    base = [{rnd.randrange(200): rnd.randint(1, 3) for _ in range(12)} for _ in range(4)]
    items = [{**rnd.choice(base), **{rnd.randrange(400): 1 for _ in range(3)}} for _ in range(60)] + [{}]
    plan = ranked.Plan(items)
    assert plan.additions() < sum(max(0, len(i) - 1) for i in items) / 2
    value = [rnd.randrange(1000) for _ in range(400)]
    sums = [value[t] * c for t, c in plan.leaves]
    for a, b in plan.inner:
        sums.append(sums[a] + sums[b])
    assert [sum(sums[n] for n in i) for i in plan.items] == [sum(value[t] * c for t, c in i.items()) for i in items]


def test_long_items_are_shared_in_windows(monkeypatch):
    monkeypatch.setattr(ranked, "WINDOW", 8)
    items = [{t: 1 for t in range(50)}, {t: 1 for t in range(5, 60)}]
    plan = ranked.Plan(items)
    sums = [t for t, _ in plan.leaves]
    for a, b in plan.inner:
        sums.append(sums[a] + sums[b])
    assert [sum(sums[n] for n in i) for i in plan.items] == [sum(i) for i in items]


# ------------------------------------------------------ conversation repair
_WHITE = " \t\n\x0b\x0c\r"


def _cheapest(rows):
    """(cost, audit) of rows (initial, must go, truncated) by exhaustive search."""
    best = None
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def go(i, state, cost, audit, added):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and state in ("", "a") and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if added < 3:
            for c in "ua":
                if (state, c) in step:
                    go(i, step[state, c], cost + 5, audit + "I", added + 1)
        if i < len(rows):
            ini, gone, cut = rows[i]
            go(i + 1, state, cost + 2, audit + "D", 0)
            if not gone:
                if (state, ini) in step:
                    go(i + 1, step[state, ini], cost + 5 * cut, audit + "K", 0)
                for c in "ua":
                    if (state, c) in step:
                        go(i + 1, step[state, c], cost + 1 + 5 * cut, audit + "R", 0)
    go(0, "", 0, "", 0)
    return best


def _repair(turns):
    """Everything about one conversation's rows (turn, role, text)."""
    rows = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, marks, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        shown = text.rstrip(_WHITE)
        fault = ("blank" if not shown else "duplicate" if (role, text) in seen
                 else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
        if fault:
            n[fault] += 1
        marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
    cost, audit = _cheapest(marks)
    out, left, after = [], list(rows), ""
    for e in audit:
        role, text = left.pop(0)[1:] if e != "I" else ("", "")
        if e == "D":
            continue
        if e != "K":
            role = "user" if after != "u" else "assistant"
        after = role[:1]
        out.append(f"{role}:{text}")
    return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def _damaged(rows):
    out = {}
    for c, t, role, text in rows:
        say = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{say(c)}:{say(t)}".encode()) % 20
        role, text = say(role), say(text)
        out.setdefault(c, [])
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        row = (t, "user" if kind == 4 else role, text)
        out[c] += [row] * {0: 0, 3: 2}.get(kind, 1)
    return out


def _odd_conversations(n=150, seed=2):
    rnd = random.Random(seed)
    rows = []
    texts = ["Yes.", "No!", "cut off", " \t", "", "Why?", "long. " * 50, "é 漢🙂.", "A.\n", "b. ", None]
    for c in range(n):
        for t in range(rnd.randint(0, 7)):
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "unicorn"])
            rows.append((c, None if rnd.random() < .05 else rnd.choice([t, t, t + 3, -2]), role,
                         rnd.choice(texts) if rnd.random() < .6 else f"row {len(rows)}."))
    rows += [(None, 0, "system", "Be kind."), (None, 1, "user", "Hi?"), (None, 2, "assistant", "Hi.")]
    return rows


@pytest.mark.parametrize("kw", [{}, {"block": 2}, {"rounds": 0}])
def test_repair_equals_exhaustive_search(spark, kw):
    rows = _odd_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.withColumn("c", F.lit("x")).withColumn("n", F.lit(2)).withColumn("copies", F.lit(7))
    got = {r["conv_id"]: tuple(r)[1:] for r in conversation.repair_digest(conversation.damage(df), **kw).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    want = {c: _repair(t) for c, t in _damaged(rows).items()}
    assert got == want


def test_rows_without_damage_and_repaired_rows(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Again."), (2, 0, "assistant", "Lost.")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    folded = conversation.audits(df)
    out = conversation.repaired(df, folded).orderBy("c", "at").collect()
    assert [tuple(r) for r in out if r["c"] == "=1"] == [
        ("=1", 0, "K", "user", "Hello."), ("=1", 1, "R", "assistant", "Again.")]
    assert [r["edit"] for r in out if r["c"] == "=2"] == []            # one row: deleting costs 2
    assert conversation.repair_digest(df).schema["conv_id"].dataType.simpleString() == "int"


def test_empty_and_fully_dropped_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation.repair_digest(conversation.damage(empty)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], empty.schema)
    r = conversation.repair_digest(conversation.damage(df)).first()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_conversation_over_many_blocks_and_partitions(spark):
    """One conversation with most rows, and a row repeated thousands of times."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}." if t % 7 else "cut") for t in range(3000)]
    rows += [(1, 4000, "user", "again and again.")] * 3000 + [(c, 0, "user", "x.") for c in range(2, 400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    got = conversation.repair_digest(df, block=100).filter("conv_id = 1").first()
    assert (got["duplicate"], got["truncated"], got["gaps"]) == (427 + 2999, 2, 4000 + 1 - 3001)
    assert len(got["audit"].replace("I", "")) == 6000
    one = conversation.repair_digest(df, block=1 << 20).filter("conv_id = 1").first()
    assert one == got


def test_ropes_compare_as_their_texts():
    rnd = random.Random(1)
    ropes = []
    for _ in range(200):
        r = minplus.leaf("")
        parts = ["".join(rnd.choice("DIK") for _ in range(rnd.randint(1, 3))) for _ in range(6)]
        for p in parts:
            r = minplus.joined(r, minplus.leaf(p)) if rnd.random() < .5 else minplus.joined(minplus.leaf(p), r)
        ropes.append((r, "".join(minplus.leaves(r))))
    for (x, a), (y, b) in itertools.product(ropes[:60], repeat=2):
        assert minplus.less(x, y) == (a < b)
        assert (x[:2] == y[:2]) == (a == b)


def test_matrix_products_are_associative():
    rnd = random.Random(8)
    spell = lambda m: {k: (c, "".join(minplus.leaves(r))) for k, (c, r) in m.items()}
    for _ in range(40):
        ms = [minplus.class_matrix(rnd.choice(minplus.CLASSES)) for _ in range(4)]
        left = minplus.product(minplus.product(minplus.product(ms[0], ms[1]), ms[2]), ms[3])
        right = minplus.product(minplus.product(ms[0], ms[1]), minplus.product(ms[2], ms[3]))
        assert spell(left) == spell(right)


# ------------------------------------------------------------- exact dedup
def _groups(docs):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in docs]
    out = []
    for k, (i, t) in enumerate(docs):
        same = [j for j in range(len(docs)) if norm[j] == norm[k]]
        best = min((-len(docs[j][1] or ""), docs[j][0] is None, docs[j][0] or 0) for j in same)
        out.append((i, None if best[1] else best[2], len(same), hashlib.sha256(norm[k].encode()).hexdigest()))
    return out


def _odd_texts():
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = [None, "", " \n\t ", "a b", "ab", "a  b", "A b", " ab", "é", "é", long, long.replace(" ", "\n"),
             long + "x", "same", "same", "s ame", "🙂 🙂", "🙂🙂 "]
    return [(100 - i, t) for i, t in enumerate(texts)] + [(None, "ab"), (None, "a  b  "), (None, "alone"), (5, "same"),
                                                          (5, "same"), (6, "twice"), (6, "twice")]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups_equal_brute_force(spark, weak):
    """``weak`` replaces the content hash by one with many collisions."""
    docs = _odd_texts()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    df = df.withColumn("h", F.lit(1)).withColumn("norm", F.lit("x")).withColumn("size", F.lit(None)).withColumn("id", F.lit(0))
    kw = {"hash_of": lambda t: F.substring(F.md5(t), 1, 1)} if weak else {}
    out = exactdup.exact_groups(df, **kw)
    got = out.collect()
    rows = sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "text_sha256")) for r in got), key=repr)
    assert rows == sorted(_groups(docs), key=repr)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert sorted(kept) == sorted({r["text_sha256"] for r in got})
    assert all(r["keep_id"] == r["doc_id"] for r in got if r["kept"])


def test_exact_groups_with_a_third_of_rows_in_one_group(spark):
    docs = [(i, "the very same text") for i in range(3000)] + [(10_000 + i, f"text {i}") for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = exactdup.exact_groups(df)
    assert out.filter("kept").count() == 6001
    assert out.filter("group_size = 3000 and keep_id = 0").count() == 3000
    assert exactdup.deduplicate(df).count() == 6001
    assert exactdup.exact_groups(df.limit(0)).count() == 0
