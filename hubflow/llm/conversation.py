"""Conversation structure repair: cheapest edits by a grammar-compressed DP.

A row's first fault counts: blank (white space only), duplicate (role and text
seen earlier in its conversation), truncated (last visible character is none
of ``.!?``). Repair keeps, re-roles (user or assistant), deletes or inserts
rows so that the role initials read ``(s?(ua)+)?``; costs are in ``minplus``.

1. Rows become records of role, text digest and fault flags; equal rows of one
   turn are one record with a count. The first of equal (role, text) is found by an
   aggregate joined back on (conversation, role, digest).
2. Records are range-partitioned by (conversation, turn, role, digest), so a
   conversation of any size is spread over tasks; each task writes the row
   classes of a conversation as strings of at most ``BLOCK`` characters.
3. Re-Pair: in rounds, the most frequent pairs of symbols over all strings
   (counted by Spark on the distinct ones) become grammar rules. The grammar is
   bounded by ``ROUNDS`` and ``PAIRS``; the result does not depend on it.
4. Every rule has one min-plus transfer matrix with an audit rope per state
   pair, made bottom-up once and shared by all conversations. A block's
   matrix is the product over its compressed string; equal strings of a task
   are evaluated once. The blocks of a conversation are then folded in order.
5. Each block's share of the audit meets its rows in one sorted pass, which
   returns the repaired rows.

Order: by turn (nulls first), then role, then SHA-256 of the text; copies are
adjacent. Defined results: a null role or text counts as one blank; an empty
role has no initial and is never kept; the rows without conv_id are one
conversation; a conversation without rows has zeros, an empty audit and no
repaired row; an empty table gives empty results; further columns are ignored,
whatever their names. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.llm import minplus
from hubflow.llm.ship import ship
from hubflow.session import cut_lineage, drop_tables

WHITE = " \t\n\x0b\x0c\r"
BLOCK = 4096
ROUNDS = 8
PAIRS = 32
MEMO = 1 << 16
RULE_0 = 0x100                       # characters of rules, beyond those of row classes
_COUNTS = ["n_rows", "n_turns", "blank", "duplicate", "truncated", "illegal"]
_BLOCKS = ("c string, ord bigint, role string, d binary, turn bigint, last_turn bigint, first_role string, "
           "last_role string, min_turn bigint, max_turn bigint, "
           + ", ".join(f"{x} bigint" for x in _COUNTS) + ", seq string")
_LEGAL = {"su", "ua", "au"}


def _key(conv: Column) -> Column:
    """Conversation as text; '' for null."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def _rows(conv: DataFrame) -> DataFrame:
    """(c, turn, role, text, copies) of conv_id, turn, role, text and, where
    given, copies (0: only the conversation is known)."""
    copies = F.col("copies") if "copies" in conv.columns else F.lit(1)
    return conv.select(_key(F.col("conv_id")).alias("c"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"), copies.cast("long").alias("copies"))


def damage(conv: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32(conv_id:turn) % 20: 0 drops a
    row (``copies`` 0), 1 empties its text, 2 removes its ``.!?``, 3 repeats it
    (``copies`` 2), 4 makes its role user. Nulls read as one blank."""
    blank = F.lit(" ")
    say = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    kind = F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn"))) % 20
    text = F.coalesce("text", blank)
    return conv.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def _records(rows: DataFrame) -> DataFrame:
    """One written record per distinct (c, turn, role, text): digest, count,
    fault flags and whether its first copy is the first of its role and text.
    A conversation's rows without copies leave one record with a null role."""
    seen = F.rtrim("text", F.lit(WHITE))
    there = F.col("copies") > 0
    only = lambda x: F.when(there, x)
    slim = rows.select("c", only(F.col("turn")).alias("turn"), only(F.col("role")).alias("role"),
                       only(F.unhex(F.sha2("text", 256))).alias("d"), "copies", (seen == "").alias("blank"),
                       (~F.right(seen, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    one = cut_lineage(slim.groupBy("c", "turn", "role", "d").agg(
        F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut")))
    again = (one.filter("role is not null and not blank").groupBy("c", "role", "d")
             .agg(F.count("*").alias("k"), F.min(F.struct(F.col("turn").isNotNull(), "turn"))["turn"].alias("t"))
             .filter("k > 1").select("c", "role", "d", "t", F.lit(True).alias("many")))
    again = cut_lineage(again)
    marked = one.join(again, ["c", "role", "d"], "left").select(
        "c", "turn", "role", "d", "n", "blank", "cut",
        (F.col("many").isNull() | F.col("turn").eqNullSafe(F.col("t"))).alias("lead"))
    out = cut_lineage(marked)
    drop_tables(one, again)
    return out


def _row_class(role: str, cut: bool) -> str:
    c = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return c.upper() if cut else c


def _class_strings(block: int):
    """Blocks of row classes with their counts, from records sorted by conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _BLOCKS.split(", ")]
        base, number, out, now = TaskContext.get().partitionId() << 36, 0, [], None

        def opened(c, turn, role, d):
            return {"c": c, "ord": base + number, "turn": turn, "role": role, "d": d, "first_role": None,
                    "last_role": None, "last_turn": None, "min_turn": None, "max_turn": None,
                    **dict.fromkeys(_COUNTS, 0), "seq": []}

        def table():
            for x in out:
                x["seq"] = "".join(x["seq"])
            return pa.record_batch([pa.array([x[n] for x in out], _TYPES[n]) for n in names], names=names)

        for batch in batches:
            for c, turn, role, d, n, blank, cut, lead in zip(*(batch.column(k).to_pylist() for k in (
                    "c", "turn", "role", "d", "n", "blank", "cut", "lead"))):
                if now is None or now["c"] != c:
                    if now is not None:
                        out.append(now)
                        number += 1
                    now = opened(c, turn, role, d)
                if role is None:                       # known, but without a row here
                    continue
                first = True
                while n:
                    if now["n_rows"] >= block:
                        out.append(now)
                        number += 1
                        now = opened(c, turn, role, d)
                    if not now["n_rows"]:
                        now.update(turn=turn, role=role, d=d, first_role=role)
                    take = min(n, block - now["n_rows"])
                    fresh = int(first and lead and not blank)
                    now["seq"].append((_row_class(role, cut) if fresh else "") + minplus.MUST_GO * (take - fresh))
                    now["blank" if blank else "duplicate"] += take - fresh
                    now["truncated"] += int(fresh and cut)
                    if now["last_role"] is not None:
                        now["illegal"] += (now["last_role"] + role[:1]) not in _LEGAL
                    now["illegal"] += take - 1         # a role beside itself
                    if turn is not None and (now["n_turns"] == 0 or now["last_turn"] != turn):
                        now["n_turns"] += 1
                        now["min_turn"] = turn if now["min_turn"] is None else now["min_turn"]
                        now["max_turn"] = turn
                    now["last_turn"], now["last_role"] = turn, role[:1]
                    now["n_rows"] += take
                    n, first = n - take, False
                if len(out) >= 2048:
                    yield table()
                    out = []
        if now is not None:
            out.append(now)
        if out:
            yield table()
    return run


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
_TYPES = {n: _ARROW[t] for n, t in (f.split() for f in _BLOCKS.split(", "))}


def repair_grammar(strings: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> list[str]:
    """Re-Pair rules for ``strings`` (seq, n): each two symbols, in the order in
    which they are replaced. At most ``pairs`` candidates a round reach the
    driver; those taken in one round share no symbol."""
    rules: list[str] = []
    seq = F.col("seq")
    for _ in range(rounds):
        at = strings.select(seq.alias("s"), "n").filter(F.length("s") > 1)
        two = at.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1),
                                                   lambda i: F.substring("s", i, 2))).alias("pair"))
        # in a run of one symbol only every second pair can be replaced
        same = F.substring("pair", 1, 1) == F.substring("pair", 2, 1)
        top = (two.groupBy("pair").agg(F.sum("n").alias("n"))
               .select("pair", F.when(same, F.col("n") / 2).otherwise(F.col("n")).alias("n"))
               .filter("n >= 2").orderBy(F.desc("n"), "pair").limit(pairs).collect())
        used, taken = set(), 0
        for pair in (r["pair"] for r in top):
            if not used & set(pair):
                used |= set(pair)
                seq = F.replace(seq, F.lit(pair), F.lit(chr(RULE_0 + len(rules))))
                rules.append(pair)
                taken += 1
        if not taken:
            break
    return rules


def _block_matrices(rules: list[str]):
    """Adds each block's matrix: costs, audits by (state before, state after)."""
    cells = [(i, j) for i in range(minplus.STATES) for j in range(minplus.STATES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, memo = minplus.grammar_matrices(rules, RULE_0), {}

        def evaluate(seq: str):
            short = seq
            for k, pair in enumerate(rules):
                short = short.replace(pair, chr(RULE_0 + k))
            m = None
            for symbol in short:
                m = table[symbol] if m is None else minplus.product(m, table[symbol])
            m = m or {(i, i): (0, minplus.leaf("")) for i in range(minplus.STATES)}
            return ([m[x][0] if x in m else None for x in cells],
                    ["".join(minplus.leaves(m[x][1])) if x in m else None for x in cells])

        for b in batches:
            found = []
            for seq in b.column("seq").to_pylist():
                if seq not in memo:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[seq] = evaluate(seq)
                found.append(memo[seq])
            rest = [n for n in b.schema.names if n != "seq"]
            yield pa.record_batch([*(b.column(n) for n in rest), pa.array([c for c, _ in found], pa.list_(pa.int64())),
                                   pa.array([a for _, a in found], pa.list_(pa.string()))],
                                  names=[*rest, "costs", "audits"])
    return run


_KEPT = ["c", "ord", "turn", "role", "d"]
_FOLDED = ("c string, ord bigint, turn bigint, role string, d binary, part string, last boolean, cost bigint, "
           "audit string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each conversation in order -> every block's share of the audit
    and, on the last one, the conversation's counts, cost and whole audit."""
    names = [f.split()[0] for f in _FOLDED.split(", ")]
    types = [{"boolean": pa.bool_()}.get(f.split()[1]) or _ARROW[f.split()[1]] for f in _FOLDED.split(", ")]
    rows = (r for b in batches for r in b.to_pylist())
    out = []
    for _, blocks in groupby(rows, key=lambda r: r["c"]):
        places, total, prev = [], dict.fromkeys(_COUNTS, 0), None
        low = high = None
        # per state: cost, and a chain (whole rope, chain before, this block's rope)
        vector = {minplus.START: (0, (minplus.leaf(""), None, None))}
        for b in blocks:
            for k in _COUNTS:
                total[k] += b[k]
            if b["min_turn"] is not None:
                low = b["min_turn"] if low is None else low
                high = b["max_turn"]
            if b["n_rows"]:
                if prev is not None:
                    total["illegal"] += (prev[1] + b["first_role"][:1]) not in _LEGAL
                    total["n_turns"] -= prev[0] is not None and prev[0] == b["turn"]
                prev = (b["last_turn"], b["last_role"])
            after: dict = {}
            for i, (c1, chain) in vector.items():
                for j in range(minplus.STATES):
                    c2 = b["costs"][i * minplus.STATES + j]
                    if c2 is None or (j in after and c1 + c2 > after[j][0]):
                        continue
                    own = minplus.leaf(b["audits"][i * minplus.STATES + j])
                    whole = minplus.joined(chain[0], own)
                    if j not in after or minplus.better((c1 + c2, whole), (after[j][0], after[j][1][0])):
                        after[j] = (c1 + c2, (whole, chain, own))
            vector = after
            places.append([b[k] for k in _KEPT])
        cost, rope = minplus.finished({j: (c, ch[0]) for j, (c, ch) in vector.items()})
        # which state it ended in: the chain whose rope the finished one extends
        audit = "".join(minplus.leaves(rope))
        ends = [(j, ch) for j, (c, ch) in vector.items() for k in minplus.ACCEPT
                if (j, k) in minplus.INSERTS and c + minplus.INSERTS[j, k][0] == cost
                and minplus.joined(ch[0], minplus.INSERTS[j, k][1])[:2] == rope[:2]]
        chain, shares = ends[0][1], []
        while chain[1] is not None:
            shares.append("".join(minplus.leaves(chain[2])))
            chain = chain[1]
        shares.reverse()
        shares[-1] += audit[sum(map(len, shares)):]
        gaps = 0 if low is None else high - low + 1 - total["n_turns"]
        for k, (place, share) in enumerate(zip(places, shares)):
            last = k == len(places) - 1
            out.append([*place, share, last, cost if last else None, audit if last else None,
                        *(x if last else None for x in (gaps, total["blank"], total["duplicate"],
                                                        total["truncated"], total["illegal"]))])
        if len(out) >= 2048:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)
            out = []
    if out:
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)


def audits(conv: DataFrame, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """Written rows of ``_FOLDED``: each block's share of its conversation's
    audit; ``last`` rows carry cost, audit and fault counts."""
    ship(conv.sparkSession)
    records = _records(_rows(conv))
    key = ["c", "turn", "role", "d"]
    blocks = cut_lineage(records.repartitionByRange(*key).sortWithinPartitions(*key)
                         .select(*key, "n", "blank", "cut", "lead").mapInArrow(_class_strings(block), _BLOCKS))
    strings = cut_lineage(blocks.groupBy("seq").agg(F.count("*").alias("n")))
    rules = repair_grammar(strings, rounds)
    schema = _BLOCKS.removesuffix(", seq string") + ", costs array<bigint>, audits array<string>"
    out = cut_lineage(blocks.mapInArrow(_block_matrices(rules), schema)
                      .repartition("c").sortWithinPartitions("c", "ord").mapInArrow(_fold, _FOLDED))
    drop_tables(records, blocks, strings)
    return out


_REPAIRED = "c string, at bigint, edit string, role string, text string"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows from audit shares and rows, sorted so that a share comes
    before the first of its rows."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [f.split()[0] for f in _REPAIRED.split(", ")]
    c_now, edits, at, after = None, deque(), 0, 0
    for batch in batches:
        out: list[list] = [[], [], [], [], []]

        def put(edit, role, text, c):
            nonlocal at
            for col, v in zip(out, (c, at, edit, role, text)):
                col.append(v)
            at += 1

        def written(edit, role, text, c):
            """A row in the role that the state asks for."""
            nonlocal after
            if edit == "K":
                after = minplus._AFTER[after, role[:1]]
            else:
                want = "u" if (after, "u") in minplus._AFTER else "a"
                after, role = minplus._AFTER[after, want], {"u": "user", "a": "assistant"}[want]
            put(edit, role, text, c)

        def inserted(c):
            while edits and edits[0] == "I":
                edits.popleft()
                written("I", "", "", c)

        for c, part, role, text, copies in zip(*(batch.column(k).to_pylist() for k in (
                "c", "part", "role", "text", "copies"))):
            if c != c_now:
                c_now, at, after = c, 0, 0
                edits.clear()
            if part is not None:
                edits.extend(part)
                continue
            for _ in range(copies):
                inserted(c)
                edit = edits.popleft()
                if edit == "D":
                    continue
                written(edit, role, text, c)
            if not any(e != "I" for e in edits):       # rows at the end of what is known so far
                inserted(c)
        yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds)], names=names)


def repaired(conv: DataFrame, folded: DataFrame) -> DataFrame:
    """Repaired rows (c, at, edit, role, text); each conversation is in one
    partition, in order of ``at``."""
    rows = _rows(conv).filter("copies > 0")
    n = F.lit(None)
    left = rows.select("c", "turn", "role", F.unhex(F.sha2("text", 256)).alias("d"), F.lit(1).alias("side"),
                       n.cast("bigint").alias("ord"), n.cast("string").alias("part"), "text", "copies")
    right = folded.select("c", "turn", "role", "d", F.lit(0).alias("side"), "ord", "part",
                          n.cast("string").alias("text"), F.lit(0).cast("bigint").alias("copies"))
    # rows of one place are alike, shares of one place follow their number
    return (left.unionByName(right).repartition("c")
            .sortWithinPartitions("c", "turn", "role", "d", "side", "ord")
            .select("c", "part", "role", "text", "copies").mapInArrow(_apply, _REPAIRED))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` lines; one state at a time."""
    now, state, out = None, None, ([], [])
    for batch in batches:
        for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("c", "role", "text"))):
            if c != now:
                if state is not None:
                    out[0].append(now)
                    out[1].append(state.hexdigest())
                now, state = c, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
    if state is not None:
        out[0].append(now)
        out[1].append(state.hexdigest())
    yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], names=["c", "repaired_sha256"])


def repair_digest(conv: DataFrame, **kw) -> DataFrame:
    """One row per conversation: fault counts, cost, audit and the digest of its
    repaired rows."""
    kind = conv.schema["conv_id"].dataType.simpleString()
    folded = audits(conv, **kw)
    made = repaired(conv, folded).mapInArrow(_digest, "c string, repaired_sha256 string")
    empty = F.sha2(F.lit(""), 256)
    return (folded.filter("last").join(made, "c", "left")
            .select(F.when(F.col("c") != "", F.expr("substr(c, 2)")).cast(kind).alias("conv_id"), "gaps", "blank",
                    "duplicate", "truncated", "illegal", "cost", "audit",
                    F.coalesce("repaired_sha256", empty).alias("repaired_sha256")))
