"""Stupid-backoff language-model scores from the corpus's own n-gram counts.

score(w | context) = count(context w) / count(context) where the n-gram was
seen at least ``min_count`` times, else ALPHA times the score with the
context's first word left out; a word below ``min_count`` gets
ALPHA^(order - 1) / N. A document's result is the mean natural logarithm over
its words (contexts do not cross documents).

The computation is relational, in three exchanges:
1. documents are dealt to chunks by a hash of their id; a chunk's n-grams of
   every order are counted inside its task;
2. each chunk sends its distinct n-gram hashes with their counts to hash
   partitions (one packed row per chunk and partition). A partition adds up
   the counts of all chunks: this is its share of the count tables; it joins
   them to the n-grams that asked and returns each chunk its own counts;
3. each chunk joins the returned counts to its documents' positions and sums
   per document.

N-grams are 64-bit hashes, rounded to 52 bits in transit. An n-gram on every
page costs one entry per chunk, as counting combines inside the chunk, so no
partition grows with a frequent n-gram; the numbers of chunks and partitions
follow the corpus, so a task's share stays bounded.

Defined results: null and empty texts have no words, a null mean and a sum of
0; repeated rows count as text of their own and get equal scores; rows
without id are scored too; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.llm import textnp
from hubflow.llm.ngram_join import _runs
from hubflow.llm.ship import ship

ORDER = 3
MIN_COUNT = 2
ALPHA = 0.4
CHUNK_BYTES = 6 << 20
PART_BYTES = 8 << 20
KEPT_BITS = 52
U = np.uint64


def _grams(h: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Per order n: hash of the n-gram that ends at each word, 0 where the
    document has fewer words before it."""
    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    out = []
    for n in range(1, order + 1):
        g = np.zeros(len(h), U)
        if len(h) >= n:
            g[n - 1:] = (textnp.ngram_hashes(h, n) >> U(64 - KEPT_BITS)) | U(1)
        g[place < n - 1] = 0
        out.append(g)
    return out


def _distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of all orders, the order in the top bits."""
    tagged = np.concatenate([g[g > 0] | U(n << KEPT_BITS) for n, g in enumerate(grams)])
    return np.unique(tagged, return_counts=True)


def _part_of(x: np.ndarray, parts: int) -> np.ndarray:
    # by the hash's upper half, so that each partition is a range of every order
    return (((x & U((1 << KEPT_BITS) - 1)) >> U(KEPT_BITS - 32)) * U(parts)) >> U(32)


def pack_counts(n: np.ndarray) -> bytes:
    """Counts with equal bytes side by side, deflated: four bytes a count, or
    eight where the greatest needs more."""
    wide = len(n) > 0 and int(n.max()) >> 32 > 0
    kind, width = (np.uint64, 8) if wide else (np.uint32, 4)
    planes = np.ascontiguousarray(n.astype(kind).view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zlib.compress(planes.tobytes(), 6)


def unpack_counts(b: bytes) -> np.ndarray:
    width = b[0]
    planes = np.frombuffer(zlib.decompress(b[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64 if width == 8 else np.uint32).ravel().astype(np.int64)


def pack_sorted(x: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted numbers as differences, their least bytes apart from the rest."""
    d = np.diff(x, prepend=U(0))
    planes = d.view(np.uint8).reshape(-1, 8).T
    width = 8
    while width > 1 and not planes[width - 1].any():
        width -= 1
    raw = np.ascontiguousarray(planes[:width]).tobytes()
    return bytes([width]) + len(x).to_bytes(8, "little") + raw + pack_counts(n)


def unpack_sorted(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, m = b[0], int.from_bytes(b[1:9], "little")
    planes = np.zeros((8, m), np.uint8)
    planes[:width] = np.frombuffer(b, np.uint8, width * m, 9).reshape(width, m)
    x = np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel(), dtype=U)
    return x, unpack_counts(b[9 + width * m:])


def _chunk_tables(batches, order: int):
    """(chunk, rows, words, n-grams) of each chunk; rows arrive sorted by chunk."""
    for t in _runs(batches, ["chunk"]):
        h, first = textnp.words(*textnp.text_buffers(t["text"]))
        yield t, first, _grams(h, first, order)


def _requests(order: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first, grams in _chunk_tables(batches, order):
            x, n = _distinct(grams)
            part = _part_of(x, parts)
            by = np.lexsort((x, part))
            x, n, part = x[by], n[by], part[by]
            at = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), part[1:] != part[:-1])))
            rows = [(int(part[a]), pack_sorted(x[a:z], n[a:z]))
                    for a, z in zip(at.tolist(), [*at[1:].tolist(), len(x)])]
            yield pa.record_batch([
                pa.array([t["chunk"][0].as_py()] * len(rows), pa.int32()),
                pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())],
                names=["chunk", "part", "grams"])
    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts over all chunks for every n-gram that a chunk sent."""
    for t in _runs(batches, ["part"]):
        sent = [unpack_sorted(b) for b in t["grams"].to_pylist()]
        x = np.concatenate([a for a, _ in sent])
        keys, place = np.unique(x, return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([n for _, n in sent])).astype(np.int64)
        cut = np.cumsum([0] + [len(a) for a, _ in sent])
        back = [pack_counts(total[place[a:z]]) for a, z in zip(cut[:-1], cut[1:])]
        yield pa.record_batch([t["chunk"].combine_chunks(), t["part"].combine_chunks(),
                               pa.array(back, pa.binary())], names=["chunk", "part", "counts"])


def _scored(order: int, parts: int, min_count: int, alpha: float, n_words: int, id_type):
    def one(t: pa.Table, replies: pa.Table) -> pa.Table:
        h, first = textnp.words(*textnp.text_buffers(t["text"]))
        grams = _grams(h, first, order)
        x, _ = _distinct(grams)
        by = np.lexsort((x, _part_of(x, parts)))
        got = sorted(zip(replies["part"].to_pylist(), replies["counts"].to_pylist()))
        count = np.zeros(len(x), np.int64)
        if got:
            count[by] = np.concatenate([unpack_counts(c) for _, c in got])
        counts = []
        for n, g in enumerate(grams):
            c = np.zeros(len(g), np.int64)
            has = g > 0
            c[has] = count[np.searchsorted(x, g[has] | U(n << KEPT_BITS))]
            counts.append(c)
        score = np.full(len(h), math.log(alpha) * (order - 1) - math.log(max(n_words, 1)))
        open_ = np.ones(len(h), bool)
        used = np.zeros((order + 1, len(h)), bool)
        for n in range(order, 0, -1):
            seen = open_ & (counts[n - 1] >= min_count)
            if n == 1:
                context = np.full(int(seen.sum()), n_words)
            else:
                # the context is the (n-1)-gram that ends one word earlier
                context = counts[n - 2][np.flatnonzero(seen) - 1]
            score[seen] = (np.log(counts[n - 1][seen]) - np.log(np.maximum(context, 1))
                           + math.log(alpha) * (order - n))
            used[n] = seen
            open_ &= ~seen
        total = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[first])
        words = np.diff(first)
        s = np.zeros(len(words))      # summed document by document, not from one running sum
        if len(score):
            s[words > 0] = np.add.reduceat(score, first[:-1][words > 0])
        return pa.table({
            "id": t["id"], "n_words": pa.array(words.astype(np.int64)),
            "log_score": pa.array(s),
            "mean_log_score": pa.array(s / np.maximum(words, 1), mask=words == 0),
            "n_full": pa.array(total(used[order]).astype(np.int64)),
            "n_unseen": pa.array(total(open_).astype(np.int64))})
    return one


def stupid_backoff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   order: int = ORDER, min_count: int = MIN_COUNT, alpha: float = ALPHA,
                   chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: id, n_words, log_score, mean_log_score, n_full
    (words scored at the full order), n_unseen (words below ``min_count``)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    size, n_words = rows.agg(
        F.sum(F.octet_length("text")), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()
    size, n_words = size or 0, n_words or 0
    chunks = max(1, -(-size // chunk_bytes))
    parts = max(1, -(-size * order // part_bytes))
    # null ids share no chunk with each other: the text's hash deals them
    deal = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.col("text"), F.lit(""))), F.lit(chunks))
    chunked = rows.withColumn("chunk", deal.cast("int")).repartition(chunks, "chunk").sortWithinPartitions("chunk")
    sent = chunked.mapInArrow(_requests(order, parts), "chunk int, part int, grams binary")
    # one plan for both uses of the chunks, so that their exchange is made once
    answers = (sent.repartition(parts, "part").sortWithinPartitions("part")
               .mapInArrow(_answers, "chunk int, part int, counts binary"))
    one = _scored(order, parts, min_count, alpha, n_words, kind)
    return (chunked.groupBy("chunk").cogroup(answers.groupBy("chunk"))
            .applyInArrow(one, f"id {kind}, n_words bigint, log_score double, mean_log_score double, "
                               "n_full bigint, n_unseen bigint")
            .withColumnRenamed("id", id_col))
