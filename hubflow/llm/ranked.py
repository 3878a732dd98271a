"""Ranked lexical search of many items at once, with shared partial sums.

Terms are the runs of letters and digits (ASCII) and non-ASCII characters, A-Z
lower-cased. The score of a document is the sum, over the item's terms with
repeats, of w * (10^9 tf div (1000 tf + 8 m)), all in integers; see ``search``.

1. Items are taken in blocks of about ``BLOCK_TERMS`` (item, term) pairs. A
   block's distinct terms are its vocabulary; only the block is on the driver.
2. One pass over all documents counts their terms and keeps, per document, the
   numbers and frequencies of vocabulary terms as two arrays, written once.
   Corpus statistics (N, L, df) are aggregated from that table.
3. Common subexpressions: of all pairs of nodes that occur together in several
   items the one in most items becomes a node of its own (a shared term set),
   again and again until no pair occurs in two items. The nodes are a DAG whose
   leaves are weighted terms; items are sums of what is left.
4. Each task goes through its documents in slices: term contributions are
   scattered into a (leaf, document) matrix, every inner node is added once from
   its two parts for the whole slice, and items add up their nodes. A task
   keeps the best ``top_k`` per item, so only those rows are shuffled; they
   are ranked per (item, salt) and then per item.

Scores are exact 64-bit integers, so sharing changes no result. Words meet the
vocabulary by 64-bit hashes; every distinct word that meets a term is compared
with its length as well.

Defined results: null and empty texts have no term; items without a term that
occurs have no row; every row of ``items`` is an item of its own, equal rows
give equal results; every row of ``docs`` is a document of its own, rows without
id rank after others of equal score; empty tables give empty results; further
columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubflow.llm import textnp
from hubflow.llm.ship import ship
from hubflow.session import cut_lineage, drop_tables

TOP_K = 10
BLOCK_TERMS = 1 << 18
WINDOW = 256                     # nodes of an item that are paired with each other
SLICE_BYTES = 16 << 20           # partial sums of a slice of documents
SALTS = 32
U = np.uint64

_GAPS = np.ones(256, dtype=bool)
_GAPS[128:] = False
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _GAPS[_lo:_hi] = False


def _term_hashes(col) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term, mixed with its length, and first term per row."""
    h, first, start, end = textnp.words(*textnp.text_buffers(col), spans=True, gaps=_GAPS)
    return textnp.mix(h ^ (end - start).astype(U) * U(0x9E3779B97F4A7C15)), first


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of each item with their counts."""
    for b in textnp.pieces(batches, "text"):
        h, first = _term_hashes(b.column("text"))
        terms, counts = [], []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            t, c = np.unique(h[lo:hi], return_counts=True)
            terms.append(t.view(np.int64))
            counts.append(c.astype(np.int64))
        yield pa.record_batch([b.column("q"), pa.array(terms, pa.list_(pa.int64())),
                               pa.array(counts, pa.list_(pa.int64()))], names=["q", "terms", "counts"])


def _postings(vocabulary):
    """Per document with a term: its terms counted, and the vocabulary's among
    them by number and frequency."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        for b in textnp.pieces(batches, "text"):
            h, first = _term_hashes(b.column("text"))
            doc = np.repeat(np.arange(b.num_rows), np.diff(first))
            at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
            hit = words[at] == h if len(words) else np.zeros(len(h), bool)
            pair, tf = np.unique(doc[hit] * (len(words) + 1) + at[hit], return_counts=True)
            doc, term = np.divmod(pair, len(words) + 1)
            offs = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32))
            n = np.diff(first)
            out = pa.record_batch([
                b.column("id"), pa.array(n.astype(np.int64)),
                pa.ListArray.from_arrays(offs, pa.array(term.astype(np.int32))),
                pa.ListArray.from_arrays(offs, pa.array(tf.astype(np.int32)))], names=["id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))
    return run


class Plan:
    """Query-sharing DAG of a block of items: ``leaves`` (term, repeats), then
    one (left, right) per inner node; ``items`` lists the nodes that each item adds up."""

    def __init__(self, items: list[dict[int, int]]):
        leaves = sorted({x for it in items for x in it.items()})
        number = {x: k for k, x in enumerate(leaves)}
        support = Counter(number[x] for it in items for x in it.items())
        # sets of at most WINDOW nodes, often shared ones together
        parts, owner = [], []
        for k, it in enumerate(items):
            nodes = sorted((number[x] for x in it.items()), key=lambda n: (-support[n], n))
            for lo in range(0, len(nodes), WINDOW):
                parts.append(set(nodes[lo:lo + WINDOW]))
                owner.append(k)
        self.leaves, self.inner = leaves, []
        self._share(parts)
        self.items: list[list[int]] = [[] for _ in items]
        for p, k in zip(parts, owner):
            self.items[k] += sorted(p)

    def _share(self, parts: list[set[int]]) -> None:
        holders: dict[int, set[int]] = {}
        for k, p in enumerate(parts):
            for n in p:
                holders.setdefault(n, set()).add(k)
        often = {n for n, h in holders.items() if len(h) > 1}
        count: Counter = Counter()
        for p in parts:
            s = sorted(p & often)
            count.update((s[i], s[j]) for i in range(len(s)) for j in range(i + 1, len(s)))
        heap = [(-c, pair) for pair, c in count.items() if c > 1]
        heapq.heapify(heap)
        while heap:
            c, pair = heapq.heappop(heap)
            if count[pair] != -c:
                if count[pair] > 1:
                    heapq.heappush(heap, (-count[pair], pair))
                continue
            a, b = pair
            new = len(self.leaves) + len(self.inner)
            self.inner.append(pair)
            users = holders[a] & holders[b]
            holders[new] = set(users)
            touched: set = set()
            for k in users:
                p = parts[k]
                p -= {a, b}
                holders[a].discard(k)
                holders[b].discard(k)
                for x in p:
                    if x in often:
                        count[min(a, x), max(a, x)] -= 1
                        count[min(b, x), max(b, x)] -= 1
                        count[x, new] += 1
                        touched.add((x, new))
                p.add(new)
            count[pair] = 0
            often.add(new)
            for t in touched:
                if count[t] > 1:
                    heapq.heappush(heap, (-count[t], t))

    def additions(self) -> int:
        """Sums made per document."""
        return len(self.inner) + sum(max(0, len(i) - 1) for i in self.items)

    def steps(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Inner nodes by depth: (nodes, left parts, right parts)."""
        depth, levels = [0] * len(self.leaves), {}
        for k, (a, b) in enumerate(self.inner):
            depth.append(1 + max(depth[a], depth[b]))
            levels.setdefault(depth[-1], []).append((len(self.leaves) + k, a, b))
        return [tuple(np.array(x) for x in zip(*levels[d])) for d in sorted(levels)]


def _trimmed(found: tuple, top_k: int) -> tuple:
    """The best rows of every item: (item, score, no id, id), sorted."""
    item, score, none, ids = found
    by = np.lexsort((ids, none, -score, item))
    item = item[by]
    begin = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))) if len(item) else np.zeros(0, int)
    place = np.arange(len(item)) - np.repeat(begin, np.diff(np.append(begin, len(item))))
    keep = by[place < top_k]
    return tuple(x[keep] for x in found)


def _best(shared, top_k: int):
    """Each task's best documents per item, by the block's DAG."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weight, n_docs, n_words = shared.value
        leaf_term = np.array([t for t, _ in plan.leaves], np.int64)
        leaf_times = np.array([c for _, c in plan.leaves], np.int64)
        steps, n_leaves = plan.steps(), len(plan.leaves)
        n_nodes = n_leaves + len(plan.inner)
        nodes = [np.array(i, np.int64) for i in plan.items]
        if not nodes:
            return
        width = max(16, SLICE_BYTES // (8 * max(1, n_nodes)))
        found = tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))
        floor = np.zeros(len(nodes), np.int64)      # scores below cannot enter any more
        for b in batches:
            ids = b.column("id")
            none = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0))
            n = np.asarray(b.column("n"))
            if len(n) and 75 * int(n.max()) * n_docs >= 1 << 63:
                m = np.array([25 + 75 * int(x) * n_docs // n_words for x in n], np.int64)
            else:
                m = 25 + 75 * n * n_docs // max(n_words, 1)
            offs = np.asarray(b.column("terms").offsets)
            term, tf = (np.asarray(b.column(c).values).astype(np.int64) for c in ("terms", "tfs"))
            for lo in range(0, len(ids), width):
                hi = min(lo + width, len(ids))
                s = slice(offs[lo], offs[hi])
                doc = np.repeat(np.arange(hi - lo), np.diff(offs[lo:hi + 1]))
                value = weight[term[s]] * ((1_000_000_000 * tf[s]) // (1000 * tf[s] + 8 * m[lo + doc]))
                by_term = np.zeros((len(weight), hi - lo), np.int64)
                by_term[term[s], doc] = value
                sums = np.empty((n_nodes, hi - lo), np.int64)
                np.multiply(by_term[leaf_term], leaf_times[:, None], out=sums[:n_leaves])
                for out, left, right in steps:
                    sums[out] = sums[left] + sums[right]
                score = np.stack([sums[k].sum(axis=0) for k in nodes])
                item, doc = np.nonzero((score > 0) & (score >= floor[:, None]))
                found = tuple(np.concatenate(x) for x in zip(found, (
                    item, score[item, doc], none[lo + doc], ids[lo + doc])))
                if len(found[0]) > 4 * top_k * len(nodes):
                    found = _trimmed(found, top_k)
                    full = np.bincount(found[0], minlength=len(nodes)) >= top_k
                    least = np.full(len(nodes), np.iinfo(np.int64).max)
                    np.minimum.at(least, found[0], found[1])
                    floor = np.where(full, least, 0)
        item, score, none, ids = _trimmed(found, top_k)
        yield pa.record_batch([pa.array(item.astype(np.int32)), pa.array(ids, mask=none), pa.array(score)],
                              names=["i", "id", "score"])
    return run


def _search_block(docs: DataFrame, block: list, top_k: int) -> tuple[DataFrame, tuple]:
    """(q, rank, id, score) of one block of items, and the tables behind it."""
    spark = docs.sparkSession
    words = np.unique(np.array([t for r in block for t in r["terms"]], np.int64).view(U))
    posts = cut_lineage(docs.mapInArrow(_postings(spark.sparkContext.broadcast(words)),
                                        "id bigint, n bigint, terms array<int>, tfs array<int>"))
    n_docs, n_words = posts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(words), np.int64)
    for r in posts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
        df[r["t"]] = r["df"]                       # one row per vocabulary term at most
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) if x else 0 for x in df],
                      np.int64)
    here = [dict(zip(np.searchsorted(words, np.array(r["terms"], np.int64).view(U)).tolist(), r["counts"]))
            for r in block]
    # terms that occur nowhere, or weigh nothing, add nothing
    plan = Plan([{t: c for t, c in it.items() if weight[t] > 0} for it in here])
    shared = spark.sparkContext.broadcast((plan, weight, n_docs, n_words))
    local = posts.mapInArrow(_best(shared, top_k), "i int, id bigint, score bigint")
    order = [F.desc("score"), F.col("id").isNull(), "id"]
    salted = local.withColumn("_s", F.pmod(F.xxhash64("id", "score"), F.lit(SALTS)))
    first = Window.partitionBy("i", "_s").orderBy(*order)
    salted = salted.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= top_k)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(*order))).filter(
        F.col("rank") <= top_k)
    q = spark.createDataFrame([(k, r["q"]) for k, r in enumerate(block)], "i int, q bigint")
    return ranked.join(F.broadcast(q), "i").select("q", "rank", "id", "score"), (posts,)


def search(docs: DataFrame, items: DataFrame, top_k: int = TOP_K, doc_col: str = "doc_id",
           item_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, doc, score): the ``top_k`` documents of each item with a
    score above 0, best first, equal scores by ascending id.

    N counts the documents with a term, L all their terms, n one document's, df
    the documents with a term: w = floor(1000 ln((2N+2) / (2df+1))) and
    m = 25 + (75 n N) div L. Document ids are integers."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(doc_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = cut_lineage(items.select(F.monotonically_increasing_id().alias("q"), F.col(item_col).alias("item"),
                                     F.col(text_col).alias("text")))
    terms = cut_lineage(asked.select("q", "text").mapInArrow(
        _item_terms, "q bigint, terms array<bigint>, counts array<bigint>"))
    total = terms.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_terms))
    deal = F.pmod(F.xxhash64("q"), F.lit(blocks))
    done = None
    for k in range(blocks):
        block = terms.filter((deal == k) & (F.size("terms") > 0)).orderBy("q").collect()
        if not block and done is not None:
            continue
        found, behind = _search_block(texts, block, top_k)
        part = cut_lineage(found)
        drop_tables(*behind)
        done = part if done is None else done.unionByName(part)
    return done.join(asked.select("q", "item"), "q").select(
        F.col("item").alias(item_col), "rank", F.col("id").alias(doc_col), "score")
