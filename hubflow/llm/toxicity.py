"""Toxic passages by maximum-scoring segments over token log-odds.

Fit (on labelled rows only):
1. At most ``max_per_class`` ids of each label, the smallest by MD5, with one
   text each, make the training sample, so its size is bounded and known.
2. Every word, and every word beginning of 4 to 9 bytes, gets its log-odds
   between toxic and clean documents under Dirichlet priors (a symmetric part
   plus one that follows its overall share), with its z value; those beyond
   ``Z_LEAST`` are the lexicon (at most ``max_lexicon``). A token weighs what
   its strongest feature in the lexicon (by z) weighs, else nothing.
3. A token's score is its log-odds less ``drift``, so the expected score of
   clean text is negative. lambda solves sum(p * exp(lambda * score)) = 1 over
   clean text, K follows from clean documents' best segments: the best score
   S of n clean words then has E = K * n * exp(-lambda * S) segments as good
   by chance (extreme-value law), and the number of segments at or above any
   score is Poisson, so r segments of at least S have a chance near E^r / r!.
   A text's evidence is its strongest r, as -ln of that chance.
4. Each of FOLDS parts of the sample is scored by the lexicon of the others;
   a logistic curve fitted to these out-of-sample statistics gives the score.

Scoring visits every whole text once, in linear time: all maximal segments
(Ruzzo and Tompa), of which those with E below ``e_most`` are passages.

Defined results: null and empty texts have no segment and get the score of
a text without evidence; ties between segments keep the text's order;
repeated rows get equal scores; labels without a document, or without a
label value, teach nothing; with no labelled row of either class every score
is 0. Only id, text and the labels are read, whatever other columns exist.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.llm import textnp
from hubflow.llm.sample import one_text, smallest
from hubflow.llm.ship import ship
from hubflow.session import cut_lineage

MAX_PER_CLASS = 10_000
MAX_LEXICON = 50_000
PRIOR = 0.5
PRIOR_SHARE = 100.0
Z_LEAST = 2.6
FOLDS = 4
PREFIXES = range(4, 10)
NO_EVIDENCE = -5.0
DRIFT = 0.3
E_MOST = 0.05
GUMBEL_MEAN = 0.5772156649


@dataclass
class Lexicon:
    hashes: np.ndarray
    scores: np.ndarray          # log-odds of each hash
    weight: np.ndarray          # |z| of each hash
    drift: float = DRIFT
    lam: float = 1.0
    log_k: float = 0.0


@dataclass
class Model:
    lexicon: Lexicon | None = None
    curve: tuple[float, ...] = field(default=(0.0, 0.0, 0.0))

    def probability(self, best: np.ndarray, total: np.ndarray) -> np.ndarray:
        if self.lexicon is None:
            return np.zeros(len(best))
        x = _features(best, total) @ np.array(self.curve)
        return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def _features(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(best)), np.clip(best, NO_EVIDENCE, 15.0), np.log1p(total)])


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of one text in order."""
    cum = np.concatenate(([0.0], np.cumsum(score)))
    up = np.flatnonzero(score > 0)
    left, right, first, last, link = [], [], [], [], []
    for i, a, b in zip(up.tolist(), cum[up].tolist(), cum[up + 1].tolist()):
        s = i
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= a:
                j = link[j]
            if j < 0 or right[j] >= b:
                left.append(a), right.append(b), first.append(s), last.append(i + 1), link.append(j)
                break
            a, s = left[j], first[j]
            del left[j:], right[j:], first[j:], last[j:], link[j:]
    return [(s, e, r - a) for a, r, s, e in zip(left, right, first, last)]


class Tokens:
    """The letter words of a batch of texts and their lexicon features."""

    def __init__(self, texts):
        self.offs, self.raw = textnp.text_buffers(texts)
        h, self.first, self.start, self.end = textnp.words(
            self.offs, self.raw, spans=True, gaps=textnp.NOT_LETTER)
        at, self.place = textnp.distinct_words(h)
        # features of each distinct word: (hash, whether it has that feature)
        self.features = [(h[at], np.ones(len(at), bool)), *textnp.prefix_hashes(
            self.raw, self.start[at], self.end[at], PREFIXES)]

    def scores(self, lex: Lexicon) -> np.ndarray:
        n = len(self.features[0][0])
        best, out = np.zeros(n), np.full(n, -lex.drift)
        if len(lex.hashes):
            for h, has in self.features:
                at = np.minimum(np.searchsorted(lex.hashes, h), len(lex.hashes) - 1)
                hit = (lex.hashes[at] == h) & has & (lex.weight[at] > best)
                best[hit] = lex.weight[at[hit]]
                out[hit] = lex.scores[at[hit]] - lex.drift
        return out[self.place]


def _evidence(lex: Lexicon, score: np.ndarray, first: np.ndarray):
    """Per text: -ln E of the best segment (NO_EVIDENCE without any), the
    evidence of its strongest number of segments, and the significant ones."""
    n = len(first) - 1
    best, total, found = np.full(n, NO_EVIDENCE), np.zeros(n), [[] for _ in range(n)]
    positive = np.concatenate(([0], np.cumsum(score > 0)))
    rows = np.flatnonzero(positive[first[1:]] > positive[first[:-1]])
    for r in rows.tolist():
        a, b = int(first[r]), int(first[r + 1])
        limit = lex.log_k + math.log(b - a)
        segs = [(s, e, v, lex.lam * v - limit) for s, e, v in maximal_segments(score[a:b])]
        best[r] = max(x[3] for x in segs)
        found[r] = [x for x in segs if x[3] > -math.log(E_MOST)]
        x = np.sort(np.array([v[3] for v in segs]))[::-1]
        k = np.arange(1, len(x) + 1)
        total[r] = max(0.0, float((k * x + np.cumsum(np.log(k))).max()))
    return best, total, found


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, by fold and label (g = fold * 2 + toxic)."""
    for b in textnp.pieces(batches, "text"):
        t = Tokens(b.column("text"))
        group = np.asarray(b.column("fold")) * 2 + np.asarray(b.column("toxic"))
        doc = np.repeat(np.arange(len(group)), np.diff(t.first))
        key = np.unique(np.stack([t.place, doc]), axis=1)      # distinct (word, document)
        word, doc = key[0], key[1]
        for h, has in t.features:
            keep = has[word]
            pair = np.unique(np.stack([h[word[keep]], doc[keep].astype(np.uint64)]), axis=1)
            g = group[pair[1].astype(np.int64)].astype(np.uint64)
            cell, n = np.unique(np.stack([pair[0], g]), axis=1, return_counts=True)
            yield pa.record_batch([pa.array(np.ascontiguousarray(cell[0]).view(np.int64)),
                                   pa.array(cell[1].astype(np.int32)), pa.array(n.astype(np.int64))],
                                  names=["h", "g", "n"])


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str,
                    label_col: str, max_per_class: int) -> DataFrame:
    """(id, fold, toxic, text) of at most ``max_per_class`` labelled ids a class,
    one row per id."""
    ranked = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
              .groupBy(id_col).agg(F.max(label_col).cast("int").alias("toxic"))
              .withColumn("_m", F.md5(F.col(id_col).cast("string"))))
    pick = [smallest(ranked.filter(F.col("toxic") == y), "_m", max_per_class, id_col) for y in (0, 1)]
    sample = (pick[0].unionByName(pick[1])
              .select(F.col(id_col).alias("id"), "toxic",
                      (F.conv(F.substring("_m", 32, 1), 16, 10).cast("int") % FOLDS).alias("fold")))
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .join(F.broadcast(sample), "id")       # 2 * max_per_class rows at most
            .groupBy("id", "toxic", "fold").agg(one_text("text").alias("text")))


def _lexicon(counts: DataFrame, groups: list[int], docs_by_group: dict[int, int],
             max_lexicon: int) -> Lexicon | None:
    """Log-odds of the features in the given groups (fold * 2 + toxic)."""
    tox = [g for g in groups if g % 2]
    clean = [g for g in groups if not g % 2]
    if not all(sum(docs_by_group.get(g, 0) for g in side) for side in (tox, clean)):
        return None
    total = lambda side: sum((F.col(f"n{g}") for g in side), F.lit(0))
    c = counts.select("h", total(tox).alias("t"), total(clean).alias("c")).filter("t + c > 0")
    n_t, n_c, vocabulary = c.agg(F.sum("t"), F.sum("c"), F.count("*")).first()
    if not n_t or not n_c:
        return None
    share = PRIOR_SHARE / (n_t + n_c)
    a = PRIOR + share * (F.col("t") + F.col("c"))
    a0 = PRIOR * vocabulary + PRIOR_SHARE
    odds = lambda y, n: F.log((F.col(y) + a) / (F.lit(float(n)) + a0 - F.col(y) - a))
    scored = (c.withColumn("d", odds("t", n_t) - odds("c", n_c))
              .withColumn("z", F.col("d") / F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a))))
    rows = (scored.filter(F.abs("z") >= Z_LEAST).orderBy(F.abs("z").desc(), "h")
            .limit(max_lexicon).select("h", "d", "c", "z").collect())
    h = np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64)
    d = np.array([r["d"] for r in rows], dtype=float)
    p = np.array([r["c"] + PRIOR for r in rows], dtype=float) / (n_c + a0)
    order = np.argsort(h)
    z = np.abs(np.array([r["z"] for r in rows], dtype=float))
    lex = Lexicon(h[order], np.clip(d, -4, 8)[order], z[order])
    s = lex.scores - lex.drift
    p = p[order]
    rest = max(1e-9, 1 - p.sum())
    total = lambda x: (p * np.exp(x * s)).sum() + rest * math.exp(-x * lex.drift)
    lo, hi = 1e-3, 1e-3
    while hi < 20 and total(hi) < 1:
        lo, hi = hi, hi * 1.5
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if total(mid) < 1 else (lo, mid)
    lex.lam = lo
    return lex


def _logistic(a: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic fit (Newton steps) of at most 2 * max_per_class rows."""
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-3 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hess, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_per_class: int = MAX_PER_CLASS,
        max_lexicon: int = MAX_LEXICON) -> Model:
    ship(docs.sparkSession)
    sample = training_sample(docs, labels, id_col, text_col, label_col, max_per_class)
    sample = cut_lineage(sample)
    # one row per feature with its counts in all groups: written once, read by every lexicon
    counts = cut_lineage(sample.mapInArrow(_feature_counts, "h bigint, g int, n bigint")
                         .groupBy("h").agg(*[F.sum(F.when(F.col("g") == g, F.col("n")).otherwise(0)).alias(f"n{g}")
                                             for g in range(2 * FOLDS)]))
    by_group = {r["g"]: r["count"] for r in sample.groupBy(
        (F.col("fold") * 2 + F.col("toxic")).alias("g")).count().collect()}
    whole = _lexicon(counts, list(range(2 * FOLDS)), by_group, max_lexicon)
    if whole is None:
        return Model()
    # each fold is scored by the lexicon of the other folds
    parts = [_lexicon(counts, [g for g in range(2 * FOLDS) if g // 2 != k], by_group, max_lexicon)
             or whole for k in range(FOLDS)]

    def by_fold(b, f):
        fold = np.asarray(b.column("fold"))
        for k in np.unique(fold).tolist():
            rows = b.filter(pa.array(fold == k))
            yield f(Tokens(rows.column("text")), parts[k], rows)

    def best_segments(batches):
        def one(t, lex, rows):
            s = t.scores(lex)
            top = [lex.lam * max((x[2] for x in maximal_segments(s[a:z])), default=0.0)
                   for a, z in zip(t.first[:-1].tolist(), t.first[1:].tolist())]
            return pa.record_batch([rows.column("toxic"), pa.array(top, pa.float64()),
                                    pa.array(np.diff(t.first).astype(np.int64))],
                                   names=["toxic", "top", "words"])
        for b in textnp.pieces(batches, "text"):
            yield from by_fold(b, one)

    ln = (sample.mapInArrow(best_segments, "toxic int, top double, words bigint")
          .filter((F.col("toxic") == 0) & (F.col("top") > 0) & (F.col("words") > 0))
          .agg(F.avg(F.col("top") - F.log("words"))).first()[0])
    log_k = (ln if ln is not None else 0.0) - GUMBEL_MEAN
    for lex in (whole, *parts):
        lex.log_k = log_k

    def evidence(batches):
        def one(t, lex, rows):
            best, total, _ = _evidence(lex, t.scores(lex), t.first)
            return pa.record_batch([rows.column("toxic"), pa.array(best), pa.array(total)],
                                   names=["toxic", "best", "total"])
        for b in textnp.pieces(batches, "text"):
            yield from by_fold(b, one)

    # two numbers a sampled row: 2 * max_per_class rows at most
    rows = sample.mapInArrow(evidence, "toxic int, best double, total double").toPandas()
    x = _features(rows["best"].to_numpy(float), rows["total"].to_numpy(float))
    return Model(whole, _logistic(x, rows["toxic"].to_numpy(float)))


def _char_spans(raw: np.ndarray, lo: int, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point positions, from a text's first byte, of byte spans."""
    chars = lambda a, b: int(np.count_nonzero((raw[a:b] & 0xC0) != 0x80))
    return [(chars(lo, a), chars(lo, b)) for a, b in pairs]


def probabilities(texts, model: Model) -> np.ndarray:
    """Score of each text of an Arrow column."""
    if model.lexicon is None:
        return np.zeros(len(texts))
    t = Tokens(texts)
    best, total, _ = _evidence(model.lexicon, t.scores(model.lexicon), t.first)
    return model.probability(best, total)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """id, score, passages (start, end in code points, score, e_value)."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()),
                               ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches):
        m = shared.value
        for b in textnp.pieces(batches, "text"):
            if m.lexicon is None:
                n = b.num_rows
                p, out = np.zeros(n), [[] for _ in range(n)]
            else:
                t = Tokens(b.column("text"))
                best, total, found = _evidence(m.lexicon, t.scores(m.lexicon), t.first)
                p, out = m.probability(best, total), []
                for r, segs in enumerate(found):
                    base = int(t.first[r])
                    byte = [(int(t.start[base + s]), int(t.end[base + e - 1])) for s, e, _, _ in segs]
                    out.append([{"start": a, "end": z, "score": v, "e_value": math.exp(-x)}
                                for (a, z), (_, _, v, x) in zip(
                                    _char_spans(t.raw, int(t.offs[r]), byte), segs)])
            yield pa.record_batch([b.column(0), pa.array(p), pa.array(out, span)],
                                  names=[id_col, "score", "passages"])

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, score double, "
             "passages array<struct<start:int,end:int,score:double,e_value:double>>")


def filter_clean(docs: DataFrame, model: Model, text_col: str = "text",
                 reject_at: float = 0.7) -> DataFrame:
    """``docs`` without the rows scored ``reject_at`` or more.

    Rows are judged where they are read: the batch is filtered in its task,
    so whole texts never move to meet their scores."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in textnp.pieces(batches, text_col):
            yield b.filter(pa.array(probabilities(b.column(text_col), shared.value) < reject_at))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows kept from training: CRC-32 of the id's text leaves 1 modulo 3 (never without id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
