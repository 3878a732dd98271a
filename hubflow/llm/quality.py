"""Quality classifier from weak labels.

1. Heuristic labellers read the whole text and vote good (1), bad (0) or
   abstain (-1): symbols, capitals, digits, repeated neighbouring words,
   vocabulary, word length, function words, line endings, repeated lines.
2. The votes form one of at most 3^9 patterns. Spark counts the patterns of
   all documents; expectation-maximisation on these counts estimates each
   labeller's accuracies and the share of good documents, and gives every
   pattern its posterior.
3. Posteriors of at most ``max_train`` documents (smallest MD5 of the id) train
   a hashed linear scorer on words, word shapes and binned text statistics:
   logistic loss against the soft label, stochastic steps in TASKS tasks whose
   weights are averaged after each of ROUNDS rounds.
4. The scorer scores every document.

Defined results: null and empty texts abstain everywhere but count as bad in
vocabulary, so they score like the emptiest texts; ties need no rule, as
equal texts have equal features; repeated rows get equal scores; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.llm import textnp
from hubflow.llm.sample import one_text, smallest
from hubflow.llm.ship import ship
from hubflow.session import cut_lineage

MAX_TRAIN = 20_000
BUCKETS = 1 << 16
TASKS = 8
ROUNDS = 3
EPOCHS = 3
RATE = 0.3
MIN_WORDS = 5

# Frequent function words of the corpus languages
FUNCTION_WORDS = ("the of and to a in is that for it was on with as be at by this from are "
                  "le la les de des et en un une du que est pour dans qui sur par au "
                  "der die das und ist von zu mit den ein eine nicht sich auf für im "
                  "el los las y que con su se por una del es no lo").split()

LABELLERS = ("symbols", "capitals", "digits", "neighbours", "vocabulary", "word_length",
             "function_words", "line_ends", "repeated_lines")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _class(b"#$%&*|{}<>~^=+@\\_!")
_UPPER = _class(bytes(range(65, 91)))
_LETTER = _class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_DIGIT = _class(b"0123456789")
_END = _class(b".!?:;\"')")
# shape alphabet: lower, upper, digit, other ASCII, non-ASCII
_SHAPE = np.full(256, 3, np.uint64)
_SHAPE[97:123] = 0
_SHAPE[65:91] = 1
_SHAPE[48:58] = 2
_SHAPE[128:] = 4


def _hash_of(words: list[str]) -> np.ndarray:
    h, _ = textnp.words(*textnp.text_buffers(pa.array(words, pa.string())))
    return np.sort(h)


class Stats:
    """Statistics, votes and hashed features of a batch of texts."""

    def __init__(self, texts):
        self.offs, self.raw = textnp.text_buffers(texts)
        raw, offs = self.raw, self.offs
        self.h, self.first, self.start, self.end = textnp.words(offs, raw, spans=True)
        n = len(offs) - 1
        lo, hi = offs[:-1], offs[1:]

        def share(mask: np.ndarray, whole: np.ndarray) -> np.ndarray:
            out = np.zeros(n)
            for i in range(n):
                out[i] = np.count_nonzero(mask[raw[lo[i]:hi[i]]])
            return out / np.maximum(whole, 1)

        size = (hi - lo).astype(float)
        letters = share(_LETTER, np.ones(n))
        words = np.diff(self.first)
        same = np.concatenate((self.h[1:] == self.h[:-1], [False])) if len(self.h) else np.zeros(0, bool)
        inside = np.ones(len(self.h), bool)
        inside[self.first[1:][words > 0] - 1] = False
        fw = _hash_of(FUNCTION_WORDS)
        at = np.minimum(np.searchsorted(fw, self.h), len(fw) - 1)
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[self.first])
        distinct, ends, repeats = np.zeros(n), np.zeros(n), np.zeros(n)
        for i in range(n):
            a, b = int(self.first[i]), int(self.first[i + 1])
            distinct[i] = len(np.unique(self.h[a:b]))
            lines = [x.strip() for x in raw[lo[i]:hi[i]].tobytes().split(b"\n")]
            lines = [x for x in lines if x]
            if lines:
                ends[i] = sum(_END[x[-1]] for x in lines) / len(lines)
                repeats[i] = 1 - len(set(lines)) / len(lines)
        per = np.maximum(words, 1)
        self.words = words
        self.values = np.stack([
            share(_SYMBOL, size), share(_UPPER, letters), share(_DIGIT, size),
            total(same & inside) / per, distinct / np.sqrt(2.0 * per),
            total((self.end - self.start).astype(np.int64)) / per,
            total(fw[at] == self.h) / per, ends, repeats], axis=1)

    def votes(self) -> np.ndarray:
        """Rows of -1 (abstain), 0 (bad), 1 (good)."""
        v, words = self.values, self.words
        enough, some = words >= 20, words >= MIN_WORDS

        def vote(x, good, bad, when):
            return np.where(when & bad(x), 0, np.where(when & good(x), 1, -1))

        return np.stack([
            vote(v[:, 0], lambda x: x < 0.02, lambda x: x > 0.06, some),
            vote(v[:, 1], lambda x: x < 0.15, lambda x: x > 0.5, some),
            vote(v[:, 2], lambda x: x < 0.05, lambda x: x > 0.2, some),
            vote(v[:, 3], lambda x: x < 0.03, lambda x: x > 0.15, enough),
            vote(v[:, 4], lambda x: x > 1.5, lambda x: x < 0.8, some | (words == 0)),
            vote(v[:, 5], lambda x: (x >= 3) & (x <= 9), lambda x: (x < 2) | (x > 14), some),
            vote(v[:, 6], lambda x: x > 0.1, lambda x: x < 0.04, enough),
            vote(v[:, 7], lambda x: x > 0.5, lambda x: x < 0.1, some),
            vote(v[:, 8], lambda x: x < 0.05, lambda x: x > 0.3, enough)], axis=1).astype(np.int8)

    def features(self) -> list[np.ndarray]:
        """Distinct hashed feature numbers per text."""
        at, place = textnp.distinct_words(self.h)
        shape = np.zeros(len(at), np.uint64)
        top = max(len(self.raw) - 1, 0)
        last = np.full(len(at), 9, np.uint64)
        for k in range(24):            # runs of one class count once
            live = self.start[at] + k < self.end[at]
            c = _SHAPE[self.raw[np.minimum(self.start[at] + k, top)]] if len(at) else last
            new = live & (c != last)
            shape = np.where(new, shape * np.uint64(7) + c + np.uint64(1), shape)
            last = np.where(live, c, last)
        mask = np.uint64(BUCKETS - 1)
        word_f = (self.h[at] & mask).astype(np.int64)
        shape_f = (textnp.mix(shape + np.uint64(1 << 40)) & mask).astype(np.int64)
        bins = np.minimum(np.floor(np.sqrt(np.abs(self.values)) * 12), 200).astype(np.uint64)
        out = []
        for i, (a, b) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist())):
            w = np.unique(place[a:b])
            stat = textnp.mix(bins[i] + np.arange(1, bins.shape[1] + 1, dtype=np.uint64) * np.uint64(1 << 20))
            out.append(np.unique(np.concatenate([word_f[w], shape_f[w], (stat & mask).astype(np.int64)])))
        return out


def _pattern(votes: np.ndarray) -> list[str]:
    return ["".join("?01"[x + 1] for x in row) for row in votes.tolist()]


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in textnp.pieces(batches, "text"):
        yield pa.record_batch([b.column("id"), pa.array(_pattern(Stats(b.column("text")).votes()))],
                              names=["id", "votes"])


def label_model(patterns: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """Posterior probability of good per vote pattern, by EM: the class share
    and each labeller's chance of a right vote in either class. Abstaining
    says nothing about the class."""
    if not patterns:
        return {}
    names = sorted(patterns)
    v = np.array([["?01".index(c) for c in p] for p in names])
    n = np.array([patterns[p] for p in names], float)
    cast = np.stack([v == 1, v == 2], axis=2).astype(float)       # pattern, labeller, vote
    # start: share of good votes, one more vote of each kind added
    post = (cast[:, :, 1].sum(axis=1) + 1.0) / (cast.sum(axis=(1, 2)) + 2.0)
    for _ in range(rounds):
        rates = []
        for w, right in ((n * post, 1), (n * (1 - post), 0)):
            c = np.einsum("p,plk->lk", w, cast) + 0.5
            c[:, right] += 0.5                                    # labellers beat chance a priori
            rates.append(np.log(c / c.sum(axis=1, keepdims=True)))
        share = (n @ post + 1.0) / (n.sum() + 2.0)
        good = np.log(share) + np.einsum("plk,lk->p", cast, rates[0])
        bad = np.log1p(-share) + np.einsum("plk,lk->p", cast, rates[1])
        now = 1 / (1 + np.exp(np.clip(bad - good, -60, 60)))
        if np.abs(now - post).max() < 1e-9:
            break
        post = now
    return dict(zip(names, post.tolist()))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(sample: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bias last) from rows (id, part, posterior, features)."""
    weights = np.zeros(BUCKETS + 1)
    for r in range(rounds):
        start = weights

        def steps(batches, start=start, r=r):
            rows = [x for b in batches for x in zip(
                b.column("posterior").to_pylist(), b.column("features").to_pylist())]
            w, g2 = start.copy(), np.full(len(start), 1e-2)
            rng = np.random.default_rng(r)
            for _ in range(EPOCHS):
                for k in rng.permutation(len(rows)).tolist():
                    p, f = rows[k]
                    f = np.array([*f, BUCKETS])
                    scale = 1 / np.sqrt(len(f))
                    g = (_sigmoid(w[f].sum() * scale) - p) * scale
                    g2[f] += g * g
                    w[f] -= RATE * g / np.sqrt(g2[f])
            yield pa.record_batch([pa.array([len(rows)], pa.int64()),
                                   pa.array([w.astype(np.float32).tobytes()], pa.binary())],
                                  names=["n", "w"])

        # TASKS rows of a fixed size
        got = (sample.repartition(TASKS, "part").sortWithinPartitions("part", "id")
               .mapInArrow(steps, "n bigint, w binary").filter("n > 0").collect())
        if not got:
            break
        total = sum(x["n"] for x in got)
        weights = sum(np.frombuffer(x["w"], np.float32).astype(float) * (x["n"] / total)
                      for x in sorted(got, key=lambda x: (x["n"], bytes(x["w"]))))
    return weights


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  max_train: int = MAX_TRAIN) -> DataFrame:
    """id, votes, posterior (of the vote pattern), quality (the scorer's), keep."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    voted = cut_lineage(rows.mapInArrow(_voted, f"id {kind}, votes string"))
    patterns = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    posterior = label_model(patterns)
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(sorted(posterior.items()), "votes string, posterior double"))
    # one row per id: of rows that repeat it, the one that `one_text` takes
    ids = voted.filter("id is not null").select("id").distinct().withColumn("m", F.md5(F.col("id").cast("string")))
    picked = smallest(ids, "m", max_train, "id").select(
        "id", F.conv(F.substring("m", 32, 1), 16, 10).cast("int").alias("part"))
    taken = cut_lineage(rows.join(F.broadcast(picked), "id")        # max_train rows at most
                        .groupBy("id", "part").agg(one_text("text").alias("text")))

    def featured(batches):
        for b in textnp.pieces(batches, "text"):
            s = Stats(b.column("text"))
            yield pa.record_batch([b.column("id"), b.column("part"), pa.array(_pattern(s.votes())),
                                   pa.array(s.features(), pa.list_(pa.int64()))],
                                  names=["id", "part", "votes", "features"])

    sample = cut_lineage(taken.mapInArrow(featured, f"id {kind}, part int, votes string, features array<bigint>")
                         .join(table, "votes").select("id", "part", "posterior", "features"))
    shared = spark.sparkContext.broadcast(train(sample))

    def scored(batches):
        w = shared.value
        for b in textnp.pieces(batches, "text"):
            s = Stats(b.column("text"))
            f = s.features()
            x = np.array([w[np.append(k, BUCKETS)].sum() / np.sqrt(len(k) + 1) for k in f])
            yield pa.record_batch([b.column("id"), pa.array(_pattern(s.votes())), pa.array(_sigmoid(x))],
                                  names=["id", "votes", "quality"])

    return (rows.mapInArrow(scored, f"id {kind}, votes string, quality double")
            .join(table, "votes", "left")
            .select(F.col("id").alias(id_col), "votes", "posterior", "quality",
                    (F.col("quality") >= 0.5).alias("keep")))
