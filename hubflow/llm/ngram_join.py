"""N-gram Jaccard join by parity sketches.

A document's set S is its distinct five-word shingles (hashed to 64 bits).
Two sets are linked when |A & B| >= 3/4 |A | B|; then their symmetric
difference is at most (|A| + |B|) / 7 and the smaller size at least 3/4 of
the larger.

Sketches. XOR-ing hashed tokens is a parity sketch: tokens in both sets
cancel, so two sketches of b bits differ in at most |A ^ B| places, a lower
bound of the symmetric difference that holds without exception. Folding a
sketch in half (XOR of the halves) gives the sketch of half as many bits.

Pigeonhole per size band. In band k (2^k <= size < 2^(k+1)) the token space is
cut into about 3/4 * 2^k hash ranges, and every range's tokens are XOR-ed into
one 64-bit word of the sketch. The tokens in which a linked pair differs touch
at most (|A| + |B|) / 7 ranges, so others agree in all 64 bits. Documents meet
on (band, range, word) for the first PARTS ranges. Up to band 6 these are all
ranges and in bands above, a linked pair at the very threshold has no agreeing
range among the 56 with a chance below 1e-13 and a single one with a chance
below 1e-11. Sets under 16 tokens meet on every token. A document near its band's upper end also uses the next band.

From meetings to links, without all pairs of a group:
1. equal sets become one class (smallest id); only classes go on;
2. per bucket, every member meets one pivot, the member that shares most
   buckets with others (in a group of edited copies that is the text closest
   to all); distinct pairs whose whole-set sketches allow a link are verified
   on their texts;
3. in buckets that still hold several components, members of different
   components are compared sketch to sketch in blocks; large buckets are
   first split by a second agreeing range. Of what the sketches allow, each
   member's nearest pairs into every other component are verified; rounds
   with more pairs each follow until no allowed pair with ends still apart
   is left untried. No pair is dropped unless the bound excludes it or its
   ends are connected.

Texts move only for verification, and only those of candidate pairs: a bitmap
of fixed size over hashed ids sorts out the others where they are read (its
false hits are removed by the join that follows).

Defined results: null and empty texts have no shingle and stay alone; a text
of one to four words is one shingle; rows that repeat an id must repeat its
text and give equal rows; a row without id joins its class; further columns
are ignored; empty tables give empty results. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.llm import textnp
from hubflow.llm.graph import components
from hubflow.llm.ship import ship
from hubflow.session import cut_lineage, drop_tables

WORDS = 5
NUM, DEN = 3, 4                 # similarity of at least NUM / DEN
PARTS = 56
SMALL = 16                      # sets below this size meet on every token
MIN_BITS = 512
SPLIT_ABOVE = 1 << 26           # comparisons from which a second range splits a bucket
BLOCK_BYTES = 2 << 20           # sketches of a block in sketch-to-sketch comparison
DIFFER_BYTES = 4 << 20          # bytes of sketches compared at once
KEY_BYTES = 64 << 20            # bits by which a bucket knows its members' other buckets
STRIPE = 1 << 16                # comparisons made at once
TAKE = 256                      # pairs per member and component in the first round
BITMAP = 1 << 25                # bits of the candidate bitmap (4 MB)
U = np.uint64


def _linked(inter: int, union: int) -> bool:
    return DEN * inter >= NUM * union


def may_link(n1, n2, difference):
    """Sizes and a lower bound of the symmetric difference allow a link."""
    # inter = (n1 + n2 - d) / 2, union = (n1 + n2 + d) / 2
    return ((DEN * (n1 + n2 - difference) >= NUM * (n1 + n2 + difference))
            & (DEN * np.minimum(n1, n2) >= NUM * np.maximum(n1, n2)))


def band_of(n: int) -> int:
    return 0 if n < SMALL else n.bit_length() - 1


def _ranges(band: int) -> int:
    return max(PARTS, (3 << band) // 4)


def _band_keys(s: np.ndarray, band: int) -> np.ndarray:
    """One key per non-empty range of the sorted set ``s``."""
    if band == 0:
        return textnp.mix(s ^ U(0x5851F42D4C957F2D))
    parts = U(_ranges(band))
    top = min(len(s), int(np.searchsorted(s, U(min((PARTS << 64) // int(parts), (1 << 64) - 1)), "right")))
    part = ((s[:top] >> U(32)) * parts) >> U(32)
    top = int(np.searchsorted(part, U(PARTS)))
    if not top:
        return np.zeros(0, U)
    part = part[:top]
    at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    word = np.bitwise_xor.reduceat(s[:top], at)
    return textnp.mix(word + part[at] * U(0x9E6C63D0876A9A63) + U(band * 0xD6E8FEB86659FD93 % (1 << 64)))


def set_keys(s: np.ndarray) -> np.ndarray:
    n = len(s)
    if not n:
        return np.zeros(0, U)
    band = band_of(n)
    keys = _band_keys(s, band)
    above = SMALL if band == 0 else 2 << band
    if DEN * n >= NUM * above:         # a linked set may lie in the next band
        keys = np.concatenate([keys, _band_keys(s, band_of(above))])
    return keys


def parity_sketch(s: np.ndarray) -> bytes:
    # four to two bits for every token of both sides keep the bound sharp
    bits = max(MIN_BITS, 2 << len(s).bit_length())
    return np.packbits((np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1)
                       .astype(np.uint8), bitorder="little").tobytes()


def fold_sketch(x: np.ndarray, size: int) -> np.ndarray:
    """Rows of sketches folded to ``size`` bytes."""
    while x.shape[-1] > size:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in textnp.pieces(batches, "text"):
        h, first = textnp.words(*textnp.text_buffers(b.column("text")))
        sets = textnp.shingle_sets(h, first, WORDS)
        keys = [set_keys(s) for s in sets]
        offs = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.zeros(0, U)
        sums = [(int(s.sum(dtype=U)), int(textnp.mix(s).sum(dtype=U))) for s in sets]
        yield pa.record_batch([
            b.column("id"), pa.array([len(s) for s in sets], pa.int64()),
            pa.array(np.array([x for x, _ in sums], dtype=U).view(np.int64)),
            pa.array(np.array([x for _, x in sums], dtype=U).view(np.int64)),
            pa.array([parity_sketch(s) if len(s) else None for s in sets], pa.binary()),
            pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.view(np.int64)))],
            names=["id", "n", "s1", "s2", "sketch", "keys"])


def _sketch_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches allow a link, with the bound."""
    for b in batches:
        n1, n2 = np.asarray(b.column("n1")), np.asarray(b.column("n2"))
        ham = np.zeros(len(n1), np.int64)
        for i, (x, y) in enumerate(zip(b.column("k1").to_pylist(), b.column("k2").to_pylist())):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            size = min(len(x), len(y))
            ham[i] = int(np.bitwise_count(fold_sketch(x, size) ^ fold_sketch(y, size)).sum())
        keep = may_link(n1, n2, ham)
        yield pa.record_batch([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep)),
                               pa.array(ham[keep])], names=["a", "b", "ham"])


def allowed_pairs(pairs: DataFrame, feats: DataFrame) -> DataFrame:
    """(a, b, ham) of the pairs that sizes and sketches allow."""
    side = lambda p, q: feats.select(F.col("id").alias(p), F.col("n").alias(f"n{q}"),
                                     F.col("sketch").alias(f"k{q}"))
    return (pairs.join(side("a", 1), "a").join(side("b", 2), "b")
            .mapInArrow(_sketch_filter, "a bigint, b bigint, ham bigint"))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in textnp.pieces(batches, "text_a"):
        ids, at, place = np.unique(np.asarray(b.column("b")), return_index=True, return_inverse=True)
        right = textnp.shingle_sets(*textnp.words(*textnp.text_buffers(
            b.column("text_b").take(pa.array(at)))), WORDS)
        left = textnp.shingle_sets(*textnp.words(*textnp.text_buffers(b.column("text_a"))), WORDS)
        keep = np.zeros(len(left), bool)
        for i, x in enumerate(left):
            y = right[place[i]]
            if len(x) and len(y):
                inter = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = _linked(inter, len(x) + len(y) - inter)
        yield pa.record_batch([b.column("a").filter(pa.array(keep)),
                               b.column("b").filter(pa.array(keep))], names=["a", "b"])


def texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose id is in ``ids`` (one distinct column, id)."""
    spot = F.pmod(F.xxhash64("id"), F.lit(BITMAP))
    cells = (ids.select(spot.alias("x"))
             .groupBy(F.shiftright("x", 6).alias("at"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(x % 64 as int))")).alias("bits")).toArrow())
    bitmap = np.zeros(BITMAP // 64, np.int64)          # BITMAP / 64 rows at most
    bitmap[np.asarray(cells["at"].combine_chunks())] = np.asarray(cells["bits"].combine_chunks())
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def may_be_in(x: pd.Series) -> pd.Series:
        x = x.to_numpy()
        return pd.Series((shared.value[x >> 6] >> (x & 63)) & 1 == 1)

    return (texts.filter("id is not null").filter(may_be_in(spot))
            .join(ids, "id", "left_semi").dropDuplicates(["id"]))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) linked by exact comparison of their whole texts, as a
    written table."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = cut_lineage(texts_of(texts, ids))
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    out = cut_lineage(pairs.select("a", "b").join(one, "a").join(two, "b")
                      .select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a bigint, b bigint"))
    drop_tables(texts)
    return out


def _runs(batches: Iterator[pa.RecordBatch], cols: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that share ``cols``, from batches sorted by them."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        vals = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in cols], axis=1)
        cuts = np.flatnonzero((vals[1:] != vals[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            key = tuple(vals[lo].tolist())
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _differences(bits: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Differing bits of rows p and q, a bounded number of bytes at a time."""
    out = np.zeros(len(p), np.int64)
    step = max(1, DIFFER_BYTES // (8 * bits.shape[1]))
    for s in range(0, len(p), step):
        out[s:s + step] = np.bitwise_count(bits[p[s:s + step]] ^ bits[q[s:s + step]]).sum(axis=1)
    return out


def _smaller_keys(t: pa.Table, key: int) -> np.ndarray | None:
    """Per member of a bucket, the set of its buckets of smaller key that other
    members are in too, as rows of bits (64 a word). None where these would fill
    more than KEY_BYTES: then pairs are merely returned again."""
    lists = t["keys"].combine_chunks()
    flat = np.asarray(lists.flatten())
    who = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    low = flat < key
    names, place, n = np.unique(flat[low], return_inverse=True, return_counts=True)
    shared = n > 1
    column = np.cumsum(shared) - 1
    use = shared[place]
    words = -(-max(1, int(shared.sum())) // 64)
    if 8 * words * len(lists) > KEY_BYTES:
        return None
    bits = np.zeros((len(lists), words), U)
    c = column[place[use]]
    np.bitwise_or.at(bits, (who[low][use], c >> 6), U(1) << (c & 63).astype(U))
    return bits


def _met_before(bits: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Pairs that also meet in a bucket of smaller key, and are compared there."""
    out = np.zeros(len(p), bool)
    step = max(1, DIFFER_BYTES // (8 * bits.shape[1]))
    for s in range(0, len(p), step):
        out[s:s + step] = (bits[p[s:s + step]] & bits[q[s:s + step]]).any(axis=1)
    return out


def _cross_pairs(take: int):
    """Per member and other component, the ``take`` nearest allowed pairs
    inside each (bucket, block pair); ``more`` marks those cut short. A pair
    belongs to the smallest bucket that both its ends are in, and is left out of
    others. A group is at most two blocks of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["key", "i", "j"]):
            i, j = t["i"][0].as_py(), t["j"][0].as_py()
            blk, ids = t["blk"].to_numpy(), t["id"].to_numpy()
            n, comp, sk = t["n"].to_numpy(), t["comp"].to_numpy(), t["sketch"].to_pylist()
            size = min(len(x) for x in sk)
            bits = np.stack([fold_sketch(np.frombuffer(x, np.uint8), size) for x in sk]).view(U)
            met = _smaller_keys(t, t["key"][0].as_py())
            # the commonest component is only ever the other side of a pair
            names, place, sizes = np.unique(comp, return_inverse=True, return_counts=True)
            most = place == sizes.argmax()
            if len(names) == 1:
                continue
            found, rows = [], np.flatnonzero(~most)
            stripe = max(1, STRIPE // len(ids))
            for lo in range(0, len(rows), stripe):
                r = rows[lo:lo + stripe, None]
                apart = place[r] != place
                if i == j:
                    apart &= most | (ids[r] < ids)
                else:
                    apart &= np.where(blk[r] == i, blk == j, most & (blk == i))
                p, q = np.nonzero(apart & may_link(n[r], n, 0))
                p = rows[lo + p]
                ham = _differences(bits, p, q)
                ok = may_link(n[p], n[q], ham)
                if met is not None:
                    ok[ok] = ~_met_before(met, p[ok], q[ok])
                p, q, ham = p[ok], q[ok], ham[ok]
                by = np.lexsort((ids[q], ham, place[q], p))
                p, q = p[by], q[by]
                new = np.ones(len(p), bool)
                new[1:] = (p[1:] != p[:-1]) | (place[q[1:]] != place[q[:-1]])
                begin = np.flatnonzero(new)
                runs = np.diff(np.append(begin, len(p)))
                keep = np.arange(len(p)) - np.repeat(begin, runs) < take
                x, y = ids[p[keep]], ids[q[keep]]
                found.append((np.maximum(x, y), np.minimum(x, y), np.repeat(runs > take, runs)[keep]))
            if found:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*found)],
                                      names=["a", "b", "more"])
    return run


def _open_pairs(multi: DataFrame, comp: DataFrame, feats: DataFrame, take: int) -> DataFrame:
    """(a, b, more): nearest allowed pairs of one bucket and different
    components, as a written table."""
    members = cut_lineage(multi.join(comp, "id", "left").join(feats.select("id", "n"), "id")
                       .select("key", "id", F.coalesce("component", "id").alias("comp"), "n"))

    def mixed(r: DataFrame) -> DataFrame:
        """Buckets with several components: comparisons between them, and the
        blocks that their sketches fill."""
        c = r.groupBy("key", "comp").agg(F.count("*").alias("c"), F.max("n").alias("n"))
        size = F.greatest(F.lit(MIN_BITS), F.expr("shiftleft(2L, length(bin(max(n))))")) / 8
        return (c.groupBy("key").agg(F.sum("c").alias("rows"), F.sum(F.col("c") * F.col("c")).alias("own"),
                                     size.alias("size"))
                .withColumn("work", F.col("rows") * F.col("rows") - F.col("own"))
                .withColumn("blocks", F.ceil(F.col("rows") * F.col("size") / BLOCK_BYTES).cast("int"))
                .filter("work > 0").select("key", "work", "blocks"))

    rows = cut_lineage(members.join(mixed(members), "key"))
    drop_tables(members)
    written = rows
    small = rows.filter(F.col("work") <= SPLIT_ABOVE)
    hot = rows.filter(F.col("work") > SPLIT_ABOVE)
    # a large bucket splits by every second range that its members agree in; a
    # pair that also meets in a small bucket is compared there
    hot = hot.select("key", "id", "comp", "n")
    second = (hot.join(hot.select("id", F.col("key").alias("key2")), "id").filter("key < key2")
              .select(F.xxhash64("key", "key2").alias("key"), "id", "comp", "n"))
    rows = small.select("key", "id", "comp", "blocks").unionByName(
        second.join(mixed(second), "key").select("key", "id", "comp", "blocks"))
    # every bucket that an id is compared in: a pair is taken from the smallest shared one
    rows = cut_lineage(rows)
    every = rows.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    blocked = (rows.withColumn("blk", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
               .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .select("key", "id", "comp", "blk", F.least("blk", "o").alias("i"),
                       F.greatest("blk", "o").alias("j")))
    full = blocked.join(feats.select("id", "n", "sketch").join(every, "id"), "id")
    out = cut_lineage(full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
                      .mapInArrow(_cross_pairs(take), "a bigint, b bigint, more boolean")
                      .groupBy("a", "b").agg(F.max("more").alias("more")))
    drop_tables(written, rows)
    return out


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (the smallest
    id reachable by links), as a written table. Ids are integers. Tables of
    earlier steps are dropped as soon as nothing reads them."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    feats = cut_lineage(texts.mapInArrow(
        _features, "id bigint, n bigint, s1 bigint, s2 bigint, sketch binary, keys array<bigint>"))
    classes = cut_lineage(feats.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep")))
    reps = (feats.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
            .select("id", "n", "sketch", "keys").dropDuplicates(["id"]))
    keys = reps.select("id", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    multi = cut_lineage(keys.join(shared, "key"))
    # the pivot of a bucket: who shares most with others, then the smallest id
    weight = multi.groupBy("id").agg(F.sum("c").alias("w"))
    weighed = cut_lineage(multi.join(weight, "id"))
    pivots = weighed.groupBy("key").agg(F.max(F.struct("w", -F.col("id"))).alias("p"))
    star = (weighed.join(pivots, "key").select("id", (-F.col("p.col2")).alias("pivot"))
            .filter("id <> pivot")
            .select(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b")).distinct())
    small = feats.select("id", "n", "sketch").dropDuplicates(["id"])
    tried = cut_lineage(allowed_pairs(star, small).select("a", "b"))
    drop_tables(weighed)
    links = verify(tried, texts)
    comp = components(links)
    # then: what is still apart inside a bucket, nearest sketches first
    take = TAKE
    while True:
        near = _open_pairs(multi.select("key", "id"), comp, small, take)
        new = cut_lineage(near.select("a", "b").join(tried, ["a", "b"], "left_anti"))
        if not new.isEmpty():
            found = verify(new, texts)
            before = links, comp, tried
            links = cut_lineage(links.unionByName(found))
            comp = components(links)
            tried = cut_lineage(tried.unionByName(new))
            drop_tables(*before, found)
        again = not near.filter("more").isEmpty()
        drop_tables(near, new)
        if not again:
            break
        take *= 8
    drop_tables(multi, links, tried)
    of_class = (classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left")
                .select("n", "s1", "s2", F.coalesce("component", "rep").alias("c")))
    out = cut_lineage(feats.select("id", "n", "s1", "s2").join(of_class, ["n", "s1", "s2"], "left")
                      .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                              F.coalesce("c", "id").alias("component_id")))
    drop_tables(feats, classes, comp)
    return out
