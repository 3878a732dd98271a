"""Benchmark decontamination: short test items found inside long documents.

An item's set is its distinct five-word shingles (lower-cased words between
ASCII white space; with fewer words the whole sequence is its one shingle).
A document is contaminated by an item when it contains at least
``threshold`` of the item's shingles.

Items are partitioned by size into classes [2^c, 2^(c+1)). Within a class of
greatest size u, every item is represented by its MinHash bottom-k sketch:
the k = floor((1 - threshold) * u) + 1 smallest shingle hashes. A document
that contains enough of an item misses at most floor((1 - threshold) * size)
of its shingles, fewer than k, so it holds at least one sketch hash: the
candidate search loses nothing, however long the document is. Candidates are
then verified by exact containment on the shingles' words.

Only built-in expressions run. Documents are split and exploded inside one
generated stage that ends in the lookup of the sketch, so no shingle of a
document without a sketch hash is ever shuffled while the sketch is small
enough to broadcast (its bytes are counted); beyond that the lookup is a
shuffled join on the hash. The ids of documents found are broadcast under the
same bound, so that texts stay where they are read.

Defined results: null or empty texts and items match nothing; a one- to
four-word item matches documents that consist of just those words; rows of
one id are one document, their shingles taken together; rows without id match
nothing and are never dropped; repeated rows give one row per distinct
(document id, item id); an empty table gives an empty result; further columns
are ignored. Texts are read whole, in time linear in their length.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.session import cut_lineage

THRESHOLD = 0.75
WORDS = 5
#: what a broadcast may hold, counted before it is made, and a row's own share
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 24
_WHITE = " \t\n\x0b\x0c\r"


def word_array(text: Column) -> Column:
    return F.split(F.btrim(F.lower(text), F.lit(_WHITE)), r"[\x20\x09-\x0D]+", -1)


def shingles(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, w, i): hash of the shingle at word i of the words w."""
    words = (rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"))
             .filter(F.btrim(F.coalesce(F.col("_t"), F.lit("")), F.lit(_WHITE)) != "")
             .select("id", word_array(F.col("_t")).alias("w")))
    at = words.select("id", "w", F.explode(
        F.sequence(F.lit(0), F.greatest(F.size("w") - WORDS, F.lit(0)))).alias("i"))
    w, i = F.col("w"), F.col("i")
    full = F.xxhash64(*[w[i + k] for k in range(WORDS)])
    return at.select("id", F.when(F.size(w) >= WORDS, full).otherwise(
        F.xxhash64(F.lit("short"), F.array_join(w, " "))).alias("h"), "w", "i")


def _spelled(s: DataFrame) -> DataFrame:
    """The shingle's words behind each hash."""
    return s.withColumn("words", F.array_join(F.slice("w", F.col("i") + 1, F.lit(WORDS)), " "))


def bounded(table: DataFrame, texts: tuple[str, ...] = ()) -> DataFrame:
    """``table`` marked for broadcast if its rows, with the bytes of its
    ``texts`` columns, are within the bound."""
    size = sum((F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in texts), F.lit(ROW_BYTES))
    total = table.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(table) if total <= BROADCAST_BYTES else table


def item_sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item, n, h, sketch): every distinct shingle of every item; ``sketch``
    marks the smallest hashes that its size class searches by."""
    miss = 1 - Fraction(str(threshold))
    sets = (items.groupBy(F.col("id").alias("item"))
            .agg(F.array_sort(F.collect_set("h")).alias("hs"))
            .withColumn("n", F.size("hs"))
            .withColumn("upper", F.expr("shiftleft(1L, length(bin(n))) - 1L")))
    # exact integer arithmetic: floor(miss * upper) + 1
    k = F.expr(f"(upper * {miss.numerator}L) div {miss.denominator}L + 1")
    return (sets.select("item", F.col("n").cast("long").alias("n"), k.alias("k"),
                        F.posexplode("hs").alias("pos", "h"))
            .select("item", "n", "h", (F.col("pos") < F.col("k")).alias("sketch")))


def contaminated(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id",
                 item_col: str = "item_id", text_col: str = "text",
                 threshold: float = THRESHOLD) -> DataFrame:
    """(doc, item, n_shared, n_item, containment) of every pair at or above
    ``threshold``; id columns keep their names."""
    item_shingles = cut_lineage(_spelled(shingles(items, item_col, text_col))
                                .select("id", "h", "words").distinct())
    table = cut_lineage(item_sketches(item_shingles, threshold))
    sketch = bounded(table.filter("sketch").select("h", "item"))
    # candidates: (document, item) pairs that share a sketch hash
    found = shingles(docs, doc_col, text_col).select("id", "h").join(sketch, "h")
    pairs = cut_lineage(found.select("id", "item").distinct())
    sizes = table.select("item", "n").distinct()
    wanted = (item_shingles.withColumnRenamed("id", "item").join(sizes, "item"))
    ids = cut_lineage(pairs.select(F.col("id").alias(doc_col)).distinct())
    again = docs.select(doc_col, text_col).join(bounded(ids, (doc_col,)), doc_col, "left_semi")
    wanted = bounded(wanted.withColumnRenamed("words", "item_words"), ("item_words",))
    hits = _spelled(shingles(again, doc_col, text_col)).select("id", "h", "words").join(wanted, "h")
    shared = (hits.filter(F.col("words") == F.col("item_words"))
              .select("id", "item", "n", "words").distinct()
              .groupBy("id", "item", "n").agg(F.count("*").alias("n_shared")))
    return (shared.join(pairs, ["id", "item"], "left_semi")
            .filter(F.col("n_shared") >= F.lit(threshold) * F.col("n"))
            .select(F.col("id").alias(doc_col), F.col("item").alias(item_col), "n_shared",
                    F.col("n").alias("n_item"), (F.col("n_shared") / F.col("n")).alias("containment")))


def decontaminate(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", **kw) -> DataFrame:
    """``docs`` without the contaminated ones."""
    bad = cut_lineage(contaminated(docs, items, doc_col, **kw).select(doc_col).distinct())
    return docs.join(bounded(bad, (doc_col,)), doc_col, "left_anti")
