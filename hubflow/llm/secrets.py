"""Secret scan over an incremental ledger of content-addressed blobs.

Every historical version of every path is addressed by the SHA-256 of its
text. The ledger holds one row per (blob, rule version) already scanned,
with its findings. A run scans only the blobs that the ledger lacks under
the current rule version, appends them, and joins findings back to all
paths, so a copy, a rename or an unchanged version costs no scan.

Defined results: null and empty texts are one blob without findings; equal
rows share a blob and each get the result; spans of equal start go by kind in
the order of ``RULES``; an empty table gives an empty result; further columns
are ignored, and path columns may have any name (a path column named like a
result column stands beside it). Texts are read whole, in time linear in
their length.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.llm.ship import ship
from hubflow.session import ensure_checkpoint_dir

_ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
           r"([A-Za-z0-9+/_.=-]+)")
#: kind, pattern, group whose length counts, least length, text that must occur (lower case)
RULES = (
    ("assign", _ASSIGN, 2, 6, ("passw", "secret", "token", "apikey", "api_key")),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    ("hex", r"[0-9a-f]{24,}", 0, 24, ()),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, ("-----begin",)),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, ("eyj",)),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, ("gh",)),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, ("xox",)),
)
BASE_KINDS = 3
RULE_VERSION = "2"
_SPAN = "array<struct<start:int,k:int,end:int,kind:string>>"
LEDGER_SCHEMA = f"blob string, spans {_SPAN}, rule_version string"


_CHAIN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)++")


def jwt_spans(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the ``jwt`` pattern, in linear time: its three parts lie in one
    chain of dotted runs, and the first reaches to the end of its run."""
    for chain in _CHAIN.finditer(text):
        at, parts = chain.start(), chain.group().split(".")
        starts = [at]
        for p in parts[:-1]:
            starts.append(starts[-1] + len(p) + 1)
        i = 0
        while i + 2 < len(parts):
            o = parts[i].find("eyJ")
            if o >= 0 and len(parts[i]) - o >= 11 and len(parts[i + 1]) >= 8 and len(parts[i + 2]) >= 8:
                yield starts[i] + o, starts[i + 2] + len(parts[i + 2])
                i += 3
            else:
                i += 1


def scan_text(text: str, compiled) -> list[dict]:
    """All spans of one text by start, then kind."""
    low = text.lower()
    found = []
    for k, (kind, rx, group, least, must) in enumerate(compiled):
        if must and not any(m in low for m in must):
            continue
        if kind == "jwt":
            found += [(lo, k, hi, kind) for lo, hi in jwt_spans(text)]
            continue
        for m in rx.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, m.end(), kind))
    return [dict(zip(("start", "k", "end", "kind"), f)) for f in sorted(found)]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compiled = [(kind, re.compile(p, re.ASCII), g, n, must) for kind, p, g, n, must in RULES]
    kind_type = pa.list_(pa.struct([("start", pa.int32()), ("k", pa.int32()),
                                    ("end", pa.int32()), ("kind", pa.string())]))
    for b in batches:
        spans = [scan_text(t.as_py() or "", compiled) for t in b.column("text")]
        yield pa.record_batch([b.column("blob"), pa.array(spans, kind_type)], names=["blob", "spans"])


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the ledger at ``path``; empty where nothing was written yet."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def scan_history(history: DataFrame, ledger_path: str, path_cols: list[str],
                 text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings per row of ``history``: its path columns, ``blob``, ``spans``.

    Appends the newly scanned (blob, rule version) pairs to the ledger, one
    file set per run; a repeated run scans nothing. Blobs are made distinct
    by an aggregation that combines copies in the map task, so a blob with a
    third of all rows moves once per task.
    """
    spark = history.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    paths = [f"path{k}_" for k in range(len(path_cols))]      # path columns may have any name
    versions = history.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(path_cols, paths)],
                              F.sha2(text, 256).alias("blob"), text.alias("text"))
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    known = open_ledger(spark, ledger_path).filter(F.col("rule_version") == rule_version)
    unseen = blobs.join(known.select("blob"), "blob", "left_anti")
    (unseen.mapInArrow(_scan_batches, f"blob string, spans {_SPAN}")
     .withColumn("rule_version", F.lit(rule_version))
     .write.mode("append").parquet(ledger_path))
    seen = open_ledger(spark, ledger_path).filter(F.col("rule_version") == rule_version)
    # a run that was retried may have written a pair twice: findings of a pair are equal
    hits = (seen.filter(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans")))
    return (versions.select(*paths, "blob").join(hits, "blob", "left")
            .select(*[F.col(n).alias(c) for c, n in zip(path_cols, paths)], "blob",
                    F.coalesce("spans", F.array().cast(_SPAN)).alias("spans")))


def new_ledger_path(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/blob-ledger-{uuid.uuid4().hex}"


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest columns per document of ``scan_history``'s result."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["k"] < BASE_KINDS)
    return found.select(
        id_col, *[count(k).alias(f"n_{RULES[k][0]}") for k in range(BASE_KINDS)],
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
