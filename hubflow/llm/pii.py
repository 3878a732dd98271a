"""Personal data: patterns propose spans, checksums confirm, context words score.

All work stays in one Spark projection per document: no shuffle, no Python.
For every kind the pattern's matches (``regexp_extract_all``) and the gaps
between them (``split`` by the same pattern) tile the text, so a match's
start is the summed length of what precedes it, in code points. Sums are kept
per block of matches and context is taken from the neighbouring tiles, so a
megabyte with tens of thousands of matches stays cheap.

The patterns below start only where the plain ones could (a run's first
character, or right after the previous match, ``\\G``) and use possessive
loops, which changes no match but keeps the search linear and free of
recursion on very long runs.

Defined results: null and empty texts have no spans; repeated rows each get
their own result; spans of equal start go by kind in the order of ``KINDS``;
an empty table gives an empty result; further columns of the input are
ignored. Texts are read whole; the work is near linear in their length.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.llm.exprs import let


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Luhn check sum of a string of digits is a multiple of ten."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def mod97_ok(code: Column) -> Column:
    """ISO 7064 mod-97-10: country and check digits moved to the end, letters
    read as 10 to 35, remainder 1."""
    turned = F.concat(F.substring(code, 5, 1 << 20), F.substring(code, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        a = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(a < 58, (acc * 10 + a - 48) % 97).otherwise((acc * 100 + a - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: cheap necessary condition on the text
    may: Callable[[Column], Column]
    #: checksum or range validator on the matched string
    valid: Callable[[Column], Column]
    score: float
    context: str
    #: characters that a match has at least
    least: int


KINDS = (
    Kind("email",
         r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), 0.8, "mail|contact|write|reply", 5),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
         lambda m: m.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), 0.5, "ip|host|server|address|login", 7),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++",
         lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
         lambda m: F.length(_digits(m)).between(14, 19) & luhn_ok(_digits(m)), 0.7,
         "card|visa|credit|payment|account", 2),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda t: F.contains(t, F.lit("+")),
         lambda m: F.length(_digits(m)).between(10, 15), 0.6, "phone|tel|call|mobile|fax", 3),
    Kind("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
         lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"),
         mod97_ok, 0.9, "iban|bank|account|transfer", 15),
)
BASE_KINDS = 4


BLOCK = 128                          # matches whose lengths are summed as one


def _prefix_sums(xs: Column) -> Column:
    """Sum of ``xs`` before every block of BLOCK entries."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")),
                         lambda j: total(F.slice(xs, j * BLOCK + 1, F.lit(BLOCK))))
    return let(blocks, lambda b: F.transform(F.sequence(F.lit(0), F.size(b) - 1),
                                             lambda j: total(F.slice(b, F.lit(1), j))))


def _spans(k: int, kind: Kind, window: int, bonus: float) -> Column:
    m, g = F.col(f"_m{k}"), F.col(f"_g{k}")
    keep = F.filter(F.sequence(F.lit(1), F.size(m)), lambda i: kind.valid(F.element_at(m, i)))

    def span(i: Column, lens: Column, before: Column) -> Column:
        block = F.floor((i - 1) / BLOCK).cast("int")
        start = (F.element_at(before, block + 1) + F.length(F.element_at(g, i)) + F.aggregate(
            F.slice(lens, block * BLOCK + 1, (i - 1) % BLOCK), F.lit(0), lambda a, v: a + v))
        end = start + F.length(F.element_at(m, i))
        # so many pairs of gap and match fill the window
        pairs = -(-window // kind.least)
        first = F.greatest(i - pairs, F.lit(1))
        last = F.least(i + 1 + pairs, F.size(g))
        left = F.array_join(F.transform(F.sequence(first, i), lambda j: F.concat(
            F.right(F.element_at(g, j), F.lit(window)),
            F.when(j < i, F.right(F.element_at(m, j), F.lit(window))).otherwise(""))), "")
        right = F.array_join(F.transform(F.sequence(i + 1, last), lambda j: F.concat(
            F.when(j > i + 1, F.left(F.element_at(m, j - 1), F.lit(window))).otherwise(""),
            F.left(F.element_at(g, j), F.lit(window)))), "")
        near = F.concat(F.right(left, F.lit(window)), F.element_at(m, i), F.left(right, F.lit(window)))
        score = F.lit(kind.score) + F.when(F.lower(near).rlike(kind.context), bonus).otherwise(0.0)
        return F.struct(start.alias("start"), F.lit(k).alias("k"), end.alias("end"),
                        F.lit(kind.name).alias("kind"), score.alias("score"))

    none = F.array().cast("array<struct<start:int,k:int,end:int,kind:string,score:double>>")
    lens = F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda a, b: F.length(a) + F.length(b))
    found = let(lens, lambda xs: let(_prefix_sums(xs), lambda before: F.transform(
        keep, lambda i: span(i, xs, before))))
    return F.when(F.size(m) > 0, found).otherwise(none)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             window: int = 40, bonus: float = 0.2) -> DataFrame:
    """``id_col`` and ``spans``: array of (start, k, end, kind, score) by start.

    ``start`` is zero-based, ``end`` exclusive, both in code points. ``score``
    is the kind's own plus ``bonus`` where one of its context words stands
    within ``window`` characters of the span.
    """
    out = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    t = F.col("_t")
    for k, kind in enumerate(KINDS):
        out = (out.withColumn(f"_has{k}", kind.may(t))
               .withColumn(f"_m{k}", F.when(F.col(f"_has{k}"),
                                            F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0))))
               .withColumn(f"_g{k}", F.when(F.col(f"_has{k}"), F.split(t, kind.pattern, -1))))
    spans = F.concat(*[_spans(k, kind, window, bonus) for k, kind in enumerate(KINDS)])
    return out.select(id_col, F.array_sort(spans).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest columns per document of ``find_pii``'s result."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["k"] < BASE_KINDS)
    return found.select(
        id_col, *[count(k).alias(f"n_{KINDS[k].name}") for k in range(BASE_KINDS)],
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
