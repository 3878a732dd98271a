"""Site-relative boilerplate: lines found on too large a share of a host's pages.

A line counts once per page. Per host, the pages that contain it divided by
the host's pages is its ratio; lines with a ratio above ``max_ratio`` on at
least ``min_pages`` pages go from every page of that host.

Lines travel as 64-bit hashes of (host, line), never as text; counting
combines in the map task, so a hot host or a line on a third of all pages
moves one row per task. Pages move once, to meet the hashes they lose.

Defined results: texts are read whole, in time linear in their length; ties do
not arise, as lines are counted; an empty table gives an empty result; a null
host is a host of its own (''); null or empty texts keep an empty text; surrounding white space and blank lines are not part of
a line and go, unless ``verbatim`` keeps them; repeated rows count as pages of their own and keep their own
result; further columns pass through untouched, except that the
result's own ``n_lines`` and ``n_dropped`` replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.llm.exprs import let
from hubflow.session import cut_lineage

MAX_RATIO = 0.1
MIN_PAGES = 3

_MARKUP = (r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>")
#: the same with its common first character in front, which a search passes text by faster
_CLOSED = r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>|[^>]*>)"

#: characters that stand for a "<" which no longer opens one kind or any kind of markup
_NOT_HERE, _NOWHERE = "\ufdd0", "\ufdd1"
#: what opens a kind of markup, and its last end; tags come last
_ENDS = ((r"<(?=!--)", "<!--", r"(?s)^.*-->"), (r"(?i)<(?=script\b)", "<", r"(?is)^.*</script\s*+>"),
         (r"(?i)<(?=style\b)", "<", r"(?is)^.*</style\s*+>"))


def html_lines(html: Column) -> Column:
    """Visible text of a page, one line per run of text between tags.

    An opening that has no end behind it would be looked for up to the end of
    the page, once per opening. Where the last end of its kind has passed, it
    is hidden before the search and put back after it, so the work is linear.
    Pages whose openings all have an end, nearly all, are searched as they are."""
    def hidden(x: Column, opening: str, end: str, sign: str) -> Column:
        return let(F.regexp_extract(x, end, 0), lambda head: F.concat(
            head, F.regexp_replace(F.substring(x, F.length(head) + 1, F.length(x)), opening, sign)))

    def without(x: Column, opening: str, hint: str, end: str) -> Column:
        return let(x, lambda v: F.when(F.contains(v, F.lit(hint)), hidden(v, opening, end, _NOT_HERE)).otherwise(v))

    def closed(x: Column, lower: Column) -> Column:
        """Whether the last opening of every kind, and so each of them, has an end behind it."""
        def ended(v: Column, opening: str, end: str) -> Column:
            last = F.substring_index(v, opening, -1)
            return F.contains(last, F.lit(end)) if end.endswith(">") else last.rlike(end + r"\s*+>")
        kinds = [~F.contains(v, F.lit(o)) | ended(v, o, e) for v, o, e in (
            (x, "<!--", "-->"), (lower, "<script", "</script"), (lower, "<style", "</style"))]
        return ended(x, "<", ">") & kinds[0] & kinds[1] & kinds[2]

    def searched(x: Column) -> Column:
        for kind in _ENDS:
            x = without(x, *kind)
        x = let(x, lambda v: hidden(v, f"[<{_NOT_HERE}]", "(?s)^.*>", _NOWHERE))
        found = F.regexp_replace(x, _MARKUP.replace("|<[^>]*>", f"|[<{_NOT_HERE}][^>]*>"), "\n")
        return F.translate(found, _NOT_HERE + _NOWHERE, "<<")

    return let(F.coalesce(html, F.lit("")), lambda t: F.when(
        ~F.contains(t, F.lit("<")), t)
        .when(let(F.lower(t), lambda low: closed(t, low)), F.regexp_replace(t, _CLOSED, "\n"))
        .when(t.rlike(f"[{_NOT_HERE}{_NOWHERE}]"), F.regexp_replace(t, _MARKUP, "\n"))
        .otherwise(searched(t)))


def url_host(url: Column) -> Column:
    """Lower-case host of a URL without user and port; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")),
                                    r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def _raw_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def line_array(text: Column) -> Column:
    return F.filter(F.transform(_raw_lines(text), _trimmed), lambda x: x != "")


def drop_boilerplate(docs: DataFrame, id_col: str, host: Column, text: Column,
                     text_col: str = "text", max_ratio: float = MAX_RATIO,
                     min_pages: int = MIN_PAGES, groups: DataFrame | None = None,
                     keep_whole: bool = False, verbatim: bool = False) -> DataFrame:
    """``docs`` with ``text_col`` rewritten, plus ``n_lines`` and ``n_dropped``.

    ``id_col`` must tell documents apart; rows that repeat an id lose the
    same lines. ``groups`` (id, group), one row per id, makes the documents of
    a group (of near copies, say) one page of their host with the lines of all,
    for a line's count and the host's alike. With ``keep_whole`` a document
    that would lose every line keeps them all.
    With ``verbatim`` white space and blank lines stay: lines are compared
    trimmed, but a text goes on as it is except for the lines it loses.
    """
    mark = "b_"                       # own names start with what no input column does
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark = "_" + mark
    my = lambda name: F.col(mark + name)
    columns = docs.columns
    host = F.coalesce(host, F.lit(""))
    if not verbatim:
        # pages are parsed once: their lines are written, beside the columns that stay
        rest = [F.col(f"`{c}`") for c in columns if c not in (text_col, "n_lines", "n_dropped") or c == id_col]
        docs = cut_lineage(docs.select(*rest, host.alias(mark + "host"),
                                       line_array(text).alias(mark + "lines")))
        host, all_lines = my("host"), my("lines")
    else:
        all_lines = line_array(text)
    # the line hashes are written too, for counting and for the lost lines
    hashed = cut_lineage(docs.select(
        F.col(id_col).alias("id"), host.alias("host"),
        F.array_distinct(F.transform(all_lines, lambda x: F.xxhash64(host, x))).alias("hs")))
    lines = hashed.select("id", "host", F.explode("hs").alias("h"))
    if groups is None:
        counted, hosts = lines, hashed
    else:
        grouped = hashed.join(groups.toDF("id", "g"), "id")
        counted = grouped.select("host", "g", F.explode("hs").alias("h")).distinct()
        hosts = grouped.select("host", "g").distinct()
    pages = hosts.groupBy("host").agg(F.count("*").alias("pages"))
    common = (counted.groupBy("host", "h").agg(F.count("*").alias("n"))
              .filter(F.col("n") >= min_pages)
              .join(pages, "host")
              .filter(F.col("n") > max_ratio * F.col("pages")).select("h"))
    lost = (lines.join(common, "h").groupBy(F.col("id").alias(mark + "id"))
            .agg(F.collect_set("h").alias(mark + "lost")))
    joined = (docs.join(lost, F.col(id_col).eqNullSafe(my("id")), "left")
              .withColumn(mark + "lines", all_lines)
              .withColumn(mark + "kept", F.when(my("lost").isNull(), my("lines")).otherwise(
                  F.filter(my("lines"), lambda x: ~F.array_contains(my("lost"), F.xxhash64(host, x))))))
    if keep_whole:
        joined = joined.withColumn(mark + "kept", F.when(F.size(my("kept")) == 0, my("lines")).otherwise(my("kept")))
    mine = {"n_lines": F.size(my("lines")).cast("long"),
            "n_dropped": (F.size(my("lines")) - F.size(my("kept"))).cast("long")}
    rest = [F.col(f"`{c}`") for c in columns if c not in (text_col, *mine)]
    out = F.array_join(my("kept"), "\n")
    if verbatim:
        left = F.filter(_raw_lines(text), lambda x: (_trimmed(x) == "") |
                        ~F.array_contains(my("lost"), F.xxhash64(host, _trimmed(x))))
        out = F.when(mine["n_dropped"] == 0, F.coalesce(text, F.lit(""))).otherwise(F.array_join(left, "\n"))
    return joined.select(*rest, out.alias(text_col),
                         *[e.alias(n) for n, e in mine.items()])
