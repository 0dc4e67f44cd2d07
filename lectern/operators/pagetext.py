"""Cleaning of paged documents: running heads and feet, front matter, service tail, wraps.

Pages of one document travel as one array, sorted by page; each document is cleaned in place by expressions over that array,
so the only shuffle is the one that gathers pages, and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import LEADER, last_quarter_start, let, looks_like_heading, rejoin_hyphens, squeeze_blank_lines

# Patterns of the page furniture and headings of the documents. Fixed values.
HEADER = r"^RFC \d+\s{2,}\S"
YEAR_AT_END = r"\d{4}\s*$"
BARE_YEAR = r"^\s*\d{4}\s*$"
FOOTER = r"Standards Track\s+\[Page\s*(\d+)\]\s*$"
FOOTER_OPEN = r"Standards Track\s+\[Page\s*$"
FOOTER_REST = r"^\s*(\d+)\]\s*$"
TITLE = r"^RFC \d+\s{2,}(.*?)\s{2,}[A-Za-z]+ \d{4}\s*$"
BODY_START = r"^\s*1\.?\s+([A-Z].*)$"
PAGE_NUMBER = r"^\s*\d{1,3}\s*$"
SERVICE = r"^\s*(?:\d+(?:\.\d+)*\.?\s+)?(Authors?' Addresses?|Full Copyright Statement|Intellectual Property|Acknowledg)"
REFERENCES = r"^\s*\d+(?:\.\d+)*\.?\s*(?:Normative\s+|Informative\s+)?References\b"

_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def page_lines(text: Column) -> Column:
    """A page's lines; what follows the last line end is a line only if there is something."""
    lines = F.split(F.coalesce(text, F.lit("")), _LINE_END, -1)
    return F.when(F.get(lines, F.size(lines) - 1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def without_furniture(lines: Column) -> Column:
    """struct<lines, printed>: the page's own lines, trimmed, and the printed page number; the last footer counts.

    Whether a line belongs to a head or foot can be told from the lines next to it: what a broken head or foot goes on with
    (a year, a number and a bracket) never begins one itself.
    """
    near = F.transform(lines, lambda x, i: F.struct(F.coalesce(F.get(lines, i - 1), F.lit("")).alias("before"), x.alias("line"), F.coalesce(F.get(lines, i + 1), F.lit("")).alias("after")))

    def is_furniture(r: Column) -> Column:
        line, before = r["line"], r["before"]
        broken_foot = before.rlike(FOOTER_OPEN) & line.rlike(FOOTER_REST)
        broken_head = before.rlike(HEADER) & ~before.rlike(FOOTER) & ~before.rlike(YEAR_AT_END) & line.rlike(BARE_YEAR)
        return line.rlike(FOOTER) | (line.rlike(FOOTER_OPEN) & r["after"].rlike(FOOTER_REST)) | line.rlike(HEADER) | broken_foot | broken_head

    def number(r: Column) -> Column:
        whole = F.when(r["line"].rlike(FOOTER), F.regexp_extract(r["line"], FOOTER, 1))
        return whole.when(r["line"].rlike(FOOTER_OPEN) & r["after"].rlike(FOOTER_REST), F.regexp_extract(r["after"], FOOTER_REST, 1))

    own = F.transform(F.filter(near, lambda r: ~is_furniture(r)), lambda r: F.regexp_replace(r["line"], r"(?U)^\s+|\s+$", ""))
    numbers = F.filter(F.transform(near, number), lambda x: x.isNotNull())
    return F.struct(own.alias("lines"), F.get(numbers, F.size(numbers) - 1).cast("int").alias("printed"))


def spots(pages: Column, fits) -> Column:
    """(p, k) of every line of pages (lines, ...) that ``fits(line, lines, k)``, in order."""
    on_page = lambda page, p: F.filter(F.transform(page["lines"], lambda x, k: F.when(fits(x, page["lines"], k), F.struct(p.alias("p"), k.alias("k")))), lambda s: s.isNotNull())
    return F.flatten(F.transform(pages, on_page))


def body_start(pages: Column) -> Column:
    """Where the first section begins: the least spot of its heading that is no entry of a table of contents.

    Such an entry is followed on its page by a page number or a line with leaders.
    """

    def fits(line: Column, lines: Column, k: Column) -> Column:
        below = F.filter(F.slice(lines, k + 2, F.size(lines)), lambda x: x != "")
        follower = F.coalesce(F.get(below, F.lit(0)), F.lit(""))
        return line.rlike(BODY_START) & looks_like_heading(line, 80) & ~follower.rlike(PAGE_NUMBER) & ~follower.rlike(LEADER)

    return F.array_min(spots(pages, fits))


def headings(pages: Column, pattern: str, longest: int, start: Column) -> Column:
    """Spots of headings of a kind, from ``start`` on."""
    return F.filter(spots(pages, lambda x, *_: x.rlike(pattern) & looks_like_heading(x, longest)), lambda s: s >= start)


def tail_start(service: Column, last_reference: Column, n_pages: Column) -> Column:
    """Where the service part begins: after the last References heading, else in the last quarter, else anywhere."""
    behind = F.array_min(F.filter(service, lambda s: s > last_reference))
    late = F.array_min(F.filter(service, lambda s: s["p"] >= last_quarter_start(n_pages)))
    return F.coalesce(behind, late, F.array_min(service))


PAGES = "array<struct<text:string,pdf:int,printed:int>>"


def gather_pages(pages: DataFrame, *keys: str) -> DataFrame:
    """(doc keys, pdf, printed, text) -> one row a document with ``pages`` sorted by pdf."""
    page = F.struct("pdf", "text", "printed")
    rows = pages.groupBy(*keys).agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return rows.withColumn("pages", F.transform("pages", lambda p: F.struct(p["text"].alias("text"), p["pdf"].cast("int").alias("pdf"), p["printed"].cast("int").alias("printed"))))


def cleaned(pages: Column) -> Column:
    """The cleaned pages of a document's body; those that are left blank go, and none are left without a body."""
    raw = F.transform(pages, lambda p: F.struct(p["pdf"].cast("int").alias("pdf"), let(page_lines(p["text"]), without_furniture).alias("own")))
    bare = F.transform(raw, lambda p: F.struct(p["pdf"].alias("pdf"), p["own"]["printed"].alias("printed"), p["own"]["lines"].alias("lines")))

    def within(bare: Column, start: Column, end: Column) -> Column:
        def body(page: Column, p: Column) -> Column:
            first = F.when(p == start["p"], start["k"]).otherwise(0)
            last = F.when(p == end["p"], end["k"]).otherwise(F.size(page["lines"]))
            own = F.when((p >= start["p"]) & (p <= end["p"]), F.array_join(F.slice(page["lines"], first + 1, F.greatest(last - first, F.lit(0))), "\n"))
            return F.struct(squeeze_blank_lines(rejoin_hyphens(own)).alias("text"), page["pdf"].alias("pdf"), page["printed"].alias("printed"))

        return F.filter(F.transform(bare, body), lambda p: p["text"] != "")

    def with_start(bare: Column, start: Column) -> Column:
        named = F.struct(headings(bare, SERVICE, 60, start).alias("service"), F.array_max(headings(bare, REFERENCES, 80, start)).alias("last"))
        behind = F.struct(F.size(bare).alias("p"), F.lit(0).alias("k"))
        return let(named, lambda h: let(F.coalesce(tail_start(h["service"], h["last"], F.size(bare)), behind), lambda end: within(bare, start, end)))

    found = let(bare, lambda bare: let(body_start(bare), lambda start: with_start(bare, start)))
    return F.coalesce(found, F.array()).cast(PAGES)


def clean_pages(docs: DataFrame) -> DataFrame:
    """Replaces ``pages`` by the cleaned pages of the body."""
    return docs.withColumn("pages", cleaned(F.col("pages")))


def document_titles(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, title): the title named most often in running heads, the first seen among equals."""
    lines = pages.select(*keys, "pdf", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    titles = lines.withColumn("title", F.regexp_extract("line", TITLE, 1)).where("title <> ''")
    return first_mode(titles, "title", F.struct("pdf", "at"), *keys)


def first_mode(rows: DataFrame, column: str, order: Column, *keys: str) -> DataFrame:
    """The most frequent value of ``column`` by key; of equals the one whose first occurrence comes first."""
    counts = rows.groupBy(*keys, column).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_n").desc(), "_first"))
    return counts.withColumn("_place", best).where("_place = 1").select(*keys, column)
