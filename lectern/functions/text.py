"""Scalar text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, spelled out because engines differ in what ``\s`` matches.
SPACE = r" \t\n\r\f\x0b"
#: Dotted leaders of tables of contents.
LEADER = r"\.{3,}|(?:\.\s){3,}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: an expression that stands in a lambda is made anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text; everything else separates."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def squeezed(text: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.btrim(F.regexp_replace(text, f"[{SPACE}]+", " "), F.lit(" "))


def plain_words(text: Column) -> Column:
    """Lower case, punctuation read as space, white space collapsed."""
    return squeezed(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "))


def rejoin_hyphens(text: Column) -> Column:
    """A line that ends in a letter or digit and a hyphen takes the next line if that begins with a letter of either case."""
    return F.regexp_replace(text, r"(?U)(?<=\p{Alnum}-)\n[^\S\n]*(?=[\p{Lu}\p{Ll}])", "")


def squeeze_blank_lines(text: Column) -> Column:
    """One blank line for a run of them, none at either end."""
    inner = F.regexp_replace(text, r"(?U)\n(?:[^\S\n]*\n)+", "\n\n")
    return F.regexp_replace(inner, r"(?U)\A(?:[^\S\n]*\n)+|(?:\n[^\S\n]*)+\z|\A[^\S\n]+\z", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(f"[^{SPACE}]"), F.lit(False))


def looks_like_heading(line: Column, longest: int) -> Column:
    body = F.btrim(line, F.lit(" \t\r\n\f\x0b"))
    return (body != "") & (F.length(body) <= longest) & ~body.rlike(LEADER)


def is_meaningful(line: Column, least: int = 40) -> Column:
    return F.length(F.btrim(line, F.lit(" \t\r\n\f\x0b"))) >= least


def rfc_from_path(path: Column) -> Column:
    """The number in a file name such as ``RFC 3261.pdf``; an error if there is none."""
    number = F.regexp_extract(path, r"(?i)RFC(?:\s|%20)*(\d+)\.pdf$", 1)
    return F.when(number != "", number.cast("int")).otherwise(F.raise_error(F.concat(F.lit("cannot parse RFC number from "), path)).cast("int"))


def cache_key(model: Column | str, text: Column) -> Column:
    model = F.lit(model) if isinstance(model, str) else model
    return F.sha2(F.concat(model, F.char(F.lit(0)), text).cast("binary"), 256)


def passage(text: Column) -> Column:
    return F.concat(F.lit("passage: "), text)


def query(text: Column) -> Column:
    return F.concat(F.lit("query: "), text)


def context_prefix(rfc: Column, title: Column, section_id: Column, section_title: Column) -> Column:
    name = F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("RFC "), rfc.cast("string")))
    return F.concat(F.lit("RFC "), rfc.cast("string"), F.lit(" — "), name, F.lit(" · §"), section_id, F.lit(" "), section_title)


def last_quarter_start(n: Column) -> Column:
    return n - F.floor(n / 4).cast("int")


def is_amount(x: Column) -> Column:
    """Finite and not negative."""
    return F.coalesce(~F.isnan(x) & (x >= 0) & (x < float("inf")), F.lit(False))


def cost(prompt_tokens: Column, completion_tokens: Column, prompt_price: Column, completion_price: Column) -> Column:
    """Unknown prices count as zero."""
    return prompt_tokens * F.coalesce(prompt_price, F.lit(0.0)) + completion_tokens * F.coalesce(completion_price, F.lit(0.0))


def format_source(rfc: Column, section: Column, page: Column) -> Column:
    """``RFC n §s p.k`` with the parts that are there."""
    return F.concat_ws(" ", F.concat(F.lit("RFC "), rfc.cast("string")), F.concat(F.lit("§"), F.nullif(section, F.lit(""))), F.concat(F.lit("p."), page.cast("string")))


def format_hit(position: Column, rfc: Column, section_path: Column, page: Column, text: Column) -> Column:
    """A numbered context block: head line with the section, else the page, then the text."""
    place = F.coalesce(F.concat(F.lit(" · §"), F.nullif(section_path, F.lit(""))), F.concat(F.lit(" · стр. "), page.cast("string")), F.lit(""))
    return F.concat(F.lit("["), position.cast("string"), F.lit("] RFC "), rfc.cast("string"), place, F.lit("\n"), text)


VERDICTS = ("correct", "wrong", "refused")


def parse_verdict(reply: Column) -> Column:
    """The verdict of a judge's reply: its JSON field if valid, else the first verdict named, in a fixed order, else wrong.

    As a substring counts, a plain "incorrect" reads as correct.
    """
    named = F.lower(F.get_json_object(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "$.verdict"))
    low = F.lower(F.coalesce(reply, F.lit("")))
    found = F.when(named.isin(*VERDICTS), named)
    for v in VERDICTS:
        found = found.when(low.contains(v), F.lit(v))
    return found.otherwise(F.lit("wrong"))


def tool_arguments(raw: Column) -> Column:
    """A JSON object of strings, or an empty map for anything else."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.when(F.btrim(raw, F.lit(" \n\t\r")).startswith("{"), F.from_json(raw, "map<string,string>")), empty)


def is_refusal(answer: Column, marker: str) -> Column:
    return F.coalesce(F.contains(answer, F.lit(marker)), F.lit(False))


def normal_refusal(answer: Column, marker: str) -> Column:
    """An answer that contains the marker becomes the marker alone."""
    return F.when(is_refusal(answer, marker), F.lit(marker)).otherwise(answer)


def citation_numbers(answer: Column, n_hits: Column) -> Column:
    """Distinct ``[n]`` within 1..n_hits in order of appearance; the first hit if there are none."""
    named = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    valid = F.array_distinct(F.filter(F.coalesce(named, F.array().cast("array<int>")), lambda x: (x >= 1) & (x <= n_hits)))
    return F.when(n_hits <= 0, F.array().cast("array<int>")).when(F.size(valid) > 0, valid).otherwise(F.array(F.lit(1)))


def strip_markdown(text: Column) -> Column:
    """Bold, code, headings, bullets and italics, in this order; bullets become ``•``."""
    for pattern, to in (
        (r"\*\*([^*]+)\*\*|__([^_]+)__", "$1$2"),
        (r"`([^`]*)`", "$1"),
        (r"(?m)^\s{0,3}#{1,6}\s+", ""),
        (r"(?m)^(\s*)\*\s+", "$1• "),
        (r"(?<![\w*])\*([^*\n]+)\*(?![\w*])", "$1"),
    ):
        text = F.regexp_replace(text, pattern, to)
    return text


def percent(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.2f%%", x * 100)).otherwise(F.lit("—"))


def dollars(x: Column) -> Column:
    """Four decimals, halves of the decimal number rounded up."""
    return F.when(x.isNotNull(), F.format_string("$%.4f", x)).otherwise(F.lit("—"))
