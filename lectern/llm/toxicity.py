"""Toxicity by a weighted lexicon: one Aho-Corasick pass over folded text, exceptions, normalisation by length.

Folding lower-cases, drops invisible characters, replaces homoglyphs of Latin letters and accented Latin letters by the
plain letter, and reads digits and symbols that stand for letters (``1d1ot``, ``$cum``) as those letters when a letter
follows in the same word.  Those at the end of a word (``idio7``, ``a$$``, ``shi7!`` but for the mark) may stand for letters
or for themselves (``version 2``, ``cool!``), so such a text has two forms, and what either of them holds is found.  The
automaton holds whole words and word beginnings (``stem*``) with their weights, and exception phrases; a hit inside an
exception phrase does not count.  The sum of weights is divided by the root of the
length in words and mapped to a probability by a monotone calibration.

The lexicon is learned from labelled documents and nothing else: words and word beginnings that at least ``SUPPORT``
toxic documents share, weighted by their log odds against clean ones; a beginning is used only where it covers several
words.  A phrase that holds a term and is common in clean documents but not in toxic ones becomes an exception.  Counting
and choosing run over all labelled documents in Spark; the driver gets the chosen terms, and a lexicon of more than
``MOST_TERMS`` is an error, never cut.

Edge cases: null and empty texts have no hits and get the lowest score; texts are used whole, in time that grows with
their length; null labels and null ids teach nothing; several rows of one id count once each; without toxic labels the
lexicon is empty and every text has score 0; other columns pass through, and columns that clash with the new ones are
replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.runtime import arrow_batches, extend, spill

#: A term is a candidate if so many toxic documents have it.
SUPPORT = 4
PREFIXES = (4, 5, 6, 7, 8)
LEAST_LOG_ODDS = 2.5
#: Chosen terms and exceptions travel with every task.
MOST_TERMS = 1_000_000
EXCEPTION_SUPPORT = 5
#: Labels, two numbers a row, are broadcast up to this many rows; beyond it the texts are shuffled to them.
MOST_BROADCAST_LABELS = 500_000
BINS = 48

_DIGITS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"})
#: Letters of other scripts that look like the Latin letter. Fixed values.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ѵ": "v", "г": "r", "п": "n",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "η": "n", "ı": "i", "ɡ": "g", "ɑ": "a", "ℓ": "l",
}
_LEET = re.compile(r"[0134578@$!|]++")
_LETTER = re.compile(r"[^\W\d_]")
WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"\S+")


@lru_cache(maxsize=1)
def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = {cp: None for cp in (0xAD, 0x34F, 0x61C, 0xFEFF, *range(0x200B, 0x2010), *range(0x2060, 0x2065), *range(0x300, 0x370))}
    for cp in (*range(0xAA, 0x250), *range(0x1E00, 0x1F00), *range(0x2100, 0x2150), *range(0x24B6, 0x24EA), *range(0xFF21, 0xFF5B), *range(0x1D400, 0x1D7CC)):
        base = unicodedata.normalize("NFKD", chr(cp))[0].lower()
        if cp not in table and "a" <= base <= "z":
            table[cp] = base
    for k, v in _LOOKALIKES.items():
        table[ord(k)] = v
        table.setdefault(ord(k.upper()), v) if len(k.upper()) == 1 else None
    return table


def forms(text: str) -> tuple[str, ...]:
    """The folded text, and if digits or symbols end a word also the form that reads those as letters; of equal length."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_table())
    ends = False

    def inner(m: re.Match) -> str:
        """A run is read once, and as letters only if a letter follows it."""
        nonlocal ends
        if _LETTER.match(text, m.end()):
            return m[0].translate(_DIGITS)
        ends = ends or m.start() > 0 and text[m.start() - 1].isalpha() and m[0].strip("!|") != ""
        return m[0]

    def last(m: re.Match) -> str:
        if _LETTER.match(text, m.end()):
            return m[0].translate(_DIGITS)
        if not (m.start() and text[m.start() - 1].isalpha()):
            return m[0]
        run = m[0].rstrip("!|")  # at the very end these are marks
        return run.translate(_DIGITS) + m[0][len(run) :]

    folded = _LEET.sub(inner, text)
    return (folded, _LEET.sub(last, text)) if ends else (folded,)


def fold(text: str) -> str:
    return forms(text)[0]


@dataclass(frozen=True)
class Lexicon:
    """Weights of whole words and of word beginnings, exception phrases, and the calibration: bin edges and scores."""

    words: dict[str, float]
    stems: dict[str, float]
    exceptions: tuple[str, ...]
    edges: tuple[float, ...] = ()
    scores: tuple[float, ...] = ()


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for term, w in lexicon.stems.items():
            entries.setdefault(term, []).append(("stem", w))
        for term, w in lexicon.words.items():
            entries.setdefault(term, []).append(("word", w))
        for term in lexicon.exceptions:
            entries.setdefault(fold(term), []).append(("exception", 0.0))
        for term, kinds in entries.items():
            self.automaton.add_word(term, (len(term), kinds))
        if entries:
            self.automaton.make_automaton()
        self.empty = not entries

    def hits(self, *forms: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of each term in any form that counts: at word boundaries, the heaviest at each start, no exceptions."""
        if self.empty:
            return []
        found: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for folded in forms:
            for last, (size, kinds) in self.automaton.iter(folded):
                start, end = last - size + 1, last + 1
                if start and folded[start - 1].isalpha():
                    continue
                closed = end == len(folded) or not folded[end].isalpha()
                for kind, w in kinds:
                    if kind == "exception":
                        if closed:
                            spared.append((start, end))
                    elif (kind == "stem" or closed) and w > found.get(start, (0, 0.0))[1]:
                        found[start] = (end, w)
        spared.sort()
        out, k, reach = [], 0, 0  # reach: the farthest end of the exceptions that begin at or before the hit
        for s, (e, w) in sorted(found.items()):
            while k < len(spared) and spared[k][0] <= s:
                reach = max(reach, spared[k][1])
                k += 1
            if e > reach:
                out.append((s, e, w))
        return out


def density(matcher: Matcher, text: str) -> tuple[float, int]:
    """Sum of weights over the root of the length in words (20 at least), and the number of hits."""
    read = forms(text)
    hits = matcher.hits(*read)
    if not hits:
        return 0.0, 0
    return sum(w for _, _, w in hits) / math.sqrt(max(20, len(read[0].split()))), len(hits)


def _edges() -> np.ndarray:
    return np.concatenate([[0.0, 1e-9], np.geomspace(0.02, 20.0, BINS)])


def _terms(text: str) -> set[str]:
    """Words, and beginnings of words marked by a trailing star."""
    words = {w for form in forms(text) for w in WORD.findall(form)}
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) >= k}


def _counted(make, schema_names):
    """A mapInArrow function that adds up what ``make(text, toxic)`` yields and gives (key, toxic, clean) rows."""

    def run(batches):
        total: dict[str, list[int]] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.int64())], names=schema_names)

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for key in make(text, toxic):
                    total.setdefault(key, [0, 0])[0 if toxic == 1 else 1] += 1
            if len(total) > 500_000:
                yield rows()
                total.clear()
        if total:
            yield rows()

    return run


def _sums(rows: DataFrame, make) -> DataFrame:
    return rows.mapInArrow(_counted(make, ["key", "toxic", "clean"]), "key string, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _choose(counts: DataFrame, n_toxic: int, n_clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems from document counts (key, toxic, clean) of candidate terms."""
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    rated = counts.withColumns({"odds": odds, "stem": F.col("key").endswith("*"), "plain": F.regexp_replace("key", r"\*$", "")})
    # of each beginning: the most documents that one of its words or longer beginnings has
    size = F.length("plain")
    inner = F.explode(F.array(*[F.when((size > k) | ((size == k) & ~F.col("stem")), F.concat(F.substring("plain", 1, k), F.lit("*"))) for k in PREFIXES]))
    widest = rated.select(inner.alias("key"), "toxic").where("key is not null").groupBy("key").agg(F.max("toxic").alias("widest"))
    good = rated.where(F.col("odds") >= LEAST_LOG_ODDS).join(widest, "key", "left")
    wide = ~F.col("stem") | (F.col("toxic") >= 1.25 * F.coalesce("widest", F.lit(0)))
    found = _bounded(good.where(wide).select("plain", "stem", "odds"))
    stems: dict[str, float] = {}
    for r in sorted((r for r in found if r["stem"]), key=lambda r: (len(r["plain"]), r["plain"])):
        if not _covered(r["plain"], stems):
            stems[r["plain"]] = r["odds"]
    return {r["plain"]: r["odds"] for r in found if not r["stem"] and not _covered(r["plain"], stems)}, stems


def _covered(word: str, stems: dict[str, float]) -> bool:
    return any(word[:k] in stems for k in PREFIXES if k <= len(word))


def _bounded(rows: DataFrame) -> list:
    found = rows.limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms: raise MOST_TERMS, SUPPORT or LEAST_LOG_ODDS")
    return found


def _phrases(matcher: Matcher, text: str) -> set[str]:
    """Each hit with the token before it and with the token after it, where a single space parts them."""
    read = forms(text)
    folded, hits = read[0], matcher.hits(*read)
    if not hits:
        return set()
    spans = [m.span() for m in TOKEN.finditer(folded)]
    out, k = set(), 0
    for s, e, _w in hits:
        while spans[k][1] <= s:
            k += 1
        if spans[k][0] == s and k and folded[spans[k - 1][1] : s] == " ":
            out.add(f"{folded[slice(*spans[k - 1])]} {folded[s:e]}")
        if spans[k][1] == e and k + 1 < len(spans) and folded[e : spans[k + 1][0]] == " ":
            out.add(f"{folded[s:e]} {folded[slice(*spans[k + 1])]}")
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learns from (doc_id, text) and (doc_id, toxic): lexicon, exceptions and calibration, each by a pass over all rows.

    The labelled texts are written once, as every pass reads them.
    """
    arrow_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int"))
    if known.count() <= MOST_BROADCAST_LABELS:
        known = F.broadcast(known)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string"))
    rows = spill(texts.join(known, "doc_id").select("text", "toxic"))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    exceptions: set[str] = set()
    if n_toxic:
        counts = spill(_sums(rows, lambda text, _: _terms(text)).where(F.col("toxic") >= SUPPORT))
        words, stems = _choose(counts, n_toxic, n_clean)
        bare = Matcher(Lexicon(words, stems, ()))
        kept = F.col("clean") >= F.greatest(F.lit(EXCEPTION_SUPPORT), 10 * F.col("toxic"))
        exceptions = {r["key"] for r in _bounded(_sums(rows, lambda text, _: _phrases(bare, text)).where(kept))}
    lexicon = Lexicon(words, stems, tuple(sorted(exceptions)))
    edges = _edges()
    positive, total = np.zeros(len(edges)), np.zeros(len(edges))
    if n_toxic:
        matcher = Matcher(lexicon)

        def place(text, _):
            return (str(int(np.searchsorted(edges, density(matcher, text)[0], side="right") - 1)),)

        for r in _sums(rows, place).collect():
            positive[int(r["key"])], total[int(r["key"])] = r["toxic"], r["toxic"] + r["clean"]
    return Lexicon(words, stems, lexicon.exceptions, tuple(edges), tuple(_monotone(positive, total)))


def _monotone(positive: np.ndarray, total: np.ndarray) -> list[float]:
    """Non-decreasing probabilities of the bins, by pooling neighbours, with a weak prior that rises with the density."""
    prior = 1.0 - np.exp(-2.0 * _edges())
    blocks: list[list[float]] = []
    for p, n, q in zip(positive, total, prior, strict=True):
        blocks.append([p + q, n + 1.0, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], a, strict=True)]
    return [b[0] / b[1] for b in blocks for _ in range(int(b[2]))]


def score(docs: DataFrame, lexicon: Lexicon, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (with text) and score, hits (terms counted) and density."""
    edges, scores = np.array(lexicon.edges or _edges()), np.array(lexicon.scores or _monotone(np.zeros(BINS + 2), np.zeros(BINS + 2)))

    def kernel():
        matcher = Matcher(lexicon)

        def run(column):
            found = [density(matcher, x or "") for x in column.to_pylist()]
            x = np.array([d for d, _ in found], float)
            at = np.searchsorted(edges, x, side="right") - 1
            # within a bin the score leans towards the next one, so that denser is never lower
            follow = np.minimum(at + 1, len(edges) - 1)
            span = np.maximum(edges[follow] - edges[at], 1e-12)
            share = np.where(at >= 2, np.clip((x - edges[at]) / span, 0, 1), 0.0)
            return [pa.array(scores[at] + (scores[follow] - scores[at]) * share), pa.array([n for _, n in found], pa.int64()), pa.array(x)]

        return run

    return extend(docs, kernel, "score double, hits long, density double", keep)
