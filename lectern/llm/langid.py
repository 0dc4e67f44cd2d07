"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile is the list of a language's most frequent letter n-grams (1 to 3 letters, words padded on both sides), most
frequent first.  A document's own most frequent n-grams are ranked the same way; each contributes the difference of
its two ranks, or the profile's length if the language does not list it.  The language with the least sum wins.

Training counts n-grams of whole texts in Arrow batches, adds them up per language in Spark and keeps only the head of
each profile; what reaches the driver is ``profile_size`` rows a language, whatever the input.

Edge cases: a null text, or one without any letter, is ``und`` with score 0; ties between languages go to the first
by code point, ties between n-grams to the lower code points; texts of any length are used whole; null languages and
empty tables teach nothing, and a model without languages answers ``und`` for everything; other columns pass through.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import textkit
from lectern.llm.runtime import arrow_batches, extend

PAD = 1
TOP = 0x110000
PROFILE_SIZE = 1200
DOCUMENT_SIZE = 400
MOST_LANGUAGES = 4000
UNDETERMINED = "und"
#: Below this score the pipeline rejects a document: its letters resemble no profile.
LEAST_SCORE = 0.1


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is none."""
    table = np.zeros(TOP, np.uint32)
    for cp in range(TOP):
        c = chr(cp)
        if c.isalpha():
            table[cp] = ord(c.lower()[0])
    return table


def count_grams(texts: list[str], owner: np.ndarray, by_count: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count) of all 1- to 3-grams, sorted by owner and then n-gram, or count falling first.

    An n-gram is three code points of 21 bits, zeros in front of shorter ones.
    """
    joined = "\n".join(texts) + "\n"
    points = letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    inside = points != 0
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    seq = np.concatenate([[np.uint32(PAD)], np.where(inside, points, np.uint32(PAD))[kept]])
    whose = np.concatenate([[0], np.repeat(owner, lengths)[kept]]).astype(np.uint64)
    present = np.zeros(TOP, bool)
    present[seq] = True
    alphabet = np.flatnonzero(present).astype(np.uint64)
    dense = np.zeros(TOP, np.uint64)
    dense[alphabet] = np.arange(1, len(alphabet) + 1, dtype=np.uint64)
    bits = np.uint64(int(len(alphabet)).bit_length())
    code = dense[seq]
    pair = (code[:-1] << bits) | code[1:]
    triple = ((code[:-2] << (bits + bits)) | pair[1:])[seq[1:-1] != PAD]
    shift = bits * np.uint64(3)
    one = seq != PAD
    keys = np.concatenate([(whose[one] << shift) | code[one], (whose[1:] << shift) | pair, (whose[2:][seq[1:-1] != PAD] << shift) | triple])
    keys.sort()
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.concatenate([at, [len(keys)]]))
    keys = keys[at]
    if by_count:
        order = np.lexsort((np.uint64(count.max()) - count.astype(np.uint64), keys >> shift))
        keys, count = keys[order], count[order]
    mask = (np.uint64(1) << bits) - np.uint64(1)
    padded = np.concatenate([[np.uint64(0)], alphabet])
    gram = np.zeros(len(keys), np.uint64)
    for k in (2, 1, 0):
        gram = (gram << np.uint64(21)) | padded[(keys >> (bits * np.uint64(k))) & mask]
    return (keys >> shift).astype(np.int64), gram, count


def _partial_counts(batches):
    """Rows (lang, gram, n), added up within the task as far as memory allows."""
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def folded():
        owner, gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((gram, owner))
        owner, gram, n = owner[order], gram[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])]))
        return owner[at], gram[at], np.add.reduceat(n, at)

    def rows(part):
        label = pa.array(list(names), pa.string()).take(pa.array(part[0]))
        return pa.RecordBatch.from_arrays([label, pa.array(part[1].astype(np.int64)), pa.array(part[2])], names=["lang", "gram", "n"])

    for batch in batches:
        lang, text = batch.column(0), batch.column(1)
        for i, j in textkit.slices(textkit.buffers(text)[1]):
            owner = np.fromiter((names.setdefault(x, len(names)) for x in lang.slice(i, j - i).to_pylist()), np.int64, j - i)
            held.append(count_grams([x or "" for x in text.slice(i, j - i).to_pylist()], owner))
            if sum(len(x[0]) for x in held) > 3_000_000:
                held = [folded()]
                if len(held[0][0]) > 1_500_000:
                    yield rows(held.pop())
    if held:
        yield rows(folded())


def fit_profiles(docs: DataFrame, size: int = PROFILE_SIZE) -> dict[str, np.ndarray]:
    """Language -> its n-grams, most frequent first; ``docs`` needs text and lang, of which null languages are left out."""
    arrow_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    total = rows.mapInArrow(_partial_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    heads = total.withColumn("place", place).where(F.col("place") <= size).select("lang", "gram", "place").limit(MOST_LANGUAGES * size + 1).toPandas()
    if len(heads) > MOST_LANGUAGES * size:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    heads = heads.sort_values(["lang", "place"])
    return {k: v["gram"].to_numpy().astype(np.uint64) for k, v in heads.groupby("lang")}


def classifier(profiles: dict[str, np.ndarray], document_size: int = DOCUMENT_SIZE):
    """A function of an Arrow string array that returns (language, score) arrays."""
    names = sorted(profiles, key=lambda x: x.encode("utf-8", "surrogatepass"))
    size = max([1, *(len(p) for p in profiles.values())])
    known = np.unique(np.concatenate([profiles[k] for k in names])) if names else np.zeros(0, np.uint64)
    place = np.full((len(known) + 1, len(names)), -1, np.int32)
    for k, name in enumerate(names):
        place[np.searchsorted(known, profiles[name]), k] = np.arange(len(profiles[name]))

    def run(column: pa.Array) -> list[pa.Array]:
        texts = [x or "" for x in column.to_pylist()]
        label, score = np.full(len(texts), -1, np.int64), np.zeros(len(texts))
        owner, gram, _ = count_grams(texts, np.arange(len(texts)), by_count=True)
        if len(owner) and names:
            first = np.searchsorted(owner, np.arange(len(texts)))
            rank = np.arange(len(owner)) - first[owner]
            head = rank < document_size
            owner, gram, rank = owner[head], gram[head], rank[head]
            at = np.searchsorted(known, gram)
            at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != gram)] = len(known)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            present = owner[starts]
            n = np.diff(np.concatenate([starts, [len(owner)]]))
            best, least = np.zeros(len(present), np.int64), np.full(len(present), np.iinfo(np.int64).max)
            for k in range(len(names)):
                p = place[at, k].astype(np.int64)
                d = np.add.reduceat(np.where(p < 0, size, np.minimum(np.abs(p - rank), size)), starts)
                better = d < least
                best[better], least[better] = k, d[better]
            label[present], score[present] = best, 1.0 - least / (n * float(size))
        return [pa.array([names[k] if k >= 0 else UNDETERMINED for k in label], pa.string()), pa.array(score)]

    return run


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """``docs`` (with text) and lang_pred, score."""
    return extend(docs, lambda: classifier(profiles), "lang_pred string, score double", keep)
