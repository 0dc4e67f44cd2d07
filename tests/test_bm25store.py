import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import bm25
from lectern.operators.bm25store import StoredIndex

WORDS = [f"w{k}" for k in range(60)]


def corpus(n, seed=1, at=0):
    r = random.Random(seed)
    return [(at + k, " ".join(r.choices(WORDS, [1 / (i + 1) for i in range(60)], k=r.randrange(1, 40))) + (" w0" * r.randrange(0, 30) if k % 9 == 0 else "")) for k in range(n)]


def queries(spark, n=12):
    r = random.Random(7)
    rows = [(k, " ".join(r.choices(WORDS, k=r.randrange(1, 5)))) for k in range(n)] + [(90, "w0"), (91, "unknown"), (92, ""), (93, None), (94, "w3 w3 w3 w55")]
    return spark.createDataFrame(rows, "qid long, text string")


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


def rows(df):
    return sorted((r.qid, r["rank"], r.id, round(r.score, 6)) for r in df.collect())


def test_search_equals_scoring_all_texts_also_after_segments_and_a_merge(spark, tmp_path):
    a, b, c = corpus(150), corpus(120, 2, 1000) + [(5000, None), (5001, ""), (5002, "w0 w0 w59"), (5003, "w0 w0 w59")], [(None, "w1 w2 w3")]
    asked = queries(spark)
    index = StoredIndex(spark, str(tmp_path), docs=16, buckets=8)
    index.add(frame(spark, a), "one")
    assert rows(index.search(asked, 5)) == rows(bm25.bm25_topk(frame(spark, a), asked, 5))
    before = {f: os.stat(f).st_mtime_ns for f in map(str, tmp_path.rglob("*.parquet"))}
    index.add(frame(spark, b), "two")
    index.add(frame(spark, b), "two")  # sent again
    assert all(os.stat(f).st_mtime_ns == t for f, t in before.items())  # nothing is rebuilt
    expected = rows(bm25.bm25_topk(frame(spark, a + b), asked, 5))
    assert rows(index.search(asked, 5)) == expected and {r.segment for r in index.segments().collect()} == {"one", "two"}
    index.merge("both")
    assert [tuple(r) for r in index.segments().select("segment", "n").collect()] == [("both", 274)] and rows(index.search(asked, 5)) == expected
    with pytest.raises(ValueError, match="both"):
        index.merge("both")
    index.add(frame(spark, c), "three")
    assert rows(index.search(asked.where("qid < 90"), 400)) == rows(bm25.bm25_topk(frame(spark, a + b + c), asked.where("qid < 90"), 400))


def test_a_segment_is_seen_only_when_it_is_whole(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path), docs=16, buckets=4)
    assert index.search(queries(spark)).count() == 0 and index.segments().count() == 0
    index.add(frame(spark, corpus(40)), "one")
    expected = rows(index.search(queries(spark)))
    index.add(frame(spark, corpus(40, 3, 500)), "two")
    for f in (tmp_path / "stats" / "segment=two").iterdir():
        f.unlink()  # as if the writer had ended before
    (tmp_path / "stats" / "segment=two").rmdir()
    assert rows(index.search(queries(spark))) == expected
    index.add(frame(spark, []), "none")
    assert rows(index.search(queries(spark))) == expected


def test_scans_are_pruned_and_slices_skipped(spark, tmp_path):
    # one slice has what the query asks for in short texts, the others in long ones
    filler = " ".join(f"f{k}" for k in range(80))
    texts = [(k, f"gold gold silver {k}") for k in range(40)] + [(1000 + k, f"silver {filler} {k}") for k in range(400)]
    index = StoredIndex(spark, str(tmp_path), docs=20, buckets=16)
    index.add(frame(spark, texts), "one")
    asked = spark.createDataFrame([(1, "gold")], "qid long, text string")
    files = index.met(bm25.query_terms(asked)).inputFiles()
    buckets = {f.split("bucket=")[1].split("/")[0] for f in files}
    plan = index.met(bm25.query_terms(asked))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,gold)]" in plan.replace("In(term, [gold])", "EqualTo(term,gold)"), plan
    assert len(buckets) == 16 or len(buckets) == 1
    both = spark.createDataFrame([(1, "gold silver")], "qid long, text string")
    out, n = index.skipped(both, 3)
    assert n >= 15 and out > 0
    assert rows(index.search(both, 3)) == rows(bm25.bm25_topk(frame(spark, texts), both, 3))


def test_many_terms_are_joined(spark, tmp_path, monkeypatch):
    from lectern.operators import bm25store

    index = StoredIndex(spark, str(tmp_path), docs=16, buckets=4)
    index.add(frame(spark, corpus(60)), "one")
    expected = rows(index.search(queries(spark)))
    monkeypatch.setattr(bm25store, "MOST_NAMED", 2)
    assert rows(index.search(queries(spark))) == expected
    assert index.search(queries(spark).where(F.lit(False))).count() == 0


def test_what_a_search_shuffles_does_not_grow_with_queries_and_documents(spark, tmp_path, monkeypatch):
    """Of a slice come k rows a query, not all pairs that share a word; of the buckets only the terms asked for."""
    from lectern.operators import bm25store

    index = StoredIndex(spark, str(tmp_path), docs=50, buckets=4)
    index.add(frame(spark, corpus(300)), "one")
    asked = bm25.query_terms(queries(spark).where("qid < 90"))
    monkeypatch.setattr(bm25store, "MOST_NAMED", 2)
    met = index.met(asked)
    terms = {r.term for r in asked.select("term").distinct().collect()}
    assert {r.term for r in met.select("term").distinct().collect()} <= terms < set(WORDS)
    search = bm25store._Search(met, asked, index._sums(), 3)
    slices = search.bounds.select("qid", "segment", "slice")
    assert 0 < search.scores(slices).count() <= 3 * slices.count() < search.all_scores(slices).count()
    few = rows(bm25.ranked(search.scores(slices), 3))
    assert few == rows(bm25.ranked(search.all_scores(slices), 3))
    monkeypatch.setattr(bm25, "MOST_QUERY_TERMS", 2)
    assert not bm25store._Search(met, asked, index._sums(), 3).few and rows(index.search(queries(spark).where("qid < 90"), 3)) == few
