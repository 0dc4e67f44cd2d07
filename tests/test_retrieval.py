import math
import random

import pytest

from lectern.operators import bm25, evaluation, fusion
from lectern.operators.embedding import EmbeddingStore, cache_hits, cache_misses, embed, hash_encoder, with_keys
from lectern.operators.topk import Best
from lectern.operators.vectors import vector_topk
from lectern.sources.collection import Collection

CHUNKS = [("a", "The proxy forwards the\nrequest to the server"), ("b", "A server answers  each request request"), ("c", "Timers and dialogs"), ("d", None)]


def test_bm25_against_the_formula(spark):
    docs = spark.createDataFrame(CHUNKS, "id string, text string")
    got = {(r.qid, r.id): (r.score, r.rank) for r in bm25.bm25_topk(docs, spark.createDataFrame([(1, "request request server"), (2, "nothing here"), (3, "ТАЙМЕР")], "qid int, text string")).collect()}
    tokens = {i: (t or "").lower().replace("\n", " ").split() for i, t in CHUNKS}
    n, avg = 4, sum(map(len, tokens.values())) / 4
    score = {}
    for i, ts in tokens.items():
        s = 0
        for term in ("request", "request", "server"):
            df, tf = sum(term in x for x in tokens.values()), ts.count(term)
            s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avg)) if tf else 0
        if s:
            score[i] = s
    order = sorted(score, key=lambda i: (-score[i], i))
    assert {k: v[1] for k, v in got.items()} == {(1, i): order.index(i) + 1 for i in order}
    assert all(got[(1, i)][0] == pytest.approx(score[i], abs=1e-6) for i in order)


def test_filter_comes_before_the_ranking(spark):
    rows = [(k, [1.0, k / 100], k % 2) for k in range(50)]
    df = spark.createDataFrame(rows, "id long, vector array<float>, label int").repartition(3)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "qid int, vector array<float>")
    got = vector_topk(df, q, 3, where="label == 1").collect()
    assert [r.id for r in sorted((r for r in got if r.qid == 1), key=lambda r: r.rank)] == [1, 3, 5]
    assert [r.id for r in sorted((r for r in got if r.qid == 2), key=lambda r: r.rank)] == [49, 47, 45]
    more = vector_topk(df, q, 5, where="label == 1").collect()
    assert {(r.qid, r.id, r.rank) for r in got} <= {(r.qid, r.id, r.rank) for r in more}


def test_vector_ties_go_to_the_lower_id_and_odd_rows_are_skipped(spark):
    rows = [(k, [1.0, 0.0]) for k in range(9, 0, -1)] + [(20, None), (21, [0.0, 0.0]), (22, [1.0])]
    got = vector_topk(spark.createDataFrame(rows, "id long, vector array<float>").repartition(4), spark.createDataFrame([(1, [2.0, 0.0])], "qid int, vector array<float>"), 3).collect()
    assert sorted((r.rank, r.id, r.score) for r in got) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)]


def test_fusion_does_not_depend_on_the_order_of_rankings(spark):
    one = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "z", 11)], "qid int, id string, rank int")
    two = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "qid int, id string, rank int")
    got = [(r.id, r.rank) for r in fusion.rrf({"x": one, "y": two}, depth=10).orderBy("rank").collect()]
    assert got == [("b", 1), ("a", 2), ("c", 3)] == [(r.id, r.rank) for r in fusion.rrf({"y": two, "x": one}, depth=10).orderBy("rank").collect()]


def test_evidence_recall_and_mrr(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "EVIDENCE_BLOCK", 2)
    docs = spark.createDataFrame(CHUNKS, "id string, text string")
    asked = spark.createDataFrame([(1, "forwards the request"), (2, "each\trequest"), (3, "absent"), (4, None), (5, "")], "qid int, text string")
    correct = evaluation.evidence_matches(docs, asked)
    assert {(r.qid, r.id) for r in correct.collect()} == {(1, "a"), (2, "b"), (5, "a"), (5, "b"), (5, "c")}
    ranks = spark.createDataFrame([("s", 1, "b", 1), ("s", 1, "a", 2), ("s", 2, "b", 1), ("s", 3, "c", 1)], "source string, qid int, id string, rank int")
    questions = asked.where("qid < 4")
    r = evaluation.recall_mrr(ranks, correct, questions).first()
    assert (r.n, r.recall_1, r.recall_3, r.mrr) == (3, 0.3333, 0.6667, 0.5)
    per = {x.qid: (x.ranked, x.correct, x.correct_hits) for x in evaluation.per_question(ranks, correct, questions).collect()}
    assert per == {1: (["b", "a"], ["a"], ["a"]), 2: (["b"], ["b"], ["b"]), 3: (["c"], [], [])}


def test_prefix_matches(spark):
    docs = spark.createDataFrame([(1, "Hello, WORLD of things"), (2, "x" * 200), (3, None)], "id int, text string")
    asked = spark.createDataFrame([(1, "hello world!"), (2, "worlds"), (3, "x" * 120 + " y"), (4, None)], "qid int, text string")
    assert {(r.qid, r.id) for r in evaluation.prefix_matches(docs, asked).collect()} == {(1, 1), (3, 2)}


@pytest.mark.parametrize("cells", [3, 2_000_000])
def test_bm25_batches_equal_the_join_of_postings(spark, monkeypatch, cells):
    """Small batches of scores, ties, repeated terms, queries without hits, and the way for many terms."""
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 30)))) for k in range(300)] + [(1000 + k, "w1 w2 w3") for k in range(30)] + [(2000, None), (2001, "")]
    queries = [(k, " ".join(r.choice(vocabulary) for _ in range(6))) for k in range(25)] + [(100, "w1 W2 w2"), (101, "absent"), (102, None), (103, "")]
    df, asked = spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame(queries, "qid int, text string")
    monkeypatch.setattr(Best, "step", lambda self: max(1, cells // len(self.names)))
    got = {tuple(x) for x in bm25.bm25_topk(df, asked, 7).collect()}
    monkeypatch.setattr(bm25, "MOST_QUERY_TERMS", 3)
    assert got == {tuple(x) for x in bm25.bm25_topk(df, asked, 7).collect()} and len(got) == 26 * 7
    assert bm25.bm25_topk(df.limit(0), asked, 7).count() == 0 and bm25.bm25_topk(df, asked.limit(0), 7).count() == 0


def test_embedding_store_keeps_the_last_row_of_a_key(spark, tmp_path):
    store = EmbeddingStore(spark, f"file://{tmp_path}/store")
    assert store.rows().count() == 0
    kind = "model string, key string, vec array<float>"
    store.upsert(spark.createDataFrame([("m", "a", [1.0]), ("m", "b", [2.0]), ("n", "a", [3.0])], kind))
    store.upsert(spark.createDataFrame([("m", "a", [9.0])], kind))
    expected = {("m", "a", 9.0), ("m", "b", 2.0), ("n", "a", 3.0)}
    assert {(r.model, r.key, r.vec[0]) for r in store.rows().collect()} == expected
    store.compact()
    assert {(r.model, r.key, r.vec[0]) for r in EmbeddingStore(spark, f"file://{tmp_path}/store").rows().collect()} == expected
    calls = []

    def factory():
        def encode(texts):
            calls.append(len(texts))
            return hash_encoder(4)(texts)

        return encode

    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id int, text string")
    assert store.embed(rows, "z", factory).count() == 3 and store.rows("z").count() == 2
    again = {r.id: list(r.vec) for r in store.embed(rows, "z", lambda: None).collect()}
    assert again[1] == again[3] != again[2] and store.rows("z").count() == 2


def test_embedding_reuses_the_cache_and_collections_upsert(spark):
    chunk = "chunk_id string, method string, rfc int, title string, section_id string, section_path string, page_start struct<pdf:int,printed:int>, page_end struct<pdf:int,printed:int>, text string"
    rows = [("n-1", "naive", 1, "t", None, None, (0, None), (1, 2), "alpha"), ("n-2", "naive", 2, "t", "9", "9.1 X", (3, 4), (3, 4), "beta"), ("n-3", "naive", 2, "t", "9", "8.1 Y", (3, 4), (3, 4), "alpha")]
    chunks = spark.createDataFrame(rows, chunk)
    cache = spark.createDataFrame([], "model string, key string, vec array<float>")
    factory = lambda: hash_encoder(8)
    vectors, fresh = embed(chunks, cache, "m", factory)
    assert fresh.count() == 2 and vectors.count() == 3
    cache = spark.createDataFrame(fresh.collect(), fresh.schema)
    keyed = with_keys(chunks, "m")
    assert cache_misses(keyed, cache, "m").count() == 0 and cache_hits(keyed, cache, "m").count() == 3 and cache_misses(keyed, cache, "other").count() == 3
    c = Collection(spark, "chunks_test")
    assert c.ensure() and not c.ensure(recreate=False) and not c.ready()
    table = vectors.withColumn("vector", vectors["vec"]).drop("vec")
    assert c.insert(table) == 3 and c.insert(table.where("chunk_id = 'n-1'")) == 1 and c.count() == 3 and c.ready()
    q = vectors.where("chunk_id = 'n-2'").selectExpr("1 as qid", "vec as vector")
    top = c.search(q, 1).first()
    assert (top.chunk_id, top.page, top.distance) == ("n-2", 4, 1.0)
    assert [r.chunk_id for r in c.search(q, 5, where='section_path like "9.%"').collect()] == ["n-2"]
    assert {r.chunk_id for r in c.search(q, 5, where="rfc == 1").collect()} == {"n-1"} and c.search(q, 5, "rfc == 1").first().page is None
    for name in ("chunks_test_next", "chunks_test_aside"):  # what a failure can leave behind
        spark.table("chunks_test").where("chunk_id <> 'n-3'").write.saveAsTable(name)
    assert c.ensure(recreate=False) is False and c.count() == 2 and not spark.catalog.tableExists("chunks_test_aside")
    c.drop()
    assert not c.ready()


def _texts(n, chars=2000):
    """Texts of words that every query asks for, so that a batch of them makes many pairs of words and queries."""
    r = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [" ".join(r.choices(vocabulary, k=chars // 4)) for _ in range(50)]
    return [texts[k % 50] for k in range(n)]


def _peak(run, batch):
    import tracemalloc

    list(run([batch.slice(0, 50)]))
    tracemalloc.start()
    out = list(run([batch]))
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    return peak, out


class _Shared:
    def __init__(self, value):
        self.value = value


def test_scoring_and_matching_hold_no_more_for_a_larger_batch(spark):
    """What a task holds is bounded, whatever the number of texts in a batch."""
    import numpy as np
    import pyarrow as pa

    terms = {f"w{k}": k for k in range(60)}
    names = list(range(40))
    owner, code = np.tile(np.arange(40), 60), np.repeat(np.arange(60), 40)
    weights = (names, np.searchsorted(code, np.arange(61)), owner, 1.0 + (owner * 7 + code * 13) % 11, 500.0)
    score = bm25._scored(_Shared(terms), _Shared(weights), 5, [pa.int64(), pa.int64(), pa.float64()])
    rows = _texts(6000)
    batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array(range(6000))], names=["low", "id"])
    peak, out = _peak(score, batch)
    assert peak < 90, peak
    assert sum(len(b) for b in out) == 200
    halves = bm25._scored(_Shared(terms), _Shared(weights), 5, [pa.int64(), pa.int64(), pa.float64()])
    assert [b.to_pylist() for b in halves([batch.slice(k, 100) for k in range(0, 6000, 100)])] == [b.to_pylist() for b in out]


def test_evidence_is_split_by_its_characters(spark, monkeypatch):
    docs = spark.createDataFrame(CHUNKS, "id string, text string")
    asked = spark.createDataFrame([(1, "forwards the request"), (2, "each\trequest"), (3, "absent"), (4, None), (5, "")], "qid int, text string")
    monkeypatch.setattr(evaluation, "EVIDENCE_CHARS", 20)
    monkeypatch.setattr(evaluation, "MATCHES", 1)
    found = evaluation.evidence_matches(docs, asked)
    assert found._jdf.queryExecution().logical().toString().count("MapInArrow") == 2
    assert {(r.qid, r.id) for r in found.collect()} == {(1, "a"), (2, "b"), (5, "a"), (5, "b"), (5, "c")}


def test_the_steps_of_per_question_hold_no_more_for_a_larger_batch(spark, monkeypatch):
    """Statistics, scoring and evidence matching, as the query itself sets them up."""
    import pyarrow as pa

    from lectern.plans.catalogue import items, per_question

    data = "/root/testdata/sf0.001"
    steps, frame = [], type(spark.range(0))

    def seen(self, run, schema, plain=frame.mapInArrow, **more):
        steps.append((self.columns, run))
        return plain(self, run, schema, **more)

    monkeypatch.setattr(frame, "mapInArrow", seen)
    per_question(spark, data)
    asked = [r.text for r in items(spark, data).collect()]
    r = random.Random(5)
    words = " ".join(asked).lower().split()
    texts = [" ".join([*r.choices(words, k=250), " ".join(asked[k % len(asked)].split())]) for k in range(6000)]
    columns = {"low": pa.array([t.lower() for t in texts]), "norm": pa.array(texts), "id": pa.array(range(6000))}
    of_texts = [(names, run) for names, run in steps if {"low", "norm"} & set(names)]
    assert sorted(names for names, _ in of_texts) == [["id", "norm"], ["low"], ["low", "id"]]
    for names, run in of_texts:
        batch = pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)
        (less, _), (more, out) = _peak(run, batch.slice(0, 1500)), _peak(run, batch)
        assert sum(map(len, out)) > 0 and more < 1.3 * less + 1, (names, less, more)
