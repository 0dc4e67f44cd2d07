import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import lm
from tests.llm.helpers import ENGLISH, GERMAN, prose, words


@pytest.mark.parametrize("head", [1 << 17, 40])
def test_base_score_and_counts(spark, monkeypatch, head):
    """With a small head most counts come by the join."""
    real = lm.new_model
    monkeypatch.setattr(lm, "new_model", lambda v: real(v, head, 2 * head))
    docs = [(k, prose(k, 80, [ENGLISH, GERMAN][k % 2])) for k in range(60)] + [(100, None), (101, ""), (102, "never seen words here"), (103, prose(5, 20_000)), (104, "Twice the row"), (104, "Twice the row"), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = lm.score_texts(df, F.coalesce(F.col("doc_id"), F.lit(1)) % 10 == 2).collect()
    assert len(found) == len(docs)
    count = collections.Counter()
    for i, t in docs:
        if (i if i is not None else 1) % 10 != 2:
            count.update([*words(t), None])
    total, distinct = sum(count.values()), len(count)
    z = math.log10(total + 0.1 * (distinct + 1))
    texts = dict(docs)
    for r in found:
        t = [*words(texts[r.doc_id]), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(count[w] > 0 for w in t), total)
        assert r.base_score == pytest.approx(sum(math.log10(count[w] + 0.1) - z for w in t))
        assert math.isfinite(r.score) and r.score < 0


def test_model_learns_context_and_sums_to_one(spark):
    cycle = "alpha beta gamma delta".split()
    docs = [(k, " ".join(cycle[(k + j) % 4] for j in range(50))) for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = lm.score_texts(df, F.col("doc_id") % 10 == 0).where("held_out").collect()
    assert sum(r.score for r in found) > 0.7 * sum(r.base_score for r in found)
    vocabulary = df.select("text").mapInArrow(lm._count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    model = lm.train(df.select("text"), lm.new_model(vocabulary))
    h = np.append(model.known, np.uint64(12345))
    one, two = np.full(len(h), model.known[0]), np.full(len(h), model.known[1])
    assert np.exp(lm.log_probabilities(model, h, one, two)).sum() == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("head", [1 << 17, 500])
def test_context_counts_for_words_beyond_the_most_frequent(spark, monkeypatch, head):
    """3,000 words of equal frequency, each of which decides the next; beyond the head, at least the next one's group."""
    real = lm.new_model
    monkeypatch.setattr(lm, "new_model", lambda v: real(v, head))
    docs = [(k, " ".join(f"w{(k * 37 + j) % 3000}" for j in range(100))) for k in range(3000)]
    found = lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), F.col("doc_id") % 10 == 0).where("held_out").collect()
    assert sum(r.score for r in found) > (0.35 if head > 3000 else 0.8) * sum(r.base_score for r in found)


def test_scores_do_not_depend_on_the_split(spark):
    docs = [(k, prose(k, 60 + k % 40, [ENGLISH, GERMAN][k % 2])) for k in range(150)] + [(1000 + k, prose(7, 50)) for k in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    two, seven = ({r.doc_id: r.score for r in lm.score_texts(df.repartition(n), F.col("doc_id") % 10 == 0).collect()} for n in (2, 7))
    assert two == pytest.approx(seven, rel=1e-4)


@pytest.mark.parametrize("counts", [[2_000_000 + k % 3 for k in range(200)], [5] * 300, [1] * 250 + [7] * 20, [3], []])
@pytest.mark.parametrize("head", [100, 1])
def test_head_is_the_most_frequent_whatever_the_counts(spark, counts, head):
    r = np.random.default_rng(len(counts))
    h = r.integers(-(1 << 63), (1 << 63) - 1, len(counts))
    model = lm.new_model(spark.createDataFrame([(int(x), c) for x, c in zip(h, counts, strict=True)], "h long, c long"), head, 0)
    order = sorted(zip(counts, h.view(np.uint64) if len(h) else h, strict=True), key=lambda x: (-x[0], x[1]))
    expected = order[:head]
    assert (lm._headed(model, model.head) == np.arange(len(model.head))).all() and (lm._headed(model, model.head + np.uint64(1)) == -1).all()
    assert (model.total, model.distinct) == (sum(counts), len(counts))
    assert sorted(model.head_count.tolist()) == sorted(c for c, _ in expected) and set(model.head.tolist()) == {int(x) for _, x in expected}


def test_tree_holds_every_leaf_once():
    for mass in (np.ones(1), np.ones(17), np.arange(1000, 0, -1.0) ** 3, np.append(1e9, np.ones(5000))):
        first, node, child, bias = lm.grow_tree(mass)
        paths = [tuple(zip(node[a:b].tolist(), child[a:b].tolist(), strict=True)) for a, b in zip(first[:-1], first[1:], strict=True)]
        assert len(set(paths)) == len(mass)
        share = [math.exp(sum(float(bias[n, c]) for n, c in p)) for p in paths]
        assert share == pytest.approx(list(mass / mass.sum()), rel=1e-4)


def test_nothing_to_learn_from_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm.score_texts(df, F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isfinite(r.score) and r.base_score == pytest.approx(0)
    assert lm.score_texts(df.limit(0), F.lit(False)).count() == 0
