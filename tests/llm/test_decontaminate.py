import random

import numpy as np
import pytest

from lectern.llm import decontaminate as dc
from tests.llm.helpers import prose


def _items(n=60):
    return [(k, f"{prose(5000 + k, 18)}. {prose(7000 + k, 8)}.") for k in range(n)]


@pytest.mark.parametrize("block", [2, 4, 64])
def test_wand_finds_what_scoring_everything_finds(monkeypatch, block):
    monkeypatch.setattr(dc, "ITEM_BLOCK", block)
    index = dc.build_index(_items())
    for seed in range(40):
        text = prose(seed, 60) + " " + _items()[seed][1][: seed * 5]
        terms = np.flatnonzero(np.isin(index.terms, np.unique(dc.text_hashes([text])[0])))
        score = np.zeros(len(index.ids))
        for t in terms:
            items, impacts = index.postings(t)
            score[items] += impacts
        for threshold in (0.15, 0.3, 0.6):
            got = dict(dc.block_max_wand(index, terms, threshold))
            assert sorted(got) == [i for i in range(len(score)) if score[i] >= threshold - 1e-9]
            assert all(got[i] == pytest.approx(score[i]) for i in got)
            within = np.array([k for k in range(-(-len(index.ids) // block)) if k % 3 != seed % 3])
            assert dict(dc.block_max_wand(index, terms, threshold, within)) == {i: pytest.approx(s) for i, s in got.items() if i // block in within}


def test_wand_skips_postings_that_cannot_matter():
    index = dc.build_index(_items(400))
    looked, all_ = [], 0
    for seed in range(20):
        text = prose(seed, 60) + " " + _items(400)[seed][1]
        terms = np.flatnonzero(np.isin(index.terms, np.unique(dc.text_hashes([text])[0])))
        assert (seed in dict(dc.block_max_wand(index, terms, 0.6, looked_at=looked)))
        all_ += sum(len(index.postings(t)[0]) for t in terms)
    assert len(looked) < 0.2 * all_


def test_short_items_match_texts_of_the_same_words(spark):
    items = [(1, "Yes, it is."), (2, "yes it is"), (3, "..."), (4, ": a: five more words than these here now"), (5, "one two three four five six seven")]
    docs = [(1, "YES -- it is!"), (2, "yes it is so"), (3, "..."), (4, "one two three four five six seven"), (5, "zero one two three four five six seven"), (6, "x a five more words than these here now y")]
    found = dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (1, 2), (4, 5), (6, 4)]


def test_partial_matches_do_not_depend_on_the_number_of_passes(spark, monkeypatch):
    items = _items() + [(100 + k, t) for k, t in _items(9)] + [(300, "short one"), (301, "SHORT, one")]
    docs = [(k, f"{prose(k, 30)} {' '.join(t.split()[: 14 + k % 12])} {prose(50 + k, 20)}") for k, t in _items()] + [(900, "short one")]
    df, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def found():
        rows = dc.find_leaks(df, table, question_share=0.5, answer_share=0.0).collect()
        return {(r.doc_id, r.item_id): (round(r.score, 9), r.question_overlap, r.answer_overlap) for r in rows}

    whole = found()
    assert 0 < len(whole) < len(items)
    for most in (40, 18):
        monkeypatch.setattr(dc, "MOST_ITEMS", most)
        assert found() == whole


def test_planted_items_are_found_and_clean_texts_are_left(spark):
    items = _items()
    docs, expected = [], set()
    for k in range(60):
        docs.append((k, prose(k, 300)))
        if k % 3 == 0:
            a, b = prose(100 + k, 40 * k), prose(300 + k, 30)
            docs.append((1000 + k, f"{a}\n{items[k][1].upper().replace(' ', '  ')} {b}"))
            expected.add((1000 + k, k))
    docs += [(5000, None), (5001, ""), (5002, items[1][1]), (5002, items[1][1]), (5003, prose(9, 30_000) + " " + items[2][1]), (5004, items[4][1].split(". ")[0])]
    expected |= {(5002, 1), (5003, 2)}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    table = spark.createDataFrame([*items, (90, None), (91, "too short"), (92, "")], "item_id long, text string")
    found = dc.find_leaks(df, table).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected and len(found) == len(expected)
    left = {r.doc_id for r in dc.drop_leaking(df, table).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in expected}


@pytest.mark.parametrize(("n", "many"), [(40, 3), (45, 15), (200, 11)])
def test_items_that_share_all_their_words_are_found(spark, n, many):
    """The first ``many`` items are equal; then as many hold the same words in other orders."""
    items = _items(n)
    equal = [(k, items[0][1] if k < many else t) for k, t in items]
    docs = spark.createDataFrame([(1, f"{prose(1, 200)} {items[0][1]} {prose(2, 90)}"), (2, prose(3, 300)), (3, items[n - 1][1]), (4, items[0][1])], "doc_id long, text string")
    found = dc.find_leaks(docs, spark.createDataFrame(equal, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == sorted([(d, k) for d in (1, 4) for k in range(many)] + [(3, n - 1)])
    question, answer = items[0][1].split(". ")
    mixed = [(k, f"{' '.join(random.Random(k).sample(question.split(), 18))}. {answer}" if 0 < k < many else t) for k, t in items]
    found = dc.find_leaks(docs, spark.createDataFrame(mixed, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 0), (3, n - 1), (4, 0)]


@pytest.mark.parametrize("threshold", [0.3, 0.6])
def test_passages_stay_open_for_all_items_that_reach_the_threshold(threshold):
    words = prose(1, 24).split()
    rows = [(k, f"{' '.join(random.Random(k).sample(words, 18))}. {prose(k % 5, 4)}.") for k in range(50)]
    index = dc.build_index(rows, threshold)
    searcher = dc.Searcher(index, threshold, 0.8, 0.8)
    for seed in range(30):
        part = dc.text_hashes([" ".join(random.Random(900 + seed).sample(words, 6 + seed % 15))])[0]
        score = np.zeros(len(index.ids))
        for t in np.flatnonzero(np.isin(index.terms, part)):
            at, impacts = index.postings(t)
            score[at] += impacts
        found = searcher.passages(part, np.array([0, len(part)]))
        assert set(np.flatnonzero(score >= threshold) // dc.ITEM_BLOCK) <= set(found[3] if found else ())


def test_items_in_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(dc, "MOST_ITEMS", 20)
    items = _items()
    docs = spark.createDataFrame([(k, prose(k, 30) + " " + items[k][1]) for k in range(60)], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, table).collect()} == {(k, k) for k in range(60)}
    assert dc.find_leaks(docs, table.limit(0)).count() == 0 and dc.find_leaks(docs.limit(0), table).count() == 0


def test_items_are_split():
    assert dc.split_item("What is it?\nAnswer: a thing") == ("What is it?\n", " a thing")
    assert dc.split_item("One two three four five six. Seven eight nine.") == ("One two three four five six. ", "Seven eight nine.")
    assert dc.split_item("a b c d e f g h") == ("a b c d e f", "g h")
