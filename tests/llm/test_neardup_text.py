import random

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import components as module
from lectern.llm import neardup_text as nt
from lectern.llm.components import components
from tests.llm.helpers import near_components, prose, roots, shingle_set


def _edit(text, seed, n):
    r = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def _corpus():
    base = [prose(k, 120) for k in range(12)]
    docs = [(k, t) for k, t in enumerate(base)]
    n = len(docs)
    for k, t in enumerate(base):
        for m in range(4):
            docs.append((n := n + 1, _edit(t, 100 * k + m, m)))
    passage = prose(999, 40)
    for k in range(30):  # a passage shared by documents that are otherwise different
        docs.append((n := n + 1, prose(500 + k, 60) + " " + passage))
    hub = prose(77, 150)
    for k in range(50):  # a group of near copies that makes long lists
        docs.append((n := n + 1, _edit(hub, 9000 + k, 1)))
    docs += [(n + 1, None), (n + 2, ""), (n + 3, " \t\n"), (n + 4, "two words"), (n + 5, "TWO  words"), (n + 6, "two words more"), (n + 7, hub), (n + 8, hub), (n + 9, prose(5, 30_000))]
    return docs


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_against_all_pairs(spark, width, percent):
    docs = _corpus()
    found = nt.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == near_components(docs, width, percent)


def test_residual_way_joins_what_pivots_miss(spark, monkeypatch):
    """A chain of texts of which only neighbours link, in lists too long for all pairs at once."""
    monkeypatch.setattr(nt, "SHORT_LIST", 1)
    w = prose(3, 200).split()
    docs = [(k, " ".join(f"k{k}x{j}" if j < 8 * k else x for j, x in enumerate(w))) for k in range(10)]
    found = nt.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == near_components(docs, 4, 85)
    assert len({r.component_id for r in found}) < 10


@pytest.mark.parametrize(("tile", "partners"), [(4, 1), (1024, 1)])
def test_tiles_rounds_and_shuffled_verification(spark, monkeypatch, tile, partners):
    """Long lists cut into small tiles, one partner a round, ids told by bits, and every way to the same components."""
    for name, value in (("SHORT_LIST", 1), ("TILE", tile), ("PARTNERS", partners), ("MOST_BROADCAST_ROLES", 0), ("OFFERS", 1)):
        monkeypatch.setattr(nt, name, value)
    docs = _corpus()[:100]
    found = nt.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 5, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == near_components(docs, 5, 80)


def test_texts_that_share_an_id_link_each(spark):
    a, b = prose(1, 60), prose(2, 60)
    docs = [(1, a), (1, b), (2, _edit(a, 1, 1)), (3, _edit(b, 2, 1)), (4, prose(3, 60))]
    found = nt.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_parity_rows_differ_in_no_more_bits_than_sets_in_shingles():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 1, 50, 3000)]
    sets += [np.unique(np.concatenate([x[: len(x) // 2], r.integers(0, 1 << 63, 20, dtype=np.uint64)])) for x in sets]
    bits = nt._parities(np.concatenate(sets), np.cumsum([0, *map(len, sets)])).view(np.uint64)
    for x, p in zip(sets, bits, strict=True):
        for y, q in zip(sets, bits, strict=True):
            assert np.bitwise_count(p ^ q).sum() <= len(np.setxor1d(x, y))


def test_sets_and_prefixes_against_sorting():
    texts = pa.array(["a b c d e f g", None, "", "a a a a a a", "x", *[prose(k, 30 * k) for k in range(9)]])
    r = np.random.default_rng(2)
    bitmap = r.integers(0, 1 << 63, 1 << (nt.FREQUENT_BITS - 6), dtype=np.uint64)
    hashes, edge = nt.joined_sets(texts, 3)
    head, start = nt.prefixes(hashes, edge, bitmap, 80)
    for k, text in enumerate(texts.to_pylist()):
        x = hashes[edge[k] : edge[k + 1]].tolist()
        assert len(x) == len(shingle_set(text, 3)) and x == sorted(set(x))
        flag = {y: y < int(nt._LOW) and bool(nt._flagged(bitmap, np.array([y >> 62 - nt.FREQUENT_BITS]))[0]) for y in x}
        assert head[start[k] : start[k + 1]].tolist() == sorted(x, key=lambda y: (flag[y], y))[: nt.prefix_length(len(x), 80) if x else 0]
        assert nt._set_keys(hashes, edge)[0][k].as_py() == int(np.add.reduce(nt.textkit.mix(np.array(x, np.uint64))).view(np.int64))


def test_frequent_shingles_of_all_tasks(spark):
    common = [(prose(7, 40),)] * 40
    rows = spark.createDataFrame(common + [(prose(100 + k, 40),) for k in range(40)], "text string").repartition(2)
    column = pa.array([common[0][0]])
    bitmap = nt.frequent_shingles(rows, 4)
    low = nt.document_sets(column, 4)[0]
    low = low[low < nt._LOW]
    assert len(low) and nt._flagged(bitmap, (low >> np.uint64(62 - nt.FREQUENT_BITS)).astype(np.int64)).all()
    assert 0 < np.bitwise_count(bitmap).sum() <= len(low)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    text = prose(1, 50)
    rows = [(1, text, "x", 5), (1, text, "y", 6), (None, text, "z", 7), (2, text, "w", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, N_Shingles int")
    found = nt.add_components(df).collect()
    assert len(found) == 4
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (1, 1), (1, 1), (2, 1)]


def test_empty_table(spark):
    assert nt.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_chains_stars_and_cycles(spark):
    r = random.Random(4)
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200)] + [(300, 300), (None, 5)]
    r.shuffle(pairs)
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None]
    expected = {k: v for k, v in roots({x for p in real for x in p}, real).items() if k != v}
    assert got == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_beyond_one_task(spark, monkeypatch):
    monkeypatch.setattr(module, "LINKS_A_TASK", 30)
    r = random.Random(9)
    pairs = [(k, k + 1) for k in range(90)] + [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(150)]
    r.shuffle(pairs)
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long").repartition(4)).collect()}
    assert got == {k: v for k, v in roots({x for p in pairs for x in p}, pairs).items() if k != v}
