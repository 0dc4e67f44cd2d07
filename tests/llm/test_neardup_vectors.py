import numpy as np
import pytest

from lectern.llm import neardup_vectors as nv
from tests.llm.helpers import roots


def _brute(rows):
    good = []
    for i, v, label in rows:
        if i is None or label is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good.append((i, np.array(v, np.float32).astype(float), label))
    links = {i: 0 for i, _, _ in rows}
    pairs = []
    for k, (a, x, p) in enumerate(good):
        for b, y, q in good[k + 1 :]:
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    found = roots({i for i, _, _ in rows}, pairs)
    return {i: (links[i], found[i], found[i] == i) for i, _, _ in rows}


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nv, "BLOCK", 32)
    monkeypatch.setattr(nv, "LEAF", 8)
    r = np.random.default_rng(3)
    rows, k = [], 0
    for label in (0, 1):
        for _ in range(40):
            center = r.normal(size=16)
            for _ in range(r.integers(1, 6)):
                rows.append((k := k + 1, (center + r.normal(size=16) * r.choice([0.02, 0.05, 0.1])).tolist(), label))
        hub = r.normal(size=16)
        rows += [((k := k + 1), (hub + r.normal(size=16) * 0.01).tolist(), label) for _ in range(60)]
        rows += [((k := k + 1), hub.tolist(), label) for _ in range(5)]
    rows += [(k + 1, None, 0), (k + 2, [], 0), (k + 3, [0.0] * 16, 0), (k + 4, [float("nan")] * 16, 0), (k + 5, [1.0] * 15 + [float("inf")], 0), (k + 6, [1.0] * 15 + [None], 1), (k + 7, [1.0, 2.0], 0), (k + 8, [2.0, 4.0], 0), (k + 9, [1.0] * 16, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    found = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in nv.near_duplicates(df).collect()}
    assert found == _brute(rows)


def test_repeated_rows_empty_table_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 3, "a"), (1, [1.0, 0.0], 3, "b"), (2, [1.0, 0.001], 3, "c"), (None, [1.0, 0.0], 3, "d")]
    found = nv.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, Kept string")).collect()
    assert sorted((r.vec_id or 0, r.n_links) for r in found) == [(0, 0), (1, 2), (1, 2), (2, 2)]
    assert nv.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize(("block", "tile"), [(512, 8), (1, 1), (2, 3)])
def test_vectors_that_share_an_id_count_one_by_one(spark, monkeypatch, block, tile):
    monkeypatch.setattr(nv, "BLOCK", block)
    monkeypatch.setattr(nv, "TILE", tile)
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.01], 0), (1, [1.0, 0.02], 0), (2, [1.0, 0.03], 0), (1, [0.0, 1.0], 0), (9, [0.0, 1.0], 0)]
    found = nv.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(2)).collect()
    assert sorted((r.vec_id, tuple(r.embedding), r.n_links, r.component_id) for r in found) == sorted((i, tuple(v), 3 if v[0] else 1, 1) for i, v, _ in rows)


def test_tiles_against_all_pairs(spark, monkeypatch):
    """Several blocks a tile and several tiles, with links across both."""
    monkeypatch.setattr(nv, "BLOCK", 7)
    monkeypatch.setattr(nv, "TILE", 2)
    r = np.random.default_rng(11)
    centres = r.normal(size=(6, 5))
    rows = [(k, (centres[k % 6] + 0.12 * r.normal(size=5)).tolist(), k % 2) for k in range(160)]
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([c for _, _, c in rows])
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    expected = roots(range(160), [(int(a), int(b)) for a, b in zip(*np.nonzero(linked), strict=True)])
    found = nv.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()
    assert {q.vec_id: (q.n_links, q.component_id) for q in found} == {k: (int(linked[k].sum()), expected[k]) for k in range(160)} and linked.any()
