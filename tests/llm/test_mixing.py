import pytest

from lectern.llm.mixing import mix_sources


def _targets(sizes, share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 2 * sizes[s] < level * weight[s]]
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def _docs():
    docs, i = [], 0
    for source, n, size in (("a", 40, 10), ("b", 30, 50), ("c", 200, 20), ("é", 5, 100), (None, 10, 30), ("empty", 3, 0)):
        for k in range(n):
            docs.append((i := i + 1, " ".join(["word"] * (size and size + k % 7)), source, "x"))
    return [*docs, (i + 1, None, "a", "y"), (i + 2, "long " * 20_000, "c", "z")]


def test_targets_budgets_and_reruns(spark):
    docs = _docs()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, Target string").repartition(5)
    found = mix_sources(df).collect()
    sizes = {}
    for _, t, s, _ in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = _targets(sizes)
    assert len(found) == len(docs)
    for s in sizes:
        rows = [r for r in found if r.source == s]
        assert {r.source_size for r in rows} == {sizes[s]} and rows[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in rows) - target[s]) <= max(r.size for r in rows) / 2 + 1e-6
        assert all(r.taken in (r.epochs * r.size, (r.epochs + 1) * r.size) and r.taken <= 2 * r.size for r in rows)
    again = mix_sources(df.repartition(2)).collect()
    assert sorted((r.doc_id, r.taken) for r in found) == sorted((r.doc_id, r.taken) for r in again)


def test_heavier_documents_are_taken_more_often(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'one two' as text", "if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', 'c')) as source", "if(id % 2 = 0, 4.0D, 1.0D) as w")
    rows = [r for r in mix_sources(df, weight=df["w"]).collect() if r.source == "c"]
    heavy = sum(r.copies for r in rows if r.doc_id % 2 == 0)
    light = sum(r.copies for r in rows if r.doc_id % 2 == 1)
    assert heavy > 1.3 * light


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 1)] * 3 + [(None, "a b", "s", 2), (None, None, None, 3)], "doc_id long, text string, source string, size int")
    assert len({r.taken for r in mix_sources(df).where("doc_id = 1").collect()}) == 1
    assert mix_sources(df).count() == 5 and mix_sources(df.limit(0)).count() == 0


def test_the_scale_of_weights_changes_nothing(spark):
    """Also where all weights are far from 1, keys are spread over many intervals."""
    df = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(id % 5 + 1 as int)) as text", "if(id % 3 = 0, 'a', 'b') as source", "1.0D as one", "0.002D as small", "500.0D as large")
    found = [{r.doc_id: r.copies for r in mix_sources(df, weight=df[c]).collect()} for c in ("one", "small", "large")]
    assert found[0] == found[1] == found[2] and len(set(found[0].values())) > 1
