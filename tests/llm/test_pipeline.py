import __spark_entry__
import corpus_pipeline
from tests.llm.helpers import ENGLISH, GERMAN, near_components, prose, words
from tests.llm.test_linededup import _brute as dedup_brute


def _documents():
    docs = []
    for k in range(40):
        docs.append((k, prose(k, 60, [ENGLISH, GERMAN][k % 2]) + "\n" + prose(500 + k, 20), ["en", "de"][k % 2], f"s{k % 3}"))
    base = prose(77, 120)
    docs += [(100 + k, base.replace("the", "a", k), "en", "s0") for k in range(4)]  # near copies
    block = "\n".join(prose(900 + k, 18) for k in range(3))
    docs += [(200 + k, f"{prose(300 + k, 40)}\n{block}\n{prose(400 + k, 40)}", None, "s1") for k in range(3)]  # a repeated block
    docs += [(300, "123 456 !!!", "en", "s1"), (301, None, "en", "s1"), (302, "", "en", None), (303, prose(1, 60, ENGLISH), "en", "s2")]
    item = prose(5555, 30) + ". " + prose(5556, 8) + "."
    docs.append((400, f"{prose(8, 30)} {item} {prose(9, 30)}", "en", "s2"))
    docs.append((401, block, "en", "s2"))  # nothing but the repeated block
    return docs, item


def test_stages_against_brute_force(spark, tmp_path):
    docs, item = _documents()
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, prose(31, 40))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table, results = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, str(tmp_path)).write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        results[name] = {r.doc_id: r for r in table.collect()}
        if name != "mixing":
            assert table.columns == corpus_pipeline.COLUMNS

    text = {i: t for i, t, _, _ in docs if i not in (300, 301, 302)}
    assert set(results["language_id"]) == set(text)
    assert {results["language_id"][200 + k].lang for k in range(3)} == {"en"}
    cut = {i: t for i, t in dedup_brute(sorted(text.items())).items() if words(t)}
    assert {i: r.text for i, r in results["line_dedup"].items()} == cut
    assert 401 not in cut and all(r.n_chars == len(r.text) for r in results["line_dedup"].values())
    single = {i for i, (_, c) in near_components(sorted(cut.items()), 5, 80).items() if i == c}
    assert set(results["ngram_jaccard_join"]) == single and 103 not in single
    clean = {i for i in single if " ".join(words(item)) not in " ".join(words(cut[i]))}
    assert set(results["decontamination"]) == clean and 400 not in clean
    mixed = results["mixing"]
    sizes = {i: len(words(cut[i])) for i in clean}
    assert set(mixed) <= clean and all(r.size == sizes[i] and 1 <= r.copies <= 2 and r.taken == r.copies * r.size for i, r in mixed.items())
    for s in ("s0", "s1", "s2"):
        mine = [i for i in clean if results["decontamination"][i].source == s]
        taken = sum(mixed[i].taken for i in mine if i in mixed)
        target = next(mixed[i].target for i in mine if i in mixed)
        assert abs(taken - target) <= max(sizes[i] for i in mine) / 2 + 1e-6

    whole = {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {(i, r.taken) for i, r in mixed.items()}


def test_every_query_is_registered():
    names = __spark_entry__.queries()
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 13))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
