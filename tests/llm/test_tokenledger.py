import base64
import os

import pytest
import tiktoken

from lectern.llm.tokenledger import PIECES, WORDS, Ledger, corpus_batches, count_tokens, read_vocabulary, signed

PATH = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
SCHEMA = "op string, source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long, old_tokens long, old_chars long"


def _as_dict(df):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars) for r in df.collect()}


def test_signed_changes(spark):
    rows = [("insert", "a", "en", "t", 1, 10, 50, None, None), ("insert", "a", "en", "t", 2, 20, 80, None, None), ("delete", "a", "en", "t", 1, 10, 50, None, None), ("revise", "a", "en", "t", 1, 12, 40, 20, 80), ("other", "a", "en", "t", 9, 9, 9, None, None), ("insert", None, None, "t", 1, None, 3, None, None)]
    assert _as_dict(signed(spark.createDataFrame(rows, SCHEMA))) == {("a", "en", "t"): (2, 12, 40), (None, None, "t"): (1, 0, 3)}


def test_commits_are_idempotent_and_survive_compaction(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    one = spark.createDataFrame([("insert", "a", "en", "t", 1, 10, 50, None, None), ("insert", "b", "en", "t", 1, 7, 9, None, None)], SCHEMA)
    two = spark.createDataFrame([("delete", "b", "en", "t", 1, 7, 9, None, None)], SCHEMA)
    assert ledger.totals().count() == 0
    assert ledger.commit("day/1", one) and not ledger.commit("day/1", one)
    assert _as_dict(ledger.totals()) == {("a", "en", "t"): (1, 10, 50), ("b", "en", "t"): (1, 7, 9)}
    ledger.compact()
    assert not ledger.commit("day/1", one)
    assert ledger.commit("day_1", two)  # another name, though it would look alike in a path
    assert _as_dict(ledger.totals()) == {("a", "en", "t"): (1, 10, 50)}
    ledger.compact()
    assert (tmp_path / "ledger/folded").iterdir() and ledger._held() == {"day_1"}
    assert not ledger.commit("day/1", one) and not ledger.commit("day_1", two)
    ledger.compact()
    assert ledger._held() == set() and not ledger.commit("day/1", one) and not ledger.commit("day_1", two)
    assert _as_dict(Ledger(spark, f"file://{tmp_path}/ledger").totals()) == {("a", "en", "t"): (1, 10, 50)}
    assert ledger.commit("empty", one.limit(0)) and _as_dict(ledger.totals()) == {("a", "en", "t"): (1, 10, 50)}


@pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")
def test_corpus_totals_against_recounting(spark, tmp_path):
    docs = [(1, "Some text here", "en", "a", 5), (2, "  Some text here\n", "en", "b", 5), (3, "Other words, 12 of them", "en", "a", 5), (4, None, "fr", None, 5), (5, "", None, "a", 5), (6, "déjà vu " * 3000, "fr", "a", 5), (3, "Other words, 12 of them", "en", "a", 5), (7, "Some text here", "en", "b", 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    raw = read_vocabulary(PATH)
    encoding = tiktoken.Encoding("x", pat_str=PIECES, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, special_tokens={})
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    batches = corpus_batches(df, {"v1": raw})
    for name in ("load", "revise-trimmed", "retract-copies", "load", "retract-copies"):
        ledger.commit(name, batches[name])
    expected, seen = {}, set()
    for _, text, lang, source, _n in sorted(docs, key=lambda d: d[0]):
        text = (text or "").strip(" \t\n\r\x0b\x0c")
        if text not in seen:
            seen.add(text)
            n = expected.setdefault((source, lang, "v1"), [0, 0, 0])
            n[0], n[1], n[2] = n[0] + 1, n[1] + len(encoding.encode_ordinary(text)), n[2] + len(text)
    assert _as_dict(ledger.totals()) == {k: tuple(v) for k, v in expected.items()}
    assert count_tokens(df.limit(0), {"v1": raw}).count() == 0


@pytest.mark.parametrize(
    "rows",
    [
        [(None, " one two three "), (2, "four five")],
        [(1, " one two three "), (1, "four five")],
        [(None, "same"), (None, " same"), (None, "same"), (None, None), (None, "")],
        [(7, "same "), (7, "same"), (8, "same"), (None, " same")],
    ],
)
def test_null_and_shared_ids_are_counted_once_each(spark, tmp_path, rows):
    docs = [(i, t, "abc"[k % 3], None if k % 2 else "en") for k, (i, t) in enumerate(rows)]
    batches = corpus_batches(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), {"w": WORDS})
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    for name, changes in batches.items():
        ledger.commit(name, changes)
    expected, seen = {}, set()
    for _, text, source, lang in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[2], d[3] or "")):
        text = (text or "").strip()
        if text not in seen:
            seen.add(text)
            n = expected.setdefault((source, lang, "w"), [0, 0, 0])
            n[0], n[1], n[2] = n[0] + 1, n[1] + len(text.split()), n[2] + len(text)
    assert _as_dict(ledger.totals()) == {k: tuple(v) for k, v in expected.items()}


def test_empty_corpus_and_extra_columns(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id int, text string, source string, lang string, n_chars string, tokens_w int, op string")
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    for name, changes in corpus_batches(docs, {"w": WORDS}).items():
        assert ledger.commit(name, changes)
    assert ledger.totals().count() == 0
    ledger.compact()
    some = spark.createDataFrame([(1, "a b", "s", "en", "x", 9, "delete")], docs.schema)
    assert ledger.commit("more", corpus_batches(some, {"w": WORDS})["load"])
    assert _as_dict(ledger.totals()) == {("s", "en", "w"): (1, 2, 3)}
