import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import rfc_from_path
from lectern.sources import pages, pagesource
from lectern.sources.pages import PAGE_MARK


@pytest.fixture
def folder(spark, tmp_path):
    r = random.Random(4)
    texts = {1: "", 22: "one page", 3261: PAGE_MARK.join("жé " * r.randrange(0, 60) + f"page {k}\n" for k in range(40)), 3262: PAGE_MARK + "second" + PAGE_MARK, 9000: "%%PAGE%% no mark\n%%PAGE%%" + PAGE_MARK + "%%PAGE%%"}
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for k, (rfc, text) in enumerate(texts.items()):
        (tmp_path / "in" / ("deep" if k % 2 else ".") / f"{'rfc' if k == 1 else 'RFC '}{rfc}.txt").write_text(text, newline="")
    (tmp_path / "in" / "notes.md").write_text("no document")
    return str(tmp_path / "in"), {(rfc, p, t) for rfc, text in texts.items() for p, t in enumerate(text.split(PAGE_MARK))}


def rows(df):
    found = [(r.rfc, r.pdf, r.text) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 20])
def test_pages_are_those_of_splitting_the_text_however_files_are_dealt(spark, folder, size, monkeypatch):
    path, expected = folder
    for where in (path, f"file://{path}"):
        assert rows(pagesource.read_pages(spark, where, bytesPerTask=max(size, 40))) == expected
    reader = pagesource.PageReader({"path": path, "bytesPerTask": str(size)})
    assert list(reader.pushFilters([pagesource.GreaterThanOrEqual(("pdf",), 0)])) == []
    monkeypatch.setattr(pagesource, "BLOCK", 3)
    assert {(rfc, p, t) for part in reader.partitions() for rfc, _, p, t in reader.read(part)} == expected
    marked = pages.read_marked_text(spark, f"{path}/RFC 3261.txt").select(rfc_from_path(F.regexp_replace("path", "txt$", "pdf")).alias("rfc"), "pdf", "text")
    assert rows(marked) == {x for x in expected if x[0] == 3261}


def test_filters_keep_files_closed_and_pages_unread(spark, folder):
    path, expected = folder
    source = pagesource.read_pages(spark, path, bytesPerTask=200)
    n = source.rdd.getNumPartitions()
    for condition, test, fewer in (
        ("rfc = 22", lambda r, p, t: r == 22, True),
        ("rfc in (22, 3262) and pdf >= 1", lambda r, p, t: r in (22, 3262) and p >= 1, True),
        ("rfc > 22 and rfc <= 3261 and pdf < 5", lambda r, p, t: 22 < r <= 3261 and p < 5, True),
        ("rfc = 3261 or pdf = 0", lambda r, p, t: r == 3261 or p == 0, False),
        ("text like 'page%' and rfc < 9000", lambda r, p, t: t.startswith("page") and r < 9000, True),
        ("rfc in (22, null)", lambda r, p, t: r == 22, True),
        ("rfc <=> 22", lambda r, p, t: r == 22, True),
        ("rfc = 5", lambda r, p, t: False, True),
    ):
        kept = source.where(condition)
        assert rows(kept) == {x for x in expected if test(*x)}, condition
        assert (kept.rdd.getNumPartitions() < n) == fewer, condition
        assert source.count() == len(expected)  # the filters of one plan are not those of the next
    plan = source.where("rfc = 3261 and pdf < 3")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Filter \(?.*(rfc|pdf)#\d+ (=|<)", plan), plan  # nothing is left for Spark to test
    assert source.where("rfc = 3261").rdd.getNumPartitions() > 5  # one file, several tasks


def test_odd_folders(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert pagesource.read_pages(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "manual.txt").write_text("x")
    with pytest.raises(Exception, match="no RFC number"):
        pagesource.read_pages(spark, str(tmp_path / "bad")).count()
    with pytest.raises(Exception, match="path is missing"):
        spark.read.format("lectern_pages").load().count()
    with pytest.raises(Exception, match="by read_pages"):
        spark.read.format("lectern_pages").load(str(tmp_path / "none")).count()
