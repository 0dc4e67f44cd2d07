import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.operators import chunking, tablefunctions


def by_rows(texts, size, overlap):
    f = tablefunctions.ChunkNaive()
    out = [x for k, t in enumerate(texts) for x in f.eval({"rfc": 7, "pdf": k, "printed": k + 3, "text": t}, size, overlap)]
    return [*out, *f.terminate()]


def whole(texts, size, overlap):
    chunks = chunking.fixed_windows([{"text": t, "pdf": k, "printed": k + 3} for k, t in enumerate(texts)], size, overlap)
    return [(7, i, c["start"], c["end"], c["n_chars"], c["text"], tuple(c["page_start"].values()), tuple(c["page_end"].values())) for i, c in enumerate(chunks)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\x1c", max_size=60)), max_size=8), st.integers(1, 20), st.integers(0, 19))
def test_windows_by_rows_equal_those_of_the_whole(texts, size, overlap):
    overlap = min(overlap, size - 1)
    assert by_rows(texts, size, overlap) == whole(texts, size, overlap)


def test_what_is_held_is_a_window_and_a_page():
    f, most = tablefunctions.ChunkNaive(), 0
    for k in range(2000):
        list(f.eval({"rfc": 1, "pdf": k, "printed": None, "text": "word " * 30}, 100, 20))
        most = max(most, len(f.held))
    assert most < 400 and len(f.pages) < 5


def test_in_sql(spark):
    tablefunctions.register(spark)
    texts = {1: ["a b c " * 20, None, "d" * 90 + " e"], 2: [" \n"], 3: ["x"], 4: ["one two " * 30]}
    rows = [(rfc, k, k + 3, t, "other") for rfc, ts in texts.items() for k, t in enumerate(ts)]
    spark.createDataFrame(rows, "rfc int, pdf int, printed int, text string, more string").repartition(5).createOrReplaceTempView("some_pages")
    found = spark.sql("SELECT * FROM chunk_naive(TABLE(some_pages) PARTITION BY rfc ORDER BY pdf, size => 40, overlap => 10) ORDER BY rfc, i").collect()
    expected = [(rfc, *x[1:]) for rfc, ts in texts.items() for x in whole(ts, 40, 10)]
    assert [(*r[:6], tuple(r[6]), tuple(r[7])) for r in found] == expected
    assert spark.sql("SELECT * FROM chunk_naive(TABLE(SELECT * FROM some_pages WHERE rfc > 9) PARTITION BY rfc ORDER BY pdf)").count() == 0
    for wrong, said in (("TABLE(SELECT rfc FROM some_pages) PARTITION BY rfc", "takes a table of pages"), ("TABLE(some_pages) PARTITION BY rfc, size => 5, overlap => 5", "overlap must be")):
        with pytest.raises(Exception, match=said):
            spark.sql(f"SELECT * FROM chunk_naive({wrong})").collect()
    spark.catalog.dropTempView("some_pages")
