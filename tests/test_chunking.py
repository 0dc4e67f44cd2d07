import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.functions import text as T
from lectern.operators import chunking as C
from lectern.operators import pagetext as P
from lectern.plans.corpus import build_chunks

WORDS = "signal route proxy header field method user agent server client request response dialog session timer".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def page(text, pdf=0, printed=None):
    return {"text": text, "pdf": pdf, "printed": printed}


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab \n\t", max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_windows_never_cut_words_and_cover_the_text(text, size, overlap):
    spans = C.window_spans(text, size, overlap)
    assert [s for s, _ in spans] == sorted({s for s, _ in spans})
    seen = set()
    for s, e in spans:
        seen.update(range(s, e))
        assert text[s:e].strip()
        assert s == 0 or text[s - 1].isspace()
        assert e == len(text) or text[e - 1].isspace() or text[e].isspace()
        if e - s > size:
            assert not any(c.isspace() for c in text[s : s + size])
    if overlap > max(map(len, text.split()), default=0):  # a shorter overlap can begin inside the word it should repeat
        assert all(k in seen for k, c in enumerate(text) if not c.isspace())


def test_windows_overlap_and_overshoot():
    text = prose(1, 600)
    spans = C.window_spans(text)
    assert all(0 < a[1] - b[0] <= C.OVERLAP for a, b in zip(spans, spans[1:], strict=False))
    assert C.window_spans("x" * 3000 + " y") == [(0, 3000), (3001, 3002)]
    assert C.window_spans(" \n ") == [] and C.window_spans("") == []


def test_windows_know_their_pages():
    pages = [page(prose(k, 120), k, k + 1 if k else None) for k in range(4)]
    chunks = C.fixed_windows(pages)
    assert chunks[0]["page_start"] == {"pdf": 0, "printed": None} and chunks[-1]["page_end"] == {"pdf": 3, "printed": 4}
    assert all(a["page_start"]["pdf"] <= a["page_end"]["pdf"] for a in chunks)
    assert C.fixed_windows([page(""), page("  ")]) == []


def document():
    return [
        page("\n".join(["1 Introduction", prose(1, 60), "", "7 apples are not a heading", prose(2, 20)])),
        page("\n".join(["1.1 Scope", "short", "2 Grammar", prose(3, 40), "token = ALPHA", "/ DIGIT", "; a remark", "", "Name     Value     Note", "aa       11        xx", "bb       22        yy", "", prose(4, 30)]), 1, 2),
        page("\n".join(["2.2 Skipped", "3 Long", prose(5, 900), "", prose(6, 200), "", prose(7, 200)]), 2, 3),
        page("\n".join(["Appendix A Examples", prose(8, 60), "Appendix A.1 More", prose(9, 60), "Appendix C Gone", prose(10, 10)]), 3, 4),
    ]


def test_sections_follow_the_outline():
    found = C.sections_of(document())
    assert [s.number for s in found] == ["1", "1.1", "2", "3", "A", "A.1"]
    assert any("7 apples" in b.text for b in found[0].blocks) and any("2.2 Skipped" in b.text for b in found[2].blocks)
    kinds = {b.kind: b.text for b in found[2].blocks}
    assert kinds["abnf"] == "token = ALPHA\n/ DIGIT\n; a remark" and kinds["table"].count("\n") == 2


def test_section_chunks_keep_their_bounds():
    chunks = C.section_chunks(document(), 5, "Title")
    assert chunks and all(c["text"].startswith("RFC 5 — Title · §") for c in chunks)
    assert all(c["n_chars"] == len(c["text"]) >= C.LEAST for c in chunks)
    long = [c for c in chunks if c["section_id"] == "3"]
    assert len(long) > 2 and all(c["n_chars"] <= C.MOST * 1.35 for c in long)
    for a, b in zip(long, long[1:], strict=False):  # the end of one is in the next
        assert a["text"][-40:].split()[-1] in b["text"][: int(0.25 * len(b["text"]))]
    everything = " ".join(c["text"] for c in chunks)
    assert all(s.line in everything for s in C.sections_of(document()))
    assert C.section_chunks([page("no headings at all")], 1, None) == []


def test_a_short_document_is_one_chunk():
    chunks = C.section_chunks([page("1 A\nx\n2 B\ny")], 1, None)
    assert len(chunks) == 1 and "2 B" in chunks[0]["text"] and chunks[0]["text"].startswith("RFC 1 — RFC 1 · §1 A")


def test_grammar_and_tables_are_not_cut():
    rows = "\n".join(f"row{k}      value{k}      note{k}" for k in range(200))
    chunks = C.section_chunks([page(f"1 T\n{prose(1, 50)}\n\n{rows}\n\n{prose(2, 50)}")], 1, None)
    assert any(c["text"].count("\n") >= 199 and c["n_chars"] > C.MOST for c in chunks)


def raw_pages():
    head, foot = "RFC 77            Calling Things            June 2002", "Someone     Standards Track     [Page {}]"
    contents = ["Contents", "1 Introduction ........ 2", "1 Introduction", "2", ""]
    return [
        "\n".join(["A cover", "1 Introduction . . . . . 2"]),
        "\n".join([head, *contents, foot.format(2)]),
        "\n".join([head, "1 Introduction", "  The case-", "insensitive text.", "", "", "Full Copyright Statement is quoted here before the references of it all", "Someone     Standards Track     [Page", "3]"]),
        "\n".join(["RFC 77            Calling Things            September", "2002", "2 More", "words", "Author's Address mentioned", foot.format(4), "after the foot"]),
        "\n".join([head, "3 References", "[1] A book", "4 Acknowledgements", "thanks", foot.format(5)]),
    ]


def cleaned(spark, *documents):
    docs = spark.createDataFrame([(k, [{"text": t, "pdf": i, "printed": None} for i, t in enumerate(pages)]) for k, pages in enumerate(documents)], f"rfc int, pages {P.PAGES}")
    return [r.pages for r in P.clean_pages(docs.repartition(2)).orderBy("rfc").collect()]


def test_furniture_body_tail_and_wraps(spark):
    whole, none = cleaned(spark, raw_pages(), ["nothing here"])
    assert [p["pdf"] for p in whole] == [2, 3, 4] and [p["printed"] for p in whole] == [3, 4, 5]
    assert whole[0]["text"].startswith("1 Introduction\nThe case-insensitive text.\n\nFull Copyright")
    assert "after the foot" in whole[1]["text"] and "2002" not in whole[1]["text"]
    assert whole[2]["text"] == "3 References\n[1] A book" and none == []


def test_the_tail_is_cut_by_three_preferences(spark):
    body, service = ["1 Scope", "words"], "Acknowledgements"
    after, late, anywhere, uncut = cleaned(
        spark,
        ["\n".join([*body, service, "more"]), "2 References\nbook", f"3 {service}\nthanks"],  # behind the last References
        ["\n".join([*body, service, "more"]), "2 More\nwords", "3 More\nwords", f"{service}\nthanks"],  # in the last quarter
        ["\n".join(body), f"2 More\n{service}\nthanks", "3 More", "4 More", "5 More\nend"],  # anywhere
        ["\n".join([service, *body]), "2 More\r\nwords\x0cpage"],  # none behind the body's start
    )
    assert [p["text"] for p in after] == ["1 Scope\nwords\nAcknowledgements\nmore", "2 References\nbook"]
    assert [p["text"] for p in late] == ["1 Scope\nwords\nAcknowledgements\nmore", "2 More\nwords", "3 More\nwords"]
    assert [p["text"] for p in anywhere] == ["1 Scope\nwords", "2 More"]
    assert [p["text"] for p in uncut] == ["1 Scope\nwords", "2 More\nwords\npage"]


def test_hyphens_and_blank_lines(spark):
    joined = {"a-\nb-\nC": "a-b-C", "--\nb": "--\nb", "a-\n1": "a-\n1", "x -\ny": "x -\ny", "the case-\n   in-\n\tsensitive": "the case-in-sensitive", "a-\n\nb": "a-\n\nb", "é-\nÜ": "é-Ü", "": ""}
    squeezed = {"\n \na\n\n\nb\n": "a\n\nb", "": "", "  ": "", "\n\n": "", "a\n \n\t\nb\n \n": "a\n\nb", "  a\nb": "  a\nb"}
    for cases, f in ((joined, T.rejoin_hyphens), (squeezed, T.squeeze_blank_lines)):
        rows = spark.createDataFrame(list(cases.items()), "x string, y string")
        assert [(r.x, r.z) for r in rows.select("x", "y", f(rows["x"]).alias("z")).where("not z <=> y").collect()] == []


def test_cleaned_pages_in_spark(spark):
    pages = [{"text": t, "pdf": k, "printed": None} for k, t in enumerate(raw_pages())]
    docs = spark.createDataFrame([(1, pages), (2, []), (3, None)], f"rfc int, pages {P.PAGES}")
    got = {r.rfc: r.pages for r in P.clean_pages(docs).collect()}
    assert got[1][0].text.startswith("1 Introduction\nThe case-insensitive text.\n\nFull Copyright") and not got[2] and not got[3]


def test_pages_to_chunks_in_spark(spark):
    rows = [(77, k, None, t) for k, t in enumerate(raw_pages())] + [(78, 0, None, "no body")]
    df = spark.createDataFrame(rows, "rfc int, pdf int, printed int, text string").repartition(3)
    chunks = build_chunks(df, "naive").collect()
    assert [c.chunk_id for c in chunks] == ["naive-77-0000"] and chunks[0].title == "Calling Things" and chunks[0].page_end.printed == 5
    sections = build_chunks(df, "structural").collect()
    assert [c.chunk_id for c in sections] == ["structural-77-0000"] and sections[0].section_path == "1 Introduction"


def test_a_task_holds_few_chunks_at_once(spark):
    """Ten times the documents in a batch, no more memory; a null array of pages gives none."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(f"rfc int, title string, i int, {C.CHUNK}"))
    run = C._rows(lambda pages, *_: C.fixed_windows(pages), schema)
    text = prose(1, 1500)

    def peak(n):
        batch = pa.RecordBatch.from_pylist([{"rfc": k, "title": None, "pages": None if k == 3 else [page(text)]} for k in range(n)], to_arrow_schema(StructType.fromDDL(f"rfc int, title string, pages {P.PAGES}")))
        tracemalloc.start()
        made = [len(b) for b in run([batch])]
        most = tracemalloc.get_traced_memory()[1] / 2**20
        tracemalloc.stop()
        return made, most

    each = len(C.window_spans(text))
    (few, _), (made, most) = peak(100), peak(2000)
    assert sum(few) == 99 * each and sum(made) == 1999 * each and max(made) < 2000 and most < 10, (max(made), most)
    docs = spark.createDataFrame([(k, "t", [page(text)]) for k in range(3)] + [(3, None, None), (4, None, [page(None)])], f"rfc int, title string, pages {P.PAGES}")
    assert C.chunk(docs.repartition(1), "naive").count() == 3 * each
    assert C.chunk(docs, "naive").schema.names == ["chunk_id", "method", "rfc", "title", "text", "n_chars", "section_id", "section_path", "page_start", "page_end", "start", "end"]
