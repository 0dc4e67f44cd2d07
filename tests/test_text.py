import hashlib

import pytest
from pyspark.sql import functions as F

from lectern.functions import rendering as R
from lectern.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "expected"), [("SIP-URI, Ünder 2x", ["sip", "uri", "nder", "2x"]), ("", []), ("Привет", [])])
def test_tokens(spark, text, expected):
    assert one(spark, T.tokens(F.col("t")), t=text) == expected


def test_squeezed_and_plain_words(spark):
    assert one(spark, T.squeezed(F.col("t")), t=" a\x0b\f b\n\nc ") == "a b c"
    assert one(spark, T.plain_words(F.col("t")), t="Ça, va?\n(oui)") == "ça va oui"
    assert one(spark, T.is_blank(F.col("t")), t=" \n\t") is True


def test_file_names(spark):
    assert one(spark, T.rfc_from_path(F.col("t")), t="/data/rfc 3261.PDF") == 3261
    with pytest.raises(Exception, match="cannot parse"):
        one(spark, T.rfc_from_path(F.col("t")), t="notes.pdf")


def test_cache_key_is_a_digest_of_model_and_text(spark):
    assert one(spark, T.cache_key("m", F.col("t")), t="é") == hashlib.sha256("m\0é".encode()).hexdigest()


@pytest.mark.parametrize(
    ("reply", "verdict"),
    [('{"verdict": "CORRECT"}', "correct"), ('x {"verdict": "refused"} y', "refused"), ('{"verdict": "odd"}', "wrong"), ("plainly incorrect", "correct"), ("it refused", "refused"), ("", "wrong"), ("{not json} wrong", "wrong")],
)
def test_verdicts(spark, reply, verdict):
    assert one(spark, T.parse_verdict(F.col("t")), t=reply) == verdict


def test_tool_arguments(spark):
    assert one(spark, T.tool_arguments(F.col("t")), t='{"query": "x", "rfc": 5}') == {"query": "x", "rfc": "5"}
    assert one(spark, T.tool_arguments(F.col("t")), t="[1]") == {} and one(spark, T.tool_arguments(F.col("t")), t="oops") == {}


@pytest.mark.parametrize(("answer", "n", "expected"), [("a [2] b [1][2] [7]", 3, [2, 1]), ("none", 3, [1]), ("[0] [9]", 3, [1]), ("[1]", 0, []), ("[99999999999]", 2, [1])])
def test_citation_numbers(spark, answer, n, expected):
    assert one(spark, T.citation_numbers(F.col("t"), F.col("n")), t=answer, n=n) == expected


def test_refusals(spark):
    assert one(spark, T.normal_refusal(F.col("t"), "NO ANSWER"), t="Sorry: NO ANSWER here [1]") == "NO ANSWER"


def test_markdown(spark):
    assert one(spark, T.strip_markdown(F.col("t")), t="# Head\n**bold** and __both__ `code`\n* item *it* a_b 2*3*4") == "Head\nbold and both code\n• item it a_b 2*3*4"


def test_amounts_costs_and_tables(spark):
    assert [one(spark, T.is_amount(F.col("v")), v=v) for v in (0.0, 1.5, -1.0, float("nan"), float("inf"))] == [True, True, False, False, False]
    assert one(spark, T.cost(F.lit(10), F.lit(5), F.lit(0.1), F.lit(None).cast("double"))) == pytest.approx(1.0)
    assert one(spark, T.percent(F.lit(0.125))) == "12.50%" and one(spark, T.dollars(F.lit(None).cast("double"))) == "—"
    assert [one(spark, T.last_quarter_start(F.lit(n))) for n in (1, 4, 7, 8)] == [1, 3, 6, 6]


def pieces(text, limit):
    return [text[a:b].rstrip() for a, b in R.cuts(text, limit)]


def test_split_text_prefers_paragraphs_lines_spaces():
    assert pieces("aa\n\nbb cc", 6) == ["aa", "bb cc"]
    assert pieces("aa bb\ncc", 6) == ["aa bb", "cc"]
    assert pieces("aaaaaaaaaa", 4) == ["aaaa", "aaaa", "aa"]
    assert pieces("", 4) == [] and pieces("  ab  ", 4) == ["ab"]
    text = " ".join(f"word{k}" for k in range(500))
    parts = pieces(text, 100)
    assert all(len(p) <= 100 for p in parts) and " ".join(parts) == text
    assert pieces("a\n\n\nb", 2) == ["a", "b"] and pieces(" \n\n ", 3) == [] and pieces("aaaa    bb", 4) == ["aaaa", "bb"] and pieces("aaa\n\nbb", 3) == ["aaa", "bb"]


def test_render_answer(spark):
    rows = [(1, "**Hi** there", [(3261, "9.1", 4), (3262, None, None)]), (2, "", []), (3, "x" * 35, [(1, None, 2)]), (4, None, [(1, "2", None)])]
    df = spark.createDataFrame(rows, "id int, text string, sources array<struct<rfc:int,section:string,page:int>>")
    got = {r.id: r.parts for r in df.select("id", R.render_answer(F.col("text"), F.col("sources"), 60).alias("parts")).collect()}
    assert got[1] == ["Hi there\n\nИсточники:\n— RFC 3261 §9.1 p.4\n— RFC 3262"]
    assert got[2] == [R.EMPTY] and got[3] == ["x" * 35 + "\n\nИсточники:\n— RFC 1 p.2"] and got[4] == ["Источники:\n— RFC 1 §2"]
    parts = {r.id: r.parts for r in df.select("id", R.render_answer(F.col("text"), F.col("sources"), 25).alias("parts")).collect()}
    assert parts[1] == ["Hi there\n\nИсточники:", "— RFC 3261 §9.1 p.4", "— RFC 3262"] and parts[2] == [R.EMPTY]
    assert parts[3] == ["x" * 25, "x" * 10, "Источники:\n— RFC 1 p.2"] and parts[4] == ["Источники:\n— RFC 1 §2"]


def test_hit_and_source_formats(spark):
    assert one(spark, T.format_hit(F.lit(1), F.lit(5), F.lit("9 X"), F.lit(3), F.lit("body"))) == "[1] RFC 5 · §9 X\nbody"
    assert one(spark, T.format_hit(F.lit(2), F.lit(5), F.lit(None).cast("string"), F.lit(3), F.lit("body"))) == "[2] RFC 5 · стр. 3\nbody"
    assert one(spark, T.context_prefix(F.lit(7), F.lit(None).cast("string"), F.lit("1"), F.lit("Scope"))) == "RFC 7 — RFC 7 · §1 Scope"
