"""The engine's queries over the sample tables, each with the SQL that it is compared with."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.rendering import render_answer, split_text
from lectern.operators import bm25, chunking, embedding, evaluation, guards, pagetext, rag, reporting, sessions, tablefunctions
from lectern.operators.bm25store import StoredIndex
from lectern.operators.fusion import rrf
from lectern.operators.embedding import EmbeddingStore
from lectern.operators.vectors import vector_topk
from lectern.plans import hybrid as plans
from lectern.plans.corpus import build_chunks
from lectern.shared import cut, new_folder
from lectern.sources import jsonl
from lectern.sources.collection import Collection
from lectern.sources.jsonl import parse_journal, total_spend
from lectern.sources.sessionstore import SessionStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WS = r"[ \t\n\r\f\x0b]"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")


def items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def chats(spark, sf_dir):
    """The events as chat messages: the user is the chat, the value a cost."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("chat_id"), F.col("event_id").alias("seq"), t.alias("t"), F.col("props").alias("text"), F.col("value").alias("cost_usd"), "event_type")


# --- words ------------------------------------------------------------------------------------------------------------

TOK = "SELECT doc_id AS id, source, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents"


def bm25_sql(where: str = "TRUE", queries: str = "SELECT item_id AS qid, text FROM benchmark", k: int | None = 10) -> str:
    head = f"""
tok AS ({TOK}), kept AS (SELECT * FROM tok WHERE {where}), st AS (SELECT count(*) AS n, avg(len(ts)) AS avgl FROM kept),
post AS (SELECT id, len AS l, term, count(*) AS tf FROM (SELECT id, len(ts) AS len, unnest(ts) AS term FROM kept) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM ({queries})) GROUP BY ALL),
sc AS (SELECT qid, id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / avgl))) AS score
       FROM post JOIN q USING (term) JOIN df USING (term), st GROUP BY qid, id),
words AS (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM sc WHERE score > 0{'' if k is None else f' QUALIFY rank <= {k}'})"""
    return head.strip()


@query(f"""WITH t AS ({TOK}) SELECT id, len(ts)::INTEGER AS n_tokens, len(list_distinct(ts))::INTEGER AS n_terms FROM t""")
def tokenize_stats(spark, sf_dir):
    ts = T.tokens(F.col("text"))
    return corpus(spark, sf_dir).select("id", F.size(ts).alias("n_tokens"), F.size(F.array_distinct(ts)).alias("n_terms"))


@query(f"""WITH t AS ({TOK}) SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT id, unnest(ts) AS term FROM t) GROUP BY term""")
def doc_freq(spark, sf_dir):
    per = bm25.Bm25Index.build(corpus(spark, sf_dir)).postings
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH t AS ({TOK}) SELECT count(*) AS n, coalesce(avg(len(ts)), 0.0) AS avg_length FROM t")
def corpus_stats(spark, sf_dir):
    return bm25.Bm25Index.build(corpus(spark, sf_dir)).stats


@query(f"WITH {bm25_sql()} SELECT * FROM words")
def bm25_topk(spark, sf_dir):
    return bm25.bm25_topk(corpus(spark, sf_dir), items(spark, sf_dir))


@query(f"WITH {bm25_sql()} SELECT * FROM words")
def bm25_stored_topk(spark, sf_dir):
    """The same from a stored index: documents of even and of odd ids as two segments, written to the shared folder."""
    index = StoredIndex(spark, new_folder(spark, "bm25"))
    docs = corpus(spark, sf_dir).select("id", "text")
    odd = F.coalesce(F.col("id") % 2 == 1, F.lit(False))
    index.add(docs.where(~odd), "even")
    index.add(docs.where(odd), "odd")
    return index.search(items(spark, sf_dir))


@query(f"WITH {bm25_sql(where=chr(39).join(['source LIKE ', 'src1%', '']))} SELECT * FROM words")
def bm25_filtered(spark, sf_dir):
    """The filter comes before the statistics and the ranking."""
    return bm25.bm25_topk(corpus(spark, sf_dir).where(F.col("source").like("src1%")), items(spark, sf_dir))


# --- vectors ----------------------------------------------------------------------------------------------------------


def vector_sql(k: int, where: str = "TRUE", queries: str = "SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id % 50 = 0") -> str:
    return f"""
vs AS (SELECT q.qid, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, ({queries}) q WHERE {where}),
near AS (SELECT qid, id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, id) AS rank FROM vs QUALIFY rank <= {k})""".strip()


def _asked(spark, sf_dir):
    """The stated query set: every row whose id is divisible by 50."""
    return vectors(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("qid"), "vector")


@query(f"WITH {vector_sql(5)} SELECT * FROM near")
def vector_topk_all(spark, sf_dir):
    return vector_topk(vectors(spark, sf_dir), _asked(spark, sf_dir), 5)


@query(f"WITH {vector_sql(5, 'e.label = 3')} SELECT * FROM near")
def vector_topk_label(spark, sf_dir):
    return vector_topk(vectors(spark, sf_dir), _asked(spark, sf_dir), 5, where="label == 3")


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS to_first FROM embeddings")
def unit_vectors(spark, sf_dir):
    from lectern.operators.vectors import cosine, unit

    rows = vectors(spark, sf_dir)
    first = rows.where("id = 0").select(F.col("vector").alias("v0"))
    length = F.sqrt(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return rows.crossJoin(F.broadcast(first)).select("id", F.round(length, 6).alias("norm"), F.round(cosine(unit(F.col("vector")), F.col("v0")), 6).alias("to_first"))


# --- fusion and evaluation ----------------------------------------------------------------------------------------------
# Vectors and documents have no common ids; vec_id stands for doc_id here, and an item's vector is that of its number.

NEAR_SQL = vector_sql(10, queries="SELECT vec_id AS qid, embedding FROM embeddings JOIN benchmark ON vec_id = item_id")
FUSED = f"""WITH {bm25_sql()}, {NEAR_SQL},
ranks AS (SELECT qid, id, rank FROM words UNION ALL SELECT qid, id, rank FROM near),
fs AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM ranks GROUP BY qid, id),
hybrid AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM fs)"""
NORM = "trim(regexp_replace({}, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))"
CORRECT = f"""correct AS (SELECT b.item_id AS qid, d.doc_id AS id FROM (SELECT item_id, {NORM.format('text')} AS t FROM benchmark) b, (SELECT doc_id, {NORM.format('text')} AS t FROM documents) d WHERE contains(d.t, b.t))"""


def _rankings(spark, sf_dir):
    asked = vectors(spark, sf_dir).join(items(spark, sf_dir).select("qid"), F.col("id") == F.col("qid")).select("qid", "vector")
    return plans.hybrid(corpus(spark, sf_dir), items(spark, sf_dir), vectors(spark, sf_dir), asked)


@query(f"{FUSED} SELECT * FROM hybrid")
def hybrid_rrf(spark, sf_dir):
    return _rankings(spark, sf_dir)["hybrid"]


@query(f"WITH {CORRECT} SELECT * FROM correct")
def evidence_match(spark, sf_dir):
    return evaluation.evidence_matches(corpus(spark, sf_dir), items(spark, sf_dir))


_LABELLED = "labelled AS (SELECT 'words' AS source, qid, id, rank FROM words UNION ALL SELECT 'vector', qid, id, rank FROM near UNION ALL SELECT 'hybrid', qid, id, rank FROM hybrid)"
_FIRST = "firsts AS (SELECT s.source, b.item_id AS qid, min(c.rank) AS f FROM benchmark b CROSS JOIN (SELECT DISTINCT source FROM labelled) s LEFT JOIN (SELECT * FROM labelled JOIN correct USING (qid, id)) c ON c.qid = b.item_id AND c.source = s.source GROUP BY ALL)"
_RECALL = ", ".join(f"round(avg(CASE WHEN f <= {k} THEN 1.0 ELSE 0.0 END), 4) AS recall_{k}" for k in (1, 3, 5, 10))


@query(f"{FUSED}, {CORRECT}, {_LABELLED}, {_FIRST} SELECT source, count(*) AS n, {_RECALL}, round(avg(coalesce(1.0 / f, 0.0)), 4) AS mrr FROM firsts GROUP BY source")
def recall_mrr(spark, sf_dir):
    return plans.evaluate(_rankings(spark, sf_dir), evaluation.evidence_matches(corpus(spark, sf_dir), items(spark, sf_dir)), items(spark, sf_dir))


_LINE = " || ' ' || ".join(f"printf('%8.3f', recall_{k})" for k in (1, 3, 5, 10))


@query(f"""{FUSED}, {CORRECT}, {_LABELLED}, {_FIRST}, r AS (SELECT source, {_RECALL} FROM firsts GROUP BY source)
SELECT 0 AS place, 'source           @1       @3       @5      @10' AS line UNION ALL SELECT list_position(['vector', 'words', 'hybrid'], source)::INTEGER, rpad(source, 10, ' ') || ' ' || {_LINE} FROM r""")
def recall_lines(spark, sf_dir):
    """The comparison of the three rankings as it is printed."""
    return reporting.recall_lines(recall_mrr(spark, sf_dir))


@query(f"""{FUSED}, {CORRECT}, {_LABELLED}, top10 AS (SELECT * FROM labelled WHERE rank <= 10) SELECT s.source, b.item_id AS qid,
coalesce((SELECT string_agg(l.id::VARCHAR, ',' ORDER BY l.rank) FROM top10 l WHERE l.qid = b.item_id AND l.source = s.source), '') AS ranked,
coalesce((SELECT string_agg(c.id::VARCHAR, ',' ORDER BY c.id) FROM correct c WHERE c.qid = b.item_id), '') AS correct,
coalesce((SELECT string_agg(l.id::VARCHAR, ',' ORDER BY l.rank) FROM top10 l JOIN correct c ON c.qid = l.qid AND c.id = l.id WHERE l.qid = b.item_id AND l.source = s.source), '') AS correct_hits
FROM benchmark b CROSS JOIN (SELECT DISTINCT source FROM labelled) s""")
def per_question(spark, sf_dir):
    found = _rankings(spark, sf_dir)
    correct = evaluation.evidence_matches(corpus(spark, sf_dir), items(spark, sf_dir))
    rows = evaluation.per_question(evaluation.label_sources(found), correct, items(spark, sf_dir), sources=list(found))
    return rows.select("source", "qid", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("ranked", "correct", "correct_hits")])


_PLAIN = "trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_\\s]', ' ', 'g'), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))"


@query(f"""SELECT b.item_id, d.doc_id FROM (SELECT item_id, left({_PLAIN}, 120) AS s FROM benchmark) b JOIN (SELECT doc_id, {_PLAIN} AS t FROM documents) d ON contains(d.t, b.s)""")
def norm_prefix_match(spark, sf_dir):
    """Items whose first 120 characters, as plain words, occur in a document."""
    return evaluation.prefix_matches(corpus(spark, sf_dir), items(spark, sf_dir)).select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"))


# --- chunks -----------------------------------------------------------------------------------------------------------

def chunks_sql(size: int = 1000) -> str:
    return f"""WITH RECURSIVE c AS (
  SELECT doc_id, text, len(text) AS n, 0 AS s, 0 AS e, 0 AS step FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\r\\f\\x0b]')
  UNION ALL
  SELECT doc_id, text, n, CASE WHEN step % 2 = 0 THEN s ELSE nx END, CASE WHEN step % 2 = 0 THEN ce ELSE e END, step + 1 FROM (
    SELECT *, CASE WHEN s + {size} >= n THEN n WHEN len(regexp_extract(substr(text, s + 1, {size}), '^(?s:.*){WS}')) > 0 THEN s + len(regexp_extract(substr(text, s + 1, {size}), '^(?s:.*){WS}'))
           ELSE s + {size} + len(regexp_extract(substr(text, s + {size + 1}), '^[^ \\t\\n\\r\\f\\x0b]*')) END AS ce,
           greatest(e - 200, s + 1) + len(regexp_extract(substr(text, greatest(e - 200, s + 1) + 1), '^[^ \\t\\n\\r\\f\\x0b]*{WS}*')) AS nx FROM c
  ) WHERE (step % 2 = 0 AND s < n) OR (step % 2 = 1 AND e < n)
), k AS (SELECT doc_id, s, e, substr(text, s + 1, e - s) AS text FROM c WHERE step % 2 = 1 AND regexp_matches(substr(text, s + 1, e - s), '[^ \\t\\n\\r\\f\\x0b]')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS i FROM k)"""


def _chunked(spark, sf_dir, size=None):
    page = F.array(F.struct("text", F.lit(0).alias("pdf"), F.lit(1).alias("printed")))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("int").alias("rfc"), F.lit(None).cast("string").alias("title"), page.alias("pages"))
    return chunking.chunk(docs, "naive", size)


@query(f"{chunks_sql()} SELECT printf('naive-%d-%04d', doc_id, i) AS chunk_id, doc_id::INTEGER AS rfc, s::INTEGER AS start, e::INTEGER AS \"end\", text FROM numbered")
def naive_chunks(spark, sf_dir):
    return _chunked(spark, sf_dir).select("chunk_id", "rfc", "start", "end", "text")


@query(f"{chunks_sql(3400)}, b AS (SELECT least(len(text) // 250, 12)::INTEGER AS bucket FROM k) SELECT bucket, CASE WHEN bucket = 12 THEN '>= 3000' ELSE (bucket * 250)::VARCHAR || '-' || (bucket * 250 + 249)::VARCHAR END AS label, count(*) AS n FROM b GROUP BY ALL")
def chunk_histogram(spark, sf_dir):
    """Of windows long enough to meet every bucket, the open one included."""
    return chunking.length_histogram(_chunked(spark, sf_dir, 3400))


_SQUEEZED = "trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))"


@query(f"""WITH d AS (SELECT doc_id, source, {_SQUEEZED} AS t FROM documents), n AS (SELECT *, greatest(ceil(len(t) / 600.0), 1)::INTEGER AS n FROM d),
s AS (SELECT doc_id, source, k, n, (k + 1) || ' Section' AS line, trim('· ' || trim(substr(t, (k * 600 + 1)::INTEGER, 600))) AS para FROM n, unnest(range(0, n)) r(k)),
c AS (SELECT *, n > 1 AND len(line) + len(para) + 1 < 200 AS short, lead(line) OVER o AS line_b, lead(para) OVER o AS para_b FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
f AS (SELECT *, coalesce(len(line_b) + len(para_b) + 1 < 200, FALSE) AS host FROM c WHERE NOT short),
x AS (SELECT *, 'RFC ' || doc_id || ' — ' || source || ' · §' || line || chr(10) || line || chr(10) || para || CASE WHEN host THEN chr(10) || line_b || chr(10) || para_b ELSE '' END AS text FROM f)
SELECT printf('structural-%d-%04d', doc_id, k) AS chunk_id, doc_id::INTEGER AS rfc, (k + 1)::VARCHAR AS section_id, line AS section_path, len(text)::INTEGER AS n_chars, text, (k // 3 + 1)::INTEGER AS first_page, ((k + host::INTEGER) // 3 + 1)::INTEGER AS last_page FROM x""")
def structural_chunks(spark, sf_dir):
    """Sections of 600 characters each, three to a page; a short last one goes behind the one before it."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", T.squeezed(F.col("text")).alias("t"))
    n = F.greatest(F.ceil(F.length("t") / 600), F.lit(1)).cast("int")
    piece = lambda k: F.concat((k + 1).cast("string"), F.lit(" Section\n· "), F.btrim(F.substring(F.col("t"), k * 600 + 1, F.lit(600))))
    pieces = F.transform(F.sequence(F.lit(0), n - 1), piece)
    page = lambda p: F.struct(F.array_join(F.slice("pieces", p * 3 + 1, F.lit(3)), "\n").alias("text"), p.alias("pdf"), (p + 1).alias("printed"))
    docs = rows.withColumn("pieces", pieces).select(F.col("doc_id").cast("int").alias("rfc"), F.col("source").alias("title"), F.transform(F.sequence(F.lit(0), F.floor((F.size("pieces") - 1) / 3).cast("int")), page).alias("pages"))
    found = chunking.chunk(docs, "structural")
    return found.select("chunk_id", "rfc", "section_id", "section_path", "n_chars", "text", F.col("page_start.printed").alias("first_page"), F.col("page_end.printed").alias("last_page"))


@query("SELECT source, lang FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, f) = 1")
def mode_first_seen(spark, sf_dir):
    return pagetext.first_mode(table(spark, sf_dir, "documents"), "lang", F.col("doc_id"), "source")


@query("""SELECT doc_id, count(*) AS n_lines, count_if(len(t) >= 40) AS meaningful, count_if(len(t) BETWEEN 1 AND 80 AND NOT regexp_matches(t, '\\.{3,}|(?:\\.\\s){3,}')) AS headings, count_if(t = '') AS blank
FROM (SELECT doc_id, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)) GROUP BY doc_id""")
def line_predicates(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    x = F.col("x")
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if(T.is_meaningful(x)).alias("meaningful"), F.count_if(T.looks_like_heading(x, 80)).alias("headings"), F.count_if(T.is_blank(x)).alias("blank")
    )


@query("SELECT count(*) AS docs, sum(len(text))::BIGINT AS chars, (SELECT count_if(len(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 40) FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents)) AS long_lines FROM documents")
def corpus_totals(spark, sf_dir):
    lines = F.filter(F.split("text", "\n"), lambda x: T.is_meaningful(x))
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(F.size(lines)).cast("long").alias("long_lines"))


# --- records and reports ------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return reporting.latest(rows, F.struct("ts", "event_id"), "user_id", "event_type").select("user_id", "event_type", "event_id", "value")


_RECORDS = "r AS (SELECT source AS config, quality = 1 AS answerable, CASE WHEN toxic = 1 THEN 'refused' WHEN doc_id % 3 = 0 THEN 'wrong' WHEN doc_id % 5 > 0 THEN 'correct' END AS verdict, n_chars / 1000.0::DOUBLE AS cost_usd, doc_id FROM documents JOIN labels USING (doc_id))"
_REPORT = f"""WITH {_RECORDS} SELECT config, count(*) AS n, coalesce(count_if(answerable AND verdict = 'correct') / nullif(count_if(answerable), 0), 0.0) AS accuracy,
coalesce(count_if(NOT answerable AND verdict = 'refused') / nullif(count_if(NOT answerable), 0), 0.0) AS honest_refusals, coalesce(count_if(answerable AND verdict = 'refused') / nullif(count_if(answerable), 0), 0.0) AS false_refusals,
round(sum(cost_usd) / count(*), 9) AS cost_per_question, round(sum(cost_usd) / nullif(count_if(answerable AND verdict = 'correct'), 0), 9) AS cost_per_correct FROM r WHERE verdict IS NOT NULL GROUP BY config"""


def _records(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    verdict = F.when(F.col("toxic") == 1, "refused").when(F.col("doc_id") % 3 == 0, "wrong").when(F.col("doc_id") % 5 > 0, "correct")
    return joined.select(F.col("source").alias("config"), F.col("doc_id").cast("string").alias("qid"), (F.col("quality") == 1).alias("answerable"), verdict.alias("verdict"), (F.col("n_chars") / 1000.0).alias("cost_usd"))


@query(_REPORT)
def config_report(spark, sf_dir):
    """Labelled documents as answers, some not judged yet: the source is the configuration."""
    return reporting.config_report(_records(spark, sf_dir))


@query(f"SELECT config, printf('%.2f%%', accuracy * 100) AS accuracy, printf('$%.4f', round(cost_per_question::DECIMAL(18, 9), 4)::DOUBLE) AS cost_per_question, coalesce(printf('$%.4f', round(cost_per_correct::DECIMAL(18, 9), 4)::DOUBLE), '—') AS cost_per_correct, printf('%.0f', round_even(honest_refusals * 10, 0)) AS refused_of_10, printf('%.0f', round_even(false_refusals * 40, 0)) AS refused_of_40 FROM ({_REPORT})")
def report_table(spark, sf_dir):
    report = reporting.config_report(_records(spark, sf_dir))
    return reporting.presented(report, sorted(r["config"] for r in report.select("config").collect()))


@query("SELECT c.config, d.doc_id::VARCHAR AS qid FROM (SELECT DISTINCT source AS config FROM documents) c CROSS JOIN documents d WHERE NOT EXISTS (SELECT 1 FROM documents x JOIN labels l USING (doc_id) WHERE x.source = c.config AND x.doc_id = d.doc_id)")
def unfinished_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return reporting.unfinished(docs.select(F.col("source").alias("config")).distinct(), docs.select(F.col("doc_id").cast("string").alias("qid")), _records(spark, sf_dir))


@query("""WITH p AS (SELECT * FROM (VALUES ('click', 0.001::DOUBLE, 0.002::DOUBLE), ('view', 0.0005::DOUBLE, 0.0)) t(model, a, b))
SELECT event_id, round((event_id % 1000) * coalesce(a, 0.0) + (event_id % 77) * coalesce(b, 0.0), 9) AS cost_usd FROM events LEFT JOIN p ON model = event_type""")
def cost_estimate(spark, sf_dir):
    prices = spark.createDataFrame([("click", 0.001, 0.002), ("view", 0.0005, 0.0)], "model string, prompt double, completion double")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("prompt_tokens"), (F.col("event_id") % 77).alias("completion_tokens"))
    return reporting.with_costs(rows, F.broadcast(prices)).select("event_id", F.round("cost_usd", 9).alias("cost_usd"))


@query("SELECT event_type, count(*) AS calls, sum(event_id % 1000)::BIGINT AS prompt_tokens, sum(event_id % 77)::BIGINT AS completion_tokens, round(sum(value), 4) AS cost_usd FROM events GROUP BY event_type")
def usage_totals(spark, sf_dir):
    replies = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 1000).alias("prompt_tokens"), (F.col("event_id") % 77).alias("completion_tokens"), F.col("value").alias("cost_usd"))
    return reporting.usage_totals(replies, "event_type").withColumn("cost_usd", F.round("cost_usd", 4))


_JOURNAL = "SELECT CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 7 = 0 THEN '{\"ts\": \"2024' WHEN event_id % 13 = 0 THEN '{\"cost_usd\": \"NaN\"}' ELSE printf('{\"ts\": \"2024-01-01T00:00:00Z\", \"chat_id\": %d, \"cost_usd\": %d}', user_id, event_id) END AS value, user_id, event_id FROM events"


@query(f"SELECT user_id AS chat_id, sum(event_id)::DOUBLE AS total FROM ({_JOURNAL}) WHERE value LIKE '%chat_id%' GROUP BY user_id")
def journal_totals(spark, sf_dir):
    """Spending by chat from a journal with blank, partial and odd lines."""
    return _journal(spark, sf_dir).groupBy("chat_id").agg(F.sum("cost_usd").alias("total"))


@query(f"SELECT sum(event_id)::DOUBLE AS total FROM ({_JOURNAL}) WHERE value LIKE '%chat_id%'")
def journal_total_spend(spark, sf_dir):
    return total_spend(_journal(spark, sf_dir))


def _journal(spark, sf_dir):
    id_ = F.col("event_id")
    line = F.when(id_ % 11 == 0, "").when(id_ % 7 == 0, '{"ts": "2024').when(id_ % 13 == 0, '{"cost_usd": "NaN"}')
    line = line.otherwise(F.format_string('{"ts": "2024-01-01T00:00:00Z", "chat_id": %d, "cost_usd": %d}', "user_id", "event_id"))
    return parse_journal(table(spark, sf_dir, "events").select(line.alias("value")))


@query(f"WITH {_RECORDS} SELECT config, doc_id::VARCHAR AS qid, coalesce(verdict, CASE WHEN doc_id % 2 = 0 THEN 'refused' END) AS verdict FROM r")
def cached_verdicts(spark, sf_dir):
    """Verdicts that a cache of even documents fills in where the record has none."""
    records = _records(spark, sf_dir)
    cache = records.where("cast(qid AS bigint) % 2 = 0").select("config", "qid", F.lit("refused").alias("verdict"))
    return reporting.with_verdicts(records.select("config", "qid", "verdict"), cache).select("config", "qid", "verdict")


@query("""WITH k AS (SELECT doc_id, sha256('m' || chr(0) || 'passage: ' || text) AS key FROM documents), c AS (SELECT DISTINCT key FROM k WHERE doc_id % 3 = 0)
SELECT doc_id, key, key IN (SELECT key FROM c) AS hit FROM k""")
def cache_misses(spark, sf_dir):
    """All texts against a cache that holds those of every third document; equal texts share a key."""
    keyed = embedding.with_keys(table(spark, sf_dir, "documents").select("doc_id", "text"), "m")
    cache = keyed.where("doc_id % 3 = 0").select(F.lit("m").alias("model"), F.concat("key", F.lit("")).alias("key"))
    misses, hits = embedding.cache_misses(keyed, cache, "m"), embedding.cache_hits(keyed, cache, "m")
    return misses.withColumn("hit", F.lit(False)).unionByName(hits.withColumn("hit", F.lit(True))).select("doc_id", "key", "hit")


# --- chats ------------------------------------------------------------------------------------------------------------

CHAT_LIMIT, CHAT_HOURS, CHAT_LONGEST, CHAT_CAP = 2, 6, 9, 20000.0
_RATE = f"""WITH RECURSIVE ev AS (SELECT user_id AS chat_id, event_id AS seq, epoch_us(ts) / 1e6 AS t, props AS text, value AS cost_usd, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (
  SELECT chat_id, seq, t, text, cost_usd, i, TRUE AS accepted, [t] AS held FROM ev WHERE i = 1
  UNION ALL
  SELECT chat_id, seq, t, text, cost_usd, i, ok, CASE WHEN ok THEN list_append(live, t) ELSE live END FROM (
    SELECT e.*, list_filter(r.held, lambda x: e.t - x < {CHAT_HOURS * 3600.0}) AS live, len(list_filter(r.held, lambda x: e.t - x < {CHAT_HOURS * 3600.0})) < {CHAT_LIMIT} AS ok
    FROM r JOIN ev e ON e.chat_id = r.chat_id AND e.i = r.i + 1)
)"""


@query(f"{_RATE} SELECT chat_id, seq, t, accepted FROM r")
def rate_limit(spark, sf_dir):
    return guards.rate_limit(chats(spark, sf_dir), CHAT_LIMIT, CHAT_HOURS * 3600.0)


@query(f"SELECT event_id AS seq, round(coalesce(sum(value) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 4) AS before, round(coalesce(sum(value) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 6) < {CHAT_CAP} AS allowed FROM events")
def spend_cap(spark, sf_dir):
    rows = guards.spend_cap(chats(spark, sf_dir), CHAT_CAP, ["t", "seq"])
    return rows.select("seq", F.round("before", 4).alias("before"), "allowed")


VERDICTS_SQL = f"""{_RATE}, j AS (SELECT *, CASE WHEN NOT accepted THEN 'rate_limited' WHEN len(text) > {CHAT_LONGEST} THEN 'too_long' END AS verdict FROM r),
ok AS (SELECT chat_id, seq, CASE WHEN round(coalesce(sum(cost_usd) OVER (ORDER BY t, chat_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 6) < {CHAT_CAP} THEN 'ok' ELSE 'over_budget' END AS verdict FROM j WHERE verdict IS NULL),
verdicts AS (SELECT chat_id, seq, verdict FROM j WHERE verdict IS NOT NULL UNION ALL SELECT * FROM ok)"""


@query(f"{VERDICTS_SQL} SELECT * FROM verdicts")
def guard_pipeline(spark, sf_dir):
    return guards.guard_pipeline(chats(spark, sf_dir), CHAT_LIMIT, CHAT_LONGEST, CHAT_CAP, CHAT_HOURS * 3600.0).select("chat_id", "seq", "verdict")


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role <> 'system'").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("seq"), F.lit("append").alias("op"), "role", "text")


@query("SELECT conv_id AS chat_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM (SELECT * FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) GROUP BY conv_id")
def history_last_n(spark, sf_dir):
    rows = sessions.history(_turns(spark, sf_dir), 3)
    return rows.select("chat_id", F.array_join(F.transform("items", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("history"))


@query("""WITH e AS (SELECT user_id AS chat_id, event_id AS seq, event_type, props FROM events), z AS (SELECT chat_id, max(seq) AS z FROM e WHERE event_type = 'purchase' GROUP BY chat_id)
SELECT chat_id, seq, props AS text FROM e LEFT JOIN z USING (chat_id) WHERE event_type <> 'purchase' AND (z IS NULL OR seq > z)""")
def history_since_reset(spark, sf_dir):
    """Purchases stand for resets."""
    log = chats(spark, sf_dir).select("chat_id", "seq", F.when(F.col("event_type") == "purchase", "reset").otherwise("append").alias("op"), F.lit("user").alias("role"), "text")
    return sessions.since_reset(log).select("chat_id", "seq", "text")


_STORED = "CASE turn % 5 WHEN 0 THEN '[' || json_object('role', role, 'text', text) || ']' WHEN 1 THEN left('[' || json_object('role', role, 'text', text) || ']', 20) WHEN 2 THEN json_object('role', role, 'text', text)::VARCHAR WHEN 3 THEN '[{\"role\": \"' || role || '\"}]' ELSE '[' || json_object('role', role, 'text', text) || ', ' || json_object('role', 'user', 'text', role) || ']' END"


@query(f"""WITH r AS (SELECT conv_id AS chat_id, turn, {_STORED} AS items FROM conversations), j AS (SELECT chat_id, turn, CASE WHEN json_valid(items) THEN items ELSE 'null' END AS items FROM r),
l AS (SELECT chat_id, turn, CASE WHEN json_type(items) = 'ARRAY' THEN from_json(items, '[{{"role": "VARCHAR", "text": "VARCHAR"}}]') ELSE [] END AS l FROM j)
SELECT chat_id, turn, CASE WHEN len(list_filter(l, lambda x: x.role IS NULL OR x.text IS NULL)) > 0 THEN 0 ELSE len(l) END::INTEGER AS n, CASE WHEN len(list_filter(l, lambda x: x.role IS NULL OR x.text IS NULL)) = 0 THEN l[1].text END AS first FROM l""")
def stored_histories(spark, sf_dir):
    """Rows of a session store: lists of turns, cut ones, one turn without a list, turns without a text."""
    turn, one = F.col("turn") % 5, F.to_json(F.struct("role", "text"))
    two = F.to_json(F.struct(F.lit("user").alias("role"), F.col("role").alias("text")))
    raw = F.when(turn == 0, F.concat(F.lit("["), one, F.lit("]"))).when(turn == 1, F.substring(F.concat(F.lit("["), one), 1, 20)).when(turn == 2, one)
    raw = raw.when(turn == 3, F.concat(F.lit('[{"role": "'), "role", F.lit('"}]'))).otherwise(F.concat(F.lit("["), one, F.lit(", "), two, F.lit("]")))
    rows = sessions.stored(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), "turn", raw.alias("items")))
    return rows.select("chat_id", "turn", F.size("items").alias("n"), F.get("items", F.lit(0))["text"].alias("first"))


_OUTCOME = "['ok', 'timeout', 'error', 'reset', 'ok'][(len(text) % 5 + 1)::INTEGER]"


def _exchanges(spark, sf_dir):
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("ok", "timeout", "error", "reset", "ok")]), F.length("text") % 5 + 1)
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("seq"), F.col("text").alias("question"), F.upper("role").alias("answer"), outcome.alias("outcome"), (F.col("turn") * 0.5).alias("cost_usd"))


@query(f"""WITH t AS (SELECT conv_id AS chat_id, turn, text, upper(role) AS answer, {_OUTCOME} AS outcome FROM conversations), l AS (
SELECT chat_id, turn * 2 AS seq, 'append' AS op, 'user' AS role, text FROM t WHERE outcome IN ('ok', 'error') UNION ALL SELECT chat_id, turn * 2 + 1, 'append', 'assistant', answer FROM t WHERE outcome = 'ok'
UNION ALL SELECT chat_id, turn * 2, 'reset', NULL, NULL FROM t WHERE outcome = 'reset'),
z AS (SELECT chat_id, max(seq) AS z FROM l WHERE op = 'reset' GROUP BY chat_id)
SELECT chat_id, string_agg(role || ': ' || text, chr(10) ORDER BY seq) AS history FROM l LEFT JOIN z USING (chat_id) WHERE op = 'append' AND (z IS NULL OR seq > z) GROUP BY chat_id""")
def settled_histories(spark, sf_dir):
    """What is left of conversations whose questions were answered, timed out, failed or met a reset."""
    rows = sessions.history(sessions.settled(_exchanges(spark, sf_dir)), 1000)
    return rows.select("chat_id", F.array_join(F.transform("items", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("history"))


@query(f"SELECT conv_id AS chat_id, turn AS seq, CASE {_OUTCOME} WHEN 'error' THEN 0.01 ELSE turn * 0.5 END AS cost_usd FROM conversations WHERE {_OUTCOME} <> 'timeout'")
def settled_costs(spark, sf_dir):
    return sessions.costs(_exchanges(spark, sf_dir))


_COMMAND = "CASE event_id % 4 WHEN 0 THEN '/' || event_type WHEN 1 THEN '/reset' || substr(props, 2, event_id % 9) WHEN 2 THEN event_type || ' /start' ELSE '/' || left('start help', event_id % 11) || ' ' || props END"


@query(f"""WITH m AS (SELECT event_id AS seq, {_COMMAND} AS text FROM events), w AS (SELECT seq, text, regexp_extract(text, '^/([A-Za-z0-9_]+)', 1) AS word FROM m)
SELECT seq, CASE WHEN word IN ('start', 'help') THEN 'onboarding' WHEN word = 'reset' THEN 'reset' WHEN left(text, 1) = '/' THEN 'ignored' ELSE 'question' END AS route FROM w""")
def command_routes(spark, sf_dir):
    """Messages made of the events' types and properties, some of them whole or cut commands."""
    i = F.col("event_id")
    text = F.when(i % 4 == 0, F.concat(F.lit("/"), "event_type")).when(i % 4 == 1, F.concat(F.lit("/reset"), F.expr("substring(props, 2, cast(event_id % 9 as int))"))).when(i % 4 == 2, F.concat("event_type", F.lit(" /start")))
    text = text.otherwise(F.concat(F.lit("/"), F.expr("left('start help', cast(event_id % 11 as int))"), F.lit(" "), "props"))
    return sessions.routes(table(spark, sf_dir, "events").select(i.alias("seq"), text.alias("text"))).select("seq", "route")


# --- answers ------------------------------------------------------------------------------------------------------------

_REPLY = "text || ' [' || (len(text) % 7)::VARCHAR || '] and [' || turn::VARCHAR || '], [' || (conv_id % 5)::VARCHAR || '] [' || (len(text) % 7)::VARCHAR || ']'"


@query(f"""WITH a AS (SELECT conv_id, turn, regexp_extract_all({_REPLY}, '\\[(\\d+)\\]', 1) AS l FROM conversations),
v AS (SELECT conv_id, turn, i, TRY_CAST(l[i] AS INTEGER) AS n FROM a, unnest(range(1, len(l) + 1)) r(i)),
f AS (SELECT conv_id, turn, n, min(i) AS i FROM v WHERE n BETWEEN 1 AND 3 GROUP BY ALL)
SELECT a.conv_id, a.turn, coalesce((SELECT string_agg(n::VARCHAR, ',' ORDER BY i) FROM f WHERE f.conv_id = a.conv_id AND f.turn = a.turn), '1') AS cited FROM a""")
def citations(spark, sf_dir):
    """Citations of three hits in answers made of turns and numbers that come from them."""
    size = (F.length("text") % 7).cast("string")
    parts = ["text", F.lit(" ["), size, F.lit("] and ["), F.col("turn").cast("string"), F.lit("], ["), (F.col("conv_id") % 5).cast("string"), F.lit("] ["), size, F.lit("]")]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(*parts).alias("answer"))
    return rows.select("conv_id", "turn", F.array_join(T.citation_numbers(F.col("answer"), F.lit(3)).cast("array<string>"), ",").alias("cited"))


@query("SELECT event_id, concat_ws(' ', 'RFC ' || user_id::VARCHAR, CASE WHEN event_id % 2 = 0 THEN '§' || (event_id % 9)::VARCHAR || '.1' END, CASE WHEN event_id % 3 = 0 THEN 'p.' || (event_id % 50)::VARCHAR END) AS source FROM events")
def sources_format(spark, sf_dir):
    i = F.col("event_id")
    section = F.when(i % 2 == 0, F.concat((i % 9).cast("string"), F.lit(".1")))
    return table(spark, sf_dir, "events").select("event_id", T.format_source(F.col("user_id"), section, F.when(i % 3 == 0, i % 50)).alias("source"))


_WORDS = "['Correct', 'WRONG', 'refused', 'maybe', 'incorrect', '']"
_JUDGED = f"""CASE event_id % 5 WHEN 0 THEN '```json' || chr(10) || '{{"verdict": "' || {_WORDS}[(event_id // 5 % 6 + 1)::INTEGER] || '", "why": "' || event_type || '"}}' || chr(10) || '```'
WHEN 1 THEN 'it is ' || {_WORDS}[(event_id // 7 % 6 + 1)::INTEGER] || ', not ' || {_WORDS}[(event_id // 11 % 6 + 1)::INTEGER] WHEN 2 THEN props || ' ' || {_WORDS}[(event_id // 13 % 6 + 1)::INTEGER]
WHEN 3 THEN '{{broken ' || {_WORDS}[(event_id // 17 % 6 + 1)::INTEGER] || '}}' ELSE event_type END"""


@query(f"""WITH r AS (SELECT event_id, {_JUDGED} AS reply FROM events), j AS (SELECT event_id, lower(reply) AS low, regexp_extract(reply, '(?s)\\{{.*\\}}') AS body FROM r),
n AS (SELECT *, CASE WHEN json_valid(body) THEN lower(json_extract_string(body, '$.verdict')) END AS named FROM j)
SELECT event_id, CASE WHEN named IN ('correct', 'wrong', 'refused') THEN named WHEN contains(low, 'correct') THEN 'correct' WHEN contains(low, 'wrong') THEN 'wrong' WHEN contains(low, 'refused') THEN 'refused' ELSE 'wrong' END AS verdict FROM n""")
def verdict_parse(spark, sf_dir):
    """Replies of a judge: fenced JSON, sentences, JSON without a verdict, broken JSON, other words."""
    i, words = F.col("event_id"), F.array(*[F.lit(x) for x in ("Correct", "WRONG", "refused", "maybe", "incorrect", "")])
    word = lambda k: F.element_at(words, (F.floor(i / k) % 6 + 1).cast("int"))
    reply = F.when(i % 5 == 0, F.concat(F.lit('```json\n{"verdict": "'), word(5), F.lit('", "why": "'), "event_type", F.lit('"}\n```')))
    reply = reply.when(i % 5 == 1, F.concat(F.lit("it is "), word(7), F.lit(", not "), word(11))).when(i % 5 == 2, F.concat("props", F.lit(" "), word(13)))
    reply = reply.when(i % 5 == 3, F.concat(F.lit("{broken "), word(17), F.lit("}"))).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", T.parse_verdict(reply).alias("verdict"))


_PARTS = f"""WITH RECURSIVE p AS (SELECT doc_id, 0 AS i, NULL::VARCHAR AS part, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS rest FROM documents
UNION ALL SELECT doc_id, i + 1, CASE WHEN len(rest) <= 300 THEN rest ELSE trim(left(rest, at), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END,
CASE WHEN len(rest) <= 300 THEN NULL ELSE nullif(trim(substr(rest, at + 1), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '') END FROM (
  SELECT *, CASE WHEN len(regexp_extract(left(rest, 302), '^(?s:(.{{1,300}})\\n\\n)', 1)) > 0 AND len(regexp_extract(left(rest, 301), '^(?s:(.{{1,299}})\\n\\n)', 1)) > 0 THEN len(regexp_extract(left(rest, 301), '^(?s:(.{{1,299}})\\n\\n)', 1))
    WHEN len(regexp_extract(left(rest, 301), '^(?s:(.{{1,300}})\\n)', 1)) > 0 THEN len(regexp_extract(left(rest, 301), '^(?s:(.{{1,300}})\\n)', 1))
    WHEN len(regexp_extract(left(rest, 301), '^(?s:(.{{1,300}}) )', 1)) > 0 THEN len(regexp_extract(left(rest, 301), '^(?s:(.{{1,300}}) )', 1)) ELSE 300 END AS at FROM p WHERE rest IS NOT NULL))
SELECT doc_id, (i - 1)::INTEGER AS i, part FROM p WHERE i > 0"""


@query(_PARTS.replace(" at)", " cut_at)").replace("at + 1", "cut_at + 1").replace("AS at ", "AS cut_at "))
def message_parts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split_text(F.col("text"), 300)).alias("i", "part"))


_MARKED = "'## ' || source || chr(10) || '* *' || lang || '* and **' || doc_id || '** __b__ `' || n_chars || '`' || chr(10) || text"
_PLAIN_TEXT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '\*\*([^*]+)\*\*|__([^_]+)__', '\1\2', 'g'), '`([^`]*)`', '\1', 'g'), '(?m)^\s{0,3}#{1,6}\s+', '', 'g'), '(?m)^(\s*)\*\s+', '\1• ', 'g'), '(^|[^\w*])\*([^*\n]+)\*([^\w*]|$)', '\1\2\3', 'g')"""


@query(f"WITH d AS (SELECT doc_id, {_MARKED} AS m FROM documents) SELECT doc_id, {_PLAIN_TEXT} AS plain FROM d")
def strip_markdown(spark, sf_dir):
    """Texts with a heading, a bullet, italics, bold and code put in front."""
    parts = [F.lit("## "), "source", F.lit("\n* *"), "lang", F.lit("* and **"), F.col("doc_id").cast("string"), F.lit("** __b__ `"), F.col("n_chars").cast("string"), F.lit("`\n"), "text"]
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_markdown(F.concat(*parts)).alias("plain"))


@query("""SELECT conv_id, string_agg(printf('[%d] RFC %d', r, conv_id) || CASE WHEN turn % 2 = 0 THEN ' · §' || turn::VARCHAR ELSE ' · стр. ' || turn::VARCHAR END || chr(10) || text, chr(10) || chr(10) ORDER BY r) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 3 GROUP BY conv_id""")
def contexts(spark, sf_dir):
    """The first three turns of a conversation as numbered context blocks."""
    from lectern.operators.rag import contexts as build

    turns = table(spark, sf_dir, "conversations").withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("rank <= 3")
    even = F.col("turn") % 2 == 0
    hits = turns.select(F.col("conv_id").alias("qid"), "rank", F.col("conv_id").alias("rfc"), F.when(even, F.col("turn").cast("string")).alias("section_path"), F.when(~even, F.col("turn")).alias("page"), "text")
    return build(hits).withColumnRenamed("qid", "conv_id")


@query("""WITH q AS (SELECT doc_id AS id, quality = 1 AS answerable FROM documents JOIN labels USING (doc_id)) SELECT id, answerable FROM q QUALIFY row_number() OVER (PARTITION BY answerable ORDER BY id) <= CASE WHEN answerable THEN 10 ELSE 2 END""")
def head_of_each(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("answerable"))
    return reporting.head_of_each(rows, 10)


# --- text and pages -------------------------------------------------------------------------------------------------------

_CASED = "[\\p{Lu}\\p{Ll}]"
_WRAPPED = "replace(replace(text, ' th', '-' || chr(10) || '  th'), '. ', '.' || chr(10) || ' ' || chr(10) || chr(10))"
_JOINED = f"regexp_replace(regexp_replace(w, '([\\p{{L}}\\p{{N}}]-)\\n[ \\t]*({_CASED})', '\\1\\2', 'g'), '([\\p{{L}}\\p{{N}}]-)\\n[ \\t]*({_CASED})', '\\1\\2', 'g')"


def _wrapped(spark, sf_dir):
    text = F.replace(F.replace(F.col("text"), F.lit(" th"), F.lit("-\n  th")), F.lit(". "), F.lit(".\n \n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query(f"WITH d AS (SELECT doc_id, {_WRAPPED} AS w FROM documents) SELECT doc_id, {_JOINED} AS text FROM d")
def rejoined_hyphens(spark, sf_dir):
    """Texts whose words were cut at line ends, joined again."""
    return _wrapped(spark, sf_dir).select("doc_id", T.rejoin_hyphens(F.col("text")).alias("text"))


@query(f"""WITH d AS (SELECT doc_id, {_WRAPPED} AS w FROM documents), l AS (SELECT doc_id, i, x, trim(x, ' ' || chr(9) || chr(13)) = '' AS blank FROM (SELECT doc_id, unnest(string_split(w, chr(10))) AS x, generate_subscripts(string_split(w, chr(10)), 1) AS i FROM d)),
k AS (SELECT doc_id, i, x, blank, lag(blank) OVER (PARTITION BY doc_id ORDER BY i) AS before, min(CASE WHEN NOT blank THEN i END) OVER (PARTITION BY doc_id) AS a, max(CASE WHEN NOT blank THEN i END) OVER (PARTITION BY doc_id) AS b FROM l)
SELECT d.doc_id, coalesce((SELECT string_agg(CASE WHEN blank THEN '' ELSE x END, chr(10) ORDER BY i) FROM k WHERE k.doc_id = d.doc_id AND i BETWEEN a AND b AND NOT (blank AND before)), '') AS text FROM d""")
def squeezed_lines(spark, sf_dir):
    """One blank line for a run of them."""
    return _wrapped(spark, sf_dir).select("doc_id", T.squeeze_blank_lines(F.col("text")).alias("text"))


@query("""WITH d AS (SELECT doc_id, source, len(string_split(text, chr(10))) AS n FROM documents)
SELECT doc_id, doc_id::INTEGER AS rfc, 'RFC ' || doc_id || ' — ' || coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), 'RFC ' || doc_id) || ' · §' || n || ' Lines' AS prefix, (n - n // 4)::INTEGER AS last_quarter FROM d""")
def document_heads(spark, sf_dir):
    """The number in a file name, the prefix of a chunk, and where the last quarter of the lines begins."""
    n = F.size(F.split("text", "\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("title"), n.alias("n"), T.rfc_from_path(F.concat(F.lit("/x/RFC%20"), F.col("doc_id").cast("string"), F.lit(".pdf"))).alias("rfc"))
    return rows.select("doc_id", "rfc", T.context_prefix(F.col("rfc"), F.col("title"), F.col("n").cast("string"), F.lit("Lines")).alias("prefix"), T.last_quarter_start(F.col("n")).alias("last_quarter"))


_TRIMMED = "trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


_CLEANED = f"""WITH l AS (SELECT doc_id, i, {_TRIMMED} AS x FROM (SELECT doc_id, unnest(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10))) AS x, generate_subscripts(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10)), 1) AS i FROM documents)),
k AS (SELECT *, lag(x = '') OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l),
body AS (SELECT doc_id, rtrim('1 Introduction' || chr(10) || string_agg(x, chr(10) ORDER BY i) FILTER (NOT (x = '' AND coalesce(before, FALSE))), chr(10)) AS text FROM k GROUP BY doc_id)
SELECT doc_id::INTEGER AS rfc, 1 AS pdf, (doc_id % 90 + 2)::INTEGER AS printed, text FROM body
UNION ALL SELECT doc_id::INTEGER, 2, (doc_id % 90 + 3)::INTEGER, '2 References' || chr(10) || '[1] ' || source FROM documents"""


def _raw_pages(spark, sf_dir):
    """(rfc, pages): documents as three pages with running heads, feet, a table of contents and a service part."""
    line = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    i = F.col("doc_id")
    head, foot = line("RFC ", i.cast("string"), "      Some Title      June 2002\n"), lambda k: line("\nSomeone      Standards Track      [Page", F.when(i % 2 == 0, " ").otherwise("\n"), (i % 90 + k).cast("string"), "]")
    body = F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n"))
    texts = [
        line("A cover\n1 Introduction ........ 2\n1 Introduction\n2"),
        line(head, "1 Introduction\n", body, foot(2)),
        line(head, "2 References\n[1] ", F.col("source"), "\nAuthors' Addresses\nsomewhere", foot(3)),
    ]
    pages = F.array(*[F.struct(t.alias("text"), F.lit(k).alias("pdf"), F.lit(None).cast("int").alias("printed")) for k, t in enumerate(texts)])
    docs = table(spark, sf_dir, "documents").select(i.cast("int").alias("rfc"), pages.alias("pages"))
    return docs


@query(_CLEANED)
def cleaned_pages(spark, sf_dir):
    """Pages cut to the body of their document."""
    docs = _raw_pages(spark, sf_dir)
    # outer: else Spark tests beforehand, by cleaning once more, whether there are pages
    return pagetext.clean_pages(docs).select("rfc", F.inline_outer("pages")).where("pdf is not null").select("rfc", "pdf", "printed", "text")


# --- answers of tools and models --------------------------------------------------------------------------------------------

_RAW = "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN ' ' || props || chr(10) WHEN 2 THEN left(props, 5) WHEN 3 THEN '[' || props || ']' ELSE event_type END"


@query(f"""WITH r AS (SELECT event_id, CASE WHEN json_valid({_RAW}) THEN {_RAW} ELSE 'null' END AS raw FROM events), o AS (SELECT event_id, CASE WHEN json_type(raw) = 'OBJECT' THEN raw ELSE '{{}}' END AS raw FROM r)
SELECT event_id, json_extract_string(raw, '$.k') AS k, len(json_keys(raw))::INTEGER AS n FROM o""")
def tool_arguments(spark, sf_dir):
    """Arguments of tool calls: objects, objects with space around, cut ones, lists, words."""
    i, props = F.col("event_id"), F.col("props")
    raw = F.when(i % 5 == 0, props).when(i % 5 == 1, F.concat(F.lit(" "), props, F.lit("\n"))).when(i % 5 == 2, F.expr("left(props, 5)")).when(i % 5 == 3, F.concat(F.lit("["), props, F.lit("]"))).otherwise(F.col("event_type"))
    found = T.tool_arguments(raw)
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(found, F.lit("k")).alias("k"), F.size(F.map_keys(found)).alias("n"))


@query("SELECT conv_id, turn, 'be brief' AS system, CASE WHEN turn % 3 = 0 THEN '(пусто)' ELSE 'context ' || role END || chr(10) || chr(10) || text AS asked FROM conversations")
def model_messages(spark, sf_dir):
    """Questions with and without a context, as messages to a model."""
    context = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("context "), "role")).when(F.col("turn") % 3 == 2, F.concat(F.lit("context "), "role")).when(F.col("turn") % 2 == 0, "")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", rag.messages(F.col("text"), context, "be brief").alias("m"))
    return rows.select("conv_id", "turn", F.get("m", F.lit(0))["content"].alias("system"), F.get("m", F.lit(1))["content"].alias("asked"))


@query(r"""WITH h AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, role AS chunk_id, text FROM conversations),
n AS (SELECT conv_id, max(rank) AS n, string_agg(text, ' ' ORDER BY rank) AS answer FROM h GROUP BY conv_id),
a AS (SELECT conv_id, n, CASE WHEN conv_id % 7 = 0 THEN answer || ' NO ANSWER' ELSE answer || ' [' || (conv_id % 4) || '] [' || (len(answer) % 9) || '] [1]' END AS answer FROM n),
v AS (SELECT conv_id, i, l[i]::INTEGER AS rank FROM (SELECT conv_id, n, regexp_extract_all(answer, '\[(\d+)\]', 1) AS l FROM a WHERE NOT contains(answer, 'NO ANSWER')), unnest(range(1, len(l) + 1)) r(i) WHERE TRY_CAST(l[i] AS INTEGER) BETWEEN 1 AND n),
f AS (SELECT conv_id, rank, min(i) AS i FROM v GROUP BY ALL), j AS (SELECT f.conv_id, f.i, f.rank, chunk_id, text FROM f JOIN h ON h.conv_id = f.conv_id AND h.rank = f.rank)
SELECT conv_id AS qid, chunk_id, rank::INTEGER AS rank, text FROM j QUALIFY row_number() OVER (PARTITION BY conv_id, chunk_id ORDER BY i) = 1""")
def cited_hits(spark, sf_dir):
    """The turns of a conversation as hits, one document a role, and an answer that cites some of them or refuses."""
    turns = table(spark, sf_dir, "conversations")
    hits = turns.select(F.col("conv_id").alias("qid"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("rank"), F.col("role").alias("chunk_id"), "text")
    whole = hits.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("t"))
    named = F.concat("t", F.lit(" ["), (F.col("qid") % 4).cast("string"), F.lit("] ["), (F.length("t") % 9).cast("string"), F.lit("] [1]"))
    answers = whole.select("qid", F.when(F.col("qid") % 7 == 0, F.concat("t", F.lit(" NO ANSWER"))).otherwise(named).alias("answer"))
    return rag.cited(answers, hits, "NO ANSWER").select("qid", "chunk_id", "rank", "text")


_ANSWER = f"(SELECT conv_id, turn, {_PLAIN_TEXT} AS text FROM (SELECT conv_id, turn, '**' || role || '** ' || text || ' `' || conv_id || '`' AS m FROM conversations))"
_ANSWER_PARTS = _PARTS[: _PARTS.rindex("SELECT doc_id")].replace("doc_id", "conv_id, turn").replace("FROM documents", f"FROM {_ANSWER}").replace(" at)", " cut_at)").replace("at + 1", "cut_at + 1").replace("AS at ", "AS cut_at ")


@query(f"""{_ANSWER_PARTS}, l AS (SELECT conv_id, turn, list(part ORDER BY i) FILTER (part <> '') AS ps FROM p WHERE i > 0 GROUP BY conv_id, turn),
c AS (SELECT *, CASE WHEN turn % 2 = 1 THEN 'Источники:' || chr(10) || '— RFC ' || conv_id || ' §' || turn || '.1' || CASE WHEN turn % 3 = 0 THEN '' ELSE ' p.' || turn END END AS cited FROM l),
j AS (SELECT conv_id, turn, CASE WHEN cited IS NULL THEN ps WHEN len(ps[-1]) + 2 + len(cited) <= 300 THEN ps[:-2] || [ps[-1] || chr(10) || chr(10) || cited] ELSE ps || [cited] END AS ps FROM c)
SELECT conv_id, turn, array_to_string(ps, '|') AS rendered, len(ps)::INTEGER AS parts FROM j""")
def rendered_answers(spark, sf_dir):
    """Answers with markup, and with sources on every other turn, in messages of at most 300 characters."""
    turn = F.col("turn")
    source = F.struct(F.col("conv_id").cast("int").alias("rfc"), F.concat(turn.cast("string"), F.lit(".1")).alias("section"), F.when(turn % 3 > 0, turn.cast("int")).alias("page"))
    none = F.array().cast("array<struct<rfc:int,section:string,page:int>>")
    text = F.concat(F.lit("**"), "role", F.lit("** "), "text", F.lit(" `"), F.col("conv_id").cast("string"), F.lit("`"))
    rows = table(spark, sf_dir, "conversations")
    parts = render_answer(text, F.when(turn % 2 == 1, F.array(source)).otherwise(none), 300)
    return rows.select("conv_id", "turn", F.array_join(parts, "|").alias("rendered"), F.size(parts).alias("parts"))


@query("""WITH q AS (SELECT vec_id AS qid, embedding, CASE WHEN vec_id % 100 = 0 THEN label END AS rfc FROM embeddings WHERE vec_id % 50 = 0),
vs AS (SELECT q.qid, e.vec_id AS id, e.label, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e JOIN q ON q.rfc IS NULL OR e.label = q.rfc),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, id) AS rank FROM vs QUALIFY rank <= 5)
SELECT qid, string_agg('[' || rank || '] RFC ' || label || ' · стр. ' || id || chr(10) || 'vector ' || id, chr(10) || chr(10) ORDER BY rank) AS reply FROM r GROUP BY qid""")
def tool_replies(spark, sf_dir):
    """The knowledge base's replies to every fiftieth vector, half of them within the label of their own."""
    rows = vectors(spark, sf_dir)
    passages = rows.select(F.col("id").alias("chunk_id"), F.col("label").alias("rfc"), F.lit(None).cast("string").alias("section_path"), F.col("id").alias("page"), F.concat(F.lit("vector "), F.col("id").cast("string")).alias("text"), "vector")
    calls = rows.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector", F.when(F.col("id") % 100 == 0, F.col("label")).alias("rfc"))
    return rag.tool_replies(calls, passages).select("qid", "reply")


# --- sources, stores and services ---------------------------------------------------------------------------------------


@query(chunks_sql().replace("FROM documents WHERE", f"FROM (SELECT rfc AS doc_id, string_agg(text, chr(10) ORDER BY pdf) AS text FROM ({_CLEANED}) GROUP BY rfc) WHERE") + """
SELECT printf('naive-%d-%04d', doc_id, i) AS chunk_id, doc_id::INTEGER AS rfc, 'Some Title' AS title, len(text)::INTEGER AS n_chars, text, s::INTEGER AS start, e::INTEGER AS "end" FROM numbered""")
def built_chunks(spark, sf_dir):
    """From raw pages to chunks: gathered, cleaned, titled by their running heads, cut into windows."""
    rows = _raw_pages(spark, sf_dir).select("rfc", F.inline("pages")).select("rfc", "pdf", "printed", "text")
    return build_chunks(rows, "naive").select("chunk_id", "rfc", "title", "n_chars", "text", "start", "end")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def jsonl_round_trip(spark, sf_dir):
    """Documents as JSON lines: those in English written, the others appended, all read back."""
    path, docs = new_folder(spark, "jsonl"), table(spark, sf_dir, "documents")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    jsonl.write(docs.where(english), path)
    jsonl.append(docs.where(~english), path)
    return jsonl.read(spark, path, docs.schema)


@query("""SELECT 'v' || vec_id AS chunk_id, CASE WHEN vec_id % 2 = 0 THEN 'naive' ELSE 'structural' END AS method, label::BIGINT AS rfc, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE vec_id % 90 END AS page,
CASE WHEN vec_id % 3 = 0 THEN 'revised ' ELSE 'first ' END || vec_id AS text, list_sum(embedding::DOUBLE[]) > 0 AS positive, count(*) OVER (PARTITION BY vec_id % 2) AS of_method FROM embeddings""")
def collection_upsert(spark, sf_dir):
    """A vector collection that is filled and then given a third of its rows again; its rows, and how many each method has."""
    chunk_id = F.concat(F.lit("v"), F.col("id").cast("string"))
    page = F.struct((F.col("id") % 90).cast("int").alias("pdf"), F.when(F.col("id") % 7 != 0, (F.col("id") % 90).cast("int")).alias("printed"))
    none = F.lit(None).cast("string")
    rows = vectors(spark, sf_dir).select("id", chunk_id.alias("chunk_id"), F.when(F.col("id") % 2 == 0, "naive").otherwise("structural").alias("method"), F.col("label").cast("int").alias("rfc"), none.alias("title"), none.alias("section_id"), none.alias("section_path"), page.alias("page_start"), page.alias("page_end"), "vector")
    collection = Collection(spark, f"collection_{uuid.uuid4().hex}")
    collection.ensure()
    collection.insert(rows.withColumn("text", F.concat(F.lit("first "), F.col("id").cast("string"))))
    collection.insert(rows.where("id % 3 = 0").withColumn("text", F.concat(F.lit("revised "), F.col("id").cast("string"))))
    found = spark.table(collection.name)
    counts = found.groupBy("method").agg(F.count("*").alias("of_method"))
    positive = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x) > 0
    out = cut(found.join(counts, "method").select("chunk_id", "method", "rfc", F.col("page_start_printed").alias("page"), "text", positive.alias("positive"), "of_method"))
    collection.drop()
    return out


def _counting_encoder():
    """A stand-in that SQL has, too: the number of characters and of spaces."""
    return lambda texts: np.array([[len(t), t.count(" ")] for t in texts], np.float32).reshape(len(texts), 2)


@query("SELECT doc_id, len('passage: ' || text)::DOUBLE AS chars, (len('passage: ' || text) - len(replace('passage: ' || text, ' ', '')))::DOUBLE AS spaces, count(DISTINCT text) OVER () AS stored FROM documents")
def embedded_texts(spark, sf_dir):
    """Texts embedded through a store, those of even ids first; equal texts are encoded once, and none is encoded again."""
    store = EmbeddingStore(spark, new_folder(spark, "embeddings"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store.embed(docs.where("doc_id % 2 = 0"), "m", _counting_encoder)
    vec = store.embed(docs, "m", _counting_encoder).select("doc_id", F.get("vec", F.lit(0)).cast("double").alias("chars"), F.get("vec", F.lit(1)).cast("double").alias("spaces"))
    return vec.withColumn("stored", F.lit(store.rows("m").count()).cast("long"))


@query(f"WITH {bm25_sql(k=1)} SELECT b.item_id AS qid, coalesce('[1] RFC ' || w.id, '(пусто)') AS answer FROM benchmark b LEFT JOIN words w ON w.qid = b.item_id")
def rag_answers(spark, sf_dir):
    """Test items answered from the documents found by words; the stand-in for a model repeats the first line it is given."""
    hits = bm25.bm25_topk(corpus(spark, sf_dir), items(spark, sf_dir), 5).join(corpus(spark, sf_dir).select("id", "text"), "id")
    none = F.lit(None)
    hits = hits.select("qid", "rank", F.col("id").cast("int").alias("rfc"), none.cast("string").alias("section_path"), none.cast("int").alias("page"), "text")
    questions = items(spark, sf_dir).select("qid", F.col("text").alias("question"))
    return rag.answer(questions, hits, "answer from the context").select("qid", "answer")


def _strict_judge():
    """A stand-in for a judge: an answer is correct if it holds the gold one, refused if it is empty; its replies differ in form."""

    def judge(messages):
        asked = json.loads(messages[0]["content"])
        verdict = "refused" if not asked["answer"] else "correct" if asked["gold"] in asked["answer"] else "wrong"
        return f'Well: {{"verdict": "{verdict.upper()}"}}' if len(asked["question"]) % 2 else f"I call it {verdict}."

    return judge


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'refused' WHEN contains(text, role) THEN 'correct' ELSE 'wrong' END AS verdict FROM conversations""")
def judged_answers(spark, sf_dir):
    """Turns of conversations as answers, their role as what is asked for; every fifth is empty."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"), F.col("role").alias("gold"), F.when(F.col("turn") % 5 == 4, "").otherwise(F.col("text")).alias("answer"))
    return rag.judged(rows, _strict_judge).select("conv_id", "turn", "verdict")


def _eighths():
    """An encoder whose vectors stand for a number modulo 8."""
    return lambda texts: np.eye(8, dtype=np.float32)[[int(t.rsplit(" ", 1)[1]) % 8 for t in texts]].reshape(len(texts), 8)


def _curious_agent():
    """A stand-in that asks for its number, then, if that is even, within one document, then answers with what it has heard."""

    def model(log, tools):
        k, heard = int(log[0]["content"]), [m["content"] for m in log if m["role"] == "tool"]
        asks = [{"query": str(k)}, *([{"query": str(k), "rfc": k % 3}] if k % 2 == 0 else [])]
        if not tools or len(heard) >= len(asks):
            return {"content": "; ".join(heard), "cost_usd": 0.25}
        return {"content": "", "cost_usd": 0.5, "tool_calls": [{"id": "1", "arguments": json.dumps(asks[len(heard)])}]}

    return model


@query("""WITH d AS (SELECT doc_id, (doc_id % 3)::INTEGER AS rfc FROM documents), q AS (SELECT item_id FROM benchmark),
a AS (SELECT item_id, doc_id, rfc, row_number() OVER (PARTITION BY item_id ORDER BY (doc_id % 8 <> item_id % 8), doc_id) AS rank FROM q, d QUALIFY rank <= 2),
b AS (SELECT item_id, doc_id, rfc, row_number() OVER (PARTITION BY item_id ORDER BY (doc_id % 8 <> item_id % 8), doc_id) AS rank FROM q, d WHERE item_id % 2 = 0 AND rfc = item_id % 3 QUALIFY rank <= 2),
r AS (SELECT item_id, 1 AS n, string_agg('[' || rank || '] RFC ' || rfc || ' · стр. ' || doc_id || chr(10) || 'document ' || doc_id, chr(10) || chr(10) ORDER BY rank) AS reply FROM a GROUP BY item_id
  UNION ALL SELECT item_id, 2, string_agg('[' || rank || '] RFC ' || rfc || ' · стр. ' || doc_id || chr(10) || 'document ' || doc_id, chr(10) || chr(10) ORDER BY rank) FROM b GROUP BY item_id)
SELECT item_id AS qid, string_agg(reply, '; ' ORDER BY n) AS answer, 0.25 + 0.5 * count(*) AS cost_usd, (1 + count(*))::INTEGER AS steps FROM r GROUP BY item_id""")
def agent_answers(spark, sf_dir):
    """Every test item's number asked by an agent over all documents: tool rounds, costs over steps, and the last answer."""
    k = F.col("doc_id")
    vector = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i == k % 8).cast("float"))
    rows = table(spark, sf_dir, "documents").select(k.alias("chunk_id"), (k % 3).cast("int").alias("rfc"), F.lit(None).cast("string").alias("section_path"), k.cast("int").alias("page"), F.concat(F.lit("document "), k.cast("string")).alias("text"), vector.alias("vector"))
    questions = items(spark, sf_dir).select("qid", F.col("qid").cast("string").alias("question"))
    return rag.run_agents(questions, _curious_agent, rows, _eighths, 2).select("qid", "answer", "cost_usd", "steps")


@query(f"{chunks_sql()} SELECT doc_id::INTEGER AS rfc, (i)::INTEGER AS i, s::BIGINT AS start, e::BIGINT AS \"end\", text FROM numbered")
def chunks_by_table_function(spark, sf_dir):
    """Documents as pages of a line each, chunked in SQL by the table function, page by page."""
    tablefunctions.register(spark)
    line = F.posexplode(F.split("text", "\n")).alias("pdf", "text")
    view = f"pages_{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").select(F.col("doc_id").cast("int").alias("rfc"), F.lit(None).cast("int").alias("printed"), line).createOrReplaceTempView(view)
    found = spark.sql(f"SELECT rfc, i, start, `end`, text FROM chunk_naive(TABLE({view}) PARTITION BY rfc ORDER BY pdf)")
    spark.catalog.dropTempView(view)
    return found


@query("""WITH z AS (SELECT conv_id, max(turn) FILTER (turn % 4 = 3) AS z FROM conversations GROUP BY conv_id)
SELECT conv_id AS chat_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM (SELECT c.* FROM conversations c JOIN z USING (conv_id) WHERE turn % 4 <> 3 AND (z IS NULL OR turn > z)
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) GROUP BY conv_id""")
def session_snapshots(spark, sf_dir):
    """Conversations in three batches, every fourth turn a reset, folded behind the first; the last three turns of each."""
    store, turns = SessionStore(spark, new_folder(spark, "sessions"), 3), table(spark, sf_dir, "conversations")
    log = turns.select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("seq"), F.when(F.col("turn") % 4 == 3, "reset").otherwise("append").alias("op"), "role", "text")
    for batch, part in enumerate((log.where("seq < 2"), log.where("seq >= 2 and seq < 5"), log.where("seq >= 5"))):
        store.append(part, batch)
        if batch == 0:
            store.fold()
    return store.history().select("chat_id", F.array_join(F.transform("items", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("history"))
