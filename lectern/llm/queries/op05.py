"""Token counts of all documents, kept in a ledger of committed batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.queries.common import documents
from lectern.llm.runtime import shared_dir
from lectern.llm.tokenledger import WORDS, Ledger, corpus_batches, read_vocabulary

TOKENIZERS = {"byte_bpe_50k": "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"}


def _totals(spark: SparkSession, sf_dir: str, vocabularies: dict[str, bytes]) -> DataFrame:
    ledger = Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    batches = corpus_batches(documents(spark, sf_dir).select("doc_id", "text", "source", "lang"), vocabularies)
    for name, changes in batches.items():
        ledger.commit(name, changes)
    ledger.commit("load", batches["load"])  # sent twice, counted once
    ledger.compact()
    return ledger.totals()


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir, {name: read_vocabulary(path) for name, path in TOKENIZERS.items()})


def ledger_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches, commits and totals under a tokenizer that SQL has, too."""
    return _totals(spark, sf_dir, {"words": WORDS})


query = op5_token_counts
SQL = None
MORE = {"ledger_word_counts": ledger_word_counts}
MORE_SQL = {
    "ledger_word_counts": r"""
WITH t AS (
  SELECT doc_id, source, lang, regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS clean FROM documents
), f AS (
  SELECT *, row_number() OVER (PARTITION BY clean ORDER BY doc_id NULLS LAST, source NULLS FIRST, lang NULLS FIRST) AS place FROM t
)
SELECT source, lang, 'words' AS tokenizer, count(*) AS n_docs, sum(len(regexp_extract_all(clean, '[^\x20\x09-\x0D]+')))::BIGINT AS n_tokens, sum(length(clean))::BIGINT AS n_chars
FROM f WHERE place = 1 GROUP BY source, lang
"""
}
