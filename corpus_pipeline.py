"""Corpus pipeline: documents through five operators of ``quarry.llm``.

1. language ID: texts without a letter and texts whose language is ambiguous
   go; a missing ``lang`` is filled in.  Where no row has both a language and
   a text with letters, every text with a letter stays, its ``lang`` as it is.
2. n-gram Jaccard join, five words, 0.8: one document of each group stays.
3. secret scans: secrets in the text are masked; no document goes.
4. mixing sources to target weights: each document as often as the mix takes it.
5. byte-level BPE: every text is encoded and its ids decoded; the rows carry the
   digests of both.

Null texts go in stage 1.  Extra columns pass through stages 1 to 4, whatever
their names.  An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import duck_bpe, jaccard_join, langid, mixing, secrets_scan
from quarry.llm.common import packed, table, unpacked
from quarry.session import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.select("lang", "text"))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = docs.select(packed(docs), "text")
    found = langid.identify(rows, model).where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous"))
    return unpacked(found, docs.columns, lang=F.coalesce(F.col("row")["lang"], F.col("lang_pred")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, size=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets_scan.redact(docs, secrets_scan.train_on(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("bigint"))
    return clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return duck_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: SQL can express neither the trained models nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
