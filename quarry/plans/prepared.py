"""Tables derived from the corpus once per application and shared by the
queries: the inverted index and the prepared corpus (composed view, TextRank
query, TextRank keyword docid).  They are written to the shared folder, so
nothing stays cached in memory; a change of the input files makes new ones.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import textrank as tr
from quarry.operators import textrank_local
from quarry.operators.index import Index, build_index
from quarry.operators.phrases import PositionIndex, build_positions
from quarry.operators.ranking import first_per_key
from quarry.plans import fixtures
from quarry.session import scratch_path, written
from quarry.sources.tables import table_path

_MADE: dict[tuple, Any] = {}


def _stamp(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> tuple:
    """Identity of the application and of the input files."""
    marks: list = [spark.sparkContext.applicationId, sf_dir]
    for t in tables:
        files = spark.read.parquet(table_path(sf_dir, t)).select(
            "_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").distinct()
        one = F.xxhash64("file_path", "file_modification_time", "file_size")
        marks += list(files.agg(F.count("*"), F.sum(one.cast("decimal(38,0)")), F.bit_xor(one)).first())
    return tuple(marks)


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], Any],
         tables: tuple[str, ...] = ("documents",)) -> Any:
    key = (name, *_stamp(spark, sf_dir, tables))
    if key not in _MADE:
        _MADE[key] = build()
    return _MADE[key]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with one row per ``mid`` (W4).  Repeated ids are found on
    the ids alone, once; only their rows are compared (by text).  Where there
    are none, no text is shuffled."""
    rows = fixtures.corpus(spark, sf_dir)

    def find() -> DataFrame | None:
        found = written(rows.groupBy("mid").agg(F.count("*").alias("_n")).where("_n > 1 AND mid IS NOT NULL").select("mid"), "repeated-ids")
        return None if found.isEmpty() else found
    repeated = once(spark, sf_dir, "repeated-ids", find)
    if repeated is None:
        return rows
    return rows.join(repeated, "mid", "left_anti").unionByName(
        first_per_key(rows.join(repeated, "mid", "left_semi"), "mid", "body_clean"))


def corpus_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Index]:
    corp = corpus(spark, sf_dir)
    docs = corp.select(F.col("mid").alias("doc_id"), tx.compose_contents("subject", "body_clean").alias("contents"))

    def build() -> Index:
        return build_index(docs, path=scratch_path(spark, "index"), distinct_ids=True)
    return corp, once(spark, sf_dir, "index", build)


def position_index(spark: SparkSession, sf_dir: str) -> PositionIndex:
    """Positional postings and document vectors of the corpus."""
    docs = corpus(spark, sf_dir).select(F.col("mid").alias("doc_id"), tx.compose_contents("subject", "body_clean").alias("contents"))
    return once(spark, sf_dir, "positions", lambda: build_positions(docs, distinct_ids=True))


def ranked_corpus(spark: SparkSession, sf_dir: str, iterations: int = tr.ITERATIONS) -> DataFrame:
    """The corpus with its TextRank ``summary`` and ``keywords``."""
    return textrank_local.summaries_and_keywords(corpus(spark, sf_dir), tx.compose_textrank_input("subject", "body_clean"), "mid", iterations)


def summaries(spark: SparkSession, sf_dir: str, iterations: int = tr.ITERATIONS) -> DataFrame:
    return ranked_corpus(spark, sf_dir, iterations).select(F.col("mid").alias("doc_id"), F.col("summary").alias("text_rank_query"))


def keyword_ids(spark: SparkSession, sf_dir: str, iterations: int = tr.ITERATIONS) -> DataFrame:
    return ranked_corpus(spark, sf_dir, iterations).select(F.col("mid").alias("doc_id"), F.col("keywords").alias("elaborative_description"))


def prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed view, TextRank query and keyword docid of every document."""
    return ranked_corpus(spark, sf_dir).select(
        F.col("mid").alias("doc_id"), "subject", "body_clean",
        tx.compose_subject_body("subject", "body_clean").alias("body_clean_and_subject"),
        tx.char_count(tx.clean_control("body_clean")).alias("clean_length_character"),
        F.col("summary").alias("text_rank_query"), F.col("keywords").alias("elaborative_description"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "prepared", lambda: written(prepare(spark, sf_dir), "prepared"))


def ranked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text_rank_query, elaborative_description) of every document:
    the prepared corpus without its texts, which take most of its disk.  A
    session that has the prepared corpus reads that."""
    columns = ["doc_id", "text_rank_query", "elaborative_description"]
    wide = _MADE.get(("prepared", *_stamp(spark, sf_dir, ("documents",))))
    if wide is not None:
        return wide.select(*columns)
    return once(spark, sf_dir, "ranked-ids", lambda: written(prepare(spark, sf_dir).select(*columns), "ranked-ids"))


def docids(spark: SparkSession, sf_dir: str, unique_ids: bool = False) -> DataFrame:
    """(doc_id, docid): TextRank keywords; '' where a document has none.
    Equal keywords are one docid, unless ``unique_ids`` appends the id."""
    docid = F.col("elaborative_description")
    if unique_ids:
        docid = F.trim(F.concat_ws(" ", docid, F.col("doc_id").cast("string")))
    return ranked_ids(spark, sf_dir).select("doc_id", docid.alias("docid"))
