"""Positional postings, document vectors and phrase search.

positions(term, doc_id, tf, positions)  - where each term stands in a document
vectors(doc_id, dl, terms)              - the forward form: a document's terms
                                          with tf and positions, sorted by term

``phrase_matches`` intersects positions: the postings of a phrase's rarest term
give the places where it can start, and the other terms are looked up there,
the rarest first with a cut in between.  No text is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators.index import analyze, document_terms, postings_of
from quarry.session import written


@dataclass
class PositionIndex:
    positions: DataFrame
    vectors: DataFrame
    term_df: DataFrame


def build_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "contents", tokenizer=tx.tokens,
                    distinct_ids: bool = False) -> PositionIndex:
    """Both forms from one tokenisation: the vectors are written, the postings
    are their entries.  With ``distinct_ids`` (no id but null comes twice) a
    document's vector is made where it is; other documents are dealt out by id."""
    analyzed = analyze(docs, id_col, text_col, tokenizer)
    shared = analyzed.where("doc_id IS NULL") if distinct_ids else analyzed
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entry = F.struct("term", "tf", "positions")
    vectors = postings_of(shared.repartition(parts, "doc_id"), with_positions=True).groupBy("doc_id", "dl").agg(
        F.sort_array(F.collect_list(entry)).alias("terms"))
    if distinct_ids:
        vectors = document_terms(analyzed.where("doc_id IS NOT NULL"), with_positions=True).unionByName(vectors)
    vectors = written(vectors, "vectors")
    term_df = written(vectors.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "position-df")
    return PositionIndex(vectors.select("doc_id", F.explode("terms").alias("t")).select("t.term", "doc_id", "t.tf", "t.positions"), vectors, term_df)


def phrase_matches(index: PositionIndex, phrases: DataFrame, id_col: str = "item_id", text_col: str = "text",
                   tokenizer=tx.tokens) -> DataFrame:
    """(item_id, doc_id, n_matches, first_pos): documents that hold the tokens
    of a phrase one after another.  A phrase without tokens, or with one that
    no document has, matches nothing."""
    terms = phrases.select(id_col, tokenizer(F.col(text_col)).alias("_t")).select(
        id_col, F.size("_t").alias("n"), F.posexplode("_t").alias("at", "term")).join(index.term_df, "term")
    per = Window.partitionBy(id_col)
    terms = written(terms.withColumn("order", F.row_number().over(per.orderBy("df", "at"))).withColumn("known", F.count("*").over(per))
                    .where("known = n"), "phrase-terms")
    first = terms.where(F.col("order") == 1).join(index.positions, "term")
    starts = first.select(id_col, "n", "doc_id", F.explode(F.transform("positions", lambda p: p - F.col("at"))).alias("start")).where("start >= 0")
    # the second rarest term alone, then all others at once
    for rest, found in ((F.col("order") == 2, F.least(F.col("n") - 1, F.lit(1))), (F.col("order") > 2, F.greatest(F.col("n") - 2, F.lit(0)))):
        wanted = starts.join(terms.where(rest).select(id_col, "at", "term"), id_col)
        held = wanted.join(index.positions.select("term", "doc_id", "positions"), ["doc_id", "term"]) \
            .where(F.array_contains("positions", F.col("start") + F.col("at")))
        seen = held.groupBy(id_col, "doc_id", "start").agg(F.count("*").alias("_seen"))
        starts = starts.join(seen, [id_col, "doc_id", "start"], "left").where(F.coalesce("_seen", F.lit(0)) == found).drop("_seen")
    return starts.groupBy(id_col, "doc_id").agg(F.count("*").alias("n_matches"), F.min("start").alias("first_pos"))
