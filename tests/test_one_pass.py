"""Texts are cut once by TextRank and the index."""
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import textrank_local
from quarry.operators.index import analyze, document_terms


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_textrank_cuts_a_text_once(spark):
    docs = spark.createDataFrame([(1, "en", "Cats chase mice. Dogs chase cats! ")], "mid long, lang string, text string")
    ranked = textrank_local.ranked(docs, F.col("text"))
    assert plan(ranked).count("regexp_extract_all(") == 2          # sentences, and the words of a sentence
    row = ranked.first()
    assert row["summary"] and set(row["keywords"].split()) == {"cats", "chase", "dogs", "mice"}


def test_index_cuts_a_text_once(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, "..."), (4, "c")], "doc_id long, contents string")
    terms = document_terms(analyze(docs).where("doc_id IS NOT NULL"))
    assert plan(terms).count("split(") == 1
    assert {(r["doc_id"], r["dl"], tuple((t["term"], t["tf"]) for t in r["terms"])) for r in terms.collect()} == {
        (1, 3, (("a", 2), ("b", 1))), (4, 1, (("c", 1),))}


def test_ends_and_tokens_as_the_expressions_give_them(spark):
    odd = ["", " ", " a ", "a  ", "  a", " a\u0085", "\x0b\f a\r", "\xa0a\xa0", "a   ", "\t ", None]
    rows = spark.createDataFrame([(s,) for s in odd], "s string")
    assert all(r[0] == r[1] for r in rows.select(tx.strip_ends("s"), tx.strip_ws("s")).collect())
    words = spark.createDataFrame([("Ab-9 Éß_x ٣́ 日本, Z",)], "s string")
    same = words.select(tx.tokens("s"), F.regexp_extract_all(F.lower("s"), F.lit(tx.TOKEN_PATTERN), 0)).first()
    assert same[0] == same[1]
