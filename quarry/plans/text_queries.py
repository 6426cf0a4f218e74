"""Registered projections (P1-P19) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import sequences as sq
from quarry.functions import text as tx
from quarry.plans import fixtures, prepared
from quarry.plans.registry import register
from quarry.sources.tables import read_table

# Prompt templates of the reference (corpus and dev forms).
PROMPT_TEMPLATE = "Generate a %s question for this passage: %s %s"
DEV_PROMPT_TEMPLATE = "Generate %s question: %s</s>%s"


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


@register("clean_body")
def q_clean_body(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.clean_control("text").alias("body"))


@register("compose_subject_body")
def q_compose_subject_body(spark, sf):
    c = fixtures.corpus(spark, sf)
    return c.select(F.col("mid").alias("doc_id"),
                    tx.compose_subject_body("subject", "body_clean").alias("body_clean_and_subject"))


@register("compose_contents")
def q_compose_contents(spark, sf):
    c = fixtures.corpus(spark, sf)
    return c.select(F.col("mid").alias("doc_id"), tx.compose_contents("subject", "body_clean").alias("contents"))


@register("prompt_by_lang")
def q_prompt_by_lang(spark, sf):
    """P5: language name from the 4-row lookup (broadcast), two templates; a
    language that is not listed keeps its code."""
    c = fixtures.corpus(spark, sf)
    langs = F.broadcast(fixtures.languages(spark))
    j = c.join(langs, "lang", "left").withColumn("language", F.coalesce("language", "lang", F.lit("")))
    return j.select(F.col("mid").alias("doc_id"), "lang",
                    F.format_string(PROMPT_TEMPLATE, "language", "subject", "body_clean").alias("prompt"),
                    F.format_string(DEV_PROMPT_TEMPLATE, "language", "subject", "body_clean")
                    .alias("dev_prompt"))


@register("role_prefix")
def q_role_prefix(spark, sf):
    """P6 on pages: 'Passage: {passage}', 'Passage: {title}</s>{passage}';
    'Question: {q}' on the first sentence of the passage."""
    p = fixtures.page_fields(spark, sf)
    q = F.coalesce(F.try_element_at(tx.sentences("passage"), F.lit(1)), F.lit(""))
    return p.select("page_id",
                    tx.role_prefix(tx.PASSAGE_PROMPT, "passage").alias("passage_text"),
                    tx.role_prefix(tx.PASSAGE_PROMPT, "title", "passage").alias("titled_text"),
                    tx.role_prefix(tx.QUESTION_PROMPT, q).alias("question_text"))


def prompted(spark, sf):
    """Prompt fixture: 'Passage: ', 'Question: ', both chained, or none, by doc_id % 4."""
    d = _docs(spark, sf)
    k = F.col("doc_id") % 4
    t = tx.null_to_empty("text")
    pre = (F.when(k == 0, F.concat(F.lit(tx.PASSAGE_PROMPT), t))
           .when(k == 1, F.concat(F.lit(tx.QUESTION_PROMPT), t))
           .when(k == 2, F.concat(F.lit(tx.PASSAGE_PROMPT + tx.QUESTION_PROMPT), t))
           .otherwise(t))
    return d.select("doc_id", pre.alias("prompt"))


@register("strip_prompt")
def q_strip_prompt(spark, sf):
    return prompted(spark, sf).select("doc_id", tx.strip_prompt("prompt").alias("text"))


def marked_titles(spark, sf):
    """Title fixture from pages: even pages carry the section marker."""
    p = fixtures.page_fields(spark, sf)
    raw = F.concat(F.lit(" title:"), F.col("title"),
                   F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(tx.SECTION_MARKER), F.col("url")))
                   .otherwise(F.lit("")), F.lit(" "))
    return p.select("page_id", raw.alias("raw_title"))


@register("title_slice")
def q_title_slice(spark, sf):
    return marked_titles(spark, sf).select("page_id", tx.title_slice("raw_title").alias("title"))


@register("flatten_newlines")
def q_flatten_newlines(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.flatten_newlines("text").alias("text"))


@register("length_features")
def q_length_features(spark, sf):
    d = _docs(spark, sf)
    clean = tx.clean_control(tx.null_to_empty("text"))
    return d.select("doc_id",
                    tx.char_count("text").alias("length_character"),
                    tx.word_count("text").alias("length_word"),
                    tx.char_count(clean).alias("clean_length_character"),
                    tx.word_count(clean).alias("clean_length_word"))


@register("token_truncate")
def q_token_truncate(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", F.array_join(tx.token_truncate("text", 16), " ").alias("tokens"))


@register("max_id_length")
def q_max_id_length(spark, sf):
    """Longest docid in tokens (+1 for the end marker) over the corpus."""
    return prepared.docids(spark, sf).agg((F.max(F.size(tx.tokens("docid"))) + 1).cast("bigint").alias("max_id_length"))


PAD_LENGTH = 128    # fixed: maximal input length in tokens


def label_sequences(spark, sf):
    """Token sequences of the texts, the ignore marker on every third document."""
    c = fixtures.corpus(spark, sf)
    toks = tx.tokens("body_clean")
    seq = F.when(F.col("mid") % 3 == 0, F.concat(toks, F.array(F.lit(sq.IGNORE)))).otherwise(toks)
    return c.select(F.col("mid").alias("doc_id"), seq.alias("seq"))


@register("pad_sequences")
def q_pad_sequences(spark, sf):
    s = label_sequences(spark, sf)
    return s.select("doc_id", F.array_join(sq.pad_to(sq.unmask("seq"), PAD_LENGTH), " ").alias("padded"))


@register("batch_pad")
def q_batch_pad(spark, sf):
    s = label_sequences(spark, sf).select("doc_id", sq.unmask("seq").alias("seq"))
    b = sq.batch_pad(s, "doc_id", "seq", batch_size=8)
    return b.select("doc_id", "batch", F.array_join("input_padded", " ").alias("input_padded"),
                    F.array_join("labels_padded", " ").alias("labels_padded"))


@register("decode_tokens")
def q_decode_tokens(spark, sf):
    s = label_sequences(spark, sf)
    padded = F.concat(sq.pad_to(sq.unmask("seq"), PAD_LENGTH), F.array(F.lit(tx.EOS)))
    return s.select("doc_id", sq.decode(padded).alias("decoded"))


@register("pair_input")
def q_pair_input(spark, sf):
    """The four ranker input forms (answer / title flags)."""
    r = fixtures.ranker_contexts(spark, sf)
    answer = tx.strip_ws(F.coalesce(F.try_element_at(tx.sentences("text"), F.lit(1)), F.lit("")))
    out = [F.col("source"), F.col("doc_id")]
    for use_answer in (False, True):
        for no_title in (False, True):
            name = f"input{'_answer' if use_answer else ''}{'_notitle' if no_title else ''}"
            out.append(sq.pair_input("question", "title", "text", answer if use_answer else None,
                                     no_title).alias(name))
    return r.select(*out)


@register("numeric_vocab")
def q_numeric_vocab(spark, sf):
    """P17 over a vocabulary derived from the corpus: each token, its
    word-marker form, the bare marker and the end marker."""
    d = _docs(spark, sf)
    terms = d.select(F.explode(tx.tokens("text")).alias("t")).distinct()
    vocab = (terms.select(F.col("t").alias("token"))
             .unionByName(terms.select(F.concat(F.lit(sq.WORD_MARKER), "t").alias("token")))
             .unionByName(spark.range(1).select(F.lit(sq.WORD_MARKER).alias("token")))
             .unionByName(spark.range(1).select(F.lit(tx.EOS).alias("token"))))
    return sq.numeric_vocab(vocab, "token").distinct()


@register("id_kind")
def q_id_kind(spark, sf):
    """Are all ids of a set non-numeric strings (semantic ids)?"""
    ids = prepared.docids(spark, sf)
    sets = (ids.select(F.lit("doc_id").alias("id_set"), F.col("doc_id").cast("string").alias("id"))
            .unionByName(ids.select(F.lit("docid").alias("id_set"), F.col("docid").alias("id"))))
    return sets.groupBy("id_set").agg(sq.all_semantic(F.col("id")).alias("semantic_ids"))
