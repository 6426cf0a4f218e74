"""Registered joins, aggregates, windows, splits and dataset builders
(J1-J5, A5-A7, W6, W8, X1-X5, X7, X8, D1-D6, F2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import split
from quarry.operators.order import global_row_number, seeded_key
from quarry.operators.ranking import first_per_key
from quarry.plans import evaluation, fixtures, prepared
from quarry.plans.registry import register
from quarry.plans.text_queries import DEV_PROMPT_TEMPLATE, PROMPT_TEMPLATE
from quarry.sources.tables import read_table

SEED = 42           # split seed (reference default)
SHUFFLE_SEED = 313  # dataset-builder shuffle seed (reference default)
VIEWS = ("body_clean_and_subject", "text_rank_query", "doctoquery")
#: The views that each ``query_type`` option trains on.
QUERY_TYPE_VIEWS = {"mixed": VIEWS, "textrank": VIEWS[:2], "d2q": (VIEWS[0], VIEWS[2])}


# ------------------------------------------------------------------ joins
@register("attach_queries")
def q_attach_queries(spark, sf):
    """Corpus LEFT JOIN generated queries (2 per doc) on mid."""
    gen = evaluation.generated_queries(spark, sf, 2)
    return prepared.corpus(spark, sf).select("mid").join(gen.withColumnRenamed("doc_id", "mid"), "mid", "left").select(
        "mid", "q_rank", F.col("query").alias("doctoquery"))


@register("qrel_lookup")
def q_qrel_lookup(spark, sf):
    """First train qid per docid -> question; docid -> passage."""
    qr = fixtures.qrels(spark, sf).where(F.col("split") == "train")
    first = first_per_key(qr, "docid", "pos").select("docid", "qid")
    pairs = fixtures.qa_pairs(spark, sf)
    return (first.join(pairs.select("qid", "question"), "qid")
            .join(pairs.select("docid", "passage"), "docid")
            .select("docid", "qid", "question", "passage"))


@register("dev_anti_train")
def q_dev_anti_train(spark, sf):
    """Dev docids not labelled in train (leakage guard)."""
    qr = fixtures.qrels(spark, sf)
    dev = qr.where(F.col("split") == "dev").select("docid").distinct()
    return dev.join(qr.where(F.col("split") == "train").select("docid"), "docid", "left_anti")


@register("qid_guard")
def q_qid_guard(spark, sf):
    """Dev questions whose qid was seen in train or earlier in dev are dropped."""
    qr = fixtures.qrels(spark, sf)
    dev = qr.where(F.col("split") == "dev")
    fresh = dev.join(qr.where(F.col("split") == "train").select("qid"), "qid", "left_anti")
    return first_per_key(fresh, "qid", "pos").select("qid", "docid")


@register("prompt_cross_lang")
def q_prompt_cross_lang(spark, sf):
    """Every passage x each language (a generator, not a join)."""
    c = fixtures.corpus(spark, sf)
    langs = F.array(*[F.struct(F.lit(k).alias("code"), F.lit(v).alias("name"))
                      for k, v in fixtures.LANGUAGES])
    x = c.select("mid", "subject", "body_clean", F.explode(langs).alias("l"))
    return x.select(F.col("mid").alias("doc_id"), F.col("l.code").alias("lang"),
                    F.format_string(PROMPT_TEMPLATE,
                                    F.col("l.name"), "subject", "body_clean").alias("prompt"))


# ------------------------------------------------------------------ aggregates
def _ranks(spark, sf):
    return evaluation.bm25_run(spark, sf).ranks


@register("mrr_at_k")
def q_mrr_at_k(spark, sf):
    r = _ranks(spark, sf).select("rank", F.explode(F.array(*[F.lit(k) for k in (1, 3, 10, 20)])).alias("k"))
    return r.groupBy("k").agg(F.round(F.avg(F.when(F.col("rank") <= F.col("k"), F.lit(1.0) / F.col("rank"))
                                            .otherwise(F.lit(0.0))), 6).alias("mrr")) \
        .select(F.col("k").cast("bigint").alias("k"), "mrr")


@register("hits_at_k")
def q_hits_at_k(spark, sf):
    r = _ranks(spark, sf).select("rank", F.explode(F.array(*[F.lit(k) for k in (1, 3, 10, 20)])).alias("k"))
    return r.groupBy("k").agg(F.round(F.avg(F.when(F.col("rank") <= F.col("k"), F.lit(1.0))
                                            .otherwise(F.lit(0.0))), 6).alias("hits")) \
        .select(F.col("k").cast("bigint").alias("k"), "hits")


@register("qrel_invert")
def q_qrel_invert(spark, sf):
    """A5: docid -> its qids in file order (per split; lists are short)."""
    qr = fixtures.qrels(spark, sf)
    return qr.groupBy("split", "docid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "qid"))),
                                 lambda s: s["qid"]), ",").alias("qids"))


@register("distinct_ids")
def q_distinct_ids(spark, sf):
    """The set of valid docids (TextRank keyword ids of the corpus)."""
    return prepared.docids(spark, sf).select(F.col("docid").alias("text_id")).distinct()


@register("source_sizes")
def q_source_sizes(spark, sf):
    """Rows per source and the total (rollup)."""
    d = read_table(spark, sf, "documents")
    return d.rollup("source").agg(F.count("*").alias("n_rows"))


# ------------------------------------------------------------------ windows / samples
@register("nth_shortest")
def q_nth_shortest(spark, sf):
    """The 4th shortest document by character count (ties by id)."""
    d = read_table(spark, sf, "documents").select("doc_id", tx.char_count("text").alias("char_count"))
    return split.nth_smallest(d, ["char_count", "doc_id"], 4)


@register("seeded_sample")
def q_seeded_sample(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    return split.seeded_sample(d, "doc_id", 100, SHUFFLE_SEED)


# ------------------------------------------------------------------ splits
@register("split_exact")
def q_split_exact(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    return split.split_exact(d, "doc_id", SEED, 0.8, 0.1, 0.1)


@register("split_bucket")
def q_split_bucket(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    return split.split_bucket(d, seeded_key(SEED, "doc_id"), 0.8, 0.1, 0.1)


def view_rows(spark, sf, query_type: str = "mixed") -> DataFrame:
    """(doc_id, view, text): the indexing views of every document."""
    gen = evaluation.generated_queries(spark, sf, 1).select("doc_id", F.col("query").alias("doctoquery"))
    wide = prepared.prepared(spark, sf).select("doc_id", *VIEWS[:2]).join(gen, "doc_id", "left")
    return wide.unpivot("doc_id", list(QUERY_TYPE_VIEWS[query_type]), "view", "text")


@register("split_by_doc")
def q_split_by_doc(spark, sf):
    """All views of a document fall in the same split."""
    return split.split_bucket(view_rows(spark, sf).select("doc_id", "view"), seeded_key(SEED, "doc_id"))


@register("split_by_query")
def q_split_by_query(spark, sf):
    """Each (document, view) row is split on its own."""
    v = view_rows(spark, sf)
    key = seeded_key(SEED, F.concat_ws(":", F.col("doc_id").cast("string"), F.col("view")))
    return split.split_bucket(v.select("doc_id", "view"), key)


def multi_view(spark, sf, query_type: str = "mixed") -> DataFrame:
    """(view, text, text_id, split) per document view; text_id = TextRank
    keyword docid ('' where a document has none); null views become '' (our
    null rule); split by document."""
    ids = prepared.docids(spark, sf)
    pairs = view_rows(spark, sf, query_type).join(ids, "doc_id", "left").select(
        "doc_id", "view", tx.null_to_empty("text").alias("text"), tx.null_to_empty("docid").alias("text_id"))
    return split.split_bucket(pairs, seeded_key(SEED, "doc_id")).drop("doc_id")


@register("multi_view_pairs")
def q_multi_view_pairs(spark, sf):
    return multi_view(spark, sf)


@register("multi_view_pairs_textrank")
def q_multi_view_pairs_textrank(spark, sf):
    """The ``query_type`` option restricts the query views."""
    return multi_view(spark, sf, "textrank")


@register("dense_ids")
def q_dense_ids(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    return split.dense_ids(d, "doc_id", SHUFFLE_SEED)


@register("quota_fill")
def q_quota_fill(spark, sf):
    """Good labelled docs first, then the rest shuffled, up to half the corpus."""
    d = read_table(spark, sf, "documents").select("doc_id")
    lab = read_table(spark, sf, "labels").where("quality = 1").select("doc_id")
    quota = d.count() // 2
    return split.quota_fill(d.join(lab, "doc_id", "left_semi"), d, "doc_id", quota, SHUFFLE_SEED)


@register("shard_rows")
def q_shard_rows(spark, sf):
    """Labelled docs topped up to a multiple of 8 workers, equal shards."""
    lab = read_table(spark, sf, "labels").select("doc_id")
    return split.shard_rows(lab, "doc_id", 8, SHUFFLE_SEED)


@register("shard_rows_inference")
def q_shard_rows_inference(spark, sf):
    """X8, inference form: the last of 8 workers takes the remainder."""
    return split.shard_contiguous(read_table(spark, sf, "labels").select("doc_id"), "doc_id", 8)


@register("mix_sources")
def q_mix_sources(spark, sf):
    """Two epochs in batches of 4, proportional to the sources' sizes."""
    d = read_table(spark, sf, "documents")
    return split.mixed_batches(d, "source", "doc_id", batch=4, epochs=2, seed=SHUFFLE_SEED)


# ------------------------------------------------------------------ builders
@register("generation_input")
def q_generation_input(spark, sf):
    """Generation inputs chosen by corpus kind (argument, not path)."""
    c = fixtures.corpus(spark, sf)
    email = c.select(F.lit("email").alias("kind"), F.col("mid").alias("doc_id"), F.lit(None).cast("string").alias("lang"),
                     F.concat(F.lit("subject: "), "subject", F.lit(" body: "), "body_clean").alias("text"))
    langs = F.array(*[F.struct(F.lit(k).alias("code"), F.lit(v).alias("name")) for k, v in fixtures.LANGUAGES])
    multi = c.select("mid", "subject", "body_clean", F.explode(langs).alias("l")).select(
        F.lit("multilingual").alias("kind"), F.col("mid").alias("doc_id"), F.col("l.code").alias("lang"),
        F.format_string(PROMPT_TEMPLATE, F.col("l.name"), "subject",
                        "body_clean").alias("text"))
    mono = c.select(F.lit("monolingual").alias("kind"), F.col("mid").alias("doc_id"),
                    F.lit(None).cast("string").alias("lang"), F.col("body_clean").alias("text"))
    return email.unionByName(multi).unionByName(mono)


def positioned(spark, train: DataFrame, pool: DataFrame, dev: DataFrame, quota: int, id_col: str = "docid",
               allow_duplicates: bool = False) -> DataFrame:
    """(id, priority, phase, text_id): training ids filled from the pool up to
    ``quota``, then the held-out ids, each with a seeded dense id.  Only ids
    are sorted."""
    filled = split.quota_fill(train, pool, id_col, quota, SHUFFLE_SEED, exclude=dev,
                              allow_duplicates=allow_duplicates).withColumn("phase", F.lit(0))
    held = dev.select(id_col).withColumn("priority", F.lit(2).cast("bigint")).withColumn("_k", seeded_key(SHUFFLE_SEED, id_col))
    held = global_row_number(held, ["_k", id_col], "fill_rank").drop("_k").withColumn("phase", F.lit(1))
    ordered = global_row_number(filled.unionByName(held), ["phase", "fill_rank"], "position")
    m = ordered.count()
    perm = split.dense_ids(spark.range(m).select(F.col("id").alias("v")), "v", SHUFFLE_SEED, "p")
    return ordered.join(perm.select((F.col("p") + 1).alias("position"), F.col("v").alias("text_id")), "position") \
        .select(id_col, "priority", "phase", "text_id")


def qa_dataset(spark, sf, allow_duplicates: bool = False):
    """Single-language retrieval dataset from the question/passage pairs.
    train: labelled train docs in seeded order, then documents of the shared
    pool (shuffled) up to 1.2x the labelled count; dev: dev docs not in train.
    The pool holds all passages and documents, so labelled and held-out ones
    are kept out by id.  Dev passages are indexed too.  Texts are joined to
    the chosen ids at the end."""
    qr = fixtures.qrels(spark, sf)
    pairs = fixtures.qa_pairs(spark, sf)
    train, dev = (first_per_key(qr.where(F.col("split") == s), "docid", "pos").select("docid", "qid")
                  for s in ("train", "dev"))
    known = pairs.select("qid")
    train, dev = train.join(known, "qid", "left_semi"), dev.join(known, "qid", "left_semi")
    dev = dev.join(train.select("docid"), "docid", "left_anti")
    docs = read_table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("docid"),
                                                     tx.null_to_empty("text").alias("passage"))
    passages = pairs.select("docid", "passage").unionByName(docs)
    ids = positioned(spark, train, passages, dev, (train.count() * 12) // 10, allow_duplicates=allow_duplicates)
    asked = train.unionByName(dev).join(pairs.select("qid", "question"), "qid").select("docid", "question")
    return ids.join(passages, "docid").join(asked, "docid", "left").withColumn(
        "question", F.when(F.col("priority") != 1, F.col("question")))


@register("qa_dataset_train")
def q_qa_dataset_train(spark, sf):
    d = qa_dataset(spark, sf).where("phase = 0 OR phase = 1")
    passages = d.select("text_id", tx.role_prefix(tx.PASSAGE_PROMPT, "passage").alias("text"))
    questions = d.where((F.col("phase") == 0) & F.col("question").isNotNull()).select(
        "text_id", tx.role_prefix(tx.QUESTION_PROMPT, "question").alias("text"))
    return passages.unionByName(questions)


@register("qa_dataset_dev")
def q_qa_dataset_dev(spark, sf):
    d = qa_dataset(spark, sf).where("phase = 1")
    return d.select("text_id", tx.role_prefix(tx.QUESTION_PROMPT, "question").alias("text"))


@register("qa_dataset_corpus")
def q_qa_dataset_corpus(spark, sf):
    d = qa_dataset(spark, sf)
    return d.select("text_id", F.concat_ws("\t", F.col("text_id").cast("string"), "passage").alias("line"))


def multiling(spark, sf):
    """Items of the multilingual set: (split, qid, question, passage, title,
    language), one per qid, the first across train then dev in seeded order.
    Titles carry the section marker and are cut (P8); a language without a
    name keeps its code."""
    qr = fixtures.qrels(spark, sf)
    pairs = fixtures.qa_pairs(spark, sf)
    langs = F.array(*[F.lit(k) for k, _ in fixtures.LANGUAGES])
    raw = F.concat(F.lit("title:"), tx.flatten_newlines("question"), F.lit(tx.SECTION_MARKER), "docid")
    rows = (qr.join(pairs.select("qid", "question", "passage", "conv_id"), "qid")
            .select("split", "qid", "pos", "question", tx.flatten_newlines("passage").alias("passage"),
                    tx.title_slice(raw).alias("title"),
                    F.element_at(langs, (F.col("conv_id") % 4 + 1).cast("int")).alias("lang")))
    order = F.when(F.col("split") == "train", 0).otherwise(1)
    w = Window.partitionBy("qid").orderBy(order, "pos")
    first = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "pos")
    return first.join(F.broadcast(fixtures.languages(spark)), "lang", "left").withColumn(
        "language", F.coalesce("language", "lang"))


def multiling_set(spark, sf):
    """D3: (text_id, phase, priority, question, passage, title): train items in
    seeded order filled from the pages up to 1.2x, then the dev items; dense
    seeded ids."""
    m = multiling(spark, sf)
    items = m.select(F.concat(F.lit("q"), "qid").alias("docid"), "split", "question", "passage", "title")
    pages = fixtures.page_fields(spark, sf).select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("docid"), F.lit(None).cast("string").alias("question"),
        F.regexp_replace("passage", "\n", " ").alias("passage"), tx.strip_ws("title").alias("title"))
    train, dev = (items.where(F.col("split") == s) for s in ("train", "dev"))
    ids = positioned(spark, train, pages, dev, (train.count() * 12) // 10)
    return ids.join(items.drop("split").unionByName(pages), "docid")


@register("multiling_train")
def q_multiling_train(spark, sf):
    """Passages of all documents, dev ones included, and the train questions."""
    m = multiling_set(spark, sf)
    return (m.select("text_id", tx.role_prefix(tx.PASSAGE_PROMPT, "title", "passage").alias("text"))
            .unionByName(m.where("priority = 0").select("text_id", tx.role_prefix(tx.QUESTION_PROMPT, "question").alias("text"))))


@register("multiling_dev")
def q_multiling_dev(spark, sf):
    m = multiling_set(spark, sf).where("phase = 1")
    return m.select("text_id", tx.role_prefix(tx.QUESTION_PROMPT, "question").alias("text"))


@register("multiling_corpus")
def q_multiling_corpus(spark, sf):
    m = multiling_set(spark, sf)
    return m.select("text_id", F.concat_ws("\t", F.col("text_id").cast("string"), "passage", "title").alias("line"))


@register("generator_pairs")
def q_generator_pairs(spark, sf):
    """Prompt -> question, one per unique qid; train and dev templates."""
    m = multiling(spark, sf)
    prompt = F.when(F.col("split") == "train", F.format_string(PROMPT_TEMPLATE, "language", "title", "passage")) \
        .otherwise(F.format_string(DEV_PROMPT_TEMPLATE, "language", "title", "passage"))
    return m.select("split", "qid", F.col("question").alias("text_id"), prompt.alias("text"))


@register("ranker_groups")
def q_ranker_groups(spark, sf):
    """question groups that have positives and negatives."""
    r = fixtures.ranker_contexts(spark, sf)
    g = r.groupBy("source", "question").agg(
        F.sum(F.col("is_positive").cast("int")).cast("bigint").alias("n_pos"),
        F.sum((~F.col("is_positive")).cast("int")).cast("bigint").alias("n_neg"))
    return g.where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
