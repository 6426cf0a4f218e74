"""R2: BM25 retrieval, exact and pruned.

score(q, d) = sum over query terms t of
    qf(t) * idf(t) * tf / (tf + k1 * (1 - b + b * dl / avgdl))

``bm25_search`` deals the documents out in shards, each of which meets every
query and gives its ``k`` best (``bm25_shards``); the lists are merged.

``required_terms`` tells which postings a query needs at all.  All
contributions are positive, and a term adds at most its weight times the
largest saturated tf of its postings (``impact``), so common terms need not be
read:

1. The terms of largest bound are scored first, until their postings can fill
   the list a few times; the best documents found get their full scores by
   look-ups.  The k-th of these is a lower bound ``theta`` for the k-th score.
2. Terms are taken by rising bound.  Those whose bounds together stay below
   theta are optional: a document that has only those cannot enter the list.
   A posting of a later term matters only if it and all smaller terms together
   can reach theta, which is a least impact per term; postings lie in blocks of
   falling impact, and blocks below it are not read.

Scores are rounded to 6 decimals, so bounds are compared with a margin and
ties at the cut survive.  No term and no document is dropped that could change
the list.  A term with more postings than a task should get is spread over
ceil(df / limit) sub-keys on both sides; as the sum of df is at most n_tokens
there are at most ``max_hot`` such terms, which bounds the broadcast list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators.bm25_shards import shard_hits
from quarry.operators.index import B, K1, Index, blocks_of, saturated
from quarry.session import written

DEPTH = 20
MARGIN = 3e-6               # three roundings to 6 decimals
POSTINGS_PER_TASK = 200_000
FILL = 10                   # postings scored first, in lists of k
TRIED = 3                   # documents that get full scores for theta, in lists of k


def query_terms(queries: DataFrame, qid: str = "query_id", text: str = "query",
                tokenizer=tx.tokens) -> DataFrame:
    return (queries.select(F.col(qid).alias("query_id"),
                           F.explode(tokenizer(F.col(text))).alias("term"))
            .groupBy("query_id", "term").agg(F.count("*").alias("qf")))


def hot_terms(index: Index, max_hot: int = 10_000) -> DataFrame:
    """Terms with df > n_tokens / max_hot (fewer than ``max_hot`` rows)."""
    limit = index.n_tokens / float(max_hot)
    return index.term_stats.where(F.col("df") > F.lit(limit)).select(
        "term", F.lit(True).alias("is_hot"))


def _salts(index: Index, max_hot: int = 10_000) -> DataFrame:
    """(term, salts) of the terms with more postings than a task should get."""
    limit = max(POSTINGS_PER_TASK, index.n_tokens // max_hot + 1)
    return index.term_stats.where(F.col("df") > limit).select("term", F.ceil(F.col("df") / limit).cast("int").alias("salts"))


def contributions(index: Index, weighted: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, part): ``weighted`` (query_id, term, qw, need) joined
    with the blocks of its terms; postings of less impact than ``need`` are
    left out, and so are whole blocks of them."""
    blocks = index.blocks if (k1, b) == (K1, B) else blocks_of(index.postings, index.avgdl, k1, b)
    salts = F.broadcast(_salts(index))
    n = F.coalesce("salts", F.lit(1))
    qt = weighted.join(salts, "term", "left").select(
        "query_id", "term", "qw", "need", F.explode(F.sequence(F.lit(0), n - 1)).alias("salt"))
    held = blocks.join(salts, "term", "left").select("term", "top", "docs", F.pmod("block", n).cast("int").alias("salt"))
    met = qt.alias("q").join(held.alias("h"), (F.col("q.term") == F.col("h.term")) & (F.col("q.salt") == F.col("h.salt"))
                             & (F.col("h.top") >= F.col("q.need")))
    rows = met.select("query_id", "qw", "need", F.explode("docs").alias("d")).select("query_id", "qw", "need", "d.*")
    rows = rows.withColumn("impact", saturated(index.avgdl, k1, b)).where("impact >= need")
    return rows.select("query_id", "doc_id", (F.col("qw") * F.col("impact")).alias("part"))


def looked_up(index: Index, pairs: DataFrame, weighted: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, part): what the terms of ``weighted`` (query_id,
    term, qw, below) add to the documents of ``pairs`` (query_id, doc_id) by
    postings of less impact than ``below`` (null: by any)."""
    rows = pairs.join(weighted, "query_id").join(index.postings, ["doc_id", "term"])
    impact = saturated(index.avgdl, k1, b)
    return rows.where(F.col("below").isNull() | (impact < F.col("below"))).select(
        "query_id", "doc_id", (F.col("qw") * impact).alias("part"))


def bm25_scores(index: Index, queries: DataFrame, qid: str = "query_id", text: str = "query",
                k1: float = K1, b: float = B, tokenizer=tx.tokens) -> DataFrame:
    """All (query_id, doc_id, score) with score > 0: every posting is read."""
    qt = query_terms(queries, qid, text, tokenizer).join(index.term_stats.select("term", "idf"), "term").select(
        "query_id", "term", (F.col("qf") * F.col("idf")).alias("qw"), F.lit(0.0).alias("need"))
    return contributions(index, qt, k1, b).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def top_k(scores: DataFrame, k: int = DEPTH, key: str = "query_id", item: str = "doc_id",
          score: str = "score") -> DataFrame:
    """Best ``k`` per key by round(score, 6) desc, then item asc."""
    s = scores.withColumn(score, F.round(F.col(score), 6))
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(item))
    return (s.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .where(F.col("rank") <= k))


def required_terms(index: Index, queries: DataFrame, k: int, qid: str = "query_id", text: str = "query",
                   k1: float = K1, b: float = B, tokenizer=tx.tokens) -> DataFrame:
    """(query_id, term, qw, required, need, unread, u_rank, theta, optional):
    which terms' postings have to be read and from what impact on, the lower
    bound of the k-th score, and what the unread postings can add at most, of
    this term (``u_rank``: its place by that) and of all."""
    stats = index.term_stats
    if (k1, b) != (K1, B):
        stats = stats.drop("impact").join(
            index.postings.groupBy("term").agg(F.max(saturated(index.avgdl, k1, b)).alias("impact")), "term")
    qt = query_terms(queries, qid, text, tokenizer).join(stats.select("term", "idf", "df", "impact"), "term").select(
        "query_id", "term", "df", (F.col("qf") * F.col("idf")).alias("qw"),
        (F.col("qf") * F.col("idf") * F.col("impact")).alias("most"))
    down = Window.partitionBy("query_id").orderBy(F.col("most").desc(), "term").rowsBetween(Window.unboundedPreceding, -1)
    qt = written(qt.withColumn("first", F.coalesce(F.sum("df").over(down), F.lit(0)) < FILL * k), "bm25-terms")
    partial = contributions(index, qt.where("first").withColumn("need", F.lit(0.0)), k1, b) \
        .groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
    tried = written(top_k(partial, TRIED * k).select("query_id", "doc_id", F.col("score").alias("part")), "bm25-tried")
    rest = qt.where("NOT first").select("query_id", "term", "qw", F.lit(None).cast("double").alias("below"))
    full = tried.unionByName(looked_up(index, tried.select("query_id", "doc_id"), rest, k1, b)) \
        .groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
    theta = top_k(full, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("theta"))
    up = F.sum("most").over(Window.partitionBy("query_id").orderBy("most", "term"))
    least = F.col("theta") - MARGIN
    qt = qt.join(theta, "query_id", "left").withColumn("theta", F.coalesce("theta", F.lit(0.0))).withColumn("up", up)
    qt = qt.withColumn("required", F.col("up") >= least)
    qt = qt.withColumn("need", F.when(F.col("required"), F.greatest(F.lit(0.0), (least - F.col("up") + F.col("most")) / F.col("qw"))))
    qt = qt.withColumn("unread", F.when(~F.col("required"), F.col("most")).otherwise(
        F.least(F.col("most"), F.col("need") * F.col("qw"))))
    per = Window.partitionBy("query_id")
    return written(qt.select("query_id", "term", "df", "qw", "required", "need", "unread", "theta",
                             F.row_number().over(per.orderBy(F.col("unread").desc(), "term")).alias("u_rank"),
                             F.sum("unread").over(per).alias("optional")), "bm25-required")


def postings_read(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, read, all): postings in the blocks that the reading join
    takes for ``required_terms`` rows, and in all blocks of their terms."""
    met = terms.join(index.blocks.select("term", "n", "top"), "term")
    return met.groupBy("query_id").agg(
        F.sum(F.when(F.col("required") & (F.col("top") >= F.col("need")), F.col("n")).otherwise(0)).alias("read"), F.sum("n").alias("all"))


def bm25_search(index: Index, queries: DataFrame, k: int = DEPTH, qid: str = "query_id", text: str = "query",
                k1: float = K1, b: float = B, tokenizer=tx.tokens) -> DataFrame:
    """(query_id, rank, doc_id, score) for the top ``k`` hits per query."""
    qt = query_terms(queries, qid, text, tokenizer).join(index.term_stats.select("term", "idf"), "term").select(
        "query_id", "term", (F.col("qf") * F.col("idf")).alias("qw"))
    found = shard_hits(index.postings, qt, index.n_docs, index.avgdl or 1.0, k, k1, b, index.documents)
    return top_k(found, k).select("query_id", "rank", "doc_id", "score")
