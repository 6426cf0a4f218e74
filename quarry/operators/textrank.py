"""TextRank sentence summary and keywords as Spark jobs.

Sentence graph (Mihalcea & Tarau 2004): w(i, j) = shared(i, j) / (ln n_i + ln n_j)
over the distinct kept terms of two sentences of one document (pairs with a
zero denominator skipped), PageRank with damping d over out-weight-normalised
edges, start value 1, fixed iterations.

No sentence pairs are materialised.  Since ln n_i only depends on the
sentence's term count, incoming mass regroups by (doc, term, n):
    in(j) = sum_{t in j} sum_n [A(t, n) - self] / (ln n_j + ln n),
    A(t, n) = sum over sentences i of length n containing t of s_i / W_i,
and W_i is computed the same way from sentence counts.  Every step is an
aggregate or equi-join over term occurrences - linear in the text, no
quadratic blow-up for long documents or frequent terms.

Keyword graph: consecutive kept tokens (window 2) are linked, unweighted;
PageRank per document; the top terms become the keyword docid.

Stop terms: the stop lists of the documents' languages (Spark ML's default
lists, a few hundred words each, broadcast); a document in another language
keeps all its terms.  Adding documents never changes the result of others.

The joins and aggregates over term occurrences are linear in the text, but
for the (term, sentence length) table, which has a row per distinct length
that a term occurs with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.stopwords import stop_words
from quarry.session import cut_lineage, materialize

DAMPING = 0.85
ITERATIONS = 10
SUMMARY_WORDS = 15
KEYWORDS = 8


def stop_terms(spark: SparkSession) -> DataFrame:
    """(lang, term): the stop lists, under a thousand rows."""
    return spark.createDataFrame(stop_words(), "lang string, term string")


def sentence_nodes(docs: DataFrame, stops: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes(doc_id, pos, sentence, words, n), occ(doc_id, pos, term, n))."""
    s = (docs.select(F.col(id_col).alias("doc_id"),
                     "lang", F.posexplode(tx.sentences(F.col(text_col))).alias("pos", "raw"))
         .select("doc_id", "lang", F.col("pos").cast("bigint").alias("pos"),
                 tx.strip_ws("raw").alias("sentence")))
    s = s.withColumn("words", tx.word_count("sentence"))
    occ = s.select("doc_id", "lang", "pos", F.explode(F.array_distinct(tx.tokens("sentence"))).alias("term"))
    occ = occ.join(F.broadcast(stops), ["lang", "term"], "left_anti").drop("lang")
    s = s.drop("lang")
    n = occ.groupBy("doc_id", "pos").agg(F.count("*").alias("n"))
    nodes = s.join(n, ["doc_id", "pos"])             # sentences with >= 1 kept term
    occ = occ.join(n, ["doc_id", "pos"])
    return nodes, occ


def _inv_len_sum(occ_side: DataFrame, agg: DataFrame, val: str) -> DataFrame:
    """sum over (t in j, n) of (agg(t, n) - self) / (ln n_j + ln n) per sentence j."""
    j = occ_side.join(agg, ["doc_id", "term"])
    self_part = F.when(F.col("n") == F.col("m"), F.col("self")).otherwise(F.lit(0.0))
    den = F.log(F.col("n").cast("double")) + F.log(F.col("m").cast("double"))
    contrib = F.when(den > 0, (F.col(val) - self_part) / den).otherwise(F.lit(0.0))
    return j.groupBy("doc_id", "pos").agg(F.sum(contrib).alias("acc"))


def sentence_rank(nodes: DataFrame, occ: DataFrame, iterations: int = ITERATIONS,
                  damping: float = DAMPING) -> DataFrame:
    """(doc_id, pos, score) after ``iterations`` PageRank steps."""
    occ = materialize(occ.select("doc_id", "pos", "term", "n"))
    # W_i from sentence counts per (doc, term, length m)
    cnt = occ.groupBy("doc_id", "term", F.col("n").alias("m")).agg(F.count("*").cast("double").alias("c"))
    w = _inv_len_sum(occ.withColumn("self", F.lit(1.0)), cnt, "c").withColumnRenamed("acc", "W")
    state = materialize(nodes.select("doc_id", "pos", F.lit(1.0).alias("score"))
                        .join(w, ["doc_id", "pos"], "left").fillna(0.0, ["W"]))
    for it in range(iterations):
        x = state.select("doc_id", "pos", F.when(F.col("W") > 0, F.col("score") / F.col("W"))
                         .otherwise(F.lit(0.0)).alias("x"))
        ox = occ.join(x, ["doc_id", "pos"])
        a = ox.groupBy("doc_id", "term", F.col("n").alias("m")).agg(F.sum("x").alias("a"))
        inc = _inv_len_sum(ox.withColumnRenamed("x", "self"), a, "a")
        state = (state.select("doc_id", "pos", "W").join(inc, ["doc_id", "pos"], "left")
                 .select("doc_id", "pos", "W",
                         (F.lit(1.0 - damping) + F.lit(damping) * F.coalesce("acc", F.lit(0.0))).alias("score")))
        state = cut_lineage(state)           # an uncut plan would triple with every iteration
    occ.unpersist()
    return state.select("doc_id", "pos", "score")


def summarize(nodes: DataFrame, scores: DataFrame, words: int = SUMMARY_WORDS) -> DataFrame:
    """Greedy by round(score, 6) desc then position: add sentences while the
    word total gets no farther from ``words``; output in text order.

    Every node has at least one word and once the total reaches ``words``
    the next sentence always stops the greedy, so only the best
    ``words + 1`` sentences of a document can matter: that top-k cut runs
    as a partial limit before the shuffle, however long the document."""
    s = nodes.join(scores, ["doc_id", "pos"]).withColumn("score", F.round("score", 6))
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), F.col("pos"))
    s = s.withColumn("_top", F.row_number().over(w)).where(F.col("_top") <= words + 1).drop("_top")
    before = F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("before", before)
    worse = (F.abs(F.lit(words) - F.col("before") - F.col("words")) > F.abs(F.lit(words) - F.col("before")))
    s = s.withColumn("stop", F.max(worse.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    picked = s.where(F.col("stop") == 0)
    return picked.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))),
                                 lambda r: r["sentence"]), "\n").alias("summary"))


def consecutive(t: DataFrame, block: int = 4096) -> DataFrame:
    """(doc_id, term, nxt): each kept token and the next kept token of its
    document (self-pairs dropped).  The lead runs inside (doc, block of
    positions) windows; the last token of a block links to the first token
    of the next non-empty block through a per-block table, so one huge
    document is spread over many tasks."""
    t = t.withColumn("blk", F.floor(F.col("p") / block))
    w = Window.partitionBy("doc_id", "blk").orderBy("p")
    inner = t.select("doc_id", "blk", "p", "term", F.lead("term").over(w).alias("nxt"))
    ends = t.groupBy("doc_id", "blk").agg(F.min_by("term", "p").alias("first"),
                                          F.max_by("term", "p").alias("last"))
    wb = Window.partitionBy("doc_id").orderBy("blk")          # one row per block
    bridge = ends.select("doc_id", F.col("last").alias("term"),
                         F.lead("first").over(wb).alias("nxt"))
    pairs = inner.where(F.col("nxt").isNotNull()).select("doc_id", "term", "nxt").unionByName(
        bridge.where(F.col("nxt").isNotNull()))
    return pairs.where(F.col("term") != F.col("nxt"))


def keyword_rank(docs: DataFrame, stops: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 iterations: int = ITERATIONS, damping: float = DAMPING, block: int = 4096) -> DataFrame:
    """(doc_id, term, score): PageRank over the window-2 co-occurrence graph."""
    t = (docs.select(F.col(id_col).alias("doc_id"), "lang",
                     F.posexplode(tx.tokens(F.col(text_col))).alias("p", "term"))
         .join(F.broadcast(stops), ["lang", "term"], "left_anti").drop("lang"))
    t = materialize(t)                 # read by the pair and the node branches
    pairs = consecutive(t, block)
    both = F.explode(F.array(F.struct(F.col("term").alias("u"), F.col("nxt").alias("v")),
                             F.struct(F.col("nxt").alias("u"), F.col("term").alias("v"))))
    und = pairs.select("doc_id", both.alias("e")).select("doc_id", "e.u", "e.v").distinct()
    und = materialize(und)
    deg = und.groupBy("doc_id", F.col("u").alias("term")).agg(F.count("*").alias("deg"))
    # the degree rides along in the state: one join per iteration fewer
    state = materialize(t.select("doc_id", "term").distinct().join(deg, ["doc_id", "term"], "left")
                        .withColumn("score", F.lit(1.0)))
    for it in range(iterations):
        x = state.select("doc_id", F.col("term").alias("u"),
                         F.when(F.col("deg") > 0, F.col("score") / F.col("deg")).otherwise(F.lit(0.0)).alias("x"))
        inc = und.join(x, ["doc_id", "u"]).groupBy("doc_id", F.col("v").alias("term")).agg(F.sum("x").alias("acc"))
        state = (state.select("doc_id", "term", "deg").join(inc, ["doc_id", "term"], "left")
                 .select("doc_id", "term", "deg",
                         (F.lit(1.0 - damping) + F.lit(damping) * F.coalesce("acc", F.lit(0.0))).alias("score")))
        state = cut_lineage(state)           # an uncut plan would triple with every iteration
    t.unpersist()
    und.unpersist()
    return state.select("doc_id", "term", "score")


def keywords(kw_scores: DataFrame, n: int = KEYWORDS) -> DataFrame:
    """(doc_id, keywords): top ``n`` terms by round(score, 6) desc, term asc,
    space-joined in that order (fewer when the text has fewer terms)."""
    s = kw_scores.withColumn("score", F.round("score", 6))
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), F.col("term"))
    top = s.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return top.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))),
                                 lambda r: r["term"]), " ").alias("keywords"))
