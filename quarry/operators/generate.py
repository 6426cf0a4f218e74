"""Query generation per document.

Default generator is extractive: each sentence is scored by the mean idf
of its tokens, the best ``n`` sentences (ties: earlier first) become
queries, cut to ``q_max_length`` tokens.  A part of the documents looks its
distinct tokens up in the term statistics (one join) and adds up the answers
(numpy in Arrow batches).

``sampled_queries`` draws instead of taking the best: of the ``top_k`` best
sentences, ``n`` without replacement with chances in proportion to
exp(score / temperature).  Ranking score / temperature plus a Gumbel variate
per sentence is that draw, and the variates come from md5 of seed, document
and sentence, so a draw is the same in every run, engine and partitioning.

A model generator plugs in through ``generate_with`` - a ``mapInPandas``
function over (doc_id, text) batches that yields (doc_id, q_rank, query);
Spark partitions the documents and runs the model per batch.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text as tx
from quarry.operators.index import BATCH_TOKENS
from quarry.session import ship_package, written

# The reference's default query length and number of choices.
Q_MAX_LENGTH = 32
TOP_K = 10


def sentence_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, toks): a document's sentences as lists of tokens, empty ones
    included, so that a place in the list is the sentence's number."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.transform(tx.sentences(F.col(text_col)), tx.tokens).alias("toks"))


def extractive_queries(docs: DataFrame, term_stats: DataFrame, hot_terms: DataFrame,
                       n: int = 1, q_max_length: int = Q_MAX_LENGTH,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    best = best_sentences(sentence_rows(docs, id_col, text_col), term_stats, hot_terms, n)
    return with_text(best, docs, q_max_length, id_col, text_col).select("doc_id", "q_rank", "query")


def sentence_parts(sents: DataFrame, hot: list[tuple[str, float]]) -> DataFrame:
    """A row per document, (part, doc_id, sentences), and a row per part,
    (part, names).  A part is a run of documents of about ``BATCH_TOKENS``
    tokens.  Of each sentence that has a token: its number, the sum and the
    count of its ``hot`` tokens' idf, and its other tokens as places in the
    part's ``names``, its distinct other tokens."""
    ship_package(sents.sparkSession)
    # a term that comes twice counts twice, as in a join
    total: dict[str, list[float]] = {}
    for term, idf in hot:
        total.setdefault(term, []).append(idf)
    names = pa.array(list(total), pa.string())
    sums = np.array([*(sum(v) for v in total.values()), 0.0])       # the last one: not hot
    many = np.array([*(len(v) for v in total.values()), 0], np.int64)
    entry = T.StructType([T.StructField("sent_pos", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType()),
                          T.StructField("cold", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([T.StructField("part", T.LongType()), sents.schema["doc_id"], T.StructField("sentences", T.ArrayType(entry)),
                           T.StructField("names", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        for batch in batches:
            ends = np.cumsum(np.asarray(pc.list_value_length(batch["toks"]).fill_null(0), np.int64))
            sizes = np.asarray(pc.list_value_length(batch["toks"].flatten()).fill_null(0), np.int64)
            tokens = np.concatenate([[0], np.cumsum(sizes)])[ends]
            cuts = np.flatnonzero(np.diff(tokens // BATCH_TOKENS)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if z > a:
                    yield from rated(batch.slice(a, z - a), part, names, sums, many)
                    part += 1
    return sents.select("doc_id", "toks").mapInArrow(run, schema)


def rated(batch: pa.RecordBatch, part: int, names: pa.Array, sums: np.ndarray, many: np.ndarray) -> list[pa.RecordBatch]:
    """``sentence_parts`` of a part: its documents' rows, its row of names."""
    per_doc = np.asarray(pc.list_value_length(batch["toks"]).fill_null(0), np.int64)
    sentences = batch["toks"].flatten()
    sizes = np.asarray(pc.list_value_length(sentences).fill_null(0), np.int64)
    coded = sentences.flatten().dictionary_encode()
    code = np.asarray(coded.indices, np.int64)
    found = np.asarray(pc.index_in(coded.dictionary, names).fill_null(len(names)), np.int64)
    at = found[code]                                                    # of each token among the hot terms
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(sentence, weights=sums[at], minlength=len(sizes))
    n = np.bincount(sentence, weights=many[at], minlength=len(sizes)).astype(np.int64)
    cold = at == len(names)
    other = found == len(names)
    place_of = np.cumsum(other) - 1
    cold_ends = np.concatenate([[0], np.cumsum(np.bincount(sentence[cold], minlength=len(sizes)))])
    document = np.repeat(np.arange(len(per_doc)), per_doc)
    pos = np.arange(len(sizes)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    live = np.flatnonzero(sizes > 0)
    places = pa.ListArray.from_arrays(pa.array(cold_ends, pa.int32()), pa.array(place_of[code[cold]], pa.int32()))
    entries = pa.StructArray.from_arrays([pa.array(pos[live]), pa.array(total[live]), pa.array(n[live]), places.take(pa.array(live))],
                                         ["sent_pos", "total", "n", "cold"])
    ends = np.searchsorted(document[live], np.arange(len(per_doc) + 1))
    held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)
    fields, strings = ["part", "doc_id", "sentences", "names"], pa.list_(pa.string())
    terms = pa.ListArray.from_arrays(pa.array([0, int(other.sum())], pa.int32()), coded.dictionary.filter(pa.array(other)))
    return [pa.RecordBatch.from_arrays([pa.array([part] * len(per_doc), pa.int64()), batch["doc_id"], held, pa.nulls(len(per_doc), strings)], fields),
            pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.nulls(1, batch["doc_id"].type), pa.nulls(1, held.type), terms], fields)]


def added_up(documents: pa.Table, stats: pa.Table) -> pa.Table:
    """(doc_id, sent_pos, total, n) of a part's sentences, from its documents'
    rows and (place, idf) of its names."""
    documents = documents.combine_chunks()
    ids, lists = (documents.column(c).combine_chunks() for c in ("doc_id", "sentences"))
    entries = lists.flatten()
    per_doc = np.asarray(pc.list_value_length(lists).fill_null(0), np.int64)
    cold = entries.field("cold")
    sizes = np.asarray(pc.list_value_length(cold).fill_null(0), np.int64)
    places, sentence = np.asarray(cold.flatten(), np.int64), np.repeat(np.arange(len(sizes)), sizes)
    at, idf = np.asarray(stats.column("place"), np.int64), np.asarray(stats.column("idf"), np.float64)
    most = int(max(places.max(initial=-1), at.max(initial=-1))) + 1
    value, times = np.bincount(at, weights=idf, minlength=most), np.bincount(at, minlength=most)
    total = np.asarray(entries.field("total"), np.float64) + np.bincount(sentence, weights=value[places], minlength=len(sizes))
    n = np.asarray(entries.field("n"), np.int64) + np.bincount(sentence, weights=times[places], minlength=len(sizes)).astype(np.int64)
    row = pa.array(np.repeat(np.arange(len(per_doc)), per_doc))
    out = pa.table({"doc_id": ids.take(row), "sent_pos": entries.field("sent_pos"), "total": pa.array(total), "n": pa.array(n)})
    return out.filter(pa.array(n > 0))


def best_sentences(sents: DataFrame, term_stats: DataFrame, hot_terms: DataFrame, n: int) -> DataFrame:
    """(doc_id, sent_pos, score, q_rank): the ``n`` sentences of highest mean
    idf per document.  ``hot_terms`` has a proven bound: their idf goes to the
    tasks.  Of the other tokens only the distinct ones of a part are shuffled
    to the statistics, and the part's documents, with places for tokens, meet
    the answers; tokens themselves never leave their document."""
    idf = term_stats.select("term", "idf")
    hot = [(r["term"], r["idf"]) for r in idf.join(F.broadcast(hot_terms.select("term").distinct()), "term", "left_semi").collect()]
    parts = written(sentence_parts(sents, hot), "sentence-parts")
    names = parts.where("names IS NOT NULL").select(F.col("part").alias("of"), F.posexplode("names").alias("place", "term"))
    stats = names.join(idf, "term").select("of", "place", "idf")
    documents = parts.where("names IS NULL").select("part", "doc_id", "sentences")
    schema = T.StructType([sents.schema["doc_id"], T.StructField("sent_pos", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])
    sums = documents.groupBy("part").cogroup(stats.groupBy("of")).applyInArrow(added_up, schema)
    scored = sums.groupBy("doc_id", "sent_pos").agg(F.round(F.sum("total") / F.sum("n"), 6).alias("score"))
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), F.col("sent_pos"))
    return (scored.withColumn("q_rank", F.row_number().over(w).cast("bigint"))
            .where(F.col("q_rank") <= n))


def with_text(best: DataFrame, docs: DataFrame, q_max_length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The text of the chosen sentences: a document's chosen numbers meet its
    text, and only those sentences are cut into tokens."""
    mine = best.select("doc_id", F.struct(*[c for c in best.columns if c != "doc_id"]).alias("b")).groupBy("doc_id").agg(
        F.collect_list("b").alias("chosen"))
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    held = text.join(mine, "doc_id").withColumn("_held", tx.sentences("_text"))
    rows = held.select("doc_id", F.explode(F.transform("chosen", lambda b: F.struct(
        b.alias("b"), F.get(F.col("_held"), b["sent_pos"].cast("int")).alias("sentence")))).alias("x"))
    toks = rows.select("doc_id", "x.b.*", tx.tokens("x.sentence").alias("toks")).where(F.size("toks") > 0)
    return toks.withColumn("query", F.array_join(F.slice("toks", 1, q_max_length), " ")).drop("toks")


def gumbel(seed: int, *keys) -> F.Column:
    """A Gumbel variate from md5 of seed and keys: 52 bits make a uniform."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def sampled_queries(docs: DataFrame, term_stats: DataFrame, hot_terms: DataFrame, n: int = 1, top_k: int = TOP_K,
                    temperature: float = 1.0, seed: int = 313, q_max_length: int = Q_MAX_LENGTH,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, q_rank, query): ``n`` seeded draws from each document's
    ``top_k`` best sentences (fewer where it has fewer)."""
    some = best_sentences(sentence_rows(docs, id_col, text_col), term_stats, hot_terms, top_k).drop("q_rank")
    drawn = some.withColumn("draw", F.round(F.col("score") / temperature + gumbel(seed, "doc_id", "sent_pos"), 6))
    w = Window.partitionBy("doc_id").orderBy(F.col("draw").desc(), F.col("sent_pos"))
    drawn = drawn.withColumn("q_rank", F.row_number().over(w).cast("bigint")).where(F.col("q_rank") <= n)
    return with_text(drawn, docs, q_max_length, id_col, text_col).select("doc_id", "q_rank", "query")


def generate_with(docs: DataFrame, fn: Callable[[Iterator], Iterator],
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Plug-in generator: ``fn`` is a mapInPandas function from batches of
    (doc_id, text) to batches of (doc_id, q_rank, query)."""
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInPandas(fn, "doc_id long, q_rank long, query string"))
