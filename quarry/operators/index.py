"""Inverted index as tables.

postings(term, doc_id, tf, dl)  - one row per distinct (doc, term)
blocks(term, block, n, top, docs) - the same postings by falling saturated tf,
                                  up to ``BLOCK_POSTINGS`` a row; ``top`` is the
                                  largest saturated tf of the block (made when
                                  first asked for: its order over all postings
                                  costs several times what the postings do)
doc_stats(doc_id, dl)           - analyzed length per document
term_stats(term, df, idf, impact) - document frequency, BM25 idf and the largest
                                  saturated tf of the term's postings
scalars: n_docs, avgdl, n_postings

The analyzed corpus is tokenized once and persisted (or written to
``path`` when given, which is the form to use at cluster scale: index once,
query many times).  Counting tf groups by (doc_id, term); with the corpus
hash-partitioned by doc_id that aggregate needs no further shuffle, and the
partial aggregate collapses repeats inside the document before any exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text as tx
from quarry.operators.order import global_row_number
from quarry.session import materialize, ship_package


# The reference's BM25 settings.
K1 = 0.9
B = 0.4
BLOCK_POSTINGS = 64
#: Characters of text that a task of the index gets at most, so that the memory
#: of its counting does not grow with the corpus.
TASK_CHARS = 16_000_000
#: Tokens that are counted at a time where documents are counted row by row.
BATCH_TOKENS = 1 << 20


def saturated(avgdl: float, k1: float = K1, b: float = B) -> Column:
    """tf / (tf + k1 * (1 - b + b * dl / avgdl))."""
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl))
    return F.col("tf") / (F.col("tf") + norm)


@dataclass
class Index:
    postings: DataFrame
    make_blocks: Callable[[], DataFrame]
    doc_stats: DataFrame
    term_stats: DataFrame
    n_docs: int
    avgdl: float
    n_tokens: int   # sum of dl >= sum of df (bounds the hot-term list)
    documents: DataFrame | None = None      # the postings by document (doc_id, dl, terms), where they lie so

    @cached_property
    def blocks(self) -> DataFrame:
        return self.make_blocks()


def analyze(docs: DataFrame, id_col: str = "doc_id", text_col: str = "contents",
            tokenizer=tx.tokens) -> DataFrame:
    """(doc_id, dl, tokens) with the pluggable ``tokenizer`` (Column -> array<string>)."""
    toks = tokenizer(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), toks.alias("tokens")).select(
        "doc_id", F.size("tokens").cast("bigint").alias("dl"), "tokens")


def document_terms(analyzed: DataFrame, with_positions: bool = False) -> DataFrame:
    """(doc_id, dl, terms): a row per row of ``analyzed`` that has a token, its
    terms in order with tf (and positions).  Documents are counted where they
    are, ``BATCH_TOKENS`` tokens at a time, so nothing is shuffled or spilled."""
    ship_package(analyzed.sparkSession)
    entry = [T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]
    if with_positions:
        entry.append(T.StructField("positions", T.ArrayType(T.LongType())))
    schema = T.StructType([analyzed.schema["doc_id"], T.StructField("dl", T.LongType()), T.StructField("terms", T.ArrayType(T.StructType(entry)))])

    # empty rows leave here: a filter on dl would cut every text once more
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater(batch["dl"], 0))
            sizes = np.asarray(batch["dl"], np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // BATCH_TOKENS)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if z > a:
                    yield counted(batch.slice(a, z - a), with_positions)
    return analyzed.select("doc_id", "dl", "tokens").mapInArrow(run, schema)


def counted(batch: pa.RecordBatch, with_positions: bool) -> pa.RecordBatch:
    """The terms of a batch of documents (doc_id, dl, tokens)."""
    sizes = np.asarray(pc.list_value_length(batch["tokens"]), np.int64)
    names = batch["tokens"].flatten().dictionary_encode()
    order = np.asarray(pc.sort_indices(names.dictionary), np.int64)     # by bytes, as Spark sorts strings
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[np.asarray(names.indices, np.int64)]
    first = np.cumsum(sizes) - sizes
    key = np.repeat(np.arange(len(sizes)), sizes) * max(1, len(order)) + code
    by = np.argsort(key, kind="stable")                                 # of one term by position
    key = key[by]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    doc, term = np.divmod(key[start], max(1, len(order)))
    ends = np.append(start, len(key))
    columns = {"term": names.dictionary.take(pa.array(order[term])), "tf": pa.array(np.diff(ends))}
    if with_positions:
        at = by - np.repeat(first, sizes)[by]
        columns["positions"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at))
    entries = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    terms = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(sizes) + 1)), pa.int32()), entries)
    return pa.RecordBatch.from_arrays([batch["doc_id"], batch["dl"], terms], ["doc_id", "dl", "terms"])


def postings_of(analyzed: DataFrame, with_positions: bool = False, distinct_ids: bool = False) -> DataFrame:
    """(doc_id, term, dl, tf) of an analyzed corpus, with ``positions`` if
    wanted.  With ``distinct_ids`` no id but null comes twice: then documents
    are counted row by row, and only rows without an id are brought together."""
    if distinct_ids:
        return postings_in(distinct_documents(analyzed, with_positions))
    ex = analyzed.select("doc_id", "dl", F.posexplode("tokens").alias("pos", "term"))
    aggs = [F.count("*").alias("tf")]
    if with_positions:
        aggs.append(F.array_sort(F.collect_list(F.col("pos").cast("bigint"))).alias("positions"))
    return ex.groupBy("doc_id", "term", "dl").agg(*aggs)


def distinct_documents(analyzed: DataFrame, with_positions: bool = False) -> DataFrame:
    """(doc_id, dl, terms) of an analyzed corpus where no id but null comes twice."""
    rest = postings_of(analyzed.where("doc_id IS NULL"), with_positions)
    rest = rest.groupBy("doc_id", "dl").agg(F.collect_list(F.struct("term", *rest.columns[3:])).alias("terms"))
    return document_terms(analyzed.where("doc_id IS NOT NULL"), with_positions).unionByName(rest)


def postings_in(documents: DataFrame) -> DataFrame:
    """(doc_id, term, dl, ...): the entries of (doc_id, dl, terms)."""
    names = documents.schema["terms"].dataType.elementType.names
    return documents.select("doc_id", "dl", F.explode("terms").alias("t")).select("doc_id", "t.term", "dl", *[f"t.{c}" for c in names[1:]])


def blocks_of(postings: DataFrame, avgdl: float, k1: float = K1, b: float = B) -> DataFrame:
    """Postings in blocks of falling impact.  The order over all terms is the
    distributed one, so a term with any number of postings is spread over
    tasks; a block ends with its term, or every ``BLOCK_POSTINGS`` places."""
    keyed = postings.select("term", (-saturated(avgdl, k1, b)).alias("_down"), "doc_id", "tf", "dl")
    numbered = global_row_number(keyed, ["term", "_down", "doc_id"])
    return numbered.groupBy("term", F.floor(F.col("rn") / BLOCK_POSTINGS).alias("block")).agg(
        F.count("*").alias("n"), (-F.min("_down")).alias("top"),
        F.collect_list(F.struct("doc_id", "tf", "dl")).alias("docs"))


def idf_expr(df: Column, n_docs: Column) -> Column:
    """BM25 idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    return F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def index_tasks(docs: DataFrame, text_col: str, task_chars: int = TASK_CHARS) -> int:
    """Number of tasks of about ``task_chars`` characters of text (a scan)."""
    chars = docs.agg(F.sum(F.length(text_col).cast("bigint"))).first()[0] or 0
    return -(-int(chars) // task_chars)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "contents",
                tokenizer=tx.tokens, path: str | None = None,
                prepartitioned: bool = False, tasks: int = 0, distinct_ids: bool = False) -> Index:
    """Tokenize once; postings are hash-partitioned by doc_id so the per-doc
    statistics need no further shuffle.  Postings are persisted, or written
    to ``path`` (a shared folder) when given.  There are ``tasks`` partitions,
    or the session's number of them if that is more.  With ``distinct_ids``
    (no id but null comes twice) documents are counted where they are.

    N and avgdl follow Lucene's collection statistics: documents with at
    least one term, and total term frequency / N."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not prepartitioned and not distinct_ids:          # caller did not hash-partition by the id yet
        docs = docs.repartition(max(parts, tasks), id_col)
    analyzed = analyze(docs, id_col, text_col, tokenizer)
    documents = None
    if path and distinct_ids:           # written by document: smaller, and BM25 deals documents out
        distinct_documents(analyzed).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/documents")
        documents = spark.read.parquet(f"{path}/documents")
        postings = postings_in(documents)
    else:
        postings = postings_of(analyzed, distinct_ids=distinct_ids)
    if documents is None and path:
        postings.write.mode("overwrite").parquet(f"{path}/postings")
        postings = spark.read.parquet(f"{path}/postings")
    elif documents is None:
        postings = postings.persist(StorageLevel.MEMORY_AND_DISK)
    doc_stats = (postings if documents is None else documents).groupBy("doc_id").agg(F.max("dl").alias("dl"))
    row = doc_stats.agg(F.count("*").alias("n"), F.sum("dl").alias("s")).first()
    n_docs = int(row["n"])
    total = int(row["s"] or 0)
    avgdl = (float(total) / n_docs) if n_docs else 0.0
    term_stats = (postings.groupBy("term").agg(F.count("*").alias("df"), F.max(saturated(avgdl or 1.0)).alias("impact"))
                  .withColumn("idf", idf_expr(F.col("df"), F.lit(float(n_docs)))))
    if path:
        term_stats.write.mode("overwrite").parquet(f"{path}/terms")
        term_stats = spark.read.parquet(f"{path}/terms")
    else:
        term_stats = materialize(term_stats)     # read by several plan branches

    def make_blocks() -> DataFrame:
        blocks = blocks_of(postings, avgdl or 1.0)
        if not path:
            return blocks.persist(StorageLevel.MEMORY_AND_DISK)
        blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        return spark.read.parquet(f"{path}/blocks")
    return Index(postings, make_blocks, doc_stats, term_stats, n_docs, avgdl, total, documents)
