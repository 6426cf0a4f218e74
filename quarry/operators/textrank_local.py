"""R4, R5 document by document: TextRank without an Exchange.

A document's graphs never leave it, so all iterations run where the document
is.  Spark splits sentences and tokens; an Arrow batch of documents becomes
arrays of occurrences, and an iteration is a few weighted counts over all of
its documents at once (numpy); Spark builds the texts from the positions that
come back.  ``ranked`` is one narrow projection over the documents, with the
other columns staying in the JVM.

The sums are those of ``quarry.operators.textrank``.  The terms of a sentence
meet the others by cells (term, sentence length): with A(t, n) the mass of the
sentences of length n that hold t, a sentence j of length m gets from t
    sum over n of A(t, n) / (ln n + ln m),  less its own mass,
which is computed per pair of cells of a term, not per pair of sentences.

Documents longer than ``GIANT_CHARS`` characters take the shuffled form in
``quarry.operators.textrank`` instead, whose tasks hold no whole document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.stopwords import stop_words
from quarry.operators import textrank as shuffled
from quarry.operators.textrank import DAMPING, ITERATIONS, KEYWORDS, SUMMARY_WORDS
from quarry.session import ship_package

GIANT_CHARS = 4_000_000
#: Tokens of documents that are ranked at once: enough to make the cost of a
#: call small, few enough for the arrays to stay in the processor's cache.
GROUP_TOKENS = 1 << 17


# ------------------------------------------------------------------ graphs of some documents
def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by one sort (``np.unique`` hashes first)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (a, b) in order, for non-negative integers."""
    side = int(b.max(initial=0)) + 1
    key = distinct(a * side + b)
    return key // side, key % side


def sentence_scores(sentence: np.ndarray, term: np.ndarray, n_sentences: int, iterations: int, damping: float) -> tuple[np.ndarray, np.ndarray]:
    """(score, distinct kept terms) of every sentence; ``term`` numbers the
    terms of each document on its own."""
    s, t = distinct_pairs(sentence, term)
    n = np.bincount(s, minlength=n_sentences)
    side = int(n.max(initial=0)) + 1
    cells, cell = np.unique(t * side + n[s], return_inverse=True)
    cell_term, log = cells // side, np.log(np.maximum(cells % side, 1))
    # ordered pairs of different cells of a term
    first = np.searchsorted(cell_term, cell_term)
    many = np.searchsorted(cell_term, cell_term, side="right") - first
    frm = np.repeat(np.arange(len(cells)), many)
    to = np.arange(len(frm)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    other = frm != to
    frm, to = frm[other], to[other]
    weight = 1.0 / (log[frm] + log[to])             # one of two different lengths has a logarithm
    own = np.where(log > 0, 1.0 / np.maximum(2 * log, 1e-300), 0.0)

    def incoming(x: np.ndarray) -> np.ndarray:
        mass = np.bincount(cell, weights=x[s], minlength=len(cells))
        across = np.bincount(to, weights=mass[frm] * weight, minlength=len(cells))
        return np.bincount(s, weights=across[cell] + (mass[cell] - x[s]) * own[cell], minlength=n_sentences)

    out = incoming(np.ones(n_sentences))
    score = np.ones(n_sentences)
    for _ in range(iterations):
        score = (1.0 - damping) + damping * incoming(np.divide(score, out, out=np.zeros(n_sentences), where=out > 0))
    return score, n


def term_scores(document: np.ndarray, term: np.ndarray, n_terms: int, iterations: int, damping: float) -> np.ndarray:
    """Score of every term over the links of consecutive kept tokens."""
    linked = (document[1:] == document[:-1]) & (term[1:] != term[:-1])
    a, b = term[:-1][linked], term[1:][linked]
    u, v = distinct_pairs(np.concatenate([a, b]), np.concatenate([b, a]))
    degree = np.bincount(u, minlength=n_terms)
    score = np.ones(n_terms)
    for _ in range(iterations):
        share = np.divide(score, degree, out=np.zeros(n_terms), where=degree > 0)
        score = (1.0 - damping) + damping * np.bincount(v, weights=share[u], minlength=n_terms)
    return score


def picked(order: list[int], words: list[int], target: int) -> list[int]:
    """Greedy by rank: sentences while the word total gets no farther from
    ``target``, in text order."""
    out, total = [], 0
    for k in order:
        if abs(target - total - words[k]) > abs(target - total):
            break
        out.append(k)
        total += words[k]
    return sorted(out)


class Stops:
    """Which strings of a dictionary are stop words, per language."""

    def __init__(self, lists: list[tuple[str, str]]):
        self.words: dict[str, set] = {}
        for lang, word in lists:
            self.words.setdefault(lang, set()).add(word)

    def keep(self, strings: list[str], langs: list[str | None], lang_of: np.ndarray, string_of: np.ndarray) -> np.ndarray:
        """Whether each token stays; ``lang_of`` indexes ``langs``."""
        drop = np.zeros((len(langs), len(strings)), bool)
        for i, lang in enumerate(langs):
            words = self.words.get(lang, ())
            drop[i] = [x in words for x in strings] if words else False
        return ~drop[lang_of, string_of]


def rank_group(tokens: pa.ListArray, words: list[list[int]], langs: list, stops: Stops, iterations: int, damping: float,
               n_words: int, n_keywords: int) -> list[tuple[list[int], str]]:
    """(picked sentences, keywords) of documents whose ``tokens`` are a list a
    sentence."""
    docs = len(tokens)
    sentences = tokens.flatten()
    per_doc = np.array(tokens.value_lengths().fill_null(0), np.int64)
    per_sentence = np.array(sentences.value_lengths().fill_null(0), np.int64)
    doc_of = np.repeat(np.arange(docs), per_doc)
    coded = sentences.flatten().dictionary_encode()
    strings = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    string = np.asarray(coded.indices, dtype=np.int64)
    sentence = np.repeat(np.arange(len(doc_of)), per_sentence)
    document = doc_of[sentence]
    names = sorted({x for x in langs if x is not None})
    lang = np.array([names.index(x) if x is not None else len(names) for x in langs], np.int64)
    keep = stops.keep(strings, [*names, None], lang[document], string)
    sentence, document, string = sentence[keep], document[keep], string[keep]
    order = np.empty(len(strings), np.int64)
    by_name = np.asarray(pc.array_sort_indices(coded.dictionary), dtype=np.int64)      # bytes of UTF-8 go by code point
    order[by_name] = np.arange(len(strings))
    pairs, term = np.unique(document * max(1, len(strings)) + order[string], return_inverse=True)
    term_doc, term_name = pairs // max(1, len(strings)), pairs % max(1, len(strings))

    score, kept = sentence_scores(sentence, term, len(doc_of), iterations, damping)
    live = np.flatnonzero(kept)
    live = live[np.lexsort((live, -np.round(score[live], 6), doc_of[live]))]
    first = np.cumsum(per_doc) - per_doc
    cuts = np.searchsorted(doc_of[live], np.arange(docs + 1))
    out_sentences = []
    for d in range(docs):
        best = live[cuts[d]:cuts[d + 1]][:n_words + 1] - first[d]      # a sentence has a word at least
        out_sentences.append(picked(best.tolist(), words[d], n_words))

    value = np.round(term_scores(document, term, len(pairs), iterations, damping), 6)
    ranked_ = np.lexsort((term_name, -value, term_doc))
    cuts = np.searchsorted(term_doc, np.arange(docs + 1))
    out_terms = [" ".join(strings[by_name[term_name[k]]] for k in ranked_[a:min(z, a + n_keywords)])
                 for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return list(zip(out_sentences, out_terms))


def groups(tokens: pa.ListArray, most: int):
    """(start, end) of runs of documents of about ``most`` tokens."""
    offsets = np.concatenate([[0], np.cumsum(np.array(tokens.value_lengths().fill_null(0), np.int64))])
    sizes = np.concatenate([[0], np.cumsum(np.array(tokens.flatten().value_lengths().fill_null(0), np.int64))])[offsets]
    at = 0
    while at < len(tokens):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, side="right")) - 1)
        yield at, min(end, len(tokens))
        at = min(end, len(tokens))


# ------------------------------------------------------------------ Spark
def rank_udf(iterations: int = ITERATIONS, damping: float = DAMPING, n_words: int = SUMMARY_WORDS, n_keywords: int = KEYWORDS):
    """Arrow UDF (tokens by sentence, words by sentence, lang) -> (picked
    sentence numbers, keywords)."""
    lists = stop_words()
    kind = pa.struct([("picked", pa.list_(pa.int32())), ("keywords", pa.string())])

    @F.arrow_udf("struct<picked:array<int>,keywords:string>")
    def rank(tokens: pa.Array, words: pa.Array, lang: pa.Array) -> pa.Array:
        stops, out = Stops(lists), []
        for a, z in groups(tokens, GROUP_TOKENS):
            got = rank_group(tokens.slice(a, z - a), words.slice(a, z - a).to_pylist(), lang.slice(a, z - a).to_pylist(), stops,
                             iterations, damping, n_words, n_keywords)
            out += [{"picked": p, "keywords": k} for p, k in got]
        return pa.array(out, kind)

    return rank


def raw_sentences(text: Column) -> Column:
    return F.transform(tx.sentences(F.coalesce(text, F.lit(""))), tx.strip_ends)


def ranked(docs: DataFrame, text: Column, lang: str = "lang", iterations: int = ITERATIONS, damping: float = DAMPING,
           n_words: int = SUMMARY_WORDS, n_keywords: int = KEYWORDS) -> DataFrame:
    """``docs`` with ``summary`` and ``keywords`` of ``text``; no Exchange.
    Documents without a kept term get empty ones."""
    ship_package(docs.sparkSession)
    rank = rank_udf(iterations, damping, n_words, n_keywords)
    # the text is cut once: tokens, words and the summary are taken from the column
    out = docs.withColumn("_held", raw_sentences(text))
    out = out.withColumn("_rank", rank(F.transform("_held", tx.tokens), F.transform("_held", tx.word_count), F.col(lang)))
    chosen = F.filter("_held", lambda _, i: F.array_contains("_rank.picked", i))
    return out.withColumn("summary", F.array_join(chosen, "\n")).withColumn("keywords", F.col("_rank.keywords")).drop("_rank", "_held")


def summaries_and_keywords(docs: DataFrame, text: Column, id_col: str, iterations: int = ITERATIONS,
                           giant_chars: int = GIANT_CHARS) -> DataFrame:
    """``docs`` (with ``lang``) plus ``summary`` and ``keywords``.  Giant
    documents go through the shuffled form; without any, the plan is the
    narrow one alone."""
    spark, long_ = docs.sparkSession, F.coalesce(F.length(text), F.lit(0)) > giant_chars
    giants = docs.where(long_)
    if giants.isEmpty():
        return ranked(docs, text, iterations=iterations)
    few = ranked(docs.where(~long_), text, iterations=iterations)
    rows = giants.select(F.col(id_col).alias("doc_id"), "lang", text.alias("text"))
    stops = shuffled.stop_terms(spark)
    nodes, occ = shuffled.sentence_nodes(rows, stops)
    summary = shuffled.summarize(nodes, shuffled.sentence_rank(nodes, occ, iterations)).withColumnRenamed("doc_id", id_col)
    words = shuffled.keywords(shuffled.keyword_rank(rows, stops, iterations=iterations)).withColumnRenamed("doc_id", id_col)
    many = giants.join(summary, id_col, "left").join(words, id_col, "left").fillna("", ["summary", "keywords"])
    return few.unionByName(many.select(few.columns))
