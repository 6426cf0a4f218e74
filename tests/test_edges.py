"""Edge rows: null/empty text, prompts, titles, short negatives lists."""

from pyspark.sql import functions as F

from quarry.functions import sequences as sq
from quarry.functions import text as tx
from quarry.operators import rerank


def test_text_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "One."), (4, "  a\tb\nc  ")], "id long, t string")
    r = {x["id"]: x for x in df.select(
        "id", tx.tokens("t").alias("tok"), tx.word_count("t").alias("wc"), tx.subject_of("t").alias("s"),
        tx.clean_control("t").alias("c"), tx.flatten_newlines("t").alias("f")).collect()}
    assert r[1]["tok"] is None and r[2]["tok"] == [] and r[3]["tok"] == ["one"]
    assert r[2]["wc"] == 0 and r[4]["wc"] == 3
    assert r[4]["s"] == "a b c" and r[2]["s"] == ""
    assert r[4]["c"] == "  a b c  " and r[4]["f"] == "a\tb c"


def test_prompt_strip_chained(spark):
    df = spark.createDataFrame([("Passage: Question: x",), ("Question: y",), ("Passage: z",), ("w",)], "p string")
    got = [r[0] for r in df.select(tx.strip_prompt("p")).collect()]
    assert got == ["x", "y", "z", "w"]


def test_title_slice(spark):
    df = spark.createDataFrame([("title:Foo_parentSection_bar",), ("title:Foo",), ("abc",)], "t string")
    got = [r[0] for r in df.select(tx.title_slice("t")).collect()]
    assert got == ["Foo", "Fo", ""]             # missing marker: find = -1 drops the last char


def test_padding_and_decode(spark):
    df = spark.createDataFrame([(["a", "-100"],), (["a", "b", "c"],)], "s array<string>")
    got = [r[0] for r in df.select(sq.pad_to(sq.unmask("s"), 2)).collect()]
    assert got == [["a", "<pad>"], ["a", "b"]]
    dec = df.select(sq.decode(F.concat(sq.unmask("s"), F.array(F.lit("</s>"))))).collect()
    assert dec[0][0] == "a"


def test_fewer_negatives_repeat(spark):
    rows = spark.createDataFrame([("g", 1, True), ("g", 2, False), ("h", 3, True)],
                                 "src string, doc_id long, is_positive boolean")
    g = rerank.hard_negative_groups(rows, "src", 4).orderBy("slot").collect()
    assert [(r["slot"], r["doc_id"]) for r in g] == [(0, 1), (1, 2), (2, 2), (3, 2)]  # h has no negatives: dropped


def test_short_passage_containment(spark):
    """Passages without interior tokens: by pieces of terms and of the runs between them."""
    from quarry.plans.fixtures import short_matches
    docs = spark.createDataFrame([(5, "xx hello world"), (3, "say hello"), (9, None), (7, "Hello"), (2, "a -- b"), (8, "othello")],
                                 "doc_id long, text string")
    terms = docs.select("doc_id", F.explode(F.array_distinct(tx.tokens("text"))).alias("term"))
    pats = spark.createDataFrame([(1, "hello"), (2, "lo wor"), (3, "zz"), (4, ""), (5, " -"), (6, "thel"), (7, "?!"), (8, "Hello")],
                                 "item_id long, query string").withColumn("toks", tx.tokens("query"))
    got = short_matches(docs, pats, terms).groupBy("item_id").agg(F.min("doc_id").alias("d"))
    assert {r["item_id"]: r["d"] for r in got.collect()} == {1: 3, 2: 5, 4: 2, 5: 2, 6: 8, 8: 7}


def test_summaries_of_few_documents(spark):
    """The stop lists do not depend on the corpus size: nine documents keep
    their terms, and adding documents changes no result."""
    from quarry.operators import textrank as tr
    rows = [(i, "en", f"The river number{i} meets the mountain road. A road of stones leads to the river town. "
                      f"Town people number{i} walk the mountain road daily.") for i in range(9)]
    def run(rows):
        docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
        nodes, occ = tr.sentence_nodes(docs, tr.stop_terms(spark))
        s = {r["doc_id"]: r["summary"] for r in tr.summarize(nodes, tr.sentence_rank(nodes, occ, 2)).collect()}
        k = {r["doc_id"]: r["keywords"] for r in tr.keywords(tr.keyword_rank(docs, tr.stop_terms(spark), iterations=2)).collect()}
        return s, k
    s, k = run(rows)
    assert len(s) == len(k) == 9 and all(s.values()) and all(k.values())
    assert not any("the" in v.split() for v in k.values())
    assert run(rows[:1]) == ({0: s[0]}, {0: k[0]})


def test_model_hooks(spark):
    from quarry.operators import generate
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")

    def first_word(batches):
        for pdf in batches:
            yield pdf.assign(q_rank=1, query=pdf["text"].str.split().str[0])[["doc_id", "q_rank", "query"]]
    assert {r["doc_id"]: r["query"] for r in generate.generate_with(docs, first_word).collect()} == {1: "one", 2: "three"}
    pairs = spark.createDataFrame([("p", "a b", "b c"), ("q", "a", "z")], "pair_id string, query string, context string")

    def overlap(batches):
        for pdf in batches:
            yield pdf.assign(score=[float(len(set(a.split()) & set(b.split()))) for a, b in zip(pdf["query"], pdf["context"])])[["pair_id", "score"]]
    assert {r["pair_id"]: r["score"] for r in rerank.score_with(pairs, overlap).collect()} == {"p": 1.0, "q": 0.0}
