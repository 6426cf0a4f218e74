"""Queries are a document's best sentences, found in one pass over its text."""
import math
import random

from quarry.operators import generate


def counted(df, seen):
    """``df`` whose rows are counted each time that they are computed."""
    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return df.mapInArrow(run, df.schema)


def test_queries_compute_the_sentences_once(spark):
    rng = random.Random(7)
    words = "red green blue black white grey pink brown".split()
    texts = {i: ". ".join(" ".join(rng.choice(words + ["unknown"]) for _ in range(rng.randint(0, 5))) for _ in range(6)) for i in range(20)}
    texts[20] = texts[21] = None
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    idf = {w: 1.0 + i / 7 for i, w in enumerate(words)}            # 'unknown' has none
    stats = spark.createDataFrame(list(idf.items()), "term string, idf double")
    want = {}
    for d, text in texts.items():
        scored = []
        for pos, s in enumerate(x for x in (text or "").split(".") if x):
            known = [idf[w] for w in s.split() if w in idf]
            if known:
                scored.append((-round(math.fsum(known) / len(known), 6), pos, " ".join(s.split())))
        for rank, (_, _, s) in enumerate(sorted(scored)[:2], 1):
            want[d, rank] = s
    for hot in ([], ["red", "blue", "absent"], words):
        hot_terms = spark.createDataFrame([(w,) for w in hot], "term string")
        seen = spark.sparkContext.accumulator(0)
        sents = counted(generate.sentence_rows(docs, "doc_id", "text"), seen)
        best = generate.best_sentences(sents, stats, hot_terms, 2)
        rows = generate.with_text(best, docs, 32).collect()
        assert {(r["doc_id"], r["q_rank"]): r["query"] for r in rows} == want
        assert seen.value == len(texts)
