"""Secret scans: candidates by shape, false positives removed by a random
forest that is trained from labelled findings.

A candidate is a word whose value (what follows a leading name with = or :,
without signs around it) has a digit and at least ``LEAST_LENGTH`` characters,
or has the shape of a known key, or whose key names a secret, whatever the
value's length and digits.  The key is the name before the sign, or before a
lone = or :.  Features: its
length, the shares of character classes, the transitions between classes,
distinct characters, how much of it words of the dictionary cover, the path,
and the neighbouring words.  The dictionary is the ``DICTIONARY`` most
frequent words around the candidates of the whole table.

The forest is fitted with Spark's ML library on at most ``TRAINING_ROWS``
labelled findings (the smallest by hash), then written out as a CASE
expression, so scanning is a projection: no shuffle, no Python.  Findings
carry place and length and a hash of the value, never the value.

Null and empty texts have no finding.  Texts of any length are scanned whole.
Null paths count as ''.  Without labelled findings nothing is a secret; with
given labels of one kind only, every candidate gets that label; where the
table's own settled findings are of one kind, the settling rules decide and
unsettled candidates are no secrets.  Repeated rows give
equal findings; columns that clash with the results are replaced.

Masking replaces a secret everywhere in its text; one of under ``LEAST_LENGTH``
characters only where it is the whole value of a word, and, if it has only
letters, where it was found, as it may be a common word elsewhere.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import packed, unpacked
from quarry.session import written

LEAST_LENGTH = 12
NEIGHBOURS = 3
DICTIONARY = 2000
TRAINING_ROWS = 20_000
TREES, DEPTH, SEED = 20, 6, 17
THRESHOLD = 0.5
MASK = "[SECRET]"

# fixed values: names and words that speak for or against a secret
SECRET_WORDS = (r"(?i)(passw|passwd|pwd|secret(?!ar)|token(?!i[sz])|api_?key|apikey|access_?key|private|credential"
                r"|auth(?!or(?!i[sz])))")
PLAIN_WORDS = r"(?i)(example|sample|test|dummy|mail|phone|call|tel|sha|hash|checksum|commit|uuid|version|isbn|ip|address|card)"
# fixed values: shapes that settle a label without a model
KNOWN_SECRET = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[0-9A-Za-z]{36}$|^xox[abprs]-[0-9A-Za-z-]{10,}$|^sk_live_[0-9A-Za-z]{16,}$"
KNOWN_PLAIN = (r"^[^@\s]+@[^@\s]+\.[A-Za-z]+$|^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^[-+0-9().,/]+$|^[a-z]+://"
               r"|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^v?[0-9]+(\.[0-9]+)+")
# fixed values: what stands after a secret's name in prose and code without being one
PLAIN_VALUE = (r"(?i)^(null|none|nil|undefined|true|false|yes|no|not|string|str|int|bool|boolean|bytes|void|required|optional"
               r"|the|an?|is|are|was|and|or|of|for|to|in|on|by|if|it|we|you|with|from|this|that|see|your|my|new|self|await)$"
               r"|^[A-Za-z_][0-9A-Za-z_]*(\.[A-Za-z_][0-9A-Za-z_]*)*[(\[]")
# a word that may hold the shape of a known key, a name with its sign, a text that may hold either
KEY_STARTS = r"(AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_|xox[abprs]-|sk_live_"
NAME = r"(?s)^(?:[A-Za-z_][A-Za-z0-9_.-]*[=:]+)?"
FEATURES = ["length", "digits", "uppers", "lowers", "others", "transitions", "distinct", "hex", "longest_run",
            "covered", "named", "near_secret", "near_plain", "path_depth", "path_test"]


def _bound(value: Column, body) -> Column:
    """``body(x)`` with x evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def value_in(word: Column) -> Column:
    """What follows a leading name with = or :, without signs around it."""
    return F.regexp_replace(F.regexp_extract(word, NAME + "(.*)$", 1), r"^[^0-9A-Za-z+/_]+|[^0-9A-Za-z+/=_]+$", "")


def long_with_digit(value: Column) -> Column:
    return (F.length(value) >= LEAST_LENGTH) & value.rlike("[0-9]")


def candidates(text: Column, path: Column) -> Column:
    """array<struct<word_no, value, key, before, after, path>> of a text."""
    def at(words, i, k):
        return F.coalesce(F.get(words, i + k), F.lit(""))

    def may_be(words, i):
        word, last = F.get(words, i), at(words, i, -1)
        named = (word.rlike("[=:]") & word.rlike(SECRET_WORDS)) | (last.rlike("[=:]$") & (
            last.rlike(SECRET_WORDS) | (last.rlike("^[=:]+$") & at(words, i, -2).rlike(SECRET_WORDS))))
        return long_with_digit(word) | word.rlike(KEY_STARTS) | named

    def within(words):
        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: may_be(words, i))
        raw = F.transform(places, lambda i: F.struct(
            i.alias("word_no"), F.get(words, i).alias("word"),
            F.concat_ws(" ", *[at(words, i, -k) for k in range(NEIGHBOURS, 0, -1)]).alias("before"),
            F.concat_ws(" ", *[at(words, i, k) for k in range(1, NEIGHBOURS + 1)]).alias("after"),
            F.when(at(words, i, -1).rlike("^[=:]+$"), at(words, i, -2)).otherwise(
                F.when(at(words, i, -1).rlike("[=:]$"), at(words, i, -1)).otherwise(F.lit(""))).alias("name")))
        cut = F.transform(raw, lambda c: F.struct(
            c["word_no"].alias("word_no"), value_in(c["word"]).alias("value"),
            F.concat(F.regexp_extract(c["word"], r"^([A-Za-z_][A-Za-z0-9_.-]*)[=:]+", 1), c["name"]).alias("key"),
            c["before"].alias("before"), c["after"].alias("after"), F.coalesce(path, F.lit("")).alias("path"),
            F.contains(c["word"], F.lit(MASK)).alias("masked")))
        kept = F.filter(cut, lambda c: long_with_digit(c["value"]) | c["value"].rlike(KNOWN_SECRET) | (
            c["key"].rlike(SECRET_WORDS) & (c["value"] != "") & ~c["masked"]))
        return F.transform(kept, lambda c: F.struct(*[c[x].alias(x) for x in ("word_no", "value", "key", "before", "after", "path")]))

    # the test of the whole text keeps texts without a candidate from being cut into words
    some = text.rlike("[0-9]") | text.rlike(SECRET_WORDS) | text.rlike(KEY_STARTS)
    return F.when(some, _bound(F.split(text, r"\s+"), within))


def features(c: Column, words: Column) -> Column:
    """struct of the features of one candidate; ``words``: the dictionary."""
    v, n = c["value"], F.length(c["value"]).cast("double")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    runs = lambda pattern: F.regexp_extract_all(v, F.lit(pattern), F.lit(0))
    near = F.concat_ws(" ", c["before"], c["after"])
    covered = F.aggregate(F.filter(F.transform(runs("[A-Za-z]{3,}"), F.lower), lambda r: F.array_contains(words, r)),
                          F.lit(0), lambda a, r: a + F.length(r))
    out = {
        "length": n, "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"),
        "others": share("[^0-9A-Za-z]"),
        "transitions": F.regexp_count(v, F.lit(r"[0-9](?=[^0-9])|[A-Z](?=[^A-Z])|[a-z](?=[^a-z])")) / n,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "hex": v.rlike("^[0-9a-fA-F]+$").cast("double"),
        "longest_run": F.aggregate(runs("[A-Za-z]+|[0-9]+"), F.lit(0), lambda a, r: F.greatest(a, F.length(r))) / n,
        "covered": covered / n, "named": c["key"].rlike(SECRET_WORDS).cast("double"),
        "near_secret": near.rlike(SECRET_WORDS).cast("double"), "near_plain": near.rlike(PLAIN_WORDS).cast("double"),
        "path_depth": F.regexp_count(c["path"], F.lit("/")).cast("double"),
        "path_test": c["path"].rlike(r"(?i)(^|[/_.-])(tests?|examples?|fixtures?|docs?)([/_.-]|$)").cast("double")}
    return F.struct(*[F.coalesce(out[f], F.lit(0.0)).cast("double").alias(f) for f in FEATURES])


def found_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row (id, c) per candidate of the table."""
    return docs.select(F.col(id_col), F.explode(candidates(F.col(text_col), F.col(path_col))).alias("c"))


def frequent_words(found: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The words of three letters and more that stand next to most
    candidates, ties in alphabetical order; ``size`` words reach the driver."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "c.before", "c.after")), F.lit(r"\b[a-z]{3,}\b"), F.lit(0))
    counts = found.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return [r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(size).collect()]


def known_labels(found: DataFrame) -> DataFrame:
    """Labelled findings among the candidates: 1 where the shape or the key
    settles that it is a secret, 0 where the shape settles that it is none."""
    return found.withColumn("label", settled(F.col("c"))).where("label IS NOT NULL").select("c", "label")


def settled(c: Column) -> Column:
    """The label of a candidate that its shape or key settles, else null."""
    value, key = c["value"], c["key"]
    plain = value.rlike(KNOWN_PLAIN) | (~long_with_digit(value) & value.rlike(PLAIN_VALUE))
    secret = value.rlike(KNOWN_SECRET) | (key.rlike(SECRET_WORDS) & ~plain)
    return F.when(secret, 1.0).when(plain, 0.0)


class Forest:
    """Trees as CASE expressions over the features, the dictionary beside.
    Without trees a constant, or for None the label that the rules settle."""

    def __init__(self, words: list[str], trees: list, constant: float | None = 0.0):
        self.words, self.trees, self.constant = words, trees, constant

    def dictionary(self) -> Column:
        return F.split(F.lit(" ".join(self.words)), " ")

    def score(self, f: Column, c: Column) -> Column:
        """Share of the trees that call candidate c with features f a secret."""
        if not self.trees and self.constant is None:
            return F.coalesce(settled(c), F.lit(0.0))
        if not self.trees:
            return F.lit(float(self.constant))

        def walk(node):
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, limit, low, high = node
            return F.when(f[FEATURES[feature]] <= limit, walk(low)).otherwise(walk(high))
        return sum((walk(t) for t in self.trees[1:]), walk(self.trees[0])) / len(self.trees)


def _tree(lines: list[str]):
    """A tree of the model's description: prediction, or (feature, limit, low, high)."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return float(line.split(":")[1])
    feature, limit = re.match(r"If \(feature (\d+) <= ([-+.\dEe]+)\)", line).groups()
    low = _tree(lines)
    lines.pop(0)                                            # the Else line
    return int(feature), float(limit), low, _tree(lines)


def train(labelled: DataFrame, words: list[str], rows: int = TRAINING_ROWS) -> Forest:
    """A forest from findings (c, label), of which at most ``rows`` are used."""
    shape = F.xxhash64("c.value", "c.before", "c.after", "c.path", "c.word_no")
    sample = labelled.select(features(F.col("c"), F.split(F.lit(" ".join(words)), " ")).alias("f"), "label",
                             shape.alias("h")).orderBy("h", "label").limit(rows).select("f.*", "label").coalesce(1).cache()
    try:
        kinds = [r["label"] for r in sample.select("label").distinct().collect()]
        if len(kinds) < 2:
            return Forest(words, [], kinds[0] if kinds else 0.0)
        table = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(sample)
        model = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=TREES, maxDepth=DEPTH,
                                       seed=SEED, featureSubsetStrategy="sqrt").fit(table)
        trees = [[x for x in t.toDebugString.splitlines() if re.match(r"\s*(If|Else|Predict)", x)] for t in model.trees]
        return Forest(words, [_tree(t) for t in trees])
    finally:
        sample.unpersist()


def train_on(docs: DataFrame, labelled: DataFrame | None = None, **columns: str) -> Forest:
    """The forest for a table: from given labelled findings, else from the
    table's candidates whose label their shape or key settles.  The texts are
    read once: the candidates are written and read again."""
    return forest_of(written(found_in(docs, **columns), "secret-candidates"), labelled)


def forest_of(found: DataFrame, labelled: DataFrame | None = None) -> Forest:
    """The forest for a table of candidates (c)."""
    if labelled is not None:
        return train(labelled, frequent_words(found))
    forest = train(known_labels(found), frequent_words(found))
    return forest if forest.trees else Forest(forest.words, [], None)


def scan(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Append ``findings``: array<struct<word_no, value, score>> of all candidates."""
    words = forest.dictionary()
    scored = F.transform(
        F.transform(candidates(F.col(text_col), F.col(path_col)),
                    lambda c: F.struct(c["word_no"].alias("word_no"), c["value"].alias("value"), c["key"].alias("key"), features(c, words).alias("f"))),
        lambda c: F.struct(c["word_no"].alias("word_no"), c["value"].alias("value"), forest.score(c["f"], c).alias("score")))
    empty = F.array().cast("array<struct<word_no:int,value:string,score:double>>")
    return docs.withColumn("findings", F.coalesce(scored, empty))


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str = "source",
           threshold: float = THRESHOLD) -> DataFrame:
    """The table with every secret in ``text_col`` replaced by ``MASK``; texts
    without one stay as they are, null stays null."""
    secret = F.filter(F.col("findings"), lambda x: x["score"] >= threshold)
    short = F.filter(secret, lambda x: F.length(x["value"]) < LEAST_LENGTH)
    text = F.when(F.size(short) > 0, _masked_words(F.col("text"), short)).otherwise(F.col("text"))
    wide = F.filter(F.array_distinct(F.transform(secret, lambda x: x["value"])), lambda v: F.length(v) >= LEAST_LENGTH)
    longest = F.sort_array(F.transform(wide, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v"))))
    clean = F.aggregate(longest, text, lambda t, s: F.replace(t, s["v"], F.lit(MASK)))
    others = docs.select([F.col(f"`{c}`") for c in docs.columns if c != text_col])
    rows = docs.select(packed(others), F.col(text_col).alias("text"), F.col(path_col).alias("path"))
    return unpacked(scan(rows, forest, "text", "path").withColumn("clean", clean), docs.columns, **{text_col: F.col("clean")})


def _masked_words(text: Column, found: Column) -> Column:
    """The text with the values of ``found`` masked in their words, and those
    with more than letters in every word of that value; white space stays."""
    places = F.transform(found, lambda x: x["word_no"])
    values = F.filter(F.transform(found, lambda x: x["value"]), lambda v: v.rlike("[^A-Za-z]"))

    def masked(word, i):
        value, name = value_in(word), F.regexp_extract(word, NAME, 0)
        rest = F.substr(word, F.length(name) + 1)
        hit = F.array_contains(places, i) | F.array_contains(values, value)
        return F.when(hit, F.concat(name, F.replace(rest, value, F.lit(MASK)))).otherwise(word)

    gaps = F.regexp_extract_all(text, F.lit(r"\s+"), F.lit(0))
    return F.array_join(F.transform(F.split(text, r"\s+"), lambda w, i: F.concat(
        masked(w, i), F.coalesce(F.get(gaps, i), F.lit("")))), "")


def findings(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, word_no, length, value_sha256, score, secret): every candidate of the table."""
    found = written(found_in(docs), "secret-candidates")
    forest = forest_of(found, labelled)
    f = found.withColumn("f", features(F.col("c"), forest.dictionary()))
    score = F.round(forest.score(F.col("f"), F.col("c")), 6)
    return f.select("doc_id", F.col("c.word_no").alias("word_no"), F.length("c.value").cast("bigint").alias("length"),
                    F.sha2("c.value", 256).alias("value_sha256"), score.alias("score"), (score >= threshold).alias("secret"))
