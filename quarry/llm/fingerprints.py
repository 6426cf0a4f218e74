"""Document fingerprints: a Merkle tree over sections and paragraphs.

A section is what stands between blank lines, a paragraph one line of it.
A paragraph's hash is the sha256 of its text, a section's the sha256 of its
paragraphs' hashes, the root the sha256 of the sections' hashes, so equal
roots mean equal texts and differing branches lead to the edited lines.
Below the paragraphs lie leaves: a word (or line end), or each eight characters
of a longer one, together with the one before it.  The share of distinct
leaves that two trees have in common is the likeness of the two fingerprints,
so a text without sentence marks, line ends or even spaces is compared by its
parts as well, and common words alone make no likeness.

Null text counts as empty.  The empty text has one empty section with one
empty paragraph and one leaf.  A very long text is one row all the way, as
many leaves as it has words.  Repeated rows and ties of ids get fingerprints
of their own rows; the next document of a tie goes by text.  An empty table
gives no rows.  Columns other than id and text are ignored, but kept by
``fingerprint``, which replaces columns named ``fingerprint`` and ``leaves``.
All expressions are built-in functions and higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bucket_of, id_cuts, long_array, order_id

UNIT = r"\n|[^\x20\x09-\x0D]{1,8}"
#: Likeness of two different texts whose leaf sets are equal.
BELOW_ONE = 0.999


def _hash_of(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def paragraph_hashes(text: Column) -> Column:
    """array<array<string>>: paragraph hashes by section."""
    return F.transform(F.split(text, "\n\n"),
                       lambda s: F.transform(F.split(s, "\n"), lambda p: F.sha2(p, 256)))


def merkle_tree(text: Column) -> Column:
    """struct<root, sections: array<struct<hash, paragraphs>>> of a non-null text."""
    sections = F.transform(paragraph_hashes(text),
                           lambda ps: F.struct(_hash_of(ps).alias("hash"), ps.alias("paragraphs")))
    return F.struct(_hash_of(F.transform(sections, lambda s: s["hash"])).alias("root"),
                    sections.alias("sections"))


def merkle_root(text: Column) -> Column:
    return _hash_of(F.transform(F.split(text, "\n\n"), lambda s: _hash_of(
        F.transform(F.split(s, "\n"), lambda p: F.sha2(p, 256)))))


def leaf_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of neighbouring units, the ends of the text
    included."""
    units, end = F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), F.array(F.lit(""))
    return F.array_distinct(F.zip_with(F.concat(end, units), F.concat(units, end), lambda a, b: F.xxhash64(a, b)))


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    """1 for equal roots, else twice the common leaves over all (0 to 0.999)."""
    total = F.size(leaves_a) + F.size(leaves_b)
    common = F.size(F.array_intersect(leaves_a, leaves_b))
    share = F.when(total > 0, 2.0 * common / total).otherwise(F.lit(0.0))
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(F.least(share, F.lit(BELOW_ONE)))


def differing_branches(tree_a: Column, tree_b: Column) -> Column:
    """array<struct<section, paragraph>> (from 0): the places where two trees
    differ.  Sections with equal hashes are not descended; a paragraph that
    only one tree has counts as differing."""
    def paragraphs(a, b, s):
        pairs = F.zip_with(F.coalesce(a["paragraphs"], F.array().cast("array<string>")),
                           F.coalesce(b["paragraphs"], F.array().cast("array<string>")),
                           lambda x, y: ~x.eqNullSafe(y))
        at = F.transform(pairs, lambda d, i: F.when(d, F.struct(s.alias("section"), i.alias("paragraph"))))
        return F.filter(at, lambda x: x.isNotNull())

    both = F.zip_with(tree_a["sections"], tree_b["sections"], lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    found = F.transform(both, lambda x, s: F.when(
        x["a"]["hash"].eqNullSafe(x["b"]["hash"]),
        F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(paragraphs(x["a"], x["b"], s)))
    empty = F.array().cast("array<struct<section:int,paragraph:int>>")
    return F.when(tree_a["root"] == tree_b["root"], empty).otherwise(F.flatten(found))


def fingerprint(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Append ``fingerprint`` (the root) and ``leaves`` to any table."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumns({"fingerprint": merkle_root(text), "leaves": leaf_hashes(text)})


def dealt_by_id(df: DataFrame, id_col: str = "doc_id", rows_per_bucket: int = 2048):
    """(rows, window) such that ``lead`` over the window gives the next row in
    descending id order (null ids last, ties by text), the first row being the
    next of the last.  Rows with ``_g = 1`` are copies: drop them afterwards.

    The ids are cut into buckets of neighbours, each bucket is one window
    partition, and the first rows of a bucket also go to the bucket before
    it.  So the text is shuffled once, whatever its size; the driver holds
    two numbers per bucket."""
    key = order_id(id_col)
    ids = df.select(id_col)
    cuts = id_cuts(ids, id_col, rows_per_bucket)
    bucket = F.lit(len(cuts)) - bucket_of(key, cuts)          # 0 holds the largest ids
    heads = sorted((r["b"], r["h"]) for r in ids.groupBy(bucket.alias("b")).agg(F.max(key).alias("h")).collect())
    used = [b for b, _ in heads]
    before = {b: used[i - 1] for i, b in enumerate(used)}     # the first follows the last
    head_of = dict(heads)
    width = len(cuts) + 1
    head = F.element_at(long_array([head_of.get(b, 0) for b in range(width)]), F.col("_b") + 1)
    prior = F.element_at(long_array([before.get(b, 0) for b in range(width)]), F.col("_b") + 1).cast("int")
    rows = df.withColumn("_k", key).withColumn("_b", bucket.cast("int"))
    # in the last bucket the copy of the first rows comes after its own rows
    places = F.when(F.col("_k") == head, F.array(
        F.struct(F.col("_b").alias("b"), F.lit(0).alias("ghost")),
        F.struct(prior.alias("b"), F.lit(1).alias("ghost")))).otherwise(
        F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("ghost"))))
    dealt = rows.withColumn("_p", F.explode(places)).withColumn("_b", F.col("_p.b")).withColumn(
        "_g", F.col("_p.ghost")).drop("_p")
    dealt = dealt.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "_b")
    return dealt, Window.partitionBy("_b").orderBy("_g", F.col("_k").desc(), "text")


def edited_fingerprints(docs: DataFrame, rows_per_bucket: int = 2048) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last
    floor(n / 2) code points are replaced by the first as many (or all) of
    the next document, with their likeness and that to the next document."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt, w = dealt_by_id(base, rows_per_bucket=rows_per_bucket)
    own = dealt.withColumns({"root": merkle_root(F.col("text")), "leaves": leaf_hashes(F.col("text"))})
    nxt = F.lead(F.struct("text", "root", "leaves")).over(w)
    rows = own.withColumn("nxt", nxt).where("_g = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("nxt.text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "root", "leaves", "nxt", edited.alias("edited"))
    e_root, e_leaves = F.col("e.root"), F.col("e.leaves")
    rows = rows.withColumn("e", F.struct(merkle_root(F.col("edited")).alias("root"),
                                         leaf_hashes(F.col("edited")).alias("leaves")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("root").alias("fingerprint"),
        e_root.alias("edited_fingerprint"),
        F.round(likeness(F.col("root"), F.col("leaves"), e_root, e_leaves), 6).alias("near_edited"),
        F.round(likeness(F.col("root"), F.col("leaves"), F.col("nxt.root"), F.col("nxt.leaves")), 6).alias("near_next"))
