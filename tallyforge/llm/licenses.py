"""License scans with DataFrame functions: rolling word k-gram hashes vote for template diagonals.

Every k-gram of a document that stands in a template votes for the diagonal (place in the document
minus place in the template). Short templates (phrases) need all their votes on one diagonal; for
texts, neighbouring diagonals are merged, as a word put in or left out shifts the rest, and the
merged span has to cover enough of the template.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import alnum_words, ascii_lower, let, table, window_hashes
from .license_texts import TEXTS

#: (label, phrase, whether its places are counted as base places)
PHRASES = [
    ("mit", "mit license", True),
    ("apache", "apache license", True),
    ("gpl", "general public license", True),
    ("agpl", "affero general public license", False),
    ("lgpl", "lesser general public license", False),
    ("bsd", "bsd license", False),
    ("isc", "isc license", False),
    ("mpl", "mozilla public license", False),
    ("epl", "eclipse public license", False),
    ("bsl", "boost software license", False),
    ("unlicense", "the unlicense", False),
    ("cc-by", "licensed under cc by 4 0", False),
    ("cc-by-sa", "cc by sa 4 0", False),
    ("cc-by-nc", "cc by nc 4 0", False),
    ("cc-by-nd", "cc by nd 4 0", False),
    ("cc0", "cc0 1 0 universal", False),
    ("cc", "creative commons attribution", False),
]
PHRASE_K, TEXT_K = 2, 4
#: A text needs this share of its k-grams, and diagonals up to so many words apart are one.
LEAST_COVER, NEAR = 0.6, 5


#: Grams of the templates that are broadcast at most (some 20 MB).
MOST_GRAMS = 100_000


def grams(spark: SparkSession, texts: Sequence[tuple[str, str]] = TEXTS) -> DataFrame:
    """hash, k, gram, template, label, base, place, n_grams of all templates, some 3,000 rows with the texts given here."""
    words = sum(len(t.split()) for _, t in texts)
    if words > MOST_GRAMS:
        raise ValueError(f"templates of {words} words: the table of their grams is broadcast, so {MOST_GRAMS} are the most")
    rows = [(i, label, text, PHRASE_K, base) for i, (label, text, base) in enumerate(PHRASES)]
    rows += [(len(PHRASES) + i, label, text, TEXT_K, False) for i, (label, text) in enumerate(texts)]
    t = spark.createDataFrame(rows, "template int, label string, text string, k int, base boolean")
    t = t.withColumn("w", alnum_words(ascii_lower(F.col("text")))).withColumn("n_grams", F.size("w") - F.col("k") + 1).where("n_grams > 0")
    t = t.select("*", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n_grams")), lambda i: F.slice("w", i, F.col("k")))).alias("place", "x"))
    return t.select(F.xxhash64(F.transform("x", lambda w: F.xxhash64(w))).alias("hash"), "k", F.array_join("x", " ").alias("gram"), "template", "label", "base", "place", "n_grams")


def spans(docs: DataFrame, texts: Sequence[tuple[str, str]] = TEXTS) -> DataFrame:
    """doc_id, text_hash, label, base, first (word where the template begins), last, cover: every verified span.

    texts: (label, wording) of the templates beside the phrases. Null and empty texts have no span; rows of one id are told apart by
    text_hash; rows that repeat id and text count once; other columns are ignored; an empty table gives no rows.
    """
    text = F.col("text").cast("string")

    both = let(F.transform("w", lambda x: F.xxhash64(F.lower(x))), lambda h: F.concat(window_hashes(h, PHRASE_K), window_hashes(h, TEXT_K)))
    rows = docs.where(text.isNotNull()).select("doc_id", F.xxhash64(text).alias("text_hash"), alnum_words(text).alias("w"))
    # bare hashes and their places keep the exploded rows and the hash table's key small
    rows = rows.select("doc_id", "text_hash", "w", F.posexplode_outer(both).alias("spot", "hash"))
    short = F.greatest(F.size("w") - (PHRASE_K - 1), F.lit(0))  # the phrases' hashes come first
    votes = rows.join(F.broadcast(grams(docs.sparkSession, texts)), "hash").withColumn("at", F.when(F.col("k") == PHRASE_K, F.col("spot")).otherwise(F.col("spot") - short))
    same = ascii_lower(F.array_join(F.slice("w", F.col("at") + 1, F.col("k")), " ")) == F.col("gram")
    votes = votes.where((F.col("at") >= 0) & (F.col("at") <= F.size("w") - F.col("k"))).where(same)
    key = ["doc_id", "text_hash", "template"]
    lines = votes.groupBy(*key, "label", "base", "k", "n_grams", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.countDistinct("place").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    # of a text, neighbouring diagonals are one line; of a phrase, each diagonal is one by itself
    w = Window.partitionBy(*key).orderBy("diagonal")
    near = F.when(F.col("k") == TEXT_K, NEAR).otherwise(0)
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > near, F.lit(True)).cast("int")
    merged = lines.withColumn("fresh", fresh).withColumn("line", F.sum("fresh").over(w))
    merged = merged.groupBy(*key, "label", "base", "k", "n_grams", "line").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    cover = F.least(F.lit(1.0), F.col("votes") / F.col("n_grams"))
    whole = F.when(F.col("k") == TEXT_K, (cover >= LEAST_COVER) & (F.col("last") - F.col("first") < 2 * F.col("n_grams"))).otherwise(F.col("votes") == F.col("n_grams"))
    return merged.where(whole).select("doc_id", "text_hash", "label", "base", "first", (F.col("last") + F.col("k") - 1).alias("last"), cover.alias("cover"))


def scan(docs: DataFrame, texts: Sequence[tuple[str, str]] = TEXTS) -> DataFrame:
    """One row per row of docs(doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, no labels and score 0; repeated rows get the same result each; null ids are kept;
    other columns are dropped. score is the largest share of a template that a verified span covers.
    """
    base = F.col("base")
    found = spans(docs, texts).groupBy("doc_id", "text_hash").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("cover").alias("score"),
    ).withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.size(alnum_words(text)).cast("bigint").alias("n_words"))
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["d"]) & (rows["text_hash"] == found["t"]), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), F.col("first_word").cast("bigint"), F.col("last_word").cast("bigint"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
