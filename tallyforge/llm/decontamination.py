"""Benchmark decontamination with DataFrame functions: all windows of k words of the training texts
meet the hash set of the benchmark's windows; hits are verified word by word.

The hash set is broadcast up to a checked size. A larger one is joined by a shuffle of bare hashes and
places; words of the few rows with hits are fetched after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, ascii_lower, checkpointed, let, table, window_hashes

#: A hash set of up to so many windows (some 100 MB) is broadcast; a larger one is joined by a shuffle.
MOST_BROADCAST = 500_000
#: Keys of so many rows with hits (16 bytes each) are broadcast to fetch their words; more are joined by a shuffle.
MOST_ROWS = 2_000_000


def benchmark_windows(benchmark: DataFrame, k: int) -> DataFrame:
    """hash, n_words, words_text, items: the distinct windows of benchmark(item_id, text); a shorter item is one window."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), alnum_words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    words = words.select("item", "w", F.least(F.lit(k), F.size("w")).alias("n_words"))
    window = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n_words") + 1), lambda i: F.slice("w", i, F.col("n_words")))
    each = words.select("item", "n_words", F.explode(window).alias("x"))
    each = each.select("item", "n_words", ascii_lower(F.array_join("x", " ")).alias("words_text"), F.xxhash64(F.transform("x", lambda w: F.xxhash64(F.lower(w)))).alias("hash"))
    return each.groupBy("hash", "n_words", "words_text").agg(F.array_sort(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, k: int = 10, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, text_hash, first (place of the window's first word), last, items: every verified occurrence, one row each."""
    windows = benchmark_windows(benchmark, k)
    sizes, n_windows = windows.agg(F.sort_array(F.collect_set("n_words")), F.count("*")).first()  # k sizes at most
    sizes = sizes or [k]
    text = F.col("text").cast("string")

    def found(w):
        return let(F.transform(w, lambda x: F.xxhash64(F.lower(x))), lambda h: F.concat(*(window_hashes(h, n) for n in sizes)))

    rows = docs.where(text.isNotNull()).select("doc_id", F.xxhash64(text).alias("text_hash"), alnum_words(text).alias("w"))
    # bare hashes and their places keep the exploded rows and the hash set's key small; the hashes of each size follow those of the one before
    first, before = F.lit(None), F.lit(0)
    for n in sizes:
        first = F.when(F.col("n_words") == n, F.col("at") - before).otherwise(first)
        before = before + F.greatest(F.col("n") - (n - 1), F.lit(0))
    if n_windows <= most_broadcast:
        each = rows.select("doc_id", "text_hash", "w", F.size("w").alias("n"), F.posexplode_outer(found(F.col("w"))).alias("at", "hash"))
        met = each.join(F.broadcast(windows), "hash").withColumn("first", first)
    else:
        each = rows.select("doc_id", "text_hash", F.size("w").alias("n"), F.posexplode(found(F.col("w"))).alias("at", "hash"))
        bare = each.join(windows.select("hash", "n_words").distinct(), "hash").withColumn("first", first)
        bare = checkpointed(bare.select("doc_id", "text_hash", "hash", "n_words", "first", "n").distinct())
        own = bare.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct()
        if own.count() <= MOST_ROWS:
            own = F.broadcast(own)
        words = rows.join(own, rows["doc_id"].eqNullSafe(own["d"]) & (rows["text_hash"] == own["t"]), "left_semi").dropDuplicates(["doc_id", "text_hash"])
        words = words.withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
        met = bare.join(words, bare["doc_id"].eqNullSafe(words["d"]) & (bare["text_hash"] == words["t"])).join(windows, ["hash", "n_words"])
    same = ascii_lower(F.array_join(F.slice("w", F.col("first") + 1, F.col("n_words")), " ")) == F.col("words_text")
    return met.where((F.col("first") >= 0) & (F.col("first") <= F.col("n") - F.col("n_words"))).where(same).select(
        "doc_id", "text_hash", "first", (F.col("first") + F.col("n_words") - 1).alias("last"), "items"
    )


def covered(spans):
    """Number of places in the union of sorted [first, last] spans."""
    zero = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["last"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(a["end"] + 1, s["first"]) + 1)).alias("n"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = 10, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row per row of docs(doc_id, text): n_words, n_hit (words inside a benchmark window), n_items, items_sha256, contaminated and the hit spans.

    A null or empty text has no words; rows that repeat get the same result each; null ids are kept; an empty benchmark hits nothing;
    benchmark items without words are ignored; extra columns are dropped.
    """
    text = F.col("text").cast("string")
    found = hits(docs, benchmark, k, most_broadcast).groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    found = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "spans", "items")
    base = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.size(alnum_words(text)).cast("bigint").alias("n_words"))
    joined = base.join(found, base["doc_id"].eqNullSafe(found["d"]) & (base["text_hash"] == found["t"]), "left")
    none = F.array().cast("array<string>")
    out = joined.select("doc_id", "n_words", F.coalesce(covered(F.col("spans")), F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", none).alias("items"), "spans")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 10) -> DataFrame:
    """docs without the rows in which a benchmark window occurs; columns as they were, whatever their names.

    Null and empty texts stay; repeated rows stay or go alike; a row is known by its id, null or not, and its text; an empty benchmark
    takes nothing away; an empty table gives no rows.
    """
    bad = hits(docs, benchmark, k).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_text")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["bad_text"]), "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in which a benchmark window occurs go; the others stay as they are (see decontaminate)."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))
