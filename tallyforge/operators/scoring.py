"""Expected against actual as long check tables, scores, gates and quality measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text(e: Column, a: Column) -> Column:
    return F.trim(e).eqNullSafe(F.trim(a))


def exact(e: Column, a: Column) -> Column:
    return e.eqNullSafe(a)


def near(e: Column, a: Column, tolerance: str = "0.01") -> Column:
    """Both missing passes, one missing fails."""
    t = F.lit(tolerance).cast("decimal(9,4)")
    return F.coalesce(F.abs(e - a) <= t, e.isNull() & a.isNull())


def at_least(e: Column, a: Column) -> Column:
    return F.coalesce(a >= e, F.lit(False))


def checks(expected: DataFrame, actual: DataFrame, keys: list[str], case: str, scorer: str, tests: dict, one_row_each: bool = True) -> DataFrame:
    """case_id, scorer, check_name, passed: a row for each expected row and test, `present` among them.

    tests: column -> test of (expected, actual). Keys are unique in actual, or made so by the caller.
    """
    a = actual.select(*keys, F.struct(*tests).alias("a"))
    j = expected.select(*keys, F.col(case).alias("case_id"), F.struct(*tests).alias("e")).join(a, keys, "left")
    passed = {"present": F.col("a").isNotNull()} | {n: F.col("a").isNotNull() & t(F.col("e")[n], F.col("a")[n]) for n, t in tests.items()}
    pairs = F.create_map(*(x for n, p in passed.items() for x in (F.lit(n), p)))
    return j.select("case_id", F.lit(scorer).alias("scorer"), F.explode(pairs).alias("check_name", "passed"))


def scores(rows: DataFrame, *keys: str) -> DataFrame:
    """Share of checks that pass; only a full score passes."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_checks"), F.count_if("passed").alias("n_passed")).withColumn("score", F.round(F.col("n_passed") / F.col("n_checks"), 4)).withColumn("passed", F.col("n_checks") == F.col("n_passed"))


def gated(by_scorer: DataFrame, gates: DataFrame) -> DataFrame:
    """gates(gate, scorer, threshold) against scores; a gate without a score fails."""
    j = gates.join(by_scorer.select("scorer", "score"), "scorer", "left")
    return j.select("gate", "scorer", "threshold", "score", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)).alias("passed"))


def class_quality(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1; pairs are counted before they are spread over labels."""
    pairs = rows.groupBy(F.col(expected).alias("e"), F.col(actual).alias("a")).agg(F.count("*").alias("n"))
    same = F.col("e").eqNullSafe(F.col("a"))
    parts = F.array(F.struct(F.col("e").alias("label"), F.when(same, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.when(same, 0).otherwise(F.col("n")).alias("fn")),
                    F.struct(F.col("a").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.when(same, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("bigint").alias("fn")))
    g = pairs.select(F.explode(parts).alias("x")).select("x.*").where("label is not null").groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select("label", "tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def member(allowed: Column, a: Column) -> Column:
    """Null is no member."""
    return F.coalesce(F.array_contains(allowed, a), F.lit(False))
