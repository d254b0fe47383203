"""Operations metrics from event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S


def rollup(rows: DataFrame, *keys: str) -> DataFrame:
    """count, failures, retries, avg and max milliseconds by keys, and tokens and cost where rows have them; the average divides by all rows."""
    more = [F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tokens", "cost") if x in rows.columns]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("failed").alias("failures"), F.sum(F.greatest(F.col("attempt") - 1, F.lit(0))).alias("retries"),
        (F.sum("ms") / F.count("*")).alias("avg_ms"), F.max("ms").alias("max_ms"), *more,
    )


def failure_runs(rows: DataFrame, key: str, least: int = 5) -> DataFrame:
    """Islands of `least` or more failures in a row of rows(key, ts, event_id, failed).

    Each day of a key is swept by itself; runs that end a day and begin the next one with rows are put together after, so that a busy
    key is as many tasks as it has days.
    """
    day = Window.partitionBy(key, "day")
    r = rows.withColumn("day", F.to_date("ts")).withColumn("ok", (~F.col("failed")).cast("int"))
    r = r.withColumns({"island": F.sum("ok").over(day.orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)), "last": F.sum("ok").over(day)})
    first = F.min(F.struct("ts", "event_id"))
    runs = r.where("failed").groupBy(key, "day", "island", "last").agg(F.count("*").alias("n"), first.alias("first"))
    days = rows.select(key, F.to_date("ts").alias("day")).distinct().withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("day")))
    w = Window.partitionBy(key).orderBy("place", "island")
    runs = runs.join(days, [key, "day"]).withColumns({"before": F.lag("place").over(w), "closes": F.lag(F.col("island") == F.col("last")).over(w)})
    goes_on = (F.col("island") == 0) & (F.col("before") == F.col("place") - 1) & F.col("closes")
    runs = runs.withColumn("run", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(w))
    return runs.groupBy(key, "run").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where(F.col("n") >= least).select(key, "n", F.col("first.event_id").alias("first_event"))


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls(provider, model, tokens) with `cost` by prices(provider, model, rate per 1,000 tokens); a call without a price has none."""
    return calls.join(prices, ["provider", "model"], "left").withColumn("cost", S.token_cost(F.col("tokens"), F.col("rate")))
