"""Alert windows over step logs: the same functions take batch tables and streams (watermark 10 minutes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def watermarked(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream's event time has to carry a zone: one without is read in the session's."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if rows.isStreaming else rows


def failure_rate(rows: DataFrame, key: str, size: str = "10 minutes", slide: str | None = None, over: float = 0.10) -> DataFrame:
    """Windows in which more than a share of a key's rows failed."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = watermarked(rows).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.count_if("failed").alias("failures"))
    return g.where(F.col("failures") > over * F.col("n")).select(F.col("w.start").alias("window_start"), key, "n", "failures")


def over_budget(rows: DataFrame, key: str, budget: int, size: str = "1 second") -> DataFrame:
    g = watermarked(rows).groupBy(F.window("ts", size).alias("w"), key).agg(F.count("*").alias("n"))
    return g.where(F.col("n") > budget).select(F.col("w.start").alias("window_start"), key, "n")


def retry_exhaustion(rows: DataFrame, key: str, most: int, least: int = 3, size: str = "15 minutes") -> DataFrame:
    g = watermarked(rows.where(F.col("failed") & (F.col("attempt") >= most))).groupBy(F.window("ts", size).alias("w"), key).agg(F.count("*").alias("n"))
    return g.where(F.col("n") > least).select(F.col("w.start").alias("window_start"), key, "n")


def new_failures(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Failed rows, each event once."""
    f = watermarked(rows, late).where("failed")
    return f.dropDuplicatesWithinWatermark(["event_id"]) if rows.isStreaming else f.dropDuplicates(["event_id"])


def slow(rows: DataFrame, key: str, limit: float | Column, size: str = "10 minutes", share: float = 0.05) -> DataFrame:
    """Windows whose 95th percentile is over the limit (of a row): more than a twentieth of the rows are. Counts combine before the shuffle, percentiles don't."""
    g = watermarked(rows).groupBy(F.window("ts", size).alias("w"), key).agg(F.count("ms").alias("n"), F.count_if(F.col("ms") > limit).alias("slow"))
    return g.where(F.col("slow") > share * F.col("n")).select(F.col("w.start").alias("window_start"), key, "n", "slow")


def failures_in_a_row(rows: DataFrame, key: str, least: int = 5) -> DataFrame:
    """A stream's keys whose rows (ts, event_id, failed) have failed `least` times or more in a row: key, n, first_event, once each time n grows.

    The state of a key is one count and one id. Rows of a batch are taken in the order of their time; what comes later than that counts
    where it arrives. (Of a batch table opslog.failure_runs tells the same.)
    """
    import pandas as pd

    kind = dict(rows.dtypes)[key]

    def counted(of: tuple, batches, state):
        n, first = state.get if state.exists else (0, -1)
        told = []
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            n, first = (n + 1, r.event_id if n == 0 else first) if r.failed else (0, -1)
            if n >= least:
                told.append((of[0], n, first))
        state.update((n, first))
        yield pd.DataFrame(told[-1:], columns=[key, "n", "first_event"])

    schema = f"{key} {kind}, n bigint, first_event bigint"
    return rows.select(key, "ts", "event_id", "failed").groupBy(key).applyInPandasWithState(counted, schema, "n bigint, first bigint", "append", "NoTimeout")


def corrections_of_last(rows: DataFrame, key: str, last: int = 50, over: float = 0.25) -> DataFrame:
    """A stream's decisions (ts, event_id, corrected) at which over a share of their key's last `last` were corrections: key, event_id, share.

    The state of a key is one flag for each of these decisions.
    """
    import pandas as pd

    kind = dict(rows.dtypes)[key]

    def counted(of: tuple, batches, state):
        held = list(state.get[0]) if state.exists else []
        told = []
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            held = [*held, bool(r.corrected)][-last:]
            if len(held) == last and sum(held) > over * last:
                told.append((of[0], r.event_id, sum(held) / last))
        state.update((held,))
        yield pd.DataFrame(told, columns=[key, "event_id", "share"])

    schema = f"{key} {kind}, event_id bigint, share double"
    return rows.select(key, "ts", "event_id", "corrected").groupBy(key).applyInPandasWithState(counted, schema, "held array<boolean>", "append", "NoTimeout")


def stale(rows: DataFrame, expired: Column, most: int) -> DataFrame:
    """Rows with an expired lease as lost, or dead_letter when no attempt is left."""
    return rows.where(expired).withColumn("state", F.when(F.col("attempt") >= most, "dead_letter").otherwise("lost"))


def new_documents(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Documents (ts, text), each content once by its hash."""
    hashed = rows.withColumn("content_hash", F.sha2("text", 256))
    return watermarked(hashed, late).dropDuplicatesWithinWatermark(["content_hash"]) if rows.isStreaming else hashed.dropDuplicates(["content_hash"])
