"""Chains of versions followed to their first version by pointer doubling: a chain of n versions takes log n rounds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.sources import store


def stored(rows: DataFrame) -> DataFrame:
    """rows, written to the shared folder, so that a round doesn't repeat those before it."""
    path = store.shared_folder(rows.sparkSession, "chains")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def roots(rows: DataFrame, key: str = "id", up: str = "supersedes_id") -> DataFrame:
    """id, root_id, version (from 1), state of rows(id, supersedes_id), ids that differ.

    state: `ok`; `orphan` if the first version known supersedes one that isn't there (it is the root then); `cycle`, without root and version,
    if the chain never ends. Each round a row's pointer skips as many versions as all rounds before it together; rows that have reached
    their root leave, and what hasn't after log2 n rounds is a cycle or hangs on one.
    """
    own = rows.select(F.col(key).alias("id"), F.col(up).alias("to"))
    known = own.select(F.col("id").alias("known"))
    state = stored(own.join(known, own["to"] == known["known"], "left").select(
        "id", F.when(F.col("known").isNotNull(), F.col("to")).alias("to"), F.lit(1).cast("bigint").alias("steps"), (F.col("to").isNotNull() & F.col("known").isNull()).alias("orphan")
    ))
    n = state.count()
    done = state.where("to is null").select("id", F.col("id").alias("root_id"), "steps", "orphan")
    open_ = state.where("to is not null").select("id", "to", "steps")
    for _ in range(math.ceil(math.log2(n + 1)) + 1 if n else 0):
        ends = done.select(F.col("id").alias("to"), "root_id", F.col("steps").alias("more"), "orphan")
        ahead = open_.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("further"))
        both = stored(open_.join(ends, "to", "left").join(ahead, "to", "left").select(
            "id", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", "further", F.lit(0))).alias("steps"), "root_id", "orphan"
        ))
        done = stored(done.unionByName(both.where("root_id is not null").select("id", "root_id", "steps", "orphan")))
        open_ = both.where("root_id is null").select("id", "to", "steps")
        if not open_.head(1):
            break
    ended = done.select("id", "root_id", F.col("steps").alias("version"), F.when(F.col("orphan"), "orphan").otherwise("ok").alias("state"))
    none = F.lit(None)
    return ended.unionByName(open_.select("id", none.cast(dict(ended.dtypes)["root_id"]).alias("root_id"), none.cast("bigint").alias("version"), F.lit("cycle").alias("state")))
