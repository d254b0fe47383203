"""Alerts on what follows upon what, in the order of event time: a stream that comes in any lots gives what its table gives.

Rows are held in their key's state until the watermark has passed them; only then does the order among them stand. A key's state is what came within
the watermark's delay, and a little memory. A timer wakes a key that gets no more rows. Rows later than the watermark are dropped, as by Spark's own windows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

STATE = "ts array<bigint>, id array<bigint>, flag array<boolean>, n bigint, first bigint, last array<boolean>"
#: What a key remembers of the rows that have been told: failures in a row, the first of them, and the last flags.
Memory = tuple[int, int, np.ndarray]


def in_order(rows: DataFrame, key: str, flag: str, late: str, out: str, tell: Callable[[np.ndarray, np.ndarray, Memory], tuple[pd.DataFrame, Memory]]) -> DataFrame:
    """What `tell` makes of each key's rows (ts, event_id, flag) as they become final: it gets their ids and flags in order, and the memory of those before."""
    kind = dict(rows.dtypes)[key]
    names = [c.split()[0] for c in out.split(", ")]

    def woken(of: tuple, batches, state):
        ts, ids, flags, n, first, last = state.get if state.exists else ([], [], [], 0, -1, [])
        new = [b for b in batches if len(b)]
        at = np.concatenate([np.asarray(ts, "int64"), *(b["micros"].to_numpy("int64") for b in new)])
        ids = np.concatenate([np.asarray(ids, "int64"), *(b["event_id"].to_numpy("int64") for b in new)])
        flags = np.concatenate([np.asarray(flags, bool), *(b["flag"].to_numpy(bool) for b in new)])
        by = np.lexsort((ids, at))
        at, ids, flags = at[by], ids[by], flags[by]
        passed = state.getCurrentWatermarkMs()
        k = int(np.searchsorted(at, passed * 1000, "right"))
        told, (n, first, last) = tell(ids[:k], flags[:k], (n, first, np.asarray(last, bool)))
        state.update((at[k:].tolist(), ids[k:].tolist(), flags[k:].tolist(), int(n), int(first), last.tolist()))
        if k < len(at):
            state.setTimeoutTimestamp(max(int(-(-at[k] // 1000)), passed + 1))
        told.insert(0, key, of[0])
        yield told

    seen = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    seen = seen.select(key, "ts", "event_id", F.unix_micros("ts").alias("micros"), F.coalesce(flag, F.lit(False)).alias("flag"))
    return seen.groupBy(key).applyInPandasWithState(woken, f"{key} {kind}, {out}", STATE, "append", GroupStateTimeout.EventTimeTimeout).select(key, *names)


def failures_in_a_row(rows: DataFrame, key: str, least: int = 5, late: str = "10 minutes") -> DataFrame:
    """key, event_id, first_event: the failure that is the `least`-th in a row, and the first of them; once a run. A null flag is no failure."""

    def tell(ids, failed, memory):
        n, first, last = memory
        if not len(ids):
            return pd.DataFrame({"event_id": ids, "first_event": ids}), memory
        place = np.arange(len(ids))
        sound = np.maximum.accumulate(np.where(failed, -1, place))  # the last row before that didn't fail; -1: none among these
        begun = np.where(sound < 0, (first if n else ids[0]), ids[np.minimum(sound + 1, len(ids) - 1)])
        run = np.where(failed, place - sound + np.where(sound < 0, n, 0), 0)
        hit = failed & (run == least)
        return pd.DataFrame({"event_id": ids[hit], "first_event": begun[hit]}), (int(run[-1]), int(begun[-1]) if failed[-1] else -1, last)

    return in_order(rows, key, "failed", late, "event_id bigint, first_event bigint", tell)


def corrections_of_last(rows: DataFrame, key: str, last: int = 50, over: float = 0.25, late: str = "10 minutes") -> DataFrame:
    """key, event_id, n_corrected: each decision at which more than a share of its key's last `last` were corrections; keys with fewer tell nothing."""

    def tell(ids, corrected, memory):
        flags = np.concatenate([memory[2], corrected])
        sums = np.concatenate([[0], np.cumsum(flags)])
        end = np.arange(len(memory[2]) + 1, len(flags) + 1)
        n = np.where(end >= last, sums[end] - sums[np.maximum(end - last, 0)], 0)
        hit = n > over * last
        return pd.DataFrame({"event_id": ids[hit], "n_corrected": n[hit].astype("int64")}), (memory[0], memory[1], flags[max(len(flags) - last + 1, 0) :])

    return in_order(rows, key, "corrected", late, "event_id bigint, n_corrected bigint", tell)
