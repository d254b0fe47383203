"""Alerts in event time: however a stream's rows come, they tell what the rows in order tell."""

import datetime as dt
import random

import pytest

from tallyforge.streaming import event_time

KIND = "key string, ts timestamp, event_id long, failed boolean, corrected boolean"
T0 = dt.datetime(2024, 3, 1)


def made(n, seed):
    r = random.Random(seed)
    return [(r.choice(["a", "b", None]), T0 + dt.timedelta(minutes=r.randrange(600)), i, r.choice([True, True, False, None]), r.choice([True, False, False, None])) for i in range(n)]


def told(spark, tmp_path, lots, alert):
    """What the alert tells of lots of rows, each of which is one file; then a row that lies far ahead."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for lot in [*lots, [("end", T0 + dt.timedelta(days=90), -1, False, False)]]:
        spark.createDataFrame(lot, KIND).coalesce(1).write.mode("append").parquet(folder)
        stream = alert(spark.readStream.schema(KIND).parquet(folder))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    return sorted(map(tuple, spark.read.schema(stream.schema).parquet(out).collect()), key=repr)


def in_order(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    return by


def runs(rows, least):
    out = []
    for key, rs in in_order(rows).items():
        n = first = 0
        for r in rs:
            n, first = (n + 1, first if n else r[2]) if r[3] else (0, 0)
            if n == least:
                out.append((key, r[2], first))
    return sorted(out, key=repr)


def shares(rows, last, over):
    out = []
    for key, rs in in_order(rows).items():
        for i in range(last - 1, len(rs)):
            n = sum(bool(r[4]) for r in rs[i - last + 1 : i + 1])
            if n > over * last:
                out.append((key, rs[i][2], n))
    return sorted(out, key=repr)


def split(rows, n, hours):
    """Lots by the time a row comes, which is up to some hours after its own."""
    r = random.Random(n)
    comes = [((x[1] - T0).total_seconds() / 3600 + r.random() * hours, x) for x in rows]
    top = 10 + hours
    lots = [[x for at, x in comes if i * top / n <= at < (i + 1) * top / n] for i in range(n)]
    for lot in lots:
        r.shuffle(lot)
    return [lot for lot in lots if lot]


@pytest.mark.parametrize("n", [1, 4])
def test_any_lots_tell_the_same(spark, tmp_path, n):
    rows = made(240, 5)
    want = runs(rows, 3)
    assert want and told(spark, tmp_path / "runs", split(rows, n, 2), lambda s: event_time.failures_in_a_row(s, "key", 3, "2 hours")) == want
    want = shares(rows, 10, 0.4)
    assert want and told(spark, tmp_path / "last", split(rows, n, 2), lambda s: event_time.corrections_of_last(s, "key", 10, 0.4, "2 hours")) == want


def test_ties_and_keys_with_few_rows(spark, tmp_path):
    rows = [("a", T0, i, True, True) for i in range(4)] + [("b", T0, 9, True, True)]
    assert told(spark, tmp_path, [rows], lambda s: event_time.failures_in_a_row(s, "key", 4, "1 hour")) == [("a", 3, 0)]


def test_what_comes_too_late_is_dropped(spark, tmp_path):
    rows = [("a", T0 + dt.timedelta(hours=h), h, True, False) for h in (0, 1, 2)]
    ahead, late = [("b", T0 + dt.timedelta(days=2), 50, False, False)], [("a", T0 + dt.timedelta(minutes=90), 60, False, False)]
    more = [("c", T0 + dt.timedelta(days=3), 51, False, False)]
    assert told(spark, tmp_path, [rows, ahead, more, late], lambda s: event_time.failures_in_a_row(s, "key", 3, "1 hour")) == [("a", 2, 0)]
