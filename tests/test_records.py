"""Stored records on hard rows: allocations, details, copied totals, states."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import documents, reconcile


def test_allocations_of_any_status_and_tenant(spark):
    found = spark.createDataFrame([(1, "a", 90, 7), (1, "b", 80, 7), (2, "a", 70, 7)], "invoice_id long, transaction_id string, score int, tenant_id int")
    stored = spark.createDataFrame([(1, "a", "rejected", 8), (1, "a", "active", 8), (None, "b", "active", 7), (2, None, "active", 7)], "invoice_id long, transaction_id string, status string, tenant_id int")
    assert sorted((r["invoice_id"], r["transaction_id"]) for r in reconcile.unallocated(found, stored).collect()) == [(1, "b"), (2, "a")]
    assert reconcile.unallocated(found, stored.limit(0)).count() == 3


def test_invoice_details(spark):
    i = spark.createDataFrame([(1,), (2,)], "invoice_id long")
    lines = spark.createDataFrame([(1, Decimal("2.00")), (1, Decimal("2.00")), (1, None)], "invoice_id long, net decimal(18,2)")
    day = dt.date(2024, 1, 1)
    proposals = spark.createDataFrame([(1, 1, "old", day), (1, 2, "new", day), (1, 3, "odd", None)], "invoice_id long, version int, status string, created date")
    got = {r["invoice_id"]: r for r in reconcile.invoice_details(i, lines, proposals, spark.createDataFrame([(1, "t2", 5, 80), (1, "t1", 5, 80), (1, "t0", 5, 90)], "invoice_id long, transaction_id string, allocated int, score int")).collect()}
    assert (got[1]["n_lines"], got[1]["line_net"]) == (3, Decimal("4.00"))
    assert [p["version"] for p in got[1]["proposals"] if p["created"]] == [2, 1] and len(got[1]["proposals"]) == 3
    assert [a["transaction_id"] for a in got[1]["allocations"]] == ["t0", "t1", "t2"]
    assert got[2].asDict() == {"invoice_id": 2, "n_lines": None, "line_net": None, "proposals": None, "allocations": None}


def test_copied_totals(spark):
    d = lambda x: None if x is None else Decimal(x)
    rows = [
        ("a", 1, None, None, "6.00"), ("a", 2, "2", "3", "6.00"), ("a", 3, None, None, "5.00"), ("a", 4, "1", "6", "6.00"), ("a", 5, None, "6", "6.00"), ("a", 6, None, None, None),
        ("b", 1, "2", "2", "9.00"), ("b", 2, None, None, "9.00"), ("c", 1, "0", "5", "0.00"), ("c", 2, None, None, "0.00"),
    ]
    items = spark.createDataFrame([(x, n, d(q), d(u), d(t)) for x, n, q, u, t in rows], "doc string, n int, quantity decimal(18,2), unit_price decimal(18,2), line_total decimal(18,2)")
    got = {(r["doc"], r["n"]): r["line_total"] for r in documents.without_copied_totals(items, "doc", ["n"]).collect()}
    assert got == {(x, n): None if (x, n) == ("a", 1) else d(t) for x, n, _, _, t in rows}


def test_states(spark):
    row = spark.createDataFrame([(Decimal("1.50"), dt.date(2024, 2, 3), None, 4, 'say "x"')], "a decimal(18,2), b date, c string, d long, e string")
    kinds = dict(row.dtypes)
    assert row.select(S.state_json({n: (F.col(n), kinds[n]) for n in kinds}).alias("j")).first()["j"] == '{"a":"1.50","b":"2024-02-03","c":null,"d":4,"e":"say \\"x\\""}'
