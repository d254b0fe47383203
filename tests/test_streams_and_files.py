"""Streams against their batch twins, and statement files."""

from decimal import Decimal

import pytest

from tallyforge.sources import statements
from tallyforge.sources import views as V
from tallyforge.streaming import alerts, ingest

SF = "/root/testdata/sf0.001"
CSV = """Bank Name,Harbour Savings
Account Number,77-12
Statement Period,05/01/2021 to 05/31/2021

date,Description,Debit,Credit,Balance
05/17/2021,ACH PAYMENT NORTH QUAY LTD #NQ-204,"2,300.10",,"9,120.00"
2021-05-18,payment Ana Reis,,88.00,"9,208.00"
19/05/2021,,4.00,,9204
05/20/2021,NEITHER AMOUNT,,,9204
"""


@pytest.fixture(scope="module")
def events(spark):
    kind = V.table(spark, SF, "events").schema
    return spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(SF)


@pytest.mark.parametrize("alert", [lambda r: alerts.failure_rate(r, "tenant_id", "1 day"), lambda r: alerts.slow(r, "agent", 50, "1 day"), lambda r: alerts.over_budget(r, "agent", 2, "1 hour")])
def test_alerts(spark, events, alert, tmp_path):
    q = alert(V.steps_of(events)).writeStream.format("memory").queryName("alerts_out").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert sorted(spark.table("alerts_out").collect()) == sorted(alert(V.steps(spark, SF)).collect())


def test_new_failures(spark, events, tmp_path):
    q = alerts.new_failures(V.steps_of(events)).writeStream.format("memory").queryName("failures_out").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert sorted(r.event_id for r in spark.table("failures_out").collect()) == sorted(r.event_id for r in V.steps(spark, SF).where("failed").select("event_id").distinct().collect())


def test_intake_takes_each_row_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, text string")
    store = str(tmp_path / "store")
    for again in range(2):
        ingest.append_new(rows, 0, store, ["id"])
        ingest.append_new(spark.createDataFrame([(2, "b"), (3, "c")], "id long, text string"), 1, store, ["id"])
        assert sorted(r.id for r in spark.read.parquet(store).collect()) == [1, 2, 3]


def test_intake_stream(spark, events, tmp_path):
    for k in range(2):  # a new checkpoint reads all again; the store takes nothing twice
        q = ingest.start(events, str(tmp_path / "store"), str(tmp_path / "check"), ["event_id"])
        q.awaitTermination(120)
        assert q.exception() is None
    assert spark.read.parquet(str(tmp_path / "store")).count() == V.table(spark, SF, "events").select("event_id").distinct().count()


def test_debit_credit(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeff" + CSV)
    files = statements.read(spark, str(tmp_path))
    a, b = sorted(statements.debit_credit(files).collect(), key=lambda r: r.row_number)
    assert (a.amount, a.direction, a.reference, a.counterparty, a.running_balance, str(a.posted_at)) == (Decimal("-2300.10"), "outflow", "NQ-204", "NORTH QUAY LTD #", Decimal("9120.00"), "2021-05-17")
    assert (b.amount, b.direction, b.currency, b.counterparty, str(b.posted_at)) == (Decimal("88.00"), "inflow", "USD", "Ana Reis", "2021-05-18")
    p = statements.preamble(files).first()
    assert p.details["Bank Name"] == "Harbour Savings" and (str(p.period_start), str(p.period_end)) == ("2021-05-01", "2021-05-31")


def test_normalized_and_nested(spark, tmp_path):
    (tmp_path / "n.csv").write_text("amount,posted_at,direction,description,currency\n10.00,2022-03-01,inflow,rent of a boat,EUR\nmany,2022-03-32,outflow,,EUR\n")
    good, bad = statements.normalized(statements.read(spark, str(tmp_path / "n.csv")))
    assert good.first().amount == Decimal("10.00") and good.count() == 1 and bad.first().lacks == ["posted_at", "description", "amount"]
    (tmp_path / "s.json").write_text('{"bank_account": {"institution_name": "Harbour"}, "statement_import": {"source_filename": "f", "opening_balance": "1,000.00"}, "transactions": [{"posted_at": "2022-03-03", "direction": "inflow", "amount": "7.25", "running_balance": "1,007.25"}]}')
    r = statements.nested(statements.read(spark, str(tmp_path / "s.json"))).first()
    assert (r.amount, r.running_balance, r.opening_balance, str(r.posted_at)) == (Decimal("7.25"), Decimal("1007.25"), Decimal("1000.00"), "2022-03-03")


def ordered(spark):
    by = {}
    for r in sorted(V.steps(spark, SF).collect(), key=lambda r: (r.ts, r.event_id)):
        by.setdefault(r.tenant_id, []).append(r)
    return by


def test_failures_in_a_row(spark, events, tmp_path):
    q = alerts.failures_in_a_row(V.steps_of(events), "tenant_id", 2).writeStream.format("memory").queryName("rows_out").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    want = set()
    for tenant, rs in ordered(spark).items():
        n, first, last = 0, None, None
        for r in rs:
            n, first = (n + 1, first if n else r.event_id) if r.failed else (0, None)
            last = (tenant, n, first) if n >= 2 else last
        want |= {last} - {None}
    assert {tuple(r) for r in spark.table("rows_out").collect()} == want and want


def test_corrections_of_last(spark, events, tmp_path):
    rows = V.steps_of(events)
    q = alerts.corrections_of_last(rows.withColumn("corrected", rows["agent"] == "purchase"), "tenant_id", 20).writeStream.format("memory").queryName("last_out").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    want = set()
    for tenant, rs in ordered(spark).items():
        for i in range(19, len(rs)):
            if (k := sum(r.agent == "purchase" for r in rs[i - 19 : i + 1])) > 5:
                want.add((tenant, rs[i].event_id, k / 20))
    assert {tuple(r) for r in spark.table("last_out").collect()} == want and want
