"""Rules on texts and payloads that no SQL says: brute force and edges."""

from decimal import Decimal

from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import documents, review
from tallyforge.plans import registry
from tallyforge.sources import payloads

SF = "/root/testdata/sf0.001"


def repaired(numbers):
    out, auto = [], 1
    for n in numbers:
        if n is None or n <= 0 or n in out:
            while auto in out:
                auto += 1
            n, auto = auto, auto + 1
        out.append(n)
    return out


def test_line_numbers(spark):
    cases = [[], [1, 1, 2], [None, 3, 0, 3, -1, 5], [2, 2, 2, 1], [7, None, None]]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, n array<int>").select("i", documents.free_line_numbers(F.col("n")).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [repaired(x) for x in cases]
    for r in registry.QUERIES["wn_09"](spark, SF).collect():
        assert list(map(int, r.repaired.split(","))) == repaired(list(map(int, r.given.split(","))))


def test_vat_amount(spark):
    cases = [(["100", "23", "123"], "23"), (["6", "100", "23", "123.01"], "23"), (["50", "40"], "40"), (["9"], None), ([], None), (["1", "2", "9"], "1")]
    rows = spark.createDataFrame([(i, [Decimal(x) for x in v]) for i, (v, _) in enumerate(cases)], "i int, v array<decimal(18,2)>")
    got = rows.select("i", documents.vat_amount(F.col("v")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [None if e is None else Decimal(e) for _, e in cases]


def test_scored_scalars(spark):
    row = spark.range(1).select(
        S.scored_amount(F.lit("1.234")).alias("a"), S.scored_amount(F.lit("1.234,5 €")).alias("b"), S.scored_amount(F.lit("x")).alias("c"), S.scored_date(F.lit("3 mai 2024")).cast("string").alias("d"), S.scored_date(F.lit("03.05.24")).cast("string").alias("e"),
        S.scored_date(F.lit("soon")).alias("f"), S.scored_text(F.lit("  Straße—№ 1 ")).alias("g"), S.scored_text(F.lit("--")).alias("h"), S.money_token(F.lit("$1,234")).alias("i"), S.quantity_token(F.lit("300"), F.lit(None).cast("decimal(18,2)"), F.lit(1)).alias("j"),
    ).first()
    assert list(row) == [Decimal("1.23"), Decimal("1234.50"), None, "2024-05-03", "2024-05-03", None, "strasse no 1", None, Decimal("12.34"), Decimal("3.00")]


def test_payload_edges(spark):
    given = ['{"totals": {"total_amount": "5.00", "currency": "EUR"}}', "broken", None, '{"table": {"line_items": [{"line_number": 1, "line_total": "x"}]}, "metadata": {"currency": "USD"}}']
    rows = spark.createDataFrame(list(enumerate(given, 1)), "id int, payload string")
    assert {r.id: (r.currency, r.total_amount) for r in payloads.invoice_groups(rows, "id").collect()} == {1: ("EUR", "5.00"), 2: (None, None), 3: (None, None), 4: ("USD", None)}
    assert {r.id: (r.line_number, r.line_total) for r in payloads.invoice_items(rows, "id").collect()} == {1: (None, None), 2: (None, None), 3: (None, None), 4: (1, None)}
    scans = ['{"paragraphs": [{"content": "a"}, {"content": " "}]}', '{"pages": [{"page": 2, "confidence": 0.5, "lines": [{"content": "b"}]}, {"page": 3}]}', "{}", '{"rec_texts": ["c", "d"], "rec_scores": [0.5]}']
    got = payloads.scan_blocks(spark.createDataFrame(list(enumerate(scans, 1)), "id int, payload string"), "id").collect()
    assert sorted((r.id, r.block_no, r.content, r.page, r.confidence, r.scan_confidence) for r in got if r.id != 4) == [(1, 1, "a", 1, None, None), (2, 1, "b", 2, None, 0.5)]
    assert sorted((r.content, r.confidence) for r in got if r.id == 4) == [("c", 0.5), ("d", None)]


def test_report_and_erasure(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "name string, n int")
    payloads.write_report(rows, ["name", "n"], F.col("name"), str(tmp_path))
    assert [r.value for r in spark.read.text(str(tmp_path / "markdown")).collect()] == ["| name | n |", "| --- | --- |", "| a | 1 |", "| b | 2 |"]
    assert sorted(r.n for r in spark.read.json(str(tmp_path / "json")).collect()) == [1, 2]
    kept, receipt = payloads.erased({"t": spark.createDataFrame([(1,), (2,), (None,)], "tenant_id int")}, F.lit(1))
    assert receipt.first().n_erased == 1 and sorted(str(r.tenant_id) for r in kept["t"].collect()) == ["2", "None"]


def test_unknown_task_type_allows_nothing(spark):
    got = review.allowed(spark.createDataFrame([("policy", "acknowledge_policy"), ("nothing", "approve_proposal")], "task_type string, action string")).collect()
    assert {r.task_type: r.allowed for r in got} == {"policy": True, "nothing": False}
