"""Erasure from a store, what corrections carry along, QA outcomes, contracts of payloads, redactions in any script, merged records."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import documents, review, validate
from tallyforge.sources import store


def held(spark, path):
    return sorted(((r["tenant_id"], r["x"]) for r in store.load(spark, path).collect()), key=repr)


@pytest.fixture
def filled(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(1, "a"), (1, "a"), (2, "b"), (None, "c"), (3, None)]
    store.publish(spark.createDataFrame(rows, "tenant_id long, x string"), path, 2)
    return path


def test_erasure(spark, filled):
    assert store.erase(spark, filled, 1, 2) == 2 and store.erase(spark, filled, 1, 2) == 0
    assert held(spark, filled) == [(2, "b"), (3, None), (None, "c")]
    assert store.stored_anywhere(spark, filled, 1).count() == 0 and store.stored_anywhere(spark, filled, 2).count() == 1
    assert store.erase(spark, filled, 99, 2) == 0
    assert [tuple(r) for r in store.receipts(spark, filled).collect()] == [(1, 2, 2)]


def test_last_rows_of_a_bucket(spark, filled):
    for tenant in (1, 2, 3):
        assert store.erase(spark, filled, tenant, 2) > 0
    assert held(spark, filled) == [(None, "c")]


def test_a_run_that_fails_before_its_version(spark, filled, monkeypatch):
    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", fail)
        with pytest.raises(OSError):
            store.erase(spark, filled, 1, 2)
    assert held(spark, filled) == [(1, "a"), (1, "a"), (2, "b"), (3, None), (None, "c")]
    assert store.erase(spark, filled, 1, 2) == 2


def test_a_run_that_fails_after_its_version(spark, filled, monkeypatch):
    emptied = store._emptied

    def fail(s, path, folders):
        if folders:
            raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_emptied", fail)
        with pytest.raises(OSError):
            store.erase(spark, filled, 1, 2)
    assert store.stored_anywhere(spark, filled, 1).count() == 2 and len(held(spark, filled)) == 3
    assert store._emptied is emptied and store.erase(spark, filled, 1, 2) == 0
    assert store.stored_anywhere(spark, filled, 1).count() == 0
    assert store.receipts(spark, filled).count() == 1


def test_store_of_no_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    store.publish(spark.createDataFrame([], "tenant_id long, x string"), path)
    assert held(spark, path) == [] and store.erase(spark, path, 1) == 0


def test_what_corrections_carry(spark):
    before = spark.createDataFrame([(1, 1, "r1", "open", 5), (2, 1, "r2", "open", 6), (3, 1, "r3", "superseded", 7)], "invoice_id long, version int, root_id string, status string, total int")
    fixes = spark.createDataFrame([(10, 100, 1, {"total": "8"}), (11, 101, 1, {"total": "9"}), (20, 200, 2, {"total": "x"}), (30, 300, 3, {"total": "1"})], "correction_id long, task_id long, invoice_id long, changes map<string,string>")
    after, refused = review.correct(before, fixes, ["total"])
    made = review.made_versions(before, after)
    assert [tuple(r) for r in made.collect()] == [(1, 1, 2)]
    lines = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 1, None), (2, 1, "b")], "invoice_id long, version int, text string")
    got = sorted((tuple(r) for r in review.copied_lines(lines, made).collect()), key=repr)
    assert got == sorted([(1, 1, "a"), (1, 1, "a"), (1, 1, None), (1, 2, "a"), (1, 2, "a"), (1, 2, None), (2, 1, "b")], key=repr)
    tasks = spark.createDataFrame([(100, 1, 1, "open"), (101, 1, 1, "open"), (200, 2, 1, "open"), (300, 3, 1, "in_progress"), (400, 1, 1, "open")], "task_id long, invoice_id long, version int, status string")
    got = {r["task_id"]: (r["version"], r["status"]) for r in review.repointed_tasks(tasks, fixes, refused, made).collect()}
    assert got == {100: (2, "resolved"), 101: (1, "open"), 200: (1, "open"), 300: (1, "in_progress"), 400: (1, "open")}


def test_qa_outcomes(spark):
    drafts = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    signals = [(1, "A", "error", True, "totals"), (1, "B", "error", False, None), (2, "B", "error", False, None), (2, "B", "error", False, None), (3, "W", "warning", True, None), (4, "C", "blocking", True, None), (5, "N", None, None, None)]
    rows = spark.createDataFrame(signals, "entity_id long, code string, severity string, retryable boolean, target string")
    got = {r["id"]: tuple(r)[1:] for r in validate.qa_outcomes(drafts, "id", rows).collect()}
    assert got == {1: ("correction_required", 1, 2, "A,B"), 2: ("review_required", 2, 2, "B"), 3: ("passed", 0, 1, "W"), 4: ("review_required", 1, 1, "C"), 5: ("review_required", 1, 1, "N"), 6: ("passed", 0, 0, "")}
    assert {r["outcome"] for r in validate.qa_outcomes(drafts, "id", rows.limit(0)).collect()} == {"passed"}


TABLE = "invoice-table-group.v1"
CASES = [
    (TABLE, "{}", []),
    (TABLE, '{"line_items":[]}', []),
    (TABLE, '{"line_items":"x"}', ["line_items: not an array"]),
    (TABLE, '{"line_items":[{"line_number":1},{"line_number":0,"more":1},{"description":["x"]}]}', ["line_items[1].line_number: below 1", "line_items[1].more: not known", "line_items[2].line_number: missing", "line_items[2].description: not a text"]),
    ("invoice-totals-group.v1", '{"total_amount":null,"currency":"EUR","confidence":"sure"}', ["confidence: not allowed"]),
    ("invoice-metadata-group.v1", '{"customer_name":{"a":1},"total":"5"}', ["customer_name: not a text", "total: not known"]),
    ("invoice-metadata-group.v1", "[]", ["not an object"]),
    ("invoice-metadata-group.v1", None, ["invalid JSON"]),
    ("other", "{}", ["schema not registered"]),
]


def test_contracts(spark):
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(CASES)], "i int, schema string, payload string, want array<string>")
    for r in validate.contract(rows).collect():
        assert r["errors"] == r["want"], r["payload"]


def test_redactions_in_any_script(spark):
    texts = ["étin abcde", "tin abcde", "mã số thuế: 12345", "vat 12345é", "x@y.org", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    text, n = S.redaction_counts(F.col("text"))
    got = {r["i"]: (r["t"], r["n"]) for r in rows.select("i", text.alias("t"), n["tax_id"].alias("n")).collect()}
    assert got == {0: ("étin abcde", 0), 1: ("[REDACTED_TAX_ID]", 1), 2: ("[REDACTED_TAX_ID]", 1), 3: ("vat 12345é", 0), 4: ("[REDACTED_EMAIL]", 0), 5: ("", 0), 6: (None, None)}


def test_merged_records(spark):
    kind = "struct<number:string,customer:string,supplier:string,currency:string,supplier_tax_id:string,customer_tax_id:string,subtotal:int,tax:int,issue_date:string,due_date:string,total:int,confidence:string>"
    rows = [((None, " ", "R", "EUR", "1", "", None, 2, "d1", None, 9, "low"), ("M", "N", " ", None, "9", "8", 7, None, "d2", "d1", None, None))]
    r = spark.createDataFrame(rows, f"r {kind}, m {kind}").select(*documents.merged("r", "m")).first()
    assert r.asDict() == {"number": "M", "customer": "N", "supplier_tax_id": "1", "customer_tax_id": "8", "supplier": "R", "currency": "EUR", "subtotal": 7, "tax": 2, "issue_date": "d1", "due_date": None, "total": 9}
