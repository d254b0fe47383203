"""Forms for large tenants, keys and rule sets against the plain ones: pairs by indexes, scans by blocks, chains, keyword index, payloads, streams in lots."""

import json
import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import scalars as S
from tallyforge.operators import chains, classify, documents, ordered, reconcile
from tallyforge.sources import statements, store
from tallyforge.streaming import ingest

INVOICES = "tenant_id int, invoice_id long, number string, total decimal(18,2), issue_date date, due_date date, currency string"
PAID = "tenant_id int, transaction_id string, amount decimal(18,2), posted_at date, value_at date, reference string, description string, counterparty string, currency string"


def ledger(spark, n, seed):
    rng = random.Random(seed)
    day = lambda: date(2024, 1, 1) + timedelta(rng.randint(0, 120)) if rng.random() > 0.1 else None
    money = lambda: Decimal(rng.choice([100, 101, 104, 2000, 2080, 5, 7, rng.randint(1, 9000)])) if rng.random() > 0.05 else None
    number = lambda i: rng.choice([f"INV-{i:04d}", f"A-{i}", "--", "", None, f"2024/{i}"])
    numbers = [number(i) for i in range(n)]
    inv = []
    for i in range(n):
        issue = day()
        inv.append((i % 2, i, numbers[i], money(), issue, issue + timedelta(30) if issue and rng.random() > 0.2 else day() if rng.random() < 0.3 else None, rng.choice(["EUR", "USD", None])))
    words = lambda: rng.choice([None, "", "rent", f"pay {rng.choice(numbers)} now", (rng.choice(numbers) or "x").replace("-", "")])
    paid = [(i % 2, f"T{i}", money() if rng.random() > 0.2 else -(money() or Decimal(1)), day(), day(), words(), words(), words(), rng.choice(["EUR", "usd", None])) for i in range(n)]
    return spark.createDataFrame(inv, INVOICES), spark.createDataFrame(paid, PAID)


@pytest.mark.parametrize("least", [1, 15, 21, 36, 51, 70])
def test_blocked_pairs_are_all_pairs_that_score(spark, least):
    inv, paid = ledger(spark, 150, 5)
    every = reconcile._scored(reconcile._invoice_side(inv).join(reconcile._transaction_side(paid), "tenant_id"), least)
    got = reconcile.blocked_pairs(inv, paid, least)
    assert sorted(map(str, got.collect())) == sorted(map(str, every.select(got.columns).collect())) and every.count() > 10


@pytest.mark.parametrize("shapes", [0, 64])
def test_numbers_that_overlap_are_found_by_shape_and_by_length(spark, monkeypatch, shapes):
    monkeypatch.setattr(reconcile, "SHAPES", shapes)
    day = date(2024, 1, 1)
    numbers = ["1-1", "a.b*", "11", "İNV-7", "b-\U0001f600-1", "a b", "--", "(x"]
    inv = spark.createDataFrame([(1, i, n, Decimal(50), day, day, None) for i, n in enumerate(numbers)], INVOICES)
    texts = ["1-1-11", "xa.b*b", "a.bb*", "1111", "i̇nv-7", "b-\U0001f600-12", "A   B", "---", "((x(x", None, ""]
    paid = spark.createDataFrame([(1, f"T{i}", Decimal(50), day, day, None, x, None, None) for i, x in enumerate(texts)], PAID)
    for least in (1, 70):
        every = reconcile._scored(reconcile._invoice_side(inv).join(reconcile._transaction_side(paid), "tenant_id"), least)
        got = reconcile.blocked_pairs(inv, paid, least)
        assert sorted(map(str, got.collect())) == sorted(map(str, every.select(got.columns).collect()))
    assert {(r.invoice_id, r.transaction_id) for r in got.where("reference_score > 0").collect()} >= {(0, "T0"), (1, "T1"), (2, "T0"), (2, "T3"), (5, "T6"), (7, "T8")}


@pytest.mark.parametrize("small", [0, 20, 1000])
def test_scopes_of_any_size_meet_once(spark, monkeypatch, small):
    monkeypatch.setattr(reconcile, "SMALL", small)
    inv, paid = (x.withColumn("import_id", F.greatest(F.right(F.col(k).cast("string"), F.lit(1)).cast("int"), F.lit(3))) for x, k in zip(ledger(spark, 120, 8), ("invoice_id", "transaction_id"), strict=True))
    met, join = [], reconcile._met
    monkeypatch.setattr(reconcile, "_met", lambda left, right, by: met.append(by) or join(left, right, by))
    got = reconcile.blocked_pairs(inv, paid, 1, ("import_id",))
    assert len(met) == (1 if small == 1000 else 4)
    assert sorted(map(str, got.collect())) == sorted(map(str, reconcile.scored_pairs(inv, paid, "import_id").select(got.columns).collect())) and got.count() > 50


def crowd(spark, n):
    """One tenant whose amounts all lie within one per cent; each invoice is paid by number, days spread over years."""
    day = lambda i: date(2000, 1, 1) + timedelta(i * 40)
    inv = [(1, i, f"INV-{i:05d}", Decimal(100000) + Decimal(i) / 10, day(i), day(i) + timedelta(30), "EUR") for i in range(n)]
    paid = [(1, f"T{i}", Decimal(100000) + Decimal(i) / 10, day(i), day(i), None, f"pay INV{i:05d}" if i % 2 else None, None, "EUR") for i in range(n)]
    return spark.createDataFrame(inv, INVOICES), spark.createDataFrame(paid, PAID)


@pytest.mark.parametrize("least", [36, 70])
def test_amounts_that_lie_close_are_not_all_compared(spark, monkeypatch, least):
    inv, paid = crowd(spark, 200)
    met, join = [], reconcile._met

    def counted(left, right, by):
        met.append(join(left, right, by).count())
        return join(left, right, by)

    monkeypatch.setattr(reconcile, "_met", counted)
    got = reconcile.blocked_pairs(inv, paid, least)
    every = reconcile._scored(reconcile._invoice_side(inv).join(reconcile._transaction_side(paid), "tenant_id"), least)
    assert sorted(map(str, got.collect())) == sorted(map(str, every.select(got.columns).collect()))
    assert sum(met) <= 10 * got.count() < 200 * 200 / 4


def test_best_and_the_rest_are_all_candidates(spark):
    found = spark.createDataFrame([(1, 1, "b", 80), (1, 1, "a", 80), (1, 1, "c", 70), (1, 2, "a", 99)], "tenant_id int, invoice_id long, transaction_id string, score int")
    assert sorted(map(tuple, reconcile.best(found).collect())) == [(1, 1, "a", 80, 3), (1, 2, "a", 99, 1)]
    assert sorted(map(tuple, reconcile.but_the_best(found).collect())) == [(1, 1, "b", 80), (1, 1, "c", 70)]


def test_amounts_near_are_counted_without_comparing_them(spark, monkeypatch):
    inv, paid = ledger(spark, 200, 7)
    i, t = inv.collect(), [r for r in paid.collect() if r.amount]
    want = {x.invoice_id: sum(y.tenant_id == x.tenant_id and x.total * 9 / 10 <= y.amount <= x.total * 11 / 10 for y in t) for x in i if x.total and x.total > 0}
    got = reconcile.count_near(inv, paid)
    assert {r.invoice_id: r.n for r in got.collect()} == {k: n for k, n in want.items() if n}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "<=" not in plan.split("Join ")[1].split("\n")[0]


def test_a_value_date_and_a_counterparty_count(spark):
    inv = spark.createDataFrame([(1, 1, "INV-9", Decimal(50), date(2024, 1, 1), date(2024, 1, 31), "EUR")], INVOICES)
    paid = spark.createDataFrame([(1, "a", Decimal(50), None, date(2024, 1, 5), None, "transfer", "ACME / INV-9", "EUR"), (1, "b", Decimal(50), None, None, None, None, None, None)], PAID)
    got = {r.transaction_id: (r.amount_score, r.date_score, r.reference_score) for r in reconcile.blocked_pairs(inv, paid).collect()}
    assert got == {"a": (50, 20, 30), "b": (50, 0, 0)}


def test_candidate_pairs(spark):
    inv, paid = ledger(spark, 80, 6)
    got = reconcile.candidate_pairs(inv, paid, 3).collect()
    i, t = [r.asDict() for r in inv.collect()], [r.asDict() for r in paid.collect()]
    want = []
    for x in i:
        own = [y for y in t if y["tenant_id"] == x["tenant_id"]]
        near = [y for y in own if x["total"] and y["amount"] and x["total"] > 0 and x["total"] * 9 / 10 <= y["amount"] <= x["total"] * 11 / 10]
        latest = sorted(own, key=lambda y: (y["posted_at"] is None, -(y["posted_at"] or date.min).toordinal(), y["transaction_id"]))[:3]
        want += [(x["invoice_id"], y["transaction_id"], "window" if near else "recent") for y in near or latest]
    assert sorted((r.invoice_id, r.transaction_id, r.origin) for r in got) == sorted(want)


@pytest.mark.parametrize("block", [7, 50, 20_000])
def test_scans_of_one_hot_key(spark, block):
    """One key has nearly all rows, one is null; each scan equals its window."""
    rng = random.Random(block)
    rows = spark.createDataFrame([(rng.choice(["hot"] * 8 + ["b", None]), rng.randint(0, 60), i, Decimal(rng.randint(-5, 9))) for i in range(700)], "key string, ts int, id int, amount decimal(18,2)").repartition(5)
    n = ordered.numbered(rows, ["key"], ["ts", "id"])
    n = ordered.running(n, ["key"], "n", block, total=F.col("amount"))
    n = ordered.last_rows(n, ["key"], "n", 5, block, last=lambda w: F.sum("amount").over(w), seen=lambda w: F.count("*").over(w))
    n = ordered.before_it(n, ["key"], "n", block, before="id")
    w = Window.partitionBy("key").orderBy("ts", "id")
    want = rows.withColumns({"n": F.row_number().over(w), "total": F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, 0)), "last": F.sum("amount").over(w.rowsBetween(-4, 0)), "seen": F.count("*").over(w.rowsBetween(-4, 0)), "before": F.lag("id").over(w)})
    columns = ["key", "id", "n", "total", "last", "seen", "before"]
    assert sorted(map(str, n.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert ordered.numbered(rows.limit(0), ["key"], ["ts"]).count() == 0


def test_chains(spark):
    """A chain of 1,000 versions, forks, orphans, a cycle with a tail, one that supersedes itself."""
    rows = [(i, i - 1 if i else None) for i in range(1000)] + [(2000, 5), (2001, 2000), (3000, -7), (3001, 3000), (4000, 4002), (4001, 4000), (4002, 4001), (4003, 4002), (5000, 5000)]
    got = {r.id: (r.root_id, r.version, r.state) for r in chains.roots(spark.createDataFrame(rows, "id long, supersedes_id long")).collect()}
    want = {i: (0, i + 1, "ok") for i in range(1000)} | {2000: (0, 7, "ok"), 2001: (0, 8, "ok"), 3000: (3000, 1, "orphan"), 3001: (3000, 2, "orphan")} | {i: (None, None, "cycle") for i in (4000, 4001, 4002, 4003, 5000)}
    assert got == want
    assert chains.roots(spark.createDataFrame([], "id long, supersedes_id long")).count() == 0


def test_ten_thousand_rules(spark):
    """As the expressions say for the default rules and some hundred of the large set; signs at the ends of keywords, blanks within, letters of other scripts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 3)))
    rules = [classify.Rule(f"r{i}", f"c{i}", rng.choice(["revenue", "expense"]), tuple({rng.choice([word(), f"{word()} {word()}", f"{word()}-", f"-{word()}", f"{word()} {word()} {word()}"]) for _ in range(rng.randint(1, 3))}), rng.randint(1, 9), rng.randint(1, 20), rng.choice(["low", "medium", "high"]), rng.choice([(), (), ("invoice",)]), rng.choice([None, None, "inflow"])) for i in range(10_000)]
    texts = [" ".join(rng.choice([word(), word() + "-", "-" + word(), "  ", "É" + word(), word() + "é"]) for _ in range(rng.randint(0, 6))) for _ in range(60)] + [None, "", "Consulting  retainer"]
    rows = spark.createDataFrame([(i, t, rng.choice(["inflow", "outflow", None])) for i, t in enumerate(texts)], "id int, text string, direction string")
    args = (F.coalesce("text", F.lit("")), F.col("direction"), F.lit(1))
    columns = ["id", "category", "category_type", "rule_id", "rule_score", "n_keywords", "confidence"]
    for some in (classify.RULES, rules[:150]):
        plain = classify.classified(rows, *args, rules=some).select(columns).collect()
        assert sorted(map(str, classify.classified_by_index(rows, "id", *args, classify.rule_table(spark, some)).select(columns).collect())) == sorted(map(str, plain))
    assert classify.classified_by_index(rows, "id", *args, classify.rule_table(spark, rules)).count() == len(texts)


def test_payloads_are_masked_at_any_depth(spark):
    given = {"tokens": ["abc"], "secret": {"x": "y"}, "email": "n/a", "customer_name": "Ann", "deep": [{"IBAN_no": 5, "ok": [1, {"raw_bytes": [1]}]}, "z" * 300], "list": list(range(30)), "é": None}
    shown = json.loads(spark.range(1).select(S.redacted_json(F.lit(json.dumps(given)))).first()[0])
    assert shown == {"tokens": ["abc"], "secret": {"x": "y"}, "email": "[REDACTED]", "customer_name": "[REDACTED]", "deep": [{"IBAN_no": "[REDACTED]", "ok": [1, {"raw_bytes": "[REDACTED]"}]}, "z" * 256 + "…"], "list": list(range(20)), "é": None}
    assert spark.range(1).select(S.redacted_json(F.lit("[1]")), S.redacted_json(F.lit("nothing")), S.redacted_json(F.lit(None).cast("string"))).first() == (None, None, None)


def test_references_at_any_depth(spark):
    payload = '{"evidence_refs":["b","a"],"x":{"y":[{"evidence_refs" : ["a", "c\\"]d", " "]}],"s":"\\"evidence_refs\\":[\\"no\\"]"},"evidence_refs":[]}'
    assert spark.range(1).select(S.evidence_refs(F.lit(payload))).first()[0] == ["b", "a", 'c"]d']


def test_line_numbers_of_a_long_invoice(spark):
    n = 100_000
    got = spark.range(1).select(documents.free_line_numbers(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: (x % 1000).cast("int"))).alias("r")).first().r
    assert len(set(got)) == n and min(got) == 1


def test_statement_files(spark, tmp_path):
    """Files that are whole, broken or empty, by each reader; a row with a cell too many or too few is put aside."""
    head = "posted_at,value_at,direction,description,counterparty,reference,currency,amount,running_balance"
    csv = spark.createDataFrame([("a", head + '\n2024-01-02,,inflow,"x, y",,,EUR,"1,000.50",\n2024-01-03,,inflow,z,,,EUR,n/a,\nonly,two\n2024-01-04,,outflow,w,,,EUR,-1,2,3,4'), ("b", head), ("c", "")], "file string, text string")
    statements.render(csv, str(tmp_path / "csv"))
    got = statements.normalized_csv(spark, str(tmp_path / "csv"), head.split(",")).collect()
    assert sorted((statements_name(r.file), r.description, r.amount, tuple(r.lacks)) for r in got if r.broken is None) == [("a", "x, y", Decimal("1000.50"), ()), ("a", "z", None, ("amount",))]
    assert sorted(r.broken for r in got if r.broken is not None) == ["2024-01-04,,outflow,w,,,EUR,-1,2,3,4", "only,two"] and all(r.lacks == ["record"] for r in got if r.broken is not None)
    nested = spark.createDataFrame([("a", '{"bank_account": {"institution_name": "H"},\n "transactions": [{"posted_at": "2024-01-02", "amount": "5.00"}]}'), ("b", '{"transactions": [{"amo'), ("c", "{}")], "file string, text string")
    statements.render(nested, str(tmp_path / "json"))
    good, bad = statements.nested_files(spark, str(tmp_path / "json"))
    assert [(statements_name(r.file), r.institution_name, r.amount) for r in good.collect()] == [("a", "H", Decimal("5.00"))] and [statements_name(r.file) for r in bad.collect()] == ["b"]
    up = {r.name: (r.media_type, r.size) for r in store.uploads(spark, str(tmp_path / "csv")).collect()}
    assert up["b"] == (None, len(head) + 1) and len(up) == 3


def statements_name(path):
    return path.split("file=")[1].split("/")[0]


def test_proposals_of_statements_that_come_in_lots(spark, tmp_path):
    """A lot that comes again brings nothing, a batch that is run again leaves the same; a later lot meets only invoices without a proposal."""
    inv = spark.createDataFrame([(1, 1, "INV-1", Decimal(50), date(2024, 1, 1), date(2024, 1, 31), "EUR"), (1, 2, "INV-2", Decimal(70), date(2024, 1, 1), date(2024, 1, 31), "EUR")], INVOICES)
    head = "posted_at,value_at,direction,description,counterparty,reference,currency,amount,running_balance\n"
    lots = [[("tenant-1-a", head + "2024-01-05,,inflow,pay INV-1,,,EUR,50,")], [("tenant-1-a-again", head + "2024-01-05,,inflow,pay INV-1,,,EUR,50,"), ("tenant-1-b", head + "2024-01-06,,inflow,INV-1 twice,,,EUR,50,\n2024-01-06,,inflow,for INV-2,,,EUR,70,"), ("tenant-1-c", "broken")]]
    folder = str(tmp_path / "store")
    for lot in lots:
        statements.render(spark.createDataFrame(lot, "file string, text string"), str(tmp_path / "drop"))
        q = ingest.start_proposals(statements.stream(spark, str(tmp_path / "drop")), inv, folder, str(tmp_path / "check"))
        q.awaitTermination(200)
        assert q.exception() is None
    assert sorted((r.invoice_id, r.score) for r in spark.read.parquet(f"{folder}/proposals").collect()) == [(1, 100), (2, 100)] and spark.read.parquet(f"{folder}/transactions").count() == 3
    again = statements.read(spark, str(tmp_path / "drop"))
    ingest.propose_new(again, 1, inv, folder)
    assert spark.read.parquet(f"{folder}/proposals").count() == 2 and spark.read.parquet(f"{folder}/transactions").count() == 3
