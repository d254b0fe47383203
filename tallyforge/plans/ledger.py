"""Queries on categories, cash-flow reports, balances and insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import classify, insights, ordered, reconcile, scoring
from tallyforge.plans import registry as R
from tallyforge.plans.catalog import ORACLES, QUERIES, query
from tallyforge.sources import views as V

c, inv, tx, stm = F.col, V.invoices, V.transactions, V.statements

#: Transactions with the category that the rules give them.
LABELLED = f"""(SELECT * EXCLUDE (b, ft), coalesce(b.code, 'uncategorized_' || ft) AS category, coalesce(b.type, ft) AS category_type, b.id AS rule_id, coalesce(b.score, 0) AS rule_score,
 coalesce(b.n, 0) AS n_keywords, coalesce(b.confidence, 'low') AS confidence
 FROM (SELECT *, {classify.oracle()} AS b, CASE direction WHEN 'inflow' THEN 'revenue' ELSE 'expense' END AS ft FROM transactions))"""
K = "substr(transaction_id, 2)::BIGINT"


def labelled(s, d):
    return classify.classified(tx(s, d), classify.haystack(c("description"), c("counterparty"), c("reference"), c("currency")), c("direction"), c("amount"))


def number():
    return F.substr("transaction_id", F.lit(2)).cast("bigint")


@query("bd_01", f"SELECT transaction_id, category, category_type, rule_id, rule_score, n_keywords, confidence FROM {LABELLED}")
def bd_01(s, d):
    return labelled(s, d).select("transaction_id", "category", "category_type", "rule_id", "rule_score", "n_keywords", "confidence")


@query("bd_01_index", f"SELECT transaction_id, category, category_type, rule_id, rule_score, n_keywords, confidence FROM {LABELLED}")
def bd_01_index(s, d):
    """The same by an index of the rules' keywords, as for rules in large numbers."""
    rows = classify.classified_by_index(tx(s, d), "transaction_id", classify.haystack(c("description"), c("counterparty"), c("reference"), c("currency")), c("direction"), c("amount"), classify.rule_table(s))
    return rows.select("transaction_id", "category", "category_type", "rule_id", "rule_score", "n_keywords", "confidence")


@query(
    "bd_03",
    f"""SELECT transaction_id, CASE WHEN use THEN label ELSE category END AS category, CASE WHEN use THEN CASE label WHEN 'office_supplies' THEN 'expense' ELSE 'other' END ELSE category_type END AS category_type,
        CASE WHEN use THEN 'medium' ELSE confidence END AS confidence FROM (SELECT *, confidence IN ('low', 'unknown') AND label <> 'no_such_code' AS use FROM (
        SELECT *, ['office_supplies', 'no_such_code', 'uncategorized_other'][{K} % 3 + 1] AS label FROM {LABELLED}))""",
)
def bd_03(s, d):
    """Stored labels count where the rules are unsure and the taxonomy has the code."""
    stored = F.element_at(F.array(*map(F.lit, ("office_supplies", "no_such_code", "uncategorized_other"))), (number() % 3 + 1).cast("int"))
    rows = labelled(s, d).withColumns({"label": stored, "label_confidence": F.lit("moderate")})
    return classify.with_stored_labels(rows).select("transaction_id", "category", "category_type", "confidence")


DUE = classify.oracle("invoice", "concat_ws(' ', text, currency)")


@query(
    "bd_09",
    f"""WITH a AS (SELECT invoice_id, b.code AS code, coalesce(b.confidence, 'low') AS confidence FROM (SELECT *, {DUE} AS b FROM (SELECT *, 'inflow' AS direction, CASE invoice_id % 3 WHEN 0 THEN 'Consulting retainer' WHEN 1 THEN 'paper' ELSE 'software' END AS text
        FROM invoices WHERE status = 'approved')))
        SELECT invoice_id, 'classification' AS kind, coalesce(code, 'uncategorized_revenue') AS proposal, CASE WHEN confidence IN ('low', 'unknown') THEN 'pending_review' ELSE 'proposed' END AS status FROM a
        UNION ALL SELECT invoice_id, 'reconciliation', 'placeholder', 'pending_review' FROM a""".replace("WITH a AS", "SELECT * FROM (WITH a AS", 1) + ")",
)
def bd_09(s, d):
    """What an approved invoice sets off: a label by the rules, and a reconciliation to be filled."""
    text = F.element_at(F.array(*map(F.lit, ("Consulting retainer", "paper", "software"))), (c("invoice_id") % 3 + 1).cast("int"))
    done = inv(s, d).where("status = 'approved'")
    named = classify.classified(done, classify.haystack(text, c("currency")), F.lit("inflow"), c("total"), "invoice")
    state = F.when(c("confidence").isin("low", "unknown"), "pending_review").otherwise("proposed")
    named = named.select("invoice_id", F.lit("classification").alias("kind"), c("category").alias("proposal"), state.alias("status"))
    return named.unionByName(done.select("invoice_id", F.lit("reconciliation").alias("kind"), F.lit("placeholder").alias("proposal"), F.lit("pending_review").alias("status")))


@query("jn_08", f"SELECT transaction_id, CASE WHEN category <> 'advertising_expense' OR tenant_id % 2 = 1 THEN tenant_id || ':' || category END AS category_id FROM {LABELLED}")
def jn_08(s, d):
    """Category rows by tenant and slug (even tenants have no advertising); the side grows with tenants, so no broadcast is forced."""
    codes = sorted({r.code for r in classify.RULES} | {"uncategorized_revenue", "uncategorized_expense"})
    slugs = V.tenants(s, d).select("tenant_id", F.explode(F.array(*map(F.lit, codes))).alias("category")).where("category <> 'advertising_expense' OR tenant_id % 2 = 1")
    known = slugs.withColumn("category_id", F.concat_ws(":", c("tenant_id").cast("string"), "category"))
    return labelled(s, d).select("transaction_id", "tenant_id", "category").join(known, ["tenant_id", "category"], "left").select("transaction_id", "category_id")


@query(
    "ag_02",
    f"""SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY absolute DESC, category) AS place FROM (SELECT tenant_id, category, max(category_type) AS category_type, count(*) AS n, sum(amount) AS total, abs(sum(amount)) AS absolute
        FROM (SELECT * REPLACE (CASE WHEN {K} % 29 = 0 THEN 'uncategorized' ELSE category END AS category, CASE WHEN {K} % 29 <> 0 THEN category_type END AS category_type) FROM {LABELLED}) GROUP BY 1, 2)""",
)
def ag_02(s, d):
    """Category totals in order of size; some rows have no category."""
    known = number() % 29 != 0
    rows = labelled(s, d).withColumns({"category": F.when(known, c("category")), "category_type": F.when(known, c("category_type"))})
    return insights.category_totals(rows, "tenant_id")


FIRST = "first({v} ORDER BY abs(amount) DESC, posted_at, transaction_id) FILTER ({w})"
REPORT = f"""(SELECT import_id, account_id, tenant_id, period_start, period_end, currency, opening_balance, closing_balance, opening_balance + coalesce(net, 0) AS expected_closing, closing_balance - (opening_balance + coalesce(net, 0)) AS variance,
 coalesce(n, 0) AS n, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, coalesce(total_in, 0)::DECIMAL(28,2) AS total_in, coalesce(total_out, 0)::DECIMAL(28,2) AS total_out, coalesce(net, 0)::DECIMAL(28,2) AS net, (-coalesce(total_out, 0))::DECIMAL(28,2) AS total_out_abs,
 largest_in, largest_in_amount, largest_out, largest_out_amount FROM statements LEFT JOIN (SELECT account_id, count(*) AS n, count(*) FILTER (amount > 0) AS n_in, count(*) FILTER (amount < 0) AS n_out,
 coalesce(sum(amount) FILTER (amount > 0), 0) AS total_in, coalesce(sum(amount) FILTER (amount < 0), 0) AS total_out, sum(amount) AS net, {FIRST.format(v="transaction_id", w="amount > 0")} AS largest_in, {FIRST.format(v="abs(amount)", w="amount > 0")} AS largest_in_amount,
 {FIRST.format(v="transaction_id", w="amount < 0")} AS largest_out, {FIRST.format(v="abs(amount)", w="amount < 0")} AS largest_out_amount FROM transactions GROUP BY 1) USING (account_id))"""


def report(s, d):
    return insights.report(tx(s, d), stm(s, d))


@query("ag_01", f"SELECT * EXCLUDE (tenant_id) FROM {REPORT}")
def ag_01(s, d):
    """A report of each statement: period, balances, variance, counts, sums and the largest rows."""
    return report(s, d)


@query("ag_01_evidence", "SELECT account_id, 'statement_transaction:' || transaction_id AS evidence_ref, CASE WHEN amount > 0 THEN 'inflow' WHEN amount < 0 THEN 'outflow' ELSE 'none' END AS side FROM transactions")
def ag_01_evidence(s, d):
    """The rows that the reports rest on."""
    return insights.evidence(tx(s, d))


BY = "string_agg({c} || '=' || amount::VARCHAR, ',' ORDER BY {c} || '=' || amount::VARCHAR)"
ODD = "CASE WHEN tenant_id % 2 = 1 THEN coalesce(currency, 'USD') ELSE coalesce(currency, 'UNK') END"


@query(
    "ag_03",
    f"""SELECT tenant_id, metric, sum(n)::BIGINT AS n, {BY.format(c="currency")} AS by_currency, CASE WHEN count(*) = 1 THEN max(amount) END AS amount, CASE WHEN count(*) = 1 THEN max(currency) END AS currency, max(day) AS period_end FROM (
        SELECT tenant_id, metric, currency, sum(abs(amount)) AS amount, count(*) AS n, max(posted_at) AS day FROM (SELECT tenant_id, amount, posted_at, {ODD} AS currency,
        unnest(list_filter([CASE WHEN direction = 'inflow' OR amount > 0 THEN 'inflow' END, CASE WHEN direction = 'outflow' OR amount < 0 THEN 'outflow' END], lambda x: x IS NOT NULL)) AS metric FROM transactions WHERE status = 'posted') GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def ag_03(s, d):
    """Dashboard sums by tenant: by currency, and as one amount where there is one currency only."""
    inflow, outflow = (c("direction") == "inflow") | (c("amount") > 0), (c("direction") == "outflow") | (c("amount") < 0)
    rows = tx(s, d).where("status = 'posted'").withColumn("metric", F.explode(F.array_compact(F.array(F.when(inflow, "inflow"), F.when(outflow, "outflow")))))
    rows = rows.withColumns({"currency": F.when(c("tenant_id") % 2 == 1, F.coalesce("currency", F.lit("USD"))).otherwise(c("currency")), "amount": F.abs("amount"), "day": c("posted_at")})
    return insights.amounts(rows, "tenant_id", "metric")


LAST = "ORDER BY coalesce(posted_at, value_at) DESC, transaction_id"
GROUPED = """(SELECT tenant_id, {k} AS kind, sum(n)::BIGINT AS n, {by} AS by_currency, CASE WHEN count(*) = 1 THEN max(amount) END AS amount, CASE WHEN count(*) = 1 THEN max(currency) END AS currency, max(day) AS period_end
 FROM (SELECT tenant_id, coalesce(currency, 'UNK') AS currency, sum(amount) AS amount, count(*) AS n, max(day) AS day FROM ({f}) GROUP BY 1, 2) GROUP BY 1)"""
RUNNING = f"SELECT any_value(tenant_id) AS tenant_id, first(currency {LAST}) AS currency, first(running_balance {LAST}) AS amount, first(posted_at {LAST}) AS day FROM transactions WHERE running_balance IS NOT NULL AND tenant_id % 3 <> 0 GROUP BY account_id"
CLOSING = "SELECT tenant_id, currency, closing_balance AS amount, period_end AS day FROM statements WHERE status = 'parsed' AND closing_balance IS NOT NULL AND tenant_id % 6 <> 0"


@query(
    "ag_04",
    f"""SELECT tenant_id, kind IS NOT NULL AS available, amount, q.currency AS currency, coalesce(by_currency, '') AS by_currency, coalesce(n, 0) AS account_count, CASE WHEN kind = 0 THEN n ELSE 0 END AS transaction_count, period_end, {insights.SOURCES}[coalesce(kind, 2) + 1] AS source
        FROM tenants LEFT JOIN (SELECT * FROM (SELECT * FROM {GROUPED.format(k=0, by=BY.format(c="currency"), f=RUNNING)} UNION ALL SELECT * FROM {GROUPED.format(k=1, by=BY.format(c="currency"), f=CLOSING)})
        QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY kind) = 1) q USING (tenant_id)""",
)
def ag_04(s, d):
    """Cash position: running balances, else statements (every third tenant has none of the first here, every sixth of neither)."""
    t = tx(s, d).withColumn("running_balance", F.when(c("tenant_id") % 3 != 0, c("running_balance")))
    return insights.cash_position(t, stm(s, d).withColumn("closing_balance", F.when(c("tenant_id") % 6 != 0, c("closing_balance"))), V.tenants(s, d))


BACK = "{'a': -date_diff('day', DATE '0001-01-01', coalesce(p, v, DATE '0001-01-01')), 'b': transaction_id}"


@query(
    "wn_01",
    f"""SELECT account_id, x.currency AS currency, x.running_balance AS balance, x.p AS posted_at, x.transaction_id AS transaction_id FROM (
        SELECT account_id, arg_min({{'currency': currency, 'running_balance': running_balance, 'p': p, 'transaction_id': transaction_id}}, {BACK}) AS x FROM (
        SELECT *, CASE WHEN {K} % 7 <> 0 THEN posted_at END AS p, CASE WHEN {K} % 14 <> 0 THEN value_at END AS v FROM transactions) WHERE running_balance IS NOT NULL GROUP BY 1)""",
)
def wn_01(s, d):
    """The latest balance of an account; rows without a posted day count by their value day, without both they come last."""
    k = number()
    return insights.latest_balance(tx(s, d).withColumns({"posted_at": F.when(k % 7 != 0, c("posted_at")), "value_at": F.when(k % 14 != 0, c("value_at"))}))


@query(
    "wn_02",
    """SELECT account_id, import_id, currency, balance, period_end FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY coalesce(period_end, DATE '0001-01-01') DESC, import_id) AS rn FROM (
        SELECT account_id, import_id * 2 + n AS import_id, currency, closing_balance + n AS balance, CASE WHEN import_id % 7 <> 0 THEN period_end + n * 31 END AS period_end FROM statements, (VALUES (0), (1)) v(n)
        WHERE status = 'parsed' AND closing_balance IS NOT NULL AND (import_id + n) % 5 <> 0)) WHERE rn = 1""",
)
def wn_02(s, d):
    """The latest of an account's statements: two each, some failed, some without an end or a balance."""
    two = stm(s, d).withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = two.select(
        "account_id", (c("import_id") * 2 + c("n")).alias("import_id"), "currency", F.when((c("import_id") + c("n")) % 5 != 0, c("closing_balance") + c("n")).alias("closing_balance"),
        F.when(c("import_id") % 7 != 0, F.date_add("period_end", c("n") * 31)).alias("period_end"), "status",
    )
    return insights.latest_statement(rows)


SAID = "coalesce(currency, 'UNKNOWN') || ' ' || format('{:,.2f}', abs({v})::DOUBLE)"
SHARE = "round((largest_in_amount * 100)::DECIMAL(38,10) / total_in, 2)"
CASH = """'{"total_inflow":"' || total_in || '","total_outflow_abs":"' || total_out_abs || '","net_change":"' || net || '"' || CASE WHEN variance IS NULL THEN '' ELSE ',"closing_balance_variance":"' || variance || '"' END || '}'"""
INSIGHTS = f"""(SELECT import_id, tenant_id, 'cashflow' AS type, CASE WHEN net < 0 THEN 'high' ELSE 'info' END AS severity, CASE WHEN net < 0 THEN 'Cash fell by ' ELSE 'Cash rose by ' END || {SAID.replace('{v}', 'net')} AS title, net::DECIMAL(38,2) AS metric,
 CASE WHEN variance = 0 THEN 'high' ELSE 'medium' END AS confidence, 'report' AS evidence, {CASH} AS metrics FROM {REPORT} WHERE n > 0
 UNION ALL SELECT import_id, tenant_id, 'expense', CASE WHEN total_out_abs > total_in THEN 'medium' ELSE 'low' END, 'Spent ' || {SAID.replace('{v}', 'total_out')}, total_out_abs, 'medium', largest_out,
 '{{"outflow_count":"' || n_out || '","total_outflow_abs":"' || total_out_abs || '","largest_outflow_amount":"' || largest_out_amount || '"}}' FROM {REPORT} WHERE n_out > 0
 UNION ALL SELECT import_id, tenant_id, 'revenue', 'medium', 'One inflow is ' || format('{{:.2f}}', {SHARE}::DOUBLE) || '% of all', {SHARE}, 'medium', largest_in, '{{"largest_inflow_amount":"' || largest_in_amount || '","share":"' || format('{{:.2f}}', {SHARE}::DOUBLE) || '"}}'
 FROM {REPORT} WHERE total_in > 0 AND {SHARE} >= 50)"""


@query("bd_13", f"SELECT * EXCLUDE (tenant_id) FROM {INSIGHTS}")
def bd_13(s, d):
    return insights.insights(report(s, d), "import_id")


@query(
    "bd_14",
    f"""SELECT tenant_id, count(*) AS n, count(*) FILTER (type = 'cashflow') AS n_cashflow, count(*) FILTER (type = 'expense') AS n_expense, count(*) FILTER (type = 'revenue') AS n_revenue, count(*) FILTER (severity = 'high') AS n_high,
        max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS top, count(DISTINCT evidence) AS n_evidence FROM {INSIGHTS} GROUP BY 1""",
)
def bd_14(s, d):
    """What a tenant's insights come to, by kind and severity."""
    rows = insights.insights(report(s, d).join(stm(s, d).select("import_id", "tenant_id"), "import_id"), "tenant_id")
    kind = lambda t: F.count_if(c("type") == t).alias(f"n_{t}")
    top = F.when(c("severity") == "high", 3).when(c("severity") == "medium", 2).when(c("severity") == "low", 1).otherwise(0)
    return rows.groupBy("tenant_id").agg(F.count("*").alias("n"), kind("cashflow"), kind("expense"), kind("revenue"), F.count_if(c("severity") == "high").alias("n_high"), F.max(top).alias("top"), F.count_distinct("evidence").alias("n_evidence"))


#: What each kind of payment is labelled as, its keyword, and where the label is wrong on purpose.
LABELS = [("CLOUD HOSTING", "software_subscription", "hosting"), ("OFFICE RENT", "rent_expense", "rent"), ("PAYROLL RUN", "payroll_expense", "payroll"), ("BANK FEE", "bank_fees", "bank fee"), ("GOOGLE ADS", "rent_expense", "billboard"), ("MISC", "uncategorized_expense", "misc")]
CHECKS = f"""SELECT transaction_id, check_name, passed FROM (SELECT transaction_id, unnest(['category', 'type', 'direction', 'confidence', 'keywords']) AS check_name,
 unnest([category = l.code, category_type = 'expense', category_type = 'expense', confidence IN ('medium', 'high'), contains(lower(description), l.word)]) AS passed
 FROM {LABELLED} t JOIN (VALUES {", ".join(map(str, LABELS))}) l(kind, code, word) ON t.counterparty = l.kind WHERE direction = 'outflow')"""


@query("ev_03", CHECKS)
def ev_03(s, d):
    """Five checks a label: code, type, direction, least confidence, and that every keyword stands in the text."""
    table = s.createDataFrame([(kind, code, [word]) for kind, code, word in LABELS], "counterparty string, code string, words array<string>")
    rows = labelled(s, d).where("direction = 'outflow'").join(F.broadcast(table), "counterparty")
    check = lambda name, test: F.struct(F.lit(name).alias("check_name"), F.coalesce(test, F.lit(False)).alias("passed"))
    words = F.forall("words", lambda w: F.lower("description").contains(w))
    found = [check("category", c("category") == c("code")), check("type", c("category_type") == "expense"), check("direction", S.category_direction(c("category_type")) == "expense"), check("confidence", S.at_least(c("confidence"), F.lit("medium"))), check("keywords", words)]
    return rows.select("transaction_id", F.inline(F.array(*found)))


@query(
    "ev_05",
    f"""SELECT import_id, type, grounded, metric_known, metric_equal FROM (SELECT import_id, type, CASE WHEN import_id % 10 = 0 AND type = 'expense' THEN false ELSE true END AS grounded,
        NOT (import_id % 11 = 0 AND type = 'expense') AS metric_known, NOT (import_id % 11 = 0 AND type = 'expense') AND NOT (import_id % 13 = 0 AND type = 'expense') AS metric_equal FROM {INSIGHTS} WHERE type IN ('expense', 'revenue'))""",
)
def ev_05(s, d):
    """Insights against their report: evidence is a row of the account, the metric's key is known, and its value is right to a cent.

    Some cite another row, name another key, or are off here.
    """
    r = report(s, d)
    off = lambda n: (c("import_id") % n == 0) & (c("type") == "expense")
    said = insights.insights(r, "import_id", "account_id").where("type <> 'cashflow'").select(
        "import_id", "account_id", "type", F.when(off(10), "none").otherwise(c("evidence")).alias("evidence"), F.when(off(11), "no_such_key").when(c("type") == "expense", "total_outflow_abs").otherwise("largest_inflow_amount").alias("key"),
        (F.coalesce(F.get_json_object("metrics", "$.total_outflow_abs"), F.get_json_object("metrics", "$.largest_inflow_amount")).cast("decimal(28,2)") + F.when(off(13), 1).otherwise(0)).alias("value"),
    )
    known = tx(s, d).select("account_id", c("transaction_id").alias("evidence"), F.lit(True).alias("known"))
    facts = r.select("import_id", F.explode(F.create_map(F.lit("total_outflow_abs"), c("total_out_abs").cast("decimal(28,2)"), F.lit("largest_inflow_amount"), c("largest_in_amount").cast("decimal(28,2)"))).alias("key", "fact"))
    j = said.join(known, ["account_id", "evidence"], "left").join(facts, ["import_id", "key"], "left")
    near = F.coalesce(F.abs(c("value") - c("fact")) <= F.lit("0.01").cast("decimal(4,2)"), F.lit(False))
    return j.select("import_id", "type", F.coalesce("known", F.lit(False)).alias("grounded"), c("fact").isNotNull().alias("metric_known"), near.alias("metric_equal"))


SEEN = f"(SELECT category AS e, CASE WHEN abs(amount) < 1000 THEN 'rent_expense' ELSE category END AS a FROM {LABELLED})"
RATIO = "round(CASE WHEN {a} > 0 THEN {b} / {a} ELSE 0 END, 4)"


@query(
    "ev_12",
    f"""WITH k AS (SELECT label, count(*) FILTER (e = label AND a = label) AS tp, count(*) FILTER (e <> label AND a = label) AS fp, count(*) FILTER (e = label AND a <> label) AS fn
        FROM (SELECT e, a, unnest(list_distinct([e, a])) AS label FROM {SEEN}) GROUP BY label),
        q AS (SELECT label, tp, fp, fn, {RATIO.format(a='(tp + fp)', b='tp')} AS precision, {RATIO.format(a='(tp + fn)', b='tp')} AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM k)
        SELECT * FROM q UNION ALL SELECT 'macro', NULL, NULL, NULL, round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4) FROM q
        UNION ALL SELECT 'micro', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, round(sum(tp) / sum(tp + fp), 4), round(sum(tp) / sum(tp + fn), 4), round(2 * sum(tp) / sum(2 * tp + fp + fn), 4) FROM q""".replace("WITH k", "SELECT * FROM (WITH k", 1) + ")",
)
def ev_12(s, d):
    """Precision, recall and F1 by category, their mean and of all rows together; small amounts are labelled wrongly here."""
    rows = labelled(s, d).select(c("category").alias("e"), F.when(F.abs("amount") < 1000, "rent_expense").otherwise(c("category")).alias("a"))
    q = scoring.class_quality(rows, "e", "a")
    none = F.lit(None).cast("bigint")
    macro = q.agg(F.lit("macro").alias("label"), *(F.max(none).alias(x) for x in ("tp", "fp", "fn")), *(F.round(F.avg(x), 4).alias(x) for x in ("precision", "recall", "f1")))
    ratio = lambda a, b: F.round(F.sum(a) / F.sum(b), 4)
    micro = q.agg(
        F.lit("micro").alias("label"), *(F.sum(x).alias(x) for x in ("tp", "fp", "fn")), ratio(c("tp"), c("tp") + c("fp")).alias("precision"), ratio(c("tp"), c("tp") + c("fn")).alias("recall"), ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1")
    )
    return q.unionByName(macro).unionByName(micro)


#: Statements whose balances are printed: the running sum of an account, every seventh row a cent or two off.
PRINTED = f"(SELECT account_id, transaction_id, amount, n, sum(amount) OVER (PARTITION BY account_id ORDER BY n) + CASE WHEN {K} % 7 = 0 THEN 0.02 ELSE 0.00 END AS balance FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY posted_at, transaction_id) AS n FROM transactions))"


QUALITY = f"""SELECT 'balance_consistency' AS metric, count(*) AS n, count(*) FILTER (abs(balance - before - amount) <= 0.01) AS n_good FROM (SELECT *, lag(balance) OVER (PARTITION BY account_id ORDER BY n) AS before FROM {PRINTED}) WHERE before IS NOT NULL
        UNION ALL SELECT 'duplicate_rate', count(*), count(*) - count(DISTINCT coalesce(text, '')) FROM documents
        UNION ALL SELECT 'candidate_recall', (SELECT count(*) FROM invoices), (SELECT count(*) FROM kept WHERE transaction_id = 'T' || invoice_id)
        UNION ALL SELECT 'auto_accept_precision', count(*), count(*) FILTER (transaction_id = 'T' || invoice_id) FROM ranked WHERE rn = 1 AND n_candidates = 1 AND score >= 85"""


def ev_12_quality(s, d):
    """Measures of a whole run: printed balances that follow from the row before, contents that came before, true matches among the candidates, and among those accepted without review."""
    t = ordered.numbered(tx(s, d).select("account_id", "transaction_id", "amount", "posted_at"), ["account_id"], ["posted_at", "transaction_id"])
    t = ordered.running(t, ["account_id"], "n", balance=c("amount")).withColumn("balance", c("balance") + F.when(number() % 7 == 0, F.lit("0.02")).otherwise(F.lit("0.00")).cast("decimal(4,2)"))
    t = ordered.before_it(t, ["account_id"], "n", before="balance").where("before IS NOT NULL")
    row = lambda name, n, good: [F.lit(name).alias("metric"), n.alias("n"), good.alias("n_good")]
    every, near = F.count("*"), F.abs(c("balance") - c("before") - c("amount")) <= F.lit("0.01").cast("decimal(4,2)")
    texts = V.table(s, d, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).agg(every.alias("k"))
    found = R.found(s, d)
    true = c("transaction_id") == F.concat(F.lit("T"), c("invoice_id").cast("string"))
    made = reconcile.proposals(reconcile.best(found)).where("status = 'proposed'")
    recall = inv(s, d).agg(every.alias("n")).crossJoin(found.where(true).agg(every.alias("n_good"))).select(F.lit("candidate_recall").alias("metric"), "n", "n_good")
    out = t.agg(*row("balance_consistency", every, F.count_if(near))).unionByName(texts.agg(*row("duplicate_rate", F.sum("k"), F.sum("k") - every)))
    return out.unionByName(recall).unionByName(made.agg(*row("auto_accept_precision", every, F.count_if(true))))


QUERIES["ev_12_quality"], ORACLES["ev_12_quality"] = ev_12_quality, R.scored(QUALITY)
