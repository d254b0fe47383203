"""Queries that join: imports, match states, enriched details, lineage, expected against actual; tasks and the policy's gate."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import reconcile, scoring
from tallyforge.plans import registry as R
from tallyforge.plans.catalog import ORACLES, QUERIES, query
from tallyforge.plans.decisions import scored
from tallyforge.plans.ledger import LABELLED, labelled
from tallyforge.sources import views as V

c, inv, tx, lines, steps, stm, k = F.col, V.invoices, V.transactions, V.invoice_lines, V.steps, V.statements, "invoice_id"


def ranked(s, d):
    return reconcile.best(R.found(s, d))


# pairs of one import: an account has two imports, and its invoices meet both
BAND = "abs(t.amount) BETWEEN i.total - greatest(i.total / 100, 1) - 1 AND i.total + greatest(i.total / 100, 1) + 1"


def jn_02(s, d):
    """Any pair of an invoice and a transaction of an import of its account that scores."""
    i = inv(s, d).withColumn("import_id", F.explode(F.array(c("customer_id") * 2, c("customer_id") * 2 + 1)))
    t = V.booked(s, d).withColumn("import_id", c("account_id") * 2 + c("row_index") % 2)
    return reconcile.scored_pairs(i, t, "import_id")


QUERIES["jn_02"] = jn_02
ORACLES["jn_02"] = R.scored("SELECT * FROM kept").replace(BAND, "i.customer_id = t.account_id").replace("score >= 70", "score >= 1").replace("diff <= greatest(total / 20, 5)", "diff * 20 <= greatest(total, 100)")


#: Pairs of a whole tenant: by amount and reference where a date alone can't reach the score.
query("jn_02_tenant", None)(lambda s, d: reconcile.blocked_pairs(inv(s, d), V.booked(s, d), 36))
ORACLES["jn_02_tenant"] = R.scored("SELECT * FROM kept").replace(f" AND {BAND}", "").replace("score >= 70", "score >= 36").replace("diff <= greatest(total / 20, 5)", "diff * 20 <= greatest(total, 100)")


def jn_02_blocked(s, d):
    """jn_02 by the indexes: the same rows."""
    i = inv(s, d).withColumn("import_id", F.explode(F.array(c("customer_id") * 2, c("customer_id") * 2 + 1)))
    t = V.booked(s, d).withColumn("import_id", c("account_id") * 2 + c("row_index") % 2)
    return reconcile.blocked_pairs(i, t, 1, ("import_id",))


QUERIES["jn_02_blocked"], ORACLES["jn_02_blocked"] = jn_02_blocked, ORACLES["jn_02"]


@query(
    "jn_03_pairs",
    """WITH near AS (SELECT i.tenant_id, invoice_id, transaction_id FROM invoices i JOIN transactions t ON i.tenant_id = t.tenant_id AND t.amount BETWEEN total * 0.9 AND total * 1.1),
       recent AS (SELECT tenant_id, transaction_id FROM transactions QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY posted_at DESC NULLS LAST, transaction_id) <= 100)
       SELECT *, 'window' AS origin FROM near UNION ALL SELECT tenant_id, invoice_id, transaction_id, 'recent' FROM invoices JOIN recent USING (tenant_id) WHERE invoice_id NOT IN (SELECT invoice_id FROM near)""".replace("WITH near", "SELECT * FROM (WITH near", 1) + ")",
)
def jn_03_pairs(s, d):
    """The candidates themselves: within a tenth of the total, else the tenant's 100 latest."""
    return reconcile.candidate_pairs(inv(s, d), tx(s, d))


@query(
    "jn_03",
    """SELECT invoice_id, coalesce(w.n, least(100, t.n)) AS n_candidates, CASE WHEN w.n IS NULL THEN 'recent' ELSE 'window' END AS origin FROM invoices i
       LEFT JOIN (SELECT invoice_id, count(*) AS n FROM invoices i JOIN transactions t ON i.tenant_id = t.tenant_id AND t.amount BETWEEN total * 0.9 AND total * 1.1 GROUP BY 1) w USING (invoice_id)
       LEFT JOIN (SELECT tenant_id, count(*) AS n FROM transactions GROUP BY 1) t USING (tenant_id)""",
)
def jn_03(s, d):
    """How many transactions lie within a tenth of the total; an invoice without any gets the tenant's 100 latest, of which only the number counts here."""
    i, t = inv(s, d), tx(s, d)
    sizes = t.groupBy("tenant_id").agg(F.count("*").alias("all"))
    j = i.select("tenant_id", k).join(reconcile.count_near(i, t), k, "left").join(sizes, "tenant_id", "left")
    return j.select(k, F.coalesce("n", F.least(F.lit(100), "all")).alias("n_candidates"), F.when(c("n").isNull(), "recent").otherwise("window").alias("origin"))


STATUS = "CASE WHEN invoice_id % 5 = 0 THEN 'rejected' WHEN n_candidates > 1 OR score < 85 THEN 'pending_review' ELSE 'proposed' END"


@scored(
    "jn_04",
    f"""SELECT transaction_id, CASE WHEN bool_or(s = 'proposed') THEN 'matched' WHEN bool_or(s = 'pending_review') THEN 'review' ELSE 'unmatched' END AS state, count(s) FILTER (s <> 'rejected') AS n_allocations
        FROM transactions LEFT JOIN (SELECT transaction_id, {STATUS} AS s FROM ranked WHERE rn = 1) USING (transaction_id) GROUP BY 1""",
)
def jn_04(s, d):
    """A transaction's state by its allocations' reconciliations; rejected ones (every fifth here) don't count."""
    a = reconcile.allocations(ranked(s, d)).select("transaction_id", F.when(c(k) % 5 == 0, "rejected").otherwise(c("status")).alias("s"))
    has = lambda x: F.max(F.coalesce(c("s") == x, F.lit(False)))
    g = tx(s, d).select("transaction_id").join(a, "transaction_id", "left").groupBy("transaction_id").agg(has("proposed").alias("p"), has("pending_review").alias("r"), F.count_if(c("s") != "rejected").alias("n_allocations"))
    return g.select("transaction_id", F.when(c("p"), "matched").when(c("r"), "review").otherwise("unmatched").alias("state"), "n_allocations")


@scored(
    "jn_06",
    """SELECT t.transaction_id, any_value(s.bank_name) AS bank_name, any_value(s.account_number) AS account_number, any_value(s.period_start) AS period_start, count(kept.invoice_id) AS n_matches, max(score) AS best,
       coalesce(string_agg(kept.invoice_id || '=' || score, ',' ORDER BY score DESC, kept.invoice_id), '') AS matches
       FROM transactions t LEFT JOIN statements s ON t.account_id = s.account_id LEFT JOIN kept USING (transaction_id) GROUP BY 1""",
)
def jn_06(s, d):
    """Transactions with their account, statement and matches, the best first; a transaction's matches lie in one band of amounts and its references."""
    one = F.struct((-c("score")).alias("o"), c(k).alias("i"))
    m = R.found(s, d).groupBy("transaction_id").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.array_sort(F.collect_list(one)).alias("x"))
    text = F.array_join(F.transform("x", lambda x: F.concat_ws("=", x["i"].cast("string"), (-x["o"]).cast("string"))), ",")
    j = tx(s, d).select("transaction_id", "account_id").join(stm(s, d).select("account_id", "bank_name", "account_number", "period_start"), "account_id", "left").join(m, "transaction_id", "left")
    return j.select("transaction_id", "bank_name", "account_number", "period_start", F.coalesce("n", F.lit(0)).alias("n_matches"), "best", F.coalesce(text, F.lit("")).alias("matches"))


@scored(
    "jn_07",
    """SELECT i.invoice_id, i.total, n_lines, line_net, CASE WHEN n_candidates > 1 OR score < 85 THEN 'pending_review' WHEN score IS NOT NULL THEN 'proposed' END AS proposal, least(abs(r.amount), r.total) AS allocated, i.total - coalesce(least(abs(r.amount), r.total), 0) AS open
       FROM invoices i LEFT JOIN (SELECT invoice_id, count(*) AS n_lines, sum(net) AS line_net FROM lines GROUP BY 1) USING (invoice_id) LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r ON r.invoice_id = i.invoice_id""",
)
def jn_07(s, d):
    """Invoices with their lines, proposal and allocation; children are summed before they join, so no row fans out."""
    sums = lines(s, d).groupBy(k).agg(F.count("*").alias("n_lines"), F.sum("net").alias("line_net"))
    a = reconcile.allocations(ranked(s, d)).select(k, c("status").alias("proposal"), "allocated")
    j = inv(s, d).join(sums, k, "left").join(a, k, "left")
    return j.select(k, "total", "n_lines", "line_net", "proposal", "allocated", (c("total") - F.coalesce("allocated", F.lit(0))).alias("open"))


@query(
    "jn_09",
    """WITH d AS (SELECT doc_id, max_run AS run FROM documents JOIN (SELECT user_id AS doc_id, max(ts::DATE) AS max_run FROM steps GROUP BY 1) USING (doc_id)),
       e AS (SELECT d.doc_id, run, event_id, agent, ts, coalesce(CASE WHEN event_id % 3 <> 0 THEN ms END, ms + 1) AS latency, row_number() OVER (PARTITION BY d.doc_id ORDER BY ts, event_id) - 1 AS step FROM d JOIN steps s ON s.user_id = d.doc_id AND ts::DATE = run)
       SELECT doc_id, run, event_id, step, agent, latency, coalesce(n_handoffs, 0) AS n_handoffs, coalesce(n_audits, 0) AS n_audits FROM e LEFT JOIN (SELECT doc_id, count(*) FILTER (agent = 'click') AS n_handoffs, count(*) FILTER (agent = 'purchase') AS n_audits FROM e GROUP BY 1) USING (doc_id)""".replace("WITH d AS", "SELECT * FROM (WITH d AS", 1) + ")",
)
def jn_09(s, d):
    """A document's latest run (its last day of events): each step with its place and latency (measured, else derived), and how many hand-offs and audits the run has."""
    e = steps(s, d).withColumn("run", F.to_date("ts"))
    last = e.groupBy(c("user_id").alias("doc_id")).agg(F.max("run").alias("run"))
    own = V.table(s, d, "documents").select("doc_id").join(last, "doc_id")
    rows = own.join(e.withColumnRenamed("user_id", "doc_id"), ["doc_id", "run"])
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ts", "event_id")) - 1
    counts = rows.groupBy("doc_id").agg(F.count_if(c("agent") == "click").alias("n_handoffs"), F.count_if(c("agent") == "purchase").alias("n_audits"))
    measured = F.when(c("event_id") % 3 != 0, c("ms"))
    return rows.withColumn("step", place).join(counts, "doc_id").select("doc_id", "run", "event_id", "step", "agent", F.coalesce(measured, c("ms") + 1).alias("latency"), "n_handoffs", "n_audits")


AUDITS = "(SELECT event_id, ['document', 'run', 'invoice'][event_id % 3 + 1] AS kind, event_id // 3 AS resource_id, action FROM (SELECT event_id, CASE WHEN agent IN ('purchase', 'click', 'signup') THEN 'review_task.' ELSE 'review_tasks_' END || agent AS action FROM steps) WHERE action LIKE 'review\\_task.%' ESCAPE '\\')"


@query(
    "jn_10",
    f"""SELECT DISTINCT doc_id, event_id, action FROM documents d JOIN {AUDITS} a ON (kind = 'document' AND resource_id = doc_id) OR (kind = 'run' AND resource_id IN (SELECT event_id FROM steps WHERE user_id = d.doc_id)) OR (kind = 'invoice' AND resource_id IN (SELECT invoice_id FROM invoices WHERE customer_id = d.doc_id))""",
)
def jn_10(s, d):
    """Audit events on a document, on one of its runs or on an invoice made from it: three equi-joins instead of one on alternatives."""
    docs = V.table(s, d, "documents").select("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("document", "run", "invoice"))), (c("event_id") % 3 + 1).cast("int"))
    # every agent's events are logged; those of review tasks carry their prefix, which is taken by letter
    action = F.concat(F.when(c("agent").isin("purchase", "click", "signup"), "review_task.").otherwise("review_tasks_"), "agent")
    a = steps(s, d).select("event_id", action.alias("action"), kind.alias("kind"), F.floor(c("event_id") / 3).alias("resource_id")).where(c("action").startswith("review_task."))
    of = lambda name: a.where(c("kind") == name).drop("kind")
    runs = steps(s, d).select(c("user_id").alias("doc_id"), c("event_id").alias("resource_id"))
    made = inv(s, d).select(c("customer_id").alias("doc_id"), c(k).alias("resource_id"))
    found = [docs.withColumn("resource_id", c("doc_id")).join(of("document"), "resource_id")] + [docs.join(x, "doc_id").join(of(n), "resource_id") for n, x in (("run", runs), ("invoice", made))]
    out = [f.select("doc_id", "event_id", "action") for f in found]
    return out[0].unionByName(out[1]).unionByName(out[2]).distinct()


@query(
    "jn_12",
    """SELECT 'line' AS kind, invoice_id || ':' || n AS key, CASE WHEN net IS NULL THEN 'missing' ELSE 'present' END AS state FROM (SELECT invoice_id, unnest([1, 2]) AS n FROM invoices) LEFT JOIN (SELECT invoice_id, line_number AS n, max(net) AS net FROM lines GROUP BY 1, 2) USING (invoice_id, n)
       UNION ALL SELECT 'reference', number, CASE WHEN EXISTS (SELECT 1 FROM transactions t WHERE t.reference = i.number) THEN 'present' ELSE 'missing' END FROM invoices i
       UNION ALL SELECT 'source_ref', 'transaction:T' || invoice_id, 'present' FROM invoices
       UNION ALL SELECT 'review', 'extraction:' || invoice_id, CASE WHEN status = 'pending_review' THEN 'present' ELSE 'missing' END FROM invoices""",
)
def jn_12(s, d):
    """Expected rows against actual ones by four kinds of keys; actual rows that repeat a key count once."""
    i = inv(s, d)
    key = lambda name, col: (F.lit(name).alias("kind"), col.alias("key"))
    text = lambda *x: F.concat_ws(":", *(c(y).cast("string") if isinstance(y, str) else y for y in x))
    lined = i.select(k, F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    expected = lined.select(*key("line", text(k, "n"))).unionByName(i.select(*key("reference", c("number"))))
    expected = expected.unionByName(i.select(*key("source_ref", F.concat(F.lit("transaction:T"), c(k).cast("string"))))).unionByName(i.select(*key("review", text(F.lit("extraction"), k))))
    t = tx(s, d)
    actual = lines(s, d).select(*key("line", text(k, "line_number"))).unionByName(t.where("reference is not null").select(*key("reference", c("reference"))))
    actual = actual.unionByName(t.select(*key("source_ref", F.concat(F.lit("transaction:"), "transaction_id")))).unionByName(i.where("status = 'pending_review'").select(*key("review", text(F.lit("extraction"), k))))
    seen = actual.distinct().withColumn("seen", F.lit(True))
    return expected.join(seen, ["kind", "key"], "left").select("kind", "key", F.when(c("seen"), "present").otherwise("missing").alias("state"))


OVER = """SELECT kind, id, allocated, available FROM (SELECT 'transaction' AS kind, transaction_id AS id, sum(a) AS allocated, any_value(abs(amount)) AS available FROM (SELECT *, least(abs(amount), total) AS a FROM ranked WHERE rn = 1) GROUP BY 2
 UNION ALL SELECT 'invoice', invoice_id::VARCHAR, sum(a), any_value(total) FROM (SELECT *, least(abs(amount), total) AS a FROM kept) GROUP BY 2) WHERE allocated > available + 0.01"""


@scored("vl_09", OVER)
def vl_09(s, d):
    """Transactions allocated beyond their amount by the best matches, and invoices beyond their total if every candidate were allocated."""
    best = reconcile.over_allocated(reconcile.allocations(ranked(s, d))).where("kind = 'transaction'")
    every = R.found(s, d).withColumn("allocated", F.least(F.abs("amount"), "total"))
    return best.unionByName(reconcile.over_allocated(every).where("kind = 'invoice'"))


# inputs, tasks, policy
@query(
    "bd_02",
    """SELECT 'invoice' AS target_type, invoice_id::VARCHAR AS id, customer || coalesce(' ' || p, '') AS text, currency, 'inflow' AS direction, total AS amount, (total::DECIMAL(30,4) * 0.1)::DECIMAL(18,2) AS tax FROM invoices LEFT JOIN (SELECT invoice_id, string_agg('Part ' || part_id, ' ' ORDER BY line_number, part_id) AS p FROM lines GROUP BY 1) USING (invoice_id)
       UNION ALL SELECT 'transaction', transaction_id, concat_ws(' ', description, lower(description), counterparty, reference), currency, direction, abs(amount), NULL FROM transactions""",
)
def bd_02(s, d):
    """What classifiers get: of invoices the customer and the lines' descriptions, of transactions all descriptors; an invoice's lines are few."""
    parts = lines(s, d).groupBy(k).agg(F.array_sort(F.collect_list(F.struct("line_number", "part_id"))).alias("p"))
    words = F.array_join(F.transform("p", lambda x: F.concat(F.lit("Part "), x["part_id"].cast("string"))), " ")
    a = inv(s, d).join(parts, k, "left").select(F.lit("invoice").alias("target_type"), c(k).cast("string").alias("id"), S.descriptor(c("customer"), words).alias("text"), "currency", F.lit("inflow").alias("direction"), c("total").alias("amount"), (c("total") / 10).cast("decimal(18,2)").alias("tax"))
    text = S.descriptor(c("description"), S.normal_reference(c("description")), c("counterparty"), c("reference"))
    return a.unionByName(tx(s, d).select(F.lit("transaction").alias("target_type"), c("transaction_id").alias("id"), text.alias("text"), "currency", "direction", F.abs("amount").alias("amount"), F.lit(None).cast("decimal(18,2)").alias("tax")))


@scored(
    "bd_08",
    f"""SELECT 'invoice_extraction' AS task_type, invoice_id::VARCHAR AS target, 'high' AS priority FROM invoices WHERE status = 'pending_review' UNION ALL SELECT 'failed_run', event_id::VARCHAR, 'high' FROM steps WHERE failed
        UNION ALL SELECT 'reconciliation', invoice_id || ':' || transaction_id, 'normal' FROM ranked WHERE rn = 1 AND (n_candidates > 1 OR score < 85)
        UNION ALL SELECT 'classification', transaction_id, 'normal' FROM {LABELLED} WHERE confidence IN ('low', 'unknown')""",
)
def bd_08(s, d):
    """Review tasks of four kinds."""
    task = lambda rows, kind, target, priority: rows.select(F.lit(kind).alias("task_type"), target.alias("target"), F.lit(priority).alias("priority"))
    a = task(inv(s, d).where("status = 'pending_review'"), "invoice_extraction", c(k).cast("string"), "high")
    b = task(steps(s, d).where("failed"), "failed_run", c("event_id").cast("string"), "high")
    p = task(reconcile.proposals(ranked(s, d)).where("status = 'pending_review'"), "reconciliation", F.concat_ws(":", c(k).cast("string"), "transaction_id"), "normal")
    return a.unionByName(b).unionByName(p).unionByName(task(labelled(s, d).where(c("confidence").isin("low", "unknown")), "classification", c("transaction_id"), "normal"))


SURE = "n_candidates = 1 AND score >= 85 AND abs(abs(amount) - total) <= 0.01"


@scored(
    "bd_16",
    f"""SELECT area, count(*) AS n, count(*) FILTER (NOT sure) AS n_review, round(count(*) FILTER (sure <> task) / count(*), 4) AS agreement FROM (SELECT 'reconciliation' AS area, {SURE} AS sure, n_candidates > 1 OR score < 85 AS task FROM ranked WHERE rn = 1
        UNION ALL SELECT 'extraction', status <> 'pending_review' AND total > 0, status = 'pending_review' FROM invoices UNION ALL SELECT 'classification', confidence IN ('high', 'medium'), confidence IN ('low', 'unknown') FROM {LABELLED}) GROUP BY 1""",
)
def bd_16(s, d):
    """The review policy by area: what may go on, and how often a task was made exactly where the policy wants one."""
    exact = F.abs(F.abs("amount") - c("total")) <= F.lit("0.01").cast("decimal(4,2)")
    r = ranked(s, d).select(F.lit("reconciliation").alias("area"), ((c("n_candidates") == 1) & (c("score") >= 85) & exact).alias("sure"), ((c("n_candidates") > 1) | (c("score") < 85)).alias("task"))
    i = inv(s, d).select(F.lit("extraction").alias("area"), ((c("status") != "pending_review") & (c("total") > 0)).alias("sure"), (c("status") == "pending_review").alias("task"))
    t = labelled(s, d).select(F.lit("classification").alias("area"), S.at_least(c("confidence"), F.lit("medium")).alias("sure"), c("confidence").isin("low", "unknown").alias("task"))
    return r.unionByName(i).unionByName(t).groupBy("area").agg(F.count("*").alias("n"), F.count_if(~c("sure")).alias("n_review"), F.round(F.count_if(c("sure") != c("task")) / F.count("*"), 4).alias("agreement"))


# evaluation
TEXTS = ["invoice_number", "supplier_name", "customer_name", "issue_date", "due_date", "currency", "supplier_tax_id", "customer_tax_id"]
LINE = ["description", "quantity", "unit_price", "tax_amount", "line_total"]
EV_01 = f"""SELECT invoice_id, check_name, passed FROM (SELECT invoice_id, unnest({[*TEXTS, 'subtotal', 'tax', 'total', 'totals_currency', 'line_count']}) AS check_name, unnest([true, true, invoice_id % 4 <> 0, true, invoice_id % 3 <> 0, true, true, true, true, true, invoice_id % 5 <> 0, true, NOT (invoice_id % 6 = 0 AND invoice_id IN (SELECT invoice_id FROM lines WHERE line_number = 1))]) AS passed FROM invoices)
 UNION ALL SELECT invoice_id, 'line.' || c, CASE WHEN invoice_id % 6 = 0 AND line_number = 1 THEN false WHEN c = 'quantity' THEN part_id % 2 = 0 WHEN c = 'line_total' THEN part_id % 7 <> 0 ELSE true END FROM (SELECT invoice_id, line_number, max(part_id) AS part_id FROM lines GROUP BY 1, 2), (VALUES {', '.join(f"('{x}')" for x in LINE)}) v(c)"""


@query("ev_01", EV_01)
def ev_01(s, d):
    """Extractions against labels: eight texts, four totals, the number of lines and five checks a line; some names, dates, totals, quantities
    (by a little more and a little less than their tolerance) and lines are off."""
    i, miss = inv(s, d), lambda n: c(k) % n == 0
    none, money = F.lit(None).cast("string"), lambda x: x.cast("decimal(18,2)")
    sums = {"subtotal": c("total"), "tax": F.lit(None).cast("decimal(18,2)"), "total": c("total")}
    head = i.select(k, c("number").alias("invoice_number"), none.alias("supplier_name"), c("customer").alias("customer_name"), c("issue_date").cast("string").alias("issue_date"), c("due_date").cast("string").alias("due_date"), "currency", none.alias("supplier_tax_id"), none.alias("customer_tax_id"), *(v.alias(n) for n, v in sums.items()), c("currency").alias("totals_currency"))
    seen = head.withColumns({"invoice_number": F.concat(F.lit(" "), "invoice_number"), "customer_name": F.when(miss(4), "?").otherwise(c("customer_name")), "due_date": F.when(~miss(3), c("due_date")), "total": money(c("total") + F.when(miss(5), F.lit("0.02")).otherwise(F.lit("0.01")).cast("decimal(18,2)"))})
    line = lines(s, d).groupBy(k, "line_number").agg(F.max("part_id").alias("part_id")).select(k, "line_number", F.concat(F.lit("Part "), c("part_id").cast("string")).alias("description"), c("part_id").cast("decimal(18,4)").alias("quantity"), money(c("part_id")).alias("unit_price"), money(F.lit(None)).alias("tax_amount"), money(c("part_id")).alias("line_total"))
    part = c("unit_price").cast("bigint")
    small = F.when(part % 2 == 0, F.lit("0.0001")).otherwise(F.lit("0.0002")).cast("decimal(18,4)")
    got = line.where(~(miss(6) & (c("line_number") == 1))).withColumns({"quantity": (c("quantity") + small).cast("decimal(18,4)"), "line_total": money(c("line_total") + F.when(part % 7 == 0, 1).otherwise(0))})
    count = lambda rows: rows.groupBy(k).agg(F.count("*").alias("line_count"))
    tests = dict.fromkeys(TEXTS, scoring.text) | dict.fromkeys(["subtotal", "tax", "total"], scoring.near) | {"totals_currency": scoring.text, "line_count": scoring.exact}
    by_line = {"description": scoring.text, "quantity": lambda e, a: scoring.near(e, a, "0.0001"), "unit_price": scoring.near, "tax_amount": scoring.near, "line_total": scoring.near}
    zero = lambda rows: rows.withColumn("line_count", F.coalesce("line_count", F.lit(0)))
    first = scoring.checks(zero(head.join(count(line), k, "left")), zero(seen.join(count(got), k, "left")), [k], k, "extraction", tests).where("check_name <> 'present'")
    # a label without lines has none to miss
    first = first.withColumnRenamed("case_id", k).drop("scorer")
    rest = scoring.checks(line, got, [k, "line_number"], k, "extraction", by_line).where("check_name <> 'present'").select(c("case_id").alias(k), F.concat(F.lit("line."), "check_name").alias("check_name"), "passed")
    return first.unionByName(rest)


ROWS = ["posted_at", "value_at", "direction", "amount", "currency", "reference", "running_balance"]


@query(
    "ev_02",
    f"""SELECT account_id, 'row_count' AS check_name, bool_and(status = 'posted') AS passed, count(*) FILTER (status = 'posted') AS n FROM transactions GROUP BY 1
        UNION ALL SELECT account_id, c, bool_and(status = 'posted' AND (c <> 'amount' OR k % 7 <> 0) AND (c <> 'running_balance' OR k % 35 <> 3)), count(*) FILTER (status = 'posted' AND (c <> 'amount' OR k % 7 <> 0) AND (c <> 'running_balance' OR k % 35 <> 3))
        FROM (SELECT * EXCLUDE (k), {"substr(transaction_id, 2)::BIGINT"} AS k FROM transactions), (VALUES {', '.join(f"('{x}')" for x in ROWS)}) v(c) GROUP BY 1, 2""",
)
def ev_02(s, d):
    """Parsed statements against labels: the number of rows, and seven checks a row (the description isn't compared), by account; pending rows
    are missing, every seventh amount and some balances are off."""
    t = tx(s, d)
    n = F.substr("transaction_id", F.lit(2)).cast("bigint")
    off = lambda col, test: F.when(test, c(col) + F.lit("0.02").cast("decimal(18,2)")).otherwise(c(col)).cast("decimal(18,2)")
    actual = t.where("status = 'posted'").withColumns({"amount": off("amount", n % 7 == 0), "running_balance": off("running_balance", n % 35 == 3)})
    tests = {"posted_at": scoring.exact, "value_at": scoring.exact, "direction": scoring.text, "amount": scoring.near, "currency": scoring.exact, "reference": scoring.exact, "running_balance": scoring.near}
    found = scoring.checks(t, actual, ["transaction_id"], "account_id", "statement", tests).withColumn("check_name", F.when(c("check_name") == "present", "row_count").otherwise(c("check_name")))
    return found.groupBy(c("case_id").alias("account_id"), "check_name").agg(F.min("passed").alias("passed"), F.count_if("passed").alias("n"))


MATCH = "FROM invoices i LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r ON r.invoice_id = i.invoice_id"


@scored(
    "ev_04",
    f"""SELECT check_name, count(*) AS n, count(*) FILTER (passed) AS n_passed FROM (SELECT unnest(['found', 'transaction', 'amount', 'currency', 'score', 'confidence']) AS check_name, unnest([r.invoice_id IS NOT NULL, coalesce(r.transaction_id = 'T' || i.invoice_id, false), coalesce(abs(abs(r.amount) - i.total) <= 0.01, false), coalesce(r.invoice_id IS NOT NULL, false),
        coalesce(r.score >= 85, false), coalesce(r.score >= 85, false)]) AS passed {MATCH} UNION ALL SELECT 'unmatched', transaction_id NOT IN (SELECT transaction_id FROM ranked WHERE rn = 1) FROM transactions WHERE direction = 'outflow') GROUP BY 1""",
)
def ev_04(s, d):
    """Expected matches: found, the right transaction, amount, currency, least score, least confidence; and outflows that should have no match."""
    got = ranked(s, d)
    want = inv(s, d).select(k, c("total").alias("want_total"), F.concat(F.lit("T"), c(k).cast("string")).alias("want"))
    j = want.join(got.select(k, "transaction_id", "amount", "score"), k, "left")
    yes = lambda x: F.coalesce(x, F.lit(False))
    there = c("transaction_id").isNotNull()
    tests = {
        "found": there, "transaction": c("transaction_id") == c("want"), "amount": F.abs(F.abs("amount") - c("want_total")) <= F.lit("0.01").cast("decimal(4,2)"), "currency": there & (c("score") > 0), "score": c("score") >= 85,
        "confidence": S.at_least(S.score_confidence(c("score")), F.lit("high")),
    }
    rows = j.select(F.explode(F.create_map(*(x for n, t in tests.items() for x in (F.lit(n), yes(t))))).alias("check_name", "passed"))
    used = got.select("transaction_id", F.lit(True).alias("used")).distinct()
    free = tx(s, d).where("direction = 'outflow'").join(used, "transaction_id", "left").select(F.lit("unmatched").alias("check_name"), c("used").isNull().alias("passed"))
    return rows.unionByName(free).groupBy("check_name").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"))


@query(
    "ev_06",
    """SELECT tenant_id, (n_e > 0) = (n_a > 0) AS should_create, n_e = n_a AS count_equal, missing, unexpected, priority_wrong FROM (SELECT tenant_id, count(*) FILTER (e) AS n_e, count(*) FILTER (a) AS n_a, count(*) FILTER (e AND NOT a) AS missing, count(*) FILTER (a AND NOT e) AS unexpected,
       count(*) FILTER (e AND a AND invoice_id % 4 = 0) AS priority_wrong FROM (SELECT *, status = 'pending_review' AND tenant_id % 7 <> 0 AS e, (status = 'pending_review' AND invoice_id % 10 <> 0) OR (status = 'extracted' AND invoice_id % 10 = 0) AS a FROM invoices) WHERE e OR a GROUP BY 1)""",
)
def ev_06(s, d):
    """Tasks that should be against those that are, by tenant: whether any, how many, which are missing or not expected, and priorities."""
    i = inv(s, d)
    expected = i.where("status = 'pending_review' AND tenant_id % 7 <> 0").select("tenant_id", k, F.lit("high").alias("want"))
    actual = i.where("(status = 'pending_review' AND invoice_id % 10 <> 0) OR (status = 'extracted' AND invoice_id % 10 = 0)").select("tenant_id", k, F.when(c(k) % 4 == 0, "normal").otherwise("high").alias("got"))
    e, a = c("want").isNotNull(), c("got").isNotNull()
    g = expected.join(actual, ["tenant_id", k], "full_outer").groupBy("tenant_id").agg(F.count("want").alias("n_e"), F.count("got").alias("n_a"), F.count_if(e & ~a).alias("missing"), F.count_if(a & ~e).alias("unexpected"), F.count_if(c("want") != c("got")).alias("priority_wrong"))
    return g.select("tenant_id", ((c("n_e") > 0) == (c("n_a") > 0)).alias("should_create"), (c("n_e") == c("n_a")).alias("count_equal"), "missing", "unexpected", "priority_wrong")


@query(
    "ev_10",
    f"""SELECT check_name, count(*) FILTER (invoice_id % 11 <> 0) AS n_scored, count(*) FILTER (invoice_id % 11 = 0) AS n_errors, round(count(*) FILTER (passed AND invoice_id % 11 <> 0) / count(*) FILTER (invoice_id % 11 <> 0), 4) AS accuracy,
        round(count(*) FILTER (invoice_id % 3 = 0) / count(*), 4) AS model_rate, count(*) FILTER (invoice_id % 3 <> 0) AS n_deterministic FROM (SELECT invoice_id, coalesce(check_name, 'overall') AS check_name, passed FROM ({EV_01} UNION ALL SELECT invoice_id, 'overall', passed FROM ({EV_01}))) GROUP BY 1""",
)
def ev_10(s, d):
    """A batch report: by check and over all, how many were scored or failed to run, accuracy, and how many needed a model (every third here)."""
    rows = ev_01(s, d)
    both = rows.select(k, F.explode(F.array("check_name", F.lit("overall"))).alias("check_name"), "passed")
    ran = c(k) % 11 != 0
    return both.groupBy("check_name").agg(
        F.count_if(ran).alias("n_scored"), F.count_if(~ran).alias("n_errors"), F.round(F.count_if(c("passed") & ran) / F.count_if(ran), 4).alias("accuracy"), F.round(F.count_if(c(k) % 3 == 0) / F.count("*"), 4).alias("model_rate"),
        F.count_if(c(k) % 3 != 0).alias("n_deterministic"),
    )
