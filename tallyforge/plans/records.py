"""Queries on stored records: allocations of any status, invoices with all that hangs on them, items with copied totals, references and states in payloads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import documents, reconcile, review
from tallyforge.plans import registry as R
from tallyforge.plans.catalog import query
from tallyforge.plans.checks import FIELDS, OLD, versions
from tallyforge.plans.decisions import scored
from tallyforge.sources import views as V

c, inv, lines, k = F.col, V.invoices, V.invoice_lines, "invoice_id"


@scored(
    "jn_05_stored",
    """SELECT invoice_id, transaction_id, score FROM kept WHERE NOT EXISTS (SELECT 1 FROM (SELECT substr(transaction_id, 2)::BIGINT AS i, transaction_id AS t FROM transactions WHERE direction = 'inflow' AND row_index % 3 = 0) WHERE i = kept.invoice_id AND t = kept.transaction_id)""",
)
def jn_05_stored(s, d):
    """Candidates without an allocation of any status: those of some inflows to the invoice that they pay are stored as active, reversed or rejected."""
    paid = V.transactions(s, d).where((c("direction") == "inflow") & (c("row_index") % 3 == 0))
    status = F.element_at(F.array(*map(F.lit, ("active", "reversed", "rejected"))), (c("row_index") % 9 / 3 + 1).cast("int"))
    stored = paid.select(F.substr("transaction_id", F.lit(2)).cast("bigint").alias(k), "transaction_id", status.alias("status"))
    return reconcile.unallocated(R.found(s, d), stored).select(k, "transaction_id", "score")


CREATED = "issue_date + CASE WHEN invoice_id % 9 = 0 THEN 0 ELSE version END"


@scored(
    "jn_07_detail",
    f"""SELECT invoice_id, i.total, n_lines, line_net, proposals, allocations FROM invoices i LEFT JOIN (SELECT invoice_id, count(*) AS n_lines, sum(net) AS line_net FROM lines GROUP BY 1) USING (invoice_id)
        LEFT JOIN (SELECT invoice_id, string_agg(version || ':' || o.status, ',' ORDER BY {CREATED} DESC, version DESC) AS proposals FROM {OLD} o JOIN (SELECT invoice_id, issue_date FROM invoices) USING (invoice_id) GROUP BY 1) USING (invoice_id)
        LEFT JOIN (SELECT invoice_id, string_agg(transaction_id || ':' || least(abs(amount), total)::DECIMAL(18,2) || ':' || score, ',' ORDER BY score DESC, transaction_id) AS allocations FROM kept GROUP BY 1) USING (invoice_id)""",
)
def jn_07_detail(s, d):
    """Invoices with their lines, all proposals from the newest, and all allocations from the best."""
    made = versions(s, d)[0].select(k, "version", "status").join(inv(s, d).select(k, "issue_date"), k)
    created = F.date_add("issue_date", F.when(c(k) % 9 == 0, 0).otherwise(c("version")))
    allocated = R.found(s, d).select(k, "transaction_id", F.least(F.abs("amount"), c("total")).cast("decimal(18,2)").alias("allocated"), "score")
    rows = reconcile.invoice_details(inv(s, d).select(k, "total"), lines(s, d), made.select(k, "version", "status", created.alias("created")), allocated)
    shown = lambda name, *fields: F.array_join(F.transform(name, lambda x: F.concat_ws(":", *(x[f].cast("string") for f in fields))), ",").alias(name)
    return rows.select(k, "total", "n_lines", "line_net", shown("proposals", "version", "status"), shown("allocations", "transaction_id", "allocated", "score"))


ORDERED = "invoice_id ORDER BY line_number, part_id, quantity, net"


@query(
    "wn_12_lines",
    f"""WITH x AS (SELECT invoice_id, line_number, part_id, quantity, part_id % 3 = 0 AS bare, row_number() OVER (PARTITION BY {ORDERED}) AS n, (quantity * (1 + part_id % 50))::DECIMAL(18,2) AS own FROM lines),
        y AS (SELECT *, first_value(CASE WHEN NOT bare AND own > 0 THEN own END IGNORE NULLS) OVER (PARTITION BY invoice_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first FROM x)
        SELECT invoice_id, n, CASE WHEN NOT bare THEN own WHEN part_id % 2 = 0 THEN NULL ELSE (coalesce(first, 0) + 1)::DECIMAL(18,2) END AS line_total FROM y""".replace("WITH x", "SELECT * FROM (WITH x", 1) + ")",
)
def wn_12_lines(s, d):
    """Items of all invoices: some have a text alone and repeat the total of the first item that has all, some a total of their own; the repeats go."""
    bare, own = c("part_id") % 3 == 0, (c("quantity") * (c("part_id") % 50 + 1)).cast("decimal(18,2)")
    order = ["line_number", "part_id", "quantity", "net"]
    rows = lines(s, d).withColumn("n", F.row_number().over(Window.partitionBy(k).orderBy(*order))).withColumn("own", own)
    first = F.first(F.when(~bare & (c("own") > 0), c("own")), ignorenulls=True).over(Window.partitionBy(k).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    given = rows.withColumn("first", first).select(
        k, "n", F.when(~bare, c("quantity")).alias("quantity"), F.when(~bare, (c("part_id") % 50 + 1).cast("decimal(18,2)")).alias("unit_price"),
        F.when(~bare, c("own")).when(c("part_id") % 2 == 0, c("first")).otherwise(F.coalesce("first", F.lit(0)) + 1).cast("decimal(18,2)").alias("line_total"),
    )
    return documents.without_copied_totals(given, k, ["n"]).select(k, "n", "line_total")


@query(
    "so_02_payloads",
    """SELECT invoice_id, array_to_string(list_concat(['inv:' || invoice_id], list_filter(refs, lambda x: x <> 'inv:' || invoice_id), ['cust:' || customer_id]), ',') AS refs FROM invoices JOIN (SELECT invoice_id, list_transform(list_sort(list_distinct(list(part_id))), lambda p: 'part:' || p) AS refs FROM lines GROUP BY 1) USING (invoice_id)""",
)
def so_02_payloads(s, d):
    """References out of nested payloads of all invoices: of the record, of each of its items (some twice), of the party three levels down; blank ones don't count."""
    ref = lambda name, key: F.concat(F.lit(f"{name}:"), c(key).cast("string"))
    parts = lines(s, d).groupBy(k).agg(F.transform(F.array_sort(F.collect_set("part_id")), lambda p: F.struct(F.array(F.concat(F.lit("part:"), p.cast("string")), F.lit(" ")).alias("evidence_refs"))).alias("items"))
    party = F.struct(F.struct(F.struct(F.array(ref("cust", "customer_id"), ref("inv", k)).alias("evidence_refs")).alias("note")).alias("to"))
    body = F.struct(F.array(ref("inv", k)).alias("evidence_refs"), c("number"), c("items"), c("items").alias("again"), party.alias("party"))
    return inv(s, d).join(parts, k).select(k, F.array_join(S.evidence_refs(F.to_json(body)), ",").alias("refs"))


@query(
    "scl_43_versions",
    f"""SELECT invoice_id, version, '{{"status":"superseded","customer":"' || customer || '","total":"' || total || '","due_date":"' || due_date || '","corrected_by":null}}' AS before_state, '{{"status":"extracted","customer":"' || CASE WHEN invoice_id % 5 = 1 THEN 'New Ltd' ELSE customer END || '","total":"'
        || CASE WHEN invoice_id % 5 = 0 THEN '12.50' ELSE total::VARCHAR END || '","due_date":"' || CASE WHEN invoice_id % 5 = 1 THEN '2030-01-02' ELSE due_date::VARCHAR END || '","corrected_by":' || (invoice_id * 10) || '}}' AS after_state FROM {OLD} WHERE hit""",
)
def scl_43_versions(s, d):
    """The audit's states of each corrected invoice: the version that was superseded, and the one that replaces it; amounts and dates are texts, nulls stay."""
    before, fixes = versions(s, d)
    after, _ = review.correct(before, fixes, FIELDS)
    made = review.made_versions(before, after)
    kinds = dict(after.dtypes) | {"corrected_by": "bigint"}
    state = lambda name: S.state_json({n: (c(n), kinds[n]) for n in ("status", "customer", "total", "due_date", "corrected_by")}).alias(name)
    old = after.withColumn("corrected_by", F.lit(None).cast("bigint")).join(made, [k, "version"]).select(k, "version", "new_version", state("before_state"))
    by = fixes.groupBy(k).agg(F.min("correction_id").alias("corrected_by"))
    new = after.join(by, k).select(k, c("version").alias("new_version"), state("after_state"))
    return old.join(new, [k, "new_version"]).select(k, "version", "before_state", "after_state")
