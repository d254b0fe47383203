"""Queries on contracts, privacy, merged records, lineage and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import documents, insights, scoring, validate
from tallyforge.plans import registry as R
from tallyforge.plans.catalog import projection, query
from tallyforge.plans.decisions import scored
from tallyforge.sources import views as V

c, inv, tx, lines, steps = F.col, V.invoices, V.transactions, V.invoice_lines, V.steps


@scored("bd_07", """SELECT i.invoice_id, concat_ws(',', CASE WHEN total - l > 0.01 THEN 'line_sum_below_total' END, CASE WHEN n_candidates IS NULL THEN 'no_matching_transaction' WHEN n_candidates > 1 THEN 'ambiguous_match' WHEN score < 85 THEN 'low_confidence_match' END) AS reasons
 FROM invoices i LEFT JOIN (SELECT invoice_id, sum(net) AS l FROM lines GROUP BY 1) USING (invoice_id) LEFT JOIN (SELECT invoice_id, n_candidates, score FROM ranked WHERE rn = 1) r USING (invoice_id)""")
def bd_07(s, d):
    """What blocks an invoice: error codes in order, then the reason of reconciliation."""
    codes = validate.arithmetic(inv(s, d), lines(s, d)).where("severity = 'error'").groupBy(c("entity_id").alias("invoice_id")).agg(F.array_sort(F.collect_set("code")).alias("codes"))
    rows = R.bd_05(s, d).join(codes, "invoice_id", "left")
    none = F.array().cast("array<string>")
    return rows.select("invoice_id", F.array_join(F.concat(F.coalesce("codes", none), F.array_compact(F.array(F.nullif("decision", F.lit("ready"))))), ",").alias("reasons"))


@query("flt_09", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT invoice_id FROM invoices) AND doc_id IN (SELECT user_id FROM (SELECT user_id, failed, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM steps) WHERE rn = 1 AND failed)")
def flt_09(s, d):
    """Documents without an invoice whose latest run failed."""
    last = insights.latest(steps(s, d), ["user_id"], F.desc("ts"), F.desc("event_id")).where("failed").select(c("user_id").alias("doc_id"))
    docs = V.table(s, d, "documents").select("doc_id")
    return docs.join(inv(s, d).select(c("invoice_id").alias("doc_id")), "doc_id", "left_anti").join(last, "doc_id", "left_semi")


query("ag_10", "SELECT agent, round(avg(CASE WHEN ms < 0 THEN NULL WHEN ms <= 1 THEN ms WHEN ms <= 100 THEN ms / 100 END), 6) AS confidence FROM steps GROUP BY 1")(lambda s, d: steps(s, d).groupBy("agent").agg(F.round(F.avg(S.ocr_confidence(c("ms"))), 6).alias("confidence")))
projection("so_01", inv, "SELECT invoice_id, number || ',' || customer || ',' || currency AS refs FROM invoices", lambda: ["invoice_id", F.array_join(F.array_union(F.array("number", "customer"), F.array("customer", "currency")), ",").alias("refs")])
