"""Further join queries: pairs of one import, amount windows, lookups, several keys, expected against actual."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators import classify, reconcile, review
from tallyforge.plans import registry as R
from tallyforge.plans.catalog import ORACLES, QUERIES, query
from tallyforge.plans.decisions import scored
from tallyforge.sources import views as V

c, inv, tx, lines, steps = F.col, V.invoices, V.transactions, V.invoice_lines, V.steps





@scored("jn_13", """SELECT invoice_id, arg_min(transaction_id, (-score, transaction_id)) AS transaction_id FROM kept k JOIN invoices i USING (invoice_id) JOIN transactions t USING (transaction_id)
 WHERE (i.invoice_id % 2 = 0 AND k.transaction_id = 'T' || i.invoice_id) OR t.reference = i.number GROUP BY 1""")
def jn_13(s, d):
    """The first candidate that has the expected transaction or, failing a known one, the invoice's reference: two equi-joins."""
    found = R.found(s, d).select("invoice_id", "transaction_id", "score")
    wanted = inv(s, d).select("invoice_id", "number", F.when(c("invoice_id") % 2 == 0, F.concat(F.lit("T"), c("invoice_id").cast("string"))).alias("want"))
    by_id = found.join(wanted.where("want is not null").select("invoice_id", c("want").alias("transaction_id")), ["invoice_id", "transaction_id"])
    refs = tx(s, d).where("reference is not null").select("transaction_id", c("reference").alias("number"))
    by_reference = found.join(refs, "transaction_id").join(wanted.select("invoice_id", "number"), ["invoice_id", "number"]).select("invoice_id", "transaction_id", "score")
    return by_id.unionByName(by_reference).groupBy("invoice_id").agg(F.min_by("transaction_id", F.struct(-c("score"), c("transaction_id"))).alias("transaction_id"))


@scored("jn_15", "SELECT invoice_id, transaction_id, t.amount, t.posted_at FROM kept k JOIN transactions t USING (transaction_id)")
def jn_15(s, d):
    """Transactions that an invoice's list of references names."""
    refs = R.found(s, d).groupBy("invoice_id").agg(F.collect_set("transaction_id").alias("refs"))
    return refs.select("invoice_id", F.explode("refs").alias("transaction_id")).join(tx(s, d).select("transaction_id", "amount", "posted_at"), "transaction_id").select("invoice_id", "transaction_id", "amount", "posted_at")


@scored("jn_16", "SELECT transaction_id, transaction_id NOT IN (SELECT transaction_id FROM kept) AS passed FROM transactions WHERE direction = 'outflow'")
def jn_16(s, d):
    """Transactions that should have no candidate, and whether they have none."""
    hit = R.found(s, d).select("transaction_id").distinct().withColumn("hit", F.lit(True))
    return tx(s, d).where("direction = 'outflow'").select("transaction_id").join(hit, "transaction_id", "left").select("transaction_id", c("hit").isNull().alias("passed"))


KINDS, ACTIONS = list(review.TASK_TYPES), sorted({a for _, xs in review.TASK_TYPES.values() for a in xs})
VALUES = ", ".join(f"({i}, '{k}', '{p}', {xs})" for i, (k, (p, xs)) in enumerate(review.TASK_TYPES.items()))


@query("bd_12", f"SELECT invoice_id AS task_id, kind AS task_type, p AS priority, list_contains(xs, {ACTIONS}[invoice_id % {len(ACTIONS)} + 1]) AS allowed FROM invoices JOIN (VALUES {VALUES}) v(i, kind, p, xs) ON i = invoice_id % {len(KINDS)} WHERE status = 'pending_review'")
def bd_12(s, d):
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (c("invoice_id") % len(xs) + 1).cast("int"))
    tasks = inv(s, d).where("status = 'pending_review'").select(c("invoice_id").alias("task_id"), pick(KINDS).alias("task_type"), pick(ACTIONS).alias("action"))
    return review.allowed(tasks).select("task_id", "task_type", "priority", "allowed")
