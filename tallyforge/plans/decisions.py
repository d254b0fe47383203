"""Queries on what follows from proposals: allocations, review tasks, QA outcomes, balances."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators import insights, reconcile, scoring, validate
from tallyforge.plans import registry as R
from tallyforge.plans.catalog import ORACLES, QUERIES, query
from tallyforge.sources import views as V

c, inv, tx, lines = F.col, V.invoices, V.transactions, V.invoice_lines


def scored(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, R.scored(sql)
        return f

    return add


def proposals(s, d):
    return reconcile.proposals(reconcile.best(R.found(s, d)))


@scored("jn_05", "SELECT invoice_id, transaction_id, score FROM kept EXCEPT ALL SELECT invoice_id, transaction_id, score FROM ranked WHERE rn = 1")
def jn_05(s, d):
    """Candidates but for the pairs that a proposal has allocated."""
    return reconcile.but_the_best(R.found(s, d).select("invoice_id", "transaction_id", "score"))


@scored("bd_06", "SELECT invoice_id, sum(abs(amount)) AS allocated, any_value(total) - sum(abs(amount)) AS difference, CASE WHEN count(*) > 1 THEN 'one_to_many' ELSE 'one_to_one' END AS match_type FROM kept GROUP BY 1")
def bd_06(s, d):
    g = R.found(s, d).groupBy("invoice_id").agg(F.sum(F.abs("amount")).alias("allocated"), F.first("total").alias("total"), F.count("*").alias("n"))
    return g.select("invoice_id", "allocated", (c("total") - c("allocated")).alias("difference"), F.when(c("n") > 1, "one_to_many").otherwise("one_to_one").alias("match_type"))


ACTIVE = "SELECT invoice_id, transaction_id FROM ranked WHERE rn = 1 AND invoice_id NOT IN (SELECT invoice_id FROM invoices WHERE invoice_id % 3 = 0)"


@scored("flt_08", ACTIVE)
def flt_08(s, d):
    """Allocations but for those that were rejected (every third here)."""
    status = F.when(c("invoice_id") % 3 == 0, "rejected").otherwise(c("status"))
    return proposals(s, d).withColumn("status", status).where(~c("status").isin("rejected", "superseded")).select("invoice_id", "transaction_id")


@scored("flt_04", "SELECT transaction_id, CASE WHEN b = 'proposed' THEN 'matched' WHEN b IS NOT NULL THEN 'review' ELSE 'unmatched' END AS state FROM transactions LEFT JOIN (SELECT transaction_id, max(CASE WHEN n_candidates > 1 OR score < 85 THEN 'pending_review' ELSE 'proposed' END) AS b FROM ranked WHERE rn = 1 GROUP BY 1) USING (transaction_id) WHERE direction = 'inflow' AND status = 'posted'")
def flt_04(s, d):
    p = proposals(s, d).groupBy("transaction_id").agg(F.max("status").alias("b"))
    rows = tx(s, d).where("direction = 'inflow' AND status = 'posted'").select("transaction_id").join(p, "transaction_id", "left")
    return rows.select("transaction_id", F.when(c("b") == "proposed", "matched").when(c("b").isNotNull(), "review").otherwise("unmatched").alias("state"))


@query("bd_15", """SELECT invoice_id, CASE WHEN l IS NULL THEN 'review_required' WHEN total - l > 0.01 THEN 'correction_required' ELSE 'passed' END AS outcome
 FROM invoices LEFT JOIN (SELECT invoice_id, sum(net) AS l FROM lines GROUP BY 1) USING (invoice_id)""")
def bd_15(s, d):
    i = inv(s, d)
    found = validate.arithmetic(i, lines(s, d)).unionByName(validate.dates(i))
    n = found.groupBy(c("entity_id").alias("invoice_id")).agg(F.count_if(c("severity") == "error").alias("errors"), F.count_if(c("severity") == "warning").alias("warnings"))
    return i.select("invoice_id").join(n, "invoice_id", "left").select("invoice_id", F.when(c("errors") > 0, "correction_required").when(c("warnings") > 0, "review_required").otherwise("passed").alias("outcome"))


@query("ag_12", "SELECT tenant_id, month, net, round(net::DOUBLE / nullif(max(abs(net)) OVER (PARTITION BY tenant_id), 0)::DOUBLE, 6) AS share FROM (SELECT tenant_id, date_trunc('month', posted_at)::DATE AS month, sum(amount) AS net FROM transactions GROUP BY 1, 2)")
def ag_12(s, d):
    g = R.monthly(s, d).groupBy("tenant_id", "month").agg(F.sum("amount").alias("net"))
    top = F.max(F.abs("net")).over(Window.partitionBy("tenant_id"))
    return g.withColumn("share", F.round(c("net").cast("double") / F.nullif(top, F.lit(0).cast("decimal(28,2)")).cast("double"), 6))


@query("so_03", "SELECT invoice_id, list_aggregate(list_sort(list_distinct(list(part_id))), 'string_agg', ',') AS refs FROM lines GROUP BY 1")
def so_03(s, d):
    """The sorted set of an invoice's parts; lines of one invoice are few."""
    return lines(s, d).groupBy("invoice_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("part_id")), lambda x: x.cast("string")), ",").alias("refs"))


