"""Queries on the operations log and further alert windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import opslog, ordered
from tallyforge.plans.catalog import query
from tallyforge.sources import views as V
from tallyforge.streaming import alerts

c, steps = F.col, V.steps


@query("op_02", "SELECT 'POST /' || agent || ' ' || CASE WHEN failed THEN 500 ELSE 200 END AS endpoint, count(*) AS n, count(*) FILTER (failed) AS failures FROM steps GROUP BY 1")
def op_02(s, d):
    """Method, path and status; a status of 500 or more fails."""
    rows = steps(s, d).withColumn("status_code", F.when(c("failed"), 500).otherwise(200))
    return rows.groupBy(F.concat(F.lit("POST /"), "agent", F.lit(" "), c("status_code").cast("string")).alias("endpoint")).agg(F.count("*").alias("n"), F.count_if(c("status_code") >= 500).alias("failures"))


@query("op_05", "SELECT 'retry' AS kind, agent, sum(greatest(attempt - 1, 0))::BIGINT AS n FROM steps GROUP BY 2 UNION ALL SELECT 'failure', agent, count(*) FILTER (failed) FROM steps GROUP BY 2")
def op_05(s, d):
    """One pass counts both kinds; they are spread after it."""
    g = opslog.rollup(steps(s, d), "agent")
    return g.select("agent", F.explode(F.create_map(F.lit("retry"), c("retries").cast("bigint"), F.lit("failure"), c("failures").cast("bigint"))).alias("kind", "n"))


@query("op_11", "SELECT event_id, CASE WHEN failed THEN 'agent=' || agent || ';state=failed' ELSE 'agent=' || agent END AS flat FROM steps")
def op_11(s, d):
    """Audit attributes merged into one map, without the keys that are null."""
    m = F.map_filter(F.map_concat(F.create_map(F.lit("agent"), c("agent")), F.create_map(F.lit("state"), F.when(c("failed"), "failed"))), lambda k, v: v.isNotNull())
    flat = F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return steps(s, d).select("event_id", flat.alias("flat"))


@query("wn_13", "SELECT event_id, tenant_id FROM (SELECT event_id, tenant_id, count(*) OVER w AS n, count(*) FILTER (agent = 'purchase') OVER w AS k FROM steps WINDOW w AS (PARTITION BY tenant_id ORDER BY ts, event_id ROWS 49 PRECEDING)) WHERE n = 50 AND k > 0.25 * n")
def wn_13(s, d):
    """Decisions at which over a quarter of the tenant's last 50 were corrections (the other half of the daily alert), in blocks of rows."""
    rows = ordered.numbered(steps(s, d).select("event_id", "tenant_id", "ts", "agent"), ["tenant_id"], ["ts", "event_id"])
    rows = ordered.last_rows(rows, ["tenant_id"], "n", 50, k=lambda w: F.count_if(c("agent") == "purchase").over(w))
    return rows.where((c("n") >= 50) & (c("k") > 0.25 * 50)).select("event_id", "tenant_id")


@query("sm_08", "SELECT tenant_id, count(*) AS n_open, max((SELECT max(issue_date) FROM invoices) - issue_date)::INT AS oldest_days FROM invoices WHERE status = 'pending_review' GROUP BY 1")
def sm_08(s, d):
    """Open tasks and the age of the oldest, as of the last day seen."""
    i = V.invoices(s, d)
    g = i.groupBy("tenant_id").agg(F.count_if(c("status") == "pending_review").alias("n_open"), F.min(F.when(c("status") == "pending_review", c("issue_date"))).alias("oldest"), F.max("issue_date").alias("last"))
    now = g.agg(F.max("last").alias("now"))  # a row a tenant by then
    return g.where("n_open > 0").join(F.broadcast(now)).select("tenant_id", "n_open", F.datediff("now", "oldest").alias("oldest_days"))


@query("sm_10", "SELECT event_id, CASE WHEN attempt >= 3 THEN 'dead_letter' ELSE 'lost' END AS state FROM steps WHERE failed AND ms > 10")
def sm_10(s, d):
    """Runs whose lease (10 ms here) ended before they did: out of attempts or to be tried again."""
    return alerts.stale(steps(s, d).where("failed").withColumn("lease", F.lit(10)), c("ms") > c("lease"), 3).select("event_id", "state")
