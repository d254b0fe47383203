"""Queries on the operations log: roll-ups with tokens and cost, queues, pages, alert windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import insights, opslog
from tallyforge.plans.catalog import query
from tallyforge.sources import store
from tallyforge.sources import views as V
from tallyforge.streaming import alerts, event_time

c, inv, tx, steps = F.col, V.invoices, V.transactions, V.steps
#: Rates by provider and model; one pair has none.
PRICES = [("alpha", "small", "0.003"), ("alpha", "large", "0.030"), ("beta", "small", "0.001")]
CALLS = """(SELECT * EXCLUDE (ms), CASE WHEN event_id % 10 <> 0 THEN ms END AS ms, CASE WHEN failed THEN 'failed' WHEN attempt > 1 AND event_id % 3 = 0 THEN 'retrying' ELSE 'succeeded' END AS status,
 ['alpha', 'beta'][event_id % 2 + 1] AS provider, ['small', 'large'][event_id // 2 % 2 + 1] AS model, attempt * 1000 AS tokens FROM steps)"""
PRICED = f"(SELECT c.*, (tokens::DECIMAL(18,0) / 1000 * rate)::DECIMAL(18,6) AS cost FROM {CALLS} c LEFT JOIN (VALUES {', '.join(f'({p!r}, {m!r}, {r}::DECIMAL(6,3))' for p, m, r in PRICES)}) v(provider, model, rate) USING (provider, model))"


def calls(s, d):
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    e = c("event_id")
    status = F.when(c("failed"), "failed").when((c("attempt") > 1) & (e % 3 == 0), "retrying").otherwise("succeeded")
    return steps(s, d).withColumns({"ms": F.when(e % 10 != 0, c("ms")), "status": status, "provider": pick(e, "alpha", "beta"), "model": pick(F.floor(e / 2), "small", "large"), "tokens": c("attempt") * 1000})


def priced(s, d):
    prices = s.createDataFrame(PRICES, "provider string, model string, rate string").withColumn("rate", c("rate").cast("decimal(6,3)"))
    return opslog.priced(calls(s, d), F.broadcast(prices))


def rolled(rows, *keys):
    return opslog.rollup(rows, *keys).withColumns({"avg_ms": F.round("avg_ms", 6), "cost": c("cost").cast("decimal(28,6)")})


ROLL = "SELECT {k}, count(*) AS n, count(*) FILTER ({f}) AS failures, sum(greatest(attempt - 1, 0))::BIGINT AS retries, round(sum(ms) / count(*), 6) AS avg_ms, max(ms) AS max_ms, sum(tokens)::BIGINT AS tokens, coalesce(sum(cost), 0)::DECIMAL(28,6) AS cost FROM {t} GROUP BY ALL"
query("op_01", ROLL.format(k="agent", f="failed", t=PRICED))(lambda s, d: rolled(priced(s, d), "agent"))
query("op_03", ROLL.format(k="agent || ':' || status AS key", f="status <> 'succeeded'", t=PRICED))(
    lambda s, d: rolled(priced(s, d).withColumns({"key": F.concat_ws(":", "agent", "status"), "failed": c("status") != "succeeded"}), "key")
)
query("op_04", ROLL.format(k="concat_ws(':', agent, provider, model) AS key", f="failed", t=PRICED))(lambda s, d: rolled(priced(s, d).withColumn("key", F.concat_ws(":", "agent", "provider", "model")), "key"))


@query(
    "op_07",
    """SELECT tenant_id, coalesce(status, 'all') AS status, coalesce(type, 'all') AS type, count(*) AS n FROM (SELECT tenant_id, status, ['extraction', 'policy', 'insight'][invoice_id % 3 + 1] AS type FROM invoices)
       GROUP BY GROUPING SETS ((tenant_id, status, type), (tenant_id, status), (tenant_id, type), (tenant_id))""",
)
def op_07(s, d):
    """Queue sizes by tenant, status and type, each also over all."""
    kind = F.element_at(F.array(*map(F.lit, ("extraction", "policy", "insight"))), (c("invoice_id") % 3 + 1).cast("int"))
    g = inv(s, d).select("tenant_id", "status", kind.alias("type")).cube("tenant_id", "status", "type").agg(F.count("*").alias("n"), F.grouping("tenant_id").alias("g"))
    return g.where("g = 0").select("tenant_id", F.coalesce("status", F.lit("all")).alias("status"), F.coalesce("type", F.lit("all")).alias("type"), "n")


@query(
    "op_08",
    f"""SELECT tenant_id, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'retrying') AS retrying, count(*) FILTER (status = 'failed') AS failed, sum(greatest(attempt - 1, 0))::BIGINT AS retries,
        count(ms) AS n_latency, round(avg(ms), 6) AS avg_ms, max(ms) AS max_ms FROM {CALLS} GROUP BY 1""",
)
def op_08(s, d):
    by = lambda x: F.count_if(c("status") == x).alias(x)
    return calls(s, d).groupBy("tenant_id").agg(by("succeeded"), by("retrying"), by("failed"), F.sum(F.greatest(c("attempt") - 1, F.lit(0))).alias("retries"), F.count("ms").alias("n_latency"), F.round(F.avg("ms"), 6).alias("avg_ms"), F.max("ms").alias("max_ms"))


@query("op_09", "SELECT tenant_id, agent AS event, count(*) AS n, greatest(0, sum(CASE agent WHEN 'signup' THEN count(*) WHEN 'purchase' THEN -count(*) ELSE 0 END) OVER (PARTITION BY tenant_id))::BIGINT AS running FROM steps GROUP BY 1, 2")
def op_09(s, d):
    """Events by kind, and how many jobs run: those that began (sign-ups here) less those that ended (purchases), not below 0."""
    n = steps(s, d).groupBy("tenant_id", c("agent").alias("event")).agg(F.count("*").alias("n"))
    change = F.when(c("event") == "signup", c("n")).when(c("event") == "purchase", -c("n")).otherwise(0)
    run = n.groupBy("tenant_id").agg(F.greatest(F.lit(0), F.sum(change)).alias("running"))
    return n.join(run, "tenant_id")


@query("op_10", f"SELECT count(*) FILTER (failed) AS failures, sum(greatest(attempt - 1, 0))::BIGINT AS retries, sum(CASE WHEN event_id % 4 <> 3 THEN cost END)::DECIMAL(28,6) AS cost, count(*) FILTER (event_id % 4 = 3 OR cost IS NULL) AS n_unread FROM {PRICED}")
def op_10(s, d):
    """Sums of figures that come as texts; what can't be read counts for nothing."""
    said = F.when(c("event_id") % 4 == 3, "n/a").otherwise(c("cost").cast("string"))
    read = said.try_cast("decimal(18,6)")
    return priced(s, d).agg(F.count_if("failed").alias("failures"), F.sum(F.greatest(c("attempt") - 1, F.lit(0))).alias("retries"), F.sum(read).cast("decimal(28,6)").alias("cost"), F.count_if(read.isNull()).alias("n_unread"))


# pages
@query(
    "tk_03",
    """SELECT page, place, id FROM (SELECT 'invoices' AS page, invoice_id AS id, row_number() OVER (ORDER BY issue_date DESC, invoice_id DESC) AS place FROM invoices
       UNION ALL SELECT 'documents', doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id DESC) FROM documents UNION ALL SELECT 'reviews', invoice_id, row_number() OVER (ORDER BY due_date DESC, invoice_id DESC) FROM invoices WHERE status = 'pending_review') WHERE place <= 50""",
)
def tk_03(s, d):
    """The first pages of invoices, documents and review tasks, newest first; a page is 50 rows."""
    from pyspark.sql import Window

    def page(name, rows, key, by):
        top = rows.select(c(key).cast("bigint").alias("id"), c(by).alias("by")).orderBy(F.desc("by"), F.desc("id")).limit(50)
        return top.select(F.lit(name).alias("page"), F.row_number().over(Window.orderBy(F.desc("by"), F.desc("id"))).alias("place"), "id")

    i = inv(s, d)
    return page("invoices", i, "invoice_id", "issue_date").unionByName(page("documents", V.table(s, d, "documents"), "doc_id", "n_chars")).unionByName(page("reviews", i.where("status = 'pending_review'"), "invoice_id", "due_date"))


query("tk_04", f"SELECT key, failures, max_ms FROM (SELECT concat_ws(':', agent, provider, model) AS key, count(*) FILTER (failed) AS failures, max(ms) AS max_ms FROM {CALLS} GROUP BY 1) ORDER BY failures DESC, max_ms DESC, key LIMIT 10")(
    lambda s, d: opslog.rollup(calls(s, d).withColumn("key", F.concat_ws(":", "agent", "provider", "model")), "key").orderBy(F.desc("failures"), F.desc("max_ms"), "key").limit(10).select("key", "failures", "max_ms")
)


@query(
    "tk_05",
    """SELECT * FROM (SELECT 'pending' AS kind, event_id, ts FROM steps WHERE NOT failed AND attempt = 1 AND ts <= (SELECT max(ts) FROM steps) - INTERVAL 1 DAY ORDER BY ts, event_id LIMIT 100)
       UNION ALL SELECT * FROM (SELECT 'stale', event_id, ts FROM steps WHERE failed AND attempt > 1 AND ts + to_milliseconds(ms::BIGINT) < (SELECT max(ts) FROM steps) ORDER BY ts, event_id LIMIT 100)""",
)
def tk_05(s, d):
    """What is to be sent out (due a day ago or earlier, oldest first) and running jobs whose lease has run out; a page is 100 rows."""
    e = steps(s, d)
    now = F.lit(e.agg(F.max("ts")).first()[0])  # one value
    due = e.where(~c("failed") & (c("attempt") == 1) & (c("ts") <= now - F.expr("interval 1 day")))
    lease = F.timestamp_micros(F.unix_micros(c("ts").cast("timestamp")) + F.col("ms").cast("bigint") * 1000)
    stale = e.where(c("failed") & (c("attempt") > 1) & (lease < now.cast("timestamp")))
    page = lambda name, rows: rows.orderBy("ts", "event_id").limit(100).select(F.lit(name).alias("kind"), "event_id", "ts")
    return page("pending", due).unionByName(page("stale", stale))


@query("wn_03", "SELECT doc_id, event_id AS run, agent, failed FROM documents LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM steps) ON user_id = doc_id AND rn = 1")
def wn_03(s, d):
    """The latest run of each document, by an aggregate; a document without runs has none."""
    last = steps(s, d).groupBy(c("user_id").alias("doc_id")).agg(F.max(F.struct("ts", "event_id", "agent", "failed")).alias("x"))
    return V.table(s, d, "documents").select("doc_id").join(last, "doc_id", "left").select("doc_id", c("x.event_id").alias("run"), "x.agent", "x.failed")


@query(
    "ag_09",
    """SELECT doc_id, count(*) AS n_blocks, count(DISTINCT page) AS n_pages, sum(length(line))::BIGINT AS n_chars, round(avg(confidence), 6) AS confidence, string_agg(line, chr(10) ORDER BY pos) AS text FROM (
       SELECT doc_id, line, pos, pos // 40 + 1 AS page, CASE WHEN pos % 3 <> 0 THEN (pos % 10) / 10.0 END AS confidence FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) WHERE trim(line) <> '') GROUP BY 1""",
)
def ag_09(s, d):
    """A document's scan from its blocks, in their order: text, pages, mean confidence of the blocks that have one. A document is one row before and after."""
    rows = V.table(s, d, "documents").select("doc_id", F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda b: F.trim(b["line"]) != "").alias("b")).where("size(b) > 0")
    sure = F.filter(F.transform("b", lambda b: F.when(b["pos"] % 3 != 0, (b["pos"] % 10) / 10.0)), lambda x: x.isNotNull())
    mean = F.aggregate(sure, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(sure), F.lit(0))
    line = F.transform("b", lambda b: b["line"])
    return rows.select(
        "doc_id", F.size("b").cast("bigint").alias("n_blocks"), F.size(F.array_distinct(F.transform("b", lambda b: F.floor(b["pos"] / 40)))).cast("bigint").alias("n_pages"),
        F.aggregate(line, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("n_chars"), F.round(mean, 6).alias("confidence"), F.array_join(line, "\n").alias("text"),
    )


@query(
    "ag_11",
    """SELECT 'banking' AS screen, tenant_id, count(*) AS shown, sum(abs(amount))::DECIMAL(28,2) AS total, count(*) FILTER (status = 'pending') AS waiting FROM transactions GROUP BY 2
       UNION ALL SELECT 'invoices', tenant_id, count(*), sum(total), count(*) FILTER (status = 'pending_review') FROM invoices GROUP BY 2
       UNION ALL SELECT 'reviews', tenant_id, count(*), sum(total), count(*) FILTER (priority IN ('1-URGENT', '2-HIGH')) FROM invoices WHERE status = 'pending_review' GROUP BY 2
       UNION ALL SELECT 'operations', tenant_id, count(*), sum(coalesce(ms, 0))::DECIMAL(28,2), count(*) FILTER (failed) FROM steps GROUP BY 2""",
)
def ag_11(s, d):
    """Head figures of four screens: what is shown, its sum, and what waits."""
    def screen(name, rows, total, waits):
        return rows.groupBy("tenant_id").agg(F.count("*").alias("shown"), F.sum(total).cast("decimal(28,2)").alias("total"), F.count_if(waits).alias("waiting")).select(F.lit(name).alias("screen"), "tenant_id", "shown", "total", "waiting")

    t, i = tx(s, d), inv(s, d)
    banking = screen("banking", t, F.abs("amount"), c("status") == "pending")
    reviews = screen("reviews", i.where("status = 'pending_review'"), c("total"), c("priority").isin("1-URGENT", "2-HIGH"))
    operations = screen("operations", steps(s, d), F.coalesce("ms", F.lit(0.0)), c("failed"))
    return banking.unionByName(screen("invoices", i, c("total"), c("status") == "pending_review")).unionByName(reviews).unionByName(operations)


# alert windows: batch twins of the streams
query("sm_03", "SELECT date_trunc('second', ts) AS window_start, agent, count(*) AS n FROM steps GROUP BY 1, 2 HAVING count(*) > 1")(lambda s, d: alerts.over_budget(steps(s, d), "agent", 1))
query("sm_04", "SELECT time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(m) AS window_start, tenant_id, count(*) AS n, count(*) FILTER (failed) AS failures FROM steps, range(10) r(m) GROUP BY 1, 2 HAVING count(*) FILTER (failed) > 0.1 * count(*)")(
    lambda s, d: alerts.failure_rate(steps(s, d), "tenant_id", slide="1 minute")
)
query(
    "sm_05",
    """SELECT 'ocr_failures' AS alert, time_bucket(INTERVAL 30 MINUTE, ts) AS window_start, tenant_id::VARCHAR AS key, count(*) AS n FROM steps GROUP BY 2, 3 HAVING count(*) FILTER (failed) > 0.05 * count(*)
       UNION ALL SELECT 'retries_exhausted', time_bucket(INTERVAL 15 MINUTE, ts), agent, count(*) FROM steps WHERE failed AND attempt >= 1 GROUP BY 2, 3 HAVING count(*) > 3""",
)(
    lambda s, d: alerts.failure_rate(steps(s, d), "tenant_id", "30 minutes", over=0.05).select(F.lit("ocr_failures").alias("alert"), "window_start", c("tenant_id").cast("string").alias("key"), "n").unionByName(
        alerts.retry_exhaustion(steps(s, d), "agent", 1).select(F.lit("retries_exhausted").alias("alert"), "window_start", c("agent").alias("key"), "n")
    )
)
query("sm_06", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, tenant_id, count(*) AS n, count(*) FILTER (agent = 'purchase') AS failures FROM steps GROUP BY 1, 2 HAVING count(*) FILTER (agent = 'purchase') > 0.25 * count(*)")(
    lambda s, d: alerts.failure_rate(steps(s, d).withColumn("failed", c("agent") == "purchase"), "tenant_id", "1 day", over=0.25)
)
query("sm_07", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, agent, count(ms) AS n, count(*) FILTER (ms > l) AS slow FROM (SELECT *, CASE agent WHEN 'signup' THEN 50 ELSE 20 END AS l FROM steps) GROUP BY 1, 2 HAVING count(*) FILTER (ms > l) > 0.05 * count(ms)")(
    lambda s, d: alerts.slow(steps(s, d), "agent", F.when(c("agent") == "signup", 50).otherwise(20))
)


@query(
    "sm_09",
    """SELECT agent AS provider, count(*) AS n, arg_min(event_id, (ts, event_id)) AS first_event FROM (SELECT event_id, ts, agent, bad, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY agent ORDER BY ts, event_id) AS island FROM (SELECT *, ms > 8 AS bad FROM steps))
       WHERE bad GROUP BY agent, island HAVING count(*) >= 5""",
)
def sm_09(s, d):
    """Five calls of a provider in a row that failed (took over 8 ms here)."""
    return opslog.failure_runs(steps(s, d).select(c("agent").alias("provider"), "ts", "event_id", F.coalesce(c("ms") > 8, F.lit(False)).alias("failed")), "provider", 5)


#: Hours by which a row comes late, at most, and the lots in which rows come.
DELAY, LOTS = 6, 3


def arrived(s, d, alert, key):
    """The alert over a stream of steps that come up to some hours late, in lots by the time they come, each lot's files after those before; a last row
    of no key is far ahead, so that the watermark passes all."""
    folder, told, checkpoint = (store.shared_folder(s, n) for n in ("steps", "told", "checkpoint"))
    rows = steps(s, d).withColumn("ts", c("ts").cast("timestamp"))
    micros = F.unix_micros("ts")
    a, b = rows.agg(F.min(micros), F.max(micros)).first()
    comes = micros + (c("event_id") % (DELAY + 1)) * 3_600_000_000
    lot = F.least(F.floor((comes - a) * LOTS / (b - a + 1)), F.lit(LOTS - 1))
    flush = rows.limit(1).withColumns({"ts": F.timestamp_micros(F.lit(b)) + F.expr("interval 400 days"), key: F.lit(None).cast(dict(rows.dtypes)[key]), "failed": F.lit(False)})
    for n in range(LOTS + 1):
        (rows.where(lot == n) if n < LOTS else flush).write.mode("append").parquet(folder)
        stream = alert(s.readStream.schema(rows.schema).parquet(folder))
        q = stream.writeStream.format("parquet").option("path", told).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return s.read.schema(stream.schema).parquet(told).where(c(key).isNotNull())


@query(
    "sm_09_stream",
    """SELECT agent, event_id, first_event FROM (SELECT agent, event_id, row_number() OVER w AS n, first_value(event_id) OVER w AS first_event FROM (SELECT event_id, ts, agent, ms > 8 AS bad, sum(CASE WHEN ms > 8 THEN 0 ELSE 1 END) OVER (PARTITION BY agent ORDER BY ts, event_id) AS island FROM steps)
       WHERE bad WINDOW w AS (PARTITION BY agent, island ORDER BY ts, event_id)) WHERE n = 5""",
)
def sm_09_stream(s, d):
    """The fifth failure of a provider in a row (calls of over 8 ms here), from a stream whose rows come late and out of order."""
    return arrived(s, d, lambda rows: event_time.failures_in_a_row(rows.withColumn("failed", c("ms") > 8), "agent", 5, f"{DELAY} hours"), "agent")


@query(
    "sm_06_stream",
    """SELECT tenant_id, event_id, n AS n_corrected FROM (SELECT tenant_id, event_id, count(*) FILTER (agent = 'purchase') OVER w AS n, count(*) OVER w AS m FROM steps WINDOW w AS (PARTITION BY tenant_id ORDER BY ts, event_id ROWS 49 PRECEDING)) WHERE m = 50 AND n > 12.5""",
)
def sm_06_stream(s, d):
    """Decisions at which over a quarter of the tenant's last 50 were corrections, from a stream whose rows come late and out of order."""
    return arrived(s, d, lambda rows: event_time.corrections_of_last(rows.withColumn("corrected", c("agent") == "purchase"), "tenant_id", 50, 0.25, f"{DELAY} hours"), "tenant_id")
