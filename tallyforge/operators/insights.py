"""Cash-flow reports, balances, category totals and what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S


def zero() -> Column:
    return F.lit(0).cast("decimal(28,2)")


def cash_flow(transactions: DataFrame, *keys: str) -> DataFrame:
    """Counts, inflow, outflow, net, and the largest of each (earliest day, then smallest id, on ties) by keys.

    A row counts as inflow by direction or by sign, and may count as both. Everything is summed before the shuffle.
    """
    inflow = (F.col("direction") == "inflow") | (F.col("amount") > 0)
    outflow = (F.col("direction") == "outflow") | (F.col("amount") < 0)
    first = F.struct((-F.abs("amount")).alias("a"), F.col("posted_at").alias("d"), F.col("transaction_id").alias("i"))
    return transactions.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(inflow).alias("n_in"), F.count_if(outflow).alias("n_out"),
        F.coalesce(F.sum(F.when(inflow, F.abs("amount"))), zero()).alias("total_in"), F.coalesce(F.sum(F.when(outflow, -F.abs("amount"))), zero()).alias("total_out"),
        F.min(F.when(inflow, first)).alias("most_in"), F.min(F.when(outflow, first)).alias("most_out"),
    ).select(
        *keys, "n", "n_in", "n_out", "total_in", "total_out", F.col("most_in.i").alias("largest_in"), (-F.col("most_in.a")).alias("largest_in_amount"), F.col("most_out.i").alias("largest_out"),
        (-F.col("most_out.a")).alias("largest_out_amount"), (F.col("total_in") + F.col("total_out")).alias("net"),
    )


def report(transactions: DataFrame, statements: DataFrame) -> DataFrame:
    """A cash-flow report of each statement(import_id, account_id, period_start, period_end, currency, opening_balance, closing_balance).

    Amounts are signed by direction. expected_closing is the opening balance and the net change; the variance is null without either balance.
    A statement without transactions has zeros. The rows that a report rests on are evidence()'s.
    """
    signed = transactions.withColumn("amount", S.signed_amount(F.col("amount"), F.col("direction")))
    side = F.when(F.col("amount") > 0, "inflow").when(F.col("amount") < 0, "outflow")
    flow = cash_flow(signed.withColumn("direction", side), "account_id")
    j = statements.join(flow, "account_id", "left")
    some = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    sums = [F.coalesce(c, zero()).alias(c) for c in ("total_in", "total_out", "net")]
    expected = F.col("opening_balance") + F.coalesce("net", zero())
    return j.select(
        "import_id", "account_id", "period_start", "period_end", "currency", "opening_balance", "closing_balance", expected.alias("expected_closing"), (F.col("closing_balance") - expected).alias("variance"),
        *map(some, ("n", "n_in", "n_out")), *sums, (-F.coalesce("total_out", zero())).alias("total_out_abs"), "largest_in", "largest_in_amount", "largest_out", "largest_out_amount",
    )


def evidence(transactions: DataFrame) -> DataFrame:
    """account_id, evidence_ref, side of each transaction: the refs of reports, a row each, so that no account is one row."""
    signed = S.signed_amount(F.col("amount"), F.col("direction"))
    return transactions.select("account_id", F.concat(F.lit("statement_transaction:"), "transaction_id").alias("evidence_ref"), F.when(signed > 0, "inflow").when(signed < 0, "outflow").otherwise("none").alias("side"))


def category_totals(rows: DataFrame, *keys: str) -> DataFrame:
    """By keys and category (null: uncategorized): type, n, total, absolute, and the place by absolute amount, then code."""
    signed = S.signed_amount(F.col("amount"), F.col("direction"))
    sums = rows.groupBy(*keys, F.coalesce("category", F.lit("uncategorized")).alias("category")).agg(F.max("category_type").alias("category_type"), F.count("*").alias("n"), F.sum(signed).alias("total"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs("total")), "category"))  # a row a category by now
    return sums.withColumn("absolute", F.abs("total")).withColumn("place", place)


def latest_balance(transactions: DataFrame) -> DataFrame:
    """account_id, currency, balance, day, transaction_id: the latest row with a running balance by posted, else value date; the smallest id on ties."""
    day = F.coalesce("posted_at", "value_at", F.lit("0001-01-01").cast("date"))
    first = F.struct((-F.unix_date(day)).alias("back"), F.col("transaction_id"), "currency", F.col("running_balance").alias("balance"), "posted_at")
    return transactions.where("running_balance is not null").groupBy("account_id").agg(F.min(first).alias("x")).select("account_id", "x.currency", "x.balance", "x.posted_at", "x.transaction_id")


def latest_statement(statements: DataFrame) -> DataFrame:
    """account_id, import_id, currency, balance, day: the parsed statement with a closing balance that ends last; the smallest id on ties."""
    end = F.coalesce("period_end", F.lit("0001-01-01").cast("date"))
    first = F.struct((-F.unix_date(end)).alias("back"), "import_id", "currency", F.col("closing_balance").alias("balance"), "period_end")
    kept = statements.where("status = 'parsed' and closing_balance is not null")
    return kept.groupBy("account_id").agg(F.min(first).alias("x")).select("account_id", "x.import_id", "x.currency", "x.balance", "x.period_end")


def amounts(rows: DataFrame, *keys: str) -> DataFrame:
    """By keys of rows(currency, amount, day): n, the sums by currency (`CUR=sum`, sorted), amount and currency where there is only one, latest day."""
    by = rows.groupBy(*keys, S.currency_bucket(F.col("currency")).alias("currency")).agg(F.sum("amount").alias("amount"), F.count("*").alias("n"), F.max("day").alias("day"))
    one = F.count("*") == 1
    return by.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "currency", F.col("amount").cast("string")))), ",").alias("by_currency"),
        F.when(one, F.max("amount")).alias("amount"), F.when(one, F.max("currency")).alias("currency"), F.max("day").alias("period_end"),
    )


#: What a cash position may rest on, and what is said without any.
SOURCES = ["Latest transaction running balance", "Latest statement closing balance", "No statement balance imported yet"]


def cash_position(transactions: DataFrame, statements: DataFrame, tenants: DataFrame) -> DataFrame:
    """By tenant: the sum of its accounts' latest balances, of running balances where it has any, else of statements, else unavailable."""
    of = lambda rows, day: rows.select("tenant_id", "currency", F.col("balance").alias("amount"), F.col(day).alias("day"))
    account = transactions.select("account_id", "tenant_id").distinct().unionByName(statements.select("account_id", "tenant_id")).distinct()
    running = amounts(of(latest_balance(transactions).join(account, "account_id"), "posted_at"), "tenant_id").withColumn("kind", F.lit(0))
    closing = amounts(of(latest_statement(statements).join(account, "account_id"), "period_end"), "tenant_id").withColumn("kind", F.lit(1))
    best = running.unionByName(closing).groupBy("tenant_id").agg(F.min_by(F.struct("n", "by_currency", "amount", "currency", "period_end", "kind"), "kind").alias("x"))
    j = tenants.select("tenant_id").join(best, "tenant_id", "left")
    return j.select(
        "tenant_id", F.col("x").isNotNull().alias("available"), "x.amount", "x.currency", F.coalesce("x.by_currency", F.lit("")).alias("by_currency"), F.coalesce("x.n", F.lit(0)).alias("account_count"),
        F.when(F.col("x.kind") == 0, F.col("x.n")).otherwise(0).alias("transaction_count"), "x.period_end", F.get(F.array(*map(F.lit, SOURCES)), F.coalesce("x.kind", F.lit(2))).alias("source"),
    )


def insights(flow: DataFrame, *keys: str) -> DataFrame:
    """Cash-flow, expense and concentration insights of reports: type, severity, title, metric, confidence, evidence, metrics.

    A report of no rows says nothing. Concentration: the largest inflow is half of the inflow or more. metrics: JSON of what the insight
    rests on; evidence: the largest row of its side, or the whole report.
    """
    share = F.when(F.col("total_in") > 0, S.percentage((F.col("largest_in_amount") * 100 / F.col("total_in")).cast("decimal(38,10)")))
    code = F.coalesce("currency", F.lit("UNKNOWN"))
    said = lambda a: F.concat_ws(" ", code, F.format_number(a, 2))
    spent = -F.col("total_out")
    kind = lambda t, severity, title, metric, confidence, ref, *m: F.struct(
        F.lit(t).alias("type"), severity.alias("severity"), title.alias("title"), metric.cast("decimal(38,2)").alias("metric"), confidence.alias("confidence"), ref.cast("string").alias("evidence"), F.to_json(F.struct(*m)).alias("metrics")
    )
    text = lambda name, c: c.cast("string").alias(name)
    net = F.col("net")
    cash = kind(
        "cashflow", F.when(net < 0, "high").otherwise("info"), F.concat(F.when(net < 0, "Cash fell by ").otherwise("Cash rose by "), said(F.abs(net))), net, F.when(F.col("variance") == 0, "high").otherwise("medium"), F.lit("report"),
        text("total_inflow", F.col("total_in")), text("total_outflow_abs", spent), text("net_change", net), text("closing_balance_variance", F.col("variance")),
    )
    expense = kind(
        "expense", F.when(spent > F.col("total_in"), "medium").otherwise("low"), F.concat(F.lit("Spent "), said(spent)), spent, F.lit("medium"), F.col("largest_out"),
        text("outflow_count", F.col("n_out")), text("total_outflow_abs", spent), text("largest_outflow_amount", F.col("largest_out_amount")),
    )
    revenue = kind("revenue", F.lit("medium"), F.concat(F.lit("One inflow is "), S.format_percentage(share), F.lit("% of all")), share, F.lit("medium"), F.col("largest_in"), text("largest_inflow_amount", F.col("largest_in_amount")), text("share", share))
    found = F.array(F.when(F.col("n") > 0, cash), F.when(F.col("n_out") > 0, expense), F.when(share >= 50, revenue))
    return flow.select(*keys, F.explode(F.array_compact(found)).alias("x")).select(*keys, "x.*")


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
