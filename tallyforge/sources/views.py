"""Finance views over the star-schema tables: invoices, lines, transactions, events of an operations log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CURRENCIES = ["USD", "EUR", "GBP", "JPY", "SGD"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_of(name: str):
    """The table as a view."""
    return lambda spark, sf_dir: table(spark, sf_dir, name)


def reader(spark: SparkSession, sf_dir: str, tenant: int):
    """Reads views for one tenant: every read goes through it, so that other tenants' rows look missing."""
    return lambda view: view(spark, sf_dir).where(F.col("tenant_id") == tenant)


def money(c: Column) -> Column:
    """Doubles become decimals before any arithmetic."""
    return c.cast("decimal(18,2)")


def lettered(name: Column) -> Column:
    """A name with letters for digits, as names of parties have none."""
    return F.translate(name, "0123456789#", "ABCDEFGHIJ ")


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("tenant_id"), F.col("n_name").alias("tenant_name"), F.element_at(F.array(*map(F.lit, CURRENCIES)), F.col("n_regionkey") + 1).alias("currency"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(tenants(spark, sf_dir), F.col("c_nationkey") == F.col("tenant_id"))
    day = F.to_date("o_orderdate")
    status = F.when(F.col("o_orderstatus") == "P", "pending_review").when(F.col("o_orderstatus") == "F", "approved").otherwise("extracted")
    return joined.select(
        "tenant_id", F.col("o_orderkey").alias("invoice_id"), F.concat(F.lit("INV-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).alias("number"), status.alias("status"),
        F.col("o_custkey").alias("customer_id"), lettered(F.col("c_name")).alias("customer"), day.alias("issue_date"), F.date_add(day, 30).alias("due_date"), "currency",
        money(F.col("o_totalprice")).alias("total"), F.col("o_orderpriority").alias("priority"),
    )


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id"),
        money(F.col("l_quantity")).alias("quantity"), money(F.col("l_extendedprice")).alias("net"), F.col("l_tax").cast("decimal(9,4)").alias("tax_rate"), F.to_date("l_shipdate").alias("ship_date"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import of a bank statement per customer: its account, period, balances, currency and status."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    start = F.date_add(F.lit("1995-01-01").cast("date"), (k % 365).cast("int"))
    return c.join(tenants(spark, sf_dir), F.col("c_nationkey") == F.col("tenant_id")).select(
        "tenant_id", k.alias("import_id"), k.alias("account_id"), F.col("tenant_name").alias("bank_name"), F.lpad(k.cast("string"), 10, "0").alias("account_number"), start.alias("period_start"),
        F.when(k % 50 == 0, F.date_sub(start, 1)).otherwise(F.date_add(start, 1000)).alias("period_end"), money(F.col("c_acctbal")).alias("opening_balance"),
        F.when(k % 4 != 0, money(F.col("c_acctbal")) + (k % 100).cast("decimal(18,2)")).cast("decimal(18,2)").alias("closing_balance"), F.when(k % 23 != 0, F.col("currency")).alias("currency"),
        F.when(k % 10 == 9, "failed").otherwise("parsed").alias("status"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inflow per invoice, its amount, day and reference off by rules on the key, and an outflow per odd invoice; one pass over the invoices."""
    k = F.col("invoice_id")
    sides = F.when(k % 2 == 1, F.array(F.lit("inflow"), F.lit("outflow"))).otherwise(F.array(F.lit("inflow")))
    i = invoices(spark, sf_dir).withColumn("direction", F.explode(sides))
    into = F.col("direction") == "inflow"
    factor = F.element_at(F.array(*(F.lit(x).cast("decimal(4,3)") for x in ("1.000", "1.005", "1.030", "1.120"))), (k % 4 + 1).cast("int"))
    amount = F.when(into, (F.col("total") * factor).cast("decimal(18,2)")).otherwise((-F.col("total") / 2).cast("decimal(18,2)"))
    reference = F.when(into & (k % 3 == 0), F.col("number")).when(into & (k % 3 == 1), F.replace(F.col("number"), F.lit("-"), F.lit("")))
    kind = F.element_at(F.array(*map(F.lit, ("CLOUD HOSTING", "OFFICE RENT", "PAYROLL RUN", "BANK FEE", "GOOGLE ADS", "MISC"))), (k % 6 + 1).cast("int"))
    posted = F.when(into, F.date_add("issue_date", (k % 40).cast("int"))).otherwise(F.date_add("issue_date", 15))
    text = F.when(into, F.concat_ws(" ", F.lit("PAYMENT"), reference, F.col("customer"))).otherwise(F.concat(F.lit("ACH PAYMENT "), kind, F.lit(" #"), F.col("number")))
    return i.select(
        "tenant_id", F.concat(F.when(into, "T").otherwise("U"), k.cast("string")).alias("transaction_id"), F.col("customer_id").alias("account_id"), "direction",
        F.when(into & (k % 10 == 9), "pending").otherwise("posted").alias("status"), posted.alias("posted_at"), text.alias("description"), reference.alias("reference"),
        F.when(into & (k % 17 == 0), F.lit(None)).otherwise(F.col("currency")).alias("currency"), amount.alias("amount"), F.date_add(posted, 1).alias("value_at"),
        F.when(into, F.col("customer")).otherwise(kind).alias("counterparty"), F.when(k % 5 != 0, amount + 1000).cast("decimal(18,2)").alias("running_balance"), (k % 97).cast("int").alias("row_index"),
    )


def booked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions as a bank books them: some have a value date alone, some name the invoice beside the counterparty only."""
    k = F.substr("transaction_id", F.lit(2)).cast("bigint")
    number = F.concat(F.lit("INV-"), F.lpad(k.cast("string"), 7, "0"))
    beside = (F.col("direction") == "inflow") & (k % 6 == 2)
    return transactions(spark, sf_dir).withColumns({"posted_at": F.when(k % 11 != 4, F.col("posted_at")), "counterparty": F.when(beside, F.concat_ws(" / ", "counterparty", number)).otherwise(F.col("counterparty"))})


#: The same in SQL.
BOOKED = """booked AS (SELECT * REPLACE (CASE WHEN substr(transaction_id, 2)::BIGINT % 11 <> 4 THEN posted_at END AS posted_at,
  CASE WHEN direction = 'inflow' AND substr(transaction_id, 2)::BIGINT % 6 = 2 THEN counterparty || ' / INV-' || lpad(substr(transaction_id, 2), 7, '0') ELSE counterparty END AS counterparty) FROM transactions)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a log of steps: user_id is the tenant, error a failure, value milliseconds, props.k the attempt."""
    return steps_of(table(spark, sf_dir, "events"))


def steps_of(e: DataFrame) -> DataFrame:
    """The same of an event table or stream."""
    attempt = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", "ts", (F.col("user_id") % 25).alias("tenant_id"), "user_id", F.col("event_type").alias("agent"), (F.col("event_type") == "error").alias("failed"), F.col("value").alias("ms"), attempt.alias("attempt"))


def nine(c: Column) -> Column:
    """A key as a tax id."""
    return F.lpad(c.cast("string"), 9, "1")


def unit_price(net: Column, quantity: Column) -> Column:
    return F.when(quantity > 0, (net / quantity).cast("decimal(18,2)")).otherwise(net)


def invoice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: each invoice as a printed page, with the labels and layouts that the field rules read; rows of items begin with the quantity, or end with marked amounts."""
    item = F.struct("line_number", "part_id", "quantity", "net")
    sums = invoice_lines(spark, sf_dir).groupBy(F.col("invoice_id").alias("doc_id")).agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum("net").alias("net_sum"))
    j = invoices(spark, sf_dir).join(tenants(spark, sf_dir).select("tenant_id", "tenant_name"), "tenant_id").join(sums, F.col("invoice_id") == F.col("doc_id"), "left").drop("doc_id")
    shown = lambda v: F.format_number(v, 2)

    def printed(x: Column) -> Column:
        q, name, unit, net = x["quantity"].cast("string"), F.concat(F.lit("Part "), x["part_id"].cast("string")), shown(unit_price(x["net"], x["quantity"])), shown(x["net"])
        return F.when(x["line_number"] % 2 == 1, F.concat_ws(" ", q, name, unit, net)).otherwise(F.concat(name, F.lit(" "), q, F.lit(" pcs $"), unit, F.lit(" $"), net))

    text = F.concat_ws(
        "\n", F.concat(lettered(F.col("tenant_name")), F.lit(" TRADING LTD")), F.concat(F.lit("NIF: "), nine(F.col("tenant_id"))), F.concat(F.lit("Invoice No: "), F.col("number")), F.lit("Invoice Date"), F.col("issue_date").cast("string"),
        F.when(F.col("invoice_id") % 4 == 0, "Payment is due in 30 days").otherwise(F.concat(F.lit("Due Date: "), F.date_format("due_date", "dd/MM/yyyy"))), F.lit("Bill To"), F.col("customer"), F.concat(F.lit("Contribuinte: "), nine(F.col("customer_id"))),
        F.lit("QTY Description Unit Price Amount"), F.array_join(F.transform("items", printed), "\n"), F.concat(F.lit("Subtotal: "), shown(F.col("net_sum"))), F.concat(F.lit("Total ("), F.col("currency"), F.lit("): "), shown(F.col("total"))),
    )
    return dealt(j.select(F.col("invoice_id").alias("doc_id"), text.alias("text")))


def dealt(texts: DataFrame) -> DataFrame:
    """Rendered texts in even parts: to read them costs more than their size tells, by which small parts would be put together."""
    return texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def invoice_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: each invoice in one of four layouts: plain, scanned with a cell a line, Portuguese with a VAT table, and the slip of a card terminal."""
    j = invoices(spark, sf_dir).join(tenants(spark, sf_dir).select("tenant_id", "tenant_name"), "tenant_id")
    k, tenant = F.col("invoice_id"), lettered(F.col("tenant_name"))
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    page = lambda *rows: F.concat_ws("\n", *(F.lit(r) if isinstance(r, str) else r for r in rows))
    total, tax = F.col("total"), (F.col("total") / 10).cast("decimal(18,2)")
    net = (total - tax).cast("decimal(18,2)")
    day = lambda c, f: F.date_format(c, f)
    plain = page(
        text(tenant, " Inc."), "77 Hill St,", "INVOICE", "Bill To", F.col("customer"), text("Invoice # ", F.col("number")), text("Invoice date ", day("issue_date", "yyyy/MM/dd")), text("Due date ", day("due_date", "yyyy/MM/dd")), "QTY Description Unit Price Amount", text("1.00 Part ", k, " ", net, " ", net),
        text("Subtotal $", net), text("Sales Tax (10%) $", tax), text("Total (USD) $", total),
    )
    split = page(text(tenant, " Inc."), "INVOICE", "Bill To", F.col("customer"), "Invoice#", F.col("number"), "Invoice date", F.col("issue_date").cast("string"), "Due date", F.col("due_date").cast("string"), "QTY Description", "Unit Price", "Amount", "1.00 Repair work", net.cast("string"), net.cast("string"), "Subtotal", text("$", net), "Total (USD)", text("$", total))
    table = page(
        text(tenant, " LDA."), text("NIF: ", nine(F.col("tenant_id"))), text("Data: ", day("issue_date", "dd.MM.yyyy")), text("Cliente: ", F.col("customer")), text("Contribuinte: ", nine(F.col("customer_id"))), text("FATURA-RECIBO N. FR MNV", k % 1000, "/", k), "Resumo do IVA", "Taxa", "Incidência", "Imposto", "Total", "10.00%",
        net.cast("string"), tax.cast("string"), total.cast("string"), text("Total Documento: ", F.translate(total.cast("string"), ".", ","), " EUR"),
    )
    slip = page(tenant, "Pago:EUR", total.cast("string"), text("TPA:", F.lpad(k.cast("string"), 8, "0")))
    return dealt(j.select(k.alias("doc_id"), F.element_at(F.array(plain, split, table, slip), (k % 4 + 1).cast("int")).alias("text")))


CTE = """
tenants AS (SELECT n_nationkey AS tenant_id, n_name AS tenant_name, ['USD','EUR','GBP','JPY','SGD'][n_regionkey + 1] AS currency FROM nation),
invoices AS (SELECT tenant_id, o_orderkey AS invoice_id, 'INV-' || lpad(o_orderkey::VARCHAR, 7, '0') AS number,
  CASE o_orderstatus WHEN 'P' THEN 'pending_review' WHEN 'F' THEN 'approved' ELSE 'extracted' END AS status, o_custkey AS customer_id, translate(c_name, '0123456789#', 'ABCDEFGHIJ ') AS customer,
  o_orderdate::DATE AS issue_date, o_orderdate::DATE + 30 AS due_date, currency, o_totalprice::DECIMAL(18,2) AS total, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN tenants ON c_nationkey = tenant_id),
lines AS (SELECT l_orderkey AS invoice_id, l_linenumber AS line_number, l_partkey AS part_id, l_suppkey AS supplier_id, l_quantity::DECIMAL(18,2) AS quantity,
  l_extendedprice::DECIMAL(18,2) AS net, l_tax::DECIMAL(9,4) AS tax_rate, l_shipdate::DATE AS ship_date FROM lineitem),
inflows AS (SELECT tenant_id, 'T' || invoice_id AS transaction_id, customer_id AS account_id, 'inflow' AS direction, CASE WHEN invoice_id % 10 = 9 THEN 'pending' ELSE 'posted' END AS status,
  issue_date + (invoice_id % 40)::INT AS posted_at, CASE invoice_id % 3 WHEN 0 THEN number WHEN 1 THEN replace(number, '-', '') END AS reference, customer,
  CASE WHEN invoice_id % 17 = 0 THEN NULL ELSE currency END AS currency, (total * [1.000, 1.005, 1.030, 1.120][invoice_id % 4 + 1]::DECIMAL(4,3))::DECIMAL(18,2) AS amount FROM invoices),
transactions AS (SELECT *, posted_at + 1 AS value_at, CASE WHEN direction = 'inflow' THEN party ELSE split_part(substr(description, 13), ' #', 1) END AS counterparty,
  CASE WHEN k % 5 <> 0 THEN (amount + 1000)::DECIMAL(18,2) END AS running_balance, (k % 97)::INT AS row_index FROM (
  SELECT tenant_id, transaction_id, account_id, direction, status, posted_at, concat_ws(' ', 'PAYMENT', reference, customer) AS description, reference, currency, amount, customer AS party, substr(transaction_id, 2)::BIGINT AS k FROM inflows
  UNION ALL SELECT tenant_id, 'U' || invoice_id, customer_id, 'outflow', 'posted', issue_date + 15,
  'ACH PAYMENT ' || ['CLOUD HOSTING','OFFICE RENT','PAYROLL RUN','BANK FEE','GOOGLE ADS','MISC'][invoice_id % 6 + 1] || ' #' || number, NULL, currency,
  (-(total::DECIMAL(30,3) * 0.5))::DECIMAL(18,2), NULL, invoice_id FROM invoices WHERE invoice_id % 2 = 1)),
statements AS (SELECT tenant_id, c_custkey AS import_id, c_custkey AS account_id, tenant_name AS bank_name, lpad(c_custkey::VARCHAR, 10, '0') AS account_number, DATE '1995-01-01' + (c_custkey % 365)::INT AS period_start,
  DATE '1995-01-01' + (c_custkey % 365)::INT + CASE WHEN c_custkey % 50 = 0 THEN -1 ELSE 1000 END AS period_end, c_acctbal::DECIMAL(18,2) AS opening_balance,
  CASE WHEN c_custkey % 4 <> 0 THEN (c_acctbal::DECIMAL(18,2) + c_custkey % 100)::DECIMAL(18,2) END AS closing_balance, CASE WHEN c_custkey % 23 <> 0 THEN currency END AS currency,
  CASE WHEN c_custkey % 10 = 9 THEN 'failed' ELSE 'parsed' END AS status FROM customer JOIN tenants ON c_nationkey = tenant_id),
steps AS (SELECT event_id, ts, user_id % 25 AS tenant_id, user_id, event_type AS agent, event_type = 'error' AS failed, value AS ms, (props->>'$.k')::INT AS attempt FROM events)
"""


def oracle(sql: str) -> str:
    return f"WITH {CTE.strip()}\n{sql}"
