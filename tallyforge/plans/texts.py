"""Further queries on scalar rules, invoice texts, payloads and merged records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import annotated, documents, opslog, scoring
from tallyforge.plans.catalog import projection, query
from tallyforge.sources import payloads
from tallyforge.sources import views as V

c, inv, tx, lines, steps, texts = F.col, V.invoices, V.transactions, V.invoice_lines, V.steps, V.invoice_texts
docs, k = V.table_of("documents"), "invoice_id"


def choose(key: str, *columns):
    return F.element_at(F.array(*columns), (c(key) % len(columns) + 1).cast("int"))


# scalar rules
projection("scl_22", tx, "SELECT transaction_id, CASE direction WHEN 'inflow' THEN amount ELSE trunc(amount) END::DECIMAL(18,2) AS amount FROM transactions", lambda: ["transaction_id", S.scored_amount(F.when(c("direction") == "inflow", F.translate(F.format_number("amount", 2), ",.", ".,")).otherwise(F.concat(F.regexp_extract(c("amount").cast("string"), r"^(-?\d+)", 1), F.lit(",00 EUR")))).alias("amount")])
projection("scl_23", inv, "SELECT invoice_id, regexp_replace(lower(customer), '[^a-z0-9]+', ' ', 'g') || ' fi 2' AS folded FROM invoices", lambda: [k, S.scored_text(F.concat("customer", F.lit(" - ﬁ ²"))).alias("folded")])
projection("scl_25", inv, "SELECT invoice_id, issue_date AS parsed FROM invoices", lambda: [k, S.scored_date(choose(k, *(F.date_format("issue_date", f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy")), F.concat_ws(" ", F.date_format("issue_date", "d"), F.get(F.array(*map(F.lit, S.MONTHS)), F.month("issue_date") - 1), F.date_format("issue_date", "yyyy")))).alias("parsed")])
projection("scl_26", inv, "SELECT invoice_id, number FROM invoices", lambda: [k, S.canonical_number(F.concat(choose(k, *map(F.lit, ("Fatura ", "fatura recibo ", "", "FT "))), "number")).alias("number")])
projection("scl_31", inv, "SELECT invoice_id, CASE WHEN invoice_id % 2 = 0 THEN 5.00::DECIMAL(18,2) END AS tax, invoice_id % 4 <> 3 AS consistent FROM invoices", lambda: [k, S.inferred_tax(c("total") + choose(k, F.lit(-5), F.lit(5)), c("total")).alias("tax"), S.consistent(c("total"), choose(k, *(F.lit(x).cast("decimal(4,2)") for x in ("0.01", "0.02", "0.00", "0.03"))), c("total")).alias("consistent")])
projection("scl_37", steps, "SELECT event_id, greatest(0, ((epoch_us(date_trunc('hour', ts)) + 1800000000 - epoch_us(ts)) + 5) // 10)::DECIMAL(20,0) / 100 AS ms FROM steps", lambda: ["event_id", S.duration_ms(c("ts"), F.date_trunc("hour", "ts") + F.expr("interval 30 minutes")).alias("ms")])
projection("scl_41", lines, "SELECT invoice_id, line_number, part_id, 'spark plugs per hour ' || part_id AS description FROM lines", lambda: [k, "line_number", "part_id", S.line_description(F.concat(F.lit(" SparkPiugs perhour "), c("part_id").cast("string"))).alias("description")])

projection("scl_43", inv, """SELECT invoice_id, '{"before":{"status":"' || status || '"},"after":{"status":"approved","currency":"' || currency || '"}}' AS snapshot FROM invoices""", lambda: [k, F.to_json(F.struct(F.struct("status").alias("before"), F.struct(F.lit("approved").alias("status"), "currency").alias("after"))).alias("snapshot")])

# texts
LABELS = ("Fatura nº ", "Recibo: ", "Bill No: ", "Invoice # ", "No. ")
query("wn_05", "SELECT invoice_id AS doc_id, issue_date::VARCHAR AS value FROM invoices")(lambda s, d: annotated.annotated(texts(s, d), ["issue"]).select("doc_id", annotated.at_label("issue", annotated.first_date).alias("value")))
projection("wn_06", texts, "SELECT invoice_id AS doc_id, lpad(customer_id::VARCHAR, 9, '1') AS value FROM invoices", lambda: ["doc_id", documents.within_lines(documents.lines(c("text")), "(?i)^bill to", r"(?i)^contribuinte\W+(\d{9})$", 3).alias("value")])


@query(
    "wn_09",
    """SELECT invoice_id, array_to_string(x, ',') AS given, array_to_string(o, ',') AS repaired FROM (WITH RECURSIVE r AS (
       SELECT invoice_id, list(line_number ORDER BY part_id, supplier_id, net, line_number) AS x, 0 AS i, []::INT[] AS o, 1::BIGINT AS auto FROM lines GROUP BY 1
       UNION ALL SELECT invoice_id, x, i + 1, list_append(o, (CASE WHEN taken THEN free ELSE x[i + 1] END)::INT), CASE WHEN taken THEN free + 1 ELSE auto END
       FROM (SELECT *, coalesce(x[i + 1] <= 0 OR list_contains(o, x[i + 1]), true) AS taken, list_min(list_filter(range(auto, auto + len(o) + 1), lambda y: NOT list_contains(o, y::INT))) AS free FROM r WHERE i < len(x)))
       SELECT * FROM r WHERE i = len(x))""",
)
def wn_09(s, d):
    """Line numbers of an invoice's lines in part order, repaired; an invoice's lines are few."""
    rows = lines(s, d).groupBy("invoice_id").agg(F.array_sort(F.collect_list(F.struct("part_id", "supplier_id", "net", "line_number"))).alias("x"))
    given = F.transform("x", lambda x: x["line_number"])
    return rows.select("invoice_id", F.array_join(F.transform(given, lambda x: x.cast("string")), ",").alias("given"), F.array_join(F.transform(documents.free_line_numbers(given), lambda x: x.cast("string")), ",").alias("repaired"))


@query("wn_12", "SELECT invoice_id, n AS line, CASE n WHEN 1 THEN total WHEN 3 THEN (total + 1)::DECIMAL(18,2) END AS line_total FROM invoices, (VALUES (1), (2), (3)) v(n)")
def wn_12(s, d):
    """A total that a row without quantity and price copies from the first sound line goes; an invoice's lines are few."""
    none = F.lit(None).cast("decimal(18,2)")
    row = lambda n, q, u, t: F.struct(F.lit(n).alias("line"), q.alias("quantity"), u.alias("unit"), t.cast("decimal(18,2)").alias("line_total"))
    one = F.lit(1).cast("decimal(18,2)")
    rows = inv(s, d).select(k, F.inline(F.array(row(1, one, c("total"), c("total")), row(2, none, none, c("total")), row(3, none, none, c("total") + 1))))
    given = rows.withColumnRenamed("unit", "unit_price")
    return documents.without_copied_totals(given, k, ["line"]).select(k, "line", "line_total")


# sets and merged records
projection("so_04", inv, "SELECT invoice_id, CASE invoice_id % 3 WHEN 0 THEN 'total' WHEN 1 THEN '' ELSE 'number,total' END AS missing FROM invoices", lambda: [k, F.array_join(F.array_except(F.array(*map(F.lit, ("number", "issue_date", "total"))), F.array_compact(F.array(F.when(c(k) % 3 != 2, "number"), F.when(c("issue_date").isNotNull(), "issue_date"), F.when(c(k) % 3 == 1, "total")))), ",").alias("missing")])


@query("so_05", """SELECT invoice_id, number, customer, lpad(tenant_id::VARCHAR, 9, '1') AS supplier_tax_id, CASE WHEN invoice_id % 4 = 1 THEN '000' ELSE lpad(customer_id::VARCHAR, 9, '1') END AS customer_tax_id, 'Model Ltd' AS supplier, currency,
 CASE WHEN invoice_id % 5 = 0 THEN total ELSE 2.00 END::DECIMAL(18,2) AS subtotal, CASE WHEN invoice_id % 2 = 0 THEN 0.50 END::DECIMAL(18,2) AS tax, issue_date, CASE WHEN invoice_id % 2 = 0 THEN due_date END AS due_date, CASE WHEN invoice_id % 3 = 0 THEN total ELSE 1.00::DECIMAL(18,2) END AS total FROM invoices""")
def so_05(s, d):
    """What the rules read and what a model says, field by field."""
    i = inv(s, d)
    rules = F.struct("number", F.lit(None).cast("string").alias("supplier"), "customer", "currency", V.nine(c("tenant_id")).alias("supplier_tax_id"), F.when(c(k) % 4 == 1, " ").otherwise(V.nine(c("customer_id"))).alias("customer_tax_id"),
                     c("total").alias("subtotal"), F.lit(None).cast("decimal(18,2)").alias("tax"), "issue_date", F.when(c(k) % 2 == 0, c("due_date")).alias("due_date"), "total", F.when(c(k) % 3 == 0, "high").otherwise("low").alias("confidence"))
    model = F.struct(F.lit("1542/AT").alias("number"), F.lit("Model Ltd").alias("supplier"), F.lit("?").alias("customer"), F.lit("").alias("currency"), F.lit("12").alias("supplier_tax_id"), F.lit("000").alias("customer_tax_id"),
                     F.when(c(k) % 5 != 0, F.lit("2.00").cast("decimal(18,2)")).alias("subtotal"), F.when(c(k) % 2 == 0, F.lit("0.50").cast("decimal(18,2)")).alias("tax"), c("due_date").alias("issue_date"), c("issue_date").alias("due_date"), F.lit("1.00").cast("decimal(18,2)").alias("total"))
    return i.select(k, rules.alias("rules"), model.alias("model")).select(k, *documents.merged("rules", "model"))


# evaluation
@query("ev_08", "SELECT count(*) AS n, count(*) FILTER (k % 2 = 0) AS n_near, count(*) FILTER (direction = 'inflow') AS n_member, count(*) FILTER (reference IS NULL) AS n_null, count(*) FILTER (amount >= 0) AS n_least FROM (SELECT *, substr(transaction_id, 2)::BIGINT AS k FROM transactions)")
def ev_08(s, d):
    """Check primitives counted over all transactions."""
    off = (c("amount") + F.when(F.substr("transaction_id", F.lit(2)).cast("bigint") % 2 == 0, F.lit("0.01")).otherwise(F.lit("0.02")).cast("decimal(4,2)")).alias("off")
    rows = tx(s, d).withColumn("off", off)
    return rows.agg(F.count("*").alias("n"), F.count_if(scoring.near(c("amount"), c("off"))).alias("n_near"), F.count_if(scoring.member(F.array(F.lit("inflow"), F.lit("fee")), c("direction"))).alias("n_member"), F.count_if(scoring.exact(F.lit(None), c("reference"))).alias("n_null"), F.count_if(scoring.at_least(F.lit(0), c("amount"))).alias("n_least"))


# payloads
@query("src_10", "SELECT doc_id, 'ocr:block:' || row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS block_id, length(line) AS n_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) WHERE trim(line) <> ''")
def src_10(s, d):
    """A block for each line that isn't blank, numbered within its document without a shuffle."""
    rows = docs(s, d).select("doc_id", F.posexplode(F.filter(F.split("text", "\r?\n"), lambda x: F.trim(x) != "")).alias("at", "line"))
    return rows.select("doc_id", F.concat(F.lit("ocr:block:"), (c("at") + 1).cast("string")).alias("block_id"), F.length("line").alias("n_chars"))


@query("jn_14", """SELECT invoice_id AS doc_id, field, CASE WHEN field = 'total' THEN 10 + coalesce(n + 1, 0) WHEN both_ways AND field = 'issue_date' THEN 5 ELSE at_line END AS line_no,
 CASE WHEN both_ways AND field = 'issue_date' THEN 138 ELSE score END AS score FROM (SELECT *, invoice_id % 4 <> 0 AND strftime(due_date, '%Y-%d-%m') = issue_date::VARCHAR AS both_ways FROM invoices) LEFT JOIN (SELECT invoice_id, count(*) AS n FROM lines GROUP BY 1) USING (invoice_id),
 (VALUES ('number', 2, 100), ('customer', 7, 144), ('issue_date', 4, 119), ('total', 0, 110)) f(field, at_line, score)""")
def jn_14(s, d):
    """Invoice fields against the lines of their texts: every line is graded, the best one is the evidence. A printed day that may be read
    either way counts for both dates, so a due date of 05/06 is evidence for an issue date of May 6."""
    known = inv(s, d).select(c(k).alias("doc_id"), "number", "customer", "issue_date", "total")
    return documents.graded_evidence(texts(s, d), known, ["number", "customer", "issue_date", "total"])
