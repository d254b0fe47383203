"""Queries on invoice texts in several layouts, with what each rule has to find in them; evidence, routing, model output, annotations."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyforge.functions import scalars as S
from tallyforge.operators import annotated as A
from tallyforge.operators import documents
from tallyforge.plans.catalog import query, sql_list
from tallyforge.sources import payloads
from tallyforge.sources import views as V

c, inv, texts, lines, k = F.col, V.invoices, V.invoice_texts, V.invoice_lines, "invoice_id"


def of(key: str, *columns):
    return F.element_at(F.array(*columns), (c(key) % len(columns) + 1).cast("int"))


layouts = V.invoice_layouts
#: Numbers as they are printed: the text around an invoice's key, and the number that has to be read (SQL; n is the key).
NUMBERS = [
    (("FACTURA SIMPLIFICADA\nRecibo: FS 0", "/00\nDate 1/2/2024"), "'FS 0' || n || '/00'"), (("FATURA/RECIBO N:\nK", "/77"), "'K' || n || '/77'"), (("Loja\nDoc n: 10000", "\nTerminal:22"), "'10000' || n"), (("FATURA\nORIGINAL\nDATA 18/01/2019\nA/", ""), "'A/' || n"),
    (("Fatura número:\nFT 03/", ""), "'FT 03/' || n"), (("Bill No. 00", " paid in cash"), "'00' || n"), (("Terminal\nA0000000000000", ""), "'A0000000000000' || n"), (("INVOICE\nto whom it concerns\nInvoice # US-000", ""), "'US-000' || n"), (("no digits at all, key of ", ""), "NULL"),
]


@query("ex_03", f"SELECT invoice_id, CASE invoice_id % {len(NUMBERS)} {' '.join(f'WHEN {i} THEN {x}' for i, (_, x) in enumerate(NUMBERS))} END AS number FROM (SELECT *, invoice_id::VARCHAR AS n FROM invoices)")
def ex_03(s, d):
    """Numbers within a line, below a heading, of a terminal, in the text as one line, and none."""
    rows = inv(s, d).select(c(k).alias("doc_id"), of(k, *(F.concat(F.lit(a), c(k).cast("string"), F.lit(b)) for (a, b), _ in NUMBERS)).alias("text"))
    return documents.header(rows).select(c("doc_id").alias(k), "number")


@query("ex_07", "SELECT invoice_id, CASE invoice_id % 4 WHEN 3 THEN NULL WHEN 2 THEN least(total - tax, tax) ELSE tax END::DECIMAL(18,2) AS tax FROM (SELECT *, (total::DECIMAL(30,4) * 0.1)::DECIMAL(18,2) AS tax FROM invoices)")
def ex_07(s, d):
    """VAT tables with and without rates, one that has lost its total (the smallest amount counts), and a text without a table."""
    tax = (c("total") / 10).cast("decimal(18,2)")
    net, total, tax = ((c("total") - tax).cast("decimal(18,2)").cast("string"), c("total").cast("string"), tax.cast("string"))
    shapes = [("Resumo do IVA", "Taxa", "Base", "10,00%", net, tax, total), ("Iliquido", "Tax%", "V.Tax", net, tax, total), ("Summary of VAT", net, tax), ("Paid in full", total)]
    text = of(k, *(F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in shape)) for shape in shapes))
    rows = A.with_totals(A.annotated(inv(s, d).select(c(k).alias("doc_id"), text.alias("text"))))
    return rows.select(c("doc_id").alias(k), c("in_table").alias("tax"))


#: The layouts' invoices as SQL: m is the layout.
LAID = "(SELECT *, invoice_id % 4 AS m, (total::DECIMAL(30,4) * 0.1)::DECIMAL(18,2) AS tax, (total - (total::DECIMAL(30,4) * 0.1)::DECIMAL(18,2))::DECIMAL(18,2) AS net FROM invoices JOIN (SELECT tenant_id, translate(tenant_name, '0123456789#', 'ABCDEFGHIJ ') AS tenant_name FROM tenants) USING (tenant_id))"


@query(
    "ex_02_layouts",
    f"""SELECT invoice_id AS doc_id, CASE m WHEN 2 THEN 'FR MNV' || invoice_id % 1000 || '/' || invoice_id WHEN 3 THEN lpad(invoice_id::VARCHAR, 8, '0') ELSE number END AS number, CASE WHEN m < 3 THEN issue_date END AS issue_date, CASE WHEN m < 2 THEN due_date END AS due_date,
        tenant_name || [' Inc.', ' Inc.', ' LDA', ''][m + 1] AS supplier, CASE WHEN m = 2 THEN lpad(tenant_id::VARCHAR, 9, '1') END AS supplier_tax_id, CASE WHEN m < 2 THEN customer END AS customer, CASE WHEN m = 2 THEN lpad(customer_id::VARCHAR, 9, '1') END AS customer_tax_id,
        CASE WHEN m < 2 THEN 'USD' ELSE 'EUR' END AS currency FROM {LAID}""",
)
def ex_02_layouts(s, d):
    """Header fields of four layouts: labels on the line, on the line before, Portuguese ones, and the slip of a terminal."""
    return documents.header(layouts(s, d))


@query("ex_06_layouts", f"SELECT invoice_id AS doc_id, CASE WHEN m < 2 THEN net END AS subtotal, CASE WHEN m < 3 THEN tax END AS tax, total, 'high' AS confidence FROM {LAID}")
def ex_06_layouts(s, d):
    """Totals that are labelled, left to infer, in a VAT table, or paid."""
    return documents.totals(layouts(s, d))


@query("ex_08_layouts", f"SELECT invoice_id AS doc_id, 1 AS line_number, CASE m WHEN 0 THEN 'Part ' || invoice_id ELSE 'Repair work' END AS description, 1.00::DECIMAL(18,2) AS quantity, net AS unit_price, net AS total FROM {LAID} WHERE m < 2")
def ex_08_layouts(s, d):
    """Items in rows, with a cell a line, or none."""
    return documents.items(layouts(s, d))


def whole(s, d, *names):
    return documents.assembled(layouts(s, d), ("number", *names))


@query("ex_09_layouts", f"SELECT invoice_id AS doc_id, CASE WHEN m < 2 THEN 1 ELSE 0 END AS n_items, CASE WHEN m < 2 THEN '' ELSE 'table' END AS missing, CASE WHEN m < 2 THEN 'extracted' ELSE 'partial' END AS status, CASE WHEN m < 3 THEN net END AS net FROM {LAID}")
def ex_09_layouts(s, d):
    return whole(s, d).select("doc_id", "n_items", "missing", "status", "net")


#: The route of each layout's groups by the rules alone: metadata, table, totals.
SURE = [("deterministic", "deterministic", "deterministic"), ("deterministic", "deterministic", "deterministic"), ("deterministic", "needs_model", "deterministic"), ("needs_model", "needs_model", "deterministic")]


@query(
    "ex_11",
    f"""SELECT doc_id, g AS "group", CASE WHEN route = 'deterministic' AND NOT coalesce(correction, false) THEN route WHEN stored IS NOT NULL AND stored <> 'low' AND NOT correction THEN 'prebuilt' ELSE 'needs_model' END AS route FROM (
        SELECT invoice_id AS doc_id, g, (CASE g WHEN 'metadata' THEN {sql_list(x[0] for x in SURE)} WHEN 'table' THEN {sql_list(x[1] for x in SURE)} ELSE {sql_list(x[2] for x in SURE)} END)[invoice_id % {len(SURE)} + 1] AS route,
        CASE WHEN invoice_id % 3 <> 0 THEN CASE WHEN invoice_id % 5 = 0 THEN 'low' ELSE 'medium' END END AS stored, CASE WHEN invoice_id % 3 <> 0 THEN invoice_id % 7 = 0 END AS correction FROM invoices, (VALUES ('metadata'), ('table'), ('totals')) v(g))""",
)
def ex_11(s, d):
    """Groups that stand on the rules, that a stored result fills (unless it is of low confidence or to be corrected), or that need a model."""
    stored = inv(s, d).where(c(k) % 3 != 0).select(c(k).alias("doc_id"), F.explode(F.array(*map(F.lit, ("metadata", "table", "totals")))).alias("group"), F.when(c(k) % 5 == 0, "low").otherwise("medium").alias("confidence"), (c(k) % 7 == 0).alias("correction"))
    return documents.routing(whole(s, d, "supplier", "issue_date"), stored)


@query("ex_10", "SELECT doc_id, field, value, state FROM (SELECT invoice_id AS doc_id, number, customer, issue_date FROM invoices) i, LATERAL (VALUES ('number', i.number, 'grounded'), ('customer', CASE WHEN doc_id % 5 = 0 THEN 'Nobody Known' ELSE i.customer END, CASE WHEN doc_id % 5 = 0 THEN 'unresolved' ELSE 'grounded' END), ('issue_date', CASE WHEN doc_id % 3 <> 0 THEN i.issue_date::VARCHAR END, 'grounded')) v(field, value, state) WHERE value IS NOT NULL")
def ex_10(s, d):
    """Fields with the line that speaks most for them; names that no line holds are unresolved, fields without a value have no row."""
    known = inv(s, d).select(c(k).alias("doc_id"), "number", F.when(c(k) % 5 == 0, "Nobody Known").otherwise(c("customer")).alias("customer"), F.when(c(k) % 3 != 0, c("issue_date")).alias("issue_date"))
    return documents.field_evidence(texts(s, d), known, ["number", "customer", "issue_date"]).select("doc_id", "field", "value", "state")


@query(
    "wn_11",
    """SELECT invoice_id AS doc_id, line_no, CASE WHEN line_no >= n + 8 AND line_no > n + 10 THEN 'footer' WHEN line_no >= n + 10 THEN 'totals' WHEN line_no >= 9 THEN 'table' WHEN line_no >= 6 THEN 'bill_to' ELSE 'header' END AS region
       FROM (SELECT invoice_id, coalesce(n, 0) AS n FROM invoices LEFT JOIN (SELECT invoice_id, count(*) AS n FROM lines GROUP BY 1) USING (invoice_id)), range(2000) r(line_no) WHERE line_no < n + CASE WHEN n = 0 THEN 11 ELSE 12 END""",
)
def wn_11(s, d):
    """The region of each line: header, bill-to, table, totals after it, and the footer."""
    return documents.regions(texts(s, d))


def expected(rows, names, key="doc_id"):
    columns = ", ".join(f"{sql_list(r[i + 1] for r in rows)}[invoice_id % {len(rows)} + 1] AS {n}" for i, n in enumerate(names))
    return f"SELECT invoice_id AS {key}, {columns} FROM invoices"


#: Model outputs under other names, and number, supplier, customer, date, total and status of each.
OUTPUTS = [
    ('{"invoiceMetadata":{"invoiceNo":"A-1","invoiceDate":"2024-01-02"},"vendor":{"name":"Sol"},"summary":{"total":12.5}}', "A-1", "Sol", None, "2024-01-02", "12.50", "extracted"),
    ('{"invoice_number":" ","number":"B2","parties":{"billTo":{"name":"Mar","taxId":"9"}},"totals":{"totalAmount":"7"}}', "B2", None, "Mar", None, "7.00", "extracted"), ('{"totals":{"amountDue":"about 5"}}', None, None, None, None, "about 5", "placeholder"),
    ("{}", None, None, None, None, None, "placeholder"), ("broken", None, None, None, None, None, "placeholder"), (None, None, None, None, None, None, "placeholder"),
]
SHOWN = ["invoice_number", "supplier_name", "customer_name", "issue_date", "total_amount", "extraction_status"]


def outputs(s, d, given):
    return inv(s, d).select(k, of(k, *(F.lit(p).cast("string") for p in given)).alias("payload"))


@query("scl_39", expected(OUTPUTS, SHOWN, k))
def scl_39(s, d):
    """Model output repaired into our groups by a table of names."""
    return payloads.repaired(outputs(s, d, [p[0] for p in OUTPUTS]), k).select(k, *SHOWN)


MADE = [('{"lineItems":[{"name":"Oak","qty":2,"rate":"3","amount":6},{"service":"Glue"}]}', "1|Oak|2.00|3.00|6.00;2|Glue"), ('{"table":{"rows":[{"item":"Tea","total":"1.5"}]}}', "1|Tea|1.50"), ("{}", ""), (None, "")]


@query("scl_39_items", expected(MADE, ["items"], k))
def scl_39_items(s, d):
    t = outputs(s, d, [p[0] for p in MADE])
    one = F.concat_ws("|", c("line_number").cast("string"), "description", "quantity", "unit_price", "line_total")
    rows = payloads.repaired_items(t, k).groupBy(k).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", one.alias("x")))), lambda r: r["x"]), ";").alias("items"))
    return t.select(k).join(rows, k, "left").select(k, F.coalesce("items", F.lit("")).alias("items"))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


#: Annotated and read values of seven fields, and whether they agree exactly and leniently.
ANNOTATED = {
    "invoice_number": [("FT 12/3", "Fatura FT 12/3", False, True), ("A1", "A1", True, True), ("A1", "A2", False, False)], "company": [("Sol & Mar", "SOL & MAR LDA", False, True), ("Casa Branca", "Casa Brancas", False, True), ("Sol", "Lua", False, False)],
    "nif_seller": [("PT 501 234", "501234", False, True), ("501", "502", False, False), ("501", "501", True, True)], "nif_buyer": [("9", None, False, False), (None, None, True, True), ("9", "9", True, True)], "date": [("3 mai 2024", "2024-05-03", False, True), ("2024-05-03", "03/05/2024", False, True), ("2024-05-03", "2024-05-04", False, False)],
    "iva_amount": [("1.234,50", "1234.50", False, True), ("5", "5.01", False, False), ("5", "5", True, True)], "total": [("10 €", "10.00", False, True), ("10", None, False, False), ("10", "10", True, True)],
}
ROWS = ", ".join(f"({i}, '{f}', {str(x[2]).lower()}, {str(x[3]).lower()})" for f, xs in ANNOTATED.items() for i, x in enumerate(xs))


@query("ev_09", f"SELECT invoice_id, field, exact, lenient FROM invoices JOIN (VALUES {ROWS}) v(i, field, exact, lenient) ON i = invoice_id % 3")
def ev_09(s, d):
    """Seven annotated fields against what was read: equal as texts, and equal by each field's own rule; only names that are neither equal nor
    within one another reach the Python function."""
    three = inv(s, d).select(k, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), of(k, *(F.struct(F.lit(e).cast("string").alias("e"), F.lit(a).cast("string").alias("a")) for e, a, _, _ in xs)).alias("x")) for f, xs in ANNOTATED.items()))).alias("r"))
    rows = three.select(k, "r.field", "r.x.e", "r.x.a")
    kind = lambda *names: c("field").isin(*names)
    rule = lambda v: F.when(kind("invoice_number"), S.scored_text(S.canonical_number(v))).when(kind("nif_seller", "nif_buyer"), S.identifier(v)).when(kind("date"), S.scored_date(v).cast("string")).when(kind("iva_amount", "total"), S.scored_amount(v).cast("string")).otherwise(S.scored_text(v))
    rows = rows.select(k, "field", c("e").eqNullSafe(c("a")).alias("exact"), rule(c("e")).alias("e"), rule(c("a")).alias("a"))
    words = lambda n: F.split(n, " ")
    inside = kind("company") & ((F.size(F.array_except(words("e"), words("a"))) == 0) | (F.size(F.array_except(words("a"), words("e"))) == 0))
    plain = c("e").eqNullSafe(c("a")) | F.coalesce(inside, F.lit(False))
    rows = rows.withColumn("plain", plain)
    open_ = lambda n: F.when(kind("company") & ~c("plain"), c(n))
    return rows.select(k, "field", "exact", (c("plain") | F.coalesce(similarity(open_("e"), open_("a")) >= 0.85, F.lit(False))).alias("lenient"))


@query(
    "ag_08",
    """SELECT doc_id, block // 5 AS region, count(*) AS n_blocks, string_agg(line, chr(10) ORDER BY block) AS text, min(block) AS first_block, max(block) AS last_block, round(avg(CASE WHEN block % 3 <> 0 THEN (block % 10) / 10.0 END), 6) AS confidence
       FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS block FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) WHERE trim(line) <> '') GROUP BY 1, 2""",
)
def ag_08(s, d):
    """The blocks of each region (five blocks here) as one: text in order, first and last block, mean confidence of those that have one."""
    rows = V.table(s, d, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("block", "line"))
    sure = F.when(c("block") % 3 != 0, (c("block") % 10) / 10.0)
    g = rows.groupBy("doc_id", F.floor(c("block") / 5).alias("region")).agg(
        F.count("*").alias("n_blocks"), F.array_sort(F.collect_list(F.struct("block", "line"))).alias("b"), F.min("block").alias("first_block"), F.max("block").alias("last_block"), F.round(F.avg(sure), 6).alias("confidence")
    )
    return g.select("doc_id", "region", "n_blocks", F.array_join(F.transform("b", lambda x: x["line"]), "\n").alias("text"), "first_block", "last_block", "confidence")


@query(
    "wn_07",
    """SELECT doc_id, item, count(*) AS n_lines, string_agg(line, ' ' ORDER BY pos) AS text FROM (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS item FROM (
       SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)) GROUP BY 1, 2""",
)
def wn_07(s, d):
    """Lines that open with no capital are appended to the item before them; a document's lines are one row's."""
    rows = V.table(s, d, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    opens = F.transform("l", lambda x: x.rlike("^[A-Z]"))
    each = rows.withColumn("o", opens).select("doc_id", F.posexplode(F.arrays_zip("l", "o")).alias("pos", "x"))
    item = F.count_if(c("x.o")).over(Window.partitionBy("doc_id").orderBy("pos"))
    g = each.withColumn("item", item).groupBy("doc_id", "item").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("pos", c("x.l").alias("line")))).alias("b"))
    return g.select("doc_id", "item", "n_lines", F.array_join(F.transform("b", lambda x: x["line"]), " ").alias("text"))
