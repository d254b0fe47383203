"""Rules on what invoices, lines and payloads of the tables look like when they are printed, scanned or given by a model; the SQL restates each from the table's own values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import documents, validate
from tallyforge.plans.catalog import projection, query
from tallyforge.plans.parsing import LAID, of
from tallyforge.sources import payloads
from tallyforge.sources import views as V

c, inv, tx, lines, k = F.col, V.invoices, V.transactions, V.invoice_lines, "invoice_id"
text = lambda x: x.cast("string")

projection(
    "scl_21_lines", lines,
    """SELECT invoice_id, line_number, part_id, net, quantity::DECIMAL(18,2) AS printed, (((200 * n + u) // (2 * u))::DECIMAL(18,2) * 0.01::DECIMAL(3,2))::DECIMAL(18,2) AS worked_out
       FROM (SELECT *, (net * 100)::HUGEINT AS n, 100 * (1 + part_id % 37)::HUGEINT AS u FROM lines)""",
    lambda: [
        k, "line_number", "part_id",
        # with marks, with a sign, or as bare digits, which are cents
        S.money_token(F.when(c("line_number") % 3 == 0, F.concat(F.lit("$"), F.format_number("net", 2))).when(c("line_number") % 3 == 1, F.translate(text(c("net")), ".", "")).otherwise(text(c("net")))).alias("net"),
        S.quantity_token(F.when(c("line_number") % 2 == 0, F.translate(text(c("quantity")), ".", "")).otherwise(text(c("quantity"))), F.lit(None).cast("decimal(18,2)"), c("net")).alias("printed"),
        S.quantity_token(text(c("quantity")), (c("part_id") % 37 + 1).cast("decimal(18,2)"), c("net")).alias("worked_out"),
    ],
)

SWAPPED = "CASE WHEN day(issue_date) <= 12 THEN make_date(year(issue_date), day(issue_date), month(issue_date)) ELSE issue_date END"
CENTURY = "make_date(2000 + year(issue_date) % 100, month(issue_date), day(issue_date))"
projection(
    "scl_27_dates", inv,
    f"""SELECT invoice_id, CASE m WHEN 1 THEN {CENTURY} WHEN 3 THEN {SWAPPED} WHEN 5 THEN NULL ELSE issue_date END AS day_first, CASE m WHEN 1 THEN {CENTURY} WHEN 2 THEN {SWAPPED} WHEN 5 THEN NULL ELSE issue_date END AS month_first FROM (SELECT *, invoice_id % 6 AS m FROM invoices)""",
    lambda: (lambda printed: [k, S.day(printed, True).alias("day_first"), S.day(printed, False).alias("month_first")])(
        of(k, text(c("issue_date")), F.date_format("issue_date", "dd/MM/yy"), F.date_format("issue_date", "dd/MM/yyyy"), F.date_format("issue_date", "MM/dd/yyyy"), F.date_format("issue_date", " yyyy.M.d "), F.date_format("issue_date", "31-02-yyyy"))
    ),
)
projection(
    "scl_32_evidence", inv,
    f"""SELECT invoice_id, 'faturainv' || lpad(invoice_id::VARCHAR, 7, '0') || strftime(issue_date, '%d%m%Y') || replace(total::VARCHAR, '.', '') || 'eur' AS key, array_to_string(list_sort(list_distinct([issue_date::VARCHAR, ({SWAPPED})::VARCHAR])), ',') AS dates,
        array_to_string(list_transform(list_sort(list_distinct([-invoice_id::DECIMAL(18,2), day(issue_date)::DECIMAL(18,2), month(issue_date)::DECIMAL(18,2), year(issue_date)::DECIMAL(18,2), total])), lambda x: x::VARCHAR), ',') AS amounts FROM invoices""",
    lambda: (lambda line: [
        k, S.alnum(line).alias("key"), F.array_join(F.transform(S.date_keys(line), text), ",").alias("dates"), F.array_join(F.transform(S.amount_keys(line), lambda x: text(x.cast("decimal(18,2)"))), ",").alias("amounts"),
    ])(F.concat(F.lit("Fatura "), "number", F.date_format("issue_date", " (dd/MM/yyyy) "), F.translate(text(c("total")), ".", ","), F.lit(" EUR"))),
)
projection(
    "scl_33_parties", inv,
    """SELECT invoice_id, regexp_replace(lower(customer), '[^a-z0-9]', '', 'g') AS party, invoice_id % 3 <> 2 AS contained, invoice_id % 4 <> 3 AS whole FROM invoices""",
    lambda: [
        k, S.party_key(c("customer")).alias("party"),
        S.contains_party(of(k, F.concat(F.lit("Bill to: "), F.upper("customer"), F.lit(", Rua 1")), F.concat_ws("-", F.lit("To"), F.regexp_replace("customer", " ", " - ")), F.concat(F.lit("Nobody & Co "), F.substring("customer", 1, 4))), c("customer")).alias("contained"),
        S.whole_name(of(k, c("customer"), F.concat("customer", F.lit(" Lda.")), F.concat(F.lit("Casa do "), "customer"), F.concat("customer", F.lit(" Dos ")))).alias("whole"),
    ],
)
projection(
    "scl_41_parts", V.table_of("part"),
    "SELECT p_partkey AS part_id, CASE p_partkey % 3 WHEN 0 THEN trim(p_name) || ' spark plugs' WHEN 1 THEN 'Wheel alignment ' || trim(p_name) || ' (front)' ELSE trim(p_name) || ' per hour' END AS description FROM part",
    lambda: [
        c("p_partkey").alias("part_id"),
        S.line_description(of("p_partkey", F.concat(F.lit(" "), F.trim("p_name"), F.lit(" SPARKPIUGS ")), F.concat(F.lit("Whoo aignment "), F.trim("p_name"), F.lit(" ( front )")), F.concat(F.trim("p_name"), F.lit(" perHour")))).alias("description"),
    ],
)


@query(
    "vl_03_transactions",
    """SELECT transaction_id AS entity_id, 'currency' AS validator, code, 'error' AS severity, 'currency' AS field_path, NULL::VARCHAR AS expected, v AS observed FROM (SELECT transaction_id, v, CASE WHEN v IS NULL OR length(v) <> 3 THEN 'ERR_CURRENCY_INVALID'
        WHEN upper(v) NOT IN ('AUD','CAD','EUR','GBP','JPY','SGD','USD','VND') THEN 'ERR_CURRENCY_UNSUPPORTED' END AS code FROM (SELECT transaction_id, CASE row_index % 5 WHEN 1 THEN lower(currency) WHEN 2 THEN substr(currency, 1, 2) WHEN 3 THEN reverse(currency) ELSE currency END AS v FROM transactions)) WHERE code IS NOT NULL""",
)
def vl_03_transactions(s, d):
    """Currencies of all transactions: missing, cut, of letters in another order, in small letters."""
    v, m = c("currency"), c("row_index") % 5
    rows = tx(s, d).select("transaction_id", F.when(m == 1, F.lower(v)).when(m == 2, F.substring(v, 1, 2)).when(m == 3, F.reverse(v)).otherwise(v).alias("currency"))
    return validate.currencies(rows, "transaction_id")


def model_output(s, d):
    """Each invoice as a model may give it: under our names, under others in groups, or with the parties below one key; amounts as numbers or texts."""
    total, day = c("total"), text(c("issue_date"))
    ours = F.struct(c("number").alias("invoice_number"), c("customer").alias("customer_name"), day.alias("issue_date"), text(c("total")).alias("total_amount"))
    grouped = F.struct(F.struct(c("number").alias("invoiceNo"), day.alias("invoiceDate")).alias("invoiceMetadata"), F.struct(c("customer").alias("name"), V.nine(c("customer_id")).alias("taxId")).alias("client"), F.struct(total.alias("totalAmount")).alias("summary"))
    below = F.struct(F.struct(F.struct(c("customer").alias("name")).alias("billTo")).alias("parties"), F.lit(" ").alias("invoice_number"), c("number"), F.struct(total.cast("double").cast("decimal(18,1)").alias("amountDue")).alias("totals"))
    return inv(s, d).select(k, of(k, F.to_json(ours), F.to_json(grouped), F.to_json(below), F.lit("{}")).alias("payload"))


@query(
    "scl_39_invoices",
    """SELECT invoice_id, CASE WHEN m < 3 THEN number END AS invoice_number, CASE WHEN m < 3 THEN customer END AS customer_name, CASE WHEN m < 2 THEN issue_date::VARCHAR END AS issue_date, CASE WHEN m = 1 THEN lpad(customer_id::VARCHAR, 9, '1') END AS customer_tax_id,
        CASE WHEN m < 2 THEN total::VARCHAR WHEN m = 2 THEN (round(total, 1)::DECIMAL(18,2))::VARCHAR END AS total_amount, CASE WHEN m < 3 THEN 'extracted' ELSE 'placeholder' END AS extraction_status FROM (SELECT *, invoice_id % 4 AS m FROM invoices)""",
)
def scl_39_invoices(s, d):
    """Header and totals out of each invoice's model output, whatever it calls them."""
    return payloads.repaired(model_output(s, d), k).select(k, "invoice_number", "customer_name", "issue_date", "customer_tax_id", "total_amount", "extraction_status")


@query(
    "scl_39_lines",
    """SELECT invoice_id, row_number() OVER (PARTITION BY invoice_id ORDER BY line_number, part_id, quantity, net) AS line_number, 'Part ' || part_id AS description, quantity::VARCHAR AS quantity, net::VARCHAR AS line_total FROM lines""",
)
def scl_39_lines(s, d):
    """Items out of each invoice's model output: its lines as an array under one of four names, with numbers or texts; an invoice's lines are few."""
    name = F.concat(F.lit("Part "), text(c("part_id")))
    items = lines(s, d).groupBy(k).agg(F.array_sort(F.collect_list(F.struct("line_number", "part_id", "quantity", "net", name.alias("name")))).alias("x"))
    made = lambda d_, q, t, as_text: F.transform("x", lambda r: F.struct(r["name"].alias(d_), (text(r["quantity"]) if as_text else r["quantity"]).alias(q), r["net"].alias(t)))
    shapes = [F.struct(made("description", "quantity", "line_total", True).alias("line_items")), F.struct(made("item", "qty", "total", False).alias("lineItems")), F.struct(F.struct(made("service", "qty", "amount", True).alias("rows")).alias("table")), F.struct(made("name", "quantity", "total", False).alias("items"))]
    rows = items.select(k, of(k, *map(F.to_json, shapes)).alias("payload"))
    return payloads.repaired_items(rows, k).select(k, "line_number", "description", "quantity", "line_total")


@query(
    "vl_10_groups",
    """SELECT invoice_id, name AS schema, array_to_string(list_filter(CASE name WHEN 'invoice-metadata-group.v1' THEN [CASE WHEN m = 1 THEN 'invoice_number: not a text' END, CASE WHEN m = 2 THEN 'total: not known' END]
        WHEN 'invoice-table-group.v1' THEN list_concat([CASE WHEN m = 3 THEN 'extraction_status: not allowed' END], list_transform(range(n), lambda i: CASE WHEN m = 4 THEN 'line_items[' || i || '].line_number: below 1' WHEN m = 5 THEN 'line_items[' || i || '].description: not a text' END))
        ELSE [CASE WHEN m = 6 THEN 'confidence: not allowed' END, CASE WHEN m = 1 THEN 'refs: not known' END] END, lambda x: x IS NOT NULL), ',') AS errors
        FROM (SELECT *, invoice_id % 8 AS m FROM invoices) LEFT JOIN (SELECT invoice_id, count(*) AS n FROM lines GROUP BY 1) USING (invoice_id), (VALUES ('invoice-metadata-group.v1'), ('invoice-table-group.v1'), ('invoice-totals-group.v1')) v(name)""",
)
def vl_10_groups(s, d):
    """Three groups of each invoice's extraction against the contracts of their schemas, items included: fields of another kind, values not allowed, names not known."""
    m = c(k) % 8
    item = F.struct(F.when(m == 4, 0).otherwise(c("line_number")).alias("line_number"), F.when(m != 5, F.concat(F.lit("Part "), text(c("part_id")))).alias("description"), F.when(m == 5, F.array(c("part_id"))).alias("parts"), text(c("net")).alias("line_total"))
    items = lines(s, d).groupBy(k).agg(F.collect_list(item).alias("line_items"))
    j = inv(s, d).join(items, k, "left")
    # fields of another kind are made under another name
    header = F.struct(F.when(m != 1, c("number")).alias("invoice_number"), F.when(m == 1, F.array("number")).alias("numbers"), c("customer").alias("customer_name"), F.when(m == 2, text(c("total"))).alias("total"), F.lit("high").alias("confidence"))
    table = F.struct(F.when(m == 3, "done").otherwise("extracted").alias("extraction_status"), "line_items")
    totals = F.struct(text(c("total")).alias("total_amount"), c("currency"), F.when(m == 6, "sure").otherwise("low").alias("confidence"), F.when(m == 1, F.array("number")).alias("refs"))
    named = F.struct(F.lit("invoice-metadata-group.v1").alias("schema"), F.replace(F.to_json(header), F.lit('"numbers"'), F.lit('"invoice_number"')).alias("payload"))
    tabled = F.struct(F.lit("invoice-table-group.v1").alias("schema"), F.replace(F.to_json(table), F.lit('"parts"'), F.lit('"description"')).alias("payload"))
    summed = F.struct(F.lit("invoice-totals-group.v1").alias("schema"), F.to_json(totals).alias("payload"))
    rows = j.select(k, F.inline(F.array(named, tabled, summed)))
    return validate.contract(rows).select(k, "schema", F.array_join("errors", ",").alias("errors"))


#: What the layouts print of seven annotated fields, and whether the rules read it.
FIELDS = {"invoice_number": "number", "company": "supplier", "nif_seller": "supplier_tax_id", "nif_buyer": "customer_tax_id", "date": "issue_date"}


@query(
    "ev_09_layouts",
    f"""SELECT invoice_id, field, coalesce(e = a, e IS NULL AND a IS NULL) AS exact, coalesce(e = a, e IS NULL AND a IS NULL) AS agrees FROM (SELECT invoice_id, v.* FROM {LAID}, LATERAL (VALUES
        ('invoice_number', CASE m WHEN 2 THEN 'FR MNV' || invoice_id % 1000 || '/' || invoice_id WHEN 3 THEN lpad(invoice_id::VARCHAR, 8, '0') ELSE number END, CASE m WHEN 2 THEN 'FR MNV' || invoice_id % 1000 || '/' || invoice_id WHEN 3 THEN lpad(invoice_id::VARCHAR, 8, '0') ELSE number END),
        ('company', tenant_name || [' Inc.', ' Inc.', ' LDA', ''][m + 1], tenant_name || [' Inc.', ' Inc.', ' LDA', ''][m + 1]), ('nif_seller', lpad(tenant_id::VARCHAR, 9, '1'), CASE WHEN m = 2 THEN lpad(tenant_id::VARCHAR, 9, '1') END),
        ('nif_buyer', lpad(customer_id::VARCHAR, 9, '1'), CASE WHEN m = 2 THEN lpad(customer_id::VARCHAR, 9, '1') END), ('date', issue_date::VARCHAR, CASE WHEN m < 3 THEN issue_date::VARCHAR END), ('iva_amount', tax::VARCHAR, CASE WHEN m < 3 THEN tax::VARCHAR END), ('total', total::VARCHAR, total::VARCHAR)) v(field, e, a))""",
)
def ev_09_layouts(s, d):
    """Seven fields of each invoice against what the rules read from its page: equal as texts, and equal as what each field means."""
    pages = V.invoice_layouts(s, d)
    found = documents.header_and_totals(pages, list(FIELDS.values()))
    read = found.select(c("doc_id").alias(k), *(text(c(n)).alias(f"a_{f}") for f, n in FIELDS.items()), text(c("tax")).alias("a_iva_amount"), text(c("total")).alias("a_total"))
    m = c(k) % 4
    number = F.when(m == 2, F.concat(F.lit("FR MNV"), text(c(k) % 1000), F.lit("/"), text(c(k)))).when(m == 3, F.lpad(text(c(k)), 8, "0")).otherwise(c("number"))
    company = F.concat(V.lettered(c("tenant_name")), of(k, *map(F.lit, (" Inc.", " Inc.", " LDA", ""))))
    known = {"invoice_number": number, "company": company, "nif_seller": V.nine(c("tenant_id")), "nif_buyer": V.nine(c("customer_id")), "date": text(c("issue_date")), "iva_amount": text((c("total") / 10).cast("decimal(18,2)")), "total": text(c("total"))}
    rows = inv(s, d).join(V.tenants(s, d).select("tenant_id", "tenant_name"), "tenant_id").select(k, *(v.alias(f"e_{f}") for f, v in known.items())).join(read, k)
    each = rows.select(k, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), c(f"e_{f}").alias("e"), c(f"a_{f}").alias("a")) for f in known))))
    kind = lambda *names: c("field").isin(*names)
    rule = lambda v: F.when(kind("invoice_number", "company"), S.alnum(v)).when(kind("nif_seller", "nif_buyer"), S.identifier(v)).when(kind("date"), text(S.scored_date(v))).otherwise(text(S.scored_amount(v)))
    return each.select(k, "field", c("e").eqNullSafe(c("a")).alias("exact"), rule(c("e")).eqNullSafe(rule(c("a"))).alias("agrees"))
