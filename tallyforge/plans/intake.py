"""Queries on sources: statement files, payloads, intake, stores, label corpora, incremental flows, reports and erasure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import opslog, reconcile
from tallyforge.plans import registry as R
from tallyforge.plans.catalog import ORACLES, QUERIES, query
from tallyforge.sources import payloads, statements, store
from tallyforge.sources import views as V
from tallyforge.streaming import alerts, ingest

c, inv, tx, lines, stm, steps, docs, k = F.col, V.invoices, V.transactions, V.invoice_lines, V.statements, V.steps, V.table_of("documents"), "invoice_id"


def of(key: str, *columns):
    return F.element_at(F.array(*columns), (c(key) % len(columns) + 1).cast("int"))


# statements: a file per account, as its bank would print it
def by_account(s, d, line) -> DataFrame:
    """account_id, body: the lines of an account's transactions in the order of their ids; a statement is what one account has."""
    return tx(s, d).groupBy("account_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("transaction_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))


ROW = "row_index"


def printed(s, d) -> DataFrame:
    """file, text: statements with a preamble, and Debit and Credit columns; some rows lack a description, some both amounts."""
    text = F.when(c(ROW) % 13 != 0, c("description")).otherwise("")
    amount = F.concat(F.lit('"'), F.format_number(F.abs("amount"), 2), F.lit('"'))
    debit, credit = F.when((c("direction") == "outflow") & (c(ROW) % 11 != 0), amount).otherwise(""), F.when((c("direction") == "inflow") & (c(ROW) % 11 != 0), amount).otherwise("")
    day = F.when(c(ROW) % 3 == 0, c("posted_at").cast("string")).when((c(ROW) % 3 == 1) & (F.dayofmonth("posted_at") > 12), F.date_format("posted_at", "dd/MM/yyyy")).otherwise(F.date_format("posted_at", "M/d/yyyy"))
    line = F.concat_ws(",", day, F.concat(F.lit('"'), text, F.lit('"')), debit, credit, F.coalesce(c("running_balance").cast("string"), F.lit("")))
    j = stm(s, d).join(by_account(s, d, line), "account_id")
    period = F.concat(F.date_format("period_start", "M/d/yyyy"), F.lit(" to "), F.date_format("period_end", "M/d/yyyy"))
    head = F.concat(F.lit("Bank Name,"), "bank_name", F.lit("\nAccount Number,"), "account_number", F.lit('\nStatement Period,"'), period, F.lit('"\n\nDATE,Description,Debit,Credit,Balance\n'))
    return j.select(c("account_id").cast("string").alias("file"), F.concat(F.when(c("account_id") % 2 == 0, "﻿").otherwise(""), head, "body").alias("text"))


FOUND = r"nullif(regexp_extract(replace(rest, '#', ' '), '(?:^|\s)(\S*-\S*[0-9]\S*|\S*[0-9]\S*-\S*)(?:\s|$)', 1), '')"
SRC_01 = f"""SELECT file, row_number, posted_at, description, amount, direction, found AS reference, CASE WHEN found IS NULL THEN nullif(rest, '') ELSE nullif(trim(replace(rest, found, '')), '') END AS counterparty, running_balance FROM (SELECT *, {FOUND} AS found FROM (
 SELECT account_id::VARCHAR AS file, row_number() OVER (PARTITION BY account_id ORDER BY transaction_id) - 1 AS row_number, posted_at, description, amount, direction, running_balance, row_index, trim(regexp_replace(description, '^(ACH PAYMENT|PAYMENT) ', '')) AS rest
 FROM transactions)) WHERE row_index % 13 <> 0 AND row_index % 11 <> 0"""


@query("src_01", SRC_01)
def src_01(s, d):
    """Statement files with a preamble: rows without a description or an amount go."""
    return statements.debit_credit(printed(s, d)).select("file", "row_number", "posted_at", "description", "amount", "direction", "reference", "counterparty", "running_balance")


@query("src_02", "SELECT account_id::VARCHAR AS file, bank_name, account_number, period_start, period_end, 'USD' AS currency FROM statements WHERE account_id IN (SELECT account_id FROM transactions)")
def src_02(s, d):
    """What stands above the heading; a currency isn't read from it, so it is the default."""
    p = statements.preamble(printed(s, d))
    return p.select("file", F.try_element_at("details", F.lit("Bank Name")).alias("bank_name"), F.try_element_at("details", F.lit("Account Number")).alias("account_number"), "period_start", "period_end", F.lit("USD").alias("currency"))


NORMAL = "SELECT account_id::VARCHAR AS file, posted_at, value_at, direction, description, counterparty, reference, CASE WHEN row_index % 7 <> 0 THEN currency END AS currency, CASE WHEN row_index % 5 <> 0 THEN amount END AS amount, running_balance FROM transactions"


@query("src_03", f"SELECT *, concat_ws(',', CASE WHEN amount IS NULL THEN 'amount' END, CASE WHEN currency IS NULL THEN 'currency' END) AS lacks FROM ({NORMAL})")
def src_03(s, d):
    """Statement files with one amount column, in another order than ours: whole rows, and those in quarantine with what they lack."""
    cell = lambda x: F.coalesce(F.concat(F.lit('"'), x, F.lit('"')), F.lit(""))
    amount = F.when(c(ROW) % 5 != 0, F.format_number("amount", 2)).otherwise("n/a")
    line = F.concat_ws(",", cell(amount), cell(F.when(c(ROW) % 7 != 0, c("currency"))), cell(c("description")), c("posted_at").cast("string"), c("value_at").cast("string"), c("direction"), cell(c("counterparty")), cell(c("reference")), F.coalesce(c("running_balance").cast("string"), F.lit("")))
    head = "Amount,currency,description,posted_at,value_at,direction,counterparty,reference,running_balance\n"
    files = by_account(s, d, line).select(c("account_id").cast("string").alias("file"), F.concat(F.lit(head), "body").alias("text"))
    good, bad = statements.normalized(files)
    return good.withColumn("lacks", F.lit("")).unionByName(bad.withColumn("lacks", F.array_join("lacks", ","))).drop("row_number")


@query(
    "src_04",
    """SELECT account_id::VARCHAR AS file, bank_name AS institution_name, s.currency AS account_currency, sha256(bank_name || '|' || account_number) AS account_identifier_hash, opening_balance, posted_at, value_at, direction, description, counterparty AS counterparty_name,
       reference, t.currency AS currency, CASE WHEN row_index % 9 <> 0 THEN amount END AS amount, running_balance FROM transactions t JOIN (SELECT account_id, bank_name, account_number, currency, opening_balance FROM statements) s USING (account_id)""",
)
def src_04(s, d):
    """Nested statement JSON; an amount that can't be read is null."""
    one = F.struct(
        "posted_at", "value_at", "direction", c("description").alias("raw_description"), c("counterparty").alias("counterparty_name"), "reference", "currency", F.when(c(ROW) % 9 != 0, F.format_number("amount", 2)).otherwise("?").alias("amount"), c("running_balance").cast("string").alias("running_balance")
    )
    body = tx(s, d).groupBy("account_id").agg(F.collect_list(one).alias("transactions"))
    j = stm(s, d).join(body, "account_id")
    account = F.struct(c("bank_name").alias("institution_name"), "currency", F.sha2(F.concat_ws("|", "bank_name", "account_number"), 256).alias("account_identifier_hash"))
    text = F.to_json(F.struct(account.alias("bank_account"), F.struct(F.lit("x.json").alias("source_filename"), c("opening_balance").cast("string").alias("opening_balance")).alias("statement_import"), "transactions"))
    return statements.nested(j.select(c("account_id").cast("string").alias("file"), text.alias("text"))).drop("source", "row_number")


# invoice payloads
def invoice_payloads(s, d) -> DataFrame:
    """Extraction payloads as JSON; every ninth is cut short, every seventh has no table, every fifth no currency in its totals."""
    item = F.struct(
        "line_number", F.concat(F.lit("Part "), c("part_id").cast("string")).alias("description"), c("quantity").cast("string").alias("quantity"), F.when(c("part_id") % 4 == 0, "n/a").otherwise(c("net").cast("string")).alias("unit_price"),
        c("net").cast("string").alias("line_total"), F.lit("high").alias("confidence"), F.array(F.concat(F.lit("ocr:block:"), c("line_number").cast("string"))).alias("evidence_refs"),
    )
    items = lines(s, d).groupBy(k).agg(F.array_sort(F.collect_list(item)).alias("line_items"))
    j = inv(s, d).join(items, k, "left")
    head = F.struct(c("number").alias("invoice_number"), c("customer").alias("customer_name"), c("issue_date").cast("string").alias("issue_date"), "currency", F.lit("extracted").alias("extraction_status"), F.lit("medium").alias("confidence"), F.array(F.lit("ocr:block:1")).alias("evidence_refs"))
    sums = F.struct(c("total").cast("string").alias("total_amount"), F.when(c(k) % 5 != 0, F.lower("currency")).alias("currency"), F.when(c(k) % 3 == 0, "partial").otherwise("extracted").alias("extraction_status"))
    whole = F.to_json(F.struct(head.alias("metadata"), F.when(c(k) % 7 != 0, F.struct("line_items", F.lit("extracted").alias("extraction_status"))).alias("table"), sums.alias("totals")))
    return j.select(k, F.when(c(k) % 9 == 0, F.expr("'{\"metadata\":'")).otherwise(whole).alias("payload"))


@query(
    "so_02",
    """SELECT invoice_id, CASE WHEN invoice_id % 9 = 0 THEN '' ELSE 'ocr:block:1' || CASE WHEN invoice_id % 7 <> 0 THEN coalesce(',' || r, '') ELSE '' END END AS refs FROM invoices
       LEFT JOIN (SELECT invoice_id, string_agg(DISTINCT 'ocr:block:' || line_number, ',' ORDER BY 'ocr:block:' || line_number) AS r FROM lines WHERE line_number <> 1 GROUP BY 1) USING (invoice_id)""",
)
def so_02(s, d):
    """The references of extraction payloads, wherever they stand, in the order in which they are seen first."""
    return invoice_payloads(s, d).select(k, F.array_join(S.evidence_refs(c("payload")), ",").alias("refs"))


SHOWN = "(SELECT invoice_id, line_number, 'Part ' || part_id AS description, quantity, CASE WHEN part_id % 4 <> 0 THEN net END AS unit_price, net, part_id FROM lines WHERE invoice_id % 7 <> 0 AND invoice_id % 9 <> 0)"


@query("src_05", f"SELECT invoice_id, line_number, description, quantity, unit_price, NULL::DECIMAL(18,2) AS tax_amount, net AS line_total, CASE WHEN net IS NOT NULL THEN 'high' END AS confidence, 'ocr:block:' || line_number AS refs FROM invoices LEFT JOIN {SHOWN} USING (invoice_id)")
def src_05(s, d):
    """Line items of payloads; a payload without a table, or that doesn't parse, keeps one row of nulls."""
    return payloads.invoice_items(invoice_payloads(s, d), k).withColumn("refs", F.array_join("evidence_refs", ",")).drop("evidence_refs")


GOOD = "CASE WHEN invoice_id % 9 <> 0 THEN {} END"


@query(
    "src_05_groups",
    f"""SELECT invoice_id, {GOOD.format('number')} AS invoice_number, {GOOD.format('customer')} AS customer_name, {GOOD.format('issue_date::VARCHAR')} AS issue_date, {GOOD.format('total::VARCHAR')} AS total_amount,
        {GOOD.format("CASE WHEN invoice_id % 5 <> 0 THEN lower(currency) ELSE currency END")} AS currency, {GOOD.format("'extracted'")} AS metadata_extraction_status, CASE WHEN invoice_id % 9 <> 0 AND invoice_id % 7 <> 0 THEN 'extracted' END AS table_extraction_status,
        {GOOD.format("CASE WHEN invoice_id % 3 = 0 THEN 'partial' ELSE 'extracted' END")} AS totals_extraction_status, {GOOD.format("'medium'")} AS metadata_confidence, {GOOD.format("'ocr:block:1'")} AS refs FROM invoices""",
)
def src_05_groups(s, d):
    g = payloads.invoice_groups(invoice_payloads(s, d), k)
    return g.select(k, "invoice_number", "customer_name", "issue_date", "total_amount", "currency", "metadata_extraction_status", "table_extraction_status", "totals_extraction_status", "metadata_confidence", F.array_join("metadata_evidence_refs", ",").alias("refs"))


def prebuilt(s, d) -> DataFrame:
    amount = lambda v, code: F.struct(v.cast("decimal(18,2)").alias("value"), code.alias("code"))
    text = lambda v, sure=0.9: F.struct(v.alias("value"), F.when(c(k) % 6 == 0, 0.5).otherwise(sure).alias("confidence"))
    item = F.struct(F.struct(F.concat(F.lit("Part "), c("part_id").cast("string")).alias("value")).alias("Description"), F.struct(c("quantity").cast("string").alias("value")).alias("Quantity"), amount(c("net"), F.lit("USD")).alias("Amount"))
    items = lines(s, d).groupBy(k).agg(F.array_sort(F.collect_list(F.struct("line_number", "part_id", "quantity", "net", item.alias("x")))).alias("x"))
    j = inv(s, d).join(items, k, "left")
    none = F.lit(None).cast("string")
    body = F.struct(
        text(c("number")).alias("InvoiceId"), text(c("customer")).alias("CustomerName"), text(F.when(c(k) % 5 != 0, c("issue_date").cast("string"))).alias("InvoiceDate"), amount(c("total") + F.when(c(k) % 4 == 0, 1).otherwise(0), F.when(c(k) % 2 == 0, c("currency"))).alias("SubTotal"),
        amount(F.when(c(k) % 3 != 0, c("total")), none).alias("InvoiceTotal"), amount(c("total"), c("currency")).alias("AmountDue"), F.transform("x", lambda x: x["x"]).alias("Items"),
    )
    return j.select(k, F.to_json(body).alias("payload"))


@query(
    "src_09",
    """SELECT invoice_id, number, NULL::VARCHAR AS supplier, NULL::VARCHAR AS supplier_tax_id, customer, NULL::VARCHAR AS customer_tax_id, CASE WHEN invoice_id % 5 <> 0 THEN issue_date::VARCHAR END AS issue_date, NULL::VARCHAR AS due_date,
       (total + CASE WHEN invoice_id % 4 = 0 THEN 1 ELSE 0 END)::DECIMAL(18,2) AS subtotal, NULL::DECIMAL(18,2) AS tax, total, currency, CASE WHEN invoice_id % 6 = 0 THEN 'medium' ELSE 'high' END AS metadata_confidence,
       CASE WHEN invoice_id % 4 = 0 THEN 'low' ELSE 'medium' END AS confidence FROM invoices""",
)
def src_09(s, d):
    return payloads.prebuilt_groups(prebuilt(s, d), k)


@query("src_09_items", "SELECT invoice_id, row_number() OVER (PARTITION BY invoice_id ORDER BY line_number, part_id, quantity, net) AS line_number, 'Part ' || part_id AS description, quantity, NULL::DECIMAL(18,2) AS unit_price, net AS line_total FROM lines")
def src_09_items(s, d):
    return payloads.prebuilt_items(prebuilt(s, d), k)


@query(
    "src_13",
    """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS block_no, line AS content, CASE WHEN m = 1 THEN pos // 10 + 2 ELSE 1 END AS page, CASE WHEN m < 2 OR pos < 5 THEN '0.0,' || pos || '.0' END AS polygon,
       CASE m WHEN 0 THEN NULL WHEN 1 THEN 0.5 ELSE CASE WHEN pos < 5 THEN 0.25 END END AS confidence, CASE m WHEN 1 THEN 0.75 END AS scan_confidence
       FROM (SELECT doc_id, doc_id % 3 AS m, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) WHERE trim(line) <> ''""",
)
def src_13(s, d):
    """Stored scans in three shapes: paragraphs, lines of pages, parallel arrays of which the later are too short."""
    rows, m = docs(s, d).withColumn("l", F.split("text", "\n")), c("doc_id") % 3
    at = lambda i: F.array(F.lit(0.0), i.cast("double"))
    paragraphs = F.when(m == 0, F.transform("l", lambda x, i: F.struct(x.alias("content"), at(i).alias("polygon"))))
    page = lambda p: F.struct((p + 2).alias("page"), F.when(p == 0, 0.75).alias("confidence"), F.transform(F.slice("l", p * 10 + 1, 10), lambda x, i: F.struct(x.alias("content"), at(p * 10 + i).alias("polygon"), F.lit(0.5).alias("confidence"))).alias("lines"))
    pages = F.when(m == 1, F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 10).cast("int")), page))
    texts, first = F.when(m == 2, c("l")), F.when(m == 2, F.slice("l", 1, 5))
    body = F.struct(paragraphs.alias("paragraphs"), pages.alias("pages"), texts.alias("rec_texts"), F.transform(first, lambda x: F.lit(0.25)).alias("rec_scores"), F.transform(first, lambda x, i: at(i)).alias("rec_polys"))
    return payloads.scan_blocks(rows.select("doc_id", F.to_json(body).alias("payload")), "doc_id").withColumn("polygon", F.array_join(F.transform("polygon", lambda x: x.cast("string")), ","))


@query("src_07", "SELECT path, annotation_path FROM (SELECT 'in/' || number || '.pdf' AS path, 'labels/' || number || '.json' AS annotation_path FROM invoices WHERE invoice_id % 2 = 0) ORDER BY path LIMIT 200 OFFSET 10")
def src_07(s, d):
    """Documents with their annotations, sorted, a page of them."""
    files = inv(s, d).select(F.concat(F.lit("in/"), "number", F.lit(".pdf")).alias("path"))
    notes = inv(s, d).where(c(k) % 2 == 0).select(F.concat(F.lit("labels/"), "number", F.lit(".json")).alias("path"))
    return payloads.pairs_by_stem(files, notes).select("path", "annotation_path").orderBy("path").offset(10).limit(200)


NAMES = [("in/Facture no 1.pdf", "Facture_no_1.pdf"), ("..\\_x_.csv", "x_.csv"), ("...", "upload"), ("a b/c%d.png", "c_d.png"), ("", "upload")]
TYPES = ["application/pdf", "Text/CSV; charset=utf-8", "image/png", "application/zip", "text/plain"]


@query(
    "src_08",
    f"""SELECT file_id, tenant_id, {[n for _, n in NAMES]}[file_id % {len(NAMES)} + 1] AS file_name, size, content_hash, CASE WHEN size = 0 THEN 'EMPTY_FILE' WHEN size > 50000 THEN 'FILE_TOO_LARGE' WHEN bad THEN 'UNSUPPORTED_MIME_TYPE'
        WHEN content_hash IN (SELECT sha256(text) FROM documents WHERE doc_id % 40 = 0) OR file_id <> min(CASE WHEN size BETWEEN 1 AND 50000 AND NOT bad THEN file_id END) OVER (PARTITION BY tenant_id, content_hash) THEN 'DUPLICATE' ELSE 'accepted' END AS state
        FROM (SELECT doc_id AS file_id, doc_id % 4 AS tenant_id, content, strlen(content) AS size, sha256(content) AS content_hash, doc_id % {len(TYPES)} = 3 AS bad FROM (SELECT doc_id, CASE WHEN doc_id % 31 = 0 THEN '' ELSE text END AS content FROM documents))""",
)
def src_08(s, d):
    """Intake: empty, too large, of another type, stored before or brought twice by its tenant, else accepted; names are cleaned."""
    rows = docs(s, d).select(c("doc_id").alias("file_id"), (c("doc_id") % 4).alias("tenant_id"), of("doc_id", *(F.lit(n) for n, _ in NAMES)).alias("name"), of("doc_id", *map(F.lit, TYPES)).alias("media_type"), F.when(c("doc_id") % 31 == 0, "").otherwise(c("text")).cast("binary").alias("content"))
    known = docs(s, d).where("doc_id % 40 = 0").select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tenant_id"), F.sha2("text", 256).alias("content_hash"))
    return store.intake(rows, known, 50_000)


@query("src_11", "SELECT invoice_id, tenant_id, total FROM invoices WHERE tenant_id = 3 AND invoice_id % 4 <> 0 UNION ALL SELECT invoice_id, tenant_id, (total + 1)::DECIMAL(18,2) FROM invoices WHERE tenant_id = 3 AND invoice_id % 4 = 0")
def src_11(s, d):
    """Invoices stored by tenant; one tenant's rows are written again with a change; its bucket alone is read."""
    path = store.shared_folder(s, "store")
    i = inv(s, d).select("invoice_id", "tenant_id", "total")
    store.write(i, path)
    bucket = {t for t in range(25) if store.zlib.crc32(str(t).encode()) % store.BUCKETS == store.zlib.crc32(b"3") % store.BUCKETS}
    store.write(i.where(c("tenant_id").isin(sorted(bucket))).withColumn("total", F.when((c("tenant_id") == 3) & (c(k) % 4 == 0), c("total") + 1).otherwise(c("total")).cast("decimal(18,2)")), path)
    return store.read(s, path, 3)


@query(
    "src_06",
    """SELECT 'D' || tenant_id AS dataset_id, 'C' || invoice_id AS case_id, kind, 'labels/' || kind || '/' || invoice_id || '.json' AS label_path, CASE WHEN kind = 'review' AND invoice_id % 5 = 0 THEN 'undeclared' WHEN invoice_id % 7 = 0 THEN 'missing' ELSE 'ready' END AS state,
       CASE WHEN NOT (kind = 'review' AND invoice_id % 5 = 0) AND invoice_id % 7 <> 0 THEN '{"n":' || invoice_id || '}' END AS payload FROM invoices, (VALUES ('extraction'), ('review')) v(kind)""",
)
def src_06(s, d):
    """A label corpus per tenant: manifests, their cases, and the label files they name; a kind that the case doesn't declare, and files that are missing, are told."""
    path = lambda kind: F.concat(F.lit(f"labels/{kind}/"), c(k).cast("string"), F.lit(".json"))
    tags = F.when(c(k) % 5 == 0, F.array(F.lit("extraction"))).otherwise(F.array(F.lit("extraction"), F.lit("review")))
    case = F.struct(F.concat(F.lit("C"), c(k).cast("string")).alias("case_id"), F.lit("invoice").alias("document_type"), tags.alias("task_tags"), F.create_map(F.lit("extraction"), path("extraction"), F.lit("review"), path("review")).alias("label_paths"))
    part = F.pmod(F.xxhash64(k), F.lit(64))  # manifests of some hundred cases
    manifests = inv(s, d).groupBy("tenant_id", part).agg(F.to_json(F.struct(F.concat(F.lit("D"), F.first("tenant_id").cast("string")).alias("dataset_id"), F.collect_list(case).alias("cases"))).alias("text"))
    files = inv(s, d).where(c(k) % 7 != 0).select(F.explode(F.array(path("extraction"), path("review"))).alias("path"), F.to_json(F.struct(c(k).alias("n"))).alias("text"))
    return store.labels(store.label_cases(manifests), files)


query("src_12", "SELECT '| agent | n | failures |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || agent || ' | ' || n || ' | ' || f || ' |', chr(10) ORDER BY agent) AS report FROM (SELECT agent, count(*) AS n, count(*) FILTER (failed) AS f FROM steps GROUP BY 1)")(
    lambda s, d: payloads.markdown(opslog.rollup(steps(s, d), "agent"), ["agent", "n", "failures"], c("agent"))
)


@query("src_12_json", "SELECT agent, count(*) AS n, count(*) FILTER (failed) AS failures FROM steps GROUP BY 1")
def src_12_json(s, d):
    """A report written as JSON and Markdown to the shared folder, and the JSON read again."""
    path = store.shared_folder(s, "report")
    payloads.write_report(opslog.rollup(steps(s, d), "agent"), ["agent", "n", "failures"], c("agent"), path)
    return s.read.schema("agent string, n bigint, failures bigint").json(f"{path}/json")


TABLES = ["invoices", "transactions", "statements", "steps"]


@query("src_14", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) FILTER (tenant_id = 3) AS n_erased, count(*) FILTER (tenant_id <> 3) AS n_left FROM {t}" for t in TABLES))
def src_14(s, d):
    """One tenant's rows go from every table: the receipt, and what is left of each."""
    left, receipt = payloads.erased({"invoices": inv(s, d), "transactions": tx(s, d), "statements": stm(s, d), "steps": steps(s, d)}, F.lit(3))
    rest = None
    for name, t in left.items():
        n = t.agg(F.lit(name).alias("table"), F.count("*").alias("n_left"))
        rest = n if rest is None else rest.unionByName(n)
    return receipt.join(rest, "table")


@query("src_14_store", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) FILTER (tenant_id = 3) AS n_erased, 0::BIGINT AS n_again, 0::BIGINT AS n_in_files, count(*) FILTER (tenant_id <> 3) AS n_left FROM {t}" for t in TABLES))
def src_14_store(s, d):
    """Tables are stored in the shared folder and a tenant is erased from them, twice: the receipt, what a second run finds, what any file still holds, and what is left."""
    out = None
    for name, view in zip(TABLES, (inv, tx, stm, steps), strict=True):
        path = store.shared_folder(s, f"store-{name}")
        store.publish(view(s, d), path)
        store.erase(s, path, 3)
        again = store.erase(s, path, 3)
        erased = store.receipts(s, path).agg(F.coalesce(F.sum("n_erased"), F.lit(0)).alias("n_erased"))
        found = store.stored_anywhere(s, path, 3).agg(F.count("*").alias("n_in_files"))
        left = store.load(s, path).agg(F.lit(name).alias("table"), F.lit(again).cast("bigint").alias("n_again"), F.count("*").alias("n_left"))
        one = left.join(F.broadcast(erased)).join(F.broadcast(found)).select("table", "n_erased", "n_again", "n_in_files", "n_left")
        out = one if out is None else out.unionByName(one)
    return out


# files: statements of some hundred accounts each, written to the shared folder and read by Spark's readers
#: Accounts of a file.
SHARE = 250


def in_files(rows: DataFrame, line, head) -> DataFrame:
    """file, text: the lines of the transactions of each SHARE accounts, by account and id, below a heading."""
    of_file = F.floor(c("account_id") / SHARE)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("account_id", "transaction_id", line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy(of_file.alias("file")).agg(body.alias("body")).select(c("file").cast("string").alias("file"), F.concat(head, F.lit("\n"), "body").alias("text"))


FILE_ROWS = SRC_01.replace("account_id::VARCHAR AS file", f"(account_id // {SHARE})::VARCHAR AS file").replace("PARTITION BY account_id ORDER BY transaction_id", f"PARTITION BY account_id // {SHARE} ORDER BY account_id, transaction_id")


@query("src_01_files", FILE_ROWS)
def src_01_files(s, d):
    """The same statements as text files: each is read whole, under its own name."""
    text = F.when(c(ROW) % 13 != 0, c("description")).otherwise("")
    amount = F.concat(F.lit('"'), F.format_number(F.abs("amount"), 2), F.lit('"'))
    side = lambda of: F.when((c("direction") == of) & (c(ROW) % 11 != 0), amount).otherwise("")
    line = F.concat_ws(",", c("posted_at").cast("string"), F.concat(F.lit('"'), text, F.lit('"')), side("outflow"), side("inflow"), F.coalesce(c("running_balance").cast("string"), F.lit("")))
    path = store.shared_folder(s, "statements")
    statements.render(in_files(tx(s, d), line, F.lit("Bank Name,Harbour\n\nDate,Description,Debit,Credit,Balance")), path)
    rows = statements.debit_credit(statements.read(s, path)).withColumn("file", statements.name_of(c("file")))
    return rows.select("file", "row_number", "posted_at", "description", "amount", "direction", "reference", "counterparty", "running_balance")


NORMAL_COLUMNS = ["amount", "currency", "description", "posted_at", "value_at", "direction", "counterparty", "reference", "running_balance"]


def normal_line():
    cell = lambda x: F.coalesce(F.concat(F.lit('"'), x, F.lit('"')), F.lit(""))
    amount = F.when(c(ROW) % 5 != 0, F.format_number("amount", 2)).otherwise("n/a")
    day = lambda n: F.coalesce(c(n).cast("string"), F.lit(""))
    return F.concat_ws(",", cell(amount), cell(F.when(c(ROW) % 7 != 0, c("currency"))), cell(c("description")), day("posted_at"), day("value_at"), c("direction"), cell(c("counterparty")), cell(c("reference")), day("running_balance"))


@query(
    "src_03_files",
    f"""SELECT (account_id // {SHARE})::VARCHAR AS file, {', '.join(f'CASE WHEN row_index % 19 <> 0 THEN {x} END AS {n}' for n, x in (('posted_at', 'posted_at'), ('value_at', 'value_at'), ('direction', 'direction'), ('description', 'description'), ('counterparty', 'counterparty'), ('reference', 'reference'),
        ('currency', 'CASE WHEN row_index % 7 <> 0 THEN currency END'), ('amount', 'CASE WHEN row_index % 5 <> 0 THEN amount END'), ('running_balance', 'running_balance')))},
        CASE WHEN row_index % 19 = 0 THEN 'record' ELSE concat_ws(',', CASE WHEN row_index % 5 = 0 THEN 'amount' END, CASE WHEN row_index % 7 = 0 OR currency IS NULL THEN 'currency' END) END AS lacks FROM transactions""",
)
def src_03_files(s, d):
    """Files with one amount column by the CSV reader: whole rows, rows that lack values, and rows with a cell too many."""
    path = store.shared_folder(s, "normalized")
    line = F.concat(normal_line(), F.when(c(ROW) % 19 == 0, ",one,cell,more").otherwise(""))
    statements.render(in_files(tx(s, d), line, F.lit(",".join(NORMAL_COLUMNS))), path)
    rows = statements.normalized_csv(s, path, NORMAL_COLUMNS).withColumns({"file": statements.name_of(c("file")), "lacks": F.array_join("lacks", ",")})
    return rows.drop("broken")


@query(
    "src_04_files",
    f"""SELECT (account_id // {SHARE})::VARCHAR AS file, transaction_id, posted_at, amount, false AS broken FROM transactions WHERE account_id // {SHARE} % 3 <> 1
        UNION ALL SELECT DISTINCT (account_id // {SHARE})::VARCHAR, NULL, NULL::DATE, NULL::DECIMAL(18,2), true FROM transactions WHERE account_id // {SHARE} % 3 = 1""",
)
def src_04_files(s, d):
    """Statements as JSON files of many lines; every third is cut short, and is put aside as a whole."""
    one = F.struct(c("posted_at"), F.lit("x").alias("direction"), c("transaction_id").alias("raw_description"), F.format_number("amount", 2).alias("amount"))
    of_file = F.floor(c("account_id") / SHARE)
    files = tx(s, d).groupBy(of_file.alias("file")).agg(F.to_json(F.struct(F.struct(F.lit("Harbour").alias("institution_name")).alias("bank_account"), F.collect_list(one).alias("transactions"))).alias("text"))
    text = F.replace(c("text"), F.lit("},{"), F.lit("},\n {"))
    path = store.shared_folder(s, "nested")
    statements.render(files.select(c("file").cast("string").alias("file"), F.when(c("file") % 3 == 1, F.substring(text, 1, 100)).otherwise(text).alias("text")), path)
    good, bad = statements.nested_files(s, path)
    none = F.lit(None)
    rows = good.select(statements.name_of(c("file")).alias("file"), c("description").alias("transaction_id"), "posted_at", "amount", F.lit(False).alias("broken"))
    return rows.unionByName(bad.select(statements.name_of(c("file")).alias("file"), none.cast("string").alias("transaction_id"), none.cast("date").alias("posted_at"), none.cast("decimal(18,2)").alias("amount"), F.lit(True).alias("broken")))


@query(
    "src_07_files",
    """SELECT file, sha256(body) AS content_hash, strlen(body) AS size, CASE WHEN file % 2 = 0 THEN 'text/plain' ELSE 'text/csv' END AS media_type FROM (SELECT doc_id // 20 AS file, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS body FROM documents GROUP BY 1)""",
)
def src_07_files(s, d):
    """Documents of twenty as binary files: what an upload is known by (hash, size, media type by its name), from the bytes."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    files = docs(s, d).groupBy(F.floor(c("doc_id") / 20).alias("n")).agg(body.alias("text")).select(F.concat(c("n").cast("string"), F.when(c("n") % 2 == 0, "-txt").otherwise("-csv")).alias("file"), "text")
    path = store.shared_folder(s, "uploads")
    statements.render(files, path)
    return store.uploads(s, path).select(F.regexp_extract("name", r"^(\d+)", 1).cast("bigint").alias("file"), "content_hash", c("size").cast("bigint").alias("size"), "media_type")


# incremental flows
BEST = "SELECT *, count(*) OVER (PARTITION BY invoice_id) AS n, row_number() OVER (PARTITION BY invoice_id ORDER BY score DESC, tid) AS r FROM ({rows})"
OF_BATCH = f"SELECT k.*, sha256(concat_ws('|', k.tenant_id::VARCHAR, t.posted_at::VARCHAR, t.amount::VARCHAR, t.description)) AS tid FROM kept k JOIN booked t USING (transaction_id) WHERE t.posted_at IS NOT NULL AND t.row_index % 5 <> 0 AND t.row_index % 7 <> 0 AND t.currency IS NOT NULL AND t.account_id // {SHARE} % 2 = {{batch}}"


def sm_01(s, d):
    """A stream over statement files that come in two lots, the second with files of the first again: each transaction is stored once, and
    each lot is met with the invoices that have no proposal yet."""
    folder, path = store.shared_folder(s, "intake"), store.shared_folder(s, "drop")
    checkpoint = store.shared_folder(s, "checkpoint")
    share = F.floor(c("account_id") / SHARE)
    body = F.array_join(F.collect_list(normal_line()), "\n")
    files = V.booked(s, d).groupBy("tenant_id", share.alias("share")).agg(F.concat(F.lit(",".join(NORMAL_COLUMNS) + "\n"), body).alias("text"))
    # statements lie in a few folders by tenant, a file each: a folder of its own for each would be listed and moved one by one
    files = files.select((c("share") % 2).alias("lot"), F.concat(F.lit("tenant-"), c("tenant_id").cast("string"), F.lit("-"), (c("share") % 16).cast("string")).alias("file"), "text")
    for lot in (0, 1):
        statements.render(files.where(c("lot") == lot), path, 1)
        if lot:
            statements.render(files.where(c("lot") == 0).withColumn("file", F.concat("file", F.lit("-again"))), path, 1)
        q = ingest.start_proposals(statements.stream(s, path), inv(s, d), folder, checkpoint)
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return s.read.parquet(f"{folder}/proposals").drop("batch_id", "tenant_id")


SM_01 = f"""SELECT invoice_id, tid AS transaction_id, score, n AS n_candidates, CASE WHEN n > 1 OR score < 85 THEN 'pending_review' ELSE 'proposed' END AS status, CASE WHEN score >= 85 THEN 'high' ELSE 'medium' END AS confidence, (abs(amount) - total)::DECIMAL(18,2) AS difference
 FROM (SELECT * FROM ({BEST.format(rows=OF_BATCH.format(batch=0))}) WHERE r = 1 UNION ALL SELECT * FROM ({BEST.format(rows=OF_BATCH.format(batch=1))}) WHERE r = 1 AND invoice_id NOT IN (SELECT invoice_id FROM ({OF_BATCH.format(batch=0)})))"""
QUERIES["sm_01"], ORACLES["sm_01"] = sm_01, R.scored(SM_01)


@query("sm_02", "SELECT sha256(text) AS content_hash, 1 AS n FROM documents GROUP BY text")
def sm_02(s, d):
    """A stream of documents, read twice from its beginning: hashes are stored for good, so that no content is taken in again."""
    folder = store.shared_folder(s, "contents")
    kind = docs(s, d).schema
    # as a pattern, the path may be that of one file
    for _ in range(2):
        stream = s.readStream.schema(kind).parquet(f"{d}/documents.parque[t]").select(F.sha2("text", 256).alias("content_hash"))
        q = ingest.start(stream, folder, store.shared_folder(s, "checkpoint"), ["content_hash"], fresh=False)
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return s.read.parquet(folder).groupBy("content_hash").agg(F.count("*").alias("n"))
