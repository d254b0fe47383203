"""Nested JSON payloads as tables: invoice extractions, scanned pages, prebuilt model results, reports and erasure."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.views import dealt

GROUP = "extraction_status: string, evidence_refs: array<string>, confidence: string"
ITEM = "line_number: int, description: string, quantity: string, unit_price: string, tax_amount: string, line_total: string, confidence: string, evidence_refs: array<string>"
METADATA = ["invoice_number", "supplier_name", "supplier_tax_id", "customer_name", "customer_tax_id", "issue_date", "due_date", "currency"]
TOTALS = ["subtotal_amount", "tax_amount", "total_amount"]
INVOICE = (
    f"metadata struct<{', '.join(f'{n}: string' for n in METADATA)}, {GROUP}>, table struct<line_items: array<struct<{ITEM}>>, {GROUP}>, "
    f"totals struct<{', '.join(f'{n}: string' for n in TOTALS)}, currency: string, {GROUP}>"
)
BLOCK = "content: string, polygon: array<double>, confidence: double"
SCAN = (
    f"paragraphs array<struct<page: int, {BLOCK}>>, pages array<struct<page: int, confidence: double, lines: array<struct<{BLOCK}>>>>, "
    "rec_texts array<string>, rec_scores array<double>, rec_polys array<array<double>>"
)
AMOUNT = "struct<value: decimal(18,2), code: string>"
TEXT = "struct<value: string, confidence: double>"
FIELD = f"struct<Description: {TEXT}, Quantity: {TEXT}, UnitPrice: {AMOUNT}, Tax: {AMOUNT}, Amount: {AMOUNT}>"
PREBUILT = (
    f"InvoiceId {TEXT}, VendorName {TEXT}, VendorTaxId {TEXT}, CustomerName {TEXT}, CustomerTaxId {TEXT}, InvoiceDate {TEXT}, DueDate {TEXT}, SubTotal {AMOUNT}, TotalTax {AMOUNT}, InvoiceTotal {AMOUNT}, AmountDue {AMOUNT}, Items array<{FIELD}>"
)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """file, payload: a JSON file each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("payload"))


def _group(p: DataFrame, key: str) -> DataFrame:
    return p.select(key, F.from_json("payload", INVOICE).alias("p"))


def invoice_items(payloads: DataFrame, key: str) -> DataFrame:
    """A row per line item of payload, with evidence and confidence; an invoice without items keeps one row of nulls, as does a payload that doesn't parse."""
    rows = _group(payloads, key).select(key, F.explode_outer("p.table.line_items").alias("item"))
    money = lambda n: F.col(f"item.{n}").try_cast("decimal(18,2)").alias(n)
    return rows.select(key, "item.line_number", "item.description", F.col("item.quantity").try_cast("decimal(18,4)").alias("quantity"), money("unit_price"), money("tax_amount"), money("line_total"), "item.confidence", "item.evidence_refs")


def invoice_groups(payloads: DataFrame, key: str) -> DataFrame:
    """A row per payload: header fields and totals as texts, the currency of totals, else the header's, each group's status, confidence and evidence."""
    groups = ("metadata", "table", "totals")
    part = [F.col(f"p.{g}.{n}").alias(f"{g}_{n}") for g in groups for n in ("extraction_status", "confidence", "evidence_refs")]
    fields = [F.col(f"p.metadata.{n}") for n in METADATA if n != "currency"] + [F.col(f"p.totals.{n}") for n in TOTALS]
    return _group(payloads, key).select(key, *fields, F.coalesce("p.totals.currency", "p.metadata.currency").alias("currency"), *part)


def scan_blocks(payloads: DataFrame, key: str) -> DataFrame:
    """Text blocks of scans: the paragraphs, else the lines of all pages, else the parallel arrays of texts, scores and polygons; page 1 by default.

    Blanks go. block_no counts what is left; scan_confidence is the mean of the pages that have one.
    """
    p = payloads.select(key, F.from_json("payload", SCAN).alias("p"))
    block = lambda text, page, polygon, confidence: F.struct(text.alias("content"), F.coalesce(page, F.lit(1)).alias("page"), polygon.alias("polygon"), confidence.alias("confidence"))
    paragraphs = F.transform("p.paragraphs", lambda x: block(x["content"], x["page"], x["polygon"], x["confidence"]))
    page_lines = F.flatten(F.transform("p.pages", lambda g: F.transform(F.coalesce(g["lines"], F.array().cast(f"array<struct<{BLOCK}>>")), lambda x: block(x["content"], g["page"], x["polygon"], x["confidence"]))))
    parallel = F.transform("p.rec_texts", lambda x, i: block(x, F.lit(1), F.get("p.rec_polys", i), F.get("p.rec_scores", i)))
    some = lambda b: F.when(F.size(b) > 0, b)
    blocks = F.coalesce(some(paragraphs), some(page_lines), parallel)
    sure = F.filter(F.transform("p.pages", lambda g: g["confidence"]), lambda x: x.isNotNull())
    mean = F.aggregate(sure, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(sure), F.lit(0))
    rows = p.select(key, mean.alias("scan_confidence"), F.posexplode(F.filter(blocks, lambda b: F.trim(b["content"]) != "")).alias("at", "b"))
    return rows.select(key, (F.col("at") + 1).alias("block_no"), "b.content", "b.page", "b.polygon", "b.confidence", "scan_confidence")


def prebuilt_groups(payloads: DataFrame, key: str) -> DataFrame:
    """Header and totals of a stored model result: the total falls back on what is due, the currency is the first that an amount carries; the
    totals' confidence is low below the subtotal; the header's is high if all of its fields are sure (0.8), else medium."""
    p = payloads.select(key, F.from_json("payload", PREBUILT).alias("p"))
    code = F.coalesce(*(F.col(f"p.{n}.code") for n in ("InvoiceTotal", "SubTotal", "TotalTax", "AmountDue")))
    total, sub = F.coalesce("p.InvoiceTotal.value", "p.AmountDue.value"), F.col("p.SubTotal.value")
    names = {"InvoiceId": "number", "VendorName": "supplier", "VendorTaxId": "supplier_tax_id", "CustomerName": "customer", "CustomerTaxId": "customer_tax_id", "InvoiceDate": "issue_date", "DueDate": "due_date"}
    sure = F.forall(F.array_compact(F.array(*(F.when(F.col(f"p.{n}.value").isNotNull(), F.coalesce(f"p.{n}.confidence", F.lit(0.0))) for n in names))), lambda x: x >= 0.8)
    return p.select(
        key, *(F.col(f"p.{n}.value").alias(a) for n, a in names.items()), sub.alias("subtotal"), F.col("p.TotalTax.value").alias("tax"), total.alias("total"), code.alias("currency"), F.when(sure, "high").otherwise("medium").alias("metadata_confidence"),
        F.when(total < sub, "low").otherwise("medium").alias("confidence"),
    )


def prebuilt_items(payloads: DataFrame, key: str) -> DataFrame:
    """Line items of stored model results, numbered as they stand."""
    p = payloads.select(key, F.from_json("payload", PREBUILT).alias("p")).select(key, F.posexplode("p.Items").alias("at", "x"))
    return p.select(key, (F.col("at") + 1).alias("line_number"), F.col("x.Description.value").alias("description"), F.col("x.Quantity.value").try_cast("decimal(18,2)").alias("quantity"), F.col("x.UnitPrice.value").alias("unit_price"), F.col("x.Amount.value").alias("line_total"))


def pairs_by_stem(documents: DataFrame, annotations: DataFrame) -> DataFrame:
    """path, annotation_path: files (path) of two listings, such as of spark.read.format("binaryFile"), that share their name without folder and ending."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem")
    return documents.select(stem, "path").join(annotations.select(stem, F.col("path").alias("annotation_path")), "stem")


def markdown(rows: DataFrame, columns: list[str], order: Column) -> DataFrame:
    """A report table (of scores, not of data) as one text."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.col(n).cast("string") for n in columns)), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{' --- |' * len(columns)}\n"
    listed = F.array_sort(F.collect_list(F.struct(order.alias("o"), cells.alias("line"))))
    return rows.agg(F.concat(F.lit(head), F.array_join(F.transform(listed, lambda x: x["line"]), "\n")).alias("report"))


def write_report(rows: DataFrame, columns: list[str], order: Column, path: str) -> None:
    """The rows as JSON and the Markdown table beside them."""
    rows.select(*columns).write.mode("overwrite").json(f"{path}/json")
    markdown(rows, columns, order).write.mode("overwrite").text(f"{path}/markdown")


def erased(tables: dict[str, DataFrame], tenant: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without a tenant's rows, and a receipt (table, n_erased). Nulls belong to no tenant and stay."""
    gone = F.coalesce(F.col("tenant_id") == tenant, F.lit(False))
    receipt = None
    for name, t in tables.items():
        n = t.agg(F.lit(name).alias("table"), F.count_if(gone).alias("n_erased"))
        receipt = n if receipt is None else receipt.unionByName(n)
    return {name: t.where(~gone) for name, t in tables.items()}, receipt


#: Names that a model gives the groups and fields of its output instead of ours (fixed values).
PARENTS = ["invoiceMetadata", "metadata", "invoice"]
ISSUERS, BUYERS = ["issuer", "supplier", "vendor"], ["billTo", "customer", "client"]
ALIASES = {
    "invoice_number": ["invoice_number", "invoiceNumber", "invoiceNo", "number"], "supplier_name": ["supplier_name", "supplierName", "issuerName", "vendorName"], "supplier_tax_id": ["supplier_tax_id", "supplierTaxId", "issuerTaxId"],
    "customer_name": ["customer_name", "customerName", "billToName", "clientName"], "customer_tax_id": ["customer_tax_id", "customerTaxId", "billToTaxId"], "issue_date": ["issue_date", "issueDate", "invoiceDate", "date"],
    "due_date": ["due_date", "dueDate", "paymentDue"], "currency": ["currency", "currencyCode"],
}
NESTED = {"supplier_name": (ISSUERS, "name"), "supplier_tax_id": (ISSUERS, "taxId"), "customer_name": (BUYERS, "name"), "customer_tax_id": (BUYERS, "taxId")}
TABLES = ["line_items", "lineItems", "items", "rows"]
ITEM_ALIASES = {"description": ["description", "name", "item", "service"], "quantity": ["quantity", "qty"], "unit_price": ["unit_price", "unitPrice", "price", "rate"], "tax_amount": ["tax_amount", "taxAmount", "tax"], "line_total": ["line_total", "lineTotal", "amount", "total"]}
SUMS = {"subtotal_amount": ["subtotal_amount", "subtotal", "subTotal"], "tax_amount": ["tax_amount", "taxAmount", "tax"], "total_amount": ["total_amount", "totalAmount", "total", "amountDue"]}


def _seen(payload: Column, paths: list[str]) -> Column:
    """Where the names of paths may stand: the payload, or all of them if it holds escapes, which names may be written with."""
    return F.when(payload.contains("\\"), F.lit(" ".join(sorted({n for p in paths for n in _names(p)})))).otherwise(payload)


def _names(path: str) -> list[str]:
    return path.split(".")[:0:-1]


def _first(payload: Column, paths: list[str], seen: Column) -> Column:
    """The first path that has a text. The payload is parsed only for paths whose names it holds, which few do."""

    def at(path: str) -> Column:
        found = F.trim(F.get_json_object(payload, path))
        return F.when(reduce(and_, (seen.contains(n) for n in _names(path))) & (found != ""), found)

    return F.coalesce(*map(at, paths))


def _two_places(c: Column) -> Column:
    return F.coalesce(c.try_cast("decimal(18,2)").cast("string"), c)


def repaired(payloads: DataFrame, key: str) -> DataFrame:
    """Header and totals of model output whatever it calls them: the first name that has a text, at the top, in a group, or in a party; numbers
    become texts of two places. What has neither number nor party nor date is a placeholder."""
    p = F.col("payload")
    paths = lambda names: [f"$.{n}" for n in names] + [f"$.{g}.{n}" for g in PARENTS for n in names]
    party = lambda of, n: [f"{g}.{x}.{n}" for g in ("$", "$.party", "$.parties", *(f"$.{y}" for y in PARENTS)) for x in of]
    head = {f: paths(names) + (party(*NESTED[f]) if f in NESTED else []) for f, names in ALIASES.items()}
    sums = {f: [f"$.{n}" for n in names] + [f"$.{g}.{n}" for g in ("totals", "summary") for n in names] for f, names in SUMS.items()}
    rows = dealt(payloads.select(key, "payload")).withColumn("seen", _seen(p, sum((head | sums).values(), [])))
    rows = rows.select(key, *(_first(p, v, F.col("seen")).alias(f) for f, v in (head | sums).items())).withColumns({f: _two_places(F.col(f)) for f in sums})
    some = F.coalesce("invoice_number", "supplier_name", "customer_name", "issue_date").isNotNull()
    return rows.withColumn("extraction_status", F.when(some, "extracted").otherwise("placeholder"))


def repaired_items(payloads: DataFrame, key: str) -> DataFrame:
    """Line items of model output: the first array by one of the table's names, fields by theirs; items are numbered as they stand."""
    array = F.coalesce(*(F.get_json_object("payload", f"{g}.{t}") for g in ("$", "$.table") for t in TABLES))
    # outer: else a filter on the arrays' size is pushed down below the deal, and parses each payload twice
    each = dealt(payloads.select(key, "payload")).select(key, F.posexplode_outer(F.from_json(array, "array<string>")).alias("at", "item")).where("at is not null")
    each = each.withColumn("seen", _seen(F.col("item"), [f"$.{n}" for names in ITEM_ALIASES.values() for n in names]))
    cell = lambda names: _first(F.col("item"), [f"$.{n}" for n in names], F.col("seen"))
    return each.select(key, (F.col("at") + 1).alias("line_number"), *(cell(n).alias(f) if f == "description" else _two_places(cell(n)).alias(f) for f, n in ITEM_ALIASES.items()))
