"""Documents of the invoice flow: fields of their texts, assembly, routing, evidence, regions. A text's lines are an array of its row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tallyforge.functions import scalars as S
from tallyforge.operators import annotated as A

lines, first_of, vat_amount = A.lines, A.first_of, A.vat_amount
day = S.day


def place(rows: Column, pattern: str) -> Column:
    """Index of the first line that matches, else the number of lines."""
    hits = F.transform(rows, lambda x, i: F.when(x.rlike(pattern), i))
    return F.coalesce(F.array_min(hits), F.size(rows))


HEADER = ["number", "supplier", "supplier_tax_id", "customer", "customer_tax_id", "issue_date", "due_date", "currency"]


def header(docs: DataFrame, names: list[str] = HEADER) -> DataFrame:
    """doc_id and the named ones of number, supplier, supplier_tax_id, customer, customer_tax_id, issue_date, due_date, currency of docs(doc_id, text)."""
    return A.with_header(A.annotated(docs, header_marks(names)), names).select("doc_id", *names)


def header_marks(names: list[str]) -> list[str]:
    return [m for n in names for m in A.HEADER_MARKS.get(n, [])]


def header_and_totals(docs: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, the named header fields, subtotal, tax, total and confidence of docs(doc_id, text), each text read once."""
    return A.with_totals(A.with_header(A.annotated(docs, header_marks(names) + A.TOTAL_MARKS), names)).select("doc_id", *names, "subtotal", "tax", "total", "confidence")


def totals(docs: DataFrame) -> DataFrame:
    """doc_id, subtotal, tax, total and confidence of docs(doc_id, text)."""
    return A.with_totals(A.annotated(docs, A.TOTAL_MARKS)).select("doc_id", "subtotal", "tax", "total", "confidence")


def items(docs: DataFrame) -> DataFrame:
    """doc_id, line_number, description, quantity, unit_price, total of each item in docs(doc_id, text)."""
    # two generators: the plan asks of a generator's input whether it is empty, which here would be to parse each text many times over
    return A.with_items(A.annotated(docs, A.ITEM_MARKS)).select("doc_id", F.explode(F.array("items")).alias("items")).select("doc_id", F.inline("items"))


def fields(docs: DataFrame, names: list[str] = HEADER) -> DataFrame:
    """The named header fields, totals, items (an array) and their number of docs(doc_id, text): each line is read once for all of them, and nothing is joined."""
    rows = A.annotated(docs, header_marks(names) + A.TOTAL_MARKS + A.ITEM_MARKS)
    return A.with_items(A.with_totals(A.with_header(rows, names))).select("doc_id", *names, "subtotal", "tax", "total", "confidence", "items", "n_items")


def assembled(docs: DataFrame, names: tuple[str, ...] = ("number", "supplier", "issue_date", "due_date", "currency")) -> DataFrame:
    """One row a document: the number and what else is named of the header, totals, item count, missing groups and `extracted` or `partial`."""
    n = F.col("n_items")
    missing = F.array_compact(F.array(F.when(F.col("number").isNull(), "metadata"), F.when(n == 0, "table"), F.when(F.col("total").isNull(), "totals")))
    j = fields(docs, list(names)).select("doc_id", *names, "subtotal", "tax", "total", "confidence", "n_items", (F.col("total") - F.col("tax")).alias("net"), F.array_join(missing, ",").alias("missing"))
    return j.withColumn("status", F.when(F.col("missing") == "", "extracted").otherwise("partial"))


def routing(done: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Where each group comes from: deterministic if its required fields are there (and totals are sure), prebuilt if a stored group is good
    enough, else needs_model.

    stored: doc_id, group, confidence, correction (one is pending for the group): accepted unless of low confidence or to be corrected.
    """
    meta = F.col("number").isNotNull() & F.col("supplier").isNotNull() & F.col("issue_date").isNotNull()
    total = F.col("total").isNotNull() & (F.col("confidence") == "high")
    table = F.col("n_items") > 0
    rows = done.select("doc_id", F.explode(F.create_map(F.lit("metadata"), meta, F.lit("table"), table, F.lit("totals"), total)).alias("group", "sure"))
    if stored is None:
        return rows.select("doc_id", "group", F.when(F.col("sure"), "deterministic").otherwise("needs_model").alias("route"))
    j = rows.join(stored.withColumnRenamed("confidence", "stored"), ["doc_id", "group"], "left")
    good = F.coalesce((F.col("stored") != "low") & ~F.col("correction"), F.lit(False))
    again = F.coalesce(F.col("correction"), F.lit(False))
    return j.select("doc_id", "group", F.when(F.col("sure") & ~again, "deterministic").when(good, "prebuilt").otherwise("needs_model").alias("route"))


def field_evidence(docs: DataFrame, fields: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, field, value, line_no, score, state: each field that has a value with the line that speaks most for it, or unresolved."""
    each = fields.select("doc_id", F.explode(F.map_filter(F.create_map(*(x for n in names for x in (F.lit(n), F.col(n).cast("string")))), lambda k, v: v.isNotNull())).alias("field", "value"))
    found = graded_evidence(docs, fields, names)
    return each.join(found, ["doc_id", "field"], "left").withColumn("state", F.when(F.col("score").isNull(), "unresolved").otherwise("grounded"))


def within_lines(rows: Column, label: str, value: str, k: int) -> Column:
    """The first value on one of the k lines after a line with the label."""
    at = place(rows, label)
    return first_of(F.transform(F.slice(rows, at + 2, k), lambda x: F.nullif(F.regexp_extract(x, value, 1), F.lit(""))))


@F.pandas_udf(ArrayType(IntegerType()))
def free_line_numbers(numbers: pd.Series) -> pd.Series:
    """Line numbers in print order made unique: a missing, non-positive or repeated one becomes the next free number; linear in the lines."""

    def repaired(given: np.ndarray | None) -> list[int] | None:
        if given is None:
            return None
        out, taken, free = [], set(), 1
        for x in given:
            n = 0 if x is None or x != x else int(x)
            if n <= 0 or n in taken:
                while free in taken:
                    free += 1
                n, free = free, free + 1
            taken.add(n)
            out.append(n)
        return out

    return numbers.map(repaired)


def merged(rules: str, model: str) -> list[Column]:
    """Fields of two structs: number, customer, tax ids and dates by the rules where they have them; supplier, currency, subtotal and tax by
    the model; the total by the rules when they are sure. Blank texts are none. A due date that only repeats the issue date goes."""
    filled = lambda v: F.when(F.trim(v) != "", v)
    r, m = F.col(rules), F.col(model)
    issue = F.coalesce(r["issue_date"], m["issue_date"])
    due = F.coalesce(r["due_date"], F.when(~m["due_date"].eqNullSafe(issue), m["due_date"]))
    total = F.when(r["confidence"] == "high", F.coalesce(r["total"], m["total"])).otherwise(F.coalesce(m["total"], r["total"]))
    ours, theirs = ("number", "customer", "supplier_tax_id", "customer_tax_id"), ("supplier", "currency")
    amounts = [F.coalesce(m[n], r[n]).alias(n) for n in ("subtotal", "tax")]
    return [F.coalesce(filled(r[n]), filled(m[n])).alias(n) for n in ours] + [F.coalesce(filled(m[n]), filled(r[n])).alias(n) for n in theirs] + amounts + [issue.alias("issue_date"), due.alias("due_date"), total.alias("total")]


def without_copied_totals(items: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """items(quantity, unit_price, line_total) of documents: a row without quantity and price that repeats the total of its document's first sound row (quantity times
    price within a cent) has none. A document without a sound row keeps all; a document's items are few."""
    sound = (F.col("line_total") > 0) & (F.abs(F.col("quantity") * F.col("unit_price") - F.col("line_total")) <= F.lit("0.01").cast("decimal(4,2)"))
    every = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.when(sound, F.col("line_total")), ignorenulls=True).over(every)
    copied = F.col("quantity").isNull() & F.col("unit_price").isNull() & (F.col("line_total") == first)
    return items.withColumn("line_total", F.when(~F.coalesce(copied, F.lit(False)), F.col("line_total")))


#: Words that stand at a field (fixed values).
ANCHORS = {
    "number": ["invoice", "invoice no", "invoice number"], "supplier": ["supplier", "vendor", "seller"], "customer": ["bill to", "customer", "client"], "issue_date": ["invoice date", "issue date", "date", "data"],
    "due_date": ["due date", "payment due"], "total": ["total", "amount due", "balance due"], "subtotal": ["subtotal", "sub total"], "tax": ["tax", "vat", "iva", "valor iva", "tx iva"],
}
DATE = r"(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})"
MONEY = r"(-?[\d.,]*\d)"
DATES, AMOUNTS = ("issue_date", "due_date"), ("total", "subtotal", "tax")


def graded_evidence(docs: DataFrame, fields: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, field, line_no, score: the line that speaks most for a field's value, the first on ties; no row where none does.

    The same text 100, the same date 95, the same amount 85, one inside the other 75; 25 more with an anchor word on the
    line, and 20 less the distance to the last line before it that begins with one.
    """
    words = lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    rows = docs.select("doc_id", lines(F.col("text")).alias("raw")).withColumn("key", F.transform("raw", words)).join(fields, "doc_id")

    def best(name: str) -> Column:
        value, anchors = F.col(name), "|".join(ANCHORS[name])
        starts = F.filter(F.transform("key", lambda x, i: F.when(x.rlike(f"^(?:{anchors})(?: |$)"), i)), lambda i: i.isNotNull())

        def graded(x: Column, i: Column, key: Column, starts: Column) -> Column:
            raw = F.get("raw", i)
            score = F.when(x == key, 100)
            if name in DATES:
                score = score.when(A.bound(F.regexp_extract(raw, DATE, 1), lambda seen: (seen != "") & ((day(seen, True) == value) | (day(seen, False) == value))), 95)
            if name in AMOUNTS:
                score = score.when(F.array_contains(F.transform(F.regexp_extract_all(raw, F.lit(MONEY), F.lit(1)), S.clean_money), value), 85)
            score = score.when((F.length(key) >= 3) & (x.contains(key) | ((F.length(x) >= 4) & key.contains(x))), 75)
            last = F.array_max(F.filter(starts, lambda a: a < i))
            extra = F.when(x.rlike(anchors), 25).otherwise(0) + F.coalesce(F.greatest(F.lit(0), 20 - (i - last)), F.lit(0))
            return F.when(key != "", F.struct((score + extra).alias("score"), (-i).alias("back")))

        # the value's words and the anchors' lines are worked out once a document, not once a line
        every = lambda key, starts: F.transform("key", lambda x, i: graded(x, i, key, starts))
        top = A.bound(words(value.cast("string")), lambda key: A.bound(starts, lambda at: F.array_max(F.filter(every(key, at), lambda g: g["score"].isNotNull()))))
        return F.struct(F.lit(name).alias("field"), top.alias("top"))

    each = rows.select("doc_id", F.inline(F.array(*map(best, names)))).where("top is not null")
    return each.select("doc_id", "field", (-F.col("top.back")).alias("line_no"), "top.score")


#: Markers of a page's regions.
REGIONS = {"table": r"(?i)^(?:description|item|qty|artigo)\b", "totals": r"(?i)^(?:sub ?total|grand total|total|amount due)\b", "bill_to": r"(?i)^(?:bill(?:ed)? to|customer|cliente)\b", "ship_to": r"(?i)^(?:ship to|deliver(?:y|ed) to)\b"}


def _marked(marker: str, after: Column):
    return lambda x, i: F.when(x.rlike(marker) & (i >= after), i)


def regions(docs: DataFrame, footer: int = 3) -> DataFrame:
    """doc_id, line_no, region of each line: table, totals (after a table), bill_to, ship_to, footer (the last lines after the totals), else header."""
    rows = docs.select("doc_id", lines(F.col("text")).alias("l")).withColumn("n", F.size("l"))
    for name, marker in REGIONS.items():
        after = F.when(F.col("table_at") < F.col("n"), F.col("table_at")).otherwise(0) if name == "totals" else F.lit(0)
        hits = F.transform("l", _marked(marker, after))
        rows = rows.withColumn(f"{name}_at", F.coalesce(F.array_min(hits), F.col("n")))
    i = F.col("line_no")
    # outer: else a filter on the lines' number is pushed down to where the texts are rendered, and renders and reads each text again
    each = rows.select("*", F.posexplode_outer("l").alias("line_no", "line")).where("line_no is not null")
    latest = F.greatest(*(F.when(i >= F.col(f"{r}_at"), F.col(f"{r}_at")).otherwise(-1) for r in REGIONS))
    end = (i >= F.col("n") - footer) & (i > F.col("totals_at"))
    region = F.when(end, "footer")
    for r in REGIONS:
        region = region.when((latest == F.col(f"{r}_at")) & (latest >= 0), r)
    return each.select("doc_id", "line_no", region.otherwise("header").alias("region"))
