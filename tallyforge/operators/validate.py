"""Validation as issue tables: one row per (entity, validator, code)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.sources.views import dealt

#: Currency codes that are allowed (fixed values).
ALLOWED = ["AUD", "CAD", "EUR", "GBP", "JPY", "SGD", "USD", "VND"]


def issue(test: Column, validator: str, code: str, severity: str, field: str, expected: Column, observed: Column) -> Column:
    s = F.struct(F.lit(validator).alias("validator"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(field).alias("field_path"), expected.cast("string").alias("expected"), observed.cast("string").alias("observed"))
    return F.when(test, s)


def issues(df: DataFrame, entity: str, *found: Column) -> DataFrame:
    return df.select(F.col(entity).alias("entity_id"), F.explode(F.array_compact(F.array(*found))).alias("x")).select("entity_id", "x.*")


def arithmetic(invoices: DataFrame, lines: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Line sums against invoice totals: a surplus is an inferred discount, a shortfall an error."""
    sums = lines.groupBy("invoice_id").agg(F.sum("net").alias("line_sum"), F.count_if(F.col("net").isNull()).alias("no_amount"))
    j = invoices.join(sums, "invoice_id", "left")
    total, line, t = F.col("total"), F.col("line_sum"), F.lit(tolerance).cast("decimal(18,2)")
    return issues(
        j, "invoice_id",
        issue(total.isNull(), "arithmetic", "missing_total", "error", "total", F.lit("amount"), total),
        issue(line.isNull(), "arithmetic", "missing_lines", "warning", "lines", F.lit("lines"), line),
        issue(F.col("no_amount") > 0, "arithmetic", "invalid_line_amount", "error", "lines", F.lit("0"), F.col("no_amount")),
        issue(line - total > t, "arithmetic", "inferred_discount_amount", "info", "total", line, total),
        issue(total - line > t, "arithmetic", "line_sum_below_total", "error", "total", line, total),
    )


def dates(invoices: DataFrame) -> DataFrame:
    """invoices(invoice_id, issue_date, due_date as dates): missing issue date, due before issue."""
    i, d = F.col("issue_date"), F.col("due_date")
    return issues(invoices, "invoice_id", issue(i.isNull(), "dates", "missing_issue_date", "error", "issue_date", F.lit("date"), i), issue(d < i, "dates", "due_before_issue", "error", "due_date", i, d))


TOTALS, METADATA = "groups.totals", "groups.metadata"


def invoice_arithmetic(groups: DataFrame, lines: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Extracted totals against each other and their lines.

    groups: invoice_id, has_totals, subtotal, tax, total (texts); lines: invoice_id, line_total (text). Lines are held against the total,
    then the subtotal; what they have above the subtotal is a discount (info), below is an error. Codes are fixed values.
    """
    amount = S.parse_decimal(F.col("line_total")).cast("decimal(18,2)")
    sums = lines.groupBy("invoice_id").agg(F.count("*").alias("n"), F.count(amount).alias("n_valid"), F.sum(amount).alias("line_sum"))
    names = ("subtotal", "tax", "total")
    j = groups.join(sums, "invoice_id", "left").withColumns({f"{n}_": S.parse_decimal(F.col(n)).cast("decimal(18,2)") for n in names})
    sub, tax, total, line = (F.col(x) for x in ("subtotal_", "tax_", "total_", "line_sum"))
    t = F.lit(tolerance).cast("decimal(18,2)")
    has, whole = F.col("has_totals"), F.col("n") == F.col("n_valid")
    matches = F.coalesce(F.abs(line - total) <= t, F.lit(False)) | F.coalesce(F.abs(line - sub) <= t, F.lit(False))
    return issues(
        j, "invoice_id", issue(~has, "arithmetic", "ERR_TOTALS_GROUP_MISSING", "error", TOTALS, F.lit(None), F.lit(None)),
        *(issue(has & F.col(f"{n}_").isNull(), "arithmetic", "ERR_AMOUNT_INVALID", "error", f"{TOTALS}.{n}_amount", F.lit(None), F.col(n)) for n in names),
        issue(has & (F.abs(sub + tax - total) > t), "arithmetic", "ERR_LOGIC_MATH", "error", f"{TOTALS}.total_amount", sub + tax, total),
        issue(has & ~whole, "arithmetic", "ERR_LINE_TOTAL_INVALID", "error", "groups.table.line_items", F.lit(None), F.lit(None)),
        issue(has & whole & sub.isNotNull() & ~matches & (line - sub > t), "arithmetic", "inferred_discount_amount", "info", f"{TOTALS}.subtotal_amount", line - sub, F.lit(None)),
        issue(has & whole & sub.isNotNull() & ~matches & (sub - line > t), "arithmetic", "ERR_SUBTOTAL_LINE_ITEMS_MISMATCH", "error", f"{TOTALS}.subtotal_amount", line, sub),
        issue(has & whole & sub.isNull() & (F.abs(line - total) > t), "arithmetic", "ERR_LINE_TOTAL_MISMATCH", "error", "groups.table.line_items", total, line),
    )


def invoice_dates(groups: DataFrame) -> DataFrame:
    """groups(invoice_id, has_metadata, issue_date, due_date as texts): texts that are no ISO dates, and a due date before the issue date."""
    i, d, has = S.parse_iso_date(F.col("issue_date")), S.parse_iso_date(F.col("due_date")), F.col("has_metadata")
    bad = lambda n, v: issue(has & F.col(n).isNotNull() & v.isNull(), "dates", "ERR_DATE_INVALID", "error", f"{METADATA}.{n}", F.lit(None), F.col(n))
    return issues(
        groups, "invoice_id", issue(~has, "dates", "ERR_METADATA_GROUP_MISSING", "error", METADATA, F.lit(None), F.lit(None)), bad("issue_date", i), bad("due_date", d),
        issue(has & (i > d), "dates", "ERR_DATE_ORDER", "error", f"{METADATA}.due_date", i, d),
    )


def currency_issues(c: Column, field: str, allowed: list[str] | None = None) -> tuple[Column, Column]:
    """Three letters in any case, and on the list."""
    up = F.upper(c)
    right = F.coalesce(F.length(up) == 3, F.lit(False))
    return issue(~right, "currency", "ERR_CURRENCY_INVALID", "error", field, F.lit(None), c), issue(right & ~up.isin(allowed or ALLOWED), "currency", "ERR_CURRENCY_UNSUPPORTED", "error", field, F.lit(None), c)


def currencies(rows: DataFrame, entity: str, allowed: list[str] | None = None) -> DataFrame:
    return issues(rows, entity, *currency_issues(F.col("currency"), "currency", allowed))


def invoice_currencies(groups: DataFrame) -> DataFrame:
    """groups(invoice_id, metadata_currency, totals_currency): each by itself, and against each other where both are there."""
    m, t = F.col("metadata_currency"), F.col("totals_currency")
    each = [x for c, n in ((m, METADATA), (t, TOTALS)) for x in currency_issues(c, f"{n}.currency")]
    return issues(groups, "invoice_id", *each, issue(F.upper(m) != F.upper(t), "currency", "ERR_CURRENCY_MISMATCH", "error", f"{TOTALS}.currency", F.upper(m), F.upper(t)))


def statement_dates(statements: DataFrame, transactions: DataFrame) -> DataFrame:
    """Periods that end before they begin, and transactions(import_id, row_index, posted_at) outside of their statement's period."""
    a, b, p = F.col("period_start"), F.col("period_end"), F.col("posted_at")
    order = issues(statements, "import_id", issue(a > b, "statement_dates", "ERR_STATEMENT_DATE_ORDER", "error", "statement_import.statement_end_date", a, b))
    j = transactions.select("import_id", "row_index", "posted_at").join(statements.select("import_id", "period_start", "period_end"), "import_id")
    place = F.concat(F.lit("transactions["), F.col("row_index").cast("string"), F.lit("].posted_at"))
    one = lambda test, code, edge: F.when(test, F.struct(F.lit("statement_dates").alias("validator"), F.lit(code).alias("code"), F.lit("error").alias("severity"), place.alias("field_path"), edge.cast("string").alias("expected"), p.cast("string").alias("observed")))
    return order.unionByName(issues(j, "import_id", one(p < a, "ERR_TRANSACTION_BEFORE_STATEMENT", a), one(p > b, "ERR_TRANSACTION_AFTER_STATEMENT", b)))


def statement_currencies(statements: DataFrame, transactions: DataFrame) -> DataFrame:
    """Account, import and each transaction by itself, then transactions against the account's currency, else the import's.

    statements: import_id, account_currency, currency; transactions: import_id, row_index, currency.
    """
    own = issues(statements, "import_id", *currency_issues(F.col("account_currency"), "bank_account.currency"), *currency_issues(F.col("currency"), "statement_import.currency"))
    expected = statements.select("import_id", F.upper(F.coalesce("account_currency", "currency")).alias("wanted"))
    j = transactions.select("import_id", "row_index", "currency").join(expected, "import_id")
    up = F.upper("currency")
    rows = issues(j.withColumn("key", F.struct("import_id", "row_index")), "key", *currency_issues(F.col("currency"), "currency"), issue(up != F.col("wanted"), "currency", "ERR_CURRENCY_MISMATCH", "error", "currency", F.col("wanted"), up))
    path = F.concat(F.lit("transactions["), F.col("entity_id.row_index").cast("string"), F.lit("].currency"))
    return own.unionByName(rows.withColumn("field_path", path).withColumn("entity_id", F.col("entity_id.import_id")))


def duplicate_issues(rows: DataFrame, key: str, entity: str) -> DataFrame:
    """code, severity, dedupe_key, n, first_entity: groups that share a key (errors), and how many rows have none (a warning)."""
    blank = F.coalesce(F.trim(F.col(key)) == "", F.lit(True))
    by = rows.groupBy(F.when(~blank, F.col(key)).alias("dedupe_key")).agg(F.count("*").alias("n"), F.min(entity).alias("first_entity")).where("n > 1 or dedupe_key is null")
    none = F.col("dedupe_key").isNull()
    return by.select(F.when(none, "WARN_DEDUPE_KEY_MISSING").otherwise("ERR_DUPLICATE_DETECTED").alias("code"), F.when(none, "warning").otherwise("error").alias("severity"), "dedupe_key", "n", "first_entity")


def party_roles(rows: DataFrame) -> DataFrame:
    """rows(doc_id, supplier, customer, supplier_region, bill_to_region): one party in both roles, or names that stand in each other's region."""
    s, c = F.col("supplier"), F.col("customer")
    same = (S.party_key(s) != "") & (S.party_key(s) == S.party_key(c))
    swapped = S.contains_party(F.col("bill_to_region"), s) & S.contains_party(F.col("supplier_region"), c)
    return issues(
        rows, "doc_id", issue(same, "party_roles", "ERR_PARTY_ROLE_CONFUSION", "error", f"{METADATA}.supplier_name", F.lit("different parties"), s),
        issue(swapped, "party_roles", "ERR_PARTY_ROLE_CONFUSION", "error", METADATA, F.concat_ws(" / ", c, s), F.concat_ws(" / ", s, c)),
    )


def duplicates(rows: DataFrame, key: list[str], entity: str) -> DataFrame:
    """Groups of rows that share a key: size and the smallest and largest entity, counted before the shuffle."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(entity).alias("first_entity"), F.max(entity).alias("last_entity")).where("n > 1")


LEVELS, STATES = ["high", "medium", "low", "unknown"], ["placeholder", "extracted", "partial", "failed"]
#: Fields that all groups of an extraction may hold.
GROUP = {"schema_version": "string?", "extraction_status": (*STATES, None), "evidence_refs": "array?", "confidence": (*LEVELS, None)}


def texts_or_null(*names: str) -> dict:
    return {n: "string?" for n in names}


#: What a payload has to hold, by schema: kinds of its fields, or the values that one may have; with ? or None it may be left out. An array may name the contract of its items.
CONTRACTS = {
    "classification-draft.v1": {"category_code": "string", "confidence": LEVELS, "score": "number", "refs": "array"},
    "invoice-metadata-group.v1": GROUP | texts_or_null("invoice_number", "supplier_name", "supplier_tax_id", "customer_name", "customer_tax_id", "issue_date", "due_date", "currency"),
    "invoice-table-group.v1": GROUP | {"line_items": "array?:item", "table_region_ref": "string?"},
    "invoice-totals-group.v1": GROUP | texts_or_null("subtotal_amount", "tax_amount", "total_amount", "currency"),
}
ITEMS = {"item": {"line_number": "number>0"} | texts_or_null("description", "quantity", "unit_price", "tax_amount", "line_total") | {"evidence_refs": "array?", "confidence": (*LEVELS, None)}}


def _fields(payload: Column) -> Column:
    """An object's fields as a map of their texts, so that it is parsed once."""
    return F.from_json(payload, "map<string,string>", {"allowUnquotedControlChars": "true"})


def _item_errors(array: Column, name: str, fields: dict) -> Column:
    """Errors of the objects of the array (a JSON text) called name, each with its place."""
    each = F.transform(F.from_json(array, "array<string>"), lambda x: F.map_filter(_fields(x), lambda _, v: v.isNotNull()))
    return F.flatten(F.transform(each, lambda x, i: F.transform(_field_errors(x, fields), lambda e: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]."), e))))


def _field_errors(payload: Column, fields: dict) -> Column:
    """Errors of one object's fields (a map of their texts), in the order of the contract, then names that it doesn't know."""
    found = []
    for f, want in fields.items():
        x = payload[f]
        free = want[-1] is None if isinstance(want, tuple) else "?" in want if isinstance(want, str) else False
        bad = F.lit(None).cast("string")
        if isinstance(want, (list, tuple)):
            bad = F.when(~x.isin([w for w in want if w]), f"{f}: not allowed")
        elif want.startswith("number"):
            least = 1 if want.endswith(">0") else 0
            bad = F.when(x.try_cast("double").isNull(), f"{f}: not a number").when(x.try_cast("double") < least, f"{f}: below {least}")
        elif want.startswith("array"):
            bad = F.when(~x.startswith("["), f"{f}: not an array")
        elif free:
            bad = F.when(x.rlike(r"^[\[{]"), f"{f}: not a text")
        own = F.array(bad if free else F.when(x.isNull(), f"{f}: missing").otherwise(bad))
        if isinstance(want, str) and ":" in want:
            inner = _item_errors(x, f, ITEMS[want.split(":")[1]])
            own = F.concat(own, F.when(x.startswith("["), inner).otherwise(F.array().cast("array<string>")))
        found.append(own)
    keys = F.coalesce(F.map_keys(payload), F.array().cast("array<string>"))
    other = F.transform(F.array_except(keys, F.array(*map(F.lit, fields))), lambda y: F.concat(y, F.lit(": not known")))
    return F.concat(F.array_compact(F.concat(*found)), other)


def contract(rows: DataFrame) -> DataFrame:
    """rows(schema, payload) with `errors`: what doesn't parse, fields that are missing, of another kind, out of their range or not known."""
    columns = rows.columns
    rows = dealt(rows).withColumns({"contract_value": F.try_parse_json("payload"), "contract_fields": _fields(F.col("payload"))})
    value = F.col("contract_value")
    kind = F.when(value.isNull(), "invalid").otherwise(F.schema_of_variant(value))
    found = F.array().cast("array<string>")
    for name, fields in CONTRACTS.items():
        found = F.when(F.col("schema") == name, _field_errors(F.col("contract_fields"), fields)).otherwise(found)
    known = F.col("schema").isin(list(CONTRACTS))
    one = lambda text: F.array(F.lit(text))
    return rows.select(*columns, F.when(~known, one("schema not registered")).when(kind == "invalid", one("invalid JSON")).when(~kind.startswith("OBJECT"), one("not an object")).otherwise(found).alias("errors"))


def qa_outcomes(drafts: DataFrame, entity: str, signals: DataFrame) -> DataFrame:
    """outcome, n_errors, n_signals and codes of each draft (a column `entity`).

    signals: entity_id, code, severity, retryable, target; null flags count as false. A signal that may be retried and names whom to ask asks for a
    correction; without one, those that may not be retried, or are errors or blocking, ask for a review; n_errors counts what decides. Codes are few, so a draft's set is small.
    """
    again = F.coalesce("retryable", F.lit(False))
    fix = again & F.col("target").isNotNull()
    see = ~again | F.coalesce(F.col("severity").isin("error", "blocking"), F.lit(False))
    g = signals.groupBy(F.col("entity_id").alias(entity)).agg(F.count("*").alias("n"), F.count_if(fix).alias("n_fix"), F.count_if(see).alias("n_see"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    j = drafts.select(entity).join(g, entity, "left").fillna(0, ["n", "n_fix", "n_see"])
    outcome = F.when(F.col("n_fix") > 0, "correction_required").when(F.col("n_see") > 0, "review_required").otherwise("passed")
    return j.select(entity, outcome.alias("outcome"), F.when(F.col("n_fix") > 0, F.col("n_fix")).otherwise(F.col("n_see")).alias("n_errors"), F.col("n").alias("n_signals"), F.coalesce("codes", F.lit("")).alias("codes"))


def privacy_gate(rows: DataFrame, policy: dict) -> DataFrame:
    """rows(text, cloud, consent, use_case, deidentified, sensitive) with action (block, allow, allow_redacted), reasons, and the text that goes on.

    Payloads that stay in house are allowed as they are; a blocked one has no text; others go on redacted and cut by the policy.
    """
    reasons = F.array_compact(F.array(
        F.when(F.lit(not policy["allow_cloud"]), "cloud disabled"), F.when(F.lit(policy["require_consent"]) & ~F.col("consent"), "no tenant consent"), F.when(~F.col("use_case").isin(policy["use_cases"]), "use case not allowed"),
        F.when((F.col("use_case") == "evaluation") & F.lit(policy["deidentified_evaluation"]) & ~F.col("deidentified"), "evaluation needs de-identified data"),
        F.when(F.col("sensitive") & ~F.col("deidentified") & F.lit(not policy["allow_sensitive"]), "sensitive payload"),
    ))
    rows = rows.withColumn("reasons", F.when(F.col("cloud"), reasons).otherwise(F.array().cast("array<string>")))
    action = F.when(~F.col("cloud"), "allow").when(F.size("reasons") > 0, "block").otherwise("allow_redacted" if policy["redact"] else "allow")
    out = rows.withColumn("action", action)
    return out.withColumn("sent", F.when(F.col("action") == "allow", F.col("text")).when(F.col("action") == "allow_redacted", S.redacted(F.col("text"), policy["max_chars"])[0]))
