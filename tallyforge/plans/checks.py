"""Queries on validation, review decisions and versions, with inputs that are missing, malformed or contradict each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import chains, insights, review, validate
from tallyforge.plans.catalog import query, sql_list
from tallyforge.sources import views as V

c, inv, tx, lines, stm, k = F.col, V.invoices, V.transactions, V.invoice_lines, V.statements, "invoice_id"


def of(key: str, *columns):
    """The next of some columns, row by row."""
    return F.element_at(F.array(*columns), (c(key) % len(columns) + 1).cast("int"))


def listed(*rows: str) -> str:
    """SQL: one row for each of the structs that isn't null."""
    return f"unnest(list_filter([{', '.join(rows)}], lambda x: x IS NOT NULL))"


def row(test: str, validator: str, code: str, severity: str, field: str, expected: str = "NULL", observed: str = "NULL") -> str:
    return f"CASE WHEN {test} THEN {{'validator': '{validator}', 'code': '{code}', 'severity': '{severity}', 'field_path': {field}, 'expected': ({expected})::VARCHAR, 'observed': ({observed})::VARCHAR}} END"


def groups(s, d) -> DataFrame:
    """Extracted totals as texts: right, off, unreadable, without a subtotal, without the group."""
    i = inv(s, d)
    tax, text = (c("total") / 10).cast("decimal(18,2)"), lambda x: x.cast("decimal(18,2)").cast("string")
    sub = text(c("total") - tax)
    return i.select(
        k, (c(k) % 7 != 4).alias("has_totals"), F.when(c(k) % 7 != 3, sub).alias("subtotal"), text(tax + F.when(c(k) % 7 == 1, 1).otherwise(0)).alias("tax"),
        F.when(c(k) % 7 == 2, "n/a").otherwise(F.format_number("total", 2)).alias("total"),
    )


def line_texts(s, d) -> DataFrame:
    """Line totals as texts; some can't be read, those of every fifth invoice add up to its total."""
    own = lines(s, d).select(k, F.when((c(k) % 10 == 9) & (c("line_number") == 1), "x").otherwise(c("net").cast("string")).alias("line_total")).where(c(k) % 5 != 0)
    return own.unionByName(inv(s, d).where(c(k) % 5 == 0).select(k, c("total").cast("string").alias("line_total")))


G = """(SELECT invoice_id, invoice_id % 7 <> 4 AS has, CASE WHEN invoice_id % 7 <> 3 THEN total - tax END AS s, (tax + CASE WHEN invoice_id % 7 = 1 THEN 1 ELSE 0 END)::DECIMAL(18,2) AS x, CASE WHEN invoice_id % 7 <> 2 THEN total END AS t,
 n, n_valid, l FROM (SELECT *, (total::DECIMAL(30,4) * 0.1)::DECIMAL(18,2) AS tax FROM invoices) LEFT JOIN (SELECT invoice_id, count(*) AS n, count(v) AS n_valid, sum(v) AS l FROM (
 SELECT invoice_id, CASE WHEN NOT (invoice_id % 10 = 9 AND line_number = 1) THEN net END AS v FROM lines WHERE invoice_id % 5 <> 0 UNION ALL SELECT invoice_id, total FROM invoices WHERE invoice_id % 5 = 0) GROUP BY 1) USING (invoice_id))"""
FINE = "(coalesce(abs(l - t) <= 0.01, false) OR coalesce(abs(l - s) <= 0.01, false))"
ISSUES = listed(
    row("NOT has", "arithmetic", "ERR_TOTALS_GROUP_MISSING", "error", "'groups.totals'"), row("has AND s IS NULL", "arithmetic", "ERR_AMOUNT_INVALID", "error", "'groups.totals.subtotal_amount'"),
    row("has AND t IS NULL", "arithmetic", "ERR_AMOUNT_INVALID", "error", "'groups.totals.total_amount'", observed="'n/a'"), row("has AND abs(s + x - t) > 0.01", "arithmetic", "ERR_LOGIC_MATH", "error", "'groups.totals.total_amount'", "(s + x)::DECIMAL(18,2)", "t"),
    row("has AND n <> n_valid", "arithmetic", "ERR_LINE_TOTAL_INVALID", "error", "'groups.table.line_items'"),
    row(f"has AND n = n_valid AND s IS NOT NULL AND NOT {FINE} AND l - s > 0.01", "arithmetic", "inferred_discount_amount", "info", "'groups.totals.subtotal_amount'", "(l - s)::DECIMAL(28,2)"),
    row(f"has AND n = n_valid AND s IS NOT NULL AND NOT {FINE} AND s - l > 0.01", "arithmetic", "ERR_SUBTOTAL_LINE_ITEMS_MISMATCH", "error", "'groups.totals.subtotal_amount'", "l::DECIMAL(28,2)", "s"),
    row("has AND n = n_valid AND s IS NULL AND abs(l - t) > 0.01", "arithmetic", "ERR_LINE_TOTAL_MISMATCH", "error", "'groups.table.line_items'", "t", "l::DECIMAL(28,2)"),
)


ARITHMETIC = f"SELECT invoice_id AS entity_id, x.* FROM (SELECT invoice_id, {ISSUES} AS x FROM {G})"


@query("vl_01", ARITHMETIC)
def vl_01(s, d):
    return validate.invoice_arithmetic(groups(s, d), line_texts(s, d))


@query(
    "vl_02",
    f"""SELECT invoice_id AS entity_id, x.* FROM (SELECT invoice_id, {listed(
        row("m = 4", "dates", "ERR_METADATA_GROUP_MISSING", "error", "'groups.metadata'"), row("m = 1", "dates", "ERR_DATE_INVALID", "error", "'groups.metadata.issue_date'", observed="strftime(issue_date, '%d/%m/%Y')"),
        row("m = 2", "dates", "ERR_DATE_INVALID", "error", "'groups.metadata.due_date'", observed="'2024-02-30'"), row("m = 3", "dates", "ERR_DATE_ORDER", "error", "'groups.metadata.due_date'", "issue_date", "issue_date - 1"))} AS x
        FROM (SELECT *, invoice_id % 6 AS m FROM invoices))""",
)
def vl_02(s, d):
    """Texts that are no ISO date, a day that no calendar has, a due date before the issue date, none at all, no group."""
    m = c(k) % 6
    issue = F.when(m == 1, F.date_format("issue_date", "dd/MM/yyyy")).otherwise(c("issue_date").cast("string"))
    due = F.when(m == 2, "2024-02-30").when(m == 3, F.date_sub("issue_date", 1).cast("string")).when(m != 5, c("due_date").cast("string"))
    return validate.invoice_dates(inv(s, d).select(k, (m != 4).alias("has_metadata"), issue.alias("issue_date"), due.alias("due_date")))


CODES = ["USD", "eur", "US", None, "VND", "CHF", "", "gbp"]
WRONG = lambda v, field, who="currency": (
    row(f"coalesce(length({v}) <> 3, true)", "currency", "ERR_CURRENCY_INVALID", "error", field, observed=v),
    row(f"length({v}) = 3 AND upper({v}) NOT IN {tuple(validate.ALLOWED)}", "currency", "ERR_CURRENCY_UNSUPPORTED", "error", field, observed=v),
)


@query("vl_03", f"SELECT invoice_id AS entity_id, x.* FROM (SELECT invoice_id, {listed(*WRONG('v', chr(39) + 'currency' + chr(39)))} AS x FROM (SELECT invoice_id, {sql_list(CODES)}[invoice_id % {len(CODES)} + 1] AS v FROM invoices))")
def vl_03(s, d):
    return validate.currencies(inv(s, d).select(k, of(k, *(F.lit(x) for x in CODES)).alias("currency")), k)


@query(
    "vl_04",
    f"""SELECT invoice_id AS entity_id, x.* FROM (SELECT invoice_id, {listed(*WRONG("m", "'groups.metadata.currency'"), *WRONG("t", "'groups.totals.currency'"), row("upper(m) <> upper(t)", "currency", "ERR_CURRENCY_MISMATCH", "error", "'groups.totals.currency'", "upper(m)", "upper(t)"))} AS x
        FROM (SELECT invoice_id, {sql_list(CODES)}[invoice_id % {len(CODES)} + 1] AS m, CASE WHEN invoice_id % 9 <> 0 THEN currency END AS t FROM invoices))""",
)
def vl_04(s, d):
    """The header's currency against that of the totals; either may be missing or wrong."""
    return validate.invoice_currencies(inv(s, d).select(k, of(k, *(F.lit(x) for x in CODES)).alias("metadata_currency"), F.when(c(k) % 9 != 0, c("currency")).alias("totals_currency")))


def of_import(s, d) -> DataFrame:
    return tx(s, d).withColumn("import_id", c("account_id"))


INDEX = "'transactions[' || row_index || '].{}'"


@query(
    "vl_05",
    f"""SELECT import_id AS entity_id, 'statement_dates' AS validator, 'ERR_STATEMENT_DATE_ORDER' AS code, 'error' AS severity, 'statement_import.statement_end_date' AS field_path, period_start::VARCHAR AS expected, period_end::VARCHAR AS observed FROM statements WHERE period_start > period_end
        UNION ALL SELECT account_id, x.* FROM (SELECT account_id, {listed(row("posted_at < period_start", "statement_dates", "ERR_TRANSACTION_BEFORE_STATEMENT", "error", INDEX.format("posted_at"), "period_start", "posted_at"),
        row("posted_at > period_end", "statement_dates", "ERR_TRANSACTION_AFTER_STATEMENT", "error", INDEX.format("posted_at"), "period_end", "posted_at"))} AS x FROM transactions JOIN (SELECT import_id AS account_id, period_start, period_end FROM statements) USING (account_id))""",
)
def vl_05(s, d):
    """Statement periods, and transactions before or after theirs; a join, so no account is one task's sort."""
    return validate.statement_dates(stm(s, d), of_import(s, d))


@query(
    "vl_06",
    f"""WITH st AS (SELECT import_id, CASE WHEN import_id % 6 <> 0 THEN lower(tc) END AS a, currency AS b, upper(coalesce(CASE WHEN import_id % 6 <> 0 THEN tc END, currency)) AS w FROM statements JOIN (SELECT tenant_id, currency AS tc FROM tenants) USING (tenant_id))
        SELECT import_id AS entity_id, x.* FROM (SELECT import_id, {listed(*WRONG("a", "'bank_account.currency'"), *WRONG("b", "'statement_import.currency'"))} AS x FROM st)
        UNION ALL SELECT import_id, x.* FROM (SELECT import_id, {listed(*WRONG("currency", INDEX.format("currency")), row("upper(currency) <> w", "currency", "ERR_CURRENCY_MISMATCH", "error", INDEX.format("currency"), "w", "upper(currency)"))} AS x
        FROM (SELECT account_id AS import_id, row_index, CASE WHEN row_index % 11 = 0 THEN 'CHF' ELSE currency END AS currency FROM transactions) JOIN st USING (import_id))""".replace("WITH st", "SELECT * FROM (WITH st", 1) + ")",
)
def vl_06(s, d):
    """Currencies of account, import and transactions; the account's, else the import's is expected."""
    own = V.tenants(s, d).select("tenant_id", F.lower("currency").alias("tc"))
    st = stm(s, d).join(own, "tenant_id").withColumn("account_currency", F.when(c("import_id") % 6 != 0, c("tc")))
    return validate.statement_currencies(st, of_import(s, d).withColumn("currency", F.when(c("row_index") % 11 == 0, "CHF").otherwise(c("currency"))))


HASH = "CASE row_index % 10 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE sha256(account_id || '|' || (amount::BIGINT % 50)::VARCHAR) END"


@query(
    "vl_07",
    f"""SELECT CASE WHEN key IS NULL THEN 'WARN_DEDUPE_KEY_MISSING' ELSE 'ERR_DUPLICATE_DETECTED' END AS code, CASE WHEN key IS NULL THEN 'warning' ELSE 'error' END AS severity, key AS dedupe_key, n, first_entity
        FROM (SELECT nullif(trim({HASH}), '') AS key, count(*) AS n, min(transaction_id) AS first_entity FROM transactions GROUP BY 1) WHERE n > 1 OR key IS NULL""",
)
def vl_07(s, d):
    """Transactions by content hash; some have none."""
    content = S.content_hash(c("account_id"), F.round("amount").cast("bigint") % 50)
    return validate.duplicate_issues(tx(s, d).withColumn("key", F.when(c("row_index") % 10 == 0, None).when(c("row_index") % 10 == 1, "  ").otherwise(content)).withColumnRenamed("key", "content_hash"), "content_hash", "transaction_id")


@query("ag_05", "SELECT CASE WHEN key IS NULL THEN 'WARN_DEDUPE_KEY_MISSING' ELSE 'ERR_DUPLICATE_DETECTED' END AS code, CASE WHEN key IS NULL THEN 'warning' ELSE 'error' END AS severity, key AS dedupe_key, n, first_entity FROM (SELECT CASE WHEN part_id % 13 <> 0 THEN invoice_id || ':' || line_number END AS key, count(*) AS n, min(part_id) AS first_entity FROM lines GROUP BY 1) WHERE n > 1 OR key IS NULL")
def ag_05(s, d):
    """Groups of lines that share a key, and how many have none."""
    key = F.when(c("part_id") % 13 != 0, F.concat_ws(":", c(k).cast("string"), c("line_number").cast("string")))
    return validate.duplicate_issues(lines(s, d).withColumn("dedupe", key), "dedupe", "part_id")


@query("ag_06", f"SELECT account_id, sum(n)::BIGINT AS n, count(*) FILTER (key IS NOT NULL) AS n_distinct, coalesce(sum(n - 1) FILTER (key IS NOT NULL), 0)::BIGINT AS n_duplicates FROM (SELECT account_id, nullif(trim({HASH}), '') AS key, count(*) AS n FROM transactions GROUP BY 1, 2) GROUP BY 1")
def ag_06(s, d):
    """Rows of an import and how many repeat a content hash; counted by hash first, so no account's hashes meet in one task."""
    content = S.content_hash(c("account_id"), F.round("amount").cast("bigint") % 50)
    rows = tx(s, d).select("account_id", F.when(c("row_index") % 10 > 1, content).alias("key")).groupBy("account_id", "key").agg(F.count("*").alias("m"))
    known = c("key").isNotNull()
    return rows.groupBy("account_id").agg(F.sum("m").alias("n"), F.count_if(known).alias("n_distinct"), F.coalesce(F.sum(F.when(known, c("m") - 1)), F.lit(0)).alias("n_duplicates"))


SUPPLIER, CUSTOMER = "tenant_name || ' Trading'", "CASE WHEN invoice_id % 13 = 0 THEN upper(tenant_name) || ' TRADING.' ELSE customer END"


ROLES = (
    f"""SELECT invoice_id AS entity_id, x.* FROM (SELECT invoice_id, {listed(row("invoice_id % 13 = 0", "party_roles", "ERR_PARTY_ROLE_CONFUSION", "error", "'groups.metadata.supplier_name'", "'different parties'", "s"),
        row("invoice_id % 5 = 0 OR invoice_id % 13 = 0", "party_roles", "ERR_PARTY_ROLE_CONFUSION", "error", "'groups.metadata'", "c || ' / ' || s", "s || ' / ' || c"))} AS x FROM (SELECT invoice_id, {SUPPLIER} AS s, {CUSTOMER} AS c FROM invoices JOIN (SELECT tenant_id, tenant_name FROM tenants) USING (tenant_id)))"""
)


@query("vl_08", ROLES)
def vl_08(s, d):
    """One party in both roles (its name printed otherwise), or names that stand in each other's region."""
    rows = inv(s, d).join(V.tenants(s, d).select("tenant_id", "tenant_name"), "tenant_id")
    supplier = F.concat("tenant_name", F.lit(" Trading"))
    customer = F.when(c(k) % 13 == 0, F.concat(F.upper("tenant_name"), F.lit(" TRADING."))).otherwise(c("customer"))
    rows = rows.select(c(k).alias("doc_id"), supplier.alias("supplier"), customer.alias("customer"))
    swap = c("doc_id") % 5 == 0
    page = lambda a, b: F.when(swap, F.concat(F.lit("From:\n"), b)).otherwise(F.concat(F.lit("From:\n"), a))
    return validate.party_roles(rows.withColumns({"supplier_region": page(c("supplier"), c("customer")), "bill_to_region": page(c("customer"), c("supplier"))}))


@query(
    "bd_15_signals",
    f"""SELECT invoice_id, CASE WHEN fix > 0 THEN 'correction_required' WHEN see > 0 THEN 'review_required' ELSE 'passed' END AS outcome, CASE WHEN coalesce(fix, 0) > 0 THEN fix ELSE coalesce(see, 0) END AS n_errors, coalesce(n, 0) AS n_signals, coalesce(codes, '') AS codes
        FROM invoices LEFT JOIN (SELECT entity_id AS invoice_id, count(*) AS n, count(*) FILTER (retry) AS fix, count(*) FILTER (NOT retry OR severity = 'error') AS see, array_to_string(list_sort(list_distinct(list(code))), ',') AS codes FROM (
        SELECT entity_id, code, severity, false AS retry FROM ({ARITHMETIC}) WHERE severity <> 'info' UNION ALL SELECT entity_id, code, severity, false FROM ({ROLES})
        UNION ALL SELECT invoice_id, 'ERR_LOGIC_MATH', 'error', true FROM invoices WHERE invoice_id % 14 = 1) GROUP BY 1) USING (invoice_id)""",
)
def bd_15_signals(s, d):
    """The QA outcome of each draft from all validators and from what earlier steps have signalled: some totals are to be read again by their extractor."""
    none = F.lit(None).cast("string")
    found = vl_01(s, d).where("severity <> 'info'").unionByName(vl_08(s, d)).select("entity_id", "code", "severity", F.lit(False).alias("retryable"), none.alias("target"))
    earlier = inv(s, d).where(c(k) % 14 == 1).select(c(k).alias("entity_id"), F.lit("ERR_LOGIC_MATH").alias("code"), F.lit("error").alias("severity"), F.lit(True).alias("retryable"), F.lit("totals").alias("target"))
    return validate.qa_outcomes(inv(s, d), k, found.unionByName(earlier))


#: Payloads of classification drafts and what is wrong with each.
PAYLOADS = [
    ('{"category_code":"rent_expense","confidence":"high","score":20,"refs":["a"]}', ""), ('{"category_code":"rent_expense","confidence":"certain","score":20,"refs":[]}', "confidence: not allowed"),
    ('{"confidence":"low","score":1}', "category_code: missing,refs: missing"), ('{"category_code":"x","confidence":"low","score":-1,"refs":[]}', "score: below 0"), ('{"category_code":"x","conf', "invalid JSON"), ("[1]", "not an object"),
    ('{"category_code":"x","confidence":"low","score":"many","refs":[],"more":1}', "score: not a number,more: not known"), (None, "invalid JSON"), ("{}", "category_code: missing,confidence: missing,score: missing,refs: missing"),
]
SCHEMAS = ["classification-draft.v1", "no-such-schema.v1"]


@query("vl_10", f"SELECT event_id, CASE WHEN event_id % 20 = 19 THEN 'schema not registered' ELSE {sql_list(p[1] for p in PAYLOADS)}[event_id % {len(PAYLOADS)} + 1] END AS errors, CASE WHEN event_id % 20 = 19 THEN false ELSE {sql_list(p[1] for p in PAYLOADS)}[event_id % {len(PAYLOADS)} + 1] = '' END AS valid FROM events")
def vl_10(s, d):
    """Payloads against the contract of their schema, errors listed: valid rows go on, the others are quarantined with their errors."""
    rows = V.table(s, d, "events").select("event_id", F.when(c("event_id") % 20 == 19, SCHEMAS[1]).otherwise(SCHEMAS[0]).alias("schema"), of("event_id", *(F.lit(p[0]) for p in PAYLOADS)).alias("payload"))
    return validate.contract(rows).select("event_id", F.array_join("errors", ",").alias("errors"), (F.size("errors") == 0).alias("valid"))


POLICY = {"allow_cloud": True, "require_consent": True, "use_cases": ["normal", "evaluation"], "deidentified_evaluation": True, "allow_sensitive": False, "redact": True, "max_chars": 20000}
GATE = listed(
    "CASE WHEN cloud AND doc_id % 7 = 0 THEN 'no tenant consent' END", "CASE WHEN cloud AND use_case = 'training' THEN 'use case not allowed' END", "CASE WHEN cloud AND use_case = 'evaluation' AND doc_id % 2 = 0 THEN 'evaluation needs de-identified data' END",
    "CASE WHEN cloud AND doc_id % 5 = 0 AND doc_id % 2 = 0 THEN 'sensitive payload' END",
)
BLOCKED = GATE.replace("unnest(", "array_to_string(", 1)[:-1] + ", ',')"


@query(
    "vl_11",
    f"""SELECT doc_id, action, reasons, CASE WHEN action = 'allow_redacted' THEN length(text) > 20000 END AS cut FROM (SELECT *, CASE WHEN NOT cloud THEN 'allow' WHEN reasons <> '' THEN 'block' ELSE 'allow_redacted' END AS action FROM (
        SELECT *, {BLOCKED} AS reasons FROM (SELECT doc_id, text, doc_id % 3 <> 0 AS cloud, ['normal', 'evaluation', 'training', 'normal'][doc_id % 4 + 1] AS use_case FROM documents)))""",
)
def vl_11(s, d):
    """The privacy gate: what blocks a payload of a cloud provider, and what goes on redacted and cut."""
    rows = V.table(s, d, "documents").select(
        "doc_id", "text", (c("doc_id") % 3 != 0).alias("cloud"), (c("doc_id") % 7 != 0).alias("consent"), of("doc_id", *map(F.lit, ("normal", "evaluation", "training", "normal"))).alias("use_case"),
        (c("doc_id") % 2 != 0).alias("deidentified"), (c("doc_id") % 5 == 0).alias("sensitive"),
    )
    out = validate.privacy_gate(rows, POLICY)
    return out.select("doc_id", "action", F.array_join("reasons", ",").alias("reasons"), F.when(c("action") == "allow_redacted", F.length("text") > POLICY["max_chars"]).alias("cut"))


# stages
#: Phase, label and percent of a stage (fixed values).
STAGES = {
    "ingested": ("queued", "Waiting for a worker", 0), "document_intake": ("intake", "Preparing document", 8), "layout_analysis": ("ocr", "Reading document with OCR", 25), "privacy_policy_gate": ("privacy", "Applying data policy", 32),
    "metadata_extraction": ("extraction", "Extracting invoice fields", 44), "table_extraction": ("extraction", "Extracting line items", 54), "totals_extraction": ("extraction", "Verifying invoice totals", 64), "invoice_assembly": ("extraction", "Assembling invoice proposal", 70),
    "qa_validation": ("qa", "Validating extracted data", 78), "classification": ("classification", "Classifying accounting category", 85), "reconciliation": ("reconciliation", "Checking bank transaction matches", 92), "review_coordination": ("review", "Preparing human review", 96),
    "insight_generation": ("insights", "Preparing business signals", 99), "completed": ("completed", "Workflow completed", 100), "failed": ("failed", "Workflow failed", 100),
}
#: The same by a run's status, which comes first (fixed values).
ENDED = {
    "queued": ("queued", "Queued for a worker", 0, False), "cancelled": ("cancelled", "Workflow cancelled before processing", 0, True), "review_required": ("review", "Awaiting human review", 100, True), "completed": ("completed", "Workflow completed", 100, True),
    **{x: ("failed", "Workflow needs attention", 100, True) for x in ("failed", "lost", "dead_lettered")},
}
NAMES, STATES = [*STAGES, "no_such_stage"], [*ENDED, "running", "running", "running"]
VALUES = lambda rows: ", ".join("(" + ", ".join(repr(x) if not isinstance(x, bool) else str(x).lower() for x in (i, *r)) + ")" for i, r in enumerate(rows))


@query(
    "scl_42",
    f"""SELECT event_id, coalesce(e.p, g.p, 'processing') AS phase, coalesce(e.l, g.l, 'Processing document') AS label, coalesce(e.n, g.n, 5) AS percent, coalesce(e.t, false) AS is_terminal FROM steps
        LEFT JOIN (VALUES {VALUES(STAGES.values())}) g(i, p, l, n) ON g.i = event_id % {len(NAMES)} LEFT JOIN (VALUES {VALUES(ENDED.values())}) e(i, p, l, n, t) ON e.i = event_id % {len(STATES)}""",
)
def scl_42(s, d):
    """A run's phase, label, percent and whether it has ended: by status where that tells, else by its stage; both tables have some ten rows."""
    stage = s.createDataFrame([(n, *p) for n, p in STAGES.items()], "stage string, p string, l string, n int")
    ended = s.createDataFrame([(n, *p) for n, p in ENDED.items()], "status string, ep string, el string, en int, et boolean")
    rows = V.steps(s, d).select("event_id", of("event_id", *map(F.lit, NAMES)).alias("stage"), of("event_id", *map(F.lit, STATES)).alias("status"))
    j = rows.join(F.broadcast(stage), "stage", "left").join(F.broadcast(ended), "status", "left")
    return j.select("event_id", F.coalesce("ep", "p", F.lit("processing")).alias("phase"), F.coalesce("el", "l", F.lit("Processing document")).alias("label"), F.coalesce("en", "n", F.lit(5)).alias("percent"), F.coalesce("et", F.lit(False)).alias("is_terminal"))


# review
TASKS = """(SELECT invoice_id AS task_id, ['extraction', 'insight', 'reconciliation'][invoice_id % 3 + 1] AS task_type, ['open', 'in_progress', 'resolved', 'dismissed'][invoice_id % 4 + 1] AS status FROM invoices WHERE invoice_id % 9 <> 0)"""


def tasks_and_decisions(s, d) -> tuple[DataFrame, DataFrame]:
    """Tasks in all states; decisions on all invoices (some have no task), and second thoughts on every fifth, some of them earlier."""
    i = inv(s, d)
    tasks = i.where(c(k) % 9 != 0).select(c(k).alias("task_id"), of(k, *map(F.lit, ("extraction", "insight", "reconciliation"))).alias("task_type"), of(k, *map(F.lit, ("open", "in_progress", "resolved", "dismissed"))).alias("status"))
    say = i.select(c(k).alias("task_id"), F.when(c(k) % 2 == 0, "approve").otherwise("reject").alias("decision"), F.lit(10).alias("decided_at"))
    again = i.where(c(k) % 5 == 0).select(c(k).alias("task_id"), F.lit("reject").alias("decision"), F.when(c(k) % 10 == 0, 5).otherwise(20).alias("decided_at"))
    return tasks, say.unionByName(again)


DECIDED = f"""(SELECT *, coalesce(status IN ('open', 'in_progress'), false) AS can FROM (SELECT invoice_id AS task_id, CASE WHEN invoice_id % 10 = 0 THEN 'reject' WHEN invoice_id % 2 = 0 THEN 'approve' ELSE 'reject' END AS decision,
 CASE WHEN invoice_id % 10 = 0 THEN 5 ELSE 10 END AS decided_at FROM invoices) LEFT JOIN {TASKS} USING (task_id))"""


@query("bd_10", f"SELECT task_id, task_type, 'resolved' AS status, CASE WHEN task_type = 'insight' THEN CASE decision WHEN 'approve' THEN 'published' ELSE 'dismissed' END ELSE CASE decision WHEN 'approve' THEN 'approved' ELSE 'rejected' END END AS resource_status FROM {DECIDED} WHERE can")
def bd_10(s, d):
    return review.decide(*tasks_and_decisions(s, d))[0]


@query(
    "bd_10_refused",
    f"""SELECT * FROM (SELECT a.task_id, a.decision, a.decided_at, CASE WHEN f.status IS NULL THEN 'missing' WHEN NOT f.can THEN f.status WHEN a.decided_at <> f.decided_at THEN 'decided_before' END AS found FROM (
        SELECT invoice_id AS task_id, CASE WHEN invoice_id % 2 = 0 THEN 'approve' ELSE 'reject' END AS decision, 10 AS decided_at FROM invoices
        UNION ALL SELECT invoice_id, 'reject', CASE WHEN invoice_id % 10 = 0 THEN 5 ELSE 20 END FROM invoices WHERE invoice_id % 5 = 0) a JOIN {DECIDED} f USING (task_id)) WHERE found IS NOT NULL""",
)
def bd_10_refused(s, d):
    """Decisions that change nothing, and why."""
    return review.decide(*tasks_and_decisions(s, d))[1]


@query(
    "bd_10_audit",
    f"""SELECT task_id, decision || '_' || task_type AS action, decided_at, '{{"status":"' || status || '"}}' AS before_state, '{{"status":"resolved","resource_status":"' || CASE WHEN task_type = 'insight' THEN CASE decision WHEN 'approve' THEN 'published' ELSE 'dismissed' END
        ELSE CASE decision WHEN 'approve' THEN 'approved' ELSE 'rejected' END END || '"}}' AS after_state FROM {DECIDED} WHERE can""",
)
def bd_10_audit(s, d):
    return review.decide(*tasks_and_decisions(s, d))[2]


FIELDS = ["total", "due_date", "customer"]


def versions(s, d) -> tuple[DataFrame, DataFrame]:
    """Invoices, every third in two versions (the first superseded), every seventh superseded as a whole; corrections, two for every tenth."""
    i = inv(s, d).select(k, F.lit(1).alias("version"), F.concat(F.lit("R"), c(k).cast("string")).alias("root_id"), F.when((c(k) % 3 == 0) | (c(k) % 7 == 0), "superseded").otherwise(c("status")).alias("status"), "customer", "total", "due_date")
    second = inv(s, d).where((c(k) % 3 == 0) & (c(k) % 7 != 0)).select(k, F.lit(2).alias("version"), F.concat(F.lit("R"), c(k).cast("string")).alias("root_id"), "status", "customer", (c("total") + 1).cast("decimal(18,2)").alias("total"), "due_date")
    change = of(
        k, F.create_map(F.lit("total"), F.lit("12.50")), F.create_map(F.lit("due_date"), F.lit("2030-01-02"), F.lit("customer"), F.lit("New Ltd")), F.create_map(F.lit("total"), F.lit("twelve")), F.create_map(F.lit("tenant_id"), F.lit("9")),
        F.create_map(F.lit("total"), F.lit(None).cast("string")),
    )
    fixes = inv(s, d).where(c(k) % 2 == 0).select((c(k) * 10).alias("correction_id"), k, change.alias("changes"))
    more = inv(s, d).where(c(k) % 10 == 0).select((c(k) * 10 + 1).alias("correction_id"), k, F.create_map(F.lit("total"), F.lit("1.00")).alias("changes"))
    return i.unionByName(second), fixes.unionByName(more)


#: Rows of versions(), and the invoices whose correction is carried out.
OLD = """(SELECT invoice_id, v AS version, 'R' || invoice_id AS root_id, CASE WHEN v = 1 AND (invoice_id % 3 = 0 OR invoice_id % 7 = 0) THEN 'superseded' ELSE status END AS status, customer,
 CASE v WHEN 2 THEN (total + 1)::DECIMAL(18,2) ELSE total END AS total, due_date, invoice_id % 2 = 0 AND invoice_id % 5 NOT IN (2, 3) AND invoice_id % 7 <> 0 AND v = CASE WHEN invoice_id % 3 = 0 THEN 2 ELSE 1 END AS hit
 FROM invoices, (VALUES (1), (2)) n(v) WHERE v = 1 OR (invoice_id % 3 = 0 AND invoice_id % 7 <> 0))"""
NEW = f"""SELECT invoice_id, version, root_id, CASE WHEN hit THEN 'superseded' ELSE status END AS status, customer, total, due_date FROM {OLD}
 UNION ALL SELECT invoice_id, version + 1, root_id, 'extracted', CASE WHEN invoice_id % 5 = 1 THEN 'New Ltd' ELSE customer END, CASE WHEN invoice_id % 5 = 0 THEN 12.50 ELSE total END::DECIMAL(18,2), CASE WHEN invoice_id % 5 = 1 THEN DATE '2030-01-02' ELSE due_date END FROM {OLD} WHERE hit"""


@query("bd_11", NEW)
def bd_11(s, d):
    return review.correct(*versions(s, d), FIELDS)[0]


@query(
    "bd_11_refused",
    """SELECT correction_id, invoice_id, CASE WHEN invoice_id % 7 = 0 THEN 'no_current_version' WHEN second THEN 'corrected_before' WHEN invoice_id % 5 = 3 THEN 'field_not_allowed' ELSE 'value_invalid' END AS refused
       FROM (SELECT invoice_id * 10 AS correction_id, invoice_id, false AS second FROM invoices WHERE invoice_id % 2 = 0 UNION ALL SELECT invoice_id * 10 + 1, invoice_id, true FROM invoices WHERE invoice_id % 10 = 0)
       WHERE invoice_id % 7 = 0 OR second OR invoice_id % 5 IN (2, 3)""",
)
def bd_11_refused(s, d):
    return review.correct(*versions(s, d), FIELDS)[1]


@query(
    "bd_11_lines",
    f"""WITH v AS {OLD}, l AS (SELECT v.invoice_id, version, hit, line_number, part_id, net FROM v JOIN lines USING (invoice_id))
        SELECT invoice_id, version, count(*) AS n_lines, sum(net) AS net, max(line_number) AS last_line FROM (SELECT * FROM l UNION ALL SELECT * REPLACE (version + 1 AS version) FROM l WHERE hit) GROUP BY 1, 2""".replace("WITH v", "SELECT * FROM (WITH v", 1) + ")",
)
def bd_11_lines(s, d):
    """Lines of all versions: a corrected invoice's new version has those of the version before."""
    before, fixes = versions(s, d)
    made = review.made_versions(before, review.correct(before, fixes, FIELDS)[0])
    own = before.select(k, "version").join(lines(s, d).select(k, "line_number", "part_id", "net"), k)
    return review.copied_lines(own, made).groupBy(k, "version").agg(F.count("*").alias("n_lines"), F.sum("net").alias("net"), F.max("line_number").alias("last_line"))


@query(
    "bd_11_tasks",
    f"""SELECT task_id, invoice_id, CASE WHEN done THEN version + 1 ELSE version END AS version, CASE WHEN done THEN 'resolved' ELSE status END AS status FROM (SELECT task_id, invoice_id, w.version, CASE WHEN task_id % 2 = 0 THEN 'open' ELSE 'in_progress' END AS status,
        task_id % 10 = 0 AND invoice_id IN (SELECT invoice_id FROM {OLD} WHERE hit) AS done FROM (SELECT invoice_id, unnest([invoice_id * 10, invoice_id * 10 + 1]) AS task_id FROM invoices) JOIN (SELECT invoice_id, max(version) AS version FROM {OLD} GROUP BY 1) w USING (invoice_id))""",
)
def bd_11_tasks(s, d):
    """Two review tasks of each invoice: the one whose correction was carried out is resolved and names the new version."""
    before, fixes = versions(s, d)
    after, refused = review.correct(before, fixes, FIELDS)
    last = before.groupBy(k).agg(F.max("version").alias("version"))
    tasks = last.select(F.explode(F.array(c(k) * 10, c(k) * 10 + 1)).alias("task_id"), k, "version").withColumn("status", F.when(c("task_id") % 2 == 0, "open").otherwise("in_progress"))
    return review.repointed_tasks(tasks, fixes.withColumn("task_id", c("correction_id")), refused, review.made_versions(before, after))


@query("wn_10", f"SELECT root_id, count(*) AS n_versions, max(version) AS version, string_agg(version::VARCHAR, '<' ORDER BY version) AS chain, max(total) FILTER (version = top AND status <> 'superseded') AS total FROM (SELECT *, max(version) OVER (PARTITION BY root_id) AS top FROM ({NEW})) GROUP BY 1")
def wn_10(s, d):
    """Chains of versions by their root: how many, which is current, and its total; null where all are superseded. A record's versions are few."""
    one = F.struct("version", "status", "total")
    g = bd_11(s, d).groupBy("root_id").agg(F.count("*").alias("n_versions"), F.max(one).alias("x"), F.array_sort(F.collect_list("version")).alias("v"))
    return g.select("root_id", "n_versions", "x.version", F.array_join(F.transform("v", lambda v: v.cast("string")), "<").alias("chain"), F.when(c("x.status") != "superseded", c("x.total")).alias("total"))


#: The orders of a customer as versions of one record; of some the first supersedes one that isn't there, of some it supersedes the last.
VERSIONS = "(SELECT invoice_id, customer_id, row_number() OVER w AS version, first_value(invoice_id) OVER w AS root FROM invoices WINDOW w AS (PARTITION BY customer_id ORDER BY invoice_id))"


@query("wn_10_chains", f"SELECT invoice_id AS id, CASE WHEN customer_id % 11 <> 0 THEN root END AS root_id, CASE WHEN customer_id % 11 <> 0 THEN version END AS version, CASE WHEN customer_id % 11 = 0 THEN 'cycle' WHEN customer_id % 7 = 0 THEN 'orphan' ELSE 'ok' END AS state FROM {VERSIONS}")
def wn_10_chains(s, d):
    """Versions that only know what they supersede, followed to the first."""
    of = Window.partitionBy("customer_id").orderBy(k)
    last = F.max(k).over(Window.partitionBy("customer_id"))
    first = F.when(c("customer_id") % 11 == 0, last).when(c("customer_id") % 7 == 0, F.lit(-1))
    return chains.roots(inv(s, d).select(c(k).alias("id"), F.coalesce(F.lag(k).over(of), first).alias("supersedes_id")))


# filters
query("flt_01", "SELECT invoice_id, total, n FROM invoices LEFT JOIN (SELECT account_id AS customer_id, count(*) AS n FROM transactions WHERE tenant_id = 3 GROUP BY 1) USING (customer_id) WHERE tenant_id = 3")(
    lambda s, d: (lambda read: read(inv).join(read(tx).groupBy(c("account_id").alias("customer_id")).agg(F.count("*").alias("n")), "customer_id", "left").select(k, "total", "n"))(V.reader(s, d, 3))
)
query("flt_02", "SELECT 'transaction' AS kind, transaction_id AS id, amount FROM transactions WHERE status = 'posted' UNION ALL SELECT 'statement', import_id::VARCHAR, closing_balance FROM statements WHERE status = 'parsed' AND closing_balance IS NOT NULL")(
    lambda s, d: tx(s, d).where("status = 'posted'").select(F.lit("transaction").alias("kind"), c("transaction_id").alias("id"), "amount").unionByName(
        stm(s, d).where("status = 'parsed' AND closing_balance IS NOT NULL").select(F.lit("statement").alias("kind"), c("import_id").cast("string").alias("id"), c("closing_balance").alias("amount"))
    )
)
SEARCHED = ["description", "counterparty", "reference", "currency", "direction", "status"]
query("flt_06", f"SELECT transaction_id FROM transactions WHERE contains(lower(concat_ws(chr(1), {', '.join(SEARCHED)})), 'rent')")(lambda s, d: tx(s, d).where(F.lower(F.concat_ws("\x01", *SEARCHED)).contains("rent")).select("transaction_id"))
