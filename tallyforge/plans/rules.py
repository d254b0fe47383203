"""Scalar rules on hard inputs (null, malformed, ambiguous), over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.plans.catalog import cases, projection, query
from tallyforge.sources import views as V

c, inv, tx, lines, steps, docs = F.col, V.invoices, V.transactions, V.invoice_lines, V.steps, V.table_of("documents")

FOUND = r"nullif(regexp_extract(replace(rest, '#', ' '), '(?:^|\s)(\S*-\S*[0-9]\S*|\S*[0-9]\S*-\S*)(?:\s|$)', 1), '')"
projection(
    "scl_11", tx,
    f"""SELECT transaction_id, CASE WHEN found IS NULL THEN nullif(rest, '') ELSE nullif(trim(replace(rest, found, '')), '') END AS party
        FROM (SELECT transaction_id, rest, {FOUND} AS found FROM (SELECT transaction_id, trim(regexp_replace(description, '^(ACH PAYMENT|PAYMENT) ', '')) AS rest FROM transactions))""",
    lambda: ["transaction_id", S.extract_counterparty(c("description")).alias("party")],
)
KEY = "account_id::VARCHAR, posted_at::VARCHAR, description, amount::VARCHAR, coalesce(running_balance::VARCHAR, 'None')"
projection(
    "scl_12", tx, f"SELECT transaction_id, sha256(concat_ws('|', {KEY}, row_index::VARCHAR)) AS hash, sha256(concat_ws('|', {KEY})) AS hash_of_any_row FROM transactions",
    lambda: (lambda key: ["transaction_id", S.content_hash(*key, c("row_index")).alias("hash"), S.content_hash(*key).alias("hash_of_any_row")])(
        [c(x) for x in ("account_id", "posted_at", "description", "amount", "running_balance")]
    ),
)
projection("scl_13", V.statements, "SELECT account_id, sha256(bank_name || '|' || account_number) AS hash FROM statements", lambda: ["account_id", S.content_hash(c("bank_name"), c("account_number")).alias("hash")])
projection(
    "scl_14", tx, r"""SELECT transaction_id, concat_ws(' ', nullif(trim(description), ''), nullif(trim(lower(description)), ''), nullif(trim(counterparty), ''), nullif(trim(reference), '')) AS text FROM transactions""",
    lambda: ["transaction_id", S.descriptor(c("description"), S.normal_reference(c("description")), c("counterparty"), c("reference")).alias("text")],
)


@query(
    "scl_17",
    """SELECT invoice_id, rank, rank >= 2 AS passes, ['unknown','low','medium','high'][least(rank, CASE WHEN invoice_id % 3 <> 0 THEN invoice_id % 4 END) + 1] AS combined
       FROM (SELECT invoice_id, CASE WHEN invoice_id % 101 >= 85 THEN 3 WHEN invoice_id % 101 >= 70 THEN 2 WHEN invoice_id % 101 > 0 THEN 1 ELSE 0 END AS rank FROM invoices)""",
)
def scl_17(s, d):
    """Rank, the test against a floor of medium, and the lowest of two groups, one of which may be missing."""
    own = S.score_confidence(c("invoice_id") % 101)
    other = F.when(c("invoice_id") % 3 != 0, F.get(F.array(*map(F.lit, S.CONFIDENCE_RANK)), (c("invoice_id") % 4).cast("int")))
    return inv(s, d).select("invoice_id", S.confidence_rank(own).alias("rank"), S.at_least(own, F.lit("medium")).alias("passes"), S.combined_confidence(own, other).alias("combined"))


QUANTITY = lambda q: S.quantity_token(F.split(q, "/")[0], F.split(q, "/")[1].try_cast("decimal(18,2)"), F.split(q, "/")[2].try_cast("decimal(18,2)"))
cases(
    "scl_21", inv, "invoices", "invoice_id",
    [("1234//", "12.34", "1234.00"), ("$1,234.50/2.00/3", "1234.50", None), ("300/x/y", "3.00", "3.00"), ("2.5/0/9", "2.50", "2.50"), ("7/2.50/17.50", "0.07", "7.00"), (None, None, None)],
    money=lambda x: S.money_token(F.split(x, "/")[0]), quantity=lambda x: F.when(~x.contains("$"), QUANTITY(x)),
)
cases(
    "scl_27", inv, "invoices", "invoice_id",
    [
        ("2024-06-05", "2024-06-05", "2024-06-05"), ("05/06/24", "2024-06-05", "2024-06-05"), ("05/06/2024", "2024-06-05", "2024-05-06"), ("25/12/2023", "2023-12-25", "2023-12-25"), ("12/25/2023", "2023-12-25", "2023-12-25"),
        ("2024.6.5", "2024-06-05", "2024-06-05"), ("31-02-2024", None, None), ("5 June", None, None), ("", None, None), (None, None, None), ("13/13/2024", None, None), (" 1-2-25 ", "2025-02-01", "2025-02-01"),
    ],
    day_first=lambda x: S.day(x, True), month_first=lambda x: S.day(x, False),
)
projection("scl_28", docs, f"SELECT doc_id, regexp_matches(lower(text), '{'|'.join(S.DAY_FIRST)}') AS day_first FROM documents", lambda: ["doc_id", S.day_first_hint(c("text")).alias("day_first")])
cases(
    "scl_32", inv, "invoices", "invoice_id",
    [
        ("Fatura Nº 12-A, 05/06/2024: 1.234,50 EUR", "faturanº12a050620241234 50eur".replace(" ", ""), "2024-05-06,2024-06-05", "5.00,12.00,1234.50,2024.00"), ("due 2024-06-05", "due20240605", "2024-06-05", "-6.00,-5.00,2024.00"),
        ("7.50", "750", "", "7.50"), ("no key", "nokey", "", ""), ("", "", "", ""), (None, None, None, None),
    ],
    text_key=S.alnum, dates=lambda x: F.array_join(F.transform(S.date_keys(x), lambda v: v.cast("string")), ","), amounts=lambda x: F.array_join(F.transform(F.filter(S.amount_keys(x), lambda v: v != 6), lambda v: v.cast("string")), ","),
)
cases(
    "scl_33", inv, "invoices", "invoice_id",
    [("Sol & Mar, Lda.", "solmarlda", "true", "true"), ("Padaria do", "padariado", "false", "false"), ("", "", "false", "false"), ("sol-mar-lda", "solmarlda", "true", "true"), (None, None, "false", "false"), ("Casa Das", "casadas", "false", "false")],
    party=S.party_key, contained=lambda x: S.contains_party(F.lit("Bill to: SOL & MAR LDA, Rua 1"), x), whole=S.whole_name,
)
cases(
    "scl_34", docs, "documents", "doc_id",
    [
        ("mail a.b@x.org now", "mail [REDACTED_EMAIL] now", "1"), ("id 123-45-6789", "id [REDACTED_SSN]", "1"), ("card 4111 1111 1111 1111 ok", "card [REDACTED_ACCOUNT_NUMBER]ok", "1"), ("EIN: 12-3456789", "[REDACTED_TAX_ID]", "1"),
        ("MST 0312345678", "[REDACTED_TAX_ID]", "1"), ("Account #AB12 and acct 9876", "[REDACTED_ACCOUNT] and [REDACTED_ACCOUNT]", "2"), ("bank account: X-991", "[REDACTED_ACCOUNT]", "1"), ("tin abc", "tin abc", "0"),
        ("x" * 79 + "  y", "x" * 79 + S.TRUNCATED, "0"), ("", "", "0"), (None, None, None),
    ],
    redacted=lambda x: S.redacted(x, 81)[0], n=lambda x: S.redacted(x, 81)[1],
)
MASKED = """'{"number":"' || number || '","customer_name":"[REDACTED]","party":"[REDACTED]","lines":[{"description":"Part","account_no":"[REDACTED]"}],"steps":{"prompt":"[REDACTED]","note":{"reply_email":"[REDACTED]","n":' || invoice_id || '}}}'"""


@query(
    "scl_35",
    f"""SELECT invoice_id, CASE WHEN invoice_id % 7 = 0 THEN NULL WHEN invoice_id % 5 = 0 THEN '{{"_truncated":true,"payload_chars":' || length(x) || ',"payload_preview":"' || replace(substr(x, 1, 60), '"', '\\"') || '"}}' ELSE x END AS shown,
        '{{"customer_email":"[REDACTED]","status":"' || status || '","Total_Amount":"[REDACTED]"}}' AS record FROM (SELECT *, {MASKED} AS x FROM invoices)""".replace("\\\\", "\\"),
)
def scl_35(s, d):
    """Payloads of traces with sensitive keys at several depths (texts, numbers, lists and objects below them are masked), cut or no JSON; and the attributes of log records."""
    note = F.struct(F.lit("x@y.org").alias("reply_email"), c("invoice_id").alias("n"))
    body = F.struct("number", c("customer").alias("customer_name"), F.struct(c("customer").alias("name")).alias("party"), F.array(F.struct(F.lit("Part").alias("description"), c("customer_id").alias("account_no"))).alias("lines"), F.struct(F.array(F.lit("a"), c("number")).alias("prompt"), note.alias("note")).alias("steps"))
    payload = F.when(c("invoice_id") % 7 != 0, F.to_json(body)).otherwise("{not json")
    rows = inv(s, d).select("invoice_id", "status", "customer", "total", payload.alias("payload"))
    shown = F.when(c("invoice_id") % 5 == 0, S.redacted_json(c("payload"), 60)).otherwise(S.redacted_json(c("payload")))
    return rows.select("invoice_id", shown.alias("shown"), F.to_json(S.redacted_keys(F.create_map(F.lit("customer_email"), c("customer"), F.lit("status"), c("status"), F.lit("Total_Amount"), c("total").cast("string")))).alias("record"))


projection(
    "scl_38", inv, "SELECT invoice_id, format('{:,.2f}', total::DOUBLE) || ' ' || currency AS shown, format('{:.2f}', (total::DECIMAL(18,2))::DOUBLE) AS share FROM invoices",
    lambda: ["invoice_id", S.format_money(c("total"), c("currency")).alias("shown"), S.format_percentage(c("total")).alias("share")],
)
projection(
    "scl_40", tx,
    """SELECT transaction_id, 'uncategorized_' || t AS category, CASE t WHEN 'revenue' THEN 'income' ELSE t END AS direction FROM (SELECT transaction_id, CASE WHEN k % 3 = 0 THEN CASE direction WHEN 'inflow' THEN 'revenue' ELSE 'expense' END
       WHEN k % 3 = 1 THEN CASE WHEN amount > 0 THEN 'revenue' WHEN amount < 0 THEN 'expense' ELSE 'other' END ELSE 'other' END AS t FROM (SELECT *, substr(transaction_id, 2)::BIGINT AS k FROM transactions))""",
    lambda: (lambda k: (lambda d, a: ["transaction_id", S.fallback_category(d, a).alias("category"), S.category_direction(S.fallback_type(d, a)).alias("direction")])(F.when(k % 3 == 0, c("direction")), F.when(k % 3 != 2, c("amount"))))(
        F.substr("transaction_id", F.lit(2)).cast("bigint")
    ),
)
