"""All queries by name, each over whole tables, and the DuckDB SQL that says the same."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import documents, insights, opslog, ordered, reconcile, review, validate
from tallyforge.plans.catalog import ORACLES, QUERIES, projection, query
from tallyforge.sources import views as V
from tallyforge.streaming import alerts

c, tx, inv, lines = F.col, V.transactions, V.invoices, V.invoice_lines

# scalar rules over whole tables
projection("scl_01", tx, "SELECT transaction_id, amount::DECIMAL(38,10) AS parsed FROM transactions", lambda: ["transaction_id", S.parse_decimal(F.concat(F.lit(" "), F.format_number("amount", 2), F.lit(" "))).alias("parsed")])
projection("scl_02", inv, "SELECT invoice_id, CASE WHEN invoice_id % 2 = 0 THEN issue_date END AS parsed FROM invoices", lambda: ["invoice_id", S.parse_iso_date(F.when(c("invoice_id") % 2 == 0, c("issue_date").cast("string")).otherwise(F.date_format("issue_date", "d/M/yyyy"))).alias("parsed")])
projection("scl_03", tx, "SELECT transaction_id, posted_at AS parsed FROM transactions", lambda: ["transaction_id", S.statement_date(F.when(c("amount") > 0, F.date_format("posted_at", "M/d/yyyy")).otherwise(c("posted_at").cast("string"))).alias("parsed")])
projection("scl_04", lines, "SELECT invoice_id, line_number, part_id, net, round_even(net * 0.125, 2)::DECIMAL(18,2) AS part FROM lines", lambda: ["invoice_id", "line_number", "part_id", "net", S.money(c("net") * F.lit("0.125").cast("decimal(4,3)")).alias("part")])
projection("scl_05", lines, "SELECT invoice_id, line_number, part_id, net, round(net::DECIMAL(18,2) * 0.125::DECIMAL(4,3), 2)::DECIMAL(18,2) AS part FROM lines", lambda: ["invoice_id", "line_number", "part_id", "net", S.percentage(c("net") * F.lit("0.125").cast("decimal(4,3)")).cast("decimal(18,2)").alias("part")])
projection("scl_06", tx, "SELECT transaction_id, CASE direction WHEN 'inflow' THEN abs(amount) ELSE -abs(amount) END AS signed FROM transactions", lambda: ["transaction_id", S.signed_amount(F.abs("amount"), c("direction")).alias("signed")])
projection("scl_07", tx, "SELECT transaction_id, coalesce(currency, 'UNK') AS bucket FROM transactions", lambda: ["transaction_id", S.currency_bucket(c("currency")).alias("bucket")])
projection("scl_08", inv, "SELECT invoice_id, CASE WHEN invoice_id % 5 = 4 THEN NULL ELSE ['USD','EUR','GBP','JPY'][invoice_id % 5 + 1] END AS code FROM invoices", lambda: ["invoice_id", S.currency_code(F.element_at(F.array(*map(F.lit, (" $", "euro ", "£", "jpy", "12"))), (c("invoice_id") % 5 + 1).cast("int"))).alias("code")])
projection("scl_09", tx, r"SELECT transaction_id, regexp_replace(lower(trim(description)), '\s+', ' ', 'g') AS plain, replace(regexp_replace(lower(trim(description)), '\s+', ' ', 'g'), '-', '') AS compact FROM transactions", lambda: ["transaction_id", S.normal_reference(c("description")).alias("plain"), S.compact_reference(c("description")).alias("compact")])
projection("scl_10", tx, r"SELECT transaction_id, nullif(regexp_extract(replace(description, '#', ' '), '(?:^|\s)(\S*-\S*[0-9]\S*|\S*[0-9]\S*-\S*)(?:\s|$)', 1), '') AS found FROM transactions", lambda: ["transaction_id", S.extract_reference(c("description")).alias("found")])
projection("scl_15", tx, r"SELECT transaction_id, regexp_matches(lower(description), '\bbank\s+fee\b') AS hit FROM transactions", lambda: ["transaction_id", S.keyword(c("description"), "bank fee").alias("hit")])
projection("scl_16", inv, "SELECT invoice_id, CASE WHEN invoice_id % 101 >= 85 THEN 'high' WHEN invoice_id % 101 >= 70 THEN 'medium' WHEN invoice_id % 101 > 0 THEN 'low' ELSE 'unknown' END AS confidence FROM invoices", lambda: ["invoice_id", S.score_confidence(c("invoice_id") % 101).alias("confidence")])
projection("scl_19", V.steps, "SELECT event_id, CASE WHEN ms < 0 THEN NULL WHEN ms <= 1 THEN ms WHEN ms <= 100 THEN ms / 100 END AS confidence FROM steps", lambda: ["event_id", S.ocr_confidence(c("ms")).alias("confidence")])
projection("scl_20", tx, "SELECT transaction_id, amount AS cleaned FROM transactions", lambda: ["transaction_id", S.clean_money(F.when(c("direction") == "inflow", F.format_number("amount", 2)).otherwise(F.translate(F.format_number("amount", 2), ",.", ".,"))).alias("cleaned")])
projection("scl_24", inv, "SELECT invoice_id, regexp_replace(number, '[^0-9]', '', 'g') AS id FROM invoices", lambda: ["invoice_id", S.identifier(c("number")).alias("id")])
projection("scl_36", V.steps, "SELECT event_id, (attempt::DECIMAL(18,0) * 0.003)::DECIMAL(18,6) AS cost FROM steps", lambda: ["event_id", S.token_cost(c("attempt") * 1000, F.lit("0.003").cast("decimal(6,3)")).alias("cost")])

def redaction_sql() -> str:
    """The redactions one after the other, with a count of each. Word boundaries of SQL know ASCII alone: after the e-mails, letters and digits of
    other scripts stand between underscores and a mark, in the text as in the patterns, until all is done."""
    fenced = lambda t: f"regexp_replace({t}, '([^\\P{{L}}\\x00-\\x7F]|[^\\P{{N}}\\x00-\\x7F])', '_' || chr(1) || '\\1' || chr(1) || '_', 'g')"
    bare = lambda t: f"regexp_replace({t}, '_' || chr(1) || '(.)' || chr(1) || '_', '\\1', 'g')"
    sql, names = "SELECT doc_id, coalesce(text, '') AS t, text IS NULL AS none FROM documents", []
    for name, pattern, mark in S.REDACTIONS:
        rule = re.sub("([^\x00-\x7f])", r"_\\x01\1\\x01_", pattern.replace("(?iu)", "(?i)"))
        sql = f"SELECT * REPLACE (regexp_replace(t, '{rule}', '{mark}', 'g') AS t), len(regexp_extract_all(t, '{rule}')) AS n_{name} FROM ({sql})"
        if name == "email":
            sql = f"SELECT * REPLACE ({fenced('t')} AS t) FROM ({sql})"
        names.append(f"CASE WHEN NOT none THEN n_{name} END AS n_{name}")
    sql = f"SELECT * REPLACE ({bare('t')} AS t) FROM ({sql})"
    return f"SELECT doc_id, {', '.join(names)}, CASE WHEN NOT none THEN length(t) END AS n_chars, CASE WHEN NOT none THEN sha256(t) END AS redacted_sha256 FROM ({sql})"


@query("ex_12_corpus", redaction_sql())
def ex_12_corpus(s, d):
    """The redacted corpus: how many places each pattern took, and length and hash of the text that is left."""
    text, counts = S.redaction_counts(c("text"))
    return V.table(s, d, "documents").select("doc_id", *(n.alias(f"n_{name}") for name, n in counts.items()), F.length(text).alias("n_chars"), F.sha2(text, 256).alias("redacted_sha256"))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("ex_12", rf"SELECT doc_id, len(regexp_extract_all(text, '{EMAIL}')) AS emails FROM documents")
def ex_12(s, d):
    """Redaction over the whole corpus; the oracle counts the addresses."""
    docs = V.table(s, d, "documents")
    text, _ = S.redacted(c("text"))
    return docs.select("doc_id", text.alias("redacted"), c("text")).select("doc_id", (F.regexp_count("redacted", F.lit(r"\[REDACTED_EMAIL\]")) - F.regexp_count("text", F.lit(r"\[REDACTED_EMAIL\]"))).alias("emails"))


@query("ex_01", r"""SELECT doc_id, len(l) AS n_lines, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0)::BIGINT AS n_chars FROM (SELECT doc_id,
 list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'), lambda x: trim(regexp_replace(x, '[\s\x0B\x{85}\p{Z}]+', ' ', 'g'), ' ''‘’“”')), lambda x: x <> '') AS l FROM documents)""")
def ex_01(s, d):
    """Lines of each document: white space collapsed, quotes at the ends and blank lines gone."""
    rows = V.table(s, d, "documents").select("doc_id", documents.lines(c("text")).alias("l"))
    return rows.select("doc_id", F.size("l").alias("n_lines"), F.aggregate("l", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x)).alias("n_chars"))


# filters
def filtered(name: str, view, sql: str, columns) -> None:
    """columns: the test, then what to return."""
    query(name, sql)(lambda s, d: (lambda test, *out: view(s, d).where(test).select(*out))(*columns()))


filtered("flt_03", inv, "SELECT invoice_id, status FROM invoices WHERE status <> 'superseded'", lambda: [c("status") != "superseded", "invoice_id", "status"])
filtered("flt_05", inv, "SELECT invoice_id, priority FROM invoices WHERE status = 'pending_review'", lambda: [c("status") == "pending_review", "invoice_id", "priority"])
filtered("flt_07", tx, "SELECT transaction_id, amount FROM transactions WHERE direction = 'inflow' OR amount > 0", lambda: [(c("direction") == "inflow") | (c("amount") > 0), "transaction_id", "amount"])

# joins
SCORE = f"""
{V.BOOKED},
pairs AS (SELECT i.tenant_id, invoice_id, transaction_id, total, amount, abs(total - abs(amount)) AS diff, date_diff('day', due_date, paid_at) AS late, date_diff('day', paid_at, issue_date) AS early,
  paid_at, issue_date, due_date, lower(number) AS num, lower(concat_ws(' ', reference, description, counterparty)) AS txt, coalesce(i.currency <> t.currency, false) AS clash
  FROM invoices i JOIN (SELECT *, coalesce(posted_at, value_at) AS paid_at FROM booked) t ON i.tenant_id = t.tenant_id AND abs(t.amount) BETWEEN i.total - greatest(i.total / 100, 1) - 1 AND i.total + greatest(i.total / 100, 1) + 1),
parts AS (SELECT *, CASE WHEN diff <= 0.01 THEN 50 WHEN diff <= greatest(total::DECIMAL(30,4) / 100, 1) THEN 35 WHEN diff <= greatest(total / 20, 5) THEN 15 ELSE 0 END AS amount_score,
  CASE WHEN paid_at BETWEEN issue_date AND due_date THEN 20 WHEN late BETWEEN 1 AND 7 THEN 15 WHEN early BETWEEN 1 AND 7 THEN 10 ELSE 0 END AS date_score,
  CASE WHEN contains(txt, num) THEN 30 WHEN contains(replace(txt, '-', ''), replace(num, '-', '')) THEN 25 ELSE 0 END AS reference_score FROM pairs),
found AS (SELECT tenant_id, invoice_id, transaction_id, total, amount, amount_score, date_score, reference_score, CASE WHEN clash THEN 0 ELSE least(100, amount_score + date_score + reference_score) END AS score FROM parts),
kept AS (SELECT * FROM found WHERE score >= 70),
ranked AS (SELECT *, count(*) OVER (PARTITION BY invoice_id) AS n_candidates, row_number() OVER (PARTITION BY invoice_id ORDER BY score DESC, transaction_id) AS rn FROM kept)
"""


def scored(sql: str) -> str:
    return V.oracle("SELECT 1").rsplit("\nSELECT 1", 1)[0].rstrip() + ",\n" + SCORE.strip() + "\n" + sql


def found(s, d):
    return reconcile.candidates(inv(s, d), V.booked(s, d))


QUERIES["jn_01"], ORACLES["jn_01"] = (lambda s, d: found(s, d)), scored("SELECT * FROM kept")
QUERIES["wn_04"], ORACLES["wn_04"] = (lambda s, d: reconcile.best(found(s, d)).select("invoice_id", "transaction_id", "score", "n_candidates")), scored("SELECT invoice_id, transaction_id, score, n_candidates FROM ranked WHERE rn = 1")
QUERIES["bd_04"] = lambda s, d: reconcile.proposals(reconcile.best(found(s, d))).drop("tenant_id")
ORACLES["bd_04"] = scored("SELECT invoice_id, transaction_id, score, n_candidates, CASE WHEN n_candidates > 1 OR score < 85 THEN 'pending_review' ELSE 'proposed' END AS status, CASE WHEN score >= 85 THEN 'high' ELSE 'medium' END AS confidence, (abs(amount) - total)::DECIMAL(18,2) AS difference FROM ranked WHERE rn = 1")


def bd_05(s, d):
    b = reconcile.best(found(s, d)).select("invoice_id", "score", "n_candidates")
    return inv(s, d).select("invoice_id").join(b, "invoice_id", "left").select("invoice_id", reconcile.decision(c("score"), c("n_candidates")).alias("decision"))


QUERIES["bd_05"] = bd_05
ORACLES["bd_05"] = scored("SELECT i.invoice_id, CASE WHEN n_candidates IS NULL THEN 'no_matching_transaction' WHEN n_candidates > 1 THEN 'ambiguous_match' WHEN score < 85 THEN 'low_confidence_match' ELSE 'ready' END AS decision FROM invoices i LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r USING (invoice_id)")
QUERIES["so_06"] = lambda s, d: tx(s, d).join(found(s, d), "transaction_id", "left_anti").select("transaction_id", "amount")
ORACLES["so_06"] = scored("SELECT transaction_id, amount FROM transactions WHERE transaction_id NOT IN (SELECT transaction_id FROM kept)")
QUERIES["tk_01"] = lambda s, d: found(s, d).withColumn("place", F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("score"), "transaction_id", "invoice_id"))).where("place <= 20").select("tenant_id", "place", "transaction_id", "invoice_id", "score")
ORACLES["tk_01"] = scored("SELECT tenant_id, place, transaction_id, invoice_id, score FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY score DESC, transaction_id, invoice_id) AS place FROM kept) WHERE place <= 20")


# aggregations
def monthly(s, d):
    return tx(s, d).withColumn("month", F.trunc("posted_at", "month"))


query("ag_07", "SELECT tenant_id, count(*) AS total FROM invoices GROUP BY 1")(lambda s, d: inv(s, d).groupBy("tenant_id").agg(F.count("*").alias("total")))


# windows
query("wn_08", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM steps")(lambda s, d: ordered.numbered(V.steps(s, d), ["user_id"], ["ts", "event_id"], "step").select("event_id", "user_id", "step"))


@query("jn_11", """SELECT a.event_id AS handoff, b.event_id AS signal FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM steps WHERE failed) a
 JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM steps WHERE agent = 'click') b ON a.user_id = b.user_id AND a.n = b.n""")
def jn_11(s, d):
    """The nth failure of a user meets its nth signal; both are numbered by ranges, so no user is sorted as a whole."""
    e = V.steps(s, d)
    side = lambda rows, name: ordered.numbered(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "n", c("event_id").alias(name))
    return side(e.where("failed"), "handoff").join(side(e.where("agent = 'click'"), "signal"), ["user_id", "n"]).select("handoff", "signal")


query("tk_02", "SELECT transaction_id, posted_at, amount FROM transactions ORDER BY posted_at DESC, transaction_id LIMIT 50 OFFSET 50")(lambda s, d: tx(s, d).orderBy(F.desc_nulls_last("posted_at"), "transaction_id").offset(50).limit(50).select("transaction_id", "posted_at", "amount"))

# validation

# insights, review


# operations log
ROLL = "SELECT {k}, count(*) AS n, count(*) FILTER (failed) AS failures, sum(greatest(attempt - 1, 0))::BIGINT AS retries, sum(ms) / count(*) AS avg_ms, max(ms) AS max_ms FROM steps GROUP BY {k}"
rounded = lambda df: df.withColumn("avg_ms", F.round("avg_ms", 6))
query("op_06", "SELECT tenant_id, round(count(*) FILTER (agent = 'purchase') / count(*), 4) AS correction_rate FROM steps GROUP BY 1")(lambda s, d: V.steps(s, d).groupBy("tenant_id").agg(F.round(F.count_if(c("agent") == "purchase") / F.count("*"), 4).alias("correction_rate")))

# alert windows: batch twins of the streams
query("sm_11", "SELECT event_id, tenant_id FROM steps WHERE failed")(lambda s, d: alerts.new_failures(V.steps(s, d)).select("event_id", "tenant_id"))

from tallyforge.plans import checks, decisions, extraction, intake, ledger, links, matching, operations, parsing, policies, printed, records, rules, texts, watch  # noqa: E402, F401  (they add their queries)
