"""Keyword rules that sort invoices, lines and transactions into categories, as one column expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S


@dataclass(frozen=True)
class Rule:
    """targets: kinds of rows that it is for, all if empty; direction: what a row's has to be, any if None."""

    id: str
    code: str
    type: str
    keywords: tuple[str, ...]
    base: int
    each: int
    confidence: str
    targets: tuple[str, ...] = ()
    direction: str | None = None


BROAD = ("invoice", "invoice_line_item", "transaction")
#: The default rules (fixed values).
RULES = [
    Rule("revenue_professional_services", "professional_services", "revenue", ("consulting", "advisory", "retainer", "professional service"), 8, 14, "high", BROAD),
    Rule("revenue_sales_invoice_payment", "sales_revenue", "revenue", ("invoice", "inv-", "ach credit", "wire credit", "payment received"), 6, 12, "medium", ("transaction",), "inflow"),
    Rule("expense_software_subscription", "software_subscription", "expense", ("cloud hosting", "hosting", "software", "saas", "subscription", "aws", "vercel", "openai", "github"), 8, 14, "high", BROAD),
    Rule("expense_advertising", "advertising_expense", "expense", ("google ads", "meta ads", "facebook ads", "advertising", "marketing", "campaign"), 8, 14, "high"),
    Rule("expense_rent", "rent_expense", "expense", ("office rent", "rent", "lease", "coworking"), 6, 12, "medium"),
    Rule("expense_utilities", "utilities_expense", "expense", ("electricity", "water", "utility", "utilities", "internet"), 6, 12, "medium"),
    Rule("expense_bank_fees", "bank_fees", "expense", ("bank fee", "service charge", "monthly fee", "wire fee"), 6, 12, "medium"),
    Rule("expense_payroll", "payroll_expense", "expense", ("payroll", "salary", "wages", "contractor payroll"), 6, 12, "medium"),
]
#: Direction that agrees with a type of category.
AGREES = {"revenue": "inflow", "expense": "outflow"}


def haystack(*parts: Column) -> Column:
    """Text, counterparty, reference and currency as one lower-case text; empty ones are left out."""
    return F.lower(F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts)))


def classified(rows: DataFrame, text: Column, direction: Column, amount: Column, target: str = "transaction", rules: list[Rule] = RULES) -> DataFrame:
    """Adds category, category_type, rule_id, rule_score, n_keywords, confidence: the best rule by (score, confidence, keywords), the earlier on ties.

    Without a rule the fallback has score 0 and low confidence. A keyword's pattern is only tried where its first word stands at all.
    """
    rows = rows.withColumn("text_", F.lower(text))
    tried = []
    for i, r in enumerate(rules):
        if r.targets and target not in r.targets:
            continue
        n = sum((F.when(F.col("text_").contains(k.split()[0]), S.keyword(F.col("text_"), k)).otherwise(False).cast("int") for k in r.keywords), F.lit(0))
        found = F.struct(
            (r.base + n * r.each + F.when(direction == AGREES.get(r.type), 5).otherwise(0)).alias("score_"), F.lit(S.CONFIDENCE_RANK[r.confidence]).alias("rank_"), n.alias("n_"), F.lit(-i).alias("order_"),
            F.lit(r.code).alias("code_"), F.lit(r.type).alias("type_"), F.lit(r.id).alias("id_"), F.lit(r.confidence).alias("confidence_"),
        )
        tried.append(F.when((n > 0) & (F.coalesce(direction == r.direction, F.lit(False)) if r.direction else F.lit(True)), found))
    # a generator: filters on what it gives aren't put into its place, where all patterns would stand again
    out = rows.select("*", F.inline(F.array(F.array_max(F.array(*tried)))))
    return out.withColumns({
        "category": F.coalesce("code_", S.fallback_category(direction, amount)), "category_type": F.coalesce("type_", S.fallback_type(direction, amount)), "rule_id": F.col("id_"),
        "rule_score": F.coalesce("score_", F.lit(0)), "n_keywords": F.coalesce("n_", F.lit(0)), "confidence": F.coalesce("confidence_", F.lit("low")),
    }).drop("score_", "rank_", "n_", "order_", "code_", "type_", "id_", "confidence_", "text_")


def rule_table(spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    """Rules as rows, in their order: what a tenant's own rules are stored as."""
    rows = [(i, r.id, r.code, r.type, list(r.keywords), r.base, r.each, r.confidence, list(r.targets), r.direction) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "position int, rule_id string, code string, type string, keywords array<string>, base int, each int, confidence string, targets array<string>, direction string")


#: Keywords up to so many are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 200_000


def classified_by_index(rows: DataFrame, key: str, text: Column, direction: Column, amount: Column, rules: DataFrame, target: str = "transaction") -> DataFrame:
    """As classified, for rules in any number: rows have a unique `key`; rules as of rule_table.

    The words of a text meet the first words of keywords, and only keywords that are met are looked for, as plain text: in both, each run
    of letters, digits and underscores stands between marks, so that a keyword is found where its words are whole. Keywords that begin with
    another sign are met by the first word in them; those without a word are left out.
    """
    wrapped = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"(?U)(\w+)", "\x01$1\x01")
    words = lambda c: F.filter(F.split(c, r"(?U)\W+"), lambda w: w != "")
    fits = rules.where((F.size("targets") == 0) | F.array_contains("targets", target)).select("*", F.explode(F.array_distinct("keywords")).alias("keyword"))
    index = fits.select(F.get(words(F.lower("keyword")), F.lit(0)).alias("word"), wrapped(F.lower("keyword")).alias("phrase"), "position", "base", "each", "confidence", "code", "type", "rule_id", F.col("direction").alias("wants")).where("word is not null")
    if index.count() <= MOST_BROADCAST:
        index = F.broadcast(index)
    texts = rows.select(key, F.lower(text).alias("text_"), direction.alias("direction_"))
    met = texts.select(key, "direction_", wrapped(F.col("text_")).alias("marked"), F.explode(F.array_distinct(words(F.col("text_")))).alias("word")).join(index, "word")
    met = met.where(F.contains("marked", "phrase") & (F.col("wants").isNull() | F.coalesce(F.col("wants") == F.col("direction_"), F.lit(False))))
    by = met.groupBy(key, "position").agg(F.count("*").alias("n_"), *(F.first(x).alias(x) for x in ("base", "each", "confidence", "code", "type", "rule_id", "direction_")))
    agrees = F.try_element_at(F.create_map(*(F.lit(x) for kv in AGREES.items() for x in kv)), F.col("type")) == F.col("direction_")
    rank = F.try_element_at(F.create_map(*(F.lit(x) for kv in S.CONFIDENCE_RANK.items() for x in kv)), F.col("confidence"))
    one = F.struct((F.col("base") + F.col("n_") * F.col("each") + F.when(agrees, 5).otherwise(0)).alias("score_"), rank.alias("rank_"), "n_", (-F.col("position")).alias("order_"), F.col("code").alias("code_"), F.col("type").alias("type_"), F.col("rule_id").alias("id_"), F.col("confidence").alias("confidence_"))
    best = by.groupBy(key).agg(F.max(one).alias("x")).select(F.col(key).alias("key_"), "x.*")
    out = rows.join(best, rows[key] == best["key_"], "left")
    return out.withColumns({
        "category": F.coalesce("code_", S.fallback_category(direction, amount)), "category_type": F.coalesce("type_", S.fallback_type(direction, amount)), "rule_id": F.col("id_"),
        "rule_score": F.coalesce("score_", F.lit(0)), "n_keywords": F.coalesce("n_", F.lit(0)), "confidence": F.coalesce("confidence_", F.lit("low")),
    }).drop("key_", "score_", "rank_", "n_", "order_", "code_", "type_", "id_", "confidence_")


#: Codes that a stored label may have, with type (fixed values).
TAXONOMY = {
    "sales_revenue": "revenue", "professional_services": "revenue", "software_subscription": "expense", "repairs_and_maintenance": "expense", "meals_and_entertainment": "expense", "office_supplies": "expense",
    "rent_expense": "expense", "utilities_expense": "expense", "uncategorized_revenue": "revenue", "uncategorized_expense": "expense", "uncategorized_other": "other",
}


def with_stored_labels(rows: DataFrame) -> DataFrame:
    """rows(category, category_type, confidence, label, label_confidence): the label replaces a category of low or unknown confidence, with its
    type and confidence, if the taxonomy has it."""
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in TAXONOMY.items() for x in kv)), F.col("label"))
    use = F.col("confidence").isin("low", "unknown") & kind.isNotNull()
    return rows.withColumns({
        "category": F.when(use, F.col("label")).otherwise(F.col("category")), "category_type": F.when(use, kind).otherwise(F.col("category_type")),
        "confidence": F.when(use, S.label_confidence(F.col("label_confidence"))).otherwise(F.col("confidence")),
    })


def oracle(target: str = "transaction", text: str = "concat_ws(' ', description, counterparty, reference, currency)") -> str:
    """The same best rule as SQL: a struct score, rank, n, ord, code, type, id, confidence of a row with direction, or null."""
    tried = []
    for i, r in enumerate(RULES):
        if r.targets and target not in r.targets:
            continue
        edge = lambda k: ("(^|[^a-z0-9_])" if k[0].isalnum() else "") + k.replace(" ", "\\s+") + ("($|[^a-z0-9_])" if k[-1].isalnum() else "")
        n = " + ".join(f"regexp_matches(lower({text}), '{edge(k)}')::INT" for k in r.keywords)
        fits = f"({n}) > 0" + (f" AND coalesce(direction = '{r.direction}', false)" if r.direction else "")
        score = f"{r.base} + ({n}) * {r.each} + CASE WHEN direction = '{AGREES[r.type]}' THEN 5 ELSE 0 END"
        tried.append(f"CASE WHEN {fits} THEN {{'score': {score}, 'rank': {S.CONFIDENCE_RANK[r.confidence]}, 'n': {n}, 'ord': {-i}, 'code': '{r.code}', 'type': '{r.type}', 'id': '{r.id}', 'confidence': '{r.confidence}'}} END")
    return f"list_reverse_sort(list_filter([{', '.join(tried)}], lambda x: x IS NOT NULL))[1]"
