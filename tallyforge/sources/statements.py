"""Bank statements as files: a row per transaction, the file's name kept. A statement is one small text; files are dealt over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S

CELLS = ", ".join(f"c{i} string" for i in range(12))
NORMALIZED = "posted_at date, value_at date, direction string, description string, counterparty string, reference string, currency string, amount decimal(18,2), running_balance decimal(18,2)"
REQUIRED = ["posted_at", "direction", "description", "amount", "currency"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, text: a row per file below the path."""
    return named(spark.read.text(path, wholetext=True, recursiveFileLookup=True))


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream: files that come in later are read when they are there."""
    return named(spark.readStream.text(path, wholetext=True, recursiveFileLookup=True))


def named(files: DataFrame) -> DataFrame:
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def render(files: DataFrame, path: str, most: int = 0) -> None:
    """files(file, text) as text files below the path, in folders file=..., beside what is there; of a folder's texts, `most` go into one file (0: all)."""
    files.select("file", "text").repartition("file").write.mode("append").option("maxRecordsPerFile", most).partitionBy("file").text(path)


def name_of(file: Column) -> Column:
    """The name that render() was given, from a file's path."""
    return F.regexp_extract(file, r"file=([^/]+)/", 1)


def _lines(files: DataFrame) -> DataFrame:
    """file, l (lines), head (index of the heading: the first line that begins with `date,`, else 0)."""
    f = files.select("file", F.split(F.regexp_replace("text", "^\ufeff", ""), r"\r?\n").alias("l"))
    at = F.array_min(F.transform("l", lambda x, i: F.when(x.rlike("(?i)^date,"), i)))
    return f.withColumn("head", F.coalesce(at, F.lit(0)))


def parsed(rows: DataFrame) -> DataFrame:
    """rows(line, ...) with the line's cells as struct x. A generator: without it the parser would stand in the plan once for each use of a cell."""
    return rows.select("*", F.explode(F.array(F.from_csv("line", F.lit(CELLS)))).alias("x"))


def debit_credit(files: DataFrame) -> DataFrame:
    """Statements (file, text) with Debit and Credit columns below any preamble. Rows without a description or with neither amount go;
    a credit makes an inflow, even one of 0.00; else the amount is the debit's, negative."""
    rows = _lines(files).select("file", F.split(F.lower(F.get("l", F.col("head"))), r"\s*,\s*").alias("names"), F.posexplode(F.slice("l", F.col("head") + 2, F.size("l"))).alias("row_number", "line"))
    rows = parsed(rows.where(F.trim("line") != ""))
    cells = F.array(*(F.col(f"x.c{i}") for i in range(12)))
    rows = rows.withColumn("cells", cells)

    def cell(name: str):
        return F.nullif(F.trim(F.get("cells", F.array_position("names", F.lit(name)).cast("int") - 1)), F.lit(""))

    money = lambda n: S.parse_decimal(cell(n)).cast("decimal(18,2)")
    rows = rows.select("file", "row_number", S.statement_date(cell("date")).alias("posted_at"), cell("description").alias("description"), money("debit").alias("debit"), money("credit").alias("credit"), money("balance").alias("running_balance"), F.coalesce(S.currency_code(cell("currency")), F.lit("USD")).alias("currency"))
    rows = rows.where(F.col("description").isNotNull() & (F.col("debit").isNotNull() | F.col("credit").isNotNull()))
    return rows.select(
        "file", "row_number", "posted_at", "description", F.coalesce("credit", -F.abs("debit")).alias("amount"), F.when(F.col("credit").isNotNull(), "inflow").otherwise("outflow").alias("direction"),
        S.extract_reference(F.col("description")).alias("reference"), S.extract_counterparty(F.col("description")).alias("counterparty"), "running_balance", "currency",
    )


def preamble(files: DataFrame) -> DataFrame:
    """Of statements (file, text): file, details (map of the lines above the heading), period_start, period_end."""
    f = _lines(files)
    pair = F.transform(F.filter(F.slice("l", 1, F.col("head")), lambda x: x.contains(",")), lambda x: F.struct(F.trim(F.split(x, ",", 2)[0]).alias("k"), F.trim(F.regexp_replace(F.split(x, ",", 2)[1], '^"|"$', "")).alias("v")))
    first = F.filter(pair, lambda p: p["k"] != "")
    f = f.select("file", F.map_from_arrays(F.array_distinct(F.transform(first, lambda p: p["k"])), F.transform(F.array_distinct(F.transform(first, lambda p: p["k"])), lambda k: F.get(F.filter(first, lambda p: p["k"] == k), F.lit(0))["v"])).alias("details"))
    ends = F.split(F.try_element_at("details", F.lit("Statement Period")), r"\s+to\s+")
    return f.select("file", "details", S.statement_date(F.get(ends, F.lit(0))).alias("period_start"), S.statement_date(F.get(ends, F.lit(1))).alias("period_end"))


def normalized(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements (file, text) with one signed amount column, columns in any order: rows that have all required values, and the rest with what
    they lack (a value that doesn't parse is lacking)."""
    rows = files.select("file", F.split(F.regexp_replace("text", "^\ufeff", ""), r"\r?\n").alias("l"))
    rows = rows.select("file", F.split(F.lower(F.get("l", F.lit(0))), r"\s*,\s*").alias("names"), F.posexplode(F.slice("l", 2, F.size("l"))).alias("row_number", "line")).where(F.trim("line") != "")
    rows = parsed(rows).withColumn("cells", F.array(*(F.col(f"x.c{i}") for i in range(12))))
    cell = lambda n: F.nullif(F.trim(F.get("cells", F.array_position("names", F.lit(n)).cast("int") - 1)), F.lit(""))
    fields = [f.strip().split(" ", 1) for f in NORMALIZED.split(", ")]
    rows = rows.select("file", "row_number", *(TYPED[kind](cell(n)).alias(n) for n, kind in fields)).withColumn("lacks", lacking())
    return rows.where(F.size("lacks") == 0).drop("lacks"), rows.where(F.size("lacks") > 0)


TYPED = {"date": S.parse_iso_date, "string": lambda v: v, "decimal(18,2)": lambda v: S.parse_decimal(v).cast("decimal(18,2)")}


def lacking() -> Column:
    return F.array_compact(F.array(*(F.when(F.col(n).isNull(), n) for n in REQUIRED)))


def normalized_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Files with one signed amount column and these columns in their order, by the CSV reader: large files are split over tasks.

    file, the normalized columns, lacks (what required values a row has not), and broken: the line of a row with too many or too few
    cells, whose values are null.
    """
    schema = ", ".join(f"{n} string" for n in columns) + ", broken string"
    raw = spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="broken", recursiveFileLookup=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), *columns, "broken")
    fields = [f.strip().split(" ", 1) for f in NORMALIZED.split(", ")]
    whole = lambda c: F.when(F.col("broken").isNull(), F.nullif(F.trim(c), F.lit("")))
    rows = rows.select("file", *(TYPED[kind](whole(F.col(n))).alias(n) for n, kind in fields), "broken")
    return rows.withColumn("lacks", F.when(F.col("broken").isNull(), lacking()).otherwise(F.array(F.lit("record"))))


def nested(files: DataFrame) -> DataFrame:
    """Statement JSON (file, text: bank_account, statement_import, transactions[]): a row per transaction, account and import beside it."""
    return nested_rows(files.select("file", F.from_json("text", NESTED).alias("p")))


def nested_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows of JSON files of one statement each, however its text is broken into lines; and the files that are no JSON: file, broken."""
    raw = spark.read.schema(f"{NESTED}, broken string").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="broken", recursiveFileLookup=True)
    files = raw.select(F.col("_metadata.file_path").alias("file"), F.struct("bank_account", "statement_import", "transactions").alias("p"), "broken")
    # the reader refuses to read the broken text alone
    return nested_rows(files.where("broken IS NULL")), files.where("broken IS NOT NULL AND coalesce(size(p.transactions), 0) >= 0").select("file", "broken")


TX = "array<struct<posted_at: date, value_at: date, direction: string, raw_description: string, counterparty_name: string, reference: string, currency: string, amount: string, running_balance: string>>"
NESTED = f"bank_account struct<institution_name: string, currency: string, account_identifier_hash: string>, statement_import struct<source_filename: string, currency: string, opening_balance: string, closing_balance: string>, transactions {TX}"


def nested_rows(p: DataFrame) -> DataFrame:
    rows = p.select(
        "file", "p.bank_account.institution_name", F.col("p.bank_account.currency").alias("account_currency"), "p.bank_account.account_identifier_hash", F.col("p.statement_import.source_filename").alias("source"),
        S.parse_decimal(F.col("p.statement_import.opening_balance")).cast("decimal(18,2)").alias("opening_balance"), F.posexplode("p.transactions").alias("row_number", "t"),
    )
    money = lambda n: S.parse_decimal(F.col(f"t.{n}")).cast("decimal(18,2)").alias(n)
    return rows.select(
        "file", "institution_name", "account_currency", "account_identifier_hash", "source", "opening_balance", "row_number", "t.posted_at", "t.value_at", "t.direction", F.col("t.raw_description").alias("description"), "t.counterparty_name",
        "t.reference", "t.currency", money("amount"), money("running_balance"),
    )
