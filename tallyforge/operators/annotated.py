"""Invoice texts as annotated lines: every line is marked once with what its labels and patterns say, and every field is picked from the marks.

The labels and patterns are tables: which words, in which order, and what value goes with them. Lines are an array of their row, so nothing
is shuffled; a line is read by each pattern once, and only where a cheap test says that the pattern can match.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S

# Labels, patterns and word lists of invoice texts.
DATE = r"(?<!\d)([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4})(?!\d)"
MONEY = r"[$£€]?\s*([0-9][0-9.,]*[.,]\d{1,2})"
WHOLE_MONEY = r"[$£€]\s*([0-9][0-9,]*)(?![0-9.,])"
ISSUE_LABELS, DUE_LABELS = ["invoice date", "date", "data"], ["due date", "payment due", "duedate"]
NUMBER_LABELS = ["invoice #", "invoice no", "invoice number", "bill no", "receipt no", "no."]
#: Numbers within a line, the first pattern that gives one with a digit counts.
NUMBER_IN_LINE = [
    r"\brec[i1]b[o0]\s*[:#-]?\s*((?:[A-Z0-9]{1,4}\s+)?[A-Z0-9][A-Z0-9_/-]{5,})", r"\b(?:fatura|factura)\s*[-/]\s*recibo.*?[:#]\s*([A-Z0-9]+(?:\s+[A-Z0-9]+)?(?:/[A-Z0-9]+)+)",
    r"\b(?:fatura|factura).*?\b((?:FS|FT|FAC|FR|F1)\s+[A-Z0-9_]+(?:/[A-Z0-9]+)+)", r"\b(?:fatura|factura)\s*[:#]\s*([A-Z0-9]+(?:\s+[A-Z0-9]+)?(?:/[A-Z0-9]+)+)",
    r"\bdoc(?:umento)?\.?\s*n[º°.]?\.?\s*[:#-]?\s*((?:[A-Z]{1,4}\s+)?[A-Z0-9_]+(?:/[A-Z0-9]+)*|[0-9]{5,})", r"\bfatura\s+n[uú]mero\s*[:#-]?\s*(.+)", r"^(?:n[º°o]?|№[°º]?)\.?\s*[:#-]?\s*([A-Z0-9]+(?:/[A-Z0-9]+)+|[0-9]{5,})\b",
]
#: Numbers of the text as one line, tried pattern by pattern.
NUMBER_IN_TEXT = [
    r"\b(?:fatura|factura)(?:\s*/\s*recibo)?(?:\s+simplificada)?\s*(?:n[º°.]?\.?)?\s*[:#-]?\s*([A-Z0-9]+(?:\s+[A-Z0-9]+)?(?:\s*[/-]\s*[A-Z0-9]+)*)", r"\brecibo\s*(?:n[º°.]?\.?)?\s*[:#-]?\s*([A-Z0-9]+(?:\s+[A-Z0-9]+)?(?:\s*[/-]\s*[A-Z0-9]+)*)",
    r"\bdoc(?:umento)?\.?\s*(?:n[º°.]?\.?)?\s*[:#-]?\s*([A-Z0-9]+(?:\s+[A-Z0-9]+)?(?:\s*[/-]\s*[A-Z0-9]+)*)", r"\b(?:bill|receipt)\s*no\.?\s*:?\s*([A-Z0-9][A-Z0-9-]*)\b", r"\bno\.?\s*([0-9]{3,})\b",
    r"\binvoice\s*(?:#|no\.?|number|num|[:*])?\s*[#:'‘’“”]*\s*([A-Z0-9][A-Z0-9-]{3,})", r"\binvoice\s+[A-Za-z\s]{0,24}?[#:'‘’“”]*\s*([0-9]{4,})",
]
#: Letters without which the patterns of NUMBER_IN_TEXT find nothing.
WORDS_IN_TEXT = [["fatura", "factura"], ["recibo"], ["doc"], ["bill", "receipt"], ["no"], ["invoice"], ["invoice"]]
NUMBER_WORD = r"rec[i1]b|fatura|factura|doc|^n[º°o]?\.?\s*[:#-]?\s*[a-z0-9]|^№"
NUMBER_HEADING = r"^(?:fatura|factura)(?:\s*/\s*recibo)?(?:\s+n[uú]mero)?\s*[:#-]?$"
#: Numbers of card terminals, where no other is: pattern by pattern over all lines.
NUMBER_OF_TERMINAL = [r"\btpa\s*[:#-]?\s*([0-9]{7,8})\b", r"\b(A[0-9]{12,})\b", r"^(501649F[F1]20)$"]
TAX_ID = r"(?<!\d)(\d(?:[\s.]?\d){8})(?!\d)"
TAX_ID_ALONE = r"^(?:pt\s*)?(\d(?:[\s.]?\d){8})$"
#: Labels of tax ids as they are without blanks and marks.
CUSTOMER_TAX_ID, SUPPLIER_TAX_ID, ANY_TAX_ID = "contribuinte|contn|numcontribuinte|customertaxid|nifcliente", "nif|nipc|nrcontr|ncontr|numcontrib|contrtb|c0ntrtb|n11|cont:", "nif|ncontr|contribuinte"
CUSTOMER_SECTION = r"cliente|\b(?:customer|bill\s*to)\b"
SENDER_ENDS = ["bill to", "billto", "ship to", "client name"]
NO_PARTY = ["bill to", "ship to", "client name", "phone number", "p.o. number", "po number", "due date", "invoice"]
NO_SUPPLIER = ["payment terms", "credit card", "due date", "date", "po no", "p.o.", "email", "phone", "upload logo", "source:", "layout notes", "synthetic", "photographed"]
FACT = r"invoice no|invoice #|invoice number|payment terms|due date|^source:|layout notes|^[a-z]{0,3}[0-9][a-z0-9-]*$"
ADDRESS = r"(?=.*\d).*(?: st| street| town| ave)"
COMPANY = r"\b([A-Z][A-Za-z0-9 .&'-]{1,80}?\b(?:Inc\.?|LLC|Ltd\.?|Corp\.?))\b"
CUSTOMER_IN_TEXT = r"(?:bill\s*to|inte)\s+([A-Z][A-Za-z0-9 .&'-]{2,80}?)\s+invoice\b"
PAYMENT_LABELS = ["pago:eur", "pago eur", "valor:eur", "valor eur", "u3lor:eur", "taxa:", "compra"]
EXPLICIT_TOTAL = r"(?<!sub)\btotal\b(?:\s*\(?[A-Z]{3}\)?)?[^0-9$]{0,24}" + MONEY
TAX_MARKS = ["taxa", "base", "iva", "imposto", "incidencia", "incidência"]
TAX_HEADING = r"\bv[.]?\s*tax\b|\b(?:resumo|summary)\b.{0,16}\b(?:iva|vat)\b|\bvalor\s+(?:do\s+)?iva\b"
SUMMARY = r"\b(?:resumo|summary)\b.{0,16}\b(?:iva|vat)\b"
SKIPPED = ["qty description", "unit price", "subtotal", "sales tax", "discount", "vat", "tax ", "tax(", "shipping", "amount paid", "balance due", "total", "terms and conditions"]
NO_ITEM = r"qty description|unit price|subtotal|sales tax|discount|vat|tax |tax\(|shipping|amount paid|balance due|total|terms and conditions"
NO_CONTINUATION = r"bill to|ship to|balance due|paid|discount|vat|tax|created by|payment|notes:"
AMOUNT = r"[$£]?\s*\d+(?:,\d{3})*(?:\.\d{2})?"
SIGNED = r"[$£]\s*\d+(?:,\d{3})*(?:\.\d{2})?"
#: Rows of items: the pattern, and the groups of description, quantity, unit price and total.
ITEM_ROWS = [(rf"^\s*(\d+(?:\.\d+)?)\s+(.+?)\s+({AMOUNT})\s+({AMOUNT})\s*$", (2, 1, 3, 4)), (rf"^\s*(.+?)\s+(\d+(?:\.\d+)?)\s*(?:[A-Za-z]{{1,8}})?\s+({SIGNED})\s+({SIGNED})\s*$", (1, 2, 3, 4))]
#: The same in a text whose lines are lost.
ITEM_IN_TEXT = r"[^\d]*(\d{1,4}(?:\.\d{1,2})?)\s+([A-Za-z][A-Za-z0-9 '&().-]{3,90}?)\s+(\$?\s*\d{2,6}(?:\.\d{2})?)\s+\$?\s*(\d{2,6}(?:\.\d{2})?)"
TABLE_BEGINS, TABLE_ENDS = ["qty description", "ty description", "description"], ["subtotal", "sales tax", "total"]
# End of the fixed values.

BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


BLANKS = r"[\s\x0B\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def stripped(c: Column, marks: str) -> Column:
    return F.btrim(c, F.lit(marks))


def cleaned(c: Column) -> Column:
    """White space collapsed, quotes at the ends gone."""
    return stripped(F.regexp_replace(c, BLANKS, " "), " '‘’“”")


#: What makes a text's lines need to be cleaned: blanks and breaks other than ASCII's blank and line feed, and what stands at a line's ends.
ODD_BLANKS, OTHER_BLANKS = [*"\t\x0b\f\r\x1c\x1d\x1e\x1f", "  "], [*"\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))]
AT_ENDS, OTHER_AT_ENDS = " '", "‘’“”"


def odd(text: Column) -> Column:
    """By plain words, as a pattern would be tried at each letter; what isn't ASCII is looked for where letters have more bytes."""
    ends = lambda marks: functools.reduce(operator.or_, (text.contains(f"{m}\n") | text.contains(f"\n{m}") | text.startswith(m) | text.endswith(m) for m in marks))
    other = (F.octet_length(text) != F.length(text)) & (any_of(text, OTHER_BLANKS) | ends(OTHER_AT_ENDS))
    return F.coalesce(any_of(text, ODD_BLANKS) | ends(AT_ENDS) | other, F.lit(False))


def as_printed(text: Column) -> Column:
    """The lines of a text that isn't odd: they are clean as they stand."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x != "")


def cleaned_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), BREAK), cleaned), lambda x: x != "")


def lines(text: Column) -> Column:
    """The lines that aren't blank, cleaned."""
    return F.when(odd(text), cleaned_lines(text)).otherwise(as_printed(text))


def take(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one; letters of either case."""
    return filled(F.regexp_extract(c, "(?i)" + pattern, group))


def filled(value: Column) -> Column:
    """A text that isn't empty; nullif would work it out twice."""
    return bound(value, lambda x: F.when(x != "", x))


def money_in(c: Column) -> Column:
    """All amounts of a text: those with decimals, then whole ones after a currency sign."""
    each = lambda p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    return F.concat(each(MONEY), each(WHOLE_MONEY))


def first_money(c: Column) -> Column:
    return F.coalesce(take(c, MONEY), take(c, WHOLE_MONEY))


def any_of(low: Column, words: list[str]) -> Column:
    out = low.contains(words[0])
    for w in words[1:]:
        out = out | low.contains(w)
    return out


def from_first(raw: Column, low: Column, words: list[str]) -> Column:
    """The line from the first of the words on."""
    at = lambda w: F.when(F.instr(low, w) > 0, F.instr(low, w))
    first = at(words[0]) if len(words) == 1 else F.least(*map(at, words))
    return F.substr(raw, first)


def dated(raw: Column, low: Column, labels: list[str]) -> Column:
    """The first date behind the label: the first of the labels, in their order, that the line has."""
    out = F.when(low.contains(labels[0]), take(raw, rf"^.*?\Q{labels[0]}\E.*?" + DATE))
    for x in labels[1:]:
        out = out.when(low.contains(x), take(raw, rf"^.*?\Q{x}\E.*?" + DATE))
    return out


def trimmed_number(found: Column) -> Column:
    """A number as it is written, blanks around its separators gone."""
    return F.regexp_replace(F.regexp_replace(stripped(cleaned(found), " :#-"), r"\s*([/_-])\s*", "$1"), r"\s+", " ")


def has_digit(c: Column) -> Column:
    return F.when(c.rlike(r"\d"), c)


def party(c: Column) -> Column:
    """A name without the full stop that ends a line, Inc. written alike."""
    return filled(F.regexp_replace(F.regexp_replace(cleaned(c), r"(?i)\binc\.?$", "Inc."), r"(?i)(?<!\binc)\.+$", ""))


def plausible(name: Column) -> Column:
    """A name with letters and no digit that is no label."""
    return F.when(~stripped(F.lower(name), " :").isin(NO_PARTY) & ~name.rlike(r"\d") & name.rlike("[A-Za-z]"), name)


def item_row(raw: Column) -> Column:
    """description, quantity, unit_price, total of a line that is an item's row, as printed; else null."""
    names = ("description", "quantity", "unit_price", "total")
    each = []
    for pattern, groups in ITEM_ROWS:
        # the pattern is the whole line and no line holds this mark, so one replacement gives all groups
        cells = F.split(F.regexp_replace(raw, pattern, "\x1f".join(f"${g}" for g in groups)), "\x1f")
        each.append(bound(cells, lambda x: F.when(F.size(x) == len(names), F.struct(*(F.get(x, F.lit(i)).alias(n) for i, n in enumerate(names))))))
    return F.when(raw.rlike(r"\d\s*$"), F.coalesce(*each))


def bound(value: Column, body) -> Column:
    """body(value), with value worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: The marks that each field is picked from.
HEADER_MARKS = {"number": ["number_label"], "customer": ["bill_to"], "issue_date": ["issue"], "due_date": ["issue", "due"]}
TOTAL_MARKS, ITEM_MARKS = ["money", "subtotal", "tax", "payment", "total", "in_euro"], ["money", "skip"]
MARKS = ["money", "skip", "number_label", "issue", "due", "bill_to", "subtotal", "tax", "payment", "total", "in_euro"]


def marked(s: Column, marks: list[str]) -> Column:
    """What a line says of itself, by plain words where they do. What depends on where it stands is looked up there, from its text."""
    raw, low, digit = s["raw"], s["low"], s["digit"]
    has = lambda words: any_of(low, words)
    here = lambda c, v: F.when(c, F.struct(v.alias("here")))
    after = lambda words, reject=None: here(has(words) & (~has(reject) if reject else F.lit(True)), F.when(digit, first_money(from_first(raw, low, words))))
    whole = F.when(any_of(raw, ["$", "£", "€"]), F.regexp_extract_all(raw, F.lit(WHOLE_MONEY), F.lit(1)))
    none = F.array().cast("array<string>")
    each = {
        "money": F.when(digit, F.concat(F.regexp_extract_all(raw, F.lit(MONEY), F.lit(1)), F.coalesce(whole, none))).otherwise(none), "skip": has(SKIPPED),
        "number_label": here(has(NUMBER_LABELS), labelled_number(raw, low)), "issue": here(has(ISSUE_LABELS), F.when(digit, dated(raw, low, ISSUE_LABELS))), "due": here(has(DUE_LABELS), F.when(digit, dated(raw, low, DUE_LABELS))),
        "bill_to": here(low.contains("bill to"), bound(party(F.substr(raw, F.instr(low, "bill to") + 7)), plausible)),
        "subtotal": after(["subtotal"]), "tax": after(["sales tax", "tax"], ["subtotal", "total"]), "payment": after(PAYMENT_LABELS),
        "total": F.when(low.contains("total"), F.struct(take(raw, EXPLICIT_TOTAL).alias("here"), (low.rlike("sub ?total") & ~low.rlike(r"(?<!sub)\btotal\b")).alias("sub"))),
        "in_euro": F.when(digit & (low.contains("€") | low.contains("eur")), F.regexp_extract_all(low, F.lit(r"([0-9][0-9.,]*[.,]\d{1,2})\s*(?:€|eur\b)"), F.lit(1))),
    }
    return F.struct(raw.alias("raw"), low.alias("low"), digit.alias("digit"), *(each[n].alias(n) for n in MARKS if n in marks))


def fact(s: Column) -> Column:
    return (stripped(s["low"], " :.") == "invoice") | s["low"].rlike(FACT)


def continues(s: Column) -> Column:
    """Whether a line goes on with the item above it."""
    low = s["low"]
    return ~s["skip"] & (F.size(s["money"]) == 0) & ~fact(s) & ~low.rlike(r"^\d+(?:\.\d+)?(?:\s+[a-z]+)?$") & ~low.rlike(NO_CONTINUATION) & s["raw"].rlike("[A-Za-z]")


def row_of(s: Column) -> Column:
    return F.when(~s["skip"] & s["digit"], item_row(s["raw"]))


def labelled_number(raw: Column, low: Column) -> Column:
    """What follows the first of the labels, in their order, that the line has."""
    out = None
    for x in NUMBER_LABELS:
        value = take(F.substr(raw, F.instr(low, x) + len(x)), "([A-Z0-9][A-Z0-9-]*)")
        out = F.when(low.contains(x), value) if out is None else out.when(low.contains(x), value)
    return out


def annotated(docs: DataFrame, marks: list[str] = MARKS) -> DataFrame:
    """doc_id, text, low, flat, hint, a of docs(doc_id, text): `a` has the marks (those asked for) of each line that isn't blank, flat the lines as one. Null and empty texts have none."""
    text, digit = F.col("text"), lambda x: x.rlike(r"\d").alias("digit")
    rows = docs.select("doc_id", "text", F.lower("text").alias("low"))
    plain = F.zip_with(as_printed(text), as_printed(F.col("low")), lambda x, y: F.struct(x.alias("raw"), y.alias("low"), digit(x)))
    both = F.when(odd(text), F.transform(cleaned_lines(text), lambda x: F.struct(x.alias("raw"), F.lower(x).alias("low"), digit(x)))).otherwise(plain)
    rows = rows.select("doc_id", "text", "low", both.alias("l"))
    return rows.select("doc_id", "text", "low", F.array_join(F.transform("l", lambda s: s["raw"]), " ").alias("flat"), any_of(F.col("low"), S.DAY_FIRST).alias("hint"), F.transform("l", lambda s: marked(s, marks)).alias("a"))


def first_of(values: Column) -> Column:
    return F.get(F.array_compact(values), F.lit(0))


def place(some: Column, test) -> Column:
    """The index of the first line that passes, if any."""
    return bound(F.array_position(F.transform(some, test), True).cast("int"), lambda n: F.when(n > 0, n - 1))


def first_that(some: Column, value) -> Column:
    """first_of the lines' values (texts), which are not worked out beyond it."""
    return F.aggregate(some, F.lit(None).cast("string"), lambda found, s: F.coalesce(found, value(s)))


def line(i: Column) -> Column:
    return F.get("a", i)


def at_label(mark: str, value) -> Column:
    """Of the lines with the label the first value: on the line, else on the next (value: of its text)."""
    return first_of(F.transform("a", lambda s, i: F.when(s[mark].isNotNull(), F.coalesce(s[mark]["here"], value(line(i + 1)["raw"])))))


def first_date(raw: Column) -> Column:
    return take(raw, DATE)


def first_word(raw: Column) -> Column:
    return take(raw, "([A-Z0-9][A-Z0-9-]*)")


def tax_id(s: Column, alone: bool = False) -> Column:
    return F.when(s["digit"], F.regexp_replace(take(s["raw"], TAX_ID_ALONE if alone else TAX_ID), r"\D", ""))


def with_header(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """annotated rows with the header's fields; names: those that are wanted, for which alone the lines have to have marks."""
    asked = {m for n in (names or HEADER_MARKS) for m in HEADER_MARKS.get(n, [])}
    label = lambda m, value: at_label(m, value) if m in asked else F.lit(None).cast("string")
    a, size, flat, hint, low = F.col("a"), F.size("a"), F.col("flat"), F.col("hint"), F.col("low")
    before = lambda test, most: F.slice(a, 1, F.coalesce(place(F.slice(a, 1, most), test), F.lit(most)))
    # numbers: whole texts without the words are passed over
    rows = rows.withColumns({
        "worded": any_of(low, ["recib", "rec1b", "fatura", "factura", "doc", "№"]) | low.rlike(r"(?m)^\W*n[º°o]?\.?\s*[:#-]?\s*[a-z0-9]"), "headed": low.contains("fatura") | low.contains("factura"), "of_terminal": any_of(low, ["tpa", "501649"]) | low.rlike("a[0-9]{12}"),
        "taxed": any_of(low, ["nif", "n if", "ni f", "n i f", "nipc", "cont", "c0ntr", "n11"]), "tax_named": low.contains("pt") & low.rlike("(?m)^\\W*pt"),
    })
    rows = rows.withColumn("issue_", label("issue", first_date)).withColumn("issued", S.day(F.col("issue_"), hint))
    in_line = lambda s: F.when(s["digit"] & s["low"].rlike(NUMBER_WORD), F.coalesce(*(bound(trimmed_number(take(s["raw"], p)), has_digit) for p in NUMBER_IN_LINE)))
    fits = lambda n: F.when(n.contains("/") | n.rlike(r"(?i)^[A-Z]?\d{5,}$"), n)
    below = lambda t: F.when(t["digit"] & ~t["low"].rlike(r"\b(?:data|date)\b"), bound(trimmed_number(t["raw"]), fits))
    heads = F.transform(a, lambda s, i: F.when(s["low"].rlike(NUMBER_HEADING), first_of(F.transform(F.slice(a, i + 2, 8), below))))
    terminal = lambda p: F.when(F.col("of_terminal"), first_that(a, lambda s: F.when(s["digit"], F.upper(take(s["raw"], p)))))
    sender = lambda s: F.when(~s["digit"] & ~any_of(s["low"], NO_SUPPLIER) & s["raw"].rlike("[A-Za-z]{3,}") & ~fact(s), bound(party(s["raw"]), plausible))
    opening = lambda s: F.when(~s["digit"] & (stripped(s["low"], " :.") != "invoice") & ~s["low"].rlike(r"no\.|upload logo|bill to"), party(s["raw"]))
    named = lambda t: F.when(~t["digit"], bound(party(t["raw"]), plausible))
    billed = lambda: F.transform(a, lambda s, i: F.when(s["bill_to"].isNotNull(), F.coalesce(s["bill_to"]["here"], first_of(F.transform(F.slice(a, i + 2, 7), named)))))
    rows = rows.withColumns({
        "number": F.coalesce(
            F.when(F.col("worded"), first_that(a, in_line)), F.when(F.col("headed"), first_of(heads)), *map(terminal, NUMBER_OF_TERMINAL), *(F.when(any_of(low, w), number_in_text(flat, p)) for w, p in zip(WORDS_IN_TEXT, NUMBER_IN_TEXT, strict=True)), label("number_label", first_word)
        ),
        "alone_": F.when(F.col("issued").isNull(), first_that(before(lambda s: any_of(s["low"], ["due date", "bill to"]), 12), lambda s: F.when(s["digit"], first_date(s["raw"])))), "due_": label("due", first_date),
        "customer_at": F.when(any_of(low, ["client", "customer", "bill"]), place(a, lambda s: any_of(s["low"], ["client", "customer", "bill"]) & s["low"].rlike(CUSTOMER_SECTION))), "currency": S.inferred_currency(F.col("text")),
        "supplier": F.coalesce(first_that(before(lambda s: stripped(s["low"], " :.").isin(SENDER_ENDS), 18), sender), party(take(flat, COMPANY)), first_that(F.slice(a, 1, 8), opening)),
        "customer": F.coalesce(first_of(billed()) if "bill_to" in asked else F.lit(None).cast("string"), party(take(flat, CUSTOMER_IN_TEXT)), F.when(flat.rlike(r"(?i)\bcustomer\s+name\b"), "Customer Name")),
    })
    start = F.coalesce("customer_at", size)
    key = lambda s: F.translate(s["low"], " \tº°._-", "")
    near = lambda s, i, limit: F.coalesce(tax_id(s), F.when(i + 1 < limit, tax_id(line(i + 1), True)))
    of_supplier = lambda s: key(s).rlike(SUPPLIER_TAX_ID) | s["low"].rlike(r"\bcontrib[.:]")
    rows = rows.withColumns({
        "issue_date": F.coalesce("issued", S.day(F.col("alone_"), hint)), "labelled_due": S.day(F.col("due_"), hint),
        "supplier_tax_id": F.coalesce(F.when(F.col("taxed"), first_of(F.transform(a, lambda s, i: F.when((i < start) & of_supplier(s), near(s, i, start))))), F.when(F.col("tax_named"), first_of(F.transform(a, lambda s, i: F.when(s["digit"] & (i < start), take(s["raw"], r"^PT\s*(\d{9})$")))))),
        "customer_tax_id": F.when(F.col("taxed") | low.contains("tax"), first_of(F.transform(a, lambda s, i: F.when((i >= start) & key(s).rlike(CUSTOMER_TAX_ID), near(s, i, size))))),
        "every_tax_id": F.when(F.col("customer_at").isNull() & F.col("taxed"), F.array_distinct(F.array_compact(F.transform(a, lambda s: F.when(key(s).rlike(ANY_TAX_ID), tax_id(s)))))),
    })
    other = F.when(F.size("every_tax_id") >= 2, F.try_element_at("every_tax_id", F.lit(-1)))
    return rows.withColumns({"due_date": F.coalesce("labelled_due", S.due_by_terms(F.col("issue_date"), F.col("text"))), "supplier_tax_id": F.coalesce("supplier_tax_id", other)})


def number_in_text(flat: Column, pattern: str) -> Column:
    """The first match of the pattern with a digit that doesn't begin as a date's label; words without a digit at its end are left out."""
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, r"\s*([/-])\s*", "$1"), "^[ :'‘’“”]+|[ :'‘’“”]+$", "")
    each = F.transform(F.regexp_extract_all(flat, F.lit("(?i)" + pattern), F.lit(1)), lambda x: F.regexp_replace(plain(x), r"(?<=\S)(?: [^\d ]+)+$", ""))
    return F.get(F.filter(each, lambda x: x.rlike(r"\d") & ~F.lower(x).startswith("date")), F.lit(0))


def tax_values(at: Column) -> Column:
    """The amounts in the twelve lines below a VAT table's heading, rates aside: until there are four, or three and a rate."""
    start = F.struct(F.array().cast("array<decimal(18,2)>").alias("v"), F.lit(False).alias("rates"))

    def add(done: Column, s: Column) -> Column:
        full = (F.size(done["v"]) >= 4) | (done["rates"] & (F.size(done["v"]) >= 3))
        more = F.struct(F.concat(done["v"], F.array_compact(F.transform(F.transform(s["money"], S.money_signs), S.money_of_signs))).alias("v"), done["rates"].alias("rates"))
        return F.when(full, done).when(s["low"].contains("%"), F.struct(done["v"].alias("v"), F.lit(True).alias("rates"))).otherwise(more)

    return F.aggregate(F.slice("a", at + 2, 12), start, add, lambda d: d["v"])


def is_tax_heading(i: Column) -> Column:
    s = line(i)
    low = lambda x: x["low"]
    around = F.array_join(F.transform(F.slice("a", F.greatest(i - 3, F.lit(0)) + 1, F.least(i, F.lit(3)) + 4), low), " ")
    return (any_of(s["low"], ["tax", "resumo", "summary", "valor"]) & s["low"].rlike(TAX_HEADING)) | (F.col("names_iva") & in_tax_summary(i)) | (s["low"].rlike("^(?:iva|imposto)$") & around.rlike("taxa|sujeito|incid|base"))


def in_tax_summary(i: Column) -> Column:
    """Whether a line is a column of a VAT table: two of its words stand around, or it is a summary. Lines after it count until one with an amount.

    Lines have marked their words (`tax_words`), so that no line is searched once a window; none of the words spans lines, but a summary may.
    """
    first = F.greatest(i - 4, F.lit(0)) + 1
    after = lambda at: F.least(i, F.lit(4)) + F.when(at > 0, at).otherwise(5)
    size = bound(F.array_position(F.transform(F.slice("a", i + 2, 4), lambda s: F.size(s["money"]) > 0), True).cast("int"), after)
    window = lambda some, n: F.slice(some, first, n)
    spans = lambda n: F.array_join(F.transform(window("a", n), lambda s: s["low"]), " ").rlike(SUMMARY)
    has = lambda w, bits: w.bitwiseAND(bits)
    either = lambda w, n: F.when(has(w, ANY_MARK) != 0, (F.bit_count(has(w, ANY_MARK - 1)) >= 2) | ((has(w, OF_SUMMARY) != 0) & spans(n))).otherwise(False)
    every = lambda n: F.aggregate(window("tax_words", n), F.lit(0), lambda x, y: x.bitwiseOR(y))
    return F.when(F.size("tax_words") > 0, bound(size, lambda n: bound(every(n), lambda w: either(w, n)))).otherwise(False)


#: Bits of a line's words beside those of TAX_MARKS: any of VAT tables, and one that a summary begins with.
ANY_MARK, OF_SUMMARY = 1 << len(TAX_MARKS), 2 << len(TAX_MARKS)
ANY_TAX_WORD = ["taxa", "base", "iva", "imposto", "incid", "resumo", "summary"]


def tax_words() -> Column:
    """Which words of VAT tables each line has, as bits; nothing for a text without any."""
    low = lambda s: s["low"]
    bit = lambda test, n: F.when(test, n).otherwise(0)
    marks = lambda s: functools.reduce(operator.add, (bit(low(s).rlike(rf"\b{m}\b"), 1 << n) for n, m in enumerate(TAX_MARKS)), F.lit(ANY_MARK) + bit(any_of(low(s), ["resumo", "summary"]), OF_SUMMARY))
    return F.when(any_of(F.col("low"), ANY_TAX_WORD), F.transform("a", lambda s: F.when(any_of(low(s), ANY_TAX_WORD), marks(s)).otherwise(0)))


def labelled_total() -> Column:
    """The amount of the last line that names the total and has one: subtotals and VAT tables aside."""
    a = F.col("a")

    def candidate(i: Column) -> Column:
        s = line(i)
        near = F.array_join(F.transform(F.slice(a, F.greatest(i - 4, F.lit(0)) + 1, F.least(i, F.lit(4)) + 2), lambda t: t["low"]), " ")
        taxed = s["low"].contains("sujeito") | F.coalesce(line(i + 1)["low"].contains("sujeito"), F.lit(False)) | bound(near, lambda x: x.contains("taxa") & x.contains("iva"))
        below = first_of(F.transform(F.slice(a, i + 2, 3), lambda t: F.get(t["money"], F.lit(0))))
        value = F.coalesce(s["total"]["here"], F.try_element_at(s["money"], F.lit(-1)), below)
        return F.when(~taxed & ~s["total"]["sub"] & ~in_tax_summary(i), value)

    named = lambda i: F.when(line(i)["total"].isNotNull(), candidate(i))
    return F.when(F.size(a) > 0, F.aggregate(F.sequence(F.size(a) - 1, F.lit(0), F.lit(-1)), F.lit(None).cast("string"), lambda found, i: F.coalesce(found, named(i))))


def money_at(mark: str) -> Column:
    return first_of(F.transform("a", lambda s, i: F.when(s[mark].isNotNull(), F.coalesce(s[mark]["here"], F.get(line(i + 1)["money"], F.lit(0))))))


def vat_amount(values: Column) -> Column:
    """The tax of a VAT table's amounts in print order: net and tax side by side whose sum is a later amount (0.02 off
    at most, the last such amount first), else the smallest of two or more. A table holds a dozen amounts or so."""
    n = F.size(values)
    cent = F.lit("0.02").cast("decimal(4,2)")

    def before(j: Column) -> Column:
        def tax(i: Column) -> Column:
            net, part = F.get(values, i), F.get(values, i + 1)
            return F.when((part > 0) & (F.abs(net + part - F.get(values, j)) <= cent), part)

        return F.transform(F.sequence(F.lit(0), j - 2), tax)

    triples = F.when(n >= 3, F.flatten(F.transform(F.sequence(n - 1, F.lit(2), F.lit(-1)), before)))
    return F.coalesce(first_of(triples), F.when(n >= 2, F.array_min(values)))


def with_totals(rows: DataFrame) -> DataFrame:
    """annotated rows with subtotal, tax, total and confidence.

    The last labelled total counts, else what is labelled as paid, else the last amount in euro, which isn't sure. tax: of a VAT table,
    labelled, else total less subtotal. High: labelled, consistent, and no VAT table without its tax; medium: something is there.
    """
    a, low = F.col("a"), F.col("low")
    euro = F.try_element_at(F.flatten(F.array_compact(F.transform(a, lambda s: s["in_euro"]))), F.lit(-1))
    taxed = any_of(low, [*ANY_TAX_WORD, "tax"])
    # neither search goes on once it has found its line
    heading = F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.lit(None).cast("int"), lambda at, i: F.coalesce(at, F.when(is_tax_heading(i), i)))
    rows = rows.withColumns({"names_iva": low.contains("iva") & low.rlike(r"\biva\b"), "tax_words": tax_words()})
    rows = rows.withColumns({"tax_at": F.when(taxed & (F.size(a) > 0), heading), "labelled_": F.coalesce(labelled_total(), money_at("payment")), "euro_": euro, "subtotal_": money_at("subtotal"), "given_": money_at("tax")})
    rows = rows.withColumns({"tax_values": F.when(F.col("tax_at").isNotNull(), tax_values(F.col("tax_at"))), "labelled": S.clean_money(F.col("labelled_")), "subtotal": S.clean_money(F.col("subtotal_")), "given": S.clean_money(F.col("given_"))})
    rows = rows.withColumns({"total": F.coalesce("labelled", S.clean_money(F.col("euro_"))), "in_table": vat_amount(F.col("tax_values"))})
    rows = rows.withColumn("tax", F.coalesce("in_table", "given", S.inferred_tax(F.col("subtotal"), F.col("total"))))
    open_ = F.col("tax").isNull() & any_of(low, ["iva", "vat", "imposto"]) & low.rlike(r"\b(?:iva|vat|imposto)\b") & low.rlike(r"\b(?:taxa|base|sujeito|incidencia|incidência)\b")
    sure = F.col("labelled").isNotNull() & S.consistent(F.col("subtotal"), F.col("tax"), F.col("total")) & ~F.coalesce(open_, F.lit(False))
    something = F.coalesce("subtotal", "tax", "total").isNotNull() | S.inferred_currency(F.col("text")).isNotNull()
    return rows.withColumn("confidence", F.when(sure, "high").when(something, "medium").otherwise("unknown"))


def with_items(rows: DataFrame) -> DataFrame:
    """annotated rows with `items`, array of (line_number, description, quantity, unit_price, total): rows of a table with the lines that go on below them;
    where there is none, rows within the text between a table's heading and its totals."""
    a, flat = F.col("a"), F.col("flat")
    rows = rows.withColumn("rows", F.transform(a, row_of))
    rows = rows.withColumn("begin", F.array_position(F.transform("rows", lambda r: r.isNotNull()), True).cast("int"))
    starts = F.filter(F.sequence(F.col("begin"), F.size(a)), lambda i: F.get("rows", i - 1).isNotNull() & ((i == F.col("begin")) | ~continues(F.get(a, i - 1))))
    rows = rows.withColumn("starts", F.when(F.col("begin") > 0, starts))

    def whole(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("a") + 1)
        more = F.transform(F.filter(F.slice("a", i + 1, end - i - 1), continues), lambda s: S.line_description(s["raw"]))
        row = F.get("rows", i - 1)
        return printed(F.array_join(F.concat(F.array(S.line_description(cleaned(row["description"]))), more), " "), row["quantity"], row["unit_price"], row["total"])

    first = lambda low, words: F.least(*(F.when(F.instr(low, w) > 0, F.instr(low, w)) for w in words))
    plain = F.coalesce(F.size("starts"), F.lit(0)) <= 0
    rows = rows.withColumn("region", F.when(plain, F.substr(flat, F.coalesce(bound(F.lower(flat), lambda low: first(low, TABLE_BEGINS)), F.lit(1)))))
    end = bound(F.lower(F.substr("region", F.lit(2))), lambda low: first(low, TABLE_ENDS))
    rows = rows.withColumn("region", F.when(end.isNull(), F.col("region")).otherwise(F.substr("region", F.lit(1), end)))
    # without what stands before the quantity, which would be looked for from each place anew
    row = "(?i)" + ITEM_IN_TEXT.removeprefix(r"[^\d]*")
    cell = lambda x, g: F.regexp_extract(x, row, g)
    within = F.transform(F.regexp_extract_all("region", F.lit(row), F.lit(0)), lambda x: printed(S.line_description(cleaned(cell(x, 2))), cell(x, 1), cell(x, 3), cell(x, 4)))
    within = F.filter(within, lambda x: ~F.lower(x["description"]).rlike(NO_ITEM))
    rows = rows.withColumn("n_items", F.when(plain, F.size(F.coalesce(within, F.array().cast(PRINTED)))).otherwise(F.size("starts")))
    rows = rows.withColumn("printed", F.when(plain, F.coalesce(within, F.array().cast(PRINTED))).otherwise(F.transform("starts", whole)))
    money = F.transform("printed", lambda x: F.struct(x["description"].alias("description"), x["quantity"].alias("quantity"), S.money_token(x["unit_price"]).alias("unit_price"), S.money_token(x["total"]).alias("total")))
    rows = rows.withColumn("priced", money)
    return rows.withColumn("items", F.transform("priced", lambda x, i: F.struct((i + 1).alias("line_number"), x["description"].alias("description"), S.quantity_token(x["quantity"], x["unit_price"], x["total"]).alias("quantity"), x["unit_price"].alias("unit_price"), x["total"].alias("total"))))


PRINTED = "array<struct<description:string,quantity:string,unit_price:string,total:string>>"


def printed(*values: Column) -> Column:
    return F.struct(*(v.alias(n) for n, v in zip(("description", "quantity", "unit_price", "total"), values, strict=True)))
