"""Personal data: patterns propose spans, validators confirm them, words nearby adjust the score.

Proposals of four base kinds (email, ip, card, phone) that pass their check always count. The others need
a score: a prior by kind and by whether a checksum (Luhn, mod 97) confirms it, more if a word nearby
names the kind, less if one names something else. Every text is read once, in time linear in its length:
patterns that could try one run of characters again and again are cut into runs first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from ipaddress import IPv6Address
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "ipv6"]
BASE = KINDS[:4]
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")
#: A number of a country's own, as written with an area code.
NATIONAL = re.compile(r"(?<![0-9A-Za-z+.(/-])\(?[0-9]{2,5}\)?[ ./-]{1,2}[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9A-Za-z-]|\.[0-9])")
#: What stands for the @ and the dots of an address that is hidden from machines.
HIDDEN_AT = re.compile(r" ?[\[({] ?(?:at|AT) ?[\])}] ?")
HIDDEN_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?: ?(?:[\[({] ?(?:dot|DOT) ?[\])}]|\.) ?[A-Za-z0-9-]+)+")
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{6,39}(?![0-9A-Za-z:])")
#: Characters before and after a span in which words count.
BEFORE, AFTER = 40, 24
WORD = re.compile(r"[^\W\d_]+")
#: Words that name a kind, in four languages; a word that begins so counts.
NAMING = {
    "email": ("mail", "email", "e-mail", "correo", "courriel", "contact", "kontakt"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "carte", "kreditkarte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "portable", "handy", "ruf", "móvil", "movil", "llam", "appel"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta", "transfer", "überweis", "virement"),
    "ssn": ("ssn", "social", "security", "tax", "taxpayer"),
    "ip": ("ip", "host", "server", "client", "address", "login"),
    "ipv6": ("ip", "host", "server", "client", "address", "login"),
}
#: Words that name numbers which belong to nobody.
DENYING = ("order", "invoice", "serial", "part", "version", "release", "isbn", "model", "sku", "build", "chapter", "section", "ticket", "figure", "table", "bestell", "rechnung", "facture", "commande", "pedido", "factura")
#: What a span is taken for before its neighbours are looked at: confirmed by a checksum or format, or by its look alone.
CONFIRMED, LOOK, NAMED, DENIED, LEAST = 0.7, 0.3, 0.3, 0.3, 0.5
SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>"


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number's check digits fit."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """E-mail addresses: what could stand before each @, from the end of the address before on, and the domain behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and LOCAL.match(text, begin - 1):
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def ip_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers of up to 255 with dots between: of a longer chain of numbers, each four from the left."""
    for m in NUMBERS.finditer(text):
        if m[0].count(".") >= 3:
            parts = [(x.start(), x.end(), x[0].lstrip("0")) for x in DIGITS.finditer(text, m.start(), m.end())]
            for k in range(0, len(parts) - 3, 4):
                if all(len(x) < 4 and int(x or 0) <= 255 for _, _, x in parts[k : k + 4]):
                    yield parts[k][0], parts[k + 3][1]


def cards(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Runs of 12 to 19 digits that pass Luhn's check; and the runs with more than 19 digits, or of several groups, that don't."""
    good, rest = [], []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            good.append(m.span())
        elif len(digits) > 12:
            rest.append(m.span())
    return good, rest


def cards_in_runs(text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Card numbers beside other numbers in one run: a group of 12 to 19 digits, or groups of four, that pass Luhn's check and begin as cards do."""
    groups = [(m.start(), m.end()) for m in DIGITS.finditer(text, begin, end)]
    k = 0
    while k < len(groups):
        for j in (k, k + 3):
            if j >= len(groups) or (j > k and any(e - s != 4 for s, e in groups[k : j + 1])):
                continue
            digits = "".join(text[s:e] for s, e in groups[k : j + 1])
            if 12 <= len(digits) <= 19 and digits[0] in "23456" and luhn(digits) and len(set(digits)) > 1:
                yield groups[k][0], groups[j][1]
                k = j
                break
        k += 1


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


def adjusted(text: str, kind: str, start: int, end: int, prior: float) -> float:
    """The prior, changed by the words nearby."""
    near = [w.lower() for w in (*WORD.findall(text[max(0, start - BEFORE) : start]), *WORD.findall(text[end : end + AFTER]))]
    named = any(w.startswith(NAMING[kind]) for w in near)
    denied = any(w.startswith(DENYING) for w in near)
    return round(min(1.0, max(0.0, prior + NAMED * named - DENIED * denied)), 3)


def hidden_addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in HIDDEN_AT.finditer(text):
        before = LOCAL_RUN.search(text, max(0, m.start() - 64), m.start())  # the part before the @ has 64 characters at most
        behind = HIDDEN_DOMAIN.match(text, m.end())
        if before and behind:
            yield before.start(), behind.end()


def proposals(text: str, rest: list[tuple[int, int]]) -> Iterator[tuple[str, int, int, float]]:
    """What isn't of the base: kind, begin, end, prior."""
    for begin, end in rest:
        for a, b in cards_in_runs(text, begin, end):
            yield "card", a, b, CONFIRMED
    for m in IBAN.finditer(text):
        value = m[0].replace(" ", "")
        if 15 <= len(value) <= 34 and mod97(value):
            yield "iban", *m.span(), CONFIRMED
    for m in SSN.finditer(text):
        yield "ssn", *m.span(), LOOK
    for m in NATIONAL.finditer(text):
        if 7 <= sum(map(str.isdigit, m[0])) <= 13:
            yield "phone", *m.span(), LOOK
    for a, b in hidden_addresses(text):
        yield "email", a, b, CONFIRMED
    for m in IPV6.finditer(text):
        try:
            IPv6Address(m[0])
        except ValueError:
            continue
        if any(c.isdigit() for c in m[0]):
            yield "ipv6", *m.span(), CONFIRMED


def spans(text: str) -> list[Span]:
    """All spans by place, then kind. Base spans may overlap one another; the others stand clear of them and of each other: the first counts, of those that begin together the likelier."""
    has_digit = DIGITS.search(text) is not None
    if not has_digit and "@" not in text and not HIDDEN_AT.search(text):
        return []
    found = [Span("email", a, b, adjusted(text, "email", a, b, CONFIRMED), True) for a, b in addresses(text)]
    rest: list[tuple[int, int]] = []
    if has_digit:
        good, rest = cards(text)
        for kind, each in (("ip", ip_addresses(text)), ("card", good), ("phone", phones(text))):
            found += [Span(kind, a, b, adjusted(text, kind, a, b, CONFIRMED), True) for a, b in each]
    more = [Span(kind, a, b, adjusted(text, kind, a, b, prior), False) for kind, a, b, prior in proposals(text, rest)]
    taken = sorted((s.start, s.end) for s in found)
    free = clear(sorted((s for s in more if s.score >= LEAST), key=lambda s: (s.start, -s.score, KINDS.index(s.kind))), taken)
    return sorted([*found, *free], key=lambda s: (s.start, KINDS.index(s.kind)))


def clear(more: list[Span], taken: list[tuple[int, int]]) -> Iterator[Span]:
    """Of spans by place, those that overlap neither `taken` nor one given before."""
    end = k = reach = 0
    for s in more:
        while k < len(taken) and taken[k][0] < s.end:
            reach = max(reach, taken[k][1])
            k += 1
        if s.start >= reach and s.start >= end:
            yield s
            end = s.end


def written(found: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans, n_email, n_ip, n_card, n_phone, base, every of each row of docs(doc_id, text).

    spans: kind, start, end (code points, end exclusive), score, base, by start, then kind. The counts are those of base spans; base and
    every are the base spans and all spans as kind:start:end, joined by commas. Null and empty texts have none; repeated rows are kept;
    null ids stay; other columns are ignored; an empty table gives no rows.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])
        for b in batches:
            each = [spans(t.as_py() or "") for t in b.column(1)]
            base = [[s for s in x if s.base] for x in each]
            columns = [b.column(0), pa.array([[s._asdict() for s in x] for x in each], pa.list_(kind)), *(pa.array([sum(s.kind == k for s in x) for x in base], pa.int64()) for k in BASE)]
            columns += [pa.array([written(x) for x in of], pa.string()) for of in (base, each)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "spans", *(f"n_{k}" for k in BASE), "base", "every"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(found, f"doc_id bigint, spans {SPANS}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, every string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of its text replaced by its kind in brackets ([EMAIL]) and n_chars, if there, counted anew; of spans that overlap, the first counts.

    Null and empty texts and rows without spans stay; ids, repeats and further columns stay as they are, whatever their names.
    """

    @F.pandas_udf("string")
    def marked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else replaced(t))

    text = F.col("text").cast("string")
    out = docs.withColumn("text", marked(text))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def replaced(text: str) -> str:
    out, at = [], 0
    for s in spans(text):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), F.col("every").alias("spans"))
