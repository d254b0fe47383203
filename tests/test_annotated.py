"""Fields of invoice texts in many forms: what each label, pattern and fallback has to find."""

import itertools

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import annotated, documents

PLAIN = """Hill Motors Inc.
77 Hill St,
Hill Town, ST 54321

INVOICE

Bill To
Dana Reed
9 Lake St,

Invoice # 0000451
Invoice date 04-03-2022
Due date 04-17-2022

QTY Description Unit Price Amount
1.00 Change of spark plugs 35.00 $35.00
3.00 Brake pad change ( front ) 20.00 $60.00
2.00 Mechanic's rate per hour 30.00 $60.00

Subtotal $155.00
Sales Tax (5%) $7.75
Total (USD) $162.75
"""
SPLIT = "Hill Motors Inc.\nUpload Logo\nINVOICE\nBill To\nDana Reed\nInvoice#\n0000451\nInvoice date\n04-03-2022\nDue date\n04-17-2022\nQTY Description\nSubtotal\n$155.00\nSales Tax (5%)\n$7.75\nTotal (USD)\n$162.75\nPayment is due in 14 days"
FLAT = "‘Hill Motors inc. 77 Hill & Upload Logo INVOICE inte Customer Name Invoice ‘0000451 TY Description ice Amount 1100 Change of sparkpiugs 3500 $3500 200 Brake pad (front) 2000 $4000 “400 whoo aignment 1750 $7000 Subtotal $145.00 Sales Tax (5%) sizs0 Total USD) $152.25"
SENDER = "INVOICE\nInvoice No:\nINV-00071\nPayment Terms:\nCredit Card\nDate:\n05/01/2023\nSERVICE BAY AUTOS\nLAKE PARK AVE\nLEEDS\nBill to:\nsam jones\n"
BRITISH = "INVOICE\nInvoice No: GB-7\nDate: 05/01/2023\nDue Date: 06/01/2023\nLAKE SERVICES LTD\nBill to:\nsam jones\nVAT 20%\nTotal £120.00\nUnited Kingdom\n"

HEADER = [
    (PLAIN, {"number": "0000451", "supplier": "Hill Motors Inc.", "customer": "Dana Reed", "issue_date": "2022-04-03", "due_date": "2022-04-17", "currency": "USD"}), (SPLIT, {"number": "0000451", "issue_date": "2022-04-03", "due_date": "2022-04-17", "customer": "Dana Reed"}),
    (FLAT, {"number": "0000451", "supplier": "Hill Motors Inc.", "customer": "Customer Name"}), (SENDER, {"supplier": "SERVICE BAY AUTOS", "customer": "sam jones", "number": "INV-00071", "issue_date": "2023-05-01"}),
    (BRITISH, {"issue_date": "2023-01-05", "due_date": "2023-01-06", "currency": "GBP", "supplier": "LAKE SERVICES LTD"}), (BRITISH.replace("VAT 20%", "").replace("£", "$").replace("United Kingdom", ""), {"issue_date": "2023-05-01", "due_date": "2023-06-01", "currency": "USD"}),
    # numbers
    ("FACTURA SIMPLIFICADA\nRecibo: FS 0602/0018", {"number": "FS 0602/0018"}), ("FATURA/RECIBO N:\nK00119/0276", {"number": "K00119/0276"}), ("PARQUE\nDoc n: 077852\nTerminal:22", {"number": "077852"}), ("Banco\nDoc. N.:017554\nBilhete:355", {"number": "017554"}),
    ("Factura: 19FT 002/46\nORIGINAL", {"number": "19FT 002/46"}), ("RECIB0 K1190120396", {"number": "K1190120396"}), ("REC1B0 K2190102400", {"number": "K2190102400"}), ("Fatura Simp11f1cada FS 27406_004/3633", {"number": "FS 27406_004/3633"}),
    ("Fatura número:\nFT 0301017/00005", {"number": "FT 0301017/00005"}), ("FATURA\nNo 13212", {"number": "13212"}), ("FATURA\nSIMPLIFICADA\nORIGINAL\nDATA 18/01/2019\n-15:19\n№° A/28064", {"number": "A/28064"}), ("FATURA\na\nb\nc\nd\ne\nf\ng\nh\n99/1", {"number": None}),
    ("TPA:00189471\nA0000000032010", {"number": "00189471"}), ("Terminal\nA0000000032010", {"number": "A0000000032010"}), ("501649FF20\nCOPIA", {"number": "501649FF20"}), ("Bill No. 53 paid", {"number": "53"}), ("invoice date 2024", {"number": "2024"}), ("no digits", {"number": None}),
    # tax ids
    ("Empresa SA\nNr.Contr.501564292\nRECIBO K1190026905", {"supplier_tax_id": "501564292"}), ("Empresa SA\nCONTRIB.509 684 122\nFATURA", {"supplier_tax_id": "509684122"}), ("Empresa SA\nC0NTRTB.509 684 122", {"supplier_tax_id": "509684122"}), ("Capital Social N11 :505416654", {"supplier_tax_id": "505416654"}),
    ("Empresa\nC.R.C./NUM. CONTRIB.:\nPT503003808\nNOME CLIENTE:", {"supplier_tax_id": "503003808"}), ("Loja\nPT506431134\nVendedor: 14", {"supplier_tax_id": "506431134"}), ("FATURA-RECIBO\nContribuinte: 510776914\nx\nContribuinte: 510010970", {"supplier_tax_id": "510010970", "customer_tax_id": None}),
    ("TINTAS, LDA.\nNIF: 502.689.390\nData: 06.04.2018\nCliente: CASA LDA\nContribuinte: 510776914\nTotal Documento: 11,01 EUR", {"supplier_tax_id": "502689390", "customer_tax_id": "510776914", "issue_date": "2018-04-06", "currency": "EUR"}),
    # dates
    ("FATURA\nNIF: 502689390\nData: 23.01.19", {"issue_date": "2019-01-23"}), ("NIF: 500602760\nData: 2019-01-11 08:52\nNoCliente:\n10001932\nContribuinte: 510776914", {"issue_date": "2019-01-11", "customer_tax_id": "510776914"}), ("DATA 18/01/2019\nNIF: 513350535", {"issue_date": "2019-01-18"}),
    ("Shop\n3/4/2020 10:00\nThe end", {"issue_date": "2020-03-04"}), ("Shop\nBill To\n3/4/2020", {"issue_date": None}), ("Date 1/2/2020\nPayment is due in 30 days", {"due_date": "2020-02-01"}), ("", {"number": None, "supplier": None, "customer": None, "issue_date": None, "currency": None}), (None, {"number": None, "customer_tax_id": None}),
]
#: subtotal, tax, total, confidence
TOTALS = [
    (PLAIN, ("155.00", "7.75", "162.75", "high")), (SPLIT, ("155.00", "7.75", "162.75", "high")), (FLAT, ("145.00", "7.25", "152.25", "high")), ("Total Documento: 11,01 EUR", (None, None, "11.01", "high")), ("Total a Pagar: 1.234,56 €", (None, None, "1234.56", "high")), ("Total (USD) $1,234.56", (None, None, "1234.56", "high")),
    ("TOTAL\nREF\n32,00\nIVA Incluido à taxa\nTaxa%\nIVA\nTotal\nsujeito\n23,00\n5,98\n32,00", (None, "5.98", "32.00", "high")), ("TOTAL\n19,98\nIVA Incluído à taxa indicada\nTaxa%\nSujeito\nIVA\nTotal\n23,00\n16,24\n3,74\n19,98", (None, "3.74", "19.98", "high")),
    ("Total\n€ 8.50\nPagamento\n€ 8.50\nValor\nTotal\nTaxa\nBase\n€ 0.24\n€ 1.30\n23.00\n€ 1.06\nIVA Incluido", (None, "0.24", "8.50", "high")), ("Total\nEUR\n13,80\nResumo do IVA\nTaxa\nIncidência\nImposto\nTotal\n10.00\n8,84\n1,16\n10,00", (None, "1.16", "13.80", "high")),
    ("Subtotal 100.00\nSales tax 10.00\nTotal 105.00", ("100.00", "10.00", "105.00", "medium")), ("Iliquido\nTax%\nV.Tax\n(D)\n10,57\n23\n2,43\nTotal a Pagar:\n13,00 €", (None, "2.43", "13.00", "high")), ("Taxa Incidência\nIVA\nTotal\n23,00%\n8,31\n2,03\n10,84\nPago em\n10,84€", (None, "2.03", "10.84", "medium")),
    ("Pago:EUR\n1.20", (None, None, "1.20", "high")), ("COMPRA\n49,99€\nAUT:432370", (None, None, "49.99", "high")), ("Taxa: 1,35 €\nPAGAMENTO", (None, "1.35", "1.35", "high")), ("U3lor:EUR\n2,40\nData: 2019-01-17", (None, None, "2.40", "high")), ("Reference\n49,99€", (None, None, "49.99", "medium")),
    ("Sub total 5.00\nTotal 6.00\nGrand total $7", (None, None, "7.00", "high")), ("words alone", (None, None, None, "unknown")), ("", (None, None, None, "unknown")), (None, (None, None, None, "unknown")),
]
#: description | quantity | unit price | total
ITEMS = [
    (PLAIN, ["Change of spark plugs|1.00|35.00|35.00", "Brake pad change (front)|3.00|20.00|60.00", "Mechanic's rate per hour|2.00|30.00|60.00"]), (FLAT, ["Change of spark plugs|1.00|35.00|35.00", "Brake pad (front)|2.00|20.00|40.00", "Wheel alignment|4.00|17.50|70.00"]),
    ("Timing chain kit 1 hrs £ 1,300.00 £1,300.00\nwith coolant\n1\nand oil\nVAT £ 182.00\nTotal £1,482.00", ["Timing chain kit with coolant and oil|1.00|1300.00|1300.00"]), ("2 Tea 1.50 3.00\nDiscount 1.00\n1 Cake 4.00 4.00\nBill to me", ["Tea|2.00|1.50|3.00", "Cake|1.00|4.00|4.00"]),
    ("intro words\n4 hours of work 10.00 40.00", ["hours of work|4.00|10.00|40.00"]), ("nothing to buy", []), ("", []), (None, []),
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


@pytest.fixture(scope="module")
def headers(spark):
    return {r.doc_id: r for r in documents.header(frame(spark, [t for t, _ in HEADER])).collect()}


@pytest.mark.parametrize("i", range(len(HEADER)))
def test_header(headers, i):
    assert {k: None if headers[i][k] is None else str(headers[i][k]) for k in HEADER[i][1]} == HEADER[i][1], HEADER[i][0]


def test_totals(spark):
    got = {r.doc_id: tuple(None if x is None else str(x) for x in (r.subtotal, r.tax, r.total, r.confidence)) for r in documents.totals(frame(spark, [t for t, _ in TOTALS])).collect()}
    assert {i: got[i] for i in range(len(TOTALS))} == {i: want for i, (_, want) in enumerate(TOTALS)}


def test_items(spark):
    got = {}
    for r in sorted(documents.items(frame(spark, [t for t, _ in ITEMS])).collect(), key=lambda r: (r.doc_id, r.line_number)):
        got.setdefault(r.doc_id, []).append(f"{r.description}|{r.quantity}|{r.unit_price}|{r.total}")
        assert r.line_number == len(got[r.doc_id])
    assert {i: got.get(i, []) for i in range(len(ITEMS))} == {i: want for i, (_, want) in enumerate(ITEMS)}


def test_a_long_text(spark):
    """20,000 rows of items: what a text costs grows with its lines."""
    rows = "\n".join(f"{i % 7 + 1} Thing number {i} 2.00 {2 * (i % 7 + 1)}.00\nmore of it" for i in range(20_000))
    (r,) = documents.assembled(frame(spark, ["Hill Motors Inc.\nInvoice # 0000451\nInvoice date 04-03-2022\n" + rows + "\nTotal 5.00"])).collect()
    assert r.n_items == 20_000 and r.status == "extracted"


def test_lines_as_printed_are_the_cleaned_ones(spark):
    """Texts of all pieces that make a text odd, one after another."""
    pieces = ["a", "B 1", " ", "  ", "\n", "\r\n", "\t", "'", "‘", " ", "\x1f", " ", "É", "x'", "'y", ""]
    texts = ["".join(t) for n in range(4) for t in itertools.product(pieces, repeat=n)] + [None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    one = annotated.annotated(rows, []).select("text", F.transform("a", lambda s: s["raw"]).alias("raw"), F.transform("a", lambda s: s["low"]).alias("low"))
    same = one.withColumn("want", annotated.cleaned_lines(F.col("text"))).withColumn("lines", annotated.lines(F.col("text")))
    assert same.where("not (raw <=> want) or not (lines <=> want) or not (low <=> transform(want, x -> lower(x)))").count() == 0


def test_only_the_marks_of_the_wanted_fields_are_made(spark):
    rows = spark.createDataFrame([(1, PLAIN)], "doc_id long, text string")
    found = documents.header(rows, ["issue_date"])
    assert str(found.first()["issue_date"]) == "2022-04-03"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "invoice date" in plan and "bill no" not in plan and "payment due" not in plan


def test_header_and_totals_come_from_one_reading(spark):
    rows = spark.createDataFrame([(1, PLAIN), (2, SPLIT), (3, None)], "doc_id long, text string")
    found = documents.header_and_totals(rows, ["number"])
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.number, str(r.total)) for r in found.orderBy("doc_id").collect()] == [("0000451", "162.75"), ("0000451", "162.75"), (None, "None")]


def test_evidence_finds_the_anchors_once_a_document(spark):
    """The filter over all lines that finds the anchors stands outside of what is done for each line."""
    rows = spark.createDataFrame([(1, PLAIN)], "doc_id long, text string")
    known = spark.createDataFrame([(1, "0000451", "Dana Reed")], "doc_id long, number string, customer string")
    found = documents.graded_evidence(rows, known, ["number", "customer"])
    assert {(r.field, r.line_no) for r in found.collect()} == {("number", 7), ("customer", 5)}
    assert "array_max(filter(filter(transform(" not in found._jdf.queryExecution().optimizedPlan().toString()
