"""What steps may cost at size, as their plans tell: texts rendered once, payloads parsed where they hold a name, amounts joined once; odd payloads as ever."""

from pyspark.sql import functions as F

from tallyforge.operators import annotated, documents, reconcile, validate
from tallyforge.sources import payloads, statements, views
from tallyforge.streaming import ingest


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_regions_render_texts_once(spark):
    """No filter on the lines stands below the deal, where it would render and read each text again; blank texts have no lines."""
    texts = spark.range(4).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, F.concat(F.lit("Item\nTotal "), F.format_number("id", 2))).when(F.col("id") == 2, "").alias("text"))
    got = documents.regions(views.dealt(texts))
    assert plan_of(got).count("format_number") == 1
    assert sorted(map(tuple, got.collect())) == [(0, 0, "table"), (0, 1, "totals"), (1, 0, "table"), (1, 1, "totals")]


PAYLOADS = [
    (r'{"invoice\u004eumber":"A","metadata":{"issue\u0044ate":"d"}}', "A", None, "d"), ('{"number":"N","invoice":{"invoiceNo":" ","number":"M"},"parties":{"vendor":{"name":" V "}}}', "N", "V", None),
    ("{'number':'Q','metadata':{'vendorName':7.50}}", "Q", "7.5", None), ('{"invoiceMetadata":{"number":12},"note":"vendor name"}', "12", None, None), ('{"number":{"a":1}}', '{"a":1}', None, None), ("number", None, None, None), (None, None, None, None),
]


def test_payloads_are_parsed_where_they_hold_the_names(spark):
    """Escaped and single-quoted names are found as ever; each path is read only behind a test for its names, and rows are dealt evenly."""
    rows = spark.createDataFrame([(i, p) for i, (p, *_) in enumerate(PAYLOADS)], "i int, payload string")
    got = payloads.repaired(rows, "i")
    assert [(r.invoice_number, r.supplier_name, r.issue_date) for r in sorted(got.collect())] == [tuple(w) for _, *w in PAYLOADS]
    plan = plan_of(got)
    assert "Repartition 8, true" in plan and plan.count("Contains(") >= plan.count("get_json_object") / 2 > 0


def test_items_of_payloads(spark):
    rows = spark.createDataFrame([(1, '{"rows":[{"it\\u0065m":"a","qty":"2"},null,5]}'), (2, '{"items":[]}'), (3, None)], "i int, payload string")
    got = payloads.repaired_items(rows, "i")
    assert sorted((r.i, r.line_number, r.description, r.quantity) for r in got.collect()) == [(1, 1, "a", "2.00"), (1, 2, None, None), (1, 3, None, None)]
    assert "size(" not in plan_of(got)


def test_contract_parses_an_object_once(spark):
    rows = spark.createDataFrame([(1, "invoice-table-group.v1", '{"confidence":"low","line_items":["{\\"line_number\\":null,\\"line_number\\":1,\\"x\\":2}",{"line_number":1.50,"confidence":1}]}')], "i int, schema string, payload string")
    got = validate.contract(rows)
    assert got.first()["errors"] == ["line_items[0].x: not known", "line_items[1].confidence: not allowed"]
    assert "get_json_object" not in plan_of(got) and got.columns == ["i", "schema", "payload", "errors"]


def test_candidate_pairs_join_amounts_once(spark):
    """Which invoices have no pair is known from counts: the join of amounts stands in the plan once."""
    i = spark.createDataFrame([(1, 1, 100), (1, 2, 9000)], "tenant_id int, invoice_id long, total int").withColumn("total", F.col("total").cast("decimal(18,2)"))
    t = spark.createDataFrame([(1, "a", 95, "2024-01-01"), (1, "b", 5, "2024-01-02")], "tenant_id int, transaction_id string, amount int, posted_at string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    got = reconcile.candidate_pairs(i, t, 1)
    assert sorted(map(tuple, got.collect())) == [(1, 1, "a", "window"), (1, 2, "b", "recent")]
    assert plan_of(got).count("explode(sequence(") == 1


def test_lines_are_cleaned_where_they_have_to_be(spark):
    """Letters beyond ASCII alone don't make a text odd; other blanks, breaks and what stands at a line's ends do, and lines are as ever."""
    plain, odd = ["Incidência\nTotal 1,00 €", "a ' b", "", None], ["a b", "a  b", "x\t", "a b", "‘a", "a \nb", "a'\nb", "é”\nb", "a\x1fb", "a\r\nb"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(plain + odd)], "i int, text string").select("i", annotated.odd(F.col("text")).alias("odd"), documents.lines(F.col("text")).alias("l"))
    got = sorted(rows.collect())
    assert [r.odd for r in got] == [False] * len(plain) + [True] * len(odd)
    assert [r.l for r in got[len(plain) :]] == [["a b"], ["a b"], ["x"], ["a", "b"], ["a"], ["a", "b"], ["a", "b"], ["é", "b"], ["a b"], ["a", "b"]]


def test_windows_of_tax_tables_are_made_once(spark):
    """A window of lines is made once, not once a word of VAT tables; what is found is the same."""
    text = "ACME LDA.\nResumo do\nIVA\nTaxa\nBase\n10.00%\n90.00\n10.00\n100.00\nTotal Documento: 100,00 EUR"
    got = documents.totals(spark.createDataFrame([(1, text), (2, "Taxa\nTotal 5.00")], "doc_id int, text string"))
    assert [(r.doc_id, str(r.tax), str(r.total), r.confidence) for r in sorted(got.collect())] == [(1, "10.00", "100.00", "high"), (2, "5.00", "5.00", "high")]
    assert plan_of(got).count("array_position(") <= 4


def test_near_amounts_compare_whole_cents(spark):
    """Both ends count; pairs compare longs, as the ends' decimals would be objects."""
    money = lambda df, c: df.withColumn(c, F.col(c).cast("decimal(18,2)"))
    i = money(spark.createDataFrame([(1, 1, "100.00"), (1, 2, "0.05"), (1, 3, None), (2, 4, "100.05")], "tenant_id int, invoice_id long, total string"), "total")
    t = money(spark.createDataFrame([(n, f"{a}", a) for n, a in ((1, "89.99"), (1, "90.00"), (1, "110.00"), (1, "110.01"), (1, "-100.00"), (1, "0.05"), (1, "0.04"), (2, "90.04"), (2, "90.05"), (2, "110.05"), (2, "110.06"), (2, None))], "tenant_id int, transaction_id string, amount string"), "amount")
    got = reconcile.near_amounts(i, t)
    assert sorted((r.invoice_id, r.transaction_id) for r in got.collect()) == [(1, "110.00"), (1, "90.00"), (2, "0.05"), (4, "110.05"), (4, "90.05")]
    assert all("decimal" not in x and "t_cents" in x for x in plan_of(got).splitlines() if "Join Inner" in x)


def test_texts_of_a_folder_as_files_of_their_own(spark, tmp_path):
    """Many statements lie in few folders, a file each, and are read as whole texts."""
    statements.render(spark.createDataFrame([("a", "1\n2"), ("a", "3"), ("b", "4")], "file string, text string"), str(tmp_path / "x"), 1)
    got = statements.read(spark, str(tmp_path / "x")).select(statements.name_of(F.col("file")).alias("name"), "text")
    assert sorted(map(tuple, got.collect())) == [("a", "1\n2\n"), ("a", "3\n"), ("b", "4\n")]


def test_a_batch_is_read_once(spark, tmp_path):
    """Rows of a batch are worked out once, though their parts are looked up before they are written; nothing stays in memory."""
    seen = spark.sparkContext.accumulator(0)
    read = F.udf(lambda x: seen.add(1) or x, "long").asNondeterministic()
    batch = spark.range(0, 50, numPartitions=2).select(read("id").alias("k"), F.lit("x").alias("v"))
    for n in (0, 1):
        ingest.append_new(batch, n, str(tmp_path / "store"), ["k"])
    assert seen.value == 100 and spark.read.parquet(str(tmp_path / "store")).count() == 50
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
