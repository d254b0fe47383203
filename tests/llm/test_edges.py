"""Empty tables, extra columns with clashing names, null columns and repeated rows, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import decontamination, embeddings, html_text, jaccard, kneser_ney, licenses, packing, quotes

SF = "/root/testdata/sf0.001"
CLASH = ["id", "a", "b", "u", "v", "n", "w", "at", "hash", "first", "last", "items", "spans", "text_hash", "component", "tok", "set", "d", "t", "bad_id", "value", "n_words", "x"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(df):
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(CLASH)))


OPERATORS = {
    "packing": (packing.pack, ("doc_id", "start", "length", "ids_crc32")),
    "jaccard": (jaccard.similar, ("doc_id", "n_shingles", "component_id")),
    "licenses": (licenses.scan, ("doc_id", "n_words", "n_base", "labels")),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three four five", "en"), (1, "one two three four five", "en"), (2, "One two three four five", None), (3, None, None), (4, "", "en"), (None, None, None), (5, "mit license " * 400, "en")]
    return spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows], DOCS)


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_and_empty_tables(spark, docs, name):
    f, out = OPERATORS[name]
    plain = sorted(map(tuple, f(docs.coalesce(1)).select(*out).collect()), key=repr)
    assert sorted(map(tuple, f(clashing(docs).coalesce(1)).select(*out).collect()), key=repr) == plain
    assert len(plain) >= docs.count()
    assert f(docs.limit(0)).count() == 0


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(7, "two three four"), (None, "five")], "item_id long, text string")
    got = decontamination.contamination(clashing(docs), clashing(bench))
    assert got.count() == docs.count() and got.where("contaminated").count() == 3
    assert decontamination.decontaminate(clashing(docs), clashing(bench)).columns == clashing(docs).columns
    assert decontamination.contamination(docs.limit(0), bench).count() == 0


def test_kneser_ney(spark, docs):
    model = kneser_ney.train(clashing(docs))
    assert kneser_ney.score(clashing(docs), model).count() == docs.count()
    assert kneser_ney.score(docs.limit(0), model).count() == 0


def test_others(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert embeddings.near_duplicates(clashing(v)).count() == 4 and embeddings.near_duplicates(v.limit(0)).count() == 0
    p = spark.createDataFrame([(1, None, "<p>x"), (None, "u", None)], "page_id long, url string, html string")
    assert html_text.extract(clashing(p)).count() == 2 and html_text.extract(p.limit(0)).count() == 0
    c = spark.createDataFrame([(1, 0, None, "hello there all"), (1, 1, "b", None), (None, None, None, None), (1, 0, None, "hello there all")], "conv_id long, turn long, role string, text string")
    assert quotes.link(clashing(c)).count() == 4 and quotes.link(c.limit(0)).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, k):
    """A stage takes empty tables and hard rows, and all but the last return the columns of documents."""
    name, stage = corpus_pipeline.STAGES[k]
    for rows in (docs, docs.limit(0)):
        got = stage(spark, rows, SF)
        n = got.count()
        if name != "packing":
            assert sorted(got.columns) == sorted(docs.columns) and n <= rows.count()
    assert n == 0
