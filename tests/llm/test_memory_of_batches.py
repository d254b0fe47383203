"""What goes to a Python process at once, and what it sends back, whatever the size of a task."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import jaccard, language_id, packing, secrets
from tallyforge.llm.common import BATCH_ROWS, ROWS_SETTING, small_batches


@pytest.fixture
def rows_of_batches(spark):
    before = spark.conf.get(ROWS_SETTING)
    yield spark
    spark.conf.set(ROWS_SETTING, before)


def texts(spark, n=2500):
    return spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("the cat sat on mat "), F.col("id") % 50).alias("text"), F.lit("en").alias("lang"))


@pytest.mark.parametrize("run", [
    lambda s, d: language_id.stage(s, d, ""), lambda s, d: packing.pack(d), lambda s, d: secrets.candidates(d), lambda s, d: jaccard.similar(d),
])
def test_texts_go_in_small_batches(rows_of_batches, run):
    spark = rows_of_batches
    spark.conf.set(ROWS_SETTING, "10000")
    run(spark, texts(spark))
    sizes = texts(spark).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n bigint").collect()
    assert max(r.n for r in sizes) <= BATCH_ROWS


@pytest.mark.parametrize("own, left", [("10000", "1024"), ("0", "1024"), ("100", "100")])
def test_a_lower_number_of_rows_stays(rows_of_batches, own, left):
    rows_of_batches.conf.set(ROWS_SETTING, own)
    small_batches(rows_of_batches)
    assert rows_of_batches.conf.get(ROWS_SETTING) == left


def test_language_stage_sends_a_text_once(rows_of_batches):
    docs = texts(rows_of_batches)
    plan = language_id.stage(rows_of_batches, docs, "")._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "ttttt" not in plan
    cast = docs.withColumn("text", F.col("text").cast("binary"))
    assert language_id.stage(rows_of_batches, cast, "").count() == language_id.stage(rows_of_batches, docs, "").count() == 2500
