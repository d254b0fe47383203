"""Incremental intake: each micro-batch appends the rows whose key isn't stored yet, once even when a batch is run again."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.operators import reconcile
from tallyforge.sources import statements

PARTS = 64


def append_new(batch: DataFrame, batch_id: int, path: str, key: list[str]) -> None:
    """Writes the new rows (known by `key`) to their batch's own partition, which a rerun writes over.

    The store is laid out by a hash of the key, and of it only the parts that the batch's keys fall into are read, their key columns alone.
    """
    spark = batch.sparkSession
    # kept until it is written: else the batch's files would be read and parsed again for each use
    rows = batch.dropDuplicates(key).withColumn("key_part", F.pmod(F.xxhash64(*key), F.lit(PARTS)).cast("int")).persist()
    try:
        rows.limit(0).write.mode("overwrite").parquet(f"{path}/batch_id=-1/key_part=-1")  # makes the store where there is none
        parts = [r[0] for r in rows.select("key_part").distinct().collect()]  # PARTS at most
        schema = rows.schema.add("batch_id", "integer")
        seen = spark.read.schema(schema).parquet(path).where((F.col("batch_id") != batch_id) & F.col("key_part").isin(parts)).select(key)
        new = rows.join(seen, key, "left_anti")
        new.write.mode("overwrite").partitionBy("key_part").parquet(f"{path}/batch_id={batch_id}")
    finally:
        rows.unpersist()


def start(stream: DataFrame, path: str, checkpoint: str, key: list[str], fresh: bool = True) -> StreamingQuery:
    """What is there now is taken in, then the query ends; the checkpoint carries on from there.

    fresh: the stream is the store's first, whose batches are numbered from 0; a stream that starts anew over a store that has rows gets
    numbers of its own, so that it writes over nothing.
    """
    first = 0 if fresh else zlib.crc32(checkpoint.encode()) % 1_000_000 * 1000
    return stream.writeStream.foreachBatch(lambda b, i: append_new(b, first + i, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def transactions_of(files: DataFrame) -> DataFrame:
    """Transactions of normalized statements (file, text) in folders tenant=N: whole rows, known by the hash of what they say."""
    good, _ = statements.normalized(files)
    tenant = F.regexp_extract("file", r"tenant-(\d+)", 1).cast("int")
    content = F.sha2(F.concat_ws("|", tenant.cast("string"), F.col("posted_at").cast("string"), F.col("amount").cast("string"), "description"), 256)
    return good.select(tenant.alias("tenant_id"), content.alias("transaction_id"), "posted_at", "value_at", "direction", "description", "counterparty", "reference", "currency", "amount", "running_balance")


def propose_new(batch: DataFrame, batch_id: int, invoices: DataFrame, folder: str) -> None:
    """Stores the statements' new transactions and proposes for them alone: the best candidate of each invoice that has no proposal yet.

    Both are written to the batch's own part, which a rerun writes over; files that come again bring nothing.
    """
    spark = batch.sparkSession
    append_new(transactions_of(batch), batch_id, f"{folder}/transactions", ["transaction_id"])
    new = spark.read.schema(transactions_of(batch).schema).parquet(f"{folder}/transactions/batch_id={batch_id}")
    made = reconcile.proposals(reconcile.best(reconcile.candidates(invoices, new)))
    made.limit(0).write.mode("overwrite").parquet(f"{folder}/proposals/batch_id=-1")
    known = spark.read.schema(made.schema.add("batch_id", "integer")).parquet(f"{folder}/proposals").where(F.col("batch_id") != batch_id)
    made.join(known.select("invoice_id"), "invoice_id", "left_anti").write.mode("overwrite").parquet(f"{folder}/proposals/batch_id={batch_id}")


def start_proposals(files: DataFrame, invoices: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """The stream of statement files that is there now, as propose_new, then the query ends."""
    return files.writeStream.foreachBatch(lambda b, i: propose_new(b, i, invoices, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
