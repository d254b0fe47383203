"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What separates words made of ASCII letters, digits and every non-ASCII character.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of a batch that goes to Python: Spark's 10,000 whole texts are tens of MB, held by the JVM and the worker alike.
BATCH_ROWS, ROWS_SETTING = 1024, "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS; a lower number stays. It is left so, as frames are run after they are returned."""
    if not 0 < int(spark.conf.get(ROWS_SETTING)) <= BATCH_ROWS:  # 0 and less: no limit
        spark.conf.set(ROWS_SETTING, str(BATCH_ROWS))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once even where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def alnum_words(text: Column) -> Column:
    """The words of a text as they stand (A-Z not lowered); null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NOT_WORD), lambda w: w != "")


def window_hashes(word_hashes: Column, k: int) -> Column:
    """Hash of each run of k consecutive words, from the words' hashes; empty if there are fewer."""
    n = F.size(word_hashes)
    return F.when(
        n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(word_hashes, i, k)))
    ).otherwise(F.array().cast("array<bigint>"))


def remainder_of_id(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, mod m; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session; on one machine (tests) a new local one where none is named, on a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, with its lineage cut."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared folder, not made yet."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """The path that a worker process opens. The shared folder has to be mounted on every machine."""
    local = path.removeprefix("file:")
    if "://" in local:
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder for memory-mapped models, not {path}")
    return "/" + local.lstrip("/") if os.path.isabs(local) else local
