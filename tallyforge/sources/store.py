"""A store of tables by tenant, intake of documents, and label corpora."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What may be taken in: media types, and bytes at most.
MEDIA = ["application/pdf", "image/png", "image/jpeg", "text/csv", "text/plain"]
MOST_BYTES = 20_000_000
BUCKETS = 16


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the cluster's shared folder (spark.checkpoint.dir); on one machine without one, under a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a shared folder")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Rows by bucket of their tenant; buckets that the rows fall into are written over, the others stay."""
    bucket = F.pmod(F.crc32(F.col("tenant_id").cast("string").cast("binary")), F.lit(buckets)).cast("int")
    out = rows.withColumn("bucket", bucket)
    out.repartition("bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, tenant: int, buckets: int = BUCKETS) -> DataFrame:
    """A tenant's rows: only its bucket is read."""
    return spark.read.parquet(path).where((F.col("bucket") == zlib.crc32(str(tenant).encode()) % buckets) & (F.col("tenant_id") == tenant)).drop("bucket")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """version, bucket, folder, superseded, tenant_id, n_erased: what each version changed; a version is one file, so it is there as a whole or not at all."""
    return spark.read.parquet(f"{path}/manifest")


def _current(spark: SparkSession, path: str) -> tuple[int, dict[int, str], list[str]]:
    """The last version, its folder of each bucket, and the folders that it has put aside. A manifest has a row a bucket and version: a few."""
    rows = sorted(_manifest(spark, path).collect(), key=lambda r: r["version"])
    last = rows[-1]["version"]
    return last, {r["bucket"]: r["folder"] for r in rows}, [r["superseded"] for r in rows if r["version"] == last and r["superseded"]]


def _commit(spark: SparkSession, path: str, version: int, rows: list[tuple]) -> None:
    """A version's rows as one file. A second writer of the same version fails here, and the first one's stands."""
    made = spark.createDataFrame(rows, "bucket int, folder string, superseded string, tenant_id long, n_erased long")
    made.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/version={version}")


def publish(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A new store of rows, by bucket of their tenant_id (rows without one have a bucket too). A store of no rows has one empty bucket."""
    spark, part = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    out = rows.withColumn("bucket", F.coalesce(F.pmod(F.crc32(F.col("tenant_id").cast("string").cast("binary")), F.lit(buckets)).cast("int"), F.lit(-1)))
    out.repartition("bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.partitionBy("bucket").parquet(f"{path}/{part}")
    filled = [r["bucket"] for r in spark.read.schema("bucket int").parquet(f"{path}/{part}").distinct().collect()]
    if not filled:
        rows.write.parquet(f"{path}/{part}/empty")
    _commit(spark, path, 1, [(b, f"{part}/bucket={b}", None, None, None) for b in filled] or [(-1, f"{part}/empty", None, None, None)])


def load(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the store's last version."""
    return spark.read.parquet(*(f"{path}/{folder}" for folder in _current(spark, path)[1].values()))


def _emptied(spark: SparkSession, path: str, folders: list[str]) -> None:
    """Files of folders that no version refers to any more go, for each is written over with no rows."""
    for folder in folders:
        spark.createDataFrame([], "erased boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/{folder}")


def erase(spark: SparkSession, path: str, tenant: int, buckets: int = BUCKETS) -> int:
    """How many rows of a tenant went from the store and its files.

    The tenant's bucket alone is written anew, without a shuffle; then the version that refers to it is committed with the receipt; then the old files
    go. A run that fails before the commit leaves the old version readable, one that fails after it is ended by the next run, and a tenant without rows
    makes no version. Rows without a tenant stay.
    """
    last, folders, aside = _current(spark, path)
    _emptied(spark, path, aside)
    bucket = zlib.crc32(str(tenant).encode()) % buckets
    if bucket not in folders:
        return 0
    rows = spark.read.parquet(f"{path}/{folders[bucket]}")
    n = rows.where(F.col("tenant_id") == tenant).count()
    if n:
        folder = f"data/{uuid.uuid4().hex}"
        rows.where(~F.coalesce(F.col("tenant_id") == tenant, F.lit(False))).write.parquet(f"{path}/{folder}")
        _commit(spark, path, last + 1, [(bucket, folder, folders[bucket], tenant, n)])
        _emptied(spark, path, [folders[bucket]])
    return n


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """tenant_id, version, n_erased of each erasure from the store: nothing else is kept of it."""
    return _manifest(spark, path).where("n_erased is not null").select("tenant_id", "version", "n_erased")


def stored_anywhere(spark: SparkSession, path: str, tenant: int) -> DataFrame:
    """A tenant's rows in any data file below the store, whether a version refers to it or not."""
    files = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(f"{path}/data")
    return files.where(F.col("tenant_id") == tenant)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """name, media_type, size, content_hash, content of the files below a path; the media type is that of the name's ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"file=([^/]+)/", 1)
    ending = F.element_at(F.split(name, "[.-]"), -1)
    media = F.when(ending == "txt", "text/plain").when(ending == "csv", "text/csv").when(ending == "pdf", "application/pdf").when(ending == "png", "image/png").when(ending.isin("jpg", "jpeg"), "image/jpeg")
    return files.select(name.alias("name"), media.alias("media_type"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"), "content")


def intake(files: DataFrame, stored: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """files(file_id, tenant_id, name, media_type, content) with file_name, size, content_hash and state: accepted, or why not.

    Empty, too large or of another media type: refused. A content that its tenant has stored (stored: tenant_id, content_hash), or that a
    file of the tenant with a smaller id brings too, is a duplicate. The hash is combined before it is shuffled, and no group is held.
    """
    base = F.trim(F.regexp_extract("name", r"([^/\\\\]*)$", 1))
    name = F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    size, media = F.octet_length("content"), F.lower(F.trim(F.split("media_type", ";")[0]))
    why = F.when(F.coalesce(size, F.lit(0)) == 0, "EMPTY_FILE").when(size > most_bytes, "FILE_TOO_LARGE").when(~F.coalesce(media.isin(MEDIA), F.lit(False)), "UNSUPPORTED_MIME_TYPE")
    rows = files.select("file_id", "tenant_id", F.coalesce(F.nullif(name, F.lit("")), F.lit("upload")).alias("file_name"), size.alias("size"), F.sha2("content", 256).alias("content_hash"), why.alias("why"))
    first = rows.where("why is null").groupBy("tenant_id", "content_hash").agg(F.min("file_id").alias("first"))
    known = stored.select("tenant_id", "content_hash", F.lit(True).alias("known")).distinct()
    j = rows.join(first, ["tenant_id", "content_hash"], "left").join(known, ["tenant_id", "content_hash"], "left")
    again = F.coalesce(F.col("known"), F.lit(False)) | (F.col("file_id") != F.col("first"))
    return j.select("file_id", "tenant_id", "file_name", "size", "content_hash", F.coalesce("why", F.when(again, "DUPLICATE").otherwise("accepted")).alias("state"))


CASES = "dataset_id string, cases array<struct<case_id: string, document_type: string, task_tags: array<string>, label_paths: map<string, string>>>"


def label_cases(manifests: DataFrame) -> DataFrame:
    """dataset_id, case_id, document_type, kind, label_path, declared of each label that manifests(text) name; declared: the kind is one of the case's task tags."""
    one = manifests.select(F.from_json("text", CASES).alias("m")).select("m.dataset_id", F.explode("m.cases").alias("x"))
    each = one.select("dataset_id", "x.case_id", "x.document_type", "x.task_tags", F.explode("x.label_paths").alias("kind", "label_path"))
    return each.select("dataset_id", "case_id", "document_type", "kind", "label_path", F.coalesce(F.array_contains("task_tags", F.col("kind")), F.lit(False)).alias("declared"))


def labels(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Each label of label_cases() with its payload from files(path, text) and state: ready, undeclared or missing."""
    j = cases.join(files.select(F.col("path").alias("label_path"), "text"), "label_path", "left")
    state = F.when(~F.col("declared"), "undeclared").when(F.col("text").isNull(), "missing").otherwise("ready")
    return j.select("dataset_id", "case_id", "kind", "label_path", state.alias("state"), F.when(state == "ready", F.col("text")).alias("payload"))
