"""Merkle manifest of a dataset: a persistent tree whose versions copy only the path above a changed row.

Leaves of a source are numbered by ranges of rows. An aligned block of FAN^depth leaves is one row of a
table and is worked on in one task; the blocks' roots are the nodes of the next tier, which is cut into
blocks in the same way, and the roots of the sources, in order, are the leaves of the last tree. A
changed leaf makes a version: within its block only its ancestors are copied, all other nodes are those
of the untouched tree; the version goes on above the block along the block's own path, which is joined
to it. So no task holds more than a block, and no version costs more than its path.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remainder_of_id, shared_path, table

FAN = 3
#: Levels within a block: 3^7 = 2,187 leaves, some 200 KB.
DEPTH = 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SIDES = "array<struct<left:string,right:string>>"
PATHS = f"g string, i bigint, sides {SIDES}, top string"
VERSIONS = f"g string, i bigint, doc_id bigint, leaf string, changed string, siblings {SIDES}, copies array<string>, subroot string, root string"


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(n: int, depth: int) -> int:
    """Levels above n nodes until one is left, `depth` at most."""
    up = 0
    while n > 1 and up < depth:
        n, up = -(-n // FAN), up + 1
    return up


def levels(nodes: list[str], up: int) -> list[list[str]]:
    """The nodes and the `up` levels above them: each run of FAN, the last one shorter, is hashed into one."""
    out = [nodes]
    for _ in range(up):
        nodes = [digest(nodes[k : k + FAN]) for k in range(0, len(nodes), FAN)]
        out.append(nodes)
    return out


def sides(tree: list[list[str]], place: int) -> list[tuple[str, str]]:
    """What stands left and right of a leaf and of its ancestors in their runs, from below."""
    out = []
    for level in tree[:-1]:
        first = place - place % FAN
        out.append(("".join(level[first:place]), "".join(level[place + 1 : first + FAN])))
        place //= FAN
    return out


def copied(path: list[tuple[str, str]], leaf: str) -> list[str]:
    """The ancestors of a changed leaf, anew: the nodes of its version that aren't shared with the untouched tree."""
    out = []
    for left, right in path:
        leaf = digest([left, leaf, right])
        out.append(leaf)
    return out


def pairs(paths: list[list[tuple[str, str]]]) -> pa.Array:
    """Lists of (left, right) as an Arrow array."""
    flat = [x for p in paths for x in p]
    both = pa.StructArray.from_arrays([pa.array([a for a, _ in flat], pa.string()), pa.array([b for _, b in flat], pa.string())], names=["left", "right"])
    ends = [0]
    for p in paths:
        ends.append(ends[-1] + len(p))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both)


def stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, f"manifest-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows(g, ...) with i, the place within g by `order`, and n, the rows of g. Ranges of rows are counted apart and summed."""
    sort = [F.col(c).asc_nulls_first() for c in ("g", *order)]
    rows = stored(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("number", F.monotonically_increasing_id()).withColumn("part", F.shiftright("number", 33)), "numbers")
    parts = rows.groupBy(F.col("g").alias("g_"), F.col("part").alias("part_")).agg(F.min("number").alias("low"), F.count("*").alias("many"))
    whole = Window.partitionBy("g_")
    before = F.sum("many").over(whole.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("g_", "part_", "low", F.coalesce(before, F.lit(0)).alias("before"), F.sum("many").over(whole).alias("n"))
    out = rows.join(parts, rows["g"].eqNullSafe(parts["g_"]) & (rows["part"] == parts["part_"]))
    return out.withColumn("i", F.col("before") + F.col("number") - F.col("low")).drop("number", "part", "g_", "part_", "low", "before")


def blocks(nodes: DataFrame, size: int, fields: list[str]) -> DataFrame:
    """g, block, n, members (i and the fields, by i): nodes(g, i, n, ...) in aligned blocks of `size`."""
    by = nodes.groupBy("g", F.floor(F.col("i") / size).alias("block"), "n")
    return by.agg(F.array_sort(F.collect_list(F.struct("i", *fields))).alias("members"))


def members(b: pa.RecordBatch) -> Iterator[tuple[dict, pa.StructArray]]:
    """Other columns, and the members, of each row of a batch."""
    others = b.drop_columns(["members"]).to_pylist()
    each, at = b.column("members").flatten(), 0
    for row, k in zip(others, pc.list_value_length(b.column("members")).to_pylist(), strict=True):
        yield row, each.slice(at, k)
        at += k


def roots(of: DataFrame, depth: int) -> DataFrame:
    """The nodes of the next tier: g, i, n, digest of each block."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(row["g"], row["block"], -(-row["n"] // FAN**depth), levels(each.field("digest").to_pylist(), height(row["n"], depth))[-1][0]) for row, each in members(b)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["g", "i", "n", "digest"])

    return of.mapInArrow(hashed, "g string, i bigint, n bigint, digest string")


def with_upper(of: DataFrame, upper: DataFrame) -> DataFrame:
    """Blocks with the path above them and the root of their tree."""
    upper = upper.select(F.col("g").alias("g_"), F.col("i").alias("i_"), "sides", "top")
    return of.join(upper, of["g"].eqNullSafe(upper["g_"]) & (of["block"] == upper["i_"])).drop("g_", "i_")


def paths(nodes: DataFrame, depth: int) -> DataFrame:
    """g, i, sides, top: of each of nodes(g, i, n, digest) the path to the root of its tree, and that root; tier by tier."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    own = blocks(nodes, FAN**depth, ["digest"])
    if most > FAN**depth:
        own = stored(own, "blocks")
        own = with_upper(own, paths(stored(roots(own, depth), "roots"), depth))
    else:
        own = own.withColumns({"sides": F.array().cast(SIDES), "top": F.lit(None).cast("string")})

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, each in members(b):
                tree = levels(each.field("digest").to_pylist(), height(row["n"], depth))
                above, top = [(x["left"], x["right"]) for x in row["sides"]], row["top"] or tree[-1][0]
                k = len(each)
                yield pa.RecordBatch.from_arrays([pa.array([row["g"]] * k, pa.string()), each.field("i"), pairs([sides(tree, p) + above for p in range(k)]), pa.array([top] * k)], names=["g", "i", "sides", "top"])

    return own.mapInArrow(walked, PATHS)


def encoded(c: Column) -> Column:
    """A value with its length, so that no two rows have one encoding; `-` for null."""
    c = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields.values())), 256)


def versions(docs: DataFrame, tampered: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """A row per row of docs(doc_id, source, lang, n_chars, text): its place in the tree, its proof, and the version that it makes.

    tampered: the row's changed text, null where it stays. g, i: source and place in it, by doc_id (null first, then by leaf; rows that
    repeat stand side by side and have a proof each). leaf, changed: hashes of the row as it was and, if it differs, as it is now.
    siblings: what stands (left, right) of the leaf and of its ancestors, level by level, through the source's root to the root. copies:
    the ancestors of a changed leaf in its version, from below, the last being the version's root; all other nodes are shared with the
    untouched tree; empty for rows that stay. subroot, root: of the source and of all. A null source is a source, the first; null and empty
    values differ; further columns are ignored; an empty table gives no rows.
    """
    fields = {c: F.col(c) for c in FIELDS}
    own = leaf(fields)
    now = leaf(fields | {"text": tampered}) if tampered is not None else F.lit(None).cast("string")
    changed = F.when(tampered.isNotNull() & ~tampered.eqNullSafe(F.col("text")), now) if tampered is not None else now
    rows = docs.select(F.col("source").cast("string").alias("g"), F.col("doc_id").cast("bigint").alias("doc_id"), own.alias("digest"), changed.alias("changed"))
    rows = stored(rows.withColumn("spot", F.monotonically_increasing_id()), "leaves")  # rows that repeat stand by their spot
    own = stored(blocks(numbered(rows, ["doc_id", "digest", "spot"]), FAN**depth, ["doc_id", "digest", "changed"]), "leaf-blocks")
    upper = stored(paths(stored(roots(own, depth), "roots"), depth), "paths")
    # the sources' roots are the leaves of one last tree
    tops = numbered(upper.where("i = 0").select(F.lit("").alias("g"), F.col("g").alias("source"), F.col("top").alias("digest")), ["source"])
    tops = stored(tops, "tops")
    last = paths(tops, depth).select("i", F.col("sides").alias("last"), F.col("top").alias("root"))
    last = tops.select(F.col("source").alias("s_"), "i").join(last, "i").drop("i")
    upper = upper.join(last, upper["g"].eqNullSafe(last["s_"])).select("g", "i", F.concat("sides", "last").alias("sides"), F.struct("top", "root").alias("top"))

    def versioned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, each in members(b):
                tree = levels(each.field("digest").to_pylist(), height(row["n"], depth))
                above, k = [(x["left"], x["right"]) for x in row["sides"]], len(each)
                proofs = [sides(tree, p) + above for p in range(k)]
                copies = [copied(p, x) if x else [] for p, x in zip(proofs, each.field("changed").to_pylist(), strict=True)]
                columns = [
                    pa.array([row["g"]] * k, pa.string()), each.field("i"), each.field("doc_id"), each.field("digest"), each.field("changed"), pairs(proofs), pa.array(copies, pa.list_(pa.string())),
                    pa.array([row["top"]["top"]] * k, pa.string()), pa.array([row["top"]["root"]] * k, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ("g", "i", "doc_id", "leaf", "changed", "siblings", "copies", "subroot", "root")])

    return with_upper(own, upper).mapInArrow(versioned, VERSIONS)


def folded(start: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings give: what someone who holds a row and its proof works out."""
    return F.aggregate(siblings, start, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def proved(rows: DataFrame) -> DataFrame:
    """rows of versions() with proof_sha256 (of all siblings), folded_root (the version's root where the row has changed) and verified."""
    proof = F.sha2(F.concat(F.lit(""), F.array_join(F.transform("siblings", lambda s: F.concat(s["left"], s["right"])), "")), 256)
    version = F.when(F.size("copies") > 0, F.element_at("copies", -1)).otherwise(F.coalesce("changed", "leaf"))  # a tree of one leaf has no ancestors
    rows = rows.withColumns({"proof_sha256": proof, "folded_root": F.when(F.col("changed").isNotNull(), version).otherwise(folded(F.col("leaf"), F.col("siblings")))})
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def copied_nodes(rows: DataFrame) -> DataFrame:
    """source, doc_id, level, place, digest: the nodes that each version of versions() has of its own. Levels count from the leaves (0) up and go on in the
    tree of the sources; place counts from the left in the tree of the source, and is null above it."""
    each = rows.where("changed is not null").select(F.col("g").alias("source"), "doc_id", "i", "subroot", F.posexplode(F.concat(F.array("changed"), F.col("copies"))).alias("level", "digest"))
    return each.select("source", "doc_id", "level", F.floor(F.col("i") / F.pow(F.lit(FAN), F.col("level"))).alias("place"), "digest")


def without_line_feeds(docs: DataFrame) -> Column:
    """The tampering of the query: rows whose id's crc32 is even lose the line feeds of their text."""
    return F.when(remainder_of_id(F.col("doc_id"), 2) == 0, F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return proved(versions(docs, without_line_feeds(docs))).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
