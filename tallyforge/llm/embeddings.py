"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

A unit vector u is s*q + r with q in int8 and e = |r| measured exactly, so that for two of them
|u.v - s*t*(q.p)| <= e_u + (1 + e_u) * e_v. Tile products of int8 values (exact: summed over at most
1,040 places in float32, beyond that in double) with each pair's own bound tell most pairs apart:
surely linked, surely not. Only pairs that the bound leaves open are worked out in double.

Equal vectors are one node with a weight. Nodes are dealt into blocks; each pair of blocks is one
task. The first pass ships int8 values, scales and bounds; it returns a row for each node that is
linked or open (the sure links' weight, the smallest node of its component there), never the pairs, so
that a large group of near copies stays small. The second ships full vectors, of open nodes alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table
from .components import components

#: Most vectors of a block; rows of a tile; fewest blocks where there are enough vectors, so that there is work for many tasks.
BLOCK, STRIP, FEWEST = 8192, 512, 16
#: 127 * 127 * EXACT < 2^24: float32 holds sums of so many products exactly.
EXACT = 1040
#: What rounding adds to the bound: of A in float32 and of unit vectors in double.
SLACK = 2e-6


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, and the lengths of what is left, rounded up."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None])
    left = np.linalg.norm(unit - q * scale[:, None], axis=1)
    return q.astype(np.int8), scale, left * (1 + 1e-9) + 1e-9


class Tile(NamedTuple):
    """One side of a pair of blocks."""

    q: np.ndarray
    scale: np.ndarray
    left: np.ndarray

    def rows(self, part: slice) -> Tile:
        return Tile(self.q[part], self.scale[part], self.left[part])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 values, exactly."""
    if a.shape[1] <= EXACT:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return sum((products(a[:, k : k + EXACT], b[:, k : k + EXACT]).astype(float) for k in range(0, a.shape[1], EXACT)), 0.0)


def strips(a: Tile, b: Tile, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j) that may reach the threshold, and whether they surely do, a strip of rows of a at a time."""
    scale = (b.scale * (1 + 1e-6)).astype(np.float32)
    most = b.left.max()
    for at in range(0, len(a.q), STRIP):
        x = a.rows(slice(at, at + STRIP))
        p = products(x.q, b.q)
        # one comparison a cell with the block's largest error; what is left is held against the pair's own
        need = (threshold - x.left - (1 + x.left) * most - SLACK) / x.scale
        i, j = np.nonzero(p * scale >= np.minimum(need * (1 - 1e-6), need * (1 + 1e-6)).astype(np.float32)[:, None])
        value, bound = p[i, j] * x.scale[i] * b.scale[j], x.left[i] + (1 + x.left[i]) * b.left[j] + SLACK
        near = value + bound >= threshold
        i, j, value, bound = i[near], j[near], value[near], bound[near]
        yield i + at, j, value - bound >= threshold


def cosines(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of unit vectors a[i] and b[j] in double, some at a time."""
    step = max(1, (1 << 22) // a.shape[1])
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step))])


class Forest:
    """Union of row numbers, each set named by its smallest member."""

    def __init__(self, n: int) -> None:
        self.top = np.arange(n)

    def settle(self) -> None:
        while not np.array_equal(up := self.top[self.top], self.top):
            self.top = up

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            x, y = self.top[i], self.top[j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(self.top, np.maximum(x, y), np.minimum(x, y))
            self.settle()


FOUND = "width int, lo int, hi int, side int, id bigint, n bigint, top bigint, open boolean"


def linked(pair: pa.Table, threshold: float, exact: bool) -> pa.Table:
    """What one pair of blocks finds, by node: n (weight of its links here), top (smallest id of its component here), open (in a pair that
    the bounds don't decide). Only sure links count at first; the second time (exact) only open pairs do, decided by full vectors."""
    order = np.lexsort((pair["id"].to_numpy(), pair["side"].to_numpy()))
    pair = pair.take(pa.array(order))
    ids, weight, side = pair["id"].to_numpy(), pair["weight"].to_numpy(), pair["side"].to_numpy()
    matrix = lambda c, kind: np.frombuffer(b"".join(pair[c].to_pylist()), kind).reshape(len(ids), -1)
    every = Tile(matrix("q", np.int8), pair["scale"].to_numpy(), pair["left"].to_numpy())
    v = matrix("v", "<f8") if exact else None
    cut = int((side == 0).sum())
    alone = pair["lo"][0].as_py() == pair["hi"][0].as_py()  # a block with itself
    b0 = 0 if alone else cut
    links, forest, opened = np.zeros(len(ids), np.int64), Forest(len(ids)), np.zeros(len(ids), bool)
    rank = np.argsort(np.argsort(ids))  # the forest's smallest is by id
    back = np.argsort(ids)
    if cut and len(ids) > b0:
        for i, j, sure in strips(every.rows(slice(0, cut)), every.rows(slice(b0, None)), threshold):
            j = j + b0
            if alone:
                i, j, sure = i[i != j], j[i != j], sure[i != j]
            if exact:
                i, j = i[~sure], j[~sure]
                on = cosines(v, v, i, j) >= threshold
            else:
                opened[i[~sure]] = opened[j[~sure]] = True
                on = sure
            i, j = i[on], j[on]
            links += np.bincount(i, weight[j], len(ids)).astype(np.int64)
            if not alone:
                links += np.bincount(j, weight[i], len(ids)).astype(np.int64)
            forest.join(rank[i], rank[j])
    on = np.flatnonzero((links > 0) | opened)
    same = lambda c: pa.array(np.full(len(on), pair[c][0].as_py()), pa.int32())
    return pa.table({
        "width": same("width"), "lo": same("lo"), "hi": same("hi"), "side": pa.array(side[on], pa.int32()), "id": pa.array(ids[on], pa.int64()), "n": pa.array(links[on], pa.int64()),
        "top": pa.array(ids[back[forest.top[rank[on]]]], pa.int64()), "open": pa.array(opened[on]),
    })


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors(vec_id, embedding).

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing and are their own component;
    vectors of different lengths don't link; rows that repeat an id count as vectors of their own under that id; a null id has a null
    component and isn't linked; other columns are dropped.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & finite & F.exists(x, lambda c: c != 0.0))
    node = good.groupBy(x.alias("x")).agg(F.min("vec_id").cast("bigint").alias("id"), F.count("*").alias("weight"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.column(0):
                v = np.asarray(r.values.to_numpy(zero_copy_only=False), float)
                v = v / np.abs(v).max()
                v = v / np.linalg.norm(v)
                q, scale, left = quantised(v[None, :])
                out.append((v.astype("<f8").tobytes(), q.tobytes(), float(scale[0]), float(left[0]), len(v)))
            kinds = [pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32()]
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*columns, b.column(1), b.column(2)], names=["v", "q", "scale", "left", "width", "id", "weight"])

    nodes = checkpointed(node.mapInArrow(unit, "v binary, q binary, scale double, left double, width int, id bigint, weight bigint"))
    count = nodes.count()
    n = max(1, math.ceil(count / block), min(FEWEST, count // 256))
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    other = F.sequence(F.lit(0), F.lit(n - 1))
    dealt = nodes.withColumn("own", own).withColumn("other", F.explode(other))
    pair = F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side")
    dealt = dealt.select("width", *pair, "id", "weight", "q", "scale", "left")
    sure = checkpointed(dealt.groupBy("width", "lo", "hi").applyInArrow(lambda t: linked(t, threshold, False), FOUND))
    again = sure.where("open").select("lo", "hi", "side", "id").join(nodes, "id").groupBy("width", "lo", "hi").applyInArrow(lambda t: linked(t, threshold, True), FOUND)
    found = checkpointed(sure.unionByName(again).where("n > 0").select("id", "n", "top"))
    sums = found.groupBy("id").agg(F.sum("n").alias("n"))
    # an id that repeats with other vectors is one end of all their links
    by_id = good.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x")).join(node, "x").select("vec_id", "id", "weight")
    copies = by_id.where("vec_id != id").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))
    label = components(found.select(F.col("id").alias("a"), F.col("top").alias("b")).unionByName(copies))
    counted = by_id.join(sums, "id", "left").groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id")).join(counted, "vec_id", "left").join(label.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    rows = rows.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return rows.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
