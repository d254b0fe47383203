"""Numbers, running sums and windows of the last rows in an order, for keys of which one may hold a third of all rows.

Rows are sorted by ranges, so one key's rows lie in many tasks; ranges are counted apart and the counts are summed. By its number a row
belongs to a block of bounded size, in which windows are worked out; sums of whole blocks are carried on, and a block gets the last rows
of the one before it. Two rows of one place in the order may come in any order, but in the same one throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources import store

#: Rows of a block.
BLOCK = 20_000


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """rows with their number in the order of their key, from 1."""
    spark, path = rows.sparkSession, store.shared_folder(rows.sparkSession, "ordered")
    by = [*keys, *order]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at_", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("part_", F.shiftright("at_", 33))  # the order is fixed by writing it
    parts = placed.groupBy(*(F.col(k).alias(f"{k}_") for k in keys), F.col("part_").alias("p_")).agg(F.min("at_").alias("low_"), F.count("*").alias("many_"))
    before = F.coalesce(F.sum("many_").over(Window.partitionBy(*(f"{k}_" for k in keys)).orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before_", before)
    same = placed["part_"] == parts["p_"]
    for k in keys:
        same &= placed[k].eqNullSafe(parts[f"{k}_"])
    return placed.join(parts, same).withColumn(name, F.col("before_") + F.col("at_") - F.col("low_") + 1).drop("at_", "part_", "p_", "low_", "many_", "before_", *(f"{k}_" for k in keys))


def running(numbered_rows: DataFrame, keys: list[str], number: str, block: int = BLOCK, **sums: Column) -> DataFrame:
    """Numbered rows with running sums, each up to and with the row."""
    rows = numbered_rows.withColumn("block_", F.floor((F.col(number) - 1) / block))
    inner = Window.partitionBy(*keys, "block_").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    total = rows.groupBy(*(F.col(k).alias(f"{k}_") for k in keys), F.col("block_").alias("b_")).agg(*(F.sum(c).alias(f"{n}_") for n, c in sums.items()))
    outer = Window.partitionBy(*(f"{k}_" for k in keys)).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    carried = total.withColumns({f"{n}_": F.coalesce(F.sum(f"{n}_").over(outer), F.lit(0)) for n in sums})
    out = rows.withColumns({n: F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in sums.items()})
    same = out["block_"] == carried["b_"]
    for k in keys:
        same &= out[k].eqNullSafe(carried[f"{k}_"])
    out = out.join(carried, same)
    return out.withColumns({n: F.col(n) + F.col(f"{n}_") for n in sums}).drop("block_", "b_", *(f"{n}_" for n in sums), *(f"{k}_" for k in keys))


def last_rows(numbered_rows: DataFrame, keys: list[str], number: str, most: int, block: int = BLOCK, **made) -> DataFrame:
    """Numbered rows with values over the last `most` rows of their key, the row included; made: functions of the window."""
    n = F.col(number)
    block = max(block, most)
    own = F.floor((n - 1) / block)
    next_too = F.when((n - 1) % block >= block - (most - 1), own + 1)
    rows = numbered_rows.withColumn("block_", F.explode(F.array_compact(F.array(own, next_too))))
    window = Window.partitionBy(*keys, "block_").orderBy(number).rowsBetween(1 - most, 0)
    return rows.withColumns({name: f(window) for name, f in made.items()}).where(F.col("block_") == own).drop("block_")


def before_it(numbered_rows: DataFrame, keys: list[str], number: str, block: int = BLOCK, **columns: str) -> DataFrame:
    """Numbered rows with columns of the row before each, null for the first."""
    return last_rows(numbered_rows, keys, number, 2, block, **{n: (lambda c: lambda w: F.when(F.count(F.lit(1)).over(w) == 2, F.first(c).over(w)))(c) for n, c in columns.items()})
