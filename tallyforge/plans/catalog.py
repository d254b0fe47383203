"""Where the modules of queries put them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Columns are made inside the queries: the modules are imported without a session.


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = V.oracle(sql)
        return f

    return add


def projection(name: str, view, sql: str, columns) -> None:
    query(name, sql)(lambda s, d: view(s, d).select(*columns()))


def sql_list(values) -> str:
    """Values as an SQL list of texts."""
    return "[" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def cases(name: str, view, of: str, key: str, pairs: list[tuple], **made) -> None:
    """A rule on hard inputs: row by row of a table the next of `pairs`' inputs (texts), and what the rule has to give (texts, or null).

    pairs: input, then the expected text of each column of `made`, which maps names to functions of the input column.
    """

    def run(s, d):
        given = F.element_at(F.array(*(F.lit(p[0]).cast("string") for p in pairs)), (F.col(key) % len(pairs) + 1).cast("int"))
        rows = view(s, d).select(key, given.alias("given"))
        return rows.select(key, *(f(F.col("given")).cast("string").alias(n) for n, f in made.items()))

    columns = ", ".join(f"{sql_list([p[i + 1] for p in pairs])}[{key} % {len(pairs)} + 1] AS {n}" for i, n in enumerate(made))
    query(name, f"SELECT {key}, {columns} FROM {of}")(run)
