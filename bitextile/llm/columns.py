"""Helpers for tables: names that no column has, and joins in which no key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with at least one in COMMON of the rows are met by a broadcast; there are COMMON of them at most.
COMMON = 10_000


def fresh(name: str, columns: list[str]) -> str:
    """name, or name with a number, so that no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    out, k = name, 0
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def whole_text(docs: DataFrame, keep: list[str]) -> tuple[str, DataFrame]:
    """The columns keep of docs and the texts as strings: in a column of their own unless text is kept and a string."""
    if "text" in keep and docs.schema["text"].dataType.simpleString() == "string":
        return "text", docs.select(*keep)
    name = fresh("text", keep)
    return name, docs.select(*keep, F.col("text").cast("string").alias(name))


def join_counted(rows: DataFrame, found: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with found (one row a key), without the column count: how many of all `total` rows have the key.

    Keys that at least one in COMMON rows have are broadcast; all others meet in a shuffle, where no key is hot.
    """
    hot = found.where(F.col(count) * COMMON >= total)
    cold = found.where(F.col(count) * COMMON < total).drop(count)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot.drop(count)), key).unionByName(rest.join(cold, key))
