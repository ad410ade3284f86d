"""Seeded choices without state: every draw is a function of a key, so it is parallel and repeatable.

The order of a draw is that of md5 of the key; a number of a draw is its first 32 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key(seed: int, *parts: Column | str) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def order_of(k: Column) -> Column:
    return F.md5(k.cast("binary"))


def number_of(k: Column) -> Column:
    """A whole number from 0 to 2**32 - 1."""
    return F.conv(F.substring(order_of(k), 1, 8), 16, 10).cast("bigint")


def pick_one(items: Column, k: Column) -> Column:
    """An item of a non-empty array, each alike."""
    return F.element_at(items, (number_of(k) % F.size(items) + 1).cast("int"))


def shuffled(items: Column, k: Column) -> Column:
    """The items in a random order; equal items stay beside each other."""
    return F.transform(F.array_sort(F.transform(items, lambda v: F.struct(order_of(F.concat_ws(":", k, v)).alias("o"), v.alias("v")))), lambda x: x["v"])


def distractors(pool: Column, gold: Column, k: Column, n: int = 3) -> Column:
    """``n`` different items of ``pool`` other than ``gold``; fewer if there are no more."""
    return F.slice(shuffled(F.array_distinct(F.filter(pool, lambda v: v != gold)), k), 1, n)


def permutation(n: int, k: Column) -> Column:
    """The numbers 0 to n - 1 in a random order."""
    idx = F.array(*[F.lit(i) for i in range(n)])
    return F.transform(shuffled(F.transform(idx, lambda i: i.cast("string")), k), lambda s: s.cast("int"))


def sample(df: DataFrame, n: int, k: Column, *ties: str) -> DataFrame:
    """``n`` rows without replacement, numbered from 0 in column ``i``.

    The limit is taken from the sorted input, so each task passes on at most ``n`` rows; only those
    are numbered.
    """
    top = df.withColumn("_o", order_of(k)).orderBy("_o", *ties).limit(n)
    return top.withColumn("i", F.row_number().over(Window.orderBy("_o", *ties)) - 1).drop("_o")


def per_group(df: DataFrame, group: str, n: int, k: Column, *ties: str) -> DataFrame:
    """``n`` rows of each group, numbered from 1 in column ``r``; pruned per task before the shuffle."""
    w = Window.partitionBy(group).orderBy("_o", *ties)
    return df.withColumn("_o", order_of(k)).withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("_o")
