"""Joins between files, works, benchmark records and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables up to this many rows may be broadcast.
SMALL = 200_000


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it is known to have few rows."""
    return F.broadcast(df) if rows <= SMALL else df


def last_by(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of rows equal in ``by`` the last one; a partial aggregation, so no group is gathered."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*by, "_r.*")


def align(predictions: DataFrame, bench: DataFrame, order: str = "rec_no") -> DataFrame:
    """Predictions with their benchmark record: every prediction is kept as often as it occurs, of records under one id the last counts, rows without a partner are dropped."""
    gold = last_by(bench, ["id"], order)
    return predictions.join(gold, "id")


def prefixes(stem: str = "stem"):
    """All parts of ``stem`` that end before a ``_``, and the stem itself."""
    parts = F.split(F.col(stem), "_", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "_"))


def resolve_works(files: DataFrame, works: DataFrame, stem: str = "stem", key: str = "work_key") -> DataFrame:
    """Files with the key and part of their work.

    ``work_key``: the key equal to the stem, else the longest one that is followed by ``_`` in the
    stem, else null.  ``part``: what follows the longest such key, looked for independently of an
    equal one; null if nothing follows.  Each stem is exploded to its prefixes for an equi-join, so
    no pair of a file and a key is compared that doesn't match.
    """
    keys = works.select(F.col(key).alias("_k")).distinct()
    hits = (
        files.select(stem).distinct()
        .select(stem, F.explode(prefixes(stem)).alias("_k"))
        .join(keys, "_k")
        .groupBy(stem)
        .agg(F.max_by("_k", F.length("_k")).alias(key), F.max_by(F.when(F.col("_k") != F.col(stem), F.col("_k")), F.when(F.col("_k") != F.col(stem), F.length("_k"))).alias("_p"))
    )
    part = F.expr(f"nullif(substr({stem}, length(_p) + 2), '')")
    return files.join(hits, stem, "left").withColumn("part", part).drop("_p")


def existing(manifest: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Manifest rows whose file exists, with the file's columns."""
    return manifest.join(files, path)


def labelled(clips: DataFrame, labels: DataFrame, stem: str = "stem") -> DataFrame:
    """Clips with a non-empty label; the rest is dropped."""
    return clips.join(labels.where("label is not null and label <> ''"), stem)


def other_values(df: DataFrame, pool: DataFrame, gold: str, value: str = "value") -> DataFrame:
    """Rows beside the array of all pool values other than their own.

    The pool is one row beside every row of ``df``, which should be those drawn, not all; it is
    broadcast if it has at most ``SMALL`` values.
    """
    n = pool.count()
    one = pool.agg(F.array_sort(F.collect_set(value)).alias("pool"))
    return df.crossJoin(if_small(one, n)).withColumn("pool", F.filter("pool", lambda v: v != F.col(gold)))


def with_split(works: DataFrame, splits: DataFrame, key: str = "work") -> DataFrame:
    return works.join(splits, key)


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """``(value, first)``: distinct non-empty values with where they first occur."""
    return df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(F.col(value).alias("value")).agg(F.min(order).alias("first"))


