"""Connected components by alternating large-star and small-star steps.

Every step is a partial aggregation and an equi-join.  The least neighbour of a node is found before
the shuffle; the edges of a node with very many are joined to it in several tasks by Spark's own
splitting of skewed join partitions, as the distinct that follows shuffles anyway.  Each round is
written to the shared folder; the previous round's table is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.scratch import Cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(least, "u")
        .where("v > u and v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return (
        edges.join(least, "u")
        .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .where("u <> v")
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a bigint, b bigint)`` to ``(node, root)``: root is the least node of the component.

    Nodes that are their own root have no row.  Self-loops, repeated and null edges are ignored; an
    empty input gives an empty result.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    now, seen = Cut(e, "edges"), None
    while True:  # every round shortens all paths, so it settles after about log n of them
        following = Cut(_small_star(_large_star(now.df)), "edges")
        now.drop()
        now = following
        state = tuple(now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
