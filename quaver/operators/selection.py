"""Seeded selections over a corpus: splits by work, prompt draws, category fill, limits per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.functions.sampling import key, number_of, order_of
from quaver.functions.text import work_id
from quaver.operators.errors import CATEGORIES


def split_by_work(scores: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 1234, work: Column | None = None) -> DataFrame:
    """Scores with ``work`` and ``split``; all parts of a work fall into one split.

    Works are ordered by the seeded hash of their id; the first ``round(train n)`` are for training,
    the next ``round(val n)`` for validation (halves to the even neighbour).  The rank is the only
    global order, and is taken over distinct works in range partitions.
    """
    if train <= 0 or val < 0 or train + val >= 1:
        raise ValueError(f"invalid ratios: train={train}, val={val}")
    named = scores.withColumn("work", work_id(F.col("source_id")) if work is None else work)
    works = named.select("work").distinct().withColumn("o", order_of(key(seed, F.col("work"))))
    n = works.count()
    ranked = number_rows(works, "o", "work")
    a, b = round(train * n), round(val * n)
    split = F.when(F.col("i") < a, "train").when(F.col("i") < a + b, "val").otherwise("test")
    return named.join(ranked.select("work", split.alias("split")), "work")


def number_rows(df: DataFrame, *order: str) -> DataFrame:
    """Rows numbered from 0 in column ``i`` by ``order``, without gathering them into one task.

    Rows fall into buckets by the leading four hex digits of the first ordering column; numbers are
    the row's rank in its bucket plus the rows of the buckets before.  The first ordering column must be a hex string such as md5 gives.
    """
    bucketed = df.withColumn("_b", F.substring(order[0], 1, 4))
    sizes = bucketed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).drop("_n")  # 65536 rows at most
    w = Window.partitionBy("_b").orderBy(*order)
    return bucketed.withColumn("_r", F.row_number().over(w)).join(F.broadcast(before), "_b").withColumn("i", F.col("_r") - 1 + F.col("_before")).drop("_b", "_r", "_before")


def prompt_draw(corpus: DataFrame, n: int, seed: int, order: str = "pos") -> DataFrame:
    """``n`` draws with replacement: the drawn rows with ``i`` from 0 to n - 1; an empty corpus raises."""
    total = corpus.count()
    if not total:
        raise ValueError("corpus is empty; nothing to draw prompts from")
    numbered = number_rows(corpus.withColumn("_o", order_of(key(seed, "row", F.col(order)))), "_o", order).withColumnRenamed("i", "_row").drop("_o")
    draws = corpus.sparkSession.range(n).select(F.col("id").alias("i"), (number_of(key(seed, F.col("id"))) % total).alias("_row"))
    return numbered.join(F.broadcast(draws) if n <= 200_000 else draws, "_row").drop("_row")


def fill_categories(pool: DataFrame, n: int, order: str = "rn") -> DataFrame:
    """Rows of ``pool`` that get an error, with ``category`` and ``category_no``.

    ``pool`` has ``rn`` (1, 2, ...) and ``ok_<category>`` flags.  Categories are filled one after the
    other from a shared cursor: each row is tried once, in order; a category stops at ``n // 5``
    rows, after eight times as many trials, or at the end of the pool.  Only the rows that can be
    tried at all, a number that depends on ``n`` alone, are brought together, and folded in one pass.
    """
    per, k = max(1, n // len(CATEGORIES)), len(CATEGORIES)
    flags = F.array(*[F.coalesce(F.col(f"ok_{c}"), F.lit(False)) for c in CATEGORIES])
    tried = pool.where(F.col(order) <= 8 * per * k).select(F.col(order).cast("bigint").alias("rn"), flags.alias("ok"))
    rows = tried.agg(F.array_sort(F.collect_list(F.struct("rn", "ok"))).alias("rows"))
    start = F.struct(
        F.lit(0).alias("no"), F.lit(0).alias("got"), F.lit(0).alias("tries"), F.array().cast("array<struct<rn:bigint,category_no:int>>").alias("out")
    )

    def step(a: Column, row: Column) -> Column:
        hit = (a["no"] < k) & F.coalesce(F.get(row["ok"], a["no"]), F.lit(False))
        got, tries = a["got"] + hit.cast("int"), a["tries"] + 1
        full = (got >= per) | (tries >= 8 * per)
        out = F.when(hit, F.concat(a["out"], F.array(F.struct(row["rn"].alias("rn"), a["no"].alias("category_no"))))).otherwise(a["out"])
        return F.struct(
            F.when(full, a["no"] + 1).otherwise(a["no"]).alias("no"), F.when(full, F.lit(0)).otherwise(got).alias("got"),
            F.when(full, F.lit(0)).otherwise(tries).alias("tries"), out.alias("out"),
        )

    filled = rows.select(F.explode(F.aggregate("rows", start, step)["out"]).alias("f"))
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    return filled.select(F.col("f.rn").cast("int").alias(order), F.get(names, F.col("f.category_no")).alias("category"), F.col("f.category_no").alias("category_no"))


def limit_per_task(bench: DataFrame, limit: int | None, order: str = "rec_no") -> DataFrame:
    """The first ``limit`` records of each task; none or 0 keeps all.  Pruned per task before the shuffle."""
    if not limit:
        return bench
    return bench.withColumn("_r", F.row_number().over(Window.partitionBy("task").orderBy(order))).where(F.col("_r") <= limit).drop("_r")


def rotated_field(i: Column) -> Column:
    """``struct(field, value)``: key, meter and note length in turn by ``i``, or the first that has a value."""
    fields = ("key", "meter", "note_length")
    whole = [F.when(F.coalesce(F.col(f), F.lit("")) != "", F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))) for f in fields]
    turn = F.coalesce(*[F.when(i % 3 == k, whole[k]) for k in range(3)])
    return F.coalesce(turn, *whole)
