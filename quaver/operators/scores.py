"""Aggregates that turn aligned predictions into scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.functions.numeric import abs_diff, sequencing_score, set_f1
from quaver.functions.text import bar_list
from quaver.sources.scratch import scratch

QUADRANTS = ("Q1", "Q2", "Q3", "Q4")
#: Values in one list of a group.
LIST_ROWS = 1000


def accuracy(pred: Column, gold: Column) -> Column:
    """Share of rows with ``pred`` equal to ``gold`` as text; 0 of no rows."""
    p, g = (F.coalesce(c.cast("string"), F.lit("None")) for c in (pred, gold))
    return F.coalesce(F.avg((p == g).cast("double")), F.lit(0.0))


def parsed_choices(answer: Column) -> Column:
    return F.count_if(answer.isin("0", "1", "2", "3"))


def parsed_numbers(answer: Column) -> Column:
    return F.count_if(answer.rlike(r"(?U)\A\d+\z"))


def bar_count_stats(df: DataFrame, pred: str, gold: str, *by: str) -> DataFrame:
    """Tolerance rates, mean and upper median of the absolute errors of those pairs that are numbers.

    The median is found by rank over the histogram of errors, so no group of rows is collected.
    """
    d = df.withColumn("d", abs_diff(F.col(pred), F.col(gold)))
    rate = lambda k: F.coalesce(F.avg(F.when(F.col("d").isNotNull(), (F.col("d") <= k).cast("double"))), F.lit(0.0)).alias(f"within_{k}")
    base = d.groupBy(*by).agg(
        F.count("*").alias("n"), rate(1), rate(5), rate(10), F.avg(F.col("d").cast("double")).alias("mean_abs_err"), F.count("d").alias("n_parsed")
    )
    hist = d.where("d is not null").groupBy(*by, "d").agg(F.count("*").alias("k"))
    over = f"(partition by {', '.join(by)} order by d)" if by else "(order by d)"
    whole = f"(partition by {', '.join(by)})" if by else "()"
    median = (
        hist.selectExpr(*by, "d", "k", f"sum(k) over {over} as upto", f"sum(k) over {whole} as n")
        .where("upto > n div 2 and upto - k <= n div 2")
        .select(*by, F.col("d").cast("double").alias("median_abs_err"))
    )
    return base.join(median, list(by), "left") if by else base.crossJoin(F.broadcast(median)) if not by and median.limit(1).count() else base.withColumn("median_abs_err", F.lit(None).cast("double"))


def sequencing(df: DataFrame, pred: str, gold: str, *by: str) -> DataFrame:
    s = df.withColumn("s", sequencing_score(F.col(pred), F.col(gold)))
    return s.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.avg("s"), F.lit(0.0)).alias("score"), F.count_if(F.col("s") > 0).alias("n_valid"))


def error_f1(df: DataFrame, answer: str, raw: str, gold_bars: str, category: str) -> DataFrame:
    """Rows with ``f1`` of the bars named in the answer (or, if it is empty, in the raw output) and ``category``, ``unknown`` if missing."""
    said = F.when(F.coalesce(F.col(answer), F.lit("")) != "", F.col(answer)).otherwise(F.col(raw))
    gold = F.transform(F.coalesce(F.col(gold_bars), F.array().cast("array<int>")), lambda b: b.cast("string"))
    return df.withColumn("f1", set_f1(bar_list(said), gold)).withColumn("category", F.coalesce(F.col(category), F.lit("unknown")))


def macro_f1(rated: DataFrame, *by: str) -> DataFrame:
    """Mean over records, and the unweighted mean of the categories' means."""
    per = rated.groupBy(*by, "category").agg(F.avg("f1").alias("m"), F.count("*").alias("k"))
    return per.groupBy(*by).agg(
        F.sum("k").alias("n"), F.coalesce(F.sum(F.col("m") * F.col("k")) / F.sum("k"), F.lit(0.0)).alias("mean_f1"), F.coalesce(F.avg("m"), F.lit(0.0)).alias("macro_f1")
    )


def confusion(df: DataFrame, pred: Column, gold: Column, *by: str) -> DataFrame:
    """Counts of predicted labels (``Q1`` to ``Q4``, ``off_grid``) for each gold label, zeros included; rows whose gold label is none are left out."""
    on = lambda c: F.when(c.isin(*QUADRANTS), c)
    got = df.select(*by, on(gold).alias("gold"), F.coalesce(on(pred), F.lit("off_grid")).alias("p")).where("gold is not null")
    counts = got.groupBy(*by, "gold").agg(*[F.count_if(F.col("p") == q).alias(q) for q in (*QUADRANTS, "off_grid")])
    grid = df.select(*by).distinct().crossJoin(df.sparkSession.createDataFrame([(q,) for q in QUADRANTS], "gold string")) if by else df.sparkSession.createDataFrame([(q,) for q in QUADRANTS], "gold string")
    return grid.join(counts, [*by, "gold"], "left").na.fill(0)


def overall(per_task: DataFrame, *by: str) -> DataFrame:
    """Macro and record-weighted mean of the tasks' main scores.

    ``per_task`` has ``accuracy``, ``score`` and ``macro_f1`` (the first that is not null counts),
    ``n`` and ``missing``; missing tasks don't count, tasks without records count 0 in the macro mean.
    """
    s = F.coalesce("accuracy", "score", "macro_f1", F.lit(0.0))
    return (
        per_task.where("not missing").withColumn("s", s).groupBy(*by)
        .agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("macro_avg"), F.coalesce(F.try_divide(F.sum(F.col("s") * F.col("n")), F.sum("n")), F.lit(0.0)).alias("weighted_avg"))
    )


def compile_rate(df: DataFrame, ok: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.coalesce(F.avg(F.col(ok).cast("double")), F.lit(0.0)).alias("compile_rate"), F.count_if(ok).alias("n_ok"), F.count("*").alias("n"))


def split_stats(df: DataFrame, split: str, work: str, composer: str) -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("files"), F.countDistinct(work).alias("works"), F.countDistinct(F.expr(f"nullif({composer}, '')")).alias("composers"))


def group_lists(df: DataFrame, by: str, value: str, size: int = LIST_ROWS) -> DataFrame:
    """``(by, chunk, values)``: values of each key in sorted lists of ``size``, chunks from 0 on; a null key reads ``None``.

    Rows are ranked within ranges of key and value, so no group is brought together, however large.
    The ranges are written before they are counted, so that a row can't change its range when a task
    is run again.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "groups")
    keyed = df.select(F.coalesce(F.col(by).cast("string"), F.lit("None")).alias(by), F.col(value).alias("_v"))
    keyed.repartitionByRange(F.col(by), F.col("_v")).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    before = ranged.groupBy(by, "_range").agg(F.count("*").alias("_n"))  # a row a range and group
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy(by).orderBy("_range")) - F.col("_n"))
    rank = F.row_number().over(Window.partitionBy(by, "_range").orderBy("_v")) - 1
    ranked = ranged.withColumn("_r", rank).join(before, [by, "_range"]).withColumn("chunk", F.floor((F.col("_r") + F.col("_before")) / size).cast("bigint"))
    return ranked.groupBy(by, "chunk").agg(F.array_sort(F.collect_list("_v")).alias("values"))


def top_counts(df: DataFrame, value: str, k: int = 5) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)
