"""Scores and statistics as Column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.functions.text import digit_sequence


def sequencing_score(pred: Column, gold: Column) -> Column:
    """Kendall's tau of two permutations as digit strings, scaled to 0..1; 0 if ``pred`` is no permutation of the length of ``gold``."""
    digits = F.filter(F.split(digit_sequence(F.coalesce(pred, F.lit(""))), ""), lambda d: d != "")
    p = F.transform(digits, lambda d: d.try_cast("int"))
    g = F.transform(F.filter(F.split(gold, ""), lambda d: d != ""), lambda d: d.try_cast("int"))
    n = F.length(gold)
    valid = (F.size(p) == n) & (F.size(F.array_distinct(p)) == n) & F.forall(p, lambda d: d.isNotNull() & (d < n))
    pairs = F.zip_with(g, p, lambda a, b: F.struct(a.alias("g"), b.alias("p")))
    sign = F.aggregate(
        pairs, F.lit(0),
        lambda acc, x: acc + F.aggregate(pairs, F.lit(0), lambda a, y: a + (F.signum(x["g"] - y["g"]) * F.signum(x["p"] - y["p"])).cast("int")),
    )
    tau = sign.cast("double") / (n * (n - 1)).cast("double")
    return (
        F.when(~valid | (n == 0), F.lit(0.0))
        .when(n == 1, (F.element_at(p, 1) == F.element_at(g, 1)).cast("double"))
        .otherwise((tau + 1.0) / 2.0)
    )


def set_f1(pred: Column, gold: Column) -> Column:
    """F1 of two sets given as arrays; two empty sets agree."""
    p, g = F.array_distinct(pred), F.array_distinct(gold)
    return F.when((F.size(p) == 0) & (F.size(g) == 0), F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(p, g)) / (F.size(p) + F.size(g)))


def whole(c: Column) -> Column:
    """The whole number a text is, else null."""
    return F.when(c.rlike(r"(?U)\A\s*[+-]?\d+\s*\z"), F.regexp_replace(c, r"(?U)\s", "").try_cast("decimal(38,0)"))


def abs_diff(a: Column, b: Column) -> Column:
    return F.abs(whole(a) - whole(b))


def share_of(n: int, k: int) -> int:
    return max(1, n // k)


def js_divergence(stats: DataFrame, points: int = 2000) -> DataFrame:
    """``(metric, js)`` of two Gaussians per metric: ``stats(metric, mu1, sd1, mu2, sd2)``, on a grid over five deviations around both."""
    grid = stats.withColumns({
        "lo": F.least(F.col("mu1") - 5 * F.col("sd1"), F.col("mu2") - 5 * F.col("sd2")),
        "hi": F.greatest(F.col("mu1") + 5 * F.col("sd1"), F.col("mu2") + 5 * F.col("sd2")),
    })
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    x = F.col("lo") + F.col("k") * F.col("dx")

    def density(mu: str, sd: str) -> Column:
        z = (F.col("x") - F.col(mu)) / F.col(sd)
        return F.exp(-0.5 * z * z) / (F.col(sd) * F.sqrt(2 * F.pi()))

    def kl(a: str) -> Column:
        m = (F.col("p") + F.col("q")) / 2
        return F.when((F.col(a) > 0) & (m > 0), F.col(a) * F.ln(F.col(a) / m)).otherwise(0.0)

    return (
        grid.withColumn("dx", step)
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", x)
        .withColumn("p", density("mu1", "sd1"))
        .withColumn("q", density("mu2", "sd2"))
        .groupBy("metric")
        .agg((F.sum(kl("p") + kl("q")) * 0.5 * F.first("dx")).alias("js"))
    )


def js_similarity(model: DataFrame, reference: DataFrame) -> DataFrame:
    """One row ``js_similarity``: 100 exp(-2 mean JS) over the metrics of two aggregates ``(metric, mean, std, n)``; null if any mean or deviation is missing or not positive."""
    both = model.select("metric", F.col("mean").alias("mu1"), F.col("std").alias("sd1")).join(
        reference.select("metric", F.col("mean").alias("mu2"), F.col("std").alias("sd2")), "metric", "full"
    )
    fit = F.col("mu1").isNotNull() & F.col("mu2").isNotNull() & (F.col("sd1") > 0) & (F.col("sd2") > 0)
    js = js_divergence(both.where(fit))
    return (
        both.select("metric", F.coalesce(fit, F.lit(False)).alias("fit")).join(js, "metric", "left")
        .agg(F.when(F.count_if(~F.col("fit")) == 0, 100 * F.exp(-2 * F.avg("js"))).alias("js_similarity"))
    )


def descriptor_stats(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """``(metric, mean, std, n)`` over the non-null, non-NaN values of each metric column; the deviation is the sample's."""
    long = rows.select(*[F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double")).alias(m) for m in metrics]).unpivot([], metrics, "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n"))


def moments(df: DataFrame, vector: str, *by: str) -> DataFrame:
    """``(by..., n, mean array, cov array)``: mean and sample covariance (row by row) of a vector column.

    Each Arrow batch is reduced to sums of outer products about a common shift before anything is
    shuffled, so a set of any size is reduced by partial sums of one d x d block each.  Null and
    empty vectors don't count; vectors of more than one length raise.
    """
    import pandas as pd

    size = F.when(F.size(vector) > 0, F.size(vector))
    least, most = df.agg(F.min(size), F.max(size)).first()
    if least != most:
        raise ValueError(f"vectors of one length are needed, got lengths from {least} to {most}")
    d = most or 0
    names = list(by)

    def part(batches):
        for pdf in batches:
            pdf = pdf[[v is not None and len(v) == d for v in pdf["v"]]]
            for k, g in pdf.groupby(names, dropna=False) if names else [((), pdf)]:
                if not len(g):
                    continue
                x = np.stack(g["v"].to_numpy()).astype(float)
                yield pd.DataFrame([{**dict(zip(names, k if isinstance(k, tuple) else (k,), strict=True)), "n": len(x), "s": x.sum(0), "q": (x.T @ x).ravel()}])

    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{b}` {fields[b]}" for b in names), "n long, s array<double>, q array<double>"])
    parts = df.select(*names, F.col(vector).alias("v")).where(F.col("v").isNotNull()).mapInPandas(part, schema)
    # element by element: the sums combine before the shuffle, whatever the number of batches
    cells = parts.select(*names, F.posexplode(F.concat(F.array(F.col("n").cast("double")), "s", "q")).alias("k", "v")).groupBy(*names, "k").agg(F.sum("v").alias("v"))
    flat = cells.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda c: c["v"]).alias("a"))
    n = F.element_at("a", 1)
    s, q = F.slice("a", 2, max(d, 1)), F.slice("a", 2 + d, max(d * d, 1))
    return flat.select(*names, n.cast("bigint").alias("n"), s.alias("s"), q.alias("q")).select(
        *names, "n", F.transform("s", lambda v: v / F.col("n")).alias("mean"),
        F.transform(F.col("q"), lambda v, i: F.try_divide(v - F.get("s", F.floor(i / F.lit(max(d, 1))).cast("int")) * F.get("s", i % max(d, 1)) / F.col("n"), F.col("n") - 1)).alias("cov"),
    )


def frechet_distance(mean_x: np.ndarray, cov_x: np.ndarray, mean_y: np.ndarray, cov_y: np.ndarray) -> float:
    """Fréchet distance of two Gaussians; never below 0."""
    values, vectors = np.linalg.eigh(cov_x)
    root = vectors * np.sqrt(np.clip(values, 0, None)) @ vectors.T
    cross = np.sqrt(np.clip(np.linalg.eigvalsh(root @ cov_y @ root), 0, None)).sum()
    gap = mean_x - mean_y
    return max(0.0, float(gap @ gap + np.trace(cov_x) + np.trace(cov_y) - 2 * cross))


def frechet(x: DataFrame, y: DataFrame, vector: str = "embedding") -> float:
    """Fréchet distance of two sets of vectors; each needs at least two.  Only two rows of moments reach the driver."""
    found = []
    for df in (x, y):
        m = moments(df, vector).first()
        if m is None or m["n"] < 2:
            raise ValueError(f"need at least 2 vectors in each set, got {m['n'] if m else 0}")
        d = len(m["mean"])
        found.append((np.array(m["mean"]), np.array(m["cov"]).reshape(d, d)))
    return frechet_distance(*found[0], *found[1])
