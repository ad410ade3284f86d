"""Descriptors of note tables: polyphony rate, groove consistency, scale consistency.

``notes(file, onset bigint, duration bigint, pitch int)``, times in ticks; ``measure`` is a number of ticks or, where files differ, a column of notes.  Definitions follow the
published descriptions of these measures; a file without notes has nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The steps of the major and the natural minor scale.
MAJOR, MINOR = (0, 2, 4, 5, 7, 9, 11), (0, 2, 3, 5, 7, 8, 10)


def polyphony_rate(notes: DataFrame) -> DataFrame:
    """Share of sounding ticks with two or more different pitches; found from note starts and ends, so no tick is materialised."""
    edges = notes.where("duration > 0").select("file", "pitch", F.explode(F.array(F.struct(F.col("onset").alias("t"), F.lit(1).alias("d")), F.struct((F.col("onset") + F.col("duration")).alias("t"), F.lit(-1).alias("d")))).alias("e")).select("file", "pitch", "e.t", "e.d")
    # per pitch: from when to when it sounds, however many notes overlap
    w = Window.partitionBy("file", "pitch").orderBy("t")
    steps = edges.groupBy("file", "pitch", "t").agg(F.sum("d").alias("d")).withColumn("on", F.sum("d").over(w))
    flips = steps.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(0))).where("(on > 0) <> (was > 0)").select("file", "t", F.when(F.col("on") > 0, 1).otherwise(-1).alias("d"))
    v = Window.partitionBy("file").orderBy("t")
    spans = flips.groupBy("file", "t").agg(F.sum("d").alias("d")).withColumn("pitches", F.sum("d").over(v)).withColumn("len", F.lead("t").over(v) - F.col("t"))
    return spans.groupBy("file").agg(F.try_divide(F.sum(F.when(F.col("pitches") >= 2, F.col("len"))), F.sum(F.when(F.col("pitches") >= 1, F.col("len")))).alias("_p")).select("file", F.coalesce("_p", F.lit(0.0)).alias("polyphony_rate"))


def groove_consistency(notes: DataFrame, measure: int | str) -> DataFrame:
    """1 less the mean share of ticks at which the onsets of neighbouring measures of ``measure`` ticks differ; null for a single measure."""
    notes = notes.withColumn("_measure", F.col(measure) if isinstance(measure, str) else F.lit(measure))
    measure = F.col("_measure")
    hits = notes.select("file", F.floor(F.col("onset") / measure).alias("m"), (F.col("onset") % measure).alias("at")).distinct()
    size = hits.groupBy("file", "m").agg(F.count("*").alias("n"))
    both = hits.join(hits.select("file", (F.col("m") - 1).alias("m"), "at"), ["file", "m", "at"]).groupBy("file", "m").agg(F.count("*").alias("k"))
    last = notes.groupBy("file").agg(F.floor(F.max("onset") / F.max(measure)).alias("last"), F.max(measure).alias("_measure"))
    # the sum of |A xor B| over neighbours is sum(n) + sum(n of the next) - 2 sum(common)
    total = size.join(last, "file").groupBy("file", "last", "_measure").agg((F.sum(F.when(F.col("m") < F.col("last"), F.col("n")).otherwise(0)) + F.sum(F.when(F.col("m") > 0, F.col("n")).otherwise(0))).alias("n"))
    common = both.groupBy("file").agg(F.sum("k").alias("k"))
    differ = F.col("n") - 2 * F.coalesce("k", F.lit(0))
    return total.join(common, "file", "left").select("file", F.when(F.col("last") > 0, 1 - differ / (F.col("last") * measure)).alias("groove_consistency"))


def scale_consistency(notes: DataFrame) -> DataFrame:
    """Largest share of notes in any of the 24 major and minor scales."""
    sizes = [F.count_if((F.col("pitch") % 12).isin([(s + root) % 12 for s in steps])) for root in range(12) for steps in (MAJOR, MINOR)]
    return notes.groupBy("file").agg(F.try_divide(F.greatest(*sizes), F.count("*")).alias("scale_consistency"))


def descriptors(notes: DataFrame, measure: int | str) -> DataFrame:
    """All three for every file."""
    return notes.select("file").distinct().join(polyphony_rate(notes), "file", "left").join(groove_consistency(notes, measure), "file", "left").join(scale_consistency(notes), "file", "left")


