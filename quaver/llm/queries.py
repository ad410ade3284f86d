"""The ``pN_`` queries over the test tables, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.llm import canon, leakage, neardup, overlap, packing, sample, skeleton, splits


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Scores that are not the first of their group of related scores."""
    done = splits.assign_splits(_t(spark, d, "scores"), _t(spark, d, "split_plan"))
    return done.where("pos <> group_pos").select("group_pos", "pos")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every score's split."""
    return splits.assign_splits(_t(spark, d, "scores"), _t(spark, d, "split_plan"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows, groups and share of each split beside its target, and how far its labels are from those of all."""
    scores, plan = _t(spark, d, "scores"), _t(spark, d, "split_plan")
    return splits.split_report(splits.assign_splits(scores, plan), plan, splits.labels_of(scores))


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    scores, files, bench = (_t(spark, d, n) for n in ("scores", "split_files", "bench"))
    return overlap.overlaps(overlap.evaluation_records(scores, bench), overlap.evaluation_sides(files, bench))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a training score and an evaluation record that overlap, smaller key first."""
    return _overlaps(spark, d).select(F.least("training_key", "key").alias("key_a"), F.greatest("training_key", "key").alias("key_b"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping evaluation records per split and corpus."""
    return overlap.overlap_report(_overlaps(spark, d), _t(spark, d, "split_files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The term meant by each typed value that is not a term as written, 0 if it means none."""
    return canon.mapped(_t(spark, d, "scores"), _t(spark, d, "term_list")).select("pos", "field_name", "item_no", "term_id")


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that mean no term, with the number of times they were typed."""
    done = canon.mapped(_t(spark, d, "scores"), _t(spark, d, "term_list"))
    return done.where("term_id = 0").groupBy("field_name", "value").agg(F.count("*").alias("n"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Scores that are not the first of their group of near-duplicates."""
    return neardup.near_duplicates(_t(spark, d, "scores")).where("pos <> group_pos").select("group_pos", "pos")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every score with music, its class of equal music and its group."""
    return neardup.near_duplicates(_t(spark, d, "scores"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that cannot be met."""
    return sample.report(_t(spark, d, "scores"), _t(spark, d, "sample_targets"), _t(spark, d, "term_list")).where("not met").select("target_id")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Every target with what there is, what is drawn and whether it can be met."""
    return sample.report(_t(spark, d, "scores"), _t(spark, d, "sample_targets"), _t(spark, d, "term_list"))


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sample of each dimension."""
    return sample.draw(_t(spark, d, "scores"), _t(spark, d, "sample_targets"), _t(spark, d, "term_list"))


def _capacity(spark: SparkSession, d: str) -> int:
    return int(_t(spark, d, "containers").agg(F.min("capacity_tokens")).first()[0])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents too long for one container: those packed in more than one piece."""
    packed = packing.pack(_t(spark, d, "documents"), _capacity(spark, d))
    return packed.where("piece > 0").select("doc_id").distinct()


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """Each text's container or containers."""
    return packing.pack(_t(spark, d, "documents"), _capacity(spark, d))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, and the share of their room that is filled."""
    capacity = _capacity(spark, d)
    return packing.packing_report(packing.pack(_t(spark, d, "documents"), capacity), capacity)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an evaluation text, with the item."""
    return leakage.leaks(_t(spark, d, "documents"), _t(spark, d, "heldout_items")).select("item_id", "doc_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked item, in how many documents it stands and how much of it at most."""
    found = leakage.leaks(_t(spark, d, "documents"), _t(spark, d, "heldout_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("share").alias("most"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same but are not stored the same."""
    return skeleton.look_alikes(_t(spark, d, "documents"))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every text."""
    return skeleton.forms(_t(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_splits, p1_report, p2_found, p2_report, p3_found, p3_unmatched, p4_found, p4_groups, p5_found,
        p5_report, p5_sample, p6_found, p6_packed, p6_report, p7_found, p7_items, p8_found, p8_forms,
    )
}

#: DuckDB statements for those queries that SQL can express.
ORACLE: dict[str, str] = {}
