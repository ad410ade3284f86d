"""Scores of predictions while they arrive: a file stream of JSON lines against a static benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quaver.operators.joins import last_by
from quaver.operators.scores import accuracy
from quaver.sources.files import PREDICTION


def predictions_stream(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of all models and tasks below ``path`` as they are written, with when they finished."""
    return spark.readStream.schema(f"{PREDICTION}, model string, task string, finished_at timestamp").json(path)


def aligned_stream(stream: DataFrame, bench: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stream-static join on the record's id; a prediction delivered twice counts once within ``late``."""
    gold = last_by(bench.select("id", "gold", "gold_index", "rec_no"), ["id"], "rec_no")
    once = stream.withWatermark("finished_at", late).dropDuplicatesWithinWatermark(["model", "id"])
    return once.join(gold, "id")


def accuracy_by_window(aligned: DataFrame, width: str = "1 day") -> DataFrame:
    """Accuracy of each model and task in windows of event time; a window is given out once it is closed."""
    return (
        aligned.groupBy(F.window("finished_at", width), "model", "task")
        .agg(F.count("*").alias("n"), accuracy(F.col("parsed_answer"), F.coalesce(F.col("gold_index").cast("string"), F.col("gold"))).alias("accuracy"))
        .select(F.col("window.start").alias("since"), "model", "task", "n", "accuracy")
    )


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what is there as Parquet, then stops; run again for what has come since."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
