"""Scores of predictions as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vaktavya.operators.scoring import COUNTS, figures, row_counts
from vaktavya.sources.speech import succeeded


def arriving(spark: SparkSession, path: str, like: DataFrame, files: int = 16) -> DataFrame:
    """A stream of the parquet files that arrive below a path, with the columns of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def first_successes(predictions: DataFrame, late: str = "1 day") -> DataFrame:
    """Successful predictions, the first that arrives of each utterance and provider; state older than ``late`` is dropped."""
    kept = predictions.where(succeeded(F.trim("status"))).withWatermark("written_at", late)
    return kept.dropDuplicatesWithinWatermark(["utterance_id", "provider"])


def scored(predictions: DataFrame, release: DataFrame) -> DataFrame:
    """The counts of arriving predictions against a static release; predictions beyond it are ignored."""
    wanted = release.select("utterance_id", "language", "transcription", "keywords")
    joined = predictions.select("utterance_id", "provider", "prediction", "written_at").join(wanted, "utterance_id")
    return row_counts(joined).select("utterance_id", "provider", "language", "written_at", *COUNTS)


def windowed_rates(counts: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Scores by provider and window of the time of writing; late rows count until the watermark passes."""
    return counts.withWatermark("written_at", late).groupBy(F.window("written_at", window), "provider").agg(*figures())


def keep_sums(rows: DataFrame, by: Sequence[str], columns: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's sums of ``columns`` by ``by`` under its own number.

    No state is kept between batches, so no row is ever too late. A batch that is run again after a failure overwrites its own
    folder, and sums count it once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*by).agg(*(F.sum(c).alias(c) for c in columns)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_sums(spark: SparkSession, by: Sequence[str], columns: Sequence[str], path: str) -> DataFrame:
    """Sums over all batches so far."""
    return spark.read.parquet(path).groupBy(*by).agg(*(F.sum(c).alias(c) for c in columns))


def keep_totals(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the sums of arriving counts by provider and language."""
    return keep_sums(counts.withColumn("utterances", F.lit(1)), ("provider", "language"), (*COUNTS, "utterances"), path, checkpoint)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Counts by provider and language over all batches so far."""
    return kept_sums(spark, ("provider", "language"), (*COUNTS, "utterances"), path)
