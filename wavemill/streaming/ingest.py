"""Recordings as they arrive: metadata files as a stream, labelled and appended in micro-batches.

Splits and audits need the whole set and stay batch plans; what a recording tells by itself doesn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavemill.functions.columns import window_count
from wavemill.operators.labels import dominant_label, label_windows_nested
from wavemill.sources import sigmf


def stream_metadata(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """A stream of (path, value), one row for each new metadata file below ``root``."""
    return (
        spark.readStream.schema("value string")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{sigmf.META}")
        .option("maxFilesPerTrigger", max_files)
        .format("text")
        .load(root)
        .selectExpr("_metadata.file_path as path", "value")
    )


def ingest(spark: SparkSession, root: str, out: str, window: int, stride: int, checkpoint: str, exclude: tuple[str, ...] | None = None):
    """Start a query that appends each new recording's window counts and dominant label to Parquet in ``out``; run once with what is there."""

    def each(batch: DataFrame, epoch: int) -> None:
        new = batch.select("path").distinct()
        found = sigmf.scan(spark, root, strict=False).join(new, "path", "left_semi").where("error is null")
        labels = dominant_label(label_windows_nested(found, window, stride, exclude)).select("record_id", "label")
        rows = found.withColumn("windows", window_count("num_samples", window, stride)).select("record_id", "sample_rate", "num_samples", "windows")
        rows.join(labels, "record_id", "left").write.mode("overwrite").parquet(f"{out.rstrip('/')}/epoch={epoch}")  # a batch that is run again replaces itself

    return stream_metadata(spark, root).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
