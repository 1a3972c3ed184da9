"""Aggregates over recordings, splits and measurement runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.operators.split import SPLITS


def class_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, share, chance): chance is the largest share. Counts are combined before the one-row total is joined."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"), F.max("n").alias("_m"))
    return counts.crossJoin(total).select(label, "n", (F.col("n") / F.col("_t")).alias("share"), (F.col("_m") / F.col("_t")).alias("chance"))


def split_histogram(rows: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """A row for each class, a column for each split; 0 where a class is absent."""
    return rows.groupBy(label).pivot(split, list(SPLITS)).agg(F.count(F.lit(1))).na.fill(0, list(SPLITS))


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, observed, expected) for every pair of values, absent ones with 0. Only counts meet in the cross join."""
    counts = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("observed"))
    ra = counts.groupBy(a).agg(F.sum("observed").alias("_ra"))
    rb = counts.groupBy(b).agg(F.sum("observed").alias("_rb"))
    n = counts.agg(F.sum("observed").alias("_n"))
    grid = ra.crossJoin(rb).crossJoin(n).join(counts, [a, b], "left")
    return grid.select(a, b, F.coalesce("observed", F.lit(0)).alias("observed"), (F.col("_ra") * F.col("_rb") / F.col("_n")).alias("expected"))


def independence_deviation(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the largest deviation of a count from what independence expects."""
    return contingency(rows, a, b).agg(F.max(F.abs(F.col("observed") - F.col("expected"))).alias("deviation"))


def offset_signs(rows: DataFrame, offset: str, split: str = "split") -> DataFrame:
    """Negative and other offsets in each split, flagged where more than one is known and all are on one side."""
    out = rows.groupBy(split).agg(F.count_if(F.col(offset) < 0).alias("negative"), F.count_if(F.col(offset) >= 0).alias("positive"))
    return out.withColumn("one_sided", (F.least("negative", "positive") == 0) & (F.col("negative") + F.col("positive") > 1))


def paired_inflation(runs: DataFrame, cells: tuple[str, ...] = ()) -> DataFrame:
    """Paired difference of the arms ``window`` and ``recording``: n, means, sample sd and standard error.

    ``runs``: strategy, split_seed, train_seed, test_accuracy and ``cells``. Pairs with one arm only don't
    count; for a single pair sd and error are null: not estimated, which is not 0.
    """
    pairs = runs.groupBy(*cells, "split_seed", "train_seed").agg(
        F.max(F.when(F.col("strategy") == "recording", F.col("test_accuracy"))).alias("rec"),
        F.max(F.when(F.col("strategy") == "window", F.col("test_accuracy"))).alias("win"),
    )
    d = pairs.where("rec is not null and win is not null").withColumn("d", F.col("win") - F.col("rec"))
    out = d.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("rec").alias("recording_mean"),
        F.avg("win").alias("window_mean"),
        F.avg("d").alias("inflation"),
        F.stddev_samp("d").alias("sd"),
    )
    return out.withColumn("se", F.col("sd") / F.sqrt("n"))


def seed_spread(runs: DataFrame, split_seed: str = "split_seed", accuracy: str = "test_accuracy") -> DataFrame:
    """One row: mean, sd, min, max over all runs; sd of the split seeds' means; mean of the sds within them; which is larger."""
    per = runs.groupBy(split_seed).agg(F.avg(accuracy).alias("m"), F.stddev_samp(accuracy).alias("s"))
    between = per.agg(F.stddev_samp("m").alias("between_sd"), F.avg("s").alias("within_sd"))
    whole = runs.agg(
        F.count(accuracy).alias("n"), F.avg(accuracy).alias("mean"), F.stddev_samp(accuracy).alias("sd"), F.min(accuracy).alias("low"), F.max(accuracy).alias("high")
    )
    return whole.crossJoin(between).withColumn("dominant", F.when(F.col("between_sd") > F.col("within_sd"), "split seed").otherwise("training seed"))


def label_map(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, index): classes in alphabetical order from 0. One row for each class."""
    distinct = rows.select(label).where(F.col(label).isNotNull()).distinct()
    return distinct.withColumn("index", F.row_number().over(Window.orderBy(label)) - 1)


def per_class_accuracy(rows: DataFrame, label: str = "label", predicted: str = "prediction") -> DataFrame:
    hit = (F.col(label) == F.col(predicted)).cast("double")
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))
