"""Leakage measurement: a bounded classifier, both arms over one table of windows, similarity of contents."""

from __future__ import annotations

import platform
import time
from collections.abc import Callable, Collection, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.operators import convnet, order
from wavemill.operators.decide import EPOCHS
from wavemill.operators.split import SPLITS, assign_splits, unseen_groups, window_level_deal
from wavemill.operators.stats import per_class_accuracy

SPLIT_SEEDS, TRAIN_SEEDS = (11, 22, 33, 44, 55), (0, 1, 2)
STRIDES = (1024, 768, 512, 256, 128)
ARMS = ("recording", "window")


def environment(spark: SparkSession) -> dict[str, str]:
    """What accuracies are comparable within."""
    import numpy

    return {"python": platform.python_version(), "spark": spark.version, "numpy": numpy.__version__}


def window_features(windows: DataFrame) -> DataFrame:
    """``windows`` with ``features``: moments of magnitude and of phase steps, which a bounded linear model can use."""
    from pyspark.ml.functions import array_to_vector

    mag = F.zip_with("i", "q", lambda a, b: F.sqrt(a * a + b * b))
    n = F.size("i")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.struct(k.alias("k")))
    re = F.transform(pairs, lambda p: F.get("i", p["k"]) * F.get("i", p["k"] - 1) + F.get("q", p["k"]) * F.get("q", p["k"] - 1))
    im = F.transform(pairs, lambda p: F.get("q", p["k"]) * F.get("i", p["k"] - 1) - F.get("i", p["k"]) * F.get("q", p["k"] - 1))
    step = F.zip_with(im, re, F.atan2)
    parts = [
        total(mag) / n, total(F.transform(mag, lambda x: x * x)) / n, total(F.transform(mag, lambda x: x * x * x * x)) / n,
        total(re) / n, total(im) / n, total(step) / n, total(F.transform(step, lambda x: x * x)) / n,
        total(F.transform(step, F.cos)) / n, total(F.transform(step, lambda x: F.cos(2 * x))) / n, total(F.transform(step, lambda x: F.cos(4 * x))) / n,
    ]
    return windows.withColumn("features", array_to_vector(F.array(*[F.coalesce(p, F.lit(0.0)) for p in parts], *[F.get("i", F.lit(k)) for k in range(8)])))


def train_and_evaluate(windows: DataFrame, seed: int = 0, iterations: int = EPOCHS) -> DataFrame:
    """(label, n, accuracy) of each class of the test split. ``windows``: label, split, i, q.

    A forest of fixed size over 18 features, far cheaper than :mod:`wavemill.operators.convnet`; accuracies of the
    two aren't comparable.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer

    rows = window_features(windows.where(F.col("label").isNotNull())).withColumn("label", F.col("label").cast("string"))
    train = rows.where(F.col("split") == SPLITS[0])
    index = StringIndexer(inputCol="label", outputCol="y", handleInvalid="keep", stringOrderType="alphabetAsc")
    forest = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=iterations, maxDepth=6, seed=seed)
    model = Pipeline(stages=[index, forest]).fit(train)
    scored = model.transform(rows.where(F.col("split") == SPLITS[2]))
    return per_class_accuracy(scored, "y", "prediction").withColumnRenamed("y", "label")


def accuracy(per_class: DataFrame) -> float:
    """Share of hits over all classes; 0 for an empty split."""
    r = per_class.agg(F.sum(F.col("n") * F.col("accuracy")).alias("h"), F.sum("n").alias("n")).first()
    return float(r.h / r.n) if r and r.n else 0.0


CNN, FOREST = "cnn", "forest"


def trained(rows: DataFrame, seed: int = 0, epochs: int = EPOCHS, model: str = CNN) -> tuple[float, float | None]:
    """(test accuracy, train accuracy) of a training on ``rows`` (record_id, window_ix, label, split, i, q)."""
    if model == FOREST:
        return accuracy(train_and_evaluate(rows, seed, epochs)), None
    found = convnet.train(rows, seed, epochs)
    return convnet.hit_share(convnet.predict(rows.where(F.col("split") == SPLITS[2]), found.net)), found.epochs[-1].train_accuracy


def probe(spark: SparkSession, window: int, windows: int = 256, model: str = CNN) -> float:
    """Seconds that training takes for one window and epoch, of a small training on ``windows`` made-up windows."""
    value = lambda j: F.transform(F.sequence(F.lit(1), F.lit(window)), lambda k: F.hash(k, F.col("id"), F.lit(j)) / F.lit(2.0**31))
    rows = spark.range(2 * windows).select(
        F.lit("r").alias("record_id"),
        F.col("id").alias("window_ix"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"),
        F.when(F.col("id") < windows, SPLITS[0]).otherwise(SPLITS[2]).alias("split"),
        value(0).alias("i"),
        value(1).alias("q"),
    )
    rows = rows.persist()
    rows.count()
    epochs = 1 if model == CNN else EPOCHS
    began = time.monotonic()
    trained(rows, epochs=epochs, model=model)
    rows.unpersist()
    return (time.monotonic() - began) / (windows * epochs)


class ShiftError(ValueError):
    """A split whose test holds values that train lacks: it would measure a shift, not leakage."""


def run_grid(
    windows: DataFrame,
    records: DataFrame,
    ratios: Sequence[float],
    split_seeds: Sequence[int] = SPLIT_SEEDS,
    train_seeds: Sequence[int] = TRAIN_SEEDS,
    on_run: Callable[[dict], None] | None = None,
    done: Collection[tuple[str, int, int]] = (),
    balanced: bool = False,
    epochs: int = EPOCHS,
    model: str = CNN,
) -> DataFrame:
    """Runs of both arms over one table of windows: (strategy, split_seed, train_seed, test_accuracy, train_accuracy, train_windows, test_windows).

    ``windows``: record_id, window_ix, label, i, q. ``records``: record_id, label (the dominant one), and unit and
    balance_group where recordings are grouped or balanced. The arms are two assignments of the same windows; nothing
    is built twice. ``on_run`` gets each finished run; those of ``done`` (strategy, split seed, training seed) aren't made.
    A balanced split whose test has values that train lacks raises before anything is trained.
    """
    spark, runs = windows.sparkSession, []
    if "unit" not in records.columns:
        records = records.withColumn("unit", F.col("record_id").cast("string"))
    for s in split_seeds:
        todo = {a: [t for t in train_seeds if (a, s, t) not in done] for a in ARMS}
        if not any(todo.values()):
            continue
        dealt_records = order.settle(assign_splits(records, ratios, s, balanced))  # a row for each recording
        if balanced:
            unseen = unseen_groups(dealt_records, "balance_group").where(F.col("split") == SPLITS[2])
            if lost := [r.balance_group for r in unseen.orderBy("balance_group").limit(4).collect()]:
                raise ShiftError(f"split seed {s}: test has balance values that train lacks, {', '.join(lost)} first; change the ratios or the recordings")
        plan = dealt_records.select(F.col("record_id").alias("_r"), "split")
        honest = windows.join(plan, F.col("record_id") == F.col("_r")).drop("_r")
        dealt = window_level_deal(honest.select("record_id", "window_ix", "label", "split"), s)
        dealt = order.settle(dealt.select("record_id", "window_ix", "split"))  # each training reads it
        leaky = windows.join(dealt, ["record_id", "window_ix"])
        for strategy, rows in zip(ARMS, (honest, leaky)):
            if not todo[strategy]:
                continue
            sizes = {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
            for t in todo[strategy]:
                test, train = trained(rows, t, epochs, model)
                run = {"strategy": strategy, "split_seed": s, "train_seed": t, "test_accuracy": test, "train_accuracy": train}
                run |= {"train_windows": sizes.get(SPLITS[0], 0), "test_windows": sizes.get(SPLITS[2], 0)}
                runs.append(run)
                if on_run:
                    on_run(run)
    schema = "strategy string, split_seed int, train_seed int, test_accuracy double, train_accuracy double, train_windows long, test_windows long"
    return spark.createDataFrame([tuple(r.values()) for r in runs], schema)
