"""Whether a leakage measurement is worth running: the first reason to refuse wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions.columns import half_even, window_count
from wavemill.operators.audit import LEAK, RISK

REFUSED, INCONCLUSIVE, MEASURE = "REFUSED", "INCONCLUSIVE", "WOULD MEASURE"
#: Categories of refusal, in the order in which they are tried.
CATEGORIES = {1: "unreadable", 2: "shared timestamp", 3: "near duplicates", 4: "ceiling", 5: "leak the grouping does not hold", 6: "too few units"}
EPOCHS, ARMS = 20, 2


FLAGS = ("unreadable", "stamps", "near", "ceiling", "leak", "unheld", "short", "grouped", "built", "has_features", "empty", "force")


def classify(flags: DataFrame) -> DataFrame:
    """``flags`` (FLAGS, a row for each folder, nulls count as false) with status, category, reason and forced_past.

    The first reason to refuse wins. ``force`` measures anyway, keeps the category, and ``forced_past`` says what was overridden: a
    category, the verdict of the axes, or an audit that told nothing.
    """
    yes = lambda n: F.coalesce(F.col(n), F.lit(False))
    unmeasured = yes("built") & ~yes("has_features")
    category = (
        F.when(yes("unreadable"), 1)
        .when(yes("stamps"), 2)
        .when(yes("near") & ~yes("grouped"), 3)
        .when(yes("ceiling"), 4)
        .when(yes("leak") | yes("unheld"), 5)
        .when(unmeasured, F.lit(None).cast("int"))
        .when(yes("short"), 6)
    )
    c = F.col("category")
    status = F.when(c.isNotNull(), REFUSED).when(unmeasured | yes("empty"), INCONCLUSIVE).otherwise(MEASURE)
    reason = F.element_at(F.create_map(*[x for k, v in CATEGORIES.items() for x in (F.lit(k), F.lit(v))]), c)
    past = F.when(c == 4, "audit verdict 'ceiling'").when(c.isNotNull(), F.concat(F.lit("category "), c.cast("string"), F.lit(" '"), F.col("reason"), F.lit("'"))).otherwise("an INCONCLUSIVE audit")
    over = yes("force") & (F.col("status") != MEASURE)
    out = flags.withColumn("category", category).withColumn("reason", F.when(c.isNotNull(), reason)).withColumn("status", status)
    return out.withColumn("forced_past", F.when(over, past)).withColumn("status", F.when(over, MEASURE).otherwise(F.col("status"))).select(*[n for n in flags.columns if n not in FLAGS], "status", "category", "reason", "forced_past")


def decide(
    findings: DataFrame,
    verdict: DataFrame,
    near_duplicate_pairs: DataFrame,
    leaks_not_held: DataFrame,
    short_classes: DataFrame,
    grouped: bool = False,
    built: bool = False,
    has_features: bool = True,
    force: bool = False,
    recordings: DataFrame | None = None,
) -> DataFrame:
    """One row: status, category, reason, forced_past, by :func:`classify`.

    ``leaks_not_held``: rows if some recordings on air together aren't kept together by the units. ``short_classes``: classes
    with fewer units than splits in use. ``recordings`` (error): if none of them can be read, nothing can be measured.
    """
    s, c, d = F.col("status"), F.col("check"), F.col("detail")
    row = findings.agg(
        (F.count(F.lit(1)) == 0).alias("empty"),
        F.max((c == "recordings readable") & (s == RISK) & d.rlike("Unsupported|unsupported|cf16")).alias("_odd"),
        F.max((c == "shared timestamp") & s.isin(LEAK, RISK)).alias("stamps"),
        F.max((s == LEAK) & ~c.isin("shared timestamp", "shared air time", "recording time overlap")).alias("leak"),
    )
    for name, rows in (("near", near_duplicate_pairs), ("unheld", leaks_not_held), ("short", short_classes)):
        row = row.crossJoin(rows.agg((F.count(F.lit(1)) > 0).alias(name)))  # one row each
    row = row.crossJoin(verdict.agg((F.max("verdict") == "ceiling").alias("ceiling")))
    none = recordings.agg(((F.count(F.lit(1)) > 0) & (F.count("error") == F.count(F.lit(1)))).alias("_none")) if recordings is not None else None
    row = row.crossJoin(none) if none is not None else row.withColumn("_none", F.lit(False))
    row = row.withColumn("unreadable", F.coalesce("_odd", F.lit(False)) | F.coalesce("_none", F.lit(False)))
    told = {"grouped": grouped, "built": built, "has_features": has_features, "force": force}
    return classify(row.withColumns({k: F.lit(v) for k, v in told.items()}).drop("_odd", "_none"))


def predicted_windows(recordings: DataFrame, window: int, stride: int, ratios: tuple[float, float, float]) -> DataFrame:
    """One row: windows in all, and in train and test for the ratios given (half to even)."""
    total = recordings.agg(F.coalesce(F.sum(window_count("num_samples", window, stride)), F.lit(0)).alias("windows"))
    part = lambda r: half_even(F.col("windows") * F.lit(float(r))).cast("long")
    return total.select("windows", part(ratios[0]).alias("train"), part(ratios[2]).alias("test"))


def work_estimate(predicted: DataFrame, seconds_per_window_epoch: float, runs: int = 1) -> DataFrame:
    """Seconds of training that a measurement takes."""
    return predicted.withColumn("seconds", F.col("train") * F.lit(seconds_per_window_epoch * EPOCHS * ARMS * runs))


def check_environment(runs: DataFrame, current: dict[str, str]) -> DataFrame:
    """``runs``, unless one was made without an environment or in another one: then the plan raises."""
    here = F.create_map(*[x for k, v in sorted(current.items()) for x in (F.lit(k), F.lit(v))])
    same = F.array_sort(F.map_entries(F.col("environment"))) == F.array_sort(F.map_entries(here))
    guard = F.when(F.col("environment").isNull(), F.raise_error(F.lit("a run has no environment"))).when(~same, F.raise_error(F.lit("a run was made in another environment")))
    return runs.withColumn("environment", F.coalesce(guard.cast("map<string,string>"), F.col("environment")))
