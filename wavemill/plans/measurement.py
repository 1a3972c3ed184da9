"""Leakage measurement over strides: both arms on the same windows, each run logged, an interrupted grid taken up again."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.operators import decide, features, measure
from wavemill.plans import build as plans
from wavemill.sources import sigmf, tables

NAMES = [c.split()[0] for c in tables.RUN_COLUMNS.split(", ")]


def measure_strides(
    spark: SparkSession,
    root: str,
    c: plans.BuildConfig,
    strides: Sequence[int],
    split_seeds: Sequence[int] = measure.SPLIT_SEEDS,
    train_seeds: Sequence[int] = measure.TRAIN_SEEDS,
    log: str | None = None,
    on_run: Callable[[dict], None] | None = None,
    snrs: Sequence[float] = (math.inf,),
    epochs: int = measure.EPOCHS,
    model: str = measure.CNN,
) -> DataFrame:
    """All runs (columns of ``tables.RUN_COLUMNS``) of the grid strides x SNRs x split seeds x training seeds x arms.

    A cell whose build warns raises: it would measure what the warning is about. An infinite SNR takes recordings as they are (and is
    null in the log, as JSON has no infinity). Each run is written to ``log`` when it is finished. Runs that the log has are not made again; a log whose runs
    were made in another environment, or don't say in which, raises. The log grows with the grid, not with the data.
    """
    here = measure.environment(spark) | ({"model": model} if model != measure.CNN else {})
    rows: list[dict] = []
    if log and tables.exists(spark, log):
        rows = [r.asDict() for r in decide.check_environment(tables.read_runs(spark, log), here).collect()]
    told = lambda snr: None if math.isinf(snr) else float(snr)
    powers = None
    for stride, snr in ((s, n) for s in strides for n in snrs):
        done = {(r["strategy"], r["split_seed"], r["train_seed"]) for r in rows if r["stride"] == stride and r["snr_db"] == told(snr)}
        if done >= {(a, s, t) for a in measure.ARMS for s in split_seeds for t in train_seeds}:
            continue
        cell = replace(c, stride=stride)
        p = plans.plan(spark, sigmf.scan(spark, root), cell)
        if p.warnings:
            raise plans.BuildError(f"stride {stride}: the build warns, so the arms couldn't be compared: {'; '.join(p.warnings)}")
        noise, sigma = {}, None
        if told(snr) is not None:
            powers = features.mean_powers(p.recordings) if powers is None else powers
            noise = {"snr_db": snr, "powers": powers}
            sigma = powers.agg(F.avg(F.sqrt(F.col("power") / (2 * 10 ** (snr / 10))))).first()[0]
        windows = plans.window_table(p, cell, **noise).drop("split").persist()

        def keep(run: dict, stride: int = stride, snr: float = snr, sigma: float | None = sigma) -> None:
            rows.append({n: None for n in NAMES} | run | {"stride": stride, "environment": here, "snr_db": told(snr), "noise_sigma": sigma})
            if log:
                tables.write_runs(spark, log, _frame(spark, rows), replace=True)
            if on_run:
                on_run(rows[-1])

        records = p.records.select("record_id", "label", "unit", "balance_group").persist()
        measure.run_grid(windows, records, c.ratios, split_seeds, train_seeds, keep, done, balanced=bool(c.balance_by), epochs=epochs, model=model)
        windows.unpersist()
        records.unpersist()
    at = F.col("snr_db").isNull() if any(map(math.isinf, snrs)) else F.lit(False)
    if finite := [float(x) for x in snrs if not math.isinf(x)]:
        at = at | F.col("snr_db").isin(*finite)
    wanted = F.col("stride").isin(*strides) & F.col("split_seed").isin(*split_seeds) & F.col("train_seed").isin(*train_seeds) & at
    return _frame(spark, rows).where(wanted)


def _frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], tables.RUN_COLUMNS)
