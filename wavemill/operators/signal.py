"""Signal features in columns: envelopes, activity, spectra, bands, pooling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions.columns import pool_bucket, power_db
from wavemill.operators.selection import exact_percentiles

BLOCK = 1024
#: Below this span of block powers (dB) all of a recording counts as active; above it, what is this share of the span above the lowest.
FLAT_DB, ACTIVE_SHARE = 6.0, 0.35
SAMPLE_LIMIT, CHUNKS = 2_000_000, 16


def power_envelope(samples: DataFrame, block: int = BLOCK, power: Column | None = None) -> DataFrame:
    """(record_id, block, power): mean power of each whole block of ``block`` samples; a rest is dropped."""
    p = power if power is not None else F.col("i").cast("double") * F.col("i") + F.col("q").cast("double") * F.col("q")
    g = samples.groupBy("record_id", F.floor(F.col("ord") / block).cast("long").alias("block"))
    return g.agg(F.count(F.lit(1)).alias("_n"), F.avg(p).alias("power")).where(F.col("_n") == block).drop("_n")


def active_mask(envelope: DataFrame) -> DataFrame:
    """``envelope`` with ``db`` and ``active``; recordings with fewer than two blocks give no rows."""
    db = envelope.withColumn("db", power_db("power"))
    span = db.groupBy("record_id").agg(F.min("db").alias("_lo"), F.max("db").alias("_hi"), F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    met = db.join(span, "record_id")
    active = F.when(F.col("_hi") - F.col("_lo") < FLAT_DB, True).otherwise(F.col("db") > F.col("_lo") + ACTIVE_SHARE * (F.col("_hi") - F.col("_lo")))
    return met.select("record_id", "block", "power", "db", active.alias("active"))


def duty_cycle(mask: DataFrame) -> DataFrame:
    """(record_id, duty_cycle, burst_start_frac): share of active blocks, and where the first one is."""
    return mask.groupBy("record_id").agg(
        F.avg(F.col("active").cast("double")).alias("duty_cycle"),
        (F.min(F.when(F.col("active"), F.col("block"))) / F.count(F.lit(1))).alias("burst_start_frac"),
    )


def sample_chunks(recordings: DataFrame, limit: int = SAMPLE_LIMIT, chunks: int = CHUNKS, block: int = BLOCK) -> DataFrame:
    """(record_id, chunk, start, count): what to read of each recording, spread over it in whole blocks; all of a short one."""
    n = F.col("num_samples")
    size = max(block, limit // chunks // block * block)
    step = F.floor((n - size) / F.lit(chunks - 1) / block) * block
    part = F.when(n <= limit, F.array(F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("start"), n.cast("long").alias("count")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda k: F.struct(k.alias("chunk"), (k * step).cast("long").alias("start"), F.lit(size).cast("long").alias("count")))
    )
    return recordings.select("record_id", F.explode(part).alias("p")).select("record_id", "p.*")


def dft_power(vectors: DataFrame, n: int, ids: tuple[str, ...] = ("record_id",), i: str = "i", q: str = "q") -> DataFrame:
    """(ids, bin, power) of the n-point discrete transform of complex arrays, bins in natural order."""
    from wavemill.operators.spectrum import spectra

    out = spectra(vectors, n, ids, i, q).select(*ids, F.posexplode("power").alias("_x", "power"))
    return out.select(*ids, ((F.col("_x") + n - n // 2) % n).alias("bin"), "power")


def shifted_bin(k: Column | str, n: int) -> Column:
    """Place of a bin when frequency 0 is in the middle."""
    k = F.col(k) if isinstance(k, str) else k
    return (k + n // 2) % n


def declared_band(annotations: DataFrame, recordings: DataFrame, exclude: tuple[str, ...] = ("ref_tone",)) -> DataFrame:
    """(record_id, offset_hz, bandwidth_hz): medians over annotations with both edges; those without a label count."""
    keep = ~F.coalesce("label", F.lit("")).isin(*exclude) & F.col("freq_lower_edge").isNotNull() & F.col("freq_upper_edge").isNotNull()
    met = annotations.where(keep).join(recordings.select("record_id", "center_frequency").where("center_frequency is not null"), "record_id")
    middle = (F.col("freq_lower_edge") + F.col("freq_upper_edge")) / 2 - F.col("center_frequency")
    return met.groupBy("record_id").agg(F.median(middle).alias("offset_hz"), F.median(F.col("freq_upper_edge") - F.col("freq_lower_edge")).alias("bandwidth_hz"))


def processing_gain(features: DataFrame) -> DataFrame:
    """One row: median of 10 log10(sample rate / occupied bandwidth) and how many recordings have one; a band of 0 doesn't count."""
    usable = features.where((F.col("occupied_bw_hz") > 0) & (F.col("sample_rate") > 0))
    return usable.agg(F.median(10 * F.log10(F.col("sample_rate") / F.col("occupied_bw_hz"))).alias("gain_db"), F.count(F.lit(1)).alias("recordings"))


def pool(rows: DataFrame, m: int, how: str = "max", value: str = "value", row: str = "ord", n: str = "n", ids: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """(ids, bucket, value): rows 0..n-1 pooled into ``m`` buckets; with ``m`` of at least n, each row repeats over its nearest buckets."""
    agg = {"max": F.max, "mean": F.avg}[how]
    down = rows.where(F.col(n) > m).groupBy(*ids, pool_bucket(row, F.col(n), m).alias("bucket")).agg(agg(value).alias("value"))
    first, last = F.ceil(F.col(row) * m / F.col(n)), F.ceil((F.col(row) + 1) * m / F.col(n)) - 1
    up = rows.where(F.col(n) <= m).select(*ids, F.explode(F.sequence(first, last)).alias("bucket"), F.col(value).alias("value"))
    return down.unionByName(up)


def percentile_clip(rows: DataFrame, value: str = "value", low: float = 0.05, high: float = 0.99) -> DataFrame:
    """One row: the exact percentiles between which values are shown; see :mod:`wavemill.operators.selection`."""
    return rows.sparkSession.createDataFrame([tuple(exact_percentiles(rows, value, (low, high)))], "low double, high double")


def half_power_edges(spectrum: DataFrame, ids: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """(ids, rise, fall): where power crosses halfway between its 10th and 90th percentile, first up and last down, interpolated.

    ``spectrum``: ids, x, power (linear).
    """
    level = spectrum.groupBy(*ids).agg(F.percentile("power", F.array(F.lit(0.1), F.lit(0.9))).alias("_p"))
    met = spectrum.join(level, list(ids)).withColumn("_th", (F.get("_p", F.lit(0)) + F.get("_p", F.lit(1))) / 2)
    w = Window.partitionBy(*ids).orderBy("x")
    met = met.withColumns({"_px": F.lag("x").over(w), "_pp": F.lag("power").over(w)})
    at = F.col("_px") + (F.col("_th") - F.col("_pp")) / (F.col("power") - F.col("_pp")) * (F.col("x") - F.col("_px"))
    up = (F.col("_pp") <= F.col("_th")) & (F.col("power") > F.col("_th"))
    down = (F.col("_pp") > F.col("_th")) & (F.col("power") <= F.col("_th"))
    return met.groupBy(*ids).agg(F.min(F.when(up, at)).alias("rise"), F.max(F.when(down, at)).alias("fall"))


def band_power(spectrum: DataFrame, low: Column | float, high: Column | float, ids: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """(ids, band_db): power of the bins x in [low, high] of a linear spectrum (ids, x, power)."""
    inside = (F.col("x") >= low) & (F.col("x") <= high)
    return spectrum.where(inside).groupBy(*ids).agg(power_db(F.sum("power"), 1e-12).alias("band_db"))


def active_span(mask: DataFrame) -> DataFrame:
    """(record_id, first, last): the outermost active blocks."""
    on = mask.where("active")
    return on.groupBy("record_id").agg(F.min("block").alias("first"), F.max("block").alias("last"))


def frame_segments(recordings: DataFrame, offsets: DataFrame, length: int, lead: int = 2048, least: int = 1024) -> DataFrame:
    """(record_id, start, count): a stretch around each recording's frame, cut at its ends; ones shorter than ``least`` are left out.

    ``recordings``: record_id, num_samples. ``offsets``: record_id, offset.
    """
    met = recordings.select("record_id", "num_samples").join(offsets.select("record_id", "offset"), "record_id")
    start = F.greatest(F.col("offset") - lead, F.lit(0)).cast("long")
    out = met.select("record_id", start.alias("start"), F.least(F.lit(length).cast("long"), F.col("num_samples") - start).alias("count"))
    return out.where(F.col("count") >= least)


def add_noise_to_windows(windows: DataFrame, snr_db: float, seed: int, power: str = "power") -> DataFrame:
    """``windows`` (record_id, start, i, q and each recording's mean ``power``) with the noise that :func:`add_noise` gives their samples.

    A sample's noise follows from (seed, record, place in the recording), so windows that overlap share it.
    """
    sigma = F.sqrt(F.col(power) / (2 * 10 ** (snr_db / 10)))

    def part(which: str) -> Column:
        def one(x: Column, k: Column) -> Column:
            uniform = lambda j: (F.pmod(F.xxhash64(F.lit(seed), F.lit(j), F.col("record_id"), F.col("start") + k), F.lit(1 << 53)) + 0.5) / float(1 << 53)
            angle = uniform(1) * (2 * math.pi)
            return (x + sigma * F.sqrt(-2 * F.log(uniform(0))) * (F.cos(angle) if which == "i" else F.sin(angle))).cast("float")

        return F.transform(which, one)

    return windows.withColumns({c: part(c) for c in ("i", "q")}).drop(power)


def add_noise(samples: DataFrame, snr_db: float, seed: int) -> DataFrame:
    """``samples`` (record_id, ord, i, q) with white noise at ``snr_db`` below each recording's mean power.

    Noise follows from (seed, record, place) by hashing, so it is the same whatever the partitioning. It belongs before
    windowing and normalising, where it still has a level.
    """
    power = samples.groupBy("record_id").agg(F.avg(F.col("i").cast("double") * F.col("i") + F.col("q").cast("double") * F.col("q")).alias("_p"))
    sigma = F.sqrt(F.col("_p") / (2 * 10 ** (snr_db / 10)))
    uniform = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "record_id", "ord"), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    radius, angle = sigma * F.sqrt(-2 * F.log(uniform(0))), uniform(1) * (2 * math.pi)
    met = samples.join(power, "record_id")
    return met.withColumns({"i": F.col("i") + radius * F.cos(angle), "q": F.col("q") + radius * F.sin(angle)}).drop("_p")
