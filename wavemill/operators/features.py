"""Scalars of each recording that the audit looks at; what can't be measured is null, never a default."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions.columns import power_db
from wavemill.operators import order, spectrum
from wavemill.operators.signal import BLOCK, active_mask, declared_band, duty_cycle, sample_chunks
from wavemill.sources.sigmf import annotations_of, bytes_per_sample, planned_by_bytes, read_range

#: What the audit's axes read.
SCALARS = "mean_power_db double, duration_samples double, duty_cycle double, burst_start_frac double"


def mean_powers(recordings: DataFrame) -> DataFrame:
    """(record_id, power): mean power of what is read of each recording, as for :func:`measure`."""
    ok = recordings.where("error is null")
    chunks = planned_by_bytes(sample_chunks(ok).join(ok.select("record_id", "data_path", "datatype"), "record_id"), bytes_per_sample(F.col("datatype")), F.col("start"), F.col("count"))
    return order.settle(spectrum.read_powers(chunks, read_range).groupBy("record_id").agg((F.sum("energy") / F.sum("samples")).alias("power")))


def measure(recordings: DataFrame, labels: DataFrame | None = None, exclude: tuple[str, ...] = ("ref_tone",)) -> DataFrame:
    """Feature table of ``recordings`` (of :func:`wavemill.sources.sigmf.scan`), with ``label`` of ``labels`` (record_id, label).

    A declared band wins over the estimated one; a width of 0 counts as none. At most 2 000 000 samples of a
    recording are read, in tasks planned by bytes; its chunks may be read by several.
    """

    ok = recordings.where("error is null")
    files = ok.select("record_id", "data_path", "datatype")
    chunks = planned_by_bytes(sample_chunks(ok).join(files, "record_id"), bytes_per_sample(F.col("datatype")), F.col("start"), F.col("count"))
    powers = order.settle(spectrum.read_powers(chunks, read_range))
    block = F.col("chunk") * F.size("powers")  # chunks of a recording are equally long
    envelope = powers.select("record_id", block.alias("_b"), F.posexplode("powers").alias("_k", "power")).select("record_id", (F.col("_b") + F.col("_k")).alias("block"), "power")
    mask = active_mask(envelope)
    level = powers.groupBy("record_id").agg(power_db(F.sum("energy") / F.sum("samples")).alias("mean_power_db"))
    duty = duty_cycle(mask)
    # Recordings with both kinds of blocks are read again, as sums of spectra; flags go back to their chunks, at most SAMPLE_LIMIT / BLOCK of a recording.
    flags = mask.join(duty.where("duty_cycle > 0 and duty_cycle < 1").select("record_id"), "record_id").groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("block", "active"))).alias("_f"))
    first = powers.select("record_id", "chunk", block.alias("_b"), F.size("powers").alias("_n")).join(flags, "record_id")
    gated = first.where("_n > 0").select("record_id", "chunk", F.transform(F.slice("_f", F.col("_b") + 1, F.col("_n")), lambda x: x["active"]).alias("active"))
    sums = spectrum.read_gated(chunks.join(gated, ["record_id", "chunk"]), read_range)
    bands = spectrum.excess(spectrum.merged(sums, BLOCK)).join(ok.select("record_id", "sample_rate"), "record_id")
    bands = bands.select("record_id", spectrum.band_of("excess", F.col("sample_rate")).alias("_band")).select("record_id", F.col("_band.offset_hz").alias("est_offset_hz"), F.col("_band.bandwidth_hz").alias("est_bw_hz"))
    found = duty.join(level, "record_id").join(bands, "record_id", "left")
    told = declared_band(annotations_of(ok), ok, exclude).withColumnRenamed("offset_hz", "told_offset").withColumnRenamed("bandwidth_hz", "told_bw")
    start = F.unix_micros("capture_time") / 1e6
    out = ok.join(found, "record_id", "left").join(told, "record_id", "left")
    if labels is not None:
        out = out.join(labels.select("record_id", "label"), "record_id", "left")
    else:
        out = out.withColumn("label", F.lit(None).cast("string"))
    told_ok = F.col("told_bw") > 0
    return out.select(
        "record_id",
        "label",
        F.when(told_ok, F.col("told_offset")).otherwise(F.col("est_offset_hz")).alias("carrier_offset_hz"),
        "mean_power_db",
        F.col("num_samples").cast("double").alias("duration_samples"),
        "duty_cycle",
        "burst_start_frac",
        start.alias("start"),
        (start + F.col("num_samples") / F.col("sample_rate")).alias("end"),
        F.when(told_ok, F.col("told_bw")).otherwise(F.col("est_bw_hz")).alias("occupied_bw_hz"),
        "sample_rate",
        F.when(told_ok, "declared").when(F.col("est_bw_hz").isNotNull(), "estimated").alias("bw_source"),
        "collection",
        "error",
    )
