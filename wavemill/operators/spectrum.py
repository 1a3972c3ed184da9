"""Spectra on executors: transforms of array columns, activity-gated periodograms, pooled spectrograms.

Sums of block spectra are the state of a periodogram: those of parts of a recording add up, so a recording may be read by any
number of tasks. A spectrogram's state is the largest magnitude in each of its pixels. Transforms run over Arrow
batches in NumPy; what follows (activity, means, bands) are columns shared by the audit and the queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.functions.columns import power_db
from wavemill.operators.signal import BLOCK, pool

#: Blocks, or frames, that are transformed at once.
TOGETHER = 256
#: Frames that one row of work stands for.
FRAMES = 4096
#: Symmetric for periodograms, periodic for spectrograms.
HANN, PERIODIC, NONE = "hann", "periodic", "none"


def taper(kind: str, n: int) -> np.ndarray:
    if kind == NONE:
        return np.ones(n)
    over = n - 1 if kind == HANN else n
    return np.sin(np.pi * np.arange(n) / max(over, 1)) ** 2


def power_spectra(z: np.ndarray, kind: str = HANN) -> np.ndarray:
    """Squared magnitudes of the transforms of rows, frequency 0 in the middle."""
    n = z.shape[-1]
    found = np.fft.fft(z * taper(kind, n), axis=-1)
    return np.roll(found.real**2 + found.imag**2, n // 2, axis=-1)


def _lists(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows, np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * (flat.shape[1] if flat.ndim == 2 else 0), pa.int32()), pa.array(flat.reshape(-1)))


def _complex(batch: pa.RecordBatch, i: str, q: str, n: int) -> np.ndarray:
    part = lambda c: np.asarray(batch.column(c).flatten()).astype(np.float64).reshape(-1, n)
    return part(i) + 1j * part(q)


def spectra(vectors: DataFrame, n: int, ids: Sequence[str] = ("record_id",), i: str = "i", q: str = "q", kind: str = NONE) -> DataFrame:
    """(ids, power): power of the n-point transform of complex arrays, frequency 0 in the middle; rows of another length raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(ids)], _lists(power_spectra(_complex(part, "_i", "_q", n), kind))], names=[*ids, "power"])

    rows = vectors.select(*ids, F.col(i).cast("array<double>").alias("_i"), F.col(q).cast("array<double>").alias("_q"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in ids) + ", power array<double>"
    return rows.mapInArrow(run, schema)


def gated_sums(blocks: DataFrame, n: int, kind: str = HANN) -> DataFrame:
    """(record_id, active, blocks, total) of blocks (record_id, active, i, q): a part for each task's run of a recording's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                power = power_spectra(_complex(part, "i", "q", n), kind)
                keys = list(zip(part.column("record_id").to_pylist(), part.column("active").to_pylist()))
                yield _summed(keys, power, part.schema.field("record_id").type)

    kind_of = blocks.schema["record_id"].dataType.simpleString()
    return blocks.select("record_id", "active", F.col("i").cast("array<double>").alias("i"), F.col("q").cast("array<double>").alias("q")).mapInArrow(
        run, f"record_id {kind_of}, active boolean, blocks long, total array<double>"
    )


def _summed(keys: list[tuple], power: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    own = list(dict.fromkeys(keys))
    at = {k: j for j, k in enumerate(own)}
    which = np.array([at[k] for k in keys])
    sums = np.zeros((len(own), power.shape[1]))
    np.add.at(sums, which, power)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in own], kind), pa.array([k[1] for k in own], pa.bool_()), pa.array(np.bincount(which, minlength=len(own))), _lists(sums)],
        names=["record_id", "active", "blocks", "total"],
    )


def merged(parts: DataFrame, n: int) -> DataFrame:
    """(record_id, active, blocks, power): the mean spectrum of a recording's active blocks, and of the others, from sums of parts."""
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    zero = F.array_repeat(F.lit(0.0), n)
    out = parts.groupBy("record_id", "active").agg(F.sum("blocks").alias("blocks"), F.aggregate(F.collect_list("total"), zero, add).alias("_t"))  # a part a task
    return out.select("record_id", "active", "blocks", F.transform("_t", lambda x: x / F.col("blocks")).alias("power"))


def excess(means: DataFrame) -> DataFrame:
    """(record_id, excess): what active blocks have above the others by bin; only recordings that have both."""
    on, off = means.where("active").select("record_id", F.col("power").alias("_on")), means.where("not active").select("record_id", F.col("power").alias("_off"))
    return on.join(off, "record_id").select("record_id", F.zip_with("_on", "_off", lambda a, b: F.greatest(a - b, F.lit(0.0))).alias("excess"))


def band_of(values: Column | str, rate: Column | float, share: float = 0.99) -> Column:
    """(offset_hz, bandwidth_hz) of the band that holds ``share`` of an array of excess, frequency 0 in the middle; nulls without any."""
    e = F.col(values) if isinstance(values, str) else values
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    tail = (1 - share) / 2

    def add(acc: Column, x: Column) -> Column:
        s = acc["s"] + x
        reached = lambda level, was: F.when(was.isNull() & (s / acc["t"] >= level), acc["k"]).otherwise(was)
        return F.struct(
            (acc["k"] + 1).alias("k"), s.alias("s"), (acc["m"] + acc["k"] * x).alias("m"), reached(tail, acc["lo"]).alias("lo"), reached(1 - tail, acc["hi"]).alias("hi"), acc["t"].alias("t")
        )

    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("s"), F.lit(0.0).alias("m"), none.alias("lo"), none.alias("hi"), total.alias("t"))
    n = F.size(e)
    bin_hz = rate / n
    found = F.aggregate(e, start, add, lambda a: F.struct(((a["m"] / a["t"] - n / 2) * bin_hz).alias("offset_hz"), (F.greatest(F.lit(1), a["hi"] - a["lo"] + 1) * bin_hz).alias("bandwidth_hz")))
    return F.when(total > 0, found)


# -- recordings, read by range

READ = Callable[[str, str, int, int], tuple[np.ndarray, np.ndarray]]


def _stretches(batch: pa.RecordBatch, read: READ) -> Iterator[tuple[int, np.ndarray]]:
    """(row, complex samples) of rows (data_path, datatype, start, count), TOGETHER blocks at once; a rest comes last."""
    columns = (batch.column(c).to_pylist() for c in ("data_path", "datatype", "start", "count"))
    for row, (path, kind, start, count) in enumerate(zip(*columns)):
        for a in range(0, count, TOGETHER * BLOCK):
            i, q = read(path, kind, start + a, min(TOGETHER * BLOCK, count - a))
            yield row, i.astype(np.float64) + 1j * q


def read_powers(chunks: DataFrame, read: READ) -> DataFrame:
    """(record_id, chunk, samples, energy, powers): what was read of each chunk, and the mean power of each whole block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            powers: list[list[np.ndarray]] = [[] for _ in range(b.num_rows)]
            samples, energy = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for row, z in _stretches(b, read):
                square = z.real**2 + z.imag**2
                samples[row] += len(z)
                energy[row] += square.sum()
                powers[row].append(square[: len(z) // BLOCK * BLOCK].reshape(-1, BLOCK).mean(axis=1))
            lists = pa.array([np.concatenate(p) if p else np.zeros(0) for p in powers], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("record_id"), b.column("chunk"), pa.array(samples), pa.array(energy), lists], names=["record_id", "chunk", "samples", "energy", "powers"])

    return chunks.select("record_id", "chunk", "data_path", "datatype", "start", "count").mapInArrow(run, "record_id string, chunk int, samples long, energy double, powers array<double>")


def read_gated(chunks: DataFrame, read: READ) -> DataFrame:
    """Parts for :func:`merged` of chunks with ``active``, an array of a flag for each whole block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, flags, done = b.column("record_id").to_pylist(), b.column("active").to_pylist(), [0] * b.num_rows
            for row, z in _stretches(b, read):
                blocks = z[: len(z) // BLOCK * BLOCK].reshape(-1, BLOCK)
                own = flags[row][done[row] : done[row] + len(blocks)]
                done[row] += len(blocks)
                if len(blocks):
                    yield _summed([(names[row], f) for f in own], power_spectra(blocks), pa.string())

    rows = chunks.select("record_id", "data_path", "datatype", "start", "count", "active")
    return rows.mapInArrow(run, "record_id string, active boolean, blocks long, total array<double>")


def frame_runs(recordings: DataFrame, nfft: int, frames: int = FRAMES) -> DataFrame:
    """(record_id, data_path, datatype, total, first, frames, start, count): half-overlapping frames in runs; a run reads into the next by half a frame."""
    hop = nfft // 2
    total = F.when(F.col("num_samples") >= nfft, F.floor((F.col("num_samples") - nfft) / hop) + 1).otherwise(F.lit(0)).cast("long")
    rows = recordings.select("record_id", "data_path", "datatype", total.alias("total")).where("total > 0")
    rows = rows.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(frames).cast("long"))))
    rows = rows.withColumn("frames", F.least(F.lit(frames).cast("long"), F.col("total") - F.col("first")))
    return rows.withColumns({"start": F.col("first") * hop, "count": (F.col("frames") - 1) * hop + nfft})


def spectrogram(runs: DataFrame, read: READ, nfft: int, rows: int = 64, cols: int = 72) -> DataFrame:
    """(record_id, row, col, db): the largest magnitude, in dB, of each pixel of each recording, row 0 the highest frequency.

    ``runs``: of :func:`frame_runs`. A pixel is the maximum over its bins and frames, so tasks send pixels and maxima merge; what comes
    together for a recording is rows times columns, whatever its length. Fewer bins or frames than pixels give fewer pixels.
    """
    hop, scale = nfft // 2, taper(PERIODIC, nfft).sum()
    rows = min(rows, nfft)
    cuts = np.arange(rows) * nfft // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                wide = min(cols, r["total"])
                best: dict[int, np.ndarray] = {}
                for a in range(0, r["frames"], TOGETHER):
                    n = min(TOGETHER, r["frames"] - a)
                    i, q = read(r["data_path"], r["datatype"], r["start"] + a * hop, (n - 1) * hop + nfft)
                    frames = np.lib.stride_tricks.sliding_window_view(i.astype(np.float64) + 1j * q, nfft)[::hop][:n]
                    power = power_spectra(frames, PERIODIC)[:, ::-1]
                    pixels = np.maximum.reduceat(power, cuts, axis=1)
                    col = ((r["first"] + a + np.arange(n) + 1) * wide - 1) // r["total"]
                    for c in np.unique(col):
                        most = pixels[col == c].max(axis=0)
                        best[int(c)] = np.maximum(best[int(c)], most) if int(c) in best else most
                yield pa.RecordBatch.from_arrays([pa.array([r["record_id"]] * len(best)), pa.array(list(best), pa.int32()), _lists(np.stack(list(best.values())))], names=["record_id", "col", "power"])

    parts = runs.mapInArrow(run, "record_id string, col int, power array<double>")
    each = parts.select("record_id", "col", F.posexplode("power").alias("row", "power"))
    merged = each.groupBy("record_id", "row", "col").agg(F.max("power").alias("power"))
    return merged.select("record_id", "row", "col", (20 * F.log10(F.sqrt("power") / float(scale) + 1e-12)).alias("db"))


def power_levels(recordings: DataFrame, read: READ, start: int = 0, buckets: int = 60) -> DataFrame:
    """(record_id, bucket, db): mean power of the blocks in each of ``buckets`` stretches of each recording."""
    step = TOGETHER * BLOCK
    rows = recordings.where(F.col("num_samples") > 0).select("record_id", "data_path", "datatype", "num_samples", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("num_samples") - 1, F.lit(step).cast("long"))).alias("chunk", "start"))
    rows = rows.withColumns({"count": F.least(F.lit(step).cast("long"), F.col("num_samples") - F.col("start")), "start": F.col("start") + start})
    each = read_powers(rows.repartition("record_id", "chunk"), read).select("record_id", "chunk", F.posexplode("powers").alias("k", "value"))
    each = each.select("record_id", (F.col("chunk") * TOGETHER + F.col("k")).alias("ord"), "value")
    n = recordings.select("record_id", F.floor(F.col("num_samples") / BLOCK).alias("n"))
    return pool(each.join(n, "record_id"), buckets, "mean").select("record_id", "bucket", power_db("value").alias("db"))
