"""Fixed-length windows over recordings: counting, starts, contents, normalisation, representations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.functions.columns import centre, window_count


def check_params(window: int, stride: int) -> None:
    if window <= 0:
        raise ValueError(f"window must be positive, not {window}")
    if stride <= 0:
        raise ValueError(f"stride must be positive, not {stride}")


def window_counts(recordings: DataFrame, window: int, stride: int) -> DataFrame:
    """``recordings`` (num_samples, ...) with ``windows``. Needs no samples."""
    check_params(window, stride)
    return recordings.withColumn("windows", window_count("num_samples", window, stride))


def window_starts(recordings: DataFrame, window: int, stride: int, keys: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """A row for each window: keys, window_ix, start, centre. Narrow: rows are generated where the recording is."""
    check_params(window, stride)
    starts = F.when(F.col("num_samples") >= window, F.sequence(F.lit(0).cast("long"), F.col("num_samples") - window, F.lit(stride).cast("long")))
    return recordings.select(*keys, F.posexplode(starts).alias("window_ix", "start")).select(
        *keys, F.col("window_ix").cast("long").alias("window_ix"), "start", centre("start", window).alias("centre")
    )


def windows_of_samples(samples: DataFrame, recordings: DataFrame, window: int, stride: int) -> DataFrame:
    """``samples`` (record_id, ord, ...) with each whole window they are in: window_ix.

    A sample knows its windows by arithmetic, so there is no range join; a recording of any length is
    parted by (record_id, window_ix) in what follows. ``recordings`` (record_id, num_samples) tells which
    windows are whole.
    """
    check_params(window, stride)
    first = F.greatest(F.ceil((F.col("ord") - window + 1) / stride), F.lit(0))
    last = F.floor(F.col("ord") / stride)
    spread = samples.join(recordings.select("record_id", "num_samples"), "record_id")
    last = F.least(last, window_count("num_samples", window, stride) - 1)
    return (
        spread.withColumn("_ix", F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))))
        .withColumn("window_ix", F.explode("_ix"))
        .drop("_ix", "num_samples")
    )


def slice_windows(recordings: DataFrame, window: int, stride: int, i: str = "i", q: str = "q") -> DataFrame:
    """Windows of recordings held as arrays: record_id, window_ix, start, i, q. No shuffle."""
    check_params(window, stride)
    starts = window_starts(recordings.withColumn("num_samples", F.size(i).cast("long")), window, stride, ("record_id", i, q))
    at = (F.col("start") + 1).cast("int")
    return starts.select("record_id", "window_ix", "start", F.slice(i, at, window).alias("i"), F.slice(q, at, window).alias("q"))


def mean_power(i: Column | str, q: Column | str) -> Column:
    i, q = (F.col(x) if isinstance(x, str) else x for x in (i, q))
    squares = F.zip_with(i, q, lambda a, b: a.cast("double") * a + b.cast("double") * b)
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x) / F.size(i)


def normalize(windows: DataFrame) -> DataFrame:
    """Unit mean power in each window; a window without power becomes zeros."""
    p = windows.withColumn("_p", mean_power("i", "q"))
    scale = F.when(F.col("_p") > 0, 1 / F.sqrt("_p")).otherwise(F.lit(0.0))
    p = p.withColumn("_s", scale)
    return p.withColumns({c: F.transform(c, lambda x: x * F.col("_s")) for c in ("i", "q")}).drop("_p", "_s")


def represent(windows: DataFrame, kind: str) -> DataFrame:
    """``x``: two rows of values (``iq2ch``: i and q; ``magphase``: magnitude and angle), or a struct (``complex``)."""
    if kind == "iq2ch":
        x = F.array("i", "q")
    elif kind == "complex":
        x = F.struct("i", "q")
    elif kind == "magphase":
        x = F.array(F.zip_with("i", "q", lambda a, b: F.sqrt(a * a + b * b)), F.zip_with("q", "i", lambda b, a: F.atan2(b, a)))
    else:
        raise ValueError(f"unknown representation {kind!r}: use iq2ch, complex or magphase")
    return windows.withColumn("x", x)


def deinterleave(values: Column | str) -> tuple[Column, Column]:
    """i and q of an interleaved array."""
    v = F.col(values) if isinstance(values, str) else values
    half = F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1)
    return F.transform(half, lambda k: F.get(v, 2 * k)), F.transform(half, lambda k: F.get(v, 2 * k + 1))
