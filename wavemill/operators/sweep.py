"""Interval join of windows and annotations by a sorted sweep.

Windows' centres and both ends of every annotation lie on one line for each recording. Sorted by (recording, sample), a running sum of
+1 at starts and -1 at ends says how many annotations hold a centre, and a running sum of their labels' numbers
is the label itself where exactly one does. So no window meets an annotation, and the cost is that of a sort,
however many annotations overlap. The line is cut into ranges of equal rows, whichever recordings they belong to; what is open at
a cut is the sum over the ranges before it in the same recording, carried in by a table with a row for each
range and recording.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.operators import order
from wavemill.operators.labels import _outcomes, usable

#: Labels that are joined back by broadcast, at most; more are joined by shuffle.
BROADCAST_LABELS = 100_000
SUMS = ("_open", "_code")


def label_windows_sweep(
    windows: DataFrame, annotations: DataFrame, exclude: Sequence[str] | None = None, keep_unlabeled: bool = False, ranges: int | None = None
) -> DataFrame:
    """What :func:`wavemill.operators.labels.label_windows` returns, for recordings with any number of windows and annotations.

    ``windows``: record_id, window_ix, centre. Annotations hold the samples from their start to before their end; those with a
    null start hold none, and windows without a record_id or centre are unmatched.
    """
    good = usable(annotations, exclude).where("sample_start is not null and record_id is not null").select("record_id", "label", "sample_start", "sample_count")
    names = good.select("label").distinct()
    names = order.places(names, ["label"], 1 if names.isEmpty() else None).select((F.col("place") + 1).alias("code"), F.col("label").alias("_label"))
    small = names.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    coded = good.join(F.broadcast(names) if small else names, F.col("label") == F.col("_label")).select(
        "record_id", "sample_start", (F.col("sample_start") + F.col("sample_count")).alias("sample_end"), "code"
    )
    # Ends and starts come before the centres at the same sample.
    end = lambda c, sign: F.struct(F.col(c).cast("long").alias("sample"), F.lit(sign).cast("long").alias("_open"), (F.col("code") * sign).cast("long").alias("_code"))
    ends = coded.select("record_id", F.explode(F.array(end("sample_start", 1), end("sample_end", -1))).alias("e")).select(
        "record_id", "e.sample", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("window_ix"), "e._open", "e._code"
    )
    zero = F.lit(0).cast("long")
    centres = windows.select("record_id", F.col("centre").cast("long").alias("sample"), F.lit(1).alias("kind"), F.col("window_ix").cast("long").alias("window_ix"), zero.alias("_open"), zero.alias("_code"))
    line = order.ranges(ends.unionByName(centres), ["record_id", "sample", "kind", "window_ix"], ranges)
    carried = line.groupBy("record_id", "_part").agg(*[F.sum(s).alias(s) for s in SUMS])
    carried = order.before(carried, SUMS, "record_id").select("record_id", "_part", *[F.col(s).alias(f"{s}_before") for s in SUMS])
    within = Window.partitionBy("record_id", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = line.withColumns({s: F.sum(s).over(within) for s in SUMS}).where("kind = 1")
    met = swept.join(carried.withColumnRenamed("record_id", "_r").withColumnRenamed("_part", "_p"), F.col("record_id").eqNullSafe(F.col("_r")) & (F.col("_part") == F.col("_p")), "left")
    total = {s: F.when(F.col("record_id").isNull() | F.col("sample").isNull(), 0).otherwise(F.col(s) + F.coalesce(f"{s}_before", F.lit(0))) for s in SUMS}
    found = met.select("record_id", "window_ix", total["_open"].cast("long").alias("matches"), F.when(total["_open"] == 1, total["_code"]).alias("_only"))
    out = found.join(F.broadcast(names) if small else names, F.col("_only") == F.col("code"), "left")
    return _outcomes(out.select("record_id", "window_ix", "matches", F.col("_label").alias("only")), keep_unlabeled)
