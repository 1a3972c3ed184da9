"""Exact percentiles of a column of any size by histogram refinement: no state ever holds the values.

A pass counts values in equal buckets between the bounds of what is still open and keeps each bucket's smallest and largest value; only the
buckets that hold a wanted rank are opened in the next pass. A bucket of one distinct value is an answer, however many rows have it.
Two passes do for most columns; very uneven ones take more. Each pass counts before it shuffles and brings at most buckets times open ranks rows to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def exact_percentiles(rows: DataFrame, value: str, shares: Sequence[float], buckets: int = BUCKETS) -> list[float | None]:
    """Percentiles at ``shares`` (0 to 1) with linear interpolation between ranks, as ``percentile`` gives them; None of no values.

    Nulls, NaN and infinite values take no part.
    """
    v = F.col("v")
    usable = rows.select(F.col(value).cast("double").alias("v")).where(v.isNotNull() & ~F.isnan("v") & (F.abs(v) < math.inf))
    n, low, high = usable.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    ranks = sorted({r for s in shares for r in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))})
    found: dict[int, float] = {}
    open_ = {(low, high): (0, ranks)}  # bounds: values before them, ranks within
    if low == high:
        found, open_ = {r: low for r in ranks}, {}
    while open_:
        bounds = list(open_)

        def bucket(k: int) -> Column:
            a, b = bounds[k]  # noqa: B023
            at = F.floor((v / 2 - a / 2) / (b / 2 - a / 2) * buckets)  # halves don't overflow
            return F.when(v.between(a, b), F.struct(F.lit(k).alias("k"), F.greatest(F.lit(0), F.least(F.lit(buckets - 1), at)).cast("int").alias("at")))

        cells = usable.select("v", F.explode(F.filter(F.array(*[bucket(k) for k in range(len(bounds))]), lambda c: c.isNotNull())).alias("c"))
        counts = cells.groupBy("c.k", "c.at").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        last, open_ = open_, {}
        for k, own in enumerate(bounds):
            before, wanted = last[own]
            for r in sorted((r for r in counts if r.k == k), key=lambda r: r.at):
                inside = [w for w in wanted if before <= w < before + r.n]
                found |= {w: r.low for w in inside if r.low == r.high or w == before} | {w: r.high for w in inside if w == before + r.n - 1}
                if rest := [w for w in inside if w not in found]:
                    open_[(r.low, r.high)] = (before, rest)
                before += r.n
    at = [s * (n - 1) for s in shares]
    return [found[math.floor(x)] + (x - math.floor(x)) * (found[math.ceil(x)] - found[math.floor(x)]) for x in at]
