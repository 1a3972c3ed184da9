"""Places of rows in an order, running sums over it, and seeded permutations of places: none of them in one task.

Rows are dealt by ranges of their order and written to the shared folder (``spark.checkpoint.dir``), so that what is computed
from a row's place doesn't change if an executor is lost. Each range is numbered, or summed, by itself; a table with a row for each range and group
shifts it by what lies before.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROUNDS = 4


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint; only a local session may lack a folder for it."""
    context = df.sparkSession.sparkContext
    if not (context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()):
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="wavemill-"))
    return df.checkpoint(eager=True)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranges(df: DataFrame, keys: Sequence[str], n: int | None = None) -> DataFrame:
    """``df`` in ``n`` ranges of ``keys``, sorted and settled, with ``_at``, which grows along the order, and ``_part``, the range."""
    dealt = df.repartitionByRange(n or parts(df.sparkSession), *keys).sortWithinPartitions(*keys)
    return settle(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))


def before(table: DataFrame, sums: Sequence[str], group: str) -> DataFrame:
    """``table`` (``group``, ``_part``, sums: a row for each group of a range) with the sums over the group's ranges before."""
    w = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumns({s: F.coalesce(F.sum(s).over(w), F.lit(0)) for s in sums})


def places(df: DataFrame, order: Sequence[str], n: int | None = None) -> DataFrame:
    """``df`` with ``place``, each row's number from 0 by ``order``, settled in that order."""
    rows = ranges(df, order, n).withColumn("_all", F.lit(0))
    shifts = before(rows.groupBy("_all", "_part").agg(F.count(F.lit(1)).alias("_before")), ["_before"], "_all")
    shifts = F.broadcast(shifts.select("_part", "_before"))  # a row for each range
    place = (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).cast("long")
    return rows.join(shifts, "_part").select(*df.columns, place.alias("place"))


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _walk(x: np.ndarray, n: int, seed: int, epoch: int, back: bool) -> np.ndarray:
    if n <= 1:
        return np.zeros(len(x), np.int64)
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    base = int(_mix(np.array([seed & 0xFFFFFFFF], np.uint64), 0x9E3779B97F4A7C15 + 0x1000003 * epoch)[0])
    x = np.asarray(x, np.int64).astype(np.uint64)
    todo = np.arange(len(x))
    keys = [base + 0x632BE59BD9B4E019 * (r + 1) for r in range(ROUNDS)]
    while len(todo):
        left, right = x[todo] >> half, x[todo] & mask
        for key in reversed(keys) if back else keys:
            left, right = (right ^ (_mix(left, key) & mask), left) if back else (right, left ^ (_mix(right, key) & mask))
        x[todo] = (left << half) | right
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def permute(place: np.ndarray, n: int, seed: int, epoch: int = 0) -> np.ndarray:
    """The position of each place of 0 .. n-1 in the order of ``epoch``: a permutation by arithmetic alone.

    A Feistel network over the next even number of bits, walked on until the result is below ``n``, which takes
    fewer than four steps on average.
    """
    return _walk(place, n, seed, epoch, back=False)


def unpermute(position: np.ndarray, n: int, seed: int, epoch: int = 0) -> np.ndarray:
    """The place at each position: :func:`permute` backwards."""
    return _walk(position, n, seed, epoch, back=True)


def position(place: Column | str, n: int, seed: int, epoch: int = 0) -> Column:
    """:func:`permute` as a column."""

    @F.pandas_udf("long")
    def run(p: pd.Series) -> pd.Series:
        return pd.Series(permute(p.to_numpy(), n, seed, epoch))

    return run(place)
