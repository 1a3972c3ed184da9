"""Built datasets: windows as Parquet by split, with a manifest; reading, item access, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.operators import order
from wavemill.operators.split import SPLITS
from wavemill.sources.tables import read_manifest

SHARD_BYTES = 256 << 20


class DatasetError(ValueError):
    """A dataset that isn't what its manifest says."""


def numbered(windows: DataFrame) -> DataFrame:
    """``windows`` with ``item``, their place from 0 in the split by (record_id, window_ix).

    Keys alone are dealt by ranges and numbered there, so neither a split nor a recording is ordered in one task. It belongs before
    samples are read; rows that have them are shuffled once more.
    """
    keys = ["split", "record_id", "window_ix"]
    rows = order.ranges(windows.select(*keys), keys)
    per = rows.groupBy("split", "_part").agg(F.count(F.lit(1)).alias("_before"), F.min("_at").alias("_first"))
    shift = order.before(per, ["_before"], "split").select("split", "_part", "_before", "_first")
    found = rows.join(F.broadcast(shift), ["split", "_part"]).select(*keys, (F.col("_at") - F.col("_first") + F.col("_before")).alias("item"))  # a row for each range and split
    return windows.join(found, keys)


def item_files(rows: DataFrame, n: int, files: int | None = None) -> DataFrame:
    """``rows`` (split, item, ...) in tasks of ``n`` consecutive items of a split, in item order: a task for each, or ``files`` in all."""
    sizes = {r.split: r.n for r in rows.groupBy("split").agg((F.max("item") + 1).alias("n")).collect()}
    first, at = {}, 0
    for s in SPLITS:
        first[s] = at
        at += -(-sizes.get(s, 0) // n)
    piece = F.floor(F.col("item") / n) + F.coalesce(*[F.when(F.col("split") == s, F.lit(first[s])) for s in SPLITS])
    tasks = max(1, at)
    if files:
        piece, tasks = F.floor(piece * min(files, tasks) / tasks), min(files, tasks)
    return rows.repartitionById(tasks, piece.cast("int")).sortWithinPartitions("split", "item")


def write_dataset(windows: DataFrame, root: str, bytes_per_window: int, files: int | None = None) -> None:
    """Parquet by split, in item order within files of at most about 256 MiB; an empty split gives no file."""
    n = max(1, SHARD_BYTES // max(1, bytes_per_window))
    rows = windows if "item" in windows.columns else numbered(windows)
    dealt = item_files(rows, n, files)
    dealt.write.mode("errorifexists").option("maxRecordsPerFile", n).partitionBy("split").parquet(f"{root.rstrip('/')}/windows")


def read_dataset(spark: SparkSession, root: str, split: str | None = None, verify: bool = True) -> DataFrame:
    """Windows of one split or all. Counts must be the manifest's; an empty or unknown split raises."""
    if split is not None and split not in SPLITS:
        raise DatasetError(f"unknown split {split!r}: use one of {', '.join(SPLITS)}")
    rows = spark.read.parquet(f"{root.rstrip('/')}/windows")
    if split is not None:
        rows = rows.where(F.col("split") == split)
    if verify:
        told = read_manifest(spark, root)["splits"]
        want = sum(v["count"] for k, v in told.items() if split in (None, k))
        if not want:
            raise DatasetError(f"split {split or 'all'} is empty")
        if (got := rows.count()) != want:
            raise DatasetError(f"{got} windows are stored, the manifest says {want}")
    return rows


def item(spark: SparkSession, root: str, split: str, index: int):
    """One window by its place; negative places count from the end."""
    count = read_manifest(spark, root)["splits"][split]["count"]
    at = index + count if index < 0 else index
    if not 0 <= at < count:
        raise IndexError(f"{index} is outside of {split}'s {count} windows")
    return read_dataset(spark, root, split, verify=False).where(F.col("item") == at).first()


def dataset_bytes(spark: SparkSession, root: str) -> int:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.agg(F.sum("length")).first()[0] or 0
