"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import string
import tempfile
from collections.abc import Callable, Iterator, Sequence
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Narrow rows that are sent to every executor, at most (some 60 MB); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
T = TypeVar("T")
#: Rows of narrow links that a task takes when rounds of contraction get small.
ROWS_A_TASK = 50_000
#: Parts of a shuffle that narrow rows keep at least.
NARROW_PARTS = 32
#: Links that are few enough for one task to finish their components, counted in both directions.
LAST_LINKS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a local one is set if Spark runs in this machine alone; on a cluster that is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="wavemill-")
        context.setCheckpointDir(found)
    return found


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def settle_narrow(df: DataFrame) -> DataFrame:
    """:func:`settle` for rows of a few numbers: in fewer and larger files where the shuffle has very many parts.

    It keeps NARROW_PARTS of them, and an eighth of more, so tasks stay as many as the input asks for.
    """
    slots = task_slots(df.sparkSession)
    return settle(df.coalesce(max(min(slots, NARROW_PARTS), slots // 8)))


def broadcast_if_small(df: DataFrame) -> DataFrame | None:
    """``df`` (settled before) marked for broadcast, if it has at most BROADCAST_ROWS rows; else None."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else None


def skew_safe_left_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` left join ``groups`` (one narrow row per ``key``), safe when one key holds a third of the rows.

    Few groups are broadcast whole. Of many, those with at least a thousandth of all rows number at most a
    thousand, so they are broadcast; what is left has no hot key and joins by shuffle.
    """
    groups = settle_narrow(groups)
    if (small := broadcast_if_small(groups)) is not None:
        return rows.join(small, key, "left")
    hot = F.col(size) * F.lit(1000) >= F.lit(max(total, 1))
    carried = [c for c in groups.columns if c != key]
    few = groups.where(hot).select(F.col(key), *[F.col(c).alias(f"_hot_{c}") for c in carried])
    many = groups.where(~hot).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_many_{c}") for c in carried])
    out = rows.join(F.broadcast(few), key, "left")
    cold = F.when(F.col(f"_hot_{size}").isNull(), F.col(key))  # null joins nothing
    out = out.withColumn("_cold", cold).join(many, F.col("_cold") == F.col("_key"), "left")
    return out.select(*rows.columns, *[F.coalesce(f"_hot_{c}", f"_many_{c}").alias(c) for c in carried])


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold at most ``rows`` rows in this session, unless it is set lower.

    Spark's own default counts rows only, ten thousand, however long their texts are.
    """
    if int(spark.conf.get(BATCH_ROWS)) > rows:
        spark.conf.set(BATCH_ROWS, str(rows))


_held: dict[tuple, object] = {}


def fresh_worker() -> None:
    """Drop what an operator before has left in this Python worker, and give the memory back to the system."""
    _held.clear()
    give_back()


def give_back() -> None:
    """Return memory that this Python worker doesn't use to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def held_in_worker(make: Callable[..., T], *args) -> T:
    """``make(*args)``, kept in this Python worker until another operator asks for something else.

    Workers are used again by later stages; so what one operator remembers doesn't add up with the next one's.
    """
    key = (make, *args)
    if key not in _held:
        fresh_worker()
        _held[key] = make(*args)
    return _held[key]


def text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def apply_decisions(docs: DataFrame, decisions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns and no other.

    ``decisions``: ``id_col``, ``_text_key`` (of :func:`text_key`) and ``kept``, a row for each row of
    ``docs``. Of rows that share id and text, and of which one is kept, the one whose columns together
    have the smallest hash stays; rows alike in all columns are the same row. Columns of ``docs`` may have any name:
    they stay in one struct beside names of this function's own. The only wide shuffle is one
    join on (id, text key), which has no hot value unless whole rows repeat; rows that need no
    action are not on its right side.
    """
    acts = (
        decisions.groupBy(F.col(id_col).alias("id"), F.col("_text_key").alias("tk"))
        .agg(F.max("kept").alias("any"), F.count(F.lit(1)).alias("n"))
        .where(~F.col("any") | (F.col("n") > 1))
        .select("id", "tk", "any")
    )
    acts = settle_narrow(acts)
    small = broadcast_if_small(acts)
    right = (acts if small is None else small).select(F.struct("id", "tk", "any").alias("act"))
    left = docs.select(F.col(id_col).alias("row_id"), text_key(text_col).alias("row_tk"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    met = left.join(right, F.col("row_id").eqNullSafe(F.col("act.id")) & (F.col("row_tk") == F.col("act.tk")), "left")
    plain = met.where(F.col("act").isNull()).select("row")
    single = met.where(F.col("act.any")).groupBy("row_id", "row_tk").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return plain.unionByName(single).select("row.*")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, to) of all nodes of a bounded number of links (u, v), by union-find."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            up[root(u)] = root(v)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["x", "to"])


def components(edges: DataFrame, max_rounds: int = 80) -> DataFrame:
    """Connected components by randomised contraction: (node, root), for nodes that have an edge.

    ``edges``: long columns ``u`` and ``v``. Each round every node takes the neighbour (or itself)
    with the smallest hash of that round, edges are renamed and those within one node dropped, so
    the nodes shrink by a constant factor a round whatever the shape. Neighbours are reduced with
    ``min``, which combines before the shuffle; nothing is collected. When LAST_LINKS or fewer are
    left, one task joins them. Roots are some node of the component, not its smallest.
    """
    slots = task_slots(edges.sparkSession)
    both = edges.where(F.col("u") != F.col("v")).select("u", "v")
    both = settle_narrow(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    names = both.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node"))
    for i in range(max_rounds):
        n = both.count()
        if n <= LAST_LINKS:
            last = both.coalesce(1).mapInArrow(_finish, "x long, to long")
            return settle_narrow(names.join(last, F.col("root") == F.col("x"), "left").select("node", F.coalesce("to", "root").alias("root")))
        parts = max(1, min(slots, -(-n // ROWS_A_TASK)))
        rank = lambda c: F.struct(F.xxhash64(F.lit(i), F.col(c)).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        step = settle(
            both.groupBy("u").agg(F.least(F.min(rank("v")), F.min(rank("u")))["x"].alias("to")).select(F.col("u").alias("x"), "to").coalesce(parts)
        )
        names = names.join(step, F.col("root") == F.col("x"), "left").select("node", F.coalesce("to", "root").alias("root"))
        if i % 4 == 3:
            names = settle(names)
        a, b = step.select(F.col("x").alias("u"), F.col("to").alias("a")), step.select(F.col("x").alias("v"), F.col("to").alias("b"))
        met = both.join(a, "u").join(b, "v").where(F.col("a") != F.col("b"))
        both = settle(met.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct().coalesce(parts))
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def task_slots(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def places(df: DataFrame, order: Sequence[str], group: str | None = None) -> DataFrame:
    """``df`` with ``place``, each row's number from 0 in the order of some columns, and ``n``, how many rows there are; both within ``group``.

    Rows are dealt by ranges of (group, order), so that a group of any size takes as many tasks as its rows need; each range is
    numbered by itself and shifted by the rows of its group before it. The table of shifts has a row for each group of a
    range. ``df`` should be cheap to read twice; ``order`` tells rows apart, or rows alike may change places; groups aren't null.
    """
    keys = [*([group] if group else []), *order]
    dealt = df.repartitionByRange(task_slots(df.sparkSession), *keys).sortWithinPartitions(*keys)
    dealt = settle(dealt.withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33)).withColumn("_group", F.col(group) if group else F.lit(0))
    parts = settle_narrow(dealt.groupBy("_group", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")))
    whole = Window.partitionBy("_group")
    before = F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = parts.select("_group", "_part", F.col("_first"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("n"))
    shifts = settle_narrow(shifts)
    small = broadcast_if_small(shifts)
    met = dealt.join(shifts if small is None else small, ["_group", "_part"])
    return met.withColumn("place", F.col("_at") - F.col("_first") + F.col("_before")).select(*df.columns, "place", "n")
