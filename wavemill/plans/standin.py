"""The test tables as recordings, samples, annotations and spans; SQL twins beside each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavemill.operators import split
from wavemill.plans.catalogue import table

WINDOW, STRIDE, SEED = 16, 8, 42
RATIOS = (0.7, 0.15, 0.15)

EV = """ev as (select user_id record_id, event_type label, value, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 ord from events),
rec as (select record_id, count(*) num_samples from ev group by 1),
ann as (select record_id, ord sample_start, 1 + cast(floor(value / 100) as bigint) sample_count, label from ev),
win as (select record_id, w window_ix, w * 8 as start, w * 8 + 8 centre from (select record_id, unnest(range(0, case when num_samples < 16 then 0 else (num_samples - 16) // 8 + 1 end)) w from rec)),
lab as (select w.record_id, w.window_ix, count(a.label) matches, min(a.label) label0 from win w left join ann a
        on a.record_id = w.record_id and centre >= sample_start and centre < sample_start + sample_count group by 1, 2),
labeled as (select record_id, window_ix, case when matches = 1 then label0 end label,
            case when matches = 1 then 'labeled' when matches = 0 then 'unmatched' else 'ambiguous' end outcome, matches from lab)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user in time order: record_id, ord, value, label, event_id."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(
        F.col("user_id").alias("record_id"), (F.row_number().over(w) - 1).cast("long").alias("ord"), "value", F.col("event_type").alias("label"), "event_id"
    )


def recordings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("record_id")).agg(F.count(F.lit(1)).alias("num_samples"))


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """An annotation for each event, some longer than others, so that windows have none, one or several."""
    count = (F.floor(F.col("value") / 100) + 1).cast("long").alias("sample_count")
    return samples(spark, d).select("record_id", F.col("ord").alias("sample_start"), count, "label")


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / 1e6


SPANS = """spans as (select event_id record_id, user_id, event_type label, epoch_us(ts) / 1e6 as start, epoch_us(ts) / 1e6 + value as "end" from events)"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    start = seconds(F.col("ts"))
    return table(spark, d, "events").select(F.col("event_id").alias("record_id"), "user_id", F.col("event_type").alias("label"), start.alias("start"), (start + F.col("value")).alias("end"))


def split_sql(source: str, name: str, unit: str = "unit", label: str = "label", ratios: tuple[float, ...] = RATIOS, seed: int = SEED) -> str:
    """CTEs that end in ``name`` (unit, label, split): the stratified split of ``source`` (unit, label)."""
    r0, r1, r2 = (f"cast({r} as double)" for r in ratios)
    return f"""{name}_n as (select {label} label, count(*) n from {source} group by 1),
{name}_f as (select *, n * {r0} - floor(n * {r0}) q0, n * {r1} - floor(n * {r1}) q1, n * {r2} - floor(n * {r2}) q2,
  cast(floor(n * {r0}) as bigint) b0, cast(floor(n * {r1}) as bigint) b1, cast(floor(n * {r2}) as bigint) b2 from {name}_n),
{name}_c as (select label, n,
  b0 + cast((q1 > q0)::int + (q2 > q0)::int < n - b0 - b1 - b2 as bigint) c0,
  b1 + cast((q0 >= q1)::int + (q2 > q1)::int < n - b0 - b1 - b2 as bigint) c1,
  b2 + cast((q0 >= q2)::int + (q1 >= q2)::int < n - b0 - b1 - b2 as bigint) c2 from {name}_f),
{name} as (select u.{unit} unit, u.{label} label, case when rn <= c0 then 'train' when rn <= c0 + c1 then 'val' else 'test' end split
  from (select *, row_number() over (partition by {label} order by md5('{seed}:' || {label} || ':' || {unit}), {unit}) rn from {source}) u join {name}_c c on c.label = u.{label})"""


ORDER_UNITS = "ou as (select o_orderkey unit, o_orderpriority label, o_custkey, o_orderstatus from orders)"


def order_units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("label"), "o_custkey", "o_orderstatus")


def order_split(spark: SparkSession, d: str) -> DataFrame:
    return split.stratified_split(order_units(spark, d), RATIOS, SEED)


VECTORS = """vec as (select vec_id record_id, list_transform(range(0, 32), lambda k: embedding[2 * k + 1]::double) i, list_transform(range(0, 32), lambda k: embedding[2 * k + 2]::double) q, label from embeddings)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 32 interleaved complex samples."""
    from wavemill.operators.windows import deinterleave

    i, q = deinterleave("embedding")
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("record_id"), i.cast("array<double>").alias("i"), q.cast("array<double>").alias("q"), "label"
    )
