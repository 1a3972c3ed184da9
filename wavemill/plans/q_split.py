"""Queries: allocation, splits and their checks, counts and paired statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavemill.operators import split, stats
from wavemill.plans.catalogue import query, table
from wavemill.plans.standin import ORDER_UNITS, RATIOS, SEED, order_split, order_units, split_sql

OS = f"{ORDER_UNITS}, {split_sql('ou', 'sp')}"


@query("largest_remainder", f"with {OS} select label, n, c0, c1, c2 from sp_c")
def largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    return split.allocate(order_units(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")), RATIOS)


@query("stratified_split", f"with {OS} select unit, label, split from sp")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return order_split(spark, d).select("unit", "label", "split")


@query(
    "stratified_split_windows",
    f"""with {OS} select split, label, count(distinct unit) recordings, count(*) windows, round(avg(l_quantity), 6) mean_quantity
from sp join lineitem on l_orderkey = unit group by 1, 2""",
)
def stratified_split_windows(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg(F.count(F.lit(1)).alias("w"), F.sum("l_quantity").alias("q"))
    met = order_split(spark, d).join(per, "unit")
    return met.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("recordings"), F.sum("w").alias("windows"), F.round(F.sum("q") / F.sum("w"), 6).alias("mean_quantity")
    )


CUST = """cnt as (select o_custkey, o_orderpriority, count(*) n from orders group by 1, 2),
cu as (select o_custkey unit, arg_min(o_orderpriority, row(-n, o_orderpriority)) label from cnt group by 1)"""


def _customers(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(F.col("o_custkey").alias("unit")).agg(F.min_by("o_orderpriority", F.struct(-F.col("n"), F.col("o_orderpriority"))).alias("label"))


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("unit"))
    return split.grouped_split(records.join(_customers(spark, d), "unit"), RATIOS, SEED)


@query("grouped_split", f"with {CUST}, {split_sql('cu', 'g')} select o_orderkey record_id, g.unit, g.label, split from orders join g on g.unit = o_custkey")
def grouped_split(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d).select("record_id", "unit", "label", "split")


@query("split_invariants", f"with {CUST}, {split_sql('cu', 'g')}, r as (select g.unit, split from orders join g on g.unit = o_custkey) select unit, count(distinct split) splits from r group by 1 having count(distinct split) > 1")
def split_invariants(spark: SparkSession, d: str) -> DataFrame:
    return split.split_violations(_grouped(spark, d), "unit")


@query("split_violations", f"with {OS} select o_custkey, count(distinct split) splits from sp join ou on ou.unit = sp.unit group by 1 having count(distinct split) > 1")
def split_violations(spark: SparkSession, d: str) -> DataFrame:
    return split.split_violations(order_split(spark, d), "o_custkey")


@query("mixed_units", "select o_custkey unit, case when min(o_orderstatus) = max(o_orderstatus) then min(o_orderstatus) else '(mixed)' end as value from orders group by 1")
def mixed_units(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderstatus").alias("value"))
    return split.unit_balance_values(o)


@query("unit_class_conflicts", "select conv_id unit, count(distinct role) classes, count(*) records from conversations group by 1 having count(distinct role) > 1")
def unit_class_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return split.unit_class_conflicts(table(spark, d, "conversations").select(F.col("conv_id").alias("unit"), F.col("role").alias("label")))


BALANCED = f"""{OS},
bal_k as (select *, row_number() over (partition by label, o_orderstatus order by md5('{SEED}:' || label || ':' || unit), unit) k,
  count(*) over (partition by label, o_orderstatus) n, ('0x' || substr(md5('{SEED}:' || o_orderstatus), 1, 8))::bigint / 4294967296.0::double u from ou),
bal_r as (select *, row_number() over (partition by label order by cast(least(floor((k - u) / n * 1099511627776.0::double), 1099511627775) as bigint),
  md5('{SEED}:' || o_orderstatus), md5('{SEED}:' || label || ':' || unit), unit) rn from bal_k),
bal as (select unit, r.label, o_orderstatus, case when rn <= c0 then 'train' when rn <= c0 + c1 then 'val' else 'test' end split from bal_r r join sp_c c on c.label = r.label)"""


@query("balanced_split", f"with {BALANCED} select * from bal")
def balanced_split(spark: SparkSession, d: str) -> DataFrame:
    return split.balanced_split(order_units(spark, d), RATIOS, SEED, "o_orderstatus").select("unit", "label", "o_orderstatus", "split")


@query("balanced_split_sizes", f"with {BALANCED} select label, o_orderstatus, split, count(*) n from bal group by all")
def balanced_split_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Units of each class and value in each split: its share of the class, less or more than one."""
    return balanced_split(spark, d).groupBy("label", "o_orderstatus", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "shortcut_groups",
    f"""with {OS}, r as (select sp.split, sp.label, o_orderstatus g from sp join ou on ou.unit = sp.unit),
p as (select split, g, count(distinct label) k from r group by 1, 2), w as (select split, count(*) records, count(distinct label) labels from r group by 1)
select w.split, records, labels, records >= 2 and labels >= 2 and not coalesce((select max(k) from p where p.split = w.split) = labels, false) shortcut from w""",
)
def shortcut_groups(spark: SparkSession, d: str) -> DataFrame:
    return split.shortcut_groups(order_split(spark, d), "o_orderstatus")


@query(
    "unseen_groups",
    f"with {OS}, p as (select distinct split, o_custkey from sp join ou on ou.unit = sp.unit) select split, o_custkey from p where split <> 'train' and o_custkey not in (select o_custkey from p where split = 'train')",
)
def unseen_groups(spark: SparkSession, d: str) -> DataFrame:
    return split.unseen_groups(order_split(spark, d), "o_custkey")


@query("balance_warnings", "select count(*) records, count(distinct o_orderkey) \"groups\", case when count(distinct o_orderkey) <= 1 then 'one value: balancing has no effect' when count(distinct o_orderkey) = count(*) then 'every record has its own value: balancing means nothing' end warning from orders")
def balance_warnings(spark: SparkSession, d: str) -> DataFrame:
    return split.balance_warnings(table(spark, d, "orders"), "o_orderkey")


LW = """lw as (select l_orderkey record_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 window_ix from lineitem)"""


def _line_windows(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record_id"), (F.row_number().over(w) - 1).alias("window_ix"))
    s = order_split(spark, d).select(F.col("unit").alias("record_id"), "label", "split")
    return rows.join(s, "record_id")


@query(
    "window_level_deal",
    f"""with {OS}, {LW}, w as (select record_id, window_ix, label, split from lw join sp on unit = record_id),
t as (select count(*) n, count(*) filter (where split = 'train') a, count(*) filter (where split = 'val') b from w),
c as (select label, cast(round_even(count(*) * any_value(a) / any_value(t.n), 0) as bigint) ca, cast(round_even(count(*) * any_value(b) / any_value(t.n), 0) as bigint) cb from w, t group by 1),
k as (select *, row_number() over (partition by label order by md5('42:' || label || ':' || record_id || ':' || window_ix), record_id || ':' || window_ix) rn from w),
z as (select k.label, record_id, case when rn <= ca then 'train' when rn <= ca + cb then 'val' else 'test' end split from k join c on c.label = k.label)
select label, split, count(*) n, cast(sum(record_id) as bigint) checksum from z group by 1, 2""",
)
def window_level_deal(spark: SparkSession, d: str) -> DataFrame:
    dealt = split.window_level_deal(_line_windows(spark, d), SEED)
    return dealt.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("record_id").alias("checksum"))


# -- counts

GRID = """o as (select o_orderpriority a, o_orderstatus b, count(*) n from orders group by 1, 2),
grid as (select x.a, y.b, coalesce(o.n, 0) observed, x.n * y.n / (select cast(sum(n) as bigint) from o) expected
from (select a, cast(sum(n) as bigint) n from o group by 1) x cross join (select b, cast(sum(n) as bigint) n from o group by 1) y left join o on o.a = x.a and o.b = y.b)"""


@query("contingency", f"with {GRID} select a o_orderpriority, b o_orderstatus, observed, round(expected, 6) expected from grid")
def contingency(spark: SparkSession, d: str) -> DataFrame:
    return stats.contingency(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus").withColumn("expected", F.round("expected", 6))


@query("independence_deviation", f"with {GRID} select round(max(abs(observed - expected)), 6) deviation from grid")
def independence_deviation(spark: SparkSession, d: str) -> DataFrame:
    return stats.independence_deviation(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus").select(F.round("deviation", 6).alias("deviation"))


@query(
    "class_distribution",
    "with c as (select event_type, count(*) n from events group by 1) select event_type, n, round(n / (select sum(n) from c), 9) share, round((select max(n) from c) / (select sum(n) from c), 9) chance from c",
)
def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    out = stats.class_distribution(table(spark, d, "events"), "event_type")
    return out.withColumns({c: F.round(c, 9) for c in ("share", "chance")})


@query(
    "split_histogram",
    f"with {OS} select label, count(*) filter (where split = 'train') train, count(*) filter (where split = 'val') val, count(*) filter (where split = 'test') test from sp group by 1",
)
def split_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.split_histogram(order_split(spark, d))


@query(
    "offset_signs",
    f"""with {OS}, r as (select split, c_acctbal o from sp join ou on ou.unit = sp.unit join customer on c_custkey = o_custkey)
select split, count(*) filter (where o < 0) negative, count(*) filter (where o >= 0) positive,
least(count(*) filter (where o < 0), count(*) filter (where o >= 0)) = 0 and count(o) > 1 one_sided from r group by 1""",
)
def offset_signs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("offset"))
    return stats.offset_signs(order_split(spark, d).join(c, "o_custkey"), "offset")


RUNS = """runs as (select o_custkey % 5 split_seed, o_orderkey % 3 train_seed, case when o_orderstatus = 'F' then 'recording' else 'window' end strategy, avg(o_totalprice) / 1e6 test_accuracy
from orders where not (o_custkey % 5 = 4 and o_orderkey % 3 = 2 and o_orderstatus = 'F') group by 1, 2, 3)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("not (o_custkey % 5 = 4 and o_orderkey % 3 = 2 and o_orderstatus = 'F')")
    strategy = F.when(F.col("o_orderstatus") == "F", "recording").otherwise("window")
    return o.groupBy((F.col("o_custkey") % 5).alias("split_seed"), (F.col("o_orderkey") % 3).alias("train_seed"), strategy.alias("strategy")).agg(
        (F.avg("o_totalprice") / 1e6).alias("test_accuracy")
    )


@query(
    "paired_inflation",
    f"""with {RUNS}, p as (select split_seed, train_seed, max(test_accuracy) filter (where strategy = 'recording') r, max(test_accuracy) filter (where strategy = 'window') w from runs group by 1, 2)
select count(*) n, round(avg(r), 9) recording_mean, round(avg(w), 9) window_mean, round(avg(w - r), 9) inflation, round(stddev_samp(w - r), 9) sd, round(stddev_samp(w - r) / sqrt(count(*)), 9) se from p where r is not null and w is not null""",
)
def paired_inflation(spark: SparkSession, d: str) -> DataFrame:
    out = stats.paired_inflation(_runs(spark, d))
    return out.select("n", *[F.round(c, 9).alias(c) for c in out.columns if c != "n"])


@query(
    "seed_spread",
    f"""with {RUNS}, r as (select * from runs where strategy = 'window'), p as (select split_seed, avg(test_accuracy) m, stddev_samp(test_accuracy) s from r group by 1)
select (select count(*) from r) n, (select round(avg(test_accuracy), 9) from r) mean, (select round(stddev_samp(test_accuracy), 9) from r) sd, (select round(min(test_accuracy), 9) from r) low,
(select round(max(test_accuracy), 9) from r) high, round(stddev_samp(m), 9) between_sd, round(avg(s), 9) within_sd, case when stddev_samp(m) > avg(s) then 'split seed' else 'training seed' end dominant from p""",
)
def seed_spread(spark: SparkSession, d: str) -> DataFrame:
    out = stats.seed_spread(_runs(spark, d).where("strategy = 'window'"))
    return out.select("n", "dominant", *[F.round(c, 9).alias(c) for c in ("mean", "sd", "low", "high", "between_sd", "within_sd")])
