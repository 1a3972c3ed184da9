"""Queries: pairs, leakage checks, decision, duplicates, classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.operators import audit, decide, measure, similarity
from wavemill.plans.catalogue import query, table
from wavemill.plans.standin import ORDER_UNITS, RATIOS, SEED, SPANS, order_split, seconds, spans, split_sql, vectors

OS = f"{ORDER_UNITS}, {split_sql('ou', 'sp')}"


def _sep(source: str, name: str, value: str) -> str:
    """CTE ``name``: n, accuracy and chance of the nearest other row of ``source`` (idx, label, value)."""
    return f"""{name} as (select count(*) n, avg((lab = label)::int) accuracy, (select max(c) / sum(c) from (select count(*) c from {source} where {value} is not null group by label)) chance
from (select a.idx, any_value(a.label) label, arg_min(b.label, row(abs(a.{value} - b.{value}), b.idx)) lab from {source} a join {source} b on a.idx <> b.idx where a.{value} is not null and b.{value} is not null group by 1))"""


CU = "c as (select c_custkey idx, c_mktsegment label, c_acctbal v, c_nationkey::double w from customer)"


@query("nn_separability", f"with {CU}, {_sep('c', 's', 'w')} select n, round(accuracy, 9) accuracy, round(chance, 9) chance from s")
def nn_separability(spark: SparkSession, d: str) -> DataFrame:
    out = audit.separability(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_custkey")
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("accuracy", "chance")])


def _scores(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("v"), F.col("c_nationkey").cast("double").alias("w"))
    return audit.axis_scores(c, (("v", "balance"), ("w", "nation")), idx="idx")


AX = f"""{CU}, {_sep('c', 's0', 'v')}, {_sep('c', 's1', 'w')}, ax as (select 0 ord, 'balance' axis, * from s0 union all select 1, 'nation', * from s1)"""


@query("axis_scores", f"with {AX} select cast(ord as integer) ord, axis, n, round(accuracy, 9) accuracy, round(chance, 9) chance, round(accuracy - chance, 9) margin from ax")
def axis_scores(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    return s.select("ord", "axis", "n", *[F.round(c, 9).alias(c) for c in ("accuracy", "chance", "margin")])


@query(
    "axis_verdict",
    f"""with {AX}, b as (select * from ax order by accuracy - chance desc, ord limit 1)
select case when accuracy >= 0.95 and accuracy > chance then 'ceiling' else 'unknown' end verdict, axis, round(accuracy - chance, 9) margin from b""",
)
def axis_verdict(spark: SparkSession, d: str) -> DataFrame:
    return audit.verdict(_scores(spark, d)).withColumn("margin", F.round("margin", 9))


PAIRS = f"""{SPANS}, pr as (select a.record_id a, b.record_id b from spans a join spans b on b.start < a."end" and (a.start, a."end", a.record_id) < (b.start, b."end", b.record_id))"""


@query("air_time_overlap", f"with {PAIRS} select a, b from pr")
def air_time_overlap(spark: SparkSession, d: str) -> DataFrame:
    return audit.overlapping_pairs(spans(spark, d))


@query(
    "adjacent_overlap",
    f"""with {SPANS}, n as (select user_id, record_id a, "end" e, lead(record_id) over w b, lead(start) over w s from spans window w as (partition by user_id order by start, "end", record_id))
select user_id, a, b from n where s < e""",
)
def adjacent_overlap(spark: SparkSession, d: str) -> DataFrame:
    return audit.adjacent_overlaps(spans(spark, d), ("user_id",))


NEAR = f"""{SPANS}, nr as (select a.label, a.record_id a, b.record_id b from spans a join spans b on a.label = b.label and a.record_id <> b.record_id and b.start >= a."end" and b.start <= a."end" + 121
where b.start - a."end" between 0 and 120 and a."end" - a.start >= 1 and b."end" - b.start >= 1
and abs((a."end" - a.start) - (b."end" - b.start)) <= 0.1::double * greatest(a."end" - a.start, b."end" - b.start))"""


@query("near_duplicates", f"with {NEAR} select * from nr")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return audit.near_duplicates(spans(spark, d))


@query(
    "pairs_apart",
    f"""with {PAIRS} select p.a, p.b from pr p join events x on x.event_id = p.a join events y on y.event_id = p.b where x.user_id % 7 is distinct from y.user_id % 7""",
)
def pairs_apart(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d).where("record_id is not null").withColumn("unit", F.col("user_id") % 7)
    return audit.overlapping_pairs_apart(s, s, "unit")


@query("shared_timestamp", "select epoch_us(o_orderdate) / 1e6 as start, count(distinct o_orderpriority) classes, count(*) records from orders group by 1 having count(distinct o_orderpriority) > 1")
def shared_timestamp(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(seconds(F.col("o_orderdate")).alias("start"), F.col("o_orderpriority").alias("label"))
    return audit.shared_stamps(o)


@query("collection_members", f"""with {OS}, c as (select o_custkey, count(distinct split) k from sp join ou on ou.unit = sp.unit group by 1)
select case when count(*) filter (where k > 1) > 0 then 'RISK' else 'PASS/sample' end status, 'collection members' as "check",
count(*) filter (where k > 1) || ' of ' || count(*) || ' collections in more than one split' detail from c""")
def collection_members(spark: SparkSession, d: str) -> DataFrame:
    return audit.check_collections(order_split(spark, d).withColumn("collection", F.col("o_custkey").cast("string")))


@query("duplicate_digests", "with f as (select sha256(text) h, min(doc_id) m, count(*) n from documents where text is not null group by 1) select doc_id record_id, m same_as from documents join f on h = sha256(text) where n > 1 and doc_id <> m")
def duplicate_digests(spark: SparkSession, d: str) -> DataFrame:
    return audit.duplicates(table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.sha2("text", 256).alias("digest")), "digest")


@query("partial_digest", "select doc_id, sha256(cast(strlen(text) as varchar) || text) digest from documents where text is not null")
def partial_digest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", audit.partial_digest(F.encode("text", "UTF-8")).alias("digest"))


@query("fingerprint", "select substr(sha256(string_agg(p_name || ':' || p_size || chr(10), '' order by p_brand || '/' || lpad(p_partkey::varchar, 9, '0') || '/' || p_name)), 1, 8) fingerprint from part")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    path = F.concat_ws("/", "p_brand", F.lpad(F.col("p_partkey").cast("string"), 9, "0"), "p_name")
    return audit.fingerprint(p.select(path.alias("path"), F.col("p_size").alias("size")))


UNITS = """n as (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings),
u as (select vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) e from n)"""
SIMILAR = f"""{UNITS},
s as (select a.vec_id id, b.vec_id other, round(abs(list_inner_product(a.e, b.e)), 9) s from u a join u b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id)"""


def _similar(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose id is divisible by 100 against all."""
    e = table(spark, d, "embeddings")
    return similarity.similarities(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding")


@query("twin_similarity", f"with {UNITS}, s as (select round(abs(list_inner_product(a.e, b.e)), 9) s from u a join u b on a.vec_id < b.vec_id) select round(max(s), 6) top, round(avg(s), 6) mean, count(*) filter (where s > 0.999) twins from s")
def twin_similarity(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of vectors, each once."""
    return similarity.all_pairs(table(spark, d, "embeddings"), "vec_id", "embedding").select(F.round("top", 6).alias("top"), F.round("mean", 6).alias("mean"), "twins")


@query(
    "nearest_similarity",
    f"""with {SIMILAR}, h as (select id, list(c order by k) histogram from (select q.id, k, count(s.id) c from (select distinct id from s) q cross join (select unnest(range(0, 20)) k) left join s on s.id = q.id and least(cast(floor(s * 20) as bigint), 19) = k group by 1, 2) group by 1)
select id, arg_min(other, (-s, other)) nearest, round(max(s), 6) top, round(avg(s), 6) mean, count(*) pairs, count(*) filter (where s > 0.999) twins, array_to_string(any_value(histogram), ',') histogram from s join h using (id) group by 1""",
)
def nearest_similarity(spark: SparkSession, d: str) -> DataFrame:
    bars = F.array_join(F.transform("histogram", lambda x: x.cast("string")), ",").alias("histogram")
    return _similar(spark, d).select("id", "nearest", F.round("top", 6).alias("top"), F.round("mean", 6).alias("mean"), "pairs", "twins", bars)


@query(
    "window_overlap_leaks",
    """with w as (select user_id record_id, (row_number() over (partition by user_id order by ts, event_id) - 1) * 4 as start, event_type split from events)
select a.record_id, a.start, b.start next_start from w a join w b on a.record_id = b.record_id and b.start > a.start and b.start < a.start + 16 and a.split <> b.split""",
)
def window_overlap_leaks(spark: SparkSession, d: str) -> DataFrame:
    """A window of 16 at a stride of 4: each window overlaps three behind it. Event types stand in for splits."""
    from wavemill.plans.standin import samples, table

    kind = table(spark, d, "events").select("event_id", F.col("event_type").alias("split"))
    w = samples(spark, d).join(kind, "event_id").select("record_id", (F.col("ord") * 4).alias("start"), "split")
    return audit.window_overlap_leaks(w, 16)


# -- whole reports: customers as recordings, on air from their first order for ten minutes

RECS = f"""cu as (select c_custkey unit, c_mktsegment label from customer), {split_sql('cu', 'cs')},
st as (select o_custkey, epoch_us(min(o_orderdate)) / 1e6 as start from orders group by 1),
rc as (select unit idx, cs.label, cs.split, start, start + 600 "end", c_nationkey coll, c_acctbal v, c_nationkey::double w from cs join customer on c_custkey = unit left join st on o_custkey = unit),
ap as (select x.split <> y.split apart from rc x join rc y on y.start < x."end" and (x.start, x."end", x.idx) < (y.start, y."end", y.idx) where abs(x.start - y.start) <= 600),
sh as (select start, count(distinct label) k, count(distinct split) s from rc where start is not null group by 1)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    from wavemill.operators.split import stratified_split

    s = stratified_split(c.select(F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("label")), RATIOS, SEED)
    start = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(F.min(seconds(F.col("o_orderdate"))).alias("start"))
    more = c.select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").cast("string").alias("collection"), F.col("c_acctbal").alias("v"), F.col("c_nationkey").cast("double").alias("w"))
    out = s.join(more, "unit").join(start, "unit", "left").withColumn("end", F.col("start") + 600)
    return out.withColumnRenamed("unit", "record_id").withColumns({"sample_rate": F.lit(1e6), "occupied_bw_hz": F.lit(None).cast("double")})


REPORT_AXES = (("v", "balance"), ("w", "nation"))


@query(
    "audit_report",
    f"""with {RECS}, {_sep('rc', 's0', 'v')}, {_sep('rc', 's1', 'w')}, {_sep('rc', 's2', 'start')}
select 0 ord, 'PASS/proof' status, 'recording disjointness' as "check"
union all select 1, 'PASS/proof', 'cross-split overlap'
union all select 2, case when count(*) filter (where apart) > 0 then 'LEAK' when count(*) > 0 then 'PASS/proof' else 'PASS/sample' end, 'shared air time' from ap
union all select 3, case when count(*) filter (where k > 1) = 0 then 'PASS/sample' when min(s) < (select count(distinct split) from rc where start is not null) then 'RISK' else 'PASS/sample' end, 'shared timestamp' from sh
union all select 4, case when count(*) filter (where k > 1) > 0 then 'RISK' else 'PASS/sample' end, 'collection members' from (select coll, count(distinct split) k from rc group by 1)
union all select 5, case when accuracy >= 0.9 and accuracy > chance then 'RISK' else 'PASS/sample' end, 'axis: balance' from s0
union all select 5, case when accuracy >= 0.9 and accuracy > chance then 'RISK' else 'PASS/sample' end, 'axis: nation' from s1
union all select 6, case when accuracy >= 0.9 then 'RISK' else 'PASS/sample' end, 'axis: capture time' from s2
union all select 7, 'NOT CHECKED', 'in-band SNR' union all select 8, 'NOT CHECKED', 'task difficulty'""",
)
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit_dataset(_records(spark, d), 1024, 512, REPORT_AXES).select("ord", "status", "check")


@query("audit_folder")
def audit_folder(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).drop("split").withColumns({"error": F.lit(None).cast("string"), "digest": F.sha2(F.col("record_id").cast("string"), 256), "carrier_offset_hz": F.col("v"), "mean_power_db": F.col("w")})
    r = r.withColumns({c: F.lit(None).cast("double") for c in ("duration_samples", "duty_cycle", "burst_start_frac")})
    return audit.audit_folder(r, 1024, 512)


@query("decision", "select 'REFUSED' status, cast(2 as integer) category, 'shared timestamp' reason")
def decision(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    found = audit.report([audit.check_disjoint(r), audit.check_shared_timestamp(r, built=False), audit.check_air_time(r)])
    scores = audit.axis_scores(r, REPORT_AXES)
    none = r.where("false").select("record_id")
    return decide.decide(found, audit.verdict(scores), none, none, none).drop("forced_past")


@query(
    "decision_cases",
    """with f as (select o_orderdate folder, max(o_totalprice) < 50000 unreadable, count(*) > count(distinct o_custkey) stamps, bool_or(o_orderpriority = '1-URGENT' and o_orderstatus = 'P') near,
  count(*) > 1 and min(o_orderstatus) = max(o_orderstatus) and min(o_orderpriority) = '2-HIGH' ceiling, max(o_totalprice) > 420000 leak, bool_or(o_orderstatus = 'P' and o_totalprice < 60000) unheld, count(*) < 4 short,
  day(o_orderdate) % 2 = 0 grouped, month(o_orderdate) = 12 built, day(o_orderdate) < 15 has_features, count(*) = 1 empty, day(o_orderdate) % 10 = 0 force from orders group by 1),
c as (select *, case when unreadable then 1 when stamps then 2 when near and not grouped then 3 when ceiling then 4 when leak or unheld then 5 when built and not has_features then null when short then 6 end category from f),
s as (select *, case when category is not null then 'REFUSED' when built and not has_features or empty then 'INCONCLUSIVE' else 'WOULD MEASURE' end s0,
  case category when 1 then 'unreadable' when 2 then 'shared timestamp' when 3 then 'near duplicates' when 4 then 'ceiling' when 5 then 'leak the grouping does not hold' when 6 then 'too few units' end reason from c)
select folder, case when force then 'WOULD MEASURE' else s0 end status, category, reason,
  case when force and s0 <> 'WOULD MEASURE' then case when category = 4 then 'audit verdict ' || chr(39) || 'ceiling' || chr(39) when category is not null then 'category ' || category || ' ' || chr(39) || reason || chr(39) else 'an INCONCLUSIVE audit' end end forced_past from s""",
)
def decision_cases(spark: SparkSession, d: str) -> DataFrame:
    """A decision for each day of orders, whose orders set the flags, so that every category and every way past it occurs."""
    p, st, pr, day = F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.dayofmonth("folder")
    flags = table(spark, d, "orders").groupBy(F.col("o_orderdate").alias("folder")).agg(
        (F.max(p) < 50000).alias("unreadable"), (F.count(F.lit(1)) > F.countDistinct("o_custkey")).alias("stamps"), F.max((pr == "1-URGENT") & (st == "P")).alias("near"),
        ((F.count(F.lit(1)) > 1) & (F.min(st) == F.max(st)) & (F.min(pr) == "2-HIGH")).alias("ceiling"), (F.max(p) > 420000).alias("leak"), F.max((st == "P") & (p < 60000)).alias("unheld"),
        (F.count(F.lit(1)) < 4).alias("short"), (F.count(F.lit(1)) == 1).alias("empty"),
    )
    more = {"grouped": day % 2 == 0, "built": F.month("folder") == 12, "has_features": day < 15, "force": day % 10 == 0}
    return decide.classify(flags.withColumns(more))


@query("predicted_windows", "with w as (select cast(sum(case when n < 3 then 0 else (n - 3) // 2 + 1 end) as bigint) windows from (select count(*) n from lineitem group by l_orderkey)) select windows, cast(round_even(windows * 0.7::double, 0) as bigint) train, cast(round_even(windows * 0.15::double, 0) as bigint) test from w")
def predicted_windows(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("num_samples"))
    return decide.predicted_windows(n, 3, 2, RATIOS)


@query("baseline_classifier")
def baseline_classifier(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select("record_id", "label", "i", "q")
    return measure.train_and_evaluate(v.withColumn("split", F.when(F.col("record_id") % 5 == 0, "test").otherwise("train")), seed=0)
