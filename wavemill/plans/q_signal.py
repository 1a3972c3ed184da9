"""Queries: arrays and spectra over embeddings, envelopes and pooling over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.operators import signal, spectrum, windows
from wavemill.plans.catalogue import query, table
from wavemill.plans.standin import EV, VECTORS, samples, vectors

UNIT = f"""{VECTORS}, p as (select record_id, i, q, list_sum(list_transform(range(1, 33), lambda k: i[k] * i[k] + q[k] * q[k])) / 32 p from vec),
u as (select record_id, unnest(range(0, 32)) k, i, q, case when p > 0 then 1 / sqrt(p) else 0 end s from p)"""


def _flat(df: DataFrame, a: str, b: str) -> DataFrame:
    """record_id, k, a, b of two arrays, rounded so that sums in another order agree."""
    z = df.select("record_id", F.posexplode(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y"))).alias("k", "z"))
    return z.select("record_id", "k", (F.round("z.x", 5) + 0.0).alias(a), (F.round("z.y", 5) + 0.0).alias(b))


@query("normalize_unit_power", f"with {UNIT} select record_id, cast(k as integer) k, round(i[k + 1] * s, 5) + 0.0 i, round(q[k + 1] * s, 5) + 0.0 q from u")
def normalize_unit_power(spark: SparkSession, d: str) -> DataFrame:
    return _flat(windows.normalize(vectors(spark, d)), "i", "q")


@query("repr_iq2ch", f"with {UNIT} select record_id, cast(k as integer) k, round(i[k + 1], 5) + 0.0 row0, round(q[k + 1], 5) + 0.0 row1 from u")
def repr_iq2ch(spark: SparkSession, d: str) -> DataFrame:
    x = windows.represent(vectors(spark, d), "iq2ch")
    return _flat(x.select("record_id", F.get("x", F.lit(0)).alias("row0"), F.get("x", F.lit(1)).alias("row1")), "row0", "row1")


@query(
    "repr_magphase",
    f"with {UNIT} select record_id, cast(k as integer) k, round(sqrt(i[k + 1] * i[k + 1] + q[k + 1] * q[k + 1]), 5) + 0.0 row0, round(atan2(q[k + 1], i[k + 1]), 5) + 0.0 row1 from u",
)
def repr_magphase(spark: SparkSession, d: str) -> DataFrame:
    x = windows.represent(vectors(spark, d), "magphase")
    return _flat(x.select("record_id", F.get("x", F.lit(0)).alias("row0"), F.get("x", F.lit(1)).alias("row1")), "row0", "row1")


@query("slice_windows", f"with {VECTORS} select record_id, w window_ix, w * 4 as start, round(list_sum(list_slice(i, w * 4 + 1, w * 4 + 8)), 5) + 0.0 sum_i from (select *, unnest(range(0, 7)) w from vec)")
def slice_windows(spark: SparkSession, d: str) -> DataFrame:
    w = windows.slice_windows(vectors(spark, d), 8, 4)
    total = F.aggregate("i", F.lit(0.0), lambda a, x: a + x)
    return w.select("record_id", "window_ix", "start", (F.round(total, 5) + 0.0).alias("sum_i"))


ENV = f"""{EV}, env as (select record_id, ord // 8 as block, avg(value * value) power from ev group by 1, 2 having count(*) = 8),
db as (select *, 10 * log10(power + 1e-30) db from env),
sp as (select record_id, min(db) lo, max(db) hi from db group by 1 having count(*) >= 2),
mask as (select db.record_id, block, power, db, case when hi - lo < 6 then true else db > lo + 0.35::double * (hi - lo) end active from db join sp on sp.record_id = db.record_id)"""


def _mask(spark: SparkSession, d: str) -> DataFrame:
    return signal.active_mask(_envelope(spark, d))


def _envelope(spark: SparkSession, d: str) -> DataFrame:
    return signal.power_envelope(samples(spark, d), 8, F.col("value") * F.col("value"))


@query("power_envelope", f"with {ENV} select record_id, block, round(power, 7) power from env")
def power_envelope(spark: SparkSession, d: str) -> DataFrame:
    return _envelope(spark, d).withColumn("power", F.round("power", 7))


@query("active_mask", f"with {ENV} select record_id, block, round(db, 6) db, active from mask")
def active_mask(spark: SparkSession, d: str) -> DataFrame:
    return _mask(spark, d).select("record_id", "block", F.round("db", 6).alias("db"), "active")


@query(
    "duty_cycle",
    f"with {ENV} select record_id, round(avg(active::int), 9) duty_cycle, round(min(block) filter (where active) / count(*), 9) burst_start_frac from mask group by 1",
)
def duty_cycle(spark: SparkSession, d: str) -> DataFrame:
    out = signal.duty_cycle(_mask(spark, d))
    return out.select("record_id", *[F.round(c, 9).alias(c) for c in ("duty_cycle", "burst_start_frac")])


DFT = f"""{VECTORS}, s as (select record_id, unnest(range(0, 32)) n, i, q from vec),
x as (select record_id, n, i[n + 1] a, q[n + 1] b from s), kk as (select unnest(range(0, 32)) k),
dft as (select record_id, k, power(sum(a * cos(2 * pi() * k * n / 32) + b * sin(2 * pi() * k * n / 32)), 2) + power(sum(b * cos(2 * pi() * k * n / 32) - a * sin(2 * pi() * k * n / 32)), 2) pw
  from x, kk group by 1, 2)"""


@query("dft_power", f"with {DFT} select record_id, cast(k as integer) as bin, round(pw, 3) power from dft")
def dft_power(spark: SparkSession, d: str) -> DataFrame:
    return signal.dft_power(vectors(spark, d), 32).withColumn("power", F.round("power", 3))


@query(
    "occupied_band",
    f"""with {DFT}, m as (select record_id, avg(pw) mp from dft group by 1), e as (select d.record_id, (k + 16) % 32 as bin, greatest(pw - mp, 0) ex from dft d join m on m.record_id = d.record_id),
c as (select *, sum(ex) over (partition by record_id order by bin rows unbounded preceding) / sum(ex) over (partition by record_id) f from e)
select record_id, round((sum(bin * ex) / sum(ex) - 16) * 1000 / 32, 4) offset_hz,
round(greatest(1, min(bin) filter (where f >= (1 + 0.99::double) / 2) - min(bin) filter (where f >= (1 - 0.99::double) / 2) + 1) * 1000 / 32, 4) bandwidth_hz from c group by 1""",
)
def occupied_band(spark: SparkSession, d: str) -> DataFrame:
    p = spectrum.spectra(vectors(spark, d), 32)
    mean = F.aggregate("power", F.lit(0.0), lambda s, x: s + x) / 32
    out = p.withColumn("_m", mean).select("record_id", spectrum.band_of(F.transform("power", lambda x: F.greatest(x - F.col("_m"), F.lit(0.0))), 1000.0).alias("b"))
    return out.select("record_id", F.round("b.offset_hz", 4).alias("offset_hz"), F.round("b.bandwidth_hz", 4).alias("bandwidth_hz"))


GATED = """g as (select event_id // 2048 record_id, event_id % 2048 // 64 as block, event_id % 64 n, case when event_id // 256 % 2 = 0 then 10 else 1 end g, value, event_id % 100 c from events),
x as (select record_id, block, n, g * value a, (g * c)::double b, g * g * (value * value + c * c) p from g),
env as (select record_id, block, avg(p) power from x group by 1, 2 having count(*) = 64),
db as (select *, 10 * log10(power + 1e-30) db from env), sp as (select record_id, min(db) lo, max(db) hi from db group by 1 having count(*) >= 2),
mask as (select db.record_id, block, case when hi - lo < 6 then true else db > lo + 0.35::double * (hi - lo) end active from db join sp on sp.record_id = db.record_id),
w as (select record_id, block, active, n, a * (0.5 - 0.5 * cos(2 * pi() * n / 63)) a, b * (0.5 - 0.5 * cos(2 * pi() * n / 63)) b from x join mask using (record_id, block)),
kk as (select unnest(range(0, 64)) k),
f as (select record_id, block, active, k, power(sum(a * cos(2 * pi() * k * n / 64) + b * sin(2 * pi() * k * n / 64)), 2) + power(sum(b * cos(2 * pi() * k * n / 64) - a * sin(2 * pi() * k * n / 64)), 2) pw from w, kk group by 1, 2, 3, 4),
m as (select record_id, active, (k + 32) % 64 as bin, count(*) blocks, avg(pw) pw from f group by 1, 2, 3)"""


def _gated(spark: SparkSession, d: str) -> DataFrame:
    """Mean Hann spectra of active and idle 64-sample blocks of events, as the audit has them of recordings.

    Events by number are the samples of recordings 2048 long, in bursts of 256.
    """
    e, g = F.col("event_id"), F.when(F.expr("event_id div 256") % 2 == 0, 10).otherwise(1)
    x = table(spark, d, "events").select(F.expr("event_id div 2048").alias("record_id"), (e % 2048).alias("ord"), (g * F.col("value")).alias("a"), (g * (e % 100)).cast("double").alias("b"))
    mask = signal.active_mask(signal.power_envelope(x, 64, F.col("a") * F.col("a") + F.col("b") * F.col("b"))).select("record_id", "block", "active")
    blocks = x.groupBy("record_id", F.floor(F.col("ord") / 64).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("ord", "a", "b"))).alias("z"))  # 64 rows
    blocks = blocks.join(mask, ["record_id", "block"]).select("record_id", "active", F.transform("z", lambda s: s["a"]).alias("i"), F.transform("z", lambda s: s["b"]).alias("q"))
    return spectrum.merged(spectrum.gated_sums(blocks, 64), 64)


@query("hann_periodogram", f"with {GATED} select record_id, active, cast(bin as integer) as bin, blocks, round(log10(pw + 1), 6) level from m")
def hann_periodogram(spark: SparkSession, d: str) -> DataFrame:
    out = _gated(spark, d).select("record_id", "active", "blocks", F.posexplode("power").alias("bin", "p"))
    return out.select("record_id", "active", "bin", "blocks", F.round(F.log10(F.col("p") + 1), 6).alias("level"))


@query(
    "gated_band",
    f"""with {GATED}, e as (select n.record_id, n.bin, greatest(n.pw - o.pw, 0) ex from m n join m o on n.active and not o.active and n.record_id = o.record_id and n.bin = o.bin),
c as (select *, sum(ex) over (partition by record_id order by bin rows unbounded preceding) / sum(ex) over (partition by record_id) f from e)
select record_id, round((sum(bin * ex) / sum(ex) - 32) * 1000 / 64, 4) offset_hz,
round(greatest(1, min(bin) filter (where f >= (1 + 0.99::double) / 2) - min(bin) filter (where f >= (1 - 0.99::double) / 2) + 1) * 1000 / 64, 4) bandwidth_hz from c group by 1""",
)
def gated_band(spark: SparkSession, d: str) -> DataFrame:
    out = spectrum.excess(_gated(spark, d)).select("record_id", spectrum.band_of("excess", 1000.0).alias("b"))
    return out.select("record_id", F.round("b.offset_hz", 4).alias("offset_hz"), F.round("b.bandwidth_hz", 4).alias("bandwidth_hz"))


def _pool(how: str) -> str:
    return f"""with {EV}, r as (select e.record_id, e.ord, e.value, num_samples n from ev e join rec on rec.record_id = e.record_id),
down as (select record_id, ((ord + 1) * 60 - 1) // n as bucket, {how}(value) v from r where n > 60 group by 1, 2),
up as (select record_id, unnest(range(cast(ceil(ord * 60 / n) as bigint), cast(ceil((ord + 1) * 60 / n) as bigint))) as bucket, value v from r where n <= 60)
select record_id, bucket, round(v, 6) as value from (select * from down union all select * from up)"""


def _pooled(spark: SparkSession, d: str, how: str) -> DataFrame:
    rows = samples(spark, d)
    n = rows.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
    return signal.pool(rows.join(n, "record_id"), 60, how).withColumn("value", F.round("value", 6))


@query("max_pool", _pool("max"))
def max_pool(spark: SparkSession, d: str) -> DataFrame:
    return _pooled(spark, d, "max")


@query("mean_pool", _pool("avg"))
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    return _pooled(spark, d, "mean")


@query("percentile_clip", "select round(quantile_cont(value, 0.05), 6) low, round(quantile_cont(value, 0.99), 6) high from events")
def percentile_clip(spark: SparkSession, d: str) -> DataFrame:
    out = signal.percentile_clip(table(spark, d, "events"))
    return out.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(
    "half_power_edges",
    f"""with {DFT}, sh as (select record_id, (k + 16) % 32 x, pw from dft), l as (select record_id, (quantile_cont(pw, 0.1) + quantile_cont(pw, 0.9)) / 2 th from sh group by 1),
w as (select sh.record_id, x, pw, th, lag(x) over (partition by sh.record_id order by x) px, lag(pw) over (partition by sh.record_id order by x) pp from sh join l on l.record_id = sh.record_id)
select record_id, round(min(px + (th - pp) / (pw - pp) * (x - px)) filter (where pp <= th and pw > th), 5) rise, round(max(px + (th - pp) / (pw - pp) * (x - px)) filter (where pp > th and pw <= th), 5) fall from w group by 1""",
)
def half_power_edges(spark: SparkSession, d: str) -> DataFrame:
    s = signal.dft_power(vectors(spark, d), 32).select("record_id", signal.shifted_bin("bin", 32).alias("x"), "power")
    out = signal.half_power_edges(s)
    return out.select("record_id", F.round("rise", 5).alias("rise"), F.round("fall", 5).alias("fall"))


@query("processing_gain", "select round(median(10 * log10(1e6 / p_retailprice)), 6) gain_db, count(*) recordings from part where p_retailprice > 0")
def processing_gain(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.lit(1e6).alias("sample_rate"), F.col("p_retailprice").alias("occupied_bw_hz"))
    return signal.processing_gain(rows).withColumn("gain_db", F.round("gain_db", 6))


@query(
    "declared_band",
    f"""with a as (select p_brand record_id, p_retailprice lo, p_retailprice + p_size hi from part where p_type not like 'PROMO%')
select record_id, round(median((lo + hi) / 2 - 1000), 6) offset_hz, round(median(hi - lo), 6) bandwidth_hz from a group by 1""",
)
def declared_band(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    label = F.when(F.col("p_type").startswith("PROMO"), "ref_tone")
    a = part.select(F.col("p_brand").alias("record_id"), label.alias("label"), F.col("p_retailprice").alias("freq_lower_edge"), (F.col("p_retailprice") + F.col("p_size")).alias("freq_upper_edge"))
    out = signal.declared_band(a, part.select(F.col("p_brand").alias("record_id"), F.lit(1000.0).alias("center_frequency")).distinct())
    return out.select("record_id", F.round("offset_hz", 6).alias("offset_hz"), F.round("bandwidth_hz", 6).alias("bandwidth_hz"))


@query("sample_chunks", f"""with {EV}, p as (select record_id, num_samples n, unnest(range(0, case when num_samples <= 40 then 1 else 4 end)) k from rec)
select record_id, cast(k as integer) as chunk, case when n <= 40 then 0 else k * ((n - 8) // 3 // 4 * 4) end as start, cast(case when n <= 40 then n else 8 end as bigint) as "count" from p""")
def sample_chunks(spark: SparkSession, d: str) -> DataFrame:
    from wavemill.plans.standin import recordings

    return signal.sample_chunks(recordings(spark, d), limit=40, chunks=4, block=4)


@query("band_power", f"with {DFT}, sh as (select record_id, (k + 16) % 32 x, pw from dft) select record_id, round(10 * log10(sum(pw) + 1e-12), 5) band_db from sh where x between 8 and 23 group by 1")
def band_power(spark: SparkSession, d: str) -> DataFrame:
    s = signal.dft_power(vectors(spark, d), 32).select("record_id", signal.shifted_bin("bin", 32).alias("x"), "power")
    return signal.band_power(s, 8, 23).withColumn("band_db", F.round("band_db", 5))


@query("active_span", f"with {ENV} select record_id, min(block) first, max(block) as last from mask where active group by 1")
def active_span(spark: SparkSession, d: str) -> DataFrame:
    return signal.active_span(_mask(spark, d))


@query(
    "frame_segments",
    f"""with {EV}, f as (select record_id, min(ord) o from ev where label = 'purchase' group by 1), s as (select r.record_id, greatest(o - 4, 0) s, num_samples n from f join rec r on r.record_id = f.record_id)
select record_id, s as start, least(40, n - s) as "count" from s where least(40, n - s) >= 10""",
)
def frame_segments(spark: SparkSession, d: str) -> DataFrame:
    from wavemill.plans.standin import recordings

    first = samples(spark, d).where("label = 'purchase'").groupBy("record_id").agg(F.min("ord").alias("offset"))
    return signal.frame_segments(recordings(spark, d), first, 40, 4, 10)
