"""Leakage checks. Each returns findings (status, check, detail); what wasn't examined says so and never passes.

Overlap is decided from index and time ranges, never from how alike contents are. ``PROOF`` passes follow
from structure; ``SAMPLE`` passes only say that the recordings looked at showed nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions.columns import overlap_fraction
from wavemill.operators import order

LEAK, RISK, PROOF, SAMPLE, NOT_CHECKED = "LEAK", "RISK", "PASS/proof", "PASS/sample", "NOT CHECKED"
STATUSES = (LEAK, RISK, PROOF, SAMPLE, NOT_CHECKED)
#: Share of recordings that one scalar must classify to be a risk, or a ceiling.
AXIS_RISK, CEILING = 0.90, 0.95
LEAST_ROWS = 3
#: Two recordings of a class are near duplicates when at least this long (s), at most this far apart (s), and of lengths within this share.
DUPLICATE_LEAST_S, DUPLICATE_GAP_S, DUPLICATE_LENGTHS = 1.0, 120.0, 0.10
AXES = (("carrier_offset_hz", "carrier offset"), ("mean_power_db", "mean power"), ("duration_samples", "recording length"), ("duty_cycle", "burst duty cycle"), ("burst_start_frac", "burst position"))
TIME_AXIS = ("start", "capture time")
#: Spans in a block that others meet: about as many as a span overlaps, within these.
LEAST_BLOCK, MOST_BLOCK = 16, 4096


def finding(rows: DataFrame, check: str, status: Column, detail: Column) -> DataFrame:
    return rows.select(status.alias("status"), F.lit(check).alias("check"), detail.alias("detail"))


def report(findings: list[DataFrame]) -> DataFrame:
    """(ord, status, check, detail) of all checks in order."""
    placed, at = [], 0
    for f in findings:
        further = "after" in f.columns  # findings of two places
        placed.append(f.withColumn("ord", F.lit(at) + (F.col("after") if further else F.lit(0))).select("ord", "status", "check", "detail"))
        at += 1 + further
    return reduce(DataFrame.unionByName, placed)


# -- pairs


def separabilities(rows: DataFrame, values: Sequence[str], label: str, idx: str = "idx", buckets: int | None = None) -> DataFrame:
    """(ord, n, accuracy, chance) of each column of ``values`` that has rows: how many rows' nearest other row on it is of their class.

    Ties go to the lowest idx, so all rows of one value but its first have that first one as nearest: counts by (value,
    class) and the first two rows of each value are enough, and both are reduced before the shuffle, however many rows
    share a value. Values are cut into ranges of about equal size; neighbours are found within a range, and across its
    ends through a table of one row for each range. All columns go in one pass.
    """
    parts = buckets or max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = F.array(*[F.col(c).cast("double") for c in values])
    long = rows.select(F.col(idx).alias("idx"), F.col(label).alias("label"), F.posexplode(columns).alias("ord", "v")).where("v is not null")
    counts = long.groupBy("ord", "v", "label").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("ord", "v").orderBy("idx"))
    pick = lambda k: F.max(F.when(F.col("_r") == k, F.struct("idx", "label")))
    firsts = long.withColumn("_r", place).where("_r <= 2").groupBy("ord", "v").agg(pick(1).alias("f"), pick(2).alias("s"))
    cuts = {}
    if parts > 1:  # a row for each column
        at = F.percentile_approx("v", [i / parts for i in range(1, parts)], 1000)
        cuts = {r.ord: sorted(set(r.c)) for r in long.groupBy("ord").agg(at.alias("c")).collect()}
    bucket = F.lit(0)
    if cuts:
        of = F.create_map(*[x for k, c in cuts.items() for x in (F.lit(k), F.array(*map(F.lit, c)))])
        bucket = F.size(F.filter(F.element_at(of, F.col("ord")), lambda c: c <= F.col("v")))
    firsts = firsts.withColumn("b", bucket).withColumn("c", F.struct("v", "f"))
    ends = firsts.groupBy("ord", "b").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    over = Window.partitionBy("ord").orderBy("b")  # a row for each range
    ends = ends.select("ord", "b", F.lag("hi").over(over).alias("before"), F.lead("lo").over(over).alias("after"))
    w = Window.partitionBy("ord", "b").orderBy("v")
    met = firsts.join(F.broadcast(ends), ["ord", "b"]).select(
        "ord", "v", "f", "s", F.coalesce(F.lag("c").over(w), F.col("before")).alias("p"), F.coalesce(F.lead("c").over(w), F.col("after")).alias("x")
    )
    other = lambda c, d: F.when(F.col(c).isNotNull(), F.struct(d.alias("d"), F.col(f"{c}.f.idx").alias("i"), F.col(f"{c}.f.label").alias("l")))
    beside = F.array_min(F.array(other("p", F.col("v") - F.col("p.v")), other("x", F.col("x.v") - F.col("v"))))["l"]
    own = F.when(F.col("s").isNotNull(), F.col("s.label")).otherwise(beside)
    per = counts.join(met.select("ord", "v", F.col("f.label").alias("fl"), own.alias("own")), ["ord", "v"])
    hit = F.when(F.col("label") == F.col("fl"), F.col("n") - 1 + F.when(F.col("own") == F.col("label"), 1).otherwise(0)).otherwise(0)
    per = per.groupBy("ord", "label").agg(F.sum("n").alias("n"), F.sum(hit).alias("hit"))
    return per.groupBy("ord").agg(F.sum("n").alias("n"), (F.sum("hit") / F.sum("n")).alias("accuracy"), (F.max("n") / F.sum("n")).alias("chance"))


def separability(rows: DataFrame, value: str, label: str, idx: str = "idx") -> DataFrame:
    """One row: n, accuracy of the nearest other row's class, and chance, the largest class's share."""
    return separabilities(rows, (value,), label, idx).agg(*[F.max(c).alias(c) for c in ("n", "accuracy", "chance")])


def _reaches(spans: DataFrame, keys: tuple[str, ...], id_col: str) -> DataFrame:
    """(keys, id, start, end, place, upto) of each span: its number by (keys, start, end, id), and that of the first of its keys to start at or after its end.

    So the later spans that a span overlaps are those of the places between. Starts and ends lie on one line, dealt by ranges of equal
    rows; an end takes the highest place of the starts before it, in its range or carried in from the ranges before.
    """
    s = spans.select(*keys, F.col(id_col).alias("id"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, "start", "end")])
    s = order.places(s.where(known), [*keys, "start", "end", "id"])
    none = F.lit(None).cast("long")
    starts = s.select(*keys, F.col("start").alias("t"), F.lit(1).alias("kind"), "place", none.alias("of"))
    ends = s.where("end > start").select(*keys, F.col("end").alias("t"), F.lit(0).alias("kind"), none.alias("place"), F.col("place").alias("of"))
    line = order.ranges(starts.unionByName(ends), [*keys, "t", "kind", "place"])
    last = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = F.broadcast(line.groupBy("_part").agg(F.max("place").alias("_most")).select("_part", F.max("_most").over(last).alias("_before")))
    seen = F.max("place").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    met = line.withColumn("_seen", seen).where("kind = 0").join(carried, "_part")
    upto = met.select(F.col("of").alias("place"), (F.greatest("_seen", "_before") + 1).alias("upto"))
    return s.join(upto, "place", "left").select(*keys, "id", "start", "end", "place", F.coalesce("upto", "place").alias("upto"))


def _meet(reaches: DataFrame, keys: tuple[str, ...], more: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """(keys, a, b) of the pairs of :func:`_reaches`; ``where`` tells by ``x`` and ``y``, which hold ``more`` columns, those wanted.

    Spans are cut by place into blocks of about as many as a span overlaps on the average, and each meets the blocks that it reaches. So at most
    some 3 times the pairs, and LEAST_BLOCK for each span, are looked at, however the spans are spread over time.
    """
    r = order.settle(reaches)
    mean = r.agg(F.avg(F.col("upto") - F.col("place"))).first()[0] or 0
    size = int(min(max(mean, LEAST_BLOCK), MOST_BLOCK))
    held = F.struct("id", "start", "end", "place", *more)
    blocks = F.sequence(F.floor((F.col("place") + 1) / size), F.floor((F.col("upto") - 1) / size))
    a = r.where("upto > place + 1").select(*keys, held.alias("x"), "upto", F.explode(blocks).alias("_block"))
    b = r.select(F.floor(F.col("place") / size).alias("_block"), held.alias("y"))
    alike = F.col("x.id").eqNullSafe(F.col("y.id")) & (F.col("x.start") == F.col("y.start")) & (F.col("x.end") == F.col("y.end"))
    near = (F.col("y.place") > F.col("x.place")) & (F.col("y.place") < F.col("upto")) & ~alike
    met = a.hint("shuffle_merge").join(b, "_block").where(near if where is None else near & where)
    return met.select(*keys, F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def overlapping_pairs(spans: DataFrame, keys: tuple[str, ...] = (), bin_s: float | None = None, id_col: str = "record_id") -> DataFrame:
    """(keys, a, b) of all spans (start, end in seconds) that overlap, ``a`` the earlier by (start, end, id).

    By places in that order, not by bins of time: rows looked at grow with spans and pairs alone. ``bin_s`` is taken for older callers and changes nothing.
    """
    return _meet(_reaches(spans, keys, id_col), keys)


def overlapping_pairs_apart(spans: DataFrame, units: DataFrame, key: str, id_col: str = "record_id") -> DataFrame:
    """:func:`pairs_apart` of all overlapping pairs: spans are given their ``key`` before they meet, so no pair is shuffled. A pair of one ``key`` isn't made."""
    k = units.select(F.col(id_col).alias("id"), F.col(key).alias("_k"))
    return _meet(_reaches(spans, (), id_col).join(k, "id", "left"), (), ("_k",), ~F.col("x._k").eqNullSafe(F.col("y._k")))


def overlap_counts(spans: DataFrame, keys: tuple[str, ...] = (), bin_s: float = 3600.0) -> DataFrame:
    """(keys, spans, pairs): how many pairs :func:`overlapping_pairs` has of each ``keys`` value, none of them made.

    All pairs less those where one has ended before the other starts: a sum over distinct times of starts by ends so
    far. Ends are counted within time bins and shifted by the bins before. Rows alike in all columns are spans of their own.
    """
    s = spans.select(*keys, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")).where("start is not null and end is not null")
    point = (F.col("end") <= F.col("start")).cast("long")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    starts = F.struct(F.col("start").alias("t"), one.alias("s"), none.alias("e"), point.alias("z"))
    stops = F.struct(F.greatest("start", "end").alias("t"), none.alias("s"), one.alias("e"), none.alias("z"))
    times = s.select(*keys, F.explode(F.array(starts, stops)).alias("x")).groupBy(*keys, F.col("x.t").alias("t")).agg(*[F.sum(f"x.{c}").alias(c) for c in "sez"])
    times = times.withColumn("bin", F.floor(F.col("t") / bin_s))
    bins = times.groupBy(*keys, "bin").agg(F.sum("e").alias("e"))
    before = F.sum("e").over(Window.partitionBy(*keys).orderBy("bin")) - F.col("e")
    shift = bins.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("bin").alias("_bin"), before.alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("bin") == F.col("_bin"))
    ended = F.sum("e").over(Window.partitionBy(*keys, "bin").orderBy("t")) + F.col("_before")
    placed = times.join(shift, same).select(*keys, "s", "z", ended.alias("ended"))
    n, apart = F.sum("s"), F.sum(F.col("s") * F.col("ended") - F.expr("z * (z + 1) div 2"))
    return placed.groupBy(*keys).agg(n.alias("spans"), (F.expr("sum(s) * (sum(s) - 1) div 2") - apart).alias("pairs"))


def overlaps_not_held(spans: DataFrame, unit: str) -> DataFrame:
    """(pairs,): one row with how many overlapping pairs differ in ``unit``, if any do; two unknown units count as the same. None is made."""
    whole = overlap_counts(spans).agg(F.sum("pairs").alias("_all"))
    held = overlap_counts(spans, (unit,)).agg(F.sum("pairs").alias("_held"))
    n = F.coalesce("_all", F.lit(0)) - F.coalesce("_held", F.lit(0))
    return whole.crossJoin(held).select(n.cast("long").alias("pairs")).where("pairs > 0")  # one row each


def adjacent_overlaps(spans: DataFrame, keys: tuple[str, ...], id_col: str = "record_id") -> DataFrame:
    """As above, but only between spans next to each other in (start, end, id) order of one ``keys`` value."""
    w = Window.partitionBy(*keys).orderBy("start", "end", id_col)
    nxt = spans.withColumns({"b": F.lead(id_col).over(w), "_s": F.lead("start").over(w)})
    return nxt.where(F.col("_s") < F.col("end")).select(*keys, F.col(id_col).alias("a"), "b")


def near_duplicates(spans: DataFrame, label: str = "label", gap_s: float = DUPLICATE_GAP_S, id_col: str = "record_id") -> DataFrame:
    """(label, a, b) of recordings of one class, each long enough, that follow each other closely and are about as long."""
    s = spans.select(F.col(label).alias("label"), F.col(id_col).alias("id"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    s = s.withColumn("d", F.col("end") - F.col("start")).where(F.col("label").isNotNull() & (F.col("d") >= DUPLICATE_LEAST_S))
    at = F.floor(F.col("end") / gap_s)
    a = s.select("label", F.explode(F.array(at, at + 1)).alias("bin"), F.struct("start", "end", "id").alias("x"), F.col("d").alias("dx"))
    b = s.select("label", F.floor(F.col("start") / gap_s).alias("bin"), F.struct("start", "end", "id").alias("y"), F.col("d").alias("dy"))
    met = a.join(b, ["label", "bin"])
    gap = F.col("y.start") - F.col("x.end")
    close = gap.between(0, gap_s) & (F.abs(F.col("dx") - F.col("dy")) <= DUPLICATE_LENGTHS * F.greatest("dx", "dy")) & (F.col("x.id") != F.col("y.id"))
    return met.where(close).select("label", F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def pairs_apart(pairs: DataFrame, keys: DataFrame, key: str, id_col: str = "record_id") -> DataFrame:
    """Pairs whose two records differ in ``key``; two unknown keys count as the same."""
    k = keys.select(F.col(id_col).alias("_id"), F.col(key).alias("_k"))
    ka, kb = k.select(F.col("_id").alias("a"), F.col("_k").alias("ka")), k.select(F.col("_id").alias("b"), F.col("_k").alias("kb"))
    return pairs.join(ka, "a", "left").join(kb, "b", "left").where(~F.col("ka").eqNullSafe(F.col("kb"))).select(*pairs.columns)


def window_overlap_leaks(windows: DataFrame, window: int, split: str = "split") -> DataFrame:
    """(record_id, start, next_start) of all pairs of a recording's windows that share samples and are in different splits.

    Windows meet in bins as long as a window, each with the next bin's too, so a recording is parted over its length.
    """
    bin_ = lambda c: F.floor(F.col(c) / window).cast("long")
    left = windows.select("record_id", "start", F.col(split).alias("_s")).withColumn("_bin", F.explode(F.array(bin_("start"), bin_("start") + 1)))
    right = windows.select("record_id", F.col("start").alias("next_start"), F.col(split).alias("_t")).withColumn("_bin", bin_("next_start"))
    met = left.join(right, ["record_id", "_bin"])
    apart = (F.col("next_start") > F.col("start")) & (F.col("next_start") < F.col("start") + window) & (F.col("_s") != F.col("_t"))
    return met.where(apart).select("record_id", "start", "next_start")


def duplicates(records: DataFrame, digest: str, id_col: str = "record_id") -> DataFrame:
    """(record_id, same_as) of records whose digest an earlier record (by id) has."""
    first = records.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(id_col).alias("same_as"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return records.join(first, digest).where(F.col(id_col) != F.col("same_as")).select(id_col, "same_as")


def partial_digest(content: Column, part: int = 1 << 20) -> Column:
    """Digest of a binary's size, first MiB and, if it is longer, last MiB."""
    n = F.octet_length(content)
    tail = F.when(n > part, F.substring(content, -part, part)).otherwise(F.lit(b""))
    return F.sha2(F.concat(F.encode(n.cast("string"), "UTF-8"), F.substring(content, 1, part), tail), 256)


def fingerprint(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """One row: 8 hex digits over name and size of all files in path order; the list grows with the files of one input folder."""
    line = F.concat(F.element_at(F.split(F.col(path), "/"), -1), F.lit(":"), F.coalesce(F.col(size), F.lit(-1)).cast("string"), F.lit("\n"))
    rows = files.agg(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), line.alias("l")))).alias("x"))
    return rows.select(F.substring(F.sha2(F.array_join(F.transform("x", lambda e: e["l"]), ""), 256), 1, 8).alias("fingerprint"))


# -- checks of a built dataset (records: record_id, split, label, ...)


def check_disjoint(records: DataFrame, windows: dict[str, int] | None = None) -> DataFrame:
    """``windows``: how many windows each split has. A split that has some but lists no recording can't be examined."""
    n = records.groupBy("record_id").agg(F.countDistinct("split").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") > 1).alias("bad"))
    filled = [s for s, k in (windows or {}).items() if k]
    seen = records.agg(F.collect_set(F.when(F.col("split").isin(*filled), F.col("split"))).alias("seen"))
    n = n.crossJoin(seen)  # one row each
    hidden = F.size("seen") < len(filled)
    status = F.when((F.col("n") == 0) | hidden, NOT_CHECKED).when(F.col("bad") > 0, LEAK).otherwise(PROOF)
    told = F.concat(F.col("bad").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" recordings in more than one split"))
    return finding(n, "recording disjointness", status, F.when(hidden, F.concat(told, F.lit("; a split with windows lists no recording"))).otherwise(told))


def check_cross_split_overlap(records: DataFrame, window: int, stride: int, windows: dict[str, int] | None = None) -> DataFrame:
    base = check_disjoint(records, windows)
    leak = F.when(F.col("status") == LEAK, F.lit(f"windows of a shared recording share {max(0, window - stride)} samples"))
    detail = leak.when(F.col("status") == NOT_CHECKED, F.lit("recordings of a split are unknown")).otherwise(F.lit("windows of different recordings share no samples"))
    return finding(base, "cross-split overlap", F.col("status"), detail)


def _timed(records: DataFrame) -> DataFrame:
    return records.where("start is not null").agg(F.count(F.lit(1)).alias("timed"), F.countDistinct("start").alias("stamps"))


def check_air_time(records: DataFrame, bin_s: float = 3600.0) -> DataFrame:
    """Recordings on air at the same time must share a split. Fewer than two times, or a single distinct one, tell nothing.

    Pairs are counted, over all and within each split; a recording listed twice is on air with itself.
    """
    within = overlap_counts(records, ("split",), bin_s).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("within"))
    pairs = overlap_counts(records, (), bin_s).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    row = _timed(records).crossJoin(pairs).crossJoin(within).withColumn("apart", F.col("pairs") - F.col("within"))  # one row each
    status = (
        F.when((F.col("timed") < 2) | (F.col("stamps") == 1), NOT_CHECKED)
        .when(F.col("apart") > 0, LEAK)
        .when(F.col("pairs") > 0, PROOF)
        .otherwise(SAMPLE)
    )
    return finding(row, "shared air time", status, F.concat(F.col("apart").cast("string"), F.lit(" of "), F.col("pairs").cast("string"), F.lit(" overlapping pairs apart")))


def check_time_overlap(records: DataFrame, bin_s: float = 3600.0) -> DataFrame:
    """The same for a folder, where nothing is split yet: any overlap is a leak to be."""
    row = _timed(records).crossJoin(overlap_counts(records, (), bin_s).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")))
    status = F.when((F.col("timed") < 2) | (F.col("stamps") == 1), NOT_CHECKED).when(F.col("pairs") > 0, LEAK).otherwise(SAMPLE)
    return finding(row, "recording time overlap", status, F.concat(F.col("pairs").cast("string"), F.lit(" overlapping pairs")))


def shared_stamps(records: DataFrame, stamp: str = "start", label: str = "label") -> DataFrame:
    """(stamp, classes, records) of time stamps that occur in more than one class."""
    return (
        records.where(F.col(stamp).isNotNull() & F.col(label).isNotNull())
        .groupBy(stamp)
        .agg(F.countDistinct(label).alias("classes"), F.count(F.lit(1)).alias("records"))
        .where("classes > 1")
    )


def check_shared_timestamp(records: DataFrame, built: bool) -> DataFrame:
    """A stamp in several classes is a session cue: a risk, never a leak; in a built set only if the splits' stamps differ."""
    known = records.where("start is not null and label is not null")
    n = known.agg(F.count(F.lit(1)).alias("timed"), F.countDistinct("start").alias("stamps"))
    row = n.crossJoin(shared_stamps(records).agg(F.count(F.lit(1)).alias("shared")))
    if built:
        # Sets of stamps are equal when every stamp is in every split.
        splits = known.agg(F.countDistinct("split").alias("splits"))
        per = known.groupBy("start").agg(F.countDistinct("split").alias("k")).agg(F.min("k").alias("least"))
        row = row.crossJoin(splits).crossJoin(per)
        differ = F.col("least") < F.col("splits")
    else:
        differ = F.lit(True)
    status = (
        F.when((F.col("timed") < 2) | (F.col("stamps") == 1), NOT_CHECKED).when(F.col("shared") == 0, SAMPLE).when(differ, RISK).otherwise(SAMPLE)
    )
    return finding(row, "shared timestamp", status, F.concat(F.col("shared").cast("string"), F.lit(" stamps in more than one class")))


def check_collections(records: DataFrame) -> DataFrame:
    c = records.where(F.length(F.trim("collection")) > 0).groupBy("collection").agg(F.countDistinct("split").alias("k"))
    n = c.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") > 1).alias("bad"))
    status = F.when(F.col("n") == 0, NOT_CHECKED).when(F.col("bad") > 0, RISK).otherwise(SAMPLE)
    return finding(n, "collection members", status, F.concat(F.col("bad").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" collections in more than one split")))


def axis_scores(records: DataFrame, axes: tuple[tuple[str, str], ...] = AXES, label: str = "label", idx: str = "record_id") -> DataFrame:
    """(ord, axis, n, accuracy, chance, margin) of each scalar axis."""
    names = records.sparkSession.createDataFrame([(i, name) for i, (_, name) in enumerate(axes)], "ord int, axis string").coalesce(1)
    found = separabilities(records.where(F.col(label).isNotNull()), [c for c, _ in axes], label, idx)
    return names.join(found, "ord", "left").withColumn("margin", F.col("accuracy") - F.col("chance"))


def check_axes(scores: DataFrame) -> DataFrame:
    """A finding for each axis: a risk when it alone tells most classes, and more than chance does.

    Capture time, where it is among them, is a risk whatever chance does; its finding stands ``after`` the others.
    """
    few = F.coalesce(F.col("n"), F.lit(0)) < LEAST_ROWS
    timed = F.col("axis") == TIME_AXIS[1]
    status = F.when(few, NOT_CHECKED).when((F.col("accuracy") >= AXIS_RISK) & (timed | (F.col("accuracy") > F.col("chance"))), RISK).otherwise(SAMPLE)
    chance = F.when(timed, "").otherwise(F.format_string(", chance %.1f %%", F.col("chance") * 100))
    detail = F.when(few, F.when(timed, "fewer than 3 recordings with a time").otherwise("fewer than 3 recordings"))
    detail = detail.otherwise(F.concat(F.format_string("nearest neighbour %.1f %%", F.col("accuracy") * 100), chance))
    return scores.select(status.alias("status"), F.concat(F.lit("axis: "), F.col("axis")).alias("check"), detail.alias("detail"), timed.cast("int").alias("after"))


def check_capture_time(records: DataFrame, label: str = "label", idx: str = "record_id") -> DataFrame:
    return check_axes(axis_scores(records, (TIME_AXIS,), label, idx)).drop("after")


def class_axes(records: DataFrame, axes: tuple[tuple[str, str], ...], label: str = "label") -> DataFrame:
    """A finding for each axis, or a single one where fewer than LEAST_ROWS recordings have a label."""
    if records.where(F.col(label).isNotNull()).limit(LEAST_ROWS).count() < LEAST_ROWS:
        return missing_axes(records, f"fewer than {LEAST_ROWS} labelled recordings")
    return check_axes(axis_scores(records, axes, label))


def missing_axes(records: DataFrame, why: str) -> DataFrame:
    return finding(records.agg(F.count(F.lit(1))), "class axes", F.lit(NOT_CHECKED), F.lit(why))


def check_snr(features: DataFrame) -> DataFrame:
    from wavemill.operators.signal import processing_gain

    g = processing_gain(features)
    none = F.col("gain_db").isNull()
    return finding(g, "in-band SNR", F.when(none, NOT_CHECKED).otherwise(SAMPLE), F.when(none, "no usable bandwidth").otherwise(F.format_string("median processing gain %.1f dB", "gain_db")))


def check_difficulty(spark_rows: DataFrame) -> DataFrame:
    return finding(spark_rows.limit(1), "task difficulty", F.lit(NOT_CHECKED), F.lit("only training tells"))


def check_readable(recordings: DataFrame) -> DataFrame:
    n = recordings.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("bad"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("record_id"))).alias("first"))
    detail = F.when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" unreadable, first: "), F.col("first"))).otherwise("all readable")
    return finding(n, "recordings readable", F.when(F.col("bad") > 0, RISK).otherwise(PROOF), detail)


def check_label_table(lost: DataFrame, unlisted: DataFrame) -> DataFrame:
    row = lost.agg(F.count(F.lit(1)).alias("lost")).crossJoin(unlisted.agg(F.count(F.lit(1)).alias("unlisted")))
    status = F.when((F.col("lost") > 0) | (F.col("unlisted") > 0), RISK).otherwise(PROOF)
    detail = F.concat(F.col("lost").cast("string"), F.lit(" labels lost, "), F.col("unlisted").cast("string"), F.lit(" recordings not listed"))
    return finding(row, "label source (csv)", status, detail)


def check_predicted_overlap(rows: DataFrame, window: int | None, stride: int | None) -> DataFrame:
    one = rows.limit(1)
    if not window or not stride:
        return finding(one, "predicted overlap", F.lit(NOT_CHECKED), F.lit("no window and stride given"))
    if stride >= window:
        return finding(one, "predicted overlap", F.lit(PROOF), F.lit("windows don't overlap"))
    shared = F.format_string(f"neighbouring windows share {window - stride} of {window} samples (%.1f %%)", 100 * overlap_fraction(window, stride))
    return finding(one, "predicted overlap", F.lit(RISK), shared)


def check_duplicates(records: DataFrame, digest: str = "digest") -> DataFrame:
    n = records.agg(F.count(digest).alias("n")).crossJoin(duplicates(records, digest).agg(F.count(F.lit(1)).alias("bad")))
    status = F.when(F.col("n") == 0, NOT_CHECKED).when(F.col("bad") > 0, LEAK).otherwise(SAMPLE)
    return finding(n, "duplicate data files", status, F.concat(F.col("bad").cast("string"), F.lit(" copies")))


def verdict(scores: DataFrame) -> DataFrame:
    """One row: ``ceiling`` where the best axis (largest margin, first of ties) nearly tells all classes, else ``unknown``."""
    ok = scores.where(F.col("n") >= LEAST_ROWS)
    best = ok.agg(F.max_by(F.struct("axis", "accuracy", "margin"), F.struct(F.col("margin"), -F.col("ord"))).alias("b"))
    ceiling = (F.col("b.accuracy") >= CEILING) & (F.col("b.margin") > 0)
    return best.select(F.when(F.coalesce(ceiling, F.lit(False)), "ceiling").otherwise("unknown").alias("verdict"), F.col("b.axis").alias("axis"), F.col("b.margin").alias("margin"))


def summary(findings: DataFrame) -> DataFrame:
    """One row: leak, pass, risk, not_checked."""
    s = F.col("status")
    return findings.agg(
        F.count_if(s == LEAK).alias("leak"), F.count_if(s.startswith("PASS")).alias("pass"), F.count_if(s == RISK).alias("risk"), F.count_if(s == NOT_CHECKED).alias("not_checked")
    )


def exit_code(findings: DataFrame, strict: bool = False) -> DataFrame:
    s = summary(findings)
    return s.select(((F.col("leak") > 0) | (F.lit(strict) & (F.col("risk") > 0))).cast("int").alias("exit_code"))


def audit_folder(records: DataFrame, window: int | None = None, stride: int | None = None, label_findings: DataFrame | None = None) -> DataFrame:
    """Findings for a folder of recordings (record_id, label, start, end, error, digest and the features).

    The table of recordings, a narrow row each, is kept while checks read it.
    """
    records = records.persist()
    readable = records.where("error is null")
    found = [check_readable(records)]
    if label_findings is not None:
        found.append(label_findings)
    found += [
        check_predicted_overlap(records, window, stride),
        check_time_overlap(readable),
        check_shared_timestamp(readable, built=False),
        check_duplicates(readable),
        finding(records.limit(1), "recording disjointness", F.lit(NOT_CHECKED), F.lit("nothing is split yet")),
        class_axes(readable, (*AXES, TIME_AXIS)),
        check_snr(readable),
        check_difficulty(records),
    ]
    return report(found)


def audit_dataset(
    records: DataFrame, window: int, stride: int, axes: tuple[tuple[str, str], ...] = AXES, windows: dict[str, int] | None = None, no_axes: str | None = None, partly: bool = False
) -> DataFrame:
    """Findings for a built dataset (record_id, split, label, start, end, collection and the features).

    ``windows``: of each split. ``no_axes``: why the recordings' scalars aren't known, where they aren't; ``partly``: some are.
    The table of recordings is kept while checks read it.
    """
    records = records.persist()
    scored = [missing_axes(records, no_axes)] if no_axes else []
    scored.append(class_axes(records, (*axes, TIME_AXIS)) if partly or not no_axes else check_capture_time(records))
    return report(
        [
            check_disjoint(records, windows),
            check_cross_split_overlap(records, window, stride, windows),
            check_air_time(records),
            check_shared_timestamp(records, built=True),
            check_collections(records),
            *scored,
            check_snr(records),
            check_difficulty(records),
        ]
    )
