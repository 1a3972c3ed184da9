"""From recordings to a labelled, leak-safe dataset: the flagship plan."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.functions import columns
from wavemill.operators import labels, order, signal, split, stats, sweep, windows
from wavemill.sources import dataset, shards, sigmf, tables


#: Annotations of a recording that each of its windows is held against; recordings with more are swept.
FEW_ANNOTATIONS = 64
#: Kinds of files that a dataset is written as.
PARQUET, ARRAYS = "parquet", "arrays"


class BuildError(ValueError):
    """A dataset that can't be built as asked."""


@dataclass(frozen=True)
class BuildConfig:
    window: int = 1024
    stride: int = 512
    label_source: str = "annotations"  # annotations, dirname, csv
    label_csv: str | None = None
    dirname_level: int = 1
    exclude: tuple[str, ...] | None = None
    keep_unlabeled: bool = False
    ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)
    seed: int = 42
    group_by: str | None = None  # path:<pattern>, csv:<file>, collection
    balance_by: str | None = None
    representation: str = "iq2ch"
    normalize: bool = True


@dataclass
class Plan:
    """Frames of a build that needs no samples yet."""

    recordings: DataFrame
    labeled: DataFrame
    records: DataFrame  # record_id, label, windows, unit, balance_group, carrier_offset_hz, split
    warnings: list[str]


def some_recordings(recordings: DataFrame, root: str) -> DataFrame:
    if recordings.isEmpty():
        raise BuildError(f"no recordings below {root}")
    return recordings


def group_units(spark: SparkSession, recordings: DataFrame, spec: str) -> DataFrame:
    """``recordings`` with ``unit`` by ``path:<pattern>``, ``csv:<file>`` or ``collection``."""
    kind, _, rest = spec.partition(":")
    if kind == "path" and rest:
        return recordings.withColumn("unit", columns.group_by_pattern("record_id", rest, re.compile(rest).groups))
    if kind == "csv" and rest:
        found = labels.lookup(recordings, tables.read_group_csv(spark, rest), "recording", "group")
        own = F.concat(F.lit(columns.UNGROUPED), F.col("record_id"))
        return found.withColumn("unit", F.coalesce("group", own)).drop("group", "matched_by", "ambiguous")
    if spec == "collection":
        return recordings.withColumn("unit", columns.group_by_collection("record_id", "collection"))
    raise BuildError(f"group by path:<pattern>, csv:<file> or collection, not {spec!r}")


def label_by_annotations(recordings: DataFrame, window: int, stride: int, exclude: Sequence[str] | None = None, keep_unlabeled: bool = False, few: int = FEW_ANNOTATIONS) -> DataFrame:
    """Windows labelled by the annotations nested in each recording.

    Up to ``few`` annotations are looked through for each window where the recording is; recordings with more are swept.
    Both give the same rows.
    """
    long = recordings.where(F.size("annotations") > few)
    if long.isEmpty():
        return labels.label_windows_nested(recordings, window, stride, exclude, keep_unlabeled)
    nested = labels.label_windows_nested(recordings.where(F.coalesce(F.size("annotations"), F.lit(0)) <= few), window, stride, exclude, keep_unlabeled)
    return nested.unionByName(sweep.label_windows_sweep(windows.window_starts(long, window, stride), sigmf.annotations_of(long), exclude, keep_unlabeled))


def plan(spark: SparkSession, recordings: DataFrame, c: BuildConfig) -> Plan:
    """Label and split by metadata alone. Refusals raise."""
    windows.check_params(c.window, c.stride)
    split.check_ratios(c.ratios)
    if c.group_by and c.balance_by and c.group_by == c.balance_by:
        raise BuildError(f"{c.group_by!r} can't group and balance at once: a value that stays whole in one split can't be spread over all")
    if c.label_source == "annotations":
        labeled = label_by_annotations(recordings, c.window, c.stride, c.exclude, c.keep_unlabeled)
    elif c.label_source in ("dirname", "csv"):
        if c.label_source == "dirname":
            named = labels.label_by_dirname(recordings, c.dirname_level)
        elif c.label_csv:
            named = labels.lookup(recordings, tables.read_label_csv(spark, c.label_csv), "filename", "label")
        else:
            raise BuildError("label source csv needs a file")
        w = windows.window_starts(named, c.window, c.stride, ("record_id", "label"))
        outcome = F.when(F.col("label").isNull(), labels.UNMATCHED).otherwise(labels.LABELED)
        labeled = w.select("record_id", "window_ix", "label", outcome.alias("outcome"), F.lit(1).alias("matches"))
    else:
        raise BuildError(f"label source must be annotations, dirname or csv, not {c.label_source!r}")
    dominant = labels.dominant_label(labeled)
    records = recordings.join(dominant, "record_id")
    if c.label_source == "csv":
        declared = labels.lookup(recordings, tables.read_label_csv(spark, c.label_csv), "filename", "label")
        if lost := [r.label for r in labels.lost_labels(declared, dominant, c.exclude).orderBy("label").limit(4).collect()]:
            raise BuildError(f"labels of the table that no recording got: {', '.join(lost)}")
    warnings = metadata_warnings(recordings, c)
    records = group_units(spark, records, c.group_by) if c.group_by else records.withColumn("unit", F.col("record_id"))
    first = labels.labelling_annotation("annotations", "label", c.exclude)
    records = records.withColumn("_a", first)
    offset = columns.carrier_offset(F.col("_a.freq_lower_edge"), F.col("_a.freq_upper_edge"), F.col("center_frequency"))
    records = records.withColumn("carrier_offset_hz", offset)
    if c.balance_by:
        value = labels.field_value(F.col("_a"), F.col("global_raw"), F.col("global_typed"), c.balance_by)
        records = records.withColumn("_v", value).withColumn("balance_group", labels.balance_key(F.col("_v")))
    else:
        records = records.withColumn("balance_group", F.lit(None).cast("string"))
    records = records.select("record_id", "label", "windows", "unit", "balance_group", "carrier_offset_hz")
    records = order.settle(split.assign_splits(records, c.ratios, c.seed, balanced=bool(c.balance_by)))  # a narrow row for each recording, read by all that follows
    if c.group_by and (w := split.grouping_warnings(records).first().warning):
        warnings.append(w)
    if c.balance_by:
        if w := split.balance_warnings(records, "balance_group").first().warning:
            warnings.append(w)
        unseen = split.unseen_groups(records, "balance_group").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("balance_group").alias("first"))
        warnings += [f"{r.split}: {r.n} values of {c.balance_by} never occur in train, {r.first!r} first" for r in unseen.orderBy("split").collect()]
        warnings += [f"{r.split}: no {c.balance_by} occurs with every class" for r in split.shortcut_groups(records, "balance_group").where("shortcut").orderBy("split").collect()]
    return Plan(recordings, labeled, records, warnings)


def metadata_warnings(recordings: DataFrame, c: BuildConfig) -> list[str]:
    """Annotations behind the end of their recording, and a directory level whose names only count where a higher one tells more."""
    out = []
    late = labels.beyond_end(sigmf.annotations_of(recordings), recordings).agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first")).first()
    if late.n:
        out.append(f"{late.n} annotations end behind the last sample, {late.first} first")
    if c.label_source == "dirname":
        levels = labels.enumeration_levels(labels.directory_levels(recordings))
        if advice := labels.dirname_level_advice(levels, c.dirname_level).first():
            out.append(f"directories {advice.chosen} above the recordings are only numbered; level {advice.better} may be the class")
    return out


def window_table(p: Plan, c: BuildConfig, items: bool = False, snr_db: float | None = None, powers: DataFrame | None = None) -> DataFrame:
    """Labelled windows with their samples: the split joins metadata rows, then only these windows are read.

    With ``items`` they are numbered, before they are read. With ``snr_db`` noise is added so far below each recording's mean power
    (``powers``: record_id, power), before anything is normalised.
    """
    wanted = p.labeled.where("label is not null").join(p.records.select("record_id", "split"), "record_id")
    more = ["item"] if items else []
    wanted = dataset.numbered(wanted) if items else wanted
    paths = p.recordings.select("record_id", "data_path", "datatype")
    rows = wanted.join(paths, "record_id").withColumn("start", F.col("window_ix") * c.stride)
    read = sigmf.read_windows(rows.select("record_id", "window_ix", "start", "label", "split", *more, "data_path", "datatype"), c.window).drop("data_path", "datatype")
    if snr_db is not None:
        read = signal.add_noise_to_windows(read.join(powers, "record_id"), snr_db, c.seed)
    return windows.normalize(read) if c.normalize else read


def build(spark: SparkSession, root: str, out: str, c: BuildConfig, files: str = PARQUET) -> dict:
    """Scan ``root``, write the dataset to ``out``, as Parquet or as array shards, and return its manifest."""
    if files not in (PARQUET, ARRAYS):
        raise BuildError(f"files are {PARQUET} or {ARRAYS}, not {files!r}")
    recordings = some_recordings(sigmf.scan(spark, root), root)
    p = plan(spark, recordings, c)
    kept = [r.asDict() for r in p.records.orderBy("record_id").collect()]  # a row for each recording: the manifest lists them
    if not kept:
        survey = labels.annotation_survey(sigmf.annotations_of(recordings)).collect()
        text = labels.text_field_survey(sigmf.annotations_of(recordings), ("core:label",)).collect()
        told = ", ".join(f"{r.label} ({r.n})" for r in survey) or "none"
        raise BuildError(f"no labelled windows; annotation labels: {told}" + (f"; other fields with text: {', '.join(f'{r.field} ({r.n}, {r.example!r})' for r in text)}" if text else ""))
    names = {r["label"]: r["index"] for r in stats.label_map(p.labeled).collect()}
    rows = windows.represent(window_table(p, c, items=True), c.representation)
    records = {s: [{"id": r["record_id"], "label": r["label"], "windows": r["windows"], "carrier_offset_hz": r["carrier_offset_hz"], "balance_group": r["balance_group"], "group": r["unit"]} for r in kept if r["split"] == s] for s in split.SPLITS}
    manifest = {"config": asdict(c) | {"input": root}, "label_map": names, "stats": labels.labeling_stats(p.labeled).first().asDict(), "warnings": p.warnings}
    if files == ARRAYS:
        part = lambda k: F.col(f"x.{'iq'[k]}") if c.representation == "complex" else F.get("x", F.lit(k))
        rows = rows.select("record_id", "window_ix", "split", "item", "label", part(0).alias("i"), part(1).alias("q"))
        return shards.write_shards(rows, out, manifest | {"splits": {s: {"records": v} for s, v in records.items()}}, c.representation)
    dataset.write_dataset(rows.drop("i", "q"), out, 8 * c.window)
    counts: dict[str, dict] = {s: {} for s in split.SPLITS}
    for r in spark.read.parquet(f"{out.rstrip('/')}/windows").groupBy("split", "label").count().collect():
        counts[r.split][r.label] = r["count"]
    manifest["splits"] = {s: {"count": sum(counts[s].values()), "labels": counts[s], "records": records[s]} for s in split.SPLITS}
    tables.write_manifest(spark, out, manifest)
    return manifest


def built_windows(spark: SparkSession, root: str, splits: Sequence[str] = split.SPLITS) -> DataFrame:
    """(record_id, window_ix, label, split, i, q) of a built dataset in either kind of files; array shards know items, not recordings."""
    told = tables.read_manifest(spark, root)
    if not any("shards" in v for v in told["splits"].values()):
        rows = dataset.read_dataset(spark, root)
        return rows.select("record_id", "window_ix", "label", "split", F.get("x", F.lit(0)).alias("i"), F.get("x", F.lit(1)).alias("q")).where(F.col("split").isin(*splits))
    found = None
    for s in splits:
        if told["splits"].get(s, {}).get("count"):
            rows = shards.read_shards(spark, root, s).select(F.lit(s).alias("record_id"), F.col("item").alias("window_ix"), "label", "split", "i", "q")
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise dataset.DatasetError(f"{', '.join(splits)}: empty")
    return found


def manifest_records(spark: SparkSession, manifest: dict) -> DataFrame:
    """(record_id, split, label, windows, carrier_offset_hz, balance_group, unit) that a manifest lists."""
    rows = [(r["id"], s, r["label"], r["windows"], r["carrier_offset_hz"], r["balance_group"], r["group"]) for s, v in manifest["splits"].items() for r in v["records"]]
    return spark.createDataFrame(rows, "record_id string, split string, label string, windows long, carrier_offset_hz double, balance_group string, unit string")


def locate_sources(spark: SparkSession, ids: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Readable recordings below ``roots`` by the ``record_id`` that ``ids`` has for them, wherever the folder was moved.

    A recording answers to each end of its path that begins behind a slash, so ids meet paths by equal keys. The first
    root that has an id wins; an id that fits several recordings of one root is left out, as is one that fits none.
    """
    found = None
    for rank, root in enumerate(dict.fromkeys(r.rstrip("/") for r in roots)):
        if not tables.exists(spark, root):
            continue
        rows = sigmf.scan(spark, root, strict=False).where("error is null").withColumn("rank", F.lit(rank))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise BuildError(f"none of these folders exists: {', '.join(roots)}")
    parts = F.split(F.regexp_replace("path", re.escape(sigmf.META) + "$", ""), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    spread = found.withColumnRenamed("record_id", "_own").withColumn("record_id", F.explode(ends)).join(ids.select("record_id").distinct(), "record_id")
    best = spread.groupBy("record_id").agg(F.min("rank").alias("rank"))
    spread = spread.join(best, ["record_id", "rank"])
    sure = spread.groupBy("record_id").agg(F.countDistinct("path").alias("n")).where("n = 1").select("record_id")
    return spread.join(sure, "record_id").drop("rank", "_own")


def exclude_list(given: Sequence[str] | None) -> tuple[str, ...]:
    return labels.excluded_labels(given)
