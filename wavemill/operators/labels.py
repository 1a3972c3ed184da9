"""Labels of windows and recordings: intervals, directory names, tables of names; their statistics and guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.functions.columns import dirname_at, number_key

#: Labels that mark a reference signal, not a class, unless a list is given, which replaces it.
DEFAULT_EXCLUDED = ("ref_tone",)
LABELED, UNMATCHED, AMBIGUOUS = "labeled", "unmatched", "ambiguous"


def excluded_labels(given: Sequence[str] | None) -> tuple[str, ...]:
    return DEFAULT_EXCLUDED if given is None else tuple(given)


def usable(annotations: DataFrame, exclude: Sequence[str] | None = None) -> DataFrame:
    """Annotations that can label: with a label that isn't excluded, and with samples."""
    drop = excluded_labels(exclude)
    keep = F.col("label").isNotNull() & (F.col("sample_count") > 0)
    return annotations.where(keep & ~F.col("label").isin(*drop) if drop else keep)


def label_windows(windows: DataFrame, annotations: DataFrame, exclude: Sequence[str] | None = None, keep_unlabeled: bool = False) -> DataFrame:
    """Each window's label by the annotation that holds its centre: record_id, window_ix, label, outcome, matches.

    One match labels, none is ``unmatched`` (``unlabeled`` with ``keep_unlabeled``), more are ``ambiguous``.
    The join has ``record_id`` as its equal key, so intervals are compared within a recording only.
    """
    spans = usable(annotations, exclude).select("record_id", "label", "sample_start", (F.col("sample_start") + F.col("sample_count")).alias("sample_end"))
    met = windows.join(
        spans, (windows.record_id == spans.record_id) & (windows.centre >= spans.sample_start) & (windows.centre < spans.sample_end), "left"
    ).select(windows.record_id, windows.window_ix, spans.label)
    found = met.groupBy("record_id", "window_ix").agg(F.count("label").alias("matches"), F.min("label").alias("only"))
    return _outcomes(found, keep_unlabeled)


def label_windows_nested(
    recordings: DataFrame, window: int, stride: int, exclude: Sequence[str] | None = None, keep_unlabeled: bool = False
) -> DataFrame:
    """As :func:`label_windows` where annotations are an array of each recording. No shuffle at all."""
    from wavemill.operators.windows import window_starts

    drop = excluded_labels(exclude)
    good = F.filter("annotations", lambda a: a["label"].isNotNull() & (a["sample_count"] > 0) & (~a["label"].isin(*drop) if drop else F.lit(True)))
    windows = window_starts(recordings.withColumn("_good", good), window, stride, ("record_id", "_good"))
    hit = F.filter("_good", lambda a: (a["sample_start"] <= F.col("centre")) & (F.col("centre") < a["sample_start"] + a["sample_count"]))
    found = windows.withColumn("_hit", hit).select(
        "record_id", "window_ix", F.size("_hit").cast("long").alias("matches"), F.get("_hit", F.lit(0))["label"].alias("only")
    )
    return _outcomes(found, keep_unlabeled)


def _outcomes(found: DataFrame, keep_unlabeled: bool) -> DataFrame:
    outcome = F.when(F.col("matches") == 1, LABELED).when(F.col("matches") == 0, UNMATCHED).otherwise(AMBIGUOUS)
    label = F.when(F.col("matches") == 1, F.col("only"))
    if keep_unlabeled:
        label = F.when(F.col("matches") == 0, F.lit("unlabeled")).otherwise(label)
    return found.select("record_id", "window_ix", label.alias("label"), outcome.alias("outcome"), "matches")


def labeling_stats(labeled: DataFrame) -> DataFrame:
    """total, labeled, unmatched, ambiguous over all windows; kept unlabeled ones count in both of the first two."""
    return labeled.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("label").alias("labeled"),
        F.count_if(F.col("outcome") == UNMATCHED).alias("unmatched"),
        F.count_if(F.col("outcome") == AMBIGUOUS).alias("ambiguous"),
    )


def dominant_label(labeled: DataFrame) -> DataFrame:
    """The most frequent label of each recording; of equally frequent ones the alphabetically first."""
    counts = labeled.where(F.col("label").isNotNull()).groupBy("record_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("record_id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"), F.sum("n").alias("windows"))


def beyond_end(annotations: DataFrame, recordings: DataFrame) -> DataFrame:
    """Annotations that end behind the recording's last sample."""
    return annotations.join(recordings.select("record_id", "num_samples"), "record_id").where(
        F.col("sample_start") + F.col("sample_count") > F.col("num_samples")
    )


def annotation_survey(annotations: DataFrame, top: int = 3) -> DataFrame:
    """Labels with their counts, most frequent first (then by name)."""
    return annotations.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("label")).limit(top)


def text_field_survey(annotations: DataFrame, skip: Sequence[str] = (), top: int = 3) -> DataFrame:
    """Of the fields that hold text in ``annotations`` (raw, typed): how often each does, and an example; blank text, other types and ``skip`` are left out."""
    keys = annotations.select("typed", F.explode(F.map_keys("raw")).alias("field"))
    keys = keys.where(~F.col("field").isin(*skip)) if skip else keys
    value = F.try_variant_get("typed", _path(F.col("field")), "variant")
    text = keys.select("field", value.alias("v")).where(F.schema_of_variant("v") == "STRING").select("field", F.trim(F.try_variant_get("v", "$", "string")).alias("value"))
    return text.where(F.length("value") > 0).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("example")).orderBy(F.desc("n"), "field").limit(top)


def _path(*keys: Column) -> Column:
    """The path of a key within a key ... of an object, whatever characters they have but a quotation mark."""
    return F.concat(F.lit("$"), *[F.concat(F.lit('["'), k, F.lit('"]')) for k in keys])


# -- directory names


def label_by_dirname(recordings: DataFrame, level: int = 1, path: str = "record_id") -> DataFrame:
    """Label of a recording: the name of a directory above it. A level above the root raises."""
    name = dirname_at(path, level)
    message = F.concat(F.lit(f"no directory {level} levels above "), F.col(path))
    return recordings.withColumn("label", F.when(name.isNull(), F.raise_error(message)).otherwise(name))


def directory_levels(recordings: DataFrame, path: str = "record_id") -> DataFrame:
    """(level, name, records) for each directory level above each recording, counted from 1."""
    parts = F.split(F.col(path), "/")
    names = F.slice(F.reverse(parts), 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return recordings.select(F.posexplode(names).alias("p", "name")).groupBy((F.col("p") + 1).alias("level"), "name").agg(F.count(F.lit(1)).alias("records"))


def enumeration_levels(levels: DataFrame) -> DataFrame:
    """For each level whether its names only count: two or more, one prefix, numbers from 0 or 1 without gaps."""
    prefix, digits = F.regexp_extract(F.lower("name"), r"^(.*?)(\d+)$", 1), F.regexp_extract("name", r"(\d+)$", 1)
    rows = levels.select("level", "name", prefix.alias("prefix"), F.when(F.length(digits) > 0, digits.cast("long")).alias("number")).distinct()
    found = rows.groupBy("level").agg(
        F.count(F.lit(1)).alias("names"),
        F.countDistinct("prefix").alias("prefixes"),
        F.count("number").alias("numbered"),
        F.countDistinct("number").alias("numbers"),
        F.min("number").alias("low"),
        F.max("number").alias("high"),
    )
    counts = (
        (F.col("names") >= 2)
        & (F.col("prefixes") == 1)
        & (F.col("numbered") == F.col("names"))
        & (F.col("numbers") == F.col("names"))
        & F.col("low").isin(0, 1)
        & (F.col("high") - F.col("low") + 1 == F.col("names"))
    )
    return found.select("level", "names", F.coalesce(counts, F.lit(False)).alias("enumerated"))


def dirname_level_advice(enumerations: DataFrame, chosen: int) -> DataFrame:
    """The nearest higher level to use instead, where the chosen one only counts; else no row."""
    own = enumerations.where((F.col("level") == chosen) & F.col("enumerated")).select(F.col("level").alias("chosen"))
    other = enumerations.where((F.col("level") > chosen) & (F.col("names") >= 2) & ~F.col("enumerated"))
    return own.crossJoin(other.agg(F.min("level").alias("better"))).where(F.col("better").isNotNull())  # one row on each side


# -- tables of names


def name_keys(rows: DataFrame, name: str, value: str) -> DataFrame:
    """(key, value, exact, values) of a table of names: the name itself, and its bare file name and stem.

    A bare key serves only if all rows that share it agree; ``values`` counts what they say.
    """
    base = F.element_at(F.split(F.col(name), "/"), -1)
    given = rows.where((F.length(name) > 0) & F.col(value).isNotNull() & (F.length(value) > 0)).select(F.col(name).alias("n"), F.col(value).alias("v"), base.alias("b"))
    keys = F.array(
        F.struct(F.col("n").alias("key"), F.lit(True).alias("exact")),
        F.struct(F.col("b").alias("key"), F.lit(False).alias("exact")),
        F.struct(F.regexp_replace("b", r"\.[^.]+$", "").alias("key"), F.lit(False).alias("exact")),
    )
    spread = given.select(F.explode(F.array_distinct(keys)).alias("k"), "v").select("k.key", "k.exact", "v")
    return spread.groupBy("key", "exact").agg(F.min("v").alias("value"), F.countDistinct("v").alias("values"))


def lookup(recordings: DataFrame, table: DataFrame, name: str, value: str, path: str = "record_id", strict: bool = True) -> DataFrame:
    """``recordings`` with ``value`` by the best key that fits: full path, then bare name, then stem.

    Columns added: value, matched_by (1, 2, 3 or null), ambiguous. With ``strict`` a recording whose only
    keys are ambiguous raises instead of taking one of the answers.
    """
    base = F.element_at(F.split(F.col(path), "/"), -1)
    wanted = F.array(
        F.struct(F.col(path).alias("key"), F.lit(True).alias("exact"), F.lit(1).alias("rank")),
        F.struct(base.alias("key"), F.lit(False).alias("exact"), F.lit(2).alias("rank")),
        F.struct(F.regexp_replace(base, r"\.[^.]+$", "").alias("key"), F.lit(False).alias("exact"), F.lit(3).alias("rank")),
    )
    tries = recordings.select(F.col(path).alias("_id"), F.explode(wanted).alias("k")).select("_id", "k.key", "k.exact", "k.rank")
    met = tries.join(name_keys(table, name, value), ["key", "exact"])
    sure = F.col("values") == 1
    best = met.groupBy("_id").agg(
        F.min_by("value", F.when(sure, F.col("rank"))).alias("_value"),
        F.min(F.when(sure, F.col("rank"))).alias("matched_by"),
        F.max(~sure).alias("_unsure"),
    )
    out = recordings.join(best, recordings[path] == best["_id"], "left").drop("_id")
    unsure = F.col("matched_by").isNull() & F.coalesce("_unsure", F.lit(False))
    found = F.when(F.col("matched_by").isNotNull(), F.col("_value"))
    if strict:
        found = F.when(unsure, F.raise_error(F.concat(F.lit("names of different rows fit "), F.col(path)))).otherwise(found)
    return out.withColumn(value, found).withColumn("ambiguous", unsure).drop("_value", "_unsure")


def lost_labels(declared: DataFrame, assigned: DataFrame, exclude: Sequence[str] | None = None) -> DataFrame:
    """Labels that a table declares for recordings that are there, but that no recording got."""
    drop = excluded_labels(exclude)
    rows = declared.select("label").where(F.col("label").isNotNull()).distinct()
    rows = rows.where(~F.col("label").isin(*drop)) if drop else rows
    return rows.join(assigned.select("label").distinct(), "label", "left_anti")


def labelling_annotation(annotations: Column | str, dominant: Column | str, exclude: Sequence[str] | None = None) -> Column:
    """The first annotation with the dominant label, else the single one that isn't excluded, else null."""
    a = F.col(annotations) if isinstance(annotations, str) else annotations
    d = F.col(dominant) if isinstance(dominant, str) else dominant
    drop = excluded_labels(exclude)
    same = F.filter(a, lambda x: x["label"] == d)
    rest = F.filter(a, lambda x: ~F.coalesce(x["label"].isin(*drop), F.lit(False)) if drop else F.lit(True))
    return F.when(F.size(same) > 0, F.get(same, F.lit(0))).when(F.size(rest) == 1, F.get(rest, F.lit(0)))


def field_value(annotation: Column, global_raw: Column, global_typed: Column, field: str) -> Column:
    """A field, as a variant, of ``annotation`` (raw, typed) if it has the key at all, else of the recording; ``key/inner`` goes into objects."""
    path = "$" + "".join(f'["{k}"]' for k in field.split("/"))
    has = F.coalesce(F.map_contains_key(annotation["raw"], field.split("/")[0]), F.lit(False))
    return F.try_variant_get(F.when(has, annotation["typed"]).otherwise(global_typed), path, "variant")


def balance_key(value: Column) -> Column:
    """The group that a variant stands for: a number by its value, anything else by its text; ``(none)`` where there is nothing."""
    number = F.when(~F.schema_of_variant(value).isin("STRING", "BOOLEAN"), F.try_variant_get(value, "$", "double"))
    return F.when(number.isNotNull(), number_key(number)).otherwise(F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("(none)")))
