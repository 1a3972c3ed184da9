"""Queries: windows, labels, lookups, directory names, units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.functions import columns
from wavemill.operators import labels, split, sweep, windows
from wavemill.plans.catalogue import query, table
from wavemill.plans.standin import EV, STRIDE, WINDOW, annotations, recordings, samples


@query("window_counts", f"with {EV} select record_id, num_samples, case when num_samples < 16 then 0 else (num_samples - 16) // 8 + 1 end windows from rec")
def window_counts(spark: SparkSession, d: str) -> DataFrame:
    return windows.window_counts(recordings(spark, d), WINDOW, STRIDE)


@query("window_starts", f"with {EV} select record_id, window_ix, start, centre from win")
def window_starts(spark: SparkSession, d: str) -> DataFrame:
    return windows.window_starts(recordings(spark, d), WINDOW, STRIDE)


@query(
    "window_materialize",
    f"""with {EV} select w.record_id, w.window_ix, count(*) n, round(sum(value), 4) total, arg_min(value, ord) first_value, arg_max(value, ord) last_value
from win w join ev s on s.record_id = w.record_id and s.ord >= w.start and s.ord < w.start + 16 group by 1, 2""",
)
def window_materialize(spark: SparkSession, d: str) -> DataFrame:
    w = windows.windows_of_samples(samples(spark, d), recordings(spark, d), WINDOW, STRIDE)
    return w.groupBy("record_id", "window_ix").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min_by("value", "ord").alias("first_value"), F.max_by("value", "ord").alias("last_value")
    )


def _labeled(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_windows(windows.window_starts(recordings(spark, d), WINDOW, STRIDE), annotations(spark, d))


@query("label_windows_interval", f"with {EV} select * from labeled")
def label_windows_interval(spark: SparkSession, d: str) -> DataFrame:
    return _labeled(spark, d)


@query("label_windows_sweep", f"with {EV} select * from labeled")
def label_windows_sweep(spark: SparkSession, d: str) -> DataFrame:
    return sweep.label_windows_sweep(windows.window_starts(recordings(spark, d), WINDOW, STRIDE), annotations(spark, d), ranges=7)


@query("label_windows_nested", f"with {EV} select * from labeled")
def label_windows_nested(spark: SparkSession, d: str) -> DataFrame:
    a = annotations(spark, d).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("sample_start", "sample_count", "label"))).alias("annotations"))
    empty = F.array().cast("array<struct<sample_start:bigint,sample_count:bigint,label:string>>")
    r = recordings(spark, d).join(a, "record_id", "left").withColumn("annotations", F.coalesce("annotations", empty))
    return labels.label_windows_nested(r, WINDOW, STRIDE)


@query(
    "label_windows_keep_unlabeled",
    f"with {EV} select record_id, window_ix, case when matches = 0 then 'unlabeled' else label end label, outcome, matches from labeled",
)
def label_windows_keep(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_windows(windows.window_starts(recordings(spark, d), WINDOW, STRIDE), annotations(spark, d), keep_unlabeled=True)


@query(
    "label_stats",
    f"""with {EV} select count(*) total, count(label) labeled, count(*) filter (where outcome = 'unmatched') unmatched,
count(*) filter (where outcome = 'ambiguous') ambiguous from labeled""",
)
def label_stats(spark: SparkSession, d: str) -> DataFrame:
    return labels.labeling_stats(_labeled(spark, d))


@query(
    "dominant_label",
    f"""with {EV}, c as (select record_id, label, count(*) n from labeled where label is not null group by 1, 2)
select record_id, arg_min(label, row(-n, label)) label, cast(sum(n) as bigint) windows from c group by 1""",
)
def dominant_label(spark: SparkSession, d: str) -> DataFrame:
    return labels.dominant_label(_labeled(spark, d))


@query("exclude_labels", f"with {EV} select label, count(*) n from ann where label not in ('click', 'view') and sample_count > 0 group by 1")
def exclude_labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.usable(annotations(spark, d), ["click", "view"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "beyond_end",
    f"""with {EV} select a.record_id, sample_start, cast(sample_count as bigint) sample_count, label, num_samples from ann a join rec r on r.record_id = a.record_id
where sample_start + sample_count > num_samples""",
)
def beyond_end(spark: SparkSession, d: str) -> DataFrame:
    return labels.beyond_end(annotations(spark, d), recordings(spark, d))


@query("annotation_survey", f"with {EV} select label, count(*) n from ann group by 1 order by n desc, label limit 3")
def annotation_survey(spark: SparkSession, d: str) -> DataFrame:
    return labels.annotation_survey(annotations(spark, d))


@query(
    "label_map",
    "select event_type as label, cast(row_number() over (order by event_type) - 1 as integer) as index from (select distinct event_type from events)",
)
def label_map(spark: SparkSession, d: str) -> DataFrame:
    from wavemill.operators.stats import label_map as f

    return f(table(spark, d, "events").select(F.col("event_type").alias("label")))


# -- paths

PATHS = "pth as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') record_id from pages)"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("record_id"))


@query("dirname_label", f"with {PATHS} select page_id, record_id, string_split(record_id, '/')[-2] label from pth")
def dirname_label(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_by_dirname(_paths(spark, d), 1)


LEVELS = f"""{PATHS}, parts as (select list_reverse(string_split(record_id, '/')) p from pth),
lev as (select k as level, p[k + 1] as name from (select p, unnest(range(1, len(p))) k from parts))"""


@query("directory_levels", f"with {LEVELS} select cast(level as integer) as level, name, count(*) records from lev group by 1, 2")
def directory_levels(spark: SparkSession, d: str) -> DataFrame:
    return labels.directory_levels(_paths(spark, d))


@query(
    "enumeration_levels",
    f"""with {LEVELS}, u as (select distinct level, name, regexp_extract(lower(name), '^(.*?)([0-9]+)$', 1) prefix,
  case when regexp_extract(name, '([0-9]+)$', 1) <> '' then cast(regexp_extract(name, '([0-9]+)$', 1) as bigint) end num from lev),
g as (select level, count(*) names, count(distinct prefix) p, count(num) k, count(distinct num) m, min(num) a, max(num) b from u group by 1)
select cast(level as integer) as level, names, coalesce(names >= 2 and p = 1 and k = names and m = names and a in (0, 1) and b - a + 1 = names, false) enumerated from g""",
)
def enumeration_levels(spark: SparkSession, d: str) -> DataFrame:
    return labels.enumeration_levels(labels.directory_levels(_paths(spark, d)))


@query(
    "enumerated_names",
    """with n as (select 'run' || (n_nationkey + 1) as name, 1 as level from nation union all select r_name as name, 2 as level from region),
u as (select level, name, regexp_extract(lower(name), '^(.*?)([0-9]+)$', 1) prefix, try_cast(regexp_extract(name, '([0-9]+)$', 1) as bigint) num from n),
e as (select level, count(*) names, count(*) >= 2 and count(distinct prefix) = 1 and count(num) = count(*) and min(num) in (0, 1) and max(num) - min(num) + 1 = count(*) enumerated from u group by 1)
select cast(1 as integer) chosen, min(level) better from e where level > 1 and names >= 2 and not coalesce(enumerated, false)""",
)
def enumerated_names(spark: SparkSession, d: str) -> DataFrame:
    low = table(spark, d, "nation").select(F.lit(1).alias("level"), F.concat(F.lit("run"), F.col("n_nationkey") + 1).alias("name"))
    high = table(spark, d, "region").select(F.lit(2).alias("level"), F.col("r_name").alias("name"))
    return labels.dirname_level_advice(labels.enumeration_levels(low.unionByName(high)), 1)


@query(
    "group_path_regex",
    f"""with {PATHS} select page_id, case when regexp_matches(record_id, '([^./]+)\\.example\\.(com|net)')
then regexp_extract(record_id, '([^./]+)\\.example\\.(com|net)', 1) || '|' || regexp_extract(record_id, '([^./]+)\\.example\\.(com|net)', 2)
else '(ungrouped) ' || record_id end unit from pth""",
)
def group_path_regex(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("page_id", columns.group_by_pattern("record_id", r"([^./]+)\.example\.(com|net)", 2).alias("unit"))


@query(
    "group_collection",
    """select doc_id, case when trim(case when doc_id % 4 = 0 then '  ' else source end) <> '' then trim(source) else '(ungrouped) ' || doc_id end unit from documents""",
)
def group_collection(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.col("source")).alias("c"))
    return docs.select("doc_id", columns.group_by_collection(F.col("doc_id").cast("string"), "c").alias("unit"))


@query(
    "grouping_warnings",
    f"""with {PATHS}, u as (select case when regexp_matches(record_id, '([^./]+)\\.example\\.com') then regexp_extract(record_id, '([^./]+)\\.example\\.com', 1)
else '(ungrouped) ' || record_id end unit from pth)
select count(*) records, count(*) filter (where unit like '(ungrouped) %') ungrouped, count(distinct unit) units,
case when count(*) filter (where unit like '(ungrouped) %') = count(*) then 'no record matched'
when count(*) filter (where unit like '(ungrouped) %') > 0 then 'some records did not match and are units of their own'
when count(distinct unit) = count(*) then 'every unit has a single record' end warning from u""",
)
def grouping_warnings(spark: SparkSession, d: str) -> DataFrame:
    return split.grouping_warnings(_paths(spark, d).select(columns.group_by_pattern("record_id", r"([^./]+)\.example\.com", 1).alias("unit")))


# -- tables of names

NAMES = """recs as (select distinct source || '/r' || (doc_id % 97) || '.rec' record_id from documents),
tab as (select distinct case when l.doc_id % 3 = 0 then source || '/r' || (l.doc_id % 97) || '.rec' when l.doc_id % 3 = 1 then 'x/r' || (l.doc_id % 97) || '.rec'
  else 'r' || (l.doc_id % 97) end as filename, 'q' || quality as label from labels l join documents d on d.doc_id = l.doc_id)"""


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "source")
    number = F.concat(F.lit("r"), F.col("doc_id") % 97)
    path = F.concat_ws("", "source", F.lit("/"), number, F.lit(".rec"))
    recs = docs.select(path.alias("record_id")).distinct()
    name = F.when(F.col("doc_id") % 3 == 0, path).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x/"), number, F.lit(".rec"))).otherwise(number)
    rows = table(spark, d, "labels").select("doc_id", "quality").join(docs, "doc_id")
    return recs, rows.select(name.alias("filename"), F.concat(F.lit("q"), "quality").alias("label")).distinct()


@query(
    "label_lookup_fallback",
    f"""with {NAMES},
k as (select filename as key, true as exact, label v from tab
  union all select string_split(filename, '/')[-1], false, label from tab
  union all select regexp_replace(string_split(filename, '/')[-1], '\\.[^.]+$', ''), false, label from tab),
keys as (select key, exact, min(v) v, count(distinct v) n from k group by 1, 2),
tries as (select record_id, record_id as key, true as exact, 1 rank from recs
  union all select record_id, string_split(record_id, '/')[-1], false, 2 from recs
  union all select record_id, regexp_replace(string_split(record_id, '/')[-1], '\\.[^.]+$', ''), false, 3 from recs),
met as (select t.record_id, rank, v, n from tries t join keys k on k.key = t.key and k.exact = t.exact),
best as (select record_id, arg_min(v, rank) filter (where n = 1) v, min(rank) filter (where n = 1) rank, bool_or(n > 1) unsure from met group by 1)
select r.record_id, cast(b.rank as integer) matched_by, b.v as label, b.rank is null and coalesce(unsure, false) ambiguous from recs r left join best b on b.record_id = r.record_id""",
)
def label_lookup_fallback(spark: SparkSession, d: str) -> DataFrame:
    recs, rows = _names(spark, d)
    return labels.lookup(recs, rows, "filename", "label", strict=False)


@query(
    "label_coverage",
    "select lang, count(l.doc_id) listed, count(*) - count(l.doc_id) unlisted from documents d left join labels l on l.doc_id = d.doc_id group by 1",
)
def label_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs, listed = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id")
    a = docs.join(listed, "doc_id", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("listed"))
    b = docs.join(listed, "doc_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("unlisted"))
    return a.join(b, "lang", "full").na.fill(0, ["listed", "unlisted"])


@query(
    "label_collapse",
    """with x as (select doc_id, 'q' || quality || doc_id % 40 as label from labels) select distinct label from x where label not in (select label from x where doc_id % 5 <> 0) and label <> 'ref_tone'""",
)
def label_collapse(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), "quality", (F.col("doc_id") % 40).cast("string")).alias("label"))
    return labels.lost_labels(x, x.where("doc_id % 5 <> 0"))


@query(
    "carrier_offset",
    "select p_partkey, round((p_retailprice + (p_retailprice + p_size)) / 2 - 1000, 6) offset_hz from part",
)
def carrier_offset(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", F.round(columns.carrier_offset(F.col("p_retailprice"), F.col("p_retailprice") + F.col("p_size"), F.lit(1000)), 6).alias("offset_hz")
    )


@query(
    "text_survey",
    """select field, n, example from (select 'c_name' field, count(*) n, min(trim(c_name)) example from customer where trim(c_name) <> '' union all select 'c_mktsegment', count(*), min(trim(c_mktsegment)) from customer where trim(c_mktsegment) <> '')""",
)
def text_survey(spark: SparkSession, d: str) -> DataFrame:
    """Customers as annotations: names and segments are text, balances and keys are numbers, an object is neither."""
    c = table(spark, d, "customer")
    body = F.to_json(F.struct("c_name", "c_mktsegment", "c_acctbal", "c_custkey", F.struct(F.col("c_name").alias("inner")).alias("nested"), F.lit("skipped").alias("note")))
    rows = c.select(F.from_json(body, "map<string,string>").alias("raw"), F.parse_json(body).alias("typed"))
    return labels.text_field_survey(rows, ("note",), top=9)


@query(
    "nested_balance",
    """select c_custkey record_id, case when c_nationkey % 3 = 0 then '(none)' when c_nationkey % 3 = 1 then c_mktsegment else cast(cast(c_nationkey as bigint) as varchar) end balance_group from customer""",
)
def nested_balance(spark: SparkSession, d: str) -> DataFrame:
    """A key within an object: missing, text, or text that looks like a number."""
    c = table(spark, d, "customer")
    n = F.col("c_nationkey") % 3
    value = F.when(n == 1, F.col("c_mktsegment")).when(n == 2, F.col("c_nationkey").cast("bigint").cast("string"))
    body = F.to_json(F.struct(F.struct(value.alias("group")).alias("site:place")))
    a = F.struct(F.from_json(body, "map<string,string>").alias("raw"), F.parse_json(body).alias("typed"))
    found = labels.field_value(F.col("a"), F.col("g"), F.parse_json(F.lit("{}")), "site:place/group")
    rows = c.select(F.col("c_custkey").alias("record_id"), a.alias("a"), F.lit(None).cast("map<string,string>").alias("g")).withColumn("v", found)
    return rows.select("record_id", labels.balance_key(F.col("v")).alias("balance_group"))
