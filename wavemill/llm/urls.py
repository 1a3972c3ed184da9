"""URL filter: sort-merge range join of urls with host and path rules.

A host is keyed by its labels in reverse, each ended by a mark below every host character, so that a
rule's host with all its subdomains is one interval of keys. Pages and rules are dealt to the same
key ranges; each range is swept once in key order with a stack of the host rules that are open there.
Intervals of such keys nest or are disjoint, so the stack is as deep as a host has labels.

Defined results: a null url or one without ``://`` has empty host and path; a rule without a path
fits only urls that start with the empty path, that is all; of fitting rules the longest string
(host and path) wins, then the longer host, then ``allow``; urls that fit no rule get ``default``.
Repeated rows are judged each; an empty table gives an empty result; further columns of either
table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wavemill.llm.shared import ascii_lower, require_columns, task_slots

#: Ends each label of a key; below all characters of hosts.
MARK = "\x01"
#: Between a key's host and path; below MARK, so that a host comes before its subdomains.
PATH_MARK = "\x00"
#: Keys looked at for each range when ranges are chosen. Bounds the driver's memory, not the result.
KEYS_A_RANGE = 60


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    start = F.length(rest) + 4
    return F.coalesce(ascii_lower(F.regexp_extract(url.substr(start, F.length(url)), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    start = F.length(rest) + 4
    return F.coalesce(F.regexp_extract(url.substr(start, F.length(url)), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), MARK), F.lit(MARK))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, ``host/path``) pairs as a table of host, path, verdict."""
    rows = [(r.partition("/")[0], "/" + r.partition("/")[2] if "/" in r else "", v) for v, r in rules]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def _range_bounds(keyed: DataFrame, ranges: int) -> list[str]:
    """Keys that part ``keyed`` into about equal ranges; at most KEYS_A_RANGE for each range are collected."""
    n = keyed.count()
    want = KEYS_A_RANGE * ranges
    some = keyed.select("key") if n <= want else keyed.select("key").sample(fraction=want / n, seed=7).limit(4 * want)
    keys = sorted(r[0] for r in some.collect())
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def _range_of(key: Column, bounds: list[str]) -> Column:
    """How many bounds are at or below ``key``, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    table = F.array(*[F.lit(b) for b in bounds])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(F.get(table, at + s - 1) <= key, at + s).otherwise(at)
    )


class _Open:
    """The rules of one host while the sweep is inside its interval."""

    def __init__(self, host: str, key: str):
        self.host, self.key, self.paths = host, key, {}
        self.sizes: list[int] = []

    def add(self, path: str, verdict: str) -> None:
        if self.paths.get(path) != "allow":
            self.paths[path] = verdict
        self.sizes = sorted({len(p) for p in self.paths}, reverse=True)

    def best(self, path: str) -> tuple[str, str] | None:
        for n in self.sizes:
            if n <= len(path) and (p := path[:n]) in self.paths:
                return p, self.paths[p]
        return None


def _sweep(default: str, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, []
        for batch in batches:
            cols = batch.to_pydict()
            ids, hosts, paths, rules, verdicts = [], [], [], [], []
            for part, key, rank, i, host, path, verdict in zip(*(cols[c] for c in ("range", "key", "rank", "id", "host", "path", "verdict"))):
                if part != at:
                    at, stack = part, []
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if rank == 0:
                    if not stack or stack[-1].host != host:
                        stack.append(_Open(host, key))
                    stack[-1].add(path, verdict)
                    continue
                won, size = None, (-1, -1)
                for o in stack:
                    if (host == o.host or host.endswith("." + o.host)) and (b := o.best(path)):
                        if (s := (len(o.host) + len(b[0]), len(o.host))) > size:
                            won, size = (o.host + b[0], b[1]), s
                ids.append(i)
                hosts.append(host)
                paths.append(path)
                rules.append(won[0] if won else None)
                verdicts.append(won[1] if won else default)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), *(pa.array(x, pa.string()) for x in (hosts, paths, rules, verdicts))], schema=schema
            )

    return run


def filter_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None
) -> DataFrame:
    """A row for each page: ``id_col``, host, path, rule (or null), verdict. ``rules``: host, path, verdict.

    The ranges' bounds are found on keys that end in a hash of the id, so that a host, or even a url,
    with a third of all rows is parted over many ranges. A rule goes to each range that its interval
    meets, so rule rows grow with the ranges, not with the pages.
    """
    require_columns(pages, [id_col, url_col])
    require_columns(rules, ["host", "path", "verdict"])
    spark = pages.sparkSession
    n = ranges or task_slots(spark)
    url = F.col(url_col)
    keyed = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn(
        "key", F.concat(host_key(F.col("host")), F.lit(PATH_MARK), F.col("path"), F.lit(PATH_MARK), F.hex(F.xxhash64("id")))
    )
    bounds = _range_bounds(keyed, n)
    mine = keyed.select(
        _range_of(F.col("key"), bounds).alias("range"), "key", F.lit(1).alias("rank"), "id", "host", "path", F.lit(None).cast("string").alias("verdict")
    )
    given = (
        rules.select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where(F.col("host").isNotNull() & F.col("verdict").isNotNull())
        .withColumn("key", host_key(F.col("host")))
    )
    last = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit(chr(ord(MARK) + 1)))
    spread = given.select(
        F.explode(F.sequence(_range_of(F.col("key"), bounds), _range_of(last, bounds))).alias("range"),
        "key",
        F.lit(0).alias("rank"),
        F.lit(None).cast(keyed.schema["id"].dataType).alias("id"),
        "host",
        "path",
        "verdict",
    )
    dealt = mine.unionByName(spread).repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "key", "rank", "path")
    kind = keyed.schema["id"].dataType.simpleString()
    id_type = to_arrow_type(keyed.schema["id"].dataType)
    out = dealt.mapInArrow(_sweep(default, id_type), f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
