"""Recordings as pairs of files: JSON metadata (``.sigmf-meta``) and interleaved samples (``.sigmf-data``).

Metadata are scanned as text and sizes from the file listing, so labelling and splitting never open the
samples; those are read by range, for the windows that are wanted only.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wavemill.operators import order

META, DATA = ".sigmf-meta", ".sigmf-data"
#: datatype: numpy type of one value, divisor. Fixed values of the format.
DATATYPES = {"cf32_le": ("<f4", 1.0), "ci16_le": ("<i2", 32768.0), "ci8": ("i1", 128.0)}
#: Bytes of samples that a task reads, and that are held at once.
TASK_BYTES, BATCH_BYTES = 128 << 20, 16 << 20
_TYPED = "struct<global:variant,annotations:array<variant>>"
_TREE = "struct<global:map<string,string>,captures:array<map<string,string>>,annotations:array<map<string,string>>>"


class RecordingError(ValueError):
    """A recording that can't be read as asked."""


def bytes_per_sample(datatype: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, (t, _) in DATATYPES.items() for x in (F.lit(k), F.lit(2 * np.dtype(t).itemsize))]), datatype)


def _is_stem(spark: SparkSession, root: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(root + META)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """All recordings below ``root`` (or the one pair that it names, with or without suffix), sorted annotations nested in each.

    Columns: record_id (path below root, without suffix), path, data_path, datatype, sample_rate,
    center_frequency, num_samples, declared_version, capture_time, collection, global_raw, global_typed, annotations, error.
    ``raw`` and ``global_raw`` are maps of text; ``typed`` and ``global_typed`` are the same objects as variants, which keep
    types and nesting.
    With ``strict`` an unreadable recording raises while the plan runs; else ``error`` says why.
    """
    single = re.sub(r"\.sigmf-(meta|data)$", "", root)
    one = single != root or _is_stem(spark, root)
    metas = spark.read.text(single + META, wholetext=True) if one else spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{META}").text(root, wholetext=True)
    files = spark.read.format("binaryFile")
    files = files.load(single + DATA) if one else files.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{DATA}").load(root)
    stem = lambda c, s: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "%20", " "), "^file:/+", "/"), re.escape(s) + "$", "")
    m = metas.select(stem(F.col("_metadata.file_path"), META).alias("stem"), F.col("_metadata.file_path").alias("path"), F.from_json("value", _TREE).alias("t"), F.from_json("value", _TYPED).alias("v"))
    d = files.select(stem(F.col("path"), DATA).alias("_stem"), F.col("path").alias("data_path"), F.col("length").alias("bytes"))
    j = m.join(d, F.col("stem") == F.col("_stem"), "left")
    base = re.sub(r"^file:/+", "/", (single.rsplit("/", 1)[0] if one else root).rstrip("/")) + "/"
    g = F.col("t.global")
    datatype, rate = g["core:datatype"], F.expr("try_cast(t.global['core:sample_rate'] as double)")
    size = bytes_per_sample(datatype)
    first = F.get("t.captures", F.lit(0))
    error = (
        F.when(F.col("t").isNull() | g.isNull(), "metadata are not valid JSON with a global object")
        .when(F.col("data_path").isNull(), "data file is missing or empty")
        .when(datatype.isNull(), "core:datatype is missing")
        .when(size.isNull(), F.concat(F.lit("unsupported datatype "), datatype, F.lit(f": use one of {', '.join(DATATYPES)}")))
        .when(rate.isNull(), "core:sample_rate is missing")
        .when(F.col("bytes") % size != 0, "data size is not a whole number of samples")
    )
    number = lambda e, k, t: e[k].try_cast(t)
    annotation = lambda a, i: F.struct(
        number(a, "core:sample_start", "long").alias("sample_start"),
        F.coalesce(number(a, "core:sample_count", "long"), F.lit(0)).cast("long").alias("sample_count"),
        a["core:label"].alias("label"),
        number(a, "core:freq_lower_edge", "double").alias("freq_lower_edge"),
        number(a, "core:freq_upper_edge", "double").alias("freq_upper_edge"),
        F.coalesce(a["core:description"], a["core:comment"]).alias("description"),
        a.alias("raw"),
        F.get("v.annotations", i).alias("typed"),
    )
    bare = F.transform(F.coalesce("t.annotations", F.array().cast("array<map<string,string>>")), annotation)
    # Maps don't compare, so the order goes by the numbers and each annotation's place.
    keyed = F.array_sort(F.transform(bare, lambda a, i: F.struct(a["sample_start"].alias("s"), a["sample_count"].alias("c"), i.alias("i"))))
    out = j.withColumn("_bare", bare).withColumn("_keys", keyed)
    found = F.regexp_replace("stem", "^" + re.escape(base), "")
    out = out.select(
        found.alias("record_id"),
        "path",
        "data_path",
        datatype.alias("datatype"),
        rate.alias("sample_rate"),
        number(first, "core:frequency", "double").alias("center_frequency"),
        F.when(size.isNotNull(), F.floor(F.col("bytes") / size)).alias("num_samples"),
        g["core:version"].alias("declared_version"),
        F.expr("try_to_timestamp(coalesce(get(t.captures, 0)['core:datetime'], t.global['core:datetime']))").alias("capture_time"),
        g["core:collection"].alias("collection"),
        g.alias("global_raw"),
        F.col("v.global").alias("global_typed"),
        F.transform("_keys", lambda k: F.get("_bare", k["i"])).alias("annotations"),
        error.alias("error"),
    )
    if strict:
        message = F.concat(F.col("record_id"), F.lit(": "), F.col("error"))
        out = out.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(message).cast("string")))
        out = out.where(F.col("error").isNull())
    return out


def annotations_of(recordings: DataFrame) -> DataFrame:
    return recordings.select("record_id", F.posexplode("annotations").alias("ann_ix", "a")).select("record_id", "ann_ix", "a.*")


def open_input(uri: str):
    uri = re.sub(r"^file:/+", "/", uri)
    fs, path = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
    return fs.open_input_file(path.replace("%20", " "))


def decode(raw: bytes, datatype: str) -> tuple[np.ndarray, np.ndarray]:
    """i and q, scaled in 32-bit floats."""
    if datatype not in DATATYPES:
        raise RecordingError(f"unsupported datatype {datatype}: use one of {', '.join(DATATYPES)}")
    kind, divisor = DATATYPES[datatype]
    v = np.frombuffer(raw, kind).astype(np.float32)
    if divisor != 1.0:
        v = v / np.float32(divisor)
    return v[0::2], v[1::2]


def read_range(uri: str, datatype: str, start: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples [start, start + count), cut at the end; nothing behind it; a start outside raises."""
    size = 2 * np.dtype(DATATYPES[datatype][0]).itemsize
    with open_input(uri) as f:
        n = f.size() // size
        if start < 0 or start > n:
            raise RecordingError(f"start {start} is outside of 0..{n}")
        f.seek(start * size)
        return decode(f.read(min(count, n - start) * size), datatype)


def range_digests(files: DataFrame, part: int = 1 << 20) -> DataFrame:
    """(data_path, digest) of files: what ``operators.audit.partial_digest`` says of their content, of which only both ends are read."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for path in pdf["data_path"]:
                with open_input(path) as f:
                    n = f.size()
                    h = hashlib.sha256(str(n).encode() + f.read(part))
                    if n > part:
                        f.seek(n - part)
                        h.update(f.read(part))
                out.append(h.hexdigest())
            yield pdf.assign(digest=out)

    return files.select("data_path").mapInPandas(run, "data_path string, digest string")


def planned_by_bytes(rows: DataFrame, size: Column, start: Column, count: Column, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``rows`` (data_path, ...) dealt to tasks that read about ``task_bytes`` each, sorted by (data_path, ``start``).

    Files are cut into stretches of ``task_bytes``; a row belongs to the stretch in which it starts. A stretch costs what lies between
    its first and last sample. Stretches in order of file and place are packed into tasks by a running sum of costs, so small files share
    a task and a large one is read by many. Tasks number what there is to read over ``task_bytes``; adaptive execution doesn't merge
    them, for it would go by the size of the rows, not of what they stand for.
    """
    keyed = rows.withColumns({"_start": start.cast("long"), "_stretch": F.floor(start * size / task_bytes).cast("long")})
    ends = F.max((start + count) * size) - F.min(start * size)
    stretches = order.settle(keyed.groupBy("data_path", "_stretch").agg(F.greatest(ends, F.lit(1)).cast("long").alias("_cost")))
    if (stretches.agg(F.sum("_cost")).first()[0] or 0) <= task_bytes:
        return keyed.repartitionById(1, F.lit(0)).sortWithinPartitions("data_path", "_start").select(*rows.columns)
    stretches = order.ranges(stretches, ["data_path", "_stretch"])
    carried = order.before(stretches.groupBy("_part").agg(F.sum("_cost").alias("_before")).withColumn("_all", F.lit(0)), ["_before"], "_all")  # a row for each range
    within = F.coalesce(F.sum("_cost").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    task = F.floor((F.col("_before") + F.col("_within")) / task_bytes).cast("int")
    dealt = stretches.withColumn("_within", within).join(F.broadcast(carried.select("_part", "_before")), "_part").select(F.col("data_path").alias("_p"), F.col("_stretch").alias("_s"), task.alias("_task"))
    dealt = order.settle(dealt)
    tasks = (dealt.agg(F.max("_task")).first()[0] or 0) + 1
    met = keyed.join(dealt, (F.col("data_path") == F.col("_p")) & (F.col("_stretch") == F.col("_s")))
    met = met.repartitionById(tasks, "_task").sortWithinPartitions("data_path", "_start")
    return met.select(*rows.columns)


class RunReader:
    """Reads stretches of recordings in order; of what the next one shares with the one before, nothing is read again."""

    def __init__(self) -> None:
        self.key, self.start, self.i, self.q = None, 0, np.zeros(0, np.float32), np.zeros(0, np.float32)
        self.bytes = 0

    def read(self, path: str, datatype: str, start: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        have = self.start + len(self.i) - start if self.key == (path, datatype) and self.start <= start else 0
        kept = max(0, min(have, count))
        old = slice(start - self.start, start - self.start + kept)
        if kept < count:
            i, q = read_range(path, datatype, start + kept, count - kept)
            self.bytes += len(i) * 2 * np.dtype(DATATYPES[datatype][0]).itemsize
            if kept:
                i, q = np.concatenate((self.i[old], i)), np.concatenate((self.q[old], q))
            self.key, self.start, self.i, self.q = (path, datatype), start, i, q
            return i, q
        return self.i[old], self.q[old]


def read_windows(windows: DataFrame, window: int, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``windows`` (record_id, data_path, datatype, start, ...) with i and q of ``window`` samples from start.

    Tasks follow the bytes to read (:func:`planned_by_bytes`). Within a task neighbouring windows are read in one go, BATCH_BYTES
    of samples at most, and no sample is read twice, however much windows overlap. A window behind the end of its recording raises.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema) + ", i array<float>, q array<float>"
    rows = max(1, BATCH_BYTES // (8 * window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RunReader()
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                paths, kinds, starts = (batch.column(c).to_pylist() for c in ("data_path", "datatype", "start"))
                i, q = np.empty((2, len(starts), window), np.float32)
                first = 0
                for k in range(1, len(starts) + 1):
                    if k < len(starts) and paths[k] == paths[first] and kinds[k] == kinds[first] and starts[k - 1] <= starts[k] <= starts[k - 1] + window and (starts[k] - starts[first] + window) * 8 <= BATCH_BYTES:
                        continue
                    x, y = reader.read(paths[first], kinds[first], starts[first], starts[k - 1] - starts[first] + window)
                    if len(x) < starts[k - 1] - starts[first] + window:
                        raise RecordingError(f"{paths[first]}: a window from {starts[k - 1]} is behind its end")
                    for j in range(first, k):
                        s = starts[j] - starts[first]
                        i[j], q[j] = x[s : s + window], y[s : s + window]
                    first = k
                offsets = pa.array(np.arange(len(starts) + 1) * window, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v.reshape(-1))) for v in (i, q)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "i", "q"])

    dealt = planned_by_bytes(windows, bytes_per_sample(F.col("datatype")), F.col("start"), F.lit(window), task_bytes)
    return dealt.mapInArrow(run, schema)


class SampleSource(DataSource):
    """``spark.read.format("iq_blocks").load(root)``: blocks of samples (record_id, block, start, i, q), one task for each run of blocks.

    Options: ``block`` (samples in a block), ``blocks`` (blocks in a task).
    """

    @classmethod
    def name(cls) -> str:
        return "iq_blocks"

    def schema(self) -> str:
        return "record_id string, block bigint, start bigint, i array<float>, q array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _SampleReader(dict(self.options))


class _Part(InputPartition):
    def __init__(self, record: str, path: str, datatype: str, start: int, stop: int):
        self.record, self.path, self.datatype, self.start, self.stop = record, path, datatype, start, stop


class _SampleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.block, self.blocks = int(options.get("block", 1024)), int(options.get("blocks", 4096))

    def partitions(self) -> list[_Part]:
        uri = re.sub(r"^file:/+", "/", self.root)
        fs, root = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
        out = []
        for info in sorted(fs.get_file_info(pafs.FileSelector(root, recursive=True)), key=lambda x: x.path):
            if not info.path.endswith(META):
                continue
            with fs.open_input_stream(info.path) as f:
                datatype = json.loads(f.read())["global"]["core:datatype"]
            if datatype not in DATATYPES:
                raise RecordingError(f"{info.path}: unsupported datatype {datatype}")
            data = info.path[: -len(META)] + DATA
            n = fs.get_file_info(data).size // (2 * np.dtype(DATATYPES[datatype][0]).itemsize)
            step = self.block * self.blocks
            name = info.path[len(root.rstrip("/")) + 1 : -len(META)]
            out += [_Part(name, data, datatype, a, min(a + step, n)) for a in range(0, n, step)]
        return out

    def read(self, part: _Part):
        i, q = read_range(part.path, part.datatype, part.start, part.stop - part.start)
        for a in range(0, len(i), self.block):
            yield part.record, (part.start + a) // self.block, part.start + a, i[a : a + self.block].tolist(), q[a : a + self.block].tolist()


def write_pair(stem: str, iq: np.ndarray, sample_rate: float, annotations: list[dict] | None = None, datatype: str = "cf32_le", **fields) -> None:
    """Write one pair of files. ``fields``: further global keys (without ``core:``), and frequency and datetime of the capture."""
    kind, divisor = DATATYPES[datatype]
    flat = np.empty(2 * len(iq), np.float32)
    flat[0::2], flat[1::2] = iq.real, iq.imag
    if divisor != 1.0:
        flat = np.clip(np.round(flat * divisor), np.iinfo(kind).min, np.iinfo(kind).max)
    flat.astype(kind).tofile(stem + DATA)
    capture = {"core:sample_start": 0} | {f"core:{k}": fields.pop(k) for k in ("frequency", "datetime") if k in fields}
    meta = {
        "global": {"core:datatype": datatype, "core:sample_rate": sample_rate, "core:version": "1.0.0"} | {f"core:{k}": v for k, v in fields.items()},
        "captures": [capture],
        "annotations": annotations or [],
    }
    with open(stem + META, "w", encoding="utf-8") as f:
        json.dump(meta, f, ensure_ascii=False)
