"""Datasets as array shards: ``<split>/shard_0000.npy`` of at most 256 MiB each and a ``manifest.json`` that names them.

A Spark data source in both directions. Writing has two phases: tasks roll shards into a staging folder of the job, and only when all
have succeeded does the driver rename them into place, in item order, and write the manifest last; a failed job leaves neither shards
nor a manifest. Reading plans partitions from the shards' headers by rows and bytes; single items are read by their places, without
the rest.

Arrays are float32 of (windows, 2, samples), or complex64 of (windows, samples). The manifest has a label for each window, as the format
wants it: it passes through the driver, 4 bytes a window, the samples never do.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from wavemill.operators import order
from wavemill.operators.split import SPLITS
from wavemill.sources.dataset import DatasetError, item_files, numbered
from wavemill.sources.tables import MANIFEST_SCHEMA, check_schema

SHARD_BYTES = 256 << 20
#: Bytes of samples of an input partition, and of an Arrow batch.
READ_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
MANIFEST = "manifest.json"
FORMAT = "iq_shards"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    uri = re.sub(r"^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def _exists(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def header(fs: pafs.FileSystem, path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, type, first byte of the values) of an array file, from its first bytes."""
    with fs.open_input_file(path) as f:
        start = io.BytesIO(f.read(min(f.size(), 4096)))
    version = np.lib.format.read_magic(start)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(start)
    if fortran:
        raise DatasetError(f"{path} is in column order")
    return shape, kind, start.tell()


@dataclass
class _Written(WriterCommitMessage):
    shards: list[tuple[str, int, int, str, bytes]]  # split, first item, rows, staged path, labels


class _Roll:
    """Rows of one split until they are a shard."""

    def __init__(self, split: str, first: int):
        self.split, self.first, self.arrays, self.labels, self.bytes, self.rows = split, first, [], [], 0, 0

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self.arrays.append(x)
        self.labels.append(y)
        self.bytes += x.nbytes
        self.rows += len(x)


class _ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.root, self.max_bytes = options["path"].rstrip("/"), int(options.get("max_bytes", SHARD_BYTES))
        self.kind, self.manifest = options.get("representation", "iq2ch"), json.loads(options["manifest"])
        self.staging = f"_staging-{options['job']}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = filesystem(self.root)
        folder = f"{root}/{self.staging}"
        fs.create_dir(folder, recursive=True)
        done: list[tuple[str, int, int, str, bytes]] = []
        open_: _Roll | None = None

        def close() -> None:
            if open_ is None or not open_.rows:
                return
            path = f"{folder}/{open_.split}-{open_.first:020d}-{uuid.uuid4().hex}.npy"
            x = np.concatenate(open_.arrays)
            with fs.open_output_stream(path) as out:
                np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(x.dtype), "fortran_order": False, "shape": x.shape})
                out.write(memoryview(x).cast("B"))
            done.append((open_.split, open_.first, open_.rows, path, np.concatenate(open_.labels).astype("<i4").tobytes()))

        for batch in iterator:
            splits, items = batch.column("split").to_pylist(), np.asarray(batch.column("item"))
            part = lambda c: np.asarray(batch.column(c).flatten()).reshape(batch.num_rows, -1)  # noqa: B023, E731
            i, q, y = part("i").astype(np.float32), part("q").astype(np.float32), np.asarray(batch.column("y"))
            x = (i + 1j * q).astype(np.complex64) if self.kind == "complex" else np.stack([i, q], axis=1)
            a_shard = max(1, self.max_bytes // max(1, x[:1].nbytes))
            at = 0
            while at < len(splits):
                if open_ is None or open_.split != splits[at] or open_.first + open_.rows != items[at] or open_.rows >= a_shard:
                    close()
                    open_ = _Roll(splits[at], int(items[at]))
                end = at + 1
                while end < len(splits) and splits[end] == open_.split and items[end] == items[end - 1] + 1 and open_.rows + end - at < a_shard:
                    end += 1
                open_.add(x[at:end], y[at:end])
                at = end
        close()
        return _Written(done)

    def commit(self, messages: list) -> None:
        fs, root = filesystem(self.root)
        found = sorted((s for m in messages if m for s in m.shards), key=lambda s: (s[0], s[1]))
        for split in SPLITS:
            own, told = [s for s in found if s[0] == split], self.manifest["splits"].setdefault(split, {})
            at, names = 0, []
            if own:
                fs.create_dir(f"{root}/{split}", recursive=True)
            for k, (_, first, rows, path, _labels) in enumerate(own):
                if first != at:
                    raise DatasetError(f"{split}: items {at} to {first} were not written once")
                at, name = first + rows, f"{split}/shard_{k:04d}.npy"
                fs.move(path, f"{root}/{name}")
                names.append(name)
            told |= {"shards": names, "labels": np.frombuffer(b"".join(s[4] for s in own), "<i4").tolist(), "count": at}
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps({"manifest_schema": MANIFEST_SCHEMA} | self.manifest, ensure_ascii=False).encode())
        self._clear(fs, root)

    def abort(self, messages: list) -> None:
        self._clear(*filesystem(self.root))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if _exists(fs, f"{root}/{self.staging}"):
            fs.delete_dir(f"{root}/{self.staging}")


class _Rows(InputPartition):
    def __init__(self, split: str, path: str, kind: str, shape: tuple[int, ...], offset: int, first: int, start: int, labels: list[int]):
        self.split, self.path, self.kind, self.shape, self.offset = split, path, kind, shape, offset
        self.first, self.start, self.labels = first, start, labels  # item of the row ``start`` of the shard; a label for each row


class _ShardReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.split = options["path"].rstrip("/"), options["split"]
        self.items = [int(x) for x in options["items"].split(",") if x] if "items" in options else None
        self.read_bytes = int(options.get("read_bytes", READ_BYTES))

    def partitions(self) -> list[_Rows]:
        fs, root = filesystem(self.root)
        told = read_manifest(self.root)
        entry = _entry(told, self.split)
        labels, out, at = entry["labels"], [], 0
        wanted = None if self.items is None else sorted(set(self.items))
        for name in entry["shards"]:
            shape, kind, offset = header(fs, f"{root}/{name}")
            n = shape[0]
            row = kind.itemsize * int(np.prod(shape[1:]))
            step = max(1, self.read_bytes // max(1, row))
            if wanted is None:
                runs = [(a, min(a + step, n)) for a in range(0, n, step)]
            else:
                own = np.array([w - at for w in wanted if at <= w < at + n], np.int64)
                cuts = np.flatnonzero(np.diff(own) != 1) + 1
                runs = [(int(r[0]), int(r[-1]) + 1) for r in np.split(own, cuts) if len(r)]
            out += [_Rows(self.split, f"{root}/{name}", kind.str, shape[1:], offset, at + a, a, labels[at + a : at + b]) for a, b in runs]
            at += n
        if at != len(labels):
            raise DatasetError(f"{self.split}: the shards hold {at} windows, the manifest has {len(labels)} labels")
        return out or [_Rows(self.split, "", "<f4", (2, 0), 0, 0, 0, [])]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        if not part.labels:
            return
        fs, path = filesystem(part.path)
        kind = np.dtype(part.kind)
        row = kind.itemsize * int(np.prod(part.shape))
        step = max(1, BATCH_BYTES // max(1, row))
        with fs.open_input_file(path) as f:
            for a in range(0, len(part.labels), step):
                n = min(step, len(part.labels) - a)
                f.seek(part.offset + (part.start + a) * row)
                x = np.frombuffer(f.read(n * row), kind).reshape(n, *part.shape)
                i, q = (x.real, x.imag) if kind.kind == "c" else (x[:, 0], x[:, 1])
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * v.shape[1], pa.int32()), pa.array(np.ascontiguousarray(v, np.float32).reshape(-1))) for v in (i, q)]
                items = pa.array(part.first + a + np.arange(n), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([part.split] * n), items, pa.array(part.labels[a : a + n], pa.int32()), *lists], names=["split", "item", "y", "i", "q"])


class ShardSource(DataSource):
    """``spark.read.format("iq_shards").option("split", ...).load(root)``: split, item, y, i, q. Options: ``items``, ``read_bytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "split string, item bigint, y int, i array<float>, q array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _ShardReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ShardWriter(dict(self.options))


def _entry(manifest: dict, split: str) -> dict:
    if split not in SPLITS:
        raise DatasetError(f"unknown split {split!r}: use one of {', '.join(SPLITS)}")
    entry = manifest["splits"].get(split, {})
    if not entry.get("count"):
        raise DatasetError(f"split {split} is empty")
    return entry


def read_manifest(root: str) -> dict:
    """The manifest of a folder of shards; a folder without one, invalid JSON, or a later schema raises."""
    fs, path = filesystem(f"{root.rstrip('/')}/{MANIFEST}")
    if not _exists(fs, path):
        raise DatasetError(f"{root} has no {MANIFEST}")
    with fs.open_input_file(path) as f:
        try:
            body = json.loads(f.read())
        except json.JSONDecodeError as e:
            raise DatasetError(f"{path} is not valid JSON: {e}") from e
    check_schema(body.get("manifest_schema"), MANIFEST_SCHEMA, "manifest")
    return body


def write_shards(windows: DataFrame, root: str, manifest: dict, representation: str = "iq2ch", max_bytes: int = SHARD_BYTES, tasks: int | None = None) -> dict:
    """Write windows (record_id, window_ix, split, label, i, q) as shards and return the manifest.

    ``manifest``: what it says besides, with ``label_map``. Items are ordered by (record_id, window_ix) within a split and dealt
    to tasks by arithmetic. An existing manifest is never replaced.
    """
    spark = windows.sparkSession
    fs, path = filesystem(root.rstrip("/"))
    if _exists(fs, f"{path}/{MANIFEST}"):
        raise DatasetError(f"{root} already holds a dataset")
    names = manifest["label_map"]
    y = F.coalesce(*[F.when(F.col("label").cast("string") == F.lit(k), F.lit(v)) for k, v in names.items()], F.lit(None).cast("int")).cast("int") if names else F.lit(None).cast("int")
    rows = (windows if "item" in windows.columns else numbered(windows)).where(F.col("label").isNotNull())
    rows = rows.select("split", "item", y.alias("y"), F.col("i").cast("array<float>").alias("i"), F.col("q").cast("array<float>").alias("q"))
    first = rows.select(F.size("i").alias("n")).first()
    dealt = item_files(rows, max(1, max_bytes // (8 * max(1, first.n if first else 1))), tasks)
    spark.dataSource.register(ShardSource)
    body = manifest | {"splits": manifest.get("splits", {})}
    dealt.write.format(FORMAT).mode("append").option("path", root.rstrip("/")).option("representation", representation).option("max_bytes", max_bytes).option("manifest", json.dumps(body)).option("job", uuid.uuid4().hex).save()
    return read_manifest(root)


def read_shards(spark: SparkSession, root: str, split: str, items: Sequence[int] | None = None, read_bytes: int = READ_BYTES) -> DataFrame:
    """split, item, y, label, i, q of a split, or of its ``items`` only; negative ones count from the end."""
    spark.dataSource.register(ShardSource)
    told = read_manifest(root)
    count = _entry(told, split)["count"]
    reader = spark.read.format(FORMAT).option("split", split).option("read_bytes", read_bytes)
    if items is not None:
        at = [i + count if i < 0 else i for i in items]
        if bad := [i for i, k in zip(items, at) if not 0 <= k < count]:
            raise IndexError(f"{bad[0]} is outside of {split}'s {count} windows")
        reader = reader.option("items", ",".join(map(str, at)))
    return reader.load(root.rstrip("/")).withColumn("label", label_of(told["label_map"], F.col("y")))


def label_of(label_map: dict[str, int], y: Column) -> Column:
    return F.coalesce(*[F.when(y == v, F.lit(k)) for k, v in label_map.items()], F.lit(None).cast("string"))


def read_batch(spark: SparkSession, root: str, split: str, batch: int, size: int, seed: int, epoch: int = 0) -> DataFrame:
    """Batch number ``batch`` of an epoch's seeded order, with ``position``: only its items are read, and nothing is sorted.

    The order is a permutation by arithmetic, run backwards for the batch's positions.
    """
    count = _entry(read_manifest(root), split)["count"]
    positions = np.arange(batch * size, min((batch + 1) * size, count))
    if not len(positions):
        raise IndexError(f"an epoch has {-(-count // size)} batches of {size}")
    places = order.unpermute(positions, count, seed, epoch)
    rows = read_shards(spark, root, split, places.tolist())
    return rows.withColumn("position", order.position("item", count, seed, epoch))
