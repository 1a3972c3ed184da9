"""Side tables: label and group CSVs, frame indexes, manifests, measurement logs."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = 1
RUN_SCHEMA = 1


class TableError(ValueError):
    """A side table that lacks what it must have, or is from a later version."""


def _csv(spark: SparkSession, path: str, needed: tuple[str, ...]) -> DataFrame:
    rows = spark.read.csv(path, header=True)
    if missing := [c for c in needed if c not in rows.columns]:
        raise TableError(f"{path} needs the columns {', '.join(needed)}; missing: {', '.join(missing)}")
    return rows


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    """filename, label; rows without a file name are left out."""
    return _csv(spark, path, ("filename", "label")).where(F.length("filename") > 0).select("filename", "label")


def read_group_csv(spark: SparkSession, path: str) -> DataFrame:
    """recording, group; rows without either are left out."""
    return _csv(spark, path, ("recording", "group")).where((F.length("recording") > 0) & (F.length("group") > 0)).select("recording", "group")


def frame_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(sigmf_file, offset): where the first frame of each file begins."""
    rows = _csv(spark, path, ("sigmf_file", "sigmf_file_offset"))
    return rows.groupBy("sigmf_file").agg(F.min(F.col("sigmf_file_offset").cast("long")).alias("offset"))


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """A small file on whatever store the path names."""
    fs, p = _hadoop(spark, path)
    out = fs.create(p, replace)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def check_schema(found: object, known: int, what: str) -> int:
    """Version of a file: none is 0, lower and equal ones are read, later ones and other types are refused."""
    if found is None:
        return 0
    if isinstance(found, bool) or not isinstance(found, int):
        raise TableError(f"{what}: the schema version must be a whole number, not {found!r}")
    if found > known:
        raise TableError(f"{what} has schema {found}; this version reads up to {known}")
    return found


def write_manifest(spark: SparkSession, root: str, manifest: dict) -> None:
    body = {"manifest_schema": MANIFEST_SCHEMA, "created": datetime.now(timezone.utc).isoformat()} | manifest
    write_text(spark, f"{root.rstrip('/')}/manifest.json", json.dumps(body, ensure_ascii=False, indent=1), replace=True)


def read_manifest(spark: SparkSession, root: str) -> dict:
    body = json.loads(read_text(spark, f"{root.rstrip('/')}/manifest.json"))
    check_schema(body.get("manifest_schema"), MANIFEST_SCHEMA, "manifest")
    return body


RUN_COLUMNS = "noise_sigma double, snr_db double, strategy string, split_seed int, train_seed int, test_accuracy double, train_accuracy double, train_windows long, test_windows long, stride int, environment map<string,string>"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a measurement log: its ``measurement.rows``. A log without rows, or of a later schema, raises."""
    body = json.loads(read_text(spark, path))
    m = body.get("measurement", body)
    check_schema(m.get("measurement_schema", body.get("measurement_schema")), RUN_SCHEMA, "measurement log")
    rows = m.get("rows")
    if not rows:
        raise TableError("the measurement log has no rows")
    names = [c.split()[0] for c in RUN_COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RUN_COLUMNS)


def write_runs(spark: SparkSession, path: str, runs: DataFrame, replace: bool = False) -> None:
    """Write a log. An existing one with more rows is never replaced."""
    rows = [r.asDict() for r in runs.collect()]
    fs, p = _hadoop(spark, path)
    if fs.exists(p):
        old = read_runs(spark, path).count()
        if old > len(rows):
            raise TableError(f"{path} has {old} rows, more than the {len(rows)} that would replace them")
        if not replace:
            raise TableError(f"{path} exists")
    write_text(spark, path, json.dumps({"measurement": {"measurement_schema": RUN_SCHEMA, "rows": rows}}), replace=True)
