"""Command line: info, inspect, build, stats, train, audit, measure-leakage, version."""

from __future__ import annotations

import argparse
import json
import math
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from wavemill import __version__, get_session
from wavemill.operators import audit, convnet, decide, features, labels, measure, signal, spectrum, split, stats, windows
from wavemill.plans import build as plans
from wavemill.plans import measurement, report
from wavemill.sources import dataset, sigmf, tables


def _numbers(text: str, kind=float) -> tuple:
    return tuple(kind(x) for x in text.split(","))


def _seeds(text: str) -> tuple[int, ...]:
    found = tuple(int(x) for x in text.split(",") if x.strip())
    if not found or len(set(found)) < len(found):
        raise ValueError(f"seeds must be different whole numbers, not {text!r}")
    return found


def _config(a: argparse.Namespace) -> plans.BuildConfig:
    return plans.BuildConfig(
        window=a.window, stride=a.stride, label_source=a.labels, label_csv=a.label_csv, dirname_level=a.dirname_level,
        exclude=tuple(a.exclude_label) if a.exclude_label else None, keep_unlabeled=a.keep_unlabeled, ratios=_numbers(a.split), seed=a.seed,
        group_by=a.group_by, balance_by=a.balance_by, representation=a.representation, normalize=not a.no_normalize,
    )


def info(spark, a) -> int:
    for r in plans.some_recordings(sigmf.scan(spark, a.input), a.input).orderBy("record_id").toLocalIterator():
        print(f"{r.record_id}: {r.datatype}, {report.hertz(r.sample_rate)}, {r.num_samples} samples, {r.num_samples / r.sample_rate:.6f} s, centre {report.hertz(r.center_frequency)}, {len(r.annotations)} annotations")
        for x in r.annotations:
            print(f"  [{x.sample_start}, {x.sample_start + x.sample_count}) {x.label or '-'} {report.hertz(x.freq_lower_edge)}..{report.hertz(x.freq_upper_edge)}" + (" beyond end" if x.sample_start + x.sample_count > r.num_samples else ""))
    return 0


def inspect(spark, a) -> int:
    one = plans.some_recordings(sigmf.scan(spark, a.input), a.input).limit(1)
    r = one.first()
    count = r.num_samples - a.start if a.count is None else min(a.count, r.num_samples - a.start)
    if a.start < 0 or a.nfft < 2 or count < a.nfft:
        raise ValueError(f"{max(count, 0)} samples from {a.start} are fewer than nfft {a.nfft}")
    seen = spark.createDataFrame([(r.record_id, r.data_path, r.datatype, count)], "record_id string, data_path string, datatype string, num_samples long")
    runs = spectrum.frame_runs(seen, a.nfft).withColumn("start", F.col("start") + a.start)
    cells = spectrum.spectrogram(sigmf.planned_by_bytes(runs, sigmf.bytes_per_sample(F.col("datatype")), F.col("start"), F.col("count")), sigmf.read_range, a.nfft, 32).collect()
    pixels = [[-240.0] * (max(c.col for c in cells) + 1) for _ in range(max(c.row for c in cells) + 1)]
    for c in cells:
        pixels[c.row][c.col] = c.db
    half, means = r.sample_rate / 2, [sum(line) / len(line) for line in pixels]
    best = half - (means.index(max(means)) + 0.5) * r.sample_rate / len(pixels)
    print(f"{r.record_id}: {count} samples, frames of {a.nfft}, strongest around {report.hertz(best)} from the centre")
    print(report.heatmap(pixels, (-half, half), (a.start / r.sample_rate, (a.start + count) / r.sample_rate)))
    levels = spectrum.power_levels(seen, sigmf.read_range, a.start).orderBy("bucket").collect()
    print(report.sparkline([x.db for x in levels]))
    return 0


def build(spark, a) -> int:
    m = plans.build(spark, a.input, a.output, _config(a), a.files)
    for w in m["warnings"]:
        print(f"warning: {w}")
    s = m["stats"]
    print(f"{s['total']} windows: {s['labeled']} labelled, {s['unmatched']} unmatched, {s['ambiguous']} ambiguous")
    for name, v in m["splits"].items():
        print(f"{name}: {v['count']} windows of {len(v['records'])} recordings")
    return 0


def show_stats(spark, a) -> int:
    m = tables.read_manifest(spark, a.dataset)
    rows = plans.manifest_records(spark, m)
    for r in stats.split_histogram(rows).orderBy("label").collect():
        print(f"{r.label}: train {r.train}, val {r.val}, test {r.test} recordings")
    for r in stats.offset_signs(rows, "carrier_offset_hz").orderBy("split").collect():
        print(f"{r.split}: {r.negative} negative, {r.positive} other offsets" + (", all on one side" if r.one_sided else ""))
    if m["config"].get("group_by"):
        g = rows.groupBy("unit").count().agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most")).first()
        print(f"{g.n} groups by {m['config']['group_by']}, the largest of {g.most} recordings")
    print(f"{dataset.dataset_bytes(spark, a.dataset)} bytes")
    return 0


def train(spark, a) -> int:
    def told(e: convnet.Epoch) -> None:
        held = "" if e.val_accuracy is None else f", val accuracy {100 * e.val_accuracy:.1f} %"
        print(f"epoch {e.epoch}: loss {e.train_loss:.4f}, train accuracy {100 * e.train_accuracy:.1f} %{held}")

    rows = plans.built_windows(spark, a.dataset)
    found = convnet.train(rows, a.seed, a.epochs, a.batch_size, rate=a.learning_rate, on_epoch=told)
    print(f"{found.net.parameters} parameters, classes {', '.join(found.net.classes)}")
    per = stats.per_class_accuracy(convnet.predict(rows.where(F.col("split") == split.SPLITS[2]), found.net), "label", "prediction")
    for r in per.orderBy("label").collect():
        print(f"class {r.label}: {100 * r.accuracy:.1f} % of {r.n}")
    print(f"test accuracy {100 * measure.accuracy(per):.2f} %")
    return 0


def _folder(spark, a):
    """The folder's table of recordings, what its label table leaves open (else None), and the scan."""
    recordings = plans.some_recordings(sigmf.scan(spark, a.input, strict=False), a.input)
    named = recordings.where("error is null")
    checked = None
    if a.labels == "dirname":
        lab = labels.label_by_dirname(named, a.dirname_level).select("record_id", "label")
    elif a.labels == "csv":
        if not a.label_csv:
            raise plans.BuildError("label source csv needs a file")
        told = labels.lookup(named, tables.read_label_csv(spark, a.label_csv), "filename", "label")
        lab = told.select("record_id", "label")
        used = labels.dominant_label(windows.window_starts(told.where("label is not null"), a.window, a.stride, ("record_id", "label")))
        checked = audit.check_label_table(labels.lost_labels(lab, used), told.where("matched_by is null"))
    else:
        lab = labels.dominant_label(labels.label_windows_nested(named, a.window, a.stride)).select("record_id", "label")
    rows = features.measure(recordings, lab)
    digests = sigmf.range_digests(named)
    rows = rows.join(named.select("record_id", "data_path").join(digests, "data_path").select("record_id", "digest"), "record_id", "left")
    bad = recordings.where("error is not null").select("record_id", "error")
    return rows.unionByName(bad, allowMissingColumns=True).persist(), checked, recordings


def _built(spark, a, m: dict):
    """Findings of a built dataset. Its recordings are looked for where it was built from, then beside the dataset."""
    rows = plans.manifest_records(spark, m)
    source, here = m["config"]["input"].rstrip("/"), a.input.rstrip("/")
    above = here.rpartition("/")[0] or "."
    beside = f"{above}/{source.rpartition('/')[2]}"
    try:
        found = plans.locate_sources(spark, rows, [source, here, beside]).persist()
        have = features.measure(found, rows.select("record_id", "label")).drop("label", "carrier_offset_hz")
        n, met = rows.count(), found.count()
    except plans.BuildError:
        n, met = rows.count(), 0
    lost = None if met == n else f"{n - met} of {n} source recordings not found; looked in {source}, {here}, {beside}"
    if not met:
        have = spark.createDataFrame([], f"record_id string, start double, end double, collection string, occupied_bw_hz double, sample_rate double, {features.SCALARS}")
    sizes = {s: v["count"] for s, v in m["splits"].items()}
    return audit.audit_dataset(rows.join(have, "record_id", "left"), m["config"]["window"], m["config"]["stride"], windows=sizes, no_axes=lost, partly=bool(met))


def run_audit(spark, a) -> int:
    m = tables.read_manifest(spark, a.input) if tables.exists(spark, f"{a.input.rstrip('/')}/manifest.json") else None
    mark = None
    if m:
        found = _built(spark, a, m)
        detail = f"{sum(v['count'] for v in m['splits'].values())} windows of {m['config']['window']} at stride {m['config']['stride']}"
    else:
        rows, checked, recordings = _folder(spark, a)
        found = audit.audit_folder(rows, a.window, a.stride, checked)
        detail = f"{rows.count()} recordings"
        if a.json:
            mark = audit.fingerprint(recordings.select("path", F.col("num_samples").alias("size"))).first()[0]
    found = found.cache()
    print(report.findings_json(found, "built" if m else "folder", a.input, detail=detail, fingerprint=mark) if a.json else report.findings_text(found))
    return audit.exit_code(found, a.strict).first()[0]


def measure_leakage(spark, a) -> int:
    split_seeds, train_seeds = _seeds(a.split_seeds), _seeds(a.train_seeds)
    rows, checked, recordings = _folder(spark, a)
    found = audit.audit_folder(rows, a.window, a.stride, checked).cache()
    usable = rows.where("error is null")
    keyed = plans.group_units(spark, usable, a.group_by) if a.group_by else usable.withColumn("unit", F.col("record_id"))
    short = keyed.groupBy("label").agg(F.countDistinct("unit").alias("n")).where(F.col("n") < sum(r > 0 for r in _numbers(a.split)))
    scores = audit.verdict(audit.axis_scores(usable))
    d = decide.decide(found, scores, audit.near_duplicates(usable), audit.overlaps_not_held(keyed, "unit"), short, grouped=bool(a.group_by), force=a.force, recordings=recordings).cache()
    go = d.first().status == decide.MEASURE
    strides = measure.STRIDES if a.sweep else (a.stride,)
    snrs = _snrs(a.snr)
    seconds = None
    if go:
        rate, each = measure.probe(spark, a.window, model=a.model), len(split_seeds) * len(train_seeds) * len(snrs)
        usual = recordings.where("error is null")
        seconds = sum(decide.work_estimate(decide.predicted_windows(usual, a.window, s, _numbers(a.split)), rate, each).first().seconds for s in strides)
    print(report.decision_json(d, seconds) if a.json else report.decision_text(d), end="\n" if a.json else "")
    if not go:
        return 1
    if a.dry_run:
        return 0
    if not a.json:
        print(f"about {seconds:.0f} s of training")
    runs = measurement.measure_strides(spark, a.input, _config(a), strides, split_seeds, train_seeds, a.log, snrs=snrs, epochs=a.epochs, model=a.model)
    print(report.inflation_table(stats.paired_inflation(runs.where("snr_db is null") if len(snrs) > 1 else runs, ("stride",)), "stride") if math.inf in snrs else "", end="")
    if snrs != (math.inf,):
        gain = signal.processing_gain(usable).first().gain_db
        levels = runs.withColumn("snr_db", F.coalesce("snr_db", F.lit(math.inf)))
        for stride in strides:
            print(f"stride {stride}")
            print(report.snr_table(stats.paired_inflation(levels.where(F.col("stride") == stride), ("snr_db",)), gain))
    return 0


def _snrs(text: str) -> tuple[float, ...]:
    """Levels in dB; ``raw`` is a recording as it is."""
    found = tuple(math.inf if x.strip() == "raw" else float(x) for x in text.split(",") if x.strip())
    if not found or len(set(found)) < len(found):
        raise ValueError(f"SNRs must be different levels in dB, or raw, not {text!r}")
    return found


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wavemill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, f, *paths: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for x in paths:
            c.add_argument(x)
        c.set_defaults(run=f)
        return c

    def building(c: argparse.ArgumentParser) -> None:
        c.add_argument("--window", type=int, default=1024)
        c.add_argument("--stride", type=int, default=512)
        c.add_argument("--labels", choices=("annotations", "dirname", "csv"), default="annotations")
        c.add_argument("--label-csv")
        c.add_argument("--dirname-level", type=int, default=1)
        c.add_argument("--exclude-label", action="append")
        c.add_argument("--keep-unlabeled", action="store_true")
        c.add_argument("--split", default="0.7,0.15,0.15")
        c.add_argument("--seed", type=int, default=42)
        c.add_argument("--group-by")
        c.add_argument("--balance-by")
        c.add_argument("--representation", default="iq2ch")
        c.add_argument("--no-normalize", action="store_true")

    command("info", info, "input")
    c = command("inspect", inspect, "input")
    c.add_argument("--start", type=int, default=0)
    c.add_argument("--count", type=int, help="samples to show; all of the recording if not given")
    c.add_argument("--nfft", type=int, default=256)
    c = command("build", build, "input", "output")
    building(c)
    c.add_argument("--files", choices=(plans.PARQUET, plans.ARRAYS), default=plans.PARQUET)
    command("stats", show_stats, "dataset")
    c = command("train", train, "dataset")
    c.add_argument("--seed", type=int, default=0)
    c.add_argument("--epochs", type=int, default=convnet.EPOCHS)
    c.add_argument("--batch-size", type=int, default=convnet.BATCH)
    c.add_argument("--learning-rate", type=float, default=convnet.RATE)
    c = command("audit", run_audit, "input")
    building(c)
    c.add_argument("--json", action="store_true")
    c.add_argument("--strict", action="store_true")
    c = command("measure-leakage", measure_leakage, "input")
    building(c)
    c.add_argument("--force", action="store_true")
    c.add_argument("--json", action="store_true", help="the decision as JSON")
    c.add_argument("--dry-run", action="store_true", help="decide and estimate only")
    c.add_argument("--sweep", action="store_true", help=f"strides {', '.join(map(str, measure.STRIDES))} instead of --stride")
    c.add_argument("--snr", default="raw", help="levels in dB at which noise is added, comma-separated; raw adds none")
    c.add_argument("--epochs", type=int, default=measure.EPOCHS)
    c.add_argument("--model", choices=(measure.CNN, measure.FOREST), default=measure.CNN)
    c.add_argument("--log", help="file of finished runs; an interrupted grid goes on from it")
    c.add_argument("--split-seeds", default=",".join(map(str, measure.SPLIT_SEEDS)))
    c.add_argument("--train-seeds", default=",".join(map(str, measure.TRAIN_SEEDS)))
    command("version", lambda spark, a: print(json.dumps({"wavemill": __version__})) or 0)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if a.command == "version":
        return a.run(None, a)
    try:
        return a.run(spark or get_session(), a)
    except (ValueError, IndexError, AnalysisException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
