"""A small convolutional classifier of windows, trained by synchronous data-parallel gradient descent.

Three convolutions with batch normalisation, ReLU and pooling, a mean over time, dropout, one linear layer. The mean over time
makes the number of parameters independent of the window's length.

A step's batch is made of micro-batches of a fixed size. Which windows are in which follows from (seed, epoch) by a permutation of places,
never from where rows lie. An epoch is one stage of barrier tasks: each task computes the gradients of its micro-batches, tasks exchange them, and
every task adds them up in the order of micro-batches and takes the same step of Adam. So weights depend on seed,
data and sizes only, whatever the number of tasks. Batch statistics are those of a micro-batch. A task holds one Arrow
batch and one micro-batch; weights (some 100 kB) come back to the driver after each epoch, from which a lost
executor's epoch starts again.
"""

from __future__ import annotations

import base64
import io
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators import order
from wavemill.operators.split import SPLITS

#: Channels and kernel of each convolution; the share of values that dropout zeroes; the budget of parameters. Fixed values.
LAYERS, DROPOUT, MAX_PARAMETERS = ((16, 7), (32, 5), (64, 5)), 0.3, 50_000
EPOCHS, BATCH, MICRO, RATE = 10, 64, 32, 1e-3
MOMENTUM, SMALL = 0.1, 1e-5
BETAS, ADAM_SMALL = (0.9, 0.999), 1e-8


class TrainingError(ValueError):
    """Windows that the classifier can't be trained on."""


@dataclass
class Net:
    """Weights, running statistics and Adam's moments, all by name."""

    classes: list[str]
    weights: dict[str, np.ndarray]
    running: dict[str, np.ndarray]
    moments: dict[str, np.ndarray] = field(default_factory=dict)
    steps: int = 0

    @property
    def parameters(self) -> int:
        return sum(w.size for w in self.weights.values())

    def dump(self) -> bytes:
        out = io.BytesIO()
        groups = (("w", self.weights), ("r", self.running), ("m", self.moments))
        np.savez(out, steps=self.steps, **{f"{g}:{k}": v for g, d in groups for k, v in d.items()})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes, classes: list[str]) -> Net:
        with np.load(io.BytesIO(raw)) as z:
            of = lambda g: {k[2:]: z[k] for k in z.files if k.startswith(f"{g}:")}
            return cls(classes, of("w"), of("r"), of("m"), int(z["steps"]))


def new_net(classes: list[str], channels: int = 2, seed: int = 0, kind: type = np.float32) -> Net:
    """Weights uniform within one over the root of a unit's inputs."""
    rng = np.random.default_rng([seed, 1])
    weights, running, inputs = {}, {}, channels
    for i, (out, kernel) in enumerate(LAYERS):
        bound = 1 / math.sqrt(inputs * kernel)
        weights[f"conv{i}"] = rng.uniform(-bound, bound, (inputs * kernel, out)).astype(kind)
        weights[f"bias{i}"] = rng.uniform(-bound, bound, out).astype(kind)
        weights[f"scale{i}"], weights[f"shift{i}"] = np.ones(out, kind), np.zeros(out, kind)
        running[f"mean{i}"], running[f"var{i}"] = np.zeros(out, kind), np.ones(out, kind)
        inputs = out
    bound = 1 / math.sqrt(inputs)
    weights["linear"] = rng.uniform(-bound, bound, (inputs, len(classes))).astype(kind)
    weights["bias"] = rng.uniform(-bound, bound, len(classes)).astype(kind)
    net = Net(list(classes), weights, running)
    if net.parameters > MAX_PARAMETERS:
        raise TrainingError(f"{net.parameters} parameters are over the budget of {MAX_PARAMETERS}: {len(classes)} classes are too many")
    net.moments = {f"{k}{j}": np.zeros(w.shape, np.float64) for k, w in weights.items() for j in "ab"}
    return net


def _columns(x: np.ndarray, kernel: int) -> np.ndarray:
    """(batch, time, channels) to (batch * time, channels * kernel), zero-padded to the same length."""
    padded = np.pad(x, ((0, 0), (kernel // 2, kernel // 2), (0, 0)))
    return np.lib.stride_tricks.sliding_window_view(padded, kernel, axis=1).reshape(x.shape[0] * x.shape[1], -1)


def forward(net: Net, x: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list[dict]]:
    """Scores of ``x`` (windows, samples, channels). With ``rng``, as in training: batch statistics and dropout."""
    kept: list[dict] = []
    for i, (out, kernel) in enumerate(LAYERS):
        cols = _columns(x, kernel)
        z = cols @ net.weights[f"conv{i}"] + net.weights[f"bias{i}"]
        mean, var = (z.mean(axis=0), z.var(axis=0)) if rng is not None else (net.running[f"mean{i}"], net.running[f"var{i}"])
        inverse = 1 / np.sqrt(var + z.dtype.type(SMALL))
        unit = (z - mean) * inverse
        y = np.maximum(unit * net.weights[f"scale{i}"] + net.weights[f"shift{i}"], 0).reshape(x.shape[0], x.shape[1], out)
        own = {"shape": x.shape, "cols": cols, "unit": unit, "inverse": inverse, "mean": mean, "var": var, "on": y > 0}
        if i < len(LAYERS) - 1:
            pairs = y[:, : y.shape[1] // 2 * 2].reshape(y.shape[0], -1, 2, out)
            own["second"] = pairs[:, :, 1] > pairs[:, :, 0]
            y = np.where(own["second"], pairs[:, :, 1], pairs[:, :, 0])
        kept.append(own)
        x = y
    length = x.shape[1]
    pooled = x.mean(axis=1)
    keep = (rng.random(pooled.shape) >= DROPOUT).astype(pooled.dtype) / pooled.dtype.type(1 - DROPOUT) if rng is not None else np.ones_like(pooled)
    dropped = pooled * keep
    kept.append({"length": length, "keep": keep, "input": dropped})
    return dropped @ net.weights["linear"] + net.weights["bias"], kept


def gradient(net: Net, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[float, int, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Mean cross-entropy of a micro-batch, hits, the gradient of each weight, and the statistics of its layers."""
    scores, kept = forward(net, x, rng)
    n = len(y)
    shifted = scores - scores.max(axis=1, keepdims=True)
    odds = np.exp(shifted)
    odds /= odds.sum(axis=1, keepdims=True)
    loss = float(-np.log(np.maximum(odds[np.arange(n), y], 1e-30)).mean())
    d = odds.copy()
    d[np.arange(n), y] -= 1
    d /= n
    head = kept[-1]
    grads = {"linear": head["input"].T @ d, "bias": d.sum(axis=0)}
    d = ((d @ net.weights["linear"].T) * head["keep"] / head["length"])[:, None, :]
    stats: dict[str, np.ndarray] = {}
    for i in reversed(range(len(LAYERS))):
        out, kernel = LAYERS[i]
        own = kept[i]
        b, length, channels = own["shape"]
        if i < len(LAYERS) - 1:
            spread = np.zeros((b, length, out), d.dtype)
            pairs = spread[:, : length // 2 * 2].reshape(b, -1, 2, out)
            pairs[:, :, 1], pairs[:, :, 0] = d * own["second"], d * ~own["second"]
            spread[:, : length // 2 * 2] = pairs.reshape(b, -1, out)
            d = spread
        d = (np.broadcast_to(d, (b, length, out)) * own["on"]).reshape(-1, out)
        grads[f"scale{i}"], grads[f"shift{i}"] = (d * own["unit"]).sum(axis=0), d.sum(axis=0)
        du = d * net.weights[f"scale{i}"]
        dz = own["inverse"] * (du - du.mean(axis=0) - own["unit"] * (du * own["unit"]).mean(axis=0))
        grads[f"conv{i}"], grads[f"bias{i}"] = own["cols"].T @ dz, dz.sum(axis=0)
        m = len(dz)
        stats[f"mean{i}"], stats[f"var{i}"] = own["mean"], own["var"] * (m / max(m - 1, 1))
        if i:
            dc = (dz @ net.weights[f"conv{i}"].T).reshape(b, length, channels, kernel)
            padded = np.zeros((b, length + kernel - 1, channels), dc.dtype)
            for k in range(kernel):
                padded[:, k : k + length] += dc[..., k]
            d = padded[:, kernel // 2 : kernel // 2 + length]
    return loss, int((scores.argmax(axis=1) == y).sum()), grads, stats


def step(net: Net, found: list[tuple[int, dict, dict]], rate: float) -> None:
    """One step of Adam by the gradients (windows, gradient, statistics) of a batch's micro-batches, in their order."""
    total = sum(n for n, _, _ in found)
    net.steps += 1
    for _, _, stats in found:
        for k, v in stats.items():
            net.running[k] = ((1 - MOMENTUM) * net.running[k] + MOMENTUM * v).astype(net.running[k].dtype)
    for k, w in net.weights.items():
        g = sum(grads[k].astype(np.float64) * (n / total) for n, grads, _ in found)
        a, b = net.moments[f"{k}a"], net.moments[f"{k}b"]
        a += (1 - BETAS[0]) * (g - a)
        b += (1 - BETAS[1]) * (g * g - b)
        move = rate * (a / (1 - BETAS[0] ** net.steps)) / (np.sqrt(b / (1 - BETAS[1] ** net.steps)) + ADAM_SMALL)
        net.weights[k] = (w - move).astype(w.dtype)


def _lists(array: pa.Array, kind: type = np.float32) -> np.ndarray:
    return np.asarray(array.flatten()).astype(kind).reshape(len(array), -1)


def stacked(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """(windows, samples, 2) of the columns i and q."""
    return np.stack([_lists(batch.column("i")), _lists(batch.column("q"))], axis=2)


def _micro_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number, x, y) of rows that come by ``position``."""
    number, xs, ys = -1, [], []
    for batch in batches:
        at = np.asarray(batch.column("position")) // size
        x, y = stacked(batch), np.asarray(batch.column("y"))
        cuts = np.flatnonzero(np.diff(at)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(at)]):
            if a == b:
                continue
            if at[a] != number and xs:
                yield number, np.concatenate(xs), np.concatenate(ys)
                xs, ys = [], []
            number = int(at[a])
            xs.append(x[a:b])
            ys.append(y[a:b])
    if xs:
        yield number, np.concatenate(xs), np.concatenate(ys)


def _pack(found: dict[int, tuple]) -> str:
    out = io.BytesIO()
    flat = {}
    for m, (n, loss, hits, grads, stats) in found.items():
        flat |= {f"{m}:n": np.array([n, loss, hits])} | {f"{m}:g:{k}": v for k, v in grads.items()} | {f"{m}:s:{k}": v for k, v in stats.items()}
    np.savez(out, **flat)
    return base64.b64encode(out.getvalue()).decode()


def _unpack(said: list[str]) -> dict[int, tuple]:
    found: dict[int, tuple] = {}
    for text in said:
        with np.load(io.BytesIO(base64.b64decode(text))) as z:
            for key in (k for k in z.files if k.endswith(":n")):
                m = key.split(":")[0]
                of = lambda g: {k.split(":")[2]: z[k] for k in z.files if k.startswith(f"{m}:{g}:")}  # noqa: B023, E731
                n, loss, hits = z[key]
                found[int(m)] = (int(n), float(loss), int(hits), of("g"), of("s"))
    return found


@dataclass(frozen=True)
class Epoch:
    epoch: int
    train_loss: float
    train_accuracy: float
    val_accuracy: float | None


@dataclass
class Trained:
    net: Net
    epochs: list[Epoch]


def _run_epoch(raw: bytes, classes: list[str], n: int, batch: int, micro: int, seed: int, epoch: int, rate: float, workers: int):
    a_step = -(-batch // micro)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = None
        if workers > 1:
            from pyspark import BarrierTaskContext

            context = BarrierTaskContext.get()
        net, loss, hits = Net.load(raw, classes), 0.0, 0
        own = _micro_batches(batches, micro)
        ahead = next(own, None)
        for at in range(-(-(-(-n // micro)) // a_step)):
            found = {}
            while ahead is not None and ahead[0] // a_step == at:
                number, x, y = ahead
                found[number] = (len(y), *gradient(net, x, y, np.random.default_rng([seed, 2, epoch, number])))
                ahead = next(own, None)
            if context is not None:
                found = _unpack(context.allGather(_pack(found)))
            ordered = [found[m] for m in sorted(found)]
            step(net, [(c, g, s) for c, _, _, g, s in ordered], rate)
            loss, hits = loss + sum(c * v for c, v, _, _, _ in ordered), hits + sum(h for _, _, h, _, _ in ordered)
        if context is None or context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([net.dump()], pa.binary()), pa.array([loss / n]), pa.array([hits / n])], names=["state", "loss", "accuracy"])

    return run


def classes_of(windows: DataFrame) -> list[str]:
    """The labels, sorted: a driver's list as long as there are classes."""
    return sorted(r[0] for r in windows.where("label is not null").select(F.col("label").cast("string")).distinct().collect())


def train(
    windows: DataFrame,
    seed: int = 0,
    epochs: int = EPOCHS,
    batch: int = BATCH,
    micro: int = MICRO,
    rate: float = RATE,
    workers: int | None = None,
    on_epoch: Callable[[Epoch], None] | None = None,
    ids: tuple[str, ...] = ("record_id", "window_ix"),
    classes: list[str] | None = None,
) -> Trained:
    """Train on the windows of split ``train`` (label, split, i, q and ``ids``, which order them), validated on ``val`` after each epoch.

    ``workers`` tasks run at once; at most one for each micro-batch of a batch, and as many as the session has slots.
    """
    spark = windows.sparkSession
    usable = windows.where("label is not null and i is not null and q is not null")
    classes = classes or classes_of(usable)
    rows = usable.where(F.col("split") == SPLITS[0])
    y = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label").cast("string")) - 1).cast("int") if classes else F.lit(0)
    rows = order.places(rows.select(*ids, y.alias("y"), F.col("i").cast("array<float>").alias("i"), F.col("q").cast("array<float>").alias("q")), ids)
    shape = rows.agg(F.count(F.lit(1)), F.min(F.size("i")), F.max(F.size("i")), F.min(F.size("q")), F.max(F.size("q"))).first()
    n = shape[0]
    if not n:
        raise TrainingError("split train has no labelled windows")
    if len(set(shape[1:])) != 1 or shape[1] < 4:
        raise TrainingError("windows must have one length of at least 4 samples, in i and q")
    slots = spark.sparkContext.defaultParallelism
    workers = max(1, min(workers or slots, slots, -(-batch // micro)))
    net, found = new_net(classes, seed=seed), []
    held_out = usable.where(F.col("split") == SPLITS[1])
    validate = not held_out.isEmpty()
    for e in range(1, epochs + 1):
        dealt = rows.withColumn("position", order.position("place", n, seed, e))
        number = F.expr(f"position div {micro}")
        dealt = dealt.repartitionById(workers, ((number % -(-batch // micro)) % workers).cast("int")).sortWithinPartitions("position")
        run = _run_epoch(net.dump(), classes, n, batch, micro, seed, e, rate, workers)
        r = dealt.select("position", "y", "i", "q").mapInArrow(run, "state binary, loss double, accuracy double", barrier=workers > 1).collect()[0]  # one row
        net = Net.load(bytes(r.state), classes)
        found.append(Epoch(e, r.loss, r.accuracy, hit_share(predict(held_out, net)) if validate else None))
        if on_epoch:
            on_epoch(found[-1])
    return Trained(net, found)


def predict(windows: DataFrame, net: Net) -> DataFrame:
    """(label, prediction) of each window with samples."""
    raw, classes = net.dump(), net.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Net.load(raw, classes)
        names = np.array(classes, dtype=object)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                best = forward(own, stacked(part))[0].argmax(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(names[best].tolist(), pa.string())], names=["label", "prediction"])

    rows = windows.where("i is not null and q is not null")
    rows = rows.select(F.col("label").cast("string").alias("label"), F.col("i").cast("array<float>").alias("i"), F.col("q").cast("array<float>").alias("q"))
    return rows.mapInArrow(run, "label string, prediction string")


def hit_share(predictions: DataFrame) -> float:
    """Share of labelled windows whose label is the prediction; 0 of none."""
    r = predictions.where("label is not null").agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()
    return float(r[0] or 0.0)
