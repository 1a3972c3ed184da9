"""SimHash near-dedup: fingerprints linked through Golay-code fuzzy hashing.

A 64-bit fingerprint has four segments of 16 bits. Of two fingerprints that differ in at most 3 bits,
some segment is equal in both, and the next one (in a ring) differs in at most 2: were it to hold all
3, the other segments would all be equal and a different start serves. So a fingerprint gets, for each
segment, the keys (segment itself, codeword near the next segment), at most 24 in all; fingerprints that
share a key are compared bit by bit, which makes the links exact.

Wider distances, up to 11, have five segments of 13 bits (the last of 12): four of them can't all differ in 3 or more, so two
differ in at most 2 each, and the keys are the pairs of codewords of two segments, some 280 in all. Of these links a task
returns the nearest first, for a check that follows.

Only distinct fingerprints are keyed, so exact copies cost one row. Keys that many fingerprints share
are cut into blocks, and each pair of blocks is compared in a task of its own; a task returns a spanning
forest of its links, never all pairs. Components come from randomised contraction.

Defined results: a null text counts as empty; a text without words has fingerprint zero and is linked
like any other; rows that repeat an id each get a row; a null id is never the smallest unless all are
null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.golay import codewords
from wavemill.llm.shared import bounded_batches, components, fresh_worker, require_columns, settle, settle_narrow, skew_safe_left_join, task_slots

WORDS, DISTANCE, SEED = 3, 3, 42
#: Fingerprints of one key that are compared in one task; larger keys are cut into blocks of this size.
BLOCK = 2048
#: The widest distance for which keys of two segments are complete, and the bits of the segments.
WIDE, WIDE_BITS = 11, (13, 13, 13, 13, 12)
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_CHUNK = 1 << 16
_TIES = 0x9E3779B97F4A7C15


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority of each bit over the XXH64 hashes of all shingles, repeats included."""
    from xxhash import xxh64_digest

    parts = (text or "").encode().translate(LOWER).split()
    n = len(parts)
    if not n:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if n >= words:
        ends, starts = ends[words - 1 :], starts[: n - words + 1]
    else:
        ends, starts = ends[-1:], starts[:1]
    ones = np.zeros(64, np.int64)
    for a in range(0, len(ends), _CHUNK):
        digests = [xxh64_digest(joined[i:j], SEED) for i, j in zip(starts[a : a + _CHUNK].tolist(), ends[a : a + _CHUNK].tolist())]
        bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(ends)).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """Fingerprint (as a signed long) of hashes (uint64) that are at hand."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[a : a + _CHUNK]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id, fp (the fingerprint as a signed long) and _text_key, without a shuffle."""
    require_columns(docs, [id_col, text_col])
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), batch.column(2)], names=[id_col, "fp", "_text_key"])

    text = F.col(text_col).cast("string")
    return docs.select(id_col, text.alias("_text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_text_key")).mapInArrow(
        run, f"`{id_col}` {kind}, fp long, _text_key long"
    )


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, key) pairs of all keys of ``fps`` (uint64)."""
    segments = [(fps >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    places, keys = [], []
    for i in range(4):
        near, real = codewords(segments[(i + 1) % 4])
        at, column = np.nonzero(real)
        places.append(at)
        keys.append((np.int64(i) << 28) | (segments[i][at] << 12) | near[at, column].astype(np.int64))
    return np.concatenate(places), np.concatenate(keys)


def wide_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, key) pairs of ``fps`` (uint64) for distances up to WIDE."""
    found, low = [], 0
    for bits in WIDE_BITS:
        found.append(codewords((fps >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64)))
        low += bits
    places, keys = [], []
    for k, ((x, x_real), (y, y_real)) in enumerate(combinations(found, 2)):
        at, i, j = np.nonzero(x_real[:, :, None] & y_real[:, None, :])
        places.append(at)
        keys.append((np.int64(k) << 24) | (x[at, i].astype(np.int64) << 12) | y[at, j].astype(np.int64))
    return np.concatenate(places), np.concatenate(keys)


def _forest(fps: list[int], distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of ``fps`` (distinct, signed) by Hamming distance."""
    n, out = len(fps), []
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    if n <= 16:
        near = ((i, j) for i in range(n) for j in range(i + 1, n) if ((fps[i] ^ fps[j]) & 0xFFFFFFFFFFFFFFFF).bit_count() <= distance)
    else:
        a = np.array(fps, np.int64).view(np.uint64)
        near = ((i, i + 1 + int(j)) for i in range(n - 1) for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= distance))
    for i, j in near:
        x, y = root(i), root(j)
        if x != y:
            up[x] = y
            out.append((fps[i], fps[j]))
    return out


def _nearest_forest(fps: list[int], distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest as of :func:`_forest`, with the least sum of distances.

    Ties are broken by a hash of the differing bits, so keys that hold the same fingerprints mostly give the same links.
    """
    n, out = len(fps), []
    if n <= 16:
        near = []
        for i in range(n):
            for j in range(i + 1, n):
                x = (fps[i] ^ fps[j]) & 0xFFFFFFFFFFFFFFFF
                if (d := x.bit_count()) <= distance:
                    near.append((d, x * _TIES & 0xFFFFFFFFFFFFFFFF, i, j))
        up = list(range(n))
        for _, _, i, j in sorted(near):
            if up[i] != up[j]:
                up = [up[i] if r == up[j] else r for r in up]
                out.append((fps[i], fps[j]))
        return out
    a = np.array(fps, np.int64).view(np.uint64)
    most = np.iinfo(np.uint64).max
    far, to, left, at = np.full(n, most, np.uint64), np.zeros(n, np.int64), np.ones(n, bool), 0
    for _ in range(n - 1):
        left[at], far[at] = False, most
        x = a ^ a[at]
        d = np.bitwise_count(x).astype(np.uint64) << np.uint64(56) | x * np.uint64(_TIES) >> np.uint64(8)
        nearer = left & (d < far)
        far[nearer], to[nearer] = d[nearer], at
        at = int(far.argmin())
        if far[at] >> np.uint64(56) <= distance:
            out.append((fps[to[at]], fps[at]))
    return out


def links(distinct: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(u, v) links between the fingerprints of ``distinct`` (fp), enough to connect all within ``distance`` (WIDE at most)."""
    if not 0 <= distance <= WIDE:
        raise ValueError(f"the keys hold for distances up to {WIDE}")
    keys_of, forest, step = (fuzzy_keys, _forest, 20_000) if distance <= 3 else (wide_keys, _nearest_forest, 1_000)

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                fps = batch.column(0).slice(a, step).to_numpy(zero_copy_only=False)
                at, keys = keys_of(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[at])], names=["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(key_rows, "key long, fp long")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keyed.join(sizes, "key").withColumn("b", F.ceil(F.col("n") / block).cast("int"))
    mine = F.pmod(F.xxhash64("fp", "key"), F.col("b")).cast("int")
    tiles = met.withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, b - 1)")))
    tiles = tiles.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"), "key", "fp")
    dealt = tiles.repartition(task_slots(distinct.sparkSession), "tile").sortWithinPartitions("tile", "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        out: list[tuple[int, int]] = []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["u", "v"])

        for batch in batches:
            for tile, key, fp in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (tile, key) != at:
                    out += forest(held, distance) if len(held) > 1 else []
                    at, held = (tile, key), []
                    if len(out) > 50_000:
                        yield batch_of(out)
                        out = []
                held.append(fp)
        out += forest(held, distance) if len(held) > 1 else []
        if out:
            yield batch_of(out)

    return dealt.mapInArrow(compare, "u long, v long").distinct()


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE
) -> DataFrame:
    """id, fp, component_id (smallest id that links reach), kept (one row of each component), _text_key."""
    rows = settle(fingerprints(docs, id_col, text_col, words).withColumn("_row", F.monotonically_increasing_id()))
    return decide(rows, lambda distinct: components(links(distinct, distance)), id_col)


def decide(rows: DataFrame, roots: DataFrame | Callable[[DataFrame], DataFrame], id_col: str) -> DataFrame:
    """What :func:`near_components` returns, of ``rows`` (id, fp, _text_key, _row; settled) and the roots (node, root) of linked fp."""
    best = lambda c: F.min(F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("i"), F.col("_row").alias("r")))
    distinct = settle_narrow(rows.groupBy("fp").agg(best(id_col).alias("best"), F.count(F.lit(1)).alias("size")))
    roots = roots(distinct) if callable(roots) else roots
    known = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lead = known.groupBy("root").agg(F.min("best").alias("lead"), F.count(F.lit(1)).alias("fps"))
    groups = known.join(lead, "root").where("size > 1 or fps > 1").select("fp", "size", F.col("lead.i").alias("lead_id"), F.col("lead.r").alias("lead_row"))
    met = skew_safe_left_join(rows, groups, "fp", "size", rows.count())
    alone = F.col("lead_row").isNull()
    return met.select(
        id_col,
        "fp",
        F.when(alone, F.col(id_col)).otherwise(F.col("lead_id")).alias("component_id"),
        (alone | (F.col("lead_row") == F.col("_row"))).alias("kept"),
        "_text_key",
    )
