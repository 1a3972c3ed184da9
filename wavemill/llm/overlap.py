"""Near-dedup by similarity: texts linked where the Jaccard share of their distinct word shingles is ``LEAST`` or more.

No pair is lost and each link is verified. Shingles are put in one order for all texts, those in seldom
met hash buckets first. Of two sets with a share s, the first n - ceil(s n) + 1 of each have one in common
(prefix filter), and prefixes longer by k have k more in common, whatever the order. So of the longer
prefixes only those shingles are kept that two sets have, and only sets that keep as many as any partner
demands: sets that merely share a passage leave here, before anything but hashes has moved.

What is left gets SimHash fingerprints of its shingles. Those within 11 bits are found by Golay-code keys
(:func:`wavemill.llm.simhash.links`), and each pair found is verified. Fingerprints lose a part of the similar pairs, whatever
the bits, so an exact check follows between the classes that they leave. Each set first meets the best known set among its
shingles (the one whose shingles most sets have, as the least changed copy does), then the best of those that are not linked to
it yet. At last, all sets of different classes that share a shingle meet: each has a home, of its open shingles the one that most
sets have, and each pair of homes that meet in a shingle is one tile, so a pair of sets meets once and not in each shingle it
shares. Large tiles are cut into blocks, and each pair of blocks is met in a task of its own. It has the sets themselves and
returns a spanning forest of verified links, never all pairs.

Only distinct sets are keyed, so equal ones cost one row; shingles are told apart by 64-bit hashes. Defined
results: a text without words has one shingle of its own kind, so all such texts are linked; a text of fewer
words than a shingle is one shingle; else as in :mod:`wavemill.llm.simhash`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.llm.shared import bounded_batches, broadcast_if_small, components, fresh_worker, require_columns, settle, settle_narrow, task_slots
from wavemill.llm.simhash import BLOCK, LOWER, SEED, WIDE, decide, links, majority

WORDS, LEAST = 5, 0.8
#: How many shingles, as a share of all, prefixes are longer than one common shingle needs.
LONGER = 0.1
#: Hash buckets whose counts order the shingles.
BUCKETS = 1 << 16
#: Cells of a set's histogram: the sum of the lesser counts of two sets is at least what they share.
CELLS = 128
#: Shingles of a block of sets, at most, but for a set that has more (8 MB).
BLOCK_SHINGLES = 1 << 20
#: Pairs of one text that are verified in one task.
PAIRS_A_TASK = 1024
#: Bits of the sieve of common shingles, at most (16 MB).
SIEVE_BITS = 1 << 27
#: Turns in which each set meets one other, at most; how many there are changes costs only.
TURNS = 8
_EPS = 1e-9


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes (uint64) of the shingles."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().translate(LOWER).split()
    n = len(parts)
    if not n:
        return np.zeros(1, np.uint64)
    each = np.fromiter((xxh64_intdigest(w, SEED) for w in parts), np.uint64, n)
    k = min(words, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ each[i : n - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _name(shingles: np.ndarray) -> int:
    from xxhash import xxh64_digest

    return int.from_bytes(xxh64_digest(shingles.tobytes(), SEED), "big", signed=True)


def prefix(shingles: np.ndarray, rank: np.ndarray, least: float = LEAST) -> np.ndarray:
    """The first shingles in the order of ``rank`` (of the bucket), then hash.

    Two sets as similar as ``least`` have as many of them in common as the lesser of their :func:`common` says.
    """
    n = len(shingles)
    order = np.lexsort((shingles, rank[(shingles % np.uint64(BUCKETS)).astype(np.int64)]))
    return shingles[order[: n - int(np.ceil(least * n - _EPS)) + common(n)]]


def common(n: int) -> int:
    return max(1, int(LONGER * n))


def _demanded(n: Column, least: float) -> Column:
    """:func:`common` of the smallest set that can be as similar as ``least`` to one of ``n``."""
    return F.greatest(F.lit(1), F.floor(F.lit(LONGER) * F.ceil(F.lit(least) * n - _EPS)).cast("int"))


def _similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both) - _EPS


def histogram(shingles: np.ndarray) -> bytes:
    found = np.bincount((shingles >> np.uint64(57)).astype(np.int64), minlength=CELLS)
    # Where a count doesn't fit, all are as large as can be, which rules nothing out.
    return (found if found.max() < 65535 else np.full(CELLS, 65535)).astype(np.uint16).tobytes()


def may_be_similar(n: np.ndarray, m: np.ndarray, most: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of n and m shingles, of which at most ``most`` are shared, can be as similar as ``least``."""
    return np.minimum(most, np.minimum(n, m)) >= least / (1 + least) * (n + m) - _EPS


def _sets(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """fp, set and sim (its fingerprint), a row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            found = [shingle_set(t.as_py(), words) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_name(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())), pa.array([majority(s) for s in found], pa.int64())],
                names=["fp", "set", "sim"],
            )

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "fp long, set array<long>, sim long")


def fingerprint_pairs(sets: DataFrame, distance: int = WIDE, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of ``sets`` (fp, sim; settled) whose fingerprints are equal or linked within ``distance``."""
    named = sets.select("sim", "fp")
    lead = settle_narrow(named.groupBy("sim").agg(F.min("fp").alias("a")))
    equal = named.join(lead, "sim").where("fp != a").select("a", F.col("fp").alias("b"))
    near = settle_narrow(links(lead.select(F.col("sim").alias("fp")), distance, block))
    first, second = lead.withColumnRenamed("sim", "u"), lead.select(F.col("sim").alias("v"), F.col("a").alias("b"))
    return settle_narrow(equal.union(near.join(first, "u").join(second, "v").select("a", "b")))


def _with_both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, and the set of each as x and y. One ``a`` may have many pairs, which are dealt to parts."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_TASK).cast("int").alias("parts"))
    left = sets.join(sizes, F.col("fp") == F.col("a")).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select("a", "part", F.col("set").alias("x"))
    right = pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    right = right.join(sets.select(F.col("fp").alias("b"), F.col("set").alias("y")), "b")
    return right.join(left, ["a", "part"]).select("a", "b", "x", "y")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(u, v): the pairs (a, b) of ``pairs`` that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = [_similar(x[i].values.to_numpy(), y[i].values.to_numpy(), least) for i in range(batch.num_rows)]
            yield batch.select([0, 1]).rename_columns(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return settle(_with_both(pairs, sets).mapInArrow(run, "u long, v long"))


def _sieve(keys: DataFrame) -> np.ndarray:
    """A bit for each residue of the keys (``key``), 16 bits a key while SIEVE_BITS are enough.

    Beyond that it lets more through, which costs a larger shuffle in the join behind it, and nothing else.
    The driver gets a row for each 64 bits at most.
    """
    bits = min(SIEVE_BITS, 1 << max(16, (16 * keys.count()).bit_length()))
    at = F.shiftright(F.col("key").bitwiseAND(F.lit(bits - 1)), 6).alias("at")
    found = keys.select(at, F.expr("shiftleft(1L, cast(key & 63L as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _sifted(keys: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    low = keys & np.uint64((len(sieve) << 6) - 1)
    return (sieve[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


def _star_pairs(met: DataFrame, least: float, turn: int) -> DataFrame:
    """(a, b): for each set one (a) that has a shingle of ``met`` (key, fp, n, pos, known, root) with it, and another root.

    In the first turn that is the best known one, later the first in an order of roots that changes from turn to turn.
    """
    order = F.xxhash64(F.lit(turn), "root").cast("double") if turn else -F.col("known")
    best = F.min(F.struct(order.alias("k"), F.col("fp").alias("a"), F.col("root").alias("r"), F.col("n").alias("m"), F.col("pos").alias("p")))
    lead = met.groupBy("key").agg(best.alias("lead"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key", "lead")
    most = F.least(F.col("n") - F.col("pos"), F.col("lead.m") - F.col("lead.p"), "n", "lead.m")  # in the first shared shingle no more than what follows can be shared
    possible = (F.col("root") != F.col("lead.r")) & (most >= F.lit(least / (1 + least)) * (F.col("n") + F.col("lead.m")) - _EPS)
    pairs = met.join(lead, "key").where(possible).groupBy(F.col("fp").alias("b")).agg(F.min(F.struct("lead.k", "lead.a")).alias("to"))
    return settle(pairs.select(F.col("to.a").alias("a"), "b"))


def _rooted(met: DataFrame, roots: DataFrame) -> DataFrame:
    return met.drop("root").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _tiles(met: DataFrame, block: int) -> DataFrame:
    """a, b, p, q (a tile: two homes, two blocks of it), fp, root, home and mine (its home and block), for :func:`_tile_links`.

    Of ``met`` (key, fp, n, root): any two sets that share a key and have different roots have a tile in common.
    """
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1")
    opened = settle(met.join(sizes.select("key", "rows"), "key").select("key", "fp", "n", "root", "rows"))
    homes = opened.groupBy("fp").agg(F.max(F.struct("rows", "key"))["key"].alias("home"), F.first("n").alias("n"), F.first("root").alias("root"))
    homes = settle_narrow(homes)
    placed = opened.select("key", "fp").join(homes.select("fp", "home"), "fp")
    others = placed.select("key", F.col("home").alias("other")).distinct()
    tiles = placed.join(others, "key").select(F.least("home", "other").alias("a"), F.greatest("home", "other").alias("b"), "fp").distinct()
    tiles = settle_narrow(tiles.join(homes, "fp"))
    counted = tiles.groupBy("a", "b").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    blocks = F.greatest(F.ceil(F.col("rows") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    tiles = tiles.join(counted.where("r0 < r1").select("a", "b", blocks.alias("blocks")), ["a", "b"])
    tiles = tiles.withColumn("mine", F.pmod(F.xxhash64("fp", "a", "b"), F.col("blocks")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return tiles.select("a", "b", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "fp", "root", "home", "mine")


def _tile_links(fp: np.ndarray, root: np.ndarray, home: np.ndarray, mine: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that connect what is similar in a tile: sets of different homes if it has two, and of different blocks if it has two."""
    n = np.array([len(s) for s in sets], np.int64)
    cells = np.frombuffer(b"".join(map(histogram, sets)), np.uint16).reshape(-1, CELLS)
    full = cells[:, 0] == 65535
    ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32), np.cumsum(n)[:-1])
    marked = np.zeros(int(n.sum()), bool)
    label = np.unique(root, return_inverse=True)[1]
    homes, blocks = home.min() != home.max(), mine.min() != mine.max()
    out = []
    for i in range(len(fp) - 1):
        meets = (label[i + 1 :] != label[i]) & may_be_similar(n[i], n[i + 1 :], n[i + 1 :], least)
        if homes:
            meets &= home[i + 1 :] != home[i]
        if blocks:
            meets &= mine[i + 1 :] != mine[i]
        at = i + 1 + np.flatnonzero(meets)
        if len(at):
            most = np.where(full[at] | full[i], n[at], np.minimum(cells[at], cells[i]).sum(1, dtype=np.int64))
            marked[ids[i]] = True
            for j in at[may_be_similar(n[i], n[at], most, least)].tolist():
                if label[j] != label[i]:
                    both = np.count_nonzero(marked[ids[j]])
                    if both >= least * (n[i] + n[j] - both) - _EPS:
                        out.append((int(fp[i]), int(fp[j])))
                        label[label == label[j]] = label[i]
            marked[ids[i]] = False
    return out


def _open_links(met: DataFrame, sets: DataFrame, least: float, block: int) -> DataFrame:
    """(u, v): verified links between sets of ``met`` (key, fp, n, root), enough to connect all that share a key and are similar."""
    tiles = _tiles(met, block).join(sets.select("fp", "set"), "fp").select("a", "b", "p", "q", "fp", "root", "home", "mine", "set")
    dealt = tiles.repartition(task_slots(met.sparkSession), "a", "b", "p", "q").sortWithinPartitions("a", "b", "p", "q")

    def links_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        *numbers, sets = zip(*rows)
        found = _tile_links(*(np.array(c, np.int64) for c in numbers), sets, least) if len(rows) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["u", "v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        at, held = None, []
        for batch in batches:
            for i, (a, b, p, q, *row) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:8]))):
                if (a, b, p, q) != at:
                    yield from links_of(held) if held else ()
                    at, held = (a, b, p, q), []
                held.append((*row, batch.column(8)[i].values.to_numpy().view(np.uint64)))
        yield from links_of(held) if held else ()

    return settle_narrow(dealt.mapInArrow(compare, "u long, v long").distinct())


def similar_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST, block: int = BLOCK, distance: int = WIDE
) -> DataFrame:
    """id, fp (of the shingle set), component_id (smallest id that links reach), kept (one row of each component), _text_key."""
    require_columns(docs, [id_col, text_col])
    if not 0 < least <= 1:
        raise ValueError("a share is above 0 and at most 1")
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        counts = np.zeros(BUCKETS, np.int64)
        none = lambda n: pa.nulls(n, pa.int64())
        columns, id_type = [id_col, "fp", "_text_key", "bucket", "n"], None
        for batch in batches:
            id_type, fps = batch.schema.field(0).type, []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), words)
                np.add.at(counts, (s % np.uint64(BUCKETS)).astype(np.int64), 1)
                fps.append(_name(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), batch.column(2), none(len(fps)), none(len(fps))], names=columns)
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), id_type), none(len(at)), none(len(at)), pa.array(at), pa.array(counts[at])], names=columns)

    read = docs.select(id_col, text.alias("_text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_text_key"))
    both = settle(read.mapInArrow(names, f"`{id_col}` {kind}, fp long, _text_key long, bucket long, n long").withColumn("_row", F.monotonically_increasing_id()))
    rows = both.where("bucket is null").drop("bucket", "n")
    rank = np.zeros(BUCKETS, np.int64)
    for r in both.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        rank[r.bucket] = r.n
    shared = spark.sparkContext.broadcast(rank)

    def prefixes(sieve=None):
        """(key, fp) of all prefixes; with a ``sieve`` (key, fp, n, pos) of what it lets through."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fresh_worker()
            for batch in batches:
                keys, fps, sizes, places = [], [], [], []
                for t in batch.column(0):
                    s = shingle_set(t.as_py(), words)
                    found = prefix(s, shared.value, least)
                    at = np.arange(len(found), dtype=np.int32)
                    if sieve is not None:
                        at = at[_sifted(found, sieve.value)]
                    keys.append(found[at].view(np.int64))
                    fps.append(np.full(len(at), _name(s)))
                    sizes.append(np.full(len(at), len(s), np.int32))
                    places.append(at)
                if keys:
                    columns = [pa.array(np.concatenate(c)) for c in ((keys, fps) if sieve is None else (keys, fps, sizes, places))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "fp", "n", "pos"][: len(columns)])

        return docs.select(text).mapInArrow(run, "key long, fp long" if sieve is None else "key long, fp long, n int, pos int")

    met_twice = prefixes().groupBy("key").agg(F.min("fp").alias("f0"), F.max("fp").alias("f1"), F.count(F.lit(1)).alias("c"))
    common_keys = settle(met_twice.where("f0 < f1").select("key", "c"))
    small = broadcast_if_small(common_keys)
    met = settle(prefixes(spark.sparkContext.broadcast(_sieve(common_keys))).join(common_keys if small is None else small, "key").distinct())
    known = met.groupBy("fp").agg(F.count(F.lit(1)).alias("have"), F.first("n").alias("size"), F.avg(F.log("c")).alias("known"))
    known = known.where(F.col("have") >= _demanded(F.col("size"), least)).select("fp", "known")
    first = F.col("pos") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - _EPS)  # the prefix that one common shingle needs
    met = settle(met.where(first).join(known, "fp").select("key", "fp", "n", "pos", "known"))
    needed = settle(met.select("fp").distinct())
    small = broadcast_if_small(needed)
    sets = _sets(docs, text_col, words).join(needed if small is None else small, "fp", "left_semi")
    sets = settle(sets.groupBy("fp").agg(F.first("set").alias("set"), F.first("sim").alias("sim")))
    linked = _verified(fingerprint_pairs(sets, distance, block), sets, least)
    rooted = settle(_rooted(met.withColumn("root", F.col("fp")), components(linked)))
    for turn in range(TURNS):
        pairs = _star_pairs(rooted, least, turn)
        found = _verified(pairs, sets, least)
        linked = linked.union(found)
        rooted = settle(_rooted(met, components(linked)))
        if found.count() * 10 < pairs.count():
            break  # few are left to link
    return decide(rows, components(linked.union(_open_links(rooted, sets, least, block))), id_col)
