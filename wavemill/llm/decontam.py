"""Benchmark decontamination: every passage of every document queries a BM25 index of test items.

The index has the items' word pairs as terms, with block maxima. An item's BM25 weights are scaled so
that a passage scores 1 or more whenever it can hold ``SHARE`` of the item's five-word shingles: the
heaviest pairs that so many missing shingles can take away are left out of the scale. So retrieval
loses nothing that verification would accept, and every passage above 1 is retrieved.

Verification takes the passage's words: the item's five-word shingles found there must be ``SHARE`` of
them. What share of its question (all but the last sentence) and of its answer (the last sentence) was
found is reported beside, and decides nothing. Passages are windows of two strides, a stride being a quarter longer than the
longest item, so that any stretch as long as an item lies in one window.

Items of one word are looked up word by word, beside the index. The benchmark, not the corpus, decides the size
of the index: it is built in parts of bounded bytes, one at a time on the driver, each sent to the executors in turn.
Defined results: texts of any length are searched whole; a null or wordless text has no passage; items without
words are never found; an item that is listed twice is reported under each id; rows that repeat an id
are searched each; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.blockmax import BlockMaxIndex
from wavemill.llm.shared import bounded_batches, fresh_worker, require_columns

SHINGLE, SHARE = 5, 0.8
K1, B = 1.2, 0.75
#: Bytes of item texts in one part of the index; the index of a part is a few times as large.
PART_BYTES = 8 << 20
#: Words looked up together.
_WORDS = 400_000
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def shingles(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def answer_start(text: str) -> int:
    """Words before the last sentence; 0 where the item has but one."""
    parts = [p for p in _SENTENCE.split(text.strip()) if words_of(p)]
    return len(words_of(" ".join(parts[:-1]))) if len(parts) > 1 else 0


class Matcher:
    """Finds the items of one part of the benchmark in texts."""

    def __init__(self, items: list[tuple[int, str]]):
        items = [(i, t, w) for i, t in items if (w := words_of(t))]
        self.ids = [i for i, _, _ in items]
        self.words = [w for _, _, w in items]
        self.shingles = [shingles(w) for w in self.words]
        self.answers = [answer_start(t) for _, t, _ in items]
        self.vocabulary: dict[str, int] = {}
        for w in self.words:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary))
        self.width = len(self.vocabulary) + 1  # the last number stands for any other word
        self.stride = -(-5 * max(map(len, self.words), default=1) // 4)
        grams = [self._grams(np.array([self.vocabulary[x] for x in w], np.int64)) for w in self.words]
        self.alone: dict[int, list[int]] = {}  # word -> items that are this word only
        for k, w in enumerate(self.words):
            if len(w) == 1:
                self.alone.setdefault(self.vocabulary[w[0]], []).append(k)
        self.codes = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)
        terms, entries, weights = [], [], []
        n, mean = len(grams), np.mean([len(g) for g in grams]) if grams else 1
        frequency = np.zeros(len(self.codes))
        for g in grams:
            frequency[np.searchsorted(self.codes, np.unique(g))] += 1
        rarity = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
        for k, g in enumerate(grams):
            if not len(g):
                continue
            code, tf = np.unique(g, return_counts=True)
            t = np.searchsorted(self.codes, code)
            w = rarity[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(g) / mean))
            missing = len(self.shingles[k]) - int(np.ceil(SHARE * len(self.shingles[k]) - 1e-9))
            # m absent shingles take away at most m + 3 pairs where they meet, and all pairs of short items are in one shingle
            spared = np.sort(w)[::-1][: missing + SHINGLE - 2 if missing else 0].sum()
            least = max(w.sum() - spared, w.min()) * (1 - 1e-9)
            terms.append(t)
            entries.append(np.full(len(t), k))
            weights.append(w / least)
        cat = lambda x: np.concatenate(x) if x else np.zeros(0)
        self.index = BlockMaxIndex(cat(terms).astype(np.int64), cat(entries), cat(weights), len(self.codes), n, block=8)

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        return ids[:-1] * self.width + ids[1:]

    def match(self, texts: Iterable[str | None]) -> list[list[tuple[int, float, float, float, float]]]:
        """For each text: (item, score, share of shingles, of question words, of answer words) of the items found."""
        out: list[list] = []
        held, places, n = [], [], 0
        for i, t in enumerate(texts):
            out.append([])
            if self.ids and (w := words_of(t)):
                held.append(w)
                places.append(i)
                n += len(w)
            if n > _WORDS:
                self._search(held, places, out)
                held, places, n = [], [], 0
        if held:
            self._search(held, places, out)
        return out

    def _search(self, docs: list[list[str]], places: list[int], out: list[list]) -> None:
        other = self.width - 1
        get = self.vocabulary.get
        ids = np.fromiter((x for w in docs for x in map(get, w, repeat(other))), np.int64)
        bounds = np.concatenate(([0], np.cumsum([len(w) for w in docs])))
        if self.alone:
            spots = np.flatnonzero(np.isin(ids, np.fromiter(self.alone, np.int64)))
            owner = np.searchsorted(bounds, spots, side="right") - 1
            for d, word in sorted(set(zip(owner.tolist(), ids[spots].tolist()))):
                out[places[d]] += [(k, 1.0, 1.0, 1.0, 1.0) for k in self.alone[word]]
        if not len(self.codes):
            return
        code = ids * self.width + np.concatenate((ids[1:], [other]))
        last = bounds[1:] - 1
        code[last] = ids[last] * self.width + other
        found = np.searchsorted(self.codes, code)
        found[found == len(self.codes)] = 0
        at = np.flatnonzero(self.codes[found] == code)
        if not len(at):
            return
        doc = np.searchsorted(bounds, at, side="right") - 1
        segment = (at - bounds[doc]) // self.stride
        # What a window of two segments can reach at most; few windows pass.
        key = doc * (int(segment.max()) + 2) + segment
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.concatenate((cuts[1:], [len(at)]))
        terms = found[at]
        bound = np.add.reduceat(self.index.term_max[terms], cuts)
        head = key[cuts]
        for j in range(len(cuts)):
            nxt = j + 1 < len(cuts) and head[j + 1] == head[j] + 1
            before = j > 0 and head[j - 1] == head[j] - 1
            if bound[j] + (bound[j + 1] if nxt else 0) < 1 and (before or bound[j] < 1):
                continue
            a, b = cuts[j], ends[j + 1] if nxt else ends[j]
            d, seg = int(doc[a]), int(segment[a])
            self._window(docs[d], seg * self.stride, (seg + 2) * self.stride, terms[a:b], ids[bounds[d] : bounds[d + 1]], out[places[d]])

    def _window(self, words: list[str], start: int, end: int, terms: np.ndarray, ids: np.ndarray, out: list) -> None:
        passage = words[start:end]
        terms = np.unique(terms)
        got = self.index.above(terms, np.ones(len(terms)), 1.0)
        if not got:
            return
        grams = {n: shingles(passage, n) for n in {min(SHINGLE, len(self.words[k])) for k, _ in got}}
        for k, score in got:
            item, cut = self.words[k], self.answers[k]
            n = min(SHINGLE, len(item))
            mine = self.shingles[k]
            share = len(mine & grams[n]) / len(mine)
            if share < SHARE:
                continue
            covered = [False] * len(item)
            for i in range(len(item) - n + 1):
                if tuple(item[i : i + n]) in grams[n]:
                    covered[i : i + n] = [True] * n
            question = sum(covered[:cut]) / cut if cut else sum(covered) / len(item)
            answer = sum(covered[cut:]) / (len(item) - cut)
            out.append((k, score, share, question, answer))

    def best(self, hits: list) -> list[tuple]:
        """One hit for each item of a text: the one with the largest share, then score."""
        kept: dict[int, tuple] = {}
        for h in hits:
            if h[0] not in kept or (h[2], h[1]) > (kept[h[0]][2], kept[h[0]][1]):
                kept[h[0]] = h
        return [(self.ids[k], *rest) for k, *rest in sorted(kept.values())]


def matchers(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[Matcher]:
    """Indexes of the whole benchmark, one after the other, in parts of about PART_BYTES of text each."""
    require_columns(benchmark, [item_col, text_col])
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(parts))
    for k in range(parts):
        yield Matcher(sorted(((r.i, r.t) for r in rows.where(part == k).collect()), key=str))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(id, item id, score, overlap, question_overlap, answer_overlap) for each document and each item found in it."""
    require_columns(docs, [id_col, text_col])
    bounded_batches(docs.sparkSession)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    spark = docs.sparkSession
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, score double, overlap double, question_overlap double, answer_overlap double"

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fresh_worker()
            m = shared.value
            for batch in batches:
                found = zip(batch.column(0).to_pylist(), m.match(x.as_py() for x in batch.column(1)))
                rows = [(i, *h) for i, hits in found if hits for h in m.best(hits)]
                if rows:
                    cols = list(zip(*rows))
                    arrays = [pa.array(cols[0], batch.schema.field(0).type), *(pa.array(c) for c in cols[1:])]
                    yield pa.RecordBatch.from_arrays(arrays, names=[id_col, item_col, "score", "overlap", "question_overlap", "answer_overlap"])

        return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)

    found = [search(spark.sparkContext.broadcast(m)) for m in matchers(benchmark, item_col, item_text)]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found. No shuffle."""
    require_columns(docs, [text_col])
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def keep(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fresh_worker()
            m = shared.value
            for batch in batches:
                yield batch.filter(pa.array([not h for h in m.match(x.as_py() for x in batch.column(at))], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    for m in matchers(benchmark, item_col, item_text):
        docs = keep(docs, docs.sparkSession.sparkContext.broadcast(m))
    return docs
