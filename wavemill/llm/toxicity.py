"""Toxicity by nearest labelled examples: exact TF-IDF cosine on a block-max index, weighted votes, calibrated.

Terms are words and their first letters (so that compounds of a known stem count). Fitting takes a bounded sample
of labelled rows, ``EXAMPLES`` of each label at most, those with the smallest hash of their id, and indexes all terms
of their whole texts: none is cut. A term's weight is its rarity times ``FLOOR`` plus the square of how far label 1 is
commoner among rows with the term than among all, a share drawn towards all rows' by ``SHRINK`` rows. A text's
vote is that of its nearest examples, each weighted by its cosine squared and by how many labelled rows it stands
for, drawn towards the base rate where the nearest are far. Votes become scores by a rising logistic line, fitted by
cross-fitting: every example's vote comes from examples, counts and weights of the other ``PARTS - 1`` parts. The
evidence is the nearest examples and the terms shared.

Everything but fitting reads every text whole; no text is shuffled. Only the text is an input of a score. The driver and
each worker hold the sampled rows' terms, whose number EXAMPLES bounds. Defined results: a null, empty or termless text,
or one whose terms no example has, gets the rate of label 1 among examples without terms, drawn to the base rate; of
equally near examples the one with the smaller place in the index counts, places following heaviest term, label and id;
of rows that share a labelled id, fitting takes the one whose text has the smallest hash (so a repeated id adds
no examples), scoring scores each; labels that contradict each other count as 1; labels without a document, or null ones,
are ignored; without labels of both kinds the score is the base rate; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain, groupby, repeat
from operator import add, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wavemill.llm.blockmax import BlockMaxIndex
from wavemill.llm.shared import bounded_batches, give_back, held_in_worker, require_columns, settle

#: Labelled rows of each label that fitting takes at most: it bounds the index and what is broadcast.
EXAMPLES = 3000
#: Labelled rows in a part while fitting.
ROWS_A_PART = 1000
#: Weight of a term that says nothing of the label, beside one that only rows of label 1 have.
FLOOR = 0.02
#: Rows of the base rate that a term's share of label 1 is drawn towards.
SHRINK = 10
#: Parts of the examples for cross-fitting.
PARTS = 4
NEIGHBOURS = 15
#: Nearest examples that are shown with a score.
EVIDENCE = 3
#: Weight of the base rate beside the votes.
DRAW = 0.05
#: Lengths of the first letters that are terms, ascending.
PREFIXES = (4, 5, 6)
FOLDS, HELD_OUT = 5, 0
_WORD = re.compile(r"[^\W\d_]+")
_ASCII = {i: chr(i).lower() if chr(i).isalpha() else " " for i in range(128)}
#: Words whose terms a worker remembers.
_REMEMBERED = 100_000
#: Texts searched together, at most, and their characters, unless one text has more.
TOGETHER, CHARACTERS = 128, 1 << 19


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def words_of(text: str | None) -> list[str]:
    """Lower-cased words. Of ASCII texts they are runs of A-Z and a-z, which needs no pattern."""
    if not text:
        return []
    return text.translate(_ASCII).split() if text.isascii() else _WORD.findall(text.lower())


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


class _Words(dict):
    """Numbers of words, given as they are met, and the terms of each that a model knows (a row of :attr:`terms`; -1 stands for none)."""

    def __init__(self):
        super().__init__()
        self.terms = np.zeros((1 << 12, 1 + len(PREFIXES)), np.int32)

    def numbers(self, words: list[str], known: dict[str, int]) -> np.ndarray:
        """The number of each word; ``known`` numbers the model's terms."""
        at = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(at < 0)):
            unmet = [words[i] for i in new.tolist()]
            self._learn(list(dict.fromkeys(unmet)), known)
            at[new] = np.fromiter(map(self.__getitem__, unmet), np.int64, len(unmet))
        return at

    def _learn(self, words: list[str], known: dict[str, int]) -> None:
        had, n = len(self), len(words)
        if had + n > len(self.terms):
            self.terms = np.concatenate((self.terms[:had], np.zeros((had + 2 * n, self.terms.shape[1]), np.int32)))
        got, length = self.terms[had : had + n], np.fromiter(map(len, words), np.int64, n)
        got[:, 0] = np.fromiter(map(known.get, words, repeat(-1)), np.int32, n)
        for k, size in enumerate(PREFIXES, 1):
            first = map(add, map(itemgetter(slice(size)), words), repeat("*"))
            got[:, k] = np.where(length > size, np.fromiter(map(known.get, first, repeat(-1)), np.int32, n), -1)
        self.update(zip(words, range(had, had + n)))


def _words_of_model(key: str) -> _Words:
    """Words of one model that this worker remembers."""
    return _Words()


def _fitting(stage: str) -> str:
    """Held by workers that fit, so that what operators before have left is dropped before anything is loaded."""
    return stage


def _together(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Texts in order, in lists of TOGETHER and CHARACTERS at most; a longer text is a list of its own."""
    held, size = [], 0
    for t in texts:
        n = len(t) if t else 0
        if held and (len(held) == TOGETHER or size + n > CHARACTERS):
            yield held
            held, size = [], 0
        held.append(t)
        size += n
    if held:
        yield held


def _terms_in(text: str | None) -> set[str]:
    """Terms of a text."""
    words = set(words_of(text))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in PREFIXES))


def _bags(texts: list[str | None], words: _Words, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's place, term, how often) of all known terms of some texts, ascending."""
    found = [words_of(t) for t in texts]
    at = words.numbers(list(chain.from_iterable(found)), known)
    pair, often = np.unique(np.repeat(np.arange(len(texts)), [len(w) for w in found]) * max(len(words), 1) + at, return_counts=True)
    text, at = np.divmod(pair, max(len(words), 1))
    term = words.terms[at]
    own = term >= 0
    n = own.sum(axis=1)
    pair, place = np.unique(np.repeat(text, n) * max(len(known), 1) + term[own], return_inverse=True)
    often = np.bincount(place, np.repeat(often, n), len(pair))
    return *np.divmod(pair, max(len(known), 1)), often


@dataclass
class Model:
    """What scoring needs: the terms and vectors of the sampled rows."""

    terms: dict[str, int]
    weight: np.ndarray
    examples: list[tuple[object, int, np.ndarray | None, np.ndarray | None]]  # id, label, terms, weights of unit length; none of these two in a worker
    votes: tuple[float, float]  # labelled rows that an example of label 0 and of label 1 stands for
    base: float
    termless: float
    line: tuple[float, float] = (1.0, 0.0)  # slope and height of the score's log-odds over those of the vote
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @cached_property
    def index(self) -> BlockMaxIndex:
        cat = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.zeros(0, kind)
        return BlockMaxIndex(
            cat([t for _, _, t, _ in self.examples], np.int32),
            np.repeat(np.arange(len(self.examples), dtype=np.int32), [len(t) for _, _, t, _ in self.examples]),
            cat([w for *_, w in self.examples], np.float32),
            len(self.terms),
            len(self.examples),
        )

    @cached_property
    def labels(self) -> np.ndarray:
        return np.array([y for _, y, _, _ in self.examples], float)

    def __getstate__(self):
        """With the index, which holds the examples' terms and weights: workers neither make it, which takes thrice its size, nor hold both."""
        return self.__dict__ | {"index": self.index, "examples": [(i, y, None, None) for i, y, *_ in self.examples]}

    def lean(self) -> Model:
        """The model as a worker gets it: its examples only by id and label, beside the index."""
        self.__dict__ = self.__getstate__()
        return self

    def searching(self) -> Model:
        """The model in a worker that scores and does nothing else: what only evidence needs of the index goes."""
        self.index.only_top()
        give_back()
        return self

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text's place, term, weight) of all known terms of some texts, ascending; the weights of a text are of unit length."""
        words = held_in_worker(_words_of_model, self.key)
        if len(words) > _REMEMBERED:
            words.clear()
        text, term, often = _bags(texts, words, self.terms)
        weight = (1 + np.log(often)) * self.weight[term]
        return text, term, weight / np.sqrt(np.bincount(text, weight**2, len(texts)))[text]

    def nearest_many(self, texts: Iterable[str | None], k: int = NEIGHBOURS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of each text's nearest examples and their cosines."""
        for some in _together(texts):
            yield from self.index.top_many(*self.vectors(some), len(some), k)

    def nearest(self, text: str | None, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        return next(self.nearest_many([text], k))

    def score(self, text: str | None) -> float:
        return self.vote(*self.nearest(text))

    def vote(self, best: np.ndarray, cosine: np.ndarray) -> float:
        """Score by the nearest examples and their cosines."""
        return self.calibrated(self.raw_vote(best, cosine)) if len(best) else self.termless

    def raw_vote(self, best: np.ndarray, cosine: np.ndarray) -> float:
        y = self.labels[best]
        vote = cosine**2 * np.where(y > 0, self.votes[1], self.votes[0])
        return float(((vote * y).sum() + DRAW * self.base) / (vote.sum() + DRAW))

    def calibrated(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-self.line[0] * _log_odds(vote) - self.line[1])))

    def evidence(self, text: str | None, k: int = 3) -> list[tuple[object, int, float, list[str]]]:
        """Nearest examples: id, label, cosine, shared terms."""
        names = {v: t for t, v in self.terms.items()}
        own = set(self.vectors([text])[1].tolist())
        best, cosine = self.nearest(text, k)
        return [(self.examples[i][0], self.examples[i][1], float(c), sorted(names[t] for t in self.index.terms_of(i).tolist() if t in own)) for i, c in zip(best.tolist(), cosine)]


def _log_odds(p):
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p) - np.log1p(-p)


def rising_line(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and height of the logistic line from a vote's log-odds to those of label 1, by Newton steps; (1, 0) if it doesn't rise."""
    x = np.stack([_log_odds(votes), np.ones(len(votes))], axis=1)
    many = weights[labels > 0].sum(), weights[labels <= 0].sum()
    aim = np.where(labels > 0, (many[0] + 1) / (many[0] + 2), 1 / (many[1] + 2))
    line = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -40, 40)))
        pull = x.T @ (weights * (aim - p)) - 1e-3 * (line - [1.0, 0.0])
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), pull)
        line = line + step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-10:
            break
    return (float(line[0]), float(line[1])) if line[0] > 0 else (1.0, 0.0)


@dataclass
class Draft:
    """Counts of terms by part, and the examples' terms, from which models with or without a part follow."""

    terms: dict[str, int]
    counts: tuple[np.ndarray, np.ndarray]  # rows of label 0 and of label 1 that hold a term, by term and part
    sizes: tuple[np.ndarray, np.ndarray]  # rows of either label, by part
    examples: list[tuple[object, int, int, np.ndarray, np.ndarray]]  # id, label, part, terms, 1 + log of occurrences
    votes: tuple[float, float]
    base: float

    def model(self, without: int | None = None) -> Model:
        parts = [i for i in range(PARTS) if i != without]
        n0, n1 = (c[:, parts].sum(axis=1) for c in self.counts)
        h0, h1 = (max(int(h[parts].sum()), 1) for h in self.sizes)
        p = self.base
        standing = n0 * self.votes[0], n1 * self.votes[1]
        rarity = np.log1p((h0 * self.votes[0] + h1 * self.votes[1]) / np.maximum(standing[0] + standing[1], 1))
        one, other = p * n1 / h1, (1 - p) * n0 / h0
        share = np.divide(one, one + other, out=np.full(len(n0), p), where=one + other > 0)
        share = ((n0 + n1) * share + SHRINK * p) / (n0 + n1 + SHRINK)
        weight = rarity * (FLOOR + (np.maximum(share - p, 0) / (1 - p)) ** 2)
        held, bare = [], [0, 0]
        for i, y, part, at, often in self.examples:
            if part == without:
                continue
            if not len(at):
                bare[y] += 1
                continue
            w = often * weight[at]
            held.append((i, y, at, (w / np.sqrt((w**2).sum())).astype(np.float32)))
        termless = (bare[1] * self.votes[1] + 0.5 * p) / (bare[0] * self.votes[0] + bare[1] * self.votes[1] + 0.5)
        # Examples with the same heaviest term lie in the same blocks, which keeps block bounds tight.
        held.sort(key=lambda x: (int(x[2][np.argmax(x[3])]), x[1], str(x[0])))
        return Model(self.terms, weight, held, self.votes, p, termless)


def _sample(labels: DataFrame, label: int, n: int) -> list:
    rows = labels.where(F.col("y") == label).orderBy(F.xxhash64("id"), "id").limit(n)
    return [r.id for r in rows.select("id").collect()]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    examples: int = EXAMPLES,
    held_out: bool = True,
) -> Model:
    """Learn from labelled rows; with ``held_out``, not from those of fold 0 (crc32 of the id, modulo 5)."""
    require_columns(docs, [id_col, text_col])
    bounded_batches(docs.sparkSession)
    require_columns(labels, [id_col, label_col])
    spark = docs.sparkSession
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if held_out:
        rows = rows.where(fold(F.col(id_col)) != HELD_OUT)
    rows = rows.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    totals = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    base = (n1 + 0.5) / (n0 + n1 + 1)
    if not n0 or not n1:
        return Model({}, np.zeros(0), [], (1.0, 1.0), base, base)
    picked = [(i, y) for y in (0, 1) for i in _sample(rows, y, examples)]
    ids = spark.createDataFrame(picked, f"id {docs.schema[id_col].dataType.simpleString()}, y int")
    # At most two times ``examples`` ids: broadcast, so that texts are filtered where they are read, and one row of each
    # id is kept. These few are dealt to as many parts as they need, not stored in a file for each part of the corpus.
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "id")
    found = found.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("row"))
    found = found.select("id", "y", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("part"), F.col("row.text").alias("text"))
    texts = settle(found.repartition(max(1, -(-len(picked) // ROWS_A_PART))))
    sizes = np.zeros((2, PARTS), np.int64)
    for r in texts.groupBy("y", "part").count().collect():
        sizes[r.y, r.part] = r["count"]
    h0, h1 = sizes.sum(axis=1).tolist()
    if not h0 or not h1:
        return Model({}, np.zeros(0), [], (1.0, 1.0), base, base)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_in_worker(_fitting, "count")
        for batch in batches:
            rows = [Counter() for _ in range(2 * PARTS)]
            for y, part, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                rows[y * PARTS + part].update(_terms_in(t.as_py()))
            terms = list(set().union(*rows))
            table = [np.fromiter(map(r.get, terms, repeat(0)), np.int64, len(terms)) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *map(pa.array, table)], names=["term", *numbers])

    numbers = [f"n{y}_{part}" for y in (0, 1) for part in range(PARTS)]
    counts = texts.select("y", "part", "text").mapInArrow(count, ", ".join(["term string", *[f"{n} long" for n in numbers]]))
    counted = counts.groupBy("term").agg(*[F.sum(n).alias(n) for n in numbers]).toArrow().sort_by("term")
    terms = {t: i for i, t in enumerate(counted.column("term").to_pylist())}
    table = np.stack([counted.column(n).to_numpy().astype(np.int32) for n in numbers], axis=1)  # at most as many as there are examples
    del counted
    draft = Draft(terms, (table[:, :PARTS], table[:, PARTS:]), (sizes[0], sizes[1]), [], (n0 / h0, n1 / h1), base)
    known = spark.sparkContext.broadcast(terms)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_in_worker(_fitting, "bags")
        for batch in batches:
            at, often, words = [], [], _Words()
            for some in _together(t.as_py() for t in batch.column(3)):
                text, term, count = _bags(some, words, known.value)
                cuts = np.searchsorted(text, np.arange(len(some) + 1)).tolist()
                term, count = term.astype(np.int32), (1 + np.log(count)).astype(np.float32)
                at += [term[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
                often += [count[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(at, pa.binary()), pa.array(often, pa.binary())], names=["id", "y", "part", "terms", "often"])

    kind = texts.schema["id"].dataType.simpleString()
    bagged = texts.select("id", "y", "part", "text").mapInArrow(bags, f"id {kind}, y int, part int, terms binary, often binary").toArrow()
    fields = [bagged.column(c).to_pylist() for c in bagged.column_names]
    draft.examples = [(i, y, part, np.frombuffer(a, np.int32), np.frombuffer(w, np.float32)) for i, y, part, a, w in zip(*fields)]
    del bagged, fields
    known.unpersist()
    line = _cross_fitted(texts, draft)  # before the model, so that the driver doesn't hold one beside what it sends
    model = draft.model()
    model.line = line
    del draft
    return model.lean()


def _cross_fitted(texts: DataFrame, draft: Draft) -> tuple[float, float]:
    """The line from votes to scores; each example votes by a model of the other parts, a task holding one such model at a time."""
    shared = texts.sparkSession.sparkContext.broadcast(draft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_in_worker(_fitting, "votes")
        at, model = None, None
        for batch in batches:
            votes = []
            for part, rows in groupby(zip(batch.column(0).to_pylist(), batch.column(2)), key=lambda x: x[0]):
                if part != at:
                    model = None  # before the next is made
                    at, model = part, shared.value.model(without=part).lean().searching()
                found = model.nearest_many(t.as_py() for _, t in rows)
                votes += [model.raw_vote(best, cosine) if len(best) else None for best, cosine in found]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(votes, pa.float64())], names=["y", "vote"])

    dealt = texts.select("part", "y", "text").repartitionByRange(PARTS, "part").sortWithinPartitions("part")
    got = dealt.mapInArrow(run, "y int, vote double").where(F.col("vote").isNotNull()).toArrow().sort_by([("y", "ascending"), ("vote", "ascending")])
    shared.unpersist()
    if not got.num_rows:
        return 1.0, 0.0
    y, votes = got.column("y").to_numpy(), got.column("vote").to_numpy()
    return rising_line(votes, y, np.where(y > 0, draft.votes[1], draft.votes[0]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and evidence (the nearest examples' ids, labels and cosines, EVIDENCE at most) of every document."""
    require_columns(docs, [id_col, text_col])
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind, key = docs.schema[id_col].dataType.simpleString(), model.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_in_worker(_words_of_model, key)  # drops what stages before have left, then the model is loaded
        m = shared.value.searching()
        for batch in batches:
            found = list(m.nearest_many(t.as_py() for t in batch.column(1)))
            scores = pa.array([m.vote(*x) for x in found], pa.float64())
            near = [list(zip(best[:EVIDENCE].tolist(), cosine[:EVIDENCE].tolist())) for best, cosine in found]
            shown = [[{"id": m.examples[i][0], "label": m.examples[i][1], "cosine": c} for i, c in x] for x in near]
            yield pa.RecordBatch.from_arrays([batch.column(0), scores, pa.array(shown, shape)], names=[id_col, "score", "evidence"])

    shape = pa.list_(pa.struct([("id", to_arrow_type(docs.schema[id_col].dataType)), ("label", pa.int32()), ("cosine", pa.float64())]))
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {kind}, score double, evidence array<struct<id:{kind},label:int,cosine:double>>"
    )


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""
    require_columns(docs, [text_col])
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, key = docs.columns.index(text_col), model.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_in_worker(_words_of_model, key)  # drops what stages before have left, then the model is loaded
        m = shared.value.searching()
        for batch in batches:
            scores = [m.vote(*x) for x in m.nearest_many(t.as_py() for t in batch.column(at))]
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
