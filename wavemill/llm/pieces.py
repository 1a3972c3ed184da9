"""SentencePiece encoding and decoding by a forward pass over a trie of distinct marked words.

A text is marked (a leading mark, marks for spaces) and cut into words, runs of marks with what follows
them; no piece of the vocabulary spans such a cut, so words are encoded alone. The distinct words of a
batch are sorted, which lays them out as a depth-first walk of their trie: consecutive words share a
prefix, and the forward cells of that prefix are kept, only the cells behind it are computed.

What a forward cell holds depends on the model. For a unigram model it is the Viterbi score: the best sum
of piece scores that ends there. The largest sum of a byte-pair model's scores is not what its library
encodes to (the scores are ranks of merges), so for such a model the cell holds the one piece that can end
there: a segmentation is the merges' result exactly if each two neighbours are what merging their joined
text gives, and so each prefix has a single last piece. Both give the ids of the ``sentencepiece`` library.

Defined results: a null or empty text has no ids and decodes to the empty text; characters outside the
vocabulary become byte pieces where the model has them, else the unknown id (one for a run of them);
marks in a text are taken for spaces, as the library does, so such a text comes back with spaces; rows that
repeat an id are encoded each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.shared import bounded_batches, held_in_worker, require_columns

MARK = "▁"
#: Words of a marked text; a line's end stands alone (no piece may hold one beside other characters).
_WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Closing marks, cut from a word where no piece has one behind a letter or digit.
MARKS = ".,;:!?"
#: Distinct words remembered in a worker, in two generations, and pairs of pieces.
REMEMBERED, PAIRS = 800_000, 400_000
#: Texts encoded together; more of them share more of what is looked up.
ROWS = 2000
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: varints as ints, the rest as bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[i : i + n]
            i += n


def model_kind(data: bytes) -> tuple[int, str]:
    """The model type and the normalizer's name of a model file."""
    kind, name = UNIGRAM, ""
    for number, value in _fields(data):
        if number == 2:
            kind = next((v for k, v in _fields(value) if k == 3), UNIGRAM)
        elif number == 3:
            name = next((v.decode() for k, v in _fields(value) if k == 1), "")
    return kind, name


class PieceCoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            self.kind, normalizer = model_kind(f.read())
        if self.kind not in (UNIGRAM, BPE) or normalizer != "identity":
            raise ValueError("a unigram or byte-pair model without normalization is needed")
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.unknown = sp.unk_id()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.byte_ids = {int(self.names[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i in special if i not in self.byte_of and i != self.unknown}
        self.ids = {p: i for i, p in enumerate(self.names) if i not in special}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a mark behind other characters")
        if any("\n" in p and len(p) > 1 for p in self.ids):
            raise ValueError("a piece has a line's end beside other characters")
        joined = {b for p in self.ids for a, b in zip(p, p[1:]) if a.isalnum()}
        self.marks = "".join(m for m in MARKS if m not in joined)
        self.scores = [sp.get_score(i) for i in range(n)]
        self.back, self.piece_of = self._backward_trie()
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.outside = min(self.scores) - 10.0  # what the library charges for an unknown character

    # -- merges of a byte-pair model, for two neighbouring pieces only

    def _merge(self, text: str) -> list[str]:
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _neighbours(self, left: int, right: int) -> bool:
        key = left << 32 | right
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            a, b = self.names[left], self.names[right]
            ok = self.fits[key] = self._merge(a + b) == [a, b]
        return ok

    def _stands(self, k: int) -> bool:
        """Whether merging the piece's characters gives the piece. The coder remembers it itself: a cache of the class would keep the coder alive."""
        ok = self.whole.get(k)
        if ok is None:
            ok = self.whole[k] = self._merge(self.names[k]) == [self.names[k]]
        return ok

    # -- the forward pass

    def _backward_trie(self) -> tuple[dict[int, int], list[int]]:
        """Pieces read from their ends: (state, character) -> state, and the piece of each state or -1."""
        step, piece_of = {}, [-1]
        for p, k in self.ids.items():
            state = 0
            for c in reversed(p):
                key = state << 21 | ord(c)
                state = step.get(key, 0)
                if not state:
                    state = step[key] = len(piece_of)
                    piece_of.append(-1)
            piece_of[state] = k
        return step, piece_of

    def _cell(self, codes: list[int], end: int, cells: list[tuple[int, int, float]]) -> tuple[int, int, float]:
        """The cell behind the first ``end`` characters: the last piece (-1: a character outside), where it begins, the score."""
        step, piece_of, state, found = self.back, self.piece_of, 0, []
        for begin in range(end - 1, -1, -1):
            state = step.get(state << 21 | codes[begin])
            if state is None:
                break
            if piece_of[state] >= 0:
                found.append((piece_of[state], begin))
        if self.kind == BPE:
            for k, begin in reversed(found):
                before = cells[begin][0] if begin else -2
                if self._stands(k) if before < 0 else self._neighbours(before, k):
                    return k, begin, 0.0
            return -1, end - 1, 0.0
        best = max(((cells[b][2] + self.scores[k], -b, k) for k, b in found), default=None)
        if found and found[0][1] == end - 1:  # the character itself is a piece
            return best[2], -best[1], best[0]
        outside = cells[end - 1][2] + self.outside
        return (best[2], -best[1], best[0]) if best is not None and best[0] >= outside else (-1, end - 1, outside)

    def _ids_of(self, word: str, cells: list[tuple[int, int, float]]) -> list[int]:
        out: list[int] = []
        end, lost = len(word), False
        while end:
            k, begin, _ = cells[end]
            if k >= 0:
                out.append(k)
                lost = False
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(word[begin:end].encode())]
            elif not lost:
                out.append(self.unknown)
                lost = True
            end = begin
        out.reverse()
        return out

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Ids of sorted distinct words; cells of the prefix shared with the word before are kept."""
        cells: list[tuple[int, int, float]] = [(-2, 0, 0.0)]
        last = ""
        for w in words:
            keep, most = 0, min(len(w), len(last))
            while keep < most and w[keep] == last[keep]:
                keep += 1
            del cells[keep + 1 :]
            codes = list(map(ord, w))
            for end in range(keep + 1, len(w) + 1):
                cells.append(self._cell(codes, end, cells))
            last = w
            yield w, self._ids_of(w, cells)

    @staticmethod
    def words(text: str | None) -> list[str]:
        return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        parts = [self.words(t) for t in texts]
        if len(self.known) > self.remembered // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = set().union(*parts)
        new -= known.keys()
        for w in new & older.keys():
            known[w] = older[w]
        new -= older.keys()
        marked, cores = [], set()
        for w in new:
            core = w.rstrip(self.marks)
            if core != w and core and core[-1].isalnum():
                marked.append((w, core, w[len(core) :]))
                cores.add(core)
                cores.add(w[len(core) :])
            else:
                cores.add(w)
        cores -= known.keys()
        for w in cores & older.keys():
            known[w] = older[w]
        for w, ids in self.walk(sorted(cores - older.keys())):
            known[w] = struct.pack(f"<{len(ids)}i", *ids)
        for w, core, tail in marked:
            known[w] = known[core] + known[tail]
        return [b"".join(map(known.__getitem__, p)) for p in parts]

    @cached_property
    def raw(self) -> list[bytes]:
        """What each piece decodes to."""
        out = []
        for i, p in enumerate(self.names):
            if i in self.byte_of:
                out.append(bytes((self.byte_of[i],)))
            else:
                out.append(b"" if i in self.silent else " \u2047 ".encode() if i == self.unknown else p.replace(MARK, " ").encode())
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, marks to spaces, the leading one dropped, bytes decoded."""
        if not ids:
            return ""
        out = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.names[ids[0]].startswith(MARK) else out


def coder(path: str, remembered: int = REMEMBERED) -> PieceCoder:
    return held_in_worker(PieceCoder, path, remembered)


def encode_pieces(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, remembered: int = REMEMBERED, rows: int = ROWS
) -> DataFrame:
    """id, ids (array<int>) and, if asked for, ``text``: what the ids decode to. No shuffle.

    ``remembered`` words and ``rows`` texts at a time trade a worker's memory for time; results are the same.
    """
    require_columns(docs, [id_col, text_col])
    bounded_batches(docs.sparkSession, rows)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model, remembered)
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                raws = c.encode(batch.column(1).slice(a, rows).to_pylist())
                values = np.frombuffer(b"".join(raws), "<i4")
                bounds = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raws]))).astype(np.int64)
                columns = [batch.column(0).slice(a, rows), pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(values)).cast(pa.list_(pa.int32()))]
                if decoded:
                    columns.append(pa.array([c.decode(values[i:j].tolist()) for i, j in zip(bounds[:-1], bounds[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "text"][: len(columns)])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", text string" * decoded)


def decode_pieces(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of ids; a null array counts as empty."""
    require_columns(encoded, [id_col, ids_col])
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for batch in batches:
            texts = [c.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
