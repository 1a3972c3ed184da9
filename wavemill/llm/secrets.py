"""Secret scan: all rules in one automaton, one pass over the bytes of each text.

The rules are compiled together (see :mod:`wavemill.llm.automaton`). A batch of texts is scanned in
lockstep: each text, or each piece of a long one, is a lane, and every step moves all lanes by one
byte through the transition array. Where a rule ends, small automata of that rule alone, run backwards
and forwards from there, give the leftmost longest span; spans of one kind don't overlap.

Defined results: a null text counts as empty; offsets are code points, the end is exclusive; rows that
repeat are scanned each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.llm import automaton
from wavemill.llm.shared import bounded_batches, held_in_worker, require_columns


@dataclass(frozen=True)
class Rule:
    """``least``: characters that a match must have, not counting ``head`` if there is one; shorter ones are dropped."""

    kind: str
    pattern: str
    any_case: bool = False
    least: int = 1
    head: str = ""

    def __hash__(self) -> int:
        return hash((self.kind, self.pattern, self.any_case, self.least, self.head))

    @property
    def tree(self):
        return automaton.parse(self.head + self.pattern, self.any_case)

    @cached_property
    def forward(self) -> automaton.Dfa:
        return automaton.build([self.tree], search=False)

    @cached_property
    def backward(self) -> automaton.Dfa:
        return automaton.build([automaton.mirrored(self.tree)], search=False)

    @cached_property
    def opening(self) -> automaton.Dfa:
        return automaton.build([automaton.parse(self.head, self.any_case)], search=False)


#: The first three are the contract's, in its order; the others are added by this method.
RULES = (
    Rule("assign", "[A-Za-z0-9+/_.=-]+", True, 12, """(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?"""),
    Rule("access", "AKIA[A-Z0-9]+", least=18),
    Rule("hex", "[0-9a-f]{16,}", least=16),
    Rule("hub", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", least=60),
    Rule("key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", least=20),
)
BASE = ("assign", "access", "hex")
#: Bytes after which a long text is cut, at the next byte that leaves no doubt about the state.
LANE = 4096


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.dfa = automaton.build([r.tree for r in rules], search=True)
        d = self.dfa
        table = d.table.reshape(-1, d.width)
        self.sync = (table == table[0]).all(axis=0)  # byte classes whose next state is the same from every state
        self.classes = d.byte_class.astype(np.uint8)

    def _lanes(self, cls: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        long = np.flatnonzero(ends - starts > LANE)
        firsts, lasts = [starts[ends - starts <= LANE]], [ends[ends - starts <= LANE]]
        for i in long:
            a, b = int(starts[i]), int(ends[i])
            safe = np.flatnonzero(self.sync[cls[a:b]]) + a
            at = np.searchsorted(safe, np.arange(a + LANE, b, LANE))
            cuts = np.unique(safe[at[at < len(safe)]])
            firsts.append(np.concatenate(([a], cuts)))
            lasts.append(np.concatenate((cuts, [b])))
        return np.concatenate(firsts).astype(np.int64), np.concatenate(lasts).astype(np.int64)

    def ends(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (of last bytes) where rules end, ascending, and the rules' bits there."""
        d = self.dfa
        cls = self.classes[data]
        first, last = self._lanes(cls, starts, ends)
        size = last - first
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        most = int(size[0]) if len(size) else 0
        live = len(size) - np.searchsorted(size[::-1], np.arange(most), side="right")
        state = np.zeros(len(size), np.int32)
        where, what = [], []
        table, accepts = d.table, d.accepts
        for t, k in enumerate(live.tolist()):
            state = table[state[:k] + cls[first[:k] + t]]
            hit = accepts[state]
            if hit.any():
                at = np.flatnonzero(hit)
                where.append(first[at] + t)
                what.append(hit[at])
        if not where:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        where, what = np.concatenate(where), np.concatenate(what)
        order = np.argsort(where)
        return where[order], what[order]

    def resolve(self, data: bytes, rule: Rule, ends: list[int]) -> list[tuple[int, int]]:
        """Leftmost longest spans (bytes) of a rule in one text, from the places where it can end."""
        out, free = [], 0
        for e in ends:
            if e < free:
                continue
            s = rule.backward.longest(data, e, free - 1, -1)
            if s < 0:
                continue
            free = rule.forward.longest(data, s, len(data)) + 1
            body = rule.opening.longest(data, s, free) + 1 if rule.head else s
            if free - body >= rule.least:
                out.append((s, free))
        return out

    def scan(self, texts: pa.Array) -> list[list[tuple[str, int, int]]]:
        """Spans (kind, start, end) of each text by start, then kind as listed."""
        texts = pa.array(texts, pa.large_string()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_string())
        texts = texts.fill_null("")
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(texts))]
        if not len(texts):
            return out
        where, what = self.ends(data, bounds[:-1], bounds[1:])
        if not len(where):
            return out
        doc = np.searchsorted(bounds, where, side="right") - 1
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for part in np.split(np.arange(len(doc)), cuts):
            i = int(doc[part[0]])
            a, b = int(bounds[i]), int(bounds[i + 1])
            text, found = data[a:b].tobytes(), []
            whole = np.concatenate(([0], np.cumsum((data[a:b] & 0xC0) != 0x80)))  # code points before each byte
            for k, rule in enumerate(self.rules):
                ends = where[part[(what[part] >> k) & 1 == 1]] - a
                found += [(int(whole[s]), k, int(whole[e])) for s, e in self.resolve(text, rule, ends.tolist())]
            out[i] = [(self.rules[k].kind, s, e) for s, k, e in sorted(found)]
        return out


def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return held_in_worker(Scanner, rules)


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id and spans, an array of (kind, start, end), for each document. No shuffle; memory is bounded by a batch."""
    require_columns(docs, [id_col, text_col])
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in s.scan(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, SPANS)], names=[id_col, "spans"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    )


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
