"""Rules as byte automata: parse, subset construction, minimisation, transition arrays.

The pattern language is a subset of the usual one: literals, ``\\xHH`` and escaped characters,
classes with ranges, groups, ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}``, ``{m,n}``. Patterns are
ASCII and match bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Syntax trees: ("set", frozenset) | ("cat", [..]) | ("alt", [..]) | ("rep", node, least, most or None)


class _Parser:
    def __init__(self, pattern: str, any_case: bool):
        self.s, self.i, self.any_case = pattern, 0, any_case

    def parse(self):
        node = self.alternatives()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} in {self.s!r}")
        return node

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(f"pattern ends early: {self.s!r}")
        self.i += 1
        return c

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                body = ""
                while self.peek() != "}":
                    body += self.take()
                self.i += 1
                low, comma, high = body.partition(",")
                node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            return int(self.take() + self.take(), 16)
        if c.isalnum():
            raise ValueError(f"unknown escape \\{c}")
        return ord(c)

    def chars(self, found: set[int]):
        if self.any_case:
            found |= {c ^ 32 for c in found if 65 <= (c & ~32) <= 90}
        return ("set", frozenset(found))

    def atom(self):
        c = self.take()
        if c == "(":
            if self.s.startswith("?:", self.i):
                self.i += 2
            node = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"group is not closed: {self.s!r}")
            return node
        if c == "[":
            found: set[int] = set()
            while self.peek() != "]":
                d = self.take()
                low = self.escaped() if d == "\\" else ord(d)
                if self.peek() == "-" and self.s[self.i + 1 : self.i + 2] not in ("]", ""):
                    self.i += 1
                    d = self.take()
                    found |= set(range(low, (self.escaped() if d == "\\" else ord(d)) + 1))
                else:
                    found.add(low)
            self.i += 1
            return self.chars(found)
        return self.chars({self.escaped() if c == "\\" else ord(c)})


def parse(pattern: str, any_case: bool = False):
    return _Parser(pattern, any_case).parse()


def mirrored(node):
    kind = node[0]
    if kind == "cat":
        return ("cat", [mirrored(x) for x in reversed(node[1])])
    if kind == "alt":
        return ("alt", [mirrored(x) for x in node[1]])
    if kind == "rep":
        return ("rep", mirrored(node[1]), *node[2:])
    return node


class _Nfa:
    """Positions with byte sets and moves without input."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.on: list[list[tuple[frozenset[int], int]]] = []
        self.accepts: dict[int, int] = {}

    def state(self) -> int:
        self.free.append([])
        self.on.append([])
        return len(self.free) - 1

    def add(self, node, start: int) -> int:
        """Build ``node`` from ``start``; its end state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.on[start].append((node[1], end))
            return end
        if kind == "cat":
            for x in node[1]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in node[1]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.add(x, first)].append(end)
            return end
        _, body, least, most = node
        for _ in range(least):
            start = self.add(body, start)
        if most is None:
            hub = self.state()
            self.free[start].append(hub)
            self.free[self.add(body, hub)].append(hub)
            end = self.state()
            self.free[hub].append(end)
            return end
        end = self.state()
        self.free[start].append(end)
        for _ in range(most - least):
            start = self.add(body, start)
            self.free[start].append(end)
        return end

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Dfa:
    """``table[state * width + byte_class[byte]]`` is the next state times ``width``; state 0 starts.

    ``accepts[state * width]``: bits of the rules that end there.
    """

    table: np.ndarray
    byte_class: np.ndarray
    width: int
    accepts: np.ndarray
    dead: int

    @property
    def states(self) -> int:
        return len(self.table) // self.width

    def longest(self, data: bytes, start: int, stop: int, step: int = 1) -> int:
        """The last place where an anchored run from ``start`` accepts, or -1. ``step`` -1 runs backwards."""
        s, found, table, classes, accepts = 0, -1, self.table, self.byte_class, self.accepts
        for i in range(start, stop, step):
            s = table[s + classes[data[i]]]
            if s == self.dead:
                break
            if accepts[s]:
                found = i
        return found


def build(nodes: list, search: bool) -> Dfa:
    """One automaton of all ``nodes``; bit k of accepts is node k. ``search``: a match may start anywhere."""
    nfa = _Nfa()
    root = nfa.state()
    for k, node in enumerate(nodes):
        first = nfa.state()
        nfa.free[root].append(first)
        end = nfa.add(node, first)
        nfa.accepts[end] = nfa.accepts.get(end, 0) | 1 << k
    sets = {s for moves in nfa.on for s, _ in moves}
    signs: dict[tuple[bool, ...], int] = {}
    ordered = sorted(sets, key=sorted)
    byte_class = np.array([signs.setdefault(tuple(b in s for s in ordered), len(signs)) for b in range(256)], np.int32)
    width = len(signs)
    sample = [int(np.flatnonzero(byte_class == c)[0]) for c in range(width)]

    start = nfa.closed([root])
    index, order, rows = {start: 0}, [start], []
    for now in order:
        row = []
        for b in sample:
            reached = {t for s in now for on, t in nfa.on[s] if b in on}
            to = nfa.closed(reached | ({root} if search else set()))
            if to not in index:
                index[to] = len(order)
                order.append(to)
            row.append(index[to])
        rows.append(row)
    table = np.array(rows, np.int64)
    accepts = np.array([_union(nfa.accepts, now) for now in order], np.int64)

    # Moore: split blocks by acceptance, then by the blocks that each byte class leads to.
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        _, new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        new = new.reshape(-1)
        if new.max() == block.max():
            break
        block = new
    first_seen: dict[int, int] = {}
    for b in block.tolist():
        first_seen.setdefault(b, len(first_seen))
    number = np.array([first_seen[b] for b in block.tolist()])
    small = np.zeros((len(first_seen), width), np.int64)
    small[number] = number[table]
    ends = np.zeros(len(first_seen), np.int64)
    ends[number] = accepts
    flat = (small * width).astype(np.int32).reshape(-1)
    wide = np.zeros(len(flat), np.int32)
    wide[np.arange(len(ends)) * width] = ends
    dead = next((i * width for i in range(len(ends)) if not ends[i] and (small[i] == i).all()), -1)
    return Dfa(flat, byte_class, width, wide, dead)


def _union(accepts: dict[int, int], states) -> int:
    out = 0
    for s in states:
        out |= accepts.get(s, 0)
    return out
