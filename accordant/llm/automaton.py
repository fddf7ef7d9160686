"""Regular expressions of several rules as one deterministic automaton over bytes, which scans texts in one pass.

Each rule's expression becomes a nondeterministic automaton. The subset construction runs over all rules at once. Within
a rule a state keeps threads, the oldest first: a thread is the set of positions that one start can be in, with its age in
bytes as long as the positions it has come through don't repeat. So a state knows where its match began: on the byte on which a
thread first comes to a position that repeats, or to a match, the state carries the thread's age as a mark, and the last mark before the first
matching byte gives the match's start. A position that an older thread also has is dropped from the younger; once a
thread matches, younger ones are dropped and none is begun until it ends. So matches are leftmost, longest and without overlap, and as a thread that
matches must match on until it dies (checked), the end is where it dies. Rules for which that doesn't hold, or in which two threads
could come to repeated positions at once, are refused when they are compiled.

States that have the same marks, matches and, after any byte, the same successors are merged. The result is a transition array (state, class of byte).

Texts are scanned in lanes. A byte after which every state is the first one (such as a line end: no rule has it) is a
safe place to cut at, so the joined texts are cut there into segments of some WIDTH bytes, and numpy moves all segments on by
a byte at a time. The few segments that are much longer go on alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

WIDTH = 256
#: With fewer lanes than this a plain loop is faster.
FEW = 24
_REPEATED = -1


@dataclass(frozen=True)
class Rule:
    """A kind of match: its expression, and the least length of the match (or, with tail, of what follows its first matching byte, that byte included)."""

    name: str
    pattern: str
    least: int
    tail: bool = False
    either_case: bool = False


# ---- expressions ----------------------------------------------------------------------------


class _Positions:
    """A nondeterministic automaton: bytes and target of each position, and where a position leads without a byte."""

    def __init__(self, rule: Rule):
        self.moves: list[tuple[frozenset[int], int] | None] = []
        self.free: list[list[int]] = []
        self.rule, self.text, self.at = rule, rule.pattern, 0
        first, last = self._node(), self._node()
        a, b = self._either()
        if self.at < len(self.text):
            raise ValueError(f"{rule.name}: {self.text[self.at :]!r} is out of place")
        self.free[first].append(a)
        self.free[b].append(last)
        self.last = last
        self.first = self.closure({first})
        if last in self.first:
            raise ValueError(f"{rule.name} matches nothing at all")
        after = [self.closure({m[1]}) if m else frozenset() for m in self.moves]
        reach = [set(x) for x in after]
        for k in range(len(reach)):  # Warshall: k as a station on the way
            for x in reach:
                if k in x:
                    x |= reach[k]
        self.repeats = frozenset(i for i, x in enumerate(reach) if i in x)

    def _node(self) -> int:
        self.moves.append(None)
        self.free.append([])
        return len(self.moves) - 1

    def _either(self) -> tuple[int, int]:
        a, b = self._node(), self._node()
        while True:
            first = last = self._node()
            while self.at < len(self.text) and self.text[self.at] not in "|)":
                x, y = self._piece()
                self.free[last].append(x)
                last = y
            self.free[a].append(first)
            self.free[last].append(b)
            if self.text[self.at : self.at + 1] != "|":
                return a, b
            self.at += 1

    def _piece(self) -> tuple[int, int]:
        begin = self.at
        a, b = self._atom()
        sign = self.text[self.at : self.at + 1]
        if sign in ("?", "*", "+") and sign:
            self.at += 1
            end = self._node()
            self.free[b].append(end)
            if sign in "?*":
                self.free[a].append(end)
            if sign == "*":
                self.free[b].append(a)
            if sign == "+":  # what repeats is a piece of its own, so that the first byte of it isn't repeated yet
                stop, self.at = self.at, begin
                x, y = self._atom()
                self.at = stop
                self.free[b].append(x)
                self.free[y] += [x, end]
            return a, end
        return a, b

    def _atom(self) -> tuple[int, int]:
        c, self.at = self.text[self.at], self.at + 1
        if c == "(":
            out = self._either()
            self.at += 1
            return out
        found = self._set() if c == "[" else {self._byte(c)}
        if self.rule.either_case:
            found |= {b ^ 0x20 for b in found if chr(b).isalpha()}
        a, b = self._node(), self._node()
        self.moves[a] = (frozenset(found), b)
        return a, b

    def _byte(self, c: str) -> int:
        if c == "\\":
            c, self.at = self.text[self.at], self.at + 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        if c in "*+?.{}^$" and self.text[self.at - 2 : self.at - 1] != "\\" or ord(c) > 127:
            raise ValueError(f"{self.rule.name}: {c!r} isn't known here")
        return ord(c)

    def _set(self) -> set[int]:
        stop = self.text.index("]", self.at)
        inside, self.at = self.text[self.at : stop], stop + 1
        out, k = set(), 0
        while k < len(inside):
            if inside[k + 1 : k + 2] == "-" and k + 2 < len(inside):
                out |= set(range(ord(inside[k]), ord(inside[k + 2]) + 1))
                k += 3
            else:
                out.add(ord(inside[k]))
                k += 1
        return out

    def closure(self, some: set[int]) -> frozenset[int]:
        out, stack = set(some), list(some)
        while stack:
            for x in self.free[stack.pop()]:
                if x not in out:
                    out.add(x)
                    stack.append(x)
        return frozenset(x for x in out if self.moves[x] or x == getattr(self, "last", -1) or not hasattr(self, "last"))

    def step(self, threads: tuple, byte: int) -> tuple:
        """The threads (age, positions) after a byte, with the one begun on it."""
        matched = bool(threads) and self.last in threads[0][1]
        seen: set[int] = set()
        out = []
        for age, places in (*threads, (0, self.first)):
            came = {self.moves[q][1] for q in places if self.moves[q] and byte in self.moves[q][0]}
            left = self.closure(came) - seen
            if not left:
                continue
            seen |= left
            out.append((_REPEATED if age == _REPEATED or age and places & self.repeats else age + 1, left))
            if self.last in left:
                if len(out) > 1:
                    raise ValueError(f"{self.rule.name}: a later start matches before an earlier one has ended")
                if matched and age == 0:
                    raise ValueError(f"{self.rule.name}: a match may follow another at once")
                break
        if matched and out and self.last not in out[0][1] and len(threads) and out[0][0] != 1:
            raise ValueError(f"{self.rule.name}: a match may go on without matching")
        if sum(age == _REPEATED or bool(left & self.repeats) for age, left in out) > 1:
            raise ValueError(f"{self.rule.name}: two starts may repeat at once")
        return tuple(out)

    def mark(self, threads: tuple) -> int:
        """The age of the thread that has just come to a repeated position or a match."""
        return next((age for age, places in threads if age != _REPEATED and (places & self.repeats or self.last in places)), 0)


# ---- the automaton --------------------------------------------------------------------------


@dataclass
class Automaton:
    rules: tuple[Rule, ...]
    classes: np.ndarray  # class of each byte
    table: np.ndarray  # (states * classes): the next state; the first state is the empty one
    matches: np.ndarray  # (rules, states): a thread matches
    marks: np.ndarray  # (rules, states): age of a thread at the place that tells its start
    safe: np.ndarray  # bytes after which every state is the first

    @property
    def states(self) -> int:
        return self.matches.shape[1]

    @cached_property
    def steps(self) -> list[int]:
        return self.table.tolist()


def compile_rules(rules: tuple[Rule, ...]) -> Automaton:
    parts = [_Positions(r) for r in rules]
    sets = [m[0] for p in parts for m in p.moves if m]
    shapes: dict[tuple, int] = {}
    classes = np.array([shapes.setdefault(tuple(b in s for s in sets), len(shapes)) for b in range(256)], dtype=np.uint8)
    samples = [int(np.flatnonzero(classes == c)[0]) for c in range(len(shapes))]
    number: dict[tuple, int] = {tuple(() for _ in parts): 0}
    steps: list[dict] = [{} for _ in parts]
    states, table = list(number), []
    for state in states:  # grows while it is read
        row = []
        for byte in samples:
            after = []
            for p, known, threads in zip(parts, steps, state):
                if (threads, byte) not in known:
                    known[threads, byte] = p.step(threads, byte)
                after.append(known[threads, byte])
            if (key := tuple(after)) not in number:
                number[key] = len(states)
                states.append(key)
            row.append(number[key])
        table.append(row)
    table = np.array(table)
    matches = np.array([[bool(s[r]) and parts[r].last in s[r][0][1] for s in states] for r in range(len(parts))])
    marks = np.array([[parts[r].mark(s[r]) for s in states] for r in range(len(parts))])
    table, chosen = _minimised(table, np.concatenate([matches, marks]).T)
    matches, marks = matches[:, chosen], marks[:, chosen]
    if len(chosen) > 1 << 16:
        raise ValueError("too many states")
    return Automaton(rules, classes, table.astype(np.uint16).ravel(), matches, marks.astype(np.int32), (table == 0).all(axis=0)[classes])


def _minimised(table: np.ndarray, outputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table and one old state of each class of states that no bytes tell apart: classes are split until they have no more successors than one."""
    block = np.unique(outputs, axis=0, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    # Numbered by their first states, so that the empty one stays first.
    _, first = np.unique(block, return_index=True)
    order = np.argsort(first)
    new = np.empty_like(order)
    new[order] = np.arange(len(order))
    return new[block[table[first[order]]]], first[order]


def run(a: Automaton, raw: np.ndarray) -> np.ndarray:
    """The state after each byte; raw begins in the first state and ends with a safe byte."""
    width = len(a.table) // a.states
    seen, states = a.classes[raw], np.zeros(len(raw), dtype=np.uint16)
    safe = np.flatnonzero(a.safe[raw])
    at = np.searchsorted(safe, np.arange(WIDTH, len(raw), WIDTH))
    cuts = np.unique(np.concatenate([[0], safe[at[at < len(safe)]] + 1, [len(raw)]]))
    start, size = cuts[:-1], np.diff(cuts)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    state = np.zeros(len(start), dtype=np.int64)
    alive = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0))  # lanes longer than t
    for t, n in enumerate(alive):
        if n < FEW:
            for k in range(n):
                _alone(a, seen, states, int(start[k]) + t, int(start[k] + size[k]), int(state[k]))
            break
        here = start[:n] + t
        state = a.table[state[:n] * width + seen[here]].astype(np.int64)
        states[here] = state
    return states


def _alone(a: Automaton, seen: np.ndarray, states: np.ndarray, lo: int, hi: int, state: int) -> None:
    width, table = len(a.table) // a.states, a.steps
    for block in range(lo, hi, 1 << 16):
        out = []
        for c in seen[block : min(hi, block + (1 << 16))].tolist():
            state = table[state * width + c]
            out.append(state)
        states[block : block + len(out)] = out


def scan(a: Automaton, raw: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Rule, start and end of each match that is long enough."""
    if not len(raw):
        return
    states = run(a, raw)
    for r, rule in enumerate(a.rules):
        inside = a.matches[r][states].view(np.int8)
        if not inside.any():
            continue
        step = np.diff(inside, prepend=np.int8(0))
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        most = 1 if rule.tail else int(a.marks[r].max())
        long = end - begin >= rule.least - most + 1 if not rule.tail else end - begin >= rule.least
        for first, stop in zip(begin[long].tolist(), end[long].tolist()):
            j = first
            while not a.marks[r][states[j]]:
                j -= 1
            start = j - int(a.marks[r][states[j]]) + 1
            if rule.tail or stop - start >= rule.least:
                yield r, start, stop
