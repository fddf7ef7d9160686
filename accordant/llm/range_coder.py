"""An adaptive range coder for token ids, on numpy lanes, with one guess each of the orders 2 and 1 and order 0 as the escape.

A block of ids is cut into up to LANES runs of neighbours, the lanes, which advance together: at each step one id of every lane is
coded, by a range coder of its own, under one model that all lanes share and that learns from all of them after the
step. The model starts anew in every block, so a block can be read by itself. It has three predictions of an id, whose
distributions aren't mixed:

* order 2: the id last seen after the two ids before (by a hash of them),
* order 1: the id last seen after the id before,
* order 0: the ids' frequencies in the block so far.

The first two name one id each. How much of the range each gets, and how much is left to order 0, is learnt for every
pair of their confidences (how often each was right in a row, and whether they agree). An id that neither named is coded
a second time, by its order-0 frequency.

A block: magic `AXR2`, and as little-endian 32-bit numbers the number of ids, of lanes, of code words, the vocabulary's
size and the crc32 of the ids (32-bit little-endian each) and of the rest of the block; then the words, of 32 bits, in the order in which reading asks for
them: one of each lane, and after each step one of each lane whose range has become short.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 1 << 14
LEAST_STEPS = 64
U = np.uint64
_HEAD = struct.Struct("<4sIIIIII")
_WORD, _BOTTOM = U(32), U(1 << 32)
_CONTEXT_BITS = 16
_STEP = 16  # what an occurrence adds to an id's order-0 frequency
_LIMIT = 3  # highest confidence
#: Bounds of the totals of outcomes and of frequencies. Together they leave room for both steps of an id within a range of 2^32.
_MOST, _MOST_IDS = 1 << 10, 1 << 22


def lanes_of(n: int) -> int:
    return max(1, min(LANES, n // LEAST_STEPS))


class Model:
    def __init__(self, vocabulary: int, lanes: int):
        self.vocabulary = vocabulary
        # Each context's id and confidence as one number, id * 4 + confidence.
        self.table1 = np.zeros(vocabulary, dtype=np.int32)
        self.table2 = np.zeros(1 << _CONTEXT_BITS, dtype=np.int32)
        # Counts of the outcomes (order 2 right, order 1 right, neither) by the state of the predictions.
        self.outcomes = np.tile(np.array([2, 2, 4], dtype=np.int64), (2 * (_LIMIT + 1) ** 2, 1))
        self.bounds = np.zeros((len(self.outcomes), 4), dtype=U)
        self.frequency = np.ones(vocabulary, dtype=np.int32)
        self.before = np.zeros(vocabulary + 1, dtype=np.int32)
        self.most = _MOST_IDS - _STEP * lanes  # a step adds no more
        self._sum()
        self.last1 = np.zeros(lanes, dtype=np.int32)
        self.last2 = np.zeros(lanes, dtype=np.int32)

    def _sum(self) -> None:
        np.cumsum(self.frequency, out=self.before[1:])
        self.bounds[:, 1:] = np.cumsum(self.outcomes, axis=1)

    def predict(self, m: int) -> None:
        """Of the first m lanes."""
        if len(self.last1) > m:
            self.last1, self.last2 = self.last1[:m], self.last2[:m]
        mixed = self.last1.view(np.uint32) * np.uint32(0x9E3779B1) + self.last2.view(np.uint32) * np.uint32(0x85EBCA6B)
        self.slot = (mixed >> np.uint32(32 - _CONTEXT_BITS)).astype(np.intp)
        self.seen2, self.seen1 = self.table2.take(self.slot), self.table1.take(self.last1)
        self.guess2, self.guess1 = self.seen2 >> 2, self.seen1 >> 2
        self.state = (self.seen2 & 3) * 8 + (self.seen1 & 3) * 2 + (self.guess2 == self.guess1)

    def outcome(self, ids: np.ndarray) -> np.ndarray:
        out = (ids != self.guess2).astype(np.int32)
        out += out & (ids != self.guess1)
        return out

    def share(self, outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the outcomes' parts."""
        flat, at = self.bounds.ravel(), self.state * 4 + outcome
        start = flat.take(at)
        return start, flat.take(at + 1) - start

    def totals(self) -> np.ndarray:
        return self.bounds[:, 3].take(self.state)

    def learn(self, ids: np.ndarray, outcome: np.ndarray, missed: np.ndarray) -> None:
        """All lanes at once; missed: the ids that no guess named. Where several lanes share a context, the last lane's id stays."""
        self.outcomes += 4 * np.bincount(self.state * 3 + outcome, minlength=self.outcomes.size).reshape(self.outcomes.shape)
        heavy = self.outcomes.sum(axis=1) > _MOST
        while heavy.any():
            self.outcomes[heavy] = (self.outcomes[heavy] + 1) >> 1
            heavy = self.outcomes.sum(axis=1) > _MOST
        new = ids << 2
        for table, at, seen, guess in ((self.table2, self.slot, self.seen2, self.guess2), (self.table1, self.last1, self.seen1, self.guess1)):
            table[at] = new + (ids == guess) * np.minimum((seen & 3) + 1, _LIMIT)
        np.add.at(self.frequency, missed, np.int32(_STEP))
        if self.before[-1] > self.most:
            self.frequency = (self.frequency + 1) >> 1
        self._sum()
        self.last2, self.last1 = self.last1, ids


def _layout(n: int, lanes: int) -> tuple[int, np.ndarray]:
    """Steps, and how many lanes take part in each: the first lanes are a step longer where n doesn't divide."""
    steps = -(-n // lanes)
    return steps, np.array([lanes if s < n // lanes else n % lanes for s in range(steps)], dtype=np.int64)


def _runs(ids: np.ndarray, grid: np.ndarray, write: bool) -> None:
    """Copies the ids to the grid (a row a step, a column a lane), or back."""
    steps, lanes = grid.shape
    size, longer = divmod(len(ids), lanes)
    for own, part in ((ids[: longer * (size + 1)].reshape(longer, -1 if longer else 1), grid[:, :longer]), (ids[longer * (size + 1) :].reshape(lanes - longer, -1), grid[:size, longer:])):
        if own.size and write:
            part[:] = own.T
        elif own.size:
            own[:] = part.T


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """Each lane codes by a range of at least 2^32 after each step, and by a number of 64 bits of which the upper 32 leave when the range gets
    shorter. A carry is added to the word that left last, and is taken on to those before at the end."""
    n = len(ids)
    ids = np.ascontiguousarray(ids, dtype=np.int32)
    check = zlib.crc32(ids.astype("<u4").tobytes())
    if not n:
        return _HEAD.pack(b"AXR2", 0, 0, 0, vocabulary, check, zlib.crc32(b""))
    lanes = lanes_of(n)
    steps, taking = _layout(n, lanes)
    model = Model(vocabulary, lanes)
    grid = np.zeros((steps, lanes), dtype=np.int32)
    _runs(ids, grid, True)
    low, width = np.zeros(lanes, dtype=U), np.full(lanes, _BOTTOM)
    words = np.zeros((steps + 2, lanes), dtype=U)  # a lane's first is always 0, as the range begins with 2^32
    left = np.zeros(lanes, dtype=np.intp)  # words that have left
    flat = words.ravel()
    asked = [np.arange(lanes, 2 * lanes)]

    def add(m: int, more: np.ndarray) -> None:
        low[:m] += more
        over = np.flatnonzero(low[:m] < more)
        if len(over):
            flat[(left[over] - 1) * lanes + over] += U(1)

    for s in range(steps):
        m = int(taking[s])
        own = grid[s, :m]
        model.predict(m)
        outcome = model.outcome(own)
        start, size = model.share(outcome)
        unit = width[:m] // model.totals()
        more, now = unit * start, unit * size
        rest = np.flatnonzero(outcome == 2)
        missed = own.take(rest)
        if len(rest):
            unit = now.take(rest) // U(int(model.before[-1]))
            more[rest] += unit * model.before.take(missed).astype(U)
            now[rest] = unit * model.frequency.take(missed).astype(U)
        add(m, more)
        width[:m] = now
        short = np.flatnonzero(now < _BOTTOM)
        out, at = low.take(short), left.take(short) * lanes + short
        flat[at] = out >> _WORD
        left[short] += 1
        low[short] = out << _WORD
        width[short] = now.take(short) << _WORD
        asked.append(at + 2 * lanes)
        model.learn(own, outcome, missed)
    # One word ends a lane: a number within its range whose further words are 0.
    add(lanes, (U(0) - low) & (_BOTTOM - U(1)))
    flat[left * lanes + np.arange(lanes)] = low >> _WORD
    for k in range(steps + 1, 0, -1):
        words[k - 1] += words[k] >> _WORD
    stream = flat.take(np.concatenate(asked)).astype("<u4")  # without the carries
    body = stream.tobytes()
    return _HEAD.pack(b"AXR2", n, lanes, len(stream), vocabulary, check, zlib.crc32(body)) + body


def decode(block: bytes) -> np.ndarray:
    """The ids of a block. A block that is cut, altered or of another format is an error."""
    if len(block) < _HEAD.size or block[:4] != b"AXR2":
        raise ValueError("not a block of token ids")
    _, n, lanes, words, vocabulary, check, body_check = _HEAD.unpack_from(block)
    body = memoryview(block)[_HEAD.size :]
    if len(body) != 4 * words or zlib.crc32(body) != body_check:
        raise ValueError("the block's checksum is wrong")
    ids = np.zeros(n, dtype=np.int32)
    if n:
        _decode(ids, n, lanes, vocabulary, np.frombuffer(body, dtype="<u4").astype(np.uint32))
    if zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise ValueError("the ids' checksum is wrong")
    return ids


def _decode(ids: np.ndarray, n: int, lanes: int, vocabulary: int, word: np.ndarray) -> None:
    steps, taking = _layout(n, lanes)
    model = Model(vocabulary, lanes)
    grid = np.zeros((steps, lanes), dtype=np.int32)
    # A lane's number, less the low end of its range.
    code, width, read = word[:lanes].astype(U), np.full(lanes, _BOTTOM), lanes

    for s in range(steps):
        m = int(taking[s])
        model.predict(m)
        totals = model.totals()
        unit = width[:m] // totals
        target = np.minimum(code[:m] // unit, totals - U(1))
        outcome = (target >= model.bounds[:, 1].take(model.state)).astype(np.int32) + (target >= model.bounds[:, 2].take(model.state))
        start, size = model.share(outcome)
        code[:m] -= unit * start
        now = unit * size
        own = np.where(outcome == 0, model.guess2, model.guess1)
        rest = np.flatnonzero(outcome == 2)
        whole = int(model.before[-1])
        unit = now.take(rest) // U(whole)
        at = code.take(rest)
        target = np.minimum(at // unit, U(whole - 1)).astype(np.int32)
        missed = _found(model.before, target)
        code[rest] = at - unit * model.before.take(missed).astype(U)
        now[rest] = unit * model.frequency.take(missed).astype(U)
        own[rest] = missed
        width[:m] = now
        short = np.flatnonzero(now < _BOTTOM)
        width[short] = now.take(short) << _WORD
        code[short] = (code.take(short) << _WORD) | word[read : read + len(short)]
        read += len(short)
        grid[s, :m] = own
        model.learn(own, outcome, missed)
    _runs(ids, grid, False)


def _found(before: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The id whose part each target is in. They are looked up in ascending order, which keeps to the same places of memory."""
    order = np.sort(target.astype(np.int64) << 32 | np.arange(len(target)))
    out = np.empty(len(target), dtype=np.int32)
    out[order & 0xFFFFFFFF] = np.searchsorted(before, (order >> 32).astype(np.int32), side="right") - 1
    return out
