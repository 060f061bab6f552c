"""An adaptive context-mixing range coder for token ids, run for many blocks side by side.

Every block starts from the same state, so blocks are independent; arrays hold
one entry per block ("lane") and a step codes one id of each. An id has two
guesses, what followed the last two ids before (order 2) and what followed the
last id (order 1). It is coded as

- if one of them has been right before: whether it is a guess, at a probability
  mixed from three adaptive ones: by confidence of the order-2 entry, by
  confidence and agreement of the order-1 entry, and by recent hits;
- if it is and the guesses differ: which of them, mixed likewise;
- else: the id itself under counts of all ids (order 0), which are taken once
  over what is coded together and go along with it (:class:`Counts`).

Mixing is in the logistic domain with integer weights learnt per block. All
arithmetic is on integers, so any machine reads what another wrote. The coder
is a range coder on 64 bits that puts out 16-bit words and adds carries to
those it has put out; it shifts after each of the three.

A step is some numpy calls whatever the number of lanes, so what is alike for
both orders or all three probabilities is one array with a row for each. The
tables of order 0 are the same for all lanes, which keeps them in the cache.
"""

from __future__ import annotations

import zlib
from decimal import Decimal, localcontext

import numpy as np

BLOCK_IDS = 4096
SLOTS = 512
#: Counts of ids are scaled to this sum, so that an interval of 48 bits leaves 30 or more.
TOTAL_BITS = 18
FULL = np.uint64((1 << 64) - 1)
#: An interval below one of these is shifted by a word more.
FLOORS = tuple(np.uint64(1 << n) for n in (48, 32))
ROUND = np.uint64((1 << 48) - 1)
#: A confidence after a miss and after a hit, in its place in an entry.
SURE = np.array([[max(c - 2, 1), min(c + 1, 7)] for c in range(8)], np.int32).reshape(-1) << 16
#: Of the parts of an entry: an id that came once, and the least of one that was right when it was guessed.
ONCE, TWICE = 1 << 16, 2 << 16
HEAVY = 1 << 18  # bound of the weights: sums of three weighed logits stay within 32 bits


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """squash: 12-bit probability of a logit in 1/256 from -2047 on, never certain; stretch: its inverse."""
    with localcontext() as c:
        c.prec = 20
        squash = np.array([int(4096 / (1 + (Decimal(-x) / 256).exp())) for x in range(-2047, 2048)], np.int64).clip(1, 4095)
    stretch = np.searchsorted(squash, np.arange(4096), side="left").clip(0, 4094) - 2047
    return squash.clip(16, 4080).astype(np.int32), stretch.astype(np.int32)


SQUASH, STRETCH = _tables()


class Counts:
    """How often ids below 65536 occur, scaled to a sum of 2 ** TOTAL_BITS with one or more for each that does; all alike if not told."""

    def __init__(self, ids: np.ndarray | None = None, shares: np.ndarray | None = None):
        self.ids = np.arange(1 << 16) if ids is None else ids.astype(np.int64)
        self.shares = np.full(len(self.ids), 1 << TOTAL_BITS - 16, np.int64) if shares is None else shares.astype(np.int64)
        if self.shares.sum() != 1 << TOTAL_BITS:
            raise ValueError("counts do not add up")
        ends = np.cumsum(self.shares)
        # begin and share of an id in one number
        self.spans = np.zeros(1 << 16, np.uint64)
        self.spans[self.ids] = (ends - self.shares << 32 | self.shares).astype(np.uint64)
        self.slots = np.repeat(self.ids.astype(np.uint16), self.shares)

    @classmethod
    def of(cls, ids: np.ndarray) -> Counts:
        times = np.bincount(ids, minlength=1 << 16)
        known = np.flatnonzero(times)
        if not len(known):
            return cls()
        shares = 1 + times[known] * ((1 << TOTAL_BITS) - len(known)) // len(ids)
        shares[shares.argmax()] += (1 << TOTAL_BITS) - shares.sum()
        return cls(known, shares)


class RangeCoder:
    """Encodes when made without data, decodes the words given otherwise.

    ``value`` is what decisions since the last shift add to ``low`` when
    encoding, and the code less the interval's low end when decoding.
    """

    def __init__(self, lanes: int, words: list[np.ndarray] | None = None, ids: int = BLOCK_IDS):
        self.decoding = words is not None
        self.range = np.full(lanes, FULL)
        if self.decoding:
            # zeros follow a block's words; each place shows the four words from there on
            sizes = np.array([len(w) + 8 for w in words])
            self.place, size = np.cumsum(sizes) - sizes, int(sizes.sum())
            flat = np.zeros(size + 3, np.uint16)
            for at, w in zip(self.place, words, strict=True):
                flat[at : at + len(w)] = w
            self.window = np.zeros(size, np.uint64)
            for n in range(4):
                self.window |= flat[n : n + size].astype(np.uint64) << np.uint64(48 - 16 * n)
            self.value = self.window[self.place]
            self.place = self.place + 4
        else:
            self.low, self.value = np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64)
            self.width = ids + 64 * 16 + 8
            self.flat = np.zeros(lanes * self.width, np.uint16)
            self.place = np.arange(lanes) * self.width
        self.steps = 0

    def reserve(self) -> None:
        """Called once per id, which takes fewer than 16 words: the output grows while it is not full."""
        self.steps += 1
        if self.steps % 64 == 0 and not self.decoding:
            begin = np.arange(len(self.place)) * self.width
            if (self.place - begin).max() + 64 * 16 > self.width:
                more = self.width // 2 + 64 * 16
                self.flat = np.pad(self.flat.reshape(-1, self.width), ((0, 0), (0, more))).reshape(-1)
                self.place += np.arange(len(self.place)) * more
                self.width += more

    def part(self, where: np.ndarray | slice) -> RangeCoder:
        """The state of some lanes, to be given back by :meth:`put`."""
        some = object.__new__(RangeCoder)
        some.decoding = self.decoding
        some.range, some.value, some.place = self.range[where], self.value[where], self.place[where]
        if self.decoding:
            some.window = self.window
        else:
            some.low, some.flat = self.low[where], self.flat
        return some

    def put(self, some: RangeCoder, where: np.ndarray | slice) -> None:
        self.range[where], self.value[where], self.place[where] = some.range, some.value, some.place
        if not self.decoding:
            self.low[where] = some.low

    def shift(self) -> None:
        """Shifts out the words that no longer change but for a carry, so that the interval has 48 bits or more."""
        words = (self.range < FLOORS[0]).astype(np.int64)
        words += self.range < FLOORS[1]
        by = (words << 4).astype(np.uint64)
        if self.decoding:
            self.value = self.value << by | self.window.take(self.place, mode="clip") >> np.uint64(1) >> np.uint64(63) - by
        else:
            low = self.low + self.value
            self._carry(self.place[low < self.value] - 1)
            for n in range(int(words.max(initial=0))):
                self.flat[self.place + n if n else self.place] = (low >> np.uint64(48 - 16 * n)).astype(np.uint16)
            self.low, self.value = low << by, np.zeros_like(low)
        self.range = self.range << by
        self.place = self.place + words

    def _carry(self, place: np.ndarray) -> None:
        while len(place):
            self.flat[place] += np.uint16(1)
            place = place[self.flat[place] == 0] - 1

    def bit(self, p: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
        """Codes a yes or no whose yes has probability p / 4096."""
        part = (self.range >> np.uint64(12)) * p.astype(np.uint64)
        if bit is None:
            bit = self.value < part
            self.value = np.where(bit, self.value, self.value - part)
        else:
            self.value = np.where(bit, self.value, self.value + part)
        self.range = np.where(bit, part, self.range - part)
        return bit

    def symbol(self, counts: Counts, symbol: np.ndarray | None, done: np.ndarray) -> np.ndarray:
        """Codes an id under ``counts``; the lanes ``done`` have theirs, and take the whole of their interval."""
        unit = self.range >> np.uint64(TOTAL_BITS)
        if symbol is None:
            symbol = counts.slots.take((self.value // unit).view(np.int64), mode="clip").astype(np.int64)
        span = counts.spans.take(symbol, mode="clip")
        span[done] = 1 << TOTAL_BITS
        left = (span >> np.uint64(32)) * unit
        self.value = self.value - left if self.decoding else self.value + left
        self.range = (span & np.uint64(0xFFFFFFFF)) * unit
        return symbol

    def finish(self) -> list[bytes]:
        """The words of each lane, one more to fix the last interval."""
        low = self.low + ROUND
        self._carry(self.place[low < ROUND] - 1)
        self.flat[self.place] = (low >> np.uint64(48)).astype(np.uint16)
        out = self.flat.reshape(-1, self.width)
        return [out[i, :n].tobytes() for i, n in enumerate(self.place + 1 - np.arange(len(out)) * self.width)]


class Mixed:
    """Three adaptive probabilities by context (8, 16 and 8 of them) and the weights that mix them, per lane."""

    def __init__(self, lanes: int):
        self.p = np.full(lanes * 32, 1 << 15, np.int32)
        self.rows, self.begins = np.array([[0], [1], [2]]) * lanes, np.array([[0], [8], [24]])
        self.w = np.full(3 * lanes, 1 << 14, np.int32)

    def code(self, coder: RangeCoder, lanes: np.ndarray, contexts: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
        """Codes a decision of some lanes."""
        places = contexts + self.begins
        places += lanes << 5
        rows = self.rows + lanes
        probs = self.p.take(places, mode="clip")
        logits = STRETCH.take(probs >> 4, mode="clip")
        weights = self.w.take(rows, mode="clip")
        mixed = logits * weights
        mixed = mixed[0] + mixed[1] + mixed[2] >> 15
        p = SQUASH.take(mixed + 2047, mode="clip")
        bit = coder.bit(p, bit)
        yes = bit.astype(np.int32)
        probs += yes * 65535 - probs >> 4
        self.p[places] = probs
        weights += logits * ((yes << 12) - p) >> 9
        self.w[rows] = np.minimum(np.maximum(weights, -HEAVY, out=weights), HEAVY, out=weights)
        return bit


class Model:
    def __init__(self, lanes: int, counts: Counts | None = None):
        #: Per lane what followed two ids, then what followed one: id + 65536 * confidence.
        self.table = np.full(lanes * 2 * SLOTS, 0, np.int32)
        self.base = np.arange(lanes) * (2 * SLOTS) + np.array([[0], [SLOTS]])
        self.first, self.second = Mixed(lanes), Mixed(lanes)
        self.counts = counts or Counts()
        self.recent = np.zeros(lanes, np.int64)

    def step(self, coder: RangeCoder, last: np.ndarray, before: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
        """Codes one id in each of the first lanes, after the ids ``before`` and ``last``."""
        n = len(last)
        at = np.empty((2, n), np.int64)
        at[0] = before * 40503 + last * 60493 >> 4
        at[1] = last * 40503 >> 3
        at &= SLOTS - 1
        at += self.base[:, :n]
        entry = self.table.take(at, mode="clip")
        out = np.zeros(n, np.int64) if ids is None else ids
        # lanes with a guess that has been right before
        asked = np.flatnonzero((entry[0] | entry[1]) >= TWICE)
        own = entry.take(asked, axis=1, mode="clip")
        guess, sure = own & 0xFFFF, own >> 16
        recent, same = self.recent.take(asked, mode="clip"), guess[0] == guess[1]
        contexts = np.empty((3, len(asked)), np.int64)
        contexts[0], contexts[1], contexts[2] = sure[0], sure[1] * 2 + same, recent
        right = None if ids is None else guess == ids.take(asked, mode="clip")
        now = coder.part(asked)
        hit = self.first.code(now, asked, contexts, None if ids is None else right[0] | right[1])
        now.shift()
        both = np.flatnonzero(hit & ~same)
        some = now.part(both)
        second = self.second.code(some, asked.take(both, mode="clip"), contexts.take(both, axis=1, mode="clip"), None if ids is None else right[0].take(both, mode="clip"))
        some.shift()
        now.put(some, both)
        coder.put(now, asked)
        now, done = coder.part(slice(0, n)), asked[hit]
        got = now.symbol(self.counts, ids, done)
        now.shift()
        coder.put(now, slice(0, n))
        if ids is None:
            found = guess[0].copy()
            found[both] = np.where(second, guess[0].take(both, mode="clip"), guess[1].take(both, mode="clip"))
            out = got
            out[done] = found[hit]
            right = guess == out[asked]
        # an entry not yet right takes the id or is right now; others lose confidence by a miss and at the bottom take the id
        fresh = out.astype(np.int32) + np.int32(ONCE)
        new = fresh + ((entry == fresh).view(np.int8).astype(np.int32) << 16)
        new[:, asked] = SURE.take(sure * 2 + right, mode="clip") | np.where(right | (sure > 2), guess, out.take(asked, mode="clip"))
        self.table[at] = new
        self.recent[asked] = (recent << 1 | hit) & 7
        return out


def _blocks(n: int, size: int) -> list[int]:
    return [min(size, n - at) for at in range(0, n, size)]


def encode(ids: np.ndarray, size: int = BLOCK_IDS, counts: Counts | None = None) -> list[bytes]:
    """One byte string per block of ``size`` ids below 65536; all of them must occur in ``counts``, if given."""
    lengths = np.array(_blocks(len(ids), size), np.int64)
    if not len(lengths):
        return []
    grid = np.zeros((len(lengths), size), np.int32)
    grid.reshape(-1)[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.T)
    coder, model = RangeCoder(len(lengths), ids=size), Model(len(lengths), counts)
    last, before = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for t in range(int(lengths.max())):
        n = len(lengths) - (lengths[-1] <= t)
        now = grid[t, :n].astype(np.int64)
        coder.reserve()
        model.step(coder, last[:n], before[:n], now)
        before[:n], last[:n] = last[:n], now
    return coder.finish()


def decode(blocks: list[bytes], n: int, size: int = BLOCK_IDS, counts: Counts | None = None) -> np.ndarray:
    """The ``n`` ids of the blocks that :func:`encode` made with the same ``counts``."""
    lengths = np.array(_blocks(n, size), np.int64)
    if len(lengths) != len(blocks):
        raise ValueError("number of blocks does not fit the number of ids")
    if not n:
        return np.empty(0, np.int64)
    coder, model = RangeCoder(len(blocks), [np.frombuffer(b, np.uint16) for b in blocks]), Model(len(blocks), counts)
    grid = np.zeros((size, len(blocks)), np.int32)
    last, before = np.zeros(len(blocks), np.int64), np.zeros(len(blocks), np.int64)
    for t in range(int(lengths.max())):
        m = len(lengths) - (lengths[-1] <= t)
        now = model.step(coder, last[:m], before[:m], None)
        grid[t, :m] = now
        before[:m], last[:m] = last[:m], now
    return grid.T.reshape(-1)[:n]


def checksums(blocks: list[bytes]) -> list[int]:
    return [zlib.crc32(b) for b in blocks]
