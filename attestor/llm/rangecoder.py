"""Context-mixing range coder for token ids.

Blocks are coded side by side: one numpy step handles the same position of up to
some thousand blocks, each with its own adaptive models, which start fresh, and its own coder state.

For each id three predictors speak.  Order 2 and order 1 adapt: they name the id that last followed the
same two ids or the same id.  Order 0 is a table of frequencies of the whole group of blocks, which the
group's first block carries; with it every block can be decoded alone.  A pair of adaptive bounds,
chosen by the confidence of the two higher orders, mixes the three into one distribution.

Bounds and frequencies have powers of two as totals, so that coding divides nothing and decoding once.
Carries are added to the last word written and settled at the end, so that the decoder needs no lower end.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Entries of the tables of a block: small, so that those of a thousand blocks stay near the processor.
_TABLE, _CONTEXTS = 1024, 32
#: Bits of the bounds and of the frequencies, and the rate at which bounds adapt.
_MIX, _FREQ, _RATE = 15, 18, 5
#: What bounds keep free for each event; rounding may take 32 of it.
_LEAST = 64
_FULL = 1 << _MIX
#: Where the bounds head after order 2, order 1 or order 0 was right, as two 16-bit numbers in one.
_GOALS = np.array([[_FULL - 2 * _LEAST, _FULL - _LEAST], [_LEAST, _FULL - _LEAST], [_LEAST, 2 * _LEAST]], dtype="<i2").view("<u4").ravel()
#: The bounds at the start, by confidence of order 2, of order 1, and whether both name the same id.
_FIRST = np.array([[a, a + b] for a in (256, 4096, 10240, 18432) for b in (512, 2048, 6144, 10240) for _ in range(2)], dtype="<i2").view("<u4").ravel()
_U = np.uint64
_32, _MIXED, _SHARED, _FLOOR = _U(32), _U(_MIX), _U(_FREQ), _U(1 << 32)
_WORD = _U(0xFFFFFFFF)


class _Model:
    """The adaptive predictors of all lanes; arrays are flat, lane after lane.

    A prediction packs its id with a confidence of two bits.
    """

    def __init__(self, lanes: int):
        self.order2, self.order1 = np.zeros(lanes * _TABLE, np.uint32), np.zeros(lanes * _TABLE, np.uint32)
        self.bounds = np.tile(_FIRST, lanes)
        self.table, self.rows = np.arange(lanes, dtype=np.int64) * _TABLE, np.arange(lanes, dtype=np.int64) * _CONTEXTS
        self.before, self.hashed = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def predict(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids by order 2 and 1, and the two bounds of each lane."""
        h = self.before[:k] * 40503
        self.at1 = self.table[:k] + ((h >> 4) & (_TABLE - 1))
        self.at2 = self.table[:k] + (((h ^ self.hashed[:k]) >> 3) & (_TABLE - 1))
        e1, e2 = self.order1.take(self.at1), self.order2.take(self.at2)
        p1, p2 = e1 >> np.uint32(2), e2 >> np.uint32(2)
        self.sure1, self.sure2 = e1 & np.uint32(3), e2 & np.uint32(3)
        context = (self.sure2 << np.uint32(3)) | (self.sure1 << np.uint32(1)) | (p1 == p2)
        self.row = self.rows[:k] + context
        self.pair = self.bounds.take(self.row)
        return p2, p1, self.pair.view("<u2").reshape(-1, 2)

    def update(self, x: np.ndarray, right2: np.ndarray, right1: np.ndarray, event: np.ndarray) -> None:
        k = len(x)
        pair = self.pair.view("<i2")
        pair += (_GOALS.take(event).view("<i2") - pair) >> _RATE
        self.bounds[self.row] = self.pair
        entry = x << np.uint32(2)
        for at, table, sure, right in ((self.at2, self.order2, self.sure2, right2), (self.at1, self.order1, self.sure1, right1)):
            table[at] = entry | np.minimum(sure + right, np.uint32(3)) * right
        np.multiply(self.before[:k], 30011, out=self.hashed[:k])
        self.before[:k] = x


class Table:
    """Frequencies of ids, all of which add up to 2 ** 18; ids that do not occur have none."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray, vocab: int):
        self.ids, self.freq, self.vocab = ids, freq, vocab
        if len(ids) != len(freq) or not len(ids) or int(freq.sum()) != 1 << _FREQ or freq.min() < 1 or ids.max() >= vocab:
            raise ValueError("table of frequencies")
        # the last entry stands for ids that a higher order has named
        self.width, self.start = np.zeros(vocab + 1, _U), np.zeros(vocab + 1, _U)
        self.width[ids], self.width[vocab] = freq, 1 << _FREQ
        self.start[ids] = np.cumsum(freq) - freq

    @classmethod
    def of(cls, ids: np.ndarray, vocab: int) -> Table:
        counts = np.bincount(ids, minlength=vocab)
        present = np.flatnonzero(counts)
        counts, full = counts[present], 1 << _FREQ
        low, high = 0.0, full / len(ids)
        for _ in range(40):  # the largest factor at which all ids, each with 1 at least, have room
            factor = (low + high) / 2
            low, high = (factor, high) if np.maximum(1, counts * factor).astype(np.int64).sum() <= full else (low, factor)
        freq = np.maximum(1, (counts * low).astype(np.int64))
        freq[counts.argmax()] += full - freq.sum()
        return cls(present, freq, vocab)

    def pack(self) -> bytes:
        return zlib.compress(np.diff(self.ids, prepend=0).astype("<u2").tobytes() + (self.freq - 1).astype("<u4").tobytes(), 6)

    @classmethod
    def unpack(cls, data: bytes | memoryview, vocab: int) -> Table:
        plain = zlib.decompress(data)
        n = len(plain) // 6
        return cls(np.cumsum(np.frombuffer(plain, "<u2", n), dtype=np.int64), np.frombuffer(plain, "<u4", n, 2 * n).astype(np.int64) + 1, vocab)

    def lookup(self) -> np.ndarray:
        return np.repeat(self.ids.astype(np.uint16), self.freq)


_SIZE = struct.Struct("<I")


def carries_table(block: bytes | memoryview) -> bool:
    """Whether a block is the first of its group."""
    return _SIZE.unpack_from(block)[0] > 0


def encode(ids: np.ndarray, size: int, vocab: int) -> list[bytes]:
    """The ids in blocks of ``size`` (the last may be shorter); the first holds the table for all."""
    lanes = -(-len(ids) // size)
    table = Table.of(ids, vocab)
    grid = np.zeros(lanes * size, np.uint32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, size).T)
    last = len(ids) - (lanes - 1) * size
    model = _Model(lanes)
    low, width = np.zeros(lanes, _U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
    room = size + 3  # a word before the first takes no carry, for all stays below 1
    out, at = np.zeros(lanes * room, _U), np.arange(lanes, dtype=np.int64) * room + 1
    named = np.uint32(vocab)
    for t in range(size):
        k = lanes if t < last else lanes - 1
        if not k:
            break
        x = grid[t, :k]
        p2, p1, bounds = model.predict(k)
        right2, right1 = p2 == x, p1 == x
        event = np.where(right2, 0, 2 - right1)
        b1, b2 = bounds[:, 0].astype(_U), bounds[:, 1].astype(_U)
        symbol = np.where(right1 | right2, named, x)
        step = width[:k] >> _MIXED
        begin = np.where(right2, _U(0), np.where(right1, b1, b2))
        end = np.where(right2, b1, np.where(right1, b2, _U(_FULL)))
        inner = (step * (end - begin)) >> _SHARED
        more = low[:k] + (step * begin + inner * table.start.take(symbol))
        over = np.flatnonzero(more < low[:k])
        if over.size:
            out[at[over] - 1] += _U(1)
        low[:k] = more
        width[:k] = inner * table.width.take(symbol)
        due = np.flatnonzero(width < _FLOOR)
        if due.size:
            a, place = low[due], at[due]
            out[place] = a >> _32
            at[due] = place + 1
            low[due] = a << _32
            width[due] <<= _32
        model.update(x, right2, right1, event)
    for _ in range(2):
        out[at] = low >> _32
        at += 1
        low <<= _32
    ends = at - np.arange(lanes) * room
    words = out.reshape(lanes, room)[:, : ends.max()]
    for j in range(words.shape[1] - 1, 0, -1):
        words[:, j - 1] += words[:, j] >> _32
    words = (words & _WORD).astype("<u4")
    head = table.pack()
    return [_SIZE.pack(0 if i else len(head)) + (b"" if i else head) + words[i, 1 : ends[i]].tobytes() for i in range(lanes)]


def table_of(block: bytes | memoryview, vocab: int) -> Table:
    """The table that the first block of a group carries."""
    n = _SIZE.unpack_from(block)[0]
    if not n:
        raise ValueError("the table stands in the first block of a group")
    return Table.unpack(block[_SIZE.size : _SIZE.size + n], vocab)


def decode(blocks: list[bytes], counts: list[int], size: int, vocab: int, table: Table | None = None) -> np.ndarray:
    """The ids of blocks of ``size`` ids (fewer only in the last), one after the other.

    Blocks without the first of their group need its ``table``.
    """
    lanes = len(blocks)
    if any(c != size for c in counts[:-1]) or not 0 < counts[-1] <= size:
        raise ValueError("only the last block may be short")
    table = table or table_of(blocks[0], vocab)
    lookup, last = table.lookup(), counts[-1]
    codes = [memoryview(b)[_SIZE.size + _SIZE.unpack_from(b)[0] :] for b in blocks]
    words = np.frombuffer(b"".join(codes) + b"\0" * 64, dtype="<u4").astype(_U)
    at = np.concatenate([[0], np.cumsum([len(c) // 4 for c in codes])[:-1]]).astype(np.int64)
    ahead = (words[at] << _32) | words[at + 1]  # how far the code is above the lower end
    at += 2
    model = _Model(lanes)
    width = np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
    grid = np.zeros((size, lanes), np.uint16)
    most, named = _U((1 << _FREQ) - 1), np.uint32(vocab)
    for t in range(size):
        k = lanes if t < last else lanes - 1
        if not k:
            break
        p2, p1, bounds = model.predict(k)
        b1, b2 = bounds[:, 0].astype(_U), bounds[:, 1].astype(_U)
        step, d = width[:k] >> _MIXED, ahead[:k]
        s1, s2 = step * b1, step * b2
        in2, in1 = d < s1, d < s2
        begin = np.where(in2, _U(0), np.where(in1, s1, s2))
        d = d - begin
        inner = (np.where(in2, s1, np.where(in1, s2, step << _MIXED)) - begin) >> _SHARED
        found = lookup.take(np.minimum(d // inner, most).astype(np.int64)).astype(np.uint32)
        event = 2 - in1.astype(np.int64) - in2
        symbol = np.where(in1, named, found)
        x = np.where(in2, p2, np.where(in1, p1, found))
        ahead[:k] = d - inner * table.start.take(symbol)
        width[:k] = inner * table.width.take(symbol)
        grid[t, :k] = x
        due = np.flatnonzero(width < _FLOOR)
        if due.size:
            place = at[due]
            ahead[due] = (ahead[due] << _32) | words[place]
            at[due] = place + 1
            width[due] <<= _32
        model.update(x, x == p2, x == p1, event)
    return grid.T.ravel()[: (lanes - 1) * size + last]
