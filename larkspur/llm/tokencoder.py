"""Range coder over token ids, driven by mixed order-0 to order-2 predictions.

A segment of ids is cut into blocks. Every block starts from a fresh model and coder and carries its own checksum, so any block
decodes from itself and the segment's header, which holds the histogram. All blocks of the segments given are coded in step, one numpy lane each.

Model of the next id: a mixture of three distributions. Orders 1 and 2 each predict the id that last followed the previous one or
two ids, with a confidence; order 0 is the segment's id histogram. The weights of orders 1 and 2 are their hit rates so far
at their present confidence. The mixture's cumulative sum is exact in integers, so decoding inverts it without a search.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = b"LRC3"
#: Bits of the order-0 histogram's total, of the weights' total, and of context tables.
HISTOGRAM_BITS, WEIGHT_BITS, TABLE_BITS = 18, 12, 12
_TOTAL_BITS = HISTOGRAM_BITS + WEIGHT_BITS
_CONFIDENCES = 16
#: Steps whose contexts the encoder works out together.
_STEPS = 16
_U = np.uint64
# A step is a row of short operations, so their constants are arrays from the start.
_FOUR, _FIVE, _FIFTEEN, _KEPT, _SIGN, _TOP = (np.array(x, np.int32) for x in (4, 5, 15, -16, 31, 65535))
_FACTOR_LAST, _FACTOR_BEFORE, _THREE, _SLOT = (np.array(x, np.int32) for x in (40503, 60493, 3, (1 << TABLE_BITS) - 1))
_LOW32, _WORD, _ONE_WORD, _UNIT = (np.array(x, np.uint64) for x in (0xFFFFFFFF, 32, 1 << 32, _TOTAL_BITS))


def scaled_histogram(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to the fixed total, at least 1 for each id that occurs."""
    total, used = 1 << HISTOGRAM_BITS, np.flatnonzero(counts)
    if len(used) > total:
        raise ValueError("more distinct ids in a segment than the histogram can tell apart")
    scaled = np.zeros(len(counts), dtype=np.int64)
    if len(used):
        room = total - len(used)
        share = counts[used].astype(np.float64) / counts[used].sum()
        scaled[used] = 1 + np.floor(share * room).astype(np.int64)
        scaled[used[np.argmax(counts[used])]] += total - scaled.sum()
    return scaled


def _next_confidences() -> np.ndarray:
    """Confidence after a miss (0 to 15) and after a hit (16 to 31), by the confidence before.

    A hit adds one up to 15, a miss halves it; a miss at confidence 1 or an empty entry takes the new id, at confidence 1.
    """
    confidence = np.arange(_CONFIDENCES)
    return np.concatenate([np.maximum(confidence >> 1, 1), np.minimum(confidence + 1, _CONFIDENCES - 1)]).astype(np.int32)


_NEXT = _next_confidences()


def _hashed(before: np.ndarray, last: np.ndarray, out: np.ndarray) -> None:
    """Table slots of the contexts of orders 1 and 2, into rows 0 and 1 of the last but one axis. 32 bits may wrap: only low ones count."""
    mixed, both = last * _FACTOR_LAST, last * before
    np.right_shift(mixed, _THREE, out=out[..., 0, :])
    both >>= _FIVE
    both += mixed
    np.multiply(before, _FACTOR_BEFORE, out=mixed)
    np.add(both, mixed, out=out[..., 1, :])
    out &= _SLOT


class _Lanes:
    """Adaptive state of blocks, all at the same position. Orders 1 and 2 are rows 0 and 1 of each array.

    Ids are ranks among those their segment uses, counted on over the segments; each segment has one more, of no frequency.
    """

    def __init__(self, lanes: int, frequencies: list[np.ndarray]):
        slots = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes)
        self.table_base, self.rate_base = slots << TABLE_BITS, slots << 4
        self.table = np.full(2 * lanes << TABLE_BITS, -16, dtype=np.int32)  # id << 4 | confidence; id -1 at confidence 0: nothing yet
        self.rate = np.full(2 * lanes * _CONFIDENCES, 1 << 10, dtype=np.int32)  # hit rate in 1 / 2**16
        self.rate[::_CONFIDENCES] = 0
        # Frequency and, in the high half, the sum below: one look-up for both. The last row is that of id -1.
        self.sums = np.concatenate([np.append(f + (np.cumsum(f) - f << 32), 0) for f in frequencies])
        # Kept between steps, as a step is too short to allocate in.
        self.confidence, self.state = np.empty((2, 2, lanes), np.int64)
        self.hit, self.kept, self.change, self.new = np.empty((4, 2, lanes), np.int32)

    def histogram_at(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums below the ids and their frequencies in the histogram; 0 and 0 for id -1."""
        both = self.sums.take(ids, mode="wrap").astype("<i8", copy=False).view("<i4")
        return both[..., 1::2], both[..., ::2]

    def look(self, place: np.ndarray, entry: np.ndarray, rates: np.ndarray) -> None:
        """Entries at ``place`` and the hit rates at their confidence."""
        self.table.take(place, out=entry, mode="clip")
        np.bitwise_and(entry, _FIFTEEN, out=self.confidence)
        np.add(self.rate_base, self.confidence, out=self.state)
        self.rate.take(self.state, out=rates, mode="clip")

    def learn(self, place: np.ndarray, entry: np.ndarray, rates: np.ndarray, hit: np.ndarray, ids: np.ndarray) -> None:
        """Takes the ids of the position that ``look`` was called for last."""
        self.hit[...] = hit
        np.multiply(self.hit, _TOP, out=self.change)
        self.change -= rates
        self.change >>= _FIVE
        self.change += rates
        self.rate[self.state] = self.change
        self.hit <<= _FOUR
        self.confidence += self.hit
        # All bits set where the new id replaces the old one: after a miss at confidence 1 or 0.
        np.subtract(self.confidence, 2, out=self.new, casting="same_kind")
        self.new >>= _SIGN
        np.bitwise_xor(entry, ids << _FOUR, out=self.kept)
        self.kept &= self.new
        self.kept ^= entry
        self.kept &= _KEPT
        _NEXT.take(self.confidence, out=self.change, mode="clip")
        self.kept += self.change
        self.table[place] = self.kept


def _masses(rates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masses of orders 1 and 2 in 1 / 2**30, and the weight of order 0 in 1 / 2**12."""
    mass = rates >> _FOUR
    one, two = mass[..., 0, :], mass[..., 1, :]
    np.minimum(two, 4000, out=two)
    rest = 4064 - two
    one *= rest
    one >>= WEIGHT_BITS
    rest -= one
    rest += (1 << WEIGHT_BITS) - 4064
    mass <<= HISTOGRAM_BITS
    return mass, rest


def _interval(model: _Lanes, ids: np.ndarray, rest: np.ndarray, passed: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative sum below the ids and their frequencies, in 1 / 2**30, from the masses below the ids and on them."""
    below, size = model.histogram_at(ids)
    below, size = rest * below, rest * size
    below += passed[..., 0, :]
    below += passed[..., 1, :]
    size += own[..., 0, :]
    size += own[..., 1, :]
    return below.astype(np.uint64), size.astype(np.uint64)


class _Coder:
    """Low end and width of every lane's range."""

    def __init__(self, lanes: int):
        self.low, self.span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        self.unit = self.span >> _UNIT

    def narrow(self, below: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Narrows the ranges to an interval; returns by how much the low ends rose."""
        rise = self.unit * below
        self.low += rise
        np.multiply(self.unit, size, out=self.span)
        return rise

    def spent(self) -> np.ndarray:
        """Lanes whose range is spent."""
        return np.flatnonzero(self.span.astype("<u8", copy=False).view("<u4")[1::2] == 0)

    def renew(self, tight: np.ndarray) -> np.ndarray:
        """Moves spent ranges on by a word, and returns that word. Where the high words of both ends differ, the range is cut at the word's end first."""
        low, span = self.low.take(tight), self.span.take(tight)
        np.minimum(span, _ONE_WORD - (low & _LOW32), out=span)
        span <<= _WORD
        self.span[tight] = span
        self.low[tight] = low << _WORD
        np.right_shift(self.span, _UNIT, out=self.unit)
        return low >> _WORD


@dataclass(frozen=True)
class Segment:
    """Coded ids: the header with the histogram, and one payload per block."""

    data: bytes

    @property
    def n_bytes(self) -> int:
        return len(self.data)


def encode_segment(ids: np.ndarray, block: int = 4096) -> bytes:
    """One segment of ``encode_segments``."""
    return encode_segments([ids], block)[0]


def encode_segments(parts: list[np.ndarray], block: int = 4096) -> list[bytes]:
    """Each part's ids (below 2**27) as a segment: header, histogram, then count, checksum, size and payload per block.

    The parts are coded in step, as a step of many lanes costs little more than one of few. A segment does not depend on the others.
    """
    parts = [np.ascontiguousarray(ids, dtype=np.int32) for ids in parts]
    out, frequencies, ranks = [], [], []
    for ids in parts:
        histogram = scaled_histogram(np.bincount(ids) if len(ids) else np.zeros(0, np.int64))
        used = np.flatnonzero(histogram)
        table = zlib.compress(np.concatenate([np.diff(used, prepend=0), histogram[used]]).astype("<u4").tobytes(), 6)
        out.append([MAGIC + struct.pack("<QIII", len(ids), block, len(used), len(table)) + table])
        rank = np.zeros(len(histogram), np.int32)
        rank[used] = np.arange(len(used))
        frequencies.append(histogram[used])
        ranks.append(rank)
    of_part = [-(-len(ids) // block) for ids in parts]
    lanes, firsts = sum(of_part), np.cumsum([0, *of_part])
    if not lanes:
        return [b"".join(x) for x in out]
    sizes = np.full(lanes, block, dtype=np.int64)
    base = np.repeat(np.cumsum([0, *(len(f) + 1 for f in frequencies)])[:-1], of_part).astype(np.int32)
    # Two empty rows first: the context of the first ids.
    grid = np.zeros((block + 2, lanes), dtype=np.int32)
    for ids, rank, n, first in zip(parts, ranks, of_part, firsts):
        if n:
            padded = np.zeros(block * n, dtype=np.int32)
            padded[: len(ids)] = rank[ids]
            grid[2:, first : first + n] = padded.reshape(n, block).T
            sizes[first + n - 1] = len(ids) - block * (n - 1)
    words, width = np.zeros(lanes * (block + 4), dtype=np.uint32), block + 4
    begin = np.arange(lanes, dtype=np.int64) * width
    at, model, coder = begin.copy(), _Lanes(lanes, frequencies), _Coder(lanes)
    payloads = [b""] * lanes

    def finish(step: int) -> None:
        for lane in np.flatnonzero(sizes == step):
            low = np.array([coder.low[lane] >> _WORD, coder.low[lane] & _LOW32], "<u4")
            payloads[lane] = words[begin[lane] : at[lane]].astype("<u4").tobytes() + low.tobytes()

    # The contexts are known beforehand, so only the tables and the ranges go step by step.
    steps, ends = int(sizes.max()), set(sizes.tolist())
    place = np.empty((_STEPS, 2, lanes), np.int64)
    entry, rates, slot = np.empty((3, _STEPS, 2, lanes), np.int32)
    hit = np.empty((_STEPS, 2, lanes), bool)
    for first in range(0, steps, _STEPS):
        k = min(_STEPS, steps - first)
        _hashed(grid[first : first + k], grid[first + 1 : first + 1 + k], slot[:k])
        np.add(slot, model.table_base, out=place)
        now = grid[first + 2 : first + 2 + k] + base
        for i in range(k):
            model.look(place[i], entry[i], rates[i])
            np.equal(entry[i] >> _FOUR, now[i], out=hit[i])
            model.learn(place[i], entry[i], rates[i], hit[i], now[i])
        mass, rest = _masses(rates[:k])
        passed = mass * (now[:, None] > entry[:k] >> _FOUR)
        mass *= hit[:k]
        below, size = _interval(model, now, rest, passed, mass)
        for i in range(k):
            if first + i in ends:
                finish(first + i)  # what these lanes code from here on is not used
            coder.narrow(below[i], size[i])
            tight = coder.spent()
            full = at.take(tight)
            words[full] = coder.renew(tight)
            at[tight] = full + 1
    finish(steps)
    for ids, n, first, blocks in zip(parts, of_part, firsts, out):
        for lane in range(n):
            size, payload = sizes[first + lane], payloads[first + lane]
            sum_ = zlib.crc32(ids[lane * block : lane * block + size].astype("<u4").tobytes())
            blocks.append(struct.pack("<III", size, sum_, len(payload)) + payload)
    return [b"".join(x) for x in out]


def decode_segment(data: bytes) -> np.ndarray:
    """The ids of a segment; raises ValueError if a block's checksum does not match."""
    return decode_segments([data])[0]


def decode_segments(parts: list[bytes]) -> list[np.ndarray]:
    """The ids of each segment, decoded in step; raises ValueError if a block's checksum does not match."""
    heads, of_part = [], []
    for data in parts:
        if data[:4] != MAGIC:
            raise ValueError("not a segment")
        n, block, used, packed = struct.unpack_from("<QIII", data, 4)
        table = np.frombuffer(zlib.decompress(data[24 : 24 + packed]), dtype="<u4").astype(np.int64)
        heads.append((n, block, np.cumsum(table[:used]), table[used:], 24 + packed))
        of_part.append(-(-n // block))
    lanes, firsts = sum(of_part), np.cumsum([0, *of_part])
    if not lanes:
        return [np.zeros(0, np.int64) for _ in parts]
    sizes, sums = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    words = np.zeros((lanes, max(head[1] for head in heads) + 8), dtype=np.uint32)
    for data, head, n, first in zip(parts, heads, of_part, firsts):
        at = head[4]
        for lane in range(first, first + n):
            sizes[lane], sums[lane], size = struct.unpack_from("<III", data, at)
            words[lane, : size // 4] = np.frombuffer(data, dtype="<u4", count=size // 4, offset=at + 12)
            at += 12 + size
    frequencies = [head[3] for head in heads]
    bases = np.cumsum([0, *(len(f) + 1 for f in frequencies)])
    slots = np.concatenate([np.repeat(np.arange(len(f), dtype=np.int32) + np.int32(b), f) for f, b in zip(frequencies, bases)])
    base = np.repeat(bases[:-1], of_part).astype(np.int32)
    slot_base = np.repeat(np.cumsum([0, *(f.sum() for f in frequencies)])[:-1], of_part).astype(np.float64)
    model, coder = _Lanes(lanes, frequencies), _Coder(lanes)
    ahead = (words[:, 0].astype(np.uint64) << _WORD) | words[:, 1]  # of the low end
    at, words = np.arange(lanes, dtype=np.int64) * words.shape[1] + 2, words.reshape(-1)
    steps, most = int(sizes.max()), np.array((1 << _TOTAL_BITS) - 1, np.uint64)
    grid = np.zeros((steps, lanes), dtype=np.int32)
    before, last = np.zeros((2, lanes), np.int32)
    place, (entry, rates, slot, start, past) = np.empty((2, lanes), np.int64), np.empty((5, 2, lanes), np.int32)
    for t in range(steps):  # a lane that has ended goes on; what it yields is cut off below
        _hashed(before, last, slot)
        np.add(slot, model.table_base, out=place)
        model.look(place, entry, rates)
        guess, (mass, rest) = entry >> _FOUR, _masses(rates)
        target = np.minimum(ahead // coder.unit, most).astype(np.int32)
        # Where the guessed ids' intervals begin and end: another guess's mass lies before, in or behind.
        below, size = model.histogram_at(guess)
        np.multiply(rest, below, out=start)
        np.multiply(rest, size, out=past)
        past += mass
        np.subtract(target, start, out=start)
        start[0] -= mass[1] * (guess[0] > guess[1])
        start[1] -= mass[0] * (guess[0] < guess[1])
        same = guess[0] == guess[1]
        past[0] += mass[1] * same
        past[1] += mass[0] * same
        hit = start.view(np.uint32) < past.view(np.uint32)
        passed = mass * (start >= past)
        target -= passed[0]
        target -= passed[1]
        at_slot = target / rest
        np.floor(at_slot, out=at_slot)
        at_slot += slot_base
        now = slots.take(at_slot.astype(np.int64), out=grid[t], mode="clip")
        np.putmask(now, hit[1], guess[1])
        np.putmask(now, hit[0], guess[0])
        mass *= hit
        ahead -= coder.narrow(*_interval(model, now, rest, passed, mass))
        tight = coder.spent()
        coder.renew(tight)
        read = at.take(tight)
        ahead[tight] = (ahead.take(tight) << _WORD) | words.take(read, mode="clip")
        at[tight] = read + 1
        model.learn(place, entry, rates, hit, now)
        before, last = last, now - base
    out = []
    id_of = np.concatenate([np.append(head[2], 0) for head in heads]).astype(np.int32)
    for head, n, first in zip(heads, of_part, firsts):
        if not n:
            out.append(np.zeros(0, np.int64))
            continue
        ids = id_of.take(grid[: head[1], first : first + n].T, mode="clip").reshape(-1)[: head[0]]
        for lane in range(n):
            if zlib.crc32(ids[lane * head[1] : lane * head[1] + sizes[first + lane]].astype("<u4").tobytes()) != sums[first + lane]:
                raise ValueError(f"block {lane} is damaged")
        out.append(ids)
    return out
