"""Adaptive context-mixing range coder for token ids.

A block is coded by itself: it begins with an empty model and ends with its
own checksum. Within a block the ids lie in lanes, contiguous strips that are
coded side by side, so numpy advances thousands of range coders with one call;
all lanes share one model, which learns after each step from all lanes' ids.

Three orders predict the next id: order 2 by the last id seen after this pair,
order 1 by the last id seen after this id, order 0 by counts of all ids. The
mix gives each its share of the range: an event - order 2 is right, order 1
is right, neither is - is coded with counts kept by context, where the context
is how often either order's slot was right before and whether they agree;
the share of "neither" is divided among all ids by the order-0 counts, so that
an id is one interval and one step of the coder.

A block, little-endian: lanes u32, ids u32, payload bytes u32, crc32 of the
ids as u32 u32; then the payload: how many 16-bit words each lane has (u32
each), and the words, one lane after another. A reader needs only the block.
A block with an id of 2^16 or more has 0 lanes, and as its payload two blocks,
of the ids' low and of their high 16 bits.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: ids of a block, at most; a block of fewer than 64 ids a lane has fewer lanes
BLOCK = 1 << 21
LANES = 16384
ALPHABET = 1 << 16
_U64 = np.uint64
_TOP = _U64(1 << 48)
_BOTTOM = _U64(1 << 44)
#: an id's interval has 2^30 units: 2^10 for the event, 2^20 for order 0
_EVENT, _ORDER0 = 10, 20
_TABLE2 = 1 << 18
_REBUILD = 16
HEAD = "<IIII"
HEAD_SIZE = 16


class _Model:
    """What encoder and decoder both know; every method depends on coded ids only."""

    def __init__(self, decodes: bool = False):
        self.decodes, self.recent = decodes, []
        self.after1 = np.zeros(ALPHABET, dtype=np.uint16)
        self.trust1 = np.zeros(ALPHABET, dtype=np.int8)
        self.after2 = np.zeros(_TABLE2, dtype=np.uint16)
        self.trust2 = np.zeros(_TABLE2, dtype=np.int8)
        #: events by context: order 2 is right, order 1 is right, neither
        self.events = np.ones((2 * 4 * 4, 3), dtype=np.int64)
        self.seen = np.ones(ALPHABET, dtype=np.int64)
        self.steps = 0
        self._rebuild()

    def _rebuild(self) -> None:
        """Order-0 frequencies that sum to 2^20 at most, at least 1 each."""
        if self.recent:
            self.seen += np.bincount(np.concatenate(self.recent), minlength=ALPHABET) * 32
            self.recent = []
        total = int(self.seen.sum())
        self.freq = 1 + self.seen * ((1 << 20) - ALPHABET) // total
        self.cum = np.concatenate(([0], np.cumsum(self.freq)))
        if self.decodes:  # the id at each value
            self.at = np.repeat(np.arange(ALPHABET, dtype=np.uint16), self.freq)

    def look(self, one: np.ndarray, two: np.ndarray) -> tuple:
        """Slots, predictions and event frequencies (cumulative) for each lane."""
        slot = ((one * 0x9E3779B1 + two * 0x85EBCA6B) >> 7) & (_TABLE2 - 1)
        p2, p1 = self.after2[slot], self.after1[one]
        context = ((p2 == p1) * 4 + self.trust2[slot]) * 4 + self.trust1[one]
        total = self.events.sum(axis=1)
        # at least 1 each
        freq = 1 + self.events * ((1 << _EVENT) - 3) // total[:, None]
        ends = np.cumsum(freq, axis=1)
        ends[:, 2] = 1 << _EVENT
        return slot, p2, p1, context, np.concatenate([np.zeros((len(ends), 1), dtype=np.int64), ends], axis=1)

    def learn(self, one: np.ndarray, look: tuple, ids: np.ndarray, event: np.ndarray) -> None:
        slot, p2, p1, context, _ = look
        for table, trust, at, right in ((self.after2, self.trust2, slot, p2 == ids), (self.after1, self.trust1, one, p1 == ids)):
            # of lanes that share a slot the last counts, as numpy assigns
            trust[at] = np.where(right, np.minimum(trust[at] + 1, 3), 0)
            table[at] = ids
        self.events += np.bincount(context * 3 + event, minlength=self.events.size).reshape(self.events.shape)
        if self.events.max() > 1 << 24:
            self.events = (self.events >> 1) + 1
        self.recent.append(ids)
        self.steps += 1
        if self.steps % _REBUILD == 0 or self.steps < _REBUILD:
            self._rebuild()


def _moves(low: np.ndarray, span: np.ndarray):
    """Lanes that give or take a word, with their low and range after it, until no lane has to."""
    who = None
    while True:
        same = (low ^ (low + span)) < _TOP
        move = np.flatnonzero(same | (span < _BOTTOM))
        if not move.size:
            return
        same, low, span = same[move], low[move], span[move]
        who = move if who is None else who[move]
        # no carry may follow: a short range that isn't settled is cut at the next multiple of 2^44
        span = np.where(same, span, (~low + _U64(1)) & (_BOTTOM - _U64(1))) << _U64(16)
        low = low << _U64(16)
        yield who, low, span


class _Encoder:
    def __init__(self, lanes: int, room: int):
        self.low = np.zeros(lanes, dtype=_U64)
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=_U64)
        self.out = np.zeros((lanes, room), dtype=np.uint16)
        self.at = np.zeros(lanes, dtype=np.int64)

    def _put(self, who: np.ndarray) -> None:
        if who.size and int(self.at[who].max()) >= self.out.shape[1]:
            self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)
        self.out[who, self.at[who]] = self.low[who] >> _U64(48)
        self.at[who] += 1

    def code(self, begin: np.ndarray, size: np.ndarray) -> None:
        """The interval [begin, begin + size) of 2^30, in every lane."""
        part = self.range >> _U64(_EVENT + _ORDER0)
        self.low += part * begin.view(_U64)
        self.range = part * size.view(_U64)
        for who, low, span in _moves(self.low, self.range):
            self._put(who)
            self.low[who], self.range[who] = low, span

    def close(self) -> None:
        for _ in range(4):
            self._put(np.arange(len(self.low)))
            self.low <<= _U64(16)


class _Decoder:
    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.words = np.concatenate([words, np.zeros(1, dtype=np.uint16)])
        self.next = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64)
        self.end = self.next + sizes
        self.low = np.zeros(len(sizes), dtype=_U64)
        self.range = np.full(len(sizes), 0xFFFFFFFFFFFFFFFF, dtype=_U64)
        self.code = np.zeros(len(sizes), dtype=_U64)
        for _ in range(4):
            self._pull(np.arange(len(sizes)))

    def _pull(self, who: np.ndarray) -> None:
        at = np.minimum(self.next[who], len(self.words) - 1)
        self.code[who] = (self.code[who] << _U64(16)) | self.words[at].astype(_U64)
        self.next[who] += 1

    def value(self) -> np.ndarray:
        """Where in 2^30 each lane's code lies."""
        part = self.range >> _U64(_EVENT + _ORDER0)
        return np.minimum((self.code - self.low) // part, _U64((1 << _EVENT + _ORDER0) - 1)).view(np.int64)

    def take(self, begin: np.ndarray, size: np.ndarray) -> None:
        part = self.range >> _U64(_EVENT + _ORDER0)
        self.low += part * begin.view(_U64)
        self.range = part * size.view(_U64)
        for who, low, span in _moves(self.low, self.range):
            self._pull(who)
            self.low[who], self.range[who] = low, span


def _lanes(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // 64))
    return lanes, -(-n // lanes)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def encode_block(ids: np.ndarray) -> bytes:
    """One block; ids below 2^32."""
    n = len(ids)
    if n and int(ids.max()) >= ALPHABET:
        payload = encode_block(ids & np.uint32(ALPHABET - 1)) + encode_block(ids >> np.uint32(16))
        return struct.pack(HEAD, 0, n, len(payload), _crc(ids)) + payload
    lanes, depth = _lanes(n)
    strips = np.zeros(lanes * depth, dtype=np.uint16)
    strips[:n] = ids
    strips = strips.reshape(lanes, depth)
    model, coder = _Model(), _Encoder(lanes, depth + 16)
    one, two = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
    for step in range(depth):
        now = strips[:, step].astype(np.int64)
        look = model.look(one, two)
        _, p2, p1, context, ends = look
        event = np.where(p2 == now, 0, np.where(p1 == now, 1, 2))
        begin = ends[context, event]
        share = ends[context, event + 1] - begin
        begin, size = begin << _ORDER0, share << _ORDER0
        missed = np.flatnonzero(event == 2)
        x, share = now[missed], share[missed]
        begin[missed] += share * model.cum[x]
        size[missed] = share * model.freq[x]
        coder.code(begin, size)
        model.learn(one, look, now, event)
        one, two = now, one
    coder.close()
    words = coder.out[np.arange(coder.out.shape[1])[None, :] < coder.at[:, None]]
    payload = coder.at.astype("<u4").tobytes() + words.astype("<u2").tobytes()
    return struct.pack(HEAD, lanes, n, len(payload), _crc(ids)) + payload


def decode_block(raw: bytes) -> np.ndarray:
    """The ids of one block, checked."""
    lanes, n, size, crc = struct.unpack_from(HEAD, raw)
    if n and not lanes:
        cut = HEAD_SIZE + HEAD_SIZE + struct.unpack_from(HEAD, raw, HEAD_SIZE)[2]
        return _checked(decode_block(raw[HEAD_SIZE:cut]) | decode_block(raw[cut:]) << np.uint32(16), crc)
    depth = _lanes(n)[1]
    counts = np.frombuffer(raw, dtype="<u4", count=lanes, offset=HEAD_SIZE).astype(np.int64)
    words = np.frombuffer(raw, dtype="<u2", offset=HEAD_SIZE + 4 * lanes, count=(size - 4 * lanes) // 2)
    model, coder = _Model(decodes=True), _Decoder(words, counts)
    one, two = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
    strips = np.zeros((lanes, depth), dtype=np.uint16)
    for step in range(depth):
        look = model.look(one, two)
        _, p2, p1, context, ends = look
        value = coder.value()
        top = value >> _ORDER0
        event = (top >= ends[context, 1]).astype(np.int64) + (top >= ends[context, 2])
        begin = ends[context, event]
        share = ends[context, event + 1] - begin
        begin, size = begin << _ORDER0, share << _ORDER0
        now = np.where(event == 0, p2, p1).astype(np.int64)
        missed = np.flatnonzero(event == 2)
        share = share[missed]
        x = model.at[np.minimum((value[missed] - begin[missed]) // share, len(model.at) - 1)].astype(np.int64)
        now[missed] = x
        begin[missed] += share * model.cum[x]
        size[missed] = share * model.freq[x]
        coder.take(begin, size)
        strips[:, step] = now
        model.learn(one, look, now, event)
        one, two = now, one
    return _checked(strips.ravel()[:n].astype(np.uint32), crc)


def _checked(ids: np.ndarray, crc: int) -> np.ndarray:
    if _crc(ids) != crc:
        raise ValueError("a block's checksum is wrong")
    return ids
