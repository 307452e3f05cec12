"""Context-mixing range coder for token ids, over many blocks at once.

A block of up to BLOCK ids is coded with a model that starts anew, so any block can be read alone. For each id an
order-2 and an order-1 table (by hash of the last ids) each predict one id with a confidence; the pair of confidences
selects adaptive odds for "as order 2 says", "as order 1 says" and "neither", which mixes the two; the rest is coded
by order-0 shares of whole ids. These are counted over many blocks and kept beside them (`Order0`), as a block alone is
too short to learn them; without a count every id has the same share. All three are one interval of a 30-bit
distribution and one step of a 64-bit range coder that puts out 32-bit words.

Blocks know nothing of each other, so their steps are done side by side, as columns of numpy arrays.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Most and fewest ids of a block; blocks coded side by side, and how many of them short input is cut into.
BLOCK, SHORT_BLOCK, SIDE_BY_SIDE, FEW = 1024, 512, 6144, 384
#: A block: mark, number of ids, number of words, checksum of the ids; then the words.
HEAD = struct.Struct("<4sIII")
MARK = b"CMR2"
_ORDER2, _ORDER1 = 512, 256
_SYMBOL_BITS, _ORDER0_BITS = 12, 18
_BITS = _SYMBOL_BITS + _ORDER0_BITS
#: Odds are shares of 2 ** _SYMBOL_BITS that move by 2 ** -_RATE of the way to what was seen.
_RATE, _FIRST_ODDS = 5, (1300, 900)
_CONTEXTS = 32
#: Steps whose places in the tables the encoder finds at once.
_STEPS = 32
_U = np.uint64


class Order0:
    """Shares of 2 ** 18 that ids have; each id that occurs has at least one part."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, self.counts = ids.astype(np.int64), counts.astype(np.int64)
        room = (1 << _ORDER0_BITS) - len(self.ids)
        share = 1 + self.counts * room // max(1, int(self.counts.sum()))
        if len(share):
            share[np.argmax(share)] += (1 << _ORDER0_BITS) - share.sum()
        self.size, self.start = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.size[self.ids], self.start[self.ids] = share, np.cumsum(share) - share
        self.owner = np.repeat(self.ids.astype(np.int32), share)

    @classmethod
    def of(cls, ids: np.ndarray) -> Order0:
        counts = np.bincount(ids, minlength=1)
        seen = np.flatnonzero(counts)
        return cls(seen, counts[seen])

    @classmethod
    def flat(cls) -> Order0:
        return cls(np.arange(1 << 16), np.ones(1 << 16))

    def pack(self) -> bytes:
        return zlib.compress(np.stack([np.diff(self.ids, prepend=0), self.counts]).astype("<u4").tobytes())

    @classmethod
    def unpack(cls, data: bytes) -> Order0:
        steps, counts = np.frombuffer(zlib.decompress(data), "<u4").reshape(2, -1)
        return cls(np.cumsum(steps, dtype=np.int64), counts)


class _Model:
    """State of all blocks; what belongs to order 2 and to order 1 are the two rows of its arrays. Shares fit 32 bits.

    An entry of a table is an id, shifted by two bits, and how sure it is: 0 to 3. Entries of all blocks for one hash stand
    together, as do their odds of one context: blocks meet the same frequent ids, so what a step reads is mostly in the cache.
    """

    def __init__(self, blocks: int):
        each = np.arange(blocks, dtype=np.int64)
        self.blocks, self.base = blocks, np.stack([each, blocks * _ORDER2 + each])
        self.table = np.zeros(blocks * (_ORDER2 + _ORDER1), np.int32)
        self.base_odds = np.stack([each, blocks * _CONTEXTS + each])
        self.odds = np.repeat(np.array(_FIRST_ODDS, np.int32), blocks * _CONTEXTS)
        self.mask = np.array([[_ORDER2 - 1], [_ORDER1 - 1]], np.int32)

    def places(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where both tables say what comes after these two ids, of one step or of several; 32 bits hold all that counts."""
        mixed = np.empty((*last.shape[:-1], 2, last.shape[-1]), np.int32)
        np.multiply(last, 0x1E35A7BD, out=mixed[..., 1, :])
        np.multiply(before, 0x2F0B4C47, out=mixed[..., 0, :])
        mixed[..., 0, :] += mixed[..., 1, :]
        mixed >>= 15
        mixed &= self.mask
        mixed *= self.blocks
        at = mixed.astype(np.int64)
        at += self.base
        return at

    def predict(self, at: np.ndarray) -> None:
        """What both tables say there, and the sizes of its intervals."""
        self.at = at
        self.entry = entry = self.table.take(at)
        self.sure = entry & 3
        # entries with one id differ in the two lowest bits alone
        one = (entry[0] ^ entry[1]).view(np.uint32) < 4
        context = (self.sure[0] * 8 + self.sure[1] * 2).astype(np.int64)
        context += one.view(np.int8).astype(np.int64)
        context *= self.blocks
        self.at_odds = self.base_odds + context
        self.p = self.odds.take(self.at_odds)
        self.size = ((self.p * ((1 << _SYMBOL_BITS) - 8)) >> _SYMBOL_BITS) + 1
        self.rest = self.size[0] + self.size[1]
        self.shares = self.size << _ORDER0_BITS

    def update(self, marked: np.ndarray, said: np.ndarray, hit: np.ndarray) -> None:
        """marked: entries that what came begins with; said: who had said so; hit: if it came as order 2 said, and as only order 1 said."""
        entry = self.entry
        new = entry - 1
        np.copyto(new, marked, where=self.sure == 0)
        np.copyto(new, np.minimum(entry + 1, entry | 3), where=said)
        self.table[self.at] = new
        moved = hit.view(np.int8).astype(np.int32)
        moved <<= _SYMBOL_BITS
        moved -= self.p
        moved >>= _RATE
        moved += self.p
        self.odds[self.at_odds] = moved


def _encode_side_by_side(ids: np.ndarray, order0: Order0) -> tuple[np.ndarray, np.ndarray]:
    """ids: (blocks, length). Words of each block, and how many."""
    blocks, length = ids.shape
    model = _Model(blocks)
    low, width = np.zeros(blocks, np.uint64), np.full(blocks, ~_U(0))
    words = np.zeros((length + 2, blocks), np.uint32)
    flat, used = words.reshape(-1), np.arange(blocks)  # where the next word of each block goes
    turned = np.zeros((length + 2, blocks), np.int32)  # two zeros stand before the first id
    turned[2:] = ids.T
    for begin in range(0, length, _STEPS):
        came = turned[begin + 2 : begin + 2 + _STEPS]
        places = model.places(turned[begin : begin + len(came)], turned[begin + 1 : begin + 1 + len(came)])
        for at, marked, own_start, own_size in zip(places, came << 2, order0.start.take(came), order0.size.take(came)):
            model.predict(at)
            said = (model.entry ^ marked).view(np.uint32) < 4
            hit = said.copy()
            hit[1] &= ~said[0]
            f0 = (1 << _SYMBOL_BITS) - model.rest
            start, size = f0 * own_start, f0 * own_size
            start += model.rest << _ORDER0_BITS
            np.copyto(start, model.shares[0], where=hit[1])
            np.copyto(size, model.shares[1], where=hit[1])
            np.copyto(start, 0, where=hit[0])
            np.copyto(size, model.shares[0], where=hit[0])
            width >>= _U(_BITS)
            moved = start.astype(np.uint64)
            moved *= width
            moved += low
            carry = np.flatnonzero(moved < low)
            at = used.take(carry) - blocks
            while len(carry):  # add one to the words already put out
                flat[at] += np.uint32(1)
                full = flat[at] == 0
                carry, at = carry[full], at[full] - blocks
            low = moved
            width *= size.astype(np.uint64)
            rows = np.flatnonzero(width < _U(1 << 32))
            if len(rows):
                out, at = low.take(rows), used.take(rows)
                flat[at] = out >> _U(32)
                used[rows] = at + blocks
                low[rows] = out << _U(32)
                width[rows] = width.take(rows) << _U(32)
            model.update(marked, said, hit)
    flat[used], flat[used + blocks] = low >> _U(32), low & _U(0xFFFFFFFF)
    used = used // blocks + 2
    return np.ascontiguousarray(words[: used.max()].T), used


def _decode_side_by_side(words: np.ndarray, length: int, order0: Order0) -> np.ndarray:
    """words: (blocks, longest), filled up behind their ends."""
    blocks = len(words)
    model = _Model(blocks)
    flat, used = words.T.reshape(-1), np.arange(blocks) + 2 * blocks  # a copy in which the blocks' next words stand together
    width = np.full(blocks, ~_U(0))
    code = (words[:, 0].astype(np.uint64) << _U(32)) | words[:, 1]  # counted from the interval's start
    out = np.empty((length, blocks), np.int32)
    most = _U((1 << _BITS) - 1)
    before = last = np.zeros(blocks, np.int32)
    said, hit = np.empty((2, 2, blocks), bool)
    for step in range(length):
        model.predict(model.places(before, last))
        width >>= _U(_BITS)
        spot = np.minimum(code // width, most).astype(np.int32)
        symbol = spot >> _ORDER0_BITS
        rest = model.rest
        np.less(symbol, model.size[0], out=hit[0])
        np.less(symbol, rest, out=hit[1])
        hit[1] ^= hit[0]
        f0 = (1 << _SYMBOL_BITS) - rest
        start = rest << _ORDER0_BITS
        spot -= start  # below zero, and so far too large without a sign, where order 2 or 1 was right
        now = order0.owner.take(spot.view(np.uint32) // f0.view(np.uint32), mode="clip")
        start += f0 * order0.start.take(now)
        size = f0 * order0.size.take(now)
        for array, first, second in ((start, 0, model.shares[0]), (size, *model.shares), (now, *(model.entry >> 2))):
            np.copyto(array, first, where=hit[0])
            np.copyto(array, second, where=hit[1])
        code -= start.astype(np.uint64) * width
        width *= size.astype(np.uint64)
        rows = np.flatnonzero(width < _U(1 << 32))
        if len(rows):
            at = used.take(rows)
            code[rows] = (code.take(rows) << _U(32)) | flat.take(at)
            width[rows] = width.take(rows) << _U(32)
            used[rows] = at + blocks
        marked = now << 2
        np.less((model.entry ^ marked).view(np.uint32), 4, out=said)
        model.update(marked, said, hit)
        before, last = last, now
        out[step] = now
    return np.ascontiguousarray(out.T).astype(np.uint32)


def encode(ids: np.ndarray, order0: Order0 | None = None) -> bytes:
    """Blocks of the ids (16 bits each), one behind the other; few ids make shorter blocks, so that some run together.

    order0 must have each of the ids; the reader needs the same.
    """
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) >= 1 << 16:
        raise ValueError("the coder takes ids below 65,536")
    order0 = order0 or Order0.flat()
    if not order0.size[ids].all():
        raise ValueError("order 0 lacks one of the ids")
    out = []
    size = min(BLOCK, max(SHORT_BLOCK, len(ids) // FEW))
    for first in range(0, len(ids), size * SIDE_BY_SIDE):
        part = ids[first : first + size * SIDE_BY_SIDE]
        blocks = -(-len(part) // size)
        length = min(size, len(part))
        filled = np.full(blocks * length, part[0])  # any id that order 0 has
        filled[: len(part)] = part
        words, used = _encode_side_by_side(filled.reshape(blocks, length), order0)
        for b in range(blocks):
            own = part[b * size : (b + 1) * size]
            out += [HEAD.pack(MARK, len(own), int(used[b]), zlib.crc32(own.tobytes())), words[b, : used[b]].astype("<u4").tobytes()]
    return b"".join(out)


def decode(data: bytes, order0: Order0 | None = None) -> np.ndarray:
    """The ids of blocks that stand one behind the other; ValueError if one is not what was written."""
    order0 = order0 or Order0.flat()
    heads, at = [], 0
    while at < len(data):
        mark, n, used, check = HEAD.unpack_from(data, at)
        if mark != MARK or at + HEAD.size + 4 * used > len(data):
            raise ValueError(f"no block at byte {at}")
        heads.append((n, used, check, at + HEAD.size))
        at += HEAD.size + 4 * used
    out = []
    for first in range(0, len(heads), SIDE_BY_SIDE):
        some = heads[first : first + SIDE_BY_SIDE]
        length = max(n for n, *_ in some)
        words = np.zeros((len(some), max(used for _, used, *_ in some) + length), np.uint32)
        for row, (_, used, _, begin) in zip(words, some):
            row[:used] = np.frombuffer(data, "<u4", used, begin)
        ids = _decode_side_by_side(words, length, order0)
        for row, (n, _, check, begin) in zip(ids, some):
            own = row[:n].astype("<u4")
            if zlib.crc32(own.tobytes()) != check:
                raise ValueError(f"the block before byte {begin} fails its checksum")
            out.append(own)
    return np.concatenate(out) if out else np.array([], dtype="<u4")
