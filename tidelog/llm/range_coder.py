"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks; a block is coded by itself: its models start anew and it carries a checksum, so any block can be read alone. Inside a
block the ids are dealt, in order, to many lanes that take their steps together, as numpy wants it, and share one set of models, so that each
learns from the whole block; a few lanes begin and the others follow, so that little is coded before anything is learnt. Three adaptive
predictions are mixed:

* order 0: counts of all ids of the block so far, as a cumulative table that is renewed every few steps;
* order 1: the two likeliest ids after the last id, with their shares;
* order 2: the two likeliest ids after a hash of the last two ids, with their shares.

The weight of each prediction depends on the age of both contexts, on what their followers leave over and on whether they agree; weights are
learnt, as the mean part that each prediction had in the probability of the ids that came. An id that order 2 or 1 lists is coded by its weighted
share, any other by the mass that is left, divided by the order-0 table. Lanes with the same context in one step overwrite each other's
update, in lane order, for encoder and decoder alike. Sums are of whole numbers and divisions of single pairs, so every machine decodes alike.

The range coder has 56 bits of low and range a lane and moves 16 bits at a time; a carry is added to the word before, and whatever exceeds 16
bits is passed on at the end.

A blob: magic and block count; for each block its id count, alphabet, number of words, and checksum (crc32 of the ids as little-endian 32-bit
integers); then each block's word counts by lane and its words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, BLOCK = b"TLR4", 1 << 22
LANES, SHORT, FIRST, EACH = 8192, 128, 256, 4  # most lanes; least ids a lane; lanes of the first steps, and the steps before each doubling
_LOW, _HALF, _WORD = (1 << 56) - 1, 1 << 40, 0xFFFF
_ROWS1, _ROWS2 = 1 << 16, 1 << 18
_ROOM = 64  # words that 16 steps may need, and some
_SLOT, _ZERO = 16, 22  # bits of the totals of lists and of order 0
_LEFT = 1 << 9  # least weight of order 0, of 2^15
MOST_IDS = (1 << 19) - 1  # ids are below this
_P = (1 << 9) - 1
_MOST_A_WORD = 1 << 10  # ids that a word can hold, as order 0 keeps its least weight
_CELLS = 1 << 11


class _Range:
    """Low and range of all lanes; when decoding, low holds the code's distance from low."""

    def __init__(self, lanes: int, words: np.ndarray | None = None) -> None:
        self.decoding = words is not None
        self.words = words if words is not None else np.zeros((lanes, 4 * _ROOM + 1), np.int32)
        self.flat, self.at = self.words.reshape(-1), np.arange(lanes) * self.words.shape[1]
        self.range, self.low = np.full(lanes, (1 << 56) - 1), np.zeros(lanes, np.int64)
        if self.decoding:  # 56 bits: three words and the upper half of a fourth; every shift brings 16 more
            w = [self.flat[self.at + k].astype(np.int64) for k in range(4)]
            self.low = w[0] << 40 | w[1] << 24 | w[2] << 8 | w[3] >> 8
            self.at += 3

    def settle(self, m: int) -> None:
        """Moves 16 bits wherever the range of the first m lanes has become small."""
        low, rng, at = self.low[:m], self.range[:m], self.at[:m]
        if not self.decoding:
            over = np.flatnonzero(low > _LOW)
            if len(over):
                self.flat[at[over] - 1] += 1
                low &= _LOW
        small = np.flatnonzero(rng < _HALF)
        while len(small):
            who, part = at.take(small), low.take(small)
            if self.decoding:
                new = (self.flat.take(who) << 8) | (self.flat.take(who + 1) >> 8)
                low[small] = (part << 16) | (new & _WORD)
            else:
                self.flat[who] = part >> 40
                low[small] = (part << 16) & _LOW
            at[small] = who + 1
            wide = rng.take(small) << 16
            rng[small] = wide
            small = small[wide < _HALF]

    def room(self) -> None:
        """Makes sure that every lane can take ``_ROOM`` more words."""
        lanes, cap = self.words.shape
        used = self.at - np.arange(lanes) * cap
        if used.max() + _ROOM >= cap:
            wide = np.zeros((lanes, 2 * cap + 1), np.int32)
            wide[:, :cap] = self.words
            self.words, self.flat = wide, wide.reshape(-1)
            self.at = used + np.arange(lanes) * wide.shape[1]

    def finish(self) -> np.ndarray:
        """Writes one more word, enough to tell the last interval, and returns the number of words of each lane."""
        last = (self.low + _HALF - 1) >> 40
        self.flat[self.at] = last
        self.at += 1
        over = np.flatnonzero(self.flat > _WORD)
        while len(over):
            self.flat[over] &= _WORD
            over -= 1
            self.flat[over] += 1
            over = over[self.flat[over] > _WORD]
        return self.at - np.arange(len(self.at)) * self.words.shape[1]


class _Followers:
    """The two likeliest followers a and b of each context, with their shares p and q (of 511) and the context's age (its uses, up to 7)."""

    def __init__(self, rows: int) -> None:
        self.first, self.second = np.full(rows, MOST_IDS << 12, np.int32), np.full(rows, MOST_IDS << 12, np.int32)

    def look(self, row: np.ndarray) -> None:
        self.row = row
        one, two = self.first.take(row), self.second.take(row)
        self.age, self.a, self.b = one & 7, one >> 12, two >> 12
        one >>= 3
        one &= _P
        two >>= 3
        two &= _P
        self.p, self.q = one, two

    def state(self) -> np.ndarray:
        """Age in four steps, and the share that the followers leave in eight."""
        left = _P - self.p
        left -= self.q
        left >>= 6
        left += self.age >> 1 << 3
        return left

    def learn(self, x: np.ndarray, hit: np.ndarray, is_a: np.ndarray) -> None:
        """x followed; ``hit`` are the lanes whose lists hold it, ``is_a`` whether it is their first. Shares move by less as a context gets older."""
        rate = self.age + 1 >> 1
        p = self.p - (self.p >> rate)
        q = self.q - (self.q >> rate)
        np.maximum(q, _P - p >> 2, out=q)
        age = np.minimum(self.age + 1, 7)
        one = self.a << 9
        one |= p
        one <<= 3
        one |= age
        two = x << 9
        two |= q
        two <<= 3
        if len(hit):
            up, rate = is_a.take(hit), rate.take(hit)
            p, q, a, y = self.p.take(hit), self.q.take(hit), self.a.take(hit), x.take(hit)
            won = np.where(up, p, q)
            lost = p + q - won
            won += _P - won >> rate
            lost -= lost >> rate
            old = a + self.b.take(hit) - y  # the one of the two that did not come
            up |= won > lost  # a second that overtakes becomes the first
            high, low = y << 9 | won, old << 9 | lost
            one[hit] = np.where(up, high, low) << 3 | age.take(hit)
            two[hit] = np.where(up, low, high) << 3
        self.first[self.row] = one
        self.second[self.row] = two


def _order0(counts: np.ndarray, total: int) -> np.ndarray:
    """Cumulative order-0 table of 2^_ZERO; ids not seen yet share as much as those seen once hold (Good and Turing), each at least one."""
    free, unseen = (1 << _ZERO) - len(counts), counts == 0
    none = int(np.count_nonzero(unseen))
    new = 0 if not none else free if not total else free * (int(np.count_nonzero(counts == 1)) + 1) // (total + 2)
    freq = counts * (free - new)
    freq //= max(total, 1)
    freq[unseen] = new // max(none, 1)
    cum = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(freq + 1, out=cum[1:])
    return cum


def _run(rc: _Range, steps: int, last: int, alphabet: int, ids: np.ndarray | None) -> np.ndarray:
    """Codes all lanes step by step: some of them in the first steps, and the first ``last`` in the last one; ids (steps, lanes) are given to encode and returned when decoding."""
    lanes = len(rc.low)
    out = np.zeros((steps, lanes), np.int32) if ids is None else ids
    one, two = _Followers(_ROWS1), _Followers(_ROWS2)
    counts, total, due, seen = np.zeros(alphabet, np.int64), 0, 0, []
    cum = _order0(counts, total)
    narrow = cum.astype(np.int32)
    score = _first_scores()
    w0, w1, w2 = _weights(score)
    last1, mixed, edge = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((5, lanes), np.int32)
    for t in range(steps):
        m = last if t == steps - 1 else min(lanes, FIRST << t // EACH)
        if m != len(last1):  # lanes begin without a past
            last1, mixed = (np.concatenate([x[:m], np.zeros(max(0, m - len(x)), np.int64)]) for x in (last1, mixed))
        if t & 15 == 0 and ids is not None:
            rc.room()
        if t == due:
            fresh = np.concatenate(seen) if seen else np.zeros(0, np.int64)
            counts += np.bincount(fresh, minlength=alphabet)
            total += len(fresh)
            cum = _order0(counts, total)
            narrow = cum.astype(np.int32)
            seen, due = [], t + max(1, min(16, t // 4))
        h = last1 * 0x9E3779B1
        one.look(last1 if alphabet <= _ROWS1 else (h >> 9 ^ last1) & (_ROWS1 - 1))
        two.look((h + mixed >> 7) & (_ROWS2 - 1))
        mixed = h * 0x2545F491
        a2, b2, a1, b1 = two.a, two.b, one.a, one.b
        aa = a1 == a2
        cell = two.state() << 5
        cell += one.state()
        cell += aa.view(np.int8) * np.int32(1 << 10)
        cell = cell.astype(np.int64)
        v2, v1 = w2.take(cell), w1.take(cell)
        # masses of the listed ids; one in both lists has that of order 2, whose weight is learnt for contexts that agree
        c1, c2, c3, c4 = (edge[k, :m] for k in range(1, 5))
        for order, weight, up, top in ((two, v2, c1, c2), (one, v1, c3, c4)):
            np.multiply(weight, order.p, out=up)
            np.multiply(weight, order.q, out=top)
        masses = edge[1:, :m]
        masses >>= 8
        masses += 1
        aa |= a1 == b2
        c3 *= ~aa
        ba = b1 == a2
        ba |= b1 == b2
        c4 *= ~ba
        c2 += c1
        c3 += c2
        c4 += c3
        rng, low = rc.range[:m], rc.low[:m]
        r = rng >> _SLOT
        base = r * c4
        part = rng - base >> _ZERO
        if ids is None:
            v = (low.view(np.uint64) // r.view(np.uint64)).view(np.int64)
            rest = np.flatnonzero(v >= c4)
            listed = np.flatnonzero(v < c4)
            v = v.take(listed)
            slot = (v >= c1.take(listed)).view(np.int8) + (v >= c2.take(listed)).view(np.int8) + (v >= c3.take(listed)).view(np.int8)
            x = np.empty(m, np.int64)
            x[listed] = np.concatenate([a2, b2, a1, b1]).take(slot * np.int64(m) + listed)
            v = (low - base).take(rest).view(np.uint64) // part.take(rest).view(np.uint64)
            x[rest] = np.searchsorted(narrow, np.minimum(v, np.uint64(cum[-1] - 1)).astype(np.int32), "right") - 1
            out[t, :m] = x
        else:
            x = ids[t, :m].astype(np.int64)
        whole_x, x = x, out[t, :m]
        is_a2, is_a1 = x == a2, x == a1
        in2, in1 = is_a2 | (x == b2), is_a1 | (x == b1)
        hit2, hit1 = np.flatnonzero(in2), np.flatnonzero(in1)
        if ids is not None:
            listed = np.flatnonzero(in2 | in1)
            low2 = in2.take(listed)
            slot = np.where(low2, 1 - is_a2.take(listed).view(np.int8), 3 - is_a1.take(listed).view(np.int8))
        c = cum.take(whole_x)
        whole_x += 1
        f = cum.take(whole_x)
        whole_x -= 1
        f -= c
        c *= part
        base += c
        part *= f
        if len(listed):
            at = slot * np.int64(lanes) + listed
            start, r = edge.reshape(-1).take(at), r.take(listed)
            base[listed] = r * start
            part[listed] = r * (edge.reshape(-1).take(at + lanes) - start)
        rng[:] = part
        if ids is None:
            low -= base
        else:
            low += base
        rc.settle(m)
        if t & 3 == 3 or t < 16:
            p2, p1 = np.zeros(m, np.int64), np.zeros(m, np.int64)
            p2[hit2] = (v2.take(hit2) * np.where(is_a2.take(hit2), two.p.take(hit2), two.q.take(hit2)) >> 8) + 1 << 4
            only = hit1[~in2.take(hit1)]
            p1[only] = (v1.take(only) * np.where(is_a1.take(only), one.p.take(only), one.q.take(only)) >> 8) + 1 << 4
            p0 = (f * w0.take(cell) >> (_ZERO + 15 - _SLOT - 4)) + 1
            whole = (p2 + p1 + p0).astype(np.float64)
            for k, p in ((0, p0), (1, p1), (2, p2)):
                score[k] += np.bincount(cell, weights=np.floor(p * 256 / whole), minlength=_CELLS)
            if t & 15 == 15 or t < 16:
                w0, w1, w2 = _weights(score)
        two.learn(x, hit2, is_a2)
        one.learn(x, hit1, is_a1)
        last1 = whole_x
        seen.append(whole_x)
    return out


def _first_scores() -> np.ndarray:
    """(3, cells): before anything is learnt, a context is trusted as far as its followers' shares leave little."""
    state = np.arange(32)
    sure = 8 - (state & 7)
    two, one = np.tile(np.repeat(sure, 32), 2), np.tile(sure, 64)
    return np.stack([(8 - two) * (8 - one) * 2 + 8, one * (16 - two), two * 16]) * 16.0


def _weights(score: np.ndarray) -> np.ndarray:
    """(3, cells): weights of orders 0, 1 and 2 of 2^15; order 0 keeps enough to reach every id."""
    w = np.floor(score * ((1 << 15) - _LEFT) / (score[0] + score[1] + score[2])).astype(np.int32)
    w[0] += _LEFT
    return w


def _shape(n: int) -> tuple[int, int, int, np.ndarray]:
    """Lanes, steps, lanes of the last step, and first step of each lane, of a block of n ids."""
    lanes = max(1, min(LANES, n // SHORT))
    begin = np.zeros(lanes, np.int64)
    for k in range(1, lanes.bit_length()):
        begin[FIRST << k - 1 : FIRST << k] = k * EACH
    whole = n + int(begin.sum())
    steps = max(-(-whole // lanes), 1)
    return lanes, steps, whole - lanes * (steps - 1), begin


def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First id and end of the ids of each lane."""
    lanes, steps, last, begin = _shape(n)
    size = steps - begin
    size[last:] -= 1
    end = np.cumsum(size)
    return end - size, end


def _grid(ids: np.ndarray) -> np.ndarray:
    lanes, steps, _, begin = _shape(len(ids))
    grid = np.zeros((lanes, steps + 16 | 1), np.int32)  # an odd width, so that columns do not share cache lines' places
    for row, lo, hi, at in zip(grid, *(x.tolist() for x in _places(len(ids))), begin.tolist(), strict=True):
        row[at : at + hi - lo] = ids[lo:hi]
    return np.ascontiguousarray(grid.T)


def _flat(grid: np.ndarray, n: int) -> np.ndarray:
    lanes, steps, _, begin = _shape(n)
    rows = np.zeros((lanes, steps + 16 | 1), np.int32)
    rows[:, :steps] = grid.T
    return np.concatenate([row[at : at + hi - lo] for row, lo, hi, at in zip(rows, *(x.tolist() for x in _places(n)), begin.tolist(), strict=True)])


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Codes ids in equal blocks of ``block`` to twice as many; fewer are one block, none give a blob without blocks."""
    ids = np.asarray(ids, np.int64)
    n = max(1, len(ids) // block) if len(ids) else 0
    if n and (ids.min() < 0 or ids.max() >= MOST_IDS):
        raise ValueError(f"ids must be between 0 and {MOST_IDS - 1:,}")
    index, body = [], []
    for part in np.array_split(ids.astype("<i4"), n) if n else []:
        lanes, steps, last, _ = _shape(len(part))
        rc = _Range(lanes)
        alphabet = int(part.max()) + 1
        _run(rc, steps, last, alphabet, _grid(part))
        used = rc.finish()
        index.append((len(part), alphabet, int(used.sum()), zlib.crc32(part.tobytes())))
        body.append(used.astype("<u4").tobytes() + rc.words[np.arange(rc.words.shape[1]) < used[:, None]].astype("<u2").tobytes())
    return struct.pack("<4sI", MAGIC, n) + np.array(index, "<u4").tobytes() + b"".join(body)


def decode(blob: bytes) -> np.ndarray:
    """The ids of a blob; raises ValueError where magic, length or a block's checksum is wrong."""
    if len(blob) < 8 or blob[:4] != MAGIC:
        raise ValueError("not a token blob")
    _, n = struct.unpack_from("<4sI", blob)
    if len(blob) < 8 + 16 * n:
        raise ValueError("the block index is cut")
    index = np.frombuffer(blob, "<u4", 4 * n, 8).reshape(n, 4).astype(np.int64)
    shapes = [_shape(int(k)) for k in index[:, 0]]
    if len(blob) != 8 + 16 * n + sum(4 * s[0] for s in shapes) + 2 * int(index[:, 2].sum()) or (index[:, :2] < 1).any() or (index[:, 1] > MOST_IDS).any() or (index[:, 0] > _MOST_A_WORD * index[:, 2]).any():
        raise ValueError("the words do not fit the block index")
    at, out = 8 + 16 * n, [np.zeros(0, np.int64)]
    for i, ((lanes, steps, last, _), (size, alphabet, total, crc)) in enumerate(zip(shapes, index.tolist(), strict=True)):
        used = np.frombuffer(blob, "<u4", lanes, at).astype(np.int64)
        at += 4 * lanes
        if used.sum() != total or (used > 4 * steps + 8).any():
            raise ValueError("the words do not fit the block index")
        words = np.zeros((lanes, int(used.max()) + 8), np.int32)
        words[np.arange(words.shape[1]) < used[:, None]] = np.frombuffer(blob, "<u2", total, at)
        at += 2 * total
        try:
            ids = _flat(_run(_Range(lanes, words), steps, last, alphabet, None), size)
        except IndexError:
            raise ValueError("a block's words end too early") from None
        if zlib.crc32(ids.astype("<i4").tobytes()) != crc:
            raise ValueError(f"block {i} has a wrong checksum")
        out.append(ids.astype(np.int64))
    return np.concatenate(out)
