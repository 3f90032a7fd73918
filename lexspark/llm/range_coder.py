"""A context-mixing range coder for token ids (operator 2).

A block of at most BLOCK ids is coded on its own: its model starts afresh, and its checksum is that of its ids. Order 2
and order 1 each predict one id, the last that followed their context, with a confidence; order 0 has the frequencies of
the ids that are still to come in the block. Whether the order-2 id is right, else whether the order-1 id is, gets a
probability that mixes, in the logistic domain, the learned weights of what order 2, and order 1, knows of its id: the
confidence, and how often the id stands in the block. Any other id gets its share of order 0's frequencies. All these
shares make one interval, so an id costs one step of the coder.

A block begins with its distinct ids, in order, and how often each stands there: gaps between ids by shares that follow
the mean of the gaps before, numbers by shares that fall with the number. So the decoder knows order 0 from the start; it
is counted down as ids come, at remaining sizes that fall by a quarter, later by half. The model learns from every id.
All arithmetic is on whole numbers (but for quotients that doubles hold exactly), so blocks decode alike on every machine.
Many blocks advance together as numpy vectors: lane i is the ith longest block. They end together, so that all have the
same number of ids to come; the lanes that have begun are the first ones.

The coder keeps 64 bits of low and range, and moves 32 bits out whenever the range is below 2 ** 32. Where the interval
then straddles a multiple of 2 ** 32, it is cut there, so that there is never a carry. A coded block is the number of
distinct ids and of their words, 16 bits each, then the words of 32 bits of distinct ids, and of all, all little-endian.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

BLOCK = 2048
#: Blocks that advance together; about 30 kB of model and work space each.
LANES = 6144
_PLACE_BITS = 11
_PLACES = 1 << _PLACE_BITS  # of an order-1 or order-2 context, in each lane
_CONTEXTS = 128  # of weights, in each lane: 32 of order 2, 64 and 32 of order 1
_ONE = 4096  # probabilities are in 4096ths
_TOTAL = 19  # bits of the interval that is shared out: products with a place in order 0 stay below 2 ** 31
_LOW32, _32, _SHARED = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(_TOTAL)

#: 1 / (1 + exp(-x)) in 4096ths for x in 256ths from -8 on; built by rule. The largest chances leave order 0 a share of
#: at least BLOCK parts of the interval.
_SQUASH = np.array([min(_ONE - 256, max(16, round(_ONE / (1 + math.exp(-x / 256))))) for x in range(-2048, 2048)], np.int32)
_MOST_ORDER_1 = _ONE * 3 // 4
#: Weights at the start, in 4096ths, by what a context's order is asked for and its confidence; those that documents tend to.
_WEIGHTS = np.array([[w] * 4 for w in (
    (-16000, -9000, -700, 0, 400, 300, 300, 5000),  # order 2 by its own context
    (-8000, -6500, -1700, -800, -600, -500, -400, -1000),  # and by order 1's, where that has another id
    (-8000, -3500, 500, 1000, 1000, 700, 600, 8000),  # or the same
    (-14000, -12000, -3500, -200, 400, 400, 300, 5000),  # order 1
)], np.int32).ravel()


def _shares(weights: list[float], least: int = 1) -> np.ndarray:
    """Where the parts of an interval begin that are in proportion to the weights, at least `least` each; their end at last."""
    room = (1 << _TOTAL) // least - len(weights)
    return least * np.r_[0, np.cumsum([1 + int(room * w / sum(weights)) for w in weights])].astype(np.int64)


#: Parts for how often an id stands in a block, from 1 on; built by rule.
_NUMBER = _shares([c**-1.75 for c in range(1, BLOCK + 1)])
#: Least means of gaps, in 16ths, of the contexts of gaps: powers of the root of 2.
_MEANS = np.array([round(16 * 2 ** (q / 2)) for q in range(1, 32)])
_GAP_BITS, _GAP_STEP = 17, 9


def _gap_shares(mean: float) -> np.ndarray:
    """Parts for how many bits a gap of that mean has below its first: mostly as a geometric distribution has them."""
    near = [math.exp((1 - 2**b) / mean) - math.exp((1 - 2 ** (b + 1)) / mean) for b in range(_GAP_BITS)]
    wide = [2 ** -abs(b - math.log2(mean)) / 3 for b in range(_GAP_BITS)]
    return _shares([0.7 * n + 0.3 * w for n, w in zip(near, wide)], 1 << _GAP_STEP)


_GAP = np.stack([_gap_shares(2 ** ((q + 0.5) / 2)) for q in range(len(_MEANS) + 1)])
#: The bits of a gap at each multiple of 2 ** _GAP_STEP.
_GAP_AT = np.stack([np.searchsorted(row[1:_GAP_BITS], np.arange(1 << (_TOTAL - _GAP_STEP)) << _GAP_STEP, "right") for row in _GAP])


class _Model:
    """What the encoder and the decoder both learn. An id is its rank * 32 + its class * 8 (a word); an entry is a word + its confidence."""

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.entries = np.zeros(2 * lanes * _PLACES, np.uint16)  # by order 2 and 1
        self.entry_base = np.stack([lane * _PLACES, (lanes + lane) * _PLACES])
        self.weights = np.tile(_WEIGHTS, lanes)  # in 4096ths
        self.weight_base = np.array([[0], [32], [96]]) + lane * _CONTEXTS

    def predict(self, one: np.ndarray, two: np.ndarray) -> None:
        """one, two: the words before, of the first lanes."""
        n = len(one)
        at = np.empty((2, n), np.int64)
        place = one * np.uint16(40503)
        place += two * np.uint16(34283)
        place >>= np.uint16(16 - _PLACE_BITS)
        at[0] = place
        at[1] = one >> np.uint16(5)
        at += self.entry_base[:, :n]
        self.at = at
        self.entry = entry = self.entries.take(at)
        self.ids = entry & np.uint16(0xFFF8)
        self.agree = agree = (entry[0] ^ entry[1]) < 32
        context = np.empty((3, n), np.int64)
        np.bitwise_and(entry, np.uint16(31), out=context[:2], casting="unsafe")
        context[2] = context[1]
        context[1] += agree * np.int64(32)
        context += self.weight_base[:, :n]
        self.context = context
        self.weight = weight = self.weights.take(context)
        dot = np.empty((2, n), np.int32)
        np.add(weight[0], weight[1], out=dot[0])
        dot[1] = weight[2]
        dot >>= 4
        dot += 2048
        self.chance = chance = _SQUASH.take(dot, mode="clip")
        chance[1] *= ~agree
        np.minimum(chance[1], _MOST_ORDER_1, out=chance[1])
        self.order2 = order2 = chance[0] << (_TOTAL - 12)  # width of order 2's part of the interval
        rest = (1 << _TOTAL) - order2
        base = rest * chance[1]
        base >>= 12
        rest -= base
        base += order2
        self.base, self.order0 = base, rest  # the width of order 1's part with it, and of order 0's

    def parts(self, same: np.ndarray, first: np.ndarray, last: np.ndarray, seen: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the ids' parts of the interval; order 0 has them at places first to last of `seen`."""
        start, end = first * self.order0, last * self.order0
        start //= seen
        end //= seen
        start += self.base
        end += self.base
        np.copyto(start, self.order2, where=same[1])
        np.copyto(end, self.base, where=same[1])
        np.copyto(start, 0, where=same[0])
        np.copyto(end, self.order2, where=same[0])
        end -= start
        return start.astype(np.uint64), end.astype(np.uint64)

    def learn(self, word: np.ndarray, same: np.ndarray) -> None:
        """What came, and whether it is the id of order 2, or 1."""
        entry = self.entry
        sure = entry & np.uint16(7)
        fresh = word + np.uint16(1)
        less = entry - (sure + np.uint16(1) >> np.uint16(1))
        np.copyto(less, fresh, where=sure < 2)
        np.copyto(less, entry + (sure < 7), where=same)
        self.entries[self.at] = less
        error = same * np.int32(_ONE)
        error -= self.chance
        error >>= 1
        error[1] *= ~(same[0] | self.agree)
        weight = self.weight
        weight[:2] += error[0]
        weight[2] += error[1]
        self.weights[self.context] = weight




class _Encoder:
    def __init__(self, lanes: int, room: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, 2**64 - 1, np.uint64)
        self.out = np.zeros(lanes * room, np.uint32)
        self.start = np.arange(lanes) * room
        self.at = self.start.copy()

    def narrow(self, n: int, start: np.ndarray, size: np.ndarray, shared: np.uint64 = _SHARED) -> None:
        low, span = self.low[:n], self.range[:n]
        span >>= shared
        low += span * start
        span *= size
        if len(short := np.flatnonzero(span <= _LOW32)):
            l, r = low[short], _cut(low[short], span[short])
            at = self.at[short]
            self.out[at] = l >> _32
            self.at[short] = at + 1
            low[short], span[short] = l << _32, r << _32

    def finish(self) -> list[bytes]:
        """One word more names a number in the interval; words of zero follow it."""
        self.out[self.at] = (self.low >> _32) + ((self.low & _LOW32) != 0)
        return [self.out[a : b + 1].astype("<u4").tobytes() for a, b in zip(self.start, self.at)]


def _cut(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The range up to the next multiple of 2 ** 32, where there is one inside."""
    return np.minimum(span, (~low & _LOW32) + np.uint64(1))


class _Decoder:
    def __init__(self, codes: list[bytes]):
        room = max(map(len, codes)) // 4 + 4
        data = np.zeros((len(codes), room), np.uint32)
        for i, b in enumerate(codes):
            data[i, : len(b) // 4] = np.frombuffer(b, "<u4")
        self.low = np.zeros(len(codes), np.uint64)
        self.range = np.full(len(codes), 2**64 - 1, np.uint64)
        self.value = data[:, 0].astype(np.uint64) << _32 | data[:, 1]  # less low
        self.data = data.ravel()
        self.at = np.arange(len(codes)) * room + 2

    def target(self, n: int, shared: np.uint64 = _SHARED) -> np.ndarray:
        span = self.range[:n]
        span >>= shared
        return np.minimum(self.value[:n] // span, np.uint64((1 << int(shared)) - 1)).astype(np.int32)

    def narrow(self, n: int, start: np.ndarray, size: np.ndarray) -> None:
        """After target(n)."""
        low, span, value = self.low[:n], self.range[:n], self.value[:n]
        down = span * start
        low += down
        value -= down
        span *= size
        if len(short := np.flatnonzero(span <= _LOW32)):
            l, r = low[short], _cut(low[short], span[short])
            at = self.at[short]
            value[short] = value[short] << _32 | self.data.take(at, mode="clip")
            self.at[short] = at + 1
            low[short], span[short] = l << _32, r << _32


class _Order0:
    """How often the ids of each lane are still to come as of the last renewal, lane by lane in one array."""

    def __init__(self, many: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        """many: distinct ids of each lane; ids, counts: of all lanes, one after another."""
        self.begin = np.r_[0, np.cumsum(many)]
        self.ids, self.many = ids, many
        self.counts = counts.astype(np.int32)
        rank = np.arange(len(ids)) - np.repeat(self.begin[:-1], many)
        often = (counts > 1).astype(np.int64) + (counts > 3) + (counts > 15)
        self.words = (rank << 5 | often << 3).astype(np.uint16)

    def place(self, words: np.ndarray) -> np.ndarray:
        """Where the ids of the first lanes stand."""
        return (words >> np.uint16(5)) + self.begin[: words.shape[-1]]

    def renew(self, lanes: int, came: np.ndarray) -> None:
        """Takes off what came, as places; then `spans` are the first places of ids in the rest of their lanes, and their numbers, 12 bits each."""
        np.subtract.at(self.counts, came, np.int32(1))
        known = self.counts[: self.begin[lanes]]
        start = np.cumsum(known, dtype=np.int32)
        start -= known
        start -= np.repeat(start[self.begin[:lanes]], self.many[:lanes])
        start <<= 12
        start |= known
        self.spans = start

    def spread(self, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        """The words to come, in order, of the first lanes one after another, and where each lane begins."""
        words = np.repeat(self.words[: self.begin[lanes]], self.counts[: self.begin[lanes]])
        ends = np.cumsum(np.add.reduceat(self.counts[: self.begin[lanes]], self.begin[:lanes]))
        return words, np.r_[0, ends[:-1]]


def _renewals(longest: int) -> list[tuple[int, int, int]]:
    """Steps from one renewal to the next, from the longest block's first on, and how many are to come in a whole block at that renewal.

    They depend on what is to come alone, so that a block's code is the same beside any others.
    """
    left, cuts = BLOCK, [0]
    while left > 8:
        left = left * 3 // 4 if left > 128 else left // 2
        cuts.append(BLOCK - left)
    return [(max(a, BLOCK - longest), b, BLOCK - a) for a, b in zip(cuts, [*cuts[1:], BLOCK]) if b > BLOCK - longest]


def _begun(sizes: np.ndarray) -> np.ndarray:
    """How many lanes, of falling sizes, have begun at each step of BLOCK."""
    return np.searchsorted(-sizes, np.arange(-BLOCK, 0), "right")


def _going(many: np.ndarray) -> np.ndarray:
    """How many lanes, of falling numbers, go on at each step."""
    return np.searchsorted(-many, -np.arange(int(many[0])), "left")


def _encode_alphabets(many: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Distinct ids of lanes, one lane after another, and how often each stands there."""
    order = np.argsort(-many, kind="stable")
    lane = np.empty_like(order)
    lane[order] = np.arange(len(order))
    begin = np.cumsum(many) - many
    gap = np.diff(ids.astype(np.int64), prepend=-1)
    gap[begin] = ids[begin].astype(np.int64) + 1
    gaps, often = (np.ones((int(many.max()), len(many)), np.int64) for _ in range(2))
    at = np.arange(len(ids)) - np.repeat(begin, many), np.repeat(lane, many)
    gaps[at], often[at] = gap, counts
    coder, mean = _Encoder(len(many), 3 * len(gaps) + 4), np.full(len(many), 64)
    for g, c, n in zip(gaps, often, _going(many[order])):
        g, c, q = g[:n], c[:n], np.searchsorted(_MEANS, mean[:n], "right")
        bits = np.frexp(g)[1] - 1
        start = _GAP[q, bits]
        coder.narrow(n, start.astype(np.uint64), (_GAP[q, bits + 1] - start).astype(np.uint64))
        coder.narrow(n, (g - (1 << bits)).astype(np.uint64), np.uint64(1), bits.astype(np.uint64))
        coder.narrow(n, _NUMBER[c - 1].astype(np.uint64), (_NUMBER[c] - _NUMBER[c - 1]).astype(np.uint64))
        mean[:n] += (g << 4) - mean[:n] >> 3
    words = coder.finish()
    return [words[i] for i in lane]


def _decode_alphabets(codes: list[bytes], many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-many, kind="stable")
    gaps, often = (np.ones((int(many.max()), len(many)), np.int64) for _ in range(2))
    coder, mean = _Decoder([codes[i] for i in order]), np.full(len(many), 64)
    for t, n in enumerate(_going(many[order])):
        q, v = np.searchsorted(_MEANS, mean[:n], "right"), coder.target(n)
        bits = _GAP_AT[q, v >> _GAP_STEP]
        start = _GAP[q, bits]
        coder.narrow(n, start.astype(np.uint64), (_GAP[q, bits + 1] - start).astype(np.uint64))
        span = coder.range[:n]
        span >>= bits.astype(np.uint64)
        low = np.minimum(coder.value[:n] // span, ((1 << bits) - 1).astype(np.uint64))
        coder.narrow(n, low, np.uint64(1))
        gaps[t, :n] = g = low.astype(np.int64) + (1 << bits)
        often[t, :n] = c = np.minimum(np.searchsorted(_NUMBER, coder.target(n), "right"), BLOCK)
        coder.narrow(n, _NUMBER[c - 1].astype(np.uint64), (_NUMBER[c] - _NUMBER[c - 1]).astype(np.uint64))
        mean[:n] += (g << 4) - mean[:n] >> 3
    lane = np.empty_like(order)
    lane[order] = np.arange(len(order))
    at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many), np.repeat(lane, many)
    return (np.cumsum(gaps, axis=0) - 1)[at], often[at]


def _encode(blocks: list[np.ndarray], sizes: np.ndarray) -> list[bytes]:
    lanes = len(blocks)
    rank_of = np.zeros(1 << 16, np.uint16)
    ranks, alphabets, numbers = [], [], []
    for b in blocks:
        rank_of[b] = own = np.arange(len(b), dtype=np.uint16)
        ids = np.sort(b[rank_of[b] == own])
        rank_of[ids] = own[: len(ids)]
        ranks.append(rank := rank_of[b])
        alphabets.append(ids)
        numbers.append(np.bincount(rank))
    many = np.array([len(x) for x in alphabets])
    order0 = _Order0(many, np.concatenate(alphabets), np.concatenate(numbers))
    steps = np.zeros((lanes, BLOCK + 2), np.uint16)
    for row, rank, a in zip(steps, ranks, order0.begin):
        order0.words[a:].take(rank, out=row[BLOCK + 2 - len(rank) :], mode="clip")
    steps = np.ascontiguousarray(steps.T)
    model, coder, begun = _Model(lanes), _Encoder(lanes, int(sizes[0]) + 4), _begun(sizes)
    came = np.zeros(0, np.int64)
    for a, b, seen in _renewals(int(sizes[0])):
        order0.renew(begun[b - 1], came)
        came = []
        for t in range(a, b):
            n = begun[t]
            word = steps[t + 2, :n]
            model.predict(steps[t + 1, :n], steps[t, :n])
            same = model.ids == (word & np.uint16(0xFFF8))
            same[1] &= ~model.agree
            place = order0.place(word)
            span = order0.spans.take(place)
            first = span >> 12
            span &= 4095
            span += first
            coder.narrow(n, *model.parts(same, first, span, seen))
            same[1] = model.ids[1] == word
            model.learn(word, same)
            came.append(place)
        came = np.concatenate(came)
    heads = _encode_alphabets(many, order0.ids, np.concatenate(numbers))
    return [int(k).to_bytes(2, "little") + (len(w) // 4).to_bytes(2, "little") + w + words for k, w, words in zip(many, heads, coder.finish())]


def _decode(codes: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
    lanes = len(codes)
    many = np.array([int.from_bytes(c[:2], "little") for c in codes])
    ends = [4 + 4 * int.from_bytes(c[2:4], "little") for c in codes]
    ids, counts = _decode_alphabets([c[4:e] for c, e in zip(codes, ends)], many)
    order0 = _Order0(many, ids, counts)
    if (np.add.reduceat(counts, order0.begin[:-1]) != sizes).any():
        raise ValueError("a block's numbers of ids are wrong")
    coder = _Decoder([c[e:] for c, e in zip(codes, ends)])
    steps = np.zeros((BLOCK + 2, lanes), np.uint16)
    model, begun = _Model(lanes), _begun(sizes)
    came = np.zeros(0, np.int64)
    for a, b, seen in _renewals(int(sizes[0])):
        order0.renew(begun[b - 1], came)
        spread, row = order0.spread(begun[b - 1])
        came = []
        for t in range(a, b):
            n = begun[t]
            model.predict(steps[t + 1, :n], steps[t, :n])
            v = coder.target(n)
            is2 = v < model.order2
            is1 = v < model.base
            is1 ^= is2
            v -= model.base
            v += 1
            v *= seen
            v -= 1
            slot = (v / model.order0).astype(np.int64)
            np.clip(slot, 0, seen - 1, out=slot)
            slot += row[:n]
            word = spread.take(slot, mode="clip")
            np.copyto(word, model.ids[1], where=is1)
            np.copyto(word, model.ids[0], where=is2)
            steps[t + 2, :n] = word
            place = order0.place(word)
            span = order0.spans.take(place, mode="clip")
            first = span >> 12
            span &= 4095
            span += first
            coder.narrow(n, *model.parts((is2, is1), first, span, seen))
            same = np.stack([is2, model.ids[1] == word])
            model.learn(word, same)
            came.append(place)
        came = np.concatenate(came)
    back = np.ascontiguousarray(steps[2:].T)
    return [ids[order0.begin[lane] : order0.begin[lane + 1]].take(back[lane, BLOCK - size :] >> np.uint16(5)).astype(np.uint32) for lane, size in enumerate(sizes)]


def _in_lanes(sizes: list[int]) -> list[list[int]]:
    """Blocks that are not empty, longest first, in parts of LANES."""
    order = sorted((i for i, n in enumerate(sizes) if n), key=lambda i: -sizes[i])
    return [order[at : at + LANES] for at in range(0, len(order), LANES)]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of at most BLOCK ids as bytes. An id beyond 16 bits is an error."""
    if any(len(b) and (b.max() > 65535 or b.min() < 0) for b in map(np.asarray, blocks)):
        raise ValueError("ids beyond 16 bits cannot be coded")
    out = [b""] * len(blocks)
    for part in _in_lanes([len(b) for b in blocks]):
        for i, code in zip(part, _encode([blocks[i] for i in part], np.array([len(blocks[i]) for i in part]))):
            out[i] = code
    return out


def decode_blocks(codes: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of each block, given how many there are."""
    out = [np.zeros(0, np.uint32)] * len(codes)
    for part in _in_lanes(sizes):
        for i, ids in zip(part, _decode([codes[i] for i in part], np.array([sizes[i] for i in part]))):
            out[i] = ids
    return out


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
