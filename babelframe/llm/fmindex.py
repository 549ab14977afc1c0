"""A compressed full-text index over the segments of one shard: a Burrows-Wheeler transform in a wavelet tree of packed bits.

All operations are on arrays, so that many backward searches advance together."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Ranks of symbols in a sequence; each level is a bit vector in 64-bit words with running counts."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.n = bits, len(symbols)
        self.words, self.counts, self.zeros = [], [], []
        x = symbols
        for level in reversed(range(bits)):
            bit = ((x >> level) & 1).astype(np.uint8)
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1].astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            order = bit.view(bool)
            x = np.concatenate([x[~order], x[order]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often `symbol` stands before `at`; symbol and at are of equal shape."""
        start = np.zeros_like(at)
        end = at
        for level in range(self.bits):
            words, counts, zeros = self.words[level], self.counts[level], self.zeros[level]
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            both = np.concatenate([start, end])
            word, inside = both >> 6, (both & 63).astype(np.uint64)
            ones = counts[word] + np.bitwise_count(words[word] & ((np.uint64(1) << inside) - np.uint64(1)))
            ones_start, ones_end = ones[: len(start)], ones[len(start) :]
            start = np.where(one, zeros + ones_start, start - ones_start)
            end = np.where(one, zeros + ones_end, end - ones_end)
        return end - start


class SegmentIndex:
    """FM-index of segments (arrays of symbols from 1), with the longest common prefixes of neighbouring suffixes.

    Each segment ends in a separator of its own, so no match crosses its end.
    """

    def __init__(self, segments: list[np.ndarray]) -> None:
        count = len(segments)
        lengths = np.array([len(x) for x in segments], np.int64)
        self.start = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.n = n = int(self.start[-1])
        text = np.zeros(n, np.int64)
        self.owner = np.repeat(np.arange(count), lengths + 1)
        text[np.arange(n) - self.owner < self.start[-1]] = 0
        fill = np.ones(n, bool)
        fill[self.start[1:] - 1] = False
        text[fill] = np.concatenate(segments) if count else []
        self.text = text
        self.bits = max(1, int(text.max()).bit_length())
        self.levels: list[tuple[int, np.ndarray]] = []
        self.order = self._suffix_order(text, fill, count, int(lengths.max()))
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.common = self._common(n)
        before = text[self.order - 1]
        before[self.order == 0] = 0
        self.tree = WaveletTree(before, self.bits)
        sizes = np.bincount(text, minlength=1 << self.bits)
        self.first = np.concatenate([[0], np.cumsum(sizes)])[: 1 << self.bits]
        self.levels = []

    def _suffix_order(self, text: np.ndarray, fill: np.ndarray, count: int, longest: int) -> np.ndarray:
        """Suffixes in order, by doubling; keeps the ranks of each length for _common."""
        n = len(text)
        rank = text + (count - 1)
        rank[~fill] = np.arange(count)
        self.levels.append((1, rank))
        width = int(rank.max() + 1).bit_length()
        per = max(1, 62 // width)
        key = np.zeros(n, np.int64)
        for i in range(per):
            key <<= width
            key[: n - i] |= rank[i:] + 1
        h, order = per, None
        while True:
            order = np.argsort(key)
            ordered = key[order]
            new = np.empty(n, np.int64)
            steps = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            new[order] = steps
            self.levels.append((h, new))
            if h > longest or steps[-1] == n - 1:
                return order
            key = new << 31
            key[: n - h] |= new[h:] + 1
            h *= 2

    def _common(self, n: int) -> np.ndarray:
        """Common prefix of each suffix in order with the one before; 0 at both ends of the array (length n + 1)."""
        a, b = self.order[:-1], self.order[1:]
        done = np.zeros(n - 1, np.int64)
        for h, rank in reversed(self.levels):
            for _ in range(1 if h > 1 else self.levels[1][0] - 1 if len(self.levels) > 1 else 1):
                x, y = np.minimum(a + done, n - 1), np.minimum(b + done, n - 1)
                done += np.where((rank[x] == rank[y]) & (x != y), h, 0)
        return np.concatenate([[-1], done, [-1]])

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffixes that begin with symbol and continue as those in [low, high)."""
        m = len(symbol)
        ranks = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.first[symbol]
        return base + ranks[:m], base + ranks[m:]


class LeastTable:
    """Nearest smaller values of an array, by least values over spans of powers of two."""

    def __init__(self, x: np.ndarray) -> None:
        self.n, self.tables = len(x), [x.astype(np.int16 if x.max() < 2**15 else np.int32)]
        span = 1
        while span * 2 <= self.n:
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-span], last[span:]))
            span *= 2

    def left(self, at: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Largest i <= at with x[i] < below (there is one)."""
        end = at + 1
        for k in reversed(range(len(self.tables))):
            table, span = self.tables[k], 1 << k
            start = end - span
            can = start >= 0
            can &= table[np.maximum(start, 0)] >= below
            end = np.where(can, start, end)
        return end - 1

    def right(self, at: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Least i >= at with x[i] < below (there is one)."""
        for k in reversed(range(len(self.tables))):
            table, span = self.tables[k], 1 << k
            can = at + span <= self.n
            can &= table[np.minimum(at, len(table) - 1)] >= below
            at = np.where(can, at + span, at)
        return at


def shared_intervals(segments: list[np.ndarray], anchor_at: np.ndarray, low_doc: np.ndarray, high_doc: np.ndarray, least: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans of at least `least` symbols around each segment's anchor that also stand in a segment of another document.

    The anchor are the `width` symbols from anchor_at. A segment stands for all its holders, which range from low_doc to high_doc.
    Matching statistics by backward search: a match is made longer to the left as long as two documents hold it, and else shortened at its
    right end to the next longest common prefix. Returns segment number, start and end, several per segment in no order.
    """
    index = SegmentIndex(segments)
    smaller = LeastTable(index.common)
    owner = index.owner[index.order]
    changes = np.concatenate([[0], np.cumsum(low_doc[owner[1:]] != low_doc[owner[:-1]])])
    multiple = np.concatenate([[0], np.cumsum((low_doc != high_doc)[owner])])

    def several(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        full = high > low
        last = np.maximum(high - 1, 0)
        first = np.minimum(low, index.n - 1)
        return full & ((changes[last] > changes[first]) | (multiple[high] > multiple[np.minimum(low, index.n)]))

    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def record(seg: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        long = size >= least
        if long.any():
            found.append((seg[long], start[long], start[long] + size[long]))

    seg = np.arange(len(segments))
    at = anchor_at.astype(np.int64)
    low = index.place[index.start[:-1] + at]
    high = low + 1
    size = np.array([len(x) for x in segments], np.int64) - at
    must = at + width  # a match that ends before has lost the anchor
    while len(seg):
        # shorten at the right end until two documents hold the match
        wide = several(low, high)
        while not wide.all():
            i = np.flatnonzero(~wide)
            depth = np.maximum(index.common[low[i]], index.common[high[i]])
            size[i] = depth
            low[i], high[i] = smaller.left(low[i], depth), smaller.right(high[i], depth)
            wide[i] = several(low[i], high[i]) | (at[i] + depth < must[i])
        alive = at + size >= must
        if not alive.all():
            seg, at, low, high, size, must = (x[alive] for x in (seg, at, low, high, size, must))
        # lengthen to the left; where it fails, the match is maximal and is kept
        going = np.ones(len(seg), bool)
        while going.all() and len(seg):
            more = at > 0
            if not more.all():
                record(seg[~more], at[~more], size[~more])
                seg, at, low, high, size, must = (x[more] for x in (seg, at, low, high, size, must))
                if not len(seg):
                    break
            symbol = index.text[index.start[seg] + at - 1]
            new_low, new_high = index.step(symbol, low, high)
            going = several(new_low, new_high)
            at = np.where(going, at - 1, at)
            size = np.where(going, size + 1, size)
            low, high = np.where(going, new_low, low), np.where(going, new_high, high)
        if not len(seg):
            break
        if going.all():
            continue
        stuck = np.flatnonzero(~going)
        record(seg[stuck], at[stuck], size[stuck])
        # the next shorter match at the same place, from which the search goes on to the left
        depth = np.maximum(index.common[low[stuck]], index.common[high[stuck]])
        size[stuck] = depth
        low[stuck], high[stuck] = smaller.left(low[stuck], depth), smaller.right(high[stuck], depth)
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]
