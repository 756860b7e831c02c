"""FM-index over integer symbols: wavelet-matrix ranks and sampled suffix positions.

The text is a sequence of segments. Symbols are 1 and up; 0 ends a segment.
Segment ends are ordered by their place in the text, so that the suffix order
is total and no match runs across two segments.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; each round sorts only what is still tied."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    if not n or text[-1] != 0:
        raise ValueError("the text must end with 0")
    first = text.astype(np.int64) + len(ends) - 1
    first[ends] = np.arange(len(ends))
    sa = np.argsort(first, kind="stable")
    keys = first[sa]
    place = np.arange(n, dtype=np.int64)
    heads = np.maximum.accumulate(np.where(np.r_[True, keys[1:] != keys[:-1]], place, 0))
    rank = np.empty(n, np.int64)
    rank[sa] = heads
    tied = np.r_[heads[1:] == heads[:-1], False] | np.r_[False, heads[1:] == heads[:-1]]
    at, step = np.flatnonzero(tied), 1
    while len(at):
        suffixes = sa[at]
        keys = rank[suffixes] * n + rank[suffixes + step]
        order = np.argsort(keys)
        keys, suffixes = keys[order], suffixes[order]
        sa[at] = suffixes
        new = np.r_[True, keys[1:] != keys[:-1]]
        heads = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[suffixes] = heads
        at = at[~(new & np.r_[new[1:], True])]
        step *= 2
    return sa


class WaveletMatrix:
    """Ranks of symbols in bit planes of 64-bit words, one count before each word."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.size, self.levels = len(symbols), max(1, int(sigma).bit_length())
        self.words, self.before, self.zeros = [], [], []
        rest = symbols.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bits = (rest >> np.uint32(level)) & np.uint32(1)
            padded = np.zeros((self.size // 64 + 1) * 64, np.uint8)
            padded[: self.size] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.before.append((np.cumsum(counts) - counts).astype(np.int32 if self.size < 2**31 else np.int64))
            set_ = bits.astype(bool)
            self.zeros.append(int(self.size - counts.sum()))
            rest = np.concatenate([rest[~set_], rest[set_]])
        # where each symbol begins once all planes are passed
        self.start = self.descend(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & ((_ONE << bit) - _ONE)).astype(np.int64)

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            ones = self._ones(level, at)
            bit = (symbols >> (self.levels - 1 - level)) & 1
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self.descend(symbols, at) - self.start[symbols]

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        symbols = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            value = ((self.words[level][word] >> bit) & _ONE).astype(np.int64)
            ones = self._ones(level, at)
            at = np.where(value == 1, self.zeros[level] + ones, at - ones)
            symbols = symbols * 2 + value
        return symbols, at - self.start[symbols]


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, every: int = 8):
        sa = suffix_array(text)
        self.size = len(text)
        self.planes = WaveletMatrix(text[sa - 1], sigma)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])[: sigma + 1]
        # each segment's first place is sampled, so a walk never crosses a segment's end
        kept = (sa % every == 0) | (text[sa - 1] == 0)
        marks = np.zeros((self.size // 64 + 1) * 64, np.uint8)
        marks[: self.size] = kept
        self.marks = np.packbits(marks, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.marks).astype(np.int64)
        self.marked = np.cumsum(counts) - counts
        self.samples = sa[kept]

    def search(self, patterns: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of right-aligned patterns, padded with -1 on the left.

        All patterns go backward together; one stops once its range has fewer
        than ``least`` rows, and its range is then empty.
        """
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            on = np.flatnonzero((high - low >= least) & (patterns[:, column] >= 0))
            if not len(on):
                break
            symbols = patterns[on, column].astype(np.int64)
            both = self.planes.rank(np.concatenate([symbols, symbols]), np.concatenate([low[on], high[on]]))
            low[on], high[on] = self.below[symbols] + both[: len(on)], self.below[symbols] + both[len(on) :]
        short = high - low < least
        high[short] = low[short]
        return low, high

    def matches(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of streamed pieces [begin, end) of ``text`` (0 for symbols the index lacks), at ``least`` and above.

        A piece is searched backward from its end. Where its match [left, right)
        cannot go on, it is reported if it is long enough, and the search begins
        again from the longest right end for which a window of ``least`` symbols
        over the next place is still open. So every place that begins a match of
        that length lies in a reported one. Returns left, right and the suffix
        range [low, high) of each; all pieces go on in step.
        """
        on = np.flatnonzero(end - begin >= least)
        stop, left, right = begin[on], end[on], end[on]
        low, high = np.zeros(len(on), np.int64), np.full(len(on), self.size, np.int64)
        size = np.append(self.below[1:], self.size) - self.below
        out: list[tuple[np.ndarray, ...]] = []
        while len(on):
            symbol = np.where(left > stop, text[left - 1], -1)
            new_low, new_high = np.zeros(len(on), np.int64), np.zeros(len(on), np.int64)
            fresh = np.flatnonzero((left == right) & (symbol > 0))
            new_low[fresh], new_high[fresh] = self.below[symbol[fresh]], self.below[symbol[fresh]] + size[symbol[fresh]]
            # a range of one row goes on only with the symbol before it
            one = np.flatnonzero((left < right) & (symbol > 0) & (high - low == 1))
            if len(one):
                before, rank = self.planes.step(low[one])
                same = one[before == symbol[one]]
                new_low[same] = self.below[symbol[same]] + rank[before == symbol[one]]
                new_high[same] = new_low[same] + 1
            more = np.flatnonzero((left < right) & (symbol > 0) & (high - low > 1))
            if len(more):
                s = symbol[more]
                both = self.planes.rank(np.concatenate([s, s]), np.concatenate([low[more], high[more]]))
                new_low[more], new_high[more] = self.below[s] + both[: len(more)], self.below[s] + both[len(more) :]
            ok = new_high > new_low
            fails = np.flatnonzero(~ok)
            if len(fails):
                long = fails[right[fails] - left[fails] >= least]
                out.append((left[long], right[long], low[long], high[long]))
                to = np.where(symbol[fails] == 0, left[fails] - 1, np.minimum(right[fails] - 1, left[fails] - 1 + least))
                right[fails] = np.where(symbol[fails] < 0, stop[fails], to)
                left[fails] = right[fails]
                left[ok] -= 1
                low, high = new_low, new_high
                keep = ok | (right - stop >= least)
                if not keep.all():
                    on, stop, left, right, low, high = (x[keep] for x in (on, stop, left, right, low, high))
            else:
                left -= 1
                low, high = new_low, new_high
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to the nearest sampled one."""
        out = np.zeros(len(rows), np.int64)
        left, at, walked = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.marks[word] >> bit) & _ONE == 1
            done = np.flatnonzero(hit)
            if len(done):
                w, b = word[done], bit[done]
                out[left[done]] = self.samples[self.marked[w] + np.bitwise_count(self.marks[w] & ((_ONE << b) - _ONE))] + walked
            left, at = left[~hit], at[~hit]
            if len(left):
                symbols, ranks = self.planes.step(at)
                at = self.below[symbols] + ranks
            walked += 1
        return out


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows of the ranges one after another, and the number of the range of each."""
    sizes = high - low
    owner = np.repeat(np.arange(len(low)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner], owner
