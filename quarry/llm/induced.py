"""Order and common prefixes of a shard's suffixes by external induced sorting.

Suffixes are smaller (S) or larger (L) than their successor. The leftmost S suffixes are
sorted first: in memory where they fit, else by naming their substrings and sorting the
string of names in the same way, recursively. All others are induced: an upward sweep over
the symbols pops each suffix and pushes the L suffix before it, a downward sweep does so
for S. The queue holds (position, common prefix with the entry before it) by first symbol;
entries arrive in order, so a first-in-first-out file for each symbol is a priority queue.
Beyond a number of entries, queue and results lie in a file. The text itself is an array
that the caller may map from a file.

Common prefixes are counted up to a depth; suffixes alike up to it are in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from tempfile import TemporaryFile

import numpy as np

_ENTRY = np.dtype([("pos", np.int64), ("lcp", np.uint8)])
_FAR = np.uint8(255)


class _Buckets:
    """Entries by symbol in the order of arrival. At most `most` are held, others lie in a file of the task."""

    def __init__(self, n_symbols: int, most: int):
        self.parts: list[list] = [[] for _ in range(n_symbols)]
        self.most, self.held, self.file, self.end = most, 0, None, 0

    def push(self, symbol: int, entries: np.ndarray) -> None:
        self.parts[symbol].append(entries)
        self.held += len(entries)
        if self.held > self.most:
            self.file = self.file or TemporaryFile()
            self.file.seek(self.end)
            for own in self.parts:
                for i, part in enumerate(own):
                    if not isinstance(part, tuple):
                        self.file.write(part.tobytes())
                        own[i] = (self.end, len(part))
                        self.end += part.nbytes
            self.held = 0

    def _read(self, part) -> np.ndarray:
        if isinstance(part, tuple):
            self.file.seek(part[0])
            return np.frombuffer(self.file.read(part[1] * _ENTRY.itemsize), dtype=_ENTRY)
        return part

    def pop(self, symbol: int) -> np.ndarray | None:
        """The oldest entries of a symbol, which go: all of them, or a good part of what may be held."""
        got, n, own = [], 0, self.parts[symbol]
        while len(got) < len(own) and n < max(1, self.most // 8):
            part = own[len(got)]
            n += part[1] if isinstance(part, tuple) else len(part)
            self.held -= 0 if isinstance(part, tuple) else len(part)
            got.append(self._read(part))
        del own[: len(got)]
        return np.concatenate(got) if got else None

    def each(self, symbol: int, down: bool = False) -> Iterator[np.ndarray]:
        """A symbol's entries, which stay; down: the newest first."""
        for part in reversed(self.parts[symbol]) if down else self.parts[symbol]:
            yield self._read(part)


def _turned(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The entries of parts that come from the last to the first, in reversed order; each one's common prefix is now with
    the entry that came behind it."""
    before = 0
    for part in parts:
        out = part[::-1].copy()
        out["lcp"][1:] = part["lcp"][:0:-1]
        out["lcp"][0] = before
        before = part["lcp"][0]
        yield out


def _common(t: np.ndarray, a: int, b: int, depth: int) -> int:
    n = min(depth, len(t) - max(a, b))
    differ = np.flatnonzero(t[a : a + n] != t[b : b + n])
    return int(differ[0]) if len(differ) else n


def _range_min(x: np.ndarray):
    """A function of (first, last), arrays, that gives the least of x[first..last]."""
    levels = [x]
    while 2 ** len(levels) <= len(x):
        half = 2 ** (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))

    def least(first, last):
        k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), dtype=x.dtype)
        for level in np.unique(k):
            at = k == level
            out[at] = np.minimum(levels[level][first[at]], levels[level][last[at] - 2 ** int(level) + 1])
        return out

    return least


def _sweep(t: np.ndarray, wanted: np.ndarray, feed, n_symbols: int, down: bool, depth: int, most: int) -> _Buckets:
    """The suffixes that `wanted` marks, induced. feed(symbol) gives the other suffixes of a symbol, which stand behind
    the induced ones in the order of the sweep."""
    queue, done = _Buckets(n_symbols, most), _Buckets(n_symbols, most)
    carry, seen = np.full(n_symbols, _FAR), np.zeros(n_symbols, dtype=bool)

    def scan(block: np.ndarray) -> None:
        at = np.flatnonzero(block["pos"] > 0)
        at = at[wanted[block["pos"][at] - 1]]
        low = block["lcp"].min()
        if not len(at):
            np.minimum(carry, low, out=carry)
            return
        symbols = t[block["pos"][at] - 1]
        order = np.argsort(symbols.astype(np.uint16) if n_symbols < 1 << 16 else symbols, kind="stable")
        at, symbols = at[order], symbols[order]
        least = _range_min(block["lcp"])
        new = np.r_[True, symbols[1:] != symbols[:-1]]
        shared = least(np.where(new, 0, np.r_[0, at[:-1] + 1]), at)
        shared[new] = np.minimum(shared[new], carry[symbols[new]])
        entries = np.empty(len(at), dtype=_ENTRY)
        entries["pos"], entries["lcp"] = block["pos"][at] - 1, np.minimum(shared.astype(np.int64) + 1, depth)
        entries["lcp"][new] *= seen[symbols[new]]
        cuts = np.r_[np.flatnonzero(new), len(at)]
        own, last = symbols[cuts[:-1]], at[cuts[1:] - 1]
        np.minimum(carry, low, out=carry)
        seen[own], carry[own] = True, _FAR
        more = last + 1 < len(block)
        carry[own[more]] = least(last[more] + 1, np.full(more.sum(), len(block) - 1))
        for s, a, b in zip(own.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            queue.push(s, entries[a:b])

    for symbol in range(n_symbols)[:: -1 if down else 1]:
        last = None
        while (block := queue.pop(symbol)) is not None:
            done.push(symbol, block)
            scan(block)
            last = int(block["pos"][-1])
        for block in feed(symbol):
            if last is not None:
                block = block.copy()
                block["lcp"][0] = _common(t, last, int(block["pos"][0]), depth)
                last = None
            scan(block)
    return done


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor; the last one, the sentinel, is."""
    n = len(t)
    smaller = np.ones(n, dtype=bool)
    smaller[:-1] = t[:-1] < t[1:]
    settled = np.arange(n)
    settled[:-1][t[:-1] == t[1:]] = n
    return smaller[np.minimum.accumulate(settled[::-1])[::-1]]


def _words(t: np.ndarray, at: np.ndarray, n_symbols: int, depth: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """The first symbols of suffixes, several in a number: (numbers, symbols in one, bits of a symbol)."""
    bits = max(1, int(n_symbols - 1).bit_length())
    per = 63 // bits
    for begin in range(0, depth, per):
        word = np.zeros(len(at), dtype=np.int64)
        for k in range(begin, min(depth, begin + per)):
            word <<= bits
            word |= np.take(t, at + k, mode="clip")  # behind the end stands the sentinel again
        yield word, min(per, depth - begin), bits


def _sorted_in_memory(t: np.ndarray, at: np.ndarray, n_symbols: int, depth: int) -> np.ndarray:
    order, group, tied = np.arange(len(at)), np.zeros(len(at), dtype=np.int64), np.arange(len(at))
    for word, _, _ in _words(t, at, n_symbols, depth):
        # tied: places in the order whose suffix equals a neighbour's so far
        w = word[order[tied]]
        by = np.lexsort((w, group[tied]))
        order[tied], w = order[tied][by], w[by]
        g = group[tied]
        new = np.r_[True, (w[1:] != w[:-1]) | (g[1:] != g[:-1])]
        group[tied] = tied[np.flatnonzero(new)][np.cumsum(new) - 1]
        alone = new & np.r_[new[1:], True]
        tied = tied[~alone]
        if not len(tied):
            break
    return at[order]


def _neighbours_common(t: np.ndarray, at: np.ndarray, n_symbols: int, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it, 0 for the first."""
    out, alike = np.zeros(len(at), dtype=np.uint8), np.ones(max(0, len(at) - 1), dtype=bool)
    for word, held, bits in _words(t, at, n_symbols, depth):
        x = word[1:] ^ word[:-1]
        for k in range(held):
            alike = alike & ((x >> (bits * (held - 1 - k))) == 0)
            out[1:] += alike
        if not alike.any():
            break
    return out


def _names(t: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names 0, 1, ... of sorted substrings, equal ones alike; ends: last place of each."""
    length = ends - order
    same = np.r_[False, length[1:] == length[:-1]]
    left = np.flatnonzero(same)
    for k in range(int(length.max(initial=0)) + 1):
        left = left[k <= length[left]]
        if not len(left):
            break
        differ = t[order[left] + k] != t[order[left - 1] + k]
        same[left[differ]] = False
        left = left[~differ]
    return np.cumsum(~same) - 1


def _sample(t: np.ndarray, small: np.ndarray, n_symbols: int, depth: int, most: int) -> np.ndarray:
    """The leftmost S suffixes, sorted."""
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) <= most or len(lms) < 3:
        return _sorted_in_memory(t, lms, n_symbols, depth)
    # sweeps from unsorted ones sort the substrings from each to the next
    by = lms[np.argsort(t[lms], kind="stable")]
    order = np.concatenate([b["pos"] for b in _induced(t, small, by, np.zeros(len(by), dtype=np.uint8), n_symbols, depth, most)])
    is_lms = np.zeros(len(t), dtype=bool)
    is_lms[lms] = True
    order = np.r_[len(t) - 1, order[is_lms[order]]]
    following = np.r_[lms[1:], len(t) - 1]
    name = np.empty(len(t), dtype=np.int64)
    name[order] = _names(t, order, following[np.searchsorted(lms, order)])
    reduced = name[lms]
    n = int(reduced.max()) + 1
    if n == len(lms):
        return order
    return lms[np.concatenate([[len(lms) - 1], *(b["pos"] for b in suffixes(reduced, n, depth, most))])]


def _induced(t, small, sample, common, n_symbols, depth, most) -> Iterator[np.ndarray]:
    """Entries of all suffixes but the sentinel's in ascending order, from the sorted sample."""
    cuts = np.searchsorted(t[sample], np.arange(n_symbols + 1))
    seeds = np.empty(len(sample), dtype=_ENTRY)
    seeds["pos"], seeds["lcp"] = sample, common

    def fed(symbol):
        a, b = cuts[symbol], cuts[symbol + 1]
        if a < b:
            part = seeds[a:b].copy()
            part["lcp"][0] = 0
            yield part

    large = _sweep(t, ~small, fed, n_symbols, False, depth, most)
    smaller = _sweep(t, small, lambda s: _turned(large.each(s, down=True)), n_symbols, True, depth, most)
    for symbol in range(n_symbols):
        last = None
        for part in large.each(symbol):
            yield part
            last = int(part["pos"][-1])
        for part in _turned(smaller.each(symbol, down=True)):
            if last is not None:
                part["lcp"][0] = _common(t, last, int(part["pos"][0]), depth)
                last = None
            yield part


def suffixes(t: np.ndarray, n_symbols: int, depth: int, most: int) -> Iterator[np.ndarray]:
    """Blocks of (pos, lcp), all suffixes of t but the last in ascending order, with the length of the common prefix with
    the one before, up to depth (254 at most).

    t: numbers under n_symbols, of which the last is a 0 that stands nowhere else. most: entries held in memory.
    """
    small = _types(t)
    sample = _sample(t, small, n_symbols, depth, most)
    return _induced(t, small, sample, _neighbours_common(t, sample, n_symbols, depth), n_symbols, depth, most)
