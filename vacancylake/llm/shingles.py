"""Word-shingle sets as 64-bit hashes in numpy, and the parts of them that a similarity join compares."""
from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_DRAW = np.random.default_rng(20240229)
_BYTE = _DRAW.integers(1, 1 << 63, 256, np.uint64)  # a random value for each byte
_BASE = 0x9E3779B97F4A7C15
_PLACE = _DRAW.integers(1, 1 << 63, WORDS + 1, np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to n."""
    if len(_powers[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes (int64) of the runs of five words of a text, A-Z lower-cased; a shorter text is one run."""
    data = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    blank = np.concatenate(([True], _SPACE[data], [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.int64)
    up, down = _power(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:len(data)])))
    words = _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    n = max(1, len(words) - WORDS + 1)
    total = np.full(n, min(len(words), WORDS), np.uint64) * _PLACE[WORDS]
    for k in range(min(WORDS, len(words))):
        total += words[k:k + n] * _PLACE[k]
    return np.unique(_mix(total)).view(np.int64) if n > 1 else _mix(total).view(np.int64)


def set_key(own: np.ndarray) -> int:
    """A 64-bit name of a set. (Two of 10^9 different sets share one with a chance of a few hundredths.)"""
    return int.from_bytes(hashlib.blake2b(np.sort(own).tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix(own: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first elements of a set, so many that any set of similarity 0.8 or more has `shared(n)` of them in its own prefix.

    All sets use one order: elements outside the frequent list by hash, then the frequent ones, most frequent last.
    frequent is sorted, rank belongs to it. Sets that have c elements in common have at least k in their first
    n - c + k; here c is at least four fifths of either size and k a twentieth of the smaller one.
    """
    n = len(own)
    need = n - (4 * n + 4) // 5 + 1 + n // 20
    own = np.sort(own)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        often = frequent[at] == own
        own = np.concatenate((own[~often], own[often][np.argsort(rank[at[often]], kind="stable")]))
    return own[:need]


class Members:
    """Sets of one region over a shared numbering of their elements."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        self.start = np.cumsum(self.size) - self.size
        values, self.items = np.unique(np.concatenate(sets), return_inverse=True)
        self.universe = len(values)

    def distances(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Jaccard distance of set i from each of rows."""
        mark = np.zeros(self.universe, np.int32)
        mark[self.items[self.start[i]:self.start[i] + self.size[i]]] = 1
        hits = np.concatenate(([0], np.cumsum(mark[self.items])))
        both = hits[self.start[rows] + self.size[rows]] - hits[self.start[rows]]
        return 1 - both / (self.size[i] + self.size[rows] - both)

    def linked(self, rows: np.ndarray):
        """Pairs (places in rows, the first smaller) of similarity 0.8 or more, a stripe of rows at a time: intersections with all
        later rows by products of incidence blocks of shared elements. No array has more than about CELLS cells for any number of rows."""
        flat = np.concatenate([self.items[a:a + n] for a, n in zip(self.start[rows], self.size[rows])])
        owner = np.repeat(np.arange(len(rows)), self.size[rows])
        values, item, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count[item] > 1
        item, owner = item[shared], owner[shared]
        order = np.argsort(owner, kind="stable")
        item, owner = item[order], owner[order]
        size = self.size[rows]
        at = 0
        while at < len(rows):
            rest = len(rows) - at
            end = min(len(rows), at + max(1, CELLS // rest))
            lo, mid = np.searchsorted(owner, (at, end))
            inside = np.unique(item[lo:mid])
            place = np.minimum(np.searchsorted(inside, item[lo:]), max(0, len(inside) - 1))
            hit = inside[place] == item[lo:] if len(inside) else np.zeros(len(item) - lo, bool)
            place, row = place[hit], owner[lo:][hit] - at
            by = np.argsort(place, kind="stable")
            place, row = place[by], row[by]
            both = np.zeros((end - at, rest), np.float32)
            width = max(1, min(8192, 2 * CELLS // rest))
            for first in range(0, len(inside), width):
                x, y = np.searchsorted(place, (first, first + width))
                block = np.zeros((rest, min(width, len(inside) - first)), np.float32)
                block[row[x:y], place[x:y] - first] = 1
                both += block[:end - at] @ block.T
            sizes = size[at:].astype(np.float32)
            a, b = np.nonzero(5 * both >= 4 * (sizes[:end - at, None] + sizes[None, :] - both))
            later = a < b
            yield a[later] + at, b[later] + at
            at = end


CELLS = 1 << 22
PIVOTS, SMALL, EPS = 8, 48, 0.2


def region_links(sets: list[np.ndarray], together: tuple[int, ...] = ()) -> list[tuple[int, int]]:
    """Pairs (positions) of similarity 0.8 or more, enough of them to join all that links join. The positions in
    `together` are known to be joined.

    Pivots are drawn, every set goes to the region of its nearest pivot and, where its distance to another pivot is
    larger by no more than 2 * 0.2, as a boundary set to that region too; two linked sets thus share a region. Regions
    are joined the same way until they are small or stop shrinking; then all their pairs are compared. Sets linked to
    the same pivot are joined through it.
    """
    members = Members(sets)
    parent = list(range(len(sets)))
    links: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a: int, b: int) -> None:
        p, q = root(a), root(b)
        if p != q:
            parent[p] = q
            links.append((a, b))

    def near(distance: np.ndarray) -> np.ndarray:
        return distance <= EPS + 1e-12  # ratios of whole numbers: equal or apart by far more

    for x in together[1:]:
        parent[root(x)] = root(together[0])
    todo = [np.arange(len(sets))]
    while todo:
        rows = todo.pop()
        if len(rows) > 1 and len({root(int(r)) for r in rows}) == 1:
            continue  # all joined already
        if len(rows) > SMALL:
            chosen, dist = [int(rows[np.argmax(members.size[rows])])], []
            for _ in range(PIVOTS):
                dist.append(members.distances(chosen[-1], rows))
                for r in rows[near(dist[-1])]:
                    join(chosen[-1], int(r))
                chosen.append(int(rows[np.min(dist, 0).argmax()]))
            d = np.stack(dist)
            home = d.min(0)
            parts = [rows[d[k] <= home + 2 * EPS + 1e-9] for k in range(len(d))]
            if max(map(len, parts)) < 0.7 * len(rows):
                todo.extend(parts)
                continue
        for a, b in members.linked(rows):
            tops = np.array([root(int(r)) for r in rows])
            new = tops[a] != tops[b]
            for x, y in zip(rows[a[new]].tolist(), rows[b[new]].tolist()):
                join(x, y)
    return links
