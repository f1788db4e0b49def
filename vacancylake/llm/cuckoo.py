"""Cuckoo filters over 16-byte keys as numpy tables: buckets of four 16-bit fingerprints, 0 is an empty slot."""
from __future__ import annotations

import numpy as np

SLOTS, LOAD, ROUNDS = 4, 0.8, 500


def buckets_for(keys: int) -> int:
    """Smallest power of two of buckets that holds this many keys under the load limit."""
    return 1 << max(0, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))


def empty(buckets: int) -> np.ndarray:
    return np.zeros((buckets, SLOTS), np.uint16)


def _places(keys: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    prints = (h[:, 1] & np.uint64(0xFFFF)).astype(np.int64)
    prints[prints == 0] = 1
    return (h[:, 0] & np.uint64(buckets - 1)).astype(np.int64), prints


def _other(bucket: np.ndarray, prints: np.ndarray, buckets: int) -> np.ndarray:
    return bucket ^ ((prints * 0x5BD1E995 >> 7) & (buckets - 1))


def contains(tab: np.ndarray, keys: list[bytes]) -> np.ndarray:
    b, f = _places(keys, len(tab))
    return (tab[b] == f[:, None]).any(1) | (tab[_other(b, f, len(tab))] == f[:, None]).any(1)


def _rank(bucket: np.ndarray) -> np.ndarray:
    """Place of each row among those of its bucket; bucket is sorted."""
    return np.arange(len(bucket)) - np.searchsorted(bucket, bucket)


def insert(tab: np.ndarray, keys: list[bytes]) -> bool:
    """Adds keys in place, all at once by rounds: fill free slots, try the other bucket, else push out a print. False if full."""
    b, f = _places(keys, len(tab))
    for turn in range(ROUNDS):
        if not len(b):
            return True
        order = np.argsort(b, kind="stable")
        b, f = b[order], f[order]
        used = tab[b] != 0
        rank, free = _rank(b), SLOTS - used.sum(1)
        fits = rank < free
        slot = np.argsort(used[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
        tab[b[fits], slot] = f[fits]
        b, f, rank = b[~fits], f[~fits], (rank - free)[~fits]
        if turn % 2:  # both buckets were full: one print of each bucket gives way
            out, at = rank == 0, turn // 2 % SLOTS
            old = tab[b[out], at].astype(np.int64)
            tab[b[out], at] = f[out]
            f[out] = old
        b = _other(b, f, len(tab))
    return False


def remove(tab: np.ndarray, keys: list[bytes]) -> None:
    """Takes out one print for each key; the keys must have been inserted."""
    b, f = _places(keys, len(tab))
    for _ in range(2 * SLOTS * max(1, len(keys))):
        if not len(b):
            return
        order = np.lexsort((f, b))
        b, f = b[order], f[order]
        first = _rank(b) == 0
        here = (tab[b] == f[:, None])
        take = first & here.any(1)
        tab[b[take], here[take].argmax(1)] = 0
        move = first & ~here.any(1)  # the print sits in the other bucket
        b = np.where(move, _other(b, f, len(tab)), b)[~take]
        f = f[~take]
