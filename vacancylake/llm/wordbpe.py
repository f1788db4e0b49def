"""Word-level ids of a BPE vocabulary with word ends, many words at a time in numpy; other words go to the tokenizers library."""
from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NONE = np.iinfo(np.int32).max
REMEMBERED = 50_000  # words from the library that a worker keeps before it starts afresh
TABLE_BITS = 18


def byte_chars() -> dict[int, str]:
    """The usual printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Merge rules as an open hash table over pairs of ids."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        self.keys = np.full(1 << TABLE_BITS, -1, np.int64)
        self.rank = np.full(1 << TABLE_BITS, NONE, np.int32)
        self.into = np.array([m for _, _, m in pairs], np.int32)
        for r, (a, b, _) in enumerate(pairs):
            at = int(self._slot(np.array([a << 20 | b]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.rank[at] = a << 20 | b, r

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's rule, NONE without one."""
        key = a.astype(np.int64) << 20 | b
        at = self._slot(key)
        have = self.keys[at]
        out = np.where(have == key, self.rank[at], NONE)
        open_ = np.nonzero((have != key) & (have >= 0))
        while len(open_[0]):
            at[open_] = (at[open_] + 1) % len(self.keys)
            have = self.keys[at[open_]]
            hit = have == key[open_]
            out[tuple(x[hit] for x in open_)] = self.rank[at[open_]][hit]
            go = ~hit & (have >= 0)
            open_ = tuple(x[go] for x in open_)
        return out


class WordTokenizer:
    """encode() gives the ids that the library gives, without special tokens.

    The vocabulary's rules never join what white space parts, so a text's ids are those of its words. Words of letters
    whose lower case is simple are merged here, all words of a length in step: each round joins every word's pair of
    the lowest rank. Any other word is encoded by the library once and remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = byte_chars()
        self.inner = np.array([vocab.get(chars[b], -1) for b in range(256)], np.int32)
        self.final = np.array([vocab.get(chars[b] + end, -1) for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.plain = re.compile(r"[\x00-įı-ɏ]*").fullmatch  # letters whose lower case and composed form are simple
        self.known: dict[str, list[int]] = {}
        self.simple = bool(end) and min(self.inner.min(), self.final.min()) >= 0 and self._library(["AbÉ"]) == self._library(["abé"])

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words given as bytes data[start:start+size]: (ids of all words, each word's first place, its number)."""
        first, number = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        blocks, used = [np.zeros(0, np.int32)], 0
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            sym = data[start[rows][:, None] + np.arange(n)]
            sym = np.concatenate((self.inner[sym[:, :-1]], self.final[sym[:, -1:]]), 1)
            rank = self.merges.ranks(sym[:, :-1], sym[:, 1:])
            while True:
                width = sym.shape[1]
                at = rank.argmin(1) if width > 1 else np.zeros(len(sym), np.int64)
                done = rank[np.arange(len(rank)), at] == NONE if width > 1 else np.ones(len(sym), bool)
                own = rows[done]
                first[own], number[own] = used + width * np.arange(len(own)), width
                blocks.append(sym[done].ravel())
                used += width * len(own)
                if done.all():
                    break
                go = ~done
                rows, sym, rank, at = rows[go], sym[go], rank[go], at[go]
                k, cols = np.arange(len(rows)), np.arange(width - 1)
                new = self.merges.into[rank[k, at]]
                sym = sym[k[:, None], cols + (cols > at[:, None])]
                sym[k, at] = new
                if width > 2:
                    cols = cols[:-1]
                    rank = rank[k[:, None], cols + (cols >= at[:, None])]
                    left, right = at > 0, at < width - 2
                    rank[k[left], at[left] - 1] = self.merges.ranks(sym[k[left], at[left] - 1], new[left])
                    rank[k[right], at[right]] = self.merges.ranks(new[right], sym[k[right], at[right] + 1])
        return np.concatenate(blocks), first, number

    def _remembered(self, words: list[str]) -> list[list[int]]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list(set(words) - self.known.keys())
        self.known.update(zip(new, self._library(new)))
        return [self.known[w] for w in words]

    def _ids(self, words: pa.LargeStringArray, lowered: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Like _merged, for any distinct words. lowered: all are of simple letters in lower case."""
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        own = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False) if lowered else np.zeros(len(words), bool)
        first, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        ids, first[own], number[own] = self._merged(data, offsets[:-1][own], np.diff(offsets)[own])
        other = self._remembered(words.filter(pa.array(~own)).to_pylist())
        number[~own] = [len(x) for x in other]
        first[~own] = len(ids) + np.cumsum(number[~own]) - number[~own]
        return np.concatenate((ids, np.array([x for own in other for x in own], np.int32))).astype(np.uint32), first, number

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text starts plus the end)."""
        plain = [bool(self.simple and self.plain(t)) for t in texts]
        if all(plain) or not any(plain):
            return self._encode([t.lower() for t in texts] if all(plain) else texts, all(plain))
        parts = {}  # texts with other letters go apart, so that the rest stays simple
        for kind in (True, False):
            rows = [i for i, p in enumerate(plain) if p == kind]
            flat, ends = self._encode([texts[i].lower() if kind else texts[i] for i in rows], kind)
            parts |= {i: flat[a:b] for i, a, b in zip(rows, ends, ends[1:])}
        return np.concatenate([parts[i] for i in range(len(texts))]), np.cumsum([0] + [len(parts[i]) for i in range(len(texts))])

    def _encode(self, texts: list[str], lowered: bool) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        cores = pc.replace_substring_regex(coded.dictionary, r"^(\pL+)[.,!?;:]$", r"\1")  # punctuation after letters is a word of its own
        cut = pc.not_equal(cores, coded.dictionary)
        tails = pc.if_else(cut, pc.utf8_slice_codeunits(coded.dictionary, -1), "").cast(pa.large_string())
        both = pa.concat_arrays([cores, tails]).dictionary_encode()
        ids, first, number = self._ids(both.dictionary, lowered)
        two = both.indices.to_numpy().reshape(2, -1).T
        run = two[coded.indices.to_numpy()].ravel()
        n = number[run]
        ends = np.concatenate(([0], np.cumsum(n)))
        flat = ids[np.arange(ends[-1]) + np.repeat(first[run] - ends[:-1], n)]
        return flat, ends[2 * lists.offsets.to_numpy()]


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
