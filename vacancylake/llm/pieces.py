"""SentencePiece ids with the source span of every piece, and back to text."""
from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from vacancylake.llm.common import bounded_batches

BLANK = "▁"  # stands for a space in pieces
CHUNK = 500  # distinct words that one library call encodes
PARTS = "\x1f"  # parts words; texts that hold it themselves are encoded whole


class CharMap:
    """The compiled character map of a model: a double-array trie of prefixes and their replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.texts = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes used) of the longest listed prefix of data[at:]."""
        if not self.units:
            return None
        unit = self.units[0]
        node, found = (unit >> 10) << ((unit & 512) >> 6), None
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (self.units[node] & 0x7FFFFFFF, k + 1 - at)
        if found is None:
            return None
        return self.texts[found[0]:self.texts.index(b"\0", found[0])], found[1]


def normalise(text: str, charmap: CharMap, dummy_prefix: bool, squeeze: bool, escape: bool = True) -> tuple[bytes, list[int]]:
    """(normalised bytes, source byte offset of each of them and of the end)."""
    data, out, align, at = text.encode(), bytearray(), [], 0
    blank = BLANK.encode() if escape else b" "

    def prefix(at: int) -> tuple[bytes, int]:
        hit = charmap.longest(data, at)
        if hit is None:
            n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            hit = data[at:at + n], n
        return hit

    def put(part: bytes, step: int = 0) -> None:
        out.extend(part)
        align.extend(at + step * k for k in range(len(part)))

    while squeeze and at < len(data) and prefix(at)[0] == b" ":
        at += prefix(at)[1]
    if at == len(data):
        return b"", [at]
    if dummy_prefix:
        put(blank)
    after_space = squeeze
    while at < len(data):
        part, used = prefix(at)
        if after_space:
            part = part.lstrip(b" ")
        if part:
            if part == data[at:at + used] and b" " not in part:
                put(part, 1)  # unchanged: byte by byte
            else:
                for byte in part:
                    put(blank if byte == 32 else bytes([byte]))
            after_space = squeeze and part.endswith(b" ")
        at += used
    while squeeze and out.endswith(blank):
        del out[-len(blank):]
        at = align[-len(blank)]
        del align[-len(blank):]
    return bytes(out), [*align, at]


class PieceEncoder:
    """The library's ids. Where the vocabulary has no piece across a space or line break and nothing is normalised away,
    each distinct word is encoded once per batch; other texts are encoded whole."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.lib = SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.charmap = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        byte = model.SentencePiece.BYTE
        self.norm_size = np.array([1 if p.type == byte else len(p.piece.encode()) for p in model.pieces])
        self.source_size = self.norm_size - np.array([0 if p.type == byte else 2 * p.piece.count(BLANK) for p in model.pieces])
        crossing = any(BLANK in p.piece.lstrip(BLANK) or "\n" in p.piece for p in model.pieces)
        self.lead = self.lib.encode("\n")
        plain = not spec.precompiled_charsmap and self.dummy and self.escape and not self.squeeze and model.trainer_spec.byte_fallback
        self.by_word = plain and not crossing and len(self.lead) == 2

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first place, number) of distinct words without line breaks; line breaks part them in one text."""
        line = self.lead[1]
        texts = ["\n" + "\n".join(words[a:a + CHUNK]) for a in range(0, len(words), CHUNK)]
        ids = [np.array([*own[1:], line], np.int32) for own in self.lib.encode(texts, num_threads=1)]
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        stops = np.flatnonzero(flat == line)
        ends = np.cumsum([0] + [len(x) for x in ids])
        last = np.isin(stops, ends[1:] - 1)
        first = stops[~last] + 1
        return flat, first, stops[1:][~last[:-1]] - first

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text starts plus the end)."""
        odd = [not self.by_word or t[:1] == " " or "  " in t or BLANK in t or PARTS in t for t in texts]
        marked = ["" if o or not t else (" " + t).replace(" ", PARTS + " ").replace("\n", f"{PARTS}\n{PARTS}") for t, o in zip(texts, odd)]
        lists = pc.split_pattern(pa.array(marked, pa.large_string()), PARTS)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        first, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        own = np.array([i for i, w in enumerate(words) if w and w != "\n"], np.int64)
        ids, first[own], number[own] = self._words([words[i] for i in own])
        if "\n" in words:
            k = words.index("\n")
            first[k], number[k] = len(ids), 1
            ids = np.append(ids, np.int32(self.lead[1]))
        run = coded.indices.to_numpy()
        n = number[run]
        ends = np.concatenate(([0], np.cumsum(n)))
        flat = ids[np.arange(ends[-1]) + np.repeat(first[run] - ends[:-1], n)]
        ends = ends[lists.offsets.to_numpy()]
        if not any(odd):
            return flat, ends
        whole = {i: np.array(x, np.int32) for i, x in zip(np.flatnonzero(odd), self.lib.encode([t for t, o in zip(texts, odd) if o], num_threads=1))}
        parts = [whole[i] if odd[i] else flat[ends[i]:ends[i + 1]] for i in range(len(texts))]
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.cumsum([0] + [len(p) for p in parts])

    def span_ends(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Source byte offset at which each piece ends; a piece starts where the one before it ends, the first at 0.

        The dummy blank in front takes no bytes, so a piece made of it alone is empty. Where nothing is normalised, a
        blank is one byte and the offsets are sums of sizes; else each boundary goes through the normaliser's alignment.
        """
        if not len(ids):
            return np.zeros(0, np.int64)
        if self.by_word and BLANK not in text:
            return np.cumsum(self.source_size[ids]) - 1
        norm, align = normalise(text, self.charmap, self.dummy, self.squeeze, self.escape)
        sizes = self.norm_size[ids]
        if (ids == self.lib.unk_id()).any():  # an unknown piece is as long as its text
            sizes = np.array([len(p.encode()) if i == self.lib.unk_id() else n for p, i, n in zip(self.lib.encode(text, out_type=str), ids, sizes)])
        return np.array(align)[np.minimum(np.cumsum(sizes), len(norm))]


@lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


KINDS = {"n_tokens": LongType(), "ids": ArrayType(IntegerType()), "span_ends": ArrayType(LongType()), "decoded": StringType(),
         "ids_sha256": StringType(), "decoded_sha256": StringType(), "spans_crc32": LongType()}


def encode(docs: DataFrame, model: str, fields: tuple[str, ...] = ("ids", "span_ends", "decoded"), keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep plus the asked fields for each row of docs.

    ids: the library's, without begin or end ids. span_ends: source byte offset where each piece ends (see
    PieceEncoder.span_ends). decoded: the library's text of the ids. *_sha256 and spans_crc32 are digests of these.
    Null counts as empty: no ids, empty text. Very long texts are encoded whole; repeated rows and null ids give a row
    each; other columns are not read; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    kind = StructType()
    for name in fields:
        kind.add(name, KINDS[name])

    @F.pandas_udf(kind)
    def run(part: pd.Series) -> pd.DataFrame:
        own, texts = encoder(model), [t or "" for t in part]
        flat, ends = own.encode(texts)
        ids = [flat[a:b] for a, b in zip(ends, ends[1:])]
        out: dict[str, list] = {"n_tokens": np.diff(ends)}
        if "ids" in fields:
            out["ids"] = ids
        if {"span_ends", "spans_crc32"} & set(fields):
            spans = [own.span_ends(t, i) for t, i in zip(texts, ids)]
            out |= {"span_ends": spans, "spans_crc32": [zlib.crc32(s.astype("<u4").tobytes()) for s in spans]}
        if {"decoded", "decoded_sha256"} & set(fields):
            decoded = own.lib.decode([i.tolist() for i in ids], num_threads=1) if texts else []
            out |= {"decoded": decoded, "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for d in decoded]}
        if "ids_sha256" in fields:
            listed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat, pa.int32()).cast(pa.string())), ",")
            out["ids_sha256"] = [hashlib.sha256(x.as_buffer()).hexdigest() for x in listed]
        return pd.DataFrame({k: pd.Series(list(out[k]), dtype=object if k not in ("n_tokens", "spans_crc32") else "int64") for k in fields})

    return docs.select(*keep, run(F.col(text)).alias("r")).select(*keep, "r.*")
