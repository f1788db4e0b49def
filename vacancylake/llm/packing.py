"""Packing of tokenised documents into fixed-length sequences by bin completion over the counts of piece lengths."""
from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from vacancylake.llm.common import bounded_batches, stored
from vacancylake.llm.wordbpe import tokenizer

LENGTH, END_ID = 2048, 0
CHUNK_CHARS = 2_000_000  # characters encoded at once, which bounds a worker's memory
FILLINGS, NODES, SEARCH = 3, 300, 2_000  # fillings tried at a branch, nodes to find them, fillings looked for after the first descent
SALT_ROWS, LEAST_SALTS = 100_000, 64

Filling = tuple[int, ...]  # lengths in a sequence, largest first


def _raw_ids(model: str, texts: list[str]) -> Iterator[bytes]:
    """Little-endian ids of each text and the end id; texts are encoded some megabytes at a time."""
    own, size = [], 0
    for k, t in enumerate(texts):
        own.append(t)
        size += len(t)
        if size >= CHUNK_CHARS or k + 1 == len(texts):
            flat, ends = tokenizer(model).encode(own)
            for a, b in zip(ends, ends[1:]):
                yield flat[a:b].tobytes() + END_ID.to_bytes(4, "little")
            own, size = [], 0


def pieces(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """keep + (piece, start, length, ids_crc32[, ids]): each document's ids and one end id, cut every `length` ids."""
    bounded_batches(docs.sparkSession, 1000)
    kind = StructType().add("start", "long").add("length", "long").add("ids_crc32", "long")
    if with_ids:
        kind.add("ids", ArrayType(IntegerType()))

    @F.pandas_udf(ArrayType(kind))
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for raw in _raw_ids(model, [t or "" for t in texts]):
            own = []
            for at in range(0, len(raw), 4 * length):
                part = raw[at:at + 4 * length]
                row = {"start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                own.append(row | {"ids": np.frombuffer(part, "<u4").astype(np.int32)} if with_ids else row)
            out.append(own)
        return pd.Series(out)

    made = docs.select(*keep, F.posexplode(cut(F.col(text))).alias("piece", "p"))
    return made.select(*keep, "piece", "p.*")


def fillings(largest: int, left: dict[int, int], sizes: list[int], room: int, nodes: int = NODES, most: int = FILLINGS) -> list[Filling]:
    """Undominated ways to fill a sequence around its largest piece, least waste first; only one if that wastes nothing.

    sizes: ascending lengths with counts above 0 in left. A filling is dominated if another piece still fits, or if one
    of its pieces can give way to a longer one that is left and fits. The search takes larger pieces first, so that the
    first filling found is the best-fit one; at each step it first looks for the piece that closes the gap.
    """
    left[largest] -= 1
    found: dict[Filling, int] = {}
    budget = nodes

    def dominated(own: list[int], waste: int) -> bool:
        for x in set(own):
            k = bisect_right(sizes, x + waste) - 1
            while sizes[k] > x:
                if left[sizes[k]] > 0:
                    return True
                k -= 1
        return False

    def fill(own: list[int], space: int, top: int) -> bool:
        """True once a filling without waste is found."""
        nonlocal budget
        if space == 0 or left.get(space, 0) > 0 and space <= top:
            found[tuple([*own, space] if space else own)] = 0
            return True
        k, leaf = bisect_right(sizes, min(space, top)) - 1, True
        while k >= 0 and budget > 0:
            s = sizes[k]
            k -= 1
            if left[s] > 0:
                leaf = False
                budget -= 1
                left[s] -= 1
                own.append(s)
                done = fill(own, space - s, s)
                own.pop()
                left[s] += 1
                if done:
                    return True
        if leaf and not any(left[s] > 0 for s in sizes[:bisect_right(sizes, space)]) and not dominated(own, space):
            found.setdefault(tuple(own), space)
        return False

    fill([], room - largest, room)
    left[largest] += 1
    ranked = sorted(found.items(), key=lambda x: (x[1], len(x[0])))[:1 if 0 in found.values() else most]
    return [(largest, *f) for f, _ in ranked] or [best_fit(largest, left, sizes, room)]


def best_fit(largest: int, counts: dict[int, int], sizes: list[int], room: int) -> Filling:
    """Greedy filling: again and again the longest piece that fits."""
    own, space, k = [largest], room - largest, len(sizes) - 1
    while space > 0 and k >= 0:
        k = min(k, bisect_right(sizes, space) - 1)
        if k < 0:
            break
        if counts[sizes[k]] - own.count(sizes[k]) > 0:
            own.append(sizes[k])
            space -= sizes[k]
        else:
            k -= 1
    return tuple(own)


def _times(filling: Filling, counts: dict[int, int]) -> int:
    return min(counts[s] // filling.count(s) for s in set(filling))


def _use(filling: Filling, n: int, left: dict[int, int], sizes: list[int]) -> None:
    for s in filling:
        left[s] -= n
    for s in set(filling):
        if not left[s]:
            sizes.remove(s)


def _greedy(left: dict[int, int], room: int) -> list[tuple[Filling, int]]:
    left, plan = dict(left), []
    sizes = sorted(s for s, n in left.items() if n)
    while sizes:
        f = best_fit(sizes[-1], left, sizes, room)
        plan.append((f, _times(f, left)))
        _use(*plan[-1], left, sizes)
    return plan


def lower_bound(counts: dict[int, int], room: int) -> int:
    """Fewest sequences possible: total volume, or pieces over half plus what cannot sit beside them, whichever is more."""
    number = np.zeros(room + 1, object)
    for s, n in counts.items():
        number[s] = n
    volume = number * np.arange(room + 1).astype(object)
    some, much = np.concatenate(([0], np.cumsum(number))), np.concatenate(([0], np.cumsum(volume)))  # of lengths below
    half, best = room // 2 + 1, -(-much[-1] // room)
    for k in range(half):
        big, mid = some[-1] - some[room - k + 1], some[room - k + 1] - some[half]
        free = mid * room - (much[room - k + 1] - much[half])
        best = max(best, big + mid + max(0, -(-(much[half] - much[k] - free) // room)))
    return int(best)


def complete_bins(counts: dict[int, int], room: int, search: int = SEARCH) -> list[tuple[Filling, int]]:
    """(filling, how often) that hold all pieces, in as few sequences as the search finds.

    Branch and bound over fillings around the largest piece left; a filling is used as often as the counts allow.
    Where the best filling wastes something, the others are branches to come back to. A branch ends when its waste is
    more than a better packing could have. The best-fit packing is the first incumbent; `search` bounds the fillings
    looked for after the first descent, and what a late branch has left is finished by best fit. Work depends on the
    number of distinct lengths, not on how many pieces there are.
    """
    counts = {s: n for s, n in counts.items() if n}
    best = _greedy(counts, room)
    fewest, bound = sum(n for _, n in best), lower_bound(counts, room)
    total = sum(s * n for s, n in counts.items())
    stack: list[tuple[dict[int, int], list[tuple[Filling, int]], int, int, Filling | None]] = [(counts, [], 0, 0, None)]
    first = True
    while stack and fewest > bound:
        left, plan, used, waste, f = stack.pop()
        left, plan = dict(left), list(plan)
        sizes = sorted(s for s, n in left.items() if n)
        while sizes and waste <= (fewest - 1) * room - total:
            if f is None:
                if not first and search <= 0:
                    rest = _greedy(left, room)
                    plan, used, sizes = plan + rest, used + sum(n for _, n in rest), []
                    break
                search -= not first
                f, *others = fillings(sizes[-1], left, sizes, room)
                stack.extend((dict(left), list(plan), used, waste, o) for o in reversed(others) if len(stack) < 1000)
            n = _times(f, left)
            plan.append((f, n))
            used, waste = used + n, waste + n * (room - sum(f))
            _use(f, n, left, sizes)
            f = None
        if not sizes and used < fewest:
            best, fewest = plan, used
        first = False
        if search <= 0:
            break
    return best


def slots(plan: list[tuple[Filling, int]]) -> dict[int, np.ndarray]:
    """Length to rows (first rank, copies in a sequence, first sequence, offset): where the pieces of a length go by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for f, n in plan:
        at = 0
        for s in sorted(set(f), reverse=True):
            k = f.count(s)
            rows.setdefault(s, []).append((ranks.get(s, 0), k, base, at))
            ranks[s] = ranks.get(s, 0) + k * n
            at += k * s
        base += n
    return {s: np.array(r, np.int64) for s, r in rows.items()}


def pack(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", length: int = LENGTH) -> DataFrame:
    """keep + (piece, start, length, ids_crc32, sequence_id, offset), one row for each piece.

    Null and empty texts are a single end id. Only documents of more than `length` ids are cut; of very long ones all
    pieces but the last fill a sequence each. Repeated rows are packed as often as they occur; null ids are kept.
    Other columns are not read; an empty table gives an empty result.

    Only the counts of the lengths (at most `length` numbers) reach the driver. Pieces of a length are ranked in salted
    parts with the parts' sizes summed up, so a length that a third of all pieces share is no single task's work.
    """
    own = stored(pieces(docs, model, keep, text, length), "pieces")
    counts = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(complete_bins(counts, length))
    salts = max(LEAST_SALTS, sum(counts.values()) // SALT_ROWS)
    salted = own.withColumn("salt", F.pmod(F.xxhash64(*keep, "piece", "ids_crc32"), F.lit(salts)))
    parts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy(*keep, "piece", "ids_crc32")
    ranked = salted.withColumn("within", F.row_number().over(inside) - 1).join(parts, ["length", "salt"])

    @F.pandas_udf(StructType().add("sequence_id", "long").add("offset", "long"))
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for size, rank in batches:
            size, rank = size.to_numpy(np.int64), rank.to_numpy(np.int64)
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(size) else ():
                rows, r = table[int(size[at[0]])], rank[at]
                hit = rows[np.searchsorted(rows[:, 0], r, "right") - 1]
                seq[at] = hit[:, 2] + (r - hit[:, 0]) // hit[:, 1]
                off[at] = hit[:, 3] + (r - hit[:, 0]) % hit[:, 1] * size[at]
            yield pd.DataFrame({"sequence_id": seq, "offset": off})

    made = ranked.select(*keep, "piece", "start", "length", "ids_crc32", place("length", F.col("before") + F.col("within")).alias("at"))
    return made.select(*keep, "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
