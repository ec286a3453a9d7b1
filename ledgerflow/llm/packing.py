"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Piece lengths are integers from 1 to the capacity, so the whole instance is a histogram of at most `capacity`
classes, whatever the corpus holds; the driver solves that histogram and never sees a document.

1. Reduction. With j a class and r the room beside one piece of it: if nothing fits in r, j stays alone; if a piece
   of exactly r exists, the pair {j, r} dominates every other set with j; so does {j, i}, i the longest piece
   that fits, if no two pieces fit in r together, or no three do and no two are longer than i together. Such sets are
   fixed for good, as many at a time as the counts allow, and the instance shrinks. All classes are tried, from the
   longest, again and again until none has a dominating set.
2. Best fit decreasing on the rest, by class: sequences with equal room are one group with a count.

Each step says which of a class's pieces (by rank) go to which sequences at which offset. Pieces get their
rank in their class without moving: a task numbers its own pieces by class while it tokenises, and a
running sum over tasks of the (task, class) counts gives where a task starts.

Defined results: null and empty texts are one piece holding id 0 alone; repeated rows are packed each;
a null doc_id is packed as any other; an empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, column, id_text, saved, texts_of
from .encoding import CACHE_MB, encoder, groups_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: only the first may be short."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


class Plan:
    """Runs of pieces: of class `length`, ranks from `first` on, `each` to a sequence, from sequence `seq` on,
    the first at `offset`."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self.used: dict[int, int] = defaultdict(int)
        self.sequences = 0
        self.fixed = 0  # pieces placed by the reduction

    def put(self, length: int, seq: int, sequences: int, each: int, offset: int) -> None:
        self.runs[length].append((self.used[length], each, seq, offset))
        self.used[length] += sequences * each

    def opened(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n


def best_pair(keys: list[int], left: dict[int, int], j: int, room: int) -> int:
    """The largest sum within the room of two pieces other than one of class j; 0 if no two fit."""
    others = [k for k in keys if k != j or left[k] > 1]
    best, low, high = 0, 0, len(others) - 1
    while low <= high:
        a, b = others[low], others[high]
        if a + b > room:
            high -= 1
            continue
        if low != high or left[a] - (a == j) > 1:
            best = max(best, a + b)
        low += 1
    return best


def reduced(counts: dict[int, int], capacity: int, plan: Plan) -> dict[int, int]:
    """Fixes dominating sets in the plan; returns the counts that are left."""
    left = {k: n for k, n in counts.items() if n}
    keys = sorted(left)

    def take(k: int, n: int) -> None:
        left[k] -= n
        if not left[k]:
            del left[k]
            keys.pop(bisect_left(keys, k))

    def smallest(j: int) -> list[int]:
        """The three shortest pieces besides one of class j."""
        out: list[int] = []
        for k in keys:
            out += [k] * min(3, left[k] - (k == j))
            if len(out) >= 3:
                break
        return out[:3]

    def fix(j: int) -> bool:
        room, n, small = capacity - j, left[j], smallest(j)
        if not small or small[0] > room:
            plan.put(j, plan.opened(n), n, 1, 0)
            take(j, n)
            return True
        at = bisect_left(keys, room + 1) - 1
        if keys[at] == j and n == 1:
            at -= 1
        i = keys[at]
        if i != room and len(small) > 1 and small[0] + small[1] <= room and ((len(small) > 2 and sum(small) <= room) or i < best_pair(keys, left, j, room)):
            return False  # two or more might do better beside j than the longest that fits
        if i == j:
            m = n // 2
            plan.put(j, plan.opened(m), m, 2, 0)
            take(j, 2 * m)
            return True
        m = min(n, left[i])
        seq = plan.opened(m)
        plan.put(j, seq, m, 1, 0)
        plan.put(i, seq, m, 1, j)
        take(j, m)
        take(i, m)
        return True

    again = True
    while again:
        again = False
        for j in sorted(left, reverse=True):
            while j in left and fix(j):
                again = True
    plan.fixed = sum(counts.values()) - sum(left.values())
    return left


def best_fit(left: dict[int, int], capacity: int, plan: Plan) -> None:
    """Best fit decreasing, piece by piece in effect, group by group in cost."""
    rooms: list[int] = []  # sorted, distinct
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, sequences)

    def give(room: int, seq: int, n: int) -> None:
        if n and room:
            if not groups[room]:
                insort(rooms, room)
            groups[room].append((seq, n))

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                seq, m = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
            else:
                room = capacity
                m = -(-n // (capacity // length))
                seq = plan.opened(m)
            each = room // length
            full = min(m, n // each)
            if full:
                plan.put(length, seq, full, each, capacity - room)
                give(room - each * length, seq, full)
                n -= full * each
            if n and full < m:  # fewer pieces are left than the next sequence takes
                plan.put(length, seq + full, 1, n, capacity - room)
                give(room - n * length, seq + full, 1)
                full, n = full + 1, 0
            give(room, seq + full, m - full)


def solve(counts: dict[int, int], capacity: int) -> Plan:
    plan = Plan()
    best_fit(reduced(counts, capacity, plan), capacity, plan)
    return plan


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", cache_mb: int = CACHE_MB) -> DataFrame:
    """A row for each piece, with the task that made it and its rank in its class there."""

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in bounded(batches):
            texts, ids = texts_of(batch), column(batch, "doc_id").to_pylist()
            for lo, hi in groups_of(texts):
                rows: list[tuple] = []
                for doc_id, data in zip(ids[lo:hi], encoder(path, cache_mb).encode(texts[lo:hi]), strict=True):
                    data += end
                    at = 0
                    for k, length in enumerate(cut_lengths(len(data) // 4, capacity)):
                        rows.append((doc_id, k, at, length, zlib.crc32(data[4 * at : 4 * (at + length)]), part, int(seen[length])))
                        seen[length] += 1
                        at += length
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return id_text(docs, id_col, text_col).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cache_mb: int = CACHE_MB) -> DataFrame:
    """Packs every document; texts are tokenised once, only rows without texts are shuffled. cache_mb: of a worker's encoder."""
    made = saved(pieces(docs, path, capacity, end_id, id_col, text_col, cache_mb), "pieces")
    counts = saved(made.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    plan = solve({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    runs = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in plan.runs.items()}
    shipped = made.sparkSession.sparkContext.broadcast(runs)  # at most a few runs for each of `capacity` classes

    def place(batches):
        for batch in batches:
            length = column(batch, "length").to_numpy()
            rank = column(batch, "nth").to_numpy() + column(batch, "base").to_numpy()
            seq, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                first, each, seq0, offset0 = shipped.value[int(k)]
                r = np.searchsorted(first, rank[at], "right") - 1
                i = rank[at] - first[r]
                seq[at], offset[at] = seq0[r] + i // each[r], offset0[r] + i % each[r] * k
            kept = [column(batch, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(offset)], names=[x.split()[0] for x in PACKED.split(", ")])

    return made.join(base.hint("merge"), ["length", "part"]).mapInArrow(place, PACKED)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences than the tokens need, or than there are pieces over half the capacity."""
    return max(-(-sum(k * n for k, n in counts.items()) // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))
