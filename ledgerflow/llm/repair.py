"""Token ids in grammar-compressed shard files (Re-Pair), with random access.

Documents are range-partitioned by id, so shards hold ascending ids. Each shard is a list of blocks of about
`block_ids` ids, each with a grammar of its own, so a worker holds one block. In a block, frequent adjacent pairs are replaced by
nonterminals, from the most frequent down, until no pair has `min_count` places left; pairs never cross the end of a
document. At the default of 6 a rule (12 bytes) costs what its places save (two bytes each). The block stores its rules,
the expansion length of every rule, the compressed sequence and the document boundaries, so any range of ids of any
document is decoded without expanding the rest.

File format: Parquet rows (shard, block, shard_start, n_ids, payload); payload is little-endian:
    magic "RPG1", then unsigned 32-bit: base (first nonterminal), rules R, documents D, symbols S, width in bytes
    R x 2 unsigned 32-bit left and right, R x unsigned 32-bit expansion lengths,
    D x signed 64-bit doc ids, D x 1 byte null flag, D x unsigned 32-bit lengths in ids, D x unsigned 32-bit lengths in symbols,
    S symbols of `width` bytes.
Spark's writer commits the files, so lost executors leave no half-written shard.

Defined results: null and empty texts hold the end id alone; repeated rows are stored each; a null doc_id
sorts first; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, column, id_text, shared_dir, texts_of
from .encoding import CACHE_MB, encoder, groups_of

MAGIC = b"RPG1"
SHARD = "shard int, block int, shard_start long, n_ids long, payload binary"
DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"


#: Pairs are first counted by a hash of so many values; a slot's count is at least that of each of its pairs.
SLOTS = 1 << 20


def _slots(left: np.ndarray, right: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The slot of each pair; SLOTS where the left symbol ends a document."""
    out = ((left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA6B)) >> np.uint32(12)).astype(np.int64)
    out[last] = SLOTS
    return out


def compress(ids: np.ndarray, lengths: np.ndarray, base: int, min_count: int, ease: float | None):
    """(symbols, lengths in symbols, rules as pairs). ids: of all documents, one after the other.

    A pair's count is that of its places from the left that do not overlap. Pairs are replaced from the most frequent
    down (ties: the smaller pair), with counts updated after each step, until none is left with `min_count` places. A step takes the
    one most frequent pair (ease None: plain Re-Pair), or all pairs at or above the level, which starts at `ease`
    times the highest count and falls by that factor; where such pairs overlap, the more frequent one has the place.
    Symbols are a linked list, closed up when a third of them is gone."""
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(symbols), bool)  # of a document: no pair crosses it
    last[np.cumsum(lengths) - 1] = True
    slot = _slots(symbols, np.roll(symbols, -1), last)
    seen = np.bincount(slot, minlength=SLOTS + 1).astype(np.int32)
    rules: list[np.ndarray] = []
    made, level = 0, np.iinfo(np.int64).max

    def linked():
        n = len(symbols)
        return np.arange(1, n + 1), np.arange(-1, n - 1), np.zeros(n, bool), np.zeros(n, bool)

    after, before, dead, mark = linked()
    gone = 0
    while True:
        seen[SLOTS] = 0
        top = int(seen.max())
        if top < min_count:
            break
        level = max(min_count, min(int(level * ease), math.ceil(top * ease))) if ease else top
        while True:
            at = np.flatnonzero((seen >= level).take(slot, mode="clip"))
            pairs, which = np.unique(symbols[at].astype(np.uint64) << np.uint64(32) | symbols[after[at]], return_inverse=True)
            again = np.zeros(len(at), bool)
            again[1:] = (at[1:] == after[at[:-1]]) & (which[1:] == which[:-1])
            place = np.arange(len(at), dtype=np.int32)  # a block has fewer
            free = (place - np.maximum.accumulate(np.where(again, np.int32(0), place))) & 1 == 0
            counts = np.bincount(which[free], minlength=len(pairs))
            if (counts >= level).any() or level <= min_count:
                break
            level = max(min_count, int(level * ease) if ease else max(int(counts.max(initial=0)), int(seen[seen < level].max(initial=0))))
        if not (counts >= level).any():
            break
        rank = np.empty(len(pairs), np.int64)
        order = np.argsort(-counts, kind="stable")
        rank[order] = np.arange(len(pairs))
        chosen = counts[which] >= level if ease else rank[which] == 0
        at, r, again, free = at[chosen], rank[which[chosen]], again[chosen], free[chosen]
        head = np.flatnonzero(~again)  # of each run of one pair
        touch = at[head[1:]] == after[at[head[1:] - 1]]
        wins = np.ones(len(head), bool)
        wins[1:] &= ~touch | (r[head[1:]] < r[head[:-1]])
        wins[:-1] &= ~touch | (r[head[:-1]] < r[head[1:]])
        kept = free & wins[np.cumsum(~again) - 1]
        at, r = at[kept], r[kept]
        places = np.bincount(r, minlength=len(pairs))
        good = np.flatnonzero(places >= min_count)  # the most frequent pair loses no place, so there is one
        name = np.zeros(len(pairs), np.uint32)
        name[good] = base + made + np.arange(len(good))
        own = name[r] > 0
        at, r = at[own], r[own]
        second, prior = after[at], before[at]
        mark[at] = mark[second] = mark[prior[prior >= 0]] = True  # positions whose pair changes
        few = len(at) < len(symbols) // 24  # then counts are updated in place, else made anew
        touched = np.flatnonzero(mark)
        if few:
            np.subtract.at(seen, slot[touched], 1)
        symbols[at] = name[r]
        last[at] |= last[second]
        then = after[second]
        after[at] = then
        inside = then < len(symbols)
        before[then[inside]] = at[inside]
        slot[second], dead[second], mark[second] = SLOTS, True, False
        fresh = touched[mark[touched]]
        mark[fresh] = False
        slot[fresh] = _slots(symbols[fresh], symbols[np.minimum(after[fresh], len(symbols) - 1)], last[fresh])
        if few:
            np.add.at(seen, slot[fresh], 1)
        else:
            seen = np.bincount(slot, minlength=SLOTS + 1).astype(np.int32)
        gone += len(at)
        if 3 * gone > len(symbols):
            symbols, last, slot = symbols[~dead], last[~dead], slot[~dead]
            after, before, dead, mark = linked()
            gone = 0
        own = pairs[order[good]]
        rules.append(np.stack([own >> np.uint64(32), own & np.uint64(0xFFFFFFFF)], axis=1).astype(np.int64))
        made += len(good)
    table = np.concatenate(rules) if rules else np.empty((0, 2), np.int64)
    return symbols[~dead].astype(np.int64), np.diff(np.flatnonzero(last[~dead]), prepend=-1), table


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    out = np.ones(len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = (out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1)
    return out


def write_block(doc_ids: list, docs: list[bytes], base: int, min_count: int, ease: float | None) -> bytes:
    lengths = np.array([len(d) // 4 for d in docs], np.int64)
    ids = np.frombuffer(b"".join(docs), "<u4")
    base = max(base, int(ids.max(initial=0)) + 1)
    symbols, in_symbols, rules = compress(ids, lengths, base, min_count, ease)
    width = 2 if base + len(rules) <= 65536 else 4
    return b"".join((
        MAGIC, struct.pack("<5I", base, len(rules), len(docs), len(symbols), width),
        rules.astype("<u4").tobytes(), expansion_lengths(rules, base).astype("<u4").tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), bytes(x is None for x in doc_ids),
        lengths.astype("<u4").tobytes(), in_symbols.astype("<u4").tobytes(), symbols.astype(f"<u{width}").tobytes(),
    ))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each run, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


class Block:
    """A payload read back."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a shard block")
        self.base, n_rules, n_docs, n_symbols, width = struct.unpack_from("<5I", payload, 4)
        at = 24

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take(2 * n_rules, "<u4").reshape(-1, 2).astype(np.int64)
        self.expansion = take(n_rules, "<u4").astype(np.int64)
        doc_ids, null = take(n_docs, "<i8"), take(n_docs, "u1")
        self.doc_ids = [None if z else d for d, z in zip(doc_ids.tolist(), null.tolist(), strict=True)]
        self.lengths, self.in_symbols = take(n_docs, "<u4").astype(np.int64), take(n_docs, "<u4").astype(np.int64)
        self.symbols = take(n_symbols, f"<u{width}").astype(np.int64)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Terminals of a run of symbols; each pass opens one level of rules."""
        while len(high := np.flatnonzero(symbols >= self.base)):
            pair = self.rules[symbols[high] - self.base]
            places = np.arange(len(symbols))
            step = np.zeros(len(symbols), np.int64)
            step[high] = 1
            places += np.cumsum(step) - step
            out = np.empty(len(symbols) + len(high), np.int64)
            out[places] = symbols
            out[places[high]], out[places[high] + 1] = pair[:, 0], pair[:, 1]
            symbols = out
        return symbols

    def all_ids(self) -> np.ndarray:
        """All rules are expanded once, the shallow ones first, and then copied to their places."""
        depth = np.zeros(len(self.rules), np.int64)
        for k, (a, b) in enumerate(self.rules.tolist()):
            depth[k] = 1 + max(depth[a - self.base] if a >= self.base else 0, depth[b - self.base] if b >= self.base else 0)
        size = self.expansion
        first = np.cumsum(size) - size
        table = np.empty(int(size.sum()), np.int64)
        left = np.where(self.rules[:, 0] >= self.base, size[np.maximum(self.rules[:, 0] - self.base, 0)], 1) if len(size) else size
        for d in range(1, int(depth.max(initial=0)) + 1):
            own = np.flatnonzero(depth == d)
            for side, shift in ((0, 0), (1, left[own])):
                child, to = self.rules[own, side], first[own] + shift
                low = child < self.base
                table[to[low]] = child[low]
                rule = child[~low] - self.base
                table[_runs(to[~low], size[rule])] = table[_runs(first[rule], size[rule])]
        high = self.symbols >= self.base
        rule = self.symbols[high] - self.base
        counts = np.ones(len(self.symbols), np.int64)
        counts[high] = size[rule]
        out = np.repeat(self.symbols, counts)
        out[np.repeat(high, counts)] = table[_runs(first[rule], size[rule])]
        return out.astype("<u4")

    def ids(self, doc: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """ids first..last of one document; only the symbols that cover them are expanded."""
        last = int(self.lengths[doc]) if last is None else min(last, int(self.lengths[doc]))
        lo = int(self.in_symbols[:doc].sum())
        own = self.symbols[lo : lo + int(self.in_symbols[doc])]
        size = np.ones(len(own), np.int64)
        high = own >= self.base
        size[high] = self.expansion[own[high] - self.base]
        ends = np.cumsum(size)
        a, b = int(np.searchsorted(ends, first, "right")), int(np.searchsorted(ends, last, "left"))
        skip = int(ends[a] - size[a]) if a < len(own) else 0
        return self.expand(own[a : b + 1])[first - skip : max(last, first) - skip].astype("<u4")


def write_shards(docs: DataFrame, path: str, out: str, end_id: int = 1, shards: int | None = None, block_ids: int = 1 << 20, min_count: int = 6, ease: float | None = 0.25, id_col: str = "doc_id", text_col: str = "text", cache_mb: int = CACHE_MB) -> None:
    """Encodes every whole text and writes shard files to the folder `out`, in ascending doc_id order."""
    rows = id_text(docs, id_col, text_col)
    n = shards or max(rows.rdd.getNumPartitions(), 1)

    def run(batches):
        shard, block, total = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        data: list[bytes] = []
        size = 0
        end = np.array([end_id], "<u4").tobytes()
        enc = encoder(path, cache_mb)
        base = enc.tokenizer.get_vocab_size()

        def flush():
            nonlocal block, total, ids, data, size
            payload = write_block(ids, data, base, min_count, ease)
            row = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (block, pa.int32()), (total, pa.int64()), (size, pa.int64()), (payload, pa.binary()))], names=[x.split()[0] for x in SHARD.split(", ")])
            block, total, ids, data, size = block + 1, total + size, [], [], 0
            return row

        for batch in bounded(batches):
            texts, doc_ids = texts_of(batch), column(batch, "doc_id").to_pylist()
            for lo, hi in groups_of(texts):
                for doc_id, own in zip(doc_ids[lo:hi], enc.encode(texts[lo:hi]), strict=True):
                    ids.append(doc_id)
                    data.append(own + end)
                    size += len(own) // 4 + 1
                    if size >= block_ids:
                        yield flush()
        if ids:
            yield flush()

    # the tie tells rows of one id apart, so that an id with very many rows is more than one shard
    tied = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    tied.select("doc_id", "text").mapInArrow(run, SHARD).write.option("compression", "zstd").parquet(out)


def shard_starts(spark: SparkSession, folder: str) -> dict[int, int]:
    """ids before each shard; one number a shard comes to the driver."""
    totals = sorted((r["shard"], r["n"]) for r in spark.read.parquet(folder).groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    return dict(zip([s for s, _ in totals], accumulate((n for _, n in totals), initial=0), strict=False))


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it), n_tokens, ids_crc32 of the decoded ids."""
    starts = spark.sparkContext.broadcast(shard_starts(spark, folder))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["payload"])
                data = block.all_ids().tobytes()
                ends = np.cumsum(block.lengths)
                first = starts.value[row["shard"]] + row["shard_start"]
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), block.lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, pa.int64()), pa.array(first + ends - block.lengths), pa.array(block.lengths), pa.array(crc, pa.int64())], names=[x.split()[0] for x in DECODED.split(", ")])

    return spark.read.parquet(folder).select("shard", "shard_start", "payload").mapInArrow(run, DECODED)


def encode_and_read_back(docs: DataFrame, path: str, end_id: int = 1, **options) -> DataFrame:
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/repair-{uuid.uuid4().hex}"
    write_shards(docs, path, folder, end_id, **options)
    return read_shards(spark, folder)
