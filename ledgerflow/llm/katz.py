"""Katz backoff language model: Good-Turing discounted n-gram counts, exactly normalised backoff, evaluated recursively.

    P(w | h) = d(c(hw)) c(hw) / c(h)  if c(hw) > 0,   else a(h) P(w | h')   (h' = h without its first token; a = 1 if c(h) = 0)
    P(w)     = d(c(w)) c(w) / N       if c(w) > 0,    else the unseen mass, that of one unknown token
    a(h)     = (1 - sum of P(w | h) over seen w) / (1 - sum of P(w | h') over the same w)

A history is up to order - 1 tokens, or what there is back to the start symbol. d(r) is Katz's Good-Turing discount of each order for r
up to 5 and 1 beyond; where the counts of counts do not give a value in (0, 1), absolute discounting by one half
stands in. A history whose seen followers would take all mass keeps 1 / (c + 1) for the others. So for every
history the probabilities of the known tokens and of the unknown token sum to 1.

Texts become blocks of about `block_tokens` tokens: document rows with a local dictionary. A block asks once for
each distinct word and n-gram it holds (hashes, sorted, delta-coded; those of n-grams keep 56 bits); requests are dealt by hash
into buckets, where the training counts of all blocks are added up. The answers, stored as tables partitioned by block
and bucket, go back to the blocks. So a frequent n-gram is one entry a block, never one a document. An n-gram that only one block asked for is
alone, and so is every longer one that holds it: their counts and weights are the block's own and need no message. One
block, the owner, adds each seen n-gram's share to the sums of its history's backoff weight. Blocks and buckets are bounded,
their numbers and the partitions they are dealt to grow with the input.

Defined results: null and empty texts are the end token alone; repeated rows are counted and scored each; a null
doc_id is scored but neither held out nor learned from; with nothing to learn from, N and V are 0 and every token is unknown.
"""

from __future__ import annotations

import gc
import struct
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bounded, column, crc32_of_id, id_text, mix64, saved, texts_of

TOP = 5  # counts up to this are discounted
END, BOS = b" ", b"\n"  # no word holds white space
BOS_HASH = np.uint64(xxh64_intdigest(BOS))
MESSAGE = "kind string, block long, bucket int, payload binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, each compressed."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.size else b""
        data = zstandard.compress(planes, 1)
        out += [struct.pack("<3sQQ", a.dtype.str[-2:].encode().ljust(3), a.size, len(data)), data]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(n):
        kind, size, length = struct.unpack_from("<3sQQ", data, at)
        at += 19
        dtype = np.dtype("<" + kind.decode().strip())
        planes = zstandard.decompress(data[at : at + length]) if size else b""
        at += length
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype) if size else np.empty(0, dtype))
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0)) if len(x) else x


def undeltas(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint64)


def slices(hashes: np.ndarray, buckets: int):
    """(bucket, lo, hi) of sorted hashes; a bucket is a range of them."""
    if not len(hashes):
        return
    own = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edge = np.flatnonzero(np.diff(own, prepend=-1))
    for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(own)], strict=True):
        yield int(own[lo]), lo, hi


class _Local(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def block_rows(docs: DataFrame, held, train, block_tokens: int) -> DataFrame:
    """MESSAGE rows of kind T: ids, null, held, train, tokens a document; dictionary hashes; tokens (end included)."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        vocab, rows, tokens, size = _Local({END: 0, BOS: 1}), [], [], 0

        def flush():
            nonlocal vocab, rows, tokens, size, seq
            ids, h, t = zip(*rows, strict=True)
            hashes = np.fromiter(map(xxh64_intdigest, vocab), np.uint64, len(vocab))
            own = np.concatenate(tokens)
            seen = np.bincount(own, minlength=len(hashes))
            seen[:2] = len(own) + 1  # the end and the start keep their places; other words are numbered by frequency, which packs well
            order = np.argsort(-seen, kind="stable")
            number = np.empty(len(order), "<u4")
            number[order] = np.arange(len(order))
            payload = pack(np.array([x or 0 for x in ids], "<i8"), np.array([x is None for x in ids], np.uint8).view("u1"), np.array(h, "u1"), np.array(t, "u1"), np.array([len(x) for x in tokens], "<u4"), hashes[order], number[own])
            out = message([("T", part << 24 | seq, 0, payload)])
            vocab, rows, tokens, size, seq = _Local({END: 0, BOS: 1}), [], [], 0, seq + 1
            return out

        for batch in bounded(batches):
            for row in zip(column(batch, "doc_id").to_pylist(), column(batch, "held").to_pylist(), column(batch, "train").to_pylist(), texts_of(batch), strict=True):
                words = row[3].encode().lower().split()
                words.append(END)
                rows.append(row[:3])
                tokens.append(np.fromiter(map(vocab.__getitem__, words), np.uint32, len(words)))
                size += len(words)
                if size >= block_tokens:
                    yield flush()
        if rows:
            yield flush()

    return docs.withColumns({"held": held, "train": train}).mapInArrow(run, MESSAGE)


def message(rows: list[tuple]) -> pa.RecordBatch:
    kind, block, bucket, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary())], names=["kind", "block", "bucket", "payload"])


class Level:
    """The distinct n-grams of one order in a block, by hash; hist and lower: their places one order below, without the last and the first token."""

    def __init__(self, hashes, hist, lower, ends, inverse, where):
        self.hashes, self.hist, self.lower, self.ends = hashes, hist, lower, ends  # ends: whether the last token is the end
        self.inverse, self.where = inverse, where  # n-gram of each position in `where`


class Block:
    """A block with its distinct words and n-grams in the order of their hashes."""

    def __init__(self, payload: bytes):
        self.ids, self.null, self.held, self.train, self.lengths, self.vocab, self.tokens = unpack(payload)
        ends = np.cumsum(self.lengths.astype(np.int64))
        self.starts = ends - self.lengths
        self.learned = np.repeat(self.train, self.lengths).astype(bool)
        order = np.argsort(self.vocab)
        self.place = np.empty(len(order), np.int32)
        self.place[order] = np.arange(len(order), dtype=np.int32)
        self.levels = {1: Level(self.vocab[order], None, None, order == 0, self.place[self.tokens], slice(None))}

    def level(self, k: int) -> Level:
        if k not in self.levels:
            self.levels[k] = self._above(self.level(k - 1), k)
        return self.levels[k]

    def _above(self, below: Level, k: int) -> Level:
        n = len(self.tokens)
        if k == 2:
            where = slice(None)
            hist = np.empty(n, np.int32)
            hist[1:] = below.inverse[:-1]
            hist[self.starts] = self.place[1]
            lower = below.inverse
        else:  # a document's first k - 2 tokens have no history of that length
            offset = np.arange(n) - np.repeat(self.starts, self.lengths)
            where = np.flatnonzero(offset >= k - 2)
            every = np.full(n, -1, np.int32)
            every[below.where] = below.inverse
            hist, lower = every[where - 1], every[where]
        words = self.levels[1]
        key = below.hashes[hist] * np.uint64(0x9E3779B97F4A7C15) + mix64(words.hashes)[words.inverse[where]]
        hashes, first, inverse = np.unique(mix64(key) & ~np.uint64(0xFF), return_index=True, return_inverse=True)
        return Level(hashes, hist[first], lower[first], below.ends[lower[first]], inverse.astype(np.int32), where)

    def counts(self, k: int) -> np.ndarray:
        """Training count of each n-gram; for the start symbol the training documents."""
        own = self.level(k)
        n = np.bincount(own.inverse[self.learned[own.where]], minlength=len(own.hashes))
        if k == 1:
            n[self.place[1]] = int(self.train.sum())
        return n


class Known:
    """What a block knows of an order after the answers: training counts over all blocks, whether it is the owner, and whether it alone asked."""

    def __init__(self, block: Block, k: int, answers: dict, below: Known | None):
        own = block.level(k)
        n = len(own.hashes)
        if k == 1:
            self.c, self.owner, self.alone = answers["G1"][0].astype(np.int64), np.zeros(n, bool), np.zeros(n, bool)
            return
        self.alone, ask = unasked(own, k, below)
        self.c, self.owner = np.where(self.alone, block.counts(k), 0), np.zeros(n, bool)
        self.owner[self.alone] = self.c[self.alone] > 0
        if f"G{k}" in answers:
            c, flags = answers[f"G{k}"]
            self.c[ask], self.owner[ask], self.alone[ask] = c, flags & 1, flags & 2


def unasked(own: Level, k: int, below: Known) -> tuple[np.ndarray, np.ndarray]:
    """(alone by what is known below, places to ask for): a part that is alone settles an n-gram, and one never seen makes it unseen."""
    if k == 2:
        return np.zeros(len(own.hashes), bool), np.arange(len(own.hashes))
    alone = below.alone[own.hist] | below.alone[own.lower]
    return alone, np.flatnonzero(~alone & (below.c[own.hist] > 0) & (below.c[own.lower] > 0))


def counts_of_counts(n: np.ndarray) -> list[int]:
    few = np.bincount(n[(n > 0) & (n <= TOP + 1)].astype(np.int64), minlength=TOP + 2)
    return few[1 : TOP + 2].tolist()


def discounts(n: list[int]) -> np.ndarray:
    """d[r] for r = 0..TOP (d[0] unused) from the counts of counts n[0] = n_1, ..."""
    d = np.ones(TOP + 1)
    for r in range(1, TOP + 1):
        d[r] = (r - 0.5) / r
        if n[0] and n[r - 1] and n[TOP]:
            common = (TOP + 1) * n[TOP] / n[0]
            turing = (r + 1) * n[r] / n[r - 1] / r
            if common < 1 and 0 < (x := (turing - common) / (1 - common)) < 1:
                d[r] = x
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) * c"""
    c = c.astype(np.int64)
    return np.where(c <= TOP, d[np.minimum(c, TOP)] * c, c)


class Unigrams:
    def __init__(self, total: int, types: int, n: list[int]):
        self.total, self.types, self.d = total, types, discounts(n)
        lost = sum(n[r - 1] * r * (1 - self.d[r]) for r in range(1, TOP + 1))
        self.scale = 1.0
        if lost <= 0:  # nothing is left for the unknown token: it counts as seen once
            self.unseen = 1 / (total + 1)
            self.scale = total / (total + 1)
        else:
            self.unseen = lost / total

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * discounted(c, self.d) / max(1, self.total), self.unseen)


def _asked(table: pa.Table) -> tuple[list[int], list[list[np.ndarray]], np.ndarray, np.ndarray]:
    """Requests in the order of blocks: blocks, arrays, all hashes, and where each block's begin."""
    table = table.sort_by("block")
    data = [unpack(x) for x in table["payload"].to_pylist()]
    return table["block"].to_pylist(), data, np.concatenate([undeltas(x[0]) for x in data]), np.cumsum([0] + [len(x[0]) for x in data])


def totals(kind: str, bucket: int, table: pa.Table) -> list[tuple]:
    """For a bucket: adds up the blocks' training counts; answers each block; a row of block -1 has statistics."""
    blocks, data, hashes, at = _asked(table)
    counts = np.concatenate([x[1] for x in data]).astype(np.int64)
    known, inverse, asks = np.unique(hashes, return_inverse=True, return_counts=True)
    total = np.bincount(inverse, counts, len(known)).astype(np.int64)
    plain = total[known != BOS_HASH] if kind == "G1" else total
    out = [("S" + kind, -1, bucket, pack(statistics(plain)))]
    places = np.flatnonzero(counts)[::-1]
    first = np.full(len(known), -1, np.int64)
    first[inverse[places]] = places  # the earliest is written last
    flags = np.zeros(len(hashes), np.uint8)
    flags[first[first >= 0]] = 1
    flags |= (2 * (asks == 1)).astype(np.uint8)[inverse]
    for block, lo, hi in zip(blocks, at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = total[inverse[lo:hi]].astype("<u8")
        out.append((kind, block, bucket, pack(own) if kind == "G1" else pack(own, flags[lo:hi])))
    return out


def statistics(n: np.ndarray) -> np.ndarray:
    """Sum, number of those seen, counts of counts."""
    return np.array([int(n.sum()), int((n > 0).sum()), *counts_of_counts(n)], "<i8")


def requests(kind: str, block: int, buckets: int, hashes: np.ndarray, *arrays: np.ndarray) -> list[tuple]:
    """A message for each bucket; hashes sorted, the others with them along their last axis."""
    return [(kind, block, b, pack(deltas(hashes[lo:hi]), *[np.ascontiguousarray(x[..., lo:hi]).reshape(-1) for x in arrays])) for b, lo, hi in slices(hashes, buckets)]


def asked(k: int, buckets: int):
    """Map: the requests of every block for its n-grams of order k, all of them."""

    def run(batches):
        for batch in batches:
            for block, payload in zip(column(batch, "block").to_pylist(), column(batch, "payload").to_pylist(), strict=True):
                own = Block(payload)
                rows = requests(f"G{k}", block, buckets, own.level(k).hashes, own.counts(k).astype("<u4"))
                for lo in range(0, len(rows), 64):
                    yield message(rows[lo : lo + 64])

    return run


def _parts(table: pa.Table) -> tuple[Block, dict[str, list[np.ndarray]]]:
    """A block and the answers to it, each kind joined in the order of buckets."""
    rows = sorted(zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["payload"].to_pylist(), strict=True), key=lambda r: r[:2])
    answers: dict[str, list] = defaultdict(list)
    block = None
    for kind, _, payload in rows:
        if kind == "T":
            block = Block(payload)
        else:
            answers[kind].append(unpack(payload))
    return block, {k: [np.concatenate(x) for x in zip(*v, strict=True)] for k, v in answers.items()}


def _released(spark) -> None:
    """Lets Spark remove the shuffle files of frames that nothing refers to any more. Its cleaner works beside the
    driver, and a frame's plan may be let go only after the first pass."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def tallies(places: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """For each place how often counts 1..TOP occur, and the sum of the larger ones: TOP + 1 rows of integers."""
    few = [np.bincount(places[counts == r], minlength=n) for r in range(1, TOP + 1)]
    large = counts > TOP
    return np.stack([*few, np.bincount(places[large], counts[large], n)]).astype("<u8")


def summed(rows: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The sum of d(c) c that tallies stand for."""
    return d[1:] * np.arange(1, TOP + 1) @ rows[:TOP] + rows[TOP]


def _stats(answers: DataFrame, kind: str) -> list[int]:
    """Sums of the statistics rows (some numbers a bucket or block)."""
    rows = [unpack(bytes(r["payload"]))[0] for r in answers.where(F.col("kind") == kind).select("payload").toLocalIterator()]
    return np.sum(rows, axis=0).astype(int).tolist() if rows else [0] * (TOP + 3)


class Model:
    """What all blocks share: unigrams and the discounts of each order."""

    def __init__(self, total: int, types: int, n: list[int]):
        self.total, self.types, self.uni, self.d = total, types, Unigrams(total, types, n), {}

    def weights(self, m: int, c, sums, c_low=None, full_low=None) -> tuple[np.ndarray, np.ndarray]:
        """Backoff weights of histories of m tokens, and whether their followers' shares are scaled down.

        sums: tallies of their followers' counts, then of the same followers' counts after the shorter history, which is
        counted c_low times."""
        c = c.astype(np.float64)
        left = 1 - summed(sums[: TOP + 1], self.d[m + 1]) / c
        full = left <= 1e-12
        left = np.where(full, 1 / (c + 1), left)
        if m == 1:
            lower = self.uni.scale * summed(sums[TOP + 1 :], self.uni.d) / max(1, self.total)
        else:
            lower = self.kept(c_low, full_low) * summed(sums[TOP + 1 :], self.d[m]) / np.maximum(1, c_low)
        return left / np.maximum(1e-300, 1 - lower), full

    @staticmethod
    def kept(c, full) -> np.ndarray:
        return np.where(full, c / (c + 1.0), 1.0)


def added(kind: str, bucket: int, table: pa.Table) -> list[tuple]:
    """For a bucket: adds up the blocks' tallies of histories and sends each block the sums of its own."""
    blocks, data, hashes, at = _asked(table)
    sums = np.concatenate([x[1].reshape(2 * TOP + 2, -1) for x in data], axis=1)
    known, inverse = np.unique(hashes, return_inverse=True)
    total = np.stack([np.bincount(inverse, row, len(known)) for row in sums]).astype("<u8")
    return [(kind, block, bucket, pack(*total[:, inverse[lo:hi]])) for block, lo, hi in zip(blocks, at[:-1].tolist(), at[1:].tolist(), strict=True)]


class View:
    """A block with all answers so far: counts by order, and the weights of its histories."""

    def __init__(self, table: pa.Table, top: int, model: Model):
        self.block, self.answers = _parts(table)
        self.model, self.known = model, {}
        for k in range(1, top + 1):
            self.known[k] = Known(self.block, k, self.answers, self.known.get(k - 1))
        self.alpha: dict[int, np.ndarray] = {}
        self.full: dict[int, np.ndarray] = {}

    def histories(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(places to ask weights for, places of histories of m tokens that are the block's own)."""
        k = self.known[m]
        seen = (k.c > 0) & ~self.block.level(m).ends
        return np.flatnonzero(seen & ~k.alone), np.flatnonzero(seen & k.alone)

    def sums(self, m: int) -> np.ndarray:
        """What the n-grams that the block owns add to the sums of their histories of m tokens."""
        own = self.block.level(m + 1)
        at = np.flatnonzero(self.known[m + 1].owner)
        n = len(self.known[m].c)
        return np.concatenate([tallies(own.hist[at], self.known[m + 1].c[at], n), tallies(own.hist[at], self.known[m].c[own.lower[at]], n)])

    def shorter(self, m: int, at: np.ndarray) -> tuple:
        """Count and scaling of the histories without their first token."""
        low = self.block.level(m).lower
        return () if m == 1 else (self.known[m - 1].c[low[at]], self.full[m - 1][low[at]])

    def weigh(self, m: int) -> None:
        """Weights of the histories of m tokens, from the sums of all blocks or, where the block is alone, its own."""
        n = len(self.known[m].c)
        alpha, full = np.ones(n), np.zeros(n, bool)
        ask, own = self.histories(m)
        answered = np.stack(self.answers[f"A{m}"]) if f"A{m}" in self.answers else np.empty((2 * TOP + 2, 0), np.uint64)
        for at, sums in ((ask, answered), (own, self.sums(m)[:, own] if len(own) else None)):
            if len(at):
                alpha[at], full[at] = self.model.weights(m, self.known[m].c[at], sums, *self.shorter(m, at))
        self.alpha[m], self.full[m] = alpha, full


def score(docs: DataFrame, held, train, order: int = 2, block_tokens: int = 1_250_000, bucket_tokens: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT for every document. held, train: boolean columns over doc_id: held out, and learned from. order: tokens of the longest n-gram, 2 or more."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    blocks = saved(block_rows(rows, held, train, block_tokens), "blocks")
    n_tokens = (rows.select(F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0] or 0) // 6  # six bytes a token, roughly
    buckets = int(max(64, n_tokens // bucket_tokens))
    parts = int(max(32, n_tokens // block_tokens))

    def settled(messages: DataFrame, name: str) -> DataFrame:
        """Requests dealt to buckets and answered, as a table."""

        def run(key, table):
            kind, bucket = key[0].as_py(), key[1].as_py()
            table = table.combine_chunks()
            if kind.startswith("S"):
                return table
            return pa.Table.from_batches([message((totals if kind.startswith("G") else added)(kind, bucket, table))])

        out = saved(messages.repartition(parts, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(run, MESSAGE), name)
        _released(spark)
        return out

    words = settled(blocks.mapInArrow(asked(1, buckets), MESSAGE), "words")
    total, types, *n = _stats(words, "SG1")
    model = Model(total, types, n)
    pairs = settled(blocks.mapInArrow(asked(2, buckets), MESSAGE), "pairs")
    model.d[2] = discounts(_stats(pairs, "SG2")[2:])
    known = blocks.unionByName(words.where("kind = 'G1'")).unionByName(pairs.where("kind = 'G2'"))

    def grouped(run, schema: str) -> DataFrame:
        return known.repartition(parts, "block").groupBy("block").applyInArrow(run, schema)

    def step(k: int):
        """After the answers of order k: sums for the histories of k - 1 tokens, and the requests of order k + 1."""

        def run(key, table):
            view, block, m = View(table, k, model), key[0].as_py(), k - 1
            at, _ = view.histories(m)
            out = requests(f"A{m}", block, buckets, view.block.level(m).hashes[at], view.sums(m)[:, at])
            if k < order:
                own, n = view.block.level(k + 1), view.block.counts(k + 1)
                alone, ask = unasked(own, k + 1, view.known[k])
                out += requests(f"G{k + 1}", block, buckets, own.hashes[ask], n[ask].astype("<u4"))
                out.append((f"SG{k + 1}", -1, block % buckets, pack(statistics(n[alone]))))
            return pa.Table.from_batches([message(out)] if out else [], schema=_EMPTY.schema)

        return run

    for k in range(2, order + 1):
        found = settled(grouped(step(k), MESSAGE), f"order{k}")
        if k < order:
            model.d[k + 1] = discounts(_stats(found, f"SG{k + 1}")[2:])
        known = known.unionByName(found.where("not startswith(kind, 'S')"))

    def judge(key, table):
        view = View(table, order, model)
        block, c = view.block, view.known[1].c
        p = model.uni.p(c)
        logs = None
        for k in range(2, order + 1):
            view.weigh(k - 1)
            own, now = block.level(k), view.known[k].c
            c_hist = view.known[k - 1].c[own.hist].astype(np.float64)
            keep = model.kept(c_hist, view.full[k - 1][own.hist])
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(now > 0, keep * discounted(now, model.d[k]) / c_hist, view.alpha[k - 1][own.hist] * p[own.lower])
            if logs is None:
                logs = np.empty(len(block.tokens))
            logs[own.where] = np.log10(p)[own.inverse]
        words = c[block.levels[1].inverse]
        base = np.log10((words + 1) / (model.total + model.types + 1))
        add = lambda x: np.add.reduceat(x, block.starts)
        ids = pa.array(block.ids, pa.int64(), mask=block.null.astype(bool))
        values = [ids, pa.array(block.held.astype(bool)), pa.array(block.lengths.astype(np.int64)), pa.array(add((words > 0).astype(np.int64))), pa.array(np.full(len(block.ids), model.total, np.int64)), pa.array(add(base)), pa.array(add(logs))]
        return pa.table(values, names=[x.split()[0] for x in RESULT.split(", ")])

    return grouped(judge, RESULT)


_EMPTY = message([("", 0, 0, b"")])


def score_folds(docs: DataFrame, folds: int = 7, out: int = 2, **options) -> DataFrame:
    """Documents whose crc32(doc_id as text) mod `folds` is `out` are held out."""
    rest = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(folds))
    return score(docs, F.coalesce(rest == out, F.lit(False)), F.coalesce(rest != out, F.lit(False)), **options)
