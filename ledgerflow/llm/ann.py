"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

Fit: the tree is built on a bounded sample (`sample` vectors, chosen by a hash of the id); every vector is
indexed. Equal vectors are one entry, which keeps the k + 1 smallest ids: the nearest k of any query need no
more. Entries are laid out by (leaf, block), where a leaf's blocks hold about `block_rows` entries, and the queries of
a leaf are dealt to sides of about `side_rows`, so neither a large leaf nor a much-visited one is one task.

Search: a query walks the tree by a priority queue of branches in order of their centres' distance and visits leaves
until the calibrated number is reached and they hold more than k ids. Calibration: for `calibration` queries
the exact neighbours are found in one pass over all entries, folded in each task before anything is sent; the number of leaf visits is the smallest that
reaches `recall` on them (plus a margin). Equal query vectors are searched once. Distances are computed in double
precision on the original vectors.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do vectors
whose length differs from the commonest one (between them no distance is defined), or rows with a null id; rows that repeat both id and
vector are one candidate, and of repeated ids with different vectors each is a candidate with its own distance; ties go to the smaller id; fewer candidates than k give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, saved

RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v (float bytes are kept as they are) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    ok = F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(ok)
    common = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    return rows.where(F.size("v") == (common["dims"] if common else 0))


def _matrix(arrays: pa.Array) -> np.ndarray:
    flat = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(arrays), -1)


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres, _nearest(x, centres)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


class Tree:
    """Inner nodes hold the centres of their children; a child is a node (>= 0) or a leaf (~leaf)."""

    def __init__(self, x: np.ndarray, leaf_size: int, branching: int, seed: int = 7):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)

        def grow(at: np.ndarray) -> int:
            if len(at) <= leaf_size:
                return self._leaf()
            centres, own = _kmeans(x[at], min(branching, len(at)), rng)
            kept = [c for c in range(len(centres)) if (own == c).any()]
            if len(kept) < 2:  # all alike
                return self._leaf()
            node = len(self.centres)
            self.centres.append(centres[kept])
            self.children.append([])
            self.children[node] = [grow(at[own == c]) for c in kept]
            return node

        self.root = grow(np.arange(len(x)))

    def _leaf(self) -> int:
        self.leaves += 1
        return ~(self.leaves - 1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest centre at every level."""
        out = np.empty(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = ~node
                continue
            own = _nearest(x[at], self.centres[node])
            todo += [(child, at[own == c]) for c, child in enumerate(self.children[node]) if (own == c).any()]
        return out

    def best_first(self, q: np.ndarray):
        """Leaves in the order of a best-bin-first walk."""
        heap, tick = [(0.0, 0, self.root)], 1
        while heap:
            _, _, node = heapq.heappop(heap)
            if node < 0:
                yield ~node
                continue
            d = ((self.centres[node] - q) ** 2).sum(1)
            for child, x in zip(self.children[node], d.tolist(), strict=True):
                heapq.heappush(heap, (x, tick, child))
                tick += 1


def _top(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For one query the exact distances and places of the nearest k rows of x, and of all rows tied with the last."""
    near = (x**2).sum(1) - 2 * x @ q
    if len(x) > k:
        far = np.partition(near, k - 1)[k - 1]
        at = np.flatnonzero(near <= far + 1e-9 * (1 + abs(far) + float(q @ q)))  # beyond what rounding can move
    else:
        at = np.arange(len(x))
    d = np.sqrt(((x[at] - q) ** 2).sum(1))
    return d, at


def distinct_entries(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids): each distinct vector with its `keep` smallest ids, combined map-side, then by salt, then by vector."""

    def run(batches):
        for batch in batches:
            x = np.ascontiguousarray(_matrix(column(batch, "v"))) + 0.0  # -0.0 is 0.0
            ids = column(batch, "id").to_numpy()
            groups: dict[bytes, list[int]] = {}
            for i, key in enumerate(map(bytes, x)):
                groups.setdefault(key, []).append(int(ids[i]))
            keys = list(groups)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([sorted(set(groups[k]))[:keep] for k in keys], pa.list_(pa.int64()))], names=["key", "ids"])

    few = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, keep)
    made = rows.mapInArrow(run, "key binary, ids array<long>")
    salted = made.groupBy("key", F.pmod(F.hash(F.col("ids")[0]), F.lit(64)).alias("salt")).agg(few("ids").alias("ids"))
    return salted.groupBy("key").agg(few("ids").alias("ids"))


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    keys = column(batch, "key").to_pylist()
    return np.frombuffer(b"".join(keys), np.float64).reshape(len(keys), -1)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(qkey, best): the nearest k (score, id) of each query vector; first by salt, so that no query gathers the lists of all tasks at once."""
    few = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
    return found.groupBy("qkey", F.pmod(F.spark_partition_id(), F.lit(64)).alias("salt")).agg(few).groupBy("qkey").agg(few)


_BEST = pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64())]))


def _found(q: np.ndarray, x: np.ndarray, ids: list[list[int]], k: int) -> list[dict]:
    d, at = _top(q, x, k)
    best = sorted((s, i) for s, a in zip(d.tolist(), at.tolist(), strict=True) for i in ids[a])[:k]
    return [dict(score=s, id=i) for s, i in best]


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, sample: int = 20_000, leaf_rows: int = 400, branching: int = 12, block_rows: int = 4096, side_rows: int = 4096, calibration: int = 128, recall: float = 0.985, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each vector whose id is divisible by `every` its k nearest others: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    rows = usable(vectors, id_col, vector_col)
    entries = saved(distinct_entries(rows, k + 1), "entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    part = entries if n <= sample else entries.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    x = np.array([np.frombuffer(r["key"], np.float64) for r in part.select("key").orderBy("key").toLocalIterator()])  # about `sample` vectors
    if not len(x):
        x = np.array([np.frombuffer(r["key"], np.float64) for r in entries.select("key").limit(1).collect()])
    leaves = max(1, min(n // leaf_rows, len(x) // 8))
    tree = sc.broadcast(Tree(x, max(1, len(x) // leaves), branching))

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([column(batch, "key"), column(batch, "ids"), pa.array(tree.value.assign(_vectors(batch)))], names=["key", "ids", "leaf"])

    placed = saved(entries.mapInArrow(place, "key binary, ids array<long>, leaf int"), "placed")
    sizes = {r["leaf"]: (r["n"], r["m"]) for r in placed.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("m")).collect()}  # one row a leaf
    blocks = {leaf: math.ceil(n / block_rows) for leaf, (n, _) in sizes.items()}
    queries = rows.where(F.pmod("id", F.lit(every)) == 0)
    asked = saved(distinct_queries(queries), "asked")
    if not asked.take(1):
        return spark.createDataFrame([], RESULT)

    visits = calibrate(asked, placed, tree, k, calibration, recall)
    layout = sc.broadcast({leaf: (blocks[leaf], m) for leaf, (_, m) in sizes.items()})

    def walk(batches):
        for batch in batches:
            keys, out = column(batch, "qkey").to_pylist(), []
            for key in keys:
                seen = held = 0
                for leaf in tree.value.best_first(np.frombuffer(key, np.float64)):
                    n_blocks, m = layout.value.get(leaf, (0, 0))
                    if n_blocks:
                        out += [(leaf, b, key) for b in range(n_blocks)]
                    seen, held = seen + 1, held + m
                    if seen >= visits and held > k:
                        break
            for lo in range(0, len(out), 4096):
                a, b, c = zip(*out[lo : lo + 4096], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], names=["leaf", "block", "qkey"])

    def search(key, left, right):
        if not len(left) or not len(right):
            return pa.table({"qkey": pa.array([], pa.binary()), "best": pa.array([], _BEST)})
        left = left.combine_chunks()
        own, ids = np.frombuffer(b"".join(left["key"].to_pylist()), np.float64).reshape(len(left), -1), left["ids"].to_pylist()
        asks = right["qkey"].to_pylist()
        return pa.table({"qkey": pa.array(asks, pa.binary()), "best": pa.array([_found(np.frombuffer(q, np.float64), own, ids, k + 1) for q in asks], _BEST)})

    counts = F.create_map(*[F.lit(x) for leaf, b in blocks.items() if b > 1 for x in (leaf, b)]) if any(b > 1 for b in blocks.values()) else None
    of = F.coalesce(counts[F.col("leaf")], F.lit(1)) if counts is not None else F.lit(1)
    index = placed.withColumn("block", F.pmod(F.hash("key"), of).cast("int"))
    routed = saved(asked.select("qkey").mapInArrow(walk, "leaf int, block int, qkey binary"), "routed")
    sides = {r["leaf"]: math.ceil(r["n"] / side_rows) for r in routed.where("block = 0").groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > side_rows).collect()}  # one row a leaf at most
    if sides:
        n_sides = F.coalesce(F.create_map(*[F.lit(x) for pair in sides.items() for x in pair])[F.col("leaf")], F.lit(1))
        index = index.withColumn("side", F.explode(F.sequence(F.lit(0), n_sides - 1)))
        routed = routed.withColumn("side", F.pmod(F.hash("qkey"), n_sides).cast("int"))
    else:
        index, routed = index.withColumn("side", F.lit(0)), routed.withColumn("side", F.lit(0))
    group = ["leaf", "block", "side"]
    found = index.groupBy(*group).cogroup(routed.groupBy(*group)).applyInArrow(search, "qkey binary, best array<struct<score: double, id: long>>")
    best = saved(_merged(found, k + 1), "best")
    each = queries.select("id", "v").distinct().mapInArrow(_keyed, "id long, qkey binary").join(best, "qkey")
    others = each.select("id", F.posexplode(F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k)).alias("pos", "b"))
    return others.select(F.col("id").alias("query_id"), (F.col("pos") + 1).alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))


def _keyed(batches):
    for batch in batches:
        x = np.ascontiguousarray(_matrix(column(batch, "v"))) + 0.0
        yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array([bytes(r) for r in x], pa.binary())], names=["id", "qkey"])


def distinct_queries(queries: DataFrame) -> DataFrame:
    return queries.mapInArrow(_keyed, "id long, qkey binary").select("qkey").distinct()


def exact(asks: list[bytes], placed: DataFrame, k: int) -> dict[bytes, list[tuple[int, int]]]:
    """For a few query vectors the (id, leaf) of the nearest k over all entries, in one pass."""

    def run(batches):
        q = [np.frombuffer(a, np.float64) for a in asks]
        best: list[list[tuple]] = [[] for _ in q]
        for batch in batches:
            x, ids, leaf = _vectors(batch), column(batch, "ids").to_pylist(), column(batch, "leaf").to_pylist()
            for n, one in enumerate(q):
                d, at = _top(one, x, k)
                best[n] = sorted(best[n] + [(s, i, leaf[a]) for s, a in zip(d.tolist(), at.tolist(), strict=True) for i in ids[a]])[:k]
        kind = pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64()), ("leaf", pa.int32())]))
        rows = [[dict(score=s, id=i, leaf=p) for s, i, p in own] for own in best]
        yield pa.RecordBatch.from_arrays([pa.array(asks, pa.binary()), pa.array(rows, kind)], names=["qkey", "best"])

    found = placed.mapInArrow(run, "qkey binary, best array<struct<score: double, id: long, leaf: int>>")
    return {r["qkey"]: [(b["id"], b["leaf"]) for b in r["best"]] for r in _merged(found, k).collect()}


def calibrate(asked: DataFrame, placed: DataFrame, tree, k: int, calibration: int, recall: float, margin: float = 1.15) -> int:
    """Leaf visits that reach the recall on up to `calibration` query vectors, widened by the margin."""
    asks = [r["qkey"] for r in asked.orderBy(F.xxhash64("qkey"), "qkey").limit(calibration).collect()]
    truth = exact([bytes(a) for a in asks], placed, k + 1)
    ranks = []
    for key, best in truth.items():
        place = {leaf: i + 1 for i, leaf in enumerate(tree.value.best_first(np.frombuffer(key, np.float64)))}
        ranks += [place[leaf] for _, leaf in best]
    ranks.sort()
    need = ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]
    return max(1, min(tree.value.leaves, math.ceil(need * margin)))
