"""Benchmark decontamination by winnowing.

A benchmark window is `window` consecutive words of an item; an item of fewer words is one window. Rolling
k-gram hashes are made of both sides, and the smallest hash of every run of window - k + 1 k-grams is its
fingerprint (k = min(8, window length)). Equal windows have equal fingerprints, so no shared span of `window` words is missed.
Document fingerprints are joined with those of the benchmark; where they meet, the hit is extended: the words
of the document window are compared with the words of the benchmark windows, so hash collisions cost time and never a result.

The benchmark is the stated query set: its windows are taken to the workers in blocks of at most
`block_windows`, each of which has a proven size bound; with more than one block, the partial hits of a
document (word positions and items) are merged by doc_id. Documents are never shuffled.

Defined results: null and empty texts have no words, no hits and are clean; a benchmark item without words
has no window; repeated items (same id) count once; a null item_id takes no part; with an empty benchmark every
document is clean; repeated rows are judged each (rows are told apart while blocks are merged); a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import CACHE_ENTRIES, arrow_map, column, free_names, hold, id_text, keep_where, mix64, saved, texts_of, words_of

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first_word: long, end_word: long>>"
PARTIAL = "doc_id long, row string, n_words long, hits array<struct<first_word: long, end_word: long>>, items array<string>"
NAMES = [x.split()[0] for x in "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean".split(", ")] + ["spans"]
#: Odd multipliers for the word at each place of a k-gram.
_PLACES = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def window_minima(words: list[bytes], window: int, k: int) -> np.ndarray:
    """For each window of `window` words the smallest hash of its k-grams."""
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - k + 1
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams += h[j : j + n] * _PLACES[j]
    grams = mix64(grams)
    run = window - k + 1
    low, done = grams, 1
    while done < run:  # a window's minimum from those of two shorter ones
        step = min(done, run - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    return low


class WindowBlock:
    """Windows of some benchmark items: words -> item ids, and their fingerprints for each window length."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int, k: int):
        self.k = k
        self.windows: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        prints: dict[int, list[np.ndarray]] = defaultdict(list)
        for item_id, words in items:
            size = min(window, len(words))
            if size:
                for i in range(len(words) - size + 1):
                    self.windows[size][b" ".join(words[i : i + size])].add(str(item_id))
                prints[size].append(window_minima(words, size, min(k, size)))
        self.prints = {size: np.unique(np.concatenate(x)) for size, x in prints.items()}
        self.filters = {}
        for size, x in self.prints.items():
            bits = np.zeros(1 << 16, bool)
            bits[(x & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.filters[size] = bits
        self.windows = {size: dict(x) for size, x in self.windows.items()}

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """(hit flag for each word, items)."""
        hold("decontaminate", _hashes.clear)
        hit, items = np.zeros(len(words), bool), set()
        for size, known in self.windows.items():
            if len(words) < size:
                continue
            low = window_minima(words, size, min(self.k, size))
            at = np.flatnonzero(self.filters[size][(low & np.uint64(0xFFFF)).astype(np.int64)])
            if len(at):
                prints = self.prints[size]
                place = np.minimum(np.searchsorted(prints, low[at]), len(prints) - 1)
                for i in at[prints[place] == low[at]].tolist():
                    own = known.get(b" ".join(words[i : i + size]))
                    if own:
                        hit[i : i + size] = True
                        items |= own
        return hit, items


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def judged(doc_id, n_words: int, hit_words: int, items, spans) -> tuple:
    ids = ",".join(sorted(items))
    return doc_id, n_words, hit_words, len(items), hashlib.sha256(ids.encode()).hexdigest(), hit_words > 0 and 20 * hit_words >= n_words, [dict(first_word=a, end_word=b) for a, b in spans]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())]))
    types = (pa.int64(),) * 4 + (pa.string(), pa.bool_(), span)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=NAMES)


def benchmark_blocks(benchmark: DataFrame, window: int, k: int, block_windows: int, item_col: str, text_col: str):
    """Blocks of at most block_windows windows (one item at least), in item order."""
    own, n = [], 0
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).dropna().orderBy("item")
    for r in items.toLocalIterator():
        words = words_of(r["text"])
        if words:
            if own and n + len(words) > block_windows:
                yield WindowBlock(own, window, k)
                own, n = [], 0
            own.append((r["item"], words))
            n += len(words)
    if own:
        yield WindowBlock(own, window, k)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 8, block_windows: int = 500_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """n_hit, items and the contamination verdict of every document, with the spans of hit words."""
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(b) for b in benchmark_blocks(benchmark, window, k, block_windows, item_col, item_text_col)]
    rows = id_text(docs, id_col, text_col)
    if len(blocks) < 2:

        def run(batch):
            out = []
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), texts_of(batch), strict=True):
                words = words_of(text)
                hit, items = blocks[0].value.hits(words) if blocks else (np.zeros(len(words), bool), set())
                out.append(judged(doc_id, len(words), int(hit.sum()), items, spans_of(hit)))
            return _rows(out)

        return arrow_map(rows, run, RESULT)

    def finish(batch):
        out = []
        for r in batch.to_pylist():
            hit = merged_hits(r)
            out += [judged(r["doc_id"], r["n_words"], int(hit.sum()), r["items"], spans_of(hit))] * (r["n"] // len(blocks))
        return _rows(out)

    return arrow_map(merged_blocks(rows, blocks), finish, RESULT)


def text_key(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def merged_hits(r: dict) -> np.ndarray:
    hit = np.zeros(r["n_words"], bool)
    for s in r["hits"]:
        hit[s["first_word"] : s["end_word"]] = True
    return hit


def merged_blocks(rows: DataFrame, blocks: list) -> DataFrame:
    """The hits of all blocks for each doc_id and text (`row`), with the number of copies times blocks."""

    def partial(block):
        def run(batch):
            out = []
            for doc_id, row, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "row").to_pylist(), texts_of(batch), strict=True):
                words = words_of(text)
                hit, items = block.value.hits(words)
                out.append((doc_id, row, len(words), [dict(first_word=a, end_word=b) for a, b in spans_of(hit)], sorted(items)))
            span = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())]))
            types = (pa.int64(), pa.string(), pa.int64(), span, pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "row", "n_words", "hits", "items"])

        return run

    # repeated rows are equal rows: one result for each distinct text of an id, given once for each copy
    keyed = rows.withColumn("row", text_key(F.col("text")))
    parts = None
    for b in blocks:
        own = arrow_map(keyed, partial(b), PARTIAL)
        parts = own if parts is None else parts.unionByName(own)
    return parts.groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.count("*").alias("n"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 8, block_windows: int = 500_000) -> DataFrame:
    """docs without the contaminated ones, all columns as they are. Each row is judged by its own text, for any number of blocks."""
    blocks = list(benchmark_blocks(benchmark, window, k, block_windows, "item_id", "text"))
    if not blocks:
        return docs
    if len(blocks) > 1:
        sc = docs.sparkSession.sparkContext

        def verdict(batch):
            own = [r["row"] for r in batch.to_pylist() if (hit := int(merged_hits(r).sum())) and 20 * hit >= r["n_words"]]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.string())], names=["contaminated_text"])

        found = saved(arrow_map(merged_blocks(id_text(docs), [sc.broadcast(b) for b in blocks]), verdict, "contaminated_text string").distinct(), "contaminated")
        (key,) = free_names(docs, "contaminated_text")
        return docs.join(found.withColumnRenamed("contaminated_text", key), text_key(docs["text"].cast("string")) == F.col(key), "left_anti")
    shipped = docs.sparkSession.sparkContext.broadcast(blocks[0])

    def keep(text):
        words = words_of(text)
        hit = int(shipped.value.hits(words)[0].sum())
        return not (hit and 20 * hit >= len(words))

    return keep_where(docs, keep)
