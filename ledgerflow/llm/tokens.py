"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as its byte symbols in a doubly linked list. A heap holds the adjacent pairs that have a
merge rank; the lowest rank (leftmost first among equals) is popped, stale entries are skipped, and the two
symbols are joined. The count is the number of initial symbols minus the number of merges: identifiers are
never made. Cost is O(n log n) in the length of a pre-token, so a text of one huge word is no special case.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; a null
doc_id stays null; an empty table gives an empty result. Special strings inside a text are one token each,
which is the library's default.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import CACHE_ENTRIES, arrow_map, column, hold, id_text, texts_of

#: Fixed value: the public byte-level pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A space before a non-space always starts a pre-token, so texts are cut there and the parts are cached.
CUT = re.compile(r" (?=\S)")

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_alphabet() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others are moved above 255."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b if b in keep else 256 + extra))
        extra += b not in keep
    return out


class HeapCounter:
    """Counts tokens of whole texts under the merges of a byte-level BPE file."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.alphabet = byte_alphabet()
        merges = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.pieces = _Cache(self.merged, cache_entries)
        self.parts = _Cache(lambda part: self.segment(" " + part), cache_entries)

    def merged(self, piece: str) -> int:
        alphabet, ranks = self.alphabet, self.ranks
        symbols = [alphabet[b] for b in piece.encode()]
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i]
            if symbols[i] is None or j >= n or ranks.get((symbols[i], symbols[j])) != rank:
                continue  # a neighbour was merged meanwhile
            symbols[i] += symbols[j]
            symbols[j] = None
            after = right[i] = right[j]
            if after < n:
                left[after] = i
                if (r := ranks.get((symbols[i], symbols[after]))) is not None:
                    heapq.heappush(heap, (r, i))
            before = left[i]
            if before >= 0 and (r := ranks.get((symbols[before], symbols[i]))) is not None:
                heapq.heappush(heap, (r, before))
            merges += 1
        return n - merges

    def segment(self, text: str) -> int:
        pieces = self.pieces
        return sum([pieces[p] for p in self.pattern.findall(text)])

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        first, *rest = CUT.split(text)
        return self.segment(first) + sum(map(self.parts.__getitem__, rest))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text) if text else 0
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += 1 + (self.plain(text[at : m.start()]) if m.start() > at else 0)
            at = m.end()
        return total + (self.plain(text[at:]) if at < len(text) else 0)


class _Cache(dict):
    """A dictionary that fills itself, keeps short keys only and is emptied when full."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value


_counters: dict[str, HeapCounter] = {}


def counter(path: str) -> HeapCounter:
    """One counter for each worker process and file."""
    hold("tokens", _counters.clear)
    if path not in _counters:
        _counters[path] = HeapCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text; one map over the scan, no shuffle."""

    def run(batch):
        count = counter(path).count
        texts = texts_of(batch)
        n = pa.array([count(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), n, pa.array([x > limit for x in n.to_pylist()], pa.bool_())],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return arrow_map(id_text(docs, id_col, text_col), run, SCHEMA)
