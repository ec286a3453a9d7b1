"""Language identification by language-bitmask n-gram filters.

Bit-sliced Bloom filters: slot s of one table holds a bit for each language, so the AND of an n-gram's
`hashes` slots gives every language whose filter holds the n-gram, in one lookup for all languages. Per-language
counts of hits over the text, corrected by each filter's false-positive rate (its fill to the power of the
number of hashes), decide.

The filters are fitted on a bounded sample of labelled rows: at most about `sample_per_language` documents of
each language (a documented bound, chosen by a hash of the id). An n-gram enters a language's filter if it
was seen `min_count` times there and its rate is at least `share` times the highest rate of any language.

Defined results: null texts and texts without a letter are `und` with score 0, as is everything if nothing could be
learned; a text with letters but no known n-gram gets the most frequent learned language with score 0; ties go to
the more frequent language, then the smaller name; repeated rows are predicted each; rows with a null lang are
never learned from; a null doc_id stays null and is not learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded, column, crc32_of_id, id_text, keep_where, mix64, saved, texts_of

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, explained double"
SIZES = (2, 3, 4)
_SPACE = 32
_table: np.ndarray | None = None
_P = np.uint64(0x9E3779B97F4A7C15)


def letter_table() -> np.ndarray:
    """1 for the code points that are letters."""
    global _table
    if _table is None:
        _table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _table


def grams_of(text: str, sizes=SIZES) -> tuple[np.ndarray, int]:
    """(hashes of all n-grams of letters and word edges, number of letters). Lower case; other characters are edges."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = letter_table()[points]
    n = int(letter.sum())
    if not n:
        return np.empty(0, np.uint64), 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one edge after each word
    chars = np.where(letter, points, _SPACE)[keep].astype(np.uint64)
    chars = np.concatenate(([_SPACE], chars, [_SPACE])).astype(np.uint64)
    edge = chars == _SPACE
    out = []
    for size in sizes:
        m = len(chars) - size + 1
        if m <= 0:
            continue
        code = np.zeros(m, np.uint64)
        inner = np.zeros(m, bool)
        for j in range(size):
            code = code * _P + chars[j : j + m]
            if 0 < j < size - 1:
                inner |= edge[j : j + m]
        if size == 2:
            inner = edge[:m] & edge[1 : m + 1]
        out.append(mix64(code + np.uint64(size))[~inner])
    return np.concatenate(out), n


@dataclass
class BitmaskFilter:
    """table[slot, word] has the language bits of a slot."""

    languages: list[str]
    table: np.ndarray
    hashes: int
    false_positive: np.ndarray

    @classmethod
    def build(cls, languages: list[str], grams: dict[int, np.ndarray], hashes: int = 4, bits_a_gram: int = 16) -> BitmaskFilter:
        """grams: for each language's number its n-grams."""
        most = max((len(g) for g in grams.values()), default=1)
        slots = 1 << max(10, int(most * bits_a_gram - 1).bit_length())
        table = np.zeros((slots, -(-len(languages) // 64)), np.uint64)
        for lang, own in grams.items():
            for s in cls._slots(own, hashes, slots):
                table[s, lang // 64] |= np.uint64(1 << lang % 64)
        fill = np.array([np.count_nonzero(table[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) / slots for k in range(len(languages))])
        return cls(languages, table, hashes, fill**hashes)

    @staticmethod
    def _slots(grams: np.ndarray, hashes: int, slots: int):
        step = (grams >> np.uint64(32)) | np.uint64(1)
        for k in range(hashes):
            yield ((grams + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the bits of all languages whose filter holds it."""
        out = None
        for s in self._slots(grams, self.hashes, len(self.table)):
            out = self.table[s] if out is None else out & self.table[s]
        return out

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """Expected true hits of each language: (hits - n * rate) / (1 - rate)."""
        masks, n = self.masks(grams), len(grams)
        hits = np.array([np.count_nonzero(masks[:, k // 64] & np.uint64(1 << k % 64)) for k in range(len(self.languages))], float)
        return np.maximum(0.0, (hits - n * self.false_positive) / np.maximum(1e-9, 1 - self.false_positive))

    def predict(self, text: str) -> tuple[str, float, float]:
        """(language, its share of all languages' hits, share of the n-grams it explains)."""
        grams, letters = grams_of(text)
        if not letters or not self.languages:
            return "und", 0.0, 0.0
        own = self.counts(grams)
        best = int(np.argmax(own))  # languages are in order of frequency, then name
        total = own.sum()
        return self.languages[best], float(own[best] / total) if total else 0.0, float(min(1.0, own[best] / len(grams)))


def fit(labelled: DataFrame, sample_per_language: int = 1500, min_count: int = 3, share: float = 0.5, hashes: int = 4) -> BitmaskFilter:
    """labelled: doc_id, text, lang of the rows to learn from."""
    rows = labelled.where("lang is not null and text is not null and doc_id is not null")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(totals, key=lambda k: (-totals[k], k))
    if not languages:
        return BitmaskFilter([], np.zeros((1024, 1), np.uint64), hashes, np.empty(0))
    number = {k: i for i, k in enumerate(languages)}
    chance = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, sample_per_language / totals[k])))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < chance[F.col("lang")]).select("lang", "text")

    def count(batches):
        own: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang, grams):
            a, n = np.unique(grams, return_counts=True)
            if lang in own:
                b, m = own[lang]
                a, where = np.unique(np.concatenate((a, b)), return_inverse=True)
                n = np.bincount(where, np.concatenate((n, m)), len(a)).astype(np.int64)
            own[lang] = a, n

        for batch in bounded(batches):
            byl: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(column(batch, "lang").to_pylist(), texts_of(batch), strict=True):
                byl.setdefault(lang, []).append(grams_of(text)[0])
            for lang, g in byl.items():
                add(lang, np.concatenate(g))
        for lang, (a, n) in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a)), pa.array(a.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = saved(sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    sums = {r["lang"]: float(r["n"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not sums:
        return BitmaskFilter(languages, np.zeros((1024, -(-len(languages) // 64)), np.uint64), hashes, np.zeros(len(languages)))
    rate = F.col("n") / F.create_map(*[F.lit(x) for kv in sums.items() for x in kv])[F.col("lang")]
    rated = counts.withColumn("rate", rate)
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
    kept = rated.where(F.col("n") >= min_count).join(best, "gram").where(F.col("rate") >= share * F.col("best"))
    seen = kept.select("lang", "gram").toPandas()  # the filters' own n-grams: bounded with the sample
    return BitmaskFilter.build(languages, {number[k]: g["gram"].to_numpy().view(np.uint64) for k, g in seen.groupby("lang")}, hashes)


def held_out(id_col):
    return F.coalesce(F.pmod(crc32_of_id(id_col), F.lit(3)) == 1, F.lit(False))


def predict(docs: DataFrame, model: BitmaskFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded with the sample

    def run(batch):
        found = [shipped.value.predict(t) for t in texts_of(batch)]
        lang, score, explained = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(lang), pa.array(score), pa.array(explained)], names=["doc_id", "held_out", "lang_pred", "score", "explained"])

    rows = id_text(docs, id_col, text_col)
    return arrow_map(rows.withColumn("held_out", held_out(F.col("doc_id"))), run, SCHEMA)


def labelled_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang of the rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.where(~held_out(F.col("doc_id")))


def keep_identified(docs: DataFrame, min_explained: float = 0.1, **options) -> DataFrame:
    """docs without those that are `und`, or of which the predicted language explains less than a share of the n-grams."""
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled_rows(docs), **options))

    def keep(text):
        lang, _, explained = model.value.predict(text)
        return lang != "und" and explained >= min_explained

    return keep_where(docs, keep)


def identify(docs: DataFrame, train: DataFrame | None = None, **options) -> DataFrame:
    """Fits on the documents of `train` (default: docs) that are not held out, and predicts every document of docs."""
    return predict(docs, fit(labelled_rows(docs if train is None else train), **options))
