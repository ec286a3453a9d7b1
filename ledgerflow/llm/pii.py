"""Personal data by patterns, and information-theoretic sanitisation of what gives it away.

Four kinds are found by their patterns and checks: email, ip, card, phone. Each distinct value is a protected
entity. Corpus co-occurrence then tells how strongly a term reveals an entity. With p(e), p(t) and p(e, t)
the shares of documents that hold entity e, term t, and both, wherever they stand in the text,

    PMI(e; t) = log2(p(e, t) / (p(e) p(t))),   IC(e) = -log2 p(e),   disclosure = PMI / IC  (1: t implies e).

A term whose disclosure reaches `generalise` is a span of kind `term` wherever it stands in a document with e, outside
the base spans; sanitise() generalises it, and removes it from `remove` on. Pairs need `support` documents, so a chance
neighbour seen once is no evidence.

Documents are never shuffled. The corpus is read four times: entity counts; (entity, term) pairs of the entities with
support; document frequencies of the terms in question; and the final spans. Entities, terms and pairs are dealt and joined by their 8-byte hashes;
only the flagged pairs go to the workers, in blocks of at most `BLOCK` of them; with more than one block, spans are merged by row.

Defined results: null and empty texts hold nothing; repeated rows are judged each and count as documents of
their own; a null doc_id stays null; an empty table gives an empty result. A failing match is dropped, without retries inside it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from xxhash import xxh64_intdigest

from .common import arrow_map, bounded, column, free_names, id_text, mix64, saved, texts_of, words_of

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match never starts inside a run of digits
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
#: Flagged pairs (16 bytes each) that go to a worker at once.
BLOCK = 1_000_000
#: Distinct terms that a worker counts before it sends them on.
TERMS = 1 << 18
SUMMARY = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping, in time linear in the text: a local part ends at its @ and runs left from there."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed; code points."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def entity(kind: str, value: str) -> int:
    """The protected value, without its spelling: case of addresses, separators of numbers."""
    own = value.lower() if kind == "email" else value if kind == "ip" else re.sub(r"[^0-9]", "", value)
    return xxh64_intdigest(f"{kind}:{own}".encode())


def is_term(word: bytes) -> bool:
    return len(word) >= 3 and not word.isdigit()


def term(word: bytes) -> int:
    return xxh64_intdigest(word, 1)


def paired(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    return mix64(mix64(e) ^ t)


def entities(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    return np.array(sorted({entity(k, text[a:b]) for k, a, b in spans}), np.uint64)


def open_terms(text: str, spans: list[tuple[str, int, int]]):
    """(term, start, end) of every term outside the base spans, which are sorted by start."""
    i, covered = 0, 0
    for m in TERM.finditer(text):
        s, t = m.span()
        while i < len(spans) and spans[i][1] < t:
            covered = max(covered, spans[i][2])
            i += 1
        word = m[0].translate(UPPER).encode()
        if covered <= s and is_term(word):
            yield term(word), s, t


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def entity_counts(docs: DataFrame) -> DataFrame:
    """(e, n_e): documents with entity e."""

    def run(batches):
        for batch in bounded(batches):
            own: Counter = Counter()
            for text in texts_of(batch):
                own.update({entity(k, text[a:b]) for k, a, b in base_spans(text)})
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.array(list(own), np.uint64))), pa.array(list(own.values()), pa.int64())], names=["e", "n"])

    return docs.mapInArrow(run, "e long, n long").groupBy("e").agg(F.sum("n").alias("n_e"))


def pair_counts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(e, t, n): documents with term t and entity e, for the entities asked for, over whole texts; one scan.

    A document gives a row for each of its entities, with all its terms; these are joined by entity, then counted by pair."""

    def run(batches):
        for batch in bounded(batches):
            es, ts = [], []
            for text in texts_of(batch):
                own = entities(text, base_spans(text))
                if len(own):
                    words = np.array([term(w) for w in set(words_of(text)) if is_term(w)], np.uint64).view(np.int64)
                    es += own.view(np.int64).tolist()
                    ts += [words] * len(own)
            if es:
                yield pa.RecordBatch.from_arrays([pa.array(es, pa.int64()), pa.array(ts, pa.list_(pa.int64()))], names=["e", "ts"])

    met = docs.mapInArrow(run, "e long, ts array<long>").join(asked.select("e"), "e")
    return met.select("e", F.explode("ts").alias("t")).groupBy("e", "t").agg(F.count("*").alias("n"))


def _has(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def document_frequency(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(t, df) of the terms asked for, over whole texts: one scan, in which a task adds up its own counts before they are dealt by term.

    Counts are added up over all tasks before the terms asked for are joined (an inner join, as a semi-join is pushed below the sum), so the join makes one row a term."""

    def run(batches):
        df: Counter = Counter()

        def flush():
            t = np.array([term(w) for w in df], np.uint64)
            out = pa.RecordBatch.from_arrays([pa.array(_signed(t)), pa.array(list(df.values()), pa.int64())], names=["t", "df"])
            df.clear()
            return out

        for batch in bounded(batches):
            for text in texts_of(batch):
                df.update({w for w in words_of(text) if len(w) >= 3})
                if len(df) >= TERMS:
                    yield flush()
        if df:
            yield flush()

    asked = terms.select("t").distinct()
    return docs.mapInArrow(run, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).join(asked, "t")


def disclosures(docs: DataFrame, support: int = 3, generalise: float = 0.9) -> DataFrame:
    """(e, t, disclosure) of the pairs at or above the threshold. docs: doc_id, text."""
    n_docs = docs.count()
    singles = saved(entity_counts(docs).where(F.col("n_e") >= support), "entities")
    pairs = saved(pair_counts(docs, singles).where(F.col("n") >= support), "pairs")
    df = document_frequency(docs, pairs)
    share = lambda c: F.col(c) / F.lit(float(max(1, n_docs)))
    ic = F.greatest(-F.log2(share("n_e")), F.lit(1e-9))
    pmi = F.log2(share("n") / (share("n_e") * share("df")))
    return saved(pairs.join(singles, "e").join(df, "t").select("e", "t", (pmi / ic).alias("disclosure")).where(F.col("disclosure") >= generalise), "disclosures")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _found(text: str, flagged: tuple[np.ndarray, np.ndarray]):
    """(base spans, term spans) of a text; flagged: sorted entities, and sorted hashes of (entity, term)."""
    spans = base_spans(text)
    added = []
    if spans and len(flagged[1]):
        own = entities(text, spans)
        own = own[_has(flagged[0], own)]
        places = list(open_terms(text, spans)) if len(own) else []
        if places:
            known, which = np.unique(np.array([t for t, _, _ in places], np.uint64), return_inverse=True)
            hit = np.zeros(len(known), bool)
            for e in own:
                hit |= _has(flagged[1], paired(e[None], known))
            added = [("term", *places[i][1:]) for i in np.flatnonzero(hit[which]).tolist()]
    return spans, added


def _flag_blocks(found: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted entities, sorted hashes of their pairs) of at most BLOCK pairs each; one empty block without pairs."""
    own, out = [], []

    def block():
        e, t = np.array(own, np.int64).reshape(-1, 2).T.copy().view(np.uint64)
        return np.unique(e), np.sort(paired(e, t))

    for r in found.select("e", "t").toLocalIterator():
        own.append((r["e"], r["t"]))
        if len(own) == BLOCK:
            out.append(block())
            own = []
    return [*out, block()] if own or not out else out


def find(docs: DataFrame, support: int = 3, generalise: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SUMMARY of every document."""
    rows = id_text(docs, id_col, text_col)
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(b) for b in _flag_blocks(disclosures(rows, support, generalise))]

    def summary(doc_id, base, added):
        n = Counter(k for k, _, _ in base)
        text = digest(base)
        return doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(text.encode()).hexdigest(), digest(base + added)

    def batch_of(out):
        types = (pa.int64(),) * 5 + (pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in SUMMARY.split(", ")])

    def run(block):
        def one(batch):
            return batch_of([summary(d, *_found(t, block.value)) for d, t in zip(column(batch, "doc_id").to_pylist(), texts_of(batch), strict=True)])

        return one

    parts = [arrow_map(rows, run(b), SUMMARY) for b in blocks]
    if len(parts) == 1:
        return parts[0]
    # more pairs than go to a worker at once: the same rows for each block, term spans merged
    keyed = rows.withColumn("row", F.sha2(F.coalesce("text", F.lit("")), 256)).select("doc_id", "row", "text")

    def with_row(block):
        def one(batch):
            out = run(block)(batch)
            return pa.RecordBatch.from_arrays([*out.columns, column(batch, "row")], names=[*out.schema.names, "row"])

        return one

    every = None
    for b in blocks:
        part = arrow_map(keyed, with_row(b), SUMMARY + ", row string")
        every = part if every is None else every.unionByName(part)
    keys = ["doc_id", "row", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    merged = every.groupBy(*keys).agg(F.count("*").alias("n"), F.array_distinct(F.split(F.array_join(F.collect_set("spans"), ","), ",")).alias("all"))

    def finish(batch):
        out = []
        for r in batch.to_pylist():
            spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["all"] if s)]
            out += [tuple(r[c] for c in keys if c != "row") + (digest(spans),)] * (r["n"] // len(blocks))
        return batch_of(out)

    return arrow_map(merged, finish, SUMMARY)


def redact(text: str, base, terms: dict[tuple[int, int], bool]) -> str:
    """Base spans become [KIND]; terms become [TERM], or go where the flag says so. Overlaps fall to the first span."""
    spans = sorted([(a, b, f"[{k.upper()}]") for k, a, b in base] + [(a, b, "" if gone else "[TERM]") for (a, b), gone in terms.items()])
    out, at = [], 0
    for a, b, put in spans:
        if a >= at:
            out += [text[at:a], put]
            at = b
        elif b > at:  # the rest of an overlapping span is private too
            at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, support: int = 3, generalise: float = 0.9, remove: float = 0.98, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with personal data in the text column replaced; all columns stay. Null texts stay null.

    All blocks of flagged pairs are held against the original text: the term spans found so far go from map to map in
    a column of their own, and the last one redacts."""
    sc = docs.sparkSession.sparkContext
    found = disclosures(id_text(docs, id_col, text_col), support, generalise)
    kinds = []
    for gone in (True, False):
        kinds += [(gone, sc.broadcast(b)) for b in _flag_blocks(found.where((F.col("disclosure") >= remove) == F.lit(gone))) if len(b[1])]
    steps = kinds or [(False, sc.broadcast((np.empty(0, np.uint64),) * 2))]

    (carried,) = free_names(docs, "term_spans")
    schema = docs.schema
    wide = StructType([*schema.fields, StructField(carried, ArrayType(LongType()))])  # start, end, gone of each span in turn

    def step(part, first, last):
        def one(batch):
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            before = [None] * len(texts) if first else column(batch, carried).to_pylist()
            out, spans = [], []
            for text, known in zip(texts, before, strict=True):
                known = known or []
                terms = {(a, b): bool(gone) for a, b, gone in zip(known[::3], known[1::3], known[2::3], strict=True)}
                if text:
                    for gone, block in part:
                        for _, a, b in _found(text, block.value)[1]:
                            terms.setdefault((a, b), gone)
                    if last and (base := base_spans(text)):
                        text = redact(text, base, terms)
                out.append(text)
                spans.append([x for (a, b), gone in terms.items() for x in (a, b, int(gone))])
            columns, names = list(batch.columns), list(batch.schema.names)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            if not first:
                columns, names = columns[:-1], names[:-1]
            if not last:
                columns, names = [*columns, pa.array(spans, pa.list_(pa.int64()))], [*names, carried]
            return pa.RecordBatch.from_arrays(columns, names=names)

        return one

    for i in range(0, len(steps), 2):  # two blocks at a time bound a worker's memory
        last = i + 2 >= len(steps)
        docs = arrow_map(docs, step(steps[i : i + 2], i == 0, last), schema if last else wide)
    return docs
