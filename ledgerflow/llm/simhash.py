"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two halves. If two fingerprints differ in at most two bits, at least one
half differs in at most one. So a fingerprint is indexed under each half as it is, and under each half with
one bit deleted (32 one-wildcard variants a half). Fingerprints that meet under an equal key are verified by
the bits that differ. Under a deleted bit only pairs that differ in that bit matter, as the others meet under the whole half.

The index holds distinct fingerprints, so copies of a text are one entry. Keys are first counted: a key with
a single pair gives that pair at once, keys of up to `max_pairs` pairs are joined, and members of heavier
keys (large groups of near copies) link through their two-bit-deletion variants: all members of such
a variant are within two bits of each other, so each links to its smallest member and no pairs are formed. No link is lost.

Defined results: null and empty texts, and texts of white space, have fingerprint zero and are linked like
any other; repeated rows are returned each; a row with a null doc_id gets its group's smallest known id (null if there is none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh64_intdigest

from .common import arrow_map, column, free_names, id_text, saved, texts_of
from .components import components

SEED = 42
#: Keys with more pairs than this link through two-bit-deletion variants.
MAX_PAIRS = 256
#: Distinct fingerprints whose variants one task makes.
FPS_A_TASK = 20_000
#: Heavy keys are broadcast up to this many (eight bytes each), joined by shuffle beyond.
BROADCAST_KEYS = 500_000


def fingerprint(text: str, words_a_shingle: int = 3) -> int:
    """Bit b is 1 if it is set in over half of the shingles' hashes."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_a_shingle:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        ends = starts[words_a_shingle:] + [at]
        hashes = [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends, strict=False)]
    h = np.array(hashes, "<u8")
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_a_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every whole text."""

    def run(batch):
        fp = np.array([fingerprint(t, words_a_shingle) for t in texts_of(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return arrow_map(id_text(docs, id_col, text_col), run, "doc_id long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(key, side, fp): 64 one-wildcard variants with the deleted bit as side, and the two whole halves with side null.

    key: the half with the bit deleted in the low 32 bits, the deleted bit's number (64 and 65: none) above."""
    half = lambda k: F.shiftrightunsigned("fp", 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))
    bit = F.col("bit")
    own = F.when(bit == 65, half(1)).when(bit == 64, half(0)).when(bit >= 32, half(1)).otherwise(half(0))
    mask = F.when(bit >= 64, F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bit % 32))
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("bit"))
    return rows.select(
        F.call_function("shiftleft", bit.cast("long"), F.lit(32)).bitwiseOR(own.bitwiseAND(F.bitwise_not(mask))).alias("key"),
        F.when(bit < 64, own.bitwiseAND(mask) != 0).alias("side"),
        "fp",
    )


def _far(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """fps: distinct fingerprints (fp). Links (a, b) whose components are those of all pairs within two bits."""
    fps = fps.repartition(max(1, -(-fps.count() // FPS_A_TASK)), "fp")  # the list is small, its variants are not
    rows = variants(fps).repartition("key")  # nearly all keys differ: there is nothing to combine before the shuffle
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.count(F.when(F.col("side"), 1)).alias("ones"), F.count("side").alias("sided"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    pairs = F.when(F.col("sided") > 0, F.col("ones") * (F.col("n") - F.col("ones"))).otherwise(F.expr("n * (n - 1) div 2"))
    met = saved(keys.withColumn("pairs", pairs).where("pairs > 0").select("key", "n", "pairs", "a", "b"), "keys")
    one = met.where("n = 2").where(_far("a", "b") <= 2).select("a", "b")
    more = met.where("n > 2").select("key", "pairs")
    if more.count() <= BROADCAST_KEYS:
        more = F.broadcast(more)
    members = saved(rows.join(more, "key").select("key", "side", "fp", (F.col("pairs") <= max_pairs).alias("light")), "members")
    light = members.where("light")
    x, y = light.select("key", F.col("side").alias("s"), F.col("fp").alias("a")), light.select("key", F.col("side").alias("t"), F.col("fp").alias("b"))
    few = x.join(y, "key").where("a < b and (s is null or s <> t)").where(_far("a", "b") <= 2).select("a", "b")
    heavy = members.where("not light").select("fp").distinct()
    one_bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c))
    first = heavy.select("fp", F.explode(F.sequence(F.lit(1), F.lit(63))).alias("i"))
    both = first.select("fp", "i", F.explode(F.sequence(F.lit(0), F.col("i") - 1)).alias("j"))  # 2016 a fingerprint
    deleted = both.select(one_bit("i").bitwiseOR(one_bit("j")).alias("mask"), "fp").withColumn("rest", F.col("fp").bitwiseAND(F.bitwise_not("mask")))
    star = deleted.groupBy("mask", "rest").agg(F.min("fp").alias("b"))
    # the planner's size of an exploded side is that of its source: without the hint it would be broadcast
    many = deleted.join(star.hint("merge"), ["mask", "rest"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return one.unionByName(few).unionByName(many)


def classes(rows: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """rows: doc_id, fp -> a row for each distinct fingerprint: fp, root (smallest fp of the class), component_id."""
    smallest = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "smallest")
    found = components(links(smallest.select("fp"), max_pairs)).select(F.col("node").alias("fp"), "root")
    rooted = smallest.join(found, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return saved(rooted.join(lowest, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_pairs: int = MAX_PAIRS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every document."""
    rows = saved(fingerprints(docs, 3, id_col, text_col), "fingerprints")
    out = rows.join(classes(rows, max_pairs), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """docs with one document of each class, that of the smallest doc_id; all columns as they are.

    Where ids are missing or repeated, rows of one class and id count as one, and a row without an id stays only
    if its class has no id at all."""
    rows = saved(fingerprints(docs), "fingerprints")
    own = classes(rows, max_pairs)
    odd = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if not odd:
        gone = rows.join(own, "fp").where("doc_id <> component_id").select("doc_id")
        (key,) = free_names(docs, "gone")
        return docs.join(gone.withColumnRenamed("doc_id", key), docs["doc_id"].cast("long") == F.col(key), "left_anti")

    def with_print(batch):
        texts = texts_of(batch)
        found = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, fp])

    fp, root, low = free_names(docs, "fp", "root", "low")
    printed = arrow_map(docs, with_print, StructType([*docs.schema.fields, StructField(fp, LongType())]))
    joined = printed.join(own.select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(low)), fp)
    named = [F.col(f"`{c}`") for c in docs.columns]
    return joined.where(F.col("doc_id").cast("long").eqNullSafe(F.col(low))).dropDuplicates([root, "doc_id"]).select(named)
