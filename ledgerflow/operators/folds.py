"""Order-dependent folds that windows cannot express: packing by a budget with reset, and clustering of words into visual rows.

Each works on a group whose size is that of a page or a document, never of a table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import clean as C

Y_TOLERANCE = 3.5


def pack_units(units: DataFrame, budget: int, group: list[str], order: list[str], text: str = "text") -> DataFrame:
    """units with chunk_no: consecutive units share a chunk while their characters (plus one each) fit the budget.

    A unit over the budget has a chunk to itself; split it before (functions.text.oversized_parts)."""
    schema = StructType([*units.schema.fields, StructField("chunk_no", IntegerType())])

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        out, chunk, size = [], 1, 0
        for n in rows[text].fillna("").str.len() + 1:
            if size and size + n > budget:
                chunk, size = chunk + 1, 0
            size += n
            out.append(chunk)
        return rows.assign(chunk_no=pd.array(out, dtype="int32"))

    return units.groupBy(*group).applyInPandas(fold, schema)


def chunk_texts(packed: DataFrame, group: list[str], order: list[str], text: str = "text", page: str | None = None) -> DataFrame:
    """One row a chunk: id, text, units, page range."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    extra = []
    if page:
        low, high = F.min(page), F.max(page)
        extra = [F.when(low.isNull(), "").when(low == high, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("-"), high.cast("string"))).alias("page_range")]
    return packed.groupBy(*group, "chunk_no").agg(F.format_string("chunk_%03d", F.col("chunk_no")).alias("chunk_id"), F.array_join(F.transform(rows, lambda x: x["__t"]), "\n").alias("context_text"), F.count("*").alias("unit_count"), *extra)


#: Heights are rounded to tenths before words are ordered; of anchors further apart than that, only the last two can be near.
Y_STEPS = 10


def visual_lines(words: DataFrame, page: list[str], tolerance: float = Y_TOLERANCE) -> DataFrame:
    """words: page columns, x0, y0, x1, word_text -> page columns, visual_row, words (x0, word_text, x1 from left to right): one row a visual row.

    A word joins the first row whose first word lies within the tolerance; rows go top down. The fold runs over the array of a page's words."""
    y = F.coalesce(F.col("y0").cast("double"), F.lit(float("nan")))
    item = F.struct((F.rint(y * Y_STEPS)).alias("step"), "x0", y.alias("y"), "x1", "word_text")
    shown = words.where(F.col("word_text").rlike(r"(?U)[^\s\x1c-\x1f]"))
    pages = shown.groupBy(*page).agg(F.sort_array(F.collect_list(item)).alias("w"))
    apart = tolerance * Y_STEPS >= 1  # then anchors ascend, and only the last two are near

    def placed(acc, w):
        n = F.size(acc["a"])
        seen = F.slice(acc["a"], F.greatest(n - 1, F.lit(1)), 2) if apart else acc["a"]
        hit = F.array_position(F.transform(seen, lambda a: F.abs(a - w["y"]) <= tolerance), True).cast("int")
        before = F.greatest(n - 2, F.lit(0)) if apart else F.lit(0)
        return F.struct(F.when(hit > 0, acc["a"]).otherwise(F.concat(acc["a"], F.array(w["y"]))).alias("a"), F.concat(acc["own"], F.array(F.when(hit > 0, before + hit).otherwise(n + 1))).alias("own"))

    def ranked(acc):
        rank = F.transform(acc["a"], lambda a: F.size(F.filter(acc["a"], lambda b: b < a)) + 1)
        return acc["own"] if apart else C.bound(rank, lambda r: F.transform(acc["own"], lambda k: F.get(r, k - 1)))

    empty = F.struct(F.array().cast("array<double>").alias("a"), F.array().cast("array<int>").alias("own"))
    own = F.aggregate("w", empty, placed, ranked)
    ordered = lambda o: F.sort_array(F.transform("w", lambda x, i: F.struct(F.get(o, i).alias("visual_row"), x["x0"].alias("x0"), x["word_text"].alias("word_text"), x["x1"].alias("x1"))))
    row = lambda v, i: F.get(v, i)["visual_row"]
    starts = lambda v: F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | (row(v, i - 1) != row(v, i)))
    cut = lambda v, at: F.transform(at, lambda s, j: F.struct(row(v, s).alias("visual_row"), F.slice(v, s + 1, F.coalesce(F.get(at, j + 1), F.size(v)) - s).alias("words")))
    lines = C.bound(C.bound(own, ordered), lambda v: C.bound(starts(v), lambda at: cut(v, at)))
    return pages.select(*page, F.inline(lines)).withColumn("words", F.transform("words", lambda w: F.struct(w["x0"].alias("x0"), w["word_text"].alias("word_text"), w["x1"].alias("x1"))))


def visual_rows(words: DataFrame, page: list[str], tolerance: float = Y_TOLERANCE) -> DataFrame:
    """The words of visual_lines(), one a row: page columns, visual_row, x0, x1, word_text."""
    return visual_lines(words, page, tolerance).select(*page, "visual_row", F.inline("words")).select(*page, "visual_row", "x0", "x1", "word_text")
