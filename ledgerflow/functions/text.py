"""Text slicing: fixed chunks, lines, token estimates, rendered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import strip, text_or_empty

#: Fixed value: characters of a stored text chunk.
CHUNK_CHARS = 30_000


def chunks(c: Column, size: int = CHUNK_CHARS) -> Column:
    """Slices of `size` characters; one empty slice for an empty text."""
    text = text_or_empty(c)
    last = F.greatest(F.lit(0), F.ceil(F.length(text) / size).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def explode_chunks(df: DataFrame, col: str, size: int = CHUNK_CHARS) -> DataFrame:
    rows = df.select("*", F.posexplode(chunks(F.col(col), size)).alias("pos", "text_chunk"))
    return rows.withColumn("text_chunk_index", F.col("pos") + 1).drop("pos").withColumn("char_count", F.length("text_chunk"))


def explode_lines(df: DataFrame, col: str) -> DataFrame:
    """Non-blank lines with their number from 1."""
    rows = df.select("*", F.posexplode(F.split(text_or_empty(F.col(col)), "\n")).alias("pos", "line_text"))
    return rows.withColumn("line_number", F.col("pos") + 1).drop("pos").where(strip(F.col("line_text")) != "")


def estimated_tokens(c: Column) -> Column:
    """Four characters a token, rounded up."""
    return F.ceil(F.length(text_or_empty(c)) / 4)


def rendered(*cols: Column) -> Column:
    """Cells as 'a | b | c', null as empty."""
    return F.array_join(F.array(*[text_or_empty(c) for c in cols]), " | ")


def oversized_parts(c: Column, budget: int, margin: int = 80) -> Column:
    """A text within the budget as it is; a longer one in marked parts of budget - margin characters."""
    size = max(1, budget - margin)
    parts = F.transform(chunks(c, size), lambda x, i: F.concat(F.lit("[part "), (i + 1).cast("string"), F.lit("] "), x))
    return F.when(F.length(c) <= budget, F.array(c)).otherwise(parts)


def page_range(pages: Column) -> Column:
    """'3' or '3-7' of an array of page numbers."""
    low, high = F.array_min(pages), F.array_max(pages)
    return F.when(low.isNull(), "").when(low == high, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("-"), high.cast("string")))


def padded_cells(cells: Column, width: int = 15) -> list[Column]:
    """col_01 ... of an array of cells, absent cells empty."""
    return [F.coalesce(F.get(cells, F.lit(i)), F.lit("")).alias(f"col_{i + 1:02d}") for i in range(width)]


def ok_reply(c: Column) -> Column:
    """Whether a reply's outermost braces hold {"ok": true}."""
    return F.coalesce(F.get_json_object(F.regexp_extract(text_or_empty(c), r"(?s)\{.*\}", 0), "$.ok") == "true", F.lit(False))
