"""Structure of sheets: profiles from a cells table, presence, set differences, header similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions.similarity import token_set_ratio

#: Words that make a sheet special.
SPECIAL_WORDS = {"summary": ("summary",), "review": ("review",), "audit": ("audit",)}


def profile_sheets(cells: DataFrame, scan_rows: int = 20) -> DataFrame:
    """cells: sheet_name, row, col, value. The header is the row with most filled cells among the first rows; the first of equals."""
    filled = cells.where(~C.is_blank(F.col("value")))
    per_row = filled.groupBy("sheet_name", "row").agg(F.count("*").alias("n"))
    header = per_row.where(F.col("row") <= scan_rows).groupBy("sheet_name").agg(F.max_by("row", F.struct("n", -F.col("row"))).alias("header_row"))
    stats = filled.groupBy("sheet_name").agg(F.countDistinct("row").alias("non_empty_rows"), F.countDistinct("col").alias("non_empty_columns"), F.count_if(C.is_formula(F.col("value"))).alias("formula_count"))
    return stats.join(header, "sheet_name", "left")


def headers(cells: DataFrame, profile: DataFrame) -> DataFrame:
    """sheet_name and its header texts in column order."""
    own = cells.join(profile.select("sheet_name", F.col("header_row").alias("row")), ["sheet_name", "row"]).where(~C.is_blank(F.col("value")))
    return own.groupBy("sheet_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]).alias("headers"))


def presence(left: DataFrame, right: DataFrame, name: str = "sheet_name") -> DataFrame:
    a, b = left.select(name).distinct().withColumn("l", F.lit(True)), right.select(name).distinct().withColumn("r", F.lit(True))
    return a.join(b, name, "full_outer").select(name, F.col("l").isNotNull().alias("in_left"), F.col("r").isNotNull().alias("in_right"))


def missing_names(required: DataFrame, present: DataFrame, name: str = "sheet_name") -> DataFrame:
    return required.select(name).subtract(present.select(name))


def shared_names(left: DataFrame, right: DataFrame, name: str = "sheet_name") -> DataFrame:
    return left.select(name).intersect(right.select(name))


def header_similarity(left: DataFrame, right: DataFrame, scope: str = "pair_id") -> DataFrame:
    """left, right: scope (which two workbooks belong together), sheet_name, pos, headers (array). Best right sheet for each left one; the first of equals.

    Sheets are compared within their scope only: an equality join, whose groups are the sheets of two workbooks."""
    text = lambda c: F.lower(F.array_join(F.filter(c, lambda h: ~C.is_blank(h)), " "))
    a = left.select(scope, "sheet_name", text(F.col("headers")).alias("a"), F.size(F.filter("headers", lambda h: ~C.is_blank(h))).alias("left_header_count"))
    b = right.select(scope, F.col("sheet_name").alias("best_sheet"), F.col("pos"), text(F.col("headers")).alias("b"), F.size(F.filter("headers", lambda h: ~C.is_blank(h))).alias("right_header_count"))
    both = a.join(b, scope)
    score = F.when((F.col("a") == "") & (F.col("b") == ""), 100.0).when((F.col("a") == "") | (F.col("b") == ""), 0.0).otherwise(token_set_ratio("a", "b"))
    w = Window.partitionBy(scope, "sheet_name").orderBy(F.desc("score"), "pos")
    return both.withColumn("score", score).withColumn("n", F.row_number().over(w)).where("n = 1").select(scope, "sheet_name", "best_sheet", F.round("score", 1).alias("header_similarity_score"), "left_header_count", "right_header_count")


def reference_summary(profile: DataFrame) -> DataFrame:
    """A reference workbook's sheets as context; one placeholder row where there is none. profile: sheet_name, headers (array), non_empty_rows."""
    shown = F.filter("headers", lambda h: ~C.is_blank(h))
    low = F.lower(F.array_join(shown, " "))
    like = low.contains("debit") & low.contains("credit")
    summary = F.lower("sheet_name").contains("summary")
    rows = profile.select("sheet_name", F.array_join(shown, " | ").alias("headers"), like.cast("string").alias("is_ledger_like"), summary.cast("string").alias("is_summary_like"), F.col("non_empty_rows").cast("string").alias("non_empty_row_count"))
    blank = profile.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("(no reference profile found)").alias("sheet_name"), *[F.lit("").alias(c) for c in ("headers", "is_ledger_like", "is_summary_like", "non_empty_row_count")])
    return rows.unionByName(blank)


def sheet_samples(cells: DataFrame, profile: DataFrame, rows: int = 3) -> DataFrame:
    """The first rows below each sheet's header as texts: sheet_name, row, values."""
    body = cells.join(profile.select("sheet_name", "header_row"), "sheet_name").where((F.col("row") > F.col("header_row")) & ~C.is_blank(F.col("value")))
    lines = body.groupBy("sheet_name", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]).alias("values"))
    return lines.withColumn("n", F.row_number().over(Window.partitionBy("sheet_name").orderBy("row"))).where(F.col("n") <= rows).drop("n")


def special_sheets(sheets: DataFrame) -> DataFrame:
    low = F.lower("sheet_name")
    kinds = {k: F.bool_or(F.greatest(*[low.contains(w) for w in words], F.lit(False))) for k, words in SPECIAL_WORDS.items()}
    return sheets.agg(*[F.coalesce(v, F.lit(False)).alias(f"has_{k}_sheet") for k, v in kinds.items()], F.count("*").alias("sheet_count"))


def dominant_value(cells: DataFrame, group: str, col: str, pos: str) -> DataFrame:
    """Most frequent value of a group; the earliest of equals."""
    n = cells.groupBy(group, col).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return n.groupBy(group).agg(F.max_by(col, F.struct("n", -F.col("first"))).alias(col))


def column_widths(sheet: DataFrame, sample_rows: int = 200, cap: int = 60) -> DataFrame:
    """Display width of each column: longest text among the first rows and the title, plus two, at most the cap."""
    rows = sheet.limit(sample_rows)
    own = rows.agg(*[F.least(F.greatest(F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)), F.lit(len(c))) + 2, F.lit(cap)).alias(c) for c in sheet.columns])
    return own.unpivot([], list(own.columns), "column", "width")


def compare(left: DataFrame, right: DataFrame) -> dict[str, DataFrame]:
    """Two workbooks' profiles (sheet_name, pos, headers, formula_count, is_ledger) side by side."""
    def side(df, name):
        return df.agg(F.count("*").alias("sheet_count"), F.count_if("is_ledger").alias("ledger_like_sheet_count"), F.sum("formula_count").alias("formula_cells"), *[F.bool_or(F.greatest(*[F.lower("sheet_name").contains(w) for w in words], F.lit(False))).cast("long").alias(f"has_{k}_sheet") for k, words in SPECIAL_WORDS.items()]).unpivot([], None, "metric", name)

    summary = side(left, "left").join(side(right, "right"), "metric", "full_outer")
    scoped = lambda df: df.withColumn("pair_id", F.lit(""))
    similar = header_similarity(scoped(left), scoped(right)).drop("pair_id")
    return {"Comparison_Summary": summary, "Sheet_Presence": presence(left, right), "Header_Similarity": similar, "Shared_Names": shared_names(left, right)}
