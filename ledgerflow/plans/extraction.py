"""From the words, tables and lines of whole files to typed ledger rows: all strategies on every page, the best of each page, audit.

All pages of all files go through together; only the columns that a page without a header takes from the pages above it, and the row numbers
of a file, are windows over a document. A page with columns of its own keeps them; others take those of the last page with a detected header."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import folds, layout
from ..operators import ledger as L
from ..sources.durable import durable

DOCUMENT = ["pair_id", "ledger_role", "source_file"]
PAGE = [*DOCUMENT, "page_number"]
#: Strategies in the order that decides ties; the reading of pictures is an extension point that yields no rows.
STRATEGIES = ("table", "coordinate", "text", "picture")
PROPOSED = "proposed_layout"
#: Pages below this confidence may take a proposed layout.
ASK_BELOW = 55.0
UNCERTAIN = 70.0


def _typed(rows: DataFrame) -> DataFrame:
    """Typed rows that count, with their confidence; above a header only markers stay."""
    once = L.type_rows(rows)
    once = once.select(F.inline(F.array(F.struct(*once.columns))))  # a filter below would parse every cell again
    typed = L.emitted(once).where(~F.col("above_header") | F.col("record_kind").isin(*L.SPECIAL_KINDS))
    return typed.withColumn("row_confidence", L.row_confidence(F.col("layout_confidence"), F.col("date_parse_confidence"), F.col("amount_parse_confidence"), F.col("record_kind")))


def candidates(words: DataFrame, tables: DataFrame, lines: DataFrame) -> DataFrame:
    """Typed rows of every strategy on every page. words: PAGE, x0, y0, x1, word_text; tables: PAGE, table_index, cells; lines: PAGE, line_number, line_text."""
    each = [*PAGE, "table_index"]
    table = _typed(layout.table_strategy(tables, each))
    sizes = table.groupBy(*each).agg(F.count("*").alias("n")).groupBy(*PAGE).agg(F.max_by("table_index", F.struct("n", -F.col("table_index"))).alias("table_index"))
    table = table.join(sizes, each, "left_semi").drop("table_index")  # of a page's tables the one with most rows
    placed = _typed(layout.coordinate_cells(durable(folds.visual_lines(words, PAGE)), PAGE, DOCUMENT)).withColumn("source_row_number", F.col("visual_row"))
    placed = L.carry_dates(placed).drop("source_row_number")
    text = _typed(layout.text_strategy(lines, PAGE))
    plain = lambda df: df.withColumn("date_carried", F.lit(False))
    return plain(table).unionByName(placed).unionByName(plain(text))


def pages_of(words: DataFrame, tables: DataFrame, lines: DataFrame) -> DataFrame:
    return words.select(*PAGE).unionByName(tables.select(*PAGE)).unionByName(lines.select(*PAGE)).distinct()


def extract(words: DataFrame, tables: DataFrame, lines: DataFrame, errors: DataFrame | None = None, proposals: DataFrame | None = None, ask_below: float = ASK_BELOW, kept: bool = True) -> dict[str, DataFrame]:
    """rows (typed, numbered through each file), page_analysis, audit, identity and layout_stats.

    errors: PAGE, message of pages that could not be read. proposals: PAGE, labels (array), source: layouts proposed elsewhere for pages
    of little confidence; they name columns and add confidence, and never make rows. kept: the typed rows of all strategies are written; without, the
    pages are judged in the one pass that makes the rows, from the columns it takes, and `rows` makes them again."""
    every = candidates(words, tables, lines)
    every = durable(every) if kept else every
    pages = pages_of(words, tables, lines)
    kind = F.col("record_kind")
    unsure = (kind == C.UNKNOWN) | ((kind == C.TRANSACTION) & ((F.col("date_parse_confidence") < UNCERTAIN) | (F.col("amount_parse_confidence") < UNCERTAIN)))
    counts = (
        F.count("*").alias("rows_emitted"), F.count_if(kind == C.TRANSACTION).alias("transaction_row_count"), F.count_if(kind.isin(*L.SPECIAL_KINDS)).alias("special_row_count"), F.count_if(kind == C.UNKNOWN).alias("unknown_row_count"),
        F.count_if(unsure).alias("review_row_count"), F.first("column_confidence_json").alias("column_confidence_json"),
    )
    scores = durable(layout.strategy_score(every, PAGE, *counts).drop("transactions"))
    best = layout.best_strategy(scores, PAGE, STRATEGIES)
    chosen = every.join(best.select(*PAGE, "extraction_method"), [*PAGE, "extraction_method"], "left_semi")
    counts = scores.join(best.select(*PAGE, "extraction_method"), [*PAGE, "extraction_method"], "left_semi").drop("extraction_method", "score")
    zero = ("rows_emitted", "transaction_row_count", "special_row_count", "unknown_row_count", "review_row_count")
    analysis = pages.join(best, PAGE, "left").join(counts, PAGE, "left").na.fill(0, list(zero)).na.fill(0.0, ["page_confidence"]).na.fill(STRATEGIES[0], ["extraction_method"])
    analysis = analysis.withColumn("detected_columns", F.coalesce(F.json_object_keys("column_confidence_json"), F.array().cast("array<string>")))
    if proposals is not None:
        p = proposals.select(*PAGE, F.filter(F.transform("labels", layout.header_key), lambda k: k.isNotNull()).alias("__keys"), F.col("source").alias("__source"))
        analysis = analysis.join(p, PAGE, "left")
        taken = F.coalesce((F.col("page_confidence") < ask_below) & (F.size("__keys") > 0), F.lit(False))
        analysis = analysis.withColumn("__taken", taken).withColumns({
            "extraction_method": F.when(F.col("__taken"), PROPOSED).otherwise(F.col("extraction_method")), "detected_columns": F.when(F.col("__taken"), F.array_distinct("__keys")).otherwise(F.col("detected_columns")),
            "page_confidence": F.when(F.col("__taken"), F.least(F.lit(100.0), F.col("page_confidence") + 8.0)).otherwise(F.col("page_confidence")), "detail": F.when(F.col("__taken"), F.concat(F.lit("layout_source="), F.col("__source"))).otherwise(""),
        }).drop("__keys", "__source", "__taken")
    else:
        analysis = analysis.withColumn("detail", F.lit(""))
    analysis = durable(analysis)
    rows = L.numbered(chosen, "visual_row").drop("above_header", "n_columns", "visual_row")
    detail = F.concat(F.lit("confidence="), F.col("page_confidence"), F.lit("; columns="), F.array_join("detected_columns", ","), F.lit("; unknown_rows="), F.col("unknown_row_count"), F.lit("; review_rows="), F.col("review_row_count"), F.lit("; detail="), F.col("detail"))
    audit = analysis.select(*PAGE, "extraction_method", F.when(F.col("rows_emitted") > 0, "ok").otherwise("review").alias("status"), "rows_emitted", detail.alias("detail"))
    if errors is not None:
        audit = audit.unionByName(errors.select(*PAGE, F.lit("").alias("extraction_method"), F.lit("error").alias("status"), F.lit(0).cast("long").alias("rows_emitted"), F.col("message").alias("detail")))
    identity = layout.detect_identity(lines.join(lines.groupBy(*DOCUMENT).agg(F.min("page_number").alias("page_number")), PAGE, "left_semi"), DOCUMENT)
    used = analysis.groupBy(*DOCUMENT, "extraction_method").agg(F.count("*").alias("n")).groupBy(*DOCUMENT).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("extraction_method", "n")))).alias("strategies"))
    stats = analysis.groupBy(*DOCUMENT).agg(F.count("*").alias("page_count"), F.sum("rows_emitted").alias("row_count"), F.max_by("detected_columns", F.when(F.size("detected_columns") > 0, F.col("page_number"))).alias("detected_columns")).join(used, DOCUMENT)
    return {"rows": rows, "page_analysis": analysis, "audit": audit, "identity": identity, "layout_stats": stats}


def layout_evidence(lines: DataFrame, analysis: DataFrame, sample_lines: int = 30, headers: int = 4) -> DataFrame:
    """What a layout request may hold for a page: detected columns, some header lines, the first lines; never a whole ledger."""
    text = C.clean_text(F.col("line_text"))
    first = lines.where(F.col("line_number") <= sample_lines).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line_number", text.alias("t")))).alias("s"))
    shown = F.transform("s", lambda x: x["t"])
    heads = F.slice(F.filter(shown, layout.is_header_text), 1, headers)
    return analysis.select(*PAGE, "detected_columns", "page_confidence").join(first, PAGE).select(*PAGE, "detected_columns", "page_confidence", heads.alias("header_texts"), shown.alias("sample_lines"), F.size("s").alias("sample_line_count"))


def parsed_layouts(replies: DataFrame) -> DataFrame:
    """replies: PAGE, reply (JSON), source -> PAGE, labels, source, layout_type, date_carry_forward, ignore_row_patterns, special_row_patterns.

    A value of the wrong kind is empty: columns must be an object; a single ignore pattern is a list of one; special patterns are an object of lists, or a list under `generic`."""
    at = lambda k: F.get_json_object("reply", f"$.{k}")
    strings = "array<string>"
    none = F.array().cast(strings)
    columns = F.when(at("columns").startswith("{"), F.json_object_keys(at("columns")))
    ignore = F.when(at("ignore_row_patterns").startswith("["), F.filter(F.from_json(at("ignore_row_patterns"), strings), lambda x: x.isNotNull())).when(at("ignore_row_patterns").isNotNull() & ~at("ignore_row_patterns").startswith("{"), F.array(at("ignore_row_patterns")))
    special = F.when(at("special_row_patterns").startswith("{"), F.from_json(at("special_row_patterns"), "map<string,array<string>>")).when(at("special_row_patterns").startswith("["), F.create_map(F.lit("generic"), F.filter(F.from_json(at("special_row_patterns"), strings), lambda x: x.isNotNull())))
    return replies.select(
        *PAGE, F.coalesce(columns, none).alias("labels"), "source", F.coalesce(at("layout_type"), F.lit("")).alias("layout_type"), F.coalesce(at("date_carry_forward") == "true", F.lit(False)).alias("date_carry_forward"),
        F.coalesce(ignore, none).alias("ignore_row_patterns"), F.coalesce(special, F.create_map().cast("map<string,array<string>>")).alias("special_row_patterns"),
    )
