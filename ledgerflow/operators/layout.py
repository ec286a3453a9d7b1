"""From words and tables on a page to ledger cells: header detection, column bands, assignment of words, strategies.

Everything after the clustering of words is joins, windows and array functions over (page, row) keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean as C

AMOUNTS = ("debit", "credit", "balance")
HEADER_GAP = 10.0
#: Words of a header label, in the order they are looked for: (key, words, confidence).
HEADER_WORDS = (("date", ("date",), 98.0), ("particulars", ("particular",), 98.0), ("reference", ("ref",), 96.0), ("type", ("type",), 95.0), ("account", ("account",), 95.0), ("balance", ("balance",), 98.0), ("debit", ("debit",), 98.0), ("credit", ("credit",), 98.0), ("voucher", ("vch", "voucher", "bill", "no"), 90.0))
CELLS = {"date": "raw_date", "type": "raw_type", "particulars": "particulars", "account": "account", "voucher": "voucher_no", "reference": "reference_no", "debit": "debit_raw_source", "credit": "credit_raw_source", "balance": "balance_raw_source"}


def header_key(label: Column) -> Column:
    """Canonical column of a header label, or null."""
    low = F.lower(label)
    out = F.lit(None).cast("string")
    for key, words, _ in reversed(HEADER_WORDS):
        hit = F.lit(False)
        for w in words:
            hit |= low.contains(w)
        out = F.when(hit, key).otherwise(out)
    return out


def header_confidence(key: Column) -> Column:
    out = F.lit(70.0)
    for name, _, score in HEADER_WORDS:
        out = F.when(key == name, score).otherwise(out)
    return out


def is_header_text(text: Column) -> Column:
    low = F.lower(text)
    return (low.contains("debit") & low.contains("credit")) | (low.contains("date") & (low.contains("amount") | low.contains("balance")))


def lines_of(rows: DataFrame, page: list[str]) -> DataFrame:
    """Visual rows from words (folds.visual_rows), each with its words from left to right."""
    return rows.groupBy(*page, "visual_row").agg(F.sort_array(F.collect_list(F.struct("x0", "word_text", "x1"))).alias("words"))


def words_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["word_text"]), " ")


def header_rows(lines: DataFrame, page: list[str]) -> DataFrame:
    """The first visual row of each page that reads like a header: page columns, header_row, words."""
    heads = lines.where(is_header_text(words_text(F.col("words"))))
    return heads.groupBy(*page).agg(F.min(F.struct("visual_row", "words")).alias("h")).select(*page, F.col("h.visual_row").alias("header_row"), "h.words")


def detect_columns(heads: DataFrame, page: list[str]) -> DataFrame:
    """page columns, key, x0, x1, confidence, label: header words closer than the gap merge; the first of a key counts."""
    own = heads.select(*page, F.inline("words"))
    w = Window.partitionBy(*page).orderBy("x0", "x1")
    new = F.coalesce((F.col("x0") - F.lag("x1").over(w) > HEADER_GAP).cast("int"), F.lit(0))
    groups = own.withColumn("new", new).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    label = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_text"))), lambda x: x["word_text"]), " ")
    bands = groups.groupBy(*page, "g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), label.alias("label")).withColumn("key", header_key(F.col("label"))).where("key is not null")
    first = F.row_number().over(Window.partitionBy(*page, "key").orderBy("x0"))
    return bands.withColumn("n", first).where("n = 1").select(*page, "key", "x0", "x1", header_confidence(F.col("key")).alias("confidence"), "label")


def columns_from_labels(labels: DataFrame, page: list[str], col: str = "labels") -> DataFrame:
    """Bands 100 wide by position, for tables without coordinates."""
    each = labels.select(*page, F.posexplode(col).alias("i", "label")).withColumn("label", C.clean_text(F.col("label"))).withColumn("key", header_key(F.col("label"))).where("key is not null")
    first = F.row_number().over(Window.partitionBy(*page, "key").orderBy("i"))
    return each.withColumn("n", first).where("n = 1").select(*page, "key", (F.col("i") * 100.0).alias("x0"), ((F.col("i") + 1) * 100.0).alias("x1"), header_confidence(F.col("key")).alias("confidence"), "label")


def page_bands(columns: DataFrame, page: list[str]) -> DataFrame:
    """One row a page: text bands, amount bands, boundaries between text bands, where amounts start, mean confidence."""
    band = F.struct("x0", "x1", "key", ((F.col("x0") + F.col("x1")) / 2).alias("centre"))
    amount = F.col("key").isin(*AMOUNTS)
    b = columns.groupBy(*page).agg(F.array_sort(F.collect_list(F.when(~amount, band))).alias("texts"), F.array_sort(F.collect_list(F.when(amount, band))).alias("amounts"), F.round(F.avg("confidence"), 1).alias("layout_confidence"), F.count("*").alias("n_columns"), F.map_from_entries(F.collect_list(F.struct("key", F.round("confidence", 1)))).alias("column_confidence"))
    first = F.array_min(F.transform("amounts", lambda x: x["centre"]))
    left = F.array_max(F.filter(F.transform("texts", lambda x: x["centre"]), lambda c: c < F.col("first")))
    edge = F.transform(F.sequence(F.lit(1), F.size("texts") - 1), lambda i: (F.get("texts", i - 1)["x1"] + F.get("texts", i)["x0"]) / 2)
    return b.withColumn("first", first).withColumns({"threshold": F.when(F.col("first").isNull(), float("inf")).when(left.isNull(), F.col("first") - 30.0).otherwise((F.col("first") + left) / 2), "boundaries": F.when(F.size("texts") > 1, edge).otherwise(F.array().cast("array<double>"))}).drop("first")


def column_key(word: Column) -> Column:
    """The key of a word's column, beside the bands of its page: amounts (and their Cr/Dr marks) go to the nearest amount band, other words by the boundaries."""
    centre = (word["x0"] + word["x1"]) / 2
    marks = C.looks_like_amount(word["word_text"]) | F.lower(C.strip(word["word_text"])).isin("cr", "dr")
    in_amounts = (F.size("amounts") > 0) & (centre >= F.col("threshold")) & marks
    nearest = F.array_min(F.transform("amounts", lambda a: F.struct(F.abs(a["centre"] - centre).alias("d"), a["x0"].alias("x"), a["key"].alias("key"))))["key"]
    slot = F.least(F.size(F.filter("boundaries", lambda b: word["x0"] >= b)), F.size("texts") - 1)
    return F.when(in_amounts, nearest).when(F.size("texts") > 0, F.get("texts", slot)["key"])


def build_rows(lines: DataFrame, bands: DataFrame, page: list[str], *keep: str) -> DataFrame:
    """lines with the cells by column and the whole text. lines: page columns, visual_row, words (x0, word_text, x1 from left to right); keep: columns of the bands to keep.

    A line is one row throughout, so its words are neither dealt nor gathered again."""
    own = bands.withColumn("column_confidence_json", F.to_json("column_confidence"))
    placed = lines.join(own, page).withColumn("placed", F.transform("words", lambda w: F.struct(w["word_text"].alias("word_text"), column_key(w).alias("key"))))
    cell = lambda key: C.clean_text(words_text(F.filter("placed", lambda w: w["key"] == key)))
    cells = [cell(key).alias(name) for key, name in CELLS.items()]
    return placed.select(*page, "visual_row", *keep, *cells, C.clean_text(words_text(F.col("placed"))).alias("raw_text"), "layout_confidence", "column_confidence_json", "n_columns")


def carried_bands(pages: DataFrame, bands: DataFrame, page: list[str], document: list[str]) -> DataFrame:
    """Bands of every page: its own, else those of the last page above it in its document that has some."""
    own = [c for c in bands.columns if c not in page]
    number = [c for c in page if c not in document]
    last = F.last("b", ignorenulls=True).over(Window.partitionBy(*document).orderBy(*number).rowsBetween(Window.unboundedPreceding, 0))
    joined = pages.select(*page).distinct().join(bands.select(*page, F.struct(*own).alias("b")), page, "left").withColumn("b", last)
    return joined.where("b is not null").select(*page, "b.*")


def coordinate_strategy(rows: DataFrame, page: list[str], document: list[str] | None = None) -> DataFrame:
    """Cells of a page whose words have coordinates; rows above the header stay only if they are markers (typed later).

    document: the columns of `page` that name a file; a page without a header of its own then takes the columns of the last page above it that has one."""
    return coordinate_cells(lines_of(rows, page), page, document)


def coordinate_cells(lines: DataFrame, page: list[str], document: list[str] | None = None) -> DataFrame:
    """coordinate_strategy() of visual lines (folds.visual_lines), which are read up to three times."""
    heads = header_rows(lines, page)
    bands = page_bands(detect_columns(heads, page), page)
    heads = heads.join(bands.select(*page), page, "left_semi").select(*page, "header_row")  # a header counts if it names a column
    if document is not None:
        bands = carried_bands(lines, bands, page, document)
    made = build_rows(lines, bands.join(heads, page, "left"), page, "header_row").where("header_row is null or visual_row <> header_row")
    return made.select("*", F.coalesce(F.col("visual_row") < F.col("header_row"), F.lit(False)).alias("above_header"), F.lit("coordinate").alias("extraction_method")).drop("header_row")


def table_strategy(tables: DataFrame, page: list[str]) -> DataFrame:
    """tables: page columns, table_index, cells (array of arrays). The first row that reads like a header names the columns by position; of a page's tables the one with most rows counts.

    Blank header cells keep their position, so data cells stay aligned with their header."""
    at = lambda r: is_header_text(C.clean_text(F.array_join(r, " ")))
    h = F.array_position(F.transform("cells", at), True)
    t = tables.withColumn("h", h).where("h > 0").withColumn("n_data", F.size("cells") - F.col("h"))
    w = Window.partitionBy(*page).orderBy(F.desc("n_data"), "table_index")
    t = t.withColumn("pick", F.row_number().over(w)).where("pick = 1").withColumn("labels", F.element_at("cells", F.col("h").cast("int")))
    bands = page_bands(columns_from_labels(t, page), page)
    data = t.select(*page, F.posexplode(F.slice("cells", F.col("h").cast("int") + 1, F.greatest(F.col("n_data"), F.lit(1)).cast("int"))).alias("r", "row"))
    cells = F.transform("row", lambda c, i: F.struct((i * 100.0).alias("x0"), C.clean_text(c).alias("word_text"), ((i + 1) * 100.0).alias("x1")))
    lines = data.select(*page, (F.col("r") + 1).alias("visual_row"), F.filter(cells, lambda w: w["word_text"] != "").alias("words")).where(F.size("words") > 0)
    return build_rows(lines, bands, page).withColumns({"above_header": F.lit(False), "extraction_method": F.lit("table"), "layout_confidence": F.least("layout_confidence", F.lit(95.0))})


#: The columns of a page of plain lines without a header.
PLAIN_LABELS = ("Date", "Type", "Particulars", "Voucher", "Debit", "Credit", "Balance")


def text_strategy(lines: DataFrame, page: list[str]) -> DataFrame:
    """lines: page columns, line_number, line_text, without coordinates: words get a place by their lengths. The first line with both debit and credit is
    the header, and one single label; without one the plain labels stand at 60 confidence. Lines of one word, page marks, and lines without an amount are left out."""
    text = C.clean_text(F.col("line_text"))
    clean = lines.select(*page, F.col("line_number").alias("visual_row"), text.alias("t")).where("t <> ''")
    low = F.lower("t")
    head = clean.groupBy(*page).agg(F.min_by("t", F.when(low.contains("debit") & low.contains("credit"), F.col("visual_row"))).alias("head"))
    named = header_key(F.col("head"))
    labels = head.select(*page, "head", F.when(named.isNotNull(), F.array("head")).otherwise(F.array(*map(F.lit, PLAIN_LABELS))).alias("labels"), named.isNull().alias("plain"))
    columns = columns_from_labels(labels, page).join(labels.select(*page, "plain"), page).withColumn("confidence", F.when(F.col("plain"), F.least("confidence", F.lit(60.0))).otherwise(F.col("confidence"))).drop("plain")
    amount = r"(?i)\(?-?\d[\d,]*(?:\.\d+)?\)?(?:\s*(?:cr|dr))?$"
    body = clean.where(~low.contains("page ")).withColumn("parts", F.split("t", " "))
    body = body.where((F.size("parts") > 1) & F.exists("parts", lambda w: w.rlike(amount)))

    def place(acc, w):
        end = acc["at"] + F.greatest(F.lit(20), 6 * F.length(w))
        return F.struct((end + 10).alias("at"), F.concat(acc["words"], F.array(F.struct(acc["at"].cast("double").alias("x0"), w.alias("word_text"), end.cast("double").alias("x1")))).alias("words"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<x0: double, word_text: string, x1: double>>").alias("words"))
    placed = body.select(*page, "visual_row", "t", F.aggregate("parts", none, place, lambda acc: acc["words"]).alias("words"))
    made = build_rows(placed, page_bands(columns, page).join(head, page), page, "t", "head").where(F.coalesce(F.col("t") != F.col("head"), F.lit(True))).drop("t", "head")
    return made.withColumns({"above_header": F.lit(False), "extraction_method": F.lit("text"), "layout_confidence": F.least("layout_confidence", F.lit(75.0))})


def strategy_score(rows: DataFrame, page: list[str], *more: Column) -> DataFrame:
    """Score of a strategy's typed rows on a page, 0 to 100; more: further aggregates of the same rows."""
    tx = F.col("record_kind") == C.TRANSACTION
    n = F.count_if(tx)
    share = lambda cond: F.when(n > 0, 10.0 * F.count_if(tx & cond) / n).otherwise(0.0)
    amount = F.col("debit_source").isNotNull() | F.col("credit_source").isNotNull()
    score = 30.0 + F.least(F.lit(30.0), F.max("n_columns") * 4.0) + F.least(F.lit(20.0), n * 1.5) + share(F.col("date").isNotNull()) + share(amount) - F.least(F.lit(25.0), F.count_if(F.col("record_kind") == C.UNKNOWN) * 2.5)
    return rows.groupBy(*page, "extraction_method").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1).alias("score"), n.alias("transactions"), *more)


def best_strategy(scores: DataFrame, page: list[str], order=("table", "coordinate", "text")) -> DataFrame:
    """The method with the highest score on each page; of equals the earlier in the order."""
    pos = F.lit(len(order))
    for i, name in enumerate(order):
        pos = F.when(F.col("extraction_method") == name, i).otherwise(pos)
    return scores.groupBy(*page).agg(F.max_by("extraction_method", F.struct("score", -pos)).alias("extraction_method"), F.max("score").alias("page_confidence"))


def page_analysis(rows: DataFrame, page: list[str]) -> DataFrame:
    """Counters of the canonical rows of each page."""
    kind = F.col("record_kind")
    return rows.groupBy(*page).agg(F.count("*").alias("rows"), F.count_if(kind == C.TRANSACTION).alias("transactions"), F.count_if(kind == C.UNKNOWN).alias("unknown"), F.count_if(~kind.isin(C.TRANSACTION, C.UNKNOWN)).alias("special"), F.count_if(F.col("date").isNull()).alias("undated"), F.round(F.avg("layout_confidence"), 1).alias("confidence_score"))


def detect_identity(lines: DataFrame, document: list[str], top: int = 12) -> DataFrame:
    """Ledger title from the first lines: 'Account : X', else the line above 'Ledger Account', else the first title line."""
    head = lines.where(F.col("line_number") <= top).withColumn("t", C.clean_text(F.col("line_text")))
    w = Window.partitionBy(*document).orderBy("line_number")
    above = F.last(F.when(F.col("t") != "", F.col("t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    label = F.trim(F.split(F.regexp_extract("t", r"(?i)^account\s*[:\-]\s*(.+)$", 1), r"(?i)\s+from\s+").getItem(0))
    period = F.col("t").rlike(r"(?i)(from\s+.+\s+to\s+.+|\d.+\s+to\s+\d.+)")
    h = head.withColumns({"above": above, "label": F.nullif(label, F.lit(""))})
    first = lambda cond, c="t": F.min_by(c, F.when(cond, F.col("line_number")))
    g = h.groupBy(*document).agg(first(F.lit(True)).alias("owner_company"), first(period).alias("period_text"), first(F.col("label").isNotNull(), "label").alias("a"), first((F.lower("t") == "ledger account") & F.col("above").isNotNull(), "above").alias("b"), first((F.col("line_number") > 1) & (F.col("t") != "")).alias("c"))
    method = F.when(F.col("a").isNotNull(), "account_label").when(F.col("b").isNotNull(), "above_ledger_account").otherwise("fallback_first_line")
    return g.select(*document, F.coalesce("a", "b", "c", "owner_company").alias("detected_title"), "owner_company", F.coalesce("period_text", F.lit("")).alias("period_text"), method.alias("detection_method"), F.when(method == "account_label", 0.95).when(method == "above_ledger_account", 0.9).otherwise(0.4).alias("confidence"))
