"""Named sets of result frames, a frame a sheet, in the order of the sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions.text import explode_chunks, explode_lines, padded_cells
from ..operators import ledger as L
from ..operators.labels import TYPE_LABELS
from ..operators.layout import page_analysis
from ..operators.resolve import master_match_table, match_stats
from ..sources.durable import durable
from ..sources.files import run_manifest, write_bundle
from . import quality, reports, standardize, structure

SOURCE = ["pair_id", "ledger_role", "source_file_name"]
PAGE = [*SOURCE, "page_number"]
BOX = ["bbox_x0", "bbox_y0", "bbox_x1", "bbox_y1"]

#: Sheets of each set, in order.
RAW_SHEETS = ("README", "Source_Manifest", "PDF_Page_Text", "PDF_Text_Lines", "PDF_Text_Blocks", "PDF_Words", "PDF_Tables_Raw", "PDF_Table_Extraction_Diagnostics", "Extraction_Audit", "Extraction_Summary")
STANDARD_SHEETS = ("README", "Source_Manifest", "Org_Ledger_Standardized", "Party_Ledger_Standardized", "Opening_Closing_Balances", "Type_Mapping", "Review_Queue", "Validation_Report", "Chunk_Audit", "AI_Audit_Log", "Reference_Workbook_Profile_Summary")


def readme(spark: SparkSession, title: str, sheets: tuple[str, ...]) -> DataFrame:
    """What the set holds: one text."""
    return spark.createDataFrame([(title + "\n\nSheets:\n" + "\n".join(f"  {s}" for s in sheets if s != "README"),)], "info string")


def raw_context(files: DataFrame, pages: DataFrame, blocks: DataFrame, words: DataFrame, tables: DataFrame, audit: DataFrame, method: str = "decoder") -> dict[str, DataFrame]:
    """The raw-context set. files: of discover(); pages: PAGE, text; blocks: PAGE, block_index, block_text, x0, y0, x1, y1; words: PAGE, word_index, word_text, x0, y0, x1, y1;
    tables: PAGE, table_index, table_row_index, cells (array), or a null table_index and a warning; audit: PAGE, status, message, exception_type."""
    spark = files.sparkSession
    box = [F.col(a).alias(b) for a, b in zip(("x0", "y0", "x1", "y1"), BOX, strict=True)]
    manifest = files.select(*SOURCE, F.col("path").alias("source_file_path"), F.col("size_bytes").alias("file_size_bytes"), "sha256", F.lit(method).alias("extraction_methods_used"))
    text = explode_chunks(pages, "text").select(*PAGE, F.lit(method).alias("extraction_method"), "text_chunk_index", "text_chunk", "char_count")
    lines = explode_lines(pages, "text").select(*PAGE, "line_number", "line_text")
    blocks = blocks.select(*PAGE, "block_index", "block_text", *box, F.length(C.text_or_empty(F.col("block_text"))).alias("char_count"))
    words = words.select(*PAGE, "word_index", "word_text", *box)
    found = tables.where("table_index is not null")
    rows = found.select(*PAGE, "table_index", "table_row_index", F.to_json("cells").alias("raw_row_json"), *padded_cells(F.col("cells")))
    diagnostics = tables.groupBy(*PAGE).agg(F.lit(method).alias("method"), F.countDistinct("table_index").alias("table_count"), F.count("table_index").alias("row_count"), F.coalesce(F.max("warning"), F.lit("")).alias("warning"))
    n = lambda df, name: df.groupBy(*SOURCE).agg(F.count("*").alias(name))
    filled = pages.groupBy(*SOURCE).agg(F.countDistinct("page_number").alias("page_count"), F.countDistinct(F.when(~C.is_blank(F.col("text")), F.col("page_number"))).alias("extracted_text_pages"))
    summary = files.select(*SOURCE).join(filled, SOURCE, "left")
    for part in (n(lines, "extracted_line_count"), n(blocks, "extracted_block_count"), n(words, "extracted_word_count"), found.groupBy(*SOURCE).agg(F.countDistinct("page_number", "table_index").alias("extracted_table_count")), n(found, "extracted_table_row_count"), n(audit.where("lower(status) <> 'ok'"), "warnings_count")):
        summary = summary.join(part, SOURCE, "left")
    parts = (manifest, text, lines, blocks, words, rows, diagnostics, audit.select(*PAGE, "status", "message", "exception_type"), summary.na.fill(0))
    return dict(zip(RAW_SHEETS, (readme(spark, "Raw extraction context only: no standardisation, no reconciliation.", RAW_SHEETS), *parts), strict=True))


def formalized(rows: DataFrame, extraction_audit: DataFrame | None = None, usage: DataFrame | None = None) -> dict[str, DataFrame]:
    """The formalised set: both ledgers, extraction audit, page analysis, checks of ledgers and of the whole, review."""
    review = rows.where("review_flag").select("pair_id", "ledger_role", "row_id", "record_kind", "page_number", "source_row_number", "date", "raw_type", "type_label", "particulars", "reference_no", "debit_source", "credit_source", "confidence_score", "review_reason")
    page = ["pair_id", "ledger_role", "source_file", "page_number"]
    if extraction_audit is None:
        extraction_audit = rows.groupBy(*page, "extraction_method").agg(F.lit("ok").alias("status"), F.count("*").alias("rows_emitted"), F.lit("").alias("detail"))
    checks = quality.formal_report(rows).unionByName(quality.workbook_report(rows, usage))
    return {"Org_Ledger": rows.where(rows["ledger_role"] == L.ORG), "Party_Ledger": rows.where(rows["ledger_role"] == L.PARTY), "Extraction_Audit": extraction_audit, "Page_Analysis": page_analysis(rows, page), "Validation_Report": checks, "Review_Queue": review}


def pair_failures(ledger: DataFrame) -> DataFrame:
    """pair_id, error of the pairs that cannot be reconciled: a ledger is missing, or transactions lack an id."""
    by = ledger.groupBy("pair_id").agg(F.count_if(F.col("ledger_role") == L.ORG).alias("org"), F.count_if(F.col("ledger_role") == L.PARTY).alias("party"), F.count_if(C.is_blank(F.col("row_id")) & (F.col("record_kind") == C.TRANSACTION)).alias("nameless"))
    why = F.filter(F.array(F.when(F.col("org") == 0, F.lit("no org_ledger rows")), F.when(F.col("party") == 0, F.lit("no party_ledger rows")), F.when(F.col("nameless") > 0, F.concat(F.col("nameless").cast("string"), F.lit(" transactions without a row_id")))), lambda x: x.isNotNull())
    return by.select("pair_id", F.explode(why).alias("error"))


def reconciled(ledger: DataFrame, labels=None, failures: DataFrame | None = None) -> dict[str, DataFrame]:
    """All result frames of all pairs. Pairs that fail (given, or by pair_failures) are left out and told in Run_Manifest; the others go on.

    failures: pair_id, error of pairs that failed before."""
    bad = pair_failures(ledger)
    bad = durable(bad if failures is None else bad.unionByName(failures.select("pair_id", "error")))
    ledger = ledger.join(bad.select("pair_id").distinct(), "pair_id", "left_anti")
    matches = durable(master_match_table(ledger))
    queue = durable(reports.review_queue(ledger, matches))
    validation = durable(quality.match_report(ledger, matches, queue, ledger))
    audit = quality.evidence_violations(matches)
    sections = reports.annexure_sections(ledger, matches, labels)
    working = L.working_ledger(ledger)
    summary = reports.label_summary(ledger, labels)
    side = lambda df, role: df.where(F.col("ledger_role") == role)
    return {
        "Executive_Summary": reports.executive_snapshot(ledger, matches, validation, queue), "Org_Ledger": side(ledger, L.ORG), "Working_Org_Ledger": side(working, L.ORG), "Party_Ledger": side(ledger, L.PARTY), "Working_Party_Ledger": side(working, L.PARTY),
        "Summary": summary, "Summary_Layout": reports.summary_layout(ledger, matches, validation, audit, labels), "Status_Totals": reports.status_totals(matches), "Master_Match_Table": matches, "Working_Ledger": working,
        "Annexure_Metrics": reports.annexure_metrics(ledger, matches, labels), "Annexure_Org": sections["org"], "Annexure_Party": sections["party"], "Annexure_Matches": sections["matches"],
        "Unknown_Labels": reports.unknown_in_order(reports.unknown_groups(ledger)), "Unknown_Needs_Review": reports.unknown_rows(ledger), "Review_Queue": reports.in_order(queue), "Validation_Report": validation, "Formula_Audit": audit, "Difference_Audit": quality.recomputed_differences(matches), "Stats": match_stats(matches),
        "Run_Manifest": run_manifest(matches, bad),
    }


def standardized(spark: SparkSession, rows: DataFrame, balances: DataFrame, chunk_audit: DataFrame, log: DataFrame, manifest: DataFrame, profile: DataFrame) -> dict[str, DataFrame]:
    """The standardised set. rows, balances: merged results; chunk_audit, log: of standardize.run(); manifest: source files; profile: a reference workbook's sheets."""
    rows = standardize.flagged(rows)
    side = lambda role: rows.where(F.col("ledger_role") == role).drop("new_reasons")
    types = standardize.type_agreement(rows)
    parts = (manifest, side(L.ORG), side(L.PARTY), balances, types, standardize.review_rows(rows, balances), standardize.checks(rows, balances), chunk_audit, log, structure.reference_summary(profile))
    return dict(zip(STANDARD_SHEETS, (readme(spark, "Assisted standardisation only: no matching and no balance decision.", STANDARD_SHEETS), *parts), strict=True))


def publish(bundle: dict[str, DataFrame], folder: str, central: str | None = None, fmt: str = "parquet") -> None:
    """Writes a set, and a copy to a central folder, which is read from the first so that both hold the same."""
    write_bundle(bundle, folder, fmt)
    if central:
        spark = next(iter(bundle.values())).sparkSession
        read = spark.read.option("header", "true") if fmt == "csv" else spark.read
        write_bundle({name: read.format(fmt).load(f"{folder}/{name}") for name in bundle}, central, fmt)


#: Frames that a whole reconciled set has.
REQUIRED = ("Executive_Summary", "Summary", "Master_Match_Table", "Review_Queue", "Validation_Report", "Formula_Audit")


def inspect(bundle: dict[str, DataFrame], ledger: DataFrame, labels=None) -> DataFrame:
    """Counters of a reconciled set, written or not: (metric, value). What must not be there counts as zero."""
    matches, spark = bundle["Master_Match_Table"], ledger.sparkSession
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    status = F.col("match_status")
    unsafe = (status == "matched_strong") & (C.is_missing_reference(F.col("org_normalized_reference")) | C.is_missing_reference(F.col("party_normalized_reference")))
    counted = matches.agg(
        F.count("*").alias("master_data_rows"), n(status == "matched_strong").alias("matched_strong"), n(status == "candidate_review").alias("candidate_review"), n(status.startswith("unmatched")).alias("unmatched"), n(unsafe).alias("strong_matches_missing_reference"),
        n(~C.is_blank(F.col("reviewer_comment")) | ~C.is_blank(F.col("manual_status"))).alias("master_manual_fields_nonblank"), n(C.is_blank(F.col("org_row_id")) & C.is_blank(F.col("party_row_id"))).alias("untraceable_rows"),
    )
    rows = ledger.agg(n((F.col("record_kind") == C.TRANSACTION) & (F.col("type_label") == "Unknown")).alias("transaction_rows_type_unknown"), n(F.col("record_kind").isin(*L.SPECIAL_KINDS)).alias("special_rows"))
    manual = n(F.greatest(*[~C.is_blank(F.col(c)) for c in reports.MANUAL]))
    queue = bundle["Review_Queue"].agg(F.count("*").alias("review_queue_count"), manual.alias("review_queue_manual_fields_nonblank"))
    checks = bundle["Validation_Report"].agg(n(F.col("status") == "FAIL").alias("validation_fail_count"))
    audit = bundle["Formula_Audit"].agg(F.count("*").alias("formula_audit_fail_count"))
    drift = bundle["Difference_Audit"].agg(F.count("*").alias("amount_difference_drift")) if "Difference_Audit" in bundle else None
    names = bundle["Annexure_Metrics"].select("type_label").distinct().agg(F.count("*").alias("annexure_count")) if "Annexure_Metrics" in bundle else None
    fixed = spark.createDataFrame([(len([s for s in REQUIRED if s not in bundle]), len(labels or TYPE_LABELS))], "missing_required_sheets long, configured_label_count long")
    out = None
    for part in (counted, rows, queue, checks, audit, drift, names, fixed):
        if part is not None:
            own = part.unpivot([], list(part.columns), "metric", "value")
            out = own if out is None else out.unionByName(own)
    return out
