"""Validation suites: one wide aggregate a ledger, unfolded to (check, status, count, details) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators.ledger import ORG, PARTY, has_trace, recon_rows, special_rows, transactions
from .reports import AMOUNT_TOLERANCE, stated_closing

CHECK = "struct<check: string, status: string, count: double, details: string>"


def rate(num: Column, den: Column) -> Column:
    """Percent with one decimal; nothing to measure is 100."""
    return F.when(den <= 0, 100.0).otherwise(F.round(100.0 * num / den, 1))


def rate_status(pct: Column, review_below: float = 95.0) -> Column:
    return F.when(pct < review_below, "REVIEW").otherwise("PASS")


def item(check: str, status: Column | str, count: Column, details: str = "") -> Column:
    return F.struct(F.lit(check).alias("check"), (F.lit(status) if isinstance(status, str) else status).alias("status"), count.cast("double").alias("count"), F.lit(details).alias("details"))


def must_be_zero(n: Column, bad: str = "REVIEW") -> Column:
    return F.when(n > 0, bad).otherwise("PASS")


def duplicates(ledger: DataFrame) -> DataFrame:
    """References that several transactions of a ledger share."""
    r = recon_rows(transactions(ledger)).where(~F.col("missing"))
    return r.groupBy("pair_id", "ledger_role", "nref").agg(F.count("*").alias("rows")).where("rows > 1")


def duplicate_suspicion(ledger: DataFrame) -> DataFrame:
    """Rows beyond the first that share date, reference, debit and credit."""
    r = transactions(ledger).where(F.coalesce("normalized_reference", F.lit("")) != "")
    groups = r.groupBy("pair_id", "ledger_role", "normalized_date", "normalized_reference", "debit_source", "credit_source").agg(F.count("*").alias("n")).where("n > 1")
    return groups.groupBy("pair_id", "ledger_role").agg(F.sum(F.col("n") - 1).alias("suspicious_rows"))


def column_confidence(ledger: DataFrame, col: str = "column_confidence_json") -> DataFrame:
    """Mean of all values of the rows' confidence maps."""
    values = F.explode(F.map_values(F.from_json(F.col(col), "map<string,double>")))
    return ledger.select("pair_id", "ledger_role", values.alias("v")).groupBy("pair_id", "ledger_role").agg(F.round(F.avg("v"), 1).alias("column_confidence"))


def formal_report(ledger: DataFrame) -> DataFrame:
    """Checks of each ledger of each pair."""
    has = set(ledger.columns)
    tx = F.col("record_kind") == C.TRANSACTION
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    low = lambda c: (F.col(c) < 70) if c in has else F.lit(False)
    no_amount = F.col("debit_source").isNull() & F.col("credit_source").isNull()
    undated = C.is_blank(F.col("normalized_date").cast("string"))
    flagged = F.coalesce("review_flag", F.lit(False))
    layout = F.avg("layout_confidence") if "layout_confidence" in has else F.lit(None).cast("double")
    agg = ledger.withColumn("extraction_method", F.col("extraction_method") if "extraction_method" in has else F.lit("table")).groupBy("pair_id", "ledger_role").agg(
        F.count("*").alias("n_rows"), n(tx).alias("n_tx"), *[n(F.col("record_kind") == k).alias(f"n_{k}") for k in (C.OPENING, C.CLOSING, C.TOTAL)],
        n(tx & ~undated).alias("dated"), n(tx & ~no_amount).alias("valued"), n(tx & no_amount).alias("unvalued"), n(tx & (F.coalesce("type_label", F.lit("")) != "") & (F.col("type_label") != C.UNKNOWN)).alias("typed"),
        n(tx & C.is_blank(F.col("reference_no"))).alias("no_ref"), n(flagged).alias("flagged"), n(tx & F.col("balance_source").isNotNull() & C.is_blank(F.col("balance_side_source") if "balance_side_source" in has else F.lit(""))).alias("sideless"),
        n(tx & ((~C.is_blank(F.col("raw_date")) & undated) | low("date_parse_confidence"))).alias("bad_dates"), n(tx & low("amount_parse_confidence")).alias("bad_amounts"), n(has_trace()).alias("traced"),
        F.round(layout, 1).alias("layout"), F.round(F.avg("confidence_score"), 1).alias("confidence"),
    )
    agg = agg.join(duplicate_suspicion(ledger), ["pair_id", "ledger_role"], "left").withColumn("dup", F.coalesce("suspicious_rows", F.lit(0)))
    if "column_confidence_json" in has:
        agg = agg.join(column_confidence(ledger), ["pair_id", "ledger_role"], "left")
    else:
        agg = agg.withColumn("column_confidence", F.lit(None).cast("double"))
    col = F.col
    found = lambda c: F.when(col(c) > 0, "PASS").otherwise("REVIEW")
    pct = lambda a, b="n_tx": rate(col(a), col(b))
    checks = [
        item("extracted_row_count", "INFO", col("n_rows"), "All emitted rows."), item("transaction_row_count", "INFO", col("n_tx"), "record_kind=Transaction."),
        item("layout_confidence", rate_status(F.coalesce("layout", F.lit(0.0)), 75), F.floor(F.coalesce("layout", F.lit(0.0))), "Average row-level layout confidence (%)."),
        item("column_confidence", rate_status(F.coalesce("column_confidence", F.lit(0.0)), 75), F.floor(F.coalesce("column_confidence", F.lit(0.0))), "Average detected-column confidence (%)."),
        item("opening_balance_captured", found("n_OpeningBalance"), col("n_OpeningBalance")), item("closing_balance_captured", found("n_ClosingBalance"), col("n_ClosingBalance")), item("total_rows_captured", found("n_Total"), col("n_Total")),
        item("date_parse_success_rate", rate_status(pct("dated")), F.floor(pct("dated"))), item("amount_parse_success_rate", rate_status(pct("valued")), F.floor(pct("valued"))), item("type_classification_success_rate", rate_status(pct("typed"), 90), F.floor(pct("typed"))),
        item("missing_references_count", must_be_zero(col("no_ref")), col("no_ref")), item("duplicate_row_suspicion_count", must_be_zero(col("dup")), col("dup")), item("debit_credit_parse_failures", must_be_zero(col("unvalued")), col("unvalued")),
        item("review_queue_count", must_be_zero(col("flagged")), col("flagged")), item("rows_requiring_review", must_be_zero(col("flagged")), col("flagged")), item("rows_with_ambiguous_balance_handling", must_be_zero(col("sideless")), col("sideless")),
        item("rows_with_date_ambiguity", must_be_zero(col("bad_dates")), col("bad_dates")), item("rows_with_amount_ambiguity", must_be_zero(col("bad_amounts")), col("bad_amounts")),
        item("source_traceability_completeness", F.when(col("traced") == col("n_rows"), "PASS").otherwise("FAIL"), F.floor(pct("traced", "n_rows"))), item("ledger_confidence", rate_status(col("confidence"), 80), F.floor("confidence")),
    ]
    return agg.select("pair_id", F.col("ledger_role").alias("scope"), F.explode(F.array(*checks)).alias("c")).select("pair_id", "scope", "c.*")


def workbook_report(ledger: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """Checks of each pair as a whole: its sources, the confidence of all rows, and what assistance did. usage: pair_id and the five counters."""
    counters = {"ai_usage_count": "AI layout/repair calls.", "ai_cache_hit_count": "AI cache hits.", "ai_cache_miss_count": "AI cache misses.", "ai_repair_applied_count": "Rows with accepted AI date repairs.", "ai_repair_rejected_count": "Failed-row repair proposals rejected."}
    files = F.array_sort(F.collect_set(F.concat(F.col("ledger_role"), F.lit(":"), F.col("source_file"))))
    agg = ledger.groupBy("pair_id").agg(F.countDistinct("ledger_role").alias("n"), F.array_join(files, "; ").alias("files"), F.round(F.avg("confidence_score"), 1).alias("confidence"))
    agg = agg.join(usage, "pair_id", "left") if usage is not None else agg.withColumns({c: F.lit(0) for c in counters})
    agg = agg.na.fill(0, list(counters))
    found = F.struct(F.lit("source_pdfs_discovered").alias("check"), F.when(F.col("n") >= 2, "PASS").otherwise("FAIL").alias("status"), F.col("n").cast("double").alias("count"), F.col("files").alias("details"))
    checks = [found, item("ledger_confidence", rate_status(F.col("confidence"), 80), F.floor("confidence"), "Average confidence across all formalized rows (%).")]
    checks += [item(c, "INFO", F.col(c), text) for c, text in counters.items()]
    checks.append(item("no_reconciliation_performed", "PASS", F.lit(0), "Formalization only: no matching, annexures, or final balances."))
    return agg.select("pair_id", F.lit("workbook").alias("scope"), F.explode(F.array(*checks)).alias("c")).select("pair_id", "scope", "c.*")


#: Cells of a match record that are evidence.
EVIDENCE = ("org_raw_type", "party_raw_type", "org_particulars", "party_particulars", "org_reference", "party_reference", "org_normalized_reference", "party_normalized_reference")


def evidence_violations(matches: DataFrame) -> DataFrame:
    """Evidence cells that hold a formula: pair_id, match_group_id, column_name, cell."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("cell")) for c in EVIDENCE]))
    return matches.select("pair_id", "match_group_id", cells.alias("x")).select("pair_id", "match_group_id", "x.*").where(C.is_formula(F.col("cell")))


def rows_dropped(source: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of a source that the ledger lacks, counted by pair and role; both have row_id."""
    lost = source.join(kept.select("pair_id", "ledger_role", "row_id"), ["pair_id", "ledger_role", "row_id"], "left_anti")
    return lost.groupBy("pair_id", "ledger_role").agg(F.count("*").alias("rows_dropped"))


def match_report(ledger: DataFrame, matches: DataFrame, queue: DataFrame | None = None, source: DataFrame | None = None) -> DataFrame:
    """Checks of each pair's reconciliation. A strong match on a missing reference is the one hard failure. source: rows (pair_id, ledger_role, row_id) that the ledger must hold."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    role, tx = F.col("ledger_role"), F.col("record_kind") == C.TRANSACTION
    rows = ledger.groupBy("pair_id").agg(*[n((role == r) & cond).alias(f"{p}_{k}") for r, p in ((ORG, "org"), (PARTY, "party")) for k, cond in (("rows", F.lit(True)), ("tx", tx))], n(tx & (F.col("type_label") == "Unknown")).alias("unknown"), n(F.col("review_flag")).alias("flagged"))
    special = special_rows(ledger).groupBy("pair_id").agg(n(role == ORG).alias("org_special"), n(role == PARTY).alias("party_special"))
    status = F.col("match_status")
    strong = status == "matched_strong"
    gap = F.col("amount_difference").isNotNull() & (F.abs(F.col("amount_difference") - F.abs(F.abs("org_amount") - F.abs("party_amount"))) > 1e-9)
    m = matches.groupBy("pair_id").agg(
        n(strong).alias("strong"), n(strong & (C.is_missing_reference(F.col("org_normalized_reference")) | C.is_missing_reference(F.col("party_normalized_reference")))).alias("unsafe"), n(F.col("match_rule").contains("fuzzy")).alias("fuzzy"), n(F.col("review_required")).alias("review"),
        n(status == "unmatched_org").alias("u_org"), n(status == "unmatched_party").alias("u_party"), n(F.lower("match_rule").contains("ambiguous")).alias("many"), n(F.col("amount_difference").isNotNull()).alias("differences"), n(gap).alias("difference_gaps"),
        F.sum(sum((C.is_formula(F.col(c)).cast("long") for c in EVIDENCE), F.lit(0))).alias("formulas"),
    )
    dup = duplicates(ledger).groupBy("pair_id").agg(n(role == ORG).alias("dup_org"), n(role == PARTY).alias("dup_party"))
    q = queue.groupBy("pair_id").agg(F.count("*").alias("queue")) if queue is not None else None
    wide = rows.join(special, "pair_id", "left").join(m, "pair_id", "left").join(dup, "pair_id", "left")
    wide = (wide.join(q, "pair_id", "left") if q is not None else wide.withColumn("queue", F.lit(0))).na.fill(0).join(stated_closing(ledger), "pair_id", "left")
    if source is not None:
        wide = wide.join(rows_dropped(source, ledger).groupBy("pair_id").agg(F.sum("rows_dropped").alias("dropped")), "pair_id", "left").na.fill(0, ["dropped"])
    else:
        wide = wide.withColumn("dropped", F.lit(0))
    col = F.col
    close_gap = F.abs(F.abs("org_closing") - F.abs("party_closing"))
    info = lambda check, c: item(check, "INFO", col(c))
    checks = [
        info("org_row_count", "org_rows"), info("party_row_count", "party_rows"), info("org_transaction_count", "org_tx"), info("party_transaction_count", "party_tx"), info("org_special_row_count", "org_special"), info("party_special_row_count", "party_special"),
        item("special_rows_excluded_from_matching", "PASS", col("org_special") + col("party_special"), "Only transactions are matched."), item("transaction_rows_type_unknown", must_be_zero(col("unknown")), col("unknown")), info("review_rows_count", "flagged"),
        info("strong_matches", "strong"), item("strong_matches_missing_reference", must_be_zero(col("unsafe"), "FAIL"), col("unsafe"), "Strong matches must never rely on a missing reference (must be 0)."), info("fuzzy_matches", "fuzzy"), info("review_candidates", "review"),
        info("unmatched_org_rows", "u_org"), info("unmatched_party_rows", "u_party"), info("many_to_one_candidates", "many"), info("duplicate_normalized_references_org", "dup_org"), info("duplicate_normalized_references_party", "dup_party"),
        info("amount_differences_present", "differences"), item("amount_difference_violations", must_be_zero(col("difference_gaps"), "FAIL"), col("difference_gaps")), item("evidence_column_violations", must_be_zero(col("formulas"), "FAIL"), col("formulas")),
        item("rows_dropped", must_be_zero(col("dropped"), "FAIL"), col("dropped"), "Source rows that the ledger lacks."),
        item("closing_balance_difference", F.when(close_gap <= AMOUNT_TOLERANCE, "PASS").otherwise("REVIEW"), F.coalesce(F.round(col("org_closing") - col("party_closing"), 2), F.lit(0.0))), item("review_queue_rows", must_be_zero(col("queue")), col("queue")),
    ]
    return wide.select("pair_id", F.explode(F.array(*checks)).alias("c")).select("pair_id", "c.*")


def recomputed_differences(stored: DataFrame) -> DataFrame:
    """Match rows whose stored amount_difference, date_delta_days or review_required is not what their other cells give (null-safe)."""
    gap = F.round(F.abs(F.abs("org_amount") - F.abs("party_amount")), 6)
    day = lambda c: F.to_date(F.nullif(F.col(c), F.lit("")))
    delta = F.abs(F.datediff(day("org_date"), day("party_date")))
    same = F.round("amount_difference", 6).eqNullSafe(gap) & F.col("date_delta_days").eqNullSafe(delta) & F.col("review_required").eqNullSafe(F.col("match_status") != "matched_strong")
    return stored.where(~same)


def recomputed_summary(stored: DataFrame, ledger: DataFrame, labels=None) -> DataFrame:
    """Lines of a stored label summary whose amounts are not those of the ledger."""
    from .reports import label_summary

    key, cells = ["pair_id", "type_label"], ("org_amount", "party_amount", "difference")
    own = label_summary(ledger, labels).select(*key, *[F.col(c).alias(f"own_{c}") for c in cells])
    bad = [~F.round(c, 2).eqNullSafe(F.round(f"own_{c}", 2)) for c in cells]
    return stored.join(own, key, "full_outer").where(bad[0] | bad[1] | bad[2])
