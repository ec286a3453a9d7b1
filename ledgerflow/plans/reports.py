"""Summaries, annexures, executive snapshot, review queue, unknown labels: grouped aggregates over the ledger and its matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators.labels import TYPE_LABELS, normalized_type
from ..operators.ledger import ORG, PARTY, recon_rows, special_rows, transactions, unknown_transactions, working_ledger

OPENING, CLOSING = "OpeningBalance", "ClosingBalance"
STATUSES = ("matched_strong", "candidate_review", "unmatched_org", "unmatched_party")
AMOUNT_TOLERANCE = 0.01
LOW_CONFIDENCE = 80.0


def _side(role: str, c: str):
    return F.coalesce(C.exact_sum(F.when(F.col("ledger_role") == role, F.col(c))), F.lit(0.0))


def label_dimension(ledger: DataFrame, labels=None) -> DataFrame:
    """Every pair with every label, in summary order: opening, body labels, closing."""
    names = list(labels or TYPE_LABELS)
    body = [x for x in names if x not in (OPENING, CLOSING)]
    rows = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("serial"), F.lit(x).alias("type_label")) for i, x in enumerate([OPENING, *body, CLOSING])]))
    return ledger.select("pair_id").distinct().select("pair_id", rows.alias("l")).select("pair_id", "l.*")


def label_totals(ledger: DataFrame) -> DataFrame:
    """Net of each label by side, over all record kinds that carry it, as the working ledger states it."""
    w = working_ledger(ledger)
    return w.groupBy("pair_id", "type_label").agg(_side(ORG, "net_org_perspective").alias("org_amount"), _side(PARTY, "net_org_perspective").alias("party_amount"))


def label_summary(ledger: DataFrame, labels=None) -> DataFrame:
    """Opening, body and closing rows with both amounts, their difference and the labels' review counts; absent labels are zero."""
    reviews = ledger.groupBy("pair_id", "type_label").agg(F.count_if(F.coalesce("review_flag", F.lit(False))).alias("review_rows"))
    full = label_dimension(ledger, labels).join(label_totals(ledger), ["pair_id", "type_label"], "left").join(reviews, ["pair_id", "type_label"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    org, party = F.coalesce("org_amount", F.lit(0.0)), F.coalesce("party_amount", F.lit(0.0))
    return full.select("pair_id", "serial", "type_label", org.alias("org_amount"), party.alias("party_amount"), F.round(org - party, 2).alias("difference"), F.when(zero("review_rows") > 0, "Review required").otherwise("Formula-linked").alias("review_status"))


def balances(ledger: DataFrame, labels=None) -> DataFrame:
    """Opening plus movements of the known labels, without the closing row; and the stated closings."""
    s = label_summary(ledger, labels)
    moved = F.when(F.col("type_label") != CLOSING, 1)
    closing = F.when(F.col("type_label") == CLOSING, 1)
    out = s.groupBy("pair_id").agg(*[C.exact_sum(F.when(cond == 1, F.col(f"{side}_amount"))).alias(f"{name}_{side}") for name, cond in (("balance", moved), ("closing", closing)) for side in ("org", "party")])
    return out.withColumns({"net_difference": F.round(F.col("balance_org") - F.col("balance_party"), 2), "closing_difference": F.round(F.col("closing_org") - F.col("closing_party"), 2)})


def status_totals(matches: DataFrame) -> DataFrame:
    """Amounts of both sides by match status, and of all rows under review; one row a pair and line."""
    lines = F.array(F.struct(F.col("match_status").alias("line")), *[F.struct(F.when(F.col("review_required"), F.lit("review_pending")).alias("line"))])
    rows = matches.select("pair_id", "org_amount", "party_amount", F.explode(lines).alias("l")).where("l.line is not null")
    total = lambda c: F.coalesce(C.exact_sum(F.col(c)), F.lit(0.0))
    out = rows.groupBy("pair_id", F.col("l.line").alias("line")).agg(total("org_amount").alias("org_amount"), total("party_amount").alias("party_amount"), F.count("*").alias("rows"))
    return out.withColumn("difference", F.round(F.col("org_amount") - F.col("party_amount"), 2))


def annexure_metrics(ledger: DataFrame, matches: DataFrame, labels=None) -> DataFrame:
    """Section A of each label's annexure; labels without rows are present. Unmatched counts the organisation's side."""
    amount = lambda s: F.coalesce(C.exact_sum(F.when(F.col("match_status") == s, F.col("org_amount"))), F.lit(0.0))
    m = matches.groupBy("pair_id", "type_label").agg(amount("matched_strong").alias("strong_amount"), amount("candidate_review").alias("candidate_amount"), amount("unmatched_org").alias("unmatched_amount"), F.count_if("review_required").alias("review_count"))
    s = label_summary(ledger, labels).select("pair_id", "serial", "type_label", "org_amount", "party_amount", "difference")
    return s.join(m, ["pair_id", "type_label"], "left").na.fill(0, ["review_count"]).na.fill(0.0, ["strong_amount", "candidate_amount", "unmatched_amount"])


def annexure_sections(ledger: DataFrame, matches: DataFrame, labels=None) -> dict[str, DataFrame]:
    """Drill-down rows of every label: both working ledgers and the match records. A label without rows has one row of nulls."""
    names = label_dimension(ledger, labels)
    w = working_ledger(ledger)
    own = lambda role: names.join(w.where(F.col("ledger_role") == role), ["pair_id", "type_label"], "left")
    return {"org": own(ORG), "party": own(PARTY), "matches": names.join(matches, ["pair_id", "type_label"], "left")}


def stated_closing(ledger: DataFrame) -> DataFrame:
    """Closing balance by side; null where none is stated."""
    r = recon_rows(ledger).where(F.col("type_label") == CLOSING)
    side = lambda role: C.exact_sum(F.when(F.col("ledger_role") == role, F.col("net_org")))
    return ledger.select("pair_id").distinct().join(r.groupBy("pair_id").agg(side(ORG).alias("org_closing"), side(PARTY).alias("party_closing")), "pair_id", "left")


#: Columns of the review queue; the last ones are for people and start blank.
QUEUE = ("priority", "source_area", "source_sheet", "source_row_id", "type_label", "date", "reference", "normalized_reference", "amount", "match_status", "reason", "suggested_action", "source_raw_text")
MANUAL = ("reviewer_comment", "manual_decision", "reviewed_by", "reviewed_date")


#: Lines below the labels of the summary: (particulars, kind, review status, remarks).
TAIL = (
    ("Balance as per Org ledger", "balance_org", "Formula-linked", "Opening + movements (org working ledger)."),
    ("Balance as per Party ledger", "balance_party", "Formula-linked", "Opening + movements (party working ledger)."),
    ("Matched Amount", "matched", "Strong matched", "Deterministic strong matches only."),
    ("Candidate Review Amount", "candidate_review", "Review required", "See Review_Queue."),
    ("Unmatched Org Amount", "unmatched_org", "Review required", "See Review_Queue."),
    ("Unmatched Party Amount", "unmatched_party", "Review required", "See Review_Queue."),
    ("Review Pending Amount", "review_pending", "Review required", "See Review_Queue."),
    ("Net Difference", "net_diff", "Formula-linked", "Org closing minus party closing."),
    ("Closing Balance Difference", "closing_diff", "Formula-linked", "Stated closing: org vs party."),
    ("Validation Status", "validation_status", "", "See Validation_Report."),
    ("Formula Audit Status", "formula_audit_status", "", "See Formula_Audit."),
)


def summary_layout(ledger: DataFrame, matches: DataFrame, validation: DataFrame, audit: DataFrame, labels=None) -> DataFrame:
    """The whole summary sheet, a row a line: opening, labels, closing, and the tail with balances, status totals, differences and both statuses.

    validation: pair_id, status; audit: pair_id of every violation."""
    shown = F.when(F.col("type_label") == OPENING, "Opening Balance").when(F.col("type_label") == CLOSING, "Closing Balance").otherwise(F.col("type_label"))
    kind = F.when(F.col("type_label") == OPENING, "opening").when(F.col("type_label") == CLOSING, "closing").otherwise("label")
    text = F.lit(None).cast("string")
    body = label_summary(ledger, labels).select("pair_id", "serial", shown.alias("particulars"), kind.alias("kind"), "org_amount", "party_amount", "difference", "review_status", F.lit("").alias("remarks"), text.alias("status"))
    n = len(labels or TYPE_LABELS)
    t = status_totals(matches).groupBy("pair_id").pivot("line", [*STATUSES, "review_pending"]).agg(F.first("org_amount").alias("org"), F.first("party_amount").alias("party"))
    v = validation.groupBy("pair_id").agg(F.count_if(F.col("status") == "FAIL").alias("bad_checks"))
    a = audit.groupBy("pair_id").agg(F.count("*").alias("bad_cells"))
    wide = balances(ledger, labels).join(t, "pair_id", "left").join(v, "pair_id", "left").join(a, "pair_id", "left").na.fill(0)
    none, col = F.lit(None).cast("double"), F.col
    passed = lambda c: F.when(col(c) > 0, "FAIL").otherwise("PASS")
    value = {
        "balance_org": (col("balance_org"), none, none, text), "balance_party": (none, col("balance_party"), none, text), "net_diff": (none, none, col("net_difference"), text), "closing_diff": (none, none, col("closing_difference"), text),
        "matched": (col("matched_strong_org"), col("matched_strong_party"), F.round(col("matched_strong_org") - col("matched_strong_party"), 2), text),
        **{k: (col(f"{k}_org"), col(f"{k}_party"), F.round(col(f"{k}_org") - col(f"{k}_party"), 2), text) for k in ("candidate_review", "unmatched_org", "unmatched_party", "review_pending")},
        "validation_status": (none, none, none, passed("bad_checks")), "formula_audit_status": (none, none, none, passed("bad_cells")),
    }
    names = ("org_amount", "party_amount", "difference", "status")
    lines = [F.struct(F.lit(n + i + 1).alias("serial"), F.lit(p).alias("particulars"), F.lit(k).alias("kind"), F.lit(r).alias("review_status"), F.lit(m).alias("remarks"), *[x.alias(c) for c, x in zip(names, value[k], strict=True)]) for i, (p, k, r, m) in enumerate(TAIL)]
    tail = wide.select("pair_id", F.explode(F.array(*lines)).alias("l")).select("pair_id", "l.*")
    return body.unionByName(tail)


def unknown_rows(ledger: DataFrame) -> DataFrame:
    """Drill-down of the unknown labels: the unclassified transactions of both ledgers."""
    return working_ledger(unknown_transactions(ledger)).withColumn("normalized_label", normalized_type(F.col("raw_type")))


def review_queue(ledger: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows for people: flagged or uncertain ledger rows, match records under review, closing gaps. Order: `priority_rank`, source_area, source_row_id."""
    blank = lambda *c: F.coalesce(*[F.nullif(F.col(x).cast("string"), F.lit("")) for x in c], F.lit(""))
    r = recon_rows(transactions(ledger))
    repaired = C.flag(F.col("ai_repair_applied")) if "ai_repair_applied" in ledger.columns else F.lit(False)
    flagged, low = F.coalesce("review_flag", F.lit(False)), F.coalesce((F.col("confidence_score") > 0) & (F.col("confidence_score") < LOW_CONFIDENCE), F.lit(False))
    reason = F.when(repaired, "AI-repaired row requires human confirmation.").when(flagged, F.coalesce(F.nullif("review_reason", F.lit("")), F.lit("Row flagged for review during formalization."))).otherwise("Low extraction confidence; otherwise traceable.")
    formal = r.where(flagged | low | repaired).select(
        "pair_id", F.when(repaired | flagged, "MEDIUM").otherwise("LOW").alias("priority"), F.lit("formalization").alias("source_area"), F.col("ledger_role").alias("source_sheet"), F.col("row_id").alias("source_row_id"), "type_label",
        F.coalesce(F.col("match_date").cast("string"), F.lit("")).alias("date"), "reference", F.col("nref").alias("normalized_reference"), F.col("net_org").alias("amount"), F.lit("").alias("match_status"), reason.alias("reason"),
        F.lit("Verify extracted row against the source ledger PDF.").alias("suggested_action"), F.col("raw_text").alias("source_raw_text"),
    )
    gap = F.coalesce(F.col("amount_difference") > AMOUNT_TOLERANCE, F.lit(False))
    high = F.lower("review_reason").rlike("ambiguous|multiple") | gap
    # Suggested actions.
    action = F.when(F.col("match_status") == "unmatched_org", "Locate corresponding party entry or confirm org-only item.").when(F.col("match_status") == "unmatched_party", "Locate corresponding org entry or confirm party-only item.").when(gap, "Resolve amount mismatch against source ledgers before closing.").otherwise("Manually confirm or reject this candidate against source ledgers.")
    recon = matches.where("review_required").select(
        "pair_id", F.when(high, "HIGH").otherwise("MEDIUM").alias("priority"), F.lit("reconciliation").alias("source_area"), F.lit("Master_Match_Table").alias("source_sheet"), blank("org_row_id", "party_row_id", "match_group_id").alias("source_row_id"), "type_label",
        blank("org_date", "party_date").alias("date"), blank("org_reference", "party_reference").alias("reference"), blank("org_normalized_reference", "party_normalized_reference").alias("normalized_reference"), F.coalesce("org_amount", "party_amount").alias("amount"), "match_status",
        F.col("review_reason").alias("reason"), action.alias("suggested_action"), F.array_join(F.filter(F.array("org_particulars", "party_particulars"), lambda x: x != ""), " | ").alias("source_raw_text"),
    )
    c = stated_closing(ledger).where(F.abs(F.abs("org_closing") - F.abs("party_closing")) > AMOUNT_TOLERANCE)
    e = F.lit("")
    closing = c.select(
        "pair_id", F.lit("HIGH").alias("priority"), F.lit("validation").alias("source_area"), F.lit("Summary").alias("source_sheet"), F.lit("closing_balance").alias("source_row_id"), F.lit(CLOSING).alias("type_label"), e.alias("date"), e.alias("reference"), e.alias("normalized_reference"),
        F.round(F.col("org_closing") - F.col("party_closing"), 2).alias("amount"), F.lit("closing_balance_difference").alias("match_status"), F.lit("Stated closing balances differ between org and party ledgers; confirm reconciliation difference.").alias("reason"),
        F.lit("Investigate closing balance gap before sign-off.").alias("suggested_action"), e.alias("source_raw_text"),
    )
    rank = F.when(F.col("priority") == "HIGH", 0).when(F.col("priority") == "MEDIUM", 1).when(F.col("priority") == "LOW", 2).otherwise(9)
    return formal.unionByName(recon).unionByName(closing).withColumns({"priority_rank": rank} | {c: F.lit("") for c in MANUAL})


def unknown_groups(ledger: DataFrame) -> DataFrame:
    """Unknown raw types with counts by side and the first context, organisation's rows first."""
    u = unknown_transactions(ledger).withColumns({"normalized_label": normalized_type(F.col("raw_type")), "context": F.substring(C.first_filled(F.col("particulars"), F.col("raw_text")), 1, 160)})
    seq = F.struct((F.col("ledger_role") != ORG).alias("s"), F.col("source_row_number").alias("n"), F.col("row_id").alias("r"))
    filled = F.when(F.col("context") != "", seq)
    side = lambda role: F.count_if(F.col("ledger_role") == role)
    suggested = {}
    if "ai_label_suggested" in ledger.columns:
        given = F.when(~C.is_blank(F.col("ai_label_suggested")), seq)
        suggested = {"ai_suggested_label": F.coalesce(F.min_by(C.strip(F.col("ai_label_suggested")), given), F.lit("")), "ai_confidence": F.min_by("ai_label_confidence", given), "ai_reason": F.coalesce(F.min_by(C.strip(F.col("ai_label_reason")), given), F.lit(""))}
    return u.groupBy("pair_id", "normalized_label").agg(
        F.min_by(C.strip(F.col("raw_type")), seq).alias("raw_label"), F.count("*").alias("affected_row_count"), side(ORG).alias("org_row_count"), side(PARTY).alias("party_row_count"), F.coalesce(F.min_by("context", filled), F.lit("")).alias("context_sample"),
        F.lit("UnknownNeedsReview").alias("classification_status"), F.lit(True).alias("review_required"), *[v.alias(k) for k, v in suggested.items()],
    )


def in_order(queue: DataFrame) -> DataFrame:
    """The review queue sorted for people."""
    return queue.orderBy("pair_id", "priority_rank", "source_area", "source_row_id")


def unknown_in_order(groups: DataFrame) -> DataFrame:
    """Unknown labels, those with most rows first."""
    return groups.orderBy("pair_id", F.desc("affected_row_count"), "raw_label")


def period_label(ledger: DataFrame) -> DataFrame:
    """First and last month as Apr'25 to Mar'26."""
    r = recon_rows(transactions(ledger)).groupBy("pair_id").agg(F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"))
    month = lambda c: F.date_format(c, "MMM''yy")
    return r.withColumn("period", F.coalesce(F.concat(month("first_date"), F.lit(" to "), month("last_date")), F.lit("")))


def executive_snapshot(ledger: DataFrame, matches: DataFrame, validation: DataFrame, queue: DataFrame) -> DataFrame:
    """One row a pair: status counts, review and failure counts, special rows, amounts."""
    n = matches.groupBy("pair_id").agg(*[F.count_if(F.col("match_status") == s).alias(f"{s}_count") for s in STATUSES])
    q = queue.groupBy("pair_id").agg(F.count("*").alias("review_queue_count"))
    v = validation.groupBy("pair_id").agg(F.count_if(F.col("status") == "FAIL").alias("validation_fail_count"))
    s = special_rows(ledger).groupBy("pair_id").agg(F.count("*").alias("special_rows"))
    out = balances(ledger).join(n, "pair_id", "left").join(q, "pair_id", "left").join(v, "pair_id", "left").join(s, "pair_id", "left").join(period_label(ledger).select("pair_id", "period"), "pair_id", "left").na.fill(0)
    return out.withColumns({"human_review_required": F.when(F.col("review_queue_count") > 0, "YES").otherwise("NO"), "validation_status": F.when(F.col("validation_fail_count") == 0, "PASS").otherwise("FAIL")})


def rollup_totals(ledger: DataFrame) -> DataFrame:
    """Totals by pair and label, by pair, and overall, in one pass (an addition to the summary)."""
    w = working_ledger(ledger)
    return w.rollup("pair_id", "type_label").agg(C.exact_sum(F.col("net_org_perspective")).alias("net"), F.count("*").alias("rows"), F.grouping_id().alias("level"))
