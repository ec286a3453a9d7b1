"""Ledger rows: perspective, assembly of typed rows from extracted cells, derived columns, working ledger, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean as C
from .labels import with_labels

ORG, PARTY = "org_ledger", "party_ledger"
#: Labels of rows that are not classified.
FIXED_LABELS = {C.OPENING: "OpeningBalance", C.CLOSING: "ClosingBalance"}
NOT_SPECIAL = (C.TRANSACTION, C.HEADER, C.FOOTER, "")
SPECIAL_KINDS = (C.OPENING, C.CLOSING, C.BALANCE_FORWARD, C.CARRIED, C.BROUGHT, C.TOTAL, C.GRAND_TOTAL)


def transactions(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("record_kind") == C.TRANSACTION)


def special_rows(rows: DataFrame) -> DataFrame:
    return rows.where(~C.text_or_empty(F.col("record_kind")).isin(*NOT_SPECIAL))


def rows_of_kind(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("record_kind") == kind)


def unknown_transactions(rows: DataFrame) -> DataFrame:
    return transactions(rows).where(F.col("type_label") == "Unknown")


def is_emitted() -> Column:
    """Transactions, special rows, and whatever holds an amount."""
    return F.col("record_kind").isin(C.TRANSACTION, *SPECIAL_KINDS) | F.coalesce("debit_source", "credit_source", "balance_source").isNotNull()


def emitted(rows: DataFrame) -> DataFrame:
    return rows.where(is_emitted())


def date_ambiguous(rows: DataFrame) -> DataFrame:
    raw, iso = ~C.is_blank(F.col("raw_date")), C.is_blank(F.col("normalized_date").cast("string"))
    return transactions(rows).where((F.col("date_parse_confidence") < 70) | F.lower(C.text_or_empty(F.col("review_reason"))).contains("date") | (raw & iso))


def has_trace() -> Column:
    """The five fields that tie a row to its source are filled."""
    out = F.lit(True)
    for name in ("source_file", "page_number", "source_row_number", "raw_text", "extraction_method"):
        out &= ~C.is_blank(F.col(name))
    return out


def with_perspective(rows: DataFrame) -> DataFrame:
    """Debit and credit from the organisation's side: the party's book is mirrored."""
    own = F.col("ledger_role") == ORG
    debit, credit = F.when(own, F.col("debit_source")).otherwise(F.col("credit_source")), F.when(own, F.col("credit_source")).otherwise(F.col("debit_source"))
    amount = F.when(debit.isNotNull() | credit.isNotNull(), F.coalesce(debit, F.lit(0.0)) - F.coalesce(credit, F.lit(0.0)))
    return rows.withColumns({"debit_org_perspective": debit, "credit_org_perspective": credit, "amount_org_perspective": amount})


def type_rows(cells: DataFrame) -> DataFrame:
    """Raw text cells (date, debit, credit, balance as text) to typed columns with confidences, kind and reason."""
    parsed = cells.withColumns({
        "__dated": C.dated(F.col("raw_date")),
        "debit_source": C.parse_amount(F.col("debit_raw_source")), "credit_source": C.parse_amount(F.col("credit_raw_source")), "balance_source": C.parse_amount(F.col("balance_raw_source")),
    })
    out = parsed.withColumns({
        "date": F.col("__dated.day"), "date_parse_confidence": C.confidence_of(F.col("__dated")), "balance_side_source": C.balance_side(F.col("balance_raw_source")),
        "amount_parse_confidence": F.greatest(C.amount_confidence(F.col("debit_raw_source"), F.col("debit_source")), C.amount_confidence(F.col("credit_raw_source"), F.col("credit_source")), C.balance_confidence(F.col("balance_raw_source"), F.col("balance_source"))),
        "reference_no": C.first_filled(F.col("reference_no"), F.col("voucher_no")), "voucher_no": C.first_filled(F.col("voucher_no"), F.col("reference_no")),
    })
    kind = C.record_kind(F.col("raw_text"), F.coalesce("debit_source", "credit_source", "balance_source").isNotNull(), C.looks_like_date(F.col("raw_date")), ~C.is_blank(F.col("raw_type")))
    return out.withColumn("__kind", kind).withColumns({"record_kind": F.col("__kind.kind"), "record_kind_reason": F.col("__kind.reason")}).drop("__kind", "__dated")


def row_confidence(layout: Column, date: Column, amount: Column, kind: Column) -> Column:
    raw = layout * 0.45 + date * 0.2 + amount * 0.25 + F.when(kind != C.UNKNOWN, 10.0).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 1)


PAGE = ("pair_id", "ledger_role", "source_file", "page_number")


def carry_dates(rows: DataFrame, counts: Column | None = None) -> DataFrame:
    """Transactions without a date take the last date above them on the page; unparseable dates carry nothing. counts: the rows whose dates count (default: all)."""
    above = Window.partitionBy(*PAGE).orderBy("source_row_number").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("date" if counts is None else F.when(counts, F.col("date")), ignorenulls=True).over(above)
    carried = (F.col("record_kind") == C.TRANSACTION) & F.col("date").isNull() & C.is_blank(F.col("raw_date")) & F.col("__last").isNotNull()
    out = rows.withColumn("__last", last).withColumn("date_carried", carried)
    return out.withColumns({"date": F.when(F.col("date_carried"), F.col("__last")).otherwise(F.col("date")), "date_parse_confidence": F.when(F.col("date_carried"), F.least("date_parse_confidence", F.lit(80.0))).otherwise(F.col("date_parse_confidence"))}).drop("__last")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Row numbers across the pages of a file."""
    return rows.withColumn("source_row_number", F.row_number().over(Window.partitionBy("pair_id", "ledger_role", "source_file").orderBy("page_number", *order)))


def assemble(rows: DataFrame, labels=None, types: DataFrame | None = None) -> DataFrame:
    """Typed rows to canonical rows: label, perspective, balances, confidence, ordered review reasons, row id. types: as in with_labels()."""
    r = with_perspective(with_labels(rows, labels=labels, types=types))
    kind = F.col("record_kind")
    is_tx, classified = kind == C.TRANSACTION, kind.isin(C.TRANSACTION, C.UNKNOWN)
    label = F.when(classified, F.col("type_label")).otherwise("")
    for k, name in FIXED_LABELS.items():
        label = F.when(kind == k, name).otherwise(label)
    no_amount = F.col("debit_source").isNull() & F.col("credit_source").isNull()
    bad_date = ~C.is_blank(F.col("raw_date")) & F.col("date").isNull()
    no_date = C.is_blank(F.col("raw_date")) & F.col("date").isNull()
    score = F.when(classified, F.least(F.lit(100.0), F.col("row_confidence"), F.col("type_confidence"))).otherwise(F.least(F.lit(100.0), F.col("row_confidence")))
    score = score - F.when(is_tx & (bad_date | no_date), 20.0).otherwise(0.0) - F.when(is_tx & no_amount, 40.0).otherwise(0.0)
    two_refs = ~C.is_blank(F.col("reference_no")) & ~C.is_blank(F.col("voucher_no")) & (C.strip(F.col("reference_no")) != C.strip(F.col("voucher_no")))
    # Reason texts of canonical rows, in this order.
    reasons = C.joined_reasons(
        F.when(classified & (F.col("type_reason") != ""), F.col("type_reason")),
        F.when(is_tx & bad_date, F.concat(F.lit("Unparseable date '"), F.col("raw_date"), F.lit("'."))),
        F.when(is_tx & no_date, F.lit("Missing date and no prior date to carry forward.")),
        F.when(is_tx & no_amount, F.lit("No parseable debit or credit amount.")),
        F.when(is_tx & (F.col("date_parse_confidence") < 70), F.lit("Low date confidence.")),
        F.when(is_tx & (F.col("amount_parse_confidence") < 70), F.lit("Low amount confidence.")),
        F.when(is_tx & (F.col("layout_confidence") < 65), F.lit("Low layout confidence.")),
        F.when(is_tx & (F.col("type_band") == "needs_review"), F.lit("Multiple type classifications tie or remain ambiguous.")),
        F.when(kind == C.UNKNOWN, F.lit("Row could not be classified to a known record kind.")),
        F.when(F.col("record_kind_reason") != "", F.col("record_kind_reason")),
        F.when(two_refs, F.lit("Multiple reference interpretations exist.")),
    )
    balance = F.coalesce("balance_source", "debit_source", "credit_source")
    return r.withColumns({
        "type_label": label, "confidence_score": F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1), "review_reason": C.clean_text(reasons), "review_flag": reasons != "",
        "opening_balance": F.when(kind == C.OPENING, balance), "closing_balance": F.when(kind == C.CLOSING, balance),
        "normalized_reference": C.normalize_reference(F.col("reference_no")), "normalized_date": F.coalesce(F.col("date").cast("string"), F.lit("")),
        "row_id": C.row_identity(*[F.col(c) for c in ("ledger_role", "source_file", "page_number", "source_row_number", "raw_text")]),
    })


def recon_rows(rows: DataFrame) -> DataFrame:
    """Columns that matching works on: match_date, reference, nref, missing, net_org, net_source."""
    has = lambda *c: sum((F.coalesce(F.col(x), F.lit(0.0)) != 0).cast("int") for x in c) > 0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    net = F.when(has("debit_org_perspective", "credit_org_perspective"), zero("debit_org_perspective") - zero("credit_org_perspective")).otherwise(zero("amount_org_perspective"))
    text = C.first_filled(F.col("normalized_date").cast("string"), F.col("date").cast("string"), F.col("raw_date").cast("string"))
    return rows.withColumns({
        "match_date": C.iso_date(text), "reference": C.first_filled(F.col("reference_no"), F.col("voucher_no")), "nref": C.strip(F.col("normalized_reference")),
        "missing": C.is_missing_reference(F.col("normalized_reference")), "net_org": net, "net_source": zero("debit_source") - zero("credit_source"),
    })


def working_ledger(rows: DataFrame) -> DataFrame:
    """The enriched projection: period and the two match keys."""
    r = recon_rows(rows)
    money = C.money_text(F.abs("net_org"))
    ref = F.coalesce(F.nullif(F.col("nref"), F.lit("")), C.normalize_reference(F.col("reference")))
    day = F.coalesce(F.col("match_date").cast("string"), F.lit(""))
    return r.select(
        "pair_id", "ledger_role", F.col("row_id").alias("source_row_id"), C.period_month(F.col("match_date")).alias("period"), "record_kind", day.alias("date"), "raw_type", "type_label", "voucher_no", "reference_no",
        ref.alias("normalized_reference"), "particulars", "account", "debit_source", "credit_source", "net_source", "debit_org_perspective", "credit_org_perspective",
        (F.coalesce("debit_org_perspective", F.lit(0.0)) - F.coalesce("credit_org_perspective", F.lit(0.0))).alias("net_org_perspective"),
        F.when(ref != "", F.concat_ws("|", ref, C.text_or_empty(F.col("type_label")), money)).otherwise("").alias("match_key_primary"),
        F.concat_ws("|", C.text_or_empty(F.col("type_label")), money, day).alias("match_key_secondary"),
        F.lit("").alias("match_group_id"), F.lit("").alias("match_status"), "review_flag", "review_reason", "source_file", "page_number", "source_row_number", "raw_text",
    )


def neighbour_dates(rows: DataFrame) -> DataFrame:
    """Dates of the rows numbered one below and one above on the same page, where they exist."""
    w = Window.partitionBy("pair_id", "ledger_role", "source_file", "page_number").orderBy("source_row_number")
    near = lambda f, step: F.when(f("source_row_number").over(w) == F.col("source_row_number") + step, f("normalized_date").over(w))
    return rows.withColumns({"previous_date": near(F.lag, -1), "next_date": near(F.lead, 1)})


def first_samples(rows: DataFrame, key: str, order: str, n: int = 2) -> DataFrame:
    return rows.withColumn("sample_no", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("sample_no") <= n)


def carry_columns(pages: DataFrame, col: str = "columns") -> DataFrame:
    """A page without detected columns takes those of the last page of its file that has some."""
    w = Window.partitionBy("pair_id", "ledger_role", "source_file").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn(col, F.last(F.when(F.size(col) > 0, F.col(col)), ignorenulls=True).over(w))


def unique_sheet_names(names: DataFrame, col: str, scope: str, order: str, reserved: tuple[str, ...] = ()) -> DataFrame:
    """Legal names, made distinct within the scope by _2, _3 ... in 31 characters, whatever their case; a made name may collide again, so the
    sheets of a scope (a workbook) are named one after the other."""
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        used, out = {r.lower() for r in reserved}, []
        for base in rows["sheet_name"]:
            name, n = base, 2
            while name.lower() in used:
                name = f"{base[: 31 - len(f'_{n}')]}_{n}"
                n += 1
            used.add(name.lower())
            out.append(name)
        return rows.assign(sheet_name=out)

    based = names.withColumn("sheet_name", C.sheet_name(F.col(col)))
    return based.groupBy(scope).applyInPandas(fold, based.schema)
