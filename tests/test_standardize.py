"""Chunk plans, checks and comparison of standardised rows."""

from pyspark.sql import functions as F

from ledgerflow.plans import standardize as Z
from ledgerflow.plans import structure


def test_chunk_plan(spark):
    rows = [("p", s, ("org_ledger", "party_ledger")[page % 2], "f.pdf", page, None, i, "x" * 80) for page in range(1, 9) for i in range(20) for s in ("PDF_Text_Lines",)] + [("p", "Audit", "org_ledger", "f.pdf", 1, None, 0, "no")]
    df = spark.createDataFrame(rows, "pair_id string, sheet_name string, ledger_role string, source_file_name string, page_number int, line_order int, row_order int, line_text string")
    units = Z.context_units(df, ["line_text"])
    assert units.count() == 160
    h = units.orderBy("page_number", "row_order").select(Z.unit_header(F.col("text")).alias("h")).first()["h"]
    assert (h["sheet_name"], h["page_number"], h["ledger_role"], h["source_file_name"], h["line_order"]) == ("PDF_Text_Lines", 1, "party_ledger", "f.pdf", 0)
    chunks = Z.plan_chunks(units, 2000).orderBy("chunk_no").collect()
    assert all(len(c["context_text"]) <= 2000 for c in chunks) and sum(c["unit_count"] for c in chunks) == 160 and chunks[0]["chunk_id"] == "chunk_001" and chunks[0]["page_range"] and chunks[0]["source_files"] == ["f.pdf"]
    assert "more rows omitted" in Z.sheet_text(df, ["pair_id"], "row_order", ["line_text"], 10).first()["sheet_text"]


def test_checks_and_review(spark):
    rows = spark.createDataFrame([("p", "org_ledger", 1, "Sale", "Invoice", "01-04-2025", "t", None, False, 1), ("p", "party_ledger", None, "Sale", "Payment", "bad", "", "old", None, 2)], "pair_id string, ledger_role string, source_page int, raw_type string, canonical_type string, transaction_date string, raw_text string, review_reason string, review_required boolean, row_no int")
    bal = spark.createDataFrame([("p", "org_ledger", "OpeningBalance", 1, "s", True, "why")], "pair_id string, ledger_role string, balance_kind string, source_page int, source_text string, review_required boolean, review_reason string")
    flagged = Z.flagged(rows)
    got = {r["row_no"]: r for r in flagged.collect()}
    assert not got[1]["review_required"] and got[2]["review_reason"] == "old; missing source_page; empty raw_text; unparseable transaction_date"
    report = {(r["check"], r["details"]): r["status"] for r in Z.checks(flagged, bal).collect()}
    assert report["source_page_present", "party"] == "REVIEW" and report["source_page_present", "org"] == "PASS" and report["OpeningBalance_present", "org"] == "PASS" and report["ClosingBalance_present", "org"] == "REVIEW"
    assert sorted(r["item_kind"] for r in Z.review_rows(flagged, bal).collect()) == ["balance", "transaction"]
    a = Z.type_agreement(rows).first()
    assert (a["proposed_type"], a["type_label"], a["agreement"]) == ("Invoice", "Invoice", True)


def test_merges(spark):
    stats = spark.createDataFrame([("p", "org_ledger", 0, ["b", "a"], {"A": 1}), ("p", "org_ledger", 1, ["a", "c"], {"A": 2, "B": 1})], "pair_id string, ledger_role string, pos int, headers array<string>, strategies map<string,int>")
    m = Z.merged_layout(stats).first()
    assert m["headers"] == ["b", "a", "c"] and m["strategies"] == {"A": 3, "B": 1}
    assert Z.run_totals(spark.createDataFrame([("succeeded",), ("failed",)], "status string")).first()["failed"] == 1
    side = spark.createDataFrame([("My Summary", 0, ["a"], 2, False), ("L", 1, ["date"], 0, True)], "sheet_name string, pos int, headers array<string>, formula_count int, is_ledger boolean")
    out = structure.compare(side, side.where("pos = 1"))
    got = {r["metric"]: (r["left"], r["right"]) for r in out["Comparison_Summary"].collect()}
    assert got["sheet_count"] == (2, 1) and got["has_summary_sheet"] == (1, 0) and got["formula_cells"] == (2, 0)


def units_of(spark):
    rows = [(p, "PDF_Text_Lines", ("org_ledger", "party_ledger")[page % 2], "f.pdf", page, i, i, f"line {page} {i} " + "x" * 60) for p in ("good", "bad", "dead") for page in range(1, 5) for i in range(8)]
    return Z.context_units(spark.createDataFrame(rows, "pair_id string, sheet_name string, ledger_role string, source_file_name string, page_number int, line_order int, row_order int, line_text string"), ["line_text"])


def transport(text):
    """A stand-in for a model: answers by the pair and the chunk in the request."""
    import json

    if "pair_id: dead" in text and "chunk_002" in text:
        raise TimeoutError("no answer")
    kind = "Nonsense" if "pair_id: bad" in text and "chunk_002" in text else "Invoice"
    row = {"ledger_role": "org_ledger", "canonical_type": kind, "raw_type": "Sale", "source_page": 1, "transaction_date": "2025-04-01", "debit": 5, "raw_text": "t"}
    balance = {"balance_kind": "OpeningBalance", "ledger_role": "org_ledger", "amount": 7.5, "source_page": 1, "source_file_name": "f.pdf"}
    name = None if "chunk_001" in text else "Acme"
    return json.dumps({"pair_id": "p", "detected_org_name": name, "org_ledger_rows": [row], "party_ledger_rows": [{**row, "ledger_role": "party_ledger"}], "opening_closing_balances": [balance], "extraction_warnings": ["w"]})


def test_run(spark):
    from ledgerflow.operators.labels import TYPE_LABELS
    from ledgerflow.plans import bundles

    out = Z.run(units_of(spark), "Return JSON.", transport, 2600, TYPE_LABELS)
    audit = {(r["pair_id"], r["chunk_id"]): (r["ai_status"], r["validation_status"], r["error_message"]) for r in out["chunk_audit"].collect()}
    n = sum(p == "good" for p, _ in audit)
    assert n > 2 and all(v == ("success", "pass", "") for (p, _), v in audit.items() if p == "good")
    assert audit["bad", "chunk_002"][:2] == ("success", "fail") and "Nonsense" in audit["bad", "chunk_002"][2] and audit["bad", "chunk_003"][:2] == ("pending", "pending")
    assert audit["dead", "chunk_002"] == ("failed", "skipped", "TimeoutError: no answer") and audit["dead", "chunk_001"][1] == "pass"
    assert {(r["pair_id"], r["ledger_role"]): r["n"] for r in out["rows"].groupBy("pair_id", "ledger_role").agg(F.count("*").alias("n")).collect()} == {("good", "org_ledger"): n, ("good", "party_ledger"): n}
    assert [(r["pair_id"], r["amount"]) for r in out["balances"].collect()] == [("good", 7.5)]
    name = out["names"].first()
    assert (name["detected_name"], name["warnings"]) == ("Acme", ["w"])
    assert out["log"].where("stage = 'parsed'").count() == n
    planned = Z.run(units_of(spark), "Return JSON.", transport, 2600, TYPE_LABELS, dry_run=True)
    assert {(r["ai_status"], r["validation_status"]) for r in planned["chunk_audit"].collect()} == {("planned", "skipped")} and planned["rows"].count() == 0
    files = spark.createDataFrame([("good", "f.pdf")], "pair_id string, source_file_name string")
    profile = spark.createDataFrame([], "sheet_name string, headers array<string>, non_empty_rows long")
    book = bundles.standardized(spark, out["rows"], out["balances"], out["chunk_audit"], out["log"], files, profile)
    assert tuple(book) == bundles.STANDARD_SHEETS and book["Org_Ledger_Standardized"].count() == n
    assert book["Type_Mapping"].first()["agreement"] and book["Reference_Workbook_Profile_Summary"].first()["sheet_name"].startswith("(no reference")
    report = {(r["check"], r["details"]): r["status"] for r in book["Validation_Report"].collect()}
    assert report["OpeningBalance_present", "org"] == "PASS" and report["ClosingBalance_present", "org"] == "REVIEW"


def test_reply_problems():
    labels = ["Invoice", "Unknown"]
    ok = '{"pair_id": "p", "org_ledger_rows": [{"ledger_role": "org_ledger", "canonical_type": "Invoice"}]}'
    assert Z.reply_problem(ok, labels) == ""
    for text, part in ((None, "empty"), ("[1]", "not an object"), ("{", "not valid JSON"), ("{}", "lacks pair_id"), ('{"pair_id": "p", "x": 1}', "unknown field x"), ('{"pair_id": 5}', "not a string"), (ok.replace("Invoice", "Other"), "approved label"), (ok.replace('"canonical_type"', '"debit": "5", "canonical_type"'), "debit is not a double"),
                       ('{"pair_id": "p", "org_ledger_rows": {}}', "not an object"), ('{"pair_id": "p", "extraction_warnings": [1]}', "not a string"), ('{"pair_id": "p", "opening_closing_balances": [{"balance_kind": "x", "ledger_role": "r"}]}', "approved kind")):
        assert part in Z.reply_problem(text, labels), text
