"""Multi-page extraction, layout proposals, and the sets of result frames."""

import json

from pyspark.sql import functions as F

from ledgerflow.operators import folds, layout
from ledgerflow.plans import bundles, extraction, quality, reports, standardize, structure
from ledgerflow.sources import files

from .test_matching import ledger as frame
from .test_matching import row
from .test_plans import ROWS, cells

DOC = ("p", "party_ledger", "a.pdf")
WORDS = "pair_id string, ledger_role string, source_file string, page_number int, x0 double, y0 double, x1 double, word_text string"
TABLES = "pair_id string, ledger_role string, source_file string, page_number int, table_index int, cells array<array<string>>"
LINES = "pair_id string, ledger_role string, source_file string, page_number int, line_number int, line_text string"


def line(page, y, *words, doc=DOC):
    return [(*doc, page, float(x), float(y), float(x + 8 * len(w)), w) for x, w in words]


HEAD = ((0, "Date"), (60, "Type"), (150, "Particulars"), (300, "Debit"), (400, "Credit"))


def inputs(spark):
    words = line(1, 20, *HEAD) + line(1, 40, (0, "01-04-2025"), (60, "Sale"), (150, "one"), (300, "100.00")) + line(1, 60, (60, "Rcpt"), (150, "two"), (400, "50.00"))
    words += line(2, 30, (0, "02-04-2025"), (60, "Sale"), (150, "three"), (300, "70.00")) + line(2, 50, (150, "Total"), (300, "170.00"))  # no header of its own
    words += line(1, 30, (150, "no"), (300, "header"), doc=("p", "org_ledger", "b.pdf"))
    tables = [(*DOC, 3, 0, [["Date", "Type", "Debit", "Credit"], ["03-04-2025", "Sale", "5.00"]]), (*DOC, 3, 1, [["Date", "Type", "Debit", "Credit"], ["04-04-2025", "Sale", "6.00"], ["", "Rcpt", "7.00"]]), (*DOC, 3, 2, [["Date", "Type", "Debit", "Credit"], ["x", "y", ""], ["z", "", ""], ["w", "", ""]])]
    lines = [(*DOC, 1, 1, "Acme"), (*DOC, 1, 2, "Account : GOOD LUCK"), (*DOC, 4, 1, "05-04-2025 Sale 9.00"), (*DOC, 4, 2, "Page 4 of 4"), (*DOC, 4, 3, "word"), (*DOC, 4, 4, "no amount here")]
    return spark.createDataFrame(words, WORDS), spark.createDataFrame(tables, TABLES), spark.createDataFrame(lines, LINES)


def test_extract(spark):
    words, tables, lines = inputs(spark)
    errors = spark.createDataFrame([(*DOC, 5, "RuntimeError: broken page")], "pair_id string, ledger_role string, source_file string, page_number int, message string")
    out = extraction.extract(words, tables, lines, errors)
    got = [(r["page_number"], r["extraction_method"], str(r["date"]), r["debit_source"], r["credit_source"], r["record_kind"]) for r in out["rows"].orderBy("source_row_number").collect()]
    assert got[:4] == [(1, "coordinate", "2025-04-01", 100.0, None, "Transaction"), (1, "coordinate", "2025-04-01", None, 50.0, "Transaction"), (2, "coordinate", "2025-04-02", 70.0, None, "Transaction"), (2, "coordinate", "None", 170.0, None, "Total")]
    assert got[4:6] == [(3, "table", "2025-04-04", 6.0, None, "Transaction"), (3, "table", "None", 7.0, None, "Transaction")]  # the table with most rows; dates are not carried in tables
    assert all(g[0] == 4 and g[1] == "text" for g in got[6:])
    assert [r["source_row_number"] for r in out["rows"].orderBy("source_row_number").collect()] == list(range(1, len(got) + 1))
    audit = {(r["source_file"], r["page_number"]): (r["status"], r["rows_emitted"]) for r in out["audit"].collect()}
    assert audit["a.pdf", 1] == ("ok", 2) and audit["a.pdf", 2] == ("ok", 2) and audit["a.pdf", 5] == ("error", 0) and audit["b.pdf", 1] == ("review", 0)
    pages = {(r["source_file"], r["page_number"]): r for r in out["page_analysis"].collect()}
    assert pages["a.pdf", 2]["special_row_count"] == 1 and set(pages["a.pdf", 2]["detected_columns"]) == {"date", "type", "particulars", "debit", "credit"}
    assert pages["a.pdf", 1]["page_confidence"] == 30 + 20 + 3 + 10 + 10
    assert {r["detected_title"] for r in out["identity"].collect()} == {"GOOD LUCK"}
    stats = {r["source_file"]: r for r in out["layout_stats"].collect()}
    assert stats["a.pdf"]["page_count"] == 4 and stats["a.pdf"]["strategies"]["coordinate"] == 2 and stats["b.pdf"]["row_count"] == 0


def test_layout_proposals(spark):
    words, tables, lines = inputs(spark)
    reply = json.dumps({"layout_type": "tabular", "columns": {"Date": "d", "Debit amount": "x", "??": "y"}, "date_carry_forward": True, "ignore_row_patterns": "page", "special_row_patterns": ["total"]})
    page = "pair_id string, ledger_role string, source_file string, page_number int"
    replies = spark.createDataFrame([("p", "org_ledger", "b.pdf", 1, reply, "model"), (*DOC, 1, reply, "model"), (*DOC, 2, '{"columns": "none", "ignore_row_patterns": {}, "special_row_patterns": {"t": ["a", "b"]}}', "model")], page + ", reply string, source string")
    parsed = extraction.parsed_layouts(replies)
    got = {(r["source_file"], r["page_number"]): r for r in parsed.collect()}
    own = got["b.pdf", 1]
    assert own["labels"] == ["Date", "Debit amount", "??"] and own["date_carry_forward"] and own["ignore_row_patterns"] == ["page"] and own["special_row_patterns"] == {"generic": ["total"]} and own["layout_type"] == "tabular"
    assert got["a.pdf", 2]["labels"] == [] and got["a.pdf", 2]["ignore_row_patterns"] == [] and got["a.pdf", 2]["special_row_patterns"] == {"t": ["a", "b"]}
    out = {(r["source_file"], r["page_number"]): r for r in extraction.extract(words, tables, lines, proposals=parsed)["page_analysis"].collect()}
    assert out["b.pdf", 1]["extraction_method"] == "proposed_layout" and out["b.pdf", 1]["page_confidence"] == 8.0 and out["b.pdf", 1]["detected_columns"] == ["date", "debit"] and out["b.pdf", 1]["detail"] == "layout_source=model"
    assert out["a.pdf", 1]["extraction_method"] == "coordinate"  # sure enough: not taken
    analysis = extraction.extract(words, tables, lines)["page_analysis"]
    evidence = {(r["source_file"], r["page_number"]): r for r in extraction.layout_evidence(lines, analysis, 3).collect()}
    assert evidence["a.pdf", 4]["sample_line_count"] == 3 and evidence["a.pdf", 1]["header_texts"] == []


def test_carried_bands_stay_in_their_file(spark):
    words, _, _ = inputs(spark)
    rows = folds.visual_rows(words, extraction.PAGE)
    got = layout.coordinate_strategy(rows, extraction.PAGE, extraction.DOCUMENT).select("source_file", "page_number").distinct().collect()
    assert {tuple(r) for r in got} == {("a.pdf", 1), ("a.pdf", 2)}
    assert {r["page_number"] for r in layout.coordinate_strategy(rows, extraction.PAGE).collect()} == {1}  # without a document nothing is carried


def small_ledger(spark):
    rows = [row("p", "org_ledger", "o1", "A", 10.0), row("p", "party_ledger", "q1", "A", 10.0), row("p", "org_ledger", "o2", "", 7.0, "Unknown"), row("p", "org_ledger", "c", "", 3.0, "ClosingBalance", kind="ClosingBalance"), row("p", "party_ledger", "d", "", 5.0, "ClosingBalance", kind="ClosingBalance")]
    rows += [row("lone", "org_ledger", "x1", "B", 1.0), row("nameless", "org_ledger", "", "C", 1.0), row("nameless", "party_ledger", "y", "C", 1.0)]
    return frame(spark, rows).withColumns({"review_flag": F.col("row_id") == "o2", "review_reason": F.lit(""), "confidence_score": F.lit(95.0), "source_file": F.lit("f"), "page_number": F.lit(1), "account": F.lit("")})


def test_failures_are_isolated(spark):
    given = spark.createDataFrame([("other", "decoder failed")], "pair_id string, error string")
    out = bundles.reconciled(small_ledger(spark), failures=given)
    manifest = {r["pair_id"]: (r["status"], r["records"], r["error"]) for r in out["Run_Manifest"].collect()}
    assert manifest == {"p": ("succeeded", 2, ""), "lone": ("failed", 0, "no party_ledger rows"), "nameless": ("failed", 0, "1 transactions without a row_id"), "other": ("failed", 0, "decoder failed")}
    assert {r["pair_id"] for r in out["Master_Match_Table"].collect()} == {"p"}
    totals = standardize.run_totals(out["Run_Manifest"]).first()
    assert (totals["pairs"], totals["succeeded"], totals["failed"]) == (4, 1, 3)
    assert out["Stats"].first()["strong"] == 1 and out["Formula_Audit"].count() == 0 and out["Unknown_Needs_Review"].first()["source_row_id"] == "o2"


def test_summary_and_annexures(spark):
    out = bundles.reconciled(small_ledger(spark))
    lines = out["Summary_Layout"].orderBy("serial").collect()
    assert [r["serial"] for r in lines] == list(range(1, 22)) and lines[0]["particulars"] == "Opening Balance" and lines[9]["particulars"] == "Closing Balance"
    by = {r["kind"]: r for r in lines[10:]}
    assert by["balance_org"]["org_amount"] == 10.0 and by["closing_diff"]["difference"] == -2.0 and by["matched"]["org_amount"] == 10.0 and by["unmatched_org"]["org_amount"] == 7.0 and by["validation_status"]["status"] == "PASS"
    org = {r["type_label"]: r["source_row_id"] for r in out["Annexure_Org"].collect()}
    assert org["Invoice"] == "o1" and org["Payment"] is None and len(org) == 10
    assert {r["type_label"] for r in out["Annexure_Matches"].collect()} >= {"TDS", "Journal"}
    closing = reports.stated_closing(small_ledger(spark)).where("pair_id = 'p'").first()
    assert (closing["org_closing"], closing["party_closing"]) == (3.0, 5.0)


def test_audits(spark):
    matches = bundles.reconciled(small_ledger(spark))["Master_Match_Table"]
    bad = matches.withColumns({"org_reference": F.lit("=A1"), "amount_difference": F.lit(1.0)})
    assert {r["column_name"] for r in quality.evidence_violations(bad).collect()} == {"org_reference"} and quality.evidence_violations(matches).count() == 0
    assert quality.recomputed_differences(bad).count() == bad.count() and quality.recomputed_differences(matches).count() == 0
    assert quality.recomputed_differences(matches.withColumn("review_required", ~F.col("review_required"))).count() == matches.count()
    summary = reports.label_summary(small_ledger(spark))
    assert quality.recomputed_summary(summary, small_ledger(spark)).count() == 0
    assert quality.recomputed_summary(summary.withColumn("org_amount", F.col("org_amount") + 1), small_ledger(spark)).count() == summary.count()
    report = {r["check"]: (r["status"], r["count"]) for r in quality.match_report(small_ledger(spark).where("row_id <> 'o2'"), matches, source=small_ledger(spark)).where("pair_id = 'p'").collect()}
    assert report["rows_dropped"] == ("FAIL", 1.0)
    assert quality.rows_dropped(small_ledger(spark), small_ledger(spark)).count() == 0


def test_inspection(spark):
    ledger = small_ledger(spark)
    out = bundles.reconciled(ledger)
    got = {r["metric"]: r["value"] for r in bundles.inspect(out, ledger.where("pair_id = 'p'")).collect()}
    assert (got["master_data_rows"], got["matched_strong"], got["candidate_review"], got["unmatched"]) == (2, 1, 0, 1)
    assert got["annexure_count"] == got["configured_label_count"] == 10 and got["transaction_rows_type_unknown"] == 1 and got["special_rows"] == 2 and got["review_queue_count"] == 3
    assert all(got[k] == 0 for k in ("missing_required_sheets", "strong_matches_missing_reference", "validation_fail_count", "formula_audit_fail_count", "master_manual_fields_nonblank", "review_queue_manual_fields_nonblank", "amount_difference_drift", "untraceable_rows"))
    del out["Annexure_Metrics"], out["Difference_Audit"]
    short = {r["metric"]: r["value"] for r in bundles.inspect({k: v for k, v in out.items()}, ledger, ["A"]).collect()}
    assert short["configured_label_count"] == 1 and "annexure_count" not in short


def test_formalized_set(spark):
    from ledgerflow.plans import reconcile

    rows = reconcile.formalize(cells(spark, ROWS))
    out = bundles.formalized(rows)
    assert list(out) == ["Org_Ledger", "Party_Ledger", "Extraction_Audit", "Page_Analysis", "Validation_Report", "Review_Queue"]
    checks = {(r["scope"], r["check"]): r["status"] for r in out["Validation_Report"].collect()}
    assert checks["workbook", "source_pdfs_discovered"] == "FAIL" and checks["party_ledger", "opening_balance_captured"] == "PASS" and checks["workbook", "no_reconciliation_performed"] == "PASS"
    page = out["Page_Analysis"].first()
    assert (page["rows"], page["transactions"], page["special"]) == (5, 3, 2) and out["Extraction_Audit"].first()["rows_emitted"] == 5


def test_raw_context(spark, tmp_path):
    page = "pair_id string, ledger_role string, source_file_name string, page_number int, "
    src = ("p", "org_ledger", "a.pdf")
    found = spark.createDataFrame([(*src, "/a.pdf", 3, "ff")], "pair_id string, ledger_role string, source_file_name string, path string, size_bytes long, sha256 string")
    pages = spark.createDataFrame([(*src, 1, "one\n\ntwo"), (*src, 2, "")], page + "text string")
    blocks = spark.createDataFrame([(*src, 1, 0, "one", 0.0, 1.0, 2.0, 3.0)], page + "block_index int, block_text string, x0 double, y0 double, x1 double, y1 double")
    words = spark.createDataFrame([(*src, 1, 0, "one", 0.0, 1.0, 2.0, 3.0), (*src, 1, 1, "two", 0.0, 1.0, 2.0, 3.0)], page + "word_index int, word_text string, x0 double, y0 double, x1 double, y1 double")
    tables = spark.createDataFrame([(*src, 1, 0, 0, ["a", None], None), (*src, 2, None, None, None, "no tables")], page + "table_index int, table_row_index int, cells array<string>, warning string")
    audit = spark.createDataFrame([(*src, 1, "OK", "", ""), (*src, 2, "ERROR", "bad", "ValueError")], page + "status string, message string, exception_type string")
    out = bundles.raw_context(found, pages, blocks, words, tables, audit)
    assert tuple(out) == bundles.RAW_SHEETS
    s = out["Extraction_Summary"].first()
    assert (s["page_count"], s["extracted_text_pages"], s["extracted_line_count"], s["extracted_word_count"], s["extracted_table_count"], s["extracted_table_row_count"], s["warnings_count"]) == (2, 1, 2, 2, 1, 1, 1)
    r = out["PDF_Tables_Raw"].first()
    assert (r["raw_row_json"], r["col_01"], r["col_02"], r["col_15"]) == ('["a",null]', "a", "", "")
    assert {r["page_number"]: (r["table_count"], r["warning"]) for r in out["PDF_Table_Extraction_Diagnostics"].collect()} == {1: (1, ""), 2: (0, "no tables")}
    bundles.publish({"Extraction_Summary": out["Extraction_Summary"]}, str(tmp_path / "own"), str(tmp_path / "central"))
    assert files.read_bundle(spark, str(tmp_path / "central"), ["Extraction_Summary"])["Extraction_Summary"].count() == 1
    assert "PDF_Words" in out["README"].first()["info"]


def test_reference_profile(spark):
    cells_ = spark.createDataFrame([("L", 1, 1, "Date"), ("L", 1, 2, "Debit"), ("L", 1, 3, "Credit"), ("L", 2, 1, "x"), ("L", 3, 2, "y"), ("My Summary", 1, 1, "a")], "sheet_name string, row int, col int, value string")
    profile = structure.profile_sheets(cells_)
    with_headers = profile.join(structure.headers(cells_, profile), "sheet_name")
    got = {r["sheet_name"]: r for r in structure.reference_summary(with_headers).collect()}
    assert got["L"]["headers"] == "Date | Debit | Credit" and got["L"]["is_ledger_like"] == "true" and got["My Summary"]["is_summary_like"] == "true"
    assert structure.reference_summary(with_headers.limit(0)).first()["sheet_name"] == "(no reference profile found)"
    assert [(r["row"], r["values"]) for r in structure.sheet_samples(cells_, profile).where("sheet_name = 'L'").orderBy("row").collect()] == [(2, ["x"]), (3, ["y"])]
    assert json.loads(files.profile_json(profile)[0])["sheet_name"] == "L"


def test_sheets_and_pairs(spark, tmp_path):
    (tmp_path / "s.csv").write_text("_code,,name,_c7\n1,junk,a,z\n2,junk\n")
    got = files.read_sheet(spark, str(tmp_path / "s.csv"))
    assert got.columns == ["_code", "name", "_c7"] and [tuple(r) for r in got.collect()] == [("1", "a", "z"), ("2", None, None)]
    rows = spark.createDataFrame([("p", "S1", 0, 1, "party_ledger"), ("p", "S2", 1, 1, ""), ("q", "S1", 0, 1, "")], "pair_id string, sheet_name string, sheet_pos int, sheet_row int, ledger_role string")
    assert {(r["pair_id"], r["sheet_name"]): (r["ledger_role"], r["is_pair"]) for r in files.ledger_pair(rows).collect()} == {("p", "S1"): ("party_ledger", True), ("p", "S2"): ("party_ledger", True), ("q", "S1"): ("org_ledger", False)}
    sheets = {"A": spark.range(1).toDF("x"), "B": spark.range(2).toDF("y"), "C": spark.range(9).toDF("z")}
    assert files.union_context(sheets, ["A", "B"]).count() == 3 and files.union_context(sheets, []) is None
    found = spark.createDataFrame([("p", "/1", "old.xlsx", "2025-01-01"), ("p", "/2", "new.xlsx", "2025-02-01"), ("p", "/3", "Reference pick.xlsx", "2024-01-01")], "pair_id string, path string, source_file_name string, modificationTime string")
    assert files.latest(found).first()["path"] == "/2" and files.latest(found, "Reference").first()["path"] == "/3"
    assert [r["pair_id"] for r in files.pairs(found).collect()] == ["p"]
    asked = spark.createDataFrame([("k1",), ("k2",)], "cache_key string")
    store = spark.createDataFrame([("k1", "v"), ("k1", "v")], "cache_key string, value string")
    assert {r["cache_key"]: (r["value"], r["hit"]) for r in files.cached(asked, store).collect()} == {"k1": ("v", True), "k2": (None, False)}
    head = spark.createDataFrame([(["A", "b"], "s", 90.0, 1), (["a", "B"], "s", 70.0, 2)], "headers array<string>, signature string, confidence double, seen_at int")
    known = files.stored_layout(head.limit(1), files.fingerprints(head)).first()
    assert known["known"] and known["usage_count"] == 2
    assert not files.stored_layout(head.withColumn("signature", F.lit("t")).limit(1), files.fingerprints(head)).first()["known"]


def test_visual_lines_are_those_of_the_serial_fold(spark):
    """Rows of words whose heights are near, equal or unknown, against the plain fold; no Python worker takes part."""
    import random

    rng = random.Random(5)
    words = [("p", "org_ledger", f"f{p}", 1, float(rng.randrange(6) * 50), None if rng.random() < 0.02 else rng.randrange(300) / 10 + rng.choice((0, 0.04)), float(i), rng.choice(("a", "b", " ", " ", "\x1c"))) for p in range(12) for i in range(40)]
    df = spark.createDataFrame(words, WORDS)
    for tolerance in (folds.Y_TOLERANCE, 0.05):
        want = set()
        for file in {w[2] for w in words}:
            own = sorted((w for w in words if w[2] == file and w[7].strip()), key=lambda w: (w[5] is None, round((w[5] or 0) * 10), w[4], w[5] or 0))
            anchors, rows = [], []
            for w in own:
                y = float("nan") if w[5] is None else w[5]
                k = next((i for i, a in enumerate(anchors) if abs(a - y) <= tolerance), len(anchors))
                anchors += [y] if k == len(anchors) else []
                rows.append(k)
            place = {k: i + 1 for i, k in enumerate(sorted(range(len(anchors)), key=lambda k: (anchors[k] != anchors[k], anchors[k] if anchors[k] == anchors[k] else k)))}
            if not any(a != a for a in anchors) or tolerance >= 0.1:
                want |= {(file, place[k], w[4], w[6], w[7]) for k, w in zip(rows, own, strict=True)}
        out = folds.visual_rows(df, extraction.PAGE, tolerance)
        got = {(r["source_file"], r["visual_row"], r["x0"], r["x1"], r["word_text"]) for r in out.collect()}
        assert want and {g for g in got if g[0] in {w[0] for w in want}} == want
        assert "InPandas" not in out._jdf.queryExecution().toString()


def test_audit_makes_the_rows_once(spark):
    words, tables, lines = inputs(spark)
    plain, once = extraction.extract(words, tables, lines), extraction.extract(words, tables, lines, kept=False)
    for name in ("rows", "audit", "page_analysis", "layout_stats"):
        assert sorted(map(str, plain[name].collect())) == sorted(map(str, once[name].collect()))
