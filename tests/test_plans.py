"""Reports, validation, extraction, assistance and sources on small fixtures."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import folds, labels, layout, ledger
from ledgerflow.plans import assist, bundles, quality, reconcile, reports, structure
from ledgerflow.sources import files

from .test_matching import ledger as frame
from .test_matching import row


def cells(spark, rows):
    """rows: (n, raw_date, raw_type, voucher, reference, debit, credit, balance, text)"""
    names = "source_row_number int, raw_date string, raw_type string, voucher_no string, reference_no string, debit_raw_source string, credit_raw_source string, balance_raw_source string, raw_text string"
    df = spark.createDataFrame(rows, names)
    return df.select("*", F.lit("p").alias("pair_id"), F.lit("party_ledger").alias("ledger_role"), F.lit("f.pdf").alias("source_file"), F.lit(1).alias("page_number"), F.lit("x").alias("particulars"), F.lit("").alias("account"), F.lit(90.0).alias("layout_confidence"), F.lit("table").alias("extraction_method"), F.lit('{"date": 98.0}').alias("column_confidence_json"))


ROWS = [
    (1, "", "", "", "", "", "", "5.00 Cr", "Opening Balance 5.00 Cr"), (2, "01-04-2025", "Sale", "V1", "R1", "100.00", "", "", "01-04-2025 Sale 100.00"), (3, "", "Rcpt", "", "", "", "(50.00)", "", "Rcpt 50.00"),
    (4, "bad", "zzzqqq", "", "R9", "7", "", "", "bad zzzqqq 7"), (5, "02-04-25", "bank pymt", "", "R2", "", "", "", "02-04-25 bank pymt"), (6, "", "", "", "", "107.00", "50.00", "", "Total 107.00 50.00"),
]


def test_formalize(spark):
    got = {r["source_row_number"]: r for r in reconcile.formalize(cells(spark, ROWS)).collect()}
    assert {n: r["record_kind"] for n, r in got.items()} == {1: "OpeningBalance", 2: "Transaction", 3: "Transaction", 4: "Transaction", 6: "Total"}
    assert got[1]["opening_balance"] == 5.0 and got[1]["type_label"] == "OpeningBalance"
    assert (got[2]["type_label"], got[2]["debit_org_perspective"], got[2]["credit_org_perspective"], got[2]["amount_org_perspective"]) == ("Invoice", None, 100.0, -100.0)
    assert got[2]["review_flag"] and "Multiple reference" in got[2]["review_reason"]
    assert got[3]["date"] == date(2025, 4, 1) and got[3]["date_carried"] and got[3]["type_label"] == "Receipt" and got[3]["amount_org_perspective"] == -50.0
    assert got[4]["type_label"] == "Unknown" and "Unparseable date 'bad'." in got[4]["review_reason"] and got[4]["confidence_score"] < 5
    assert all(len(r["row_id"]) == 12 for r in got.values())
    report = {r["check"]: (r["status"], r["count"]) for r in quality.formal_report(reconcile.formalize(cells(spark, ROWS))).collect()}
    assert report["transaction_row_count"] == ("INFO", 3.0) and report["opening_balance_captured"][0] == "PASS" and report["source_traceability_completeness"] == ("PASS", 100.0)
    assert report["column_confidence"] == ("PASS", 98.0)


def test_labels(spark):
    given = {"Rcpt": "Receipt", "Pymt": "Payment", "Sale": "Invoice", "Purchase": "Invoice", "SlRt": "CreditNote", "PrRt": "DebitNote", "Jrnl": "Journal", "zzzqqq-not-a-type": "Unknown", "": "Unknown", "job work": "OpeningBalance", "sales return x": "CreditNote", "recipt": "Receipt", None: "Unknown"}
    df = spark.createDataFrame([(k,) for k in given], "raw_type string")
    got = {r["raw_type"]: r for r in labels.with_labels(df).collect()}
    assert {k: r["type_label"] for k, r in got.items()} == given
    assert got["recipt"]["match_method"] == "fuzzy" and got["job work"]["match_method"] == "substring" and got[""]["type_review"]


def test_reports(spark):
    rows = [row("p", "org_ledger", "o1", "A", 10.0), row("p", "party_ledger", "q1", "A", 10.0), row("p", "org_ledger", "o2", "", 7.0, "Unknown"), row("p", "org_ledger", "c", "", 3.0, "ClosingBalance", kind="ClosingBalance"), row("p", "party_ledger", "d", "", 5.0, "ClosingBalance", kind="ClosingBalance")]
    df = frame(spark, rows).withColumns({"review_flag": F.col("row_id") == "o2", "review_reason": F.lit(""), "confidence_score": F.lit(95.0), "source_file": F.lit("f"), "page_number": F.lit(1), "account": F.lit("")})
    out = bundles.reconciled(df)
    summary = {r["type_label"]: (r["org_amount"], r["party_amount"]) for r in out["Summary"].collect()}
    assert summary["Invoice"] == (10.0, 10.0) and summary["ClosingBalance"] == (3.0, 5.0) and summary["Payment"] == (0.0, 0.0)
    assert [r["serial"] for r in out["Summary"].orderBy("serial").collect()] == list(range(1, 11))
    status = {r["line"]: (r["org_amount"], r["rows"]) for r in out["Status_Totals"].collect()}
    assert status["matched_strong"] == (10.0, 1) and status["unmatched_org"] == (7.0, 1) and status["review_pending"] == (7.0, 1)
    report = {r["check"]: (r["status"], r["count"]) for r in out["Validation_Report"].collect()}
    assert report["strong_matches_missing_reference"] == ("PASS", 0.0) and report["closing_balance_difference"] == ("REVIEW", -2.0) and report["transaction_rows_type_unknown"] == ("REVIEW", 1.0)
    queue = [(r["priority"], r["source_area"], r["source_row_id"]) for r in out["Review_Queue"].orderBy("priority_rank", "source_area", "source_row_id").collect()]
    assert queue == [("HIGH", "validation", "closing_balance"), ("MEDIUM", "formalization", "o2"), ("MEDIUM", "reconciliation", "o2")]
    assert out["Unknown_Labels"].first()["affected_row_count"] == 1 and out["Difference_Audit"].count() == 0
    top = out["Executive_Summary"].first()
    assert top["matched_strong_count"] == 1 and top["human_review_required"] == "YES" and top["validation_status"] == "PASS" and top["closing_difference"] == -2.0


def test_layout(spark):
    def line(y, *words):
        return [(1, float(x), float(y), float(x + 8 * len(w)), w) for x, w in words]

    words = line(5, (200, "Title")) + line(20, (0, "Date"), (60, "Vch"), (88, "No."), (150, "Particulars"), (300, "Debit"), (400, "Credit"), (500, "Balance"))
    words += line(40, (0, "01-04-2025"), (62, "V7"), (150, "To"), (170, "Sale"), (302, "100.00"), (500, "100.00"), (560, "Dr")) + line(42, (402, "5.00"))
    rows = folds.visual_rows(spark.createDataFrame(words, "page int, x0 double, y0 double, x1 double, word_text string"), ["page"])
    got = {r["visual_row"]: r for r in layout.coordinate_strategy(rows, ["page"]).collect()}
    assert set(got) == {1, 3} and got[1]["above_header"] and not got[3]["above_header"]
    r = got[3]
    assert (r["raw_date"], r["voucher_no"], r["particulars"], r["debit_raw_source"], r["credit_raw_source"], r["balance_raw_source"]) == ("01-04-2025", "V7", "To Sale", "100.00", "5.00", "100.00 Dr")


def test_tables_and_text(spark):
    t = spark.createDataFrame([(1, 0, [["junk"], ["Date", "Type", "", "Debit", "Credit"], ["01-04-2025", "Sale", "n", "5.00", None], ["", "Rcpt", "", "", "6.00"]]), (1, 1, [["Date", "Debit", "Credit"]])], "page int, table_index int, cells array<array<string>>")
    got = [(r["raw_date"], r["raw_type"], r["debit_raw_source"], r["credit_raw_source"]) for r in layout.table_strategy(t, ["page"]).orderBy("visual_row").collect()]
    assert got == [("01-04-2025", "Sale n", "5.00", ""), ("", "Rcpt", "", "6.00")]  # text under a blank header goes to the column on its left
    lines = spark.createDataFrame([(1, 1, "01-04-2025 Sale"), (1, 2, "")], "page int, line_number int, line_text string")
    assert [r["raw_text"] for r in layout.text_strategy(lines, ["page"]).collect()] == ["01-04-2025 Sale"]
    doc = spark.createDataFrame([("a", 1, "Acme Ltd"), ("a", 2, "Account : GOOD LUCK from 1-Apr to 2-Apr"), ("b", 1, "Own"), ("b", 2, "Other Co"), ("b", 3, "Ledger Account"), ("c", 1, "X"), ("c", 2, "Y")], "doc string, line_number int, line_text string")
    got = {r["doc"]: (r["detected_title"], r["confidence"]) for r in layout.detect_identity(doc, ["doc"]).collect()}
    assert got == {"a": ("GOOD LUCK", 0.95), "b": ("Other Co", 0.9), "c": ("Y", 0.4)}


def test_packing_folds(spark):
    units = spark.createDataFrame([("d", i, "x" * 79) for i in range(10)] + [("e", 0, "y" * 999)], "doc string, n int, text string")
    packed = folds.pack_units(units, 240, ["doc"], ["n"])
    chunks = folds.chunk_texts(packed, ["doc"], ["n"]).collect()
    assert sorted(len(c["context_text"]) for c in chunks if c["doc"] == "d") == [79, 239, 239, 239] and all(c["unit_count"] <= 3 for c in chunks)


def test_assist(spark):
    df = frame(spark, [row("p", "party_ledger", "q", "A", 1.0), row("p", "org_ledger", "o", "A", 1.0), row("p", "party_ledger", "r", "A", 1.0)]).withColumns({"raw_date": F.when(F.col("row_id") == "q", "bad").otherwise("01-04-2025"), "normalized_date": F.lit(""), "review_reason": F.lit("Low date confidence."), "review_flag": F.lit(True), "date_parse_confidence": F.lit(15.0), "page_number": F.lit(1)})
    p = spark.createDataFrame([("q", "2025-04-03", 90.0, "x"), ("o", "2025-04-03", 90.0, "x"), ("r", "2025-05-03", 90.0, "x"), ("zz", "2025-05-03", 90.0, "x")], "row_id string, proposed_date string, proposed_confidence double, explanation string")
    got = {r["row_id"]: r for r in assist.apply_date_repairs(df, p).collect()}
    assert got["q"]["ai_repair_applied"] and got["q"]["normalized_date"] == "2025-04-03" and got["q"]["review_reason"] == ""
    assert got["o"]["ai_repair_rejected"] and got["r"]["ai_repair_rejection_reason"].startswith("Conflicts")
    assert [r["row_id"] for r in assist.failed_rows(df, 5).orderBy("row_id").collect()] == ["q", "r"]
    u = frame(spark, [row("p", "org_ledger", "a", "", 1.0, "Unknown")]).withColumns({"raw_type": F.lit("Foo"), "review_reason": F.lit("Type could not be classified."), "page_number": F.lit(1)})
    s = spark.createDataFrame([("foo", "Payment", 80.0, "r")], "raw_type string, suggested_label string, confidence double, reason string")
    assert assist.apply_label_suggestions(u, s).first()["type_label"] == "Payment"
    assert assist.apply_label_suggestions(u, s.withColumn("suggested_label", F.lit("Nope"))).first()["ai_label_rejected"]
    assert assist.unknown_evidence(u).first()["row_count"] == 1


def test_gate_and_retries():
    calls = []

    def send(payload):
        calls.append(payload)
        return (503, "") if len(calls) < 3 else (200, "fine")

    on = assist.Settings.from_env({"LEDGERFLOW_ENABLED": "yes", "LEDGERFLOW_HOSTED": "no", "LEDGERFLOW_BASE_URL": "http://x", "LEDGERFLOW_MODEL": "m", "LEDGERFLOW_RETRIES": "bad"})
    assert on.retries == 2 and assist.complete(on, {}, send, sleep=lambda s: None) == "fine" and len(calls) == 3
    with pytest.raises(PermissionError):
        assist.complete(assist.Settings(), {}, send)
    with pytest.raises(ValueError):
        assist.complete(on, {"x": "y" * 20_000}, send)
    with pytest.raises(RuntimeError):
        assist.complete(on, {}, lambda p: (400, ""), sleep=lambda s: None)


def test_probe():
    on = assist.Settings(enabled=True, hosted=False, base_url="http://x", model="m")
    assert assist.probe(on, lambda p: (200, 'fine: {"ok": true}')) == (True, "")
    assert assist.probe(on, lambda p: (200, '{"ok": 1}')) == (False, "unexpected reply") and assist.probe(on, lambda p: (503, "")) == (False, "provider answered 503")
    assert assist.probe(on, lambda p: (200, "no")) == (False, "ValueError") and assist.probe(assist.Settings(), None) == (False, "not allowed by the settings")


def test_structure(spark):
    cells = spark.createDataFrame([("S", 1, 1, "title"), ("S", 2, 1, "Date"), ("S", 2, 2, "Debit"), ("S", 3, 1, "x"), ("S", 3, 2, "=A1")], "sheet_name string, row int, col int, value string")
    profile = structure.profile_sheets(cells)
    r = profile.first()
    assert (r["header_row"], r["non_empty_rows"], r["non_empty_columns"], r["formula_count"]) == (2, 3, 2, 1)
    assert structure.headers(cells, profile).first()["headers"] == ["Date", "Debit"]
    names = "pair_id string, sheet_name string, pos int, headers array<string>"
    left = spark.createDataFrame([("p", "A", 0, ["Date", "Debit"]), ("p", "B", 1, []), ("q", "A", 0, ["other"])], names)
    right = spark.createDataFrame([("p", "X", 0, ["debit", "date"]), ("p", "Y", 1, ["other"])], names)
    assert {r["sheet_name"]: (r["best_sheet"], r["header_similarity_score"]) for r in structure.header_similarity(left, right).collect()} == {"A": ("X", 100.0), "B": ("X", 0.0)}
    assert structure.special_sheets(spark.createDataFrame([("My Summary",), ("Ledger",)], "sheet_name string")).first()["has_summary_sheet"]
    assert {r["column"]: r["width"] for r in structure.column_widths(spark.createDataFrame([("abcdef",)], "a string")).collect()} == {"a": 8}


def test_files(spark, tmp_path):
    for role, text in (("org_ledger", b"one"), ("party_ledger", b"boom")):
        (tmp_path / "pair_1" / "input" / role).mkdir(parents=True)
        (tmp_path / "pair_1" / "input" / role / "a.pdf").write_bytes(text)
    found = files.discover(spark, str(tmp_path))
    assert [(r["pair_id"], r["ledger_role"], r["size_bytes"]) for r in found.collect()] == [("pair_1", "org_ledger", 3), ("pair_1", "party_ledger", 4)]
    assert files.missing_roles(found).count() == 0

    def decoder(content, path):
        if content == b"boom":
            raise ValueError("bad file")
        yield {"page_number": 1, "line_text": content.decode()}

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    audit = {r["status"]: r["rows"] for r in files.audit_rows(files.decode(raw, decoder, "page_number int, line_text string")).collect()}
    assert audit == {"OK": 1, "ERROR": 0}
    files.write_bundle({"A": spark.range(3).toDF("x")}, str(tmp_path / "out"))
    assert files.read_bundle(spark, str(tmp_path / "out"), ["A"])["A"].count() == 3
    rows = spark.createDataFrame([(json.dumps({"a": 1, "t": "X"}),), ('{"a": "q", "z": 1}',), ("nope",)], "j string")
    got = [r["errors"] for r in files.parse_strict(rows, "j", "a int, t string", ["a", "t"], {"t": ["X"]}).collect()]
    assert got[0] == [] and {"missing t", "unknown z", "bad a"} <= set(got[1]) and got[2] == ["not an object"]
    assert files.label_dictionary(spark).count() == 40


def test_names_windows(spark):
    df = spark.createDataFrame([("p", 1, "Acme"), ("p", 2, "ACME"), ("p", 3, "a/cme"), ("q", 1, "Acme")], "pair string, n int, name string")
    assert [r["sheet_name"] for r in ledger.unique_sheet_names(df, "name", "pair", "n").orderBy("pair", "n").collect()] == ["Acme", "ACME_2", "acme_3", "Acme"]


def test_stream(spark, tmp_path):
    from ledgerflow.streaming import ingest

    df = spark.createDataFrame([("a", "p", "Invoice", 1.0), ("a", "p", "Invoice", 1.0), ("b", "p", "Invoice", 2.0)], "row_id string, pair_id string, type_label string, net double").withColumn("loaded_at", F.lit("2025-04-01").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    rows = ingest.once(ingest.ledger_stream(spark, str(tmp_path / "in"), df.schema))
    q = rows.writeStream.format("memory").queryName("drops").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select * from drops").count() == 2
