"""Golden vectors of the scalar functions."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions import clean as C
from ledgerflow.functions import similarity as S
from ledgerflow.functions import text as T


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_amounts(spark):
    given = {"28,630.00": 28630.0, "1,06,710.00": 106710.0, "20,07,983.49": 2007983.49, "Rs. 0.00": 0.0, "28,630.00 Cr": 28630.0, "13,896.00 Dr": 13896.0, "(1,200.00)": -1200.0, "500": 500.0, "(-5)": 5.0, "₹ 7": 7.0, None: None, "": None, "  ": None, "abc": None, "ICICI Bank": None, "DL/25-26/191": None}
    assert column(spark, given, C.parse_amount) == list(given.values())
    assert column(spark, ["5", "5,0", "(5)", "5 Cr", "x", "", None], C.amount_confidence) == [95, 92, 90, 90, 10, 0, 0]
    assert column(spark, ["5 Cr", "5 dr", "5", None], C.balance_side) == ["Cr", "Dr", "", ""]
    assert column(spark, ["5 Cr", "5", "x", ""], C.balance_confidence) == [94, 90, 10, 0]


def test_dates(spark):
    day = date(2025, 4, 1)
    given = {"22-04-2025": date(2025, 4, 22), "1-4-2025": day, "01-04-25": day, "1-Apr-25": day, "01/04/2025": day, "April 1 2025": day, "1-APR-2025": day, "01.04.2025": day, "Apr 1, 2025": day, "22-Apr-25": date(2025, 4, 22), "30-5-2026": date(2026, 5, 30), "01-04-75": date(1975, 4, 1), "01-04-68": date(2068, 4, 1), None: None, "": None, "not-a-date": None, "2025": None, "Sales": None, "31-02-2025": None, "001-04-2025": None}
    assert column(spark, given, C.parse_date) == list(given.values())
    assert column(spark, ["01-04-2025", "01-04-25", "1-Apr-25", "1-Apr-2025", "x", ""], C.date_confidence) == [96, 88, 88, 92, 15, 0]
    assert column(spark, ["2025-04-01T10", "2025-13-01", "", None], C.iso_date) == [day, None, None, None]


@pytest.mark.parametrize(
    ("text", "amount", "dated", "typed", "kind", "reason"),
    [
        ("Opening Bal. = Rs. 0.00", 1, 0, 0, "OpeningBalance", False), ("By Closing Balance 13,896.00", 1, 0, 0, "ClosingBalance", False), ("Total 20,07,983.49 20,07,983.49", 1, 0, 0, "Total", False), ("17,75,015.00 17,61,119.00", 1, 0, 0, "Total", True),
        ("Carried Over", 0, 0, 0, "CarriedForward", False), ("Brought Forward", 0, 0, 0, "BroughtForward", False), ("1-Apr-26 To Opening Balance 13,896.00", 1, 1, 0, "OpeningBalance", False), ("Totals c/o 5", 1, 0, 0, "CarriedForward", False),
        ("Totals b/d 5", 1, 0, 0, "BroughtForward", False), ("Debit Balance 5", 1, 0, 0, "ClosingBalance", True), ("Grand Total 5", 1, 0, 0, "GrandTotal", False), ("Sale 5", 1, 1, 1, "Transaction", False), ("words 5", 1, 0, 0, "Transaction", True), ("", 0, 0, 0, "Unknown", True), ("note", 0, 0, 0, "Unknown", True),
    ],
)
def test_record_kind(spark, text, amount, dated, typed, kind, reason):
    got = spark.range(1).select(C.record_kind(F.lit(text), F.lit(bool(amount)), F.lit(bool(dated)), F.lit(bool(typed))).alias("r")).first()["r"]
    assert (got["kind"], bool(got["reason"])) == (kind, reason)


def test_references(spark):
    given = {"SA/PB/2425/017": "SAPB2425017", "64858/SA/PB/2425/017SC": "64858SAPB2425017SC", "  DL / 25-26 / 191  ": "DL2526191", "DL.25.26.191": "DL2526191", "cn/dl/25-26/063": "CNDL2526063", "--": "", None: ""}
    assert column(spark, given, C.normalize_reference) == list(given.values())
    assert column(spark, [None, "None", "", "  ", "nan", "NaN", "null", "-", "--", "NONE", "ABC123", "0", "X-1"], C.is_missing_reference) == [True] * 10 + [False] * 3


def test_names_and_reasons(spark):
    assert column(spark, ["GOOD LUCK", "a:b/c?*[]", "", "///", "x" * 40], C.sheet_name) == ["GOOD LUCK", "abc", "Ledger", "Ledger", "x" * 31]
    assert column(spark, ["Good  Luck! - Apr 2025", "Acme-2025", "a_b", " - ", None], C.slug) == ["good_luck", "acme", "a_b", "reference_workbook", "reference_workbook"]
    assert column(spark, ["Low date confidence.; Other."], lambda c: C.without_reasons(c, "date")) == ["Other."]
    assert column(spark, [100.0, 85.0, 75.0, 50.0], C.confidence_band, "double") == ["high", "acceptable", "needs_review", "unmatched"]
    assert column(spark, ["yes", "TRUE", "1", "no", None], C.flag) == [True, True, True, False, False]


def test_similarities():
    assert S.indel("kitten", "sitting") == pytest.approx(100 * (1 - 5 / 13))
    assert S.indel("", "") == 100 and S.indel("a", "") == 0
    assert (S.sequence("tide", "diet"), S.sequence("diet", "tide")) == (0.25, 0.5)
    assert S.token_set("date debit credit", "credit date") == 100 and S.token_set("", "a") == 0


def test_indel_is_lcs():
    import random

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = 0
            for j, y in enumerate(b):
                old, row[j + 1] = row[j + 1], old + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in "ab")
        if a or b:
            assert S.indel(a, b) == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)))


def test_chunks_and_parts(spark):
    assert column(spark, ["abcdefg", "", None], lambda c: T.chunks(c, 3)) == [["abc", "def", "g"], [""], [""]]
    assert column(spark, ["x" * 10, "x" * 100], lambda c: F.size(T.oversized_parts(c, 50, 20))) == [1, 4]
    assert column(spark, ["", "abcd", "abcde", None], T.estimated_tokens) == [0, 1, 2, 0]
    assert column(spark, ['{"ok": true} x', "no", None], T.ok_reply) == [True, False, False]
