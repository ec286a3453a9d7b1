"""The distributed matcher against a serial one, on random small ledgers with contested references and amounts."""

import random
from datetime import date, timedelta
from difflib import SequenceMatcher

import pytest

from ledgerflow.operators import edges as E
from ledgerflow.operators import resolve as R

SCHEMA = "pair_id string, ledger_role string, row_id string, record_kind string, source_row_number int, normalized_date string, date string, raw_date string, raw_type string, type_label string, particulars string, voucher_no string, reference_no string, normalized_reference string, debit_source double, credit_source double, debit_org_perspective double, credit_org_perspective double, amount_org_perspective double, raw_text string"
MISSING = {"", "none", "nan", "null", "-", "--"}


def row(pair, role, rid, ref, amount, label="Invoice", day="2025-04-01", n=1, kind="Transaction"):
    return (pair, role, rid, kind, n, day, day, day, label, label, "p", "", ref, ref, None, None, amount, None, amount, f"{rid} {ref}")


def ledger(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def close(a, b):
    return abs(abs(a) - abs(b)) <= 0.01


def compatible(a, b):
    return bool(a) and bool(b) and (a == b or {a, b} in ({"Receipt", "Payment"}, {"CreditNote", "DebitNote"}))


def relation(a, b):
    if a.lower() in MISSING or b.lower() in MISSING:
        return 1, 0.0
    if a == b:
        return 5, 1.0
    if a in b or b in a:
        return 4, 0.8
    s = SequenceMatcher(a=a.lower(), b=b.lower()).ratio()
    return (3, s) if s >= 0.85 else (0, s)


def days(o, p):
    return abs((date.fromisoformat(o[5]) - date.fromisoformat(p[5])).days) if o[5] and p[5] else None


def serial(rows):
    """One pair, one org row after the other."""
    org = sorted((r for r in rows if r[1] == "org_ledger"), key=lambda r: r[2])
    free = {r[2]: r for r in sorted((r for r in rows if r[1] == "party_ledger"), key=lambda r: r[2])}
    out, open_org = [], {r[2]: r for r in org}

    def key(o, p):
        tier, score = relation(o[13], p[13])
        d = days(o, p)
        return max(tier, 1), score, -abs(abs(o[16]) - abs(p[16])), -(9999 if d is None else d), -p[4], p[2]

    for o in org:
        if o[13].lower() in MISSING:
            continue
        met = [p for p in free.values() if p[13] == o[13] and close(o[16], p[16])]
        typed = [p for p in met if compatible(o[9], p[9])]
        pool = typed or met
        if len(pool) == 1:
            out.append((o[2], pool[0][2], "stage1_exact_ref_type_amount" if typed else "stage2_exact_ref_amount"))
            del free[pool[0][2]], open_org[o[2]]
        elif pool:
            out.append((o[2], max(pool, key=lambda p: key(o, p))[2], "stage1_2_ambiguous_exact_ref"))
    for o in list(open_org.values()):
        scored = []
        for p in free.values():
            d = days(o, p)
            if not close(o[16], p[16]) or (d is not None and d > 7):
                continue
            tier, _ = relation(o[13], p[13])
            if (tier == 1 and compatible(o[9], p[9])) or tier in (3, 4):
                scored.append(p)
        if not scored:
            continue
        p = max(scored, key=lambda p: key(o, p))
        tier, _ = relation(o[13], p[13])
        out.append((o[2], p[2], {4: "stage3_containment_ref_amount", 3: "stage4_fuzzy_ref_amount_date"}.get(tier, "stage5_no_ref_amount_date")))
        if tier == 4:
            del free[p[2]], open_org[o[2]]
    return sorted(out + [(o, None, "stage6_unmatched_org") for o in open_org] + [(None, p, "stage7_unmatched_party") for p in free], key=str)


def test_against_serial(spark):
    rng = random.Random(11)
    rows = []
    refs = ["ABC/1", "X-ABC/1", "ABC/12", "SA/PB/2425/017", "SA/PB/2425/071", "", "none", "ABC"]
    for pair in range(60):
        for side in ("org_ledger", "party_ledger"):
            for i in range(rng.randint(0, 7)):
                day = date(2025, 4, 1) + timedelta(days=rng.randint(0, 12))
                rows.append(row(f"p{pair:03d}", side, f"{side[0]}{rng.randint(0, 99999):05d}{i}", rng.choice(refs), rng.choice([100.0, 100.005, 100.01, 250.0]), rng.choice(["Invoice", "Receipt", "Payment"]), "" if rng.random() < 0.1 else day.isoformat(), rng.randint(1, 3)))
    got = {}
    for r in R.picks(ledger(spark, rows)).collect():
        got.setdefault(r["pair_id"], []).append((r["o_row_id"], r["p_row_id"], r["match_rule"]))
    for pair in sorted({r[0] for r in rows}):
        assert sorted(got.get(pair, []), key=str) == serial([r for r in rows if r[0] == pair]), pair


@pytest.mark.parametrize(
    ("org", "party", "rules"),
    [
        (["ABC/1"], ["ABC/1"], {"stage1_exact_ref_type_amount"}), (["ABC/1"], ["X-ABC/1"], {"stage3_containment_ref_amount"}), (["SA/PB/2425/017"], ["SA/PB/2425/071"], {"stage4_fuzzy_ref_amount_date", "stage6_unmatched_org", "stage7_unmatched_party"}),
        ([""], [""], {"stage5_no_ref_amount_date", "stage6_unmatched_org", "stage7_unmatched_party"}), (["ABC"], ["ABC", "ABC"], {"stage1_2_ambiguous_exact_ref", "stage6_unmatched_org", "stage7_unmatched_party"}), (["None"], ["None"], {"stage5_no_ref_amount_date", "stage6_unmatched_org", "stage7_unmatched_party"}),
    ],
)
def test_cases(spark, org, party, rules):
    rows = [row("p", "org_ledger", f"o{i}", r, 500.0) for i, r in enumerate(org)] + [row("p", "party_ledger", f"q{i}", r, 500.0) for i, r in enumerate(party)]
    m = R.master_match_table(ledger(spark, rows)).collect()
    assert {r["match_rule"] for r in m} == rules
    assert all(r["org_normalized_reference"].lower() not in MISSING and r["party_normalized_reference"].lower() not in MISSING for r in m if r["match_status"] == "matched_strong")
    assert [r["match_group_id"] for r in sorted(m, key=lambda r: r["match_group_id"])] == [f"MG{i + 1:06d}" for i in range(len(m))]


def test_amount_mismatch_and_empty(spark):
    rows = [row("p", "org_ledger", "o", "ABC", 100.0), row("p", "party_ledger", "q", "ABC", 125.0), row("p", "party_ledger", "t", "ABC", 100.0, kind="Total")]
    assert {r["match_rule"] for r in R.picks(ledger(spark, rows)).collect()} == {"stage6_unmatched_org", "stage7_unmatched_party"}
    assert R.picks(ledger(spark, [])).count() == 0


def test_band_edge_is_exact(spark):
    rows = [row("p", "org_ledger", "o1", "A", 100.01), row("p", "party_ledger", "q1", "B", 100.00), row("p", "org_ledger", "o2", "A", 0.02), row("p", "party_ledger", "q2", "B", -0.01)]
    got = {(r["o_row_id"], r["p_row_id"]) for r in E.band_edges(*E.sides(ledger(spark, rows))).collect()}
    assert got == {("o2", "q2")}
