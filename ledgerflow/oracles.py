"""SQL for an independent engine that repeats whole plans: string similarities, formalisation, staged matching, and the reports on both."""

from __future__ import annotations

from .operators.labels import alias_rows
from .sources import synth

MONEY = "CAST(sum(CAST({} AS decimal(18,2))) AS double)"


def sequence_sql(pairs: str, out: str) -> str:
    """CTEs: `pairs` (a, b) -> `out` (a, b, ratio): longest common block, the earliest in a, then in b, and so on to both sides of it."""
    best = "list_max(flatten(list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(b) + 1), lambda j: {'l': len(list_filter(range(1, least(len(a) - i, len(b) - j) + 2), lambda n: substr(a, i, n) = substr(b, j, n))), 'i': -i, 'j': -j}))))"
    return f"""
, {out}_parts AS (
  SELECT a AS a0, b AS b0, a, b, 0 AS l FROM {pairs}
  UNION ALL
  SELECT a0, b0, part.a, part.b, part.l FROM (
    SELECT a0, b0, unnest([{{'a': substr(a, 1, i - 1), 'b': substr(b, 1, j - 1), 'l': m}}, {{'a': substr(a, i + m), 'b': substr(b, j + m), 'l': 0}}]) AS part FROM (
      SELECT a0, b0, a, b, best.l AS m, -best.i AS i, -best.j AS j FROM (SELECT *, {best} AS best FROM {out}_parts WHERE a <> '' AND b <> '') found) cut WHERE m > 0) halves
), {out} AS (SELECT a0 AS a, b0 AS b, CASE WHEN len(a0) + len(b0) = 0 THEN 1.0 ELSE 2.0 * sum(l) / (len(a0) + len(b0)) END AS ratio FROM {out}_parts GROUP BY a0, b0)
"""


def subsequence_sql(pairs: str, out: str) -> str:
    """CTEs: `pairs` (a, b) -> `out` (a, b, score): 200 times the longest common subsequence over both lengths, a row of the table a step."""
    row = "list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len(b) + 1), lambda j: [CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN r[j] + 1 ELSE r[j + 1] END, 0])), lambda acc, x: list_append(acc, greatest(acc[len(acc)], x[1])))"
    return f"""
, {out}_rows AS (
  SELECT a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda x: 0) AS r FROM {pairs}
  UNION ALL
  SELECT a, b, i + 1, {row} FROM {out}_rows WHERE i < len(a) AND b <> ''
), {out} AS (SELECT a, b, CASE WHEN len(a) + len(b) = 0 THEN 100.0 ELSE 200.0 * max(r[len(r)]) / (len(a) + len(b)) END AS score FROM {out}_rows GROUP BY a, b)
"""


def token_set_sql(pairs: str, out: str) -> str:
    """CTEs: `pairs` (a, b) -> `out` (a, b, score): the closest two of the shared words, and the shared words with either side's own."""
    words = lambda c: f"list_sort(list_distinct(list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> '')))"
    return f"""
, {out}_words AS (SELECT *, {words("a")} AS wa, {words("b")} AS wb FROM (SELECT DISTINCT a, b FROM {pairs}) p)
, {out}_sets AS (SELECT *, array_to_string(list_sort(list_intersect(wa, wb)), ' ') AS common, array_to_string(list_filter(wa, lambda x: NOT list_contains(wb, x)), ' ') AS oa, array_to_string(list_filter(wb, lambda x: NOT list_contains(wa, x)), ' ') AS ob FROM {out}_words)
, {out}_joined AS (SELECT *, trim(common || ' ' || oa) AS ja, trim(common || ' ' || ob) AS jb FROM {out}_sets)
, {out}_asked AS (SELECT ja AS a, jb AS b FROM {out}_joined UNION SELECT common, ja FROM {out}_joined WHERE common <> '' UNION SELECT common, jb FROM {out}_joined WHERE common <> '')
{subsequence_sql(f"{out}_asked", f"{out}_lcs")}
, {out} AS (SELECT t.a, t.b, CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0 WHEN common <> '' AND (oa = '' OR ob = '') THEN 100.0 ELSE greatest(j.score, coalesce(x.score, 0.0), coalesce(y.score, 0.0)) END AS score
  FROM {out}_joined t LEFT JOIN {out}_lcs j ON j.a = ja AND j.b = jb LEFT JOIN {out}_lcs x ON x.a = common AND x.b = ja AND common <> '' LEFT JOIN {out}_lcs y ON y.a = common AND y.b = jb AND common <> '')
"""


ALIASES = "(VALUES " + ", ".join(f"({i}, {j}, '{c}', '{n}')" for i, j, c, _, n in alias_rows()) + ") aliases(label_pos, alias_pos, canonical, alias)"


def labels_sql(types: str) -> str:
    """CTEs: `types` (raw_type) -> labelled (raw_type, type_label, match_method, score): an equal alias, else the longest contained (of equals the larger), else the closest."""
    return f"""
, norms AS (SELECT DISTINCT coalesce(raw_type, '') AS raw_type, lower(trim(regexp_replace(coalesce(raw_type, ''), '\\s+', ' ', 'g'))) AS norm FROM {types})
, alias_exact AS (SELECT raw_type, arg_min(canonical, label_pos * 100 + alias_pos) AS canonical FROM norms JOIN {ALIASES} ON norm = alias GROUP BY raw_type)
, alias_inside AS (SELECT raw_type, arg_max(canonical, (length(alias), canonical, alias)) AS canonical FROM norms JOIN {ALIASES} ON norm <> '' AND contains(norm, alias) GROUP BY raw_type)
, open_pairs AS (SELECT DISTINCT norm AS a, alias AS b FROM norms CROSS JOIN {ALIASES} WHERE norm <> '' AND raw_type NOT IN (SELECT raw_type FROM alias_exact) AND raw_type NOT IN (SELECT raw_type FROM alias_inside))
{subsequence_sql("open_pairs", "close_pairs")}
, alias_close AS (SELECT raw_type, arg_min(canonical, (-score, label_pos, alias_pos)) AS canonical, max(score) AS score FROM norms JOIN close_pairs ON norm = a JOIN {ALIASES} ON b = alias WHERE score > 0 GROUP BY raw_type)
, labelled AS (SELECT n.raw_type, coalesce(e.canonical, i.canonical, CASE WHEN c.score >= 70 THEN c.canonical END, 'Unknown') AS type_label,
    CASE WHEN e.canonical IS NOT NULL THEN 'exact' WHEN i.canonical IS NOT NULL THEN 'substring' WHEN c.score > 0 THEN 'fuzzy' ELSE 'none' END AS match_method,
    CASE WHEN coalesce(e.canonical, i.canonical) IS NOT NULL THEN 100.0 ELSE coalesce(c.score, 0.0) END AS score
  FROM norms n LEFT JOIN alias_exact e USING (raw_type) LEFT JOIN alias_inside i USING (raw_type) LEFT JOIN alias_close c USING (raw_type))
"""


# -- formalisation -------------------------------------------------------------------------------------------------------

#: The cells of synth.extracted_cells(), and canonical rows from their texts.
CANONICAL = f"""WITH RECURSIVE base AS (
  SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS date) AS d, CAST(CAST(round(o_totalprice, 2) AS decimal(18,2)) AS varchar) AS v FROM orders
), texts AS (
  SELECT *, CASE k % 10 WHEN 0 THEN strftime(d, '%d-%m-%Y') WHEN 1 THEN strftime(d, '%-d-%-m-%y') WHEN 2 THEN strftime(d, '%-d-%b-%y') WHEN 5 THEN strftime(d, '%d/%m/%Y') WHEN 6 THEN strftime(d, '%d.%m.%Y') WHEN 7 THEN 'not-a-date' WHEN 8 THEN strftime(d, '%B %-d %Y') WHEN 9 THEN strftime(d, '%-d-%b-%Y') ELSE '' END AS raw_date,
    CASE k % 7 WHEN 1 THEN 'Rs. ' || v WHEN 2 THEN v || ' Cr' WHEN 3 THEN '(' || v || ')' WHEN 5 THEN 'abc' ELSE v END AS amount,
    CASE k % 8 WHEN 0 THEN 'Sale' WHEN 1 THEN 'Rcpt' WHEN 2 THEN 'bank pymt' WHEN 3 THEN 'SlRt' WHEN 4 THEN 'Purchse' WHEN 5 THEN 'Jrnl' WHEN 6 THEN 'zzzqqq' ELSE '' END AS raw_type,
    CASE WHEN k % 97 = 0 THEN 'Opening Balance ' WHEN k % 89 = 0 THEN 'By Closing Balance ' WHEN k % 83 = 0 THEN 'Grand Total ' WHEN k % 79 = 0 THEN 'Carried Over ' ELSE '' END AS mark,
    CASE WHEN k % 3 = 0 THEN '' ELSE 'SA / 25-26 / ' || k END AS ref, CASE WHEN k % 5 = 0 THEN '' ELSE 'V/' || k END AS vch
  FROM base
), cells AS (
  SELECT *, 'pair_' || lpad(CAST(c % 8 AS varchar), 3, '0') AS pair_id, CASE WHEN k % 2 = 0 THEN 'org_ledger' ELSE 'party_ledger' END AS ledger_role, k // 40 AS page, mark || raw_date || ' ' || raw_type || ' ' || amount AS raw_text,
    CASE WHEN ref = '' THEN vch ELSE ref END AS reference_no, CASE WHEN vch = '' THEN ref ELSE vch END AS voucher_no FROM texts
)
{labels_sql("cells")}
, parsed AS (
  SELECT *, CASE WHEN regexp_matches(raw_date, '^\\d+-\\d+-\\d{{4}}$') THEN try_strptime(raw_date, '%d-%m-%Y') WHEN regexp_matches(raw_date, '^\\d+-\\d+-\\d{{2}}$') THEN try_strptime(raw_date, '%d-%m-%y') WHEN regexp_matches(raw_date, '^\\d+-[A-Za-z]{{3}}-\\d{{2}}$') THEN try_strptime(raw_date, '%d-%b-%y')
      WHEN regexp_matches(raw_date, '^\\d+-[A-Za-z]{{3}}-\\d{{4}}$') THEN try_strptime(raw_date, '%d-%b-%Y') WHEN raw_date LIKE '%/%' THEN try_strptime(raw_date, '%d/%m/%Y') WHEN raw_date LIKE '%.%' THEN try_strptime(raw_date, '%d.%m.%Y') ELSE try_strptime(raw_date, '%B %d %Y') END::date AS own_date,
    try_cast(trim(regexp_replace(regexp_replace(amount, '^Rs\\. ', ''), ' Cr$', ''), '()') AS double) AS size
  FROM cells
), typed AS (
  SELECT *, CASE WHEN amount LIKE '(%' THEN -size ELSE size END AS value, CASE WHEN size IS NULL THEN 10.0 WHEN amount LIKE '(%' OR amount LIKE '% Cr' THEN 90.0 ELSE 95.0 END AS amount_confidence,
    CASE WHEN raw_date = '' THEN 0.0 WHEN own_date IS NULL THEN 15.0 WHEN regexp_matches(raw_date, '-\\d{{2}}$') AND NOT regexp_matches(raw_date, '-\\d{{4}}$') THEN 88.0 WHEN regexp_matches(raw_date, '[A-Za-z]') THEN 92.0 ELSE 96.0 END AS own_confidence,
    regexp_matches(raw_date, '^\\d{{1,2}}[-/.](\\d{{1,2}}|[A-Za-z]{{3,}})[-/.]\\d{{2,4}}$') AS date_like
  FROM parsed
), kinds AS (
  SELECT *, CASE WHEN raw_text LIKE 'Opening Balance%' THEN 'OpeningBalance' WHEN raw_text LIKE '%Closing Balance%' THEN 'ClosingBalance' WHEN raw_text LIKE 'Carried Over%' THEN 'CarriedForward' WHEN raw_text LIKE 'Grand Total%' THEN 'GrandTotal'
      WHEN value IS NOT NULL AND NOT date_like AND raw_type = '' AND NOT regexp_matches(raw_text, '[A-Za-z]') THEN 'Total' WHEN value IS NOT NULL THEN 'Transaction' ELSE 'Unknown' END AS kind
  FROM typed
), emitted AS (SELECT * FROM kinds WHERE kind <> 'Unknown' OR value IS NOT NULL)
, above AS (SELECT *, last_value(own_date IGNORE NULLS) OVER (PARTITION BY pair_id, ledger_role, page ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM emitted)
, dated AS (SELECT *, kind = 'Transaction' AND own_date IS NULL AND raw_date = '' AND before IS NOT NULL AS carried FROM above)
, scored AS (SELECT d.*, CASE WHEN carried THEN before ELSE own_date END AS day, CASE WHEN carried THEN least(own_confidence, 80.0) ELSE own_confidence END AS date_confidence, l.type_label AS known_label, l.score AS type_score,
    round(greatest(0.0, least(100.0, 90.0 * 0.45 + own_confidence * 0.2 + amount_confidence * 0.25 + CASE WHEN kind <> 'Unknown' THEN 10.0 ELSE 0.0 END)), 1) AS row_confidence FROM dated d JOIN labelled l USING (raw_type))
, canonical AS (
  SELECT *, substr(sha1(ledger_role || '|orders.pdf|' || page || '|' || k || '|' || raw_text), 1, 12) AS row_id, CASE WHEN ledger_role = 'org_ledger' THEN value END AS debit, CASE WHEN ledger_role = 'party_ledger' THEN value END AS credit,
    CASE WHEN kind IN ('OpeningBalance', 'ClosingBalance') THEN kind WHEN kind IN ('Transaction', 'Unknown') THEN CASE WHEN type_score < 70 THEN 'Unknown' ELSE known_label END ELSE '' END AS type_label,
    round(greatest(0.0, least(100.0, row_confidence, CASE WHEN kind IN ('Transaction', 'Unknown') THEN type_score ELSE 100.0 END) - CASE WHEN kind = 'Transaction' AND day IS NULL THEN 20.0 ELSE 0.0 END - CASE WHEN kind = 'Transaction' AND value IS NULL THEN 40.0 ELSE 0.0 END), 1) AS confidence_score,
    array_to_string(list_filter([
      CASE WHEN kind IN ('Transaction', 'Unknown') AND type_score < 70 THEN 'Type ''' || raw_type || ''' unmatched (best score ' || CAST(CAST(round_even(type_score, 0) AS int) AS varchar) || ' < 70).' WHEN kind IN ('Transaction', 'Unknown') AND type_score < 80 THEN 'Type ''' || raw_type || ''' low confidence (score ' || CAST(CAST(round_even(type_score, 0) AS int) AS varchar) || '); needs review.' END,
      CASE WHEN kind = 'Transaction' AND raw_date <> '' AND day IS NULL THEN 'Unparseable date ''' || raw_date || '''.' END, CASE WHEN kind = 'Transaction' AND raw_date = '' AND day IS NULL THEN 'Missing date and no prior date to carry forward.' END,
      CASE WHEN kind = 'Transaction' AND value IS NULL THEN 'No parseable debit or credit amount.' END, CASE WHEN kind = 'Transaction' AND date_confidence < 70 THEN 'Low date confidence.' END, CASE WHEN kind = 'Transaction' AND amount_confidence < 70 THEN 'Low amount confidence.' END,
      CASE WHEN kind = 'Transaction' AND type_score >= 70 AND type_score < 80 THEN 'Multiple type classifications tie or remain ambiguous.' END,
      CASE WHEN kind = 'Total' THEN 'Untitled amount-only row treated as subtotal/total.' WHEN kind = 'Transaction' AND NOT date_like AND raw_type = '' THEN 'Transaction lacks a date or type marker.' END,
      CASE WHEN reference_no <> '' AND voucher_no <> '' AND reference_no <> voucher_no THEN 'Multiple reference interpretations exist.' END], lambda x: x IS NOT NULL), '; ') AS review_reason
  FROM scored
)
"""

_RATE = "CASE WHEN {1} <= 0 THEN 100.0 ELSE round(100.0 * {0} / {1}, 1) END"


def _rated(num: str, den: str, below: int) -> tuple[str, str]:
    pct = _RATE.format(num, den)
    return f"CASE WHEN {pct} < {below} THEN 'REVIEW' ELSE 'PASS' END", f"floor({pct})"


def _none(count: str) -> tuple[str, str]:
    return f"CASE WHEN {count} > 0 THEN 'REVIEW' ELSE 'PASS' END", count


def _found(count: str) -> tuple[str, str]:
    return f"CASE WHEN {count} > 0 THEN 'PASS' ELSE 'REVIEW' END", count


#: check -> (status, count, details)
FORMAL_CHECKS = {
    "extracted_row_count": ("'INFO'", "n_rows", "All emitted rows."), "transaction_row_count": ("'INFO'", "n_tx", "record_kind=Transaction."), "layout_confidence": ("'PASS'", "90", "Average row-level layout confidence (%)."), "column_confidence": ("'PASS'", "94", "Average detected-column confidence (%)."),
    "opening_balance_captured": (*_found("opening"), ""), "closing_balance_captured": (*_found("closing"), ""), "total_rows_captured": (*_found("total"), ""),
    "date_parse_success_rate": (*_rated("dated", "n_tx", 95), ""), "amount_parse_success_rate": (*_rated("valued", "n_tx", 95), ""), "type_classification_success_rate": (*_rated("named", "n_tx", 90), ""),
    "missing_references_count": (*_none("no_ref"), ""), "duplicate_row_suspicion_count": (*_none("dup"), ""), "debit_credit_parse_failures": (*_none("(n_tx - valued)"), ""), "review_queue_count": (*_none("flagged"), ""), "rows_requiring_review": (*_none("flagged"), ""),
    "rows_with_ambiguous_balance_handling": (*_none("0"), ""), "rows_with_date_ambiguity": (*_none("bad_dates"), ""), "rows_with_amount_ambiguity": (*_none("bad_amounts"), ""), "source_traceability_completeness": ("'PASS'", "100", ""), "ledger_confidence": ("CASE WHEN confidence < 80 THEN 'REVIEW' ELSE 'PASS' END", "floor(confidence)", ""),
}

QUALITY_REPORT = CANONICAL + """
, dups AS (SELECT pair_id, ledger_role, sum(n - 1) AS dup FROM (SELECT pair_id, ledger_role, count(*) AS n FROM canonical WHERE kind = 'Transaction' AND regexp_replace(reference_no, '[^A-Za-z0-9]+', '', 'g') <> '' GROUP BY pair_id, ledger_role, day, upper(regexp_replace(reference_no, '[^A-Za-z0-9]+', '', 'g')), debit, credit HAVING count(*) > 1) g GROUP BY pair_id, ledger_role)
, agg AS (SELECT pair_id, ledger_role AS scope, count(*) AS n_rows, count(*) FILTER (WHERE kind = 'Transaction') AS n_tx, count(*) FILTER (WHERE kind = 'OpeningBalance') AS opening, count(*) FILTER (WHERE kind = 'ClosingBalance') AS closing, count(*) FILTER (WHERE kind = 'Total') AS total,
    count(*) FILTER (WHERE kind = 'Transaction' AND day IS NOT NULL) AS dated, count(*) FILTER (WHERE kind = 'Transaction' AND value IS NOT NULL) AS valued, count(*) FILTER (WHERE kind = 'Transaction' AND type_label NOT IN ('', 'Unknown')) AS named, count(*) FILTER (WHERE kind = 'Transaction' AND reference_no = '') AS no_ref,
    count(*) FILTER (WHERE review_reason <> '') AS flagged, count(*) FILTER (WHERE kind = 'Transaction' AND ((raw_date <> '' AND day IS NULL) OR date_confidence < 70)) AS bad_dates, count(*) FILTER (WHERE kind = 'Transaction' AND amount_confidence < 70) AS bad_amounts, round(avg(confidence_score), 1) AS confidence FROM canonical GROUP BY ALL)
, wide AS (SELECT a.*, coalesce(dup, 0) AS dup FROM agg a LEFT JOIN dups d ON d.pair_id = a.pair_id AND d.ledger_role = a.scope)
""" + " UNION ALL ".join(f"SELECT pair_id, scope, '{check}' AS \"check\", {status} AS status, CAST({n} AS double) AS count, '{details}' AS details FROM wide" for check, (status, n, details) in FORMAL_CHECKS.items())


# -- matching ------------------------------------------------------------------------------------------------------------

COMPATIBLE = "(o_type <> '' AND (o_type = p_type OR (o_type, p_type) IN (('Receipt', 'Payment'), ('Payment', 'Receipt'), ('CreditNote', 'DebitNote'), ('DebitNote', 'CreditNote'))))"
ORDER = "amount_gap, coalesce(days, 9999), p_n, p_row_id DESC"
#: All records of the staged matching of synth's ledgers, in which references of a pair's org rows differ, so that no row waits for another's choice.
MATCHES = synth.OTHER_LEDGER.replace("WITH base", "WITH RECURSIVE base", 1) + f"""
, s AS (SELECT pair_id, ledger_role, row_id, trim(normalized_reference) AS nref, lower(trim(normalized_reference)) IN ('', 'none', 'nan', 'null', '-', '--') AS missing, date AS day, type_label, amount_org_perspective AS net, source_row_number AS n, reference_no, raw_type, particulars FROM ledger)
, o AS (SELECT * FROM s WHERE ledger_role = 'org_ledger'), p AS (SELECT * FROM s WHERE ledger_role = 'party_ledger')
, e AS (SELECT o.pair_id, o.row_id AS o_row_id, p.row_id AS p_row_id, o.nref AS o_nref, p.nref AS p_nref, o.missing AS o_missing, p.missing AS p_missing, o.type_label AS o_type, p.type_label AS p_type, p.n AS p_n, abs(abs(o.net) - abs(p.net)) AS amount_gap, abs(date_diff('day', o.day, p.day)) AS days
        FROM o JOIN p ON o.pair_id = p.pair_id AND p.net BETWEEN o.net - 0.02 AND o.net + 0.02 WHERE abs(abs(o.net) - abs(p.net)) <= 0.01)
, exact_all AS (SELECT *, {COMPATIBLE} AS typed FROM e WHERE NOT o_missing AND NOT p_missing AND o_nref = p_nref)
, exact_pool AS (SELECT *, count(*) OVER (PARTITION BY pair_id, o_row_id) AS n, row_number() OVER (PARTITION BY pair_id, o_row_id ORDER BY {ORDER}) AS r FROM (SELECT *, max(typed) OVER (PARTITION BY pair_id, o_row_id) AS any_typed FROM exact_all) x WHERE typed = any_typed)
, sure AS (SELECT * FROM exact_pool WHERE n = 1), many AS (SELECT * FROM exact_pool WHERE n > 1 AND r = 1)
, band AS (SELECT * FROM e WHERE (days IS NULL OR days <= 7) AND (pair_id, o_row_id) NOT IN (SELECT (pair_id, o_row_id) FROM sure) AND (pair_id, p_row_id) NOT IN (SELECT (pair_id, p_row_id) FROM sure))
, held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, o_row_id ORDER BY {ORDER}) AS r FROM band WHERE NOT o_missing AND NOT p_missing AND o_nref <> p_nref AND (contains(o_nref, p_nref) OR contains(p_nref, o_nref))) x WHERE r = 1)
, maybe AS (SELECT * FROM band WHERE NOT o_missing AND NOT p_missing AND NOT contains(o_nref, p_nref) AND NOT contains(p_nref, o_nref))
, maybe_pairs AS (SELECT DISTINCT lower(o_nref) AS a, lower(p_nref) AS b FROM maybe)
{sequence_sql("maybe_pairs", "alike")}
, weak AS (SELECT * FROM (
    SELECT m.*, 3 AS tier, ratio AS score FROM maybe m JOIN alike ON a = lower(o_nref) AND b = lower(p_nref) WHERE ratio >= 0.85
    UNION ALL SELECT *, 1 AS tier, 0.0 AS score FROM band WHERE (o_missing OR p_missing) AND {COMPATIBLE}) w
  WHERE (pair_id, o_row_id) NOT IN (SELECT (pair_id, o_row_id) FROM held) AND NOT EXISTS (SELECT 1 FROM held h WHERE h.pair_id = w.pair_id AND h.p_row_id = w.p_row_id AND h.o_row_id < w.o_row_id))
, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, o_row_id ORDER BY tier DESC, score DESC, {ORDER}) AS r FROM weak) x WHERE r = 1)
, taken AS (SELECT pair_id, o_row_id, p_row_id FROM sure UNION ALL SELECT pair_id, o_row_id, p_row_id FROM held)
, records AS (
  SELECT pair_id, o_row_id, p_row_id, 'matched_strong' AS match_status, CASE WHEN any_typed THEN 'stage1_exact_ref_type_amount' ELSE 'stage2_exact_ref_amount' END AS match_rule, CASE WHEN any_typed THEN 1.0 ELSE 0.95 END AS match_confidence, '' AS review_reason, 'exact' AS relation, 1 AS pass FROM sure
  UNION ALL SELECT pair_id, o_row_id, p_row_id, 'candidate_review', 'stage1_2_ambiguous_exact_ref', 0.7, 'Multiple exact-reference candidates; deterministic tie unresolved.', 'exact', 1 FROM many
  UNION ALL SELECT pair_id, o_row_id, p_row_id, 'matched_strong', 'stage3_containment_ref_amount', 0.9, '', CASE WHEN contains(p_nref, o_nref) THEN 'contained_by' ELSE 'contains' END, 2 FROM held
  UNION ALL SELECT pair_id, o_row_id, p_row_id, 'candidate_review', CASE WHEN tier = 3 THEN 'stage4_fuzzy_ref_amount_date' ELSE 'stage5_no_ref_amount_date' END, CASE WHEN tier = 3 THEN 0.6 ELSE 0.4 END,
    CASE WHEN tier = 3 THEN 'Fuzzy/weak reference candidate requires manual review.' ELSE 'Missing normalized reference on at least one side; no deterministic reference evidence. Amount/date/type candidate only.' END, CASE WHEN tier = 3 THEN 'fuzzy' ELSE 'missing' END, 2 FROM best
  UNION ALL SELECT pair_id, row_id, NULL, 'unmatched_org', 'stage6_unmatched_org', 0.0, 'No deterministic match found for org row.', 'missing', 3 FROM o WHERE (pair_id, row_id) NOT IN (SELECT (pair_id, o_row_id) FROM taken)
  UNION ALL SELECT pair_id, NULL, row_id, 'unmatched_party', 'stage7_unmatched_party', 0.0, 'No deterministic match found for party row.', 'missing', 4 FROM p WHERE (pair_id, row_id) NOT IN (SELECT (pair_id, p_row_id) FROM taken)
)
, m AS (
  SELECT r.pair_id, 'MG' || lpad(CAST(row_number() OVER (PARTITION BY r.pair_id ORDER BY pass, coalesce(o_row_id, p_row_id)) AS varchar), 6, '0') AS match_group_id, match_status, CAST(match_confidence AS double) AS match_confidence, match_rule, coalesce(o.type_label, p.type_label) AS type_label,
    coalesce(o_row_id, '') AS org_row_id, coalesce(p_row_id, '') AS party_row_id, coalesce(CAST(o.day AS varchar), '') AS org_date, coalesce(CAST(p.day AS varchar), '') AS party_date, CAST(abs(date_diff('day', o.day, p.day)) AS int) AS date_delta_days, coalesce(o.reference_no, '') AS org_reference, coalesce(p.reference_no, '') AS party_reference,
    coalesce(o.nref, '') AS org_normalized_reference, coalesce(p.nref, '') AS party_normalized_reference, relation AS reference_relation, o.net AS org_amount, p.net AS party_amount, abs(abs(o.net) - abs(p.net)) AS amount_difference, coalesce(o.raw_type, '') AS org_raw_type, coalesce(p.raw_type, '') AS party_raw_type,
    coalesce(o.particulars, '') AS org_particulars, coalesce(p.particulars, '') AS party_particulars, match_status <> 'matched_strong' AS review_required, review_reason, '' AS reviewer_comment, '' AS manual_status
  FROM records r LEFT JOIN o ON o.pair_id = r.pair_id AND o.row_id = o_row_id LEFT JOIN p ON p.pair_id = r.pair_id AND p.row_id = p_row_id
)
"""

STATUS_TOTALS = MATCHES + f""", lines AS (SELECT pair_id, match_status AS line, org_amount, party_amount FROM m UNION ALL SELECT pair_id, 'review_pending', org_amount, party_amount FROM m WHERE review_required)
, st AS (SELECT pair_id, line, coalesce({MONEY.format("org_amount")}, 0.0) AS org_amount, coalesce({MONEY.format("party_amount")}, 0.0) AS party_amount, count(*) AS rows FROM lines GROUP BY ALL)
"""

REVIEW = MATCHES + """
, flagged AS (SELECT *, review_flag OR (confidence_score > 0 AND confidence_score < 80) AS shown FROM ledger)
, q AS (
  SELECT pair_id, CASE WHEN review_flag THEN 'MEDIUM' ELSE 'LOW' END AS priority, 'formalization' AS source_area, ledger_role AS source_sheet, row_id AS source_row_id, type_label, CAST(date AS varchar) AS date, reference_no AS reference, normalized_reference, amount_org_perspective AS amount, '' AS match_status,
    CASE WHEN review_flag THEN review_reason ELSE 'Low extraction confidence; otherwise traceable.' END AS reason, 'Verify extracted row against the source ledger PDF.' AS suggested_action, raw_text AS source_raw_text FROM flagged WHERE shown
  UNION ALL
  SELECT pair_id, CASE WHEN regexp_matches(lower(review_reason), 'ambiguous|multiple') OR amount_difference > 0.01 THEN 'HIGH' ELSE 'MEDIUM' END, 'reconciliation', 'Master_Match_Table', CASE WHEN org_row_id <> '' THEN org_row_id ELSE party_row_id END, type_label, CASE WHEN org_date <> '' THEN org_date ELSE party_date END,
    CASE WHEN org_reference <> '' THEN org_reference ELSE party_reference END, CASE WHEN org_normalized_reference <> '' THEN org_normalized_reference ELSE party_normalized_reference END, coalesce(org_amount, party_amount), match_status, review_reason,
    CASE match_status WHEN 'unmatched_org' THEN 'Locate corresponding party entry or confirm org-only item.' WHEN 'unmatched_party' THEN 'Locate corresponding org entry or confirm party-only item.' ELSE CASE WHEN amount_difference > 0.01 THEN 'Resolve amount mismatch against source ledgers before closing.' ELSE 'Manually confirm or reject this candidate against source ledgers.' END END,
    CASE WHEN org_particulars <> '' AND party_particulars <> '' THEN org_particulars || ' | ' || party_particulars ELSE org_particulars || party_particulars END FROM m WHERE review_required
)
"""

MATCH_CHECKS = {
    "org_row_count": ("'INFO'", "org_rows", ""), "party_row_count": ("'INFO'", "party_rows", ""), "org_transaction_count": ("'INFO'", "org_rows", ""), "party_transaction_count": ("'INFO'", "party_rows", ""), "org_special_row_count": ("'INFO'", "0", ""), "party_special_row_count": ("'INFO'", "0", ""),
    "special_rows_excluded_from_matching": ("'PASS'", "0", "Only transactions are matched."), "transaction_rows_type_unknown": ("", "unknown", ""), "review_rows_count": ("'INFO'", "flagged", ""), "strong_matches": ("'INFO'", "strong", ""),
    "strong_matches_missing_reference": ("'PASS'", "0", "Strong matches must never rely on a missing reference (must be 0)."), "fuzzy_matches": ("'INFO'", "fuzzy", ""), "review_candidates": ("'INFO'", "review", ""), "unmatched_org_rows": ("'INFO'", "u_org", ""), "unmatched_party_rows": ("'INFO'", "u_party", ""),
    "many_to_one_candidates": ("'INFO'", "many", ""), "duplicate_normalized_references_org": ("'INFO'", "dup_org", ""), "duplicate_normalized_references_party": ("'INFO'", "dup_party", ""), "amount_differences_present": ("'INFO'", "differences", ""), "amount_difference_violations": ("'PASS'", "0", ""), "evidence_column_violations": ("'PASS'", "0", ""),
    "rows_dropped": ("'PASS'", "0", "Source rows that the ledger lacks."), "closing_balance_difference": ("'REVIEW'", "0", ""), "review_queue_rows": ("'PASS'", "0", ""),
}

MATCH_REPORT = MATCHES + """
, a AS (SELECT pair_id, count(*) FILTER (WHERE ledger_role = 'org_ledger') AS org_rows, count(*) FILTER (WHERE ledger_role = 'party_ledger') AS party_rows, count(*) FILTER (WHERE type_label = 'Unknown') AS unknown, count(*) FILTER (WHERE review_flag) AS flagged FROM ledger GROUP BY pair_id)
, b AS (SELECT pair_id, count(*) FILTER (WHERE match_status = 'matched_strong') AS strong, count(*) FILTER (WHERE match_rule LIKE '%fuzzy%') AS fuzzy, count(*) FILTER (WHERE review_required) AS review, count(*) FILTER (WHERE match_status = 'unmatched_org') AS u_org, count(*) FILTER (WHERE match_status = 'unmatched_party') AS u_party,
    count(*) FILTER (WHERE match_rule LIKE '%ambiguous%') AS many, count(amount_difference) AS differences FROM m GROUP BY pair_id)
, dup AS (SELECT pair_id, count(*) FILTER (WHERE ledger_role = 'org_ledger') AS dup_org, count(*) FILTER (WHERE ledger_role = 'party_ledger') AS dup_party FROM (SELECT pair_id, ledger_role, nref FROM s WHERE NOT missing GROUP BY ALL HAVING count(*) > 1) g GROUP BY pair_id)
, wide AS (SELECT a.*, b.* EXCLUDE (pair_id), coalesce(dup_org, 0) AS dup_org, coalesce(dup_party, 0) AS dup_party FROM a JOIN b USING (pair_id) LEFT JOIN dup USING (pair_id))
""" + " UNION ALL ".join(f"SELECT pair_id, '{check}' AS \"check\", {status or f'CASE WHEN {n} > 0 THEN {chr(39)}REVIEW{chr(39)} ELSE {chr(39)}PASS{chr(39)} END'} AS status, CAST({n} AS double) AS count, '{details}' AS details FROM wide" for check, (status, n, details) in MATCH_CHECKS.items())
