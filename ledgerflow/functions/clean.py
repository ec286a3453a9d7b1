"""Cleaning and typing of ledger cells as Catalyst expressions; nothing here leaves the JVM.

An absent value is null or empty, never zero. Every parse has a confidence from 0 to 100.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that mean "no reference".
MISSING_REFERENCE_TOKENS = ("", "none", "nan", "null", "-", "--")

#: Record kinds.
TRANSACTION, OPENING, CLOSING = "Transaction", "OpeningBalance", "ClosingBalance"
BALANCE_FORWARD, CARRIED, BROUGHT = "BalanceForward", "CarriedForward", "BroughtForward"
TOTAL, GRAND_TOTAL, HEADER, FOOTER, UNKNOWN = "Total", "GrandTotal", "Header", "Footer", "Unknown"

#: English month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Day first, a month number or three letters, two or four digits of year; letters do not go with dots.
DAY_FIRST = r"^(\d{1,2})(?:([-/])(\d{1,2}|[A-Za-z]{3})\2|[.](\d{1,2})[.])(\d{4}|\d{2})$"
#: A full or three-letter month name, day, four digits of year.
MONTH_FIRST = r"^([A-Za-z]+) (\d{1,2}),? (\d{4})$"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean_text(c: Column) -> Column:
    """White space collapsed and trimmed; null is empty."""
    return F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(text_or_empty(c), r"^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def parse_amount(c: Column) -> Column:
    """Amount in double precision, or null: currency marks, Cr/Dr, grouping commas and (negatives) are understood."""
    body = F.regexp_replace(F.regexp_replace(strip(c), r"(?i)rs\.?", ""), "₹", "")

    def value(text: Column) -> Column:
        core = strip(F.regexp_replace(text, r"^[()]+|[()]+$", ""))
        number = F.when(core.rlike(r"^-?\d[\d,]*(\.\d+)?$"), F.regexp_replace(core, ",", "").try_cast("double"))
        return F.when(text.startswith("(") & text.endswith(")"), -number).otherwise(number)

    return bound(strip(F.regexp_replace(body, r"(?i)\b(cr|dr)\b", "")), value)


def amount_confidence(c: Column, amount: Column | None = None) -> Column:
    """amount: the parsed text, where it is at hand."""
    def score(s: Column) -> Column:
        marks = F.when((s.contains("(") & s.contains(")")) | s.rlike(r"(?i)\b(cr|dr)\b"), 90.0).when(s.contains(","), 92.0).otherwise(95.0)
        return F.when(s == "", 0.0).when((parse_amount(s) if amount is None else amount).isNull(), 10.0).otherwise(marks)

    return bound(strip(c), score)


def looks_like_amount(c: Column) -> Column:
    return parse_amount(c).isNotNull()


def balance_side(c: Column) -> Column:
    """'Cr', 'Dr' or ''."""
    return F.initcap(F.regexp_extract(text_or_empty(c), r"(?i)\b(cr|dr)\b", 1))


def balance_confidence(c: Column, amount: Column | None = None) -> Column:
    return F.when(is_blank(c), 0.0).when((parse_amount(c) if amount is None else amount).isNull(), 10.0).when(balance_side(c) != "", 94.0).otherwise(90.0)


def looks_like_date(c: Column) -> Column:
    return strip(c).rlike(r"^\d{1,2}[-/.](\d{1,2}|[A-Za-z]{3,})[-/.]\d{2,4}$")


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once; keeps expressions that need it many times small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dated(c: Column) -> Column:
    """struct(day, score) of a text: taken apart once, parsed once. Two-digit years from 69 on are of the last century."""
    names, shorts = F.array(*map(F.lit, MONTHS)), F.array(*[F.lit(m[:3]) for m in MONTHS])

    def parts(s: Column) -> Column:
        at = lambda i: F.regexp_extract(s, DAY_FIRST, i)
        other = lambda i: F.regexp_extract(s, MONTH_FIRST, i)
        day_first = F.struct(at(1).alias("d"), F.lower(F.concat(at(3), at(4))).alias("m"), at(5).alias("y"), F.lit(False).alias("full"), F.lit(False).alias("blank"))
        month_first = F.struct(other(2).alias("d"), F.lower(other(1)).alias("m"), other(3).alias("y"), F.lit(True).alias("full"), (s == "").alias("blank"))
        return F.when(s.rlike(DAY_FIRST), day_first).otherwise(month_first)

    def result(p: Column) -> Column:
        m, y = p["m"], p["y"]
        named = m.rlike("^[a-z]")
        number = F.when(~named, m).when(F.array_contains(shorts, m) | (p["full"] & F.array_contains(names, m)), F.array_position(shorts, F.substring(m, 1, 3)).cast("string"))
        short = F.length(y) == 2
        year = F.when(short & (y >= "69"), F.concat(F.lit("19"), y)).when(short, F.concat(F.lit("20"), y)).otherwise(y)
        day = F.try_to_date(F.concat(year, F.lit("-"), number, F.lit("-"), p["d"]), "yyyy-M-d")
        score = F.when(p["blank"], 0.0).when(short, 88.0).when(named, 92.0).otherwise(96.0)
        return F.struct(day.alias("day"), score.alias("score"))

    return bound(bound(F.regexp_replace(strip(c), r"\s+", " "), parts), result)


def parse_date(c: Column) -> Column:
    """A date of the understood shapes, or null."""
    return dated(c)["day"]


def date_confidence(c: Column) -> Column:
    return bound(dated(c), confidence_of)


def confidence_of(parsed: Column) -> Column:
    """Of a dated() struct."""
    return F.when(parsed["day"].isNull() & (parsed["score"] > 0), 15.0).otherwise(parsed["score"])


def iso_date(c: Column) -> Column:
    """The date of an ISO text's first ten characters, or null."""
    s = F.substring(strip(c), 1, 10)
    return F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(s, "yyyy-M-d"))


def date_delta_days(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def period_month(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit(""))


def normalize_reference(c: Column) -> Column:
    return F.upper(F.regexp_replace(text_or_empty(c), r"[^A-Za-z0-9]+", ""))


def is_missing_reference(c: Column) -> Column:
    return F.lower(strip(c)).isin(*MISSING_REFERENCE_TOKENS)


#: Markers of special rows, in order of precedence, and the reasons that go with some kinds: (pattern, kind, reason).
KIND_MARKERS = (
    (r"\b(?:opening\s+(?:bal\.?|balance)|balance\s+brought\s+forward|b/?f)\b", OPENING, ""),
    (r"\b(?:closing\s+(?:bal\.?|balance)|balance\s+carried\s+forward|c/?f)\b", CLOSING, ""),
    (r"\b(?:debit|credit|dr\.?|cr\.?)\s+balance\b", CLOSING, "Dr/Cr balance line treated as closing balance."),
    (r"\bbalance\s*(?:c/?[fod]|b/?[fod])\b", BALANCE_FORWARD, ""),
    (r"(?:\bcarried\s+(?:over|forward|down)\b|\bc\s*/\s*[fod]\b|\bc\.f\.)", CARRIED, ""),
    (r"(?:\bbrought\s+(?:over|forward|down)\b|\bb\s*/\s*[fod]\b|\bb\.f\.)", BROUGHT, ""),
    (r"\bgrand\s+totals?\b", GRAND_TOTAL, ""),
    (r"\b(?:totals?|(?:debit|credit)\s+totals?|sub\s*-?\s*totals?)\b", TOTAL, ""),
)
#: Every marker holds one of these; most texts hold none, and then no marker is looked for.
MARKED = r"bal|total|carried|brought|[bc]\s*[/.]?\s*[fod]"
UNTITLED_TOTAL = "Untitled amount-only row treated as subtotal/total."
NO_MARKER = "Transaction lacks a date or type marker."
EMPTY_ROW = "Empty row."
UNRECOGNISED = "Row has no amount and no recognised marker."


def record_kind(raw: Column, has_amount: Column, has_date: Column, has_type: Column, is_header: Column | None = None) -> Column:
    """struct(kind, reason): markers of balances and totals win over what looks like a transaction."""
    kind = lambda k, why="": F.struct(F.lit(k).alias("kind"), F.lit(why).alias("reason"))

    def plain(text: Column, out: Column | None = None) -> Column:
        when = F.when if out is None else out.when
        bare = F.regexp_replace(text, "[^A-Za-z]", "") == ""
        out = when(has_amount & ~has_date & ~has_type & bare, kind(TOTAL, UNTITLED_TOTAL))
        out = out.when(has_amount & (has_date | has_type), kind(TRANSACTION))
        out = out.when(has_amount, kind(TRANSACTION, NO_MARKER))
        return out.when(text == "", kind(UNKNOWN, EMPTY_ROW)).otherwise(kind(UNKNOWN, UNRECOGNISED))

    def judged(text: Column, low: Column) -> Column:
        out = F.when(F.lit(False) if is_header is None else is_header, kind(HEADER)).when(~low.rlike(MARKED), plain(text))
        for pattern, name, why in KIND_MARKERS:
            out = out.when(low.rlike(pattern), kind(name, why))
        return plain(text, out)

    return bound(clean_text(raw), lambda text: bound(F.lower(text), lambda low: judged(text, low)))


def flag(c: Column) -> Column:
    """Booleans as written by people: true, 1, yes."""
    return F.lower(strip(c)).isin("true", "1", "yes")


def first_filled(*cols: Column) -> Column:
    """The first that is not blank, trimmed; else empty."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cols], F.lit(""))


def money_text(c: Column) -> Column:
    return F.round(c, 2).cast("decimal(18,2)").cast("string")


def exact_sum(c: Column) -> Column:
    """Sum of money in decimals, given as double: the same whatever the order of rows."""
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def joined_reasons(*reasons: Column) -> Column:
    """Non-null reasons joined by '; '."""
    return F.array_join(F.array_compact(F.array(*reasons)), "; ")


def sheet_name(c: Column) -> Column:
    """A legal sheet name of at most 31 characters."""
    name = F.regexp_replace(clean_text(F.regexp_replace(text_or_empty(c), r"[:\\/?*\[\]]", "")), "^'+|'+$", "")
    return F.coalesce(F.nullif(F.substring(name, 1, 31), F.lit("")), F.lit("Ledger"))


#: Fixed value: the slug of a name without letters or digits.
DEFAULT_SLUG = "reference_workbook"


def slug(c: Column) -> Column:
    """What stands before " - " (or else before the first hyphen) in lower case, runs of other characters as one underscore."""
    text = text_or_empty(c)
    head = F.when(text.contains(" - "), F.substring_index(text, " - ", 1)).otherwise(F.substring_index(text, "-", 1))
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(F.regexp_replace(head, r"[^a-zA-Z0-9]+", "_"), r"^_+|_+$", "")), F.lit("")), F.lit(DEFAULT_SLUG))


def looks_like_colour(c: Column) -> Column:
    """An (A)RGB text that is neither transparent nor white."""
    return F.coalesce(F.length(c).isin(6, 8) & ~c.isin("00000000", "FFFFFFFF", "FFFFFF"), F.lit(False))


def row_class(status: Column, review: Column) -> Column:
    """match, review or fail, for the look of a match row; null for others."""
    s = F.lower(strip(status))
    return F.when(s == "matched_strong", "match").when(review | (s == "candidate_review"), "review").when(s.isin("unmatched_org", "unmatched_party"), "fail")


def is_formula(c: Column) -> Column:
    return F.coalesce(c.startswith("="), F.lit(False))


def confidence_band(c: Column) -> Column:
    return F.when(c >= 90, "high").when(c >= 80, "acceptable").when(c >= 70, "needs_review").otherwise("unmatched")


def row_identity(role: Column, file: Column, page: Column, row_no: Column, raw: Column) -> Column:
    """First twelve hex digits of sha1 over role|file|page|row|text."""
    parts = [text_or_empty(x) for x in (role, file, page, row_no, raw)]
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("|"), p)
    return F.substring(F.sha1(joined), 1, 12)


def without_reasons(c: Column, pattern: str) -> Column:
    """Reasons ('; '-joined) without those that match the pattern."""
    return F.array_join(F.filter(F.transform(F.split(text_or_empty(c), ";"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.lower(x).rlike(pattern)), "; ")
