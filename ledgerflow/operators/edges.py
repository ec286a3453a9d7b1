"""Candidate edges between the two ledgers of a pair.

Equal amounts within a tolerance are a band join: amounts fall into cells, the party side stands in every cell that its
reach touches (one or two), and the exact predicate follows; so the join has equality keys and no pair is compared that is not
near. Exact references have the reference in the key too, so a reference that very many rows share is dealt by amount. String similarity is computed last, on what cheaper predicates left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import sequence_ratio
from .ledger import ORG, PARTY, recon_rows, transactions

AMOUNT_TOLERANCE = 0.01
DATE_TOLERANCE_DAYS = 7
FUZZY_MIN = 0.85
KEPT = ("row_id", "nref", "missing", "match_date", "type_label", "net_org", "source_row_number")
SHOWN = ("reference", "raw_type", "particulars")
#: Types that mirror each other in the two books.
MIRROR = {"Receipt": "Payment", "Payment": "Receipt", "CreditNote": "DebitNote", "DebitNote": "CreditNote"}


def amount_close(a: Column, b: Column, tolerance: float = AMOUNT_TOLERANCE) -> Column:
    return F.abs(F.abs(a) - F.abs(b)) <= tolerance


def types_compatible(a: Column, b: Column) -> Column:
    x, y = F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))
    mirrored = F.lit(False)
    for k, v in MIRROR.items():
        mirrored |= (x == k) & (y == v)
    return (x != "") & (y != "") & ((x == y) | mirrored)


def prepared(ledger: DataFrame) -> DataFrame:
    """Transactions of both ledgers with the columns that matching and its records need; of equal row ids in a ledger the last row counts."""
    r = recon_rows(transactions(ledger))
    w = Window.partitionBy("pair_id", "ledger_role", "row_id").orderBy(F.desc("source_row_number"), F.desc("raw_text"))
    r = r.withColumn("__n", F.row_number().over(w)).where("__n = 1").withColumn("source_row_number", F.coalesce("source_row_number", F.lit(0)))
    return r.select("pair_id", "ledger_role", *KEPT, *SHOWN)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(org, party) of prepared rows as o_... and p_... columns."""
    pick = lambda role, p: rows.where(F.col("ledger_role") == role).select("pair_id", *[F.col(c).alias(f"{p}_{c}") for c in KEPT])
    return pick(ORG, "o"), pick(PARTY, "p")


def sides(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split(prepared(ledger))


def with_deltas(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"amount_gap": F.abs(F.abs("o_net_org") - F.abs("p_net_org")), "days": F.abs(F.datediff("o_match_date", "p_match_date"))})


def near_cells(org: DataFrame, party: DataFrame, tolerance: float, width: float) -> tuple[DataFrame, DataFrame]:
    """org with o_cell, and party in every p_cell that amounts within the tolerance of its own may have (rounding included)."""
    width = max(width, 1e-9)
    cell = lambda amount: F.floor(amount / width)
    own = F.abs("p_net_org")
    reach = own * 1e-12 + tolerance * (1 + 1e-6)
    return org.withColumn("o_cell", cell(F.abs("o_net_org"))), party.withColumn("p_cell", F.explode(F.sequence(cell(own - reach), cell(own + reach))))


def exact_ref_edges(org: DataFrame, party: DataFrame, tolerance: float = AMOUNT_TOLERANCE) -> DataFrame:
    """Same present reference and close amounts; `typed` where the types agree too. No condition on dates."""
    a, b = near_cells(org.where(~F.col("o_missing")), party.where(~F.col("p_missing")).withColumnRenamed("pair_id", "__pair"), tolerance, 64 * tolerance)
    met = a.join(b, (F.col("pair_id") == F.col("__pair")) & (F.col("o_nref") == F.col("p_nref")) & (F.col("o_cell") == F.col("p_cell"))).drop("__pair", "o_cell", "p_cell")
    met = met.where(amount_close(F.col("o_net_org"), F.col("p_net_org"), tolerance))
    return with_deltas(met).withColumn("typed", types_compatible(F.col("o_type_label"), F.col("p_type_label")))


def band_edges(org: DataFrame, party: DataFrame, tolerance: float = AMOUNT_TOLERANCE, days: int = DATE_TOLERANCE_DAYS) -> DataFrame:
    """Close amounts and compatible dates."""
    a, b = near_cells(org, party.withColumnRenamed("pair_id", "__pair"), tolerance, 4 * tolerance)
    met = a.join(b, (F.col("pair_id") == F.col("__pair")) & (F.col("o_cell") == F.col("p_cell"))).drop("__pair", "o_cell", "p_cell")
    met = with_deltas(met.where(amount_close(F.col("o_net_org"), F.col("p_net_org"), tolerance)))
    return met.where(F.col("days").isNull() | (F.col("days") <= days))


def containment_edges(band: DataFrame) -> DataFrame:
    """Both references present, different, one inside the other."""
    a, b = F.col("o_nref"), F.col("p_nref")
    return band.where(~F.col("o_missing") & ~F.col("p_missing") & (a != b) & (a.contains(b) | b.contains(a))).withColumns({"tier": F.lit(4), "score": F.lit(0.8)})


def fuzzy_edges(band: DataFrame, minimum: float = FUZZY_MIN) -> DataFrame:
    """Both references present, neither equal nor contained, alike. Lengths alone rule most pairs out."""
    a, b = F.col("o_nref"), F.col("p_nref")
    la, lb = F.length(a), F.length(b)
    near = band.where(~F.col("o_missing") & ~F.col("p_missing") & ~a.contains(b) & ~b.contains(a) & (2.0 * F.least(la, lb) >= minimum * (la + lb)))
    return near.withColumn("tier", F.lit(3)).withColumn("score", sequence_ratio(F.lower(a), F.lower(b))).where(F.col("score") >= minimum)


def no_reference_edges(band: DataFrame) -> DataFrame:
    """A reference is missing: amount, date and type must do."""
    ok = (F.col("o_missing") | F.col("p_missing")) & types_compatible(F.col("o_type_label"), F.col("p_type_label"))
    return band.where(ok).withColumns({"tier": F.lit(1), "score": F.lit(0.0)})


def candidate_order():
    """Best first: tier, score, amount gap, days (unknown last), lowest source row, highest row id."""
    return [F.desc("tier"), F.desc("score"), F.asc("amount_gap"), F.asc(F.coalesce("days", F.lit(9999))), F.asc("p_source_row_number"), F.desc("p_row_id")]


def best_candidates(edges: DataFrame) -> DataFrame:
    w = Window.partitionBy("pair_id", "o_row_id").orderBy(*candidate_order())
    return edges.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def reference_relation(a: Column, b: Column, score: Column) -> Column:
    """missing, exact, contained_by, contains, fuzzy or ambiguous; score: the sequence ratio of both, lower-cased."""
    from ..functions.clean import is_missing_reference

    x, y = F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))
    out = F.when(is_missing_reference(x) | is_missing_reference(y), "missing").when(x == y, "exact").when(y.contains(x), "contained_by").when(x.contains(y), "contains")
    return out.when(score >= FUZZY_MIN, "fuzzy").otherwise("ambiguous")
