"""Staged one-to-one matching of two ledgers, for all pairs in one job.

Stages 1 and 2 take exact references with close amounts. Rows interact only if they share pair, reference and an
island of amounts (no gap above the tolerance), so an island is the unit: with one org row it is a window
expression, with several an ordered fold. Stage 3 takes contained references. In the serial rule each org row, in row_id order,
takes its best free party; all parties prefer the lowest org row_id, so mutual bests are taken at once, and what is still
contested is an ordered fold for each island of amounts.
Stages 4 and 5 propose review candidates, which take nothing. What is not taken is reported unmatched, on both sides.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions.similarity import sequence_ratio
from ..sources.durable import durable
from . import edges as E

STRONG, REVIEW, UNMATCHED_ORG, UNMATCHED_PARTY = "matched_strong", "candidate_review", "unmatched_org", "unmatched_party"
#: Reasons of review rows.
AMBIGUOUS = "Multiple exact-reference candidates; deterministic tie unresolved."
FUZZY = "Fuzzy/weak reference candidate requires manual review."
NO_REFERENCE = "Missing normalized reference on at least one side; no deterministic reference evidence. Amount/date/type candidate only."
NO_ORG = "No deterministic match found for org row."
NO_PARTY = "No deterministic match found for party row."
PICKS = "pair_id string, o_row_id string, p_row_id string, typed boolean, many boolean"


def _fold(group: pd.DataFrame) -> pd.DataFrame:
    """Org rows of an island in row_id order: a single candidate is taken, several are a review of the best."""
    taken: set[str] = set()
    out = []
    for org, own in group.groupby("o_row_id", sort=True):
        free = own[~own["p_row_id"].isin(taken)]
        if free.empty:
            continue
        typed = free[free["typed"]]
        pool = typed if len(typed) else free
        best = pool.loc[pool["rank"].idxmin()]
        if len(pool) == 1:
            taken.add(best["p_row_id"])
        out.append((own["pair_id"].iloc[0], org, best["p_row_id"], bool(len(typed)), len(pool) > 1))
    return pd.DataFrame(out, columns=["pair_id", "o_row_id", "p_row_id", "typed", "many"])


def exact_stage(org: DataFrame, party: DataFrame, tolerance: float = E.AMOUNT_TOLERANCE) -> DataFrame:
    """PICKS of stages 1 and 2: `many` rows are ambiguous and take nothing."""
    met = E.exact_ref_edges(org, party, tolerance).withColumns({"tier": F.lit(5), "score": F.lit(1.0)})
    by_amount = Window.partitionBy("pair_id", "o_nref").orderBy(F.abs("o_net_org"))
    gap = (F.abs("o_net_org") - F.lag(F.abs("o_net_org")).over(by_amount)) > 2 * tolerance * (1 + 1e-6)
    met = met.withColumn("gap", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("island", F.sum("gap").over(by_amount.rowsBetween(Window.unboundedPreceding, 0)))
    island = ["pair_id", "o_nref", "island"]
    met = met.withColumn("rank", F.row_number().over(Window.partitionBy("pair_id", "o_row_id").orderBy(*E.candidate_order())))
    whole = Window.partitionBy(*island)
    met = met.withColumn("several", F.min("o_row_id").over(whole) != F.max("o_row_id").over(whole))
    own = Window.partitionBy("pair_id", "o_row_id")
    alone = met.where(~F.col("several")).withColumn("any_typed", F.max("typed").over(own)).where(F.col("typed") == F.col("any_typed"))
    alone = alone.withColumns({"n": F.count("*").over(own), "first": F.min("rank").over(own)}).where("rank = first")
    single = alone.select("pair_id", "o_row_id", "p_row_id", F.col("any_typed").alias("typed"), (F.col("n") > 1).alias("many"))
    folded = met.where("several").select(*island, "o_row_id", "p_row_id", "typed", "rank").groupBy(*island).applyInPandas(_fold, PICKS)
    return single.unionByName(folded)


def _serial(group: pd.DataFrame) -> pd.DataFrame:
    """Org rows of an island in row_id order, each with its best free party; one pass over the sorted edges."""
    group = group.sort_values(["o_row_id", "rank"])
    served: set[str] = set()
    taken: set[str] = set()
    out = []
    for org, party in zip(group["o_row_id"], group["p_row_id"], strict=True):
        if org not in served and party not in taken:
            served.add(org)
            taken.add(party)
            out.append((org, party))
    picked = pd.DataFrame(out, columns=["o_row_id", "p_row_id"])
    picked.insert(0, "pair_id", group["pair_id"].iloc[0])
    return picked


def amount_islands(rows: DataFrame, tolerance: float) -> DataFrame:
    """rows (pair_id, o_row_id, amount, ...) with `island`: amounts of a pair without a gap above three tolerances. Only distinct cells are sorted."""
    cell = F.floor(F.col("amount") / max(tolerance, 1e-9))
    rows = rows.withColumn("cell", cell)
    by_cell = Window.partitionBy("pair_id").orderBy("cell")
    new = F.coalesce((F.col("cell") - F.lag("cell").over(by_cell) > 3).cast("int"), F.lit(0))
    cells = rows.select("pair_id", "cell").distinct().withColumn("new", new).withColumn("island", F.sum("new").over(by_cell.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.join(cells.drop("new"), ["pair_id", "cell"]).drop("cell")


def containment_stage(found: DataFrame, tolerance: float = E.AMOUNT_TOLERANCE) -> DataFrame:
    """(pair_id, o_row_id, p_row_id) of the serial rule over containment edges: mutual bests at once, contested rows by a fold."""
    rank = F.row_number().over(Window.partitionBy("pair_id", "o_row_id").orderBy(*E.candidate_order()))
    first = F.min("o_row_id").over(Window.partitionBy("pair_id", "p_row_id"))
    edges = durable(found.select("pair_id", "o_row_id", "p_row_id", F.abs("o_net_org").alias("amount"), rank.alias("rank")).withColumn("first", first))
    agreed = edges.where("rank = 1 and o_row_id = first").select("pair_id", "o_row_id", "p_row_id")
    left = edges.join(agreed.select("pair_id", "o_row_id"), ["pair_id", "o_row_id"], "left_anti").join(agreed.select("pair_id", "p_row_id"), ["pair_id", "p_row_id"], "left_anti")
    contested = amount_islands(left, tolerance).select("pair_id", "island", "o_row_id", "p_row_id", "rank")
    return agreed.unionByName(contested.groupBy("pair_id", "island").applyInPandas(_serial, "pair_id string, o_row_id string, p_row_id string"))


def picks(ledger: DataFrame, tolerance: float = E.AMOUNT_TOLERANCE, days: int = E.DATE_TOLERANCE_DAYS) -> DataFrame:
    """pair_id, o_row_id, p_row_id, match_status, match_rule, match_confidence, review_reason, pass: one row a record."""
    return picks_of(durable(E.prepared(ledger)), tolerance, days)


def picks_of(rows: DataFrame, tolerance: float = E.AMOUNT_TOLERANCE, days: int = E.DATE_TOLERANCE_DAYS) -> DataFrame:
    """picks() of prepared rows, which are read several times."""
    org, party = E.split(rows)
    row = lambda df, status, rule, conf, reason, n: df.select("pair_id", "o_row_id", "p_row_id", F.lit(status).alias("match_status"), (rule if not isinstance(rule, str) else F.lit(rule)).alias("match_rule"), (conf if not isinstance(conf, float) else F.lit(conf)).alias("match_confidence"), (reason if not isinstance(reason, str) else F.lit(reason)).alias("review_reason"), F.lit(n).alias("pass"))
    exact = durable(exact_stage(org, party, tolerance))
    sure = exact.where(~F.col("many"))
    parts = [
        row(sure, STRONG, F.when(F.col("typed"), "stage1_exact_ref_type_amount").otherwise("stage2_exact_ref_amount"), F.when(F.col("typed"), 1.0).otherwise(0.95), "", 1),
        row(exact.where("many"), REVIEW, "stage1_2_ambiguous_exact_ref", 0.7, AMBIGUOUS, 1),
    ]
    free_org = org.join(sure.select("pair_id", "o_row_id"), ["pair_id", "o_row_id"], "left_anti")
    free_party = party.join(sure.select("pair_id", "p_row_id"), ["pair_id", "p_row_id"], "left_anti")
    band = durable(E.band_edges(free_org, free_party, tolerance, days))
    contained = durable(containment_stage(E.containment_edges(band), tolerance))
    parts.append(row(contained, STRONG, "stage3_containment_ref_amount", 0.9, "", 2))

    weak = E.fuzzy_edges(band).unionByName(E.no_reference_edges(band))
    weak = weak.join(contained.select("pair_id", "o_row_id"), ["pair_id", "o_row_id"], "left_anti")
    takers = contained.select("pair_id", "p_row_id", F.col("o_row_id").alias("taker"))
    weak = weak.join(takers, ["pair_id", "p_row_id"], "left").where(F.col("taker").isNull() | (F.col("taker") > F.col("o_row_id")))
    best = E.best_candidates(weak)
    alike = F.col("tier") == 3
    parts.append(row(best, REVIEW, F.when(alike, "stage4_fuzzy_ref_amount_date").otherwise("stage5_no_ref_amount_date"), F.when(alike, 0.6).otherwise(0.4), F.when(alike, FUZZY).otherwise(NO_REFERENCE), 2))

    o_left = free_org.join(contained.select("pair_id", "o_row_id"), ["pair_id", "o_row_id"], "left_anti").select("pair_id", "o_row_id", F.lit(None).cast("string").alias("p_row_id"))
    p_left = free_party.join(contained.select("pair_id", "p_row_id"), ["pair_id", "p_row_id"], "left_anti").select("pair_id", F.lit(None).cast("string").alias("o_row_id"), "p_row_id")
    parts += [row(o_left, UNMATCHED_ORG, "stage6_unmatched_org", 0.0, NO_ORG, 3), row(p_left, UNMATCHED_PARTY, "stage7_unmatched_party", 0.0, NO_PARTY, 4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def master_match_table(ledger: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The 26 columns of a match record, numbered in order of emission within each pair."""
    r = durable(E.prepared(ledger))
    found = durable(picks_of(r) if found is None else found)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def side(role, p):
        own = {"date": text("match_date"), "reference": F.col("reference"), "normalized_reference": F.col("nref"), "amount": F.col("net_org"), "raw_type": text("raw_type"), "particulars": text("particulars"), "type": F.col("type_label")}
        return r.where(F.col("ledger_role") == role).select("pair_id", F.col("row_id").alias(f"{p[0]}_row_id"), *[c.alias(f"{p}_{k}") for k, c in own.items()])

    m = found.join(side(E.ORG, "org"), ["pair_id", "o_row_id"], "left").join(side(E.PARTY, "party"), ["pair_id", "p_row_id"], "left")
    # numbers in order of pass and row id: rows before a (pass, id prefix), and the place in it, so that a large pair is many tasks
    m = m.withColumn("__id", F.coalesce("o_row_id", "p_row_id")).withColumn("__prefix", F.substring("__id", 1, 3))
    part = ["pair_id", "pass", "__prefix"]
    sizes = found.select("pair_id", "pass", F.substring(F.coalesce("o_row_id", "p_row_id"), 1, 3).alias("__prefix")).groupBy(*part).agg(F.count("*").alias("n"))
    before = Window.partitionBy("pair_id").orderBy("pass", "__prefix").rowsBetween(Window.unboundedPreceding, -1)
    m = m.join(sizes.select(*part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base")), part)
    number = F.col("__base") + F.row_number().over(Window.partitionBy(*part).orderBy("__id"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    relation = E.reference_relation(F.col("org_normalized_reference"), F.col("party_normalized_reference"), F.col("__score"))
    # alike or not is asked only where both references are there, differ, and hold neither one the other
    a, b = blank("org_normalized_reference"), blank("party_normalized_reference")
    open_ = ~C.is_missing_reference(a) & ~C.is_missing_reference(b) & ~a.contains(b) & ~b.contains(a)
    both = m.withColumn("__score", sequence_ratio(F.lower(F.when(open_, a)), F.lower(F.when(open_, b))))
    return both.select(
        "pair_id", F.format_string("MG%06d", number).alias("match_group_id"), "match_status", "match_confidence", "match_rule",
        F.coalesce("org_type", "party_type", F.lit("")).alias("type_label"), blank("o_row_id").alias("org_row_id"), blank("p_row_id").alias("party_row_id"), blank("org_date").alias("org_date"), blank("party_date").alias("party_date"),
        F.abs(F.datediff(F.to_date(F.nullif("org_date", F.lit(""))), F.to_date(F.nullif("party_date", F.lit(""))))).alias("date_delta_days"),
        *[blank(c).alias(c) for c in ("org_reference", "party_reference", "org_normalized_reference", "party_normalized_reference")], relation.alias("reference_relation"),
        "org_amount", "party_amount", F.abs(F.abs("org_amount") - F.abs("party_amount")).alias("amount_difference"),
        *[blank(c).alias(c) for c in ("org_raw_type", "party_raw_type", "org_particulars", "party_particulars")],
        (F.col("match_status") != STRONG).alias("review_required"), "review_reason", F.lit("").alias("reviewer_comment"), F.lit("").alias("manual_status"),
    )


def match_stats(matches: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c).alias
    return matches.groupBy("pair_id").agg(n(F.col("match_status") == STRONG)("strong"), n(F.col("review_required"))("review"), n(F.col("match_status") == UNMATCHED_ORG)("unmatched_org"), n(F.col("match_status") == UNMATCHED_PARTY)("unmatched_party"))
