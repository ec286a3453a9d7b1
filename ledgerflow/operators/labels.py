"""Type labels: exact, then longest substring, then best fuzzy alias.

The alias dictionary is small and fixed, so it is a literal array in the plan; distinct raw types are classified once and
joined back. What is classified hangs on their count, so no alias test can be pushed below the grouping onto all rows; the
similarity UDF works only on those without an exact or substring alias.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import confidence_band, strip, text_or_empty
from ..functions.similarity import indel

#: Canonical labels and their aliases; the order decides ties.
TYPE_LABELS = {
    "Invoice": ["sale", "sales", "purchase", "purc", "invoice", "bill"],
    "CreditNote": ["cn", "crnt", "slrt", "sales return", "credit note"],
    "DebitNote": ["dn", "debit note", "prrt", "purchase return"],
    "Payment": ["payment", "pymt", "bank payment", "neft", "rtgs", "upi"],
    "Receipt": ["receipt", "rcpt", "bank receipt"],
    "TDS": ["tds", "income tax", "tax deducted"],
    "PQV": ["pqv", "quality variance", "price variance", "qty variance"],
    "Journal": ["jrnl", "journal", "round off", "adjustment"],
    "OpeningBalance": ["opening balance", "opening", "ob"],
    "ClosingBalance": ["closing balance", "closing"],
}
UNKNOWN_LABEL = "Unknown"
FUZZY_FLOOR = 70.0


def load_labels(path: str | None = None) -> dict[str, list[str]]:
    """A label dictionary from JSON (an object of lists), or the built-in one."""
    if path is None:
        return TYPE_LABELS
    with open(path, encoding="utf-8") as f:
        out = json.load(f)
    if not isinstance(out, dict) or not all(isinstance(v, list) for v in out.values()):
        raise ValueError("a label dictionary is an object of lists")
    return out


def alias_rows(labels: dict[str, list[str]] | None = None) -> list[tuple[int, int, str, str, str]]:
    """(label_pos, alias_pos, canonical, alias, norm_alias) in dictionary order."""
    return [(i, j, canonical, alias, " ".join(alias.lower().split())) for i, (canonical, aliases) in enumerate((labels or TYPE_LABELS).items()) for j, alias in enumerate(aliases)]


def normalized_type(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"\s+", " ")


def _alias_array(labels) -> Column:
    return F.array(*[F.struct(F.length(F.lit(n)).alias("len"), F.lit(c).alias("canonical"), F.lit(a).alias("alias"), F.lit(n).alias("norm")) for _, _, c, a, n in alias_rows(labels)])


def classify_types(types: DataFrame, col: str = "raw_type", labels: dict[str, list[str]] | None = None, threshold: float = FUZZY_FLOOR) -> DataFrame:
    """One row for each distinct raw type: canonical label, method, score, alias, band, review."""
    aliases = alias_rows(labels)
    raw = types.select(text_or_empty(F.col(col)).alias("raw_type")).groupBy("raw_type").agg(F.count("*").alias("uses")).withColumn("norm", F.when(F.col("uses") > 0, normalized_type(F.col("raw_type"))))
    known = _alias_array(labels)
    exact = F.get(F.filter(known, lambda a: a["norm"] == F.col("norm")), F.lit(0))
    inside = F.array_max(F.filter(known, lambda a: F.col("norm").contains(a["norm"])))
    hit = F.when(F.col("norm") != "", F.coalesce(exact, inside))

    @F.pandas_udf("struct<canonical: string, alias: string, score: double>")
    def best(norm):
        import pandas as pd

        out = []
        for text in norm:
            top = ("", "", 0.0)
            for _, _, canonical, alias, own in aliases if text else ():
                score = indel(text, own)
                if score > top[2]:  # the first of equals stays
                    top = (canonical, alias, score)
            out.append(top)
        return pd.DataFrame(out, columns=["canonical", "alias", "score"])

    rows = raw.withColumn("hit", hit).withColumn("is_exact", exact.isNotNull()).withColumn("b", best(F.when(F.col("hit").isNull(), F.col("norm"))))
    sure = F.col("hit").isNotNull()
    rows = rows.select(
        "raw_type",
        F.when(sure, F.col("hit.canonical")).when(F.col("b.score") >= threshold, F.col("b.canonical")).otherwise(UNKNOWN_LABEL).alias("canonical"),
        F.when(sure & F.col("is_exact"), "exact").when(sure, "substring").when(F.col("b.score") > 0, "fuzzy").otherwise("none").alias("match_method"),
        F.when(sure, 100.0).otherwise(F.col("b.score")).alias("match_score"),
        F.when(sure, F.col("hit.alias")).otherwise(F.nullif(F.col("b.alias"), F.lit(""))).alias("matched_alias"),
    )
    band = confidence_band(F.col("match_score"))
    shown = F.format_string("%.0f", F.bround("match_score", 0))
    reason = (
        F.when(band == "unmatched", F.concat(F.lit("Type '"), F.col("raw_type"), F.lit("' unmatched (best score "), shown, F.lit(f" < {FUZZY_FLOOR:.0f}).")))
        .when(band == "needs_review", F.concat(F.lit("Type '"), F.col("raw_type"), F.lit("' low confidence (score "), shown, F.lit("); needs review.")))
        .when(F.col("canonical") == UNKNOWN_LABEL, "Type could not be classified.")
        .otherwise("")
    )
    return rows.select("raw_type", F.when(band == "unmatched", UNKNOWN_LABEL).otherwise(F.col("canonical")).alias("type_label"), F.col("match_score").alias("type_confidence"), band.alias("type_band"), "match_method", "matched_alias", (reason != "").alias("type_review"), reason.alias("type_reason"))


def with_labels(rows: DataFrame, col: str = "raw_type", labels: dict[str, list[str]] | None = None, types: DataFrame | None = None) -> DataFrame:
    """rows with the columns of classify_types. Raw types are few against rows, but their number is not bounded: AQE picks the join.

    types: a frame that holds all raw types of the rows and is cheaper to read (default: the rows)."""
    found = classify_types(rows if types is None else types, col, labels).withColumnRenamed("raw_type", "__raw")
    return rows.join(found, text_or_empty(F.col(col)) == F.col("__raw"), "left").drop("__raw")
