"""Raw cells to canonical ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import ledger as L


def formalize(cells: DataFrame, labels=None) -> DataFrame:
    """Raw cells to canonical rows: typing, carried dates, labels, perspective, reasons, ids.

    Cells are dealt by page before they are parsed, as the window over pages needs them, and rows are left out after it: so the
    parsing is spread, and done once (a filter on parsed values would be pushed below and parse them again)."""
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    typed = L.type_rows(cells.repartition(parts, *L.PAGE))
    scored = typed.withColumn("row_confidence", L.row_confidence(typed["layout_confidence"], typed["date_parse_confidence"], typed["amount_parse_confidence"], typed["record_kind"]))
    return L.assemble(L.emitted(L.carry_dates(scored, L.is_emitted())), labels, types=cells)
