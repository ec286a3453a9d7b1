"""Two ledgers derived from `orders` by arithmetic on the order key, in SQL that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw types by key % 8, their mirror in the party's book, and the labels both have.
RAW = ("Sale", "Rcpt", "Pymt", "SlRt", "PrRt", "Jrnl", "TDS", "Mystery")
MIRRORED = ("Purchase", "Pymt", "Rcpt", "PrRt", "SlRt", "Jrnl", "TDS", "Mystery")
LABEL = {"Sale": "Invoice", "Purchase": "Invoice", "Rcpt": "Receipt", "Pymt": "Payment", "SlRt": "CreditNote", "PrRt": "DebitNote", "Jrnl": "Journal", "TDS": "TDS", "Mystery": "Unknown"}


def _case(of: str, values) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: ledger(pair_id, ledger_role, row_id, record_kind, source_file, page_number, source_row_number, date, normalized_date, raw_date, raw_type, type_label,
#: particulars, account, voucher_no, reference_no, normalized_reference, debit_source, credit_source, balance_source, debit_org_perspective,
#: credit_org_perspective, amount_org_perspective, raw_text, review_flag, review_reason, confidence_score)
LEDGER_SQL = f"""
WITH base AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS v, CAST(o_orderdate AS date) AS d,
         CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('SA/25-26/', lpad(CAST(o_orderkey AS string), 7, '0')) END AS ref
  FROM orders
), org AS (
  SELECT k, 0 AS copy, concat('pair_', lpad(CAST(c % 8 AS string), 3, '0')) AS pair_id, 'org_ledger' AS ledger_role, ref AS reference_no, d AS day, v AS amount,
         {_case("k % 8", RAW)} AS raw_type
  FROM base
), party AS (
  SELECT k, copy, concat('pair_', lpad(CAST(c % 8 AS string), 3, '0')) AS pair_id, 'party_ledger' AS ledger_role,
         CASE WHEN ref = '' THEN '' WHEN k % 7 = 1 THEN concat('64858/', ref) WHEN k % 7 = 2 THEN concat(substr(ref, 1, 14), substr(ref, 16, 1), substr(ref, 15, 1)) WHEN k % 7 = 3 THEN '' ELSE ref END AS reference_no,
         date_add(d, CAST(k % 12 - 2 AS int)) AS day, CASE WHEN k % 17 = 0 THEN v + 125.0 ELSE v END AS amount,
         {_case("k % 8", MIRRORED)} AS raw_type
  FROM base CROSS JOIN (SELECT 0 AS copy UNION ALL SELECT 1 AS copy) copies
  WHERE k % 13 <> 0 AND (copy = 0 OR k % 23 = 0)
), ledger AS (
  SELECT pair_id, ledger_role, substr(sha1(concat(ledger_role, '|orders|1|', CAST(k AS string), '|', CAST(copy AS string))), 1, 12) AS row_id, 'Transaction' AS record_kind,
         'orders' AS source_file, CAST(1 AS int) AS page_number, CAST(k AS int) AS source_row_number, day AS date, CAST(day AS string) AS normalized_date, CAST(day AS string) AS raw_date, raw_type,
         {_case("raw_type", ()).replace(" END", " ".join([""] + [f"WHEN '{k}' THEN '{v}'" for k, v in LABEL.items()]) + " END")} AS type_label,
         concat('order ', CAST(k AS string)) AS particulars, '' AS account, reference_no AS voucher_no, reference_no, upper(regexp_replace(reference_no, '[^A-Za-z0-9]+', ''{{flags}})) AS normalized_reference,
         CASE WHEN ledger_role = 'org_ledger' THEN amount END AS debit_source, CASE WHEN ledger_role = 'party_ledger' THEN amount END AS credit_source, CAST(NULL AS double) AS balance_source,
         amount AS debit_org_perspective, CAST(NULL AS double) AS credit_org_perspective, amount AS amount_org_perspective,
         concat('order ', CAST(k AS string), ' ', raw_type) AS raw_text, (raw_type = 'Mystery') AS review_flag, CASE WHEN raw_type = 'Mystery' THEN 'Type could not be classified.' ELSE '' END AS review_reason,
         CAST(90 - k % 20 AS double) AS confidence_score
  FROM (SELECT * FROM org UNION ALL SELECT * FROM party) rows
)
"""

SPARK_LEDGER = LEDGER_SQL.replace("{flags}", "").replace("{", "{")
#: The same for an engine whose regexp_replace needs a flag to replace all.
OTHER_LEDGER = LEDGER_SQL.replace("{flags}", ", 'g'").replace("date_add(d, CAST(k % 12 - 2 AS int))", "CAST(d + CAST(k % 12 - 2 AS int) AS date)")


def ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ledgers of all pairs."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return spark.sql(SPARK_LEDGER.replace("FROM orders", "FROM {orders}") + " SELECT * FROM ledger", orders=orders)


def extracted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text cells as a page parser leaves them: one page for every 40 orders, markers, dates and amounts in many spellings."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, day, v = F.col("o_orderkey"), F.col("o_orderdate").cast("date"), F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string")
    kind = (k % 10).cast("int")
    date = F.element_at(F.array(F.date_format(day, "dd-MM-yyyy"), F.date_format(day, "d-M-yy"), F.date_format(day, "d-MMM-yy"), F.lit(""), F.lit(""), F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "dd.MM.yyyy"), F.lit("not-a-date"), F.date_format(day, "MMMM d yyyy"), F.date_format(day, "d-MMM-yyyy")), kind + 1)
    amount = F.element_at(F.array(v, F.concat(F.lit("Rs. "), v), F.concat(v, F.lit(" Cr")), F.concat(F.lit("("), v, F.lit(")")), v, F.lit("abc"), v, v, v, F.concat(v, F.lit(" Dr"))), ((k % 7) + 1).cast("int"))
    raw_type = F.element_at(F.array(*[F.lit(x) for x in ("Sale", "Rcpt", "bank pymt", "SlRt", "Purchse", "Jrnl", "zzzqqq", "")]), ((k % 8) + 1).cast("int"))
    mark = F.when(k % 97 == 0, "Opening Balance ").when(k % 89 == 0, "By Closing Balance ").when(k % 83 == 0, "Grand Total ").when(k % 79 == 0, "Carried Over ").otherwise("")
    return o.select(
        F.concat(F.lit("pair_"), F.lpad((F.col("o_custkey") % 8).cast("string"), 3, "0")).alias("pair_id"), F.when(k % 2 == 0, "org_ledger").otherwise("party_ledger").alias("ledger_role"), F.lit("orders.pdf").alias("source_file"),
        F.floor(k / 40).cast("int").alias("page_number"), k.cast("int").alias("source_row_number"), date.alias("raw_date"), raw_type.alias("raw_type"), F.concat(F.lit("order "), k.cast("string")).alias("particulars"), F.lit("").alias("account"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("V/"), k.cast("string"))).alias("voucher_no"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("SA / 25-26 / "), k.cast("string"))).alias("reference_no"),
        F.when(k % 2 == 0, amount).otherwise("").alias("debit_raw_source"), F.when(k % 2 == 1, amount).otherwise("").alias("credit_raw_source"), F.lit("").alias("balance_raw_source"), F.concat(mark, date, F.lit(" "), raw_type, F.lit(" "), amount).alias("raw_text"),
        F.lit(90.0).alias("layout_confidence"), F.lit("table").alias("extraction_method"), F.lit('{"date": 98.0, "debit": 90.0}').alias("column_confidence_json"),
    )
