"""Registered queries and, where SQL expresses them, the same in SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles as Q
from .functions import clean as C
from .functions import similarity as S
from .functions import text as T
from .operators import edges as E
from .operators import folds, labels, layout, ledger, resolve
from .plans import bundles, extraction, quality, reconcile, reports, structure
from .sources import synth
from .sources.durable import durable
from .sources.files import cache_key, detected_name, distinct_balances, extraction_summary, fingerprints, ledger_pair, merged_results, run_manifest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Dirty text cells by arithmetic on the order key, in SQL that both engines read alike.
TEXTS = """
WITH base AS (
  SELECT o_orderkey AS k, CAST(o_orderdate AS date) AS d, CAST(CAST(round(o_totalprice, 2) AS decimal(18,2)) AS string) AS v FROM orders
), parts AS (
  SELECT *, CAST(day(d) AS string) AS dd, CAST(month(d) AS string) AS mm, CAST(year(d) AS string) AS yy, substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month(d) * 3 - 2 AS int), 3) AS mon FROM base
), texts AS (
  SELECT k, d, v,
    CASE k % 8 WHEN 0 THEN v WHEN 1 THEN concat('Rs. ', v) WHEN 2 THEN concat(v, ' Cr') WHEN 3 THEN concat('(', v, ')') WHEN 4 THEN concat(' ', v, ' Dr ') WHEN 5 THEN 'abc' WHEN 6 THEN '' ELSE concat('1,06,', lpad(CAST(k % 1000 AS string), 3, '0'), '.50') END AS amount_text,
    CASE k % 9 WHEN 0 THEN concat(lpad(dd, 2, '0'), '-', lpad(mm, 2, '0'), '-', yy) WHEN 1 THEN concat(dd, '-', mm, '-', substr(yy, 3, 2)) WHEN 2 THEN concat(dd, '-', mon, '-', substr(yy, 3, 2)) WHEN 3 THEN concat(dd, '-', mon, '-', yy)
      WHEN 4 THEN concat(dd, '/', mm, '/', yy) WHEN 5 THEN concat(dd, '.', mm, '.', yy) WHEN 6 THEN 'not-a-date' WHEN 7 THEN '' ELSE concat(mon, ' ', dd, ', ', yy) END AS date_text,
    CASE k % 10 WHEN 0 THEN 'Opening Bal. = Rs. 0.00' WHEN 1 THEN 'By Closing Balance 13,896.00' WHEN 2 THEN 'Total 20,07,983.49' WHEN 3 THEN '17,75,015.00 17,61,119.00' WHEN 4 THEN 'Carried Over' WHEN 5 THEN 'Totals b/d 1.00' WHEN 6 THEN 'Debit Balance 5.00' WHEN 7 THEN 'Grand Total 5.00' WHEN 8 THEN '' ELSE 'Sale 5.00' END AS row_text,
    CASE k % 6 WHEN 0 THEN concat('SA/PB/25-26/', CAST(k AS string)) WHEN 1 THEN concat('  dl / 25-26 / ', CAST(k AS string)) WHEN 2 THEN concat('64858.', CAST(k AS string), 'sc') WHEN 3 THEN 'None' WHEN 4 THEN ' -- ' ELSE '' END AS ref_text,
    CASE k % 9 WHEN 0 THEN 'Sale' WHEN 1 THEN ' RCPT ' WHEN 2 THEN 'bank  pymt' WHEN 3 THEN 'sales return x' WHEN 4 THEN 'Jrnl' WHEN 5 THEN 'income tax 94' WHEN 6 THEN 'job work' WHEN 7 THEN 'zzzqqq-7' ELSE '' END AS type_text
  FROM parts
)
"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_totalprice")
    return spark.sql(TEXTS.replace("FROM orders", "FROM {orders}") + " SELECT * FROM texts", orders=orders)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LEDGER = synth.OTHER_LEDGER
#: Both sides as matching sees them, in SQL.
SIDES = LEDGER + """
, s AS (SELECT pair_id, ledger_role, row_id, trim(normalized_reference) AS nref, lower(trim(normalized_reference)) IN ('', 'none', 'nan', 'null', '-', '--') AS missing, date AS day, type_label, amount_org_perspective AS net, source_row_number AS n FROM ledger)
, o AS (SELECT * FROM s WHERE ledger_role = 'org_ledger'), p AS (SELECT * FROM s WHERE ledger_role = 'party_ledger')
, e AS (SELECT o.pair_id, o.row_id AS o_row_id, p.row_id AS p_row_id, o.nref AS o_nref, p.nref AS p_nref, o.missing AS o_missing, p.missing AS p_missing, o.type_label AS o_type, p.type_label AS p_type, p.n AS p_n, abs(abs(o.net) - abs(p.net)) AS amount_gap, abs(date_diff('day', o.day, p.day)) AS days
        FROM o JOIN p ON o.pair_id = p.pair_id AND p.net BETWEEN o.net - 0.02 AND o.net + 0.02 WHERE abs(abs(o.net) - abs(p.net)) <= 0.01)
"""
COMPATIBLE = "(o_type <> '' AND (o_type = p_type OR (o_type, p_type) IN (('Receipt', 'Payment'), ('Payment', 'Receipt'), ('CreditNote', 'DebitNote'), ('DebitNote', 'CreditNote'))))"
MONEY = "CAST(sum(CAST({} AS decimal(18,2))) AS double)"


# -- scalars ---------------------------------------------------------------------------------------------------------


@query(TEXTS + """, b AS (SELECT k, trim(amount_text) AS s, trim(regexp_replace(regexp_replace(trim(amount_text), '(?i)rs\\.?', '', 'g'), '(?i)\\b(cr|dr)\\b', '', 'g')) AS body FROM texts)
, c AS (SELECT *, trim(body, '()') AS core FROM b), r AS (SELECT *, CASE WHEN regexp_matches(core, '^-?\\d[\\d,]*(\\.\\d+)?$') THEN CAST(replace(core, ',', '') AS double) END AS a FROM c)
SELECT k, CASE WHEN body LIKE '(%)' THEN -a ELSE a END AS amount, CASE WHEN s = '' THEN 0e0 WHEN a IS NULL THEN 10e0 WHEN s LIKE '%(%)%' OR regexp_matches(s, '(?i)\\b(cr|dr)\\b') THEN 90e0 WHEN s LIKE '%,%' THEN 92e0 ELSE 95e0 END AS confidence FROM r""")
def amount_parse(spark, sf_dir):
    c = F.col("amount_text")
    return texts(spark, sf_dir).select("k", C.parse_amount(c).alias("amount"), C.amount_confidence(c).alias("confidence"))


@query(TEXTS + "SELECT k, CASE WHEN k % 8 = 2 THEN 'Cr' WHEN k % 8 = 4 THEN 'Dr' ELSE '' END AS side, CASE WHEN k % 8 = 6 THEN 0e0 WHEN k % 8 = 5 THEN 10e0 WHEN k % 8 IN (2, 4) THEN 94e0 ELSE 90e0 END AS confidence FROM texts")
def balance_parse(spark, sf_dir):
    c = F.col("amount_text")
    return texts(spark, sf_dir).select("k", C.balance_side(c).alias("side"), C.balance_confidence(c).alias("confidence"))


@query(TEXTS + "SELECT k, CASE WHEN k % 9 NOT IN (6, 7) THEN d END AS day, CASE k % 9 WHEN 1 THEN 88e0 WHEN 2 THEN 88e0 WHEN 3 THEN 92e0 WHEN 8 THEN 92e0 WHEN 6 THEN 15e0 WHEN 7 THEN 0e0 ELSE 96e0 END AS confidence, k % 9 NOT IN (6, 7, 8) AS looks_like FROM texts")
def date_parse(spark, sf_dir):
    c = F.col("date_text")
    return texts(spark, sf_dir).select("k", C.parse_date(c).alias("day"), C.date_confidence(c).alias("confidence"), C.looks_like_date(c).alias("looks_like"))


@query(TEXTS + """SELECT k, CASE k % 10 WHEN 0 THEN 'OpeningBalance' WHEN 1 THEN 'ClosingBalance' WHEN 2 THEN 'Total' WHEN 3 THEN 'Total' WHEN 4 THEN 'CarriedForward' WHEN 5 THEN 'BroughtForward' WHEN 6 THEN 'ClosingBalance' WHEN 7 THEN 'GrandTotal' WHEN 8 THEN 'Unknown' ELSE 'Transaction' END AS kind,
CASE k % 10 WHEN 3 THEN 'Untitled amount-only row treated as subtotal/total.' WHEN 6 THEN 'Dr/Cr balance line treated as closing balance.' WHEN 8 THEN 'Empty row.' ELSE '' END AS reason FROM texts""")
def record_kind(spark, sf_dir):
    m = F.col("k") % 10
    return texts(spark, sf_dir).withColumn("r", C.record_kind(F.col("row_text"), ~m.isin(4, 8), F.lit(False), m == 9)).select("k", "r.kind", "r.reason")


@query(TEXTS + "SELECT k, upper(regexp_replace(ref_text, '[^A-Za-z0-9]+', '', 'g')) AS nref, lower(trim(ref_text)) IN ('', 'none', 'nan', 'null', '-', '--') AS missing FROM texts")
def reference_normalize(spark, sf_dir):
    c = F.col("ref_text")
    return texts(spark, sf_dir).select("k", C.normalize_reference(c).alias("nref"), C.is_missing_reference(c).alias("missing"))


@query("SELECT o_orderkey AS k, substr(sha1(concat('org_ledger|orders|1|', CAST(o_orderkey AS varchar), '|', o_orderpriority)), 1, 12) AS row_id FROM orders")
def row_identity(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("k"), C.row_identity(F.lit("org_ledger"), F.lit("orders"), F.lit(1), F.col("o_orderkey"), F.col("o_orderpriority")).alias("row_id"))


@query(TEXTS + """SELECT k, CASE k % 9 WHEN 0 THEN 'Invoice' WHEN 1 THEN 'Receipt' WHEN 2 THEN 'Payment' WHEN 3 THEN 'CreditNote' WHEN 4 THEN 'Journal' WHEN 5 THEN 'TDS' WHEN 6 THEN 'OpeningBalance' ELSE 'Unknown' END AS type_label,
CASE k % 9 WHEN 0 THEN 'exact' WHEN 1 THEN 'exact' WHEN 4 THEN 'exact' WHEN 2 THEN 'substring' WHEN 3 THEN 'substring' WHEN 5 THEN 'substring' WHEN 6 THEN 'substring' WHEN 7 THEN 'fuzzy' ELSE 'none' END AS match_method, k % 9 IN (7, 8) AS type_review FROM texts""")
def type_labels(spark, sf_dir):
    return labels.with_labels(texts(spark, sf_dir), "type_text").select("k", "type_label", "match_method", "type_review")


@query("WITH RECURSIVE words AS (SELECT p_partkey, ['recipt', 'purchse', 'jornal', 'debt note', 'paymnt', 'invoce', 'qwrtz'][CAST(p_partkey % 7 + 1 AS int)] AS raw_type FROM part)" + Q.labels_sql("words") + """
SELECT p_partkey, w.raw_type, CASE WHEN l.score < 70 THEN 'Unknown' ELSE l.type_label END AS type_label, l.score AS type_confidence, CASE WHEN l.score >= 90 THEN 'high' WHEN l.score >= 80 THEN 'acceptable' WHEN l.score >= 70 THEN 'needs_review' ELSE 'unmatched' END AS type_band, l.match_method FROM words w JOIN labelled l ON l.raw_type = w.raw_type""")
def type_label_fuzzy(spark, sf_dir):
    words = F.element_at(F.array(*[F.lit(x) for x in ("recipt", "purchse", "jornal", "debt note", "paymnt", "invoce", "qwrtz")]), ((F.col("p_partkey") % 7) + 1).cast("int"))
    return labels.with_labels(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", words.alias("raw_type"))).select("p_partkey", "raw_type", "type_label", "type_confidence", "type_band", "match_method")


@query("SELECT o_orderkey AS k, CASE WHEN o_totalprice >= 400000 THEN 'high' WHEN o_totalprice >= 300000 THEN 'acceptable' WHEN o_totalprice >= 200000 THEN 'needs_review' ELSE 'unmatched' END AS band, strftime(o_orderdate, '%Y-%m') AS period FROM orders")
def confidence_bands(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    score = F.when(F.col("o_totalprice") >= 400000, 90).when(F.col("o_totalprice") >= 300000, 80).when(F.col("o_totalprice") >= 200000, 70).otherwise(69)
    return o.select(F.col("o_orderkey").alias("k"), C.confidence_band(score).alias("band"), C.period_month(F.col("o_orderdate").cast("date")).alias("period"))


@query("WITH RECURSIVE src AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part), distinct_src AS (SELECT DISTINCT a, b FROM src)" + Q.subsequence_sql("distinct_src", "lcs") + Q.token_set_sql("distinct_src", "tokens") + Q.sequence_sql("distinct_src", "seq") + """
SELECT p_partkey, CAST(lcs.score AS double) AS indel, CAST(tokens.score AS double) AS token_set, CAST(ratio AS double) AS sequence FROM src JOIN lcs USING (a, b) JOIN tokens USING (a, b) JOIN seq USING (a, b)""")
def string_similarities(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b"))
    return p.select("p_partkey", S.indel_ratio("a", "b").alias("indel"), S.token_set_ratio("a", "b").alias("token_set"), S.sequence_ratio("a", "b").alias("sequence"))


@query("SELECT s_suppkey AS k, coalesce(nullif(trim(regexp_replace(lower(CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'Acme (' || s_nationkey || ') & Co' ELSE '' END), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'reference_workbook') AS slug, substr(trim(regexp_replace(s_name, '[:\\\\/?*\\[\\]]', '', 'g')), 1, 31) AS sheet FROM supplier")
def names(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    n = F.col("s_suppkey") % 3
    title = F.when(n == 0, F.concat("s_name", F.lit(" - "), F.col("s_nationkey").cast("string"))).when(n == 1, F.concat(F.lit("Acme ("), F.col("s_nationkey").cast("string"), F.lit(") & Co-"), F.col("s_acctbal").cast("string"))).otherwise("- only a tail")
    return s.select(F.col("s_suppkey").alias("k"), C.slug(title).alias("slug"), C.sheet_name(F.col("s_name")).alias("sheet"))


# -- texts -----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(i AS bigint) + 1 AS text_chunk_index, CAST(length(substr(t, CAST(i AS bigint) * 1000 + 1, 1000)) AS bigint) AS char_count, md5(substr(t, CAST(i AS bigint) * 1000 + 1, 1000)) AS digest FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d, unnest(range(0, greatest(1, CAST(ceil(length(t) / 1000.0) AS bigint)))) u(i)")
def text_chunks(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return T.explode_chunks(d, "text", 1000).select("doc_id", F.col("text_chunk_index").cast("bigint").alias("text_chunk_index"), F.col("char_count").cast("bigint").alias("char_count"), F.md5("text_chunk").alias("digest"))


@query("SELECT doc_id, CAST(n AS bigint) AS line_number, length(l) AS chars FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents) WHERE trim(l, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''")
def text_lines(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return T.explode_lines(d, "text").select("doc_id", F.col("line_number").cast("bigint").alias("line_number"), F.length("line_text").cast("bigint").alias("chars"))


@query("SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 4.0) AS bigint) AS tokens, concat(CAST(doc_id AS varchar), ' | ', coalesce(lang, ''), ' | ', coalesce(source, '')) AS rendered FROM documents")
def token_estimate(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"), T.rendered(F.col("doc_id"), F.col("lang"), F.col("source")).alias("rendered"))


@query("""WITH RECURSIVE u AS (SELECT conv_id, turn, length(coalesce(text, '')) + 1 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
, walk AS (SELECT conv_id, r, n, n AS size, 1 AS chunk_no FROM u WHERE r = 1
  UNION ALL SELECT u.conv_id, u.r, u.n, CASE WHEN w.size + u.n > 400 THEN u.n ELSE w.size + u.n END, CASE WHEN w.size + u.n > 400 THEN w.chunk_no + 1 ELSE w.chunk_no END FROM walk w JOIN u ON u.conv_id = w.conv_id AND u.r = w.r + 1)
SELECT conv_id, chunk_no, count(*) AS units, CAST(sum(n) AS bigint) AS chars FROM walk GROUP BY ALL""")
def chunk_packing(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return folds.pack_units(c.select("conv_id", "turn", "text"), 400, ["conv_id"], ["turn"]).groupBy("conv_id", "chunk_no").agg(F.count("*").alias("units"), F.sum(F.length("text") + 1).alias("chars"))


@query("SELECT event_type, count(v) AS n, avg(v) AS mean FROM (SELECT event_type, CAST(props ->> '$.k' AS double) AS v FROM events) GROUP BY event_type")
def json_map_confidence(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.explode(F.map_values(F.from_json("props", "map<string,double>"))).alias("v"))
    return e.groupBy("event_type").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))


@query("SELECT source, count(*) AS usage_count, max(n_chars) AS longest FROM documents GROUP BY source")
def layout_fingerprints(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.array(F.col("source")).alias("headers"), F.lit("sig").alias("signature"), F.col("n_chars").alias("confidence"), F.col("n_chars").alias("seen_at"))
    return fingerprints(d).select(F.substring_index("fingerprint", "::", 1).alias("source"), "usage_count", F.col("confidence").alias("longest"))


@query("SELECT o_orderkey AS k, sha256('{\"k\":' || CAST(o_orderkey AS varchar) || ',\"s\":\"' || o_orderstatus || '\"}') AS cache_key FROM orders")
def content_keys(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("k"), cache_key(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))).alias("cache_key"))


# -- ledgers ---------------------------------------------------------------------------------------------------------


@query(LEDGER + """SELECT pair_id, ledger_role, row_id AS source_row_id, strftime(date, '%Y-%m') AS period, normalized_reference, CASE WHEN normalized_reference <> '' THEN concat(normalized_reference, '|', type_label, '|', CAST(CAST(round(abs(amount_org_perspective), 2) AS decimal(18,2)) AS varchar)) ELSE '' END AS match_key_primary,
concat(type_label, '|', CAST(CAST(round(abs(amount_org_perspective), 2) AS decimal(18,2)) AS varchar), '|', CAST(date AS varchar)) AS match_key_secondary FROM ledger""")
def working_ledger(spark, sf_dir):
    return ledger.working_ledger(synth.ledgers(spark, sf_dir)).select("pair_id", "ledger_role", "source_row_id", "period", "normalized_reference", "match_key_primary", "match_key_secondary")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE NULL END AS debit, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice END AS credit, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0.0 - o_totalprice END AS amount FROM orders")
def org_perspective(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    own = F.col("o_orderkey") % 4
    rows = o.select(F.col("o_orderkey").alias("k"), F.when(own < 2, "org_ledger").otherwise("party_ledger").alias("ledger_role"), F.when(own.isin(0, 3), F.col("o_totalprice")).alias("debit_source"), F.when(own.isin(1, 2), F.col("o_totalprice")).alias("credit_source"))
    return ledger.with_perspective(rows).select("k", F.col("debit_org_perspective").alias("debit"), F.col("credit_org_perspective").alias("credit"), F.col("amount_org_perspective").alias("amount"))


@query(Q.CANONICAL + "SELECT pair_id, ledger_role, row_id, kind AS record_kind, type_label, day AS date, debit AS debit_source, credit AS credit_source, confidence_score, review_reason <> '' AS review_flag, review_reason FROM canonical")
def formalized_rows(spark, sf_dir):
    return reconcile.formalize(synth.extracted_cells(spark, sf_dir)).select("pair_id", "ledger_role", "row_id", "record_kind", "type_label", "date", "debit_source", "credit_source", "confidence_score", "review_flag", "review_reason")


PAGES = "WITH r AS (SELECT o_orderkey // 40 AS g, o_orderkey + o_orderkey // 4 AS n, CAST(o_orderdate AS date) AS d FROM orders)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows numbered with gaps (every fifth number) on pages of forty."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.lit("p").alias("pair_id"), F.lit("r").alias("ledger_role"), F.lit("f").alias("source_file"), F.floor(F.col("o_orderkey") / 40).alias("page_number"), (F.col("o_orderkey") + F.floor(F.col("o_orderkey") / 4)).alias("source_row_number"), F.col("o_orderdate").cast("date").alias("date"))


@query(PAGES + """, x AS (SELECT g, n, CASE WHEN n % 3 = 0 THEN d END AS d FROM r), y AS (SELECT *, last_value(d IGNORE NULLS) OVER (PARTITION BY g ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x)
SELECT g, n, coalesce(d, before) AS date, d IS NULL AND before IS NOT NULL AS carried FROM y""")
def date_carry_forward(spark, sf_dir):
    rows = pages(spark, sf_dir).withColumn("date", F.when(F.col("source_row_number") % 3 == 0, F.col("date"))).select("*", F.lit(C.TRANSACTION).alias("record_kind"), F.lit("").alias("raw_date"), F.lit(96.0).alias("date_parse_confidence"))
    return ledger.carry_dates(rows).select(F.col("page_number").alias("g"), F.col("source_row_number").alias("n"), "date", F.col("date_carried").alias("carried"))


@query(PAGES + "SELECT a.g, a.n, CAST(b.d AS varchar) AS previous_date, CAST(c.d AS varchar) AS next_date FROM r a LEFT JOIN r b ON b.g = a.g AND b.n = a.n - 1 LEFT JOIN r c ON c.g = a.g AND c.n = a.n + 1")
def neighbour_dates(spark, sf_dir):
    rows = pages(spark, sf_dir).withColumn("normalized_date", F.col("date").cast("string"))
    return ledger.neighbour_dates(rows).select(F.col("page_number").alias("g"), F.col("source_row_number").alias("n"), "previous_date", "next_date")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS bigint) AS sample_no FROM orders QUALIFY sample_no <= 2")
def samples_per_group(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey")
    return ledger.first_samples(o, "o_custkey", "o_orderkey").withColumn("sample_no", F.col("sample_no").cast("bigint"))


@query("SELECT * FROM (" + LEDGER + "SELECT pair_id, min(date) AS first_date, max(date) AS last_date, concat(strftime(min(date), '%b''%y'), ' to ', strftime(max(date), '%b''%y')) AS period FROM ledger GROUP BY pair_id)")
def recon_period(spark, sf_dir):
    return reports.period_label(synth.ledgers(spark, sf_dir))


# -- edges and matching ----------------------------------------------------------------------------------------------


@query(SIDES + f"SELECT pair_id, o_row_id, p_row_id, amount_gap, CAST(days AS bigint) AS days, {COMPATIBLE} AS typed FROM e WHERE NOT o_missing AND NOT p_missing AND o_nref = p_nref")
def exact_ref_edges(spark, sf_dir):
    return E.exact_ref_edges(*E.sides(synth.ledgers(spark, sf_dir))).select("pair_id", "o_row_id", "p_row_id", "amount_gap", F.col("days").cast("bigint").alias("days"), "typed")


@query(SIDES + "SELECT pair_id, o_row_id, p_row_id, amount_gap, CAST(days AS bigint) AS days FROM e WHERE days IS NULL OR days <= 7")
def band_edges(spark, sf_dir):
    return E.band_edges(*E.sides(synth.ledgers(spark, sf_dir))).select("pair_id", "o_row_id", "p_row_id", "amount_gap", F.col("days").cast("bigint").alias("days"))


@query(SIDES + "SELECT pair_id, o_row_id, p_row_id FROM e WHERE (days IS NULL OR days <= 7) AND NOT o_missing AND NOT p_missing AND o_nref <> p_nref AND (contains(o_nref, p_nref) OR contains(p_nref, o_nref))")
def containment_edges(spark, sf_dir):
    return E.containment_edges(E.band_edges(*E.sides(synth.ledgers(spark, sf_dir)))).select("pair_id", "o_row_id", "p_row_id")


@query(SIDES + f"SELECT pair_id, o_row_id, p_row_id FROM e WHERE (days IS NULL OR days <= 7) AND (o_missing OR p_missing) AND {COMPATIBLE}")
def no_reference_edges(spark, sf_dir):
    return E.no_reference_edges(E.band_edges(*E.sides(synth.ledgers(spark, sf_dir)))).select("pair_id", "o_row_id", "p_row_id")


@query(SIDES.replace("WITH base", "WITH RECURSIVE base", 1) + """, near AS (SELECT * FROM e WHERE (days IS NULL OR days <= 7) AND NOT o_missing AND NOT p_missing AND NOT contains(o_nref, p_nref) AND NOT contains(p_nref, o_nref)), near_pairs AS (SELECT DISTINCT lower(o_nref) AS a, lower(p_nref) AS b FROM near)""" + Q.sequence_sql("near_pairs", "alike") + "SELECT pair_id, o_row_id, p_row_id, CAST(ratio AS double) AS score FROM near JOIN alike ON a = lower(o_nref) AND b = lower(p_nref) WHERE ratio >= 0.85")
def fuzzy_edges(spark, sf_dir):
    return E.fuzzy_edges(E.band_edges(*E.sides(synth.ledgers(spark, sf_dir)))).select("pair_id", "o_row_id", "p_row_id", "score")


@query(SIDES + f"""SELECT pair_id, o_row_id, p_row_id FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, o_row_id ORDER BY CASE WHEN o_missing OR p_missing THEN 1 ELSE 4 END DESC, amount_gap, coalesce(days, 9999), p_n, p_row_id DESC) AS r
FROM e WHERE (days IS NULL OR days <= 7) AND (((o_missing OR p_missing) AND {COMPATIBLE}) OR (NOT o_missing AND NOT p_missing AND o_nref <> p_nref AND (contains(o_nref, p_nref) OR contains(p_nref, o_nref))))) WHERE r = 1""")
def best_candidate(spark, sf_dir):
    band = E.band_edges(*E.sides(synth.ledgers(spark, sf_dir)))
    return E.best_candidates(E.containment_edges(band).unionByName(E.no_reference_edges(band))).select("pair_id", "o_row_id", "p_row_id")


@query(SIDES + f""", x AS (SELECT *, {COMPATIBLE} AS typed FROM e WHERE NOT o_missing AND NOT p_missing AND o_nref = p_nref)
, g AS (SELECT pair_id, o_row_id, bool_or(typed) AS any_typed FROM x GROUP BY ALL), pool AS (SELECT x.*, any_typed, count(*) OVER (PARTITION BY x.pair_id, x.o_row_id) AS n FROM x JOIN g USING (pair_id, o_row_id) WHERE typed = any_typed)
SELECT pair_id, o_row_id, p_row_id, CASE WHEN any_typed THEN 'stage1_exact_ref_type_amount' ELSE 'stage2_exact_ref_amount' END AS match_rule FROM pool WHERE n = 1""")
def stage12_match(spark, sf_dir):
    """References of the derived ledgers have one org row each, so no row waits for another."""
    found = resolve.exact_stage(*E.sides(synth.ledgers(spark, sf_dir))).where("not many")
    return found.select("pair_id", "o_row_id", "p_row_id", F.when(F.col("typed"), "stage1_exact_ref_type_amount").otherwise("stage2_exact_ref_amount").alias("match_rule"))


@query(Q.MATCHES + "SELECT * FROM m")
def master_match(spark, sf_dir):
    return resolve.master_match_table(synth.ledgers(spark, sf_dir))


@query(Q.STATUS_TOTALS + "SELECT *, round(org_amount - party_amount, 2) AS difference FROM st")
def match_status_summary(spark, sf_dir):
    return reports.status_totals(resolve.master_match_table(synth.ledgers(spark, sf_dir)))


@query(Q.MATCHES + """, f AS (SELECT pair_id, count(*) AS records, count(*) FILTER (WHERE match_status = 'matched_strong') AS strong FROM m GROUP BY pair_id)
SELECT pair_id, records, strong, 'succeeded' AS status, '' AS error FROM f UNION ALL SELECT 'pair_without_party', 0, 0, 'failed', 'no party_ledger rows'""")
def run_manifests(spark, sf_dir):
    """A pair of which one ledger is missing fails alone."""
    rows = synth.ledgers(spark, sf_dir)
    lone = rows.where("ledger_role = 'org_ledger'").withColumn("pair_id", F.lit("pair_without_party"))
    rows = durable(rows.unionByName(lone))
    bad = bundles.pair_failures(rows)
    return run_manifest(resolve.master_match_table(rows.join(bad.select("pair_id"), "pair_id", "left_anti")), bad)


@query(Q.MATCHES + "SELECT pair_id, count(*) FILTER (WHERE match_status = 'matched_strong') AS strong, count(*) FILTER (WHERE review_required) AS review, count(*) FILTER (WHERE match_status = 'unmatched_org') AS unmatched_org, count(*) FILTER (WHERE match_status = 'unmatched_party') AS unmatched_party FROM m GROUP BY pair_id")
def match_statistics(spark, sf_dir):
    return resolve.match_stats(resolve.master_match_table(synth.ledgers(spark, sf_dir)))


#: Orders of a customer all want their customer's parties: every amount is the same, and each org reference is inside all party references.
CONTESTED = "SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders"


@query("WITH x AS (" + CONTESTED + ") SELECT concat('c', c) AS pair_id, concat('o', lpad(CAST(k AS varchar), 9, '0')) AS o_row_id, concat('p', lpad(CAST(k AS varchar), 9, '0')) AS p_row_id FROM x")
def contested_containment(spark, sf_dir):
    """The n-th org row of a customer gets the n-th party: each prefers the lowest source row, and the lower rows are served first."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey")
    x = spark.sql(CONTESTED.replace("FROM orders", "FROM {orders}"), orders=orders)
    name = lambda p: F.concat(F.lit(p), F.lpad(F.col("k").cast("string"), 9, "0"))
    org = x.select(F.concat(F.lit("c"), F.col("c").cast("string")).alias("pair_id"), name("o").alias("o_row_id"), F.lit(100.0).alias("o_net_org"))
    party = x.select(F.concat(F.lit("c"), F.col("c").cast("string")).alias("pair_id"), name("p").alias("p_row_id"), F.col("k").alias("p_source_row_number"))
    edges = org.join(party, "pair_id").withColumns({"tier": F.lit(4), "score": F.lit(0.8), "amount_gap": F.lit(0.0), "days": F.lit(0)})
    return resolve.containment_stage(edges)


# -- reports ---------------------------------------------------------------------------------------------------------

TOTALS = LEDGER + f""", t AS (SELECT pair_id, type_label, coalesce({MONEY.format("CASE WHEN ledger_role = 'org_ledger' THEN amount_org_perspective END")}, 0.0) AS org_amount, coalesce({MONEY.format("CASE WHEN ledger_role = 'party_ledger' THEN amount_org_perspective END")}, 0.0) AS party_amount, count(*) FILTER (WHERE review_flag) AS flagged FROM ledger GROUP BY ALL)
, names(serial, type_label) AS (VALUES {", ".join(f"({i + 1}, '{n}')" for i, n in enumerate(["OpeningBalance", *[x for x in labels.TYPE_LABELS if x not in ("OpeningBalance", "ClosingBalance")], "ClosingBalance"]))})
, f AS (SELECT pair_id, serial, n.type_label, coalesce(org_amount, 0.0) AS org_amount, coalesce(party_amount, 0.0) AS party_amount, coalesce(flagged, 0) AS flagged FROM (SELECT DISTINCT pair_id FROM ledger) CROSS JOIN names n LEFT JOIN t USING (pair_id, type_label))
"""


@query(TOTALS + "SELECT pair_id, serial, type_label, org_amount, party_amount, round(org_amount - party_amount, 2) AS difference, CASE WHEN flagged > 0 THEN 'Review required' ELSE 'Formula-linked' END AS review_status FROM f")
def label_summary(spark, sf_dir):
    return reports.label_summary(synth.ledgers(spark, sf_dir))


@query(TOTALS + f"SELECT pair_id, {MONEY.format('org_amount')} AS balance_org, {MONEY.format('party_amount')} AS balance_party, round({MONEY.format('org_amount')} - {MONEY.format('party_amount')}, 2) AS net_difference FROM f WHERE type_label <> 'ClosingBalance' GROUP BY pair_id")
def balance_check(spark, sf_dir):
    return reports.balances(synth.ledgers(spark, sf_dir)).select("pair_id", "balance_org", "balance_party", "net_difference")


@query(Q.MATCHES + ", " + TOTALS.split(", t AS (", 1)[1].join([" t AS (", ""]).strip() + f""", am AS (SELECT pair_id, type_label, coalesce({MONEY.format("CASE WHEN match_status = 'matched_strong' THEN org_amount END")}, 0.0) AS strong_amount, coalesce({MONEY.format("CASE WHEN match_status = 'candidate_review' THEN org_amount END")}, 0.0) AS candidate_amount,
  coalesce({MONEY.format("CASE WHEN match_status = 'unmatched_org' THEN org_amount END")}, 0.0) AS unmatched_amount, count(*) FILTER (WHERE review_required) AS review_count FROM m GROUP BY ALL)
SELECT pair_id, serial, f.type_label, org_amount, party_amount, round(org_amount - party_amount, 2) AS difference, coalesce(strong_amount, 0.0) AS strong_amount, coalesce(candidate_amount, 0.0) AS candidate_amount, coalesce(unmatched_amount, 0.0) AS unmatched_amount, coalesce(review_count, 0) AS review_count FROM f LEFT JOIN am USING (pair_id, type_label)""")
def annexure_metrics(spark, sf_dir):
    rows = synth.ledgers(spark, sf_dir)
    return reports.annexure_metrics(rows, resolve.master_match_table(rows))


@query(LEDGER + "SELECT pair_id, lower(raw_type) AS normalized_label, raw_type AS raw_label, count(*) AS affected_row_count, count(*) FILTER (WHERE ledger_role = 'org_ledger') AS org_row_count, count(*) FILTER (WHERE ledger_role = 'party_ledger') AS party_row_count FROM ledger WHERE type_label = 'Unknown' GROUP BY ALL")
def unknown_groups(spark, sf_dir):
    return reports.unknown_groups(synth.ledgers(spark, sf_dir)).select("pair_id", "normalized_label", "raw_label", "affected_row_count", "org_row_count", "party_row_count")


@query(LEDGER + "SELECT pair_id, row_id AS source_row_id, CASE WHEN review_flag THEN 'MEDIUM' ELSE 'LOW' END AS priority, CASE WHEN review_flag THEN review_reason ELSE 'Low extraction confidence; otherwise traceable.' END AS reason FROM ledger WHERE review_flag OR confidence_score < 80")
def review_queue_formal(spark, sf_dir):
    rows = synth.ledgers(spark, sf_dir)
    none = spark.createDataFrame([], "pair_id string, match_group_id string, match_status string, type_label string, org_row_id string, party_row_id string, org_date string, party_date string, org_reference string, party_reference string, org_normalized_reference string, party_normalized_reference string, org_amount double, party_amount double, amount_difference double, org_particulars string, party_particulars string, review_required boolean, review_reason string")
    return reports.review_queue(rows, none).select("pair_id", "source_row_id", "priority", "reason")


@query(Q.REVIEW + "SELECT *, CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS priority_rank, '' AS reviewer_comment, '' AS manual_decision, '' AS reviewed_by, '' AS reviewed_date FROM q")
def review_queue(spark, sf_dir):
    rows = synth.ledgers(spark, sf_dir)
    return reports.review_queue(rows, resolve.master_match_table(rows))


@query(LEDGER + "SELECT pair_id, ledger_role, normalized_reference AS nref, count(*) AS rows FROM ledger WHERE normalized_reference <> '' GROUP BY ALL HAVING count(*) > 1")
def duplicate_refs(spark, sf_dir):
    return quality.duplicates(synth.ledgers(spark, sf_dir))


@query(LEDGER + "SELECT pair_id, ledger_role, CAST(sum(n - 1) AS bigint) AS suspicious_rows FROM (SELECT pair_id, ledger_role, count(*) AS n FROM ledger WHERE normalized_reference <> '' GROUP BY pair_id, ledger_role, normalized_date, normalized_reference, debit_source, credit_source HAVING count(*) > 1) GROUP BY ALL")
def duplicate_suspicion(spark, sf_dir):
    return quality.duplicate_suspicion(synth.ledgers(spark, sf_dir))


@query(Q.QUALITY_REPORT)
def quality_report(spark, sf_dir):
    return quality.formal_report(durable(reconcile.formalize(synth.extracted_cells(spark, sf_dir))))  # read three times


@query(Q.MATCH_REPORT)
def match_report(spark, sf_dir):
    rows = synth.ledgers(spark, sf_dir)
    return quality.match_report(rows, resolve.master_match_table(rows))


@query(LEDGER + f"SELECT pair_id, type_label, {MONEY.format('amount_org_perspective')} AS net, count(*) AS rows FROM ledger GROUP BY ROLLUP (pair_id, type_label)")
def rollup_totals(spark, sf_dir):
    return reports.rollup_totals(synth.ledgers(spark, sf_dir)).drop("level")


# -- structure, layout -----------------------------------------------------------------------------------------------


#: Two sides that share some names: dates of orders, and ship dates of their lines.
def days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, li = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return o.select(F.col("o_orderdate").cast("date").cast("string").alias("sheet_name")), li.select(F.col("l_shipdate").cast("date").cast("string").alias("sheet_name"))


DAYS = "WITH a AS (SELECT DISTINCT CAST(CAST(o_orderdate AS date) AS varchar) AS n FROM orders), b AS (SELECT DISTINCT CAST(CAST(l_shipdate AS date) AS varchar) AS n FROM lineitem) "


@query(DAYS + "SELECT coalesce(a.n, b.n) AS sheet_name, a.n IS NOT NULL AS in_left, b.n IS NOT NULL AS in_right FROM a FULL JOIN b ON a.n = b.n")
def sheet_presence(spark, sf_dir):
    return structure.presence(*days(spark, sf_dir))


@query(DAYS + "SELECT n AS sheet_name FROM b WHERE n NOT IN (SELECT n FROM a)")
def set_difference(spark, sf_dir):
    a, b = days(spark, sf_dir)
    return structure.missing_names(b, a)


@query(DAYS + "SELECT n AS sheet_name FROM a WHERE n IN (SELECT n FROM b)")
def shared_names(spark, sf_dir):
    return structure.shared_names(*days(spark, sf_dir))


@query("""WITH c AS (SELECT l_orderkey % 50 AS sheet, l_orderkey // 50 AS r, l_linenumber AS col FROM lineitem), f AS (SELECT sheet, r, count(*) AS n FROM c GROUP BY ALL)
SELECT concat('s', CAST(sheet AS varchar)) AS sheet_name, count(DISTINCT r) AS non_empty_rows, (SELECT count(DISTINCT col) FROM c x WHERE x.sheet = f.sheet) AS non_empty_columns, (SELECT g.r FROM f g WHERE g.sheet = f.sheet AND g.r <= 20 ORDER BY g.n DESC, g.r LIMIT 1) AS header_row FROM f GROUP BY sheet""")
def sheet_profile(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cells = li.select(F.concat(F.lit("s"), (F.col("l_orderkey") % 50).cast("string")).alias("sheet_name"), F.floor(F.col("l_orderkey") / 50).alias("row"), F.col("l_linenumber").alias("col"), F.lit("x").alias("value"))
    return structure.profile_sheets(cells).select("sheet_name", "non_empty_rows", "non_empty_columns", "header_row")


@query("WITH g AS (SELECT o_custkey, o_orderstatus, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY ALL) SELECT o_custkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first) AS r FROM g) WHERE r = 1")
def dominant_value(spark, sf_dir):
    return structure.dominant_value(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", "o_orderstatus", "o_orderkey")


@query("""WITH RECURSIVE l AS (SELECT n_regionkey, n_name AS sheet, lower('n_name ' || n_name) AS a FROM nation), r AS (SELECT n_regionkey, c_name AS sheet, c_custkey AS pos, lower(c_mktsegment || ' ' || n_name || ' Ledger') AS b FROM customer JOIN nation ON c_nationkey = n_nationkey)
, both_sides AS (SELECT l.n_regionkey, l.sheet AS sheet_name, r.sheet AS best_sheet, pos, a, b FROM l JOIN r USING (n_regionkey)), distinct_sides AS (SELECT DISTINCT a, b FROM both_sides)""" + Q.token_set_sql("distinct_sides", "tokens") + """
SELECT CAST(n_regionkey AS varchar) AS pair_id, sheet_name, best_sheet, CAST(round(score, 1) AS double) AS header_similarity_score, 2 AS left_header_count, 3 AS right_header_count FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey, sheet_name ORDER BY score DESC, pos) AS n FROM both_sides JOIN tokens USING (a, b)) x WHERE n = 1""")
def header_similarity(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    sheet = lambda name, pos, *heads: (F.col("n_regionkey").cast("string").alias("pair_id"), name.alias("sheet_name"), pos.alias("pos"), F.array(*heads).alias("headers"))
    left = n.select(*sheet(F.col("n_name"), F.col("n_nationkey"), F.lit("n_name"), F.col("n_name"), F.lit("")))
    right = c.join(n, n["n_nationkey"] == c["c_nationkey"]).select(*sheet(F.col("c_name"), F.col("c_custkey"), F.col("c_mktsegment"), F.col("n_name"), F.lit("Ledger")))
    return structure.header_similarity(left, right)


@query("SELECT lang AS pair_id, source AS ledger_role, count(*) AS text_chunks, CAST(sum(n_chars) AS bigint) AS characters FROM documents GROUP BY ALL")
def extraction_summaries(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("lang").alias("pair_id"), F.col("source").alias("ledger_role"), F.lit("f").alias("source_file_name"), F.col("doc_id").alias("page_number"), F.col("n_chars").alias("char_count"))
    none = spark.createDataFrame([], "pair_id string, ledger_role string, source_file_name string, page_number long, table_index int")
    return extraction_summary(d, none).select("pair_id", "ledger_role", "text_chunks", "characters")


@query("SELECT pair_id, ledger_role, amount FROM (SELECT DISTINCT CAST(o_custkey % 8 AS varchar) AS pair_id, o_orderstatus AS ledger_role, CAST(o_orderkey % 50 AS double) AS amount FROM orders)")
def balances_once(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select((F.col("o_custkey") % 8).cast("string").alias("pair_id"), F.col("o_orderstatus").alias("ledger_role"), F.lit("opening").alias("balance_kind"), F.lit(1).alias("source_page"), F.lit("f").alias("source_file_name"), (F.col("o_orderkey") % 50).cast("double").alias("amount"), F.col("o_orderkey").alias("chunk_no"))
    return distinct_balances(rows).select("pair_id", "ledger_role", "amount")


def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes of files of four pages of forty rows, a row for each order; only the first page of a file has a header."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at, k = F.floor(F.col("o_orderkey") / 40).cast("int"), F.col("o_orderkey")
    page = [F.lit("p").alias("pair_id"), F.when(F.floor(at / 4) % 2 == 0, "org_ledger").otherwise("party_ledger").alias("ledger_role"), F.concat(F.lit("f"), F.floor(at / 4).cast("string")).alias("source_file"), (at % 4 + 1).alias("page_number")]
    day, money = F.date_format(F.col("o_orderdate").cast("date"), "dd-MM-yyyy"), F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string")
    word = lambda x0, y, w: F.struct(F.lit(float(x0)).alias("x0"), y.cast("double").alias("y0"), F.lit(float(x0 + 50)).alias("x1"), w.alias("word_text"))
    y = (k % 40 + 2) * 12.0
    body = o.select(*page, F.explode(F.array(word(0, y, day), word(100, y + 1, F.lit("Sale")), word(200, y, F.concat(F.lit("order-"), k.cast("string"))), word(400, y - 1, F.when(k % 2 == 0, money).otherwise("")), word(500, y, F.when(k % 2 == 1, money).otherwise("")))).alias("w"))
    head = o.where(at % 4 == 0).select(*page).distinct().select("*", F.explode(F.array(*[word(x, F.lit(5.0), F.lit(t)) for x, t in ((0, "Date"), (100, "Type"), (200, "Particulars"), (400, "Debit"), (500, "Credit"))])).alias("w"))
    return body.unionByName(head).select("pair_id", "ledger_role", "source_file", "page_number", "w.*")


#: The rows that come out: those of files whose first page is there.
PAGE_ROWS = """WITH o AS (SELECT o_orderkey AS k, o_orderkey // 40 AS pg, CAST(o_orderdate AS date) AS d, CAST(CAST(round(o_totalprice, 2) AS decimal(18,2)) AS varchar) AS v FROM orders), f AS (SELECT DISTINCT pg // 4 AS f FROM o WHERE pg % 4 = 0)
, r AS (SELECT o.*, pg // 4 AS f, concat('f', pg // 4) AS source_file, CAST(pg % 4 + 1 AS int) AS page_number, CAST(dense_rank() OVER (PARTITION BY pg ORDER BY k % 40) + CASE WHEN pg % 4 = 0 THEN 1 ELSE 0 END AS int) AS visual_row FROM o WHERE pg // 4 IN (SELECT f FROM f))
"""


@query(PAGE_ROWS + "SELECT source_file, page_number, visual_row, strftime(d, '%d-%m-%Y') AS raw_date, 'Sale' AS raw_type, concat('order-', k) AS particulars, CASE WHEN k % 2 = 0 THEN v ELSE '' END AS debit_raw_source, CASE WHEN k % 2 = 1 THEN v ELSE '' END AS credit_raw_source, concat(strftime(d, '%d-%m-%Y'), ' Sale order-', k, ' ', v) AS raw_text FROM r")
def page_word_layout(spark, sf_dir):
    """Words through clustering, bands (a page without a header takes those above it) and assignment."""
    rows = folds.visual_rows(page_words(spark, sf_dir), extraction.PAGE)
    return layout.coordinate_strategy(rows, extraction.PAGE, extraction.DOCUMENT).select("source_file", "page_number", "visual_row", "raw_date", "raw_type", "particulars", "debit_raw_source", "credit_raw_source", "raw_text")


def extracted(spark: SparkSession, sf_dir: str, kept: bool = True) -> dict[str, DataFrame]:
    words = page_words(spark, sf_dir)
    tables = words.where("false").select(*extraction.PAGE, F.lit(0).alias("table_index"), F.array(F.array(F.lit(""))).alias("cells"))
    lines = words.groupBy(*extraction.PAGE, F.round("y0", -1).alias("y")).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_text"))), lambda w: w["word_text"])).alias("line_text"))
    lines = durable(lines.withColumn("line_number", F.col("y").cast("int")).drop("y"))
    return extraction.extract(words, tables, lines, kept=kept)


@query(PAGE_ROWS + "SELECT source_file, page_number, CAST(row_number() OVER (PARTITION BY f ORDER BY page_number, visual_row) AS int) AS source_row_number, 'coordinate' AS extraction_method, 'Transaction' AS record_kind, d AS date, CASE WHEN k % 2 = 0 THEN CAST(v AS double) END AS debit_source, CASE WHEN k % 2 = 1 THEN CAST(v AS double) END AS credit_source FROM r")
def extracted_rows(spark, sf_dir):
    """All strategies on all pages, the best of each page, numbered through each file."""
    return extracted(spark, sf_dir)["rows"].select("source_file", "page_number", "source_row_number", "extraction_method", "record_kind", "date", "debit_source", "credit_source")


@query(PAGE_ROWS + """SELECT source_file, page_number, 'coordinate' AS extraction_method, 'ok' AS status, count(*) AS rows_emitted FROM r GROUP BY ALL""")
def extraction_audit(spark, sf_dir):
    return extracted(spark, sf_dir, kept=False)["audit"].select("source_file", "page_number", "extraction_method", "status", "rows_emitted")


@query(PAGE_ROWS + "SELECT source_file, count(DISTINCT page_number) AS page_count, count(*) AS row_count FROM r GROUP BY source_file")
def layout_statistics(spark, sf_dir):
    return extracted(spark, sf_dir, kept=False)["layout_stats"].select("source_file", "page_count", "row_count")


# -- bundles -------------------------------------------------------------------------------------------------------------


@query(Q.CANONICAL + """, w AS (SELECT pair_id, count(DISTINCT ledger_role) AS n, string_agg(DISTINCT ledger_role || ':orders.pdf', '; ' ORDER BY ledger_role || ':orders.pdf') AS files, round(avg(confidence_score), 1) AS c FROM canonical GROUP BY pair_id)
SELECT pair_id, 'workbook' AS scope, 'source_pdfs_discovered' AS "check", 'PASS' AS status, CAST(n AS double) AS count, files AS details FROM w
UNION ALL SELECT pair_id, 'workbook', 'ledger_confidence', CASE WHEN c < 80 THEN 'REVIEW' ELSE 'PASS' END, CAST(floor(c) AS double), 'Average confidence across all formalized rows (%).' FROM w
UNION ALL SELECT pair_id, 'workbook', x.c, 'INFO', 0.0, x.d FROM w, (VALUES ('ai_usage_count', 'AI layout/repair calls.'), ('ai_cache_hit_count', 'AI cache hits.'), ('ai_cache_miss_count', 'AI cache misses.'), ('ai_repair_applied_count', 'Rows with accepted AI date repairs.'), ('ai_repair_rejected_count', 'Failed-row repair proposals rejected.')) x(c, d)
UNION ALL SELECT pair_id, 'workbook', 'no_reconciliation_performed', 'PASS', 0.0, 'Formalization only: no matching, annexures, or final balances.' FROM w""")
def workbook_checks(spark, sf_dir):
    return quality.workbook_report(reconcile.formalize(synth.extracted_cells(spark, sf_dir)))


@query(Q.CANONICAL + "SELECT pair_id, ledger_role, CAST(page AS int) AS page_number, count(*) AS rows, count(*) FILTER (WHERE kind = 'Transaction') AS transactions, count(*) FILTER (WHERE kind NOT IN ('Transaction', 'Unknown')) AS special, count(*) FILTER (WHERE day IS NULL) AS undated FROM canonical GROUP BY ALL")
def page_counters(spark, sf_dir):
    rows = reconcile.formalize(synth.extracted_cells(spark, sf_dir))
    return layout.page_analysis(rows, ["pair_id", "ledger_role", "page_number"]).select("pair_id", "ledger_role", "page_number", "rows", "transactions", "special", "undated")


SUMMARY_LINES = Q.STATUS_TOTALS + ", " + TOTALS.split(", t AS (", 1)[1].join([" t AS (", ""]).strip() + f"""
, bal AS (SELECT pair_id, {MONEY.format("CASE WHEN type_label <> 'ClosingBalance' THEN org_amount END")} AS o, {MONEY.format("CASE WHEN type_label <> 'ClosingBalance' THEN party_amount END")} AS p FROM f GROUP BY pair_id)
, tl(serial, particulars, kind, line) AS (VALUES (13, 'Matched Amount', 'matched', 'matched_strong'), (14, 'Candidate Review Amount', 'candidate_review', 'candidate_review'), (15, 'Unmatched Org Amount', 'unmatched_org', 'unmatched_org'), (16, 'Unmatched Party Amount', 'unmatched_party', 'unmatched_party'), (17, 'Review Pending Amount', 'review_pending', 'review_pending'))
"""


@query(SUMMARY_LINES + """SELECT pair_id, serial, CASE type_label WHEN 'OpeningBalance' THEN 'Opening Balance' WHEN 'ClosingBalance' THEN 'Closing Balance' ELSE type_label END AS particulars, org_amount, party_amount, round(org_amount - party_amount, 2) AS difference, CAST(NULL AS varchar) AS status FROM f
UNION ALL SELECT pair_id, 11, 'Balance as per Org ledger', o, NULL, NULL, NULL FROM bal UNION ALL SELECT pair_id, 12, 'Balance as per Party ledger', NULL, p, NULL, NULL FROM bal
UNION ALL SELECT b.pair_id, tl.serial, tl.particulars, coalesce(st.org_amount, 0), coalesce(st.party_amount, 0), round(coalesce(st.org_amount, 0) - coalesce(st.party_amount, 0), 2), NULL FROM bal b CROSS JOIN tl LEFT JOIN st ON st.pair_id = b.pair_id AND st.line = tl.line
UNION ALL SELECT pair_id, 18, 'Net Difference', NULL, NULL, round(o - p, 2), NULL FROM bal UNION ALL SELECT pair_id, 19, 'Closing Balance Difference', NULL, NULL, 0.0, NULL FROM bal
UNION ALL SELECT pair_id, 20, 'Validation Status', NULL, NULL, NULL, 'PASS' FROM bal UNION ALL SELECT pair_id, 21, 'Formula Audit Status', NULL, NULL, NULL, 'PASS' FROM bal""")
def summary_lines(spark, sf_dir):
    rows = synth.ledgers(spark, sf_dir)
    matches = durable(resolve.master_match_table(rows))
    out = reports.summary_layout(rows, matches, quality.match_report(rows, matches), quality.evidence_violations(matches))
    return out.select("pair_id", "serial", "particulars", "org_amount", "party_amount", "difference", "status")


@query(Q.REVIEW + f""", ex AS (SELECT pair_id, {", ".join(f"count(*) FILTER (WHERE match_status = '{x}') AS {x}_count" for x in reports.STATUSES)} FROM m GROUP BY pair_id), qn AS (SELECT pair_id, count(*) AS review_queue_count FROM q GROUP BY pair_id)
, pr AS (SELECT pair_id, concat(strftime(min(date), '%b''%y'), ' to ', strftime(max(date), '%b''%y')) AS period FROM ledger GROUP BY pair_id)
SELECT pair_id, ex.* EXCLUDE (pair_id), review_queue_count, 'YES' AS human_review_required, 'PASS' AS validation_status, period FROM ex JOIN qn USING (pair_id) JOIN pr USING (pair_id)""")
def executive_summary(spark, sf_dir):
    rows = synth.ledgers(spark, sf_dir)
    matches = durable(resolve.master_match_table(rows))
    queue = reports.review_queue(rows, matches)
    out = reports.executive_snapshot(rows, matches, quality.match_report(rows, matches), queue)
    return out.select("pair_id", *[f"{x}_count" for x in reports.STATUSES], "review_queue_count", "human_review_required", "validation_status", "period")


@query(TOTALS + ", l AS (SELECT pair_id, serial, f.type_label, row_id FROM f LEFT JOIN ledger USING (pair_id, type_label)) SELECT pair_id, serial, type_label, row_id AS source_row_id FROM l WHERE true".replace("LEFT JOIN ledger USING (pair_id, type_label)", "LEFT JOIN (SELECT * FROM ledger WHERE ledger_role = 'org_ledger') g USING (pair_id, type_label)"))
def annexure_rows(spark, sf_dir):
    """The organisation's drill-down: labels without rows are there with nulls."""
    rows = synth.ledgers(spark, sf_dir)
    none = spark.createDataFrame([], "pair_id string, type_label string")
    return reports.annexure_sections(rows, none)["org"].select("pair_id", "serial", "type_label", "source_row_id")


@query("SELECT concat('w', o_custkey % 7) AS pair_id, o_orderpriority AS sheet_name, CASE WHEN min(o_orderkey) FILTER (WHERE o_orderstatus = 'F') IS NULL THEN NULL ELSE 'x' END AS known FROM orders GROUP BY ALL".replace("SELECT concat", "WITH g AS (SELECT concat", 1) + """), p AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY sheet_name) AS n, count(*) OVER (PARTITION BY pair_id) AS total FROM g)
SELECT pair_id, sheet_name, CASE WHEN n = 1 THEN 'org_ledger' ELSE 'party_ledger' END AS ledger_role, total = 2 AS is_pair FROM p""")
def ledger_sheets(spark, sf_dir):
    """Roles by the order of sheets, where no row says one."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select(F.concat(F.lit("w"), (F.col("o_custkey") % 7).cast("string")).alias("pair_id"), F.col("o_orderpriority").alias("sheet_name"), F.col("o_orderpriority").alias("sheet_pos"), F.lit(1).alias("sheet_row"), F.lit("").alias("ledger_role"))
    return ledger_pair(rows)


@query("WITH x AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN '' ELSE concat(role, ' ', turn) END AS name FROM conversations) SELECT CAST(conv_id AS varchar) AS pair_id, arg_min(name, turn) FILTER (WHERE name <> '') AS detected_name, list_sort(list_distinct(list(role))) AS warnings FROM x GROUP BY conv_id".replace("list_sort(list_distinct(list(role)))", "array_to_string(list_sort(list_distinct(list(role))), ',')"))
def merged_chunks(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = c.select(F.col("conv_id").cast("string").alias("pair_id"), F.col("turn").alias("chunk_no"), F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat("role", F.lit(" "), F.col("turn").cast("string"))).alias("detected_name"), F.array("role").alias("warnings"))
    return merged_results(rows).withColumn("warnings", F.array_join("warnings", ","))


@query("WITH x AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT CAST(o_custkey AS varchar) AS pair_id, coalesce(CAST(min(CASE WHEN n <= 30 AND o_orderkey % 4 = 0 THEN o_orderkey END) AS varchar), 'none') AS detected_name FROM x GROUP BY o_custkey")
def first_names(spark, sf_dir):
    from pyspark.sql import Window

    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select(F.col("o_custkey").cast("string").alias("pair_id"), F.lit("org_ledger").alias("ledger_role"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("sheet_row"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey").cast("string")).otherwise(" ").alias("detected_ledger_name"))
    return detected_name(rows, "none").select("pair_id", "detected_name")


@query("SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'match' WHEN 1 THEN 'review' WHEN 2 THEN 'review' WHEN 3 THEN 'fail' END AS look, o_orderkey % 6 NOT IN (0, 1, 2) AS coloured FROM orders")
def row_looks(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (k % n + 1).cast("int"))
    status = pick((" Matched_Strong", "candidate_review", "unmatched_org", "unmatched_party", "other"), 5)
    return o.select(k.alias("k"), C.row_class(status, k % 5 == 2).alias("look"), C.looks_like_colour(pick(("", "FFFFFF", "00000000", "FF0000", "AA11BB22", "123456"), 6)).alias("coloured"))
