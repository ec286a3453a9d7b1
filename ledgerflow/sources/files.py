"""Readers and writers. Decoders for PDF and workbook files are not part of the environment: a decoder is a function
(content, path) -> rows that the caller plugs in; everything else is Spark's own readers and writers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators.ledger import ORG, PARTY


def discover(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """Files below <root>/<pair>/input/<role>/: path, pair_id, ledger_role, size, sha256, sorted by path. A pair without one of the roles is an error row in missing_roles()."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    part = lambda i: F.regexp_extract("path", r"([^/]+)/input/([^/]+)/[^/]+$", i)
    return f.select("path", part(1).alias("pair_id"), part(2).alias("ledger_role"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.substring_index("path", "/", -1).alias("source_file_name"), "modificationTime").where("pair_id <> ''").orderBy("path")


def missing_roles(files: DataFrame) -> DataFrame:
    own = files.groupBy("pair_id").agg(F.collect_set("ledger_role").alias("roles"))
    return own.select("pair_id", F.explode(F.array_except(F.array(F.lit(ORG), F.lit(PARTY)), "roles")).alias("missing_role"))


def decode(files: DataFrame, decoder: Callable[[bytes, str], Iterable[dict]], schema: str) -> DataFrame:
    """Rows of every file (columns path, content) by the plugged decoder; a file that fails gives one row with `error` and the job goes on. schema: the decoder's columns."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [{"path": path, "error": None, **r} for r in decoder(content, path)]
                except Exception as e:  # any fault of one file is that file's audit row
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            if rows:
                yield pd.DataFrame(rows, columns=names, dtype=object)

    names = ["path", "error", *[p.split()[0] for p in schema.split(",")]]
    return files.select("path", "content").mapInPandas(run, f"path string, error string, {schema}")


def audit_rows(decoded: DataFrame) -> DataFrame:
    return decoded.groupBy("path").agg(F.when(F.max("error").isNull(), "OK").otherwise("ERROR").alias("status"), F.max("error").alias("message"), F.count_if(F.col("error").isNull()).alias("rows"))


def extraction_summary(page_text: DataFrame, tables: DataFrame) -> DataFrame:
    """Pages with text, tables, chunks and characters of each pair and role."""
    key = ["pair_id", "ledger_role"]
    p = page_text.groupBy(*key).agg(F.countDistinct(F.when(F.col("char_count") > 0, F.struct("source_file_name", "page_number"))).alias("pages_with_text"), F.count("*").alias("text_chunks"), F.sum("char_count").alias("characters"))
    t = tables.groupBy(*key).agg(F.countDistinct("source_file_name", "page_number", "table_index").alias("tables"), F.count("*").alias("table_rows"))
    return p.join(t, key, "full_outer").na.fill(0)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet saved as CSV: the first row names the columns; columns without a name are left out; short rows are padded."""
    df = spark.read.option("header", "true").option("mode", "PERMISSIVE").csv(path)
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if c.strip() and c != f"_c{i}"])  # _c<position> stands for a blank header


def ledger_pair(rows: DataFrame) -> DataFrame:
    """Ledgers of a workbook's sheets: role by the first known role in a sheet's first 20 rows, else by sheet order; exactly two a pair."""
    first = rows.where((F.col("sheet_row") <= 20) & F.col("ledger_role").isin(ORG, PARTY)).groupBy("pair_id", "sheet_name").agg(F.min_by("ledger_role", "sheet_row").alias("known"))
    sheets = rows.groupBy("pair_id", "sheet_name").agg(F.min("sheet_pos").alias("pos")).join(first, ["pair_id", "sheet_name"], "left")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("pair_id").orderBy("pos"))
    total = F.count("*").over(Window.partitionBy("pair_id"))
    role = F.coalesce("known", F.when(n == 1, ORG).otherwise(PARTY))
    return sheets.withColumns({"ledger_role": role, "n_sheets": total}).withColumn("is_pair", F.col("n_sheets") == 2).select("pair_id", "sheet_name", "ledger_role", "is_pair")


def union_context(sheets: dict[str, DataFrame], allowed: Iterable[str]) -> DataFrame | None:
    """Sheets of the allow-list as one frame with sheet_name."""
    out = None
    for name in allowed:
        if name in sheets:
            own = sheets[name].withColumn("sheet_name", F.lit(name))
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def write_bundle(bundle: dict[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A named set of frames, one folder a sheet."""
    for name, df in bundle.items():
        w = df.write.mode(mode).format(fmt)
        (w.option("header", "true") if fmt == "csv" else w).save(f"{folder}/{name}")


def read_bundle(spark: SparkSession, folder: str, names: Iterable[str], fmt: str = "parquet") -> dict[str, DataFrame]:
    return {n: spark.read.format(fmt).load(f"{folder}/{n}") for n in names}


def run_manifest(matches: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """One row a pair: records, status and error, what a run's JSON manifest holds. failures: pair_id, error; a pair may have several."""
    own = matches.groupBy("pair_id").agg(F.count("*").alias("records"), F.count_if(F.col("match_status") == "matched_strong").alias("strong"))
    if failures is None:
        return own.select("*", F.lit("succeeded").alias("status"), F.lit("").alias("error"))
    why = failures.groupBy("pair_id").agg(F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("error"))
    out = own.join(why, "pair_id", "full_outer").na.fill(0, ["records", "strong"])
    return out.select("pair_id", "records", "strong", F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("status"), F.coalesce("error", F.lit("")).alias("error"))


def pairs(files: DataFrame) -> DataFrame:
    """The pairs that have input files, sorted."""
    return files.select("pair_id").distinct().orderBy("pair_id")


def detected_name(rows: DataFrame, fallback: str = "", first: int = 30) -> DataFrame:
    """The first filled detected_ledger_name among the first rows of each ledger; else the fallback. rows: ..., sheet_row."""
    named = (F.col("sheet_row") <= first) & ~C.is_blank(F.col("detected_ledger_name"))
    return rows.groupBy("pair_id", "ledger_role").agg(F.coalesce(F.min_by(C.strip(F.col("detected_ledger_name")), F.when(named, F.col("sheet_row"))), F.lit(fallback)).alias("detected_name"))


def cache_key(payload: F.Column) -> F.Column:
    """Content key of a struct."""
    return F.sha2(F.to_json(payload), 256)


def cached(requests: DataFrame, store: DataFrame, key: str = "cache_key") -> DataFrame:
    """requests with the stored value where there is one; `hit` tells."""
    s = store.select(key, "value").dropDuplicates([key])
    return requests.join(s, key, "left").withColumn("hit", F.col("value").isNotNull())


def fingerprints(headers: DataFrame) -> DataFrame:
    """Layouts keyed by headers and column signature: usage count and the last confidence. headers: headers (array), signature, confidence, seen_at."""
    key = F.concat(F.lower(F.array_join("headers", "|")), F.lit("::"), "signature")
    return headers.groupBy(key.alias("fingerprint")).agg(F.count("*").alias("usage_count"), F.max_by("confidence", "seen_at").alias("confidence"))


def stored_layout(pages: DataFrame, store: DataFrame) -> DataFrame:
    """pages (headers, signature) with the confidence and use of their stored layout; `known` tells whether there is one."""
    key = F.concat(F.lower(F.array_join("headers", "|")), F.lit("::"), F.col("signature"))
    return pages.withColumn("fingerprint", key).join(store, "fingerprint", "left").withColumn("known", F.col("usage_count").isNotNull())


def latest(files: DataFrame, prefer: str | None = None) -> DataFrame:
    """The file to use in each pair: one whose name holds the preferred words, else the newest."""
    liked = F.lower("source_file_name").contains(prefer.lower()) if prefer else F.lit(False)
    return files.groupBy("pair_id").agg(F.max_by("path", F.struct(liked, "modificationTime", "path")).alias("path"))


def parse_strict(raw: DataFrame, col: str, schema: str, required: Iterable[str], enums: dict[str, Iterable[str]] | None = None) -> DataFrame:
    """JSON objects against a flat schema: parsed, and `errors`: not an object, missing, unknown or badly typed keys, values outside an enum."""
    fields = [f.strip().split()[0] for f in schema.split(",")]
    text = F.trim(C.text_or_empty(F.col(col)))
    keys = F.json_object_keys(text)
    got = F.from_json(text, schema)
    value = lambda k: F.get_json_object(text, f"$.{k}")
    errors = [F.when(keys.isNull(), F.array(F.lit("not an object"))).otherwise(F.array().cast("array<string>"))]
    errors.append(F.transform(F.array_except(F.array(*map(F.lit, required)), F.coalesce(keys, F.array().cast("array<string>"))), lambda k: F.concat(F.lit("missing "), k)))
    errors.append(F.transform(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, fields))), lambda k: F.concat(F.lit("unknown "), k)))
    errors.append(F.array_compact(F.array(*[F.when(value(k).isNotNull() & got[k].isNull(), F.lit(f"bad {k}")) for k in fields])))
    for k, allowed in (enums or {}).items():
        errors.append(F.array_compact(F.array(F.when(value(k).isNotNull() & ~value(k).isin(*allowed), F.lit(f"value of {k}")))))
    return raw.withColumn("parsed", got).withColumn("errors", F.when(keys.isNull(), F.array(F.lit("not an object"))).otherwise(F.concat(*errors[1:])))


def merged_results(rows: DataFrame) -> DataFrame:
    """Chunk results of a pair as one: first known name, distinct sorted warnings. rows: pair_id, chunk_no, detected_name, warnings (array)."""
    name = F.min_by("detected_name", F.when(~C.is_blank(F.col("detected_name")), F.col("chunk_no")))
    return rows.groupBy("pair_id").agg(name.alias("detected_name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("warnings")))).alias("warnings"))


def distinct_balances(rows: DataFrame) -> DataFrame:
    """Balances once for each role, kind, page, file and amount; the earliest chunk's stays."""
    from pyspark.sql import Window

    w = Window.partitionBy("pair_id", "ledger_role", "balance_kind", "source_page", "source_file_name", "amount").orderBy("chunk_no")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def label_dictionary(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The alias dictionary with positions, as a small frame."""
    from ..operators.labels import alias_rows, load_labels

    return spark.createDataFrame(alias_rows(load_labels(path)), "label_pos int, alias_pos int, canonical string, alias string, norm_alias string")


def profile_json(profile: DataFrame) -> list[str]:
    """A workbook profile (one row a sheet) as JSON lines."""
    return [json.dumps(r.asDict(recursive=True), sort_keys=True) for r in profile.orderBy("sheet_name").toLocalIterator()]
