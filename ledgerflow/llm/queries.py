"""The registered queries of this subpackage: thin calls of its operators on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read_documents, tuned

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: MB of an encoder's cache in workers that do nothing else.
ALONE_MB = 300


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    return count_tokens(read_documents(tuned(spark), sf_dir), tokenizer_path(BYTE_BPE))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(read_documents(tuned(spark), sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read_documents(tuned(spark), sf_dir))


def op4_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find

    return find(read_documents(tuned(spark), sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read_documents(tuned(spark), sf_dir), tokenizer_path(BYTE_BPE), cache_mb=ALONE_MB)


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(read_documents(tuned(spark), sf_dir), read_documents(tuned(spark), sf_dir, "benchmark")).drop("spans")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan_licences

    return scan_licences(read_documents(tuned(spark), sf_dir)).drop("spans")


def op7_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import encode_and_read_back

    return encode_and_read_back(read_documents(tuned(spark), sf_dir), tokenizer_path(WORD_BPE), cache_mb=ALONE_MB)


def op9_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(read_documents(tuned(spark), sf_dir, "embeddings"))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import score_folds

    return score_folds(read_documents(tuned(spark), sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_language_id, op3_simhash, op4_disclosure, op5_best_fit_packing, op6_winnowing, op7_repair_shards, op8_licences, op9_kmeans_tree, op10_katz)}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL)
, bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS t FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) u(i) WHERE len(w) > 0)
, dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS t FROM d, (SELECT DISTINCT n FROM bw) sizes, unnest(range(1, len(w) - n + 2)) u(i))
, m AS (SELECT DISTINCT doc_id, n, i, item_id FROM dw JOIN bw USING (n, t))
, h AS (SELECT doc_id, count(DISTINCT p) AS hit FROM m, unnest(range(i, i + n)) v(p) GROUP BY doc_id)
, s AS (SELECT doc_id, count(*) AS items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS x FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(hit, 0) AS n_hit, coalesce(items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit, 0) > 0 AND 20 * coalesce(hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """Only decontamination is whole in SQL: the tokenisers, hashes and fitted models of the others are not."""
    return {"op6_winnowing": OP6_SQL}
