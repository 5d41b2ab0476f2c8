"""Queries opN_<name>: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm.conversations import repair_report
from gristmill.llm.decontaminate import find_leaks
from gristmill.llm.language import language_report
from gristmill.llm.line_dedup import line_links
from gristmill.llm.lz_fingerprint import lz_fingerprints
from gristmill.llm.packing import pack
from gristmill.llm.quality import score
from gristmill.llm.secrets_scan import scan_secrets
from gristmill.llm.simhash import near_duplicates
from gristmill.llm.spelling import spelling_variants
from gristmill.llm.substring import substring_report
from gristmill.llm.token_files import token_file_round_trip
from gristmill.llm.warc import archive_round_trip
from gristmill.session import load

def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprints(load(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_links(load(spark, sf_dir, "documents"), similarity=0.8)


def op3_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_round_trip(load(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(load(spark, sf_dir, "documents"))


def op5_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(load(spark, sf_dir, "pages"), roll_bytes=64 << 20, least_bytes=100)


OP5_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
     f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN f.first_id < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id < p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND p.n >= 100
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), window=20, similarity=0.8, least_words=5)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), host_col="source", path_col="lang", max_labelled=20_000)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), width=4, radius=4)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), tokenizer_path(), capacities=(512, 1024, 2048, 4096))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(load(spark, sf_dir, "documents"), width=50)


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     e AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS s, w FROM d WHERE len(w) >= 50),
     h AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS k FROM e),
     m AS (SELECT k, min(doc_id) AS low FROM h GROUP BY k HAVING min(doc_id) < max(doc_id)),
     g AS (SELECT doc_id, s FROM h JOIN m USING (k) WHERE low < doc_id),
     c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM g),
     r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
              ELSE coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(load(spark, sf_dir, "documents"), least_length=7, least_count=2, factor=10, modulus=31)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(load(spark, sf_dir, "conversations"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(load(spark, sf_dir, "documents"), fold=2, folds=4)


def queries() -> dict[str, Query]:
    operators = (
        op1_lz_fingerprint, op2_line_dedup, op3_huffman_token_files, op4_secret_scan, op5_warc_writer, op6_decontamination, op7_quality_classifier, op8_simhash, op9_best_fit_packing,
        op10_substring_dedup, op11_spelling_variants, op12_conversation_repair, op13_language_id,
    )
    return {f.__name__: f for f in operators}


def oracle_sql() -> dict[str, str]:
    return {"op5_warc_writer": OP5_SQL, "op10_substring_dedup": OP10_SQL}
