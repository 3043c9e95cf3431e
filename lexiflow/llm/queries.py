"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.avi import media_digest
from lexiflow.llm.exact_dedup import exact_dedup
from lexiflow.llm.line_dedup import line_dedup
from lexiflow.llm.mixing import mix
from lexiflow.llm.near_dedup import near_dedup
from lexiflow.llm.pieces import encode_documents
from lexiflow.llm.quality import quality_scores, train_quality
from lexiflow.llm.secret_scan import secret_digest
from lexiflow.llm.substring_dedup import substring_dedup
from lexiflow.llm.url_filter import url_filter
from lexiflow.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


@query(
    "op9_url_filter",
    r"""
    WITH u AS (
      SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
    ), h AS (
      SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail FROM u
    ), p AS (
      SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(tail, '^[^?#]*') AS path FROM h
    ), r AS (
      SELECT *, CASE
        WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
        CASE WHEN contains(host || path, 'spam') THEN '**spam**' WHEN contains(host || path, 'casino') THEN '**casino**'
             WHEN contains(host || path, 'porn') THEN '**porn**' WHEN contains(host || path, 'viagra') THEN '**viagra**' END AS matched_glob
      FROM p
    )
    SELECT page_id, host, path, rule,
      CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN matched_glob IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
      matched_glob FROM r
    """,
)
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_read(spark, sf_dir, "pages"))


@query(
    "op10_exact_dedup",
    """
    WITH n AS (
      SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
    ), k AS (SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
      row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS place FROM n)
    SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM k
    """,
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(_read(spark, sf_dir, "documents"))


@query(
    "op6_line_dedup",
    """
    WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS ls FROM documents),
    pages AS (SELECT host, count(*) AS total FROM d GROUP BY host),
    one AS (SELECT host, unnest(list_distinct(ls)) AS line FROM d WHERE text IS NOT NULL),
    bad AS (
      SELECT host, line FROM (SELECT host, line, count(*) AS n FROM one WHERE trim(line) <> '' GROUP BY host, line) JOIN pages USING (host) WHERE n >= 3 AND n / total > 0.05
    ),
    per AS (SELECT host, list(line) AS bad FROM bad GROUP BY host),
    k AS (
      SELECT doc_id, text, coalesce(len(ls), 0) AS n_lines,
        CASE WHEN bad IS NULL OR text IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(bad, x)) END AS kept
      FROM d LEFT JOIN per USING (host)
    )
    SELECT doc_id, n_lines, n_lines - coalesce(len(kept), 0) AS n_removed, sha256(array_to_string(kept, chr(10))) AS text_sha256 FROM k
    """,
)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def piece_model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_read(spark, sf_dir, "documents"), piece_model_path(), ids=False, text=False)


@query("op7_media")
def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(_read(spark, sf_dir, "documents"))


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_scores(docs, train_quality(docs, _read(spark, sf_dir, "labels")))


@query("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_read(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op3_near_dedup")
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_read(spark, sf_dir, "documents")).drop("rid")


@query("op5_mixing")
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).drop("rid")
