"""From raw documents to token ids: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.line_dedup import without_boilerplate
from lexiflow.llm.mixing import mixed_documents
from lexiflow.llm.near_dedup import near_distinct
from lexiflow.llm.pieces import encode_documents
from lexiflow.llm.quality import quality_scores, train_quality
from lexiflow.llm.queries import piece_model_path
from lexiflow.llm.store import materialize
from lexiflow.session import ship


#: Aims after the quality stage, which has dealt with poor text. Clean text holds about 2% of toxic posteriors: a lower aim would take clean documents out with the toxic ones.
MIX_TARGETS = {"good+poor": 0.975, "toxic": 0.025}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_scores(docs, train_quality(docs, _table(spark, sf_dir, "labels")), keep=True)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many pages of a source share go; documents stay."""
    return without_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_distinct(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out, so that domains come to their target shares of tokens."""
    return mixed_documents(docs, _table(spark, sf_dir, "labels"), MIX_TARGETS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    return encode_documents(docs, piece_model_path(), text=False)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("sentencepiece", encode),
]

#: No SQL says what the classifiers, dart signatures and merges do; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
