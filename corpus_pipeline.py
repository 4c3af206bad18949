"""Corpus cleaning in five stages; each reads what its predecessor kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard, language, postings, secrets
from tidemark.llm.tables import table
from tidemark.session import release, scratch_tables, written

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language is found: null texts and texts without a letter."""
    found = language.identify(docs, language.trained(docs), out_col="__language")
    return found.where(F.col("__language.lang") != language.UNKNOWN).drop("__language")


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: that with the smallest id. Repeated rows of an id become one."""
    leaders = jaccard.link_classes(docs).where("doc_id = component_id").select("doc_id").distinct()
    first = docs.where("doc_id is not null").join(leaders, "doc_id").dropDuplicates(["doc_id"])
    return first.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    found = postings.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    leaking = found.where("contaminated").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(leaking, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts that are left."""
    return bpe.digests(bpe.encode_texts(docs, bpe.vocabulary_path()), "doc_id", "lang", "source")


_left: list[str] = []

# Texts are long: at Spark's 64 MB a batch, each task and its Python worker hold some hundred MB of them.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def tidy(stage):
    """``stage`` after removing the scratch tables of the stage before it, whose result is stored by then.

    Its batches of texts are small. The result is computed after the call, so the setting stays with the session.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH, BATCH_BYTES)
        release(spark, _left, docs)
        held = set(scratch_tables())
        out = stage(spark, docs, sf_dir)
        _left[:] = [path for path in scratch_tables() if path not in held]
        return out

    return run_stage


STAGES = [
    ("language", tidy(identify_language)),
    ("near_copies", tidy(join_near_copies)),
    ("benchmark", tidy(remove_leaks)),
    ("secrets", tidy(redact_secrets)),
    ("tokens", tidy(encode)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
