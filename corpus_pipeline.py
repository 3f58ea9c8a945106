"""A corpus from raw documents to a weighted mix, as stages that each read what the last one wrote.

``STAGES`` names them in order; every stage but the last keeps the columns of
``documents``. ``run`` writes each result below the cluster's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.llm.common import table, written
from shelfsight.llm.decontaminate import decontaminate
from shelfsight.llm.language import UNKNOWN, identify_language, train_language
from shelfsight.llm.mixing import mix_to_weights
from shelfsight.llm.secrets import redact_secrets
from shelfsight.llm.simhash import keep_one_of_each

LEAST_LANGUAGE_SHARE = 0.4
MIX = {"weights": [5, 2, 1], "max_epochs": 3.0, "seed": 17}


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those of whose words no language has ``LEAST_LANGUAGE_SHARE``.

    The model learns from the rows of this input that have a language.
    """
    model = train_language(docs.select("doc_id", "text", "lang"))
    told = identify_language(docs, model)
    sure = (F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE_SHARE)
    return told.filter(sure).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of linked fingerprints."""
    return keep_one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with an item of ``benchmark``."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by a mark and counts the characters of changed texts anew."""
    marked = redact_secrets(docs.withColumn("_before", F.xxhash64("text")))
    changed = F.col("_before") != F.xxhash64("text")
    count = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return marked.withColumn("n_chars", count).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their number of copies, and what the mix was aimed at."""
    return mix_to_weights(docs, **MIX).filter("copies > 0")


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
]

# Chain models, component search and automata are beyond SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
