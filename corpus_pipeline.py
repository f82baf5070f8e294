"""A training corpus from ``documents``: quality rules, line dedup,
near-duplicate removal, benchmark decontamination, mixing.

Every stage takes what its predecessor wrote and works on all of it; what a
stage decides takes effect for the next ones. ``run`` applies the stages to
the table ``documents``, each written as Parquet in the shared folder and read
again. The last stage returns the documents of the mix with their copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taskwatch.llm import decontaminate, linedup, mixing, quality, simjoin
from taskwatch.llm.common import read
from taskwatch.session import pin


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.rejecting(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linedup.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simjoin.distinct(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
]

#: similarity joins and seeds over token hashes have no SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
