"""The corpus pipeline: stages in order, each over all that its predecessor kept.

1. Quality classifier: documents above their language's perplexity limit go.
2. Line dedup: lines that many documents hold stay in one.
3. SimHash near-dedup: one document of each component of fingerprints within two
   bits of each other stays (op1's operator).
4. Benchmark decontamination: documents that hold a benchmark item go.
5. Mixing to target weights: every document with its size, its source's target
   and the words the mix takes of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.common import table, written
from scriptorium.llm.decontamination import decontaminate
from scriptorium.llm.line_dedup import line_dedup
from scriptorium.llm.mixing import mix_report
from scriptorium.llm.perplexity import quality_filter
from scriptorium.llm.simhash import keep_one


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_report(docs)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("near-dedup", dedup_near),
    ("decontamination", decontaminated),
    ("mixing", mix),
]

#: Perplexities, fingerprints and edit distances are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
