"""From raw documents to packed token sequences, in five stages.

1. quality: documents that the word rules or the perplexity bands reject go;
2. exact dedup: of equal texts one stays;
3. near dedup: of each group of near duplicates one stays;
4. mixing: documents are taken as often as their source's target weight says;
5. packing: the documents taken become full token sequences.

Each stage reads what its predecessor kept, written as Parquet, and works on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from duotext.llm.exact import exact_dedup
from duotext.llm.mixing import mix_sources
from duotext.llm.neardup import near_dedup
from duotext.llm.packing import bpe_path, pack_documents
from duotext.llm.quality import quality_filter
from duotext.scratch import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids (``ids``: little-endian unsigned 32-bit numbers)."""
    return pack_documents(docs, bpe_path())


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: The perplexity model of the first stage is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
