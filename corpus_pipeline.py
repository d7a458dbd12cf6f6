"""Training-data pipeline: quality, near duplicates, benchmark leaks, secrets, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that run() writes as
Parquet in the shared folder and reads again as the next stage's docs. All but the last return documents' columns.

Nulls: a null text counts as empty in every stage; it is judged by the quality classifier like an empty one, links with
nothing, leaks nothing, holds no secret and is packed as its end id. A null doc_id or item_id is a key like any other, and
comes after all others where one of a group of copies stays. Of equal rows one stays. Ties go to the smaller doc_id. An
empty table gives no pieces; without labels every document is kept, without benchmark items none leaks. Columns that the
stages don't know pass through whatever they are called, up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattloom.llm import decontaminate, jaccard, packing, quality, secrets
from wattloom.llm.common import discard, read, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_quality(docs, read(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates."""
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret span replaced by a mark."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage),
    ("secrets", secret_stage), ("packing", packing_stage),
]
#: No SQL: a trained classifier, a tokenizer and a linear program are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs
