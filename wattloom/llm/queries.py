"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, decontaminate, extract, jaccard, licenses, lm_score, packing, quality, secrets, toxicity, trie, url_filter
from .common import read


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = read(spark, sf_dir, "labels").where("quality = 1")
    return lm_score.score(read(spark, sf_dir, "documents"), target)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda x: x["rank"] < len(secrets.BASE_RULES))
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_phrases(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))
    items = decontaminate.item_list(F.col("hits"))
    found = found.select("doc_id", "n_words", "hits", items.alias("items"))
    return found.select(
        "doc_id", "n_words", decontaminate.hit_words(F.col("hits")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def op6_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity matches of operator 6; a query of its own, as the SQL of the other fixes its columns."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))
    items = decontaminate.item_list(F.col("near"))
    return found.select(
        "doc_id", "n_words", decontaminate.hit_words(F.col("near")).alias("n_near"), F.size(items).cast("long").alias("n_near_items"),
        F.array_join(items, ",").alias("near_items"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_groups(read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality.score_quality(docs, read(spark, sf_dir, "labels")).drop("text", "source", "lang")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read(spark, sf_dir, "conversations")).drop("preorder", "subtree_end")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if (k.startswith("op") or k == "pipeline") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
