"""The registered queries of this package, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import (
    alignment,
    archives,
    decontamination,
    fingerprints,
    infilling,
    langid,
    licences,
    minhash,
    mixing,
    permutations,
    quality,
    sharding,
    toxicity,
)
from tramline.llm.sampling import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the fold that is held out."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs, fold(F.col("doc_id"), 4) != 2)
    return langid.identify(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document, learned outside the fold that is held out."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return toxicity.grade(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "severity", "expected_severity", "p_toxic", "toxic"
    )


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of every document."""
    return licences.scan(_table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of near duplicates of every document."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as ARC, converted to WARC and read back."""
    found = archives.convert_pages(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of the sources takes of every document."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select(
        "row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned outside the fold that is held out."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return quality.score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    placed = sharding.shard(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return placed.select("row.doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document beside those of its edited text and of the next document."""
    return fingerprints.compare_with_next(_table(spark, sf_dir, "documents"))


def op11_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle form of every document, and the text rebuilt from it."""
    return infilling.digests(_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers over every document, aligned, with what the corpus links."""
    return alignment.alignments(_table(spark, sf_dir, "documents"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every hundredth one."""
    return permutations.neighbours(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_toxicity": op2_toxicity,
    "op3_licences": op3_licences,
    "op4_near_dedup": op4_near_dedup,
    "op5_archives": op5_archives,
    "op6_mix": op6_mix,
    "op7_quality": op7_quality,
    "op8_shards": op8_shards,
    "op9_decontamination": op9_decontamination,
    "op10_fingerprints": op10_fingerprints,
    "op11_infilling": op11_infilling,
    "op12_alignment": op12_alignment,
    "op13_neighbours": op13_neighbours,
}
