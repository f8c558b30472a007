"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm import bitpack, fingerprints, mixing, packing, quality_model, quality_rules, simhash, suffix_dedup, toxicity, url_filters
from tracelens.llm.common import crc_mod, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=1, size=2048, markers=True)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(spark, table(spark, sf_dir, "documents"))


def _judged(scored: DataFrame, held_out, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality_model.score(spark, docs, labels, quality_model.learned_fold())
    return _judged(scored, crc_mod(F.col("doc_id"), 5) == 0, 0.3)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(spark, table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(spark, table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(spark, docs, labels, toxicity.learned_fold())
    return _judged(scored, crc_mod(F.col("doc_id"), 3) == 1, 0.7)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.write_and_read(spark, table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2, markers=True)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(spark, table(spark, sf_dir, "pages"))


def queries() -> dict:
    found = (op1_packing, op2_mixing, op3_quality_classifier, op4_suffix_dedup, op5_fingerprints, op6_toxicity, op7_simhash, op8_quality_rules, op9_bit_packed_ids, op10_url_filters)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.SQL}
