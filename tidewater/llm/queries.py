"""Registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii(spark, sf_dir):
    from .pii import pii_report

    return pii_report(_read(spark, sf_dir, "documents"))


def op2_mix_sources(spark, sf_dir):
    from .mixing import mixing_report

    return mixing_report(_read(spark, sf_dir, "documents"))


def op3_repeated_spans(spark, sf_dir):
    from .dupspans import cut_repeats

    return cut_repeats(_read(spark, sf_dir, "documents"))


def op4_lm_score(spark, sf_dir):
    from .lmscore import score_texts

    return score_texts(_read(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    from .quality import quality_report

    return quality_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_license_scan(spark, sf_dir):
    from .licenses import license_report

    return license_report(_read(spark, sf_dir, "documents"))


def op7_decontaminate(spark, sf_dir):
    from .decontam import decontamination_report

    return decontamination_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_token_counts(spark, sf_dir):
    from .tokencount import token_report

    return token_report(_read(spark, sf_dir, "documents"))


def op9_secret_scan(spark, sf_dir):
    from .secrets import secrets_report

    return secrets_report(_read(spark, sf_dir, "documents"))


def op10_ngram_join(spark, sf_dir):
    from .ngram_join import near_components

    return near_components(_read(spark, sf_dir, "documents"))


def op11_pack_windows(spark, sf_dir):
    from .packing import packing_report

    return packing_report(_read(spark, sf_dir, "documents"))


def op12_repair_conversations(spark, sf_dir):
    from .dialogue import conversation_report

    return conversation_report(_read(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark, sf_dir):
    from .negatives import negatives_report

    return negatives_report(_read(spark, sf_dir, "embeddings"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    own = (op1_pii, op2_mix_sources, op3_repeated_spans, op4_lm_score, op5_quality_rules, op6_license_scan, op7_decontaminate, op8_token_counts, op9_secret_scan, op10_ngram_join, op11_pack_windows, op12_repair_conversations, op13_hard_negatives, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Of the others, what each method decides is outside SQL; tests compare with brute force instead."""
    from .dialogue import CONVERSATION_SQL
    from .negatives import NEGATIVES_SQL

    return {"op12_repair_conversations": CONVERSATION_SQL, "op13_hard_negatives": NEGATIVES_SQL}
