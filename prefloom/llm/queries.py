"""Registered queries of the document operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.llm import (
    bpe, chat_format, decontaminate, filter_audit, neardup, periodic_runs, pseudo_likelihood, quality_model,
    quality_rules, sharding, suffixes, toxicity, url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(quality_rules.measures(table(spark, sf, "documents"))).select(*quality_rules.RESULT)


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")))


def op3_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"), size=4)


def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality_model.score(docs, quality_model.fit(docs, table(spark, sf, "labels")))


def op5_pseudo_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    return pseudo_likelihood.fit_and_score(table(spark, sf, "documents"))


def op6_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.assign(table(spark, sf, "documents"), keep=["doc_id"])


def op7_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.digests(table(spark, sf, "documents"))


def op8_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"))


def op9_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    judged = url_filter.judge(url_filter.page_captures(pages), url_filter.page_entries(pages))
    return judged.select("page_id", "day", "host", "n_entries", F.array_join("lists", ",").alias("lists"), "blocked")


def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan(table(spark, sf, "documents"), table(spark, sf, "benchmark")))


def op11_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op12_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = chat_format.with_hostile(table(spark, sf, "conversations"))
    return chat_format.digest(chat_format.read_back(chat_format.render(chat_format.conversations(rows))))


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.periodic_runs(table(spark, sf, "documents"), prepare=periodic_runs.with_period))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_minhash": op3_minhash,
    "op4_quality": op4_quality,
    "op5_pseudo_likelihood": op5_pseudo_likelihood,
    "op6_sharding": op6_sharding,
    "op7_suffixes": op7_suffixes,
    "op8_bpe": op8_bpe,
    "op9_url_filter": op9_url_filter,
    "op10_decontamination": op10_decontamination,
    "op11_filter_audit": op11_filter_audit,
    "op12_chat_format": op12_chat_format,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op6_sharding": sharding.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_chat_format": chat_format.ORACLE,
}
