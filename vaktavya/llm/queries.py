"""Queries of the operators for training data, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaktavya.llm import bpe, digest, languages, leakage, personal, stuffing, survivors, unify
from vaktavya.llm.sql import SQL
from vaktavya.plans.session import spread
from vaktavya.sources.tables import table

__all__ = ["QUERIES", "SQL"]

Query = Callable[[SparkSession, str], DataFrame]


def spoken_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (source_table, record_id, text) of release.transcription and predictions.prediction."""
    release = table(spark, folder, "release").select(F.lit("release").alias("source_table"), F.col("utterance_id").alias("record_id"), F.col("transcription").alias("text"))
    predictions = table(spark, folder, "predictions").select(F.lit("predictions").alias("source_table"), F.col("row_id").cast("string").alias("record_id"), F.col("prediction").alias("text"))
    return release.unionAll(predictions)


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with placeholders for personal information, and the types of it."""
    return personal.redact(spread(spoken_texts(spark, folder)), "text", ["source_table", "record_id"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The types of personal information in each text."""
    found = p1_redacted(spark, folder)
    return found.select("source_table", "record_id", F.explode("pii_types").alias("pii_type")).distinct()


def p2_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Languages and stretches of every utterance, with confidence."""
    release = table(spark, folder, "release", "utterance_id", "transcription", "language", "language_tag", "is_code_mixed")
    return languages.detect(spread(release), "utterance_id", "transcription", "language", "language_tag", "is_code_mixed")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The languages of utterances whose labels are missing or wrong."""
    wrong = p2_languages(spark, folder).where("wrong")
    return wrong.select("utterance_id", F.explode("languages.language").alias("language")).distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that give prediction and latency of each repeated utterance and provider."""
    found = survivors.attempt_survivors(table(spark, folder, "predictions"), least=2)
    return found.select("utterance_id", "provider", "prediction_row", "latency_row")


def p3_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """One surviving record for each utterance and provider."""
    return survivors.attempt_survivors(table(spark, folder, "predictions"))


def p5_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Latency percentiles per language, domain and day."""
    rows = digest.latencies(table(spark, folder, "predictions"), table(spark, folder, "release"))
    keys = ["language", "domain", "day"]
    return digest.quantiles(digest.build_digests(rows, "latency_ms", keys), keys, 1)


def p5_total(spark: SparkSession, folder: str) -> DataFrame:
    """Latency percentiles per language and domain, combined from the digests of the days."""
    rows = digest.latencies(table(spark, folder, "predictions"), table(spark, folder, "release"))
    days = digest.build_digests(rows, "latency_ms", ["language", "domain", "day"])
    keys = ["language", "domain"]
    return digest.quantiles(digest.merge_digests(days, keys), keys, 2)


def p5_coarse(spark: SparkSession, folder: str, k: int = 440) -> DataFrame:
    """Per language, whether the percentiles of digests of few nodes, combined from those of the days, keep the rank error that they state."""
    rows = digest.latencies(table(spark, folder, "predictions"), table(spark, folder, "release"))
    keys = ["language"]
    merged = digest.merge_digests(digest.build_digests(rows, "latency_ms", ["language", "day"], k), keys, k)
    found = digest.quantiles(merged, keys, 2, k)
    # a leaf holds values that are told apart by less than its width
    leaf = 2.0**-digest.MANTISSA_BITS
    ranked = rows.select("language", "latency_ms").join(found, "language")
    low = {q: F.sum((F.col("latency_ms") < F.col(q) * (1 - leaf)).cast("bigint")) for q in digest.QUANTILES}
    high = {q: F.sum((F.col("latency_ms") <= F.col(q) * (1 + leaf)).cast("bigint")) for q in digest.QUANTILES}
    slack = F.first("rank_error") * F.first("n") + 1
    kept = F.lit(True)
    for q, share in digest.QUANTILES.items():
        kept = kept & (low[q] - slack <= share * F.first("n")) & (high[q] + slack >= share * F.first("n"))
    return ranked.groupBy("language").agg(F.first("n").alias("n"), kept.alias("kept"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that hold something that looks like its plain spelling but isn't."""
    texts = spoken_texts(spark, folder).where(F.col("text").isNotNull())
    odd = unify.unify(spread(texts), "text").where(F.col("text") != F.col("text_unified"))
    return odd.select("source_table", "record_id").distinct()


def p6_unified(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in its one form."""
    return unify.unify(spread(spoken_texts(spark, folder)), "text").select("source_table", "record_id", "text_unified")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_texts(spread(table(spark, folder, "documents", "doc_id", "text")), "doc_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the evaluation items that they leak."""
    return p9_clean(spark, folder).select("doc_id", "item_id").distinct()


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Leaking documents with the leaked spans taken out."""
    documents, items = table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items")
    return leakage.leaks(spread(documents), "doc_id", "text", items, "item_id", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are more lists of keywords, links or tags than sentences."""
    return p10_shares(spark, folder).where(F.col("share") > stuffing.SHARE).select("doc_id").distinct()


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's share of listed words."""
    return stuffing.stuffing(spread(table(spark, folder, "documents", "doc_id", "text")), "doc_id", "text")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_redacted, p2_found, p2_languages, p3_found, p3_survivors, p5_daily, p5_total, p5_coarse, p6_found, p6_unified, p8_ids, p9_found, p9_clean, p10_found, p10_shares)
}
