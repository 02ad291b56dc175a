"""The core's queries and their SQL, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaktavya.functions.distance import keyword_counts, mixed_counts, word_counts
from vaktavya.functions.ids import plain_id
from vaktavya.functions.normalize import fold, nfkc, normalize, settle_spellings, tokens, with_normal_forms
from vaktavya.inference import recognisers, routing
from vaktavya.operators import scoring
from vaktavya.operators.packed import unpack
from vaktavya.plans.session import shared_folder, spread
from vaktavya.semantic import judge, pipeline
from vaktavya.sources import speech
from vaktavya.sources.records import damaged_records, sound_records
from vaktavya.sources.tables import table
from vaktavya.sql import SQL
from vaktavya.streaming import live

__all__ = ["QUERIES", "SQL"]

Query = Callable[[SparkSession, str], DataFrame]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every keyword of every cell of release.keywords."""
    release = table(spark, folder, "release", "utterance_id", "keywords")
    return unpack(release, "utterance_id", "keywords", "keyword").distinct()


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The records of raw_predictions that aren't sound."""
    return damaged_records(table(spark, folder, "raw_predictions")).select("line_id").distinct()


def p7_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """The records that aren't sound, with the reason."""
    return damaged_records(table(spark, folder, "raw_predictions"))


def p7_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The sound records as typed rows."""
    return sound_records(table(spark, folder, "raw_predictions"))


def release_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The release, rows that are repeated whole once."""
    return speech.load_release(spark, f"{folder.rstrip('/')}/release.parquet").distinct()


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions with the plain id and a trimmed status; row_id is the order of attempts."""
    rows = table(spark, folder, "predictions")
    return rows.withColumns({"utterance_id": plain_id(F.col("utterance_id")), "status": F.trim("status"), "attempt": F.col("row_id")})


def system(spark: SparkSession, folder: str, provider: str) -> DataFrame:
    """Best attempts of one recogniser."""
    return speech.best_attempts(attempts(spark, folder).where(F.col("provider") == provider), columns=["prediction"])


def systems(spark: SparkSession, folder: str) -> DataFrame:
    """Best attempt of every recogniser for each released utterance that it has one for."""
    best = speech.best_attempts(attempts(spark, folder), ["provider", "utterance_id"], columns=["prediction"])
    wanted = release_rows(spark, folder).select("utterance_id", "call_id", "language", "domain", "transcription", "keywords")
    return best.join(wanted, "utterance_id").withColumn("prediction", F.coalesce("prediction", F.lit("")))


def scan_project(spark: SparkSession, folder: str) -> DataFrame:
    """Columns that scoring needs."""
    return release_rows(spark, folder).select("utterance_id", "call_id", "transcription", "keywords")


def dedupe_last_success(spark: SparkSession, folder: str) -> DataFrame:
    """Row of the best attempt of each utterance and recogniser: the last successful one, or else the last."""
    return speech.best_attempts(attempts(spark, folder), ["provider", "utterance_id"], "row_id", ["row_id"])


def repeated_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Utterances with several predictions."""
    return speech.repeated_ids(attempts(spark, folder))


def missing_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Utterances that no recogniser answered."""
    return speech.missing_predictions(release_rows(spark, folder), attempts(spark, folder)).select("utterance_id")


def align_left(spark: SparkSession, folder: str) -> DataFrame:
    """The release with one recogniser's predictions; utterances without one have the empty text."""
    rows = speech.align(release_rows(spark, folder), system(spark, folder, "aldervox"), require_complete=False)
    return rows.select("utterance_id", "transcription", "prediction")


def tag_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of every tag, joined by commas."""
    return release_rows(spark, folder).select("utterance_id", F.array_join(speech.tag_codes(F.col("language_tag")), ",").alias("codes"))


def without_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Utterances without Malayalam that aren't just Hindi and Marathi."""
    return speech.without_languages(release_rows(spark, folder), ("ml",), (("hi", "mr"),)).select("utterance_id")


def first_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred longest utterances: a top-k report."""
    rows = release_rows(spark, folder).select("utterance_id", F.coalesce("duration_sec", F.lit(-1.0)).alias("seconds"))
    return speech.first_rows(rows, 100, F.col("seconds").desc(), "utterance_id")


def batch_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Utterances of each batch of at most sixteen of one language and domain."""
    rows = speech.batches(release_rows(spark, folder), F.concat_ws("/", "language", "domain"), 16, F.col("utterance_id"))
    return rows.groupBy(F.concat_ws("/", "language", "domain").alias("lane"), "batch").agg(F.count(F.lit(1)).alias("n"))


def folded_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Transcriptions with characters, case, punctuation and blanks folded."""
    rows = release_rows(spark, folder).select("utterance_id", nfkc(F.col("transcription")).alias("t"))
    return rows.select("utterance_id", fold(F.col("t")).alias("folded"))


def settled_spellings(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions, folded, with fillers and spellings settled."""
    rows = table(spark, folder, "predictions").select("row_id", nfkc(F.col("prediction")).alias("t"))
    return rows.select("row_id", F.array_join(settle_spellings(tokens(fold(F.col("t")))), " ").alias("settled"))


def _said(number: Column) -> Column:
    """English words of a number below a thousand."""
    small = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    tens = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
    below = lambda n: small[n] if n < 20 else tens[n // 10] + (f" {small[n % 10]}" if n % 10 else "")
    named = [below(n) if n < 100 else f"{small[n // 100]} hundred" + (f" and {below(n % 100)}" if n % 100 else "") for n in range(1000)]
    return F.get(F.lit(named), number.cast("int"))


def _said_whole(number: Column, scales: dict[int, str]) -> Column:
    """Words of a number by scales, the largest first."""
    parts, rest = [], number
    for size, name in scales.items():
        parts.append(F.when(F.floor(rest / size) > 0, F.concat(_said(F.floor(rest / size)), F.lit(f" {name}"))))
        rest = F.pmod(rest, F.lit(size))
    return F.concat_ws(" ", *parts, F.when((rest > 0) | (number == 0), _said(rest)))


def spoken_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Each line item said in words, English, Indian and with ordinals, decimals and two Indian languages, and normalized."""
    rows = spread(table(spark, folder, "lineitem"))
    key, price, hundredths = F.col("l_orderkey"), F.floor("l_extendedprice"), F.round(F.col("l_discount") * 100).cast("int")
    ordinals = F.lit(["zeroth", "first", "second", "third", "fourth", "fifth", "sixth", "seventh"])
    ordinal = F.when(key % 2 == 0, F.get(ordinals, F.col("l_linenumber"))).otherwise(
        F.concat("l_linenumber", F.when(F.col("l_linenumber") == 1, "st").when(F.col("l_linenumber") == 2, "nd").when(F.col("l_linenumber") == 3, "rd").otherwise("th"))
    )
    units = {"hi": "शून्य एक दो तीन चार पांच छह सात आठ नौ दस ग्यारह बारह तेरह चौदह पंद्रह सोलह सत्रह अठारह उन्नीस", "mr": "शून्य एक दोन तीन चार पाच सहा सात आठ नऊ दहा अकरा बारा तेरा चौदा पंधरा सोळा सतरा अठरा एकोणीस"}
    tens = {"hi": "- - बीस तीस चालीस पचास", "mr": "- - वीस तीस चाळीस पन्नास"}

    def pieces(language: str) -> Column:
        u, t = units[language].split(), tens[language].split()
        return F.get(F.lit([u[n] if n < 20 else t[n // 10] + (f" {u[n % 10]}" if n % 10 else "") for n in range(60)]), F.col("l_quantity").cast("int"))

    said = F.concat_ws(
        " ", _said_whole(key, {1_000_000: "million", 1000: "thousand"}), F.lit("line"), ordinal, F.lit("part"), _said_whole(F.col("l_partkey"), {1000: "thousand"}),
        F.lit("Rs."), _said_whole(price, {10_000_000: "crore", 100_000: "lakh", 1000: "thousand"}), F.lit("less zero point"),
        _said(F.floor(hundredths / 10)), _said(F.pmod(hundredths, F.lit(10))), F.lit("%"), F.when(key % 3 == 0, pieces("mr")).otherwise(pieces("hi")), F.lit("नग"),
    )
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", normalize(said).alias("form"))


def number_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every transcription and prediction with its numbers composed; spellings stay."""
    release = table(spark, folder, "release").select(F.lit("release").alias("source_table"), F.col("utterance_id").alias("record_id"), F.col("transcription").alias("t"))
    predictions = table(spark, folder, "predictions").select(F.lit("predictions").alias("source_table"), F.col("row_id").cast("string").alias("record_id"), F.col("prediction").alias("t"))
    return spread(release.unionAll(predictions)).select("source_table", "record_id", normalize(F.col("t"), spellings=False).alias("form"))


def loaded_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The predictions file as a scoring run reads it: the last good attempt of each id as it is spelled, by place in the file."""
    return speech.load_predictions(spark, f"{folder.rstrip('/')}/predictions.parquet")


def plain_word_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Word edits of every recogniser without number and spelling rules."""
    rows = with_normal_forms(systems(spark, folder), {"transcription": "r", "prediction": "h"}, numbers=False, spellings=False)
    counted = rows.withColumn("c", word_counts(F.col("r"), F.col("h")))
    return counted.select("provider", "utterance_id", "c.edits", "c.units")


def plain_wer_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Word error rates overall, by recogniser, language and domain in one pass, without number and spelling rules."""
    rows = with_normal_forms(systems(spark, folder), {"transcription": "r", "prediction": "h"}, numbers=False, spellings=False)
    none = F.lit(0).cast("bigint")
    counted = rows.withColumn("c", word_counts(F.col("r"), F.col("h"))).select(
        "provider", "language", "domain", F.col("c.edits").alias("w_edits"), F.col("c.units").alias("w_units"), *(none.alias(c) for c in scoring.COUNTS[2:])
    )
    return scoring.score_sets(counted, "provider", "language", "domain").select("breakdown", "value", "utterances", "reference_words", "wer")


def counts_of_systems(spark: SparkSession, folder: str) -> DataFrame:
    """All counts of every row."""
    return scoring.row_counts(systems(spark, folder))


def row_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The nine counts of every recogniser and utterance."""
    return counts_of_systems(spark, folder).select("provider", "utterance_id", *scoring.COUNTS)


def score_overall(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus score of one recogniser over the whole release."""
    rows = speech.align(release_rows(spark, folder), system(spark, folder, "aldervox"), require_complete=False)
    return scoring.score(scoring.row_counts(rows))


def score_by_provider(spark: SparkSession, folder: str) -> DataFrame:
    """A corpus score for each recogniser."""
    return scoring.score_by(counts_of_systems(spark, folder), "provider")


def score_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Overall score and breakdowns in one pass."""
    return scoring.score_sets(counts_of_systems(spark, folder), "provider", "language", "domain")


def call_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of counts by call."""
    return scoring.call_totals(counts_of_systems(spark, folder))


def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    """Interval of one recogniser's word error rate."""
    rows = speech.align(release_rows(spark, folder), system(spark, folder, "aldervox"), require_complete=False)
    return scoring.bootstrap_ci(scoring.row_counts(rows, keywords=False))


def paired_delta_ci(spark: SparkSession, folder: str) -> DataFrame:
    """Difference of two recognisers over the whole release and its interval, by weights."""
    release = release_rows(spark, folder)
    a, b = (scoring.row_counts(speech.align(release, system(spark, folder, p), require_complete=False), keywords=False) for p in ("aldervox", "brooktalk"))
    delta = scoring.paired_delta_ci(a, b, n_boot=200, drawn_calls=0)
    return delta.select(*(F.round(c, 9).alias(c) for c in ("delta", "low", "high")))


def weighted_ci(spark: SparkSession, folder: str) -> DataFrame:
    """Interval of one recogniser's word error rate over the utterances that it answered, by weights instead of draws."""
    counts = counts_of_systems(spark, folder).where(F.col("provider") == "brooktalk")
    interval = scoring.bootstrap_ci(counts, n_boot=200, drawn_calls=0)
    return interval.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def mixed_unit_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Edits of mixed units of every recogniser, by expressions over normal forms."""
    rows = with_normal_forms(systems(spark, folder), {"transcription": "r", "prediction": "h"}).withColumn("c", mixed_counts(F.col("r"), F.col("h")))
    return rows.select("provider", "utterance_id", "c.edits", "c.units")


def keyword_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword hits and the miss rate of each row."""
    found = keyword_counts(F.col("keywords"), F.col("prediction"), F.col("transcription"))
    return systems(spark, folder).withColumn("k", found).select("provider", "utterance_id", "k.hits", "k.scored", "k.rate")


def corpus_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of the release."""
    facts = scoring.corpus_facts(release_rows(spark, folder))
    return facts.select("utterances", F.round("hours", 6).alias("hours"), "calls", F.round("mixed_share", 9).alias("mixed_share"), F.round("short_share", 9).alias("short_share"), F.round("keyword_share", 9).alias("keyword_share"))


def normal_form_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Utterances whose stored normal form differs."""
    return scoring.normal_form_drift(release_rows(spark, folder)).select("utterance_id", "expected")


def sampled_in(spark: SparkSession, folder: str) -> DataFrame:
    """A fixed sample of a tenth, by the hash of the row id: a sampling operator."""
    rows = table(spark, folder, "predictions", "row_id")
    return rows.where(judge.sampled_in(F.col("row_id"), 0.1))


def question_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of questions about predictions."""
    rows = table(spark, folder, "predictions")
    return rows.select("row_id", judge.identity(F.col("utterance_id"), F.col("prediction"), F.col("provider")).alias("cache_key"))


def latest_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The last answer of each key, as its number of pairs."""
    answers = judge.latest_answers(table(spark, folder, "judge_cache"))
    return answers.select("cache_key", F.coalesce(F.size("response.equivalences"), F.lit(-1)).cast("bigint").alias("n_pairs"))


def pending_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions without a judge's answer."""
    questions = table(spark, folder, "predictions", "row_id").withColumn("cache_key", F.col("row_id").cast("string"))
    answers = judge.latest_answers(table(spark, folder, "judge_cache").where("response IS NOT NULL"), "row_id")
    return judge.pending_questions(questions, answers.withColumn("cache_key", F.col("cache_key").cast("string"))).select("row_id")


def pair_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Every different pair that the judge proposed, whether the rules accept it, and why not."""
    pairs = table(spark, folder, "judge_cache").select(F.explode("response.equivalences").alias("e")).select(
        F.lower(F.trim(F.coalesce("e.type", F.lit("")))).alias("kind"), F.coalesce("e.hypothesis_span", F.lit("")).alias("hypothesis_span"), F.coalesce("e.reference_span", F.lit("")).alias("reference_span")
    )
    return pipeline.verdicts(pairs.distinct())


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """Every prediction with a reference, judged by the answers in the judge's cache."""
    release = release_rows(spark, folder).select("utterance_id", "language", "transcription")
    rows = attempts(spark, folder).select("row_id", "utterance_id", "prediction").join(release, "utterance_id")
    prepared = pipeline.prepare(rows, "row_id", "transcription", "prediction", "language")
    # this cache is keyed by prediction; a row's last answer counts
    answers = judge.latest_answers(table(spark, folder, "judge_cache"), "row_id").where("response IS NOT NULL").withColumn("cache_key", F.col("cache_key").cast("string"))
    keyed = prepared.withColumn("cache_key", F.when(F.col("status").isNull(), F.col("row_key").cast("string")))
    return pipeline.judged(keyed, answers)


def semantic_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Semantic edits of every prediction with a reference, and how many pairs were accepted."""
    counted = {f"n_{c}": F.size(c).cast("bigint") for c in ("accepted", "rejected")}
    return _judged(spark, folder).withColumns(counted).withColumn("number_pairs", F.col("number_pairs").cast("bigint")).drop("accepted", "rejected")


def semantic_score(spark: SparkSession, folder: str) -> DataFrame:
    """Semantic and lexical rates by language."""
    return pipeline.semantic_score(_judged(spark, folder), "language")


def routes(spark: SparkSession, folder: str) -> DataFrame:
    """Languages as recognisers take them."""
    language, tag, mixed = F.col("language"), F.col("language_tag"), F.col("is_code_mixed")
    return release_rows(spark, folder).select(
        "utterance_id",
        routing.one_or_many(language, mixed, ("hi", "en", "bn", "ta", "te", "kn", "mr", "gu"), ("hi", "en")).alias("one_or_many"),
        routing.regional(language).alias("regional"),
        F.coalesce(routing.code_or_null(language), F.lit("-")).alias("code"),
        routing.supported_or(tag, ("bn", "en", "gu", "hi", "kn", "ml", "mr", "ta", "te"), "multi").alias("supported"),
        F.coalesce(F.array_join(routing.language_hints(tag, language), ","), F.lit("-")).alias("hints"),
        routing.language_name(language).alias("name"),
    )


def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Results by status."""
    return recognisers.status_counts(table(spark, folder, "predictions").select(F.lower(F.trim("status")).alias("status")))


def run_tallies(spark: SparkSession, folder: str) -> DataFrame:
    """Ids that succeeded and ids that only failed."""
    rows = attempts(spark, folder).select("utterance_id", F.lower("status").alias("status"))
    return recognisers.tallies(rows)


def unfinished(spark: SparkSession, folder: str) -> DataFrame:
    """Utterances that a resumed run would take up."""
    rows = attempts(spark, folder).select("utterance_id", F.lower("status").alias("status"))
    return release_rows(spark, folder).join(recognisers.finished(rows), "utterance_id", "left_anti").select("utterance_id")


def transcribed(spark: SparkSession, folder: str) -> DataFrame:
    """A run of the test recogniser, with each transcription's bytes as its audio; null ones have none."""
    rows = release_rows(spark, folder).dropDuplicates(["utterance_id"])
    audio = rows.where("transcription IS NOT NULL").select("utterance_id", F.col("transcription").cast("binary").alias("audio"))
    return recognisers.transcribe(rows, audio, recognisers.Echo).select("utterance_id", "prediction", "status")


def _stream_of_predictions(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """Predictions as a stream, and a folder of its own for what is kept of it."""
    place = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    return live.arriving(spark, f"{folder.rstrip('/')}/predictions.parquet*", table(spark, folder, "predictions")), place


def streamed_status_days(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions by day of writing and status, counted as they arrive."""
    arriving, place = _stream_of_predictions(spark, folder)
    rows = arriving.where("written_at IS NOT NULL").select(
        F.date_format("written_at", "yyyy-MM-dd").alias("day"), F.lower(F.trim(F.coalesce("status", F.lit("")))).alias("status"), F.lit(1).alias("n")
    )
    live.keep_sums(rows, ("day", "status"), ("n",), f"{place}/sums", f"{place}/checkpoint").awaitTermination()
    return live.kept_sums(spark, ("day", "status"), ("n",), f"{place}/sums")


def streamed_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of all successful attempts by recogniser and language, scored as they arrive against the release."""
    arriving, place = _stream_of_predictions(spark, folder)
    rows = arriving.where(speech.succeeded(F.trim("status"))).withColumn("utterance_id", plain_id(F.col("utterance_id")))
    live.keep_totals(live.scored(rows, release_rows(spark, folder)), f"{place}/sums", f"{place}/checkpoint").awaitTermination()
    return live.totals(spark, f"{place}/sums")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p4_found, p7_found, p7_reasons, p7_rows, scan_project, dedupe_last_success, repeated_ids, missing_predictions, align_left, tag_codes,
        without_languages, first_rows, batch_sizes, folded_texts, settled_spellings, spoken_numbers, number_forms, loaded_predictions,
        plain_word_counts, plain_wer_sets, row_counts, score_overall, score_by_provider, score_sets, call_totals, bootstrap_ci, paired_delta_ci,
        weighted_ci, mixed_unit_counts, keyword_misses,
        corpus_facts, normal_form_drift, sampled_in, question_keys, latest_answers, pending_rows, pair_verdicts, semantic_rows, semantic_score, routes,
        status_counts, run_tallies, unfinished, transcribed, streamed_status_days, streamed_scores,
    )
}
