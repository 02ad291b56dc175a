"""The semantic error rate: differences that a judge proposes and rules verify aren't counted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaktavya.functions.distance import char_counts, word_counts
from vaktavya.functions.normalize import with_normal_forms
from vaktavya.functions.plain import plain_normalize
from vaktavya.plans.settings import Settings, settings
from vaktavya.semantic.judge import QUESTION, Judge, answer_into, identity, sampled_in
from vaktavya.semantic.pairs import LEAST_LIKENESS, apply_pairs, verify_pair

_RECORD = "struct<hypothesis_span: string, reference_span: string, type: string>"
_REJECTED = "struct<hypothesis_span: string, reference_span: string, type: string, reason: string>"


def prepare(df: DataFrame, key: str, reference: str, hypothesis: str, language: str, share: float = 1.0) -> DataFrame:
    """Normal forms, counts, and ``status`` where no judge is needed; elsewhere ``cache_key`` names the question.

    Statuses: empty_reference, exact, empty_hypothesis, sampled_out; null for rows to be judged.
    """
    rows = df.select(F.col(key).alias("row_key"), F.col(reference).alias("_t"), F.col(hypothesis).alias("_p"), F.coalesce(F.col(language), F.lit("")).alias("language"))
    normal = with_normal_forms(rows, {"_t": "reference", "_p": "hypothesis"}).drop("_t", "_p")
    w, c = word_counts(F.col("reference"), F.col("hypothesis")), char_counts(F.col("reference"), F.col("hypothesis"))
    status = (
        F.when(F.col("reference") == "", "empty_reference")
        .when(F.col("reference") == F.col("hypothesis"), "exact")
        .when(F.col("hypothesis") == "", "empty_hypothesis")
        .when(~sampled_in(F.col("row_key"), share), "sampled_out")
    )
    out = normal.withColumns({"_w": w, "_c": c, "status": status})
    asked = F.when(F.col("status").isNull(), identity(F.col("reference"), F.col("hypothesis"), F.col("language"), F.lit(QUESTION)))
    return out.select(
        "row_key", "reference", "hypothesis", "language", "status", asked.alias("cache_key"),
        F.col("_w.edits").alias("word_edits"), F.col("_w.units").alias("words"), F.col("_c.edits").alias("char_edits"), F.col("_c.units").alias("chars"),
    )


def questions(prepared: DataFrame) -> DataFrame:
    """Each question once."""
    return prepared.where("cache_key IS NOT NULL").select("cache_key", "reference", "hypothesis", "language").dropDuplicates(["cache_key"])


def judged(
    prepared: DataFrame, answers: DataFrame, least: float = LEAST_LIKENESS, allow_unverified_numbers: bool = False, asked: bool = True
) -> DataFrame:
    """One row for each prepared row with semantic edits, rates, status, and the pairs accepted and rejected.

    Rows whose question has no answer have null semantic figures and the status ``judge_error``, or ``no_judge`` if none was
    ``asked``; rows that were sampled out have null figures too.
    An empty hypothesis has its lexical edits. Only the texts of rows with an answer visit Python.
    """
    known = answers.select("cache_key", F.col("response.equivalences").alias("pairs"), F.lit(True).alias("_answered"))
    rows = prepared.join(known, "cache_key", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [
                None if r is None else apply_pairs(r, h, None if p is None else list(p), least, allow_unverified_numbers)
                for r, h, p in zip(pdf["r"], pdf["h"], pdf["p"], strict=True)
            ]
            names = ("hypothesis", "word_edits", "accepted", "rejected")
            yield pd.DataFrame([dict.fromkeys(names) if f is None else f for f in found], columns=list(names))

    @F.pandas_udf(f"hypothesis string, word_edits bigint, accepted array<{_RECORD}>, rejected array<{_REJECTED}>")
    def applied(sent: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(sent)

    # rows that no answer concerns pass nulls to Python, and nothing is computed twice for two branches
    open_ = F.col("_answered") & F.col("status").isNull()
    sent = F.struct(F.when(open_, F.col("reference")).alias("r"), F.when(open_, F.col("hypothesis")).alias("h"), F.when(open_, F.col("pairs")).alias("p"))
    done = rows.withColumns({"_a": applied.asNondeterministic()(sent), "_asked": F.coalesce(open_, F.lit(False))})
    settled = F.col("status").isin("exact", "empty_hypothesis")
    accepted = F.coalesce("_a.accepted", F.array().cast(f"array<{_RECORD}>"))
    status = F.when(~F.col("_asked"), F.coalesce("status", F.lit("judge_error" if asked else "no_judge"))).when(F.size(accepted) > 0, "success").otherwise("no_equivalences")
    characters = F.least(F.levenshtein("reference", "_a.hypothesis").cast("bigint"), F.col("char_edits"))
    out = done.select(
        "row_key", "language", "word_edits", "words", "char_edits", "chars", status.alias("status"),
        F.when(F.col("_asked"), F.col("_a.word_edits")).when(settled, F.col("word_edits")).alias("semantic_word_edits"),
        F.when(F.col("_asked"), characters).when(settled, F.col("char_edits")).alias("semantic_char_edits"),
        F.size(F.filter(accepted, lambda p: p["type"] == "number")).alias("number_pairs"),
        accepted.alias("accepted"), F.coalesce("_a.rejected", F.array().cast(f"array<{_REJECTED}>")).alias("rejected"),
    )
    return out.withColumns(
        {
            "semantic_wer": F.try_divide(F.col("semantic_word_edits").cast("double"), F.col("words").cast("double")),
            "semantic_cer": F.try_divide(F.col("semantic_char_edits").cast("double"), F.col("chars").cast("double")),
        }
    )


def evaluate(
    df: DataFrame, key: str, reference: str, hypothesis: str, language: str, judge: Judge | str | None = "", model: str = "", options: Settings | None = None
) -> tuple[DataFrame, int]:
    """The whole pipeline: the rows of ``judged``, and the number of questions that the judge failed to answer.

    Which judge (by default the one that the settings name; None asks nobody and uses what is cached), the share that is
    judged, the tolerance of verification and the cache's folder come from the settings. The cache belongs to one model and
    one version of the question.
    """
    options = options or settings()
    judge = options.judge if judge == "" else judge
    model = model or (judge if isinstance(judge, str) else options.judge)
    prepared = prepare(df, key, reference, hypothesis, language, options.judged_share)
    path = options.cache_path("equivalences", model, QUESTION)
    answers, failures = answer_into(questions(prepared), path, model, judge, options.parallel, attempts=options.judge_attempts)
    return judged(prepared, answers, options.least_likeness, options.allow_unverified_numbers, judge is not None), failures


def audited(rows: DataFrame) -> DataFrame:
    """``rows`` of ``judged`` with the pairs accepted and rejected as JSON texts, empty where there are none."""
    shown = {c: F.when(F.size(c) > 0, F.to_json(c)).otherwise("") for c in ("accepted", "rejected")}
    return rows.withColumns(shown)


def verdicts(pairs: DataFrame, least: float = LEAST_LIKENESS, allow_unverified_numbers: bool = False) -> DataFrame:
    """``pairs`` (kind, hypothesis_span, reference_span) with ``accepted`` and ``reason``: spans are normalized, then verified by the rule of their kind."""

    @F.pandas_udf("accepted boolean, reason string")
    def verified(hypotheses: pd.Series, references: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        spans = zip(hypotheses.map(plain_normalize), references.map(plain_normalize), kinds, strict=True)
        return pd.DataFrame([verify_pair(h, r, k, least, allow_unverified_numbers) for h, r, k in spans], columns=["accepted", "reason"])

    found = pairs.withColumn("_v", verified.asNondeterministic()("hypothesis_span", "reference_span", "kind"))
    return found.select(*pairs.columns, "_v.accepted", "_v.reason")


def semantic_score(rows: DataFrame, *by: str) -> DataFrame:
    """Corpus rates: over answered rows only, and over all rows with the lexical edits where there is no answer; and the coverage."""
    answered = F.col("semantic_word_edits").isNotNull()
    units = F.sum(F.when(answered, F.col("words")))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("utterances"),
        F.try_divide(F.sum("semantic_word_edits").cast("double"), units.cast("double")).alias("semantic_wer"),
        F.try_divide(F.sum(F.coalesce("semantic_word_edits", "word_edits")).cast("double"), F.sum("words").cast("double")).alias("semantic_wer_or_lexical"),
        F.try_divide(F.sum("word_edits").cast("double"), F.sum("words").cast("double")).alias("wer"),
        F.avg(answered.cast("int")).alias("coverage"),
        F.sum("number_pairs").alias("number_pairs"),
    )
