"""Judges that propose pairs, and the cache of their answers."""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Version of the question: part of every key, so that answers to another question are never reused.
QUESTION = "equivalence-1"
PAIRS = "array<struct<hypothesis_span string, reference_span string, type string>>"
PROMPT = (
    "Two transcripts of one utterance follow, a reference and a hypothesis. List pairs of spans that are the same spoken words "
    "written in two ways: in another script, in another spelling, split or joined, as number words or digits, or a hesitation that one "
    "side lacks. List nothing that was misheard. Answer with equivalences of hypothesis_span, reference_span and type."
)


def question_text(reference: str, hypothesis: str, language: str) -> str:
    """The question as a text, for judges that read one: the task, then the two transcripts as JSON."""
    return f"{PROMPT}\n\n{json.dumps({'language': language, 'reference': reference, 'hypothesis': hypothesis}, ensure_ascii=False)}"


def text_judge(complete: Callable[[str], str]) -> Judge:
    """A judge from a function that answers a text with a JSON object; pairs without the three texts are left out.

    An answer that isn't such an object raises, and so counts as a failure.
    """

    def judge(reference: str, hypothesis: str, language: str) -> list[dict[str, str]]:
        pairs = json.loads(complete(question_text(reference, hypothesis, language)))["equivalences"]
        names = ("hypothesis_span", "reference_span", "type")
        return [{n: p[n] for n in names} for p in pairs if all(isinstance(p.get(n), str) for n in names)]

    return judge


#: A judge takes (reference, hypothesis, language) and returns pairs; it may raise.
Judge = Callable[[str, str, str], list[dict[str, str]]]
_JUDGES: dict[str, Judge] = {}


def register_judge(name: str, judge: Judge) -> None:
    """Make a judge known by name; it must be picklable."""
    _JUDGES[name] = judge


def get_judge(name: str) -> Judge:
    """The judge of a name."""
    if name not in _JUDGES:
        raise KeyError(f"no judge {name!r}; there are {', '.join(sorted(_JUDGES)) or 'none'}")
    return _JUDGES[name]


def silent(reference: str, hypothesis: str, language: str) -> list[dict[str, str]]:
    """A judge that proposes nothing."""
    return []


register_judge("silent", silent)


def identity(*fields: Column) -> Column:
    """SHA-1 of the fields, joined by the unit separator; null counts as empty."""
    return F.sha1(F.concat_ws("\x1f", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)).cast("binary"))


def sampled_in(row_id: Column, share: float) -> Column:
    """A fixed sample by row id: the first four bytes of its SHA-1, as a share of their range, are below ``share``."""
    first = F.conv(F.substring(F.sha1(F.coalesce(row_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10)
    return F.lit(True) if share >= 1 else first.cast("bigint") / F.lit(4294967295) < share


def latest_answers(cache: DataFrame, key: str = "cache_key", order: str = "cached_at") -> DataFrame:
    """One answer for each key, the last one; answers that are null count only if there is no other."""
    ranked = F.struct(F.col("response").isNotNull(), F.col(order))
    return cache.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("cache_key")).agg(F.max_by("response", ranked).alias("response"))


def load_json_cache(spark, path: str) -> DataFrame:
    """Answers in JSON lines (key, model, response); blank and torn lines are skipped, a later line of a file wins."""
    schema = f"key string, model string, response struct<equivalences: {PAIRS}>, _corrupt string"
    rows = spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    ordered = rows.withColumn("cached_at", F.monotonically_increasing_id())
    return latest_answers(ordered.where("_corrupt IS NULL AND key IS NOT NULL").withColumnRenamed("key", "cache_key"))


def with_retry(call: Callable[[], list[dict[str, str]]], attempts: int = 4, pause: float = 1.0, longest: float = 60.0) -> list[dict[str, str]]:
    """The call's result; waits twice as long after each failure, with jitter, and raises the last failure."""
    for attempt in range(attempts):
        try:
            return call()
        except Exception:
            if attempt == attempts - 1:
                raise
            time.sleep(min(longest, pause * 2**attempt) * (0.5 + random.random() / 2))
    return []


def ask(pending: DataFrame, judge: Judge, parallel: int = 8, attempts: int = 4, pause: float = 1.0) -> DataFrame:
    """Answers (cache_key, response, failure) to (cache_key, reference, hypothesis, language), each key once.

    ``parallel`` bounds the calls at a time. A failed call gives a null response and its failure.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    pairs = with_retry(lambda r=r: judge(r.reference, r.hypothesis, r.language), attempts, pause)
                    rows.append((r.cache_key, {"equivalences": pairs}, None))
                except Exception as error:  # noqa: BLE001 - a failed answer is a result
                    rows.append((r.cache_key, None, f"{type(error).__name__}: {error}"[:300]))
            yield pd.DataFrame(rows, columns=["cache_key", "response", "failure"])

    once = pending.select("cache_key", "reference", "hypothesis", "language").dropDuplicates(["cache_key"]).repartition(parallel)
    return once.mapInPandas(run, f"cache_key string, response struct<equivalences: {PAIRS}>, failure string")


def pending_questions(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """Questions without an answer, each key once."""
    return questions.dropDuplicates(["cache_key"]).join(cache.where("response IS NOT NULL").select("cache_key"), "cache_key", "left_anti")


def answer_into(questions: DataFrame, cache_path: str, model: str, judge: Judge | str | None, parallel: int = 8, **retry: float) -> tuple[DataFrame, int]:
    """Ask what the table at ``cache_path`` lacks, append the answers there; the whole cache, and the number of questions that failed.

    ``judge`` is one, its name, or None to use what is there only. Answers are written before they are used, so a later failure
    doesn't ask again. Failures are written beside them, without a response and with their text, and are asked again next time.
    """
    spark = questions.sparkSession
    schema = f"cache_key string, model string, response struct<equivalences: {PAIRS}>, failure string, cached_at timestamp"
    run = uuid.uuid4().hex

    def known() -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{cache_path}/run=*").where(F.col("model") == model)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return spark.createDataFrame([], schema)

    def answered() -> DataFrame:
        return latest_answers(known().where("response IS NOT NULL"))

    if judge is not None:
        judge = get_judge(judge) if isinstance(judge, str) else judge
        asked = ask(pending_questions(questions, answered()), judge, parallel, **retry)
        fresh = asked.select("cache_key", F.lit(model).alias("model"), "response", "failure", F.current_timestamp().alias("cached_at"))
        # a folder for each run: a run that is started again after a crash finds what was answered before
        fresh.write.parquet(f"{cache_path}/run={run}")
        failures = spark.read.schema(schema).parquet(f"{cache_path}/run={run}").where("response IS NULL").count()
        return answered(), failures
    return answered(), 0
