"""Recognisers: an interface, a registry, and a run that resumes."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol, TypedDict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaktavya.sources.speech import need

SUCCESS = "success"
#: Answers of a server after which a call is tried again.
RETRYABLE = (429, 500, 502, 503)
#: Characters of an error that are kept; longest wait between tries.
ERROR_CHARS, LONGEST_WAIT = 300, 8.0
RESULT = "utterance_id string, prediction string, latency_ms double, status string, error string"


class Result(TypedDict):
    """What a recogniser returns for one utterance."""

    prediction: str
    latency_ms: float
    status: str
    error: str | None


@dataclass(frozen=True, slots=True)
class RowContext:
    """What is known of an utterance's language."""

    language_tag: str = ""
    base_language: str = ""
    is_code_mixed: bool = False

    @property
    def language(self) -> str | None:
        return self.language_tag or None


class Recogniser(Protocol):
    """A speech recogniser. It is made once a task, on the executor."""

    def transcribe(self, audio: bytes, row: RowContext) -> str: ...


class TransientError(Exception):
    """A failure after which another try may succeed."""


class HttpError(Exception):
    """An answer with a status code."""

    def __init__(self, code: int, text: str = "") -> None:
        super().__init__(f"{code} {text}".strip())
        self.code = code


def is_transient(error: Exception) -> bool:
    """Whether to try again after a failure."""
    return isinstance(error, (TransientError, TimeoutError, ConnectionError)) or (isinstance(error, HttpError) and error.code in RETRYABLE)


_MAKERS: dict[str, Callable[[], Recogniser]] = {}


def register(name: str, maker: Callable[[], Recogniser]) -> None:
    """Make a recogniser known; ``maker`` may import what it needs when it is called."""
    _MAKERS[name.lower()] = maker


def get_maker(name: str) -> Callable[[], Recogniser]:
    """The maker of a name."""
    if name.lower() not in _MAKERS:
        raise KeyError(f"no recogniser {name!r}; there are {', '.join(sorted(_MAKERS))}")
    return _MAKERS[name.lower()]


class Echo:
    """A recogniser for tests: what it hears is a function of the audio's bytes."""

    def transcribe(self, audio: bytes, row: RowContext) -> str:
        return f"{row.base_language or 'und'} {hashlib.sha1(audio).hexdigest()[:8]}"


register("echo", Echo)


def succeeded(prediction: str, began: float) -> Result:
    """The result of a call that returned."""
    return {"prediction": prediction or "", "latency_ms": round((time.time() - began) * 1000, 1), "status": SUCCESS, "error": None}


def failed(error: str, began: float | None = None, status: str = "error") -> Result:
    """The result of a call that didn't."""
    took = 0.0 if began is None else round((time.time() - began) * 1000, 1)
    return {"prediction": "", "latency_ms": took, "status": status, "error": error[:ERROR_CHARS]}


def call(recogniser: Recogniser, audio: bytes | None, row: RowContext, attempts: int = 2, pause: float = 1.0) -> Result:
    """One utterance's result. Only transient failures are tried again; no failure is raised."""
    if audio is None:
        return failed("audio not found", status="missing_audio")
    began = time.time()
    for attempt in range(max(1, attempts)):
        try:
            return succeeded(recogniser.transcribe(audio, row), began)
        except Exception as error:  # noqa: BLE001 - one utterance must not end the run
            if attempt + 1 >= attempts or not is_transient(error):
                return failed(str(error) or type(error).__name__, began)
            time.sleep(min(pause * 2**attempt, LONGEST_WAIT))
    return failed("no attempt", began)


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """(utterance_id, audio) of the wav files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("utterance_id"), F.col("content").alias("audio"))


def finished(results: DataFrame) -> DataFrame:
    """Ids with a successful result."""
    return results.where(F.col("utterance_id") != "").groupBy("utterance_id").agg(F.bool_or(F.coalesce(F.col("status") == SUCCESS, F.lit(False))).alias("ok")).where("ok").select("utterance_id")


def tallies(results: DataFrame) -> DataFrame:
    """One row: ids that succeeded, and ids that only failed."""
    by_id = results.where(F.col("utterance_id") != "").groupBy("utterance_id").agg(F.bool_or(F.coalesce(F.col("status") == SUCCESS, F.lit(False))).alias("ok"))
    return by_id.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))


def status_counts(results: DataFrame) -> DataFrame:
    """Results by status."""
    return results.groupBy(F.coalesce("status", F.lit("")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def transcribe(
    rows: DataFrame, audio: DataFrame, maker: Callable[[], Recogniser], parallel: int = 8, interval: float = 0.0, attempts: int = 2, pause: float = 1.0
) -> DataFrame:
    """Results for (utterance_id, language, language_tag, is_code_mixed): every utterance once, also those without audio.

    ``parallel`` tasks call at a time; together they keep ``interval`` seconds between calls, each of them
    ``parallel`` times that.
    """
    need(rows, "utterance_id", "language", "language_tag", "is_code_mixed")
    joined = rows.select("utterance_id", "language", "language_tag", "is_code_mixed").join(audio, "utterance_id", "left").repartition(parallel)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recogniser = maker()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                began = time.time()
                known = RowContext(r.language_tag or "", r.language or "", r.is_code_mixed is True)
                out.append({"utterance_id": r.utterance_id, **call(recogniser, r.audio, known, attempts, pause)})
                time.sleep(max(0.0, interval * parallel - (time.time() - began)) if interval else 0)
            yield pd.DataFrame(out, columns=["utterance_id", "prediction", "latency_ms", "status", "error"])

    return joined.mapInPandas(run, RESULT)


def resume(rows: DataFrame, audio: DataFrame, maker: Callable[[], Recogniser], results_path: str, limit: int | None = None, **options: float) -> DataFrame:
    """Transcribe what has no successful result in the table at ``results_path``, append, and return all results."""
    spark = rows.sparkSession
    try:
        done = finished(spark.read.schema(RESULT).parquet(results_path))
        todo = rows.join(done, "utterance_id", "left_anti")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        todo = rows
    if limit is not None:
        todo = todo.orderBy("utterance_id").limit(limit)
    transcribe(todo, audio, maker, **options).write.mode("append").parquet(results_path)
    return spark.read.schema(RESULT).parquet(results_path)
