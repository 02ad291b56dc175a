"""Reference transcripts and system predictions: scans, checks, alignment."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaktavya.plans.session import settled

#: Languages with a folder of their own, and the columns of a release.
LANGUAGES = {
    "bengali": "bn", "english": "en", "gujarati": "gu", "hindi": "hi", "kannada": "kn", "malayalam": "ml", "marathi": "mr", "tamil": "ta", "telugu": "te",
}
RELEASE = T.StructType(
    [
        T.StructField("utterance_id", T.StringType()),
        T.StructField("call_id", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("language_tag", T.StringType()),
        T.StructField("is_code_mixed", T.BooleanType()),
        T.StructField("duration_sec", T.DoubleType()),
        T.StructField("domain", T.StringType()),
        T.StructField("transcription", T.StringType()),
        T.StructField("transcription_normalized", T.StringType()),
        T.StructField("keywords", T.StringType()),
    ]
)
PREDICTION_FIELDS = ("utterance_id", "prediction", "latency_ms", "status", "error")
SUCCESS = ("success", "ok")


class MissingColumn(KeyError):
    """A column that an operator needs isn't there."""


class DuplicateIds(ValueError):
    """Several rows remain for one utterance."""


class MissingPredictions(ValueError):
    """Utterances without a prediction."""


def need(df: DataFrame, *columns: str) -> None:
    """Raise MissingColumn, naming the available ones, unless ``df`` has ``columns``."""
    if lost := [c for c in columns if c not in df.columns]:
        raise MissingColumn(f"no column {', '.join(lost)}; there are {', '.join(df.columns)}")


def load_release(spark: SparkSession, folder: str, config: str = "all", with_audio: bool = False, revision: str | None = None) -> DataFrame:
    """The shards ``<language>/test-*.parquet`` below ``folder``, of one language or all; a name that ends with .parquet is read as it is.

    ``revision`` names a folder between: a release that is kept in several versions.

    Only the columns of RELEASE are read, and ``audio`` if asked for. An unknown config raises ValueError,
    a folder without shards FileNotFoundError.
    """
    if config != "all" and config not in LANGUAGES:
        raise ValueError(f"unknown config {config!r}; there are all, {', '.join(LANGUAGES)}")
    root = folder.rstrip("/") + (f"/{revision}" if revision else "")
    pattern = root if root.endswith(".parquet") else f"{root}/{'*' if config == 'all' else config}/test-*.parquet"
    try:
        df = spark.read.parquet(pattern)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no shard matches {pattern}") from error
        raise
    need(df, *RELEASE.fieldNames())
    return df.select(*RELEASE.fieldNames(), *(["audio"] if with_audio else []))


def _breaks_inside_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a line of a CSV file holds an odd number of quotes, so that a record goes on in the next line."""
    lines = spark.read.text(path)
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    return bool(lines.where(odd).limit(1).count())


def scan_predictions(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A predictions file: parquet by suffix, else CSV with a header, all text unless ``schema`` is given.

    Text such as ``nan`` or ``NA`` stays text. A file without a column ``attempt`` gets one: the place of each row
    by file name and position in the file. Only a CSV with line breaks inside of quotes is read by one task a file.
    """
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        # the file's metadata isn't to be had after a projection, so it is taken here
        return df if "attempt" in df.columns else df.withColumn("attempt", F.struct("_metadata.file_path", "_metadata.row_index"))
    whole = _breaks_inside_quotes(spark, path)
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=whole, inferSchema=False, schema=schema)
    if "attempt" in df.columns:
        return df
    return df.withColumn("attempt", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")))


def succeeded(status: Column) -> Column:
    """Whether a status names success; null doesn't."""
    return F.coalesce(F.lower(status).isin(*SUCCESS), F.lit(False))


def best_attempts(df: DataFrame, id_column: str | Sequence[str] = "utterance_id", order: str = "attempt", columns: Sequence[str] | None = None) -> DataFrame:
    """One row for each id: the last successful attempt, or else the last one. Without a ``status`` column, ``df`` itself.

    ``id_column`` names one column or several; ``order`` one that tells attempts apart by time, null before all others. Rows are
    combined before the shuffle, so a hot id sends one a task, and only the id and ``columns`` (all unless given) travel. Where
    the order is the only one of these and a number, two maxima do and hashing takes the place of sorting.
    """
    ids = [id_column] if isinstance(id_column, str) else list(id_column)
    need(df, *ids)
    if "status" not in df.columns:
        return df if columns is None else df.select(*dict.fromkeys([*ids, *columns]))
    need(df, order, *(columns or ()))
    wanted = [c for c in (df.columns if columns is None else columns) if c not in ids]
    ok = succeeded(F.col("status"))
    if wanted == [order] and isinstance(df.schema[order].dataType, T.IntegralType):
        last = F.coalesce(F.max(F.when(ok, F.col(order))), F.max(order))
        return df.groupBy(*ids).agg(last.alias(order))
    best = F.max_by(F.struct(*wanted), F.struct(ok, F.col(order))) if wanted else F.max(ok)
    out = df.groupBy(*ids).agg(best.alias("_best"))
    names = [c for c in (df.columns if columns is None else dict.fromkeys([*ids, *columns]))]
    return out.select(*(F.col(c) if c in ids else F.col(f"_best.{c}") for c in names))


def repeated_ids(df: DataFrame, id_column: str = "utterance_id") -> DataFrame:
    """Ids that stand in more than one row, with the number of rows."""
    return df.groupBy(id_column).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def check_unique(df: DataFrame, id_column: str = "utterance_id") -> DataFrame:
    """``df`` if its ids are unique; otherwise DuplicateIds names three."""
    if found := repeated_ids(df, id_column).orderBy(id_column).limit(3).collect():
        raise DuplicateIds("several rows for " + ", ".join(str(r[0]) for r in found))
    return df


def load_predictions(
    spark: SparkSession, path: str, id_column: str = "utterance_id", text_column: str = "prediction"
) -> DataFrame:
    """(utterance_id, prediction): the best attempt of each utterance, the last of equal ones by ``attempt`` or place in the file.

    Missing text is empty. Repeats without a status raise.
    """
    raw = scan_predictions(spark, path)
    need(raw, id_column, text_column)
    best = check_unique(best_attempts(raw, id_column, columns=[text_column]), id_column)
    return best.select(F.col(id_column).alias("utterance_id"), F.coalesce(F.col(text_column), F.lit("")).alias("prediction"))


def missing_predictions(release: DataFrame, predictions: DataFrame) -> DataFrame:
    """Utterances of the release without a prediction."""
    return release.join(predictions.select("utterance_id"), "utterance_id", "left_anti")


def align(release: DataFrame, predictions: DataFrame, require_complete: bool = True) -> DataFrame:
    """The release with ``prediction``: a left join that drops no utterance and ignores predictions beyond the release.

    A missing prediction raises MissingPredictions, naming three, or is the empty text if
    ``require_complete`` is false. Which side is broadcast, if any, is left to the size that the optimizer sees.
    """
    need(release, "utterance_id")
    need(predictions, "utterance_id", "prediction")
    if require_complete and (lost := missing_predictions(release, predictions).select("utterance_id").limit(3).collect()):
        raise MissingPredictions("no prediction for " + ", ".join(str(r[0]) for r in lost))
    side = predictions.select("utterance_id", "prediction")
    return release.join(side, "utterance_id", "left").withColumn("prediction", F.coalesce("prediction", F.lit("")))


def tag_codes(tag: Column) -> Column:
    """Distinct codes of a language tag, whatever its case, order and joining mark."""
    parts = F.split(F.translate(F.lower(F.trim(F.coalesce(tag, F.lit("")))), "_", "-"), "-")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda c: c != "")))


def without_languages(df: DataFrame, any_of: tuple[str, ...] = (), exactly: tuple[tuple[str, ...], ...] = ()) -> DataFrame:
    """Rows whose languages, base and tag together, have none of ``any_of`` and aren't just one of the sets ``exactly``."""
    base = F.lower(F.trim(F.coalesce("language", F.lit(""))))
    codes = F.array_sort(F.array_distinct(F.when(base == "", tag_codes(F.col("language_tag"))).otherwise(F.concat(tag_codes(F.col("language_tag")), F.array(base)))))
    keep = F.lit(True)
    if any_of:
        keep = keep & ~F.arrays_overlap(codes, F.array(*map(F.lit, any_of)))
    for one in exactly:
        keep = keep & (codes != F.array(*map(F.lit, sorted(one))))
    return df.where(keep)


#: Languages that a recogniser can't do, by its id: any of these codes, or exactly one of these sets.
UNSUPPORTED: dict[str, dict[str, tuple]] = {
    "deepgram": {"any_of": ("ml",)},
    "gemini_realtime": {"exactly": (("hi", "mr"),)},
}


def load_unsupported(path: str | Path) -> dict[str, dict[str, tuple]]:
    """A table like UNSUPPORTED from a JSON file."""
    rules = json.loads(Path(path).read_text(encoding="utf-8"))
    return {name: {"any_of": tuple(r.get("any_of", ())), "exactly": tuple(map(tuple, r.get("exactly", ())))} for name, r in rules.items()}


def supported_rows(df: DataFrame, provider: str, rules: dict[str, dict[str, tuple]] | None = None) -> DataFrame:
    """The rows whose languages a recogniser can do; a recogniser without an entry in ``rules`` keeps all."""
    return without_languages(df, **(UNSUPPORTED if rules is None else rules).get((provider or "").strip().lower(), {}))


def first_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows in an order: a top-k, not a sort of everything."""
    return df.orderBy(*order).limit(n)


def batches(df: DataFrame, key: Column, size: int, order: Column) -> DataFrame:
    """``df`` with ``batch``, numbering groups of at most ``size`` rows of one key from 0, in ``order``; a null key is one too.

    Rows are cut into ranges of key and order, so a key with most of the rows is spread over many tasks. A row's number is its place in its
    range after the sizes of the key's ranges before, a table of one row for each key and range. The ranges are kept in the checkpoint
    folder, since numbers and sizes must be of the same ones.
    """
    ranged = df.withColumns({"_k": key, "_o": order}).repartitionByRange("_k", "_o").sortWithinPartitions("_k", "_o")
    kept = settled(ranged.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    ranges = kept.groupBy("_k", "_p").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select(F.col("_k").alias("_sk"), F.col("_p").alias("_sp"), (before - F.col("_first")).alias("_shift"))
    placed = kept.join(starts, (F.col("_p") == F.col("_sp")) & F.col("_k").eqNullSafe(F.col("_sk")))
    return placed.withColumn("batch", F.floor((F.col("_i") + F.col("_shift")) / size).cast("bigint")).select(*df.columns, "batch")


#: Languages that a recogniser can't do, by its id: any of these codes, or exactly one of these sets.
UNSUPPORTED: dict[str, dict[str, tuple]] = {
    "deepgram": {"any_of": ("ml",)},
    "gemini_realtime": {"exactly": (("hi", "mr"),)},
}


def load_unsupported(path: str | Path) -> dict[str, dict[str, tuple]]:
    """A table like UNSUPPORTED from a JSON file."""
    rules = json.loads(Path(path).read_text(encoding="utf-8"))
    return {name: {"any_of": tuple(r.get("any_of", ())), "exactly": tuple(map(tuple, r.get("exactly", ())))} for name, r in rules.items()}


def supported_rows(df: DataFrame, provider: str, rules: dict[str, dict[str, tuple]] | None = None) -> DataFrame:
    """The rows whose languages a recogniser can do; a recogniser without an entry in ``rules`` keeps all."""
    return without_languages(df, **(UNSUPPORTED if rules is None else rules).get((provider or "").strip().lower(), {}))


def first_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows in an order: a top-k, not a sort of everything."""
    return df.orderBy(*order).limit(n)


def batches(df: DataFrame, key: Column, size: int, order: Column) -> DataFrame:
    """``df`` with ``batch``, numbering groups of at most ``size`` rows of one key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("batch", F.floor((place - 1) / size).cast("bigint"))
