"""Delimited records that may be damaged: sound ones as typed rows, the others with a reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaktavya.functions.bind import let
from vaktavya.plans.session import settled

#: Marks a cut between fields. A text that holds the mark itself is escaped first.
_CUT, _ESC = "\x1fc", "\x1fe"

#: The columns of a runner's output file, and the names a status may have.
FIELDS = ("utterance_id", "prediction", "latency_ms", "status", "error")
STATUSES = ("success", "ok", "error", "timeout", "rate_limited", "missing_audio")

#: Size up to which the dictionary of invalid values is broadcast.
DICTIONARY_BYTES = 8_000_000

#: What a value is cast to, by column, and the reason of one that has no cast. A column without an entry takes anything.
#: A number must also be written plainly: a cast alone would take signs, exponents, blanks and NaN.
CASTS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "utterance_id": ("bad_utterance_id", lambda v: F.when(v.rlike(r"\Ac[0-9]+_t[0-9]+\z"), v)),
    "latency_ms": (
        "bad_latency_ms",
        lambda v: F.when(v == "", "").otherwise(F.when(v.rlike(r"\A[0-9]+(?:\.[0-9]+)?\z"), v.try_cast("double").cast("string"))),
    ),
    "status": ("bad_status", lambda v: F.when(F.lower(v).isin(*STATUSES), F.lower(v))),
}


def split_record(raw: Column) -> Column:
    """(fields, fault): the fields of a record and its structural fault, or null.

    Cutting at the quotes makes text outside and inside of quotes alternate, so one pass
    finds quotes that don't open or close a whole field, without a backtracking pattern.
    """

    def read(parts: Column) -> Column:
        last = F.size(parts) - 1

        def stray(part: Column, i: Column) -> Column:
            # an empty part between two quoted ones is a doubled quote
            opens = (i == last) | (part == "") | part.endswith(",")
            closes = (i == 0) | (part == "") | part.startswith(",")
            return (i % 2 == 0) & ~(opens & closes)

        joined = F.array_join(
            F.transform(
                parts,
                lambda p, i: F.when(i % 2 == 1, p)
                .when((p == "") & (i > 0) & (i < last), F.lit('"'))
                .otherwise(F.replace(p, F.lit(","), F.lit(_CUT))),
            ),
            "",
        )
        fields = F.transform(F.split(joined, _CUT, -1), lambda f: F.replace(f, F.lit(_ESC), F.lit("\x1f")))
        fault = (
            F.when(last % 2 == 1, "unclosed_quote")
            .when(F.exists(F.transform(parts, stray), lambda bad: bad), "text_outside_quotes")
            .when(F.exists(F.transform(parts, lambda p, i: (i % 2 == 0) & p.rlike("[\\r\\n]")), lambda bad: bad), "line_break_outside_quotes")
        )
        return F.struct(fields.alias("fields"), fault.alias("fault"))

    return F.when(raw.isNotNull(), let(F.split(F.replace(raw, F.lit("\x1f"), F.lit(_ESC)), '"', -1), read))


def invalid_values(parsed: DataFrame, casts: dict[str, tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """Rows (c, v, reason): of the distinct values ``v`` of each checked column ``c``, each cast once, those without a cast.

    The cast depends on the number of the value's occurrences, which only the aggregation knows. Otherwise the optimizer
    would move it below the aggregation and cast every record's value. It is part of a generator, which drops values
    as it computes reasons; a filter beside a projection would cast again what it lets through.
    """
    checked = F.explode(F.array(*(F.struct(F.lit(name).alias("c"), F.col(f"_{name}").alias("v")) for name in casts)))
    values = parsed.where("_fault IS NULL").select(checked.alias("_x")).groupBy("_x.c", "_x.v").agg(F.count(F.lit(1)).alias("_n"))
    reason = F.lit(None).cast("array<string>")
    for name, (why, cast) in casts.items():
        reason = F.when((F.col("_n") > 0) & (F.col("c") == name), F.when(cast(F.col("v")).isNull(), F.array(F.lit(why)))).otherwise(reason)
    return values.select("c", "v", F.explode(reason).alias("reason"))


def parse_records(
    df: DataFrame, raw: str = "raw_line", key: str = "line_id", casts: dict[str, tuple[str, Callable[[Column], Column]]] | None = None
) -> DataFrame:
    """Every record of ``df`` once: its key, the five typed fields, and ``reason``.

    ``reason`` is null for a sound record; otherwise it names the first fault, structure before
    values, and the typed fields are null. Each distinct value of a checked column is cast
    once: those without a cast form a dictionary with reasons, which is kept and joined back to the records. It is
    broadcast if it measures at most DICTIONARY_BYTES; beyond, a shuffle join with skew splitting takes over.

    Null records are ``no_record``, empty ones ``wrong_column_count``. Repeated records are kept,
    other columns of ``df``, whatever their names, don't come out.
    """
    casts = CASTS if casts is None else casts
    source = df.select(F.col(key).alias("_key"), F.col(raw).alias("_raw"))
    read = source.select("_key", split_record(F.col("_raw")).alias("_s"))
    fault = F.when(F.col("_s").isNull(), "no_record").otherwise(F.coalesce("_s.fault", F.when(F.size("_s.fields") != len(FIELDS), "wrong_column_count")))
    parsed = read.select("_key", F.col("_s.fields").alias("_f"), fault.alias("_fault"))
    parsed = parsed.select(
        "_key", "_fault", *(F.when(F.col("_fault").isNull(), F.get("_f", F.lit(i))).alias(f"_{c}") for i, c in enumerate(FIELDS))
    )
    dictionary = settled(invalid_values(parsed, casts))
    small = dictionary.agg(F.coalesce(F.sum(F.length("v") + 40), F.lit(0))).first()[0] <= DICTIONARY_BYTES
    for name in casts:
        side = dictionary.where(F.col("c") == name).select(F.col("v").alias(f"_bad_{name}"), F.col("reason").alias(f"_why_{name}"))
        parsed = parsed.join(F.broadcast(side) if small else side, F.col(f"_{name}") == F.col(f"_bad_{name}"), "left").drop(f"_bad_{name}")
    out = parsed.withColumn("_reason", F.coalesce("_fault", *(F.col(f"_why_{name}") for name in casts)))
    sound = F.col("_reason").isNull()
    typed = {"latency_ms": F.expr("try_cast(nullif(_latency_ms, '') as double)"), "status": F.lower("_status")}
    return out.select(
        F.col("_key").alias(key),
        *(F.when(sound, typed.get(c, F.col(f"_{c}"))).alias(c) for c in FIELDS),
        F.col("_reason").alias("reason"),
    )


def sound_records(df: DataFrame, raw: str = "raw_line", key: str = "line_id") -> DataFrame:
    """The sound records as typed rows."""
    return parse_records(df, raw, key).where(F.col("reason").isNull()).drop("reason")


def damaged_records(df: DataFrame, raw: str = "raw_line", key: str = "line_id") -> DataFrame:
    """Key and reason of the records that aren't sound."""
    return parse_records(df, raw, key).where(F.col("reason").isNotNull()).select(key, "reason")
