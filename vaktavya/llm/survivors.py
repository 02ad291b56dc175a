"""One surviving record per group of duplicates, chosen field by field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaktavya.functions.ids import plain_id

#: Statuses of an attempt that succeeded.
SUCCESS = ("success", "ok")


def blank(text: Column) -> Column:
    """True for null and for texts of blanks and invisible characters only."""
    return F.coalesce(~text.rlike(r"[^\s\p{Z}\p{Cf}]"), F.lit(True))


def survive(
    df: DataFrame,
    keys: Sequence[Column],
    fields: Mapping[str, tuple[Column, Column | None]],
    trust: Sequence[Column],
    least: int = 1,
) -> DataFrame:
    """One row per group of at least ``least`` records, each field taken from its best record.

    ``keys`` are named columns. ``fields`` maps a result column to its value and to the condition
    under which a record may give it (None: whenever it isn't null). ``trust`` orders records from its first column
    on, larger first, null last; it must end in a unique column if ties are to have one answer. A null gives no field, however trusted
    its record is.

    All fields are kept in a single aggregation as the maximum of (trust..., value), so rows are
    combined before the shuffle and a hot group moves one row per task. A field for which no
    record qualifies is null. Records in which a key is null form no group: they name nothing that
    could be repeated. Repeated records count. An empty table gives an empty result.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    flat = {c: (v, v.isNotNull() if when is None else v.isNotNull() & when) for c, (v, when) in fields.items()}
    rows = df.select(
        *(k.alias(n) for k, n in zip(keys, names, strict=True)),
        *(t.alias(f"_t{i}") for i, t in enumerate(trust)),
        *(v.alias(f"_v{i}") for i, (v, _) in enumerate(flat.values())),
        *(F.coalesce(w, F.lit(False)).alias(f"_w{i}") for i, (_, w) in enumerate(flat.values())),
    ).where(" AND ".join(f"{n} IS NOT NULL" for n in names))
    order = [F.col(f"_t{i}") for i in range(len(trust))]

    def best(i: int) -> Column:
        return F.max(F.when(F.col(f"_w{i}"), F.struct(*order, F.col(f"_v{i}"))))

    groups = rows.groupBy(*names).agg(
        F.count(F.lit(1)).alias("_n"), *(best(i).alias(f"_b{i}") for i in range(len(flat)))
    )
    out = groups.where(F.col("_n") >= least)
    return out.select(
        *names, F.col("_n").alias("n_records"), *(F.col(f"_b{i}._v{i}").alias(c) for i, c in enumerate(flat))
    )


def attempt_survivors(predictions: DataFrame, least: int = 1) -> DataFrame:
    """The surviving attempt per utterance and provider.

    Ids are compared in their plain form. Records rank by success with a non-blank prediction, then
    by written_at (null last), then by row_id. status and prediction come from the first that has one that isn't blank,
    written_at from the first that has one, latency_ms from the first with a positive one. prediction_row is the first record,
    latency_row the one that gives the latency, -1 where none is known.
    """
    c = {n: F.col(n) for n in predictions.columns}
    done = F.coalesce(F.lower(F.regexp_replace(c["status"], r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).isin(*SUCCESS), F.lit(False))
    known = (c["latency_ms"] > 0) & ~F.isnan(c["latency_ms"])
    found = survive(
        predictions,
        [plain_id(c["utterance_id"]), c["provider"]],
        {
            "prediction_row": (c["row_id"], None),
            "prediction": (c["prediction"], ~blank(c["prediction"])),
            "status": (c["status"], ~blank(c["status"])),
            "written_at": (c["written_at"], None),
            "latency_row": (c["row_id"], known),
            "latency_ms": (c["latency_ms"], known),
        },
        [done & ~blank(c["prediction"]), c["written_at"], c["row_id"]],
        least,
    )
    return found.withColumnsRenamed({"_k0": "utterance_id", "_k1": "provider"}).withColumn(
        "latency_row", F.coalesce("latency_row", F.lit(-1).cast("bigint"))
    )
