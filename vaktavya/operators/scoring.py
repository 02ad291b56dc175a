"""Row counts, corpus rates, groups, and intervals that resample calls.

A corpus rate is the sum of edits over the sum of reference units, never a mean of row rates. An
empty hypothesis is a full deletion and is never dropped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaktavya.functions.kernel import row_forms
from vaktavya.functions.keywords import raw_items
from vaktavya.functions.normalize import with_normal_forms
from vaktavya.sources.speech import need

COUNTS = ("w_edits", "w_units", "c_edits", "c_units", "m_edits", "m_units", "kw_hits", "kw_total", "empty_hyp")
#: Edits and units of each metric. The keyword rate is one minus hits over keywords.
METRICS = {"wer": ("w_edits", "w_units"), "cer": ("c_edits", "c_units"), "mer": ("m_edits", "m_units"), "kwer": ("kw_hits", "kw_total")}
#: Defaults of the intervals.
SEED, RESAMPLES, ALPHA = 20260916, 1000, 0.05
#: Calls up to which resamples are drawn on the driver.
DRAWN_CALLS = 100_000


def row_counts(df: DataFrame, keywords: bool = True) -> DataFrame:
    """``df`` (transcription, prediction, keywords) with the nine counts of each row.

    Texts visit Python once and come back as normal forms and as one character a unit; all metrics share them, and the built-in
    distance counts edits. Null texts count as empty ones; a
    reference that normalizes to nothing has no units and leaves the rates. ``empty_hyp`` counts predictions
    that are blank before normalization. Without ``keywords`` the keyword counts are 0.
    """
    need(df, "transcription", "prediction", *(["keywords"] if keywords else []))
    staged = df.withColumn("_n", row_forms(F.col("transcription"), F.col("prediction"), F.col("keywords") if keywords else None))
    edits = lambda r, h: F.when(F.length(f"_n.{r}") == 0, 0).otherwise(F.levenshtein(f"_n.{r}", f"_n.{h}")).cast("bigint")
    blank = F.coalesce(F.col("prediction").rlike(r"^[\s\p{Z}]*$"), F.lit(True))
    found = []
    for metric, (r, h) in {"w": ("rw", "hw"), "c": ("r", "h"), "m": ("rm", "hm")}.items():
        found += [edits(r, h).alias(f"{metric}_edits"), F.length(f"_n.{r}").cast("bigint").alias(f"{metric}_units")]
    return staged.select(*df.columns, *found, F.col("_n.hits").alias("kw_hits"), F.col("_n.scored").alias("kw_total"), blank.cast("bigint").alias("empty_hyp"))


def rate(metric: str) -> Column:
    """A corpus rate from sums; null where there is nothing to divide by."""
    edits, units = METRICS[metric]
    share = F.try_divide(F.sum(edits).cast("double"), F.sum(units).cast("double"))
    return 1 - share if metric == "kwer" else share


def figures() -> list[Column]:
    """The eight figures of a score."""
    return [
        F.count(F.lit(1)).alias("utterances"),
        F.sum("w_units").alias("reference_words"),
        *(rate(m).alias(m) for m in METRICS),
        F.sum("kw_total").alias("keywords_scored"),
        F.sum("empty_hyp").alias("empty_hypotheses"),
    ]


def score(counts: DataFrame) -> DataFrame:
    """One row: the score of everything."""
    return counts.agg(*figures())


def score_by(counts: DataFrame, column: str) -> DataFrame:
    """A score for each value of a column; rows where it is null are left out."""
    need(counts, column)
    return counts.where(F.col(column).isNotNull()).groupBy(column).agg(*figures())


def score_sets(counts: DataFrame, *columns: str) -> DataFrame:
    """Overall score and a score by each of ``columns`` in one pass: (breakdown, value, figures).

    Grouping sets over the row counts; ``breakdown`` is null for the overall row. Rows with a null in a
    column are left out of that breakdown only.
    """
    need(counts, *columns)
    names = [f"_g{i}" for i in range(len(columns))]
    rows = counts.select(*COUNTS, *(F.col(c).cast("string").alias(n) for c, n in zip(columns, names, strict=True)))
    sets = [[], *([F.col(n)] for n in names)]
    out = rows.groupingSets(sets, *names).agg(F.grouping_id().alias("_id"), *figures())
    full = (1 << len(names)) - 1
    # a set's bit is 0 in grouping_id for the column that it groups by, the first column's bit leftmost
    bits = [full ^ (1 << (len(names) - 1 - i)) for i in range(len(names))]
    breakdown, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for bit, column, name in zip(bits, columns, names, strict=True):
        breakdown = F.when(F.col("_id") == bit, column).otherwise(breakdown)
        value = F.when(F.col("_id") == bit, F.col(name)).otherwise(value)
    shaped = out.select(breakdown.alias("breakdown"), value.alias("value"), *[c for c in out.columns if c not in (*names, "_id")])
    return shaped.where("breakdown IS NULL OR value IS NOT NULL")


def call_totals(counts: DataFrame) -> DataFrame:
    """Sums of the counts by call."""
    need(counts, "call_id")
    return counts.where("call_id IS NOT NULL").groupBy("call_id").agg(*(F.sum(c).alias(c) for c in COUNTS))


def poisson_weights(call_hashes: np.ndarray, n_boot: int, seed: int) -> np.ndarray:
    """Weights (calls, resamples): how often a call stands in a resample, by a hash of both.

    The hash mixes 32 bits by shifts and products; where it falls among the cumulated probabilities of a Poisson
    variable of mean 1 is the weight.
    """
    mask = np.uint64(0xFFFFFFFF)
    boots = (np.arange(n_boot, dtype=np.uint64) * np.uint64(0x9E3779B9) + np.uint64(seed)) & mask
    h = call_hashes.astype(np.uint64)[:, None] ^ boots[None, :]
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = ((h ^ (h >> np.uint64(shift))) * np.uint64(factor)) & mask
    return np.searchsorted(POISSON_BOUNDS, h, side="right").astype(np.int64)


#: Cumulated probabilities of a Poisson variable of mean 1, times 2^32; a weight beyond 12 is less likely than the hash can tell.
POISSON_BOUNDS = np.array([int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)], dtype=np.uint64)


def weighted_sums(totals: DataFrame, columns: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """(boot_id, columns): the sums of each resample, each call weighed by ``poisson_weights``.

    A task adds up its calls for all resamples at once and sends ``n_boot`` rows, however many calls it has.
    """
    import pandas as pd

    hashed = totals.select(F.conv(F.substring(F.sha1(F.col("call_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint").alias("_h"), *columns)

    def run(batches):
        sums = np.zeros((n_boot, len(columns)), np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                sums += poisson_weights(part["_h"].to_numpy(), n_boot, seed).T @ part[list(columns)].to_numpy(np.int64)
        yield pd.DataFrame({"boot_id": np.arange(n_boot), **{c: sums[:, i] for i, c in enumerate(columns)}})

    parts = hashed.mapInPandas(run, ", ".join(["boot_id bigint", *(f"{c} bigint" for c in columns)]))
    return parts.groupBy("boot_id").agg(*(F.sum(c).alias(c) for c in columns))


def _percentiles(values: DataFrame, alpha: float) -> DataFrame:
    both = F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return values.agg(both.alias("_p")).select(F.get("_p", F.lit(0)).alias("low"), F.get("_p", F.lit(1)).alias("high"))


def _few(totals: DataFrame, columns: Sequence[str], calls: int) -> np.ndarray | None:
    """The sums of each call, in order of its id, if there are at most ``calls``."""
    rows = totals.select("call_id", *columns).limit(calls + 1).collect()
    return None if len(rows) > calls else np.array([r[1:] for r in sorted(rows, key=lambda r: str(r[0]))], np.int64).reshape(-1, len(columns))


def _resampled(sums: np.ndarray, n_boot: int, seed: int) -> np.ndarray:
    """Sums (resamples, columns): every resample draws as many calls as there are, with replacement, from one seeded generator."""
    draw = np.random.default_rng(seed)
    return np.array([sums[draw.integers(0, len(sums), len(sums))].sum(0) for _ in range(n_boot)])


def _limits(values: np.ndarray, alpha: float) -> tuple[float | None, float | None]:
    known = values[np.isfinite(values)]
    return tuple(np.percentile(known, [100 * alpha / 2, 100 - 100 * alpha / 2]).tolist()) if len(known) else (None, None)


def bootstrap_ci(
    counts: DataFrame, metric: str = "wer", n_boot: int = RESAMPLES, seed: int = SEED, alpha: float = ALPHA, drawn_calls: int = DRAWN_CALLS
) -> DataFrame:
    """(low, high): percentile interval of a corpus rate under resampling of whole calls; nulls if there is nothing to rate.

    Calls are summed once. Sums of at most ``drawn_calls`` calls are resampled on the driver from one seeded generator, in order of
    the calls' ids, so that an interval equals one that is published with its seed. More calls, or all with
    ``drawn_calls`` 0, are weighed by Poisson variables where they are; the sum of weights then varies, which changes a rate's
    interval by less than the draw of another seed does. Resamples without units are skipped.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; there are {', '.join(METRICS)}")
    edits, units = METRICS[metric]
    totals = call_totals(counts).select("call_id", F.col(edits).alias("e"), F.col(units).alias("u"))
    few = _few(totals, ("e", "u"), drawn_calls) if drawn_calls else None
    if few is not None:
        with np.errstate(all="ignore"):
            e, u = _resampled(few, n_boot, seed).T if len(few) else np.zeros((2, 1))
            values = e / u
        low, high = _limits(1 - values if metric == "kwer" else values, alpha)
        return counts.sparkSession.createDataFrame([(low, high)], "low double, high double")
    ratio = F.try_divide(F.col("e").cast("double"), F.col("u").cast("double"))
    return _percentiles(weighted_sums(totals, ("e", "u"), n_boot, seed).select((1 - ratio if metric == "kwer" else ratio).alias("value")), alpha)


def paired_delta_ci(
    counts_a: DataFrame, counts_b: DataFrame, metric: str = "wer", n_boot: int = RESAMPLES, seed: int = SEED, alpha: float = ALPHA,
    drawn_calls: int = DRAWN_CALLS,
) -> DataFrame:
    """(delta, low, high): rate of B minus rate of A over the calls of both, and its interval on the same resamples for both.

    Resamples are drawn or weighed as in ``bootstrap_ci``. Nulls where there is no common call or no unit.
    """
    if metric not in METRICS or metric == "kwer":
        raise ValueError(f"unknown metric {metric!r}; there are wer, cer, mer")
    edits, units = METRICS[metric]
    columns = ("ea", "ua", "eb", "ub")
    side = lambda df, x: call_totals(df).select("call_id", F.col(edits).alias(f"e{x}"), F.col(units).alias(f"u{x}"))
    totals = side(counts_a, "a").join(side(counts_b, "b"), "call_id")
    few = _few(totals, columns, drawn_calls) if drawn_calls else None
    if few is not None:
        with np.errstate(all="ignore"):
            both = np.vstack([few.sum(0), *(_resampled(few, n_boot, seed) if len(few) else ())]).T
            delta, *values = both[2] / both[3] - both[0] / both[1]
        row = (float(delta) if np.isfinite(delta) else None, *_limits(np.array(values), alpha))
        return counts_a.sparkSession.createDataFrame([row], "delta double, low double, high double")
    ratio = lambda x: F.try_divide(F.col(f"e{x}").cast("double"), F.col(f"u{x}").cast("double"))
    observed = totals.agg(*(F.sum(c).alias(c) for c in columns)).select((ratio("b") - ratio("a")).alias("delta"))
    interval = _percentiles(weighted_sums(totals, columns, n_boot, seed).select((ratio("b") - ratio("a")).alias("value")), alpha)
    both = interval.select(F.struct("low", "high")).scalar()
    return observed.select("delta", both.alias("_b")).select("delta", "_b.low", "_b.high")


def corpus_facts(release: DataFrame, short: float = 2.0) -> DataFrame:
    """One row: utterances, hours, calls, share of mixed and of short utterances."""
    return release.agg(
        F.count(F.lit(1)).alias("utterances"),
        (F.sum("duration_sec") / 3600).alias("hours"),
        F.countDistinct("call_id").alias("calls"),
        F.avg(F.col("is_code_mixed").cast("int")).alias("mixed_share"),
        F.avg((F.col("duration_sec") < short).cast("int")).alias("short_share"),
        F.avg((F.size(raw_items(F.col("keywords"))) > 0).cast("int")).alias("keyword_share"),
    )


def normal_form_drift(release: DataFrame) -> DataFrame:
    """Utterances whose stored normal form isn't what the normalizer gives."""
    checked = with_normal_forms(release.select("utterance_id", "transcription", "transcription_normalized"), {"transcription": "expected"})
    return checked.where(F.col("transcription_normalized").isNotNull() & (F.col("transcription_normalized") != F.col("expected")))
