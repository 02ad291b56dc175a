"""Mergeable percentiles with a guaranteed rank error: a quantile digest over a bounded universe.

A positive number is quantized to one of 2**22 ordered leaves (7 bits of binary exponent, 15 of
mantissa), so a leaf is at most 2**-15 of its value wide. Counts sit on the nodes of the binary tree
over the leaves. Compression moves the count of a pair of siblings to their parent wherever pair and
parent together hold at most n / k. Digests merge by adding the counts of equal nodes.

A rank that a digest answers is off by at most ``LEVELS * n / k`` for each compression that its counts
went through. Day digests are compressed once, combined ones once more: with K = 8800 the rank error
is at most 22 * 2 / 8800 = 0.5 % of n. Groups of fewer than K values are exact up to the leaf width.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaktavya.functions.ids import plain_id

MANTISSA_BITS, EXPONENT_BITS = 15, 7
LEVELS = MANTISSA_BITS + EXPONENT_BITS
LEAVES = 1 << LEVELS
_BIAS = 64
K = 8800
QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def leaf(value: Column) -> Column:
    """The leaf of a positive number; numbers beyond 2**-64 and 2**64 go to the first or last leaf."""
    rough = F.floor(F.log2(value))
    power = rough + F.when(value >= F.pow(F.lit(2.0), rough + 1), 1).when(value < F.pow(F.lit(2.0), rough), -1).otherwise(0)
    inside = F.floor((value / F.pow(F.lit(2.0), power) - 1) * (1 << MANTISSA_BITS))
    number = (power + _BIAS) * (1 << MANTISSA_BITS) + inside
    return F.greatest(F.lit(0), F.least(F.lit(LEAVES - 1), number)).cast("bigint")


def leaf_value(number: np.ndarray) -> np.ndarray:
    """The middle of a leaf."""
    power, inside = np.divmod(number, 1 << MANTISSA_BITS)
    return np.ldexp(1.0 + (inside + 0.5) / (1 << MANTISSA_BITS), power - _BIAS)


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compressed (group, node, count), many groups at once. Nodes are numbered from the root, 1, so that node v has parent v // 2."""
    if not len(group):
        return group, node, count
    limit = np.bincount(group, count).astype(np.int64) // k
    busy = limit[group] > 0
    done = [(group[~busy], node[~busy], count[~busy])]
    group, node, count = group[busy], node[busy], count[busy]
    for level in range(LEVELS, 0, -1):
        here = node >= (1 << level)
        g, v, c = group[here], node[here], count[here]
        if not len(g):
            continue
        parent = np.where(here, node // 2, node)
        at = (node >= (1 << (level - 1)))
        key = group * (2 * LEAVES) + parent
        uniq, place = np.unique(key[at], return_inverse=True)
        total = np.bincount(place, count[at])
        merge = np.zeros(len(node), bool)
        merge[at] = total[place] <= limit[group[at]]
        keep = here & ~merge
        done.append((group[keep], node[keep], count[keep]))
        group, node, count = group[~keep], np.where(here & merge, parent, node)[~keep], count[~keep]
        key = group * (2 * LEAVES) + node
        uniq, place = np.unique(key, return_inverse=True)
        count = np.bincount(place, count, len(uniq)).astype(np.int64)
        group, node = uniq // (2 * LEAVES), uniq % (2 * LEAVES)
    done.append((group, node, count))
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def answer(nodes: np.ndarray, counts: np.ndarray, wanted: Sequence[float]) -> list[float]:
    """The values at the wanted fractions: nodes in order of their largest leaf, smaller ranges first."""
    height = LEVELS - np.floor(np.log2(nodes)).astype(np.int64)
    last = ((nodes + 1) << height) - 1 - LEAVES
    order = np.lexsort((height, last))
    ranks = np.cumsum(counts[order])
    # rank = ceil(q n), as percentile_disc counts
    at = np.searchsorted(ranks, [max(1, int(np.ceil(q * ranks[-1] - 1e-9))) for q in wanted])
    return leaf_value(last[order][at].astype(np.int64)).tolist()


def _by_group(batches: Iterator[pd.DataFrame], keys: list[str], k: int) -> Iterator[pd.DataFrame]:
    """Compress groups of rows that arrive sorted by group; a group that a batch cuts waits for the next."""

    def closed(pdf: pd.DataFrame) -> pd.DataFrame:
        code = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        heads = pdf.loc[~pdf.duplicated(keys), keys].reset_index(drop=True)
        g, v, c = compress(code.astype(np.int64), pdf["node"].to_numpy(), pdf["n"].to_numpy(), k)
        out = heads.iloc[g].reset_index(drop=True)
        return out.assign(node=v, n=c)

    rest: pd.DataFrame | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = pdf[keys].iloc[-1]
        same = np.ones(len(pdf), bool)
        for name in keys:
            same &= pdf[name].isna().to_numpy() if pd.isna(last[name]) else (pdf[name] == last[name]).fillna(False).to_numpy()
        cut = len(pdf) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield closed(pdf.iloc[:cut].reset_index(drop=True))
        rest = pdf.iloc[cut:].reset_index(drop=True)
        if len(rest) > LEAVES // 8:
            rest = closed(rest)
    if rest is not None and len(rest):
        yield closed(rest)


def merge_digests(nodes: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """One digest per combination of ``keys`` from rows (keys..., node, n): equal nodes add up, then are compressed."""
    keys = list(keys)
    types = dict(nodes.dtypes)
    # a constant key makes a digest of everything out of no keys
    inner = keys or ["_all"]
    rows = nodes if keys else nodes.withColumn("_all", F.lit(0))
    types["_all"] = "int"
    summed = rows.groupBy(*inner, "node").agg(F.sum("n").alias("n"))
    placed = summed.repartition(*inner).sortWithinPartitions(*inner)
    schema = ", ".join(f"`{c}` {types[c]}" for c in inner) + ", node bigint, n bigint"
    out = placed.mapInPandas(lambda b: _by_group(b, inner, k), schema)
    return out if keys else out.drop("_all")


def build_digests(df: DataFrame, value: str, keys: Sequence[str], k: int = K) -> DataFrame:
    """Digest rows (keys..., node, n) of the known values: those above zero that are numbers.

    Leaves are counted in the JVM before the shuffle, so a hot group moves at most one row per leaf
    and task. A null in a key is a group of its own. A table without known values gives no rows.
    """
    v = F.col(value).cast("double")
    known = df.where((v > 0) & ~F.isnan(v))
    leaves = known.select(*keys, (leaf(v) + LEAVES).alias("node")).groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("n"))
    return merge_digests(leaves, keys, k)


def quantiles(digests: DataFrame, keys: Sequence[str], compressions: int, k: int = K) -> DataFrame:
    """Per digest: n, one column for each of QUANTILES, and the guaranteed rank error as a share of n."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (int(c.sum()), *answer(v, c, list(QUANTILES.values())))
                for v, c in ((np.array([x["node"] for x in nodes]), np.array([x["n"] for x in nodes])) for nodes in pdf["_nodes"])
            ]
            yield pd.concat([pdf[list(keys)], pd.DataFrame(rows, columns=["n", *QUANTILES], index=pdf.index)], axis=1)

    # a digest holds at most 3 k nodes, or as many as there are values if those are fewer
    gathered = digests.groupBy(*keys).agg(F.collect_list(F.struct("node", "n")).alias("_nodes"))
    types = dict(digests.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), "n bigint", *(f"{q} double" for q in QUANTILES)])
    bound = F.when(F.col("n") < k, 0.0).otherwise(LEVELS * compressions / k)
    return gathered.mapInPandas(read, schema).withColumn("rank_error", bound)


def latencies(predictions: DataFrame, release: DataFrame) -> DataFrame:
    """Known latencies with language, domain and day of writing. Utterances that aren't released have null language and domain."""
    known = release.select(
        plain_id(F.col("utterance_id")).alias("_id"), F.col("language").alias("_l"), F.col("domain").alias("_d")
    ).where(F.col("_id").isNotNull())
    known = known.groupBy("_id").agg(F.max("_l").alias("language"), F.max("_d").alias("domain"))
    rows = predictions.where((F.col("latency_ms") > 0) & ~F.isnan("latency_ms")).select(
        plain_id(F.col("utterance_id")).alias("_id"), "latency_ms", F.to_date("written_at").alias("day")
    )
    return rows.join(known, "_id", "left").select("language", "domain", "day", "latency_ms")
