"""Several values packed in one field: one row per value, by the cheapest dialect of each field."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaktavya.plans.session import settled

#: Marks that part values. A comma between digits and a slash inside a word don't.
DELIMITERS = {
    "comma": r"(?<!\d),|,(?!\d)|[，、،]",
    "semicolon": r"[;；]",
    "pipe": r"[|｜]",
    "line": r"[\r\n  ]",
    "tab": r"\t",
    "bullet": r"[•·‣▪●]",
    "slash": r"(?<=\s)/|/(?=\s)",
}
#: Opening and closing quotes, and brackets around a whole field.
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "`": "`"}
BRACKETS = {"[": "]", "(": ")", "{": "}", "<": ">"}
EMPTY_CELLS = ("", "nan", "none")

#: Bits: of a character spelled out, of a mark left inside an unquoted value, of each further kind of mark.
CHAR_BITS, MARK_BITS, KIND_BITS = 5.0, 60.0, 4.0

_KINDS = {k: re.compile(p) for k, p in DELIMITERS.items()}
_ANY_MARK = re.compile("|".join([*DELIMITERS.values(), "[" + "".join(QUOTES) + "”»]"]))
_EDGE_MARK = re.compile(r"^[\"'“‘«`]|[\"'”’»`]$")


def _unwrapped(text: str) -> str:
    text = text.strip()
    while len(text) > 1 and BRACKETS.get(text[0]) == text[-1]:
        text = text[1:-1].strip()
    return text


def _quoted_end(text: str, start: int) -> int:
    """Place after the closing quote of the value that opens at ``start``, or -1."""
    close, i = QUOTES[text[start]], start + 1
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text) and text[i + 1] == close:
            i += 2
        elif text[i] == close:
            if text[i + 1 : i + 2] == close and close == text[start]:
                i += 2
            else:
                return i + 1
        else:
            i += 1
    return -1


def parse(cell: str, kinds: tuple[str, ...], quotes: str) -> tuple[list[str], float]:
    """The non-empty values of a cell in a dialect, and the bits its loose marks cost."""
    text = _unwrapped(cell)
    cut = re.compile("|".join(DELIMITERS[k] for k in kinds)) if kinds else None
    values: list[str] = []
    bits, i, n = KIND_BITS * len(kinds) + KIND_BITS * bool(quotes), 0, len(text)
    while i <= n:
        j = i
        while j < n and text[j].isspace() and not (cut and cut.match(text, j)):
            j += 1
        value, end = None, -1
        if j < n and text[j] in quotes and (stop := _quoted_end(text, j)) > 0:
            k = stop
            while k < n and text[k].isspace() and not (cut and cut.match(text, k)):
                k += 1
            if k == n or (cut and cut.match(text, k)):
                q = QUOTES[text[j]]
                value, end = text[j + 1 : stop - 1].replace("\\" + q, q), k
                if q == text[j]:
                    value = value.replace(q * 2, q)
                value = value.strip()
        if value is None:
            found = cut.search(text, i) if cut else None
            end = found.start() if found else n
            value = text[i:end].strip()
            bits += MARK_BITS * (len(_ANY_MARK.findall(value)) - len(re.findall(r"(?<=\w)['’](?=\w)", value)))
            while len(value) > 1 and (QUOTES.get(value[0]) == value[-1] or BRACKETS.get(value[0]) == value[-1]):
                value = value[1:-1].strip()
        if value:
            values.append(value)
        if end >= n:
            break
        i = cut.match(text, end).end()
    return values, bits


def dialects(cell: str) -> list[tuple[tuple[str, ...], str]]:
    """The dialects that differ on this cell: each kind of mark in it, all of them, none; with and without quotes."""
    present = tuple(k for k, p in _KINDS.items() if p.search(cell))
    quotes = "".join(q for q in QUOTES if q in cell)
    kinds = dict.fromkeys([present, *((k,) for k in present), ()])
    return [(k, q) for q in dict.fromkeys([quotes, *quotes, ""]) for k in kinds]


def parses(cell: str) -> list[tuple[list[str], float]]:
    """The different value lists a cell may hold, each with the fewest bits of loose marks; the finest first."""
    best: dict[tuple[str, ...], float] = {}
    for kinds, quotes in dialects(cell):
        values, bits = parse(cell, kinds, quotes)
        best[tuple(values)] = min(bits, best.get(tuple(values), bits))
    return [(list(v), b) for v, b in best.items()]


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [parses(c) for c in pdf["_cell"]]
        yield pd.DataFrame(
            {
                "_cell": pdf["_cell"].repeat([len(f) for f in found]).reset_index(drop=True),
                "_rows": pdf["_rows"].repeat([len(f) for f in found]).reset_index(drop=True),
                "_choices": [len(f) for f in found for _ in f],
                "_pick": [i for f in found for i in range(len(f))],
                "_values": [v for f in found for v, _ in f],
                "_bits": [b for f in found for _, b in f],
            }
        )


def unpack(df: DataFrame, key: str, field: str, value: str = "value") -> DataFrame:
    """One row (``key``, ``pos``, ``value``) per value in ``field``; ``pos`` counts from 1, repeats stay.

    Each distinct cell is parsed once, in every dialect that its marks allow; the parses are kept in the checkpoint folder. A parse costs the code
    lengths of its values, -log2 of a value's share in all parses of the corpus plus its spelling
    spread over its occurrences, and the bits of delimiters or quotes left loose inside values. The
    cheapest parse wins, the finer one in ties. Cells with one possible parse skip the scoring; the
    value counts still include them.

    Null cells, blank ones and ``nan`` or ``none`` in any case hold no value. Rows with a null key
    keep their values. Repeated rows give repeated results. Extra columns don't come out.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(field).alias("_cell"))
    bare = F.lower(F.regexp_replace("_cell", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    rows = rows.where(F.col("_cell").isNotNull() & ~bare.isin(*EMPTY_CELLS))
    cells = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_rows"))
    # parsed once; counts, prices and choices read what is kept
    parsed = settled(cells.mapInPandas(_parsed, "_cell string, _rows long, _choices int, _pick int, _values array<string>, _bits double"))
    counted = parsed.select("_rows", F.explode("_values").alias("_value")).groupBy("_value").agg(F.sum("_rows").alias("_n"))
    total = parsed.agg(F.sum(F.col("_rows") * F.size("_values"))).scalar()
    code = F.log2(total / F.col("_n")) + F.length("_value") * CHAR_BITS / F.col("_n")
    # from here on everything of a cell stays in one partition, up to the join with the rows
    priced = (
        parsed.where("_choices > 1")
        .select("_cell", "_pick", "_bits", F.posexplode_outer("_values").alias("_pos", "_value"))
        .join(counted, "_value", "left")
        .select("_cell", "_pick", "_bits", "_pos", "_value", code.alias("_code"))
        .repartition("_cell")
    )
    whole = F.transform(F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", "_value")))), lambda x: x["_value"])
    scored = priced.groupBy("_cell", "_pick").agg((F.coalesce(F.sum("_code"), F.lit(0.0)) + F.first("_bits")).alias("_cost"), whole.alias("_values"))
    chosen = scored.groupBy("_cell").agg(F.min_by("_values", F.struct("_cost", "_pick")).alias("_values"))
    chosen = chosen.unionByName(parsed.where("_choices = 1").select("_cell", "_values"))
    return (
        rows.join(chosen, "_cell")
        .select(F.col("_key").alias(key), F.posexplode("_values").alias("_pos", value))
        .select(key, (F.col("_pos") + 1).cast("bigint").alias("pos"), value)
    )
