"""Cells of keywords. Whether a text says them is found in the visit that normalizes it (``kernel``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: line breaks, and commas that don't stand between two digits, part keywords.
SEPARATORS = r"\n+|(?<!\p{Nd}),|,(?!\p{Nd})"
#: Characters that become a comma in NFKC but don't part keywords.
LATER_COMMAS = "，﹐︐"
#: Cells without a keyword, ignoring case and outer blanks.
NO_KEYWORDS = ("", "nan", "none")
#: Letters of a keyword from which a suffix is allowed, and characters of a suffix in another script.
STEM, SUFFIX = 3, 6


def raw_items(keywords: Column) -> Column:
    """The items of a cell before normalization; none for null, blank, ``nan`` and ``none``."""
    missing = keywords.isNull() | F.lower(F.regexp_replace(keywords, r"^\s+|\s+$", "")).isin(*NO_KEYWORDS)
    parts = F.split(F.translate(keywords, LATER_COMMAS, " " * len(LATER_COMMAS)), SEPARATORS)
    return F.when(missing, F.array().cast("array<string>")).otherwise(parts)
