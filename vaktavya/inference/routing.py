"""Languages as recognisers take them, as expressions."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaktavya.sources.speech import LANGUAGES

#: English names of languages by code.
NAMES = {
    "hi": "Hindi", "bn": "Bengali", "ta": "Tamil", "te": "Telugu", "kn": "Kannada", "ml": "Malayalam", "mr": "Marathi", "gu": "Gujarati",
    "pa": "Punjabi", "od": "Odia", "or": "Odia", "as": "Assamese", "en": "English",
}
#: Codes that have a region of their own, codes that name no language.
REGIONAL = ("hi", "bn", "ta", "te", "kn", "ml", "mr", "gu", "pa", "od", "en")
NO_LANGUAGE = ("", "other", "unknown")


def _code(language: Column) -> Column:
    return F.lower(F.trim(F.coalesce(language, F.lit(""))))


def one_or_many(language: Column, mixed: Column, single: Collection[str], together: Collection[str], many: str = "multi") -> Column:
    """The language itself if there is a model of its own; ``many`` for unknown ones and for mixed rows of those in ``together``."""
    code = _code(language)
    both = F.coalesce(mixed, F.lit(False)) & code.isin(*together)
    return F.when(~both & code.isin(*single), code).otherwise(many)


def regional(language: Column, region: str = "IN", unknown: str = "unknown") -> Column:
    """``hi`` to ``hi-IN``; ``unknown`` for other codes."""
    code = _code(language)
    return F.when(code.isin(*REGIONAL), F.concat(code, F.lit(f"-{region}"))).otherwise(unknown)


def code_or_null(language: Column) -> Column:
    """The code, or null where none is named, so that the recogniser finds out."""
    code = _code(language)
    return F.when(~code.isin(*NO_LANGUAGE), code)


def supported_or(language: Column, supported: Collection[str], fallback: str) -> Column:
    """The code if it is a single supported one; ``fallback`` for none, unknown ones and joined tags. A model of one language takes that for both."""
    code = _code(language)
    return F.when(code.isin(*supported), code).otherwise(fallback)


def language_hints(tag: Column, language: Column, supported: Collection[str] = tuple(LANGUAGES.values())) -> Column:
    """Distinct supported codes, those of the tag first, then the base language; null if there is none."""
    parts = F.split(F.translate(_code(tag), "_", "-"), "-")
    codes = F.array_distinct(F.filter(F.concat(parts, F.array(_code(language))), lambda c: c.isin(*supported)))
    return F.when(F.size(codes) > 0, codes)


def language_name(language: Column) -> Column:
    """English name of a code, empty for unknown ones."""
    code = _code(language)
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    return F.when(code.isin(*NAMES), F.element_at(names, code)).otherwise("")
