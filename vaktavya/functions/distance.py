"""Edit counts between rows of words, characters and mixed units, by the built-in Levenshtein distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaktavya.functions.bind import let
from vaktavya.functions.kernel import row_forms
from vaktavya.functions.normalize import tokens
from vaktavya.functions.plain import JOINERS, VIRAMAS

#: Code points that stand for units: from here up none is a surrogate.
_FIRST = 0xE000


def _spelled(units: Column, vocabulary: Column) -> Column:
    """One character for each unit: its place in the vocabulary."""
    code = lambda u: F.lpad(F.hex(F.array_position(vocabulary, u).cast("int") + _FIRST), 8, "0")
    return F.decode(F.unhex(F.array_join(F.transform(units, code), "")), "UTF-32")


def sequence_edits(reference: Column, hypothesis: Column) -> Column:
    """Levenshtein distance between two arrays of units.

    Each distinct unit of the pair becomes one character, so the built-in distance of strings counts
    units. A pair may hold a million distinct ones.
    """
    distance = let(
        F.array_distinct(F.concat(reference, hypothesis)),
        lambda vocabulary: F.levenshtein(_spelled(reference, vocabulary), _spelled(hypothesis, vocabulary)),
    )
    return (
        F.when(F.size(reference) == 0, F.size(hypothesis))
        .when(F.size(hypothesis) == 0, F.size(reference))
        .when(reference == hypothesis, 0)
        .otherwise(distance)
    )


def counts(edits: Column, units: Column, hypothesis_units: Column) -> Column:
    """(rate, edits, units). A reference without units has no edits; its rate is 1 unless the hypothesis has none either."""
    empty = units == 0
    return F.struct(
        F.when(empty, F.when(hypothesis_units == 0, 0.0).otherwise(1.0)).otherwise(edits / units).alias("rate"),
        F.when(empty, 0).otherwise(edits).cast("bigint").alias("edits"),
        units.cast("bigint").alias("units"),
    )


def _unit_counts(reference: Column, hypothesis: Column) -> Column:
    both = F.struct(reference.alias("r"), hypothesis.alias("h"))
    return let(both, lambda s: counts(sequence_edits(s["r"], s["h"]), F.size(s["r"]), F.size(s["h"])))


def word_counts(reference: Column, hypothesis: Column) -> Column:
    """Word counts of two normal forms."""
    return _unit_counts(tokens(reference), tokens(hypothesis))


def char_counts(reference: Column, hypothesis: Column) -> Column:
    """Character counts of two normal forms, blanks included, in code points."""
    return counts(F.levenshtein(reference, hypothesis), F.length(reference), F.length(hypothesis))


def syllables(token: Column) -> Column:
    """Written syllables of a word: a letter with its marks, and what follows a virama or joiner."""
    pattern = rf"(?s).(?:[\p{{M}}{JOINERS}]|(?<=[{VIRAMAS}{JOINERS}]).)*"
    return F.regexp_extract_all(token, F.lit(pattern), F.lit(0))


def mixed_units(text: Column) -> Column:
    """Words with Latin letters or digits whole, others by syllable."""
    return F.flatten(F.transform(tokens(text), lambda t: F.when(t.rlike(r"[a-z\p{Nd}]"), F.array(t)).otherwise(syllables(t))))


def mixed_counts(reference: Column, hypothesis: Column) -> Column:
    """Counts of mixed units of two normal forms."""
    return _unit_counts(mixed_units(reference), mixed_units(hypothesis))


def keyword_counts(keywords: Column, hypothesis: Column, reference: Column | None = None) -> Column:
    """(rate, hits, scored) of raw texts: keywords that the hypothesis says, of those that the reference says, or of all without one.

    The rate is one minus hits over scored keywords, null where none is scored.
    """
    hypothesis = F.coalesce(hypothesis, F.lit(""))
    found = row_forms(keywords if reference is None else F.coalesce(reference, F.lit("")), hypothesis, keywords, reference is None)
    return let(found, lambda n: F.struct((1 - F.try_divide(n["hits"].cast("double"), n["scored"].cast("double"))).alias("rate"), n["hits"].alias("hits"), n["scored"].alias("scored")))
