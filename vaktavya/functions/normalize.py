"""The text normalizer that every metric shares.

Order matters: compatibility composition, characters, case, punctuation, blanks, ordinals, decimal
point, cardinals, fillers and spellings. The whole of it is one visit to Python (``kernel``); the steps that look at one
character or one word are here as built-in expressions too.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaktavya.functions.kernel import normal_texts
from vaktavya.functions.vocabulary import SPELLINGS, SPOKEN_SYMBOLS, VANISH, ZEROS


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; the JVM has it, but no built-in function reaches it."""
    return text.str.normalize("NFKC")


# the optimizer repeats deterministic columns where they are used, even as part of a join's condition; this one stays put
nfkc = nfkc.asNondeterministic()


def _among(word: Column, some: Iterable[str]) -> Column:
    """Whether a word, which has no blanks, is one of some: one literal, however many they are."""
    return F.contains(F.lit(f" {' '.join(some)} "), F.concat(F.lit(" "), word, F.lit(" ")))


def _table(values: Mapping[str, object]) -> Column:
    """A constant map of words to texts."""
    return F.str_to_map(F.lit("\x1f".join(f"{k}\x1e{v}" for k, v in values.items())), F.lit("\x1f"), F.lit("\x1e"))


def _lookup(word: Column, table: Mapping[str, str], otherwise: Column) -> Column:
    """The value of a small table for a word."""
    return F.when(_among(word, table), F.element_at(_table(table), word)).otherwise(otherwise)


def fold(text: Column) -> Column:
    """Characters, case, punctuation and blanks of a text in NFKC; null becomes empty.

    Apostrophes and joiners vanish, Indic digits become ASCII, %, ₹ and $ become words, other currency
    signs words of their own, punctuation and separators blanks; blanks collapse.
    """
    digits = "".join(chr(z + d) for z in ZEROS for d in range(10))
    # characters of the second argument beyond the third's length are deleted
    out = F.translate(F.coalesce(text, F.lit("")), digits + VANISH, "0123456789" * len(ZEROS))
    out = F.lower(out)
    for sign, word in SPOKEN_SYMBOLS.items():
        out = F.replace(out, F.lit(sign), F.lit(f" {word} "))
    out = F.regexp_replace(out, r"[\p{P}\p{Z}]", " ")
    out = F.regexp_replace(out, r"(\p{Sc})", " $1 ")
    return F.trim(F.regexp_replace(out, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def tokens(text: Column) -> Column:
    """Words of a folded text; an empty text has none."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def settle_spellings(toks: Column) -> Column:
    """Fillers with a stretched sound in one form, then words with several spellings."""
    def one(t: Column) -> Column:
        sound = F.when(t.rlike("^h*m{2,}$"), "hmm").when(t.rlike("^a+h+$"), "ah").when(t.rlike("^h+a+$"), "ha").otherwise(t)
        return _lookup(sound, SPELLINGS, sound)

    return F.transform(toks, one)


def normalize(text: Column, numbers: bool = True, spellings: bool = True, whole_numbers: bool = False) -> Column:
    """The normal form of a text. Null becomes empty.

    ``numbers``: compose ordinals, decimals and cardinals, one digit a word, or whole ones with
    ``whole_numbers``. ``spellings``: settle fillers and spellings.
    """
    return normal_texts(text, numbers=numbers, spellings=spellings, whole_numbers=whole_numbers)["n0"]


def with_normal_forms(df: DataFrame, columns: dict[str, str], **options: bool) -> DataFrame:
    """``df`` with the normal form of each column of ``columns`` under the name given; one visit to Python for all."""
    out = df.withColumn("_forms", normal_texts(*(F.col(old) for old in columns), **options))
    return out.withColumns({new: F.col(f"_forms.n{i}") for i, new in enumerate(columns.values())}).drop("_forms")
