"""Normal forms and units of rows of texts, one Arrow batch at a time.

Compatibility composition isn't to be had in the JVM, so texts visit Python once in any case. What needs a look at
neighbouring words is done in the same visit: as built-in expressions, normal forms, units and keyword hits took five times as long,
since lambdas over arrays are interpreted. Distances stay with the built-in Levenshtein function: units leave
Python as texts of one character a unit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vaktavya.functions.keywords import LATER_COMMAS, NO_KEYWORDS, SEPARATORS, STEM, SUFFIX
from vaktavya.functions.plain import folded_words, numbers_composed, spellings_settled, syllables

#: Forms kept at a time by each worker, and the code point of the first unit: from here up none is a surrogate.
KEPT, FIRST_UNIT = 100_000, 0xE000

_SEPARATORS = re.compile(SEPARATORS.replace(r"\p{Nd}", r"\d"))
_UNPARTED = str.maketrans(LATER_COMMAS, " " * len(LATER_COMMAS))
_LETTER = re.compile("[A-Za-z]")


class Forms(dict):
    """Normal forms of texts met so far: with numbers composed and as spoken, each with a blank around it."""

    def __missing__(self, text: str) -> tuple[str, str]:
        if len(self) > KEPT:
            self.clear()
        words = folded_words(text)
        composed = numbers_composed(words)
        full = f" {' '.join(spellings_settled(composed))} "
        found = self[text] = (full, full if composed is words else f" {' '.join(spellings_settled(words))} ")
        return found


class Units(dict):
    """Mixed units of words met so far."""

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > KEPT:
            self.clear()
        whole = any("a" <= c <= "z" or c.isdigit() for c in word)
        found = self[word] = (word,) if whole else tuple(syllables(word))
        return found


def spelled(reference: list[str], hypothesis: list[str]) -> tuple[str, str]:
    """Two rows of units as texts of one character a unit, equal for equal ones."""
    known: dict[str, str] = {}
    code = lambda unit: known.setdefault(unit, chr(FIRST_UNIT + len(known)))
    return "".join(map(code, reference)), "".join(map(code, hypothesis))


def says(keyword: str, text: str) -> bool:
    """Whether a text says a keyword, its last word perhaps with a plural ending or a short suffix in another script; both with a blank around."""
    stem = keyword[:-1]
    inflected = len(stem) - 1 - stem.rfind(" ") >= STEM
    at = text.find(stem)
    while at >= 0:
        rest = text[at + len(stem) : text.index(" ", at + len(stem))]
        if not rest or (inflected and (rest in ("s", "es") if rest.isascii() else len(rest) <= SUFFIX and not _LETTER.search(rest))):
            return True
        at = text.find(stem, at + 1)
    return False


def keyword_hits(cell: str | None, reference: tuple[str, str] | None, hypothesis: tuple[str, str], forms: Forms) -> tuple[int, int]:
    """Keywords of a cell that the hypothesis says, of those that the reference says, and the number of the latter; all without a reference."""
    if not cell or cell.strip().lower() in NO_KEYWORDS:
        return 0, 0
    named: dict[str, tuple[str, str]] = {}
    for item in _SEPARATORS.split(cell.translate(_UNPARTED)):
        both = forms[item]
        if both[0] != "  ":
            named.setdefault(both[0], both)
    said = lambda both, texts: any(says(k, t) for k in dict.fromkeys(both) for t in dict.fromkeys(texts))
    scored = [both for both in named.values() if reference is None or said(both, reference)]
    return sum(said(both, hypothesis) for both in scored), len(scored)


ROW = "r string, h string, rw string, hw string, rm string, hm string, hits bigint, scored bigint"


def row_forms(reference: Column, hypothesis: Column, keywords: Column | None = None, all_keywords: bool = False) -> Column:
    """Of each row, the normal forms r and h, their words and mixed units as texts of one character each, and keyword hits.

    Keywords that the reference doesn't say aren't scored, unless ``all_keywords`` is set.
    """

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        forms, units = Forms(), Units()
        for references, hypotheses, *cells in batches:
            rows = []
            for a, b, cell in zip(references, hypotheses, cells[0] if cells else [None] * len(references), strict=True):
                r, h = forms[a or ""], forms[b or ""]
                x, y = r[0].split(), h[0].split()
                mixed = spelled([u for w in x for u in units[w]], [u for w in y for u in units[w]])
                rows.append((r[0].strip(), h[0].strip(), *spelled(x, y), *mixed, *keyword_hits(cell, None if all_keywords else r, h, forms)))
            yield pd.DataFrame(rows, columns=[field.split()[0] for field in ROW.split(", ")])

    # the optimizer repeats deterministic columns where they are used, even as part of a join's condition; this one stays put
    return F.pandas_udf(run, ROW).asNondeterministic()(reference, hypothesis, *([] if keywords is None else [keywords]))


def normal_texts(*texts: Column, numbers: bool = True, spellings: bool = True, whole_numbers: bool = False) -> Column:
    """A struct of the normal forms n0, n1, ... of several texts; null becomes empty."""
    names = [f"n{i}" for i in range(len(texts))]

    def form(text: str | None) -> str:
        words = folded_words(text)
        words = numbers_composed(words, digits=not whole_numbers) if numbers else words
        return " ".join(spellings_settled(words) if spellings else words)

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            # a lone column comes by itself
            columns = (columns,) if isinstance(columns, pd.Series) else columns
            yield pd.DataFrame({n: [form(t) for t in c] for n, c in zip(names, columns, strict=True)})

    return F.pandas_udf(run, ", ".join(f"{n} string" for n in names)).asNondeterministic()(*texts)
