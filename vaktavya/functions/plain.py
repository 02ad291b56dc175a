"""The normalizer for single texts, for use inside of Python functions and to hold the expressions against."""

from __future__ import annotations

import re
import unicodedata

from vaktavya.functions.vocabulary import BEFORE_SECOND, JOINER, ORDINALS, SCALES, SPELLINGS, SPOKEN_SYMBOLS, TENS, UNITS, VANISH, ZEROS, words

_UNITS, _TENS, _SCALES = words(UNITS), words(TENS), words(SCALES)
_VALUES = {**_UNITS, **_TENS, **_SCALES}
_COUNTS = {*_UNITS, *BEFORE_SECOND}
#: Words without which, and without digits, the number rules change nothing.
_NUMERIC = frozenset({*_VALUES, *ORDINALS, "second"})
_SOUNDS = ((re.compile(r"h*m{2,}"), "hmm"), (re.compile(r"a+h+"), "ah"), (re.compile(r"h+a+"), "ha"))
_ORDINAL = re.compile(r"([0-9]+)(?:st|nd|rd|th)")
_DIGIT = re.compile(r"\d")


class _Folded(dict):
    """What a character becomes, found out when it is first met."""

    def __missing__(self, point: int) -> str | None:
        c = chr(point)
        if c in VANISH:
            found = None
        elif c in SPOKEN_SYMBOLS:
            found = f" {SPOKEN_SYMBOLS[c]} "
        elif zero := next((z for z in ZEROS if z <= point < z + 10), None):
            found = str(point - zero)
        else:
            kind = unicodedata.category(c)
            found = " " if kind[0] in "PZ" else f" {c} " if kind == "Sc" else c
        self[point] = found
        return found


_FOLDED = _Folded()


def _numeral(t: str) -> bool:
    return t.isdigit() or t in _VALUES


class _Cardinal:
    """A number that is being said."""

    def __init__(self) -> None:
        self.total = self.current = self.joiners = 0
        self.last = ""

    def take(self, token: str, kind: str) -> None:
        value = int(token) if kind == "D" else _VALUES[token]
        if kind == "S" and value != 100:
            self.total, self.current = self.total + (self.current or 1) * value, 0
        elif kind == "S":
            self.current = (self.current or 1) * value
        else:
            self.current += value
        self.joiners, self.last = 0, kind

    def goes_on(self, kind: str) -> bool:
        return kind == "S" or (self.last == "S" and kind in "DUNX") or (self.last == "X" and kind == "U")


def _kind(t: str) -> str:
    if t.isdigit():
        return "D"
    if t in _UNITS:
        return "U" if _UNITS[t] <= 9 else "N"
    return "X" if t in _TENS else "S" if t in _SCALES else "A" if t == JOINER else "O"


def compose(toks: list[str], digits: bool = True) -> list[str]:
    """Cardinal phrases as numbers, one digit a word, or whole."""
    out: list[str] = []
    number: _Cardinal | None = None

    def close() -> None:
        nonlocal number
        if number:
            value = str(number.total + number.current)
            out.extend(value if digits else [value])
            out.extend([JOINER] * number.joiners)
        number = None

    for i, t in enumerate(toks):
        kind = _kind(t)
        if number and kind == "A":
            number.joiners += 1
            continue
        if not (number and number.goes_on(kind)):
            close()
            if kind in "UNXS" or (kind == "D" and i + 1 < len(toks) and toks[i + 1] in _SCALES):
                number = _Cardinal()
            else:
                out.extend(t if kind == "D" and digits else [t])
        if number:
            number.take(t, kind)
    close()
    return out


def folded_words(text: str | None) -> list[str]:
    """The words of a text with characters, case, punctuation and blanks folded."""
    if not text:
        return []
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower().translate(_FOLDED).split()


def numbers_composed(toks: list[str], digits: bool = True) -> list[str]:
    """Ordinals as cardinals, no spoken points, cardinal phrases digit by digit or whole; the same list where there is no number."""
    if _NUMERIC.isdisjoint(toks) and not _DIGIT.search(" ".join(toks)):
        return toks
    before = ["", *toks]
    toks = [
        m[1] if (m := _ORDINAL.fullmatch(t)) else "two" if t == "second" and not (before[i] in _COUNTS or before[i].isdigit()) else ORDINALS.get(t, t)
        for i, t in enumerate(toks)
    ]
    toks = [t for i, t in enumerate(toks) if not (t == "point" and 0 < i < len(toks) - 1 and _numeral(toks[i - 1]) and _numeral(toks[i + 1]))]
    return compose(toks, digits)


def _settled_word(t: str) -> str:
    sound = t
    if t[0] in "hma":
        sound = next((kept for p, kept in _SOUNDS if p.fullmatch(t)), t)
    return SPELLINGS.get(sound, sound)


def spellings_settled(toks: list[str]) -> list[str]:
    """Fillers and spellings of one word in one form."""
    return " ".join(map(_settled_word, toks)).split()


def plain_normalize(text: str | None, numbers: bool = True, spellings: bool = True) -> str:
    """The normal form of one text; null is empty."""
    toks = folded_words(text)
    if numbers:
        toks = numbers_composed(toks)
    if spellings:
        toks = spellings_settled(toks)
    return " ".join(toks)


#: Signs that join Indic letters (combining class 9), and the zero-width joiners.
VIRAMAS = "".join(c for c in map(chr, range(0x0900, 0x1100)) if unicodedata.combining(c) == 9)
JOINERS = "\u200c\u200d"


def syllables(token: str) -> list[str]:
    """Written syllables of a word: a letter with its marks, and what follows a virama or joiner."""
    out: list[str] = []
    for c, before in zip(token, ["", *token], strict=False):
        if out and (before in VIRAMAS or before in JOINERS or c in JOINERS or unicodedata.category(c)[0] == "M"):
            out[-1] += c
        else:
            out.append(c)
    return out


def edits(a: list[str], b: list[str]) -> int:
    """Levenshtein distance of two rows of words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]
