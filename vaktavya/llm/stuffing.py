"""Pages of repeated keywords, links and tags instead of sentences.

A text is cut into turns of speakers, told by line heads that recur, into sentences, ended by a sentence mark, and into loose
stretches, which have none. Terms are compared by class: every link counts as the same term, every tag too, and
numbers are equal. Three statistics tell lists from prose: the gaps after which terms recur, as the share of terms
that stand again nearby or anywhere in the stretch; the autocorrelation of the positions of equal terms at its best lag, up to
half the stretch; and the share of function words, without which a long row of distinct nouns is a list, whatever parts its members.
Function words are those of nine languages, in their script or in Latin letters by their sound.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaktavya.semantic.sounds import phonetic

#: Terms within which a recurrence is near, and lags that are tried in any stretch.
LAG = 40
LAGS = range(1, 25)
#: Terms up to which each lag is tried; random signs of a term by which the lags of longer stretches are found.
DIRECT, ROUNDS = 128, 8
#: Least share of terms near an equal one in a loose stretch and in a row of sentences; least autocorrelation and recurrence together.
RECURS, SENTENCES_RECUR, REGULAR, REGULAR_RECURS = 0.62, 0.85, 0.45, 0.45
#: Shares of function words below which far recurrence counts, and below which a row of words is a list.
FAR_NEEDED, NEEDED, ONCE = 0.12, 0.05, 0.2
#: Words from which a sentence or a turn is tested by itself.
LONG = 12
#: Words of a row that needs no marks to be a list; shares of marks in shorter ones: of all kinds, with line breaks, of one kind in a sentence.
ROW, MARKS, BREAKS, SENTENCE_MARKS = 20, 0.16, 0.25, 0.2
#: Share of a text's words beyond which it is stuffed.
SHARE = 0.5
#: Words that sentences need and lists of nouns lack, by language.
FUNCTION_WORDS = {
    "en": "the a an is are was were be been has have had do does did will would can could that this these those and or but if as of to for with by from at on in not we you he she it "
    "they i my your our their when which who so because while after before until again please what how there any",
    "hi": "है हैं में की का के को से ने पर और यह मैं मुझे मेरा आप हम क्या नहीं था थे तो भी तक लिए हूँ",
    "mr": "आहे मला मी माझं तुम्ही ची चा चे ला मध्ये आणि हे ते नाही नाहीये पासून पर्यंत की होतं",
    "bn": "আমি আমার আমাদের আপনি আপনার এর কি না যে থেকে পর্যন্ত এবং এই জন্য মধ্যে দিকে",
    "gu": "છે મને મારું હું તમે તમારા અમારા માં ની નો ના નું અને તે થી સુધી નથી માટે",
    "ta": "நான் என் எனக்கு என்னோட நீங்க உங்க எங்க அவங்க என்று என்ன இந்த ஒரு வரை முதல் இல்லை மேல்",
    "te": "నేను నా నాకు మీరు మీ మా వారు వాళ్ళు వాళ్లు అని ఈ ఆ కోసం లేదు ఉంది వరకు నుంచి మీద",
    "kn": "ನಾನು ನನ್ನ ನನಗೆ ನೀವು ನಿಮ್ಮ ನಮ್ಮ ಅವರು ಎಂದು ಈ ಆ ಮೇಲೆ ಇದೆ ಇಲ್ಲ ತನಕ ಗಾಗಿ ಒಂದು",
    "ml": "ഞാൻ എന്റെ എനിക്ക് നിങ്ങൾ ഞങ്ങളുടെ അവർ എന്ന് ഈ ആ വരെ മേൽ ഇല്ല ആണ് ഒരു നിന്ന്",
}

_LINK = re.compile(r"(?i)(?:[a-z][a-z0-9+.-]*://|www\.)\S+|(?<![\w@.])[a-z0-9][\w-]*(?:\.[\w-]+)*\.[a-z]{2,12}(?:/\S*|(?=\)))|(?<![\w@.])[a-z0-9][\w-]*(?:\.[\w-]+)*\.(?:com|org|net|edu|gov|info|io)(?![\w.])")
#: What every link has.
_DOTTED = re.compile(r"\w\.\w|://")
_TAG = re.compile(r"(?<!\S)#[^\s#]+")
_MARKUP = re.compile(r"</?\w[^>]*>")
_ANCHOR = re.compile(r"<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\n]*\)", re.S)
_END = re.compile(r"(?<=[.?!।॥])[\"'”’)\]]*(?=\s|$)")
#: What may be a speaker: at the start of a line or sentence up to three words before a colon, elsewhere one; a time may stand before it.
_HEAD = re.compile(
    r"(?:^|(?<=[.?!।॥]\s))(?:\[[\d:.]+\]\s*)?([^\W\d][\w'-]{0,19}(?: [\w'-]{1,20}){0,2}):\s|(?<=\s)(?:\[[\d:.]+\]\s*)?([^\W\d][\w'-]{0,19}):\s", re.M
)
_TERM = re.compile(r"[^\W_]+(?:['’\-‌‍\u0900-\u0dff]+[^\W_]*)*|[>|/•,;]|(?<=\s)-(?=\s)|\uE000|\uE001")
_WORD = re.compile(r"\w")
_DIGITS = re.compile(r"\d+")
_MARKS = frozenset(">|/•,;-")
_CLASSES = frozenset("\uE000\uE001")


def _sound(word: str) -> str:
    """A word's sound, nasals alike, without a last a; Latin spellings double a vowel to make it long."""
    word = word.replace("ee", "i").replace("oo", "u") if word.isascii() else word
    key = phonetic(word).replace("m", "n").replace(" ", "")
    return (key.rstrip("a") or key) if len(key) > 2 else key


_SPELLED = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split())
_SOUNDED = frozenset(k for k in (_sound(w) for language, words in FUNCTION_WORDS.items() if language != "en" for w in words.split()) if len(k) > 2)


class Needed(dict):
    """Whether a term is a function word, for terms met so far."""

    def __missing__(self, term: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        # sounds of two letters are those of too many English words
        found = self[term] = term in _SPELLED or (term.isascii() and term.isalpha() and len(term) > 2 and _sound(term) in _SOUNDED)
        return found


_NEEDED = Needed()


def replace_links(text: str, by: str) -> str:
    """A text with ``by`` in place of its links."""
    return _LINK.sub(by, text) if _DOTTED.search(text) else text


def terms(text: str) -> list[str]:
    """The terms of a stretch, by class."""
    text = replace_links(text, " \uE000 ")
    if "<" in text:
        text = _MARKUP.sub(" \uE000 ", text)
    if "#" in text:
        text = _TAG.sub(" \uE001 ", text)
    return _TERM.findall(_DIGITS.sub("0", text).lower())


def recurrence(found: list[str], lag: int | None = None) -> float:
    """Share of terms that stood already, within the last ``lag`` terms or anywhere before."""
    if lag is None:
        return 1 - len(set(found)) / len(found)
    last: dict[str, int] = {}
    hits = 0
    for i, t in enumerate(found):
        hits += i - last.get(t, -lag - 1) <= lag
        last[t] = i
    return hits / len(found)


@cache
def _signs(size: int) -> np.ndarray:
    return np.random.default_rng(7).choice(np.array([-1.0, 1.0]), (ROUNDS, size))


def _lags(codes: np.ndarray, distinct: int) -> list[int]:
    """Lags to try: all of a short stretch, else those of the largest estimates from transforms of random signs of the terms."""
    n = len(codes)
    near = [k for k in LAGS if n - k >= 8]
    if n <= DIRECT:
        return [*near, *(k for k in range(LAGS.stop, n // 2 + 1) if n - k >= 8)]
    size = 1 << (2 * n - 1).bit_length()
    power = np.zeros(size // 2 + 1)
    for signs in _signs(1 << distinct.bit_length()):
        power += np.abs(np.fft.rfft(signs[codes], size)) ** 2
    share = np.fft.irfft(power, size)[: n // 2 + 1] / (n - np.arange(n // 2 + 1))
    share[: LAGS.stop] = -1
    return [*near, *np.argsort(share)[-8:].tolist()]


def autocorrelation(found: list[str]) -> float:
    """Largest share, over lags up to half the length, of places whose term stands again that many places on."""
    known: dict[str, int] = {}
    codes = np.array([known.setdefault(t, len(known)) for t in found])
    if len(known) == len(found):
        return 0.0
    n = len(codes)
    return max((float(np.count_nonzero(codes[:-k] == codes[k:])) / (n - k) for k in _lags(codes, len(known))), default=0.0)


def near_terms(found: list[str], lag: int = LAG) -> list[bool]:
    """Whether each term stands again within ``lag`` terms, before or after."""
    last: dict[str, int] = {}
    near = [False] * len(found)
    for i, t in enumerate(found):
        j = last.get(t, -lag - 1)
        if i - j <= lag:
            near[i] = near[j] = True
        last[t] = i
    return near


def needed_share(found: list[str]) -> float:
    """Share of function words among the words; links, tags and marks are none."""
    said = [t for t in found if t not in _MARKS]
    return sum(map(_NEEDED.__getitem__, said)) / max(1, len(said))


def is_list(found: list[str], breaks: int = 0, sentence: bool = False) -> bool:
    """Whether the terms of a loose stretch, or of one long sentence or turn, are a list or keyword string.

    ``breaks`` are the line breaks between lines of the stretch, marks too if lines are short. In a ``sentence`` only marks of one kind
    count, as commas may stand in any.
    """
    n = len(found)
    if n < 8:
        return bool(found) and all(t in _CLASSES for t in found)
    needed, far = needed_share(found), recurrence(found)
    if needed < NEEDED:
        kinds = Counter(t for t in found if t in _MARKS or t in _CLASSES)
        said = n - sum(c for m, c in kinds.items() if m in _MARKS)
        # no sentence is long without a function word; shorter rows of nouns are told by what parts them
        if said >= (2 * ROW if sentence else ROW):
            return True
        if sentence:
            if said >= LONG and max(kinds.values(), default=0) >= SENTENCE_MARKS * n:
                return True
        elif sum(kinds.values()) >= MARKS * n or sum(kinds.values()) + breaks >= BREAKS * (n + breaks):
            return True
    # few terms that recur anywhere leave fewer that recur nearby
    if far < REGULAR_RECURS:
        return False
    near = recurrence(found, LAG)
    if near >= RECURS:
        return True
    if (far if needed < FAR_NEEDED else near) >= REGULAR_RECURS and autocorrelation(found) >= REGULAR:
        return True
    if needed >= FAR_NEEDED:
        return False
    # long prose recurs too, but half of its words stand once
    count = Counter(found)
    return far >= RECURS and n > 2 * LAG and sum(c == 1 for c in count.values()) <= ONCE * len(count)


class Unit(NamedTuple):
    """A piece of text and its words."""

    text: str
    size: int


def one_phrase(run: list[Unit]) -> list[Unit]:
    """The sentences of a run that say few terms again and again: without function words, nearly all their terms near an equal one, few of them different."""
    cut = [terms(u.text) for u in run]
    bare = [needed_share(c) < FAR_NEEDED for c in cut]
    if sum(len(c) for c, b in zip(cut, bare, strict=True) if b) < LAG:
        return []
    near = iter(near_terms([t for c in cut for t in c]))
    shares = [sum(next(near) for _ in c) / max(1, len(c)) for c in cut]
    alike = [i for i in range(len(cut)) if bare[i] and shares[i] >= SENTENCES_RECUR]
    found = [t for i in alike for t in cut[i]]
    return [run[i] for i in alike] if len(found) >= LAG and recurrence(found) >= RECURS else []


def words(text: str) -> int:
    """Words by blanks that hold a letter or digit."""
    cut = text.split()
    return len(cut) - len([w for w in cut if not w[0].isalnum() and not _WORD.search(w)])


def turns(text: str) -> list[tuple[bool, str]]:
    """The lines of a text, cut before speakers too, and whether a speaker says them.

    A speaker is a short head before a colon that recurs in the text, numbers in it being equal; where most lines have a head
    each, as in a glossary, all are taken for such.
    """
    heads = list(_HEAD.finditer(text)) if ":" in text else []
    if not heads:
        return [(False, line) for line in text.split("\n")]
    named = [_DIGITS.sub("0", m[1] or m[2]) for m in heads]
    count = Counter(named)
    begin = lambda m: not m.start() or text[m.start() - 1] == "\n"
    lines = [line for line in text.split("\n") if line.strip()]
    whole = 2 * sum(map(begin, heads)) > len(lines) > 2
    out: list[tuple[bool, str]] = []
    at, said = 0, False

    def take(piece: str) -> None:
        nonlocal said
        for k, line in enumerate(piece.split("\n")):
            # a turn ends with its line
            out.append((said and not k, line))
        said = False

    for m, name in zip(heads, named, strict=True):
        if count[name] > 1 or (whole and begin(m)):
            take(text[at : m.start()])
            said, at = True, m.end()
    take(text[at:])
    return out


def parts_of(text: str) -> tuple[list[list[Unit]], list[list[Unit]], list[Unit]]:
    """Runs of loose stretches, runs of sentences, and turns: whatever stands between two of one kind ends their run."""
    loose: list[list[Unit]] = [[]]
    sentences: list[list[Unit]] = [[]]
    said: list[Unit] = []

    def end(runs: list[list[Unit]]) -> None:
        if runs[-1]:
            runs.append([])

    linked = bool(_DOTTED.search(text))
    anchored = "<a" in text or "](" in text
    for turn, line in turns(text):
        start = 0
        if turn:
            if line.strip():
                said.append(Unit(line, words(line)))
            end(loose)
            end(sentences)
            continue
        for mark in _END.finditer(line):
            piece = line[start : mark.end()]
            start = mark.end()
            size = words(piece)
            plain = replace_links(piece, "") if linked else piece
            if (anchored and _ANCHOR.search(piece)) or (plain != piece and words(plain) < 0.5 * size):
                loose[-1].append(Unit(piece, size))
            else:
                sentences[-1].append(Unit(piece, size))
                end(loose)
        rest = line[start:]
        if rest.strip():
            loose[-1].append(Unit(rest, words(rest)))
            end(sentences)
    return [r for r in loose if r], [r for r in sentences if r], said


def stuffed_share(text: str | None) -> tuple[float, float, float]:
    """Share of words in lists, and recurrence and autocorrelation of the terms of loose stretches and of other lists."""
    loose, sentences, said = parts_of(text or "")
    total = sum(u.size for run in (*loose, *sentences, said) for u in run)
    if not total:
        return 0.0, 0.0, 0.0
    long = lambda units: [u for u in units if u.size >= LONG and is_list(terms(u.text), sentence=True)]
    # turns of speakers may be short and alike; rows of other sentences may not
    listed = long(said)
    for run in sentences:
        alike = one_phrase(run) if sum(u.size for u in run) >= LAG else []
        listed += alike + long([u for u in run if u not in alike] if alike else run)
    known = sum(u.size for u in listed)
    free = [u for run in loose for u in run]
    found = terms("\n".join(u.text for u in free))
    if found and is_list(found):
        known += sum(u.size for u in free)
    else:
        # a list may stand among lines that aren't one: judge runs of lines on their own, and lines of other runs
        for run in loose:
            if is_list(terms("\n".join(u.text for u in run)), breaks=len(run) - 1):
                known += sum(u.size for u in run)
            elif len(run) > 1:
                known += sum(u.size for u in run if is_list(terms(u.text)))
    shown = found + [t for u in listed for t in terms(u.text)]
    return (known / total, recurrence(shown), autocorrelation(shown)) if shown else (known / total, 0.0, 0.0)


def stuffing(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (``key``, share, recurrence, autocorrelation) of all texts.

    ``share`` is the part of a text's words, 0 to 1, that belongs to keyword strings, lists of links
    or tags. Null, empty and blank texts have 0. Repeated rows stay. The work is linear in the
    length of a text but for a transform's logarithm, and needs no shuffle.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *stuffed_share(t)) for k, t in zip(pdf["_key"], pdf["_text"], strict=True)]
            yield pd.DataFrame(rows, columns=[key, "share", "recurrence", "autocorrelation"])

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInPandas(run, f"{key} {kind}, share double, recurrence double, autocorrelation double")
