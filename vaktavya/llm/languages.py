"""Languages of code-switched texts: a linear-chain conditional random field over words.

A word's features are itself, its affixes, its letter trigrams, and its shares by language in a
lexicon. Script limits the languages a word may have; Latin letters may write any. Learned
transitions keep stretches together. Forward-backward gives each word's probability by language. Names,
numbers and the like carry no language: they take part in the chain with no evidence of their own.

The model is fitted on a bounded sample of labelled utterances (``SAMPLE`` rows at most of each label). A label
tells the language of each word: that of the utterance, or in mixed ones English for Latin words and
the other language for words in its script. Mixed utterances in Latin letters alone leave that open and don't
take part, nor do those whose script contradicts the label; words that carry no language stay latent.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Languages, and the scripts of their own.
LANGUAGES = ("en", "bn", "gu", "hi", "kn", "ml", "mr", "ta", "te")
SCRIPTS = {0x0900: ("hi", "mr"), 0x0980: ("bn",), 0x0A80: ("gu",), 0x0B80: ("ta",), 0x0C00: ("te",), 0x0C80: ("kn",), 0x0D00: ("ml",)}
#: Utterances of each label that the model is fitted on; passes, rate and penalty of the fit.
SAMPLE, PASSES, RATE, PENALTY, BATCH = 500, 5, 0.5, 1e-3, 400
#: Start of the sums of squared slopes.
SMOOTH = 1.0
#: Passes after which labelled texts are left out whose words get less than this share of probability on the label.
TRUSTING_PASSES, DOUBT = 2, 0.7
#: Hashed features; words that are labelled at a time in a longer text, with as many on each side as context; words in a row that make a language present.
BUCKETS, WINDOW, CONTEXT, RUN = 1 << 16, 2000, 100, 3
#: Places of a padded matrix that are labelled at a time.
CELLS = 400_000
_INDEX = {c: i for i, c in enumerate(LANGUAGES)}
_N = len(LANGUAGES)
_HIDDEN = -1e4

_DIGIT = re.compile(r"\d")
_UNSEEN = re.compile("[­​-‏‪-‮⁠-⁯﻿]")
_EDGES = " \t\n.,;:?!\"'()[]{}।॥“”‘’-–—"


def bare_word(raw: str) -> tuple[str, bool]:
    """A word's form for comparisons, and whether it tells a language. Words with digits or marks inside and capitalized ones don't."""
    if not raw.isascii():
        raw = unicodedata.normalize("NFKC", _UNSEEN.sub("", raw))
        raw = raw.translate(_latin())
    word = raw.strip(_EDGES)
    if not word or any(c.isdigit() or c in "@#/_.:" for c in word):
        return "", False
    if len(word) == 1 and word not in "aAIiઆએजछयই" and word.isascii():
        return "", False
    return word.lower(), True


@cache
def _latin() -> dict[int, str]:
    from vaktavya.llm.unify import LOOKALIKES

    return {ord(a): k for k, v in LOOKALIKES.items() for a in v}


def script_of(word: str) -> int:
    """The block of the script of a word's first letter outside of ASCII, or 0 for Latin."""
    for c in word:
        block = ord(c) & ~0x7F
        if block in SCRIPTS:
            return block
    return 0


@cache
def allowed_by_script(block: int) -> np.ndarray:
    """True for languages that may be written so."""
    mask = np.ones(_N, bool)
    if block:
        mask[:] = False
        mask[[_INDEX[c] for c in SCRIPTS[block]]] = True
    return mask


def feature_ids(word: str) -> list[int]:
    """Hashed features of a word: itself, affixes, trigrams."""
    w = f"<{word}>"
    parts = [f"w{word}", *(f"p{w[: k + 1]}" for k in (1, 2, 3, 4)), *(f"s{w[-k - 1 :]}" for k in (1, 2, 3, 4)), *(f"t{w[i : i + 3]}" for i in range(len(w) - 2))]
    return sorted({zlib.crc32(p.encode()) % BUCKETS for p in parts})


class Model:
    """Weights of the field."""

    def __init__(self, theta: np.ndarray, moves: np.ndarray, starts: np.ndarray, lexicon: dict[str, np.ndarray], trust: np.ndarray, rival: float = 0.0) -> None:
        self.theta, self.moves, self.starts, self.lexicon, self.trust, self.rival = theta, moves, starts, lexicon, trust, rival
        self.kept: dict[str, int] = {}
        self.rows: list[np.ndarray] = [np.zeros(_N, np.float32)]
        self.table: np.ndarray | None = None

    def row(self, raw: str) -> int:
        """The place of a word's emission scores; place 0 is of words that tell nothing."""
        at = self.kept.get(raw)
        if at is None:
            word, tells = bare_word(raw)
            if not tells:
                at = 0
            else:
                score = self.theta[feature_ids(word)].sum(0)
                if word in self.lexicon:
                    score = score + self.trust * self.lexicon[word]
                score = np.where(allowed_by_script(script_of(word)), score, _HIDDEN)
                at = len(self.rows)
                self.rows.append(score.astype(np.float32))
                self.table = None
            self.kept[raw] = at
        return at

    def forget(self, most: int = 300_000) -> None:
        """Drop the kept words if there are too many."""
        if len(self.kept) > most:
            self.kept.clear()
            del self.rows[1:]
            self.table = None

    def posteriors(self, ids: np.ndarray) -> np.ndarray:
        """Probabilities (texts, words, languages) for a padded matrix of places, -1 beyond the end.

        If ``rival`` is set, a text in which several languages beside English come out is read once more, with all but
        the likeliest of them held back by that much a word: near languages of one script then don't
        share it, while words whose script leaves no choice keep theirs.
        """
        if self.table is None:
            self.table = np.vstack(self.rows)
        real = ids >= 0
        emit = np.where(real[:, :, None], self.table[ids], 0.0)
        post = forward_backward(emit, real, self.moves, self.starts)[0]
        if not self.rival:
            return post
        tells = ids > 0
        mass = (post * tells[:, :, None]).sum(1)
        mass[:, 0] = 0
        label = np.where(tells, post.argmax(2), 0)
        rivals = np.array([(label == c).any(1) for c in range(1, _N)]).sum(0) > 1
        if rivals.any():
            held = np.full((int(rivals.sum()), _N), -self.rival)
            held[:, 0] = 0
            held[np.arange(len(held)), mass[rivals].argmax(1)] = 0
            longest = int(real[rivals].sum(1).max())
            again = np.where(tells[rivals, :longest, None], emit[rivals, :longest] + held[:, None, :], 0.0)
            post[rivals, :longest] = forward_backward(again, real[rivals, :longest], self.moves, self.starts)[0]
        return post


def forward_backward(emit: np.ndarray, real: np.ndarray, moves: np.ndarray, starts: np.ndarray, pairs: bool = False):
    """Posteriors of a batch by scaled forward-backward; with ``pairs`` also summed pair posteriors and log likelihoods."""
    b, t, n = emit.shape
    top = emit.max(2, keepdims=True)
    e = np.exp(emit - top)
    step = np.exp(moves)
    alpha = np.empty((t, b, n))
    scale = np.ones((t, b))
    a = np.exp(starts) * e[:, 0]
    for i in range(t):
        if i:
            nxt = (a @ step) * e[:, i]
            a = np.where(real[:, i, None], nxt, a)
        s = a.sum(1)
        s = np.where(real[:, i] | (i == 0), s, 1.0)
        a = a / np.where(s > 0, s, 1.0)[:, None]
        scale[i] = s
        alpha[i] = a
    beta = np.ones((b, n))
    post = np.empty((b, t, n))
    both = np.zeros((n, n))
    for i in range(t - 1, -1, -1):
        p = alpha[i] * beta
        post[:, i] = p / p.sum(1, keepdims=True)
        if i:
            inner = e[:, i] * beta / scale[i][:, None]
            if pairs:
                both += np.where(real[:, i, None], alpha[i - 1], 0.0).T @ inner * step
            beta = np.where(real[:, i, None], inner @ step.T, beta)
    return (post, both) if pairs else (post,)


def label_codes(tag: str | None) -> tuple[str, ...] | None:
    """The known codes of a tag, sorted; None if it names none or an unknown one."""
    codes = sorted({c for c in re.split(r"[^a-z]+", (tag or "").strip().lower()) if c})
    return tuple(codes) if codes and all(c in _INDEX for c in codes) else None


def _pieces(text: str, size: int = 400) -> Iterator[list[str]]:
    """A text's words, in pieces that fit side by side into one batch."""
    words = text.split()
    for a in range(0, len(words), size):
        yield words[a : a + size]


def fit(rows: list[tuple[str, tuple[str, ...]]]) -> Model:
    """Fit on (text, codes of the label). Texts whose script contradicts the codes, or leaves the words' languages open, are left out."""
    words: dict[str, int] = {}
    texts: list[tuple[list[int], np.ndarray]] = []
    counts: Counter[tuple[str, int]] = Counter()
    for text, codes in ((piece, codes) for text, codes in rows for piece in _pieces(text)):
        label = np.zeros(_N, bool)
        label[[_INDEX[c] for c in codes]] = True
        english = np.arange(_N) == 0
        known = [(w, script_of(w)) if tells else None for w, tells in map(bare_word, text)]
        if len(codes) > 1 and not any(k and k[1] for k in known):
            continue
        # English may stand in a text of one label whose other words are in its language's script
        latin = english if len(codes) > 1 else label | english if any(k and k[1] for k in known) else label
        masks = [label if k is None else allowed_by_script(k[1]) & (label if k[1] else latin) for k in known]
        if known and all(m.any() for m in masks):
            texts.append(([words.setdefault(k[0], len(words)) if k else -1 for k in known], np.array(masks)))
            counts.update((k[0], int(m.argmax())) for k, m in zip(known, masks, strict=True) if k and m.sum() == 1)
    totals = np.ones(_N)
    for (_, c), k in counts.items():
        totals[c] += k
    lexicon: dict[str, np.ndarray] = {}
    for (w, c), k in counts.items():
        lexicon.setdefault(w, np.zeros(_N))[c] = k / totals[c]
    for w, share in lexicon.items():
        x = np.log(share + 1e-5)
        lexicon[w] = x - x.mean()
    full = np.zeros((BUCKETS, _N), np.float32)
    moves, starts, trust = np.eye(_N), np.zeros(_N), np.full(_N, 0.5)
    if not texts:
        return Model(full, moves, starts, lexicon, trust)
    feats = [np.array(feature_ids(w)) for w in words] or [np.array([0])]
    sizes = np.array([len(f) for f in feats])
    used_features, flat = np.unique(np.concatenate(feats), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(sizes)])
    lex = np.array([lexicon.get(w, np.zeros(_N)) for w in words] or [np.zeros(_N)])
    masks = np.array([allowed_by_script(script_of(w)) for w in words] or [np.ones(_N, bool)])
    theta = np.zeros((len(used_features), _N))
    seen = [np.full(x.shape, SMOOTH) for x in (theta, moves, starts, trust)]
    order = np.random.default_rng(3)
    doubted = np.zeros(len(texts), bool)
    for turn in range(PASSES):
        at = order.permutation(np.flatnonzero(~doubted))
        for cut in range(0, len(at), BATCH):
            batch = [texts[i] for i in at[cut : cut + BATCH]]
            longest = max(len(i) for i, _ in batch)
            ids = np.full((len(batch), longest), -2)
            allowed = np.ones((len(batch), longest, _N), bool)
            for r, (i, m) in enumerate(batch):
                ids[r, : len(i)] = i
                allowed[r, : len(i)] = m
            known, real = ids >= 0, ids > -2
            here = np.unique(ids[known]) if known.any() else np.array([0])
            local = np.searchsorted(here, np.where(known, ids, here[0]))
            places = np.concatenate([np.arange(first[w], first[w + 1]) for w in here])
            own = np.repeat(np.arange(len(here)), sizes[here])
            cuts = np.concatenate([[0], np.cumsum(sizes[here])[:-1]])
            score = np.add.reduceat(theta[flat[places]], cuts, axis=0)
            score = np.where(masks[here], score + trust * lex[here], _HIDDEN)
            emit = np.where(known[:, :, None], score[local], 0.0)
            free, free_pairs = forward_backward(emit, real, moves, starts, True)
            held, held_pairs = forward_backward(np.where(allowed, emit, _HIDDEN), real, moves, starts, True)
            if turn >= TRUSTING_PASSES - 1:
                # a text whose words the model gives to other languages has a wrong label
                agreed = (np.where(allowed, free, 0.0).sum(2) * known).sum(1) / np.maximum(1, known.sum(1))
                doubted[at[cut : cut + BATCH]] = agreed < DOUBT
            slope = (held - free)[known]
            by_word = np.stack([np.bincount(local[known], slope[:, c], len(here)) for c in range(_N)], 1)
            spread_out = by_word[own]
            g_theta = np.stack([np.bincount(flat[places], spread_out[:, c], len(theta)) for c in range(_N)], 1)
            grads = (g_theta, held_pairs - free_pairs, (held[:, 0] - free[:, 0]).sum(0), (by_word * lex[here]).sum(0))
            for x, g, s in zip((theta, moves, starts, trust), grads, seen, strict=True):
                g = g - PENALTY * x * len(batch)
                s += g * g
                x += RATE * g / np.sqrt(s)
    full[used_features] = theta
    return Model(full, moves, starts, lexicon, trust)


def labelled_sample(df: DataFrame, text: str, language: str, tag: str, mixed: str, sample: int = SAMPLE) -> list[tuple[str, tuple[str, ...]]]:
    """At most ``sample`` texts for each label whose three parts agree: those of the smallest hashes.

    How many different texts a label has is estimated in one pass; twice the share that is wanted passes by its hash, and
    only those texts are told apart and ranked. How often a text stands in the table changes nothing.
    """
    codes = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.trim(tag)), "[^a-z]+"), lambda c: c != "")))
    spoken = F.lower(F.trim(language))
    agree = (F.array_contains(codes, spoken)) & (F.size(codes) == F.when(F.col(mixed), 2).otherwise(1))
    rows = df.where(F.col(text).isNotNull() & F.col(mixed).isNotNull()).select(F.col(text).alias("t"), F.array_join(codes, "-").alias("c"), agree.alias("a")).where("a")
    rows = rows.where(F.col("c").isin(*LANGUAGES, *("-".join(sorted(("en", c))) for c in LANGUAGES[1:])))
    rows = rows.select("c", "t", F.xxhash64("t").alias("h"))
    total = {r["c"]: r["n"] for r in rows.groupBy("c").agg(F.approx_count_distinct("h").alias("n")).collect()}
    share = F.lit(0.0)
    for c, n in total.items():
        share = F.when(F.col("c") == c, min(1.0, 2 * sample / n)).otherwise(share)
    near = rows.where(F.pmod("h", F.lit(1_000_003)) / 1_000_003.0 < share).dropDuplicates(["c", "t"])
    place = F.row_number().over(Window.partitionBy("c").orderBy(F.pmod("h", F.lit(1_000_003)), "t"))
    kept = near.withColumn("place", place).where(F.col("place") <= sample).select("c", "t").collect()
    return [(r["t"], tuple(r["c"].split("-"))) for r in sorted(kept)]


_MAIL = re.compile(r"(?i)\bdot\b|\brate\b|\bunderscore\b|[(\[]at[)\]]")


def without_addresses(words: list[str]) -> list[str]:
    """The words, with those of e-mail addresses that are spoken or spelled in brackets replaced by a mark."""
    out = list(words)
    for i, w in enumerate(words):
        low = w.lower().strip("()[].,?!")
        if low in ("dot", "underscore"):
            out[max(0, i - 1) : i + 2] = ["@"] * len(out[max(0, i - 1) : i + 2])
        elif low == "rate" and i >= 2 and words[i - 1].lower() == "the" and not (i + 1 < len(words) and words[i + 1].lower() == "of"):
            out[i - 3 if i >= 3 else 0 : i + 2] = ["@"] * len(out[i - 3 if i >= 3 else 0 : i + 2])
        elif low == "at" and w[0] in "([":
            out[max(0, i - 1) : i + 2] = ["@"] * len(out[max(0, i - 1) : i + 2])
    return out


def segments(model: Model, texts: list[str | None]) -> list[list[tuple[int, int, str, float, int]]]:
    """Per text, stretches of one language: first word, word after the last, language, confidence, most words in a row that tell it."""
    ids, kept = [], []
    split = [without_addresses(t.split()) if t and _MAIL.search(t) else (t or "").split() for t in texts]
    for k, words in enumerate(split):
        rows = [model.row(w) for w in words]
        for a in range(0, len(words), WINDOW):
            # words far away say nothing about a word: a window with context labels as the whole text does
            left = max(0, a - CONTEXT)
            ids.append(rows[left : a + WINDOW + CONTEXT])
            kept.append((k, a - left, min(len(words), a + WINDOW) - left))
    order = sorted(range(len(ids)), key=lambda i: len(ids[i]))
    found: dict[int, list[tuple[int, float, bool]]] = {}
    at = 0
    while at < len(order):
        size = max(1, min(512, CELLS // len(ids[order[min(at + 511, len(order) - 1)]])))
        part = order[at : at + size]
        at += size
        matrix = np.full((len(part), len(ids[part[-1]])), -1)
        for r, i in enumerate(part):
            matrix[r, : len(ids[i])] = ids[i]
        post = model.posteriors(matrix)
        label, sure = post.argmax(2), post.max(2)
        for r, i in enumerate(part):
            _, first, end = kept[i]
            found[i] = list(zip(label[r, first:end].tolist(), sure[r, first:end].tolist(), (matrix[r, first:end] > 0).tolist(), strict=True))
    best: list[list[tuple[int, float, bool]]] = [[] for _ in texts]
    for i, (k, _, _) in enumerate(kept):
        best[k] += found[i]
    return [_stretches(words, row) for words, row in zip(split, best, strict=True)]


def _stretches(words: list[str], row: list[tuple[int, float, bool]]) -> list[tuple[int, int, str, float, int]]:
    out, i, n = [], 0, len(row)
    capital = [w[0].isupper() and len(w.strip(_EDGES)) > 1 for w in words]
    # where most words have a capital, it tells no name
    if 2 * sum(capital) > n:
        capital = [False] * n
    while i < n:
        if not row[i][2]:
            i += 1
            continue
        j, last, total, told, row_of, longest = i, i, 0.0, 0, 0, 0
        while j < n and (not row[j][2] or row[j][0] == row[i][0]):
            if row[j][2]:
                last = j
                # a capital inside of a text may begin a name
                if not (capital[j] and j):
                    total, told, row_of = total + row[j][1], told + 1, row_of + 1
                    longest = max(longest, row_of)
            elif _DIGIT.search(words[j]):
                # words on both sides of a number aren't in a row
                row_of = 0
            j += 1
        out.append((i, last + 1, LANGUAGES[row[i][0]], total / told if told else row[i][1], longest))
        i = j
    return out


def present(parts: list[tuple[int, int, str, float, int]], run: int = RUN) -> dict[str, float]:
    """Languages with ``run`` words or more in a row, and the confidence of the surest stretch of each."""
    out: dict[str, float] = {}
    for _, _, code, sure, told in parts:
        if told >= run:
            out[code] = max(sure, out.get(code, 0.0))
    return out


def contradicts(codes: set[str], language: str | None, tag: str | None, mixed: bool | None) -> bool:
    """Whether a label is missing or differs from the languages really there."""
    if not codes:
        return False
    named = label_codes(language)
    if named is None or label_codes(tag) is None or mixed is None or pd.isna(mixed):
        return True
    right = (codes - {"en"}) if len(codes) > 1 else codes
    return not (len(named) == 1 and named[0] in right) or set(label_codes(tag)) != codes or bool(mixed) != (len(codes) > 1)


def detect(df: DataFrame, key: str, text: str, language: str, tag: str, mixed: str, rival: float = 0.0) -> DataFrame:
    """Rows (``key``, languages, segments, wrong) of every utterance.

    ``languages`` lists (language, confidence) of the languages with three words or more in a row;
    ``segments`` lists (first, last, language, confidence) of all stretches, words counted from 0.
    ``wrong`` is true for utterances of five words or more whose labels are missing or contradict the text.
    Null, empty and blank texts have empty lists and aren't wrong. Repeated rows stay. Very
    long texts are labelled whole, ``WINDOW`` words at a time with context on both sides. ``rival`` is what a word pays for a
    further language beside English and the likeliest one; 0 lets texts hold any number of languages.
    """
    model = fit(labelled_sample(df, text, language, tag, mixed))
    shared = df.sparkSession.sparkContext.broadcast((model.theta, model.moves, model.starts, model.lexicon, model.trust))
    kind = dict(df.dtypes)[key]
    names = [F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(language).alias("_l"), F.col(tag).alias("_t"), F.col(mixed).alias("_m")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = Model(*shared.value, rival)
        for pdf in batches:
            field.forget()
            found = segments(field, list(pdf["_text"]))
            langs = [present(p) for p in found]
            long = [len((t or "").split()) >= 5 for t in pdf["_text"]]
            yield pd.DataFrame(
                {
                    key: pdf["_key"],
                    "languages": [[{"language": c, "confidence": s} for c, s in sorted(x.items())] for x in langs],
                    "segments": [[{"first": a, "last": b - 1, "language": c, "confidence": s} for a, b, c, s, _ in p] for p in found],
                    "wrong": [
                        w and contradicts(set(x), l, t, m) for w, x, l, t, m in zip(long, langs, pdf["_l"], pdf["_t"], pdf["_m"], strict=True)
                    ],
                }
            )

    return df.select(*names).mapInPandas(
        run,
        f"{key} {kind}, languages array<struct<language string, confidence double>>, "
        "segments array<struct<first int, last int, language string, confidence double>>, wrong boolean",
    )
