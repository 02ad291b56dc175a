"""Pairs of spans that a judge calls one word written in two ways: verified by rule, then applied."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

from vaktavya.functions.plain import edits, plain_normalize
from vaktavya.semantic import sounds

#: Likeness of sounds that a pair in two scripts needs if its consonants alone don't settle it.
LEAST_LIKENESS = 60.0
#: Words of the longest number phrase that is verified.
NUMBER_WORDS = 8


class Verdict(NamedTuple):
    """Whether a pair is accepted, and why not."""

    accepted: bool
    reason: str = "ok"


def _no(reason: str) -> Verdict:
    return Verdict(False, reason)


def _numerals(text: str) -> list[str]:
    return [t for t in text.split() if t.isdigit()]


def same_number(digits: str, words: str) -> bool:
    """Whether number words, as written, romanized, or read as English, have exactly the value and the other words of ``digits``."""
    value, rest = "".join(_numerals(digits)), [t for t in digits.split() if not t.isdigit()]
    for reading in (words, sounds.latin(words), sounds.english_numbers(words)):
        if reading:
            normal = plain_normalize(reading)
            if "".join(_numerals(normal)) == value and [t for t in normal.split() if not t.isdigit()] == rest:
                return True
    return False


def _filler(h: str, r: str, _: float, __: bool) -> Verdict:
    if h and r:
        return _no("a filler stands on one side only")
    return Verdict(True) if sounds.hesitation(h or r) else _no("not a hesitation")


def _number(h: str, r: str, _: float, unverified: bool) -> Verdict:
    if bool(_numerals(h)) == bool(_numerals(r)):
        return _no("a number pair has digits on exactly one side")
    digits, words = (h, r) if _numerals(h) else (r, h)
    if len(words.split()) > NUMBER_WORDS:
        return _no("too many number words")
    if same_number(digits, words):
        return Verdict(True)
    return Verdict(True, "value not verified") if unverified else _no("value can't be verified")


def _one_indic_script(h: str, r: str) -> Verdict:
    if sounds.consonants(h) != sounds.consonants(r):
        return _no("a consonant differs")
    script = sounds.script_of(h)
    if script in sounds.ENDING_IS_GRAMMAR and sounds.ending(h, script) != sounds.ending(r, script):
        return _no("the ending differs, which is grammar")
    return Verdict(True)


def _split(h: str, r: str, _: float, __: bool) -> Verdict:
    if len(h.split()) == len(r.split()):
        return _no("a split has differing word counts")
    a, b = h.replace(" ", ""), r.replace(" ", "")
    if a == b:
        return Verdict(True)
    scripts = {sounds.script_of(t) for t in (*h.split(), *r.split())} - {""}
    indic = scripts - {"LATIN"}
    if len(indic) > 1:
        return _no("two Indic scripts")
    if not indic:
        return _no("joined forms differ")
    if "LATIN" not in scripts:
        return _one_indic_script(h, r)
    close = sounds.skeletons_agree(a, b, 90) and sounds.sound_likeness(a, b) >= 80
    return Verdict(True) if close else _no("joined forms differ")


def _word(across: bool) -> Callable[[str, str, float, bool], Verdict]:
    def rule(h: str, r: str, least: float, _: bool) -> Verdict:
        if abs(len(h.split()) - len(r.split())) > 1:
            return _no("word counts differ too much")
        a, b = sounds.script_of(h), sounds.script_of(r)
        if a != b and "LATIN" not in (a, b):
            return _no("two Indic scripts")
        if across and a == b:
            return _no("a script pair in one script")
        if across:
            alike = sounds.skeletons_agree(h, r, 75) or (sounds.sound_likeness(h, r) >= least and sounds.skeletons_agree(h, r, 50))
            return Verdict(True) if alike else _no("sounds differ")
        if a != b:
            return _no("a spelling pair across scripts")
        if a == "LATIN":
            return _no("Latin spellings are the normalizer's")
        return _one_indic_script(h, r)

    return rule


RULES: dict[str, Callable[[str, str, float, bool], Verdict]] = {
    "script": _word(True), "spelling": _word(False), "split_join": _split, "number": _number, "filler": _filler,
}


def verify_pair(hypothesis: str, reference: str, kind: str, least: float = LEAST_LIKENESS, allow_unverified_numbers: bool = False) -> Verdict:
    """Whether two normalized spans are one word written in two ways, by the rule of the pair's kind."""
    rule = RULES.get((kind or "").strip().lower())
    if rule is None:
        return _no("unknown kind")
    if hypothesis == reference:
        return _no("spans are the same")
    if rule is not _filler and not (hypothesis and reference):
        return _no("a span is empty")
    if rule not in (_filler, _number) and (_numerals(hypothesis) or _numerals(reference)):
        return _no("digits outside of a number pair")
    return rule(hypothesis, reference, least, allow_unverified_numbers)


def find(words: list[str], span: list[str]) -> list[int]:
    """Places at which a span stands."""
    return [i for i in range(len(words) - len(span) + 1) if words[i : i + len(span)] == span]


def deletions(reference: list[str], hypothesis: list[str]) -> list[tuple[int, int, int]]:
    """Runs of reference words that an alignment of fewest edits leaves out: first, end, and the place in the hypothesis.

    Of several such alignments, the one that prefers, from the end, matches and replacements, then deletions.
    """
    n, m = len(reference), len(hypothesis)
    cost = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (reference[i - 1] != hypothesis[j - 1]))
    gone, i, j = [], n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (reference[i - 1] != hypothesis[j - 1]):
            i, j = i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            if gone and gone[-1][0] == i + 1 and gone[-1][2] == j:
                gone[-1] = (i, gone[-1][1], j)
            else:
                gone.append((i, i + 1, j))
        else:
            j -= 1
    return gone[::-1]


def apply_pairs(
    reference: str, hypothesis: str, pairs: list[dict[str, Any]] | None, least: float = LEAST_LIKENESS, allow_unverified_numbers: bool = False
) -> dict[str, Any]:
    """Rewrite a normalized hypothesis by verified pairs, in their order, wherever that lowers the edits; the reference stays.

    Returns hypothesis, word_edits, accepted and rejected pairs, the latter with a reason. Edits never rise.
    """
    ref, hyp = reference.split(), hypothesis.split()
    now = edits(ref, hyp)
    accepted: list[dict[str, str]] = []
    rejected: list[dict[str, str]] = []
    for pair in pairs or []:
        h, r = plain_normalize(pair.get("hypothesis_span")), plain_normalize(pair.get("reference_span"))
        kind = str(pair.get("type") or "").strip().lower()
        record = {"hypothesis_span": h, "reference_span": r, "type": kind}
        verdict = verify_pair(h, r, kind, least, allow_unverified_numbers)
        if verdict.accepted and r and not find(ref, r.split()):
            verdict = _no("not in the reference")
        if verdict.accepted and h and not find(hyp, h.split()):
            verdict = _no("not in the hypothesis")
        if not verdict.accepted:
            rejected.append({**record, "reason": verdict.reason})
            continue
        gained = False
        while True:
            if h:
                size = len(h.split())
                trials = [hyp[:i] + r.split() + hyp[i + size :] for i in find(hyp, h.split())]
            else:
                cut = next((j for a, b, j in deletions(ref, hyp) if hyp and ref[a:b] == r.split()), None)
                trials = [] if cut is None or gained else [hyp[:cut] + r.split() + hyp[cut:]]
            better = next((t for t in trials if edits(ref, t) < now), None)
            if better is None:
                break
            hyp, now, gained = better, edits(ref, better), True
        if gained:
            accepted.append(record)
        else:
            rejected.append({**record, "reason": "no edit is saved"})
    return {"hypothesis": " ".join(hyp), "word_edits": now, "accepted": accepted, "rejected": rejected}
