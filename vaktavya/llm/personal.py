"""Personal information in free text: found by a semi-Markov conditional random field, replaced by placeholders.

A text is a row of tokens. Candidate segments are spans of tokens that could be an e-mail address,
a phone number, an identity number, a street address or a name; each has features of the whole span
and of the words around it, and a score, the weighted sum of them. A labelling is a set of spans that
don't overlap; its weight is exp of the sum of their scores, tokens outside have 0. Dynamic programming over
token positions, with spans of bounded length, finds the best labelling: boundaries and types at once.
A text without a candidate has one labelling, so leaving the programme out for it changes nothing. Candidates are told by their shape
(digits, signs, capitals, a phrase or a known name before); words of lists are evidence that weights are learned for.

Weights are trained by maximum likelihood on examples that this module writes with a fixed seed; no
text of the tables is used for them. Names are known by two lists, given names and surnames, counted
over the whole input where a phrase introduces a name; the most frequent ones are sent to all executors, others joined to texts.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaktavya.llm.leakage import Folder
from vaktavya.semantic.sounds import phonetic

TYPES = ("email", "phone", "identity", "address", "name")
#: Tokens of the longest segment, by type.
LONGEST = {"email": 14, "phone": 16, "identity": 14, "address": 16, "name": 4}
#: Half the names of the input that every executor holds, the most frequent ones (others are joined to their texts), and the least count of one.
NAMES, NAME_COUNT = 20_000, 2

#: Spoken digits and the words that repeat one.
DIGITS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0", "o": "0"}
REPEATS = {"double": 2, "triple": 3}
#: Words that tell what stands near them, in English as they are spelled and in Indian languages by their sound, whatever
#: script or spelling a text has them in. They are evidence for a segment, never a condition of it.
WORDS = {
    "phone": ("phone mobile contact call reach ring text whatsapp otp telephone cell dial", "फोन मोबाइल ফোন போன் ఫోన్ ಫೋನ್ ഫോൺ ફોન"),
    "number": ("number no", "नंबर নম্বর நம்பர் నంబర్ ನಂಬರ್ നമ്പർ નંબર"),
    "identity": ("aadhaar aadhar adhaar adhar pan पैन passport voter kyc identity ssn social licence license tax", "आधार पासपोर्ट আধার ஆதார் ఆధార్ ಆಧಾರ್ ആധാർ આધાર"),
    "other": (
        "transaction reference ticket order policy meter serial invoice amount rs rupees bill slot code percent account docket batch receipt units",
        "रुपये টাকা ரூபாய் రూపాయలు ರೂಪಾಯಿ രൂപ રૂપિયા",
    ),
    "mail": ("email mail e-mail id write send copy drop", "ईमेल ইমেল மின்னஞ்சல் ఈమెయిల్ ಇಮೇಲ್ ഇമെയിൽ ઈમેલ"),
    "after_name": ("speaking here only today already at not called calling wrote told said", "है आहे છે"),
    "before_thing": ("the a an our your near old new from to in of on every next last", ""),
    "thing": ("plan card depot hub branch pack offer scheme bank app store bridge road street square voucher service", ""),
    "house": ("flat plot house door h.no h.no. hno apartment villa building quarter no block shop room", ""),
    "street": ("street lane road nagar colony layout cross main sector towers tower avenue marg gali chowk enclave floor tank mill society phase ward bazaar", ""),
    "common": (
        "the a an is are i you we my your please ask for at on in of to and it this that they he she gold plus plan card tuesday friday monday sunday saturday "
        "wednesday thursday depot branch number mr ms mrs hi who what why how when not only here today already speaking calling voice order one there right sorry "
        "yes no okay ok sir madam was were has have had do did can could will would should from with about again now late very but if so then",
        "",
    ),
    "mail_common": ("look looking us available site page more found see arrive meeting office only login visit", ""),
}
#: Phrases before a name and before an address, in English and Indian languages; they too are compared by sound.
NAME_PHRASES = (
    "my name is|name is|this is|i am calling for mr|i am calling for ms|calling for|account is under|please ask for|ask for|should read|account holder|mr|ms|mrs|hi|"
    "speaking with|talk to|myself|मेरा नाम|माझं नाव|माझा नाव|माझे नाव|আমার নাম|મારું નામ|என் பெயர்|నా పేరు|ನನ್ನ ಹೆಸರು|എന്റെ പേര്"
).split("|")
HOME_PHRASES = "address is|home is|deliver it to|deliver to|courier to|pickup from|collect from|shifted to|moved to|stay at|live at|lives at|come to|located at".split("|")

_SPOKEN_LINE = re.compile(r" ?\bunderscore\b ?")
_SPOKEN_DOT = re.compile(r" ?(?:\bdot\b|\(dot\)|\[dot\]) ?")
_SPOKEN_AT = re.compile(r" ?(?:\bat the rate(?: of)?\b|\(at\)|\[at\]|@|\bat\b) ?")
_SPOKEN_MARK = re.compile(r" ?([_-]|\bdash\b|\bplus\b) ?")
_DOMAIN = re.compile(r"^[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z][a-z0-9-]*$")
#: Last parts of domains that are common or reserved.
TLDS = frozenset("com org net in test example invalid co edu gov info io".split())
_MAIL_AT = frozenset(("@", "at", "rate", "(at)", "[at]"))
_ALNUM = re.compile(r"^[A-Z]{2,5}\d{4,8}[A-Z]?$")
_LOCAL = re.compile(r"^[\w.+-]+$")
_SSN = re.compile(r"^\d{3}-\d{2}-\d{4}$")
_PHONE_SHAPE = re.compile(r"^(?:\+\d{1,3}[- ]?)?(?:\(\d{3,4}\) ?)?[\d -]+$")
_HOUSE_NO = re.compile(r"^(?:\d+[A-Za-z]?|\d+(?:[-/]\d+)+)$")
_PIN = re.compile(r"^\d{6}$")
_NUMBERISH = re.compile(r"^[+(]*\d[\d()+-]*$")
_EDGE = ".,;:?!।॥\"'”’“‘()"


class Token(NamedTuple):
    """A token: without looks, outer punctuation and case; its sound; whether punctuation ends it; its marks and what it may be part of, as bits."""

    form: str
    bare: str
    low: str
    sound: str
    stop: bool
    marks: int
    uses: int


class Span(NamedTuple):
    """A candidate segment and its features."""

    start: int
    end: int
    kind: str
    features: tuple[str, ...]


def sound_of(word: str) -> str:
    """A word's sound without a last a, nasals alike: equal for an Indian word and its Latin spellings. The sign ~ sets it off from spellings."""
    # Latin spellings double a vowel to make it long
    word = word.replace("ee", "i").replace("oo", "u") if word.isascii() else word
    key = phonetic(word).replace("m", "n").replace(" ", "")
    return "~" + ((key.rstrip("a") or key) if len(key) > 2 else key)


_MARKS = {name: 1 << i for i, name in enumerate(WORDS)}


def _marks(words: int) -> dict[str, int]:
    """Marks by spelling (0) or by sound (1)."""
    found: dict[str, int] = {}
    for name, lists in WORDS.items():
        for word in lists[words].split():
            key = sound_of(word) if words else word
            found[key] = found.get(key, 0) | _MARKS[name]
    return found


_SPELLED, _SOUNDED = _marks(0), _marks(1)


_FOLD = Folder()


def plain_form(raw: str) -> str:
    """A token without invisible characters, full-width forms and letters of other scripts."""
    if raw.isascii():
        return raw
    word = unicodedata.normalize("NFKC", _FOLD.unseen.sub("", raw))
    if _FOLD.stand_in.search(word):
        plain = word.translate(_FOLD.latin)
        word = word if _FOLD.stand_in.search(plain) else plain
    return word


@cache
def _token_of(raw: str) -> Token:
    form = plain_form(raw)
    bare = form.strip(".,;:?!।॥\"'”’“‘")
    low = bare.lower()
    sound = sound_of(low)
    leads = _LEADS if low in _NAME_PHRASES or sound in _NAME_PHRASES else 0
    return Token(form, bare, low, sound, form[-1:] in ".,;:?!।॥", _SPELLED.get(low, 0) | _SOUNDED.get(sound, 0), _uses(form, bare, low) | leads)


class Tokens(dict):
    """Tokens met so far, forgotten when there are many."""

    def __missing__(self, raw: str) -> Token:
        if len(self) > 300_000:
            self.clear()
        found = self[raw] = _token_of.__wrapped__(raw)
        return found


def _by_last(phrases: list[str]) -> dict[str, list[tuple[str, ...]]]:
    found: dict[str, list[tuple[str, ...]]] = {}
    for p in phrases:
        # short English words are too alike by sound
        words = tuple(w if w.isascii() else sound_of(w) for w in p.split())
        found.setdefault(words[-1], []).append(words)
    return found


_NAME_PHRASES, _HOME_PHRASES = _by_last(NAME_PHRASES), _by_last(HOME_PHRASES)


def _phrase(tokens: list[Token], start: int, phrases: dict[str, list[tuple[str, ...]]]) -> bool:
    """Whether a phrase ends before ``start``."""
    if not start:
        return False
    last = tokens[start - 1]
    for p in (*phrases.get(last.low, ()), *(phrases.get(last.sound, ()) if last.sound != last.low else ())):
        if len(p) <= start and all(w in (t.low, t.sound) for t, w in zip(tokens[start - len(p) : start], p, strict=True)):
            return True
    return False


def _distance(tokens: list[Token], start: int, mark: str, back: int = 5) -> int:
    """Tokens back to the nearest one with a mark, 99 if there is none."""
    bit = _MARKS[mark]
    for k in range(1, min(back, start) + 1):
        if tokens[start - k].marks & bit:
            return k
    return 99


def _emails(tokens: list[Token]) -> Iterator[Span]:
    n = len(tokens)
    for i, t in enumerate(tokens):
        low = t.low.strip("()[]") if t.low in _MAIL_AT else t.low
        if not ("@" in t.form or "(at)" in t.low or "[at]" in t.form or low in ("at", "rate")):
            continue
        seen = set()
        for start in range(max(0, i - 6), i + 1):
            for end in range(i + 1, min(n, i + 7) + 1):
                if end - start > LONGEST["email"]:
                    continue
                text = " ".join(x.form for x in tokens[start:end]).strip(_EDGE.replace("(", "").replace(")", "") + "[]<>")
                joined = _SPOKEN_DOT.sub(".", _SPOKEN_LINE.sub("_", text.lower()))
                joined = _SPOKEN_MARK.sub(lambda m: {"dash": "-", "plus": "+"}.get(m[1], m[1]), _SPOKEN_AT.sub("@", joined))
                if joined.count("@") != 1 or " " in joined or (start, end) in seen:
                    continue
                local, _, domain = joined.partition("@")
                if not _LOCAL.match(local) or not _DOMAIN.match(domain):
                    continue
                seen.add((start, end))
                edge = tokens[start - 1].low if start else ""
                sign = "@" if "@" in text else "bracket" if text[0] != "(" and ("(at)" in text or "[at]" in text) else "rate" if "rate" in text.lower() else "said"
                features = ["email", f"email_len{min(4, end - start)}", f"email_{sign}"]
                features.append("email_tld" if domain.rsplit(".", 1)[1] in TLDS else "email_odd_tld")
                if any(tokens[k].marks & _MARKS["mail_common"] for k in range(start, i)):
                    features.append("email_common_local")
                if _distance(tokens, start, "mail", 4) < 99:
                    features.append("email_near")
                if any(c in local for c in "._-+0123456789"):
                    features.append("email_local_marks")
                if local[0] in ".-+_" or local[-1] in ".-+_" or edge in ("dot", "underscore", ".", "_"):
                    features.append("email_cut_left")
                nxt = tokens[end].low if end < n else ""
                if nxt in ("dot", "(dot)", "[dot]") or tokens[end - 1].form.endswith("-"):
                    features.append("email_cut_right")
                yield Span(start, end, "email", tuple(features))


def _number_at(t: Token) -> str:
    """The characters of a number that a token gives, '' if none, '*2' for a repeat."""
    if t.low in DIGITS:
        return "O" if t.bare == "O" else DIGITS[t.low]
    if t.low in REPEATS:
        return f"*{REPEATS[t.low]}"
    if _NUMBERISH.match(t.bare):
        return "".join(c for c in t.bare if c.isdigit())
    if _ALNUM.match(t.bare) or (len(t.bare) == 1 and "A" <= t.bare <= "Z"):
        return t.bare
    return ""


def read_number(tokens: list[Token]) -> str:
    """Digits and letters of a run of number tokens; a lone repeat gives nothing."""
    out, times = [], 1
    for t in tokens:
        part = _number_at(t)
        if part.startswith("*"):
            times = int(part[1:])
        else:
            out.append(part * times if len(part) == 1 else part)
            times = 1
    return "".join(out)


def _numbers(tokens: list[Token]) -> Iterator[Span]:
    n, i = len(tokens), 0
    while i < n:
        if not _number_at(tokens[i]):
            i += 1
            continue
        j = i
        while j < n and _number_at(tokens[j]):
            j += 1
            if tokens[j - 1].stop and tokens[j - 1].form[-1] not in ".":
                break
        for start in range(i, j):
            for end in range(start + 1, min(j, start + LONGEST["phone"]) + 1):
                yield from _number_span(tokens, start, end, i, j)
        i = j


def _number_span(tokens: list[Token], start: int, end: int, left: int, right: int) -> Iterator[Span]:
    part = tokens[start:end]
    text = " ".join(t.bare for t in part)
    value = read_number(part)
    digits = sum(c.isdigit() for c in value)
    whole = start == left and end == right
    near_phone, near_id = _distance(tokens, start, "phone"), _distance(tokens, start, "identity")
    other = _distance(tokens, start, "other", 2)
    if min(near_phone, near_id) < other:
        # a word for another number before one for a phone or an identity isn't about this number
        other = 99
    if near_phone == near_id == 99:
        near_phone = _distance(tokens, start, "number")
    common = ["num_whole" if whole else "num_part"]
    if other < 99:
        common.append("num_other")
    if value.isdigit() and 9 <= digits <= 15:
        core = value
        for lead in ("0091", "91", "0", "1"):
            if (text.startswith("+") or lead in ("0091", "0")) and core.startswith(lead) and len(core) - len(lead) in ((10, 11) if lead == "1" else (10,)):
                core = core[len(lead) :]
                break
        features = [*(f"phone_{f}" for f in common), f"phone_len{min(len(core), 13)}"]
        if text[0] in "+(" or text.startswith("0091"):
            features.append("phone_lead")
        if near_phone < near_id:
            features.append("phone_near")
        if near_id < 99 and near_id <= near_phone:
            features.append("phone_near_id")
        if len(part) >= 8:
            features.append("phone_spoken")
        yield Span(start, end, "phone", tuple(features))
    features = [f"id_{f}" for f in common]
    if near_id < 99 and near_id <= near_phone:
        features.append("id_near")
    elif near_phone < 99:
        features.append("id_near_phone")
    compact = text.replace(" ", "")
    if value.isdigit() and digits == 12:
        shape = "id_groups" if re.match(r"^\d{4}[ -]\d{4}[ -]\d{4}$|^\d\d(?: \d\d){5}$", text) else "id_twelve"
    elif _SSN.match(text):
        shape = "id_ssn"
    elif re.match(r"^[A-Z]{2,5}\d{4,8}[A-Z]?$", value) and 7 <= len(value) <= 12:
        shape = "id_alnum"
    elif value.isdigit() and 8 <= digits <= 13 and near_id < 99:
        shape = "id_other"
    else:
        return
    if shape == "id_alnum" and len(compact) != len(value):
        features.append("id_spelled")
    yield Span(start, end, "identity", (*features, shape))


def _opens_address(tokens: list[Token], i: int) -> bool:
    """Whether an address may begin here: a word for a house, a house number in parts, or a plain one before a word."""
    t = tokens[i]
    if t.marks & _MARKS["house"]:
        return not (t.low == "no" and i and tokens[i - 1].marks & _MARKS["house"])
    if not t.uses & _HOUSE:
        return False
    return bool(t.uses & _OPENS) or (len(t.bare) <= 5 and i + 1 < len(tokens) and tokens[i + 1].bare.isalpha() and not t.stop)


def _addresses(tokens: list[Token]) -> Iterator[Span]:
    n = len(tokens)
    house, street = _MARKS["house"], _MARKS["street"]
    for i, t in enumerate(tokens):
        if not t.uses & (_OPENS | _HOUSE) or not _opens_address(tokens, i):
            continue
        led = _phrase(tokens, i, _HOME_PHRASES)
        other = _distance(tokens, i, "other", 1) < 99
        after_house = i > 0 and tokens[i - 1].marks & (house | _MARKS["number"])
        numbers = streets = tail = 0
        for end in range(i + 1, min(n, i + LONGEST["address"]) + 1):
            last, after = tokens[end - 1], tokens[end] if end < n else None
            numbers += bool(last.uses & _HOUSE)
            named = last.marks & street or last.low.endswith("nagar")
            streets += bool(named)
            tail = 0 if named else tail + 1
            if end - i < 2 or not numbers:
                continue
            split_pin = end - i > 3 and len(last.bare) == 3 == len(tokens[end - 2].bare) and (tokens[end - 2].bare + last.bare).isdigit() and streets
            features = ["address", f"address_streets{min(3, streets)}", f"address_numbers{min(3, numbers)}", f"address_tail{min(5, tail)}"]
            features.append("address_led" if led else "address_not_led")
            if led and streets:
                features.append("address_led_street")
            if t.marks & house:
                features.append("address_house")
            elif not t.uses & _OPENS:
                features.append("address_plain_number")
            if after_house:
                features.append("address_cut_left")
            if other:
                features.append("address_other")
            if named:
                features.append("address_ends_street")
            elif split_pin:
                features.append("address_ends_split_pin")
            elif end - i > 2 and tokens[end - 2].marks & _MARKS["other"]:
                features.append("address_ends_other")
            elif _PIN.match(last.bare) or last.low == "depot":
                features.append("address_ends_pin")
            elif last.bare[:1].isupper() and len(last.bare) > 1:
                features.append("address_ends_place")
            elif last.uses & _HOUSE:
                features.append("address_ends_number")
            elif not last.bare:
                features.append("address_ends_mark")
            else:
                features.append("address_ends_word")
            if after is not None:
                if _PIN.match(after.bare) or after.low in ("pin", "depot") or after.marks & street:
                    features.append("address_cut")
                elif not after.bare or (len(after.bare) == 3 and after.bare.isdigit()):
                    features.append("address_cut_pin" if streets and (not after.bare or not split_pin) else "address_before_number")
                elif after.bare[:1].isupper() and len(after.bare) > 1 and not last.stop:
                    features.append("address_goes_on")
            if last.stop:
                features.append("address_stop")
            yield Span(i, end, "address", tuple(features))


def _name_like(t: Token) -> bool:
    return len(t.bare) >= 2 and t.bare.isalpha() and t.bare.isascii()


def _names(tokens: list[Token], given: frozenset[str], surnames: frozenset[str]) -> Iterator[Span]:
    n = len(tokens)
    common, thing, before_thing, after_name = (_MARKS[m] for m in ("common", "thing", "before_thing", "after_name"))
    for i, t in enumerate(tokens[:-1]):
        led = i > 0 and bool(tokens[i - 1].uses & _LEADS) and _phrase(tokens, i, _NAME_PHRASES)
        upper = t.bare[:1].isupper()
        if not led and not upper and t.low not in given and t.low not in surnames:
            continue
        indic = not t.bare.isascii()
        if indic and not led:
            continue
        for end in (i + 2, i + 3):
            if end > n or tokens[i].stop and tokens[i].form[-1] in ",?!;":
                break
            last = tokens[end - 1]
            if end == i + 3 and not (len(tokens[i + 1].bare) == 1 and tokens[i + 1].bare.isalpha()):
                break
            if indic:
                if not led or not last.bare or last.bare.isascii():
                    continue
            elif not _name_like(t) or not _name_like(last):
                continue
            known = (t.low in given, last.low in surnames, t.low in surnames, last.low in given)
            both = upper and last.bare[:1].isupper()
            if not led and not any(known) and not both:
                continue
            features = ["name", "name_led" if led else "name_bare"]
            if indic:
                features.append("name_indic")
            if known[0] and known[1]:
                features.append("name_both")
            elif known[2] and known[3]:
                features.append("name_turned")
            elif known[0] or known[1]:
                features.append("name_one")
            elif known[2] or known[3]:
                features.append("name_one_turned")
            else:
                features.append("name_unlisted_led" if led else "name_unlisted_bare")
            features.append("name_case" if both else "name_case1" if upper or last.bare[:1].isupper() else "name_lower")
            if (t.marks | last.marks) & common or len(last.bare) < 3 > len(t.bare):
                features.append("name_common")
            if (t.marks | last.marks) & after_name:
                features.append("name_holds_after")
            if min(len(t.bare), len(last.bare)) < 3:
                features.append("name_short")
            if (t.marks | last.marks) & thing:
                features.append("name_holds_thing")
            if i and not led and tokens[i - 1].marks & before_thing:
                features.append("name_before_thing")
            if end < n and tokens[end].marks & after_name:
                features.append("name_after")
            if end < n and tokens[end].marks & thing:
                features.append("name_of_thing")
            if end == i + 3:
                features.append("name_initial")
            yield Span(i, end, "name", tuple(features))


def candidates(tokens: list[Token], given: frozenset[str], surnames: frozenset[str]) -> list[Span]:
    """All candidate segments of a text."""
    return [*_emails(tokens), *_numbers(tokens), *_addresses(tokens), *_names(tokens, given, surnames)]


def best_labels(n: int, spans: list[Span], weights: dict[str, float]) -> list[Span]:
    """The spans of the best labelling."""
    ending: dict[int, list[tuple[float, Span]]] = {}
    for s in spans:
        score = sum(weights.get(f, 0.0) for f in s.features)
        if score > 0:
            ending.setdefault(s.end, []).append((score, s))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for score, s in ending.get(j, ()):
            if best[s.start] + score > best[j]:
                best[j], back[j] = best[s.start] + score, s
    found, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            found.append(back[j])
            j = back[j].start
    return found[::-1]


def train(examples: list[tuple[list[Token], list[tuple[int, int, str]]]], given: frozenset[str], surnames: frozenset[str], rounds: int = 6) -> dict[str, float]:
    """Weights of greatest likelihood, by stochastic gradients with a small penalty."""
    weights: dict[str, float] = {}
    data = [(len(t), candidates(t, given, surnames), set(g)) for t, g in examples]
    order = random.Random(5)
    for step in range(rounds):
        order.shuffle(data)
        rate = 0.5 / (1 + step)
        for n, spans, gold in data:
            if not spans:
                continue
            score = [sum(weights.get(f, 0.0) for f in s.features) for s in spans]
            starts: dict[int, list[int]] = {}
            ends: dict[int, list[int]] = {}
            for k, s in enumerate(spans):
                starts.setdefault(s.start, []).append(k)
                ends.setdefault(s.end, []).append(k)
            ahead = [0.0] * (n + 1)
            for j in range(1, n + 1):
                ahead[j] = _logsum([ahead[j - 1], *(ahead[spans[k].start] + score[k] for k in ends.get(j, ()))])
            behind = [0.0] * (n + 1)
            for j in range(n - 1, -1, -1):
                behind[j] = _logsum([behind[j + 1], *(behind[spans[k].end] + score[k] for k in starts.get(j, ()))])
            for k, s in enumerate(spans):
                share = math.exp(ahead[s.start] + score[k] + behind[s.end] - ahead[n])
                slope = ((s.start, s.end, s.kind) in gold) - share
                if abs(slope) > 1e-4:
                    for f in s.features:
                        w = weights.get(f, 0.0)
                        weights[f] = w + rate * (slope - 1e-4 * w)
    return weights


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


class Examples:
    """Invented, labelled sentences with a fixed seed; none is taken from a table."""

    GIVEN = ("asha", "ravi", "lina", "omar", "petra", "vikram", "dalia", "noor")
    SURNAMES = ("fenwick", "kolhari", "marwick", "sundaro", "tallis", "prabhune", "ostrava", "bellari")
    UNLISTED = ("Tomas Birk", "Jaya Mundle", "Elif Corran", "Sunil Varde", "Greta Olin", "Imran Sheth")
    FILLER = (
        "could you look into this soon|nothing has changed since I rang|she left the keys with our neighbour|that was the second complaint|many thanks|"
        "the technician came and went|kitne din aur lagenge|kal tak ho jayega kya|मुझे जवाब चाहिए|the screen goes blank whenever I log in|do you need anything else from us|"
        "I told them so in the morning|it rained and the van was late|everyone agrees with that|there were 3 people in the queue|two boxes and one bag arrived"
    ).split("|")
    DECOYS = (
        "order no WX-{d8} came broken|docket {d4} {d4} is closed|the transaction reference was {t12}|meter reading {d4}-{d4} this month|policy QR/{d4}/{d4} lapsed|"
        "delivered on 03-11-2024|they took Rs {d3},{d3} from me|I transferred {d4} rupees|loans at the rate of 9 percent|we waited near Fenmoor Bridge|sent from the New Quay depot|"
        "I took the Meridian Prime plan|only with the Harbour Blue card|be there at 18:30|wait at the gate|ring me on Monday|the address is wrong|this is not right|"
        "hi good evening madam|invoice {t12} is unpaid|that number is wrong|reference {d4} {d4} {d4} was rejected|reference number {t12}|take a look at example.com|"
        "it is on our site at kolmail.org|more at post-box.test today|this is about the parcel|Old Fenmoor branch was shut|every Monday Morning they call|{d3} units were used last month|"
        "{d3} rupees in all|flat rate of {d3} rupees|no {d3} of them came back|{d4} points on the Silver Star pack|block the card at once|house rent of {d4} rupees|"
        "ask for a receipt|speaking with the manager|account holder is absent|talk to someone else|name is missing|{d3} pages and {d3} lines in the main file|the receipt of {d4} units|"
        "{d4} days on the main road and the amount is Rs {d3}{d3}|{d3} bags from the mill and a bill of {d3}{d3}|"
        "between 5 and 6 on the main road|plot twist in episode {d3}|batch code AB{d4}CD is old|serial {d3} {d3} {d4} on the box|we live at the end of the lane"
    ).split("|")

    def __init__(self, seed: int = 11) -> None:
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))

    def spoken(self, digits: str) -> str:
        by = {v: k for k, v in DIGITS.items() if k not in ("oh", "o")}
        out = [by[d] for d in digits]
        if self.r.random() < 0.5:
            out[0:2] = ["double", by[digits[0]]]
        return " ".join(out)

    def phone(self) -> tuple[str, str, str]:
        d = self.digits
        forms = [d(10), f"+91 {d(5)} {d(5)}", f"+91-{d(3)}-{d(3)}-{d(4)}", f"0091{d(10)}", f"(0{d(3)}) {d(3)} {d(4)}", " ".join(d(10)), self.spoken(d(10)), f"+1 (555) 0{d(3)}-{d(4)}", f"0{d(10)}"]
        lead = self.r.choice(["my cell is", "ring me on", "text", "dial", "phone", "another contact is", "no OTP came to", "मेरा मोबाइल नंबर", "en pon nampar", "నా ఫోన్ నంబర్", "the number to use is", ""])
        form = self.r.choice(forms if lead else [*forms[1:5], forms[7]])
        return lead, form, self.r.choice(["", "any time", "in the evening", "है"])

    def identity(self) -> tuple[str, str, str]:
        d, a = self.digits, self.letters
        forms = [d(12), f"{d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}", " ".join(d(2) for _ in range(6)), f"{d(3)}-{d(2)}-{d(4)}", a(5) + d(4) + a(1), a(3) + d(7), a(2) + d(6),
                 " ".join([*a(5), *(self.spoken(d(4)).replace("double ", "").split()), a(1)])]
        lead = self.r.choice(["aadhaar card number", "the PAN is", "passport no", "my voter card is", "tax id", "for KYC the identity number", "identity proof", "आधार नंबर", "aadhar nambar", "social security", "licence", ""])
        form = self.r.choice(forms[1:4] if not lead else forms)
        return lead, form, self.r.choice(["", "is valid", "है"])

    def email(self) -> tuple[str, str, str]:
        r, local = self.r, self.r.choice(["asha.kolhari", "r_tallis", "noor+bills", "vikram72", "lina-marwick", "DALIA.9", "omar", "petra"])
        host, tld = r.choice(["example", "kolmail", "post-box"]), r.choice(["com", "org", "test", "example", "shop"])
        form = r.choice([f"{local}@{host}.{tld}", f"{local} @ {host}.{tld}", f"{local}(at){host}(dot){tld}", f"{local} [at] {host} [dot] {tld}", f"{local} at {host} dot {tld}", f"{local} at {host}.{tld}",
                         f"{local.replace('.', ' dot ').replace('_', ' underscore ')} at the rate {host} dot {tld}"])
        return r.choice(["drop a mail to", "copy", "my e-mail", "ईमेल", "write to", "the statement should reach", "mail"]), form, r.choice(["", "thanks", "each quarter", "पर"])

    def address(self) -> tuple[str, str, str]:
        r, d = self.r, self.r.randint(1, 300)
        area, town = r.choice(["Rowan Street", "Birch Lane", "Teak Nagar", "Old Quay Road", "Sector Four", "Potters Colony", "Neem Layout", "Fig Cross", "Rao Enclave"]), r.choice(["Harnpur", "Old Denby", "Millwadi", "Torvelli"])
        pin = r.choice([self.digits(6), f"pin {self.digits(6)}", f"- {self.digits(3)} {self.digits(3)}"])
        form = r.choice([f"house number {d}, 3th Main, {area}, {town}", f"flat {d}B Juniper Towers, {area}, {town} {pin}", f"H.No. {d}-3-1, {area}, {town} {pin}", f"{d} {area}, {town} {pin}", f"no {d} {area.lower()} {town.lower()}",
                         f"door no {d} second floor {area} opposite the {town} depot", f"plot {d} behind the water tank {area.lower()} {town.lower()}", f"{d}/{r.randint(1, 20)} {area} {town}", f"{d}/4 {area}, {town} {pin}"])
        return r.choice(["the address is", "courier to", "collect from", "we live at", "our home is", "she moved to", "come to", ""]), form, r.choice(["", "beside the park", "before noon", "since March"])

    def name(self) -> tuple[str, str, str]:
        r, g, s = self.r, self.r.choice(self.GIVEN), self.r.choice(self.SURNAMES)
        if r.random() < 0.15:
            return r.choice(["मेरा नाम", "माझं नाव", "আমার নাম"]), r.choice(["मीना सोनार", "तरुण गोरे", "मीना क सोनार"]), r.choice(["है", "आहे", ""])
        if r.random() < 0.2:
            return r.choice(["my name is", "hi", "this is", "account holder", "talk to", "myself"]), r.choice(self.UNLISTED), r.choice(["", "here", "speaking", "from the office"])
        form = r.choice([f"{g.title()} {s.title()}", f"{g.title()} {s}", f"{s.upper()} {g.upper()}", f"{g.title()} {r.choice('ABKMT')} {s.title()}", f"{g} {s}", f"{g} {s}"])
        if r.random() < 0.3:
            return "", form, r.choice(["", "wrote back", "told me", "was late"])
        return r.choice(["my name is", "this is", "account holder", "talk to", "speaking with", "Mr", "Ms", "hi", "mera nam", "en peyar", "আমার নাম", "myself"]), form, r.choice(["", "speaking", "here", "hai", "from the office"])

    def sentence(self) -> tuple[list[Token], list[tuple[int, int, str]]]:
        tokens: list[str] = []
        gold: list[tuple[int, int, str]] = []
        for _ in range(self.r.randint(1, 4)):
            kind = self.r.choice([*TYPES, "decoy", "decoy", "filler", "filler"])
            if kind == "filler":
                tokens += self.r.choice(self.FILLER).split()
            elif kind == "decoy":
                t = self.r.choice(self.DECOYS)
                tokens += t.format(d3=self.digits(3), d4=self.digits(4), d8=self.digits(8), t12=self.digits(12)).split()
            else:
                before, form, after = getattr(self, kind)()
                tokens += before.split()
                gold.append((len(tokens), len(tokens) + len(form.split()), kind))
                tokens += form.split() + after.split()
        return [_token_of(t) for t in tokens], gold


@cache
def trained() -> dict[str, float]:
    """The weights, trained once a process."""
    examples = Examples()
    return train([examples.sentence() for _ in range(1500)], frozenset(Examples.GIVEN), frozenset(Examples.SURNAMES))


#: What a token may begin or be part of; generators of candidates that lack a needed one have none in a text.
_AT, _SAID_AT, _DOT, _NUMBER, _OPENS, _HOUSE, _LEADS = (1 << k for k in range(7))
#: Characters of the shortest number that is a candidate.
LEAST_NUMBER = 7


def _uses(form: str, bare: str, low: str) -> int:
    """What a token may be part of, as bits."""
    uses = 0
    if "@" in form or "(at)" in low or "[at]" in form:
        uses |= _AT
    if low in ("at", "rate"):
        uses |= _SAID_AT
    if "." in form[:-1] or "dot" in low:
        uses |= _DOT
    if low in DIGITS or low in REPEATS or _NUMBERISH.match(bare) or _ALNUM.match(bare) or (len(bare) == 1 and "A" <= bare <= "Z"):
        uses |= _NUMBER
    if _HOUSE_NO.match(bare):
        uses |= _HOUSE | (_OPENS if "/" in bare or "-" in bare else 0)
    if _SPELLED.get(low, 0) & _MARKS["house"]:
        uses |= _OPENS
    return uses


def _long_number(tokens: list[Token]) -> bool:
    """Whether a run of number tokens may give LEAST_NUMBER characters."""
    size = 0
    for t in tokens:
        if t.uses & _NUMBER:
            part = _number_at(t)
            size += 2 if part.startswith("*") else len(part)
            if size >= LEAST_NUMBER:
                return True
        else:
            size = 0
    return False


class Finder:
    """Finds and replaces personal information in texts."""

    def __init__(self, weights: dict[str, float], given: frozenset[str], surnames: frozenset[str]) -> None:
        self.weights, self.given, self.surnames = weights, given, surnames
        self.tokens = Tokens()

    def spans(self, tokens: list[Token], more: tuple[frozenset[str], frozenset[str]] | None = None) -> list[Span]:
        """The candidates, without the search for kinds that lack a word or sign that each of their spans has."""
        given, surnames = self.given, self.surnames
        if more:
            given, surnames = given | more[0], surnames | more[1]
        uses = 0
        for t in tokens:
            uses |= t.uses
        found: list[Span] = []
        if uses & _AT or (uses & _SAID_AT and uses & _DOT):
            found += _emails(tokens)
        if uses & _NUMBER and _long_number(tokens):
            found += _numbers(tokens)
        if uses & _HOUSE:
            found += _addresses(tokens)
        found += _names(tokens, given, surnames)
        return found

    def find(self, text: str | None, more: tuple[frozenset[str], frozenset[str]] | None = None) -> tuple[list[str], list[Span]]:
        """The text's raw tokens and the spans found; ``more``: given names and surnames of this text beside the lists."""
        raw = (text or "").split()
        if not raw:
            return raw, []
        known = self.tokens
        tokens = [known[r] for r in raw]
        spans = self.spans(tokens, more)
        return raw, best_labels(len(tokens), spans, self.weights) if spans else []

    def redact(self, text: str | None, more: tuple[frozenset[str], frozenset[str]] | None = None) -> tuple[str | None, list[str]]:
        """The text with a placeholder for each find, and the types found. Blanks and outer punctuation stay."""
        raw, spans = self.find(text, more)
        if not spans:
            return text, []
        places, at = [], 0
        for r in raw:
            at = text.index(r, at)
            places.append((at, at + len(r)))
            at += len(r)
        out, at = [], 0
        for s in spans:
            first, last = raw[s.start], raw[s.end - 1]
            a = places[s.start][0] + len(first) - len(first.lstrip(".,;:?!\"'“‘"))
            b = places[s.end - 1][1] - len(last) + len(last.rstrip(".,;:?!।॥\"'”’"))
            out += [text[at:a], f"[{s.kind.upper()}]"]
            at = max(b, a)
        return "".join([*out, text[at:]]), sorted({s.kind for s in spans})


def name_counts(df: DataFrame, text: str) -> DataFrame:
    """Rows (w, n, is_given) of all names that phrases introduce anywhere in ``text``, ``NAME_COUNT`` times at least.

    Counted in one pass with partial aggregation; a word is a given name if it stands more often as one.
    """
    # phrases in English and in the languages' own scripts; "this is" only before what looks like a name
    said = "|".join(f"[{p[0].upper()}{p[0]}]{p[1:]}" if p.isascii() else p for p in NAME_PHRASES if p not in ("this is", "hi", "name is", "myself", "talk to"))
    lead = rf"(?:\b(?:{said})|[Tt]his is(?= [A-Z]\w+(?: [A-Z])? [A-Z])) "
    pattern = lead + r"([A-Z][A-Za-z]{2,14})( [A-Z])?[ ]([A-Za-z]{3,14})(?:[ .,?!]|$)"
    every = lambda group: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))
    rows = df.where(F.col(text).rlike(pattern)).select(F.explode(F.arrays_zip(every(1).alias("a"), every(3).alias("b"))).alias("x")).select("x.a", "x.b")
    # names in capitals come surname first
    turned = (F.upper("a") == F.col("a")) & (F.upper("b") == F.col("b"))
    pairs = rows.select(F.lower(F.when(turned, F.col("b")).otherwise(F.col("a"))).alias("g"), F.lower(F.when(turned, F.col("a")).otherwise(F.col("b"))).alias("s"))
    named = pairs.select(F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("g").alias("w")), F.struct(F.lit(1).alias("k"), F.col("s").alias("w")))).alias("x")).select("x.*")
    kept = lambda k: F.expr(f"if(count_if(k = {k}) >= {NAME_COUNT}, count_if(k = {k}), 0)")
    counts = named.groupBy("w").agg(kept(0).alias("g"), kept(1).alias("s")).where(F.greatest("g", "s") > 0)
    return counts.where(~F.col("w").isin(*WORDS["common"][0].split())).select("w", F.greatest("g", "s").alias("n"), (F.col("g") > F.col("s")).alias("is_given"))


def name_lists(df: DataFrame, text: str) -> tuple[frozenset[str], frozenset[str], DataFrame | None]:
    """Given names and surnames of ``name_counts``, the ``2 * NAMES`` most frequent ones, and the others if there are any."""
    counts = name_counts(df, text)
    top = counts.orderBy(F.col("n").desc(), "w").limit(2 * NAMES + 1).collect()
    rest = None
    if len(top) > 2 * NAMES:
        top = top[:-1]
        n, w = (top[-1]["n"], top[-1]["w"]) if top else (1 << 62, "")
        rest = counts.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("w") > w)))
    return frozenset(r["w"] for r in top if r["is_given"]), frozenset(r["w"] for r in top if not r["is_given"]), rest


def _with_rare_names(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """``rows`` with the names of ``rest`` that stand in each text, as _given and _surnames; null where there are none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Tokens()
        for pdf in batches:
            found = [(h, w) for h, t in zip(pdf["_h"], pdf["_text"], strict=True) for w in {x.low for x in map(known.__getitem__, t.split()) if _name_like(x)}]
            yield pd.DataFrame(found, columns=["_h", "w"])

    # texts are known by 128 bits of them, so that only words are shuffled
    hashed = rows.withColumn("_h", F.md5("_text"))
    words = hashed.where("_text IS NOT NULL").select("_h", "_text").mapInPandas(cut, "_h string, w string")
    listed = lambda given: F.expr(f"collect_set(if(is_given = {given}, w, null))")
    hits = words.join(rest.select("w", "is_given"), "w").groupBy("_h").agg(listed("true").alias("_given"), listed("false").alias("_surnames"))
    return hashed.join(hits, "_h", "left").drop("_h")


def redact(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Rows (``keys``, redacted, pii_types) of every text.

    ``redacted`` is the text with [EMAIL], [PHONE], [IDENTITY], [ADDRESS] and [NAME] in place of what
    was found; all else stays as it is. ``pii_types`` lists the types found, sorted, without repeats.
    Null stays null with no types; empty and blank texts stay. Repeated rows stay. Time is linear in
    the text's length for a bounded segment length.
    """
    given, surnames, rest = name_lists(df, text)
    beyond = rest is not None
    shared = df.sparkSession.sparkContext.broadcast((trained(), given, surnames))
    types = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(*shared.value)
        for pdf in batches:
            more = [None] * len(pdf)
            if beyond:
                more = [None if g is None else (frozenset(g), frozenset(s)) for g, s in zip(pdf["_given"], pdf["_surnames"], strict=True)]
            found = [finder.redact(t, m) for t, m in zip(pdf["_text"], more, strict=True)]
            yield pdf[inner].assign(redacted=[f[0] for f in found], pii_types=[f[1] for f in found])

    inner = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, inner, strict=True)), F.col(text).alias("_text"))
    if beyond:
        rows = _with_rare_names(rows, rest)
    schema = ", ".join(f"{n} {types[k]}" for k, n in zip(keys, inner, strict=True)) + ", redacted string, pii_types array<string>"
    return rows.mapInPandas(run, schema).withColumnsRenamed(dict(zip(inner, keys, strict=True)))
