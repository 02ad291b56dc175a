import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaktavya.llm import bpe, digest, languages, leakage, personal, queries, stuffing, survivors, unify


def test_survivors(spark):
    schema = "row_id bigint, utterance_id string, provider string, prediction string, latency_ms double, status string, written_at timestamp, _k0 string"
    at = F.to_timestamp
    rows = [
        (1, "c1_t1", "p", "x", 5.0, "success", "2025-01-01", "z"), (2, " C00000001-T001 ", "p", " ", 7.0, "ok", "2025-01-03", "z"), (3, "c1_t1", "p", "y", None, " OK ", None, "z"),
        (4, "c2_t1", "p", None, 0.0, None, None, "z"), (5, "c2_t1", "p", None, float("nan"), "error", None, "z"), (6, None, "p", "x", 1.0, "ok", None, "z"),
        (7, None, "p", "x", 1.0, "ok", None, "z"), (8, "c3_t1", "p", "x", 1.0, "ok", "2025-01-01", "z"), (9, "c3_t1", None, "x", 1.0, "ok", "2025-01-01", "z"),
        (10, "c4_t1", "p", "a", 1.0, "ok", "2025-01-01", "z"), (11, "c4_t1", "p", "b", -1.0, "ok", "2025-01-01", "z"),
    ]
    df = spark.createDataFrame(rows, schema.replace("written_at timestamp", "written_at string")).withColumn("written_at", at("written_at"))
    found = {r.utterance_id: (r.prediction_row, r.latency_row, r.prediction) for r in survivors.attempt_survivors(df, least=2).collect()}
    assert found == {"c00000001_t0001": (1, 1, "x"), "c00000002_t0001": (5, -1, None), "c00000004_t0001": (11, 10, "b")}
    mixed = spark.createDataFrame([(1, "c1_t1", "p", "old", 3.0, "error", "2025-01-01"), (2, "c1_t1", "p", " ", 9.0, " ", "2025-01-03"), (3, "c1_t1", "p", None, -1.0, None, None)], "row_id bigint, utterance_id string, provider string, prediction string, latency_ms double, status string, written_at string")
    best = survivors.attempt_survivors(mixed.withColumn("written_at", at("written_at"))).first()
    assert (best.prediction_row, best.prediction, best.status, str(best.written_at)[:10], best.latency_row, best.n_records) == (2, "old", "error", "2025-01-03", 2, 3)
    assert survivors.attempt_survivors(df).count() == 4 and survivors.attempt_survivors(df.limit(0)).count() == 0


@pytest.mark.parametrize("k", [50, 400])
def test_digest_rank_error(k):
    r = np.random.default_rng(k)
    for values in (r.lognormal(6, 2, 20_000), np.full(5000, 7.0), r.integers(1, 40, 9000).astype(float)):
        leaf = np.floor((np.frexp(values)[0] * 2 - 1) * (1 << digest.MANTISSA_BITS)).astype(np.int64) + (np.frexp(values)[1] - 1 + 64) * (1 << digest.MANTISSA_BITS)
        parts = []
        for part in np.array_split(leaf, 7):
            v, n = np.unique(part + digest.LEAVES, return_counts=True)
            parts.append(digest.compress(np.zeros(len(v), np.int64), v, n.astype(np.int64), k))
        v, place = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        n = np.bincount(place, np.concatenate([p[2] for p in parts])).astype(np.int64)
        _, v, n = digest.compress(np.zeros(len(v), np.int64), v, n, k)
        assert n.sum() == len(values) and len(v) <= 3 * k + 2
        order = np.sort(values)
        for q, answer in zip((0.5, 0.9, 0.99), digest.answer(v, n, (0.5, 0.9, 0.99)), strict=True):
            low, high = np.searchsorted(order, answer * (1 - 1e-4)), np.searchsorted(order, answer * (1 + 1e-4), "right")
            slack = digest.LEVELS * 2 / k * len(values) + 1
            assert low - slack <= q * len(values) <= high + slack


def test_digests_by_group(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.randint(1, 3), r.choice([r.lognormvariate(6, 1), -1.0, 0.0, None, float("nan")])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    days = digest.build_digests(df, "v", ["g", "day"])
    total = {x.g: x for x in digest.quantiles(digest.merge_digests(days, ["g"]), ["g"], 2).collect()}
    for g in ("a", "b", None):
        known = sorted(v for a, _, v in rows if a == g and v and v > 0)
        assert total[g].n == len(known) and total[g].rank_error == 0.0
        for name, q in digest.QUANTILES.items():
            assert abs(getattr(total[g], name) / known[max(0, int(np.ceil(q * len(known))) - 1)] - 1) < 2**-14
    assert digest.quantiles(days, ["g", "day"], 1).count() == 9
    assert digest.quantiles(digest.merge_digests(days, []), [], 2).first().n == sum(x.n for x in total.values())
    assert digest.build_digests(df.limit(0), "v", ["g"]).count() == 0


FORMS = {
    "ｆｕｌｌ": "full", "café": "café", "a b": "a b", "wa​it": "wait", "pоlicy": "policy", "ΤΕSΤ": "TEST", "क्‍ष": "क्‍ष", "क‍ष": "कष", "ﬁnd": "find",
    "7852‑9833": "7852-9833", "ಸರಿ": "ಸರಿ", "ಸరಿ": "ಸರಿ", "Москва": "Москва", "plain": "plain", "": "", "a\tb": "a\tb", "য়": unicodedata.normalize("NFC", "য়"), "प‎र": "पर", "﻿": "",
    "अापके": "आपके", "काेट": "कोट", "અાજ": "આજ", "ಉಾ": "ಊ", "ഒാട്ടോ": "ഓട്ടോ", "আমি": "আমি",
}


def test_one_form(spark):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*FORMS, None])], "i int, t string, t_unified string")
    found = {r.i: r.t_unified for r in unify.unify(rows, "t").collect()}
    assert found == dict(enumerate([*FORMS.values(), None]))
    odd = {r.t for r in unify.odd_texts(rows, "i", "t").collect()}
    assert odd == {t for t, f in FORMS.items() if t != f}
    again = spark.createDataFrame([(f,) for f in FORMS.values()], "t string")
    assert unify.odd_texts(again, "t", "t").count() == 0
    assert unify.unify(rows.limit(0), "t").count() == 0
    many = spark.createDataFrame([("ａ" * 300_000, i) for i in range(40)], "t string, i int").coalesce(1)
    assert {len(r.t_unified) for r in unify.unify(many, "t").collect()} == {300_000}
    long = "ａ" * 200_000
    assert unify.unify(spark.createDataFrame([(long,)], "t string"), "t").first().t_unified == "a" * 200_000


def test_token_ids(spark):
    tokenizers = pytest.importorskip("tokenizers")
    model = tokenizers.Tokenizer.from_file(f"{bpe.FOLDER}/byte_bpe_50k.json")
    model.encode_special_tokens = True
    r = random.Random(3)
    texts = ["", "hello world", " " * 5000, "नमस्ते जी 123", "a" * 30_000, "<|endoftext|>", "it's\n\n\tx", "".join(chr(r.choice([r.randint(32, 126), r.randint(0x900, 0xD7F), 0x1F600])) for _ in range(4000))]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, None])], "doc_id bigint, text string, _key int")
    found = {x.doc_id: list(x.ids) for x in bpe.encode_texts(df, "doc_id", "text").collect()}
    assert found == {i: model.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)} | {len(texts): []}
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_merges_are_those_of_a_plain_loop():
    ranks = bpe.load_ranks(f"{bpe.FOLDER}/{bpe.VOCABULARY}")
    r = random.Random(5)
    for _ in range(150):
        piece = bytes(r.choice(b"aeinst ") for _ in range(r.randint(1, 60)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            pairs = [(ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)]
            if not pairs or min(pairs)[0] == 1 << 30:
                break
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.merge_piece(piece, ranks) == [ranks[p] for p in parts]


def test_window_hashes_and_their_filter(spark, monkeypatch):
    r = random.Random(3)
    words = [r.choice("abcdefgh") * r.randint(1, 3) for _ in range(400)]
    h = leakage.Hashes().of_windows(words, 10)
    by: dict[str, set] = {}
    for gram, x in zip(leakage.windows(words), h.tolist(), strict=True):
        by.setdefault(gram, set()).add(x)
    assert all(len(x) == 1 for x in by.values()) and len(set(h.tolist())) == len(by)
    assert len(leakage.Hashes().of_windows(words[:9], 10)) == 0
    values = [0, 1, 32767, 32768, 32769, 2**20 - 1, 2**20 + 5, -1]
    bits = leakage._filter_of(spark.createDataFrame([(v,) for v in values], "_h long"), 1 << 20)
    assert set(np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist()) == {v % 2**20 for v in values}


def test_a_filter_that_lets_all_through_changes_no_row(spark, monkeypatch):
    words = [f"word{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[10:30]))], "item_id int, text string")
    df = spark.createDataFrame([(i, "x " + " ".join(words[i : i + 12]) + " y") for i in range(25)] + [(99, " ".join("abcdefghijklmnop"))], "doc_id int, text string")
    rows = lambda: sorted(map(tuple, leakage.leaks(df, "doc_id", "text", items, "item_id", "text", broadcast_windows=0).collect()))
    sharp = rows()
    monkeypatch.setattr(leakage, "FILTER_BITS", 8)
    assert rows() == sharp and len(sharp) > 25


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_leaks(spark, limit):
    words = [f"word{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "only nine words here so nothing can leak ever"), (3, None), (4, "")], "item_id int, text string")
    docs = [
        (1, "x " + " ".join(words[5:15]) + " y"), (2, "x " + " ".join(words[5:14])), (3, ("WORD1,\nword2 -- " + " ".join(words[3:11])).replace("word5", "wоrd5")), (4, None), (5, ""),
        (6, "wo​rd20 " + "  ".join(words[21:40])), (1, "x " + " ".join(words[5:15]) + " y"),
    ]
    df = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id int, text string, item_id int")
    found = leakage.leaks(df, "doc_id", "text", items, "item_id", "text", broadcast_windows=limit)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (3, 1), (6, 1)}
    if limit:
        assert {r.clean_text for r in found.where("doc_id = 1").collect()} == {"x  y"}
    assert leakage.leaks(df.limit(0), "doc_id", "text", items, "item_id", "text", broadcast_windows=limit).count() == 0


def test_leaks_are_cut_out_however_many_items_there_are(spark):
    words = [f"word{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[10:30])), (3, " ".join(words[:12])), (4, None), (1, " ".join(words[:20]))], "item_id int, text string")
    docs = [
        ("a", "x " + " ".join(words[5:15]) + " y, " + ", ".join(words[10:24]) + "! z"), ("b", "wo​rd20 " + "  ".join(words[21:40]) + " end"), ("a", "other " + " ".join(words[:12]) + " text"),
        ("c", " ".join(words[:9])), ("d", None), ("e", ""), ("b", "wo​rd20 " + "  ".join(words[21:40]) + " end"), ("f", "p " + " ".join(words[:10] * 3) + " q"),
    ]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    few, many = (leakage.leaks(df, "doc_id", "text", items, "item_id", "text", broadcast_windows=b).collect() for b in (1_000_000, 0))
    assert sorted(map(tuple, few)) == sorted(map(tuple, many)) and len(many) == 10
    assert {r.clean_text for r in many if r.doc_id == "a"} == {"x  y, ! z", "other  text"}


SENTENCES = "The branch near the park handles parcels between nine and five. Callers told us that the page loads slowly since Friday. We wait for the tone and then read the terms."
LISTS = [
    "cheap loan near me " * 40, "\n".join(f"http://deals{i}.example/tag/loan-{i}" for i in range(30)), " ".join(f"#loanOffer{i}" for i in range(40)), "\n".join(f"SKU-{i * 37} / loan / sale / Rs {i * 91}" for i in range(1, 25)),
    "\n".join(f"* [best loan](www.quick{i}.test/go/loan)" for i in range(20)), ", ".join(f"loan in Town{i % 7}" for i in range(40)), "\n".join(f"loan > card > best loan ({i})" for i in range(25)), "कर्ज़ बीमा कर्ज़ कर्ज़ बीमा " * 20,
]
PROSE = [
    SENTENCES, "\n".join(f"{i}. Open the form and write the reason in box {i}." for i in range(1, 15)), "\n".join(f"loan {i}: money that the bank lends for {i} years." for i in range(1, 15)),
    "\n".join(["Agent: yes yes yes yes", "Caller: ok ok ok ok", "Agent: right right"] * 10), SENTENCES + " See https://kb.example/a and #help.\nTags: loan, card", "", "   ", None, "मुझे रसीद दोबारा चाहिए। मीटर में गलत पता लिखा हुआ है। " * 10,
]


def test_stuffing(spark):
    texts = [*LISTS, *(x + "\n" + SENTENCES for x in LISTS[:2]), *PROSE]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    shares = {r.doc_id: r.share for r in stuffing.stuffing(df, "doc_id", "text").collect()}
    assert [i for i, t in enumerate(texts) if (shares[i] > stuffing.SHARE) != (i < len(LISTS) + 2 and i != len(LISTS) + 1)] == []
    assert stuffing.stuffing(df.limit(0), "doc_id", "text").count() == 0


ENDED = [
    "cheap loan near me " * 40 + ".", "Keywords: " + "cheap loan near me " * 40, "Tags: " + "#loan and card " * 2 + "best loan " * 30, "कर्ज़ बीमा कर्ज़ कर्ज़ बीमा " * 20 + "।",
    "Keywords: loans, cards, mortgages, insurance, savings, deposits, credit, brokers, funds, bonds, shares, pensions.",
]


def test_stuffing_of_long_sentences_and_label_tails():
    assert [t for t in ENDED if stuffing.stuffed_share(t)[0] <= stuffing.SHARE] == []
    assert [t for t in PROSE if stuffing.stuffed_share(t)[0] > 0.1] == []
    mixed = stuffing.stuffed_share(ENDED[0] + " " + SENTENCES)
    assert 0.5 < mixed[0] < 1 and mixed[1] > stuffing.RECURS


NOUNS = (
    "loan card policy credit broker fund bond share pension deposit mortgage savings insurance wallet parcel voucher refund booking ticket rent tyre phone laptop camera printer router modem cable "
    "charger battery speaker monitor keyboard mouse tablet watch bracelet ring necklace scarf jacket"
).split()
PHRASES = "हमारे घर पर बीमा पहुँचा ही नहीं - मुझे मीटर की रसीद दोबारा चाहिए - मैं सोमवार तक खाता का इंतज़ार करूँगा - आपके यहाँ से सामान रद्द कर दिया गया - क्या आप तारीख बदल सकते हैं"


def test_stuffing_needs_no_marks_and_knows_function_words_of_other_languages():
    stops = "cheap loan near me. best loan near me. fast loan near me. " * 10
    lists = [" ".join(NOUNS), stops, " ".join([f"term{a}{b}" for a in "abcdefghi" for b in "vwxyz"] * 20), stops + SENTENCES, "ಸಾಲ ವಿಮೆ ಕಾರ್ಡ್ ಠೇವಣಿ ಬಿಲ್ ಮೀಟರ್ ಖಾತೆ ಔಷಧಿ ಬಾಡಿಗೆ ಪಾರ್ಸೆಲ್ " * 3]
    assert [t[:50] for t in lists if stuffing.stuffed_share(t)[0] <= stuffing.SHARE] == []
    prose = [
        PHRASES, PHRASES.replace(" - ", "\n"), "mujhe meter kee raseed dobara chahie - hamare ghar par beema pahuncha hee naheen - main somavar tak khata ka intajar karoonga",
        "The clerk closed the claim form. The clerk opened the claim form. The clerk closed the claim form again. " * 6, "Our card was late; the bank, the shop and the courier - all of them - said that it was on its way.",
    ]
    assert [t[:50] for t in prose if stuffing.stuffed_share(t)[0] > stuffing.SHARE] == []
    part = stuffing.stuffed_share(stops + SENTENCES)[0]
    assert part < 1


def test_speakers_are_told_by_their_repetition():
    talk = "\n".join(f"{who}: {what}" for who, what in [("Zorba 1", "yes yes yes yes"), ("Zorba 2", "ok ok ok")] * 12)
    assert stuffing.stuffed_share(talk)[0] == 0 and all(turn for turn, line in stuffing.turns(talk) if line.strip())
    line = " ".join(f"[00:{i:02}] {who}: {what}" for i, (who, what) in enumerate([("nurse", "right right right"), ("visitor", "hmm hmm")] * 12))
    assert stuffing.stuffed_share(line)[0] == 0
    inline = "clerk: the refund is late. buyer: ok the refund. clerk: fine then buyer: yes"
    assert [t.strip() for turn, t in stuffing.turns(inline) if turn] == ["the refund is late.", "ok the refund.", "fine then", "yes"]
    assert stuffing.turns("Keywords: a, b") == [(False, "Keywords: a, b")]
    assert sum(turn for turn, _ in stuffing.turns("x: one\ny: two\nz: three")) == 3


def test_links_of_any_domain_are_links():
    assert stuffing.terms("see http://a.b/c and www.x.dev or shop.kolmail.agency/tag/1 now") == ["see", "\ue000", "and", "\ue000", "or", "\ue000", "now"]
    assert "\ue000" not in stuffing.terms("he left.Then 3.14 and e.g. mail me@shop.dev")[:6]
    pages = "\n".join(f"shop{i}.store/go/{i}" for i in range(30))
    assert stuffing.stuffed_share(pages)[0] == 1


def test_stuffing_of_long_cycles_and_lists_of_lines():
    r = random.Random(8)
    keywords = [f"{a}{b}" for a in ("loan", "card", "policy", "credit", "broker", "fund") for b in "abcdefghij"]
    shuffled = [w for _ in range(10) for w in r.sample(keywords, len(keywords))]
    nouns = ["Loan Mumbai", "Card Delhi", "Insurance", "Mortgage", "Savings Pune", "Deposit", "Credit", "Broker Goa", "Fund", "Bond", "Share", "Pension"]
    lists = [" ".join(keywords * 10), "\n".join(keywords * 10), "\n".join(" ".join(keywords[i : i + 5]) for i in range(0, 60, 5)) + "\n" + " ".join(keywords * 2), " ".join(shuffled), "\n".join(nouns), " ".join(keywords * 2000)]
    assert [t[:50] for t in lists if stuffing.stuffed_share(t)[0] <= stuffing.SHARE] == []
    assert stuffing.autocorrelation(keywords * 10) == 1.0 == stuffing.autocorrelation(keywords * 2)
    # long texts without a sentence mark: words as frequent as in prose, by rank
    common = "the of to and in a is that for it".split()
    ranks = r.choices(range(20_000), [1 / (k + 2.7) for k in range(20_000)], k=5000)
    prose = [" ".join(common[k] if k < len(common) else f"w{chr(97 + k % 26)}{'x' * (k // 26)}" for k in ranks[:n]) for n in (100, 500, 5000)]
    assert [t[:50] for t in prose if stuffing.stuffed_share(t)[0]] == []


REDACTED = {
    "my email is asha.k [at] example [dot] org okay": "my email is [EMAIL] okay", "write r underscore tallis at the rate example dot com now": "write [EMAIL] now", "call me back on double five one two three four five six seven eight please": "call me back on [PHONE] please",
    "WhatsApp +91-531-337-4533, thanks": "WhatsApp [PHONE], thanks", "my aadhaar is 0402 5946 4928": "my aadhaar is [IDENTITY]", "passport H P Y Q C three three three nine O expires soon": "passport [IDENTITY] expires soon",
    "voter id 000-43-8138": "voter id [IDENTITY]", "transaction reference 987059459870 failed": "transaction reference 987059459870 failed", "ticket number 6682 9628 please": "ticket number 6682 9628 please", "it was on 16-02-2025": "it was on 16-02-2025",
    "interest at the rate of 6 percent": "interest at the rate of 6 percent", "home is flat 171B Kestrel Towers, Gulmohar Layout, Mirapet 023825 near the temple": "home is [ADDRESS] near the temple", "the branch near Palashpur refused": "the branch near Palashpur refused",
    "deliver it to 258/6 Lantern Lane Old Kasbari": "deliver it to [ADDRESS]", "the account is under Farhan K Chelvanur only": "the account is under [NAME] only", "I upgraded to the Kestrel Gold plan": "I upgraded to the Kestrel Gold plan",
    "मेरा नाम मीनल सोंधानी है": "मेरा नाम [NAME] है", "my аadhaar is ０４０２59464928": "my аadhaar is [IDENTITY]", "": "", "  ": "  ",
}


def test_personal_information(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*REDACTED, None])], "k int, text string, _text int")
    found = {r.k: r for r in personal.redact(df, "text", ["k"]).collect()}
    assert [(t, found[i].redacted) for i, t in enumerate(REDACTED) if found[i].redacted != REDACTED[t]] == []
    assert found[len(REDACTED)].redacted is None and found[len(REDACTED)].pii_types == []
    assert personal.redact(df.limit(0), "text", ["k"]).count() == 0


PREFILTERED = {
    "this is Zubin Marwah about the parcel": "this is [NAME] about the parcel", "block 12 Rowan Street, Harnpur": "[ADDRESS]", "no 12 Rowan Street, Harnpur": "[ADDRESS]",
    "double nine triple eight double seven triple six": "[PHONE]",
}
SOUP = (
    "this is my name mr hi this is calling for Zubin Marwah K asha fenwick block no flat 12 12/4 12-3 Rowan Street nagar teaknagar Harnpur 560001 double triple nine eight O 9 98451 +91 (080) 2233-44 AB "
    "ABCDE1234F A 123-45-6789 0402 5946 at rate the dot (dot) [dot] (at) [at] @ asha@kolmail.com asha kolmail.com example. .com com underscore _ - dash plus number aadhaar phone मेरा नाम मीनल सोंधानी १२३४५६७८९० ９８４５１２３４５６ аt. No, BLOCK."
).split()


def test_the_filter_of_candidates_changes_nothing():
    finder = personal.Finder(personal.trained(), frozenset(), frozenset())
    assert {t: finder.redact(t)[0] for t in PREFILTERED} == PREFILTERED
    r = random.Random(4)
    for names in ((), ("asha", "zubin")):
        finder = personal.Finder(personal.trained(), frozenset(names), frozenset(["fenwick"] if names else ()))
        for text in (*PREFILTERED, *REDACTED, *(" ".join(r.choices(SOUP, k=r.randint(1, 12))) for _ in range(6000))):
            tokens = [personal._token_of(w) for w in text.split()]
            assert finder.spans(tokens) == personal.candidates(tokens, finder.given, finder.surnames), text


@pytest.mark.parametrize("bound", [personal.NAMES, 2, 0])
def test_names_beyond_the_bound_and_later_ones_of_a_text_are_known(spark, monkeypatch, bound):
    names = [("Zubin", "Marwah"), ("Talia", "Orvane"), ("Keshav", "Dunmore"), ("Ilsa", "Pembry"), ("Roshan", "Quillon"), ("Anvi", "Strade")]
    first, others = names[0], names[1:]
    led = [f"my name is {g} {s} and please ask for {a} {b} only" for g, s in [first] for a, b in others for _ in range(2)]
    bare = [f"send it to {g.lower()} {s.lower()} today" for g, s in names] + [f"{s.upper()} {g.upper()} wrote" for g, s in names] + [None, "", "send it to green table today"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*led, *bare, *bare])], "k int, text string").repartition(3)
    monkeypatch.setattr(personal, "NAMES", bound)
    found = {r.k: r.redacted for r in personal.redact(df, "text", ["k"]).collect()}
    wanted = ["send it to [NAME] today"] * 6 + ["[NAME] wrote"] * 6 + [None, "", "send it to green table today"]
    assert [found[i] for i in range(len(led), len(led) + 2 * len(bare))] == wanted * 2
    assert (personal.name_lists(df, "text")[2] is None) == (bound > 2)


def test_personal_information_in_very_long_texts():
    finder = personal.Finder(personal.trained(), frozenset(), frozenset())
    text = "please wait " * 20_000 + "my number is 5192834751 " + "thank you " * 1000
    assert finder.redact(text)[1] == ["phone"]


def test_languages(spark, data):
    release = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/release.parquet")
    extra = [("a", "नमस्ते जी मेरा बिल अभी तक नहीं आया है", "hi", "hi", False), ("b", "please send the receipt for the parcel again", None, " ", None), ("c", None, None, None, None), ("d", "", None, "xx", None), ("e", "ठीक है", "en", "en", False), ("f", "1 2 3 4 5 6", None, None, None)]
    names = ["utterance_id", "transcription", "language", "language_tag", "is_code_mixed"]
    more = spark.createDataFrame(extra, "utterance_id string, transcription string, language string, language_tag string, is_code_mixed boolean")
    rows = release.select(*names).unionByName(more)
    found = {r.utterance_id: r for r in languages.detect(rows, *names).collect()}
    assert [x.language for x in found["a"].languages] == ["hi"] and not found["a"].wrong
    assert [x.language for x in found["b"].languages] == ["en"] and found["b"].wrong
    assert all(not found[k].wrong for k in "cdef") and found["c"].languages == [] == found["f"].segments
    held = [r for r in release.where("language = 'ta' AND language_tag = 'ta' AND NOT is_code_mixed").dropDuplicates(["utterance_id"]).collect() if len((r.transcription or "").split()) >= 5]
    assert sum([x.language for x in found[r.utterance_id].languages] == ["ta"] for r in held) / len(held) > 0.9


def test_languages_of_capitalized_texts(spark, data):
    release = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/release.parquet")
    said = "please send the receipt for the parcel again"
    texts = {"upper": said.upper(), "title": said.title(), "plain": said, "name": "मेरा बिल अभी तक नहीं आया है Kestrel Gold Plan Card"}
    names = ["utterance_id", "transcription", "language", "language_tag", "is_code_mixed"]
    more = spark.createDataFrame([(k, t, None, None, None) for k, t in texts.items()], "utterance_id string, transcription string, language string, language_tag string, is_code_mixed boolean")
    found = {r.utterance_id: r for r in languages.detect(release.select(*names).unionByName(more), *names).where(F.col("utterance_id").isin(*texts)).collect()}
    assert {k: ([x.language for x in r.languages], r.wrong) for k, r in found.items()} == {"upper": (["en"], True), "title": (["en"], True), "plain": (["en"], True), "name": (["hi"], True)}


def test_forward_backward_is_that_of_all_paths():
    import itertools

    r = np.random.default_rng(2)
    emit, moves, starts = r.normal(size=(1, 4, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    post = np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        w = np.exp(starts[path[0]] + sum(emit[0, i, c] for i, c in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        for i, c in enumerate(path):
            post[i, c] += w
    assert np.allclose(languages.forward_backward(emit, np.ones((1, 4), bool), moves, starts)[0][0], post / post.sum(1, keepdims=True))


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "p2_languages"])
def test_queries_run(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert len(df.columns) == len(set(df.columns)) and df.count() >= 0
