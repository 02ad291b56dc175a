import json

import pytest

from vaktavya.functions.plain import edits
from vaktavya.functions.plain import plain_normalize as form
from vaktavya.plans.settings import Settings
from vaktavya.semantic import judge, pipeline, sounds
from vaktavya.semantic.pairs import apply_pairs, deletions, verify_pair

ACCEPTED = {
    "spelling": [("எப்படி", "எப்டி"), ("ಸುಮ್ಮನೆ", "ಸುಮ್ನೆ"), ("ನಾವು", "ನಾವ್"), ("இல்லை", "இல்ல"), ("ছিল", "ছিলো"), ("করব", "করবো"), ("ठिक", "ठीक"), ("हूं", "हूँ"), ("அஞ்சு", "அஞ்சி"), ("எண்பத்தி", "எம்பத்தி"), ("இரநூறு", "எரநூறு")],
    "split_join": [("ఎంత ఉంది", "ఎంతుంది"), ("എവിടെയാണ്", "എവിടെ ആണ്"), ("कौन से", "कौनसे"), ("health care", "healthcare")],
    "script": [("कार", "car"), ("सर", "sir"), ("லோன்", "loan"), ("டோக்கன்", "token"), ("ಕಾರ್", "car"), ("স্যার", "sir"), ("കോൾ", "call"), ("ഗൂഗിൾ", "google"), ("নম্বর", "number"), ("ഡിസൈഡ്", "decide"), ("ഓൺലൈൻ", "online"), ("ફોલો", "follow"), ("மீட்டிங்", "meeting")],
    "number": [("ಟೂ ಹಂಡ್ರೆಡ್", "2 0 0"), ("વન ફાઇવ સેવન થ્રી", "1 5 7 3"), ("వన్ థౌసండ్ త్రీ హండ్రెడ్ అండ్ ఫార్టీ టూ", "1 3 4 2"), ("జీరో పాయింట్ జీరో సెవెన్", "0 0 7"), ("টু থাউজ্যান্ড টোয়েন্টি এইট", "2 0 2 8"), ("ട്വന്റി", "2 0"), ("ಒನ್ ಆರ್ ಟೂ", "1 or 2"), ("सिक्सटी सिक्स", "6 6")],
    "filler": [("hmm", ""), ("আহ", "")],
}
REJECTED = {
    "spelling": [("இந்த", "ಇಂದ"), ("देखी", "দেখি"), ("ಮಾಡ್ಸಿದ್ದಾರೆ", "ಮಾಡ್ತಿದ್ದಾರೆ"), ("बंद", "बंध"), ("तुमचा", "तुमचं"), ("আজকেই", "আজকে"), ("बोलतीये", "बोलतेय"), ("insurance", "assurance"), ("loan", "lane"), ("yes", "ok"), ("શું", "સુ"), ("કહી", "કઈ"), ("5", "five")],
    "split_join": [("boy cut", "boycott"), ("credit b", "kreditbee"), ("என்ன இது", "ಏನಿದು")],
    "script": [("आम्ही", "আমি"), ("ಹೌದು", "no")],
    "number": [("এট্টি", "8"), ("নেওয়া", "9 0"), ("દુશો", "2 4 8"), ("টুয়েন্টি ফাইভ থাউজেন্ডের", "2 5 0 0 0"), ("half", "0 5"), ("leven", "1 1"), ("ಟೂ ನೂರ", "2 0 0"), ("9 0", "8 0")],
    "filler": [("haan", ""), ("hmm", "ah"), ("", "नहीं")],
    "synonym": [("5", "6")],
}


@pytest.mark.parametrize("kind,h,r", [(k, *p) for k, ps in ACCEPTED.items() for p in ps])
def test_accepted(kind, h, r):
    assert verify_pair(form(h), form(r), kind).accepted


@pytest.mark.parametrize("kind,h,r", [(k, *p) for k, ps in REJECTED.items() for p in ps])
def test_rejected(kind, h, r):
    assert not verify_pair(form(h), form(r), kind).accepted


def test_spoken_numbers_have_their_digits_value():
    assert verify_pair(form("24000"), "twenty four thousand", "number").accepted
    assert verify_pair(form("11 am"), "eleven am", "number").accepted
    assert not verify_pair(form("12"), "eleven", "number").accepted


def test_unverified_numbers_only_on_request():
    pair = form("944"), form("નવસો ચુંબાલીસ")
    assert not verify_pair(*pair, "number").accepted
    assert verify_pair(*pair, "number", allow_unverified_numbers=True).accepted


@pytest.mark.parametrize("word,latin", [("லோன்", "lon"), ("நான்", "nan"), ("அவன்", "avan"), ("ಹಂಡ್ರೆಡ್", "hamdred"), ("law", "la"), ("city", "sity")])
def test_latin_spelling(word, latin):
    assert sounds.latin(word) == latin


def test_application_saves_edits_or_does_nothing():
    out = apply_pairs(
        form("naan car vaanginen"),
        form("naan ಕಾರ್ vaanginen hmm"),
        [
            {"hypothesis_span": "ಕಾರ್", "reference_span": "car", "type": "script"},
            {"hypothesis_span": "hmm", "reference_span": "", "type": "filler"},
            {"hypothesis_span": "vaanginen", "reference_span": "naan", "type": "spelling"},
        ],
    )
    assert (out["word_edits"], len(out["accepted"]), len(out["rejected"])) == (0, 2, 1)
    pair = [{"hypothesis_span": "சார்", "reference_span": "sir", "type": "script"}]
    assert apply_pairs("sir ok sir", form("சார் ok சார்"), pair)["word_edits"] == 0
    gain = apply_pairs("car", form("car ಕಾರ್"), [{"hypothesis_span": "ಕಾರ್", "reference_span": "car", "type": "script"}])
    assert gain["accepted"] == [] and gain["word_edits"] == 1
    assert apply_pairs("a b c", "a x c", [{"hypothesis_span": "zzz", "reference_span": "b", "type": "spelling"}])["word_edits"] == 1
    assert apply_pairs("um a b", "a b", [{"hypothesis_span": None, "reference_span": "um", "type": "filler"}])["word_edits"] == 0
    assert apply_pairs("a", "b", None)["word_edits"] == 1


def test_deletions_cover_the_distance():
    for a, b in (("a b c d", "a d"), ("x", "y"), ("a a b", "b a")):
        gone = deletions(a.split(), b.split())
        assert all(x < y for x, y, _ in gone) and sum(y - x for x, y, _ in gone) <= edits(a.split(), b.split())


def test_pipeline(spark, tmp_path):
    def echo_judge(reference, hypothesis, language):
        if "boom" in hypothesis:
            raise RuntimeError("no answer")
        return [{"hypothesis_span": "कार", "reference_span": "car", "type": "script"}]

    rows = spark.createDataFrame(
        [(1, "my car", "my कार", "hi"), (2, "same", "same", "en"), (3, "...", "x", "en"), (4, "a b", "", "en"), (5, "a", "boom", "en"), (6, "my car", "my कार", "hi"), (7, None, None, None)],
        "id int, r string, h string, l string",
    )
    prepared = pipeline.prepare(rows, "id", "r", "h", "l")
    asked = pipeline.questions(prepared)
    assert asked.count() == 2
    answers, failures = judge.answer_into(asked, str(tmp_path / "cache"), "m", echo_judge, parallel=2, attempts=1)
    assert failures == 1
    found = {r.row_key: r for r in pipeline.judged(prepared, answers).collect()}
    assert {k: r.status for k, r in found.items()} == {1: "success", 2: "exact", 3: "empty_reference", 4: "empty_hypothesis", 5: "judge_error", 6: "success", 7: "empty_reference"}
    assert found[1].semantic_word_edits == 0 and found[1].word_edits == 1 and found[5].semantic_wer is None and found[4].semantic_wer == 1.0
    total = pipeline.semantic_score(pipeline.judged(prepared, answers)).first()
    assert total.semantic_wer == 2 / 7 and total.semantic_wer_or_lexical == 3 / 8
    assert judge.pending_questions(asked, answers).count() == 1


def test_whole_pipeline(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def answers(text):
        calls.add(1)
        asked = json.loads(text.rpartition("\n")[2])
        if "boom" in asked["hypothesis"]:
            return "no JSON"
        return json.dumps({"equivalences": [{"hypothesis_span": "कार", "reference_span": "car", "type": "script"}, {"type": "script"}]})

    rows = spark.createDataFrame([(1, "my car", "my कार", "hi"), (2, "a", "boom", "en"), (3, "same", "same", "en")], "id int, r string, h string, l string")
    options = Settings(cache_dir=str(tmp_path), judge_attempts=1, parallel=2)
    run = lambda who: pipeline.evaluate(rows, "id", "r", "h", "l", who, "m", options)
    statuses = lambda df: {r.row_key: r.status for r in df.collect()}
    before, _ = run(None)
    assert statuses(before) == {1: "no_judge", 2: "no_judge", 3: "exact"}
    found, failures = run(judge.text_judge(answers))
    assert statuses(found) == {1: "success", 2: "judge_error", 3: "exact"} and failures == 1 and calls.value == 2
    audit = {r.row_key: (r.accepted, r.rejected) for r in pipeline.audited(found).collect()}
    assert json.loads(audit[1][0])[0]["reference_span"] == "car" and audit[1][1] == "" == audit[3][0]
    again, failures = run(judge.text_judge(answers))
    assert failures == 1 and calls.value == 3 and statuses(again)[1] == "success"
    assert pipeline.evaluate(rows, "id", "r", "h", "l", options=options)[1] == 0


def test_cache_and_sample(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"key":"a","model":"m","response":{"equivalences":[]}}\n\n{"key":"a","model":"m","response":{"equivalences":[{"type":"script"}]}}\n{"key":"b","resp\n')
    found = judge.load_json_cache(spark, str(tmp_path / "c.jsonl")).collect()
    assert [(r.cache_key, len(r.response.equivalences)) for r in found] == [("a", 1)]
    import hashlib

    ids = [f"id{i}" for i in range(300)]
    rows = spark.createDataFrame([(i,) for i in ids], "i string")
    kept = {r.i for r in rows.where(judge.sampled_in(rows.i, 0.3)).collect()}
    assert kept == {i for i in ids if int.from_bytes(hashlib.sha1(i.encode()).digest()[:4], "big") / 0xFFFFFFFF < 0.3}
    with pytest.raises(KeyError):
        judge.get_judge("nobody")


def test_sql_verdicts_agree_on_the_published_pairs():
    import duckdb

    from vaktavya.sql import SQL

    pairs = [(k, h, r) for lists in (ACCEPTED, REJECTED) for k, ps in lists.items() for h, r in ps]
    pairs += [("number", a, b) for a, b in (("24000", "twenty four thousand"), ("11 am", "eleven am"), ("12", "eleven"), ("half", "0.5"), ("5 rupees", "five rupees"))]
    pairs += [(k, r, h) for k, h, r in pairs] + [("script", "phone", "फोन"), ("script", "school", "स्कूल"), ("script", "kitten", "कटा"), ("spelling", "चिट्ठी", "चिठी"), ("split_join", "फोन नंबर", "phonenambar")]
    con = duckdb.connect()
    con.execute("CREATE TABLE judge_cache (response STRUCT(equivalences STRUCT(hypothesis_span VARCHAR, reference_span VARCHAR, type VARCHAR)[]))")
    for k, h, r in pairs:
        con.execute("INSERT INTO judge_cache VALUES ({'equivalences': [{'hypothesis_span': ?, 'reference_span': ?, 'type': ?}]})", [h, r, k])
    columns = [c[0] for c in con.execute(SQL["pair_verdicts"]).description]
    found = {(x["kind"], x["hypothesis_span"], x["reference_span"]): x["reason"] for x in (dict(zip(columns, row)) for row in con.execute(SQL["pair_verdicts"]).fetchall())}
    wrong = [(p, found[p], verify_pair(form(p[1]), form(p[2]), p[0]).reason) for p in dict.fromkeys(pairs) if found[p] != verify_pair(form(p[1]), form(p[2]), p[0]).reason]
    assert wrong == []
