"""Personal information on sentences of forms that neither the tables nor the module's own examples have."""

import random

from vaktavya.llm import personal

HELD_OUT = {
    "kindly forward everything to lucia_ferro at fastpost dot in before noon": ["email"],
    "[kiran.d@wellspring.edu] is where the tickets go": ["email"],
    "his id reads jo-ann.p@mail.mooring.co and nothing else": ["email"],
    "mail sunita at greenleaf.org whenever you can": ["email"],
    "we gave h.okafor AT the rate tidewater dot net": ["email"],
    "leave a voicemail on 044 2345 67890 if nobody answers": ["phone"],
    "her landline, (0712) 255 4410, is always busy": ["phone"],
    "dial nine eight double zero one two triple five seven and wait": ["phone"],
    "the courier's mobile: +44 7700 900123": ["phone"],
    "reach our office at 080-4123-9876 ext none": ["phone"],
    "మొబైల్ 98480 22338 కి చేయండి": ["phone"],
    "copy of passport K1234567 attached": [],
    "passport number KLM1234567 was renewed": ["identity"],
    "my social security is 219-09-9999": ["identity"],
    "PAN BQRPK4821L is linked": ["identity"],
    "they verified aadhaar 4821 7735 0912 twice": ["identity"],
    "voter card no XGD4410928": ["identity"],
    "आधार कार्ड 3321 8876 1204 जमा किया": ["identity"],
    "parcel goes to shop 14, Palm Avenue, Eastwick": ["address"],
    "the keys are at villa 9 Lotus Enclave, Brindhill 400093": ["address"],
    "we now live at 22/7 Cotton Mill Road Sundarpet": ["address"],
    "apartment 5C, Cedar Towers, 4th Main, Nellore Road": ["address"],
    "deliver to quarter 31 Railway Colony near the chapel": ["address"],
    "my name is Oluwaseun Adebayo": ["name"],
    "speaking with Harriet Stowe was no use": ["name"],
    "मेरा नाम अर्जुन वाधवा है": ["name"],
    "mera naam Arjun Wadhwa hai": ["name"],
    "ask for Mrs Paloma Reyes at reception": ["name"],
    "this is Ingrid B Lund from the clinic": ["name"],
    "the carton weighs 4200 grams and costs 3999": [],
    "call me when tracking 9921 4410 8821 0093 moves": [],
    "meet us at platform 9 at half past six": [],
    "I look at example.com every day": [],
    "interest at the rate of 12 dot 5 percent": [],
    "the Golden Harvest scheme closed in March": [],
    "flat 20 percent off on every order": [],
    "no 3 of the list is missing": [],
    "house prices rose 14 percent on the coast road": [],
    "order number 448120933317 is pending": [],
    "this is Monday and nobody came": [],
    "version 10.4.2 of the app crashed": [],
    "between 1998 and 2004 she lived abroad": [],
    "double trouble: two vans, three drivers, one road": [],
    "invoice INV20394 for 12,500 rupees": [],
    "hi good afternoon team": [],
    "paid Rs 4,500 on 12/04/2023": [],
    "": [],
}


def test_held_out_forms():
    finder = personal.Finder(personal.trained(), frozenset(), frozenset())
    found = {t: finder.redact(t)[1] for t in HELD_OUT}
    wrong = {t: (found[t], HELD_OUT[t]) for t in HELD_OUT if found[t] != HELD_OUT[t]}
    right = sum(len(set(found[t]) & set(HELD_OUT[t])) for t in HELD_OUT)
    named, wanted = sum(map(len, found.values())), sum(map(len, HELD_OUT.values()))
    assert right / named >= 0.9 and right / wanted >= 0.9, wrong


def test_other_text_stays():
    finder = personal.Finder(personal.trained(), frozenset(), frozenset())
    assert finder.redact("we live at 22/7 Cotton Mill Road, Sundarpet - 560 034 for now")[0] == "we live at [ADDRESS] for now"
    assert finder.redact("ring (0712) 255 4410, or mail sunita at greenleaf.org.")[0] == "ring [PHONE], or mail [EMAIL]."


PARTS = (
    "my name is|this is|hi|Mr|mera naam|मेरा नाम|talk to|block|no|flat|plot|shop|12|7B|22/7|3-1-9|2023|at|at the rate|dot|(at)|[at]|@|.|example.com|org|kiran|Kiran|LUND|Reyes|B|of|the|"
    "double|triple|nine|oh|O|98480|+91|(080)|4123-9876|KLM1234567|A|219-09-9999|4821|0912|road|nagar|Rajnagar|Enclave,|560034|-|560|034|aadhaar|mobile|नंबर|फोन|fon|pon|pin|depot|policy|Rs|"
    "please|wait|जी|ठीक|हाँ।|yes.|no,|kiran@fast.co|h.okafor|_|underscore|a_b|x-y|plus|९८४५|аt|ｆｌａｔ|​12| "
).split("|")


def test_leaving_generators_out_changes_nothing_on_generated_sentences():
    r = random.Random(12)
    for names in ((frozenset(), frozenset()), (frozenset(["kiran", "asha"]), frozenset(["lund", "reyes"]))):
        finder = personal.Finder(personal.trained(), *names)
        for _ in range(5000):
            tokens = [personal._token_of(w) for w in " ".join(r.choices(PARTS, k=r.randint(1, 14))).split()]
            assert finder.spans(tokens) == personal.candidates(tokens, *names)


def test_phrases_are_known_in_any_script_and_spelling():
    finder = personal.Finder(personal.trained(), frozenset(), frozenset())
    for said in ("mera nam", "mera naam", "मेरा नाम", "majhan nav", "majha nav", "nanna hesaru", "ನನ್ನ ಹೆಸರು", "en peyar", "na peru", "aamar nam", "marun nam"):
        assert finder.redact(f"{said} Elif Corran")[0] == f"{said} [NAME]", said
    # English words that sound like an Indian one don't count for it
    assert finder.redact("हमारे घर पर ही नहीं मेरा मीटर")[1] == []
