"""The fit's sample, long texts, and texts of several languages."""

import numpy as np
import pytest

from vaktavya.llm import languages

NAMES = ["utterance_id", "transcription", "language", "language_tag", "is_code_mixed"]


@pytest.fixture(scope="module")
def model(spark, data):
    release = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/release.parquet")
    return languages.fit(languages.labelled_sample(release, *NAMES[1:]))


def test_a_text_that_fills_the_table_fills_no_sample(spark):
    rows = [(f"text number {'x' * i} of many", "en", "en", False) for i in range(60)] + [("over and over", "en", "en", False)] * 5000 + [(f"दो {'क' * (i + 1)}", "hi", "hi", False) for i in range(40)]
    df = spark.createDataFrame(rows, "t string, l string, g string, m boolean").repartition(7)
    first, again = (languages.labelled_sample(d, "t", "l", "g", "m", sample=30) for d in (df, df.repartition(3)))
    assert first == again and len(first) == len(set(first)) == 60
    assert {c: sum(x[1] == c for x in first) for c in (("en",), ("hi",))} == {("en",): 30, ("hi",): 30}
    assert languages.labelled_sample(df.limit(0), "t", "l", "g", "m") == []


def test_all_words_of_a_training_text_count():
    long = " ".join(["filler"] * 1500 + ["rarest"] * 5)
    fitted = languages.fit([(long, ("en",)), ("दो शब्द यहाँ", ("hi",))])
    assert "rarest" in fitted.lexicon


def test_windows_label_as_the_whole_chain_does(model, monkeypatch):
    parts = ["please send the receipt for the parcel again", "mujhe parchi dobara chahie aur kal tak", "मुझे रसीद दोबारा चाहिए", "your app keeps asking for a code", "नमस्कार मला पावती पुन्हा हवी आहे"]
    text = " ".join(parts[i % 5] for i in range(700))
    whole = languages.segments(model, [text, None, ""])
    monkeypatch.setattr(languages, "WINDOW", 333)
    cut = languages.segments(model, [text, None, ""])
    assert [p[:3] for p in cut[0]] == [p[:3] for p in whole[0]] and cut[1:] == [[], []]
    assert np.allclose([p[3] for p in cut[0]], [p[3] for p in whole[0]], atol=1e-4)


def test_two_languages_of_one_script_may_stand_in_one_text(model):
    hindi, marathi = "मुझे मीटर की रसीद दोबारा चाहिए", "मला वीज बिल ची पावती पुन्हा हवी आहे"
    found = languages.present(languages.segments(model, [f"{hindi} {hindi} {marathi} {marathi}"])[0])
    assert set(found) == {"hi", "mr"}
    strict = languages.Model(model.theta, model.moves, model.starts, model.lexicon, model.trust, rival=30.0)
    assert len(languages.present(languages.segments(strict, [f"{hindi} {hindi} {marathi} {marathi}"])[0])) == 1


def test_english_in_texts_of_one_label_is_not_learned_as_that_language():
    clean = [("your refund has still not reached me", ("en",)), ("মিটার এর মধ্যে ভুল ঠিকানা লেখা আছে", ("bn",))] * 20
    noisy = [("মিটার এর মধ্যে your refund has still not reached me ভুল ঠিকানা লেখা আছে", ("bn",))] * 15
    fitted = languages.fit(clean + noisy)
    found = languages.segments(fitted, ["মিটার এর মধ্যে ভুল your refund has still not reached me"])[0]
    assert [p[2] for p in found] == ["bn", "en"]


def test_words_on_both_sides_of_a_number_are_not_in_a_row(model):
    told = lambda text: [p[4] for p in languages.segments(model, [text])[0]]
    assert told("please send the receipt 5276594660 for the parcel again") == [4]
    assert told("please send the receipt , for the parcel again") == [8]
