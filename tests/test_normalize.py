from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vaktavya import queries
from vaktavya.functions.normalize import fold, nfkc, settle_spellings, tokens, with_normal_forms
from vaktavya.functions.plain import compose, plain_normalize

PAIRS = [
    ("eight lakhs", "8 lakhs"), ("eight lakh", "8 lakh"), ("twenty five lakh", "25 lakh"), ("two thousand", "2 thousand"), ("five hundred", "500"),
    ("three crore", "3 crore"), ("one lakh fifteen thousand", "1 लाख 15 हजार"), ("पंद्रह हजार", "15 हजार"), ("एक लाख", "1 लाख"),
    ("one point two five", "1.25"), ("eight point seven five percent", "8.75%"), ("ninety percent", "90%"), ("rupees five hundred", "₹500"),
    ("twenty eighth may", "28th may"), ("two thirty", "2:30"), ("twenty four thousand", "24,000"), ("फोन ५० है", "फोन 50 है"), ("௨௪", "24"),
    ("क्‌ष", "क्ष"), ("Okay, sir.", "ok sir"), ("colour", "color"), ("maam", "mam"), ("₹287", "Rs. 287"), ("पच्चास", "50"),
    ("nine thousand two hundred ninety three", "nine two nine three"), ("Ｆｕｌｌ width", "full width"),
]
FORMS = {
    "wait one second": "wait 1 second", "2 3": "2 3", "my number is 9 8 7 6 5": "my number is 9 8 7 6 5", "five ten five twenty": "5 1 0 5 2 0",
    "zero thousand": "1 0 0 0", "hundred": "1 0 0", "thousand million": "1 0 0 1 0 0 0", "two hundred and five": "2 0 5", "one hundred and": "1 0 0 and",
    "the point is clear": "the point is clear", "haa uhh aaah": "ha uhh ah", "क्या हाल है?": "क्या हाल है", "...": "", "": "", "the second one": "the 2 1",
    "o'clock": "o clock", "I'm you're": "im youre", "madam mam": "madam mam", "€5": "€ 5", "a+b": "a+b", "\t x\n": "x",
}
WORDS = "one two nineteen twenty ninety hundred thousand lakh crore and 5 12 point second first 3rd x दो सौ ok haan %".split()


def spark_forms(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.n for r in with_normal_forms(rows, {"t": "n"}).orderBy("i").collect()]


def test_pairs_agree(spark):
    found = spark_forms(spark, [t for p in PAIRS for t in p])
    assert [(a, b) for a, b in zip(found[::2], found[1::2]) if a != b] == []


def test_forms(spark):
    assert dict(zip(FORMS, spark_forms(spark, list(FORMS)))) == FORMS


def test_null_is_empty(spark):
    assert spark_forms(spark, [None]) == [""]


@pytest.mark.parametrize("text,form", FORMS.items())
def test_single_texts(text, form):
    assert plain_normalize(text) == form


def test_columns_agree_with_single_texts(spark):
    import random

    r = random.Random(4)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 12))) for _ in range(600)]
    assert spark_forms(spark, texts) == [plain_normalize(t) for t in texts]


@given(st.integers(0, 999_999_999))
@settings(max_examples=200, deadline=None)
def test_spelled_numbers_come_back(n):
    small = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    tens = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()

    def below(k):
        if k < 20:
            return [small[k]]
        if k < 100:
            return [tens[k // 10], *([small[k % 10]] if k % 10 else [])]
        return [small[k // 100], "hundred", *(below(k % 100) if k % 100 else [])]

    said = []
    for size, name in ((1_000_000, "million"), (1000, "thousand")):
        if n // size % 1000:
            said += [*below(n // size % 1000), name]
    said += below(n % 1000) if n % 1000 or not said else []
    assert "".join(compose(said)) == str(n)


def test_numbers_have_no_bound(spark):
    text = "9" * 30 + " billion" * 3
    # integers have no bound here: 999... times a billion, then a billion and a billion more
    assert spark_forms(spark, [text]) == [" ".join(str(int("9" * 30) * 10**9 + 2 * 10**9))]


def test_variants(spark):
    rows = spark.createDataFrame([("twenty six okay",)], "t string")
    assert with_normal_forms(rows, {"t": "n"}, numbers=False).first().n == "twenty six ok"
    assert with_normal_forms(rows, {"t": "n"}, whole_numbers=True, spellings=False).select(F.col("n")).first().n == "26 okay"


def test_expressions_of_single_characters_and_words_agree(spark, data):
    rows = spark.read.parquet(f"{data}/predictions.parquet").select("prediction", nfkc(F.col("prediction")).alias("t"))
    found = rows.select("prediction", F.array_join(settle_spellings(tokens(fold(F.col("t")))), " ").alias("n")).collect()
    assert [(r.prediction, r.n) for r in found if r.n != plain_normalize(r.prediction, numbers=False)] == []


def test_number_forms_of_whole_tables(spark, data):
    rows = [("release", r.utterance_id, r.transcription) for r in spark.read.parquet(f"{data}/release.parquet").collect()]
    rows += [("predictions", str(r.row_id), r.prediction) for r in spark.read.parquet(f"{data}/predictions.parquet").collect()]
    found = Counter(map(tuple, queries.QUERIES["number_forms"](spark, data).collect()))
    assert found == Counter((s, k, plain_normalize(t, spellings=False)) for s, k, t in rows)
    assert sum(plain_normalize(t, numbers=False, spellings=False) != plain_normalize(t, spellings=False) for _, _, t in rows) > 20
