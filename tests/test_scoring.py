import pytest
from pyspark.sql import functions as F

from vaktavya.functions.distance import char_counts, keyword_counts, mixed_counts, mixed_units, sequence_edits, syllables, word_counts
from vaktavya.functions.normalize import with_normal_forms
from vaktavya.functions.plain import edits
from vaktavya.operators import scoring
from vaktavya.sources import speech

RELEASE = [
    ("u1", "c1", "hi", "en-hi", True, 4.1, "banking_finance", "mera loan amount twenty six thousand hai", "", "loan, twenty six thousand"),
    ("u2", "c1", "hi", "hi", False, 0.9, "other", "haan ji", "", None),
    ("u3", "c2", "en", "en", False, 3.2, "insurance", "my policy number please", "", "policy number"),
    ("u4", "c2", "en", "en", False, 1.1, "other", "ok thank you", "", None),
]
PREDICTIONS = [("u1", "mera loan amount 26000 hai"), ("u2", "haan ji"), ("u3", "my policy no please"), ("u4", None)]


@pytest.fixture(scope="module")
def counts(spark):
    release = spark.createDataFrame(RELEASE, speech.RELEASE)
    predictions = spark.createDataFrame(PREDICTIONS, "utterance_id string, prediction string")
    return scoring.row_counts(speech.align(release, predictions)).persist()


def test_fixture_scores(counts):
    s = scoring.score(counts).first()
    assert (s.utterances, s.reference_words, s.keywords_scored, s.empty_hypotheses) == (4, 18, 3, 1)
    assert s.wer == 4 / 18 and s.cer == 17 / 71 and s.mer == 4 / 18 and abs(s.kwer - 1 / 3) < 1e-12


def test_groups_and_sets_agree(counts):
    by = {r.language: r for r in scoring.score_by(counts, "language").collect()}
    assert set(by) == {"en", "hi"} and by["en"].wer == 4 / 7
    sets = {(r.breakdown, r.value): r for r in scoring.score_sets(counts, "language", "domain").collect()}
    assert sets[None, None].wer == 4 / 18 and sets["language", "en"].wer == 4 / 7 and sets["domain", "other"].kwer is None
    assert len(sets) == 6


def test_null_groups_are_left_out(counts):
    odd = counts.withColumn("language", F.when(F.col("language") == "en", "en"))
    assert [r.language for r in scoring.score_by(odd, "language").collect()] == ["en"]
    assert {r.breakdown for r in scoring.score_sets(odd, "language").collect()} == {None, "language"}


def test_intervals(counts):
    a, b = (scoring.bootstrap_ci(counts, n_boot=80).first() for _ in range(2))
    assert a == b and 0 <= a.low <= 4 / 18 <= a.high
    one = scoring.bootstrap_ci(counts.where("call_id = 'c2'"), n_boot=20).first()
    assert one.low == one.high == 4 / 7
    assert tuple(scoring.bootstrap_ci(counts.where("keywords IS NULL"), "kwer", n_boot=20).first()) == (None, None)
    assert tuple(scoring.bootstrap_ci(counts.limit(0), n_boot=20).first()) == (None, None)
    with pytest.raises(ValueError):
        scoring.bootstrap_ci(counts, "bleu")


def test_interval_is_that_of_one_matrix_of_draws(spark, counts):
    import numpy as np

    many = counts.crossJoin(spark.range(9).withColumnRenamed("id", "copy")).withColumn("call_id", F.concat("call_id", F.col("copy").cast("string"))).withColumn("w_edits", F.col("w_edits") + F.col("copy"))
    totals = {r.call_id: (r.w_edits, r.w_units) for r in scoring.call_totals(many).collect()}
    e, u = (np.array([totals[c][k] for c in sorted(totals)]) for k in (0, 1))
    draws = np.random.default_rng(7).integers(0, len(e), size=(60, len(e)))
    values = [e[d].sum() / u[d].sum() for d in draws]
    found = scoring.bootstrap_ci(many, n_boot=60, seed=7).first()
    assert tuple(found) == tuple(np.percentile(values, [2.5, 97.5]))
    delta = scoring.paired_delta_ci(many, many.withColumn("w_edits", F.col("w_edits") * 2), n_boot=60, seed=7).first()
    assert np.allclose(tuple(delta), (e.sum() / u.sum(), *np.percentile(values, [2.5, 97.5])))


def test_weights_are_those_of_a_poisson_variable_and_give_like_intervals(spark, counts):
    import numpy as np

    w = scoring.poisson_weights(np.random.default_rng(1).integers(0, 2**32, 3000), 200, 5)
    shares = np.bincount(w.ravel(), minlength=4)[:4] / w.size
    assert np.allclose(shares, np.exp(-1) / np.array([1, 1, 2, 6]), atol=2e-3) and abs(w.sum(0) - 3000).max() < 300
    many = counts.crossJoin(spark.range(60).withColumnRenamed("id", "copy")).withColumn("call_id", F.concat("call_id", F.col("copy").cast("string")))
    drawn, weighed = (scoring.bootstrap_ci(many, n_boot=300, drawn_calls=n).first() for n in (100_000, 0))
    assert abs(drawn.low - weighed.low) < 0.02 and abs(drawn.high - weighed.high) < 0.02
    same = scoring.paired_delta_ci(many, many, n_boot=20, drawn_calls=0).first()
    assert tuple(same) == (0.0, 0.0, 0.0)
    assert tuple(scoring.bootstrap_ci(counts.limit(0), n_boot=20, drawn_calls=0).first()) == (None, None)


def test_paired_difference(counts):
    same = scoring.paired_delta_ci(counts, counts, n_boot=30).first()
    assert tuple(same) == (0.0, 0.0, 0.0)
    worse = scoring.paired_delta_ci(counts, counts.withColumn("w_edits", F.col("w_edits") + 1), n_boot=30).first()
    assert worse.delta == pytest.approx(4 / 18) and worse.low > 0
    apart = scoring.paired_delta_ci(counts.where("call_id = 'c1'"), counts.where("call_id = 'c2'"), n_boot=5).first()
    assert tuple(apart) == (None, None, None)


@pytest.mark.parametrize(
    "keywords,prediction,reference,expected",
    [
        ("loan, EMI\npolicy number\nloan\n", "loan emi policy number", None, (3, 3)),
        ("website", "அந்த websiteல பாருங்க", None, (1, 1)),
        ("policy number", "your policy numbers", None, (1, 1)),
        ("twenty four thousand", "it is 24000 rupees", None, (1, 1)),
        ("24,000, loan", "24000", "24,000 loan", (1, 2)),
        ("car", "my card", "the car", (0, 1)),
        ("policy number", "number policy", "policy number", (0, 1)),
        ("car, white filed", "car ನೋಡಿ", "random ಆಗಿ car ನೋಡ್ಬೇಕು Whitefield ಅಲ್ಲಿ", (1, 1)),
        ("eighty thousand, eight lakhs", "eighty thousand eight lakhs ಇದು", None, (2, 2)),
        ("loan", "two loans", None, (1, 1)),
        ("  \n", "x", None, (0, 0)),
        (None, "x", None, (0, 0)),
        ("nan", "nan", None, (0, 0)),
    ],
)
def test_keywords(spark, keywords, prediction, reference, expected):
    rows = spark.createDataFrame([(keywords, reference or prediction, prediction)], "keywords string, transcription string, prediction string")
    assert tuple(scoring.row_counts(rows).select("kw_hits", "kw_total").first()) == expected
    hits, scored = expected
    counted = lambda r: tuple(rows.select(keyword_counts(F.col("keywords"), F.col("prediction"), r).alias("k")).select("k.rate", "k.hits", "k.scored").first())
    assert counted(F.col("transcription")) == ((1 - hits / scored) if scored else None, hits, scored)
    assert counted(None)[2] >= scored


def test_a_full_width_comma_parts_nothing(spark):
    rows = spark.createDataFrame([("marg，tax", "marg tax", "marg tax")], "keywords string, transcription string, prediction string")
    assert tuple(scoring.row_counts(rows).select("kw_hits", "kw_total").first()) == (1, 1)


def test_expressions_give_the_counts_of_the_kernel(spark, data):
    from vaktavya import queries

    rows = queries.systems(spark, data)
    whole = scoring.row_counts(rows).select("provider", "utterance_id", "w_edits", "w_units", "c_edits", "c_units", "m_edits", "m_units")
    forms = with_normal_forms(rows, {"transcription": "r", "prediction": "h"})
    columns = [F.col("r"), F.col("h")]
    parts = forms.select("provider", "utterance_id", word_counts(*columns).alias("w"), char_counts(*columns).alias("c"), mixed_counts(*columns).alias("m"))
    parts = parts.select("provider", "utterance_id", "w.edits", "w.units", "c.edits", "c.units", "m.edits", "m.units")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_rows(spark):
    rows = [
        ("one two three words", "", (4, 4, 1)), ("...", "hello", (0, 0, 0)), ("ಮನೆಯಲ್ಲಿ ಇದೆ", "ಮನೆಯಲ್ಲ ಇದೆ", (1, 2, 0)), (None, None, (0, 0, 1)), ("a", "...", (1, 1, 0)),
    ]
    df = spark.createDataFrame([(i, r, h) for i, (r, h, _) in enumerate(rows)], "i int, transcription string, prediction string")
    found = [(r.w_edits, r.w_units, r.empty_hyp) for r in scoring.row_counts(df, keywords=False).orderBy("i").collect()]
    assert found == [x for *_, x in rows]


def test_mixed_units(spark):
    df = spark.createDataFrame([("email के regard कितने",)], "t string")
    assert df.select(mixed_units(F.col("t"))).first()[0] == ["email", "के", "regard", "कि", "त", "ने"]
    df = spark.createDataFrame([("क्या",), ("ಕನ್ನಡ",)], "t string")
    assert [r[0] for r in df.select(syllables(F.col("t"))).collect()] == [["क्या"], ["ಕ", "ನ್ನ", "ಡ"]]


def test_sequence_distance_is_levenshtein(spark):
    import random

    r = random.Random(2)
    pairs = [([r.choice("abcd") + "x" for _ in range(r.randint(0, 9))], [r.choice("abcde") + "x" for _ in range(r.randint(0, 9))]) for _ in range(200)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    found = [x.d for x in df.select("i", sequence_edits(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()]
    assert found == [edits(a, b) for a, b in pairs]


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(3_000))
    df = spark.createDataFrame([(long, long + " more")], "a string, b string")
    d = df.select(sequence_edits(F.split("a", " "), F.split("b", " ")).alias("d"))
    assert d.first().d == 1


def test_facts_and_drift(spark, counts):
    facts = scoring.corpus_facts(counts).first()
    assert (facts.utterances, facts.calls, facts.mixed_share, facts.short_share) == (4, 2, 0.25, 0.5)
    assert scoring.normal_form_drift(counts).count() == 4
