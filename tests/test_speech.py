import pytest
from pyspark.sql import functions as F

from vaktavya.functions.ids import plain_id
from vaktavya.sources import speech


@pytest.fixture
def release(spark):
    return spark.createDataFrame([("u1", "c1", "hi", "en-hi", True, 1.0, "d", "a b", "a b", None), ("u2", "c1", "ml", "ml", False, 1.0, "d", "c", "c", None)], speech.RELEASE)


def test_release_scan(spark, release, tmp_path):
    release.withColumn("audio", F.lit(b"x")).write.parquet(str(tmp_path / "hindi" / "test-0.parquet"))
    assert speech.load_release(spark, str(tmp_path), "hindi").columns == speech.RELEASE.fieldNames()
    assert "audio" in speech.load_release(spark, str(tmp_path), with_audio=True).columns
    assert speech.load_release(spark, str(tmp_path.parent), revision=tmp_path.name).count() == 2
    with pytest.raises(ValueError):
        speech.load_release(spark, str(tmp_path), "klingon")
    with pytest.raises(FileNotFoundError):
        speech.load_release(spark, str(tmp_path), "tamil")


def test_predictions_scan(spark, tmp_path):
    (tmp_path / "p.csv").write_text('utterance_id,prediction,status\nu1,"say ""hi"",\nthen",success\nu2,nan,success\nu3,,success\n')
    found = {r.utterance_id: r.prediction for r in speech.load_predictions(spark, str(tmp_path / "p.csv")).collect()}
    assert found == {"u1": 'say "hi",\nthen', "u2": "nan", "u3": ""}
    with pytest.raises(speech.MissingColumn):
        speech.load_predictions(spark, str(tmp_path / "p.csv"), text_column="hypothesis")


def test_predictions_in_parquet_keep_their_place_in_the_file(spark, tmp_path):
    rows = [("u1", "zzz", "success"), ("u1", "aaa", "success"), ("u1", "bbb", "error"), ("u2", "first", "error"), ("u2", "last", None)]
    spark.createDataFrame(rows, "utterance_id string, prediction string, status string").coalesce(1).write.parquet(str(tmp_path / "p.parquet"))
    found = {r.utterance_id: r.prediction for r in speech.load_predictions(spark, str(tmp_path / "p.parquet")).collect()}
    assert found == {"u1": "aaa", "u2": "last"}
    # an own order column wins over the place
    spark.createDataFrame([(*r, 9 - i) for i, r in enumerate(rows)], "utterance_id string, prediction string, status string, attempt int").write.parquet(str(tmp_path / "q.parquet"))
    assert {r.prediction for r in speech.load_predictions(spark, str(tmp_path / "q.parquet")).collect()} == {"zzz", "first"}


def test_a_csv_without_breaks_in_quotes_is_read_in_parts(spark, tmp_path):
    lines = ["utterance_id,prediction,status", *(f'u{i % 500},"text ""{i}""",{"ok" if i < 3000 else "error"}' for i in range(4000))]
    (tmp_path / "p.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert speech.scan_predictions(spark, str(tmp_path / "p.csv")).rdd.getNumPartitions() > 3
        found = {r.utterance_id: r.prediction for r in speech.load_predictions(spark, str(tmp_path / "p.csv")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {f"u{i}": f'text "{2500 + i}"' for i in range(500)}


def test_best_attempts_by_a_number_alone(spark):
    rows = spark.createDataFrame([("u1", "p", "error", 1), ("u1", "p", "OK", 2), ("u1", "p", None, 3), ("u1", "q", None, 4), (None, "q", "ok", 5)], "utterance_id string, provider string, status string, row_id long")
    best = speech.best_attempts(rows, ["provider", "utterance_id"], "row_id", ["row_id"])
    assert sorted(map(tuple, best.collect()), key=str) == [("p", "u1", 2), ("q", "u1", 4), ("q", None, 5)]
    assert "SortAggregate" not in best._jdf.queryExecution().executedPlan().toString()
    wide = speech.best_attempts(rows, ["provider", "utterance_id"], "row_id").collect()
    assert {r.status for r in wide} == {"OK", None, "ok"} and len(wide) == 3


def test_supported_rows(spark, release, tmp_path):
    assert [r.utterance_id for r in speech.supported_rows(release, " Deepgram").collect()] == ["u1"]
    assert speech.supported_rows(release, "unheard").count() == speech.supported_rows(release, None).count() == 2
    (tmp_path / "rules.json").write_text('{"x": {"exactly": [["en", "hi"]]}}')
    assert [r.utterance_id for r in speech.supported_rows(release, "x", speech.load_unsupported(tmp_path / "rules.json")).collect()] == ["u2"]


def test_best_attempts(spark):
    rows = spark.createDataFrame([("u1", "bad", "error", 1), ("u1", "good", "OK", 2), ("u1", "later", "timeout", 3), ("u2", "only", None, 4)], "utterance_id string, prediction string, status string, attempt int")
    assert {r.utterance_id: r.prediction for r in speech.best_attempts(rows).collect()} == {"u1": "good", "u2": "only"}
    assert speech.best_attempts(rows.drop("status")).count() == 4
    with pytest.raises(speech.DuplicateIds):
        speech.check_unique(rows)


def test_alignment(spark, release):
    predictions = spark.createDataFrame([("u1", "x"), ("u9", "y")], "utterance_id string, prediction string")
    with pytest.raises(speech.MissingPredictions):
        speech.align(release, predictions)
    found = {r.utterance_id: r.prediction for r in speech.align(release, predictions, require_complete=False).collect()}
    assert found == {"u1": "x", "u2": ""}


def test_batches_of_a_hot_key_are_numbered_across_tasks(spark):
    from collections import Counter

    rows = [("hot", f"{i:05}") for i in range(3000)] + [("cold", f"{i:05}") for i in range(7)] + [(None, f"{i:05}") for i in range(20)]
    df = spark.createDataFrame(rows, "k string, id string").repartition(5)
    found = speech.batches(df, F.col("k"), 16, F.col("id"))
    assert found.columns == ["k", "id", "batch"]
    assert {(r.k, r.id): r.batch for r in found.collect()} == {(k, i): int(i) // 16 for k, i in rows}
    assert max(Counter((r.k, r.batch) for r in found.collect()).values()) == 16
    assert speech.batches(df.limit(0), F.col("k"), 16, F.col("id")).count() == 0


def test_languages(spark, release):
    assert [r[0] for r in release.select(speech.tag_codes(F.lit(" HI_en-hi-"))).limit(1).collect()] == [["en", "hi"]]
    assert [r.utterance_id for r in speech.without_languages(release, ("ml",)).collect()] == ["u1"]
    assert [r.utterance_id for r in speech.without_languages(release, exactly=(("hi", "en"),)).collect()] == ["u2"]


def test_ids(spark):
    spelled = {
        "c00000007_t0003": "c00000007_t0003", " C00000007_T0003\t": "c00000007_t0003", "./audio/c7-t003.WAV": "c00000007_t0003", "c7_t3": "c00000007_t0003",
        "c00000007 t0003": "c00000007_t0003", "c12_t90000102": "c00000012_t90000102", "odd": "odd", "": "", "c0_t0": "c00000000_t0000",
    }
    rows = spark.createDataFrame([(s,) for s in [*spelled, None]], "s string")
    assert [r[0] for r in rows.select(plain_id(F.col("s"))).collect()] == [*spelled.values(), None]
