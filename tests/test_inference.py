import json

import pytest
from pyspark.sql import functions as F

from vaktavya import cli
from vaktavya.functions.sql import register_functions
from vaktavya.inference import recognisers as R
from vaktavya.inference import cli as runner
from vaktavya.inference import routing
from vaktavya.plans.settings import Settings, read_dotenv, settings_from
from vaktavya.sources import speech
from vaktavya.streaming import live


class Flaky:
    def __init__(self):
        self.calls = 0

    def transcribe(self, audio, row):
        self.calls += 1
        if audio == b"bad":
            raise R.HttpError(400, "no")
        if self.calls % 2:
            raise R.TransientError("again")
        return "heard"


def test_calls_try_again_only_what_may_pass():
    assert R.call(Flaky(), b"x", R.RowContext(), pause=0)["prediction"] == "heard"
    assert R.call(Flaky(), b"x", R.RowContext(), attempts=1)["status"] == "error"
    assert R.call(Flaky(), b"bad", R.RowContext(), pause=0)["error"].startswith("400")
    assert R.call(Flaky(), None, R.RowContext())["status"] == "missing_audio"
    assert R.is_transient(R.HttpError(503)) and not R.is_transient(ValueError())
    with pytest.raises(KeyError):
        R.get_maker("nobody")


def test_a_run_resumes(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "hi", "en-hi", True), ("u2", "en", "en", False), ("u3", None, None, None)], "utterance_id string, language string, language_tag string, is_code_mixed boolean")
    (tmp_path / "audio").mkdir()
    (tmp_path / "audio" / "u1.wav").write_bytes(b"abc")
    out = str(tmp_path / "out")
    first = R.resume(rows, R.audio_files(spark, str(tmp_path / "audio")), R.get_maker("echo"), out, parallel=2)
    assert {r.utterance_id: r.status for r in first.collect()} == {"u1": "success", "u2": "missing_audio", "u3": "missing_audio"}
    (tmp_path / "audio" / "u2.wav").write_bytes(b"abc")
    again = R.resume(rows, R.audio_files(spark, str(tmp_path / "audio")), R.get_maker("echo"), out, parallel=2)
    assert again.where("utterance_id = 'u1'").count() == 1
    assert tuple(R.tallies(again).first()) == (2, 1)
    assert {r.utterance_id for r in R.finished(again).collect()} == {"u1", "u2"}


def test_routes(spark):
    rows = spark.createDataFrame([("HI ", True, "en_HI"), ("ml", False, "ml"), (None, None, None), ("other", False, "fr-other"), ("ta", True, "en-ta")], "l string, m boolean, t string")
    found = rows.select(
        routing.one_or_many(F.col("l"), F.col("m"), ("hi", "en", "ta"), ("hi", "en")), routing.regional(F.col("l")), routing.code_or_null(F.col("l")),
        routing.supported_or(F.col("t"), ("ml",), "multi"), routing.language_hints(F.col("t"), F.col("l")), routing.language_name(F.col("l")),
    ).collect()
    assert [tuple(r) for r in found] == [
        ("multi", "hi-IN", "hi", "multi", ["en", "hi"], "Hindi"), ("multi", "ml-IN", "ml", "ml", ["ml"], "Malayalam"), ("multi", "unknown", None, "multi", None, ""),
        ("multi", "unknown", None, "multi", None, ""), ("ta", "ta-IN", "ta", "multi", ["en", "ta"], "Tamil"),
    ]


def test_settings(tmp_path):
    (tmp_path / ".env").write_text('# c\nexport VAKTAVYA_PARALLEL="3"\nX\n')
    env = read_dotenv(tmp_path / ".env")
    assert settings_from(env).parallel == 3 and settings_from({"VAKTAVYA_ALLOW_UNVERIFIED_NUMBERS": "Yes"}).allow_unverified_numbers
    assert read_dotenv(tmp_path / "none") == {} and Settings().cache_path("a", "M/1", "2") == "outputs/cache/a/model=m_1/version=2"


def test_streamed_totals_are_those_of_a_batch(spark, tmp_path):
    release = spark.createDataFrame([("u1", "c1", "hi", "hi", False, 1.0, "d", "a b c", "", "b")], speech.RELEASE)
    schema = "utterance_id string, provider string, prediction string, status string, written_at timestamp"
    rows = spark.createDataFrame([("u1", "p", "a b", "success", None), ("u1", "q", "x", "success", None), ("u1", "p", "zzz", "error", None), ("u9", "p", "k", "ok", None)], schema).withColumn("written_at", F.to_timestamp(F.lit("2025-01-01 10:00:00")))
    rows.write.parquet(str(tmp_path / "in"))
    stream = live.scored(live.first_successes(live.arriving(spark, str(tmp_path / "in"), rows)), release)
    live.keep_totals(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    found = {r.provider: (r.w_edits, r.w_units, r.kw_hits, r.utterances) for r in live.totals(spark, str(tmp_path / "out")).collect()}
    assert found == {"p": (1, 3, 1, 1), "q": (3, 3, 0, 1)}
    windows = live.windowed_rates(live.scored(rows.where("status = 'success'"), release)).collect()
    assert {r.provider: r.wer for r in windows} == {"p": 1 / 3, "q": 1.0}


def test_command_line(spark, tmp_path, capsys):
    release = [("u1", "c1", "hi", "hi", False, 1.0, "d", "a b c", "", "b"), ("u2", "c2", "en", "en", False, 1.0, None, "d", "", None)]
    spark.createDataFrame(release, speech.RELEASE).write.parquet(str(tmp_path / "r" / "hindi" / "test-0.parquet"))
    (tmp_path / "p.csv").write_text("utterance_id,prediction\nu1,a b\nu2,\n")
    base = ["--release", str(tmp_path / "r"), "--predictions", str(tmp_path / "p.csv")]
    result = cli.main([*base, "--by", "language", "--ci", "--n-boot", "20", "--json", str(tmp_path / "o.json")])
    assert result["overall"]["wer"] == 0.5 and result["by_language"]["en"]["wer"] == 1.0 and json.loads((tmp_path / "o.json").read_text()) == result
    shown = capsys.readouterr().out.splitlines()
    assert shown[0].split() == ["rows", "scored", "WER", "CER", "MER", "KWER", "utterances", "words"] and shown[2].split()[:3] == ["all", "rows", "50.00%"] and shown[3].startswith("language en")
    part = cli.main([*base, "--provider", "gemini_realtime", "--without", "en"])
    assert part["provider"] == "gemini_realtime" and part["overall"]["utterances"] == 1 and "2 of 2" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main([*base, "--by", "nothing"])


def test_runner_command_line(spark, tmp_path, capsys):
    release = [("u1", "c1", "hi", "hi", False, 1.0, "d", "a", "", None), ("u2", "c2", "ml", "ml", False, 1.0, None, "d", "", None)]
    spark.createDataFrame(release, speech.RELEASE).write.parquet(str(tmp_path / "r" / "hindi" / "test-0.parquet"))
    (tmp_path / "audio").mkdir()
    (tmp_path / "audio" / "u1.wav").write_bytes(b"abc")
    base = ["--provider", "echo", "--release", str(tmp_path / "r"), "--audio-dir", str(tmp_path / "audio"), "--concurrency", "2", "--out", str(tmp_path / "out")]
    assert runner.main([*base, "--limit", "1"]) == (1, 0)
    assert runner.main(base) == (1, 1) and "without success" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        runner.main(["--provider", "nobody", *base[2:]])


def test_package_names():
    import vaktavya

    assert all(callable(getattr(vaktavya, n)) for n in vaktavya.__all__ if n != "LANGUAGES") and vaktavya.LANGUAGES["tamil"] == "ta"
    with pytest.raises(AttributeError):
        vaktavya.nothing  # noqa: B018


def test_checkpoints_need_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from vaktavya.plans import session

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    df = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))
    with pytest.raises(RuntimeError):
        session.settled(df)


def test_sql_functions(spark):
    register_functions(spark)
    assert spark.sql("SELECT speech_normal_form('Twenty six, okay'), speech_word_edits('a b', 'a')").first()[:] == ("2 6 ok", 1)
