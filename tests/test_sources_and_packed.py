import re

import pytest
from pyspark.sql import functions as F

from vaktavya.operators.packed import parses, unpack
from vaktavya.sources.records import CASTS, damaged_records, invalid_values, parse_records, sound_records

CELLS = {
    "a, b,c": ["a", "b", "c"], "EMI 2,400; x": ["EMI 2,400", "x"], "tax/GST / y": ["tax/GST", "y"], "customer's copy|z": ["customer's copy", "z"],
    '["a; b", "c"]': ["a; b", "c"], '"the ""gold"" plan, new";was': ['the "gold" plan, new', "was"], "“Kestrel plan, gold”; k": ["Kestrel plan, gold", "k"],
    "'x', 'y, z'": ["x", "y, z"], "one\r\ntwo\r\n\r\nthree": ["one", "two", "three"], "p • q\tr": ["p", "q", "r"], "a,, ,b": ["a", "b"], "x，y": ["x", "y"],
    "1,50,000": ["1,50,000"], "  solo ": ["solo"], "same, same": ["same", "same"], "['k']": ["k"], "fee?": ["fee?"], "by this | wait, x; y": ["by this", "wait", "x", "y"],
}


def test_cells(spark):
    rows = spark.createDataFrame([(str(i), c) for i, c in enumerate(CELLS)], "id string, cell string")
    found = {}
    for r in unpack(rows, "id", "cell").orderBy("id", "pos").collect():
        found.setdefault(r.id, []).append((r.pos, r.value))
    assert {c: [v for _, v in found[str(i)]] for i, c in enumerate(CELLS)} == CELLS
    assert all([p for p, _ in v] == list(range(1, len(v) + 1)) for v in found.values())


def test_cells_without_values_and_clashing_columns(spark):
    rows = spark.createDataFrame([("a", None, 1, "x"), ("b", " NaN ", 1, "x"), ("c", "none", 2, "x"), (None, "k", 3, "x"), ("d", "", 4, "x"), ("e", ",;|", 5, "x"), (None, "k", 3, "x")], "id string, cell string, _cell int, value string")
    assert [(r.id, r.pos, r.value) for r in unpack(rows, "id", "cell").collect()] == [(None, 1, "k")] * 2
    assert unpack(rows.limit(0), "id", "cell").count() == 0


def test_a_very_long_cell(spark):
    rows = spark.createDataFrame([("a", ", ".join(f"k{i}" for i in range(5000)))], "id string, cell string")
    assert unpack(rows, "id", "cell").count() == 5000


def test_the_finest_parse_comes_first():
    assert parses("a,b")[0][0] == ["a", "b"]


RECORDS = {
    "c1_t1,text,1.5,ok,": None, '"c1_t1","a ""b"", c","","SUCCESS","e"': None, 'c1_t1,"two\nlines",,Timeout,x': None, "c1_t1,,0,missing_audio,": None,
    "c1_t1,a,b,1,ok,": "wrong_column_count", "c1_t1,a,1,ok": "wrong_column_count", "": "wrong_column_count", 'c1_t1,"open,1,ok,': "unclosed_quote", 'c1_t1,"a"b,1,ok,': "text_outside_quotes",
    'c1_t1,a"b"c,1,ok,': "text_outside_quotes", "c1_t1,a\nb,1,ok,": "line_break_outside_quotes", "x1,a,1,ok,": "bad_utterance_id", "c1_t1,a,3s,ok,": "bad_latency_ms",
    "c1_t1,a,-1,ok,": "bad_latency_ms", "c1_t1,a,NaN,ok,": "bad_latency_ms", "c1_t1,a,1,done,": "bad_status", "c1_t1,a,1, ok,": "bad_status", "c1_t1\x1f,a,1,ok,": "bad_utterance_id",
}


def test_records(spark):
    rows = spark.createDataFrame([(i, r, "x") for i, r in enumerate([*RECORDS, None])], "line_id int, raw_line string, reason string")
    found = {r.line_id: r.reason for r in parse_records(rows).collect()}
    assert found == dict(enumerate([*RECORDS.values(), "no_record"]))
    sound = {r.line_id: r for r in sound_records(rows).collect()}
    assert sound[1].prediction == 'a "b", c' and sound[1].latency_ms is None and sound[1].status == "success" and sound[0].latency_ms == 1.5 and sound[2].prediction == "two\nlines"
    assert damaged_records(rows).count() + len(sound) == len(RECORDS) + 1
    assert parse_records(rows.limit(0)).count() == 0


def test_each_distinct_value_is_cast_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def cast(v):
        seen.add(len(v))
        return v.where(v != "bad")

    rows = spark.createDataFrame([(i, f"c1_t1,text {i},{'bad' if i % 4 == 0 else i % 4},ok,") for i in range(400)], "line_id int, raw_line string").repartition(6)
    found = parse_records(rows, casts={"latency_ms": ("not_cast", cast)}).collect()
    assert sum(r.reason == "not_cast" for r in found) == 100 and len(found) == 400
    # the values are bad, 1, 2 and 3
    assert seen.value == 4


def test_casts_stay_above_the_invalid_values(spark):
    rows = spark.createDataFrame([(1, "c1_t1,a,1,ok,")], "line_id int, raw_line string")
    parsed = rows.select(F.lit(None).cast("string").alias("_fault"), *(F.col("raw_line").alias(f"_{c}") for c in CASTS))
    plan = invalid_values(parsed, CASTS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("Aggregate") and "RLIKE" not in plan[plan.index("Aggregate") :] and "try_cast" in plan.lower()


def test_long_and_repeated_records(spark):
    text = '"' + '""'.join(["x" * 20] * 20_000) + '"'
    rows = spark.createDataFrame([(1, f"c1_t1,{text},1,ok,"), (1, f"c1_t1,{text},1,ok,"), (2, "c1_t1,a\x1fb,1,ok,")], "line_id int, raw_line string")
    found = parse_records(rows).collect()
    assert [r.reason for r in found] == [None] * 3 and {r.prediction for r in found if r.line_id == 2} == {"a\x1fb"}


def test_records_agree_with_a_pattern(spark, data):
    field = r'("(?:[^"]|"")*"|[^",\r\n]*)'
    whole = re.compile(rf"{field},{field},{field},{field},{field}")
    table = spark.read.parquet(f"{data}/raw_predictions.parquet")
    bad = {r.line_id for r in damaged_records(table).collect()}
    for r in table.collect():
        m = whole.fullmatch(r.raw_line or "")
        g = [x[1:-1].replace('""', '"') if x.startswith('"') else x for x in m.groups()] if m else []
        sound = bool(m) and re.fullmatch(r"c\d+_t\d+", g[0]) and re.fullmatch(r"(\d+(\.\d+)?)?", g[2]) and g[3].lower() in ("success", "ok", "error", "timeout", "rate_limited", "missing_audio")
        assert bool(sound) == (r.line_id not in bad)


@pytest.mark.parametrize("name", ["p4_found", "p7_found"])
def test_queries_run(spark, data, name):
    import __spark_entry__

    assert __spark_entry__.queries()[name](spark, data).count() > 0
