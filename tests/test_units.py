import pytest

from quire.operators import units

RESULTS = "result_id long, metric string, value double, unit string, raw_text string"
METRICS = "metric string, common_unit string"
COMMON = [("latency", "ms"), ("accuracy", "%"), ("train time", "h"), ("params", "M"), ("peak memory", "GB"), ("power draw", "W")]


def run(spark, data, metrics=COMMON):
    got = units.measured(spark.createDataFrame(data, RESULTS), spark.createDataFrame(metrics, METRICS)).collect()
    return {r["result_id"]: r for r in got}


@pytest.mark.parametrize(
    "metric, value, unit, raw, common, converted",
    [
        ("latency", None, None, "reached 0.25 s on PageVale", 250.0, True),
        ("Latency", 12.0, "ms", "", 12.0, False),
        ("latency", 12.0, "s", "latency (ms): 12", 12.0, False),  # the text holds
        ("latency", 1500.0, None, "1'500 µs", 1.5, True),
        ("accuracy", None, None, "accuracy of 0.461, averaged over 9 runs", 46.1, True),
        ("accuracy", None, None, "27,90", 27.9, False),
        ("accuracy", 93.05, "pct.", "Accuracy 93.05 pct.", 93.05, False),
        ("train_time", None, None, "24 h 45 min", 24.75, True),
        ("train time", None, None, "3:30 h:min", 3.5, True),
        ("train time", 8081.0, "", "Foo-2, train time: 8081 sec", 8081 / 3600, True),
        ("params", 541699517.0, None, "params [parameters] = 541,699,517", 541.699517, True),
        ("params", None, None, "params of 3.37Mparams, averaged over 4 runs", 3.37, False),
        ("peak memory", None, None, "57.09 GiB", 57.09 * 1024**3 / 1e9, True),
        ("peak memory", None, "gbytes", "64.23", 64.23, False),
        ("power draw", None, None, "power draw 1.5e3 mW", 1.5, True),
        ("power draw", None, None, "1.37 x 10^4 mW", 13.7, True),
    ],
)
def test_reading(spark, metric, value, unit, raw, common, converted):
    got = run(spark, [(1, metric, value, unit, raw)])[1]
    assert got["common_value"] == pytest.approx(common)
    assert got["is_converted"] is converted


def test_no_measurement_and_unknowns(spark):
    got = run(spark, [(1, "latency", None, None, "n/a"), (2, "accuracy", float("nan"), "%", ""), (3, None, 1.0, "s", "1 s"), (4, "unlisted", 1.0, "s", "1 s"), (5, "latency", 3.0, "parsecs", "")])
    assert not any(r["is_converted"] for r in got.values())
    assert got[1]["common_value"] is None and got[2]["common_value"] is None
    assert got[3]["recorded_unit"] is None and got[4]["recorded_unit"] is None


def test_found_is_distinct_and_empty_tables_work(spark):
    data = [(1, "latency", 2.0, "s", "2 s")] * 3 + [(None, "latency", 2.0, "s", "2 s")]
    df = spark.createDataFrame(data, RESULTS).selectExpr("*", "1 as known", "'x' as quantity")
    metrics = spark.createDataFrame(COMMON, METRICS)
    assert [r[0] for r in units.found(df, metrics).collect()] == [1]
    assert units.found(df.limit(0), metrics).count() == 0
    assert units.found(df, metrics.limit(0)).count() == 0


def test_weighted_distance_keeps_milli_from_mega():
    assert units.weighted_distance("mw", "mW") < units.weighted_distance("mw", "MW")
    assert units.weighted_distance("hours", "hour") < 0.5 < units.weighted_distance("hour", "sour")
