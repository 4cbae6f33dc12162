from pyspark.sql import functions as F

import pytest

from talentloom.streaming.stage import PROVIDER_ERROR, Stage, preflight

SCHEMA = "item long, text string"


def files(spark, path, groups):
    """One file a group of items, so that epochs are known."""
    for k, items in enumerate(groups):
        spark.createDataFrame([(i, f"t{i}") for i in items], SCHEMA).coalesce(1).write.parquet(str(path / f"{k:02d}"))
    return str(path / "*")


def judged(bad=(), rejected=(), kind=PROVIDER_ERROR, once=False):
    def process(rows):
        fails = F.col("item").isin(list(bad)) & ((F.col("attempt") == 1) if once else F.lit(True))
        state = F.when(F.col("item").isin(list(rejected)), "rejected").when(fails, "failed").otherwise("success")
        return rows.select("item", "attempt", state.alias("state"), F.when(state != "success", F.when(state == "rejected", "business_validation_error").otherwise(kind)).alias("failure_type"), F.lit(None).cast("string").alias("error"), F.upper("text").alias("out"))

    return process


def told(stage):
    return {r["item"]: (r["state"], r["attempts"]) for r in stage.states().collect()}


def test_each_item_once_failed_ones_again_and_a_readable_record(spark, tmp_path):
    source = files(spark, tmp_path / "in", [[1, 2, 3], [3, 4], [5]])
    stage = Stage(spark, str(tmp_path / "s"), source, SCHEMA, judged(bad=[4], rejected=[2], once=True))
    record = stage.run("one")
    assert told(stage) == {1: ("success", 1), 2: ("rejected", 1), 3: ("success", 1), 4: ("failed", 1), 5: ("success", 1)}
    assert record["items"] == 5 and record["states"] == {"success": 3, "rejected": 1, "failed": 1} and not record["stopped_early"]
    assert stage.run("two")["items"] == 0  # nothing new
    assert stage.resume_failed("three")["states"] == {"success": 1}
    assert told(stage)[4] == ("success", 2) and told(stage)[2] == ("rejected", 1)
    assert sorted(r["out"] for r in stage.results().collect()) == ["T1", "T3", "T4", "T5"]
    assert stage.read_record("one") == record
    assert [c["cause"] for c in record["dominant_failure_causes"]] == ["business_validation_error", PROVIDER_ERROR]


def test_a_crash_between_results_and_ledger_counts_no_item_twice(spark, tmp_path):
    source = files(spark, tmp_path / "in", [[1, 2], [3, 4], [5, 6]])
    stage = Stage(spark, str(tmp_path / "s"), source, SCHEMA, judged())
    commit, calls = stage._commit, []

    def broken(rows, epoch):
        out = commit(rows, epoch)
        calls.append(epoch)
        if len(calls) == 2:
            raise OSError("driver is lost")  # results and ledger of the epoch are there, its commit is not
        return out

    stage._commit = broken
    with pytest.raises(Exception, match="driver is lost"):
        stage.run("one")
    again = Stage(spark, str(tmp_path / "s"), source, SCHEMA, judged())
    again.run("two")
    assert told(again) == {i: ("success", 1) for i in range(1, 7)}
    assert again.results().count() == 6 and again.ledger().count() == 6


def test_saturation_stops_before_the_next_epoch_and_a_later_run_goes_on(spark, tmp_path):
    source = files(spark, tmp_path / "in", [[1, 2], [3, 4], [5, 6], [7]])
    stage = Stage(spark, str(tmp_path / "s"), source, SCHEMA, judged(bad=[2, 3, 4], once=True), saturation=3)
    first = stage.run("one")
    assert first["stopped_early"] and first["stop_reason"] == "provider_saturation" and sorted(told(stage)) == [1, 2, 3, 4]
    second = stage.run("two")
    assert not second["stopped_early"] and second["items"] == 3 and sorted(told(stage)) == list(range(1, 8))
    stage.resume_failed("three")
    assert set(told(stage).values()) == {("success", 1), ("success", 2)}


def test_other_failures_and_broken_rows_of_errors_do_not_saturate(spark, tmp_path):
    source = files(spark, tmp_path / "in", [[1, 2, 3, 4], [5]])
    assert not Stage(spark, str(tmp_path / "a"), source, SCHEMA, judged(bad=[1, 2, 3, 4], kind="json_error")).run("r")["stopped_early"]
    assert not Stage(spark, str(tmp_path / "b"), source, SCHEMA, judged(bad=[1, 2, 3])).run("r")["stopped_early"]


def test_preflight(spark, tmp_path):
    def fails(text):
        def probe():
            raise RuntimeError(text)

        return probe

    fine = lambda: True
    assert preflight(("a", fine), ("b", fails("x")))["recommended_provider"] == "a"
    degraded = preflight(("a", fails("429 Too Many Requests")), ("b", fine))
    assert degraded["provider_preflight_status"] == "degraded_fallback_only" and degraded["providers"]["a"]["status"] == "provider_rate_limited"
    failed = preflight(("a", fails("missing_api_key")), ("b", fails("timed out")))
    stage = Stage(spark, str(tmp_path / "s"), files(spark, tmp_path / "in", [[1]]), SCHEMA, judged())
    record = stage.run("r", failed)
    assert record["stop_reason"] == "provider_preflight_failed" and record["items"] == 0 and told(stage) == {}
    assert stage.run("s", degraded)["items"] == 1
