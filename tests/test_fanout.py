"""Channels that fail or are late while they run, and stages that are told to stop."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import fanout
from quillgraph.plugins import CallFailed

RESULT = ["query_id", "chunk_id", "score", "score_normalized", "rank", "source"]


def channel(name, chunk=7, score=None):
    def run(asked):
        value = F.lit(1.0) if score is None else score
        return asked.select("query_id", F.lit(chunk).cast("long").alias("chunk_id"), value.alias("score"), F.lit(1.0).alias("score_normalized"), F.lit(1).alias("rank"), F.lit(name).alias("source"))

    return run


def slow(seconds):
    @F.pandas_udf("double")
    def wait(x):
        time.sleep(seconds)
        return x * 1.0

    return channel("slow", score=wait(F.col("query_id")))


def broken(asked):
    return channel("broken", score=F.raise_error(F.lit("the model is away")).cast("double"))(asked)


def away(asked):
    raise OSError("no such index")


@pytest.fixture
def asked(spark):
    return spark.range(3).select(F.col("id").alias("query_id"))


def test_a_failing_and_a_late_channel_leave_the_others(spark, asked):
    failures = {}
    began = time.monotonic()
    found = fanout.fan_out(asked, {"good": channel("good"), "broken": broken, "slow": slow(120), "away": away, "off": away, "other": channel("other", 9)}, ["good", "broken", "slow", "away", "other"], failures, deadline=15)
    assert time.monotonic() - began < 60
    assert {(r.query_id, r.source) for r in found.collect()} == {(i, s) for i in range(3) for s in ("good", "other")} and found.columns == RESULT
    assert set(failures) == {"broken", "slow", "away"}
    assert "the model is away" in failures["broken"] and "no such index" in failures["away"] and "15 s" in failures["slow"]
    assert not spark.sparkContext.statusTracker().getActiveJobsIds(), "the late channel's jobs are cancelled"


def test_failures_are_raised_if_nobody_takes_them(asked):
    with pytest.raises(CallFailed, match="broken"):
        fanout.fan_out(asked, {"good": channel("good"), "broken": broken})
    with pytest.raises(TypeError):
        fanout.fan_out(asked, {"wrong": lambda q: q + 1}, failures={})
    assert fanout.fan_out(asked, {}).count() == 0
    failures = {}
    assert fanout.fan_out(asked, {"away": away}, failures=failures).count() == 0 and list(failures) == ["away"]


def test_channels_run_at_the_same_time(asked):
    meet = threading.Barrier(3, timeout=60)

    def waiting(name):
        def run(q):
            meet.wait()
            return channel(name)(q)

        return run

    assert fanout.fan_out(asked, {n: waiting(n) for n in "abc"}).count() == 9


def test_stages_run_in_turn_and_stop_where_they_are_told(spark, asked):
    seen = []

    def step(name, more):
        def run(rows):
            seen.append(name)
            return rows.withColumn("query_id", F.col("query_id") + more)

        return run

    assert [r.query_id for r in fanout.run_stages(asked, [("one", step("one", 1)), ("two", step("two", 10))]).orderBy("query_id").collect()] == [11, 12, 13]
    signal = fanout.StopSignal()

    def stop(rows):
        signal.request_stop()
        return rows

    with pytest.raises(fanout.Cancelled) as told:
        fanout.run_stages(asked, [("one", step("one", 1)), ("two", stop), ("three", step("three", 1))], signal)
    assert told.value.done[:1] == ["one"] and told.value.stage in ("two", "three") and "three" not in seen


def test_a_running_stage_is_interrupted(spark, asked):
    signal = fanout.StopSignal()
    threading.Timer(6, signal.request_stop).start()
    began = time.monotonic()
    with pytest.raises(fanout.Cancelled) as told:
        fanout.run_stages(asked, [("quick", lambda r: r), ("long", lambda r: slow(120)(r))], signal)
    assert time.monotonic() - began < 60 and told.value.stage == "long" and told.value.done == ["quick"]
    with pytest.raises(Exception, match="divide"):
        fanout.run_stages(asked, [("bad", lambda r: r.select(F.expr("1 / (query_id - query_id)")))])
