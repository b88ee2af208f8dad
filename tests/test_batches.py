"""Resumable delivery of batch plans."""

import time

import pytest

from quaylark.operators import catalogue
from quaylark.streaming import batches


def run(query, done):
    end = time.time() + 120
    while time.time() < end and query.isActive and not done():
        time.sleep(0.3)
    query.stop()
    return query


@pytest.mark.parametrize("each", [1, 3])
def test_every_batch_once_over_stops(spark, tmp_path, each):
    """A run that fails in the middle, one that is stopped, and one to the end: every batch once and in order, as resume_offset counts."""
    tracks = spark.range(50).selectExpr("concat('t', id) AS track_id")
    plan = catalogue.batch_plan(tracks, 3, 2, 50, 4, 2).select("batch_idx", "slot", "track_id", "optimizer_step")
    path, folder, check = (f"file://{tmp_path}/{n}" for n in ("plan", "out", "check"))
    n = batches.write_plan(plan, path)
    assert n == 14
    kind = plan.schema
    got = lambda: batches.delivered(spark, folder, "batch_idx long, slot int, track_id string, optimizer_step long, part int").collect()
    with pytest.raises(Exception, match="stopped"):
        batches.deliver(batches.plan_stream(spark, path, kind, check, each), folder, check, until=2).awaitTermination(120)
    first = got()
    assert {r["batch_idx"] for r in first} == set(range(2 * each))
    # The step that a resumed loader starts with is the one after what was delivered.
    at = catalogue.resume_offset(100, 2, 2 * each, 50, 4, 2)
    follow = [r["optimizer_step"] - 0 for r in plan.collect() if r["batch_idx"] == 2 * each]
    assert {s + at for s in follow} == {100}
    run(batches.deliver(batches.plan_stream(spark, path, kind, check, each), folder, check), lambda: len({r["batch_idx"] for r in got()}) > 3 * each)
    for _ in range(2):  # the second time there is nothing left
        batches.deliver_all(batches.plan_stream(spark, path, kind, check, each), folder, check, n)
    rows = got()
    assert sorted((r["batch_idx"], r["slot"], r["track_id"], r["optimizer_step"]) for r in rows) == sorted(map(tuple, plan.collect()))
    if each == 1:
        assert all(r["part"] == r["batch_idx"] for r in rows)


def test_stops_between_micro_batches(spark, tmp_path):
    """Stops with everything committed: no batch comes twice."""
    plan = spark.range(24).selectExpr("id div 3 AS batch_idx", "id")
    path, folder, check = (f"file://{tmp_path}/{n}" for n in ("plan", "out", "check"))
    n = batches.write_plan(plan, path)
    for wanted in (2, 4, 7, 8, 8):
        query = batches.deliver(batches.plan_stream(spark, path, plan.schema, check, 1), folder, check)
        run(query, lambda: query.lastProgress and len({r["batch_idx"] for r in batches.delivered(spark, folder, "batch_idx long, id long").collect()}) >= wanted)  # noqa: B023
    batches.deliver_all(batches.plan_stream(spark, path, plan.schema, check, 1), folder, check, n)
    assert sorted(r["id"] for r in batches.delivered(spark, folder, "batch_idx long, id long").collect()) == list(range(24))
