"""Exact dedup's calls die at each of their steps and are made again."""

import pytest
from pyspark.sql import DataFrameWriter

from quaylark.llm import exact_dedup as module

SCHEMA = "doc_id long, text string"
CALLS = [[(1, "a"), (2, "B"), (3, "b"), (4, "c")], [(5, "A"), (6, "d"), (7, "d"), (8, "b")], [(9, "e"), (10, "a"), (10, "a")]]


class Died(Exception):
    pass


def told(spark, rows, state):
    return sorted(map(tuple, module.exact_groups(spark.createDataFrame(rows, SCHEMA), state_dir=state).collect()))


@pytest.fixture(scope="module")
def want(spark, tmp_path_factory):
    state = f"file://{tmp_path_factory.mktemp('whole')}/s"
    return [told(spark, rows, state) for rows in CALLS]


def dying(monkeypatch, step):
    """The next call dies before or after the write whose path has the step's word, or at a function of the module."""
    word, when = step.split(":")
    if word.startswith("_") or word == "run_ledger":
        real = getattr(module, word)

        def f(*args, **kwargs):
            if when == "after":
                real(*args, **kwargs)
            raise Died

        monkeypatch.setattr(module, word, f)
        return
    write = DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        hit = word in path
        if hit and when == "before":
            raise Died
        write(self, path, *args, **kwargs)
        if hit:
            raise Died

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)


STEPS = ["/content/call=:before", "/content/call=:after", "/ledger/call=:before", "/ledger/call=:after", "run_ledger:before", "/touched/call=:before", "/touched/call=:after", "run_ledger:after", "exact-found:before", "_mark:before"]


@pytest.mark.parametrize("step", STEPS)
def test_a_call_that_died_is_made_again(spark, tmp_path, monkeypatch, want, step):
    state = f"file://{tmp_path}/s"
    for rows, whole in zip(CALLS[:2], want, strict=False):
        with monkeypatch.context() as m:
            dying(m, step)
            with pytest.raises(Exception):  # noqa: B017
                told(spark, rows, state)
        assert told(spark, rows, state) == whole


def test_other_rows_after_a_call_that_died(spark, tmp_path, monkeypatch):
    """A call whose ledger was complete counts, even if the next one comes with other rows; one that died before does not."""
    state = f"file://{tmp_path}/s"
    for step, counts in (("/ledger/call=:before", 0), ("/touched/call=:after", 1)):
        with monkeypatch.context() as m:
            dying(m, step)
            with pytest.raises(Exception):  # noqa: B017
                told(spark, [(1, f"x{step}")], state)
        assert [r[:3] for r in told(spark, [(2, f"X{step}")], state)] == [(2, 2, 1 + counts)]


def test_locators_name_the_content(spark, tmp_path):
    state = f"file://{tmp_path}/s"
    for rows in CALLS:
        told(spark, rows, state)
    held = spark.read.parquet(f"{state}/touched/call=2").collect()
    text = {(c, r["locator"]): r["text"] for c in range(3) for r in spark.read.parquet(f"{state}/content/call={c}").collect()}
    assert {(text[r["at"]["call"], r["at"]["locator"]], r["at"]["call"]) for r in held} == {("a", 0), ("e", 2)}
