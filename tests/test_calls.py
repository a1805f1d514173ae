"""Calls in flight: retries, errors, waves and what is committed."""

import os
import time

import pytest
from pyspark.sql import functions as F

from kestrel.operators import calls
from kestrel.plans.q_models import flaky


def prompts(spark, n=300):
    rows = spark.range(n).select("id", F.concat(F.lit("p"), (F.col("id") % 120).cast("string")).alias("p"))
    return rows.unionByName(spark.createDataFrame([(-1, None)], "id long, p string"))


def expected(prompt, attempts):
    for a in range(1, attempts + 1):
        try:
            return flaky(prompt, a), None, a
        except TimeoutError as e:
            error = f"TimeoutError: {e}"
    return None, error, attempts


def test_every_prompt_ends_with_one_value_or_one_error(spark, tmp_path):
    folder = str(tmp_path / "answers")
    df = prompts(spark)
    got = calls.call_stage(df, "p", flaky, folder, attempts=2, wait=0.001, wave_rows=50, tasks=3).collect()
    assert len(got) == 301
    for r in got:
        assert (r.value, r.value_error, r.value_calls) == ((None, None, None) if r.p is None else expected(r.p, 2))
    waves = [x for x in os.listdir(folder) if x.startswith("wave-")]
    assert len(waves) == 3 and spark.read.parquet(*[f"{folder}/{w}" for w in waves]).count() == 120
    assert {r.value_error is None for r in got} == {True, False}


def test_committed_answers_are_not_asked_again(spark, tmp_path):
    folder, asked = str(tmp_path / "answers"), str(tmp_path / "asked")
    os.mkdir(asked)

    def call(prompt, attempt):
        open(f"{asked}/{prompt}-{attempt}-{time.time_ns()}", "w").close()
        return flaky(prompt, attempt)

    df = prompts(spark)
    calls.call_stage(df.where("id % 120 < 40"), "p", call, folder, attempts=1, wait=0).count()
    assert len(os.listdir(asked)) == 40
    # a wave that was under way when its driver was lost has no mark: it does not count
    os.mkdir(f"{folder}/wave-lost")
    spark.createDataFrame([("x", 0.5, None, 1)], "pkey string, value double, error string, calls int").write.parquet(f"{folder}/wave-lost/part")
    got = calls.call_stage(df, "p", call, folder, attempts=1, wait=0)
    assert len(os.listdir(asked)) == 120 and got.where("p is not null and value is null and value_error is null").count() == 0
    failed = got.where("value_error is not null").select("p").distinct().count()
    assert failed > 10
    again = calls.call_stage(df, "p", lambda p, a: flaky(p, a + 1), folder, attempts=3, wait=0.001, again=True)
    assert again.where("value_error is not null").select("p").distinct().count() < failed
    assert calls.committed(spark, folder).count() == 120


def test_calls_run_together_and_waits_grow(monkeypatch):
    waits = []
    monkeypatch.setattr(time, "sleep", waits.append)
    assert calls._ask(lambda p, a: 1 / 0, "p", 6, 1.0, 8.0) == (None, "ZeroDivisionError: division by zero", 6)
    assert len(waits) == 5 and all(2 ** i / 2 <= min(w, 8.0) <= 2 ** i for i, w in enumerate(waits[:4])) and waits[4] <= 8.0


def test_open_calls_are_bounded(spark, tmp_path):
    """A task of 20 calls of 50 ms with 5 in flight takes 4 rounds, not 20."""
    import threading

    def call(prompt, attempt, state={"open": 0, "most": 0}, lock=threading.Lock()):
        with lock:
            state["open"] += 1
            state["most"] = max(state["most"], state["open"])
        time.sleep(0.05)
        with lock:
            state["open"] -= 1
        return float(state["most"])

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(20)])] * 2, ["pkey", "prompt"])
    started = time.time()
    out = pa.Table.from_batches(calls._calls(call, pa.float64(), 5, 1, 0, 0)(iter([batch])))
    assert time.time() - started < 0.9 and 1 < max(out["value"].to_pylist()) <= 5


def test_text_answers_and_nothing_to_ask(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "p string")
    got = {r.p: r.said for r in calls.call_stage(df, "p", lambda p, a: p * 2, str(tmp_path / "t"), out="said", kind="string").collect()}
    assert got == {"a": "aa", "b": "bb"}
    none = calls.call_stage(df.where("false"), "p", lambda p, a: p, str(tmp_path / "n"), kind="string")
    assert none.collect() == [] and none.columns == ["p", "value", "value_error", "value_calls"]


@pytest.mark.parametrize("k", [2])
def test_merge_and_rescore(spark, k):
    from kestrel.operators import rerank as rr

    rows = [(1, r, "q?", c, f"Context: t{r} Answer:") for r, c in enumerate([0.1, 0.9, 0.9, 0.3])]
    df = spark.createDataFrame(rows, "qid long, rank int, q string, c double, z_prompt string")
    score = lambda d: d.withColumn("c", F.length("prompt") + F.col("temperature"))
    r = rr.merge_and_rescore(df, k, "<question> <title> - <context> Answer:", "Context:", "Answer:", [1.0, 2.0], score).collect()
    assert [x.z_prompt for x in r] == ["q? \nt1\nt2 Answer:"]
    assert r[0].c == pytest.approx(len("q? \nt1\nt2 Temperature: 1.0000\nAnswer:") + 1.5)
