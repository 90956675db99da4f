"""Streams against tables: late and shuffled steps, restarts, replays, expiry."""

import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ligature.operators import runs
from ligature.streaming import jobs, ordered, sinks

SCHEMA = "run_id long, step int, loss double, grad_norm double, ts timestamp"
DAY = dt.datetime(2024, 1, 1)


def steps(run, n, seed=0, start=0):
    rnd = random.Random(seed)
    out, level = [], 4.0
    for k in range(n):
        level = level if 60 < k < 110 else level * rnd.choice([0.9, 1.0, 1.1])
        loss = rnd.choice([float("nan"), float("inf"), None]) if rnd.random() < 0.04 else 1e-9 if 130 < k < 145 else level
        out.append((run, k, loss, None if rnd.random() < 0.02 else 30.0 if rnd.random() < 0.02 else 1.0, DAY + dt.timedelta(seconds=start + 10 * k)))
    return out


def put(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def alarms(spark, tmp_path, seen, **limits):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = ordered.ordered_alarms(source, "ts", patience=20, warm=20, **limits)
    query = jobs.for_each_batch(out, lambda df, _: seen.extend(map(tuple, df.collect())), str(tmp_path / "mark"))
    query.awaitTermination(240)
    assert query.exception() is None
    return query


def wanted(spark, rows):
    table = runs.stability(spark.createDataFrame(rows, SCHEMA), patience=20, warm=20)
    names = ["numerical_instability", "exploding_gradients", "non_finite_loss", "complete_stagnation"]
    return {(r["run_id"], r["step"], r["steps_since_best"], n) for r in table.collect() for n in names if r[n]}


def test_late_and_shuffled_steps_are_judged_as_a_table(spark, tmp_path):
    rows = steps(1, 180, 1) + steps(2, 90, 2, 300)
    rows.sort(key=lambda r: r[4] + dt.timedelta(seconds=random.Random(str(r[:2])).uniform(0, 500)))  # up to 500 s late
    thirds = [rows[:90], rows[90:180], rows[180:]]
    seen = []
    for k, part in enumerate(thirds):
        put(spark, part, tmp_path / f"in/{k}")
        if k != 1:
            alarms(spark, tmp_path, seen)  # restarted from its checkpoint
    end = [(3, 0, 1.0, 1.0, DAY + dt.timedelta(hours=2)), (3, 1, 1.0, 1.0, DAY + dt.timedelta(hours=2))]
    put(spark, end[:1], tmp_path / "in/8")
    alarms(spark, tmp_path, seen)
    put(spark, end[1:], tmp_path / "in/9")
    alarms(spark, tmp_path, seen)
    assert len(seen) == len(set(seen)) and set(seen) == wanted(spark, rows) and len(seen) > 30


def test_too_late_rows_go_and_finished_runs_are_forgotten(spark, tmp_path):
    put(spark, steps(1, 60, 3), tmp_path / "in/0")
    put(spark, steps(2, 3, 4, 40000), tmp_path / "in/1")
    put(spark, [(1, 900, float("nan"), 1.0, DAY + dt.timedelta(seconds=5))] + steps(2, 3, 5, 90000), tmp_path / "in/2")
    put(spark, steps(2, 3, 6, 90100), tmp_path / "in/3")
    seen = []
    query = alarms(spark, tmp_path, seen, idle="1 hour")
    assert {s for s in seen if s[0] == 1} == wanted(spark, steps(1, 60, 3))
    left = query.lastProgress.stateOperators[0].numRowsTotal
    state = spark.read.format("statestore").option("stateVarName", "judged").load(str(tmp_path / "mark")).select("key.run_id").collect()
    assert left and {r["run_id"] for r in state} == {2}


class State(dict):
    """A run's state and its calls, as Spark's client has them."""

    calls = 0

    def call(self, name, *x):
        self.calls += 1
        found = {"get": lambda: self.get("judged"), "update": lambda v: self.update(judged=v), "clear": lambda: self.pop("judged", None)}
        found |= {"getValue": lambda k: self.get(k), "updateValue": lambda k, v: self.update({k: v}), "removeKey": lambda k: self.pop(k)}
        found |= {"registerTimer": lambda t: self.update(timer=t), "deleteTimer": lambda t: self.pop("timer")}
        return found[name](*x)

    def __getattribute__(self, name):
        dearer = ("getValue", "updateValue", "removeKey", "registerTimer", "deleteTimer")
        return (lambda *x: dict.__getattribute__(self, "call")(name, *x)) if name in dearer else dict.__getattribute__(self, name)


class Verdict:
    def __init__(self, state):
        self.get, self.update, self.clear = (lambda *x, n=n: state.call(n, *x) for n in ("get", "update", "clear"))


class Clock:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at


@pytest.mark.parametrize("n, near", [(67, 256), (150, 40), (150, 1)])
def test_a_run_costs_few_calls_of_the_state(spark, monkeypatch, n, near):
    monkeypatch.setattr(ordered, "NEAR", near)
    rows = steps(1, n, 7)
    random.Random(3).shuffle(rows)
    zero = int(DAY.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    frame = pd.DataFrame([(zero + k * 10_000, k, loss, grad, loss is None, grad is None) for _, k, loss, grad, _ in rows], columns=["at", "step", "loss", "grad_norm", "no_loss", "no_grad_norm"])
    monitor = ordered.Monitor(20, 1e-6, 10.0, 20, 10**9, span=100_000)
    monitor.handle = monitor.waiting = state = State()
    monitor.judged = Verdict(state)
    seen = []
    for part in (frame[: n // 2], frame[n // 2 :]):
        seen += list(monitor.handleInputRows((1,), iter([part]), Clock(0)))
    for now in (zero + 555_000, zero + 10**7, zero + 10**9 + 10**7):
        assert state["timer"] <= now
        seen += list(monitor.handleExpiredTimer((1,), Clock(now), Clock(state.pop("timer"))))
    assert not state  # nothing is left, no timer either
    assert {tuple(r) for f in seen for r in f.itertuples(index=False)} == wanted(spark, rows)
    assert near < n or state.calls <= 3 * 5  # five batches


def lines(spark, folder, name, texts):
    (folder / "in").mkdir(exist_ok=True)
    (folder / "in" / name).write_text("\n".join(texts) + "\n")


def test_strings_come_once_over_restarts_and_replays(spark, tmp_path):
    source = spark.readStream.text(str(tmp_path / "in") if (tmp_path / "in").mkdir() is None else "").select(F.col("value").alias("smiles"))
    handle = sinks.write_once(str(tmp_path / "out"))
    rnd, every = random.Random(1), []
    for k in range(4):
        texts = [f"C{rnd.randint(0, 60)}" for _ in range(50)]
        every += texts
        lines(spark, tmp_path, f"{k}.txt", texts)
        sinks.run_sink(source, handle, str(tmp_path / "mark")).awaitTermination(90)
    out = lambda: sorted(r["smiles"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert out() == sorted(set(every))
    last = spark.createDataFrame([(t,) for t in texts], "smiles string")
    handle(last, 3)  # the last batch again
    assert out() == sorted(set(every))
    handle(spark.createDataFrame([("C1",), (None,), ("new",), ("new",)], "smiles string"), 4)
    assert out() == sorted({*every, "C1", "new"})


@pytest.mark.parametrize("times", [1, 3])
def test_a_replayed_ledger_batch_changes_nothing(spark, tmp_path, times):
    first = [(1, "CCO"), (2, "CCO"), (3, "!!"), (4, "CC")]
    second = [(5, "CC"), (6, "CN"), (7, "CN"), (8, "??"), (9, "CCO")]
    handle = sinks.write_ledger_batches(str(tmp_path / "g"))
    for batch, rows in enumerate((first, second)):
        for _ in range(times):
            handle(spark.createDataFrame(rows, "mol_id int, smiles string"), batch)
    converted = spark.read.option("header", True).csv(str(tmp_path / "g/converted")).select("smiles").collect()
    assert sorted(r[0] for r in converted) == ["CC", "CCO", "CN"]
    failed = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "g/failed")).select("smiles", "Reason").collect()
    assert sorted(map(tuple, failed)) == sorted([("!!", "conversion_failed"), ("??", "conversion_failed"), ("CC", "Duplicate SMILES"), ("CCO", "Duplicate SMILES"), ("CCO", "Duplicate SMILES"), ("CN", "Duplicate SMILES")])
    stats = [json.loads(x) for p in (tmp_path / "g/stats/batch=1").glob("part*") for x in p.read_text().splitlines()]
    assert {s["outcome"]: s["n"] for s in stats} == {"ok": 3, "Duplicate SMILES": 4, "conversion_failed": 2}
