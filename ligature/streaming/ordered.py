"""Live alarms in the order of event time: typed state, timers and expiry."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from math import isfinite
from struct import Struct
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "run_id long, step long, steps_since_best long, alarm string"
#: Rows that wait for the watermark are kept by spans of this many milliseconds, and judged a span at a time.
SPAN = 60_000
#: So many rows of a run wait beside its verdict, more in their spans.
NEAR = 256
#: The state of a run that was not seen, as in "judged".
NEW = (None, 0, 0, -1, [], [], b"", [], None)
ROW = Struct("<qq?d?d")


def rounded(x: float) -> float:
    return round(x, 8) + 0.0


def checks(losses: list, grads: list, since: int, patience: int, min_loss: float, max_grad: float) -> dict[str, bool]:
    """The alarms by the last 20 losses and gradients, of which null ones say nothing."""
    last = [x for x in losses[-10:] if x is not None]
    return {
        "numerical_instability": bool(last) and all(x < min_loss for x in last),
        "exploding_gradients": any(not x <= max_grad for x in grads[-10:] if x is not None),
        "non_finite_loss": not all(isfinite(x) for x in losses[-5:] if x is not None),
        "complete_stagnation": since > patience and len({str(rounded(x)) for x in losses if x is not None}) <= 2,
    }


def pack(rows: list[tuple]) -> bytes:
    """Rows (time, step, loss, gradient) as one value: Spark's client goes through the elements of arrays one by one."""
    return b"".join(ROW.pack(at, int(step), loss is None, loss or 0.0, grad is None, grad or 0.0) for at, step, loss, grad in rows)


def unpack(packed: bytes) -> list[tuple]:
    return [(at, step, None if no_loss else loss, None if no_grad else grad) for at, step, no_loss, loss, no_grad, grad in ROW.iter_unpack(packed)]


class Monitor(StatefulProcessor):
    """A run's rows wait until the watermark has passed them, then they are judged by time and step.

    One timer a run: at the earliest row that waits, else at the run's end, ``idle`` after its last row, where its state goes.
    Each call of the state is a message to the JVM, so up to NEAR rows wait beside the verdict, with the timer: such a run
    costs one read and one write a batch. More rows wait in their spans, in a map, and are read a span at a time.
    """

    def __init__(self, patience: int, min_loss: float, max_grad: float, warm: int, idle: int, span: int = SPAN):
        self.limits, self.warm, self.idle, self.span = (patience, min_loss, max_grad), warm, idle, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.judged = handle.getValueState("judged", "best double, gained long, seen long, until long, losses array<double>, grads array<double>, near binary, spans array<long>, timer long")
        self.waiting = handle.getMapState("waiting", "span long", "rows binary")

    def state(self) -> tuple[list, list[tuple], list[int], int | None]:
        """What was judged, the rows that wait near it, the spans that wait in the map, and the timer."""
        *run, near, spans, timer = self.judged.get() or NEW
        return run, unpack(near), list(spans), timer

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        run, near, spans, timer = self.state()
        first = timer if near or spans else None  # with rows that wait, the timer is at the earliest
        for frame in rows:
            known = [[None if gone else x for x, gone in zip(frame[c].tolist(), frame[f"no_{c}"].tolist())] for c in ("loss", "grad_norm")]
            near += zip(frame["at"].tolist(), frame["step"].tolist(), *known)
            least = min(frame["at"].tolist())
            first = least if first is None else min(first, least)
            if spans or len(near) > NEAR:
                spans, near = self.put(near, spans), []
        yield from self.proceed(key, run, near, spans, first, timer, timerValues)

    def put(self, rows: list[tuple], spans: list[int]) -> list[int]:
        """Adds rows to their spans in the map; the spans that wait then, in order."""
        parts: dict[int, list[tuple]] = {}
        for row in rows:
            parts.setdefault(row[0] // self.span, []).append(row)
        for span, part in parts.items():
            kept = bytes(self.waiting.getValue((span,))[0]) if span in spans else b""
            self.waiting.updateValue((span,), (kept + pack(part),))
        return sorted({*spans, *parts})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        run, near, spans, timer = self.state()
        # Spark itself deletes the timer that has expired
        left = None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer
        yield from self.proceed(key, run, near, spans, timer if near or spans else None, left, timerValues)

    def judge(self, run: list, ready: list[tuple]) -> Iterator[tuple[int, int, str]]:
        """(step, steps since the best, alarm) of rows in order; ``run`` is brought up to them."""
        best, gained, seen, until, losses, grads = run
        for at, step, loss, grad in ready:
            seen, until = seen + 1, max(until, at)
            if loss is not None and loss == loss and (best is None or loss < best):
                best, gained = loss, seen
            losses, grads = [*losses, loss][-20:], [*grads, grad][-20:]
            if seen >= self.warm:
                yield from ((int(step), seen - gained, name) for name, hit in checks(losses, grads, seen - gained, *self.limits).items() if hit)
        run[:] = best, gained, seen, until, losses, grads

    def proceed(self, key: Any, run: list, near: list[tuple], spans: list[int], first: int | None, timer: int | None, timerValues: Any) -> Iterator[pd.DataFrame]:
        """Judges what the watermark has passed of the rows that wait, of which ``first`` is the earliest time, and sets the
        next timer in place of ``timer``."""
        now = timerValues.getCurrentWatermarkInMs()
        while first is not None and first <= now:
            held = near or unpack(self.waiting.getValue((spans[0],))[0])
            held.sort(key=lambda r: r[:2])
            passed = bisect_right(held, now, key=lambda r: r[0])
            out = [(int(key[0]), *alarm) for alarm in self.judge(run, held[:passed])]
            if out:
                yield pd.DataFrame(out, columns=["run_id", "step", "steps_since_best", "alarm"])
            left = held[passed:]
            first = left[0][0] if left else None
            if near:
                near = left
                break
            if left:
                self.waiting.updateValue((spans[0],), (pack(left),))
                break
            self.waiting.removeKey((spans.pop(0),))
            if spans:
                first = min(r[0] for r in unpack(self.waiting.getValue((spans[0],))[0]))
        if first is None and run[3] + self.idle <= now:
            due = None
            self.judged.clear()
        else:
            due = max(now + 1, run[3] + self.idle if first is None else first)
            self.judged.update((*run, pack(near), spans, due))
        if timer not in (None, due):
            self.handle.deleteTimer(timer)
        if due not in (None, timer):
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


def ordered_alarms(source: DataFrame, time: str, delay: str = "10 minutes", idle: str = "1 day", patience: int = 200, min_loss: float = 1e-6, max_grad: float = 10.0, warm: int = 50, span: int = SPAN) -> DataFrame:
    """(run_id, step, steps_since_best, alarm) of a stream of (run_id, step, loss, grad_norm) with an event time.

    Rows come in any order within ``delay`` and are judged by time, then step, as runs.stability judges a table; later ones
    are dropped by the watermark. A run is forgotten ``idle`` after its last row, so state is that of the runs under way: 20
    rows each, and the rows of the delay. Rows with a null run or time are left out. State lives in RocksDB, which this turns on.
    """
    source.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    gap = F.expr(f"interval {idle}")
    milliseconds = source.sparkSession.range(1).select(((F.timestamp_seconds(F.lit(0)) + gap).cast("double") * 1000).cast("long")).first()[0]
    rows = source.filter(F.col("run_id").isNotNull() & F.col(time).isNotNull()).withWatermark(time, delay)
    rows = rows.select(F.col("run_id").cast("long").alias("run_id"), F.col("step").cast("long").alias("step"), "loss", "grad_norm", F.col("loss").isNull().alias("no_loss"), F.col("grad_norm").isNull().alias("no_grad_norm"), F.unix_millis(F.col(time).cast("timestamp")).alias("at"), time)
    return rows.groupBy("run_id").transformWithStateInPandas(Monitor(patience, min_loss, max_grad, warm, int(milliseconds), span), OUTPUT, "append", "eventTime")
