"""Streams: resumable ingest, de-duplication, throughput, live alarms. All run unchanged on batch frames too."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..functions.tokens import encode, tokens
from ..operators.clean import with_clean_verdict


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(smiles) of text files as they arrive."""
    return spark.readStream.text(folder).select(F.trim("value").alias("smiles"))


def ingest(source: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is new since the last run and stops; the checkpoint remembers the files that are done."""
    return source.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def unique_strings(source: DataFrame, column: str = "smiles", time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each string once over all batches; with an event time, state older than ``delay`` is dropped."""
    if time is None:
        return source.dropDuplicates([column])
    return source.withWatermark(time, delay).dropDuplicatesWithinWatermark([column])


def throughput(source: DataFrame, time: str, width: str, delay: str | None = None) -> DataFrame:
    """(start, n): rows of each interval; late rows beyond ``delay`` are dropped on streams."""
    timed = source.withWatermark(time, delay) if delay else source
    return timed.groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def cumulative(counts: DataFrame) -> DataFrame:
    """Adds the running total over intervals, of which there is a row each."""
    return counts.withColumn("cumulative", F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)))


def clean_and_tokenise(source: DataFrame, vocabulary: list[str], column: str = "smiles") -> DataFrame:
    """Passing strings with their ids; stateless, so the same for streams and tables."""
    judged = with_clean_verdict(source, column).filter("is_valid").drop("is_valid", "reason")
    return judged.withColumn("ids", encode(tokens(F.col(column)), vocabulary)).filter("ids is not null")


def alarms(source: DataFrame, patience: int = 200, min_loss: float = 1e-6, max_grad: float = 10.0, warm: int = 50) -> DataFrame:
    """(run_id, step, steps_since_best, alarm) of a stream of (run_id, step, loss, grad_norm).

    The state of a run is its best loss, counters, and its last 20 rows at most.
    """

    def update(key: tuple, frames, state: GroupState):
        best, since, seen, losses, grads = state.get if state.exists else (float("inf"), 0, 0, [], [])
        losses, grads, out = list(losses), list(grads), []
        rows = pd.concat(list(frames)).sort_values("step")
        for step, loss, grad in zip(rows["step"], rows["loss"], rows["grad_norm"]):
            seen += 1
            best, since = (loss, 0) if loss < best else (best, since + 1)
            losses, grads = [*losses, float(loss)][-20:], [*grads, float(grad)][-20:]
            if seen < warm:
                continue
            checks = {
                "numerical_instability": all(x < min_loss for x in losses[-10:]),
                "exploding_gradients": any(x > max_grad for x in grads[-10:]),
                "non_finite_loss": any(x != x or abs(x) == float("inf") for x in losses[-5:]),
                "complete_stagnation": since > patience and len({round(x, 8) for x in losses}) <= 2,
            }
            out += [(key[0], int(step), since, name) for name, hit in checks.items() if hit]
        state.update((float(best), since, seen, losses, grads))
        yield pd.DataFrame(out, columns=["run_id", "step", "steps_since_best", "alarm"])

    kept = "best double, since long, seen long, losses array<double>, grads array<double>"
    return source.groupBy("run_id").applyInPandasWithState(update, "run_id long, step long, steps_since_best long, alarm string", kept, "append", "NoTimeout")


def for_each_batch(source: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
