"""Run metrics: epoch means, stability, best so far, advantages, schedule audits."""

from __future__ import annotations

from math import log10

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import rl_weight, tf_prob
from .scan import LONGEST, by_length, segments

# Keys that each metric record has, and names of the added ones.
FIXED_KEYS = (
    "epoch phase timestamp train_loss train_reconstruction_loss train_perplexity train_accuracy train_entropy "
    "val_loss val_reconstruction_loss val_perplexity val_accuracy val_entropy learning_rate"
).split()
#: Steps that a window sums at once.
BLOCK = 64
EXTRA_KEYS = ["validity_rate", "avg_qed", "avg_sa", "ppo_weight", "tf_prob"]


def epoch_metrics(df: DataFrame, keys: list[str], values: list[str], rl: Column) -> DataFrame:
    """Means by key; the means named rl_ are over the batches of ``rl``, each counted once."""
    means = [F.avg(v).alias(f"mean_{v}") for v in values] + [F.avg(F.when(rl, F.col(v))).alias(f"rl_mean_{v}") for v in values]
    return df.groupBy(*keys).agg(F.count("*").alias("batches"), F.count_if(rl).alias("rl_batches"), *means)


def stability(df: DataFrame, run: str = "run_id", step: str = "step", patience: int = 200, min_loss: float = 1e-6, max_grad: float = 10.0, warm: int = 50, longest: int = LONGEST) -> DataFrame:
    """Adds steps_since_best, four alarms, trend, grad_stability and is_unstable to (run, step, loss, grad_norm).

    Nothing is said before step ``warm``. Frames of 5, 10 and 20 rows; only the running best looks back further. Runs
    of more than ``longest`` rows go in segments that get the best so far and the 19 rows before them. A loss that is null or NaN is no gain.
    """
    limits = (patience, min_loss, max_grad, warm)
    short, long = by_length(df, run, longest)
    numbered = short.withColumn("_n", F.row_number().over(Window.partitionBy(run).orderBy(step)).cast("long"))
    gain = F.when(~F.isnan("loss") & F.col("loss").isNotNull(), F.struct(F.col("loss").alias("value"), F.col("_n").alias("n")))
    out = _judged(numbered.withColumn("_best", gain), [run], *limits).drop("_n", "_best")
    if long is None:
        return out
    cut = _judged(segments(long, run, [step], halo=19, least="loss"), [run, "_seg"], *limits)
    return out.unionByName(cut.filter("_own").select(*out.columns))


def _judged(rows: DataFrame, keys: list[str], patience: int, min_loss: float, max_grad: float, warm: int) -> DataFrame:
    """The verdicts of rows with their number _n and _best, by windows over ``keys``."""
    at = Window.partitionBy(*keys).orderBy("_n")
    last = lambda n: at.rowsBetween(-(n - 1), 0)
    finite = ~F.isnan("loss") & (F.abs("loss") != float("inf"))
    # the first row of those with the least loss so far is where the loss fell last
    gained = F.min("_best").over(at.rowsBetween(Window.unboundedPreceding, 0))["n"]
    rows = rows.withColumn("steps_since_best", (F.col("_n") - F.coalesce(gained, F.lit(0))).cast("long"))
    warmed = F.col("_n") >= warm
    low = F.min((F.col("loss") < min_loss).cast("int")).over(last(10)) == 1
    steep = F.max((F.col("grad_norm") > max_grad).cast("int")).over(last(10)) == 1
    broken = F.max((~finite).cast("int")).over(last(5)) == 1
    flat = (F.col("steps_since_best") > patience) & (F.size(F.collect_set(F.round("loss", 8)).over(last(20))) <= 2)
    early, late = F.avg("loss").over(at.rowsBetween(-19, -10)), F.avg("loss").over(last(10))
    trend = F.when(F.col("_n") < 20, "insufficient_data").when(late < early * 0.95, "improving").when(late > early * 1.05, "degrading").otherwise("stable")
    spread = F.stddev_samp("grad_norm").over(last(20)) / (F.avg("grad_norm").over(last(20)) + 1e-8)
    grad = F.when(F.col("_n") < 20, "insufficient_data").when(spread > 2.0, "unstable").otherwise("stable")
    alarms = {"numerical_instability": low, "exploding_gradients": steep, "non_finite_loss": broken, "complete_stagnation": flat}
    out = rows.withColumns({k: F.coalesce(warmed & v, F.lit(False)) for k, v in alarms.items()} | {"trend": F.when(warmed, trend), "grad_stability": F.when(warmed, grad)})
    return out.withColumn("is_unstable", F.col("numerical_instability") | F.col("exploding_gradients") | F.col("non_finite_loss") | F.col("complete_stagnation"))


def decayed_sums(df: DataFrame, key: str, at: str, value: str, decay: float, levels: int = 2) -> DataFrame:
    """Adds ``sum``: value + decay * (the sum of the row before), in the order of ``at`` (0, 1, 2, ... by key).

    Within blocks of BLOCK rows by a window; the blocks' last sums are rows of the same kind, BLOCK times fewer, and
    after ``levels`` of them an array is walked. So no row holds a whole key, and no step copies what came before.
    """
    if decay < 1e-4:  # what is more than a few rows back is below 1e-40 of its value
        back = Window.partitionBy(key).orderBy(at)
        few = int(-40 / log10(decay)) + 1 if decay > 0 else 0
        return df.withColumn("sum", sum((F.coalesce(F.lag(value, k).over(back), F.lit(0.0)) * decay**k for k in range(1, few + 1)), F.col(value)))
    own = f"_key{levels}"
    place = F.pmod(F.col(at), F.lit(BLOCK))
    rows = df.withColumn("_block", F.floor(F.col(at) / BLOCK)).withColumn("_place", place)
    inside = Window.partitionBy(key, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.sum(F.col(value) * F.pow(F.lit(decay), -F.col("_place"))).over(inside) * F.pow(F.lit(decay), F.col("_place")))
    ends = rows.groupBy(F.col(key).alias(own), F.col("_block").alias("_at")).agg(F.max_by("_own", "_place").alias("_end"))
    if levels:
        ends = decayed_sums(ends, own, "_at", "_end", decay**BLOCK, levels - 1)
    else:
        walk = lambda acc, x: F.concat(acc, F.array(x["_end"] + decay**BLOCK * F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0))))
        listed = ends.groupBy(own).agg(F.array_sort(F.collect_list(F.struct("_at", "_end"))).alias("s"))
        walked = F.aggregate("s", F.array().cast("array<double>"), walk)
        ends = listed.select(own, F.posexplode(walked).alias("_at", "sum"))
    carry = ends.select(own, (F.col("_at") + 1).alias("_after"), F.col("sum").alias("_carry"))
    joined = rows.join(carry, (F.col(key) == F.col(own)) & (F.col("_block") == F.col("_after")), "left")
    return joined.select(*df.columns, (F.col("_own") + F.pow(F.lit(decay), F.col("_place") + 1) * F.coalesce("_carry", F.lit(0.0))).alias("sum"))


def gae(df: DataFrame, gamma: float = 0.99, lam: float = 0.95, longest: int = LONGEST) -> DataFrame:
    """(seq_id, step, advantage, returns, normalised) from (seq_id, step, value, reward), backwards from each
    sequence's last step; the normalisation takes one row of totals. Sequences above ``longest`` are numbered in segments."""
    df = df.select("seq_id", "step", "value", "reward")
    ahead = lambda w: F.coalesce(F.lag("value").over(w), F.lit(0.0)).alias("_next")
    short, long = by_length(df, "seq_id", longest)
    back = Window.partitionBy("seq_id").orderBy(F.desc("step"))
    rows = short.select(*df.columns, (F.row_number().over(back) - 1).cast("long").alias("_n"), ahead(back))
    if long is not None:
        cut = segments(long, "seq_id", [F.desc("step")], halo=1)
        cut = cut.withColumn("_next", ahead(Window.partitionBy("seq_id", "_seg").orderBy("_n"))).filter("_own")
        rows = rows.unionByName(cut.withColumn("_n", F.col("_n") - 1).select(*rows.columns))
    rows = rows.withColumn("_delta", F.col("reward") + gamma * F.col("_next") - F.col("value"))
    rows = decayed_sums(rows, "seq_id", "_n", "_delta", gamma * lam)
    rows = rows.select("seq_id", F.col("step").cast("int").alias("step"), F.col("sum").alias("advantage"), (F.col("sum") + F.col("value")).alias("returns"))
    totals = rows.agg(F.avg("advantage").alias("_m"), F.stddev_samp("advantage").alias("_s"))
    return rows.crossJoin(F.broadcast(totals)).withColumn("normalised", (F.col("advantage") - F.col("_m")) / (F.col("_s") + 1e-8)).drop("_m", "_s")  # one row


def best_so_far(df: DataFrame, run: str, step: str, loss: str, longest: int = LONGEST) -> DataFrame:
    """Adds is_best (strictly lower than all before; NaN never is) and best_loss; runs above ``longest`` go in segments."""

    def marked(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        least = F.min("_best").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        real = F.when(~F.isnan(loss), F.col(loss))
        return rows.withColumn("_least", least).withColumns({"is_best": real.isNotNull() & (F.col("_least").isNull() | (real < F.col("_least"))), "best_loss": F.least("_least", real)}).drop("_least")

    short, long = by_length(df, run, longest)
    out = marked(short.withColumn("_best", F.when(~F.isnan(loss), F.col(loss))), [run], step).drop("_best")
    if long is None:
        return out
    cut = segments(long, run, [step], least=loss).withColumn("_best", F.col("_best.value"))
    return out.unionByName(marked(cut, [run, "_seg"], "_n").filter("_own").select(*out.columns))


def latest(df: DataFrame, run: str, step: str) -> DataFrame:
    rest = [c for c in df.columns if c != run]
    return df.groupBy(run).agg(F.max_by(F.struct(*rest), step).alias("_r")).select(run, "_r.*")


def schedule_audit(df: DataFrame, epoch: Column, logged_tf: Column, logged_rl: Column, total: int, kind: str = "inverse_sigmoid", start: int = 2, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose logged schedule values aren't those of the formulas, with both values."""
    tf, rl = tf_prob(kind, epoch, total), rl_weight(epoch, start)
    out = df.withColumns({"tf_expected": tf, "tf_logged": logged_tf, "rl_expected": rl, "rl_logged": logged_rl})
    return out.filter((F.abs(F.col("tf_expected") - F.col("tf_logged")) > tolerance) | (F.abs(F.col("rl_expected") - F.col("rl_logged")) > tolerance))


def metric_record(fixed: dict[str, Column], extra: Column) -> Column:
    """JSON of the fixed keys, in their order and null where not given, and of those entries of the map ``extra`` that
    belong in a record, prefixed. Numbers stay numbers; other names than the fixed ones are an error."""
    if unknown := set(fixed) - set(FIXED_KEYS):
        raise ValueError(f"no fixed keys of a record: {sorted(unknown)}")
    whole = F.to_json(F.struct(*[fixed.get(k, F.lit(None).cast("string")).alias(k) for k in FIXED_KEYS]), {"ignoreNullFields": "false"})
    wanted = F.map_filter(extra, lambda k, v: k.startswith("ppo_") | k.isin(EXTRA_KEYS))
    more = F.to_json(F.map_from_entries(F.transform(F.map_entries(wanted), lambda e: F.struct(F.concat(F.lit("train_"), e["key"]), e["value"]))), {"ignoreNullFields": "false"})
    return F.concat(F.substr(whole, F.lit(1), F.length(whole) - 1), F.when(F.size(wanted) > 0, F.concat(F.lit(","), F.substr(more, F.lit(2)))).otherwise(F.lit("}")))
