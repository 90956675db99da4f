"""Candidate distributions: blocking, penalties, top-k and nucleus, grammar state, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import is_atom_class, token_class


def block_tokens(df: DataFrame, blocked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Candidates without the blocked ones: (tok), or (q, tok) for those of one query."""
    return df.join(blocked, keys or ["tok"], "left_anti")


def blocked_next_tokens(seqs: DataFrame, n: int = 3) -> DataFrame:
    """(q, tok) that would complete a run of ``n`` tokens which the sequence has, from (q, pos, tok) rows."""
    w = Window.partitionBy("q").orderBy("pos")
    runs = seqs.select("q", "pos", F.count("*").over(Window.partitionBy("q")).alias("size"), *[F.lead("tok", k).over(w).alias(f"t{k}") for k in range(n)], F.row_number().over(w).alias("rn"))
    heads = [f"t{k}" for k in range(n - 1)]
    tail = runs.filter(F.col("rn") == F.col("size") - n + 2).select("q", *heads)
    return runs.filter(F.col("rn") <= F.col("size") - n + 1).join(tail, ["q", *heads], "left_semi").select("q", F.col(f"t{n - 1}").alias("tok")).distinct()


def top_k(df: DataFrame, k: int, ties: bool = True) -> DataFrame:
    """The k highest logits of each query; with ``ties`` all that equal the k-th stay."""
    if k <= 0:
        return df
    w = Window.partitionBy("q").orderBy(F.desc("logit"))
    rank = F.rank().over(w) if ties else F.row_number().over(w.orderBy(F.desc("logit"), "tok"))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def top_p(df: DataFrame, p: float) -> DataFrame:
    """By falling logit, up to the token with which the probability exceeds p; the first always stays."""
    if p >= 1:
        return df
    every = Window.partitionBy("q")
    down = every.orderBy(F.desc("logit"), "tok").rowsBetween(Window.unboundedPreceding, -1)
    weighed = df.withColumn("_w", F.exp(F.col("logit") - F.max("logit").over(every)))
    share = weighed.withColumn("_before", F.coalesce(F.sum("_w").over(down), F.lit(0.0)) / F.sum("_w").over(every))
    first = F.row_number().over(every.orderBy(F.desc("logit"), "tok")) == 1
    return share.withColumn("_first", first).filter(F.col("_first") | (F.col("_before") <= p)).drop("_w", "_before", "_first")


def repetition_penalty(df: DataFrame, seen: DataFrame, penalty: float, sign_aware: bool = False) -> DataFrame:
    """Divides the logit of tokens that the query has already, once, negative logits too; ``sign_aware``
    multiplies those. 1 or less changes nothing."""
    if penalty <= 1:
        return df
    marked = df.join(seen.select("q", "tok").distinct().withColumn("_seen", F.lit(True)), ["q", "tok"], "left")
    lower = F.when((F.col("logit") < 0) & F.lit(sign_aware), F.col("logit") * penalty).otherwise(F.col("logit") / penalty)
    return marked.withColumn("logit", F.when(F.col("_seen"), lower).otherwise(F.col("logit"))).drop("_seen")


def decode_filter(df: DataFrame, blocked: DataFrame, seen: DataFrame, ngram: DataFrame, temperature: float = 1.0, penalty: float = 1.2, k: int = 50, p: float = 0.95) -> DataFrame:
    """The sampling chain: temperature, masks, repetition, run blocking, top-k, nucleus."""
    out = block_tokens(df.withColumn("logit", F.col("logit") / temperature), blocked)
    out = block_tokens(repetition_penalty(out, seen, penalty), ngram, ["q", "tok"])
    return top_p(top_k(out, k), p)


def prefix_state(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """For each token (key, pos, token, class) the state before it: paren balance, open rings, aromatic rings,
    last class that counts, tokens since the last atom.

    Windows over the sequence, and over the sequence's ring numbers: the odd places of a number open it, the
    even ones close it and take the flag of the place before.
    """
    each = df.select(key, F.posexplode(tokens).alias("pos", "token"))
    each = each.withColumn("class", token_class(F.col("token")))
    at = Window.partitionBy(key).orderBy("pos")
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    classed = F.when(is_atom_class(F.col("class")) | F.col("class").isin("bond", "stereo"), F.col("class"))
    each = each.withColumns(
        {
            "paren_balance": F.coalesce(F.sum(F.when(F.col("class") == "paren_open", 1).when(F.col("class") == "paren_close", -1).otherwise(0)).over(before), F.lit(0)),
            "last_class": F.coalesce(F.last(classed, ignorenulls=True).over(before), F.lit("other")),
            "last_token": F.lag("token").over(at),
            "tokens_since_atom": (F.col("pos") - F.coalesce(F.max(F.when(is_atom_class(F.col("class")), F.col("pos"))).over(before), F.lit(-1)) - 1).cast("long"),
        }
    )
    ring = F.when(F.col("class") == "ring_digit", F.regexp_replace("token", "%", "").cast("int"))
    of_ring = Window.partitionBy(key, "ring").orderBy("pos")
    each = each.withColumn("ring", ring)
    each = each.withColumn("_nth", F.when(F.col("ring").isNotNull(), F.row_number().over(of_ring)))
    opens = F.col("_nth") % 2 == 1
    own = (F.col("last_class") == "aromatic_atom").cast("int")
    each = each.withColumn("_aromatic", F.when(opens, own)).withColumn("_aromatic", F.when(opens, own).otherwise(F.lag("_aromatic").over(of_ring)))
    change = F.when(F.col("ring").isNull(), 0).when(opens, 1).otherwise(-1)
    each = each.withColumn("_change", change)
    return each.withColumns(
        {
            "open_rings": F.coalesce(F.sum("_change").over(before), F.lit(0)),
            "aromatic_depth": F.coalesce(F.sum(F.col("_change") * F.coalesce("_aromatic", F.lit(0))).over(before), F.lit(0)),
        }
    ).drop("_nth", "_aromatic", "_change", "ring")


def breach(strict: bool = False) -> Column:
    """Rule that the token breaks in the state before it, else null; the end of a sequence is always allowed.

    ``last_class`` skips ring digits and parentheses, so rules about what follows a parenthesis only apply with
    ``strict``, which asks the last token itself.
    """
    cls, last = F.col("class"), F.col("last_class")
    extra = F.when(F.lit(strict) & (F.col("last_token") == "(") & (cls == "bond"), "bond_after_paren").when(F.lit(strict) & F.col("last_token").isin("(", ")") & (cls == "stereo"), "stereo_after_paren")
    return (
        F.when((F.col("pos") == 0) & ~is_atom_class(cls), "start")
        .when((cls == "ring_digit") & (F.col("token") == F.col("last_token")), "same_ring_twice")
        .when((cls == "stereo") & (last == "stereo"), "stereo_after_stereo")
        .when((cls == "stereo") & (F.col("tokens_since_atom") > 2), "stereo_far_from_atom")
        .when((cls == "bond") & (last == "bond"), "bond_after_bond")
        .when((cls == "paren_close") & (F.col("paren_balance") <= 0), "close_without_open")
        .when((cls == "paren_close") & (F.col("last_token") == "("), "empty_paren")
        .otherwise(extra)
    )


def grammar_audit(df: DataFrame, key: str, tokens: str, strict: bool = False) -> DataFrame:
    """(key, pos, token, rule): the first breach of each sequence that has one."""
    broken = prefix_state(df, key, tokens).withColumn("rule", breach(strict)).filter("rule is not null")
    return broken.groupBy(key).agg(F.min_by(F.struct("pos", "token", "rule"), "pos").alias("b")).select(key, "b.*")


def light_constraints(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, pos, token, blocked, factor): the small rule set for each token that stands there; new ring numbers
    count half while three rings are open."""
    state = prefix_state(df, key, tokens)
    of_ring = Window.partitionBy(key, "token").orderBy("pos")
    opens = (F.col("class") == "ring_digit") & (F.row_number().over(of_ring) % 2 == 1)
    mark = F.col("class").isin("bond", "stereo")
    after = F.coalesce(F.col("last_token").isin("=", "#", "-", "/", "\\"), F.lit(False))
    blocked = ((F.col("class") == "paren_close") & (F.col("paren_balance") <= 0)) | (mark & after)
    return state.select(key, "pos", "token", blocked.alias("blocked"), F.when(opens & F.col("token").rlike("^[0-9]$") & (F.col("open_rings") >= 3), 0.5).otherwise(1.0).alias("factor"))


def token_accuracy(df: DataFrame, pad: int = 0) -> DataFrame:
    """Accuracy over all, real and padding labels, from (pred, label)."""
    hit = (F.col("pred") == F.col("label")).cast("double")
    real = F.col("label") != pad
    return df.agg(F.count("*").alias("total"), F.count_if(real).alias("real"), F.avg(hit).alias("accuracy"), F.avg(F.when(real, hit)).alias("real_accuracy"), F.avg(F.when(~real, hit)).alias("pad_accuracy"))


def log_probabilities(df: DataFrame, clamp: float | None = None) -> DataFrame:
    """Adds logp, the log softmax of each query's logits, clamped first if asked."""
    logit = F.col("logit") if clamp is None else F.greatest(F.lit(-clamp), F.least(F.lit(clamp), F.col("logit")))
    every = Window.partitionBy("q")
    top = df.withColumn("_x", logit).withColumn("_m", F.max("_x").over(every))
    return top.withColumn("logp", F.col("_x") - F.col("_m") - F.log(F.sum(F.exp(F.col("_x") - F.col("_m"))).over(every))).drop("_x", "_m")


def smoothed_ce(df: DataFrame, target: Column, eps: float = 0.1, clamp: float = 10.0, ignore: int | None = None) -> DataFrame:
    """(n, loss, perplexity): ``target`` marks each query's label among its candidates; queries whose label is
    ``ignore`` don't count."""
    each = log_probabilities(df, clamp).withColumn("_t", target)
    by = each.groupBy("q").agg(F.max(F.when(F.col("_t"), -F.col("logp"))).alias("nll"), F.avg(-F.col("logp")).alias("flat"), F.max(F.when(F.col("_t"), F.col("tok"))).alias("label"))
    if ignore is not None:
        by = by.filter(F.col("label") != ignore)
    loss = F.avg((1 - eps) * F.col("nll") + eps * F.col("flat"))
    return by.agg(F.count("*").alias("n"), loss.alias("loss"), F.exp(loss).alias("perplexity"))


def mean_entropy(df: DataFrame) -> DataFrame:
    """Mean over queries of -sum p log(p + 1e-8)."""
    each = log_probabilities(df).withColumn("_p", F.exp("logp"))
    by = each.groupBy("q").agg((-F.sum(F.col("_p") * F.log(F.col("_p") + 1e-8))).alias("h"))
    return by.agg(F.count("*").alias("n"), F.avg("h").alias("mean_entropy"))
