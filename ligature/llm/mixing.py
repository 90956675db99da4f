"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Only DataFrame functions. Each source's words, in a random order of its documents, are a line cut into blocks
of equal size; a source that has to be repeated starts its line again in a new order. The tree deals the
sources' block quotas to the output shards: a node gives its left child as many blocks as that child's shards
hold, drawn without replacement, so that each shard's mix is a fair draw and all quotas stay exact. A shard
then draws so many blocks of each source's line, disjoint and permuted, and orders what it has by a local hash.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

SEED = 20240501
#: Words of a shard, blocks of a shard, and sources that one row of the tree may hold.
SHARD_WORDS, SHARD_BLOCKS, GROUP_SOURCES = 1 << 27, 256, 512
#: Primes below 2**31, above any number of blocks of a source.
PRIMES = [2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """In [0, 1), from a hash of the parts: the same in every run."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 48)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, target): ``share`` of all words dealt by weight, at most ``most`` times a
    source's size; what stands above is dealt again by weight, until none is above.

    That end has one level L with target = min(most * size, L * weight): sources fill in the order of
    size / weight, so L follows from running sums. One row per source, the only unpartitioned window here.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (float(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("place", F.row_number().over(by_fill))
    # the level is that of the first source in this order which it does not fill; of ties too, the first
    final = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("place", "level"))).over(every)
    return per.withColumn("final", final["level"]).select("source", "source_size", "n_docs", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def hypergeometric(marked: str, blocks: str, places: str, u: str) -> str:
    """SQL of how many of ``places`` places, filled without replacement from ``blocks`` blocks, get one of the ``marked``
    ones.

    By inversion from the mode: weights next to it follow from ratios, over 12 standard deviations and 8 on both sides
    (what is beyond is below the precision of a double), so a draw takes steps in proportion to the root of the counts.
    """

    def side(up: bool, result: str, goal: str = "0D") -> str:
        """The sum of the weights on one side of the mode, or n, the steps after which they exceed ``goal``."""
        far = "least(d.reach, least(d.marked, d.places) - d.mode)" if up else "least(d.reach, d.mode - greatest(0L, -d.rest))"
        k = "(d.mode + j)" if up else "(d.mode - j + 1)"
        rise, fall = f"(d.marked - {k} + 1) * (d.places - {k} + 1)", f"{k} * (d.rest + {k})"
        w = f"(x.w * ({rise}) / ({fall}))" if up else f"(x.w * ({fall}) / ({rise}))"
        step = f"named_struct('w', {w}, 'sum', x.sum + {w}, 'n', x.n + if(x.sum <= {goal}, 1L, 0L))"
        return f"aggregate(if({far} > 0, sequence(1L, {far}), cast(array() as array<bigint>)), named_struct('w', 1D, 'sum', 0D, 'n', 0L), (x, j) -> {step}, x -> x.{result})"

    spread = f"sqrt({places} / {blocks} * {marked} * (1 - {marked} / {blocks}) * ({blocks} - {places}) / greatest(1L, {blocks} - 1))"
    mode = f"cast(floor(({places} + 1) * ({marked} + 1) / ({blocks} + 2)) as bigint)"
    given = f"named_struct('mode', {mode}, 'reach', cast(ceil(12 * {spread}) as bigint) + 8, 'marked', {marked}, 'places', {places}, 'rest', {blocks} - {marked} - {places}, 'u', {u})"
    sums = f"transform(array(named_struct('above', {side(True, 'sum')}, 'below', {side(False, 'sum')})), e -> named_struct('above', e.above, 'x', d.u * (1 + e.above + e.below)))"
    find = f"case when f.x < 1 then d.mode when f.x < 1 + f.above then d.mode + {side(True, 'n', '(f.x - 1)')} else d.mode - {side(False, 'n', '(f.x - 1 - f.above)')} end"
    # through arrays of one, so that each value is made once
    return f"element_at(transform(array({given}), d -> element_at(transform({sums}, f -> {find}), 1)), 1)"


def split_groups(quotas: DataFrame, places: DataFrame, depth: int, seed: int) -> DataFrame:
    """(group, key, shard, n): ``quotas`` (group, key, n) dealt to ``places`` (group, places of each of 2**depth shards).

    One row per group and node of the tree. The left child's places are its shards'; source by source, a hypergeometric
    draw says how many of them the source fills, which is the multivariate draw, and the right child has the rest.
    """
    listed = quotas.filter("n > 0").groupBy("group").agg(F.sort_array(F.collect_list(F.struct("key", F.col("n").cast("long").alias("n")))).alias("q"))
    nodes = listed.join(places, "group").select("group", F.lit(0).cast("long").alias("node"), "q", "places")
    total = "aggregate({}, 0L, (a, y) -> a + y)".format
    for level in range(depth):
        half = 1 << (depth - level - 1)
        nodes = nodes.selectExpr("*", f"{total('places')} as blocks", f"{total(f'slice(places, 1, {half})')} as room")
        u = f"pmod(xxhash64({seed}L, {level}, group, node, x.key), {1 << 48}L) / {float(1 << 48)}D"
        left = hypergeometric("x.n", "acc.blocks", "acc.room", u)
        grown = "named_struct('blocks', acc.blocks - x.n, 'room', acc.room - got, 'out', concat(acc.out, array(named_struct('key', x.key, 'n', x.n, 'left', got))))"
        start = "named_struct('blocks', blocks, 'room', room, 'out', cast(array() as array<struct<key:bigint,n:bigint,left:bigint>>))"
        drawn = f"aggregate(q, {start}, (acc, x) -> element_at(transform(array({left}), got -> {grown}), 1), acc -> acc.out)"
        nodes = nodes.selectExpr("group", "node", "places", f"{drawn} as out")
        child = "filter(transform(out, x -> named_struct('key', x.key, 'n', {})), x -> x.n > 0)".format
        children = [f"named_struct('node', node * 2 + {r}, 'q', {child('x.n - x.left' if r else 'x.left')}, 'places', slice(places, {1 + r * half}, {half}))" for r in (0, 1)]
        nodes = nodes.selectExpr("group", f"inline(array({', '.join(children)}))")
        nodes = materialise(nodes.filter(F.size("q") > 0), "mix-nodes")  # 2**level rows a group at most
    return nodes.select("group", F.col("node").alias("shard"), F.inline("q")).select("group", "key", "shard", "n")


def split_quotas(quotas: DataFrame, depth: int, seed: int = SEED, group_sources: int = GROUP_SOURCES) -> DataFrame:
    """(source_key, shard, first, n): ``quotas`` (source_key, n_blocks) dealt to 2**depth shards whose totals differ
    by one at most, by a multivariate hypergeometric draw.

    ``first`` is the number of blocks of that source in the shards before. More than ``group_sources`` sources are
    dealt in groups: the groups' totals first, then each group's places among its sources, so no row holds all sources.
    """
    own = quotas.filter("n_blocks > 0").select(F.col("source_key").alias("key"), F.col("n_blocks").cast("long").alias("n"))
    count, total = own.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = lambda i: F.floor(i * F.lit(total) / F.lit(1 << depth)).cast("long")
    even = F.transform(F.sequence(F.lit(0).cast("long"), F.lit((1 << depth) - 1).cast("long")), lambda i: ends(i + 1) - ends(i))
    places = quotas.sparkSession.range(1).select(F.lit(0).cast("long").alias("group"), even.alias("places"))
    levels = [1]  # groups of each level, from the top
    while count > levels[-1] * group_sources:
        levels.append(levels[-1] * group_sources)
    group = lambda n: F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(n)).cast("long")  # noqa: E731  a group's number modulo a smaller level is its parent's
    for upper, lower in zip(levels, levels[1:]):
        per = own.groupBy(group(lower).alias("key")).agg(F.sum("n").alias("n"))
        dealt = split_groups(per.select(F.pmod("key", F.lit(upper)).alias("group"), "key", "n"), places, depth, seed)
        counts = dealt.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("m"))
        shards = F.sequence(F.lit(0).cast("long"), F.lit((1 << depth) - 1).cast("long"))
        places = materialise(counts.select(F.col("key").alias("group"), F.transform(shards, lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("places")), "mix-places")
    dealt = split_groups(own.select(group(levels[-1]).alias("group"), "key", "n"), places, depth, seed)
    before = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select(F.col("key").alias("source_key"), "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n")


def drawn_blocks(quotas: DataFrame, depth: int, seed: int = SEED) -> DataFrame:
    """(source_key, block, shard): each shard draws as many blocks of a source as the tree says, the next ones in an
    order that permutes them: block = rank * prime + shift modulo their number, for a prime above that number."""
    prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(F.xxhash64(F.lit(seed), "source_key"), F.lit(len(PRIMES))) + 1).cast("int"))
    dealt = split_quotas(quotas, depth, seed).join(quotas.select("source_key", "n_blocks"), "source_key")
    ranks = dealt.withColumn("rank", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    return ranks.select("source_key", F.pmod(F.col("rank") * prime + F.pmod(F.xxhash64(F.lit(seed), F.lit("shift"), "source_key"), F.col("n_blocks")), F.col("n_blocks")).alias("block"), "shard")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (row, doc_id, ...) with ``repeat``: how many rows of the same doc_id come before. ``row`` has the number
    of the partition in its upper bits, so a doc_id's rows are numbered in each partition and the counts joined."""
    rows = rows.withColumn("part", F.shiftright("row", 33))
    inside = Window.partitionBy("doc_id", "part").orderBy("row")
    before = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("doc_id", "part").agg(F.count("*").alias("n")).withColumn("offset", F.sum("n").over(before)).filter("offset > 0")
    offsets = offsets.select(F.col("doc_id").alias("same_id"), F.col("part").alias("same_part"), "offset")
    found = rows.withColumn("inside", F.row_number().over(inside) - 1).join(offsets, F.col("doc_id").eqNullSafe(F.col("same_id")) & (F.col("part") == F.col("same_part")), "left")
    return found.withColumn("repeat", F.col("inside") + F.coalesce("offset", F.lit(0))).drop("part", "inside", "same_id", "same_part", "offset")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, blocks: int | None = None, depth: int | None = None, bucket_docs: int = 4096, whole_documents: bool = False, one_row: bool = False, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Deal ``docs`` (doc_id, source, text) to 2**depth shards.

    Returns the documents (row, doc_id, source, size, source_size, target) and the pieces of the mix: (row, doc_id,
    copy, shard, block, first_word, words, local_order), where row is a key of the input's rows, copy counts the passes over a source, first_word is
    the place in the document from which ``words`` words are taken, and rows sorted by (shard, local_order)
    are the shuffled shard. Only blocks that the tree deals to a shard are taken. There are eight shards at least, and
    so many that one has SHARD_WORDS words at most, of SHARD_BLOCKS ``blocks`` each. With ``whole_documents`` a document's copy goes where its middle word goes, undivided.

    Rows that repeat a doc_id (with the same text) have pieces each of its own; with ``one_row``, one row of each doc_id
    is taken and the others are left out. Null text has size 0; documents without words and empty sources get no pieces; the null
    source is a source of its own, the last. Further columns of ``docs`` are left out.
    """
    source_key = F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", source_key.alias("source_key"), word_count(F.col("text")).alias("size"))
    sizes = numbered(materialise(rows, "mix-rows"))
    sizes = materialise(sizes.filter("repeat = 0") if one_row else sizes, "mix-sizes")
    aims = materialise(targets(sizes, weights, share, most).withColumn("source_key", source_key), "mix-targets")
    total = aims.agg(F.sum("target")).first()[0] or 0.0
    depth = max(3, ceil(log2(max(1.0, total / SHARD_WORDS)))) if depth is None else depth
    block_words = max(1, ceil(total / (SHARD_BLOCKS << depth if blocks is None else blocks)))
    aim = aims.select("source_key", "n_docs", "source_size", "target")  # a row a source: Spark broadcasts it if it is small
    # a random order of each source: hash buckets of bounded size, then the hash within; running sums in two steps
    placed = sizes.filter("size > 0").join(aim, "source_key").select("row", "doc_id", "repeat", "source_key", "size", "source_size", "target", "n_docs", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("copy")).filter(F.col("copy") * F.col("source_size") < F.col("target"))
    own = F.nullif(F.col("repeat"), F.lit(0))  # null adds nothing to a hash
    placed = placed.withColumn("order", F.xxhash64(F.lit(seed), "copy", "doc_id", own))
    placed = placed.withColumn("bucket", F.pmod(F.col("order"), F.ceil(F.col("n_docs") / bucket_docs)).cast("long"))
    in_bucket = Window.partitionBy("source_key", "copy", "bucket").orderBy("order", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = placed.groupBy("source_key", "copy", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_key").orderBy("copy", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("source_key", "copy", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(in_bucket), F.lit(0))).join(offsets, ["source_key", "copy", "bucket"])
    placed = placed.withColumn("start", F.col("offset") + F.col("inside")).withColumn("line", F.round("target").cast("long"))
    quota = aims.select("source_key", F.ceil(F.round("target") / block_words).cast("long").alias("n_blocks"))
    shards = materialise(drawn_blocks(quota, depth, seed), "mix-shards")
    if whole_documents:
        middle = F.col("start") + F.floor(F.col("size") / 2)
        pieces = placed.filter(middle < F.col("line")).select("row", "doc_id", "repeat", "source_key", "copy", F.floor(middle / F.lit(block_words)).alias("block"), F.lit(0).cast("long").alias("first_word"), F.col("size").alias("words"))
    else:
        end = F.least(F.col("start") + F.col("size"), F.col("line"))
        cut = placed.withColumn("end", end).filter(F.col("start") < F.col("end"))
        cut = cut.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.lit(block_words)), F.floor((F.col("end") - 1) / F.lit(block_words)))))
        low, high = F.greatest(F.col("start"), F.col("block") * F.lit(block_words)), F.least(F.col("end"), (F.col("block") + 1) * F.lit(block_words))
        pieces = cut.select("row", "doc_id", "repeat", "source_key", "copy", "block", (low - F.col("start")).alias("first_word"), (high - low).alias("words"))
    pieces = pieces.join(shards, ["source_key", "block"])
    pieces = pieces.withColumn("local_order", F.xxhash64(F.lit(seed), "shard", "doc_id", "copy", "first_word", own)).drop("source_key", "repeat")
    per_doc = sizes.join(aim, "source_key").select("row", "doc_id", "source", "size", "source_size", "target")
    return per_doc, pieces


def write_mix(docs: DataFrame, pieces: DataFrame, path: str) -> None:
    """One folder a shard, its rows in their local order, the words of each piece as text."""
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    text = F.array_join(F.slice(words, (F.col("first_word") + 1).cast("int"), F.col("words").cast("int")), " ")
    out = pieces.join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").select("shard", "local_order", "doc_id", "copy", "first_word", text.alias("text"))
    out.repartitionByRange("shard", "local_order").sortWithinPartitions("shard", "local_order").write.partitionBy("shard").parquet(path)


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards) for each row: the words that the mix takes of it, and in
    which shards, as (shard, words) in order."""
    per_doc, pieces = mix_sources(docs)
    by_shard = pieces.groupBy("row", "shard").agg(F.sum("words").alias("words"))
    sums = by_shard.groupBy("row").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("shards"))
    out = per_doc.join(sums, "row", "left").select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "shards")
    return out.withColumn("shards", F.coalesce("shards", F.array().cast("array<struct<shard:bigint,words:bigint>>")))
