"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with the same set of word shingles are one class of copies, joined by one row each. Between different
sets, MinHash bands propose pairs; a pair's MinHash values are compared a few at a time, and it is dropped as
soon as the posterior probability that its similarity reaches the threshold falls below the tolerance. What
survives is verified exactly on the shingles.

No pair ever becomes a row, and a large group is not compared pair by pair where its middle tells enough. In a bucket
all members are compared with one of them first. Those that survive hang together; only the others meet the rest, in
blocks of bounded size, and a task returns a spanning forest of what survives. The components are the clusters.
In a cluster each text's exact distance (one minus similarity) from a central one is taken. Distances are a metric, so
two texts whose distances add up to no more than the bound are linked, two that differ by more are not, and both
are counted by classes of distance. Only texts of the other classes meet, in blocks of bounded bytes, where
pairs are pruned and verified on their shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Forest, components, materialise, mix, ship, slices, span_hashes, text_block, word_spans

#: At this tolerance a linked pair just above the threshold is dropped with about 1e-8.
WIDTH, THRESHOLD, TOLERANCE = 5, 0.8, 1e-9
#: Values of a signature, and the probability with which a pair at the threshold may share no band (see band_rows()).
VALUES, MISS = 160, 1e-5
STEPS = (16, 32, 48, 64, 96, 128, 160)
#: Texts of a block of a bucket; texts and bytes of shingles of a block of a cluster.
BUCKET_BLOCK, CLUSTER_BLOCK, CLUSTER_BYTES = 1024, 1024, 1 << 19
#: Classes of distance up to the bound, and in all.
CLASSES, MOST_CLASSES = 16, 96

_random = np.random.RandomState(7)
_FACTORS = (_random.randint(1, 1 << 31, VALUES).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_ADDENDS = _random.randint(0, 1 << 31, VALUES).astype(np.uint32)


def shingle_sets(raw: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Sorted hashes of each row's runs of WIDTH words; a shorter text's words are its one shingle."""
    starts, ends, first = word_spans(raw, offs)
    h = span_hashes(raw, starts, ends)
    run = np.zeros(max(0, len(h) - WIDTH + 1), np.uint64)
    for k in range(WIDTH):
        run = mix(run * np.uint64(31) + h[k : len(h) - WIDTH + 1 + k])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WIDTH:
            out.append(np.unique(run[a : b - WIDTH + 1]))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for x in h[a:b]:
                one = mix(one * np.uint64(31) + x + np.uint64(1))
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (rows x VALUES) of sets of which none is empty."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), VALUES), np.uint32)
    for k in range(VALUES):
        out[:, k] = np.minimum.reduceat(flat * _FACTORS[k] + _ADDENDS[k], at)
    return out


def band_rows(threshold: float) -> int:
    """Values of a band: as many as leave a pair at the threshold without a common band with MISS at most, as
    (1 - 0.8**5)**32 = 3e-6 does. Fewer serve lower thresholds, with more buckets; below 0.07 none do."""
    for rows in range(10, 0, -1):
        if (1 - threshold**rows) ** (VALUES // rows) <= MISS:
            return rows
    raise ValueError(f"{VALUES} values can't find the pairs at a threshold of {threshold}")


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    bands = VALUES // rows
    key = np.zeros((len(values), bands), np.uint64)
    for k in range(rows):
        key = mix(key * np.uint64(31) + values[:, k : bands * rows : rows].astype(np.uint64))
    return key


def bytes_of(values: np.ndarray) -> np.ndarray:
    """One byte of each value: equal values stay equal, others are so by chance of 1 in 256."""
    folded = values ^ (values >> np.uint32(8)) ^ (values >> np.uint32(16)) ^ (values >> np.uint32(24))
    return folded.astype(np.uint8)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each step, the fewest matches with which a pair goes on. After m matches of n, under a uniform prior,
    P(similarity >= t) is the probability of at most m successes in n + 1 trials of chance t."""
    out = {}
    for n in STEPS:
        p, m = 0.0, 0
        while True:
            p += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if p >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def survive(signs: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which of the pairs (a, b) of rows are never pruned."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    done = 0
    for n in STEPS:
        matches = matches + (signs[a[alive], done:n] == signs[b[alive], done:n]).sum(1, dtype=np.int32)
        ok = matches >= least[n]
        alive, matches, done = alive[ok], matches[ok], n
        if not len(alive):
            break
    mask = np.zeros(len(a), bool)
    mask[alive] = True
    return mask


def sketches(docs: DataFrame, rows: int) -> DataFrame:
    """(doc_id, digest of the shingle set, bands, signs); null digest for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_block(batch.column("text"))
            for lo, hi in slices(offs):
                sets = shingle_sets(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                values = signatures([s if len(s) else np.zeros(1, np.uint64) for s in sets])
                keys = band_keys(values, rows).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                signs = [x.tobytes() for x in bytes_of(values)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(digests, pa.binary()), lists, pa.array(signs, pa.binary())], ["doc_id", "digest", "bands", "signs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, bands array<long>, signs binary")


def with_sets(docs: DataFrame) -> DataFrame:
    """(cluster, center): the shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_block(batch.column("text"))
            for lo, hi in slices(offs):
                sets = shingle_sets(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                yield pa.RecordBatch.from_arrays([batch.column("cluster")[lo:hi], pa.array([s.tobytes() for s in sets], pa.binary())], ["cluster", "center"])

    return docs.select("cluster", "text").mapInArrow(run, "cluster long, center binary")


def with_distances(docs: DataFrame, threshold: float) -> DataFrame:
    """(rep, cluster, g, shingles): the class of each text's distance from ``center``, and its shingles."""
    width = max(1 - threshold, 1e-6) / CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_block(batch.column("text"))
            for lo, hi in slices(offs):
                sets = shingle_sets(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                kinds = []
                for own, x in zip(sets, batch.column("center")[lo:hi]):
                    center = np.frombuffer(x.as_buffer(), np.uint64)
                    common = int((center[np.minimum(np.searchsorted(center, own), len(center) - 1)] == own).sum())
                    kinds.append(min(int((1 - common / (len(own) + len(center) - common)) / width), MOST_CLASSES - 1))
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[lo:hi] for c in ("rep", "cluster")], pa.array(kinds, pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "cluster", "g", "shingles"])

    return docs.select("rep", "cluster", "center", "text").mapInArrow(run, "rep long, cluster long, g int, shingles binary")


def near_heads(members: DataFrame, least: dict[int, int]) -> DataFrame:
    """(band, key, rep, head, near): whether a bucket's member survives the comparison with the bucket's head."""
    names = ["band", "key", "rep", "head"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = np.concatenate([fixed_bytes(batch.column(c), VALUES) for c in ("signs", "head_signs")])
            near = survive(signs, np.arange(batch.num_rows), np.arange(batch.num_rows) + batch.num_rows, least)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(near)], [*names, "near"])

    return members.select(*names, "signs", "head_signs").mapInArrow(run, "band int, key long, rep long, head long, near boolean")


def together(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a pair of blocks (keys, i, j) stand together in one partition."""
    return df.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "rep")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups, with the number of each row's group."""
    rest: pa.Table | None = None

    def numbers(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, np.int64)
        for k in keys:
            x = table.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.cumsum(new)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        if not table.num_rows:
            continue
        group = numbers(table)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield table.slice(0, cut).combine_chunks(), group[:cut]
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), numbers(rest)


def fixed_bytes(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return text_block(column)[0].reshape(-1, width)


def forests(members: DataFrame, least: dict[int, int]) -> DataFrame:
    """Edges (a, b) that join what survives the pruning within each bucket."""
    keys = ["band", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, keys):
            rep, own = table.column("rep").to_numpy(), table.column("own").to_numpy()
            cross = table.column("i").to_numpy() != table.column("j").to_numpy()
            signs = fixed_bytes(table.column("signs"), VALUES)
            trees = Forest(len(rep))
            at, d = np.arange(len(rep)), 0
            while len(at):
                d += 1
                at = at[at < len(rep) - d]
                at = at[group[at] == group[at + d]]
                new = at[~cross[at] | (own[at] != own[at + d])]
                new = new[trees.up[new] != trees.up[new + d]]  # pairs that are joined already need no test
                if len(new):
                    new = new[survive(signs, new, new + d, least)]
                    for x in new.tolist():
                        trees.union(x, x + d)
                    if len(new):
                        trees.roots()
            root = trees.roots()
            child = np.flatnonzero(root != np.arange(len(rep)))
            edges = np.unique(np.stack([rep[child], rep[root[child]]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], ["a", "b"])

    return members.select(*keys, "own", "rep", "signs").mapInArrow(run, "a long, b long")


def verified(members: DataFrame, least: dict[int, int], threshold: float) -> DataFrame:
    """(rep, links, tree): for each row of each block pair, the documents it is linked with there, and the smallest
    text that it hangs together with there."""
    keys = ["cluster", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, keys):
            rep, own, copies = (table.column(c).to_numpy() for c in ("rep", "own", "copies"))
            cross = table.column("i").to_numpy() != table.column("j").to_numpy()
            signs = fixed_bytes(table.column("signs"), VALUES)
            raw, offs = text_block(table.column("shingles"))
            values, bounds = np.frombuffer(raw.tobytes(), np.uint64), offs // 8
            sizes = np.diff(bounds)
            links, trees = np.zeros(len(rep), np.int64), Forest(len(rep))
            again = np.append(False, (rep[1:] == rep[:-1]) & (group[1:] == group[:-1]))  # repeated rows, which stand together
            last = np.searchsorted(group, group, "right")
            for x in np.flatnonzero(~again).tolist():
                ys = np.arange(x + 1, last[x])
                ys = ys[~again[ys]]
                if cross[x]:
                    ys = ys[own[ys] != own[x]]
                small, large = np.minimum(sizes[x], sizes[ys]), np.maximum(sizes[x], sizes[ys])
                ys = ys[small >= threshold * large - 1e-9]
                if len(ys):
                    ys = ys[survive(signs, np.full(len(ys), x), ys, least)]
                if not len(ys):
                    continue
                mine, theirs = values[bounds[x] : bounds[x + 1]], np.concatenate([values[bounds[y] : bounds[y + 1]] for y in ys])
                hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                common = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[ys])[:-1]]))
                ys = ys[common >= threshold * (sizes[x] + sizes[ys] - common) - 1e-9]
                links[x] += copies[ys].sum()
                links[ys] += copies[x]
                for y in ys.tolist():
                    trees.union(x, y)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links), pa.array(rep[trees.roots()])], ["rep", "links", "tree"])

    return members.select(*keys, "own", "rep", "copies", "signs", "shingles").mapInArrow(run, "rep long, links long, tree long")


def bucket_edges(signed: DataFrame, least: dict[int, int]) -> DataFrame:
    """Edges (a, b) that join what survives the pruning within each bucket, from (band, key, rep, signs).

    Members that survive with their bucket's head hang together by it. Each of the others meets all members, so its
    bucket is cut into blocks of far and of near members, and two blocks meet if one of them is of far ones.
    """
    heads = signed.groupBy("band", "key").agg(F.min(F.struct("rep", "signs")).alias("h")).select("band", "key", F.col("h.rep").alias("head"), F.col("h.signs").alias("head_signs"))
    stars = materialise(near_heads(signed.join(heads.hint("merge"), ["band", "key"]), least), "bucket-stars")
    far = stars.groupBy("band", "key").agg(F.sum((~F.col("near")).cast("long")).alias("n_far"), F.sum(F.col("near").cast("long")).alias("n_near")).filter("n_far > 0 and n_far + n_near > 2")
    rest = stars.select("band", "key", "rep", "near").join(materialise(far, "open-buckets").hint("merge"), ["band", "key"])
    n_far, n_near = (F.ceil(F.col(c) / BUCKET_BLOCK).cast("int") for c in ("n_far", "n_near"))
    block = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    rest = rest.withColumn("own", F.when(F.col("near"), n_far + block(n_near)).otherwise(block(n_far)))
    rest = rest.join(signed.select("band", "key", "rep", "signs").hint("merge"), ["band", "key", "rep"])
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("near"), n_far).otherwise(n_far + n_near) - 1)))
    rest = rest.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    trees = forests(together(rest, ["band", "key"]), least)
    return stars.filter("near and rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b")).unionByName(trees).distinct()


def texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (rep, cluster) with their texts, once where rows repeat a doc_id."""
    return docs.join(rows.withColumnRenamed("rep", "doc_id").hint("merge"), "doc_id").withColumnRenamed("doc_id", "rep").dropDuplicates(["rep"])


def by_class(rows: DataFrame, centers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (rep, cluster, g, bytes, copies): (rep, links, center) by classes alone, where center is null unless the text
    is surely linked with it; and (rep, cluster, own, pairs) of the texts that must meet others, with the pairs (i, j)
    of blocks in which they do.

    A text of class g is at less than g + 1 widths from the center, of which CLASSES make the bound. So classes f and g
    are linked if f + g + 2 <= CLASSES, and can't be if one of them is more than CLASSES + 1 above the other.
    """
    per = rows.groupBy("cluster", "g").agg(F.sum("copies").alias("docs"), F.greatest(F.ceil(F.count("*") / CLUSTER_BLOCK), F.ceil(F.sum("bytes") / CLUSTER_BYTES)).cast("int").alias("blocks"))
    before = Window.partitionBy("cluster").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # of MOST_CLASSES rows at most
    per = per.withColumn("offset", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int"))
    per = materialise(per.groupBy("cluster").agg(F.collect_list(F.struct("g", "docs", "blocks", "offset")).alias("classes")), "distance-classes")
    named = rows.join(per.hint("merge"), "cluster").join(centers.withColumnRenamed("rep", "center").hint("merge"), "cluster")
    sure = f"filter(classes, c -> c.g + g + 2 <= {CLASSES})"
    links = f"aggregate({sure}, 0L, (n, c) -> n + c.docs) - if(2 * g + 2 <= {CLASSES}, copies, 0L)"
    open_ = f"filter(classes, c -> c.g + g + 2 > {CLASSES} and abs(c.g - g) <= {CLASSES + 1})"
    own = "element_at(transform(filter(classes, c -> c.g = g), c -> c.offset + cast(pmod(xxhash64(rep), c.blocks) as int)), 1)"
    named = named.selectExpr("rep", "cluster", f"{links} as links", f"if(g + 2 <= {CLASSES}, center, null) as center", f"{open_} as open", f"{own} as own")
    pairs = "flatten(transform(open, c -> transform(sequence(c.offset, c.offset + c.blocks - 1), b -> struct(least(own, b) as i, greatest(own, b) as j))))"
    named = materialise(named.selectExpr("rep", "cluster", "links", "center", "own", f"{pairs} as pairs"), "block-pairs")
    return named.select("rep", "links", "center"), named.filter("size(pairs) > 0").select("rep", "cluster", "own", "pairs")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, n_links) for each document.

    n_links: the other documents whose set of five-word shingles has a Jaccard similarity of ``threshold`` at
    least. class_id: the smallest doc_id of those that hang together by links. A text of one to four words is
    one shingle; a null text and one without words has no links. Words are taken as they stand. Repeated rows
    are copies of each other; rows with a null doc_id come back, and count as copies at most. Further columns of
    ``docs`` are left out. A threshold below 0.07, at which MinHash values find too few pairs, is an error.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    least = least_matches(threshold, tolerance)
    drawn = materialise(sketches(docs, band_rows(threshold)), "sketches")
    reps = materialise(drawn.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "texts")
    own = drawn.join(reps.select(F.col("rep").alias("doc_id"), "copies").hint("merge"), "doc_id").withColumnRenamed("doc_id", "rep").dropDuplicates(["rep"])
    bands = materialise(own.select("rep", F.posexplode("bands").alias("band", "key")), "bands")
    buckets = materialise(bands.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = bands.join(buckets.select("band", "key").hint("merge"), ["band", "key"])
    signed = materialise(members.join(own.select("rep", "signs").hint("merge"), "rep"), "members")
    edges = materialise(bucket_edges(signed, least), "pruned-edges")
    clusters = components(edges, "clusters").select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    clusters = materialise(clusters.join(own.select("rep", "copies", "signs").hint("merge"), "rep"), "cluster-rows")
    # the central text: the one that shares most buckets with others
    shared = signed.join(buckets.hint("merge"), ["band", "key"]).groupBy("rep").agg(F.sum("n").alias("n"))
    centers = clusters.select("rep", "cluster").join(shared.hint("merge"), "rep").groupBy("cluster").agg(F.max(F.struct("n", "rep"))["rep"].alias("rep"))
    centers = materialise(centers, "centers")
    sets = materialise(with_sets(texts_of(docs, centers)), "center-sets")
    starred = materialise(with_distances(texts_of(docs, clusters.select("rep", "cluster")).join(sets.hint("merge"), "cluster"), threshold), "distances")
    sure, open_ = by_class(starred.select("rep", "cluster", "g", F.length("shingles").alias("bytes")).join(clusters.select("rep", "copies").hint("merge"), "rep"), centers)
    blocks = open_.join(starred.select("rep", "shingles").hint("merge"), "rep").join(clusters.select("rep", "copies", "signs").hint("merge"), "rep").select("*", F.inline("pairs"))
    found = materialise(verified(together(blocks, ["cluster"]), least, threshold), "links")
    near = sure.filter("center is not null").select(F.col("rep").alias("a"), F.col("center").alias("b"))
    classes = components(found.select(F.col("rep").alias("a"), F.col("tree").alias("b")).unionByName(near), "classes")
    links = found.select("rep", "links").unionByName(sure.select("rep", "links")).groupBy("rep").agg(F.sum("links").alias("links"))
    named = reps.join(links, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("digest", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = materialise(named, "text-classes")
    # texts without words share the null digest, and stand aside
    out = drawn.filter("digest is not null").select("doc_id", "digest").join(named.hint("merge"), "digest", "left").select("doc_id", "class_id", "n_links")
    out = out.unionByName(drawn.filter("digest is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
