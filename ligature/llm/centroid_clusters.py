"""Lloyd rounds with heap-ordered bounds.

A vector's gap is the distance to its second nearest centroid less that to its own. Centroid c moving by m(c) shrinks the
gaps of its vectors by m(c) and by the largest move of another centroid at most, so each cluster keeps the sum of these
shrinkages, its drift. A vector enters its cluster's heap with gap + drift; as long as that is above the cluster's drift,
its centroid is still the nearest. So a round pops from each heap what has expired, scans those vectors against all
centroids, and pushes them where they belong; the rest of the heap isn't looked at.

Vectors lie in blocks of BLOCK, each with a heap a cluster. Blocks and heaps are bucketed tables by block in the shared folder:
a round joins them without a shuffle, and writes the heaps and the sums of what moved, never the vectors. Sums and counts
are integers and exact; the centroids, 64 numbers each, are all that passes through the driver.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship, tables_folder

#: Vectors of a block, and blocks of a bucket, which one task reads at a time.
BLOCK, BUCKET_BLOCKS = 4096, 64
#: Below this, products of components add up exactly in floating point; above the second, distances leave 64 bits.
FLOAT_MOST, MOST = 1 << 22, 1 << 27
#: Share by which a bound is taken as worse than computed, for the roots' rounding.
SLACK = 1e-9


def kept_vectors(df: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v array<double>) of the vectors with ``dims`` finite components, each floor(scale * x)."""
    v = F.col(vector)
    whole = (F.size(v) == dims) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    rows = df.select(F.col(key).alias("vec_id"), v).filter(whole)
    return rows.select("vec_id", F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """(block, ids, data) of BLOCK vectors each; ``data`` has their components as integers, row after row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                flat = np.asarray(part.column("v").flatten())
                if len(flat) and np.abs(flat).max() > MOST:
                    raise ValueError(f"components above {MOST} in size: distances would leave 64 bits")
                ids = pa.ListArray.from_arrays([0, part.num_rows], part.column("vec_id"))
                data = pa.ListArray.from_arrays([0, len(flat)], pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids, data], ["ids", "data"])

    return vectors.select("vec_id", "v").mapInArrow(run, "ids array<long>, data array<int>").withColumn("block", F.monotonically_increasing_id())


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids."""
    kind = np.float64 if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= FLOAT_MOST else np.int64
    x, c = vectors.astype(kind), centroids.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


def scan(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number) and gap of each vector, the gap rounded down."""
    far = squared(vectors, centroids)
    own = far.argmin(axis=1)
    if len(centroids) < 2:
        return own, np.full(len(vectors), np.inf)
    near = np.sqrt(np.partition(far, 1, axis=1)[:, :2].astype(np.float64))
    return own, near[:, 1] - near[:, 0] - SLACK * (1 + near[:, 1])


def shrinkage(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each cluster, what its vectors' gaps lose at most: its own move and the largest of the others, rounded up."""
    moves = np.sqrt(((after - before).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)
    others = np.array([np.delete(moves, c).max(initial=0.0) for c in range(len(moves))])
    return moves + others


class Heaps:
    """A heap of (gap + drift, vector) for each cluster of one block."""

    def __init__(self, k: int, clusters: list[int], keys: list[float], vectors: list[int]):
        # rows come in the order of the stored heaps, so each is a heap already
        self.of: list[list[tuple[float, int]]] = [[] for _ in range(k)]
        for c, key, v in zip(clusters, keys, vectors):
            self.of[c].append((key, v))

    def expired(self, drift: np.ndarray) -> list[tuple[int, int]]:
        """Pops the (vector, cluster) whose gap may be used up."""
        out = []
        for c, heap in enumerate(self.of):
            limit = float(drift[c]) * (1 + SLACK)
            while heap and heap[0][0] <= limit:
                out.append((heapq.heappop(heap)[1], c))
        return out

    def push(self, cluster: int, key: float, vector: int) -> None:
        heapq.heappush(self.of[cluster], (key, vector))

    def columns(self) -> tuple[list[int], list[float], list[int]]:
        rows = [(c, key, v) for c, heap in enumerate(self.of) for key, v in heap]
        return tuple(map(list, zip(*rows))) if rows else ([], [], [])  # type: ignore[return-value]


_STATE = "block long, clusters array<int>, keys array<double>, members array<int>, rescanned long, moved array<struct<cluster:int,n:long,sums:array<long>>>"
_MOVED = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))


def step(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray, dims: int, first: bool) -> DataFrame:
    """The heaps after the vectors that expired, all of them at ``first``, were scanned; ``moved`` has what each
    cluster won less what it lost."""
    k = len(centroids)

    def one(row: dict) -> dict:
        data = np.asarray(row["data"].values).reshape(-1, dims)
        if first:
            heaps, was = Heaps(k, [], [], []), np.full(len(data), -1)
            open_ = np.arange(len(data))
        else:
            heaps = Heaps(k, *(row[c].values.to_pylist() for c in ("clusters", "keys", "members")))
            popped = heaps.expired(drift)
            open_ = np.array([v for v, _ in popped], np.int64)
            was = np.array([c for _, c in popped], np.int64)
        now, gap = scan(data[open_], centroids) if len(open_) else (was, np.zeros(0))
        for v, c, key in zip(open_.tolist(), now.tolist(), (gap + drift[now]).tolist()):
            heaps.push(c, key, v)
        other = now != was
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        np.add.at(n, now[other], 1)
        np.add.at(sums, now[other], data[open_[other]])
        lost = other & (was >= 0)
        np.add.at(n, was[lost], -1)
        np.add.at(sums, was[lost], -data[open_[lost]].astype(np.int64))
        changed = np.flatnonzero((n != 0) | sums.any(axis=1)).tolist()
        clusters, keys, members = heaps.columns()
        moved = [{"cluster": c, "n": int(n[c]), "sums": sums[c].tolist()} for c in changed]
        return {"clusters": clusters, "keys": keys, "members": members, "rescanned": len(open_), "moved": moved}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = one({c: batch.column(c)[i] for c in batch.schema.names})
                kinds = [pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.int64(), _MOVED]
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), *(pa.array([v], t) for v, t in zip(out.values(), kinds))], ["block", *out])

    return rows.mapInArrow(run, _STATE)


def distances(rows: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    """(vec_id, cluster, distance) of the vectors in the heaps, each against its own centroid only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.asarray(batch.column("data")[i].values).reshape(-1, dims)
                clusters, members = (np.asarray(batch.column(c)[i].values) for c in ("clusters", "members"))
                gone = data[members].astype(np.int64) - centroids[clusters]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values.take(pa.array(members)), pa.array(clusters), pa.array((gone * gone).sum(axis=1))], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, cluster, distance) of each kept vector, the final centroids, and how many vectors each scan looked at.

    Kept are vectors with ``dims`` components, none null or not finite; a component x counts as floor(scale * x), which
    may be 2**27 in size at most (else an error, since distances would leave 64 bits). Centroids start as the k vectors with
    the smallest sha256 of ``seed:key`` (ties by components, null keys last, fewer if there are fewer). Rows that repeat a key
    are vectors of their own; a null key is kept and clustered. No vectors give no rows. Further columns are left out.
    """
    spark = df.sparkSession
    ship(spark)
    vectors = kept_vectors(df, key, vector, dims, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = vectors.orderBy(order.asc_nulls_last(), "v").limit(k).collect()  # k rows
    centroids = np.array([r["v"] for r in starts], np.float64).astype(np.int64).reshape(-1, dims)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids, []
    # rows as the footers count them; a bucket is a task's work and holds some 64 MB, less where cores would idle
    n_blocks = -(-df.select().count() // BLOCK)
    buckets = max(min(n_blocks, spark.sparkContext.defaultParallelism), -(-n_blocks // BUCKET_BLOCKS))
    name = f"ligature_{uuid.uuid4().hex}"

    def store(rows: DataFrame, label: str) -> DataFrame:
        path = f"{tables_folder(spark)}/{label}-{name}"
        rows.write.bucketBy(buckets, "block").sortBy("block").option("path", path).saveAsTable(f"{name}_{label}")
        made.append(f"{name}_{label}")
        return spark.table(made[-1])

    made: list[str] = []
    try:
        stored = store(blocks(vectors, dims).repartition(buckets, "block"), "vectors")
        drift, scans = np.zeros(len(centroids)), []
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for turn in range(rounds + 1):
            rows = stored if not turn else stored.join(state.select("block", "clusters", "keys", "members").hint("merge"), "block")
            state = store(step(rows, centroids, drift, dims, not turn), f"heaps{turn}")
            scans.append(state.agg(F.sum("rescanned")).first()[0])
            if turn == rounds:
                break
            change = state.select(F.explode("moved").alias("m")).select("m.cluster", "m.n", F.posexplode("m.sums").alias("dim", "x"))
            for r in change.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():  # k * dims rows
                n[r["cluster"]] += r["n"] if r["dim"] == 0 else 0
                sums[r["cluster"], r["dim"]] += r["x"]
            after = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centroids)
            drift, centroids = drift + shrinkage(centroids, after), after
        final = materialise(distances(stored.join(state.select("block", "clusters", "members").hint("merge"), "block"), centroids, dims), "clusters")
    finally:
        for table in made:  # the files stay until clear_tables()
            spark.sql(f"drop table if exists {table}")
    return final, centroids, scans


def digest(df: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) by the contract's parameters."""
    rows, centroids, _ = cluster(df)
    spark = df.sparkSession
    shas = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    named = spark.createDataFrame(shas, "cluster int, centroid_sha256 string")
    of = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    totals = of.crossJoin(F.broadcast(of.agg(F.sum("cluster_inertia").alias("inertia")))).join(named, "cluster")  # one row; k rows
    return rows.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> str:
    """SQL of the same, one pair of table expressions a round."""
    far = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"""v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as e
from embeddings where len(list_filter(embedding, lambda x: isfinite(x))) = {dims} and len(embedding) = {dims})""",
        f"c0 as (select row_number() over (order by sha256('{seed}:' || vec_id), e) - 1 as c, e from v qualify c < {k})",
    ]
    for t in range(rounds + 1):
        parts.append(f"a{t} as (select v.r, arg_min(c.c, (cast({far} as bigint), c.c)) as c, cast(min({far}) as bigint) as d from v, c{t} c group by v.r)")
        if t < rounds:
            means = f"select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as e from (select a.c, i, sum(v.e[i]) as s, count(*) as n from v join a{t} a using (r), range(1, {dims + 1}) as g(i) group by a.c, i) group by c"
            parts.append(f"m{t} as ({means}), c{t + 1} as (select o.c, coalesce(m.e, o.e) as e from c{t} o left join m{t} m using (c))")
    body = ",\n".join(parts)
    return f"""with {body}
select v.vec_id, cast(a.c as integer) as cluster, a.d as distance, cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia,
       sha256(array_to_string(list_transform(c.e, lambda x: cast(x as varchar)), ',')) as centroid_sha256
from v join a{rounds} a using (r) join c{rounds} c on c.c = a.c"""


ORACLE = _oracle()
