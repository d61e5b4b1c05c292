"""Centroid clustering of integer vectors by ball-tree filtering.

Each task builds ball trees over the vectors of its partition; nothing is shuffled. A node has a
centre, a radius, a count and the exact integer sum of its vectors. In a round every tree is walked with
the centroids, a bounded table that all tasks get: by the triangle inequality a centroid that is
nearer to the farthest possible vector of a ball than another is to the nearest one beats it, and a ball
with one centroid left is assigned whole, by its count and sum. Other balls are opened, down to leaves
that compare every vector exactly. Tasks send one partial sum per centroid and component.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, staged

#: Components of a vector, factor before flooring, clusters, rounds.
SIZE, SCALE, CLUSTERS, ROUNDS = 64, 1024.0, 8, 10
#: Vectors of a tree and of a leaf.
SHARD, LEAF = 16_384, 64
LONG = (1 << 63) - 1
#: Sums travel in digits of this base, so that none is too long for a column.
BASE = 1 << 62
_EXACT = 2.0**53


def quantised(embeddings: DataFrame, size: int = SIZE, scale: float = SCALE) -> DataFrame:
    """vec_id and v, the components floor(scale x) as little-endian doubles, which are integers.

    Only vectors with exactly ``size`` components stay, none of them null or non-finite; so do
    vectors whose scaled components leave the range of a double go. Null ids stay.
    """
    small_batches(embeddings.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1)
            whole = np.asarray(rows.value_lengths().fill_null(0)) == size
            batch = batch.filter(pa.array(whole))
            values = batch.column(1).flatten()
            x = np.floor(scale * np.asarray(values.cast(pa.float64()).fill_null(np.nan), np.float64)).reshape(-1, size)
            good = np.isfinite(x).all(axis=1)
            packed = pa.array([row.tobytes() for row in x[good].astype("<f8")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), packed], names=["vec_id", "v"])

    return embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, v binary")


def _whole(x: np.ndarray) -> np.ndarray:
    """Doubles that are integers as Python's integers."""
    return np.frompyfunc(int, 1, 1)(x)


def distances(v: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances, a row per vector: int64, or Python's integers if those could overflow."""
    most = max(np.abs(v).max(initial=0), max((abs(x) for c in centroids for x in c), default=0))
    if 4 * max(1, v.shape[1]) * float(most) ** 2 < _EXACT:  # each term of the expansion is an exact double
        c = np.array(centroids, np.float64)
        d = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)
        return d.astype(np.int64)
    v = _whole(v)
    return np.array([((v - np.array(c, object)) ** 2).sum(axis=1) for c in centroids], object).T.reshape(len(v), -1)


def nearest(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every vector, the smaller number in ties, and the squared distance."""
    d = distances(v, centroids)
    best = np.array([min(range(len(centroids)), key=row.__getitem__) for row in d], np.int64) if d.dtype == object else d.argmin(axis=1)
    return best, d[np.arange(len(v)), best]


def exact_sum(v: np.ndarray) -> list[int]:
    if len(v) * float(np.abs(v).max(initial=0)) < _EXACT:
        return v.sum(axis=0).astype(np.int64).tolist()
    return _whole(v).sum(axis=0).tolist()


class BallTree:
    """A metric tree; node k covers rows start[k] to stop[k], and its right child is right[k]."""

    def __init__(self, ids: list[int | None], vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        nodes: list[list] = []
        self._build(vectors, order, 0, len(ids), leaf, nodes)
        self.ids = [ids[i] for i in order]
        small = np.abs(vectors).max(initial=0) < 2**15
        self.vectors = vectors[order].astype(np.int16 if small else np.float64)
        self.centre = np.array([n[0] for n in nodes])
        self.radius = np.array([n[1] for n in nodes])
        self.start, self.stop, self.right = ([n[k] for n in nodes] for k in (2, 3, 4))
        self.sums = [n[5] for n in nodes]

    def _build(self, vectors: np.ndarray, order: np.ndarray, start: int, stop: int, leaf: int, nodes: list) -> int:
        own = vectors[order[start:stop]]
        # Halves first: the mean of huge components must not overflow.
        centre = (own / len(own)).sum(axis=0)
        with np.errstate(over="ignore"):
            gap = np.sqrt(((own - centre) ** 2).sum(axis=1))
        node = [centre, gap.max() * (1 + 1e-9) + 1e-6, start, stop, 0, None]
        here = len(nodes)
        nodes.append(node)
        if stop - start > leaf and (own != own[0]).any():
            far = own[gap.argmax()]
            with np.errstate(over="ignore", invalid="ignore"):
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                along = np.nan_to_num(own @ (other - far))
            order[start:stop] = order[start:stop][np.argsort(along, kind="stable")]
            middle = (start + stop) // 2
            left = self._build(vectors, order, start, middle, leaf, nodes)
            node[4] = self._build(vectors, order, middle, stop, leaf, nodes)
            node[5] = [a + b for a, b in zip(nodes[left][5], nodes[node[4]][5])]
        else:
            node[5] = exact_sum(own)
        return here

    def assign(self, centroids: list[list[int]]) -> Iterator[tuple[int, int, int | None]]:
        """(node, start row, centroid) of every ball that one centroid owns, and (node, start row,
        None) of every leaf whose vectors must be compared."""
        c = np.array([[float(x) for x in row] for row in centroids])
        stack = [(0, np.arange(len(centroids)))]
        while stack:
            k, left = stack.pop()
            with np.errstate(over="ignore", invalid="ignore"):
                gap = np.sqrt(((c[left] - self.centre[k]) ** 2).sum(axis=1))
            slack = 1e-9 * gap + 1e-6
            farthest = (gap + self.radius[k] + slack).min()
            left = left[~(gap - self.radius[k] - slack > farthest)]  # a bound that is no number cuts nothing
            if len(left) == 1:
                yield k, self.start[k], int(left[0])
            elif self.right[k]:
                stack += [(self.right[k], left), (k + 1, left)]
            else:
                yield k, self.start[k], None

    def partial(self, centroids: list[list[int]]) -> tuple[list[int], list[list[int]]]:
        """Count and sum of the vectors nearest to each centroid."""
        count = [0] * len(centroids)
        total = [[0] * self.vectors.shape[1] for _ in centroids]

        def add(j: int, n: int, sums: list[int]) -> None:
            count[j] += n
            total[j] = [a + b for a, b in zip(total[j], sums)]

        loose = []
        for k, start, owner in self.assign(centroids):
            if owner is None:
                loose.append(np.arange(start, self.stop[k]))
            else:
                add(owner, self.stop[k] - start, self.sums[k])
        if loose:
            v = self.vectors[np.concatenate(loose)].astype(np.float64)
            best, _ = nearest(v, centroids)
            for j in np.unique(best).tolist():
                add(j, int((best == j).sum()), exact_sum(v[best == j]))
        return count, total

    def labels(self, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of every row; in a ball with one owner only that one is measured."""
        found = [(np.arange(start, self.stop[k]), owner) for k, start, owner in self.assign(centroids)]
        cluster, distance = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), object)
        for owner in {o for _, o in found}:
            rows = np.concatenate([r for r, o in found if o == owner])
            v = self.vectors[rows].astype(np.float64)
            near, d = nearest(v, centroids if owner is None else [centroids[owner]])
            cluster[rows] = near if owner is None else owner
            distance[rows] = d
        return cluster, distance


def trees(vectors: DataFrame, shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """tree: a ball tree for every ``shard`` vectors of a partition, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []

        def flush() -> pa.RecordBatch:
            tree = BallTree(ids[:shard], np.array([np.frombuffer(r, "<f8") for r in rows[:shard]]), leaf)
            del ids[:shard], rows[:shard]
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tree.__dict__, pickle.HIGHEST_PROTOCOL)], pa.binary())], names=["tree"])

        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows += batch.column(1).to_pylist()
            while len(ids) >= shard:
                yield flush()
        if ids:
            yield flush()

    return vectors.mapInArrow(run, "tree binary")


def _load(tree: bytes) -> BallTree:
    found = BallTree.__new__(BallTree)
    found.__dict__.update(pickle.loads(tree))
    return found


def seeds(vectors: DataFrame, clusters: int = CLUSTERS) -> list[list[int]]:
    """The vectors with the smallest lowercase-hex sha256 of ``3:<vec_id>``; repeated ids follow
    each other by their components, null ids are never chosen."""
    key = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.where("vec_id IS NOT NULL").select(key.alias("key"), "v").orderBy("key", "v").limit(clusters).collect()
    return [[int(x) for x in np.frombuffer(r[1], "<f8")] for r in first]


def moved(forest: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: the floored means of their vectors; empty ones stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(centroids[0])
        whole = [[0] * (width + 1) for _ in centroids]  # the count is component -1
        for batch in batches:
            for tree in batch.column(0):
                count, total = _load(tree.as_py()).partial(centroids)
                whole = [[a + b for a, b in zip(have, [*more, n])] for have, more, n in zip(whole, total, count)]
        out = []
        for j, sums in enumerate(whole):
            for component, value in enumerate(sums):
                digit = 0
                while value:
                    value, low = divmod(value, BASE) if value > 0 else (-x for x in divmod(-value, BASE))
                    out.append((j, component, digit, low))
                    digit += 1
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "component", "digit", "part"])

    parts = forest.mapInArrow(run, "cluster long, component long, digit long, part long")
    width = len(centroids[0])
    sums = [[0] * (width + 1) for _ in centroids]
    # At most one row per centroid, component and digit comes to the driver.
    for j, component, digit, part in parts.groupBy("cluster", "component", "digit").agg(F.sum(F.col("part").cast("decimal(38,0)"))).collect():
        sums[j][component] += int(part) * BASE**digit
    return [[x // s[-1] for x in s[:-1]] if s[-1] else old for s, old in zip(sums, centroids)]


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and squared distance of every row of :func:`quantised`, and the centroids.

    Ties go to the smaller number. Repeated rows count as often as they occur; with fewer vectors than
    ``clusters`` there are fewer centroids; an empty table gives an empty result. Distances beyond a
    long are cut to the largest long.
    """
    vectors = staged(vectors, "cluster-vectors")
    centroids = seeds(vectors, clusters)
    forest = staged(trees(vectors), "cluster-trees")
    for _ in range(rounds if centroids else 0):
        after = moved(forest, centroids)
        if after == centroids:  # no later round can change anything
            break
        centroids = after

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                tree = _load(blob.as_py())
                label, distance = tree.labels(centroids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree.ids, pa.int64()), pa.array(label), pa.array([min(int(x), LONG) for x in distance], pa.int64())], names=["vec_id", "cluster", "distance"]
                )

    return (forest if centroids else forest.limit(0)).mapInArrow(run, "vec_id long, cluster long, distance long"), centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found, centroids = cluster(vectors)
    found = staged(found, "clusters")
    total = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    about = [(j, min(s, LONG), min(sum(total.values()), LONG), digest[j]) for j, s in total.items()]
    table = spark.createDataFrame(about, "cluster long, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = found.join(F.broadcast(table), "cluster")  # one row per centroid
    return joined.select("vec_id", F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds one after the other, as SQL."""
    near = (
        "SELECT k, vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT k, vec_id, v, cluster,"
        " list_sum(list_transform(range(1, {n} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS d FROM kept, c{r}) GROUP BY k, vec_id, v"
    )
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        f" WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS cluster, v AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id), v) <= {CLUSTERS})",
    ]
    for r in range(ROUNDS):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(n=SIZE, r=r)})")
        mean = "CAST(CASE WHEN s < 0 AND s % n <> 0 THEN s // n - 1 ELSE s // n END AS BIGINT)"
        sums = f"SELECT cluster, i, sum(CAST(v[i] AS HUGEINT)) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, {SIZE} + 1)) AS i) GROUP BY 1, 2"
        means = f"SELECT cluster, list({mean} ORDER BY i) AS c FROM ({sums}) GROUP BY 1"
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN ({means}) m USING (cluster))")
    parts.append(f"last AS MATERIALIZED ({near.format(n=SIZE, r=ROUNDS)})")
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM last JOIN c{ROUNDS} USING (cluster)"
    )


ORACLE = _oracle()
