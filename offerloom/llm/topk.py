"""Exact inner-product top-k: branch and bound over one ball tree per shard.

Vectors go to the nearest of a bounded number of pivots, and the vectors of a pivot to shards of a
bounded size; each shard gets a ball tree. A query first searches one shard of its own pivot, then
the pivots with the highest upper bounds, then what is left. The kth score found so far is a
true lower bound that it carries, shared, into every later search: pivots whose upper bound
``q . pivot + |q| radius`` lies below it are not visited and their trees are not sent. In a tree,
nodes whose bound lies below it are cut off with all below them; the leaves left are visited by
upper bound, best first, until none can improve the kth score.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import small_batches, staged

TOP = 20
SCALE = 64.0
#: Vectors of a shard, queries of a block, vectors of a leaf.
SHARD, BLOCK, LEAF = 16_384, 1_024, 256
#: Most pivots (they travel to every task), and pivots that a query visits before the rest.
PIVOTS, AHEAD = 256, 2
LONG = (1 << 63) - 1


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, the components floor(64 x) as little-endian doubles (exact integers).

    Vectors that are null or hold null or non-finite components are left out, as are null ids.
    """
    small_batches(embeddings.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or x is None or None in x:
                    continue
                x = np.asarray(x, np.float64)
                if np.isfinite(x).all():
                    ids.append(i)
                    vectors.append(np.floor(SCALE * x).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], names=["vec_id", "v"])

    return embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, v binary")


def matrix(rows: list[bytes]) -> np.ndarray:
    """One vector a row; shorter vectors are padded with zeros, which add nothing to a product."""
    parts = [np.frombuffer(r, "<f8") for r in rows]
    out = np.zeros((len(parts), max((len(p) for p in parts), default=0)))
    for k, p in enumerate(parts):
        out[k, : len(p)] = p
    return out


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products as int64; beyond the range of a long they saturate."""
    width = min(q.shape[1], v.shape[1])
    q, v = q[:, :width], v[:, :width]
    most = (np.abs(q).max(initial=0) * np.abs(v).max(initial=0)) * max(width, 1)
    if most < 2**53:  # every partial sum is an exact double
        return (q @ v.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    if width == 0:
        return np.zeros((len(q), len(v)), np.int64)
    return np.clip(exact(q) @ exact(v).T, -LONG - 1, LONG).astype(np.int64)


class BallTree:
    """Node k has children 2k + 1 and 2k + 2; leaves hold runs of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.ids, self.vectors = ids, vectors
        order = np.arange(len(ids))
        nodes: list[tuple[np.ndarray, float, int, int, int]] = []  # centre, radius, start, stop, right child or 0
        self._build(order, 0, len(ids), leaf, nodes)
        self.ids, self.vectors = ids[order], vectors[order]
        self.centre = np.array([n[0] for n in nodes]).reshape(len(nodes), -1)
        self.radius = np.array([n[1] for n in nodes])
        self.span = np.array([n[2:4] for n in nodes], np.int64)
        self.right = np.array([n[4] for n in nodes], np.int64)

    def _build(self, order: np.ndarray, start: int, stop: int, leaf: int, nodes: list) -> int:
        own = self.vectors[order[start:stop]]
        centre = own.mean(axis=0)
        gap = np.sqrt(((own - centre) ** 2).sum(axis=1))
        here = len(nodes)
        nodes.append((centre, gap.max(), start, stop, 0))
        if stop - start > leaf and gap.max() > 0:
            far = own[gap.argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            by = np.argsort(own @ (other - far), kind="stable")
            order[start:stop] = order[start:stop][by]
            middle = (start + stop) // 2
            self._build(order, start, middle, leaf, nodes)
            right = self._build(order, middle, stop, leaf, nodes)
            nodes[here] = (*nodes[here][:4], right)
        return here

    def dump(self) -> bytes:
        out = io.BytesIO()
        small = np.abs(self.vectors).max(initial=0) < 2**15
        np.savez(out, ids=self.ids, vectors=self.vectors.astype(np.int16) if small else self.vectors, centre=self.centre, radius=self.radius, span=self.span, right=self.right)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> BallTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as got:
            for name in got.files:
                setattr(tree, name, got[name])
        tree.vectors = tree.vectors.astype(np.float64)
        return tree

    def bounds(self, q: np.ndarray, norms: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """No product of a query with a vector of the node is larger."""
        width = min(q.shape[1], self.centre.shape[1])
        upper = q[:, :width] @ self.centre[nodes, :width].T + norms[:, None] * self.radius[nodes]
        return upper + 1e-9 * np.abs(upper) + 1e-6 * (1 + norms[:, None])

    def leaves(self, q: np.ndarray, norms: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaves, upper bound of each query for each); -inf where an ancestor was cut off."""
        found, bound = [], []
        stack = [(0, np.ones(len(q), bool))]
        while stack:
            node, alive = stack.pop()
            upper = np.full(len(q), -np.inf)
            upper[alive] = self.bounds(q[alive], norms[alive], np.array([node]))[:, 0]
            alive = alive & (upper >= kth)
            if not alive.any():
                continue
            if self.right[node]:
                stack += [(node + 1, alive), (self.right[node], alive)]
            else:
                found.append(node)
                bound.append(np.where(alive, upper, -np.inf))
        return np.array(found, np.int64), np.array(bound).reshape(len(found), len(q))

    def search(self, qids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, score, vec_id) of up to k best per query that reach its bound ``kth``."""
        kth = kth.astype(np.float64).copy()
        norms = np.sqrt((q**2).sum(axis=1))
        leaves, bound = self.leaves(q, norms, kth)
        row, score, vec = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        turn = np.argsort(-bound, axis=0, kind="stable")
        for t in range(len(leaves)):
            best = bound[turn[t], np.arange(len(q))]
            active = np.flatnonzero((best >= kth) & (best > -np.inf))
            if not len(active):
                break  # bounds only fall and kth only rises
            rows, scores, vecs = [row], [score], [vec]
            at = turn[t][active]
            for leaf in np.unique(at):
                who = active[at == leaf]
                start, stop = self.span[leaves[leaf]]
                s = products(q[who], self.vectors[start:stop])
                ids = self.ids[start:stop]
                a, b = np.nonzero((s >= kth[who][:, None]) & (ids[None, :] != qids[who][:, None]))
                rows.append(who[a])
                scores.append(s[a, b])
                vecs.append(ids[b])
            row, score, vec = np.concatenate(rows), np.concatenate(scores), np.concatenate(vecs)
            order = np.lexsort((vec, -score, row))
            row, score, vec = row[order], score[order], vec[order]
            first = np.searchsorted(row, np.arange(len(q)))
            place = np.arange(len(row)) - first[row]
            last = place == k - 1
            kth[row[last]] = np.maximum(kth[row[last]], score[last])
            row, score, vec = row[place < k], score[place < k], vec[place < k]
        return row, score, vec


def _column(rows: pa.Table, name: str) -> list:
    return rows.column(name).to_pylist()


def _search(block: pa.Table, trees: pa.Table) -> pa.Table:
    out = {"query_id": [], "score": [], "vec_id": []}
    if block.num_rows and trees.num_rows:
        qids, q = np.array(_column(block, "vec_id"), np.int64), matrix(_column(block, "v"))
        kth = np.array([-np.inf if x is None else x for x in _column(block, "kth")])
        for data in _column(trees, "tree"):
            row, score, vec = BallTree.load(data).search(qids, q, kth)
            out["query_id"] += qids[row].tolist()
            out["score"] += score.tolist()
            out["vec_id"] += vec.tolist()
    return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())]))


class Pivots:
    """At most ``PIVOTS`` vectors, and the radius that holds all vectors nearest to each."""

    def __init__(self, rows: list[bytes]):
        self.points, self.radius = matrix(rows), np.full(len(rows), np.inf)

    def _widened(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = max(v.shape[1], self.points.shape[1])
        return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (v, self.points))

    def nearest(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The pivot of each vector and its distance."""
        v, p = self._widened(matrix(rows))
        with np.errstate(over="ignore", invalid="ignore"):
            at = np.nan_to_num((p**2).sum(axis=1) - 2 * (v @ p.T), nan=np.inf).argmin(axis=1)
            return at, np.sqrt(((v - p[at]) ** 2).sum(axis=1))

    def bounds(self, rows: list[bytes]) -> np.ndarray:
        """No product of a query (row) with a vector of the pivot (column) is larger."""
        q, p = self._widened(matrix(rows))
        norms = np.sqrt((q**2).sum(axis=1))[:, None]
        with np.errstate(over="ignore", invalid="ignore"):
            upper = q @ p.T + norms * self.radius[None, :]
            return np.nan_to_num(upper + 1e-9 * np.abs(upper) + 1e-6 * (1 + norms), nan=np.inf)

    def attach(self, vectors: DataFrame) -> DataFrame:
        """vec_id, v, pivot and gap, the distance to it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, gap = self.nearest(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int32()), pa.array(gap, pa.float64())], names=["vec_id", "v", "pivot", "gap"])

        return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v binary, pivot int, gap double")

    def within_reach(self, queries: DataFrame) -> DataFrame:
        """vec_id, v, kth, block, and ``to``: pivots that can reach kth, highest bound first."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                upper = self.bounds(batch.column(1).to_pylist())
                kth = np.array([-np.inf if x is None else x for x in batch.column(2).to_pylist()])
                turn = np.argsort(-upper, axis=1, kind="stable")
                to = [[int(p) for p in turn[i] if not upper[i, p] < kth[i]] for i in range(len(kth))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.list_(pa.int32()))], names=["vec_id", "v", "kth", "block", "to"])

        return queries.select("vec_id", "v", "kth", "block").mapInArrow(run, "vec_id long, v binary, kth long, block long, to array<int>")


def distinct_enough(vectors: DataFrame) -> DataFrame:
    """Of equal vectors the ``TOP`` + 1 smallest ids: no query, its own row apart, can return another.

    Repeated rows of one id all stay. Ranks are cut before the shuffle, so a crowd of equal
    vectors never meets in one task.
    """
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    return vectors.withColumn("__place", place).where(F.col("__place") <= TOP + 1).drop("__place")


def _parts(sizes: dict[int, int], most: int, seed: int, wide: int) -> tuple:
    """Column of the part of a row: its pivot's number and one of as many parts as its size asks."""
    each = {p: max(1, -(-n // most)) for p, n in sizes.items()}
    count = F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for pair in each.items() for x in pair]), F.col("pivot")), F.lit(1)) if each else F.lit(1)
    return F.col("pivot").cast("long") * wide + F.pmod(F.xxhash64("vec_id", F.lit(seed)), count), count


def top_k(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: the ``TOP`` best rows for each query, none its own.

    ``vectors`` and ``queries`` are rows of :func:`quantised`. Equal scores go to the smaller
    vec_id. Repeated candidate rows each count; a repeated query row counts once. Empty tables
    give an empty result.
    """
    found, wide = "query_id long, score long, vec_id long", 1 << 32
    vectors = staged(distinct_enough(vectors), "vectors")
    n = vectors.count()
    first = vectors.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(min(PIVOTS, max(1, -(-n // SHARD))))
    pivots = Pivots([bytes(r.v) for r in first.select("v").collect()] or [b""])
    placed = staged(pivots.attach(vectors), "placed")
    summed = {r.pivot: r for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect()}
    pivots.radius = np.array([summed[p].radius if p in summed else -np.inf for p in range(len(pivots.points))])
    pivots.radius[np.isnan(pivots.radius)] = np.inf
    sizes = {p: r.n for p, r in summed.items()}
    shard, _ = _parts(sizes, SHARD, 1, wide)

    def build(rows: pa.Table) -> pa.Table:
        ids = np.array(_column(rows, "vec_id"), np.int64)
        tree = BallTree(ids, matrix(_column(rows, "v")))
        return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int64()), "tree": pa.array([tree.dump()], pa.binary())})

    trees = staged(placed.select("vec_id", "v", shard.alias("shard")).groupBy("shard").applyInArrow(build, "shard long, tree binary"), "trees")
    asked = staged(pivots.attach(queries.dropDuplicates(["vec_id", "v"])), "queries")
    crowd = {r["pivot"]: r["count"] for r in asked.groupBy("pivot").count().collect()}
    block, _ = _parts(crowd, BLOCK, 2, wide)  # queries near each other share a block, so it needs few trees
    asked = asked.select("vec_id", "v", "pivot", shard.alias("home"), block.alias("block"))

    def search(pairs: DataFrame, name: str) -> DataFrame:
        """Results of (vec_id, v, kth, block, shard); a tree goes to the blocks that ask for it."""
        needed = staged(pairs.select("block", "shard").distinct(), "needed").join(trees, "shard")
        return staged(pairs.groupBy("block", "shard").cogroup(needed.groupBy("block", "shard")).applyInArrow(_search, found), name)

    def best(results: DataFrame) -> DataFrame:
        return results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= TOP)

    def reached(results: DataFrame) -> DataFrame:
        """Queries with their kth score so far and the shards that can still better it."""
        kth = best(results).groupBy("query_id").agg(F.when(F.count("score") >= TOP, F.min("score")).alias("kth"))
        known = asked.join(kth, F.col("vec_id") == F.col("query_id"), "left")
        to = pivots.within_reach(known).select("*", F.posexplode("to").alias("turn", "pivot"))
        _, count = _parts(sizes, SHARD, 1, wide)
        shards = to.withColumn("shard", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1), lambda s: F.col("pivot").cast("long") * wide + s)))
        homes = asked.select("vec_id", "v", F.col("home").alias("shard"))
        return shards.drop("to", "pivot").join(homes, ["vec_id", "v", "shard"], "left_anti")

    pairs = ["vec_id", "v", "kth", "block", "shard"]
    home = search(asked.select("vec_id", "v", F.lit(None).cast("long").alias("kth"), "block", F.col("home").alias("shard")), "home")
    if trees.limit(2).count() < 2:
        return best(home).select("query_id", "rank", "vec_id", "score")
    near = staged(reached(home).where(F.col("turn") < AHEAD).select(*pairs), "near")
    close = home.unionByName(search(near, "close"))
    rest = reached(close).join(near.select("vec_id", "v", "shard"), ["vec_id", "v", "shard"], "left_anti")
    away = search(staged(rest.select(*pairs), "rest"), "away")
    return best(close.unionByName(away)).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 20 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
