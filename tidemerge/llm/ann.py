"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on the driver to a bounded sample and kept near one size by splitting large clusters. Every vector is
indexed: in its nearest centroid's list and, if near a boundary, in further lists (replicas), leaving out lists that lie in the
direction of one already taken. A query finds its centroids by best-first search in an in-memory neighbour graph, keeps the
lists whose centroid is at most ``probe_ratio`` times as far as the nearest one, and is compared with all vectors of these lists in
double precision. Lists are cut into parts of bounded size, so a hot list spreads over many tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_of, named, record_batch, saved, slim

#: Documented bounds: sampled vectors that centroids are fitted to (at least eight a centroid), vectors and queries of a block.
SAMPLE_ROWS, BLOCK_ROWS, BLOCK_QUERIES = 32_768, 512, 128
#: Lists that a query is compared with first, for a bound on its k-th distance.
FIRST_LISTS = 4


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a (few, or a block) to all rows of b, fast and inexact."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


class CentroidGraph:
    """Centroids with a navigable neighbour graph: each linked to its nearest ones, both ways, and to a few random ones."""

    def __init__(self, centroids: np.ndarray, degree: int = 16, seed: int = 7):
        self.centroids = c = centroids.astype(np.float32)
        n, rng = len(c), np.random.default_rng(seed)
        links: list[set[int]] = [set() for _ in range(n)]
        for start in range(0, n, 1024):
            d = squared(c[start : start + 1024], c)
            near = np.argsort(d, axis=1)[:, : degree + 1]
            for i, row in enumerate(near, start):
                for j in row:
                    if i != j:
                        links[i].add(int(j))
                        links[int(j)].add(i)
        for i in range(n):
            links[i].update(int(j) for j in rng.integers(0, n, 4) if j != i)
        self.links = [np.fromiter(sorted(x), np.int64, len(x)) for x in links]
        self.entries = np.unique(rng.integers(0, n, min(n, 8)))

    def search(self, query: np.ndarray, ratio: float, beam: int) -> np.ndarray:
        """Centroids at most ``ratio`` times as far as the nearest found, nearest first. Best-first; it goes on while within the ratio or among the ``beam`` best."""
        q, seen, heap, done = query.astype(np.float32), np.zeros(len(self.links), bool), [], []

        def add(which: np.ndarray) -> None:
            which = which[~seen[which]]
            seen[which] = True
            d = np.sqrt(((self.centroids[which] - q) ** 2).sum(1))
            for x, i in zip(d.tolist(), which.tolist(), strict=True):
                heapq.heappush(heap, (x, i))

        add(self.entries)
        best: list[float] = []  # the beam's distances, negated: a heap with the farthest on top
        nearest = float("inf")
        while heap:
            d, i = heapq.heappop(heap)
            if len(best) >= beam and d > -best[0] and d > ratio * nearest:
                break
            nearest = min(nearest, d)
            done.append((d, i))
            heapq.heappush(best, -d)
            if len(best) > beam:
                heapq.heappop(best)
            add(self.links[i])
        done.sort()
        return np.array([i for d, i in done if d <= ratio * nearest], np.int64)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Balanced k-means: after each round the smallest clusters' centroids move beside those of clusters over twice the mean."""
    points, rng = np.unique(sample.astype(np.float32), axis=0), np.random.default_rng(seed)
    k = max(1, min(lists, len(points)))
    c = points[rng.choice(len(points), k, replace=False)].copy()
    for turn in range(rounds):
        own = np.concatenate([squared(points[s : s + 2048], c).argmin(1) for s in range(0, len(points), 2048)])
        size = np.bincount(own, minlength=k)
        total = np.zeros_like(c, dtype=np.float64)
        np.add.at(total, own, points)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c).astype(np.float32)
        if turn < rounds - 2:
            large, small = np.flatnonzero(size > 2 * len(points) / k), np.argsort(size, kind="stable")
            for i, j in zip(large[np.argsort(-size[large], kind="stable")], small, strict=False):
                members = np.flatnonzero(own == i)
                if size[j] * 2 < size[i] and len(members) > 1:
                    c[j] = points[rng.choice(members)]
    return np.unique(c, axis=0)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec) of vectors that take part: no null, empty, non-finite or all-zero ones. Components keep their precision: single, or else double."""
    kind = "float" if vectors.select(named(vector_col)).dtypes[0][1] == "array<float>" else "double"
    rows = slim(vectors, vec_id=id_col, vec=vector_col).select(F.col("vec_id").cast("long"), F.col("vec").cast(f"array<{kind}>").alias("vec"))
    fine = F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
    fine &= F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("vec", lambda x: x != 0)
    return rows.where(fine).distinct()


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of numbers, without nulls and all of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def nearest(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", query_modulus: int = 100, k: int = 10,
    list_rows: int = 128, replicas: int = 4, boundary_ratio: float = 1.05, probe_ratio: float = 1.3, beam: int = 24, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query, nearest first, ties to the smaller id.

    Queries are the rows whose id is divisible by ``query_modulus``; candidates all rows but the query's own. score is the
    Euclidean distance in double precision of the vectors as stored. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do rows without id. Vectors of different lengths are searched apart: no distance is defined
    between them.
    Of equal vectors only the k + 1 smallest ids are indexed: no other copy can be among the k nearest of any query, for ties go
    to smaller ids, so the result is the same. Repeated (id, vector) rows count once. Empty tables give no rows.
    """
    rows = usable(vectors, id_col, vector_col)
    lengths = [r.n for r in rows.select(F.size("vec").alias("n")).distinct().orderBy("n").collect()]  # vectors of one kind have one length
    found = [_nearest(rows.where(F.size("vec") == n), query_modulus, k, list_rows, replicas, boundary_ratio, probe_ratio, beam, sample_rows) for n in lengths]
    return reduce(DataFrame.unionByName, found, vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double"))


def _nearest(rows: DataFrame, query_modulus: int, k: int, list_rows: int, replicas: int, boundary_ratio: float, probe_ratio: float, beam: int, sample_rows: int) -> DataFrame:
    """As ``nearest``, for usable vectors of one length."""
    spark, vector = rows.sparkSession, dict(rows.dtypes)["vec"]
    same = Window.partitionBy("vec").orderBy("vec_id")
    points = saved(rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).select("vec_id", "vec"))
    total = points.count()
    keep = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < min(1 << 30, int((1 << 30) * sample_rows / max(total, 1)))
    sample = points.where(keep).select("vec").limit(2 * sample_rows).toArrow().column("vec").combine_chunks()
    sample = matrix(sample).astype(np.float32)
    if not len(sample):
        sample = matrix(points.select("vec").limit(1).toArrow().column("vec").combine_chunks()).astype(np.float32)
    lists = int(np.clip(round(total / list_rows), 1, max(1, len(sample) // 8)))
    graph = CentroidGraph(fit_centroids(sample, lists))
    sent = spark.sparkContext.broadcast(graph)  # an eighth of the sample's size at most

    post = arrow_of(f"list int, vec_id long, vec {vector}")

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value.centroids
        among = np.sqrt(squared(c, c))
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                x = matrix(part.column("vec"))
                d = np.sqrt(squared(x.astype(np.float32), c))
                near = np.argpartition(d, min(2 * replicas, len(c) - 1), axis=1)[:, : 2 * replicas]
                near = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1)
                far = np.take_along_axis(d, near, 1)
                chosen = np.zeros(near.shape, bool)
                chosen[:, 0] = True
                for j in range(1, near.shape[1]):
                    blocked = np.zeros(len(x), bool)
                    for i in range(j):
                        blocked |= chosen[:, i] & (among[near[:, i], near[:, j]] < far[:, j])
                    chosen[:, j] = (far[:, j] <= boundary_ratio * far[:, 0]) & ~blocked & (chosen.sum(1) < replicas)
                at, which = np.nonzero(chosen)
                taken = part.take(pa.array(at))
                yield record_batch(post, {"list": near[at, which].astype(np.int32), "vec_id": taken.column("vec_id"), "vec": taken.column("vec")})

    postings = saved(points.mapInArrow(index, f"list int, vec_id long, vec {vector}"))
    queries = rows.where(F.col("vec_id") % query_modulus == 0)
    distinct = queries.groupBy("vec").agg(F.min("vec_id").alias("query"))

    probe = arrow_of(f"list int, query long, vec {vector}, place int")

    def probes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [sent.value.search(q, probe_ratio, beam) for q in matrix(part.column("vec"))]
                at = np.repeat(np.arange(len(found)), [len(x) for x in found])
                taken = part.take(pa.array(at))
                places = np.concatenate([np.arange(len(x), dtype=np.int32) for x in found])
                yield record_batch(probe, {"list": np.concatenate(found).astype(np.int32), "query": taken.column("query"), "vec": taken.column("vec"), "place": places})

    probed = saved(distinct.mapInArrow(probes, f"list int, query long, vec {vector}, place int"))

    def blocks(rows: DataFrame, key: str, most: int, *also: str) -> DataFrame:
        """A row for each list and part: keys and vectors of at most some ``most`` rows."""
        sizes = rows.groupBy("list").count().select("list", F.ceil(F.col("count") / most).cast("int").alias("parts"))  # a row a list
        dealt = rows.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")))
        packed = dealt.groupBy("list", "part").agg(F.collect_list(F.struct(key, "vec", *also)).alias("rows"))
        return packed.select("list", *(F.col(f"rows.{name}").alias(f"{key}_{name}") for name in ("vec", *also)), F.col(f"rows.{key}").alias(key))

    posted = saved(blocks(postings, "vec_id", BLOCK_ROWS))
    out = arrow_of("query long, vec_id long, score double")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, queries, bounds = (batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("vec_id", "query", "query_bound"))
                x, q = (matrix(batch.column(n)[i].values).astype(np.float64) for n in ("vec_id_vec", "query_vec"))
                got: list[tuple] = []
                for name, vector, bound in zip(queries, q, bounds, strict=True):
                    d = np.sqrt(((x - vector) ** 2).sum(1))
                    near = np.flatnonzero(d <= (min(bound, np.partition(d, k)[k]) if len(d) > k + 1 else bound))
                    near = near[np.lexsort((ids[near], d[near]))][: k + 1]
                    got.append((np.full(len(near), name), ids[near], d[near]))
                yield record_batch(out, dict(zip(("query", "vec_id", "score"), map(np.concatenate, zip(*got, strict=True)), strict=True)))

    def compared(asked: DataFrame) -> DataFrame:
        joined = posted.join(blocks(asked, "query", BLOCK_QUERIES, "bound"), "list")
        return joined.select("vec_id", "vec_id_vec", "query", "query_vec", "query_bound").mapInArrow(compare, "query long, vec_id long, score double")

    # the nearest lists give each query a bound; from the others only what is within it is passed on
    first = saved(compared(probed.where(F.col("place") < FIRST_LISTS).withColumn("bound", F.lit(float("inf")))))
    ordered = Window.partitionBy("query").orderBy("score", "vec_id")
    ends = first.distinct().withColumn("place", F.row_number().over(ordered)).where(F.col("place") == k + 1).select("query", F.col("score").alias("bound"))
    rest = probed.where(F.col("place") >= FIRST_LISTS).join(ends, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    once = first.unionByName(compared(rest)).groupBy("query", "vec_id").agg(F.min("score").alias("score"))  # replicas of one vector
    top = once.withColumn("place", F.row_number().over(ordered)).where(F.col("place") <= k + 1)
    answered = distinct.withColumnRenamed("vec", "same").join(top, "query").join(queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("same")), "same")
    mine = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = answered.where(F.col("query_id") != F.col("vec_id")).withColumn("rank", F.row_number().over(mine))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
