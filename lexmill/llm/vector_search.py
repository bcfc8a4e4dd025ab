"""Exact top-k inner-product search over a pivot-distance index.

Pivots are a fixed number of vectors from a bounded sample. Every vector is
keyed by its nearest pivot, its distance to it and its norm; the cell of a pivot
is cut into rings (annuli) by quantiles of the distance, so there are at most
PIVOTS x RINGS rings whatever the size of the table, and the driver holds one
row for each. A ring's rows are dealt to slices, so equal vectors and large
cells spread. A slice has about as many rows as there are queries, from SLICE to
MOST_SLICE, so that queries which nothing prunes travel no more than the rows do
(beyond MOST_SLICE queries: queries / MOST_SLICE times as much).

For a query q and a ring of pivot p with distances from lo to hi and norms up to
m, no row x of it can score more than either of
    q.p + |q| hi                                          (Cauchy)
    (|q|^2 + m^2 - max(0, |q-p| - hi, lo - |q-p|)^2) / 2   (triangle inequality)
Each query sorts the rings by this bound. It is sent to the best ones first,
until they hold enough rows; the k-th best score there is its threshold, and it
goes on to the other rings in order until a bound is below it. Queries meet
slices in a shuffle: a task holds one slice and streams the queries that reached
it, so neither all queries nor all rows are ever in one place.

Queries are a stated set. Scores are integers and exact. scored_share() tells
which share of all pairs was scored; nothing is pruned where vectors don't cluster.

Contract for odd rows: null vectors and those with null or non-finite components
take no part, nor do rows without an id; rows that share an id are each
candidates of other queries, a query's own id is never its candidate, and of
query rows that share an id the one with the smallest vector asks; equal vectors
are told apart by their ids, ties go to the smaller id; vectors of another length
than the query's are no candidates, those of no length take no part; scores
beyond 64 bits are held at the bounds; a query with fewer than k candidates gets
all; other columns take no part, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import durable, table

#: Rows of the sample, pivots of each vector length, rings of a pivot, least and most rows of a slice.
SAMPLE, PIVOTS, RINGS, SLICE, MOST_SLICE = 4096, 64, 16, 2048, 65_536
#: Scores that a slice makes at a time.
SCORES = 1 << 20
QUERIES = 512
SCALE = 256


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): integer vectors without the rows that take no part."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    return kept.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v"))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows as int64; in floats only where those are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(y) for y in row] for row in x], dtype=object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ties to the smaller id; absent ones have id -1 and the least score."""
    order = np.lexsort((ids, np.negative(scores)), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


LEAST = -(2**63) + 1


class Rings:
    """The rings as arrays, and for queries the order in which to expand them."""

    def __init__(self, pivots: np.ndarray, rows: list):
        self.pivots = pivots
        self.cell, self.ring, self.slices = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("cell", "ring", "slices"))
        self.n = np.array([r["n"] for r in rows], dtype=np.int64)
        self.lo, self.hi, self.most = (np.array([r[c] for r in rows], dtype=np.float64) for c in ("lo", "hi", "most"))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Queries x rings: the most that a row of the ring can score."""
        norms, products = np.linalg.norm(queries, axis=1)[:, None], queries @ self.pivots.T
        away = np.sqrt(np.maximum(0, norms**2 - 2 * products + (self.pivots**2).sum(1)[None, :]))[:, self.cell]
        cauchy = products[:, self.cell] + norms * self.hi
        gap = np.maximum(0, np.maximum(away - self.hi, self.lo - away) - 1e-6 * (1 + away))
        bound = np.minimum(cauchy, (norms**2 + self.most**2 - gap**2) / 2)
        return bound + np.abs(bound) * 1e-9 + 1e-3  # rounding must not lose a tie

    def first(self, queries: np.ndarray, k: int) -> np.ndarray:
        """Queries x rings: those to start with, in order of the bound until they hold more than k rows."""
        order = np.argsort(-self.bounds(queries), axis=1, kind="stable")
        held = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(out, order, held <= k, axis=1)
        return out


def nearest_pivot(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    squared = (vectors**2).sum(1)[:, None] - 2 * (vectors @ pivots.T) + (pivots**2).sum(1)[None, :]
    cell = squared.argmin(axis=1)
    return cell, np.linalg.norm(vectors - pivots[cell], axis=1)


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of which is_query (over column id) is true."""
    results = None
    for index in indexes(vectors, is_query, id_col, vector_col):
        found = index.search(is_query, k)
        results = found if results is None else results.unionAll(found)
    if results is None:
        results = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scored_share(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The share of all pairs of a query and a row of its length that the search scores."""
    scored = every = 0
    for index in indexes(vectors, is_query, id_col, vector_col):
        first, others = index.expansions(is_query, k)
        sizes = dict(zip(zip(index.rings.cell.tolist(), index.rings.ring.tolist(), strict=True), index.rings.n.tolist(), strict=True))
        scored += sum(r["n"] * sizes[r["cell"], r["ring"]] for r in first.unionAll(others).groupBy("cell", "ring").agg(F.countDistinct("query_id").alias("n")).collect())
        every += index.queries(is_query).count() * int(index.rings.n.sum())
    return scored / every if every else 0.0


def indexes(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> Iterator[Index]:
    """An index for each vector length, in slices for so many queries."""
    rows = durable(usable(vectors, id_col, vector_col).withColumn("n", F.size("v")).where("n > 0"))
    for (length,) in rows.select("n").distinct().orderBy("n").toLocalIterator():
        own = rows.where(F.col("n") == length).drop("n")
        yield Index(own, length, own.where(is_query).count())


class Index:
    """Rows (id, v) of one length, keyed by cell, ring and slice."""

    def __init__(self, rows: DataFrame, length: int, queries: int):
        self.length = length
        size = max(SLICE, min(MOST_SLICE, queries))
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
        sampled = np.unique(np.array([r["v"] for r in sample], dtype=np.float64).reshape(-1, length), axis=0)
        pivots = sampled[np.linspace(0, len(sampled) - 1, min(PIVOTS, len(sampled))).astype(int)]

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch.column("v"), length)
                cell, distance = nearest_pivot(v, pivots) if batch.num_rows else (np.zeros(0, int), np.zeros(0))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(distance), pa.array(np.linalg.norm(v, axis=1))], names=["id", "v", "cell", "distance", "norm"])

        keyed = durable(rows.mapInArrow(key, "id long, v array<double>, cell int, distance double, norm double"))
        cuts = keyed.groupBy("cell").agg(F.percentile_approx("distance", [i / RINGS for i in range(1, RINGS)]).alias("cuts"))
        ring = F.size(F.filter("cuts", lambda c: c < F.col("distance")))
        ringed = durable(keyed.join(F.broadcast(cuts), "cell").select("id", "v", "cell", ring.alias("ring"), "distance", "norm"))
        #: At most PIVOTS x RINGS rows.
        found = ringed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.max("norm").alias("most")).withColumn("slices", F.ceil(F.col("n") / size).cast("int"))
        listed = found.orderBy("cell", "ring").collect()
        self.rings = Rings(pivots, listed)
        slices = F.broadcast(found.select("cell", "ring", "slices"))
        self.rows = ringed.join(slices, ["cell", "ring"]).select("cell", "ring", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), "id", "v")

    def queries(self, is_query: Column) -> DataFrame:
        """(query_id, v)"""
        return self.rows.where(is_query).groupBy(F.col("id").alias("query_id")).agg(F.min("v").alias("v"))

    def expansions(self, is_query: Column, k: int) -> tuple[DataFrame, DataFrame]:
        """(query_id, v, threshold, cell, ring, slices) of the first rings of each query, and of those that its threshold leaves."""
        rings, length = self.rings, self.length

        def expand(batches: Iterator[pa.RecordBatch], others: bool) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                for i in range(0, batch.num_rows, QUERIES):
                    part = batch.slice(i, QUERIES)
                    v = _matrix(part.column("v"), length)
                    threshold = part.column("threshold").to_numpy(zero_copy_only=False)
                    go = rings.first(v, k)
                    if others:
                        go = ~go & (rings.bounds(v) >= threshold[:, None])
                    q, r = np.nonzero(go)
                    at = pa.array(q)
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("query_id", "v", "threshold")), pa.array(rings.cell[r].astype(np.int32)), pa.array(rings.ring[r].astype(np.int32)), pa.array(rings.slices[r].astype(np.int32))], names=["query_id", "v", "threshold", "cell", "ring", "slices"])

        kind = "query_id long, v array<double>, threshold long, cell int, ring int, slices int"
        asked = durable(self.queries(is_query).withColumn("threshold", F.lit(LEAST)))
        first = asked.mapInArrow(lambda b: expand(b, False), kind)
        self.begun = durable(self.score(first, k))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"))
        reached = self.begun.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("score").alias("threshold"))
        known = asked.drop("threshold").join(reached, "query_id", "left").select("query_id", "v", F.coalesce("threshold", F.lit(LEAST)).alias("threshold"))
        return first, known.mapInArrow(lambda b: expand(b, True), kind)

    def search(self, is_query: Column, k: int) -> DataFrame:
        """(query_id, vec_id, score): candidates of each query, its k best among them."""
        _, others = self.expansions(is_query, k)
        return self.begun.unionAll(self.score(others, k))

    def score(self, expanded: DataFrame, k: int) -> DataFrame:
        """(query_id, vec_id, score): the k best rows of each slice that a query reached, none under its threshold."""
        length = self.length
        slices = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
        asking = expanded.select("cell", "ring", slices.alias("slice"), F.lit(1).alias("side"), F.col("query_id").alias("id"), "v", "threshold")
        held = self.rows.select("cell", "ring", "slice", F.lit(0).alias("side"), "id", "v", F.lit(0).cast("long").alias("threshold"))
        key = ["cell", "ring", "slice"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, ids, vectors = None, [], []
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (*key, "side")], axis=1)
                edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
                for a, b in zip(edges, edges[1:], strict=False):
                    where, side, part = tuple(keys[a, :3].tolist()), keys[a, 3], batch.slice(a, b - a)
                    if where != at:
                        at, ids, vectors = where, [], []
                    if side == 0:
                        ids.append(part.column("id").to_numpy(zero_copy_only=False))
                        vectors.append(_matrix(part.column("v"), length))
                    elif ids:
                        ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                        few = max(1, SCORES // len(ids[0]))
                        for i in range(0, b - a, few):
                            yield best(part.slice(i, few), ids[0], vectors[0])

        def best(asked: pa.RecordBatch, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
            mine, floor = (asked.column(c).to_numpy(zero_copy_only=False) for c in ("id", "threshold"))
            scores = exact(_matrix(asked.column("v"), length), vectors)
            scores[mine[:, None] == ids[None, :]] = LEAST
            order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
            top = np.take_along_axis(scores, order, 1)
            q, r = np.nonzero((top > LEAST) & (top >= floor[:, None]))
            return pa.RecordBatch.from_arrays([pa.array(mine[q]), pa.array(ids[order[q, r]]), pa.array(top[q, r])], names=["query_id", "vec_id", "score"])

        return held.unionAll(asking).repartition(*key).sortWithinPartitions(*key, "side").select(*key, "side", "id", "v", "threshold").mapInArrow(run, "query_id long, vec_id long, score long")


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


ORACLE = """
WITH e AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
