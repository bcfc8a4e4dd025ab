"""Centroid clustering over integer vectors, exact in every round, screened in float32.

Each round streams the vectors once against all centroids. A product of float32
matrices gives every inner product x.c with an error of at most

    gamma |x| |c|,  gamma = m u / (1 - m u),  m = length + 2,  u = 2^-24

whatever the order of its additions (each component is rounded once, each
product and each sum once; Cauchy's inequality bounds the sum of absolute
products). With |x|^2 left out, which is the same for all centroids, each
distance becomes an interval around |c|^2 - 2 x.c. Centroids whose interval
begins beyond the least end of any can't be nearest. Where one stays, it is the
nearest; where several intervals overlap, their distances are computed again in
exact integers, and the lowest number wins ties. Vectors or centroids too long
for float32 get the interval ((|c| - |x|)^2, (|c| + |x|)^2) instead.

A task sends one row of sums for each centroid and component, split into limbs,
so any size of sum is exact; Spark adds these up, and the driver holds nothing
but the centroids (k x length integers, closure of the next round). Vectors are
written once to the shared folder; rounds read them there.

Contract for odd rows: null vectors, those of another length, with null or
non-finite components or components that overflow a double when scaled take no
part; rows without an id do, but come last in the choice of first centroids; rows
that share an id are each a vector (as first centroids the smaller vector comes
first); equal vectors get equal clusters, all ties go to the smaller number;
with fewer vectors than k there are as many centroids as vectors; distances
beyond 64 bits are compared exactly and returned held at the bound; columns of
other names take no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import durable, table
from lexmill.llm.vectors import LIMB, columns_sum, finite, held, limbs, matrix, squares

LENGTH, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Vectors that are held against the centroids at a time.
ROWS = 4096
#: Beyond this length vectors leave float32.
FAR = 1e17


class Centroids:
    """Centroids as exact integers, with what the screening needs of them."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        doubles = np.array([[float(x) for x in row] for row in rows], dtype=np.float64)
        #: Doubles hold them exactly up to 2^53; beyond, all that is exact is done with Python integers.
        self.exact = doubles if all(abs(x) < 2**53 for row in rows for x in row) else np.array(rows, dtype=object)
        with np.errstate(over="ignore"):
            self.norms = np.sqrt((doubles**2).sum(1))
        self.near = self.norms < FAR
        self.single = np.where(self.near[:, None], doubles, 0).astype(np.float32)
        self.squared = np.where(self.near, (np.where(self.near[:, None], doubles, 0) ** 2).sum(1), 0)

    def screen(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors x centroids: those whose interval reaches below the least end of any interval of the vector."""
        m = (vectors.shape[1] + 2) * 2.0**-24
        gamma = m / (1 - m)
        with np.errstate(over="ignore", invalid="ignore"):
            norms = np.sqrt((vectors**2).sum(1))
        near = norms < FAR
        inside = np.where(near[:, None], vectors, 0)
        products = (inside.astype(np.float32) @ self.single.T).astype(np.float64)
        short = np.where(near, norms, 0)[:, None] * np.where(self.near, self.norms, 0)[None, :]
        middle = self.squared[None, :] - 2 * products
        # Twice the product's error, and generously that of the norms and of the sums in doubles.
        error = 2 * gamma * short * (1 + 1e-9) + 1e-12 * (self.squared[None, :] + 2 * short) + 1e-9
        lo, hi = middle - error, middle + error
        if not near.all() or not self.near.all():
            with np.errstate(over="ignore", invalid="ignore"):
                least = np.nan_to_num((np.abs(self.norms[None, :] - norms[:, None]) * (1 - 1e-9)) ** 2, nan=0.0, posinf=np.finfo(float).max)
                most = ((self.norms[None, :] + norms[:, None]) * (1 + 1e-9)) ** 2
            far = ~near[:, None] | ~self.near[None, :]
            own = np.where(near, norms, 0)[:, None] ** 2  # back to whole distances, so that both kinds compare
            lo, hi = np.where(far, least * (1 - 1e-9), (lo + own) * (1 - 1e-9) - error), np.where(far, most * (1 + 1e-9), (hi + own) * (1 + 1e-9) + error)
        return lo <= hi.min(axis=1)[:, None]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest centroid, exact squared distance, distances computed exactly to decide) of each vector."""
        open_ = self.screen(vectors)
        nearest = open_.argmax(axis=1)
        several = np.flatnonzero(open_.sum(1) > 1)
        which, c = np.nonzero(open_[several])
        if len(several):
            exact = squares(vectors[several[which]], self.exact[c])
            order = np.lexsort((c, exact, which)) if exact.dtype != object else np.array(sorted(range(len(c)), key=lambda i: (which[i], exact[i], c[i])))
            first = order[np.r_[True, which[order][1:] != which[order][:-1]]]
            nearest[several] = c[first]
        return nearest, squares(vectors, self.exact[nearest]), len(c)


def usable(vectors: DataFrame, length: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors that take part, still unscaled."""
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull() & (F.size("v") == length))
    return kept.where(finite("v", scale)).select("id", F.col("v").cast("array<double>").alias("v"))


def first_centroids(rows: DataFrame, k: int, length: int, scale: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of their ids."""
    hashed = rows.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256))
    found = hashed.orderBy(F.asc_nulls_last("hash"), "v").limit(k).collect()
    return [[int(x) for x in np.floor(np.array(r["v"], dtype=np.float64) * scale).tolist()] for r in found]


def totals(rows: DataFrame, centroids: Centroids, length: int, scale: int) -> dict[tuple[int, int], int]:
    """(cluster, component): sum over the vectors nearest to that centroid; component -1 counts them, -2 those decided exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                v = matrix(batch.column("v").slice(i, ROWS), length, scale)
                nearest, _, again = centroids.assign(v)
                for c in np.unique(nearest).tolist():
                    own = v[nearest == c]
                    for j, x in enumerate([*columns_sum(own), len(own)]):
                        at = (c, j if j < length else -1)
                        sums[at] = sums.get(at, 0) + x
                sums[0, -2] = sums.get((0, -2), 0) + again
        parts = [(c, j, place, x) for (c, j), total in sums.items() for place, x in limbs(total)]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["c", "j", "place", "x"])

    added = rows.mapInArrow(run, "c int, j int, place int, x long").groupBy("c", "j", "place").agg(F.sum("x").alias("x"))
    out: dict[tuple[int, int], int] = {}
    for r in added.collect():  # at most k x (length + 2) numbers of a few limbs
        out[r["c"], r["j"]] = out.get((r["c"], r["j"]), 0) + (r["x"] << (LIMB * r["place"]))
    return out


def fit(rows: DataFrame, k: int = K, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE, seed: int = SEED) -> list[list[int]]:
    """Centroids after the rounds; rows as usable() gives them."""
    found = first_centroids(rows, k, length, scale, seed)
    for _ in range(rounds if found else 0):
        sums = totals(rows, Centroids(found), length, scale)
        moved = [[sums[c, j] // n for j in range(length)] if (n := sums.get((c, -1), 0)) else row for c, row in enumerate(found)]
        if moved == found:
            break  # every further round would give the same
        found = moved
    return found


def assigned(rows: DataFrame, centroids: list[list[int]], length: int = LENGTH, scale: int = SCALE) -> DataFrame:
    """(id, cluster, distance, square): distance as long, held at the bound, and as the digits of the exact number."""
    from pyspark.sql.pandas.types import to_arrow_type

    near, kind = Centroids(centroids), to_arrow_type(rows.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                nearest, distance, _ = near.assign(matrix(part.column("v"), length, scale))
                longs = distance if distance.dtype != object else np.array([held(x) for x in distance], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id").cast(kind), pa.array(nearest.astype(np.int32)), pa.array(longs), pa.array([str(x) for x in distance.tolist()] if distance.dtype == object else [None] * len(longs), pa.string())], names=["id", "cluster", "distance", "square"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long, square string")


def inertias(found: DataFrame) -> DataFrame:
    """(cluster, cluster_inertia, inertia): sums of the distances, held at 64 bits; one row for each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in batches:
            for c, d, s in zip(*(batch.column(n).to_pylist() for n in ("cluster", "distance", "square")), strict=True):
                sums[c] = sums.get(c, 0) + (d if s is None else int(s))
        parts = [(c, place, x) for c, total in sums.items() for place, x in limbs(total)]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "place", "x"])

    sums: dict[int, int] = {}
    for r in found.mapInArrow(run, "cluster int, place int, x long").groupBy("cluster", "place").agg(F.sum("x").alias("x")).collect():
        sums[r["cluster"]] = sums.get(r["cluster"], 0) + (r["x"] << (LIMB * r["place"]))
    every = held(sum(sums.values()))
    return found.sparkSession.createDataFrame([(c, held(x), every) for c, x in sums.items()], "cluster int, cluster_inertia long, inertia long")


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256) of every vector that takes part.

    centroid: its components as decimal integers, joined by commas.
    """
    rows = durable(usable(vectors, length, scale, id_col, vector_col))
    centroids = fit(rows, k, rounds, length, scale, seed)
    found = durable(assigned(rows, centroids, length, scale)) if centroids else rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit("").alias("square"))
    texts = [",".join(map(str, row)) for row in centroids]
    listed = vectors.sparkSession.createDataFrame([(c, t, hashlib.sha256(t.encode()).hexdigest()) for c, t in enumerate(texts)], "cluster int, centroid string, centroid_sha256 string")
    per = inertias(found).join(listed, "cluster")  # k rows
    return found.drop("square").join(F.broadcast(per), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings")).drop("centroid")


def oracle(k: int = K, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE, seed: int = SEED) -> str:
    """SQL of the whole clustering: one pair of common tables for each round."""
    steps = [
        f"""e AS (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS HUGEINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {length} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM e)
  QUALIFY c < {k}
)""",
    ]
    square = "list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS (
  SELECT e.r, e.vec_id, e.v, c.c, {square} AS d FROM e, c{i} c
  QUALIFY row_number() OVER (PARTITION BY e.r ORDER BY d, c.c) = 1
)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (
    SELECT c, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n
    FROM (SELECT c, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS j FROM a{i}) GROUP BY c, j
  ) GROUP BY c
), c{i + 1} AS (
  SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON c{i}.c = m{i}.c
)"""
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string([CAST(x AS VARCHAR) for x in c.v], ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c
"""
    )


ORACLE = oracle()
