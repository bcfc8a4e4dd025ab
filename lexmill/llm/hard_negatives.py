"""Hard negatives by two-dimensional block matrix multiplication.

Rows are sorted by label and numbered, and so fall into blocks of equal size
whatever the labels are: a label that holds a third of all rows is many blocks,
many small labels share one. A block is parted along its dimensions into chunks.
The score matrix of anchors and rows is a grid of tiles: for each tile (i, j)
and chunk d the chunk of anchor block i meets that of row block j in one task,
which makes a partial tile of 64-bit scores; a shuffle by (i, j) adds the partial
tiles, and the tile is reduced at once to the best of each anchor, so no score
outlives its tile.

Anchors ask twice. First their own labels' blocks, for their positives; then all
the others, for the negatives in each positive's window. As blocks follow the
labels, no tile but those in which a label begins or ends is made twice.

Anchors are a stated query set, held against all rows in blocks. A task holds two
blocks and their tile, or the partial tiles of one place of the grid.

Contract for odd rows: rows with a null id, a null label, a null vector, or with
null or non-finite components or ones that overflow a double when scaled take no
part; vectors without components take none; vectors of another length than
the anchor's are neither its positives nor its negatives; rows that share an id
are never each other's positives or negatives, of anchors that share one the one
with the least label and vector asks, and as candidates each of them counts;
equal vectors are told apart by their ids; scores beyond 64 bits are added
exactly and then held at the bounds; an anchor without another row of its
label, or without a row in a window, has no rows there; other columns take no part,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import durable, table
from lexmill.llm.vectors import finite, matrix, products
from lexmill.operators.ranking import numbered

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: Score of a negative in hundredths of the positive's: from, to.
LOW, HIGH = 30, 90
#: Anchors and rows of a tile, dimensions of a chunk. A partial tile has 4 MB.
ANCHORS, ROWS, CHUNK = 256, 2048, 32
LEAST, MOST = -(2**63), 2**63 - 1

BLOCK = "block int, chunk int, ids binary, labels array<string>, windows array<array<array<long>>>, cells binary"
TILE = "i int, j int, chunk int, anchor_ids binary, anchor_labels array<string>, windows array<array<array<long>>>, ids binary, labels array<string>, cells binary, wide boolean"
_TILE = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("chunk", pa.int32()), ("anchor_ids", pa.binary()), ("anchor_labels", pa.list_(pa.string())), ("windows", pa.list_(pa.list_(pa.list_(pa.int64())))), ("ids", pa.binary()), ("labels", pa.list_(pa.string())), ("cells", pa.binary()), ("wide", pa.bool_())])
BEST = "anchor_id long, positive_id long, positive_score long, id long, score long"


def usable(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, label, v): rows that take part; labels as text, vectors unscaled."""
    kept = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vector_col).alias("v"))
    kept = kept.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    return kept.where(finite("v", SCALE)).select("id", "label", F.col("v").cast("array<double>").alias("v"))


def blocks(rows: DataFrame, size: int, length: int) -> DataFrame:
    """BLOCK: rows (n from 1 without gaps, id, label, v, windows) as blocks of `size` rows, each in chunks of CHUNK dimensions.

    Cells are whole doubles, row after row; ids, labels and windows come with every chunk.
    """

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("n").combine_chunks()
        column = group.column("v").combine_chunks()
        cells = matrix(column, length, SCALE)
        ids = group.column("id").to_numpy().astype(np.int64).tobytes()
        labels, windows = group.column("label").to_pylist(), group.column("windows").to_pylist()
        starts = range(0, length, CHUNK)
        return pa.table(
            {
                "block": pa.array([group.column("block")[0].as_py()] * len(starts), pa.int32()),
                "chunk": pa.array(range(len(starts)), pa.int32()),
                "ids": pa.array([ids] * len(starts), pa.binary()),
                "labels": pa.array([labels] * len(starts), pa.list_(pa.string())),
                "windows": pa.array([windows] * len(starts), pa.list_(pa.list_(pa.list_(pa.int64())))),
                "cells": pa.array([np.ascontiguousarray(cells[:, s : s + CHUNK]).tobytes() for s in starts], pa.binary()),
            }
        )

    held = rows.select(F.expr(f"cast((n - 1) div {size} as int)").alias("block"), "n", "id", "label", "v", "windows")
    return held.groupBy("block").applyInArrow(pack, BLOCK)


def tiles(anchors: DataFrame, rows: DataFrame, grid: tuple[DataFrame, DataFrame], length: int, own: bool) -> DataFrame:
    """TILE: partial tiles of the places of the grid; grid: (block, j) for anchor blocks, (block, i) for row blocks.

    own: only tiles with a pair of one label, else only those with a pair of two.
    """
    left = anchors.join(grid[0], "block").select(F.lit(0).alias("side"), F.col("block").alias("i"), "j", "chunk", "ids", "labels", "windows", "cells")
    right = rows.join(grid[1], "block").select(F.lit(1).alias("side"), "i", F.col("block").alias("j"), "chunk", "ids", "labels", "windows", "cells")

    def multiply(group: pa.Table) -> pa.Table:
        sides = dict(zip(group.column("side").to_pylist(), range(group.num_rows), strict=True))
        if len(sides) < 2:
            return _TILE.empty_table()
        a, b = (group.slice(sides[s], 1).to_pylist()[0] for s in (0, 1))
        mine, theirs = set(a["labels"]), set(b["labels"])
        if not (mine & theirs if own else len(mine | theirs) > 1):
            return _TILE.empty_table()
        width = min(CHUNK, length - CHUNK * a["chunk"])
        cells = products(*(np.frombuffer(x["cells"], dtype=np.float64).reshape(-1, width) for x in (a, b)))
        most = cells.dtype == object or np.abs(cells).max(initial=0) > 2**62 // (-(-length // CHUNK))
        packed = " ".join(map(str, cells.ravel().tolist())).encode() if most else cells.tobytes()
        first = a["chunk"] == 0
        row = [a["i"], a["j"], a["chunk"], a["ids"], a["labels"] if first else None, a["windows"] if first else None, b["ids"], b["labels"] if first else None, packed, bool(most)]
        return pa.table([pa.array([x], f.type) for x, f in zip(row, _TILE, strict=True)], schema=_TILE)

    return left.unionAll(right).groupBy("i", "j", "chunk").applyInArrow(multiply, TILE)


def added(group: pa.Table) -> tuple[dict, np.ndarray]:
    """The labels, ids and windows of a place of the grid, and its scores: the sum of its partial tiles, held at 64 bits."""
    total, head, wide = None, None, any(group.column("wide").to_pylist())
    for at in range(group.num_rows):
        row = group.slice(at, 1).to_pylist()[0]
        if row["chunk"] == 0:
            head = {k: v for k, v in row.items() if k != "cells"}
        cells = np.array([int(x) for x in row["cells"].split()], dtype=object) if row["wide"] else np.frombuffer(row["cells"], dtype=np.int64)
        cells = cells.astype(object) if wide else cells
        total = cells.copy() if total is None else total + cells
    if wide:
        total = np.array([max(LEAST, min(MOST, x)) for x in total], dtype=np.int64)
    head["anchor_ids"], head["ids"] = (np.frombuffer(head[k], dtype=np.int64) for k in ("anchor_ids", "ids"))
    return head, total.reshape(len(head["anchor_ids"]), len(head["ids"]))


def first_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    # ~ reverses the order of integers and can't overflow
    return at[np.lexsort((ids[at], ~scores[at]))[:k]]


def reduced(partial: DataFrame, k: int, own: bool) -> DataFrame:
    """BEST: of each tile the k best rows of each anchor (own label) or of each window of it (other labels)."""
    kind = pa.schema([(c.split()[0], pa.int64()) for c in BEST.split(", ")])

    def reduce(group: pa.Table) -> pa.Table:
        head, scores = added(group)
        names, codes = np.unique(np.array([*head["anchor_labels"], *head["labels"]], dtype=object).astype(str), return_inverse=True)
        mine, theirs = codes[: len(scores)], codes[len(scores) :]
        ids, out = head["ids"], [[] for _ in kind]
        for r, anchor in enumerate(head["anchor_ids"].tolist()):
            open_ = np.flatnonzero(((theirs == mine[r]) == own) & (ids != anchor))
            for positive, score, low, high in [(None, None, LEAST, MOST)] if own else head["windows"][r]:
                at = open_[(scores[r, open_] >= low) & (scores[r, open_] <= high)]
                at = at[first_of(scores[r, at], ids[at], k)]
                for column, x in zip(out, ([anchor] * len(at), [positive] * len(at), [score] * len(at), ids[at].tolist(), scores[r, at].tolist()), strict=True):
                    column += x
        return pa.table([pa.array(x, pa.int64()) for x in out], schema=kind)

    return partial.groupBy("i", "j").applyInArrow(reduce, BEST)


def window_of(score: Column, low: int, high: int) -> tuple[Column, Column]:
    """Least and greatest whole n with low * score <= 100 * n <= high * score; decimals hold the products."""
    wide = score.cast("decimal(38,0)")
    up = F.ceil(wide * low / F.lit(100).cast("decimal(3,0)"))
    down = F.floor(wide * high / F.lit(100).cast("decimal(3,0)"))
    clip = lambda c: F.least(F.greatest(c.cast("decimal(38,0)"), F.lit(LEAST).cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    return clip(up), clip(down)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); is_anchor is over column id, label over rows."""
    kept = durable(usable(rows, id_col, vector_col, label).withColumn("n_cells", F.size("v")))
    found = None
    for (length,) in kept.select("n_cells").distinct().orderBy("n_cells").toLocalIterator():
        mined = of_length(kept.where(F.col("n_cells") == length).drop("n_cells"), is_anchor, length, positives, negatives, low, high)
        found = mined if found is None else found.unionAll(mined)
    if found is None:
        found = rows.sparkSession.createDataFrame([], BEST)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def of_length(rows: DataFrame, is_anchor: Column, length: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """BEST of all windows for rows (id, label, v) of one length."""
    none = F.lit(None).cast("array<array<long>>")
    ranked = numbered(rows, "label", "id", "v")
    asking = rows.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    asking = durable(numbered(asking, "label", "id"))
    all_rows = durable(blocks(ranked.withColumn("windows", none), ROWS, length))
    n_rows, n_anchors = ((df.select("block").distinct().count()) for df in (all_rows, asking.select(F.expr(f"(n - 1) div {ANCHORS}").alias("block"))))

    # Own labels: an anchor block meets the row blocks over which its labels reach.
    reach = ranked.groupBy("label").agg(F.expr(f"cast((min(n) - 1) div {ROWS} as int)").alias("lo"), F.expr(f"cast((max(n) - 1) div {ROWS} as int)").alias("hi"))
    places = asking.select(F.expr(f"cast((n - 1) div {ANCHORS} as int)").alias("i"), "label").distinct().join(reach, "label")
    near = durable(places.select("i", F.explode(F.sequence("lo", "hi")).alias("j")).distinct())
    grid = near.select(F.col("i").alias("block"), "j"), near.select(F.col("j").alias("block"), "i")
    same = reduced(tiles(blocks(asking.withColumn("windows", none), ANCHORS, length), all_rows, grid, length, True), positives, True)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    best = same.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    up, down = window_of(F.col("score"), low, high)
    windows = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.array("id", "score", up, down)).alias("windows"))
    asked = durable(asking.join(windows, "id", "left").withColumn("windows", F.coalesce("windows", F.array().cast("array<array<long>>"))))

    # Other labels: every anchor block meets every row block.
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias(name)
    spark = rows.sparkSession
    grid = (spark.range(n_anchors).select(F.col("id").cast("int").alias("block"), every(n_rows, "j")), spark.range(n_rows).select(F.col("id").cast("int").alias("block"), every(n_anchors, "i")))
    return reduced(tiles(blocks(asked, ANCHORS, length), all_rows, grid, length, False), negatives, False)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, moved)


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT s.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY s.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank,
         s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM s JOIN p ON s.anchor_id = p.anchor_id WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
