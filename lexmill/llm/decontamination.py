"""Benchmark decontamination: suffix arrays over the training words find what benchmark items share with them.

Documents stream through each partition in blocks of bounded size; a block is a
shard with a suffix array over its words. Words that no benchmark item has are
one symbol that nothing matches, and suffixes that begin with a pair of words
which no item has in a row are left out of the array: no test suffix could reach
them. The array is sorted by prefix doubling.

Every suffix of every item that holds a window is binary-searched in the array:
word by word the interval of training suffixes that share its beginning narrows,
until it is empty or the window is shared. Suffixes with equal windows are one
search; they are sorted once, on the driver. Each place of an interval holds an
item's window.

Places in a document and places in items are never paired with each other. The
windows that both sides share become symbols; the suffixes of both over these
symbols are ranked together by prefix doubling, and the longest match that
begins at a word is the longer of the common beginnings with the items' suffixes
that stand next to it in this order. Matches that a longer one contains are left
out, so they are at most as many as the words of the document, each with its
place in one item that holds it, however often words repeat on both sides.

The benchmark is the stated query set. Its suffixes are broadcast in blocks of
bounded size; one pass over the documents holds each shard against one block
after the other, and a worker keeps one block at a time in memory.

Contract for odd rows: a null text has no words; items without words match
nothing; a null item_id is left out of the ids and their number, but its passages count
as hits; items that share an id are one in the ids; repeated documents each get
their row; texts of any length are read whole (a text is never parted over two
shards); columns of docs are kept, but those with the names of ADDED are
replaced; an empty benchmark leaves all clean, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lexmill.llm.common import table, unclashed, words_of

WINDOW = 10
#: Of a shard: characters. Of a block of the benchmark: UTF-8 bytes.
SHARD_CHARS, BLOCK_BYTES = 8_000_000, 4_000_000


class Items:
    """A block of benchmark items: the distinct windows that their suffixes begin with, sorted, and where each stands."""

    def __init__(self, items: list[tuple], window: int):
        texts = [(key, words_of(text)) for key, text in items]
        texts = [(key, words) for key, words in texts if words]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in texts for w in words}), 1)}
        self.keys, self.window = [key for key, _ in texts], window
        ids = [np.array([self.vocabulary[w] for w in words], dtype=np.int64) for _, words in texts]
        depths = [min(window, len(x)) for x in ids]
        rows = [np.zeros((0, window), np.int32), *(np.pad(np.lib.stride_tricks.sliding_window_view(x, d), ((0, 0), (0, window - d))) for x, d in zip(ids, depths, strict=True))]
        suffixes = np.concatenate(rows).astype(np.int32)
        owner = np.repeat(np.arange(len(ids)), [len(x) - d + 1 for x, d in zip(ids, depths, strict=True)]).astype(np.int64)
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x) - d + 1) for x, d in zip(ids, depths, strict=True))])
        #: Sorted distinct windows; window w stands at owner, place [of[w], of[w + 1]).
        self.windows, inverse = np.unique(suffixes, axis=0, return_inverse=True)
        order = np.argsort(inverse.ravel(), kind="stable")
        self.of = np.searchsorted(inverse.ravel()[order], np.arange(len(self.windows) + 1))
        self.owner, self.place = owner[order], place[order]
        self.depth = (self.windows > 0).sum(1)
        self.single = np.unique(self.windows[self.depth == 1, 0])
        #: Where each item begins if all stand one after the other, a gap between any two.
        self.begin = np.cumsum(np.array([0, *(len(x) + 1 for x in ids)], dtype=np.int64))
        n = len(self.vocabulary) + 1
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(x[:-1] * n + x[1:] for x in ids)]))

    def find(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the shard, window that stands there), by place. Windows of items with fewer words than a window may stand where others do."""
        none = (np.zeros(0, np.int64),) * 2
        if not len(words) or not len(self.windows):
            return none
        n = len(self.vocabulary) + 1
        tail = np.r_[np.where(doc[1:] == doc[:-1], words[1:], 0), 0]
        at = np.flatnonzero((words > 0) & (np.isin(words, self.single) | ((tail > 0) & np.isin(words * n + tail, self.pairs))))
        if not len(at):
            return none
        # The words that follow each suffix, none beyond an unknown word or another document's.
        key = np.zeros((len(at), self.window), dtype=np.int32)
        alive = np.ones(len(at), dtype=bool)
        for k in range(self.window):
            to = np.minimum(at + k, len(words) - 1)
            alive &= (at + k < len(words)) & (doc[to] == doc[at]) & (words[to] > 0)
            key[:, k] = np.where(alive, words[to], 0)
        order = suffix_array(key)
        lo, hi = intervals(key[order], self.windows, self.depth)
        found = np.flatnonzero(hi > lo)
        window, mine = spread(found, lo[found], hi[found])
        place = at[order[mine]]
        sort = np.lexsort((window, place))
        return place[sort], window[sort]

    def spans(self, place: np.ndarray, window: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first word, words, item, first word in the item): the longest match at each place of find() that no match from the place before contains."""
        whole = self.depth[window] == self.window
        short = ~whole
        first = self.of[window[short]]
        out = [(place[short], self.depth[window[short]], self.owner[first], self.place[first])]
        if whole.any():
            a, symbol = place[whole], window[whole]
            used = np.unique(symbol)
            item_symbol, stands = spread(used, self.of[used], self.of[used + 1])
            # Positions of all texts one after the other, a gap between any two.
            owner, at = self.owner[stands], self.place[stands]
            position = self.begin[owner] + at
            order = np.argsort(position, kind="stable")
            position, item_symbol, owner, at = position[order], item_symbol[order], owner[order], at[order]
            mine = a + doc[a]
            n, other = longest_beginnings(np.r_[mine, position + mine[-1] + 2], np.r_[symbol, item_symbol], len(mine))
            end = a + n
            new = np.r_[True, (mine[1:] != mine[:-1] + 1) | (end[1:] > end[:-1])]
            out.append((a[new], n[new] - 1 + self.window, owner[other[new]], at[other[new]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def longest_beginnings(position: np.ndarray, symbol: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first n suffixes: the symbols that the longest common beginning with any of the others has, and which other.

    A suffix runs as long as positions follow each other. Sorting by prefix doubling takes as many rounds as the
    longest run has binary digits; a rank of 4 bytes is kept for each suffix and round.
    """
    m = len(symbol)
    ranks = [np.unique(symbol, return_inverse=True)[1].ravel().astype(np.int32) + 1]
    ends = np.flatnonzero(np.r_[position[1:] != position[:-1] + 1, True])
    left = ends[np.searchsorted(ends, np.arange(m))] - np.arange(m) + 1
    while (step := 1 << (len(ranks) - 1)) < left.max():
        second = np.where(left > step, ranks[-1][np.minimum(np.arange(m) + step, m - 1)], 0)
        ranks.append(np.unique(ranks[-1].astype(np.int64) * (m + 1) + second, return_inverse=True)[1].ravel().astype(np.int32) + 1)
    order = np.lexsort((np.arange(m), ranks[-1]))
    others = np.where(order >= n, np.arange(m), -1)
    before = np.maximum.accumulate(others)
    after = m - 1 - np.maximum.accumulate(np.where(order >= n, m - 1 - np.arange(m), -1)[::-1])[::-1] if n < m else np.full(m, m)
    at = np.empty(m, np.int64)
    at[order] = np.arange(m)
    best, which = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for beside in (before[at[:n]], after[at[:n]]):
        there = (beside >= 0) & (beside < m)
        x, y = np.flatnonzero(there), order[beside[there]]
        common = _common(ranks, left, x.copy(), y.copy())
        more = common > best[x]
        best[x[more]], which[x[more]] = common[more], y[more] - n
    return best, which


def _common(ranks: list[np.ndarray], left: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Symbols that suffixes x and y have in common from their beginning, side by side."""
    total, live = np.zeros(len(x), np.int64), np.ones(len(x), dtype=bool)
    for k in range(len(ranks) - 1, -1, -1):
        same = live & (ranks[k][x] == ranks[k][y])
        more = np.where(same, np.minimum(1 << k, left[x]), 0)
        live &= ~(same & (np.minimum(left[x], left[y]) <= 1 << k))  # one of them ends there
        total += more
        x, y = np.where(live, x + more, x), np.where(live, y + more, y)
    return total


def spread(labels: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number from lo to hi of each range, beside its label."""
    n = hi - lo
    return np.repeat(labels, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def suffix_array(keys: np.ndarray) -> np.ndarray:
    """Order of the suffixes whose first words are the rows of keys, by prefix doubling.

    Ranks by the first 2^k words pair up with those of the 2^k words after them
    to ranks by the first 2^(k+1) words.
    """
    ranks = list(keys.T)
    while len(ranks) > 1:
        merged = []
        for i in range(0, len(ranks), 2):
            if i + 1 < len(ranks):
                span = int(ranks[i + 1].max(initial=0)) + 1
                merged.append(np.unique(ranks[i] * span + ranks[i + 1], return_inverse=True)[1].ravel())
            else:
                merged.append(ranks[i])
        ranks = merged
    return np.argsort(ranks[0], kind="stable")


def intervals(suffixes: np.ndarray, tests: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each test the interval of the sorted suffixes that share its first `depth` words; empty (lo = hi) if none does."""
    lo, hi = np.zeros(len(tests), np.int64), np.full(len(tests), len(suffixes), np.int64)
    live = np.arange(len(tests))
    for k in range(suffixes.shape[1]):
        live = live[(depth[live] > k) & (hi[live] > lo[live])]
        if not len(live):
            break
        column, want = suffixes[:, k], tests[live, k]
        a, b = lo[live], hi[live]
        lo[live], hi[live] = bisect(column, want, a, b, False), bisect(column, want, a, b, True)
    return lo, hi


def bisect(column: np.ndarray, want: np.ndarray, lo: np.ndarray, hi: np.ndarray, after: bool) -> np.ndarray:
    """For each range of the column, sorted inside it, the first place at or after `want` (after: beyond it)."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        middle = (lo + hi) // 2
        there = column[np.minimum(middle, len(column) - 1)]
        right = open_ & ((there <= want) if after else (there < want))
        lo, hi = np.where(right, middle + 1, lo), np.where(open_ & ~right, middle, hi)
    return lo


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The benchmark, a bounded block at a time."""
    held, size = [], 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        held.append((row[0], row[1]))
        size += len((row[1] or "").encode("utf-8", "surrogatepass")) + 16
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


MATCH = StructType([StructField("item_id", StringType()), StructField("first", LongType()), StructField("item_first", LongType()), StructField("words", LongType())])
FOUND = StructType([StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("longest_match", LongType()), StructField("item_ids", ArrayType(StringType())), StructField("matches", ArrayType(MATCH))])
#: Names of the columns that contamination() adds.
ADDED = (*FOUND.names, "n_items", "items_sha256", "contaminated")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, n_hit, n_items, longest_match (words), item_ids (sorted), items_sha256, contaminated and matches.

    matches: item_id, first word in the document, first word in the item and
    words of every verbatim match of at least a window that no longer one
    contains, by place; where several items hold it, one of them.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    blocks = [docs.sparkSession.sparkContext.broadcast(Items(b, window)) for b in _blocks(benchmark, item_col, item_text)]
    kept = docs.drop(*(c for c in ADDED if c != text_col))
    columns = kept.columns
    types = [to_arrow_type(f.dataType) for f in FOUND]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                found = scan_shard(part.column(text_col).to_pylist(), blocks)
                new = [pa.array(list(x), t) for x, t in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in columns), *new], names=[*columns, *FOUND.names])

    out = kept.mapInArrow(run, StructType([*kept.schema.fields, *FOUND.fields]))
    return out.select(
        "*",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def pieces(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about SHARD_CHARS."""
    start, size = 0, 0
    for i, n in enumerate(pc.utf8_length(batch.column(text_col)).to_pylist()):
        size += n or 0
        if size >= SHARD_CHARS:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _opened(block) -> Items:
    """A broadcast block; of several, only the one in use stays in memory."""
    return block.value if hasattr(block, "value") else block


def scan_shard(texts: list[str | None], blocks: list) -> list[tuple]:
    """(n_words, n_hit, longest match, ids of matched items, matches) of each text of a shard."""
    split = [words_of(text) for text in texts]
    sizes = np.array([len(p) for p in split], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(split)), sizes)
    spans: list[list[tuple]] = [[] for _ in texts]
    ids: list[set[str]] = [set() for _ in texts]
    for block in blocks:
        items = _opened(block)
        get = items.vocabulary.get
        words = np.array([get(w, 0) for part in split for w in part], dtype=np.int64)
        place, window = items.find(words, doc)
        if len(place):
            names = [None if k is None else str(k) for k in items.keys]
            n = len(items.windows)
            held = np.unique(doc[place] * n + window)
            of, stands = spread(held // n, items.of[held % n], items.of[held % n + 1])
            for i in np.unique(of * len(names) + items.owner[stands]).tolist():
                if names[i % len(names)] is not None:
                    ids[i // len(names)].add(names[i % len(names)])
            for a, m, i, p in zip(*(x.tolist() for x in items.spans(place, window, doc)), strict=True):
                spans[doc[a]].append((a - int(begin[doc[a]]), -m, p, names[i]))
        if len(blocks) > 1 and hasattr(block, "_value"):
            del items, get, block._value  # read again for the next shard
    out = []
    for size, found, keys in zip(sizes.tolist(), spans, ids, strict=True):
        hit, reached, matches = 0, 0, []
        found.sort(key=lambda m: (m[0], m[1], m[3] or "", m[2]))
        for a, m, p, key in found:
            if a - m > reached:
                hit += a - m - max(a, reached)
                reached = a - m
                matches.append({"item_id": key, "first": a, "item_first": p, "words": -m})
        out.append((size, hit, max((m["words"] for m in matches), default=0), sorted(keys), matches))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the affected documents, same columns."""
    clean = lambda plain, text: contamination(plain, benchmark, text_col=text).where(~F.col("contaminated")).select(*plain.columns)
    return unclashed(docs, clean, text_col)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match")


#: Windows as strings. The words that a window's places cover are counted once each; windows that follow each other on a diagonal are one match.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, text, row_number() OVER () AS k FROM documents
), w AS (
  SELECT k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bn AS (
  SELECT item_id, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM bn)
), bp AS (
  SELECT item_id, n, i AS p, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM bn)
), ns AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT k, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, ns WHERE len(ws) >= n)
), m AS (
  SELECT dw.k, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), mp AS (
  SELECT dw.k, dw.i, dw.n, bp.item_id, bp.p FROM dw JOIN bp ON dw.n = bp.n AND dw.win = bp.win
), h AS (
  SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM m) GROUP BY k
), runs AS (
  SELECT k, max(hi - lo) AS longest FROM (
    SELECT k, item_id, i - p AS diagonal, run, min(i) AS lo, max(i + n) AS hi
    FROM (SELECT *, i - row_number() OVER (PARTITION BY k, item_id, i - p ORDER BY i) AS run FROM mp) GROUP BY k, item_id, i - p, run
  ) GROUP BY k
), it AS (
  SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY k
)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(runs.longest, 0) AS BIGINT) AS longest_match
FROM w LEFT JOIN h ON w.k = h.k LEFT JOIN it ON w.k = it.k LEFT JOIN runs ON w.k = runs.k
"""
