"""Line dedup: suffix arrays over line-id sequences by distributed prefix doubling.

A document is a sequence of line ids (128 bits of hash of its trimmed lines;
blank ones left out); a suffix starts at a line and ends with its document.
Ranks of suffixes by their first 1, 2, 4, ... lines are built round by round:
the ranks at a line and 2^k lines on pair up, distinct pairs are counted (partial
counts first, so a line that a third of all rows hold is one row for each task),
sorted over the cluster and numbered in that order.

Suffixes that share their first d lines are an interval of the suffix array
whose longest common prefix is at least d. Two ranks of 2^k lines that overlap
fix every depth d from 2^k + 1 to 2^(k+1), so the intervals of all depths are
found, not of powers of two alone. The first place of an interval, by (id, line),
is the original, its other places are later copies. Copies of one document that
overlap or touch are joined to maximal runs, and the lines of these go, with the
blank lines inside.

Every run of any length with at least `min_words` words that occurs earlier is
deleted. Windows that say more than that aren't compared: if a window has
`min_words` words without its first line and also without its last line, those
two shorter windows cover it and are copies wherever it is one. What is left has
under `min_words` words but for one end line, so at most `min_words` lines: the
depths that the rounds reach. Each part of such a window is one too, so a
window's ranks exist when it is asked for.

Words of a line: runs without blanks, or half the characters of scripts that are
written without blanks, if that is more; one at least. Contract for odd rows:
null texts have no lines and stay null; a document's own repeats count like
those of others; rows that repeat id and text are one document (all stay, cut
alike); of equal places in two texts of one id the one with the smaller hash is
first; a null id comes before all others; texts and lines may be of any length;
other columns are kept, whatever their names, except __lines and __removed,
which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import durable, rows_of, table, unclashed

MIN_WORDS = 8
#: Scripts without blanks between words.
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
#: Lines that a task hands on at a time.
LINES = 50_000

_unspaced = regex.compile(UNSPACED)


def words_in(line: str) -> int:
    """Words of a line that isn't blank."""
    n = len(line.encode("utf-8", "surrogatepass").split())
    return max(1, n if line.isascii() else max(n, len(_unspaced.findall(line)) // 2))


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dk, j, i, c, e, h0, h1): line j of those that aren't blank, its place i among all lines, the words before and up to its end, both halves of its id."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "dk", "j", "i", "c", "e", "h0", "h1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of, n = [], [], 0
            for row, text in enumerate(batch.column("text").to_pylist()):
                before = j = 0
                for i, line in enumerate(text.split("\n") if text else ()):
                    if not (line := line.strip(" ")):
                        continue
                    digest, after = xxhash.xxh128_digest(line.encode("utf-8", "surrogatepass")), before + words_in(line)
                    of.append(row)
                    rows.append((j, i, before, after, digest))
                    before, j, n = after, j + 1, n + 1
                    if n >= LINES:
                        yield record(batch, of, rows)
                        rows, of, n = [], [], 0
            yield record(batch, of, rows)

    def record(batch: pa.RecordBatch, of: list, rows: list) -> pa.RecordBatch:
        j, i, c, e, digests = zip(*rows, strict=True) if rows else ((),) * 5
        halves = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
        at = pa.array(of, pa.int64())
        numbers = [pa.array(x, t) for x, t in ((j, pa.int32()), (i, pa.int32()), (c, pa.int64()), (e, pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("dk").take(at), *numbers, pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=names)

    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("dk"), F.col(text_col).alias("text"))
    return keyed.mapInArrow(run, f"id {kind}, dk long, j int, i int, c long, e long, h0 long, h1 long")


def place():
    return F.struct("id", "dk", "j")


#: Of a window: document, first line, places of its first and last line, words before it, up to its end, of its first and of its last line.
WINDOW = ("id", "dk", "j", "i", "end", "c", "e", "head", "tail")


def first_round(lines: DataFrame) -> DataFrame:
    """Windows of one line that repeats: WINDOW, rank and the interval's first place."""
    #: Written first, so that the join reads plain exchanges and a line that very many documents hold is split over tasks.
    intervals = durable(lines.groupBy("h0", "h1").agg(F.count("*").alias("n"), F.min(place()).alias("first")).where("n > 1").drop("n"))
    ranked = intervals.repartitionByRange("h0", "h1").sortWithinPartitions("h0", "h1").withColumn("rank", F.monotonically_increasing_id())
    words = F.col("e") - F.col("c")
    return durable(lines.join(durable(ranked), ["h0", "h1"]).select("id", "dk", "j", "i", F.col("i").alias("end"), "c", "e", words.alias("head"), words.alias("tail"), "rank", "first"))


def next_round(ranked: DataFrame, size: int, depths: list[int], min_words: int) -> DataFrame:
    """Windows of each of the depths (size < depth <= 2 * size) that repeat, from the ranks of `size` lines: WINDOW, depth, rank, first place."""
    by = Window.partitionBy("id", "dk").orderBy("j")
    later = F.struct("end", "e", "tail", "rank")
    ahead = [F.struct(F.lit(d).alias("depth"), F.last(later).over(by.rangeBetween(d - size, d - size)).alias("to")) for d in depths]
    words = F.col("e") - F.col("c")
    paired = ranked.select("id", "dk", "j", "i", "c", "head", F.col("rank").alias("r"), F.array(*ahead).alias("xs"))
    paired = paired.select("id", "dk", "j", "i", "c", "head", "r", F.explode("xs").alias("x")).where("x.to is not null")
    paired = paired.select("id", "dk", "j", "i", F.col("x.to.end").alias("end"), "c", F.col("x.to.e").alias("e"), "head", F.col("x.to.tail").alias("tail"), F.col("x.depth").alias("depth"), "r", F.col("x.to.rank").alias("next"))
    paired = durable(paired.where(F.least(words - F.col("head"), words - F.col("tail")) < min_words))
    key = ["depth", "r", "next"]
    intervals = durable(paired.groupBy(key).agg(F.count("*").alias("n"), F.min(place()).alias("first")).where("n > 1").drop("n"))
    #: Sorted over the cluster, so the numbers rise with (rank, next): the order of the suffix array at this depth.
    numbered = durable(intervals.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("rank", F.monotonically_increasing_id()))
    return durable(paired.join(numbered, key).select(*WINDOW, "depth", "rank", "first"))


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dk, j, i, end, lines, first) of the windows with `min_words` words that have an earlier occurrence."""
    copy = (place() > F.col("first")) & (F.col("e") - F.col("c") >= min_words)
    columns = ("id", "dk", "j", "i", "end", F.col("depth").alias("lines"), "first")
    ranked, size = first_round(durable(line_rows(docs, id_col, text_col))).withColumn("depth", F.lit(1)), 1
    found = ranked.where(copy).select(*columns)
    while size < min_words and not ranked.isEmpty():
        windows = next_round(ranked, size, list(range(size + 1, min(2 * size, min_words) + 1)), min_words)
        found = found.unionAll(windows.where(copy).select(*columns))
        size *= 2
        ranked = windows.where(F.col("depth") == size)
    return found


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dk, line, last, lines, source_id, source_line) of maximal later runs.

    line and last: places among all lines of the text; lines: those that aren't
    blank. Windows of a document that overlap or touch are one run; the source is
    where the first of them occurs first.
    """
    by = Window.partitionBy("id", "dk").orderBy("j", "lines")
    reached = F.max(F.col("j") + F.col("lines")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    #: Of the windows from one line the longest covers the others.
    widest = later_copies(docs, min_words, id_col, text_col).groupBy("id", "dk", "j", "i").agg(F.max_by(F.struct("lines", "end", "first"), "lines").alias("w"))
    windows = widest.select("id", "dk", "j", "i", "w.lines", "w.end", "w.first")
    run = F.sum(F.when(reached >= F.col("j"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    runs = windows.withColumn("run", run).groupBy("id", "dk", "run").agg(F.min("i").alias("line"), F.max("end").alias("last"), F.min("j").alias("j"), F.max(F.col("j") + F.col("lines")).alias("to"), F.min_by("first", "j").alias("first"))
    return runs.select("id", "dk", "line", "last", (F.col("to") - F.col("j")).alias("lines"), F.col("first.id").alias("source_id"), F.col("first.j").alias("source_line"))


def cut(text: str | None, spans: list | None) -> tuple[str | None, int, int]:
    """The text without the lines of the spans, its lines, the lines taken out."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    gone = bytearray(len(lines))
    for a, b in spans or ():
        gone[a : b + 1] = b"\1" * (b + 1 - a)
    return "\n".join(x for x, g in zip(lines, gone, strict=True) if not g) if any(gone) else text, len(lines), sum(gone)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col cut, and two columns more: __lines and __removed."""
    return unclashed(docs.drop("__lines", "__removed"), lambda plain, key, text: _cut_runs(plain, min_words, key, text), id_col, text_col)


def _cut_runs(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    from pyspark.sql.types import LongType, StructField, StructType

    columns = docs.columns
    schema = StructType([*docs.schema.fields, StructField("__lines", LongType()), StructField("__removed", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [cut(t, [(s["line"], s["last"]) for s in spans or ()]) for t, spans in rows_of([batch], text_col, "__spans")]
            text, lines, removed = ([k[n] for k in kept] for n in range(3))
            arrays = [pa.array(text, batch.column(c).type) if c == text_col else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], names=[*columns, "__lines", "__removed"])

    runs = repeated_runs(docs, min_words, id_col, text_col)
    spans = runs.groupBy(F.col("id").alias("__id"), F.col("dk").alias("__dk")).agg(F.collect_list(F.struct("line", "last")).alias("__spans"))
    keyed = docs.withColumn("__key", F.xxhash64(id_col, text_col))
    return keyed.join(spans, (F.col("__key") == F.col("__dk")) & F.col(id_col).eqNullSafe(F.col("__id")), "left").select(*columns, "__spans").mapInArrow(run, schema)


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs after the deletions, same columns; size_col (if there) follows the text, and a document that lost every line with text goes."""

    def run(plain: DataFrame, key: str, text: str, *size: str) -> DataFrame:
        done = dedup_lines(plain, id_col=key, text_col=text)
        left = done.where(~((F.col("__removed") > 0) & (F.length(F.trim(text)) == 0)))
        for c in size:
            left = left.withColumn(c, F.length(text).cast(plain.schema[c].dataType))
        return left.select(*plain.columns)

    return unclashed(docs, run, id_col, text_col, *([size_col] if size_col in docs.columns else []))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


#: Windows of every length from 1 to 8 lines that aren't blank, compared as strings (longer ones with 8 words are covered by these); blank lines between two lines that go.
ORACLE = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS i, trim(lines[i]) AS x, lines[i] AS raw
  FROM (
    SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)
  )
), n AS (
  SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j,
    greatest(1, len(regexp_extract_all(x, '[^ \t\n\x0B\f\r]+')),
      length(regexp_replace(x, '[^\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]', '', 'g')) // 2) AS w
  FROM l WHERE x <> ''
), g AS (SELECT unnest(range(1, 9)) AS d
), win AS (
  SELECT a.doc_id, a.j, g.d, min(b.i) AS lo, max(b.i) AS hi, sum(b.w) AS w, count(*) AS c, string_agg(b.x, chr(10) ORDER BY b.j) AS s
  FROM n a CROSS JOIN g JOIN n b ON a.doc_id = b.doc_id AND b.j >= a.j AND b.j < a.j + g.d
  GROUP BY a.doc_id, a.j, g.d HAVING count(*) = g.d
), r AS (
  SELECT doc_id, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY d, s ORDER BY doc_id, j) AS k FROM win) WHERE k > 1 AND w >= 8
), gn AS (SELECT DISTINCT n.doc_id, n.i, n.j FROM n JOIN r ON n.doc_id = r.doc_id AND n.i BETWEEN r.lo AND r.hi
), gone AS (
  SELECT doc_id, unnest(range(i, CASE WHEN next_j = j + 1 THEN next_i ELSE i + 1 END)) AS i
  FROM (SELECT *, lead(j) OVER (PARTITION BY doc_id ORDER BY j) AS next_j, lead(i) OVER (PARTITION BY doc_id ORDER BY j) AS next_i FROM gn)
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN l.raw END, chr(10) ORDER BY l.i) AS t
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, md5(coalesce(t, '')) AS kept_md5
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
