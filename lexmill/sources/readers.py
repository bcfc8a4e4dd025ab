"""Scans: tables, lines, tokens, and dictionary files in their published formats.

Dictionary readers give one row for each lower-cased key, the last one read.
Every reader takes any path that Spark can open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import expressions as X
from lexmill.functions import lexicon as L


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def of_language(spark: SparkSession, sf_dir: str, lang: str = "en") -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("lang") == lang).select("doc_id", "text", "source")


def english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_language(spark, sf_dir, "en")


def lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line)."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line_no", "line"))


def tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, pos, token)."""
    return docs.select("doc_id", F.posexplode(X.corpus_tokens(text_col)).alias("pos", "token"))


def pages(docs: DataFrame) -> DataFrame:
    """(book, page_no, header, footer): a document's first and last line, its source as the book."""
    ls = F.split(F.coalesce("text", F.lit("")), "\n")
    return docs.where(F.size(ls) >= 2).select(F.col("source").alias("book"), F.col("doc_id").alias("page_no"), F.element_at(ls, 1).alias("header"), F.element_at(ls, -1).alias("footer"))


def first_pages(pages_: DataFrame, n: int = 15, chars: int = 300, total: int = 6000) -> DataFrame:
    """(book, head): the beginnings of a book's first pages, tagged with the page, cut at `total`."""
    part = F.struct("page_no", F.concat(F.lit("[p"), F.col("page_no"), F.lit("] "), F.substring("body", 1, chars)).alias("t"))
    joined = pages_.where(F.col("page_no") <= n).groupBy("book").agg(F.array_sort(F.collect_list(part)).alias("ps"))
    return joined.select("book", F.substring(F.array_join(F.col("ps.t"), "\n"), 1, total).alias("head"))


def page_zones(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, header, footer, body) from text blocks (doc_id, page_no, block_no, y0, height, text)."""
    zone = F.when(F.col("y0") < 0.08 * F.col("height"), "header").when(F.col("y0") > 0.92 * F.col("height"), "footer").otherwise("body")
    of = lambda z, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("zone") == z, F.struct("block_no", "text")))), lambda s: s.text), sep)
    return blocks.withColumn("zone", zone).groupBy("doc_id", "page_no").agg(of("header", " ").alias("header"), of("footer", " ").alias("footer"), of("body", "\n").alias("body"))


def binary_documents(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page_no, body) of files that `extract` turns into page texts; a file that it can't read gives no pages."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    texts = extract(content)
                except ValueError:
                    texts = []
                rows += [(name, i, t) for i, t in enumerate(texts, 1)]
            yield pd.DataFrame(rows, columns=["path", "page_no", "body"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page_no int, body string")


def last_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))).where("__n = 1").drop("__n", *order)


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))


def pronunciations(spark: SparkSession, path: str) -> DataFrame:
    """(word, phones): "WORD  P H O N E S" lines, ";;;" comments, "(2)" marks of variants."""
    rows = _numbered_lines(spark, path).where(~F.col("value").startswith(";;;")).select(F.split(F.trim("value"), r"\s+").alias("p"), "at").where(F.size("p") >= 2)
    return last_of_each(rows.select(F.lower(F.regexp_replace(F.col("p")[0], r"\(\d+\)$", "")).alias("word"), F.slice("p", 2, F.size("p")).alias("phones"), "at"), "word", ["at"])


def level_list(spark: SparkSession, path: str) -> DataFrame:
    """(word, pos, cefr, gloss_en, example) from plain comma-separated lines with a heading."""
    p = F.split("value", ",")
    rows = _numbered_lines(spark, path).where((F.size(p) >= 4) & (F.lower(F.trim(p[0])) != "headword") & (F.lower(F.trim(p[0])) != "word"))
    return last_of_each(rows.select(F.lower(F.trim(p[0])).alias("word"), F.trim(p[1]).alias("pos"), F.upper(F.trim(p[2])).alias("cefr"), F.trim(p[3]).alias("gloss_en"), F.trim(F.get(p, F.lit(4))).alias("example"), "at"), "word", ["at"])


def tabbed_levels(spark: SparkSession, path: str) -> DataFrame:
    """(word, pos, cefr) from tab-separated lines of five columns or more."""
    p = F.split("value", "\t")
    rows = _numbered_lines(spark, path).where(F.size(p) >= 5)
    return last_of_each(rows.select(F.lower(F.trim(p[0])).alias("word"), F.trim(p[3]).alias("pos"), F.upper(F.trim(p[4])).alias("cefr"), "at"), "word", ["at"])


def bilingual(spark: SparkSession, path: str) -> DataFrame:
    """(word, phonetic, definition_en, translation_zh, pos, frq) from CSV with quotes; a missing pos is read off the glosses."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').withColumn("at", F.monotonically_increasing_id())
    seen = F.coalesce(*(F.nullif(F.regexp_extract(F.col(c), r"^([a-z]+\.)\s", 1), F.lit("")) for c in ("definition", "translation")))
    return last_of_each(
        rows.select(F.lower(F.trim("word")).alias("word"), "phonetic", F.col("definition").alias("definition_en"), F.col("translation").alias("translation_zh"), F.coalesce(F.nullif(F.trim("pos"), F.lit("")), seen).alias("pos"), F.col("frq").cast("int").alias("frq"), "at"), "word", ["at"]
    )


def translations(spark: SparkSession, path: str) -> DataFrame:
    """(word, translation_zh) of the bilingual file, of the words that have one."""
    return bilingual(spark, path).where(X.stripped("translation_zh") != "").select("word", "translation_zh")


def subject_files(subjects: list[str]) -> list[str]:
    """The files of the named subjects, each once; all files where no subject is known."""
    every = list(dict.fromkeys(L.SUBJECT_FILES.values()))
    return sorted({L.SUBJECT_FILES[s] for s in subjects if s in L.SUBJECT_FILES}) or every


def wiktionary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(word, gloss_en, glosses, pos, topics, ipa, etymology) from JSON lines; lines that don't parse are skipped."""
    schema = "word string, pos string, etymology_text string, sounds array<struct<ipa:string>>, senses array<struct<glosses:array<string>,topics:array<string>>>"
    rows = spark.read.schema(schema).json(path).where(F.col("word").isNotNull() & (F.length("word") <= 40)).withColumn("at", F.monotonically_increasing_id())
    glosses = F.array_compact(F.flatten(F.transform(F.slice("senses", 1, 5), lambda s: F.coalesce(s.glosses, F.array().cast("array<string>")))))
    topics = F.array_sort(F.array_distinct(F.flatten(F.transform("senses", lambda s: F.coalesce(s.topics, F.array().cast("array<string>"))))))
    named = rows.select(F.lower("word").alias("word"), glosses.alias("g"), "pos", F.slice(topics, 1, 8).alias("topics"), F.get(F.filter("sounds.ipa", lambda x: x.isNotNull()), F.lit(0)).alias("ipa"), F.substring("etymology_text", 1, 300).alias("etymology"), "at")
    return last_of_each(named.where(F.size("g") > 0).select("word", F.substring(F.col("g")[0], 1, 300).alias("gloss_en"), F.slice("g", 1, 3).alias("glosses"), "pos", "topics", "ipa", "etymology", "at"), "word", ["at"])


def decoded_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of the lines of a file in UTF-8, or in Latin-1 if it isn't."""
    lines_ = spark.read.text(path)
    if lines_.where(~F.is_valid_utf8("value")).isEmpty():
        return lines_
    return spark.read.csv(path, schema="value string", sep="\x01", quote="", escape="", encoding="ISO-8859-1").where("value is not null")


def level_bands(spark: SparkSession, path: str) -> DataFrame:
    """(exam, lo, hi, cefr) from JSON {"exams": {exam: {"bands": [{"min", "max", "cefr_max"}]}}}."""
    band = "array<struct<min:double,max:double,cefr_max:string>>"
    rows = spark.read.schema(f"exams map<string,struct<bands:{band}>>").json(path, multiLine=True)
    return rows.select(F.explode("exams").alias("exam", "e")).select("exam", F.explode("e.bands").alias("b")).select("exam", F.col("b.min").alias("lo"), F.col("b.max").alias("hi"), F.col("b.cefr_max").alias("cefr"))


def families(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(word, band): band k for the k-th file; a word in several files has the last band."""
    parts = [decoded_lines(spark, p).select(F.lower(F.trim("value")).alias("word"), F.lit(i).alias("band")) for i, p in enumerate(paths, 1)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.where("word <> ''").groupBy("word").agg(F.max("band").alias("band"))
