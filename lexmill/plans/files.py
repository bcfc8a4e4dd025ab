"""Queries that write the tables as files of published formats to the shared folder and read them with the library's data sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexmill.operators import replies, search
from lexmill.operators.ranking import shared_folder
from lexmill.plans import catalog
from lexmill.plans.catalog import WORDS, query
from lexmill.sources import formats, readers


@query("SELECT doc_id, md5(trim(replace(text, chr(12), ' '), ' ' || chr(10))) AS body, length(trim(replace(text, chr(12), ' '), ' ' || chr(10))) AS size, 'plain' AS extractor FROM documents WHERE text IS NOT NULL AND trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''")
def paged_documents(spark, d):
    """Every document as a page of a book of its source, read back a page at a time."""
    formats.register(spark)
    base = f"{shared_folder(spark).rstrip('/')}/books-{uuid.uuid4().hex}"
    docs = readers.table(spark, d, "documents").where("text is not null")
    page = F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.replace("text", F.lit("\f"), F.lit(" ")), F.lit("\f"))
    docs.select(F.coalesce("source", F.lit("none")).alias("book"), page.alias("value")).write.partitionBy("book").text(base)
    pages = spark.read.format("lexmill_pages").option("extractors", "pypdf,plain").load(base)
    body = F.regexp_extract("body", r"(?s)^\s*(\d+)\n(.*)$", 2)
    read = pages.where("error is null and trim(body) <> ''").select(F.regexp_extract("body", r"(?s)^\s*(\d+)\n", 1).cast("long").alias("doc_id"), F.trim(body, F.lit(" \n")).alias("body"), "extractor")
    return read.where(F.trim("body", F.lit(" \t\n\x0b\f\r")) != "").select("doc_id", F.md5("body").alias("body"), F.length("body").cast("long").alias("size"), "extractor")


@query(
    f"""WITH {WORDS} SELECT 'levels' AS kind, word, 'noun|' || level || '|of ' || word AS value FROM w
  UNION ALL SELECT 'pronunciations', word, 'HH AH' || n % 3 FROM w
  UNION ALL SELECT 'entries', word, 'first ' || word || '|noun|from ' || level FROM w
  UNION ALL SELECT 'broken', '', CAST(count(*) * 2 AS VARCHAR) FROM w WHERE n % 7 = 0"""
)
def dictionary_sources(spark, d):
    """Every word in files of three dictionary formats, with a broken line now and then, read back by blocks of a megabyte."""
    formats.register(spark)
    w = catalog.words(spark, d)
    base, word, torn = f"{shared_folder(spark).rstrip('/')}/sources-{uuid.uuid4().hex}", F.col("word"), F.col("n") % 7 == 0
    lines = {
        "levels": F.when(torn, F.concat(F.concat_ws(",", word, F.lit("noun"), F.lower("level"), F.concat(F.lit("of "), word), F.lit("x")), F.lit("\n"), word)).otherwise(F.concat_ws(",", word, F.lit("noun"), F.lower("level"), F.concat(F.lit("of "), word), F.lit("x"))),
        "pronunciations": F.concat(word, F.lit("  HH AH"), (F.col("n") % 3).cast("string")),
        "entries": F.concat(F.when(torn, F.lit("{torn\n")).otherwise(""), F.to_json(F.struct(word, F.lit("noun").alias("pos"), F.concat(F.lit("from "), "level").alias("etymology_text"), F.array(F.struct(F.array(F.concat(F.lit("first "), word)).alias("glosses"))).alias("senses")))),
    }
    shown = {"levels": ("pos", "cefr", "gloss_en"), "pronunciations": (F.array_join("phones", " "),), "entries": ("gloss_en", "pos", "etymology")}
    out = broken = None
    for kind, line in lines.items():
        w.select(line.alias("value")).write.text(f"{base}/{kind}")
        rows = spark.read.format("lexmill_dictionary").option("kind", kind).option("blockBytes", 1 << 20).load(f"{base}/{kind}")
        entries = formats.last_entries(rows).select(F.lit(kind).alias("kind"), "word", F.concat_ws("|", *shown[kind]).alias("value"))
        lost = rows.where("broken is not null").select("broken")
        out, broken = (entries, lost) if out is None else (out.unionAll(entries), broken.unionAll(lost))
    return out.unionAll(broken.agg(F.count("*").cast("string").alias("value")).select(F.lit("broken").alias("kind"), F.lit("").alias("word"), "value"))


@query(
    f"WITH {WORDS}, e AS (SELECT word, n, 'level ' || level AS gloss, CASE WHEN n % 2 = 0 THEN 'mastered' ELSE 'new' END AS status FROM w), "
    "f AS (SELECT 'tion' AS q, * FROM e WHERE contains(word, 'tion') AND status = 'new' UNION ALL SELECT 'an', * FROM e WHERE contains(word, 'an') AND status = 'mastered' UNION ALL SELECT 'l c2', * FROM e WHERE contains(lower(gloss), 'l c2')) "
    "SELECT q, word, n, status FROM f QUALIFY row_number() OVER (PARTITION BY q ORDER BY word) BETWEEN 51 AND 100"
)
def indexed_search(spark, d):
    """The second page of three searches over all words, from a stored index."""
    w = catalog.words(spark, d)
    path, fields = f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}", ["word", "gloss"]
    search.build(w.select("word", "n", F.concat(F.lit("level "), "level").alias("gloss")), path, fields)
    states = w.where("n % 2 = 0").select("word", F.lit("mastered").alias("status"))
    out = None
    for q, status in (("tion", "new"), ("an", "mastered"), ("l c2", None)):
        first = search.search(spark, path, fields, q, states, status, size=50).agg(F.max("entry")).first()[0]
        page = search.search(spark, path, fields, q, states, status, first, 50).select(F.lit(q).alias("q"), "word", "n", "status")
        out = page if out is None else out.unionAll(page)
    return out


@query("SELECT conv_id, turn, CASE WHEN text IS NULL THEN NULL WHEN length(text) % 5 = 0 THEN 'RuntimeError: busy' END AS error, CASE WHEN length(text) % 5 <> 0 THEN md5('reply to ' || text) END AS reply FROM conversations")
def stored_replies(spark, d):
    """A reply to every turn from a store that two jobs fill: the first job's model fails for most turns."""
    path = f"{shared_folder(spark).rstrip('/')}/replies-{uuid.uuid4().hex}"
    turns = readers.table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    replies.ask_once(turns, _busy(3), path, pause=0.0, tries=1)
    return replies.ask_once(turns, _busy(5), path, pause=0.0, tries=2).select("conv_id", "turn", "error", F.md5("reply").alias("reply"))


def _busy(often: int):
    """A model that is busy for prompts of some lengths; those of lengths that 5 divides never get a reply."""

    def ask(prompt: str) -> str:
        if len(prompt) % 5 == 0 or often == 3 and len(prompt) % 3:
            raise RuntimeError("busy")
        return f"reply to {prompt}"

    return ask
