"""Single calls of a model (an injected, picklable function of a prompt): titles, single entries, proofreading, texts of reports.

A call that fails or replies without sense leaves what was there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import expressions as X
from lexmill.operators import books, senses

#: Strict tries for a title; lengths of a title in them and in the last, lenient one.
TRIES, LONG, LONGEST = 3, 80, 120


def replied(call: Callable[[str], str], prompt: str) -> str:
    try:
        return call(prompt) or ""
    except (RuntimeError, ValueError, OSError):
        return ""


def read_object(reply: str) -> dict:
    """The JSON object in a reply, text around it ignored; empty if there is none."""
    found = re.search(r"\{.*\}", reply, re.DOTALL)
    try:
        out = json.loads(found[0]) if found else {}
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}


def titles(rows: DataFrame, call: Callable[[str], str] | None = None) -> DataFrame:
    """rows (path, head, title, author) with title and author: stated ones, else a model's reading of the first pages, else the file name.

    The model is asked up to TRIES times for a title that doesn't look like a file name, then once for any.
    """
    asked = rows.withColumn("prompt", F.when((F.coalesce("title", F.lit("")) == "") & (F.trim(F.coalesce("head", F.lit(""))) != ""), F.concat(F.lit("以下是《书籍》开头若干页文本，完全以文本内容为准：\n\n"), "head")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            read = []
            for prompt in frame["prompt"]:
                found = []
                for _ in range(TRIES + 1 if prompt else 0):
                    d = read_object(replied(call, prompt))
                    found.append((str(d.get("book_title") or "").strip(), str(d.get("book_author") or "").strip()))
                read.append(found)
            yield frame.assign(read=read)

    if call is None:
        read = asked.withColumn("read", F.array().cast("array<struct<t:string,a:string>>"))
    else:
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
        read = asked.mapInPandas(run, f"{columns}, read array<struct<t:string,a:string>>")
    strict = F.filter(F.slice("read", 1, TRIES), lambda r: (F.length(r["t"]) <= LONG) & ~X.looks_like_file_name(r["t"]))
    lenient = F.filter(F.slice("read", TRIES + 1, 1), lambda r: (r["t"] != "") & (F.length(r["t"]) <= LONGEST))
    own = F.struct(F.nullif("title", F.lit("")).alias("t"), F.coalesce("author", F.lit("")).alias("a"))
    name = F.struct(books.fallback_title("path").alias("t"), F.lit("").alias("a"))
    first = lambda xs: F.get(xs, F.lit(0))
    chosen = F.when(F.nullif("title", F.lit("")).isNotNull(), own).otherwise(F.coalesce(first(strict), first(lenient), name))
    return read.withColumn("__c", chosen).select(*(c for c in rows.columns if c not in ("title", "author")), F.col("__c.t").alias("title"), F.col("__c.a").alias("author"))


def complete_each(entries: DataFrame, call: Callable[[str], str] | None, title: str = "", author: str = "") -> DataFrame:
    """entries (word, pos, gloss_zh, gloss_en) completed by a model, one word at a time; non-empty fields of a reply replace the entry's."""
    if call is None:
        return entries
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("未知"))
    prompt = F.concat(F.lit("单词: "), "word", F.lit("\n已知词性: "), known("pos"), F.lit("\n已知释义: "), known("gloss_en"), F.lit(f"\n来源书籍: {title or '未知'}（作者: {author or '未知'}）\n请补全完整词汇信息。"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [read_object(replied(call, p)) for p in frame["prompt"]]
            fields = {c: [str(d[c]) if d.get(c) else None for d in found] for c in ("pos", "gloss_zh", "gloss_en", "cefr_level")}
            yield pd.DataFrame({"word": frame["word"], **fields})

    replies = entries.select("word", prompt.alias("prompt")).mapInPandas(run, "word string, pos string, gloss_zh string, gloss_en string, cefr_level string")
    return senses.merge_replies(entries, replies)


def proofread(rows: DataFrame, columns: list[str], call: Callable[[str], str] | None = None) -> DataFrame:
    """rows with the text columns corrected by a function of a text; as they are without one or where it fails."""
    if call is None:
        return rows

    @F.pandas_udf("string")
    def fixed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if not t else replied(call, t) or t)

    return rows.withColumns({c: fixed(c) for c in columns})


def report_prompt(statistics: DataFrame, title: str) -> DataFrame:
    """One row (prompt): the most frequent words and the shares of levels and parts of speech of reports.statistics(), as a request."""
    part = lambda section, k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("section") == section) & (F.col("no") <= k), F.struct("no", "key", "n")))), lambda s: F.concat(s["key"], F.lit("×"), s["n"].cast("long").cast("string"))), "、")
    return statistics.agg(F.concat(F.lit(f"书名：{title}\n高频实词："), part("top_words", 15), F.lit("\n难度分布："), part("level", 6), F.lit("\n词性分布："), part("pos", 6)).alias("prompt"))


def report_text(prompt: DataFrame, call: Callable[[str], str] | None) -> DataFrame:
    """(text) of a model for (prompt); empty without a model."""
    if call is None:
        return prompt.select(F.lit("").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"text": [replied(call, p) for p in frame["prompt"]]})

    return prompt.mapInPandas(run, "text string")
