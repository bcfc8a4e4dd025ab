"""Collocations: n-gram counts, pointwise mutual information, phrases of a word."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import expressions as X
from lexmill.functions import lexicon as L


def placed_words(docs: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """(ws, i, w1): every word with its text's words; texts under n words are left out.

    The words stay one array through the generator. Its outer form and a filter that needs i keep
    filters above it: below, each of them would split the text once more. The last filter is that of joins, so all readers of one count share it.
    """
    ws = docs.select(X.phrase_tokens(text_col).alias("ws"))
    return ws.select("ws", F.posexplode_outer("ws").alias("i", "w1")).where(F.greatest(F.col("i") + 1, F.size("ws")) >= n).where("w1 is not null")


def ngram_counts(docs: DataFrame, n: int, text_col: str = "text", least: int | None = None) -> DataFrame:
    """(w1 to wn, n) over texts of `least` words (n where not given)."""
    placed = placed_words(docs, least or n, text_col).where(F.col("i") + n <= F.size("ws"))
    names = [f"w{k + 1}" for k in range(n)]
    return placed.select("w1", *(F.get("ws", F.col("i") + k).alias(f"w{k + 1}") for k in range(1, n))).groupBy(*names).agg(F.count("*").alias("n"))


def pmi(ab: Column, a: Column, b: Column, total: Column) -> Column:
    return F.when((ab > 0) & (a > 0) & (b > 0) & (total > 0), F.log2((ab / total) / ((a / total) * (b / total))))


def is_meaningful(*words: Column) -> Column:
    content = reduce(lambda a, b: a | b, (~w.isin(*L.FUNCTION_WORDS) for w in words))
    return F.lit(len(words) >= 2) & ~F.concat_ws(" ", *words).isin(*L.BLOCKED_PHRASES) & content


def collocations(docs: DataFrame, n: int = 2, min_count: int = 2, text_col: str = "text") -> DataFrame:
    """(phrase, words, n, pmi) of phrases with a content word, counts of at least min_count and a score over 0."""
    ws = [F.col(f"w{k + 1}") for k in range(n)]
    counts = ngram_counts(docs, n, text_col).where(F.col("n") >= min_count).where(is_meaningful(*ws))
    if n == 2:
        single = placed_words(docs, n, text_col).groupBy("w1").agg(F.count("*").alias("c"))
        total = single.agg(F.sum("c").alias("total"))
        a, b = (single.select(F.col("w1").alias(f"w{i}"), F.col("c").alias(f"c{i}")) for i in (1, 2))
        scored = counts.join(a, "w1").join(b, "w2").join(F.broadcast(total)).withColumn("s", pmi(F.col("n"), F.col("c1"), F.col("c2"), F.col("total")))
    else:
        pairs = ngram_counts(docs, 2, text_col, 3).withColumnRenamed("n", "ab")
        scored = counts.join(pairs, ["w1", "w2"]).withColumn("s", F.log2(F.greatest(F.lit(1), F.col("n")) / F.greatest(F.lit(1), F.col("ab")) * 2))
    return scored.where("s > 0").select(F.concat_ws(" ", *ws).alias("phrase"), F.array(*ws).alias("words"), "n", F.round("s", 2).alias("pmi"))


def top(found: DataFrame, k: int) -> DataFrame:
    return found.orderBy(F.desc("pmi"), F.desc("n"), "phrase").limit(k)


def phrases_of(found: DataFrame, words: DataFrame) -> DataFrame:
    """(word, phrase, n, pmi) for each word of words that is a member of a phrase."""
    return found.select(F.explode(F.array_distinct("words")).alias("word"), "phrase", "n", "pmi").join(words.select("word").distinct(), "word")
