"""Queries over several dictionaries at once: merged senses, known words, words that a dictionary must know."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import expressions as X
from lexmill.operators import levels, senses

#: Where the senses of each source stand among a word's.
ORDER = {"kaikki": 0, "ecdict": 1, "cefr": 2, "wordnet": 3}


def _items(rows: DataFrame, texts: Column, source: str, lang: str) -> DataFrame:
    before = F.lit(ORDER[source] << 32)  # a gloss has fewer senses
    return rows.select("word", F.posexplode(texts).alias("i", "text")).select("word", "text", F.lit(source).alias("source"), F.lit(lang).alias("lang"), (before + F.col("i")).alias("ord"))


def sense_items(words: DataFrame, wiktionary: DataFrame, bilingual: DataFrame, cefr: DataFrame, wordnet: DataFrame | None = None) -> DataFrame:
    """(word, text, source, lang, ord): all senses of all dictionaries, in their order; glosses of several lines are several senses.

    wordnet: (word, definitions), of which four are taken.
    """
    of = lambda d: d.join(words.select("word").distinct(), "word", "left_semi")
    lines = lambda c: F.filter(F.transform(F.split(X.clean_gloss(c), "\n"), X.stripped), lambda x: x != "")
    glosses = F.col("glosses") if "glosses" in wiktionary.columns else F.array("gloss_en")
    parts = [
        _items(of(wiktionary), F.array_compact(glosses), "kaikki", "en"),
        _items(of(bilingual), lines("definition_en"), "ecdict", "en"),
        _items(of(bilingual), lines("translation_zh"), "ecdict", "zh"),
        _items(of(cefr).where(F.coalesce("gloss_en", F.lit("")) != ""), F.array("gloss_en"), "cefr", "en"),
    ]
    if wordnet is not None:
        parts.append(_items(of(wordnet), F.slice("definitions", 1, 4), "wordnet", "en"))
    return reduce(DataFrame.unionByName, parts)


def query(words: DataFrame, tables: dict[str, DataFrame], wordnet: DataFrame | None = None) -> DataFrame:
    """words (word) with pronunciation, level and the like by precedence, and the senses of all dictionaries merged.

    (word, ipa, pos, level, etymology, gloss_en, gloss_zh, senses_en, senses_zh): senses are (text, sources); glosses are the senses' texts.
    """
    asked = words.select(F.lower(X.stripped("word")).alias("word")).distinct()
    found = levels.look_up(asked, tables["cmu"], tables["cefr"], tables["oxford"], tables["bilingual"], tables["wiktionary"])
    merged = senses.merge_senses(sense_items(asked, tables["wiktionary"], tables["bilingual"], tables["cefr"], wordnet))
    of = lambda lang: F.transform(F.array_sort(F.collect_list(F.when(F.col("lang") == lang, F.struct("sense_no", "text", "sources")))), lambda s: F.struct(s["text"].alias("text"), s["sources"].alias("sources")))
    listed = merged.groupBy("word").agg(of("en").alias("senses_en"), of("zh").alias("senses_zh"))
    text = lambda lang: F.coalesce(F.nullif(F.array_join(F.transform(f"senses_{lang}", lambda s: s["text"]), "；"), F.lit("")), F.col(f"gloss_{lang}"), F.lit(""))
    none = F.array().cast("array<struct<text:string,sources:array<string>>>")
    out = found.join(listed, "word", "left")
    return out.select("word", "ipa", "pos", "level", "etymology", text("en").alias("gloss_en"), text("zh").alias("gloss_zh"), F.coalesce("senses_en", none).alias("senses_en"), F.coalesce("senses_zh", none).alias("senses_zh"))


#: A word this frequent is known without a dictionary.
KNOWN_ZIPF = 4.0


def known(words: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """words (word, zipf, ...) with known: whether a dictionary has the word or it is frequent."""
    keys = reduce(DataFrame.unionAll, (tables[t].select("word") for t in ("bilingual", "cmu", "cefr", "oxford"))).distinct().withColumn("__held", F.lit(True))
    return words.join(keys, "word", "left").withColumn("known", F.coalesce("__held", F.lit(False)) | (F.coalesce("zipf", F.lit(0.0)) >= KNOWN_ZIPF)).drop("__held")


def suspects(words: DataFrame, capitals: DataFrame, tables: dict[str, DataFrame], most: int = 200) -> DataFrame:
    """(word, n, cap_ratio) of the most frequent unknown words; cap_ratio: share of capitals inside sentences, 0 where not counted."""
    unknown = known(words, tables).where(~F.col("known")).orderBy(F.desc("n"), "word").limit(most)
    ratio = F.when(F.col("total") > 0, F.round(F.col("upper") / F.col("total"), 2)).otherwise(0.0)
    return unknown.join(capitals.select("word", "upper", "total"), "word", "left").select("word", "n", F.coalesce(ratio, F.lit(0.0)).alias("cap_ratio"))


def candidates(words: DataFrame, looked_up: DataFrame, short: int = 3) -> DataFrame:
    """words without the short ones that no dictionary pronounces or explains: they are broken pieces."""
    held = [levels.missing(c).isNotNull() for c in ("ipa", "gloss_zh", "gloss_en")]
    explained = looked_up.where(held[0] | held[1] | held[2]).select("word")
    return words.where(F.length("word") > short).unionByName(words.where(F.length("word") <= short).join(explained, "word", "left_semi"))


def pronunciation_conflict(sources: Column, primary: str = "cmu") -> Column:
    """Of a map from source to pronunciation the primary one, else the first that isn't empty."""
    return F.coalesce(levels.missing(sources[primary]), F.get(F.filter(F.map_values(sources), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), F.lit(0)))
