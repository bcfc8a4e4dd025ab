"""Exam levels, dictionary lookups with precedence, word filters and the capped selection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import expressions as X
from lexmill.functions import lexicon as L
from lexmill.operators.ranking import numbered

# ---- small literal tables


def literal_table(spark: SparkSession, rows: list[tuple], *names_types: tuple[str, str]) -> DataFrame:
    """A table of literals without a Python-side relation."""
    structs = [F.struct(*(F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, names_types, strict=True))) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def bands(spark: SparkSession) -> DataFrame:
    return literal_table(spark, L.EXAM_BANDS, ("exam", "string"), ("lo", "double"), ("hi", "double"), ("cefr", "string"))


def thresholds(spark: SparkSession, table: dict, value_type: str) -> DataFrame:
    return literal_table(spark, [(e, s, v) for e, x in table.items() for s, v in x.items()], ("exam", "string"), ("at", "double"), ("value", value_type))


def presets(spark: SparkSession) -> DataFrame:
    return literal_table(spark, L.PRESETS, ("preset", "string"), ("exam", "string"), ("score", "double"))


# ---- range and as-of joins


def level_of_score(scores: DataFrame) -> DataFrame:
    """scores (exam, score, ...) with cefr: the band that holds the score, C2 in gaps, beyond the ends and for unknown exams."""
    b = F.broadcast(bands(scores.sparkSession).withColumnRenamed("exam", "__exam"))
    return scores.join(b, (F.col("exam") == F.col("__exam")) & F.col("score").between(F.col("lo"), F.col("hi")), "left").withColumn("cefr", F.coalesce("cefr", F.lit("C2"))).drop("__exam", "lo", "hi")


def as_of(scores: DataFrame, table: dict, value_type: str, name: str, below: Column, unknown: Column) -> DataFrame:
    """scores with the value of the greatest threshold at or under the score; `below` under all of them, `unknown` for other exams."""
    steps = thresholds(scores.sparkSession, table, value_type).groupBy("exam").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("steps"))
    at = F.filter("steps", lambda s: s.at <= F.col("score"))
    found = F.when(F.col("steps").isNull(), unknown).when(F.size(at) > 0, F.element_at(at, -1).value).otherwise(below)
    return scores.join(F.broadcast(steps), "exam", "left").withColumn(name, found).drop("steps")


def learned_level(scores: DataFrame) -> DataFrame:
    return as_of(scores, L.EXAM_LEVELS, "string", "cefr", F.lit("A1"), F.lit("C2"))


def zipf_threshold(scores: DataFrame) -> DataFrame:
    lowest = X.mapping({e: float(min(t.items())[1]) for e, t in L.EXAM_ZIPF.items()}, F.col("exam"))
    return as_of(scores, L.EXAM_ZIPF, "double", "zipf_threshold", lowest, F.lit(4.0))


def preset_levels(requests: DataFrame) -> DataFrame:
    """requests (preset, ...) with exam, score, cefr; unknown presets take everything."""
    known = level_of_score(presets(requests.sparkSession))
    return requests.join(F.broadcast(known), "preset", "left").withColumns({"cefr": F.coalesce("cefr", F.lit("C2")), "exam": F.coalesce("exam", F.lit("all"))})


def user_level(scores: DataFrame) -> DataFrame:
    """scores (exam, score, vocabulary) with u: by exam and score, else by vocabulary, else 0.6."""
    learned = learned_level(scores)
    by_exam = F.when(F.col("exam").isNotNull() & F.col("score").isNotNull(), X.mapping(L.LEVEL_SHARE, F.col("cefr")))
    return learned.withColumn("u", F.coalesce(by_exam, X.vocabulary_level("vocabulary"), F.lit(0.6))).drop("cefr")


def level_matrix(spark: SparkSession) -> DataFrame:
    """(exam, bands): a line of bands for each exam."""
    part = F.struct("lo", F.concat_ws("", F.format_string("%.1f", "lo"), F.lit("-"), F.format_string("%.1f", "hi"), F.lit("→"), "cefr").alias("t"))
    return bands(spark).groupBy("exam").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s.t), "；").alias("bands"))


# ---- dictionaries


def missing(c: Column | str) -> Column:
    """Null where a string is empty."""
    return F.nullif(F.trim(X.col(c)), F.lit(""))


def look_up(words: DataFrame, cmu: DataFrame, cefr: DataFrame, oxford: DataFrame, bilingual: DataFrame, wiki: DataFrame, strategy: str = "hardest") -> DataFrame:
    """Each word of words (word) once, with ipa, gloss_en, gloss_zh, pos, level, etymology, sources by precedence.

    Dictionaries hold a word once. All rows meet in one exchange by word, whose first step adds up what a task has.
    """
    rows = words.select("word", F.lit(True).alias("asked"))
    for name, d in (("cmu", cmu), ("cefr", cefr), ("oxford", oxford), ("bi", bilingual), ("wiki", wiki)):
        rows = rows.unionByName(d.select("word", *(F.col(c).alias(f"{name}_{c}") for c in d.columns if c != "word")), allowMissingColumns=True)
    out = rows.groupBy("word").agg(*(F.max(c).alias(c) for c in rows.columns if c != "word")).where("asked")
    pick = lambda *cs: F.coalesce(*(missing(c) for c in cs))
    source = lambda *pairs: reduce(lambda c, p: F.when(missing(p[1]).isNotNull(), p[0]).otherwise(c), reversed(pairs), F.lit(None).cast("string"))
    chosen = {
        "ipa": pick(F.when(F.col("cmu_phones").isNotNull(), X.ipa("cmu_phones")), "bi_phonetic"),
        "gloss_en": pick("cefr_gloss_en", "wiki_gloss_en", X.clean_gloss("bi_definition_en")),
        "gloss_zh": pick(X.clean_gloss("bi_translation_zh")),
        "pos": pick("cefr_pos", "wiki_pos", X.pos_code("bi_pos")),
        "level": level_conflict(F.array("oxford_cefr", "cefr_cefr"), strategy),
        "etymology": pick("wiki_etymology"),
        "gloss_source": source(("cefr", "cefr_gloss_en"), ("wiki", "wiki_gloss_en"), ("bilingual", "bi_definition_en")),
    }
    return out.select("word", *(c.alias(n) for n, c in chosen.items()))


def level_conflict(levels: Column, strategy: str = "hardest") -> Column:
    """One of the known levels of an array: hardest, easiest or most frequent (ties: first)."""
    known = F.filter(levels, lambda x: X.level_order(x).isNotNull())
    orders = F.transform(known, X.level_order)
    if strategy == "majority":
        counted = F.transform(known, lambda x, i: F.struct(F.size(F.filter(known, lambda y: F.upper(y) == F.upper(x))).alias("n"), (-i).alias("i"), x.alias("x")))
        return F.array_max(counted).x
    best = F.array_max(orders) if strategy == "hardest" else F.array_min(orders)
    return F.get(F.filter(known, lambda x: X.level_order(x) == best), F.lit(0))


def gloss_conflict(bank: Column, other: Column, strategy: str = "bank_first") -> Column:
    a, b = missing(bank), missing(other)
    if strategy == "both":
        return F.when(a.isNotNull() & b.isNotNull() & (a != b), F.concat(a, F.lit("；本书义："), b)).otherwise(F.coalesce(a, b))
    return F.coalesce(a, b) if strategy == "bank_first" else F.coalesce(b, a)


def family_bands(words: DataFrame, families: DataFrame) -> DataFrame:
    """words (word) with band: by the word itself, else by the first of s, es, ed, ing, er, est whose stem is a headword."""
    out = words.join(families.select("word", F.col("band").alias("b0")), "word", "left")
    for i, s in enumerate(("s", "es", "ed", "ing", "er", "est"), 1):
        stem = F.when(F.col("word").endswith(s) & (F.length("word") > len(s) + 2), X.without_last(F.col("word"), len(s)))
        out = out.withColumn("__stem", stem).join(families.select(F.col("word").alias("__stem"), F.col("band").alias(f"b{i}")), "__stem", "left").drop("__stem")
    return out.select(*words.columns, F.coalesce(*(f"b{i}" for i in range(7))).alias("band"))


def coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """(source, words): distinct keys of each dictionary."""
    parts = [d.agg(F.countDistinct("word").alias("words")).select(F.lit(n).alias("source"), "words") for n, d in sorted(tables.items())]
    return reduce(DataFrame.unionAll, parts)


# ---- filters: predicates over columns


def frequency_between(least: int = 1, most: int = 10**9) -> Column:
    return F.col("n").between(least, most)


def level_between(least: str, most: str) -> Column:
    """Unknown levels pass."""
    o = X.level_order("level")
    return o.isNull() | o.between(L.LEVELS.index(least), L.LEVELS.index(most))


def level_for(user: str, mode: str) -> Column:
    """learn: at the user's level or above; master: at or below. Unknown levels don't pass."""
    o, cap = X.level_order("level"), L.LEVELS.index(user) if user in L.LEVELS else 4
    return F.coalesce(o >= cap if mode == "learn" else o <= cap, F.lit(False))


def list_level_at_most(cap: str) -> Column:
    """By the level, else by zipf; words with neither pass, unknown labels don't."""
    o = F.when(missing("level").isNull(), X.level_order(X.level_of_zipf("zipf"))).otherwise(X.level_order("level"))
    return F.when(missing("level").isNull() & F.col("zipf").isNull(), True).otherwise(F.coalesce(o <= L.LEVELS.index(cap), F.lit(False)))


def no_function_word() -> Column:
    return ~F.lower("word").isin(*L.FILTER_WORDS)


def zipf_floor(least: float) -> Column:
    return F.col("zipf") >= least


def is_clean_word() -> Column:
    """3 to 30 letters, no digit, an apostrophe only as 's in ten letters or fewer, no joined words. Hyphens: see with_hyphens."""
    w = F.lower(X.stripped("word"))
    return F.length(w).between(3, 30) & ~w.rlike("[0-9]") & (~w.contains("'") | (w.endswith("'s") & (F.length(w) <= 10))) & ~w.contains("-") & ~X.is_joined_word("word")


def clean_words(words: DataFrame) -> DataFrame:
    """Words that pass is_clean_word, and those of two parts that are both words of zipf over 2."""
    plain = words.where(is_clean_word())
    parts = F.split("word", "-")
    known = words.where("zipf > 2").select("word")
    two = words.where(F.col("word").contains("-") & (F.size(parts) == 2) & F.length("word").between(3, 30) & ~F.col("word").contains("'")).withColumns({"__a": F.get(parts, F.lit(0)), "__b": F.get(parts, F.lit(1))})
    joined = two.join(known.select(F.col("word").alias("__a")), "__a", "left_semi").join(known.select(F.col("word").alias("__b")), "__b", "left_semi")
    return plain.unionByName(joined.select(*words.columns))


@dataclass(frozen=True)
class Gates:
    least_count: int = 2
    function_words: bool = True
    important_share: float = 0.25


def classic_filter(words: DataFrame, predicates: list[Column] | None = None, must: Column | None = None) -> DataFrame:
    """Words that pass every predicate, that are wanted anyway, or that have a special sense."""
    every = reduce(lambda a, b: a & b, predicates or [no_function_word(), frequency_between(2), zipf_floor(0)])
    return words.where(every | (must if must is not None else F.lit(False)) | F.lower("word").isin(*L.POLYSEMOUS))


def quantile_filter(words: DataFrame, u: float, important: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """(word, n, q, kept_by): difficult words (q), important ones (important) or both; important ones are capped by share.

    The cap: a quarter of all kept words (one at least), counted before; beyond
    it the important words with the lowest q go. Row numbers are distributed.
    """
    pool = clean_words(words.where(no_function_word()) if gates.function_words else words)
    pool = pool.join(important.select("word").distinct().withColumn("__i", F.lit(True)), "word", "left")
    wanted = (F.col("__i").isNotNull() | X.is_notable("word", "zipf")) & (F.col("n") >= gates.least_count)
    scored = pool.withColumn("q", F.round(X.difficulty("zipf", "band", "level"), 6)).withColumn("wanted", wanted)
    kept_by = F.when((F.col("q") >= u) & F.col("wanted"), "both").when(F.col("q") >= u, "q").when(F.col("wanted"), "important")
    kept = scored.select("word", "n", "q", kept_by.alias("kept_by")).where("kept_by is not null")
    return capped(kept, gates.important_share)


def capped(kept: DataFrame, share: float) -> DataFrame:
    sizes = kept.agg(F.count("*").alias("t"), F.count(F.when(F.col("kept_by") == "important", 1)).alias("i")).first()
    most = max(1, int(sizes["t"] * share))
    if sizes["i"] <= most:
        return kept
    ranked = numbered(kept.where("kept_by = 'important'"), F.desc("q"), "word", name="__r")
    return kept.where("kept_by <> 'important'").unionByName(ranked.where(F.col("__r") <= most).drop("__r"))
