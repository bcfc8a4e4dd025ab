"""License scans by diagonal voting.

Every k words in a row of every text are joined to the positions that these
words have in the templates, by hash and verified by the words themselves. A match
at word i of a text and position j of a template votes for the diagonal i - j.
Votes are summed by (text, template, diagonal). Of passage templates, diagonals
that lie near each other are merged, which bridges words put in or left out. A
phrase template (the base) counts only where one diagonal has every vote, which
is the phrase word for word.

A merged span is verified by aligning it: its matches are walked in the text's order, and
those that also go forward in the template pair words with words. The pairs must
make up most of the template's words and of the span's own. Templates of
different labels that share most of their words differ in some k-grams, those
that no other label's template has; a span must hold half of these. Of verified
spans that overlap, those with the most words aligned stay, so "CC BY" inside
"CC BY-NC" is no license of its own.

Templates may be of any length, whole licenses too; those with fewer words than
k are joined by as many words as they have. Templates are a parameter and go
through the same expressions as the texts, so no vote depends on how either was
split.

DataFrame operations only. One scan and one pass over the words serve both the
matches and the counts of words, and only matches are shuffled. Templates are
broadcast, as they are a literal of the plan and don't grow with the data.

Contract for odd rows: null and empty texts have no words, no labels and score
0; texts of any length are scanned whole; repeated rows each get a row (texts are
told apart by a row number); templates of one label are one label; other columns
take no part, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import WORD_PATTERN, fold, table, words_of
from lexmill.llm.license_texts import PASSAGES

#: Phrases that must stand word for word.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Words of a gram; share of a template's words that a span must align, of its own words that must be the template's, of the
#: template's grams that no other label has.
GRAM, COVERAGE, OWN, RARE = 4, 0.8, 0.5, 0.5
#: How far apart merged diagonals may be.
DRIFT = 2


def words(text: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))


def gram(at: Column, size: int) -> Column:
    """Hash of the first `size` words of a struct of words."""
    return F.xxhash64(F.lit(size), *(at[f"w{n}"] for n in range(size)))


def placed(rows: DataFrame, column: str, most: int, *kept: str) -> DataFrame:
    """The kept columns, i and w: each word's place in an array column and the `most` words from there on, as w.w0, w.w1, ...

    An empty array gives one row with nulls. The generator and get() run as
    generated code, so the array isn't copied to the rows.
    """
    return rows.select(*kept, column, F.posexplode_outer(column).alias("i", "w0")).select(*kept, "i", F.struct("w0", *(F.get(column, F.col("i") + n).alias(f"w{n}") for n in range(1, most))).alias("w"))


def templates(spark: SparkSession, phrases: dict[str, str], passages: list[tuple[str, str]], k: int) -> tuple[DataFrame, list[int]]:
    """(tid, label, base, size, length, grams, rares, tpos, t, gram, rare): a row for each gram of a template, t its words; and the sizes of grams.

    rare: no passage of another label has the gram.
    """
    listed = [*((label, text, True) for text, label in phrases.items()), *((label, text, False) for label, text in passages)]
    sizes = {min(k, len(words_of(text))) for _, text, _ in listed}
    if 0 in sizes:
        raise ValueError("a template has no words")
    literals = F.array(*(F.struct(F.lit(i).alias("tid"), F.lit(text).alias("text"), F.lit(label).alias("label"), F.lit(base).alias("base")) for i, (label, text, base) in enumerate(listed)))
    split = spark.range(1).select(F.inline(literals)).withColumn("words", words(F.col("text"))).withColumn("length", F.size("words"))
    split = split.withColumn("size", F.least(F.lit(k), F.col("length"))).withColumn("grams", F.col("length") - F.col("size") + 1)
    at = placed(split, "words", max(sizes), "tid", "label", "base", "size", "length", "grams").where(F.col("i") < F.col("grams"))
    hashed = F.lit(None).cast("long")
    for size in sorted(sizes):
        hashed = F.when(F.col("size") == size, gram(F.col("w"), size)).otherwise(hashed)
    every = at.select("tid", "label", "base", "size", "length", "grams", F.col("i").alias("tpos"), F.col("w").alias("t"), hashed.alias("gram"))
    labels = every.where(~F.col("base")).groupBy("gram").agg(F.countDistinct("label").alias("labels"))
    known = every.join(labels, "gram", "left").withColumn("rare", ~F.col("base") & (F.coalesce("labels", F.lit(0)) == 1)).drop("labels")
    rares = known.groupBy("tid").agg(F.count(F.when(F.col("rare"), 1)).alias("rares"))
    return known.join(rares, "tid"), sorted(sizes)


def aligned(at: Column, size: Column) -> Column:
    """(t, s): words of the template and of the text that matches (i, tpos, rare), walked in order, pair up."""
    start = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("t"), F.lit(0).alias("s"))

    def step(state: Column, hit: Column) -> Column:
        new = lambda at, last: F.when(last < 0, size).otherwise(F.least(size, at - last))
        on = F.struct(hit["i"].alias("i"), hit["tpos"].alias("j"), (state["t"] + new(hit["tpos"], state["j"])).alias("t"), (state["s"] + new(hit["i"], state["i"])).alias("s"))
        return F.when((hit["i"] > state["i"]) & (hit["tpos"] > state["j"]), on).otherwise(state)

    return F.aggregate(F.array_sort(at), start, step)


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, passages: list[tuple[str, str]] = PASSAGES, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, coverage: float = COVERAGE) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row of docs.

    spans: first and last word, label and coverage of each verified passage or phrase.
    """
    known, sizes = templates(docs.sparkSession, phrases, passages, k)
    most = max(sizes)
    texts = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), words(F.col(text_col)).alias("words"))
    at = placed(texts.withColumn("n_words", F.size("words").cast("long")), "words", most, "id", "row", "n_words")
    if len(sizes) == 1:
        at = at.withColumn("at", gram(F.col("w"), sizes[0]))
    else:
        at = at.withColumn("at", F.explode(F.array(*(gram(F.col("w"), s) for s in sizes))))
    same = F.lit(True)
    for n in range(most):
        same &= (F.col("size") <= n) | (F.col(f"w.w{n}") == F.col(f"t.w{n}"))
    hits = at.join(F.broadcast(known), (F.col("at") == F.col("gram")) & same, "left")
    hits = hits.where(F.col("tid").isNotNull() | F.col("i").isNull() | (F.col("i") == 0))
    hit = F.col("tid").isNotNull()
    passage = hit & ~F.col("base")
    template = ["row", "id", "n_words", "tid", "label", "base", "size", "length", "grams", "rares"]
    diagonals = (
        hits.withColumn("diagonal", F.col("i") - F.col("tpos"))
        .groupBy(*template, "diagonal")
        .agg(F.count(F.when(hit, 1)).alias("votes"), F.collect_list(F.when(passage, F.struct("i", "tpos", "rare"))).alias("at"), F.min(F.when(hit, F.col("i"))).alias("lo"), F.max(F.col("i") + F.col("size") - 1).alias("hi"))
    )
    along = Window.partitionBy("row", "tid").orderBy("diagonal")
    apart = F.col("base") | F.lag("diagonal").over(along).isNull() | (F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT)
    bands = (
        diagonals.withColumn("band", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(along))
        .groupBy(*template, "band")
        .agg(F.max("votes").alias("votes"), F.flatten(F.collect_list("at")).alias("at"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .withColumn("pairs", F.when(passage, aligned(F.col("at"), F.col("size"))))
        .withColumn("coverage", F.when(F.col("base"), F.col("votes") / F.col("grams")).otherwise(F.col("pairs.t") / F.col("length")))
        .withColumn("own", F.col("pairs.s") / (F.col("hi") - F.col("lo") + 1))
        .withColumn("held", F.size(F.array_distinct(F.transform(F.filter("at", lambda x: x["rare"]), lambda x: x["tpos"]))))
    )
    whole = F.col("base") & (F.col("votes") == F.col("grams"))
    near = F.coalesce(passage & (F.col("coverage") >= coverage) & (F.col("own") >= OWN) & (F.col("held") >= RARE * F.col("rares")), F.lit(False))
    # Islands of overlapping verified spans: of each the spans with most words aligned stay.
    before = Window.partitionBy("row", "near").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy("row", "near").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    island = Window.partitionBy("row", "near", "island")
    weight = F.struct(F.col("pairs.t"), F.col("coverage"))
    spans = (
        bands.withColumn("near", near)
        .withColumn("new", F.coalesce(F.col("lo") > F.max("hi").over(before), F.lit(True)).cast("int"))
        .withColumn("island", F.sum("new").over(through))
        .withColumn("best", F.col("near") & (weight == F.max(weight).over(island)))
    )
    best = F.coalesce("best", F.lit(False))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return (
        spans.groupBy("row", "id", "n_words")
        .agg(
            F.count(F.when(whole, 1)).alias("n_base"),
            F.min(F.when(whole, F.col("lo"))).cast("long").alias("first_word"),
            F.max(F.when(whole, F.col("lo"))).cast("long").alias("last_word"),
            listed(whole).alias("base_labels"),
            listed(whole | best).alias("labels"),
            F.coalesce(F.max(F.when(whole, F.lit(1.0)).when(passage, F.col("coverage") * F.least(F.lit(1.0), F.col("own") / OWN))), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_list(F.when(whole | best, F.struct(F.col("lo").alias("first"), F.col("hi").alias("last"), "label", "coverage")))).alias("spans"),
        )
        .drop("row")
        .withColumnRenamed("id", id_col)
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")
