"""The library in SQL: temporary functions and table functions over any table.

install() registers, in a session:

    lexmill_difficulty(zipf, band, level)  lexmill_tier(q)  lexmill_level(zipf)      scalar; the library's own
    lexmill_missing_fields(word, pos, ipa, gloss)  lexmill_clean_example(s)          column expressions, which
    lexmill_clean_examples(array)  lexmill_review(ease, interval, reps, quality)     Catalyst inlines
    lexmill_languages()  lexmill_generators()                                        what is registered
    lexmill_lookup(word)  lexmill_coverage()                                         of the given dictionaries
    lexmill_vocabulary(u)                                                            of the given documents
    lexmill_review_days(days)                                                        days of a word's reviews
    lexmill_ngrams(TABLE(t), 'text', n)                                              w1 to wn, row by row
    lexmill_replay(TABLE(t) PARTITION BY key ORDER BY (time))                         state after all reviews

Table functions over a word are correlated subqueries, so `FROM t, LATERAL
lexmill_lookup(t.word)` is a plain join. lexmill_replay reads each key's reviews
one after the other in the order given and holds one state, not the history.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lexmill import api
from lexmill.functions import expressions as X
from lexmill.functions import lexicon as L
from lexmill.operators import levels
from lexmill.streaming.reviews import step

BANK = ("word", "ipa", "gloss_en", "gloss_zh", "pos", "level", "etymology", "gloss_source")


def expression(spark: SparkSession, column: Column, parameters: str) -> str:
    """A column over the named parameters as the SQL text that Spark gives of it."""
    rows = spark.createDataFrame([], parameters).select(column.alias("x"))
    return rows._jdf.queryExecution().analyzed().expressions().apply(0).child().sql()


def scalars() -> list[tuple[str, str, str, Column | str]]:
    """(name, parameters, type, body) of the scalar functions."""
    missing = F.array_compact(F.array(*(F.when(F.coalesce(X.stripped(F.col(c)), F.lit("")) == "", c) for c in api.REQUIRED)))
    return [
        ("lexmill_difficulty", "zipf double, band int, level string", "double", X.difficulty("zipf", "band", "level")),
        ("lexmill_tier", "q double", "int", X.tier("q")),
        ("lexmill_level", "zipf double", "string", X.level_of_zipf("zipf")),
        ("lexmill_missing_fields", ", ".join(f"{c} string" for c in api.REQUIRED), "array<string>", missing),
        ("lexmill_clean_example", "example string", "string", X.clean_example("example")),
        ("lexmill_clean_examples", "examples array<string>", "array<string>", "array_distinct(filter(transform(examples, x -> {}), y -> y <> ''))"),
        ("lexmill_review", "ease double, interval int, reps int, quality int", "struct<ease: double, interval: int, reps: int, status: string>", X.review_step("ease", "interval", "reps", "quality")),
    ]


class ReviewDays:
    """(day, ease, interval) of every review up to a day, each with the best mark."""

    def eval(self, days: int) -> Iterator[tuple[int, float, int]]:
        state, day = (L.START_EASE, 0, 0), 0
        while day < (days or 0):
            state = step(*state, 5)
            yield day, state[0], state[1]
            day += state[1]


class Ngrams:
    """(w1, ..., wn) of every run of n words of a text column."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or text.value is None or not isinstance(n.value, int) or n.value < 1:
            raise ValueError("lexmill_ngrams(TABLE(...), 'column', n)")
        if text.value not in rows.dataType.names:
            raise ValueError(f"there is no column {text.value}")
        kind = StructType()
        for i in range(1, n.value + 1):
            kind = kind.add(f"w{i}", StringType())
        return AnalyzeResult(kind)

    def __init__(self):
        self.words = re.compile(L.PHRASE_TOKEN_PATTERN).findall

    def eval(self, row: Row, text: str, n: int) -> Iterator[tuple[str, ...]]:
        words = self.words((row[text] or "").lower())
        yield from zip(*(words[i:] for i in range(n)), strict=False)


class Replay:
    """The partition's columns and (ease, interval, reps, status, reviews) after all rows of a partition, in their order."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        names = rows.dataType.names if rows.isTable else []
        if "key" not in names or "quality" not in names:
            raise ValueError("lexmill_replay(TABLE(SELECT ... AS key, ... AS quality, ...) PARTITION BY key ORDER BY ...)")
        kind = StructType().add("key", rows.dataType["key"].dataType)
        return AnalyzeResult(kind.add("ease", DoubleType()).add("interval", IntegerType()).add("reps", IntegerType()).add("status", StringType()).add("reviews", LongType()))

    def __init__(self):
        self.key, self.state, self.status, self.n = None, (L.START_EASE, 0, 0), "new", 0

    def eval(self, row: Row) -> None:
        self.key = row["key"]
        q = min(5, max(0, int(row["quality"])))
        self.state = step(*self.state, q)
        self.status = "learned" if q >= 4 else "reviewing" if q == 3 else "forgot"
        self.n += 1

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            yield self.key, *self.state, self.status, self.n


def install(spark: SparkSession, dictionaries: dict[str, DataFrame] | None = None, words: DataFrame | None = None, documents: DataFrame | None = None) -> None:
    """Register the functions. lexmill_lookup and lexmill_coverage need dictionaries (arguments of levels.look_up()) and the words to
    look up, lexmill_vocabulary needs documents (doc_id, text)."""
    for name, parameters, kind, body in scalars():
        # No function may be called inside a lambda: its text goes there.
        text = body.format(expression(spark, X.clean_example("x"), "x string")) if isinstance(body, str) else expression(spark, body, parameters)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {text}")
    listed = lambda names: ", ".join("'" + n.replace("'", "''") + "'" for n in sorted(names))
    for name, column, values in (("lexmill_languages", "language", api.LANGUAGES), ("lexmill_generators", "generator", api.GENERATORS)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}() RETURNS TABLE({column} string) RETURN SELECT explode(array({listed(values)}))")
    spark.udtf.register("lexmill_review_days", F.udtf(ReviewDays, returnType="day int, ease double, interval int"))
    spark.udtf.register("lexmill_ngrams", F.udtf(Ngrams))
    spark.udtf.register("lexmill_replay", F.udtf(Replay))
    if dictionaries is not None and words is not None:
        levels.look_up(words, **{"wiki" if k == "wiktionary" else k: v for k, v in dictionaries.items()}).createOrReplaceTempView("lexmill_bank")
        levels.coverage(dictionaries).createOrReplaceTempView("lexmill_bank_coverage")
        kinds = {f.name: f.dataType.simpleString() for f in spark.table("lexmill_bank").schema}
        columns = [c for c in BANK if c in kinds]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION lexmill_lookup(wanted string) RETURNS TABLE({', '.join(f'{c} {kinds[c]}' for c in columns)}) RETURN SELECT {', '.join(columns)} FROM lexmill_bank WHERE word = lower(trim(wanted))")
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION lexmill_coverage() RETURNS TABLE(source string, words bigint) RETURN SELECT source, words FROM lexmill_bank_coverage")
    if documents is not None:
        api.difficult_words(documents).createOrReplaceTempView("lexmill_words")
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION lexmill_vocabulary(u double) RETURNS TABLE(word string, n bigint, q double, tier int) RETURN SELECT word, n, q, tier FROM lexmill_words WHERE q >= u")
