"""Programmatic surface: generators by name, predicates and enrichers to register, and execute(), which answers in JSON."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import expressions as X
from lexmill.functions import lexicon as L
from lexmill.operators import corpus, enrich, levels, ngrams, reports, reviews
from lexmill.operators.ranking import durable
from lexmill.sources import readers

GENERATORS: dict[str, Callable[..., DataFrame]] = {}
PREDICATES: dict[str, Callable[..., Column]] = {"frequency": levels.frequency_between, "level_between": levels.level_between, "level_for": levels.level_for, "zipf_floor": levels.zipf_floor, "no_function_word": levels.no_function_word}
LANGUAGES = {"de", "en", "es", "fr"}
REQUIRED = ["word", "pos", "ipa", "gloss"]
#: Field of an entry to the function that gives it as a column of a word.
ENRICHERS: dict[str, Callable[..., Column]] = {"ipa": enrich.common_ipa, "morpheme": X.morphemes}
#: What a session of this surface is given from outside: a model (prompt to reply) and a reader (bytes to page texts).
INJECTED: dict[str, Callable | None] = {"model": None, "reader": None}
#: Calls of execute() and their arguments.
CALLS = {
    "list_languages": [], "list_generators": [], "validate_entry": REQUIRED, "clean_examples": ["examples"], "generate_vocabulary": ["docs", "generator", "options"],
    "lookup_word": ["word", "dictionaries"], "extract_collocations": ["texts", "n", "min_count", "top_n"], "quantile_of": ["zipf", "band", "level"],
    "bank_coverage": ["dictionaries"], "srs_plan": ["words", "days"], "srs_review": ["quality", "state"],
}


def register_language(lang: str) -> bool:
    LANGUAGES.add(lang)
    return True


def register_predicate(name: str):
    """A predicate is a function of plain arguments that gives a boolean column."""

    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        PREDICATES[name] = f
        return f

    return add


def keep(words: DataFrame, *wanted: tuple) -> DataFrame:
    """words that all named predicates keep; wanted: (name, argument, ...) each. Without any, all stay."""
    return reduce(lambda df, w: df.where(PREDICATES[w[0]](*w[1:])), wanted, words)


def register_enricher(name: str):
    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        ENRICHERS[name] = f
        return f

    return add


def inject(model: Callable | None = None, reader: Callable | None = None) -> None:
    """Set the model or the reader; those that aren't given stay."""
    INJECTED.update({k: v for k, v in (("model", model), ("reader", reader)) if v is not None})


def reset() -> None:
    INJECTED.update(dict.fromkeys(INJECTED))


def call_schema(name: str) -> dict:
    """A call's name and arguments, for those who list it as a tool."""
    return {"name": name, "parameters": {"type": "object", "properties": {a: {} for a in CALLS[name]}}}


def register_generator(name: str):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        GENERATORS[name] = f
        return f

    return add


def clean_words(docs: DataFrame) -> DataFrame:
    """(word, n, zipf, rank, band, level) of the clean lemmas of documents (doc_id, text)."""
    table = durable(corpus.word_table(readers.tokens(docs.withColumn("text", corpus.repair("text")))))
    # The texts are read once: a lemma's count is the sum of its words'.
    clean = table.select("word", "n").join(corpus.clean_lemmas(corpus.lemmas(table)), "word")
    counts = durable(clean.groupBy(F.lower("lemma").alias("word")).agg(F.sum("n").alias("n")))
    return durable(corpus.ranked_words(counts).withColumn("level", X.level_of_zipf("zipf")))


def difficult_words(docs: DataFrame) -> DataFrame:
    """(word, n, q, tier) of the clean lemmas of documents."""
    return clean_words(docs).select("word", "n", F.round(X.difficulty("zipf", "band", "level"), 6).alias("q")).withColumn("tier", X.tier("q"))


@register_generator("vocabulary")
def vocabulary(docs: DataFrame, u: float = 0.6, important: DataFrame | None = None, gates: levels.Gates = levels.Gates(), most: int = 2500) -> DataFrame:
    """From documents (doc_id, text) to the selected words with difficulty, tier and reason, most frequent first."""
    words = clean_words(docs)
    kept = levels.quantile_filter(words, u, important if important is not None else words.select("word").limit(0), gates)
    return kept.withColumn("tier", X.tier("q")).orderBy(F.desc("n"), "word").limit(most)


def _rows(df: DataFrame, most: int = 2500) -> list[dict]:
    """A bounded answer as Python values."""
    return [json.loads(x) for x in df.limit(most).toJSON().collect()]


def execute(spark: SparkSession, name: str, args: dict | None = None) -> str:
    """Run one of the named calls; the answer is JSON with ok, and error where it failed."""
    args = args or {}
    lit = lambda values, c, t: levels.literal_table(spark, [(v,) for v in values], (c, t)) if values else spark.createDataFrame([], f"{c} {t}")
    try:
        match name:
            case "list_languages":
                out = {"languages": sorted(LANGUAGES)}
            case "list_generators":
                out = {"generators": sorted(GENERATORS)}
            case "validate_entry":
                entry = {k: str(args.get(k) or "") for k in REQUIRED}
                row = levels.literal_table(spark, [tuple(entry.values())], *((k, "string") for k in REQUIRED))
                out = {"missing": reports.missing_fields(row, REQUIRED).first()["missing"]}
            case "clean_examples":
                row = spark.range(1).select(F.array(*map(F.lit, args["examples"])).cast("array<string>").alias("x"))
                out = {"examples": row.select(X.clean_examples("x").alias("x")).first()["x"]}
            case "extract_collocations":
                docs = lit(args["texts"], "text", "string").withColumn("doc_id", F.monotonically_increasing_id())
                found = ngrams.collocations(docs, args.get("n", 2), args.get("min_count", 2))
                out = {"collocations": _rows(ngrams.top(found, args.get("top_n", 50)))}
            case "quantile_of":
                row = spark.range(1).select(X.difficulty(F.lit(args.get("zipf")).cast("double"), F.lit(args.get("band")).cast("int"), F.lit(args.get("level")).cast("string")).alias("q")).select("q", X.tier("q").alias("tier"))
                out = row.first().asDict()
            case "lookup_word":
                out = {"entry": (_rows(levels.look_up(lit([args["word"].strip().lower()], "word", "string"), **args["dictionaries"])) or [None])[0]}
            case "bank_coverage":
                out = {"sources": _rows(levels.coverage(args["dictionaries"]))}
            case "srs_plan":
                out = {"plan": _rows(reviews.plan(lit(args["words"], "word", "string"), args.get("days", 7)))}
            case "srs_review":
                s = args.get("state", {"ease": L.START_EASE, "interval": 0, "reps": 0})
                out = {"state": spark.range(1).select(X.review_step(*(F.lit(s[k]) for k in ("ease", "interval", "reps")), F.lit(args["quality"])).alias("s")).first()["s"].asDict()}
            case "generate_vocabulary":
                out = {"words": _rows(GENERATORS[args.get("generator", "vocabulary")](args["docs"], **args.get("options", {})))}
            case _:
                return json.dumps({"ok": False, "error": f"unknown call {name}"})
    except (KeyError, TypeError, ValueError) as e:
        return json.dumps({"ok": False, "error": f"{type(e).__name__}: {e}"})
    return json.dumps({"ok": True, **out}, ensure_ascii=False)
