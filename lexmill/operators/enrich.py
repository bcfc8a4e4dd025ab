"""Entries of selected words: dictionary fields, pronunciation, contexts, phenomena, morphemes, collocations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import expressions as X
from lexmill.functions import lexicon as L


def common_ipa(word) -> Column:
    """Map of accents of a common word; empty for others."""
    us, uk = (X.mapping({w: p[i] for w, p in L.COMMON_IPA.items()}, F.lower(X.col(word))) for i in (0, 1))
    return F.map_filter(F.create_map(F.lit("en_us"), us, F.lit("en_uk"), uk), lambda _, v: v.isNotNull())


#: Words of which a task holds the first places at once.
HELD = 200_000


def first_places(sentences: DataFrame, most: int = 3) -> DataFrame:
    """(word, doc_id, no, h) of sentences (doc_id, no, sentence, h): of each word the first places of every task, at most `most`, without the sentences.

    Words are those of expressions.corpus_tokens in small letters. A full table is sent and begun again, so a word may have more rows.
    """
    own, number = (sentences.schema[c].dataType.simpleString() for c in ("doc_id", "no"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = re.compile(L.TOKEN_PATTERN).findall
        best: dict[str, list[tuple]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            rows = [(w, *place[1:]) for w, places in best.items() for place in places]
            best.clear()
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 20_000], strict=True), types, strict=True)], names=["word", "doc_id", "no", "h"])

        for batch in batches:
            types = [pa.string(), *(batch.schema.field(c).type for c in ("doc_id", "no", "h"))]
            for i, no, text, h in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "no", "sentence", "h")), strict=True):
                text = text or ""
                place = (i is None, i, no, h)  # rows without an id are the last ones, as in SQL
                for w in set(tokens(text.lower())) if text.isascii() else {t.lower() for t in tokens(text)}:
                    held = best.get(w)
                    if held is None:
                        best[w] = [place]
                    elif len(held) < most or place < held[-1]:
                        if place not in held:
                            held.append(place)
                            held.sort()
                            del held[most:]
                if len(best) >= HELD:
                    yield from sent()
        yield from sent()

    return sentences.select("doc_id", "no", "sentence", "h").mapInArrow(run, f"word string, doc_id {own}, no {number}, h long")


def contexts(words: DataFrame, sentences: DataFrame, most: int = 3) -> DataFrame:
    """(word, contexts): the first sentences (doc_id, no, sentence) that hold each word, cleaned, at most `most`.

    Only places (id, number and hash) of the first sentences of each task go through the exchange by word;
    the sentences themselves are moved once, to the places that are left.
    """
    sentences = sentences.withColumn("h", F.xxhash64("sentence"))
    held = first_places(sentences, most).join(words.select("word").distinct(), "word").distinct()
    order = Window.partitionBy("word").orderBy(F.asc_nulls_last("doc_id"), "no", "h")
    first = held.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    wanted = first.select("word", "r", F.col("doc_id").alias("__i"), F.col("no").alias("__n"), F.col("h").alias("__h"))
    found = sentences.join(wanted.hint("shuffle_hash"), (F.col("h") == F.col("__h")) & (F.col("no") == F.col("__n")) & F.col("doc_id").eqNullSafe(F.col("__i")))
    xs = found.groupBy("word").agg(F.array_sort(F.collect_set(F.struct("r", "sentence"))).alias("xs"))
    return xs.select("word", X.clean_examples(F.col("xs.sentence")).alias("contexts"))


def numbered_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, no, sentence). There is always a sentence; the generator's outer form keeps a filter by size, which would cut the text once more, away."""
    return docs.select("doc_id", F.posexplode_outer(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+|\n")).alias("no", "sentence"))


def enrich(words: DataFrame, looked_up: DataFrame, found_contexts: DataFrame, phrases: DataFrame) -> DataFrame:
    """words (word, n, level) with every field that can be had offline.

    looked_up: of levels.look_up; phrases: (word, phrase, n, pmi) of ngrams.phrases_of.
    """
    order = Window.partitionBy("word").orderBy(F.desc("pmi"), F.desc("n"), "phrase")
    four = phrases.withColumn("r", F.row_number().over(order)).where("r <= 4")  # cut before each exchange, so common words stay small
    best = four.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "phrase"))), lambda s: s.phrase).alias("collocations"))
    d = looked_up.select("word", "ipa", "gloss_en", "gloss_zh", "pos", F.col("level").alias("bank_level"), "etymology")
    out = words.join(d, "word", "left").join(found_contexts, "word", "left").join(best, "word", "left")
    text = F.array_join(F.coalesce("contexts", F.array().cast("array<string>")), " ")
    return out.select(
        "word", "n", "pos", "gloss_en", "gloss_zh", "etymology", F.coalesce("level", "bank_level").alias("level"),
        F.when(F.col("ipa").isNotNull(), F.create_map(F.lit("en_us"), F.col("ipa"))).otherwise(common_ipa("word")).alias("ipa"),
        F.coalesce("contexts", F.array().cast("array<string>")).alias("examples"), F.coalesce("collocations", F.array().cast("array<string>")).alias("collocations"),
        X.morphemes("word").alias("morphemes"), X.phenomena("word", text).alias("phenomena"),
    )


def preview(entries: DataFrame, most: int = 300) -> DataFrame:
    """The first entries by frequency with two examples and four collocations."""
    return entries.orderBy(F.desc("n"), "word").limit(most).withColumn("examples", F.slice("examples", 1, 2)).withColumn("collocations", F.slice("collocations", 1, 4))
