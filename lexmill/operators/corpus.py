"""Cleaning of pages and lines; tokens to lemmas; word tables; the clean corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import expressions as X
from lexmill.functions import lexicon as L
from lexmill.operators.ranking import durable, numbered, running
from lexmill.sources import readers


def strip_headers(pages: DataFrame) -> DataFrame:
    """Pages with header and footer kept only where they are neither page numbers nor repeated on half of a book's pages (three at least)."""
    for c in ("header", "footer"):
        key = F.coalesce(X.repeat_key(c), F.lit(""))
        counts = pages.groupBy("book", key.alias("__k")).agg(F.count("*").alias("__n"))
        sizes = pages.groupBy("book").agg(F.count("*").alias("__pages"))
        most = F.greatest(F.lit(3), F.floor((F.col("__pages") + 1) / 2))
        pages = pages.withColumn("__k", key).join(counts, ["book", "__k"]).join(sizes, "book")
        pages = pages.withColumn(c, F.when(X.is_page_number(c) | (F.col("__n") >= most), F.lit(None)).otherwise(F.col(c))).drop("__k", "__n", "__pages")
    return pages


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, kept): in texts of three lines or more, page numbers and short lines that occur three times in the text go; blank lines stay."""
    rows = readers.lines(docs).withColumn("key", X.repeat_key("line")).withColumn("short", (F.length(X.stripped("line")) <= 60) & (X.stripped("line") != ""))
    own = Window.partitionBy("doc_id", "key")
    n = F.count(F.when(F.col("short"), 1)).over(own)
    size = F.count("*").over(Window.partitionBy("doc_id"))
    drop = (size >= 3) & (X.stripped("line") != "") & (X.is_page_number("line") | (F.col("short") & (n >= 3)))
    return rows.select("doc_id", "line_no", "line", (~drop).alias("kept"))


def strip_repeated_lines(docs: DataFrame) -> DataFrame:
    kept = repeated_lines(docs).where("kept").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return kept.select("doc_id", F.array_join(F.col("ls.line"), "\n").alias("text"))


def repair(text_col: str = "text", lang: str = "en"):
    """Characters composed, hyphens at line ends joined (English only); blank texts stay as they are."""
    text = X.composed(F.col(text_col))
    return F.when(X.stripped(text_col) == "", F.col(text_col)).otherwise(X.joined_hyphens(text) if lang == "en" else text)


def counted_words(tokens: DataFrame) -> DataFrame:
    """(word, n, first_doc)."""
    return tokens.groupBy(F.lower("token").alias("word")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_types) of documents with tokens.

    A row is counted where it is read and sends three numbers; only the rows of ids
    that occur more than once send their distinct words too.
    """
    ws = docs.select("doc_id", X.corpus_tokens("text").alias("ws"))
    sizes = ws.select("doc_id", F.size("ws").alias("n"), F.size(F.array_distinct(F.transform("ws", F.lower))).alias("types"))
    counted = durable(sizes.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.max("types").cast("long").alias("n_types"), F.count("*").alias("rows")).where("n_tokens > 0"))
    several = counted.where("rows > 1").select(F.col("doc_id").alias("id"), "n_tokens")
    words = docs.join(several, F.col("doc_id").eqNullSafe(F.col("id"))).select("id", "n_tokens", F.explode(F.array_distinct(F.transform(X.corpus_tokens("text"), F.lower))).alias("word"))
    joined = words.groupBy("id", "n_tokens").agg(F.countDistinct("word").alias("n_types"))
    return counted.where("rows = 1").select("doc_id", "n_tokens", "n_types").unionAll(joined.select(F.col("id").alias("doc_id"), "n_tokens", "n_types"))


def ranked_words(words: DataFrame) -> DataFrame:
    """words (word, n, ...) with zipf, the frequency per billion words on a log scale, a band of 1 to 10 from it, and a rank that is smaller for more common words."""
    total = words.agg(F.sum("n").alias("total"))
    zipf = F.round(F.log10(F.col("n") * 1e9 / F.col("total")), 6)
    sized = words.join(F.broadcast(total)).select(*words.columns, zipf.alias("zipf"), (F.col("total") - F.col("n") + 1).alias("rank"))
    return sized.withColumn("band", F.least(F.lit(10), F.greatest(F.lit(1), F.ceil((8 - F.col("zipf")) * 2))).cast("int"))


def word_table(tokens: DataFrame) -> DataFrame:
    """(word, n, zipf, rank, band) of tokens."""
    return ranked_words(tokens.groupBy(F.lower("token").alias("word")).agg(F.count("*").alias("n")))


def lemmas(words: DataFrame) -> DataFrame:
    """(word, lemma) of a table with word and rank: only distinct words are looked up; stems of -ing and -ed are restored by rank."""
    ranks = words.select("word", "rank")
    rule = words.select("word", "rank", X.plural_lemma(F.col("word")).alias("lemma"))
    done = rule.where("lemma is not null").select("word", "lemma")
    w = F.col("word")
    base = F.when(w.endswith("ing"), X.without_last(w, 3)).otherwise(X.without_last(w, 2))
    last = F.substring("base", -1, 1)
    tries = (
        rule.where("lemma is null")
        .select("word", F.col("rank").alias("own"), base.alias("base"))
        .select("*", F.when(~last.rlike("[aeiouy]"), F.concat("base", F.lit("e"))).alias("with_e"), F.when((F.length("base") >= 3) & (last == F.substring("base", -2, 1)) & ~last.rlike("[aeiouy]"), X.without_last(F.col("base"), 1)).alias("single"))
    )
    #: All stems of all words meet the ranks in one join.
    kinds = ("base", "with_e", "single")
    stems = tries.select("word", "own", F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("stem")) for c in kinds))).alias("s")).select("word", "own", "s.kind", "s.stem").where("stem is not null")
    ranked = stems.join(ranks.select(F.col("word").alias("stem"), "rank"), "stem", "left")
    of = lambda c, name: F.max(F.when(F.col("kind") == c, F.col(name)))
    tries = ranked.groupBy("word", "own").agg(*(of(c, "stem").alias(c) for c in kinds), *(of(c, "rank").alias(f"{c}_rank") for c in kinds))
    stem = lambda a, b, c: F.when(X.more_common("with_e_rank", "base_rank"), a).when(X.more_common("single_rank", "base_rank"), b).otherwise(c)
    restored = tries.select("word", "own", stem(F.col("with_e"), F.col("single"), F.col("base")).alias("stem"), stem(F.col("with_e_rank"), F.col("single_rank"), F.col("base_rank")).alias("stem_rank"))
    return done.unionAll(restored.select("word", F.when(X.more_common("stem_rank", "own"), F.col("stem")).otherwise(F.col("word")).alias("lemma")))


def recover_truncated(words: DataFrame, known: DataFrame) -> DataFrame:
    """(word, recovered): words of four letters or more that aren't in known(word) get the first of +e, +es, +ed, +d that is."""
    out = words.select("word").join(known.select("word", F.lit(True).alias("own")), "word", "left")
    for s in ("e", "es", "ed", "d"):
        out = out.join(known.select(F.expr(f"substring(word, 1, length(word) - {len(s)})").alias("word"), F.col("word").alias(f"as_{s}")).where(F.col(f"as_{s}").endswith(s)), "word", "left")
    longer = F.coalesce("as_e", "as_es", "as_ed", "as_d", "word")
    return out.select("word", F.when((F.length("word") < 4) | F.col("own").isNotNull(), F.col("word")).otherwise(longer).alias("recovered"))


def clean_lemmas(lemma_of: DataFrame) -> DataFrame:
    """Of (word, lemma) those that are no stop word (word or lemma), single letter or noise."""
    return lemma_of.where(~F.col("word").isin(*L.STOP_WORDS) & ~F.col("lemma").isin(*L.STOP_WORDS) & (F.length("lemma") >= 2) & ~X.is_noise("word") & ~X.is_noise("lemma"))


def lemma_table(tokens: DataFrame) -> DataFrame:
    """(lemma, n, first_doc) of the clean corpus in one pass over the tokens: all else is done with distinct words."""
    words = durable(counted_words(tokens))
    lemma_of = clean_lemmas(lemmas(ranked_words(words)))
    return words.join(lemma_of, "word").groupBy("lemma").agg(F.sum("n").alias("n"), F.min("first_doc").alias("first_doc"))


def clean_tokens(tokens: DataFrame, lemma_of: DataFrame) -> DataFrame:
    """(doc_id, pos, token, lemma) without stop words (token or lemma), single letters and noise; words are tested once each, in the lemma table."""
    wanted = clean_lemmas(lemma_of)
    #: The most frequent words are stop words: they go before the exchange, not in it.
    words = tokens.withColumn("word", F.lower("token")).where(~F.col("word").isin(*L.STOP_WORDS) & (F.length("word") >= 2))
    return words.join(wanted, "word").select("doc_id", "pos", "token", "lemma")


def clean_places(docs: DataFrame, lemma_of: DataFrame) -> DataFrame:
    """(doc_id, places): of each row of docs the places of the tokens of clean_tokens(), in order; rows without any are left out.

    The words that are left out are few (stop words, noise, forms of both) and go to every task; no token goes through an
    exchange. A row's tokens come one after the other, so a task puts them together again as they pass.
    """
    out = lemma_of.select("word").join(clean_lemmas(lemma_of).select("word"), "word", "left_anti")
    own = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("at"))
    tokens = rows.select("doc_id", "at", F.posexplode_outer(X.corpus_tokens("text")).alias("pos", "token")).withColumn("word", F.lower("token"))
    kept = tokens.join(F.broadcast(out), "word", "left_anti").where("pos is not null").select("doc_id", "at", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row at the end of a batch may go on in the next one
        for batch in batches:
            if not batch.num_rows:
                continue
            at, pos, ids = batch.column("at").to_numpy(), batch.column("pos").to_numpy(), batch.column("doc_id")
            if last is not None:
                at, pos, ids = np.concatenate([last[0], at]), np.concatenate([last[1], pos]), pa.concat_arrays([last[2], ids])
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            end = int(starts[-1])
            last = at[end:], pos[end:], ids.slice(end)
            if end:
                yield grouped(ids, pos[:end], starts[:-1])
        if last is not None:
            yield grouped(last[2], last[1], np.zeros(1, np.int64))

    return kept.mapInArrow(run, f"doc_id {own.simpleString()}, places array<int>")


def grouped(ids: pa.Array, pos: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    ends = np.append(starts, len(pos)).astype(np.int32)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(starts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(pos.astype(np.int32)))], names=["doc_id", "places"])


def paged_places(places: DataFrame, size: int = 500) -> DataFrame:
    """(doc_id, pos, page_no) of (doc_id, places): all places in the order of doc_id and pos, `size` to a page; rows without an id come last.

    Only one row for each id is put in order: its places start where those of the ids before it end.
    The places of an id that has several rows are numbered one by one.
    """
    places = durable(places)
    own = F.size("places").cast("long")
    counts = running(places.groupBy("doc_id").agg(F.sum(own).alias("n"), F.count("*").alias("rows")), F.asc_nulls_last("doc_id"), value="n", name="before").select(F.col("doc_id").alias("__i"), "rows", "before")
    counts = durable(counts)
    met = F.col("doc_id").eqNullSafe(F.col("__i"))
    page = lambda n: (F.floor(n / size) + 1).alias("page_no")
    once = places.join(counts.where("rows = 1"), met).select("doc_id", "before", F.posexplode("places").alias("k", "pos")).select("doc_id", "pos", page(F.col("before") + F.col("k")))
    several = counts.where("rows > 1")
    if several.isEmpty():
        return once
    mixed = places.join(several, met).select("doc_id", "before", F.explode("places").alias("pos"))
    numbers = durable(numbered(mixed, F.asc_nulls_last("doc_id"), "pos"))
    first = numbers.groupBy("doc_id").agg(F.min("n").alias("first")).withColumnRenamed("doc_id", "__i")
    return once.unionAll(numbers.join(first, met).select("doc_id", "pos", page(F.col("before") + F.col("n") - F.col("first"))))


def word_decisions(words: DataFrame, tags: DataFrame | None = None, least: int = 5) -> DataFrame:
    """(word, surface, lemma, independent, reason) of every word (word, n, rank) that belongs to the clean corpus.

    surface: the word with its cut end restored, where a word of at least `least` occurrences continues it.
    tags: (word, pos); without them, forms count as nouns. All is decided once for each word, not for each token.
    """
    surfaces = recover_truncated(words, words.where(F.col("n") >= least)).withColumnRenamed("recovered", "surface")
    lemma_of = lemmas(words)
    rows = surfaces.join(lemma_of.select(F.col("word").alias("surface"), "lemma"), "surface")
    if tags is None:
        rows = rows.withColumns({"pos": F.lit("NOUN"), "lemma_pos": F.lit("NOUN")})
    else:
        own, of = (tags.select(F.col("word").alias(c), F.col("pos").alias(p)) for c, p in (("surface", "pos"), ("lemma", "lemma_pos")))
        rows = rows.join(own, "surface", "left").join(of, "lemma", "left").withColumn("lemma_pos", F.coalesce("lemma_pos", "pos"))
    wanted = ~F.col("surface").isin(*L.STOP_WORDS) & ~F.col("lemma").isin(*L.STOP_WORDS) & (F.length("lemma") >= 2) & ~X.is_noise("lemma")
    made = X.form_decision("surface", "lemma", "pos", "lemma_pos", X.term_context(freq=F.lit(1)))
    return rows.where(wanted).select("word", "surface", "lemma", made["independent"].alias("independent"), made["reason"].alias("reason"))


def clean_corpus(tokens: DataFrame, decisions: DataFrame, page: int = 500) -> DataFrame:
    """(doc_id, pos, token, lemma, context, page_no): the clean corpus in order, `page` rows to a page.

    A word that stands on its own appears once, where it comes first, as itself
    and with the reason; every other token appears with its lemma. Pages come from row numbers over range partitions.
    """
    rows = tokens.withColumn("word", F.lower("token")).join(decisions, "word")
    once = first_of_each(rows.where("independent").drop("word"), "surface", "doc_id", "pos")
    every = rows.where("not independent").drop("word").select(*once.columns)
    lemma = F.when(F.col("independent"), F.col("surface")).otherwise(F.col("lemma"))
    emitted = once.unionAll(every).select("doc_id", "pos", F.col("surface").alias("token"), lemma.alias("lemma"), F.when(F.col("independent"), F.col("reason")).otherwise("").alias("context"))
    return numbered(emitted, "doc_id", "pos").withColumn("page_no", F.floor((F.col("n") - 1) / page) + 1).drop("n")


def first_of_each(tokens: DataFrame, key: str, *order: str) -> DataFrame:
    """Of rows with one key only the first in the order."""
    rest = [c for c in tokens.columns if c != key]
    first = tokens.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__f"))
    return first.select(key, *(F.col("__f")[c].alias(c) for c in rest)).select(*tokens.columns)


def term_signals(docs: DataFrame, words: DataFrame) -> DataFrame:
    """words (word, n, ..) with the signals of form_decision(): in_heading (a document's first line has the word), capitalized, freq."""
    heads = docs.select(F.explode(X.corpus_tokens(F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1))).alias("t")).select(F.lower("t").alias("word")).distinct()
    names = proper_nouns(capital_stats(docs)).select("word")
    flagged = lambda df, name: df.withColumn(name, F.lit(True))
    out = words.join(flagged(heads, "in_heading"), "word", "left").join(flagged(names, "capitalized"), "word", "left")
    return out.withColumns({"in_heading": F.coalesce("in_heading", F.lit(False)), "capitalized": F.coalesce("capitalized", F.lit(False)), "freq": F.col("n")})


#: Letters that words run together have at least; the longest part of one that is looked for.
RUN, PART = 8, 24


def split_joined(words: DataFrame, known: DataFrame) -> DataFrame:
    """(word, parts): each long word as the cheapest series of known (word, rank) words, itself if it is cheapest or nothing fits.

    A word costs the logarithm of its rank times the logarithm of their number.
    Its pieces are looked up in a join, so the table of known words may be of any size.
    """
    total = known.agg(F.log(F.count("*") + F.lit(1.0)).alias("size"))
    costs = known.join(F.broadcast(total)).select(F.col("word").alias("piece"), F.log(F.greatest(F.lit(1), F.col("rank")) * F.col("size")).alias("cost"))
    long_ = words.select("word").distinct().where(F.col("word").rlike(f"^[a-z]{{{RUN},}}$"))
    at = long_.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("i"))
    pieces = at.select("word", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(PART), F.length("word") - F.col("i")))).alias("k")).select("word", "i", "k", F.substring("word", F.col("i") + 1, F.col("k")).alias("piece"))
    held = pieces.join(costs, "piece").groupBy("word").agg(F.collect_list(F.struct("i", "k", "cost")).alias("pieces"))

    @F.pandas_udf("array<string>")
    def cheapest(word: pd.Series, pieces: pd.Series) -> pd.Series:
        def one(w: str, found) -> list[str]:
            best: list[tuple[float, int]] = [(0.0, 0)] + [(math.inf, 0)] * len(w)
            for i, k, cost in sorted((p["i"], p["k"], p["cost"]) for p in found):
                if best[i][0] + cost < best[i + k][0]:
                    best[i + k] = (best[i][0] + cost, k)
            at, parts = len(w), []
            while at and best[at][0] < math.inf:
                parts.append(w[at - best[at][1] : at])
                at -= best[at][1]
            return parts[::-1] if parts else [w]

        return pd.Series([one(w, found) for w, found in zip(word, pieces, strict=True)])

    split = held.select("word", cheapest("word", "pieces").alias("parts"))
    return long_.join(split, "word", "left").select("word", F.coalesce("parts", F.array("word")).alias("parts"))


def capital_stats(docs: DataFrame) -> DataFrame:
    """(word, upper, total) over words that don't start a sentence; words that occur twice at least."""
    sentences = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"[.!?]\s*|\n")).alias("s"))
    inside = sentences.select(F.explode(F.slice(X.corpus_tokens("s"), 2, 1_000_000_000)).alias("token"))
    return inside.groupBy(F.lower("token").alias("word")).agg(F.count(F.when(F.col("token").rlike("^[A-Z]"), 1)).alias("upper"), F.count("*").alias("total")).where("total >= 2")


def proper_nouns(stats: DataFrame) -> DataFrame:
    return stats.where(F.col("upper") / F.col("total") > 0.6)
