"""Phrases in texts: any number of set phrases, idioms, slang and terms found with their places in one pass.

The phrases are compiled to an Aho-Corasick automaton over words (or, for
substrings, over characters): the tokens of a text walk through it once, however many
phrases there are, and every phrase that ends at a token is given, also inside others.
The automaton goes to the tasks up to MOST_PHRASES phrases and MOST_SYMBOLS of their words;
larger tables meet the texts in a shuffle instead, by the hash of as many words as a phrase has.
Where phrases of two words are many, as collocations are, these go to the tasks as sorted numbers
instead, twelve bytes each: up to MOST_PAIRS pairs of MOST_WORDS words, in the same pass over the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import expressions as X
from lexmill.functions import lexicon as L
from lexmill.operators import tagging
from lexmill.operators.ranking import durable

#: Bounds of what is sent to every task; hits that a task holds at a time.
MOST_PHRASES, MOST_SYMBOLS, MOST_ROWS = 500_000, 4_000_000, 50_000
#: From how many on phrases of two words are sorted numbers; bounds of these.
PAIRS_FROM, MOST_PAIRS, MOST_WORDS = 10_000, 30_000_000, 4_000_000
#: Words of texts that a task looks up at a time.
MOST_WORDS_HELD = 1_000_000
FOUND = "phrase string, kind string, place long"


def fixed_phrases(spark) -> DataFrame:
    """(phrase, kind): the set phrases, idioms and words with special senses that the library knows."""
    rows = [(p, k) for k, ps in (("collocation", L.SET_PHRASES), ("slang", L.IDIOMS), ("polysemy", L.POLYSEMOUS)) for p in ps]
    return spark.createDataFrame(rows, "phrase string, kind string")


def split_phrases(phrases: DataFrame, by: str) -> DataFrame:
    """(phrase, kinds, symbols): distinct phrases that have symbols."""
    cut = X.phrase_tokens("phrase") if by == "words" else F.filter(F.split(F.lower("phrase"), ""), lambda c: c != "")
    return phrases.groupBy("phrase").agg(F.array_sort(F.collect_set(F.coalesce("kind", F.lit("")))).alias("kinds")).withColumn("symbols", cut).where(F.size("symbols") > 0)


class Automaton:
    """Phrases by number of symbol; several phrases may have the same symbols."""

    def __init__(self, rows: list[tuple[str, list[str], list[str]]]):
        self.number: dict[str, int] = {}
        at: dict[tuple[int, ...], list[tuple[str, str]]] = {}
        for phrase, kinds, symbols in rows:
            key = tuple(self.number.setdefault(s, len(self.number) + 1) for s in symbols)
            at.setdefault(key, []).extend((phrase, kind) for kind in kinds)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for group, key in enumerate(at):
            self.automaton.add_word(key, group)
        if at:
            self.automaton.make_automaton()
        self.empty = not at
        #: Of a group of phrases with the same symbols: how many symbols; the names from first[group] to first[group + 1].
        self.size = np.array([len(key) for key in at], dtype=np.int64)
        self.first = np.cumsum([0, *(len(named) for named in at.values())])
        names = [x for named in at.values() for x in named]
        self.phrase, self.kind = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))

    def ends(self, symbols: Iterable[str]) -> list[tuple[int, int]]:
        """(place of its last symbol, group) of every occurrence."""
        get = self.number.get
        return [] if self.empty else list(self.automaton.iter(tuple([get(s, 0) for s in symbols])))

    def named(self, row: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
        """(row, phrase, kind, place of its first symbol) of occurrences."""
        n = self.first[group + 1] - self.first[group]
        name = np.repeat(self.first[group] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(row, n), self.phrase.take(pa.array(name)), self.kind.take(pa.array(name)), np.repeat(end - self.size[group] + 1, n)


class Pairs:
    """Phrases of two words: the numbers of both words in one, sorted, with the number of their list of kinds."""

    def __init__(self, words: list[str], kinds: list[list[str]], keys: np.ndarray, listed: np.ndarray):
        self.number = {w: i for i, w in enumerate(words, 1)}
        self.words, self.keys, self.listed = pa.array(["", *words], pa.string()), keys, listed
        self.size = np.array([len(k) for k in kinds], dtype=np.int64)
        self.first = np.cumsum([0, *self.size])
        self.kind = pa.array([k for ks in kinds for k in ks], pa.string())

    def found(self, ids: pa.Array, row: np.ndarray, place: np.ndarray, word: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Every occurrence in the words (row, place, number) of texts that follow each other."""
        key = word[:-1] << 32 | word[1:]
        at = np.flatnonzero((row[:-1] == row[1:]) & (word[:-1] > 0) & (word[1:] > 0))
        where = np.searchsorted(self.keys, key[at])
        hit = self.keys[np.minimum(where, len(self.keys) - 1)] == key[at]
        at, group = at[hit], self.listed[where[hit]]
        for i in range(0, len(at), MOST_ROWS):
            x, g = at[i : i + MOST_ROWS], group[i : i + MOST_ROWS]
            n = self.size[g]
            kind = np.repeat(self.first[g] - np.cumsum(n) + n, n) + np.arange(n.sum())
            phrase = pc.binary_join_element_wise(self.words.take(pa.array(word[x])), self.words.take(pa.array(word[x + 1])), " ")
            x, of = np.repeat(x, n), np.repeat(np.arange(len(n)), n)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[x])), phrase.take(pa.array(of)), self.kind.take(pa.array(kind)), pa.array(place[x])], names=["id", "phrase", "kind", "place"])


def _sent_pairs(split: DataFrame) -> tuple[DataFrame, _Sent | None]:
    """The phrases that are left, and those of two words with a blank between them as sorted numbers; None where these are few or too many."""
    spark = split.sparkSession
    is_pair = (F.size("symbols") == 2) & (F.col("phrase") == F.concat_ws(" ", "symbols"))
    two = split.where(is_pair)
    words = two.select(F.explode("symbols").alias("w")).distinct()
    if not PAIRS_FROM <= two.count() <= MOST_PAIRS or words.count() > MOST_WORDS:
        return split, None
    listed = [r[0] for r in two.select("kinds").distinct().orderBy("kinds").collect()]  # kinds are a handful
    named = words.toArrow().column(0).to_pylist()
    sent = _Sent(spark, named)
    codes = [tuple(k) for k in listed]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, code = {w: i for i, w in enumerate(sent.value, 1)}, {k: i for i, k in enumerate(codes)}
        for batch in batches:
            keys = [of[a] << 32 | of[b] for a, b in batch.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([code[tuple(k)] for k in batch.column("kinds").to_pylist()], pa.int32())], names=["key", "listed"])

    table = two.select("symbols", "kinds").mapInArrow(numbered, "key long, listed int").toArrow()
    keys, lists = (table.column(c).to_numpy() for c in ("key", "listed"))
    order = np.argsort(keys)
    return split.where(~is_pair), _Sent(spark, (named, listed, keys[order], lists[order]))


_compiled: dict[int, Automaton | Pairs] = {}


def _made(sent: _Sent, make):
    """Compiled once in a worker; those of the last search are kept."""
    if sent.id not in _compiled:
        for old in [k for k in _compiled if k < sent.id - 16]:
            del _compiled[old]
        _compiled[sent.id] = make(sent.value)
    return _compiled[sent.id]


class _Sent:
    """A broadcast with its number, which workers know it by."""

    def __init__(self, spark, rows):
        self.held = spark.sparkContext.broadcast(rows)
        self.id = self.held._jbroadcast.id()

    def __getstate__(self):
        return {"held": self.held, "id": self.id}

    @property
    def value(self):
        return self.held.value


def find(docs: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: str = "words", most: int = MOST_PHRASES) -> DataFrame:
    """(id, phrase, kind, place) of every occurrence of the phrases (phrase, kind), place counted in words or characters from 0.

    by: "words" holds the words of text and phrase against each other, "characters" finds the lower-cased phrase anywhere.
    Null texts and phrases without symbols match nothing; repeated texts each give their rows.
    """
    spark = docs.sparkSession
    split = durable(split_phrases(phrases.where("phrase is not null"), by))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    split, pairs = _sent_pairs(split) if by == "words" else (split, None)
    size = split.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("symbols")), F.lit(0)).alias("symbols")).first()
    joined = _joined(texts, split, by) if size["n"] > most or size["symbols"] > MOST_SYMBOLS else None
    if joined is not None and pairs is None:
        return joined.withColumnRenamed("id", id_col)
    sent = _Sent(spark, [] if joined is not None else [tuple(r) for r in split.select("phrase", "kinds", "symbols").toLocalIterator()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, two = _made(sent, Automaton), pairs and _made(pairs, lambda x: Pairs(*x))
        cut = re.compile(L.PHRASE_TOKEN_PATTERN).findall if by == "words" else iter
        for batch in batches:
            column, row, found, numbers, sizes = batch.column("text"), [], [], [], []
            held = 0
            for i in range(batch.num_rows):
                symbols = cut(column[i].as_py())
                if two:
                    get = two.number.get
                    numbers.append(np.fromiter((get(w, 0) for w in symbols), np.int64, len(symbols)))
                    sizes.append((i, len(symbols)))
                    held += len(symbols)
                    if held >= MOST_WORDS_HELD or i + 1 == batch.num_rows:
                        n = np.array([n for _, n in sizes])
                        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        yield from two.found(batch.column("id"), np.repeat(np.array([r for r, _ in sizes]), n), place, np.concatenate(numbers))
                        numbers, sizes, held = [], [], 0
                ends = automaton.ends(symbols)
                found += ends
                row += [i] * len(ends)
                if found and (len(found) >= MOST_ROWS or i + 1 == batch.num_rows):
                    yield packed(automaton, batch, row, found)
                    row, found = [], []
            if found:
                yield packed(automaton, batch, row, found)

    def packed(automaton: Automaton, batch: pa.RecordBatch, row: list[int], found: list[tuple[int, int]]) -> pa.RecordBatch:
        hits = np.array(found, dtype=np.int64)
        rows, phrase, kind, place = automaton.named(np.array(row), hits[:, 0], hits[:, 1])
        return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), phrase, kind, pa.array(place)], names=["id", "phrase", "kind", "place"])

    lowered = texts.select("id", F.lower("text").alias("text"))
    out = lowered.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, {FOUND}")
    return (out if joined is None else out.unionByName(joined)).withColumnRenamed("id", id_col)


def _joined(texts: DataFrame, split: DataFrame, by: str) -> DataFrame:
    """The same by a shuffle: every run of as many symbols as some phrase has, by its hash, checked by the symbols."""
    cut = X.phrase_tokens("text") if by == "words" else F.split(F.lower("text"), "")
    sizes = [r[0] for r in split.select(F.size("symbols").alias("n")).distinct().orderBy("n").collect()]
    symbols = texts.select("id", cut.alias("ws"))
    every = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - n + 1)), lambda i: F.struct(i.alias("i"), F.slice("ws", i, n).alias("part")))
    runs = lambda n: F.filter(every(n), lambda x: F.size(x["part"]) == n)
    at = F.explode(F.flatten(F.array(*map(runs, sizes))))
    parts = symbols.where(F.size("ws") > 0).select("id", at.alias("x")).select("id", (F.col("x.i") - 1).cast("long").alias("place"), F.col("x.part").alias("part"), F.xxhash64("x.part").alias("h"))
    return parts.join(split.withColumn("h", F.xxhash64("symbols")), "h").where("part = symbols").select("id", "phrase", F.explode("kinds").alias("kind"), "place")


def phenomena(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, polysemy, collocations, slang): distinct phrases of each kind, sorted; texts without any have no row."""
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("phrase"))))
    return found.groupBy(id_col).agg(of("polysemy").alias("polysemy"), of("collocation").alias("collocations"), of("slang").alias("slang"))


def words_in_context(docs: DataFrame, phrases: DataFrame, contexts: int = 3) -> DataFrame:
    """(word, kinds): words of which one of the first sentences holds a phrase anywhere, and words with a special sense.

    Of each word only as many sentences as count are kept before they are gathered.
    """
    split = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), tagging.SENTENCE_END)).alias("no", "text"))
    sentences = durable(split.where(F.col("text") != "").withColumn("at", F.struct("doc_id", "no")))
    found = find(sentences, phrases.where("kind <> 'polysemy'"), "at", "text", "characters").select("at", "kind").distinct()
    words = sentences.select("at", F.explode(F.array_distinct(F.transform(X.corpus_tokens("text"), F.lower))).alias("word"))
    order = Window.partitionBy("word").orderBy("at")
    first = words.withColumn("r", F.row_number().over(order)).where(F.col("r") <= contexts).drop("r")
    near = first.join(found, "at").select("word", "kind")
    special = first.select("word").join(phrases.where("kind = 'polysemy'").select(F.lower("phrase").alias("word")).distinct(), "word", "left_semi").select("word", F.lit("polysemy").alias("kind"))
    return near.unionAll(special).groupBy("word").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
