"""Part-of-speech tags by a hidden Markov model that Spark counts and Arrow batches decode.

Training rows (sentence, place, token, pos) come from outside: a treebank, a
model's replies, or the sure tags of seed_tag(). Spark counts how often each tag
follows each other and how often each word and each ending of one to four
letters has each tag. Scores are whole numbers (thousandths of a natural
logarithm), so a path has one score wherever it is computed.

The model is bounded: tags x tags and at most MOST_KEYS words and endings, the
most frequent ones. It goes to the tasks with the function; texts are read once, without
a shuffle. All sentences of a batch are decoded in step, the longest first, by
Viterbi's recurrence over arrays of (tags, sentences). Words are looked up once
a part of a batch, and a part holds WORDS_AT_ONCE words or one sentence.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import expressions as X
from lexmill.functions import lexicon as L
from lexmill.operators.ranking import durable

#: Words and endings of a model; least count of either; letters of the longest ending; thousandths.
MOST_KEYS, LEAST, ENDING, UNIT = 200_000, 2, 4, 1000
#: Words that a task decodes at once, and words whose rows it keeps.
WORDS_AT_ONCE, WORDS_KEPT = 1 << 18, 1 << 17
#: What a count is raised by: of a key's tags, of a tag's successors.
KEY_SMOOTH, STEP_SMOOTH = 0.1, 1.0
START = "^"
SENTENCE_END = r"[.!?]+\s*|\n"


def seed_tag(word: Column | str) -> Column:
    """The tag of words that have one by themselves: closed classes, then sure endings; else null."""
    w = F.lower(X.col(word))
    tag = None
    for pos, words in L.CLOSED_CLASSES.items():
        is_one = w.isin(*words.split())
        tag = F.when(is_one, pos) if tag is None else tag.when(is_one, pos)
    of = {e: pos for pos, endings in L.SURE_ENDINGS.items() for e in endings.split()}
    ending = F.regexp_extract(w, f"^.{{3,}}({'|'.join(of)})$", 1)  # no ending ends another
    return tag.otherwise(X.mapping(of, ending))


def keys_of(word: Column) -> Column:
    """The word itself, marked as whole, and its endings, the longest first."""
    w = F.lower(word)
    endings = [F.when(F.length(w) >= n, F.concat(F.lit("-"), F.right(w, F.lit(n)))) for n in range(ENDING, 0, -1)]
    return F.array_compact(F.array(F.concat(F.lit("="), w), *endings))


@cache
def _sure() -> tuple[dict[str, str], dict[str, str]]:
    """Tags of the words of closed classes, and of sure endings."""
    closed = {w: pos for pos, words in reversed(L.CLOSED_CLASSES.items()) for w in words.split()}
    return closed, {e: pos for pos, endings in L.SURE_ENDINGS.items() for e in endings.split()}


def seed_of(word: str) -> str | None:
    """What seed_tag() gives for a word, inside a task."""
    closed, endings = _sure()
    w = word.lower()
    return closed.get(w) or next((pos for e, pos in endings.items() if len(w) >= len(e) + 3 and w.endswith(e)), None)


class Model:
    """Tags with the scores of their successions and of the keys of words."""

    def __init__(self, tags: list[str], steps: dict[tuple[str, str], int], keys: dict[str, dict[str, int]]):
        self.tags = tags
        size = len(tags)
        from_ = {p: sum(steps.get((p, t), 0) for t in tags) for p in (START, *tags)}
        step = lambda p, t: math.floor(0.5 + UNIT * math.log((steps.get((p, t), 0) + STEP_SMOOTH) / (from_[p] + STEP_SMOOTH * size)))
        self.start = np.array([step(START, t) for t in tags], dtype=np.int64)
        self.step = np.array([[step(p, t) for t in tags] for p in tags], dtype=np.int64).reshape(size, size)
        # A key's tags as the words have them: each word counts once for itself and not for its endings.
        every = {t: sum(k.get(t, 0) for name, k in keys.items() if name[0] == "=") for t in tags}
        total = sum(every.values())
        share = {t: (every[t] + KEY_SMOOTH) / (total + KEY_SMOOTH * size) for t in tags}
        #: The row of each key in one table of scores; the last row is that of words without a key.
        self.rows = {name: i for i, name in enumerate(keys)}
        self.table = np.zeros((len(keys) + 1, size), dtype=np.int32)
        for i, counts in enumerate(keys.values()):
            n = sum(counts.values())
            self.table[i] = [math.floor(0.5 + UNIT * (math.log((counts.get(t, 0) + KEY_SMOOTH) / (n + KEY_SMOOTH * size)) - math.log(share[t]))) for t in tags]

    @property
    def keys(self) -> dict[str, np.ndarray]:
        return {name: self.table[i] for name, i in self.rows.items()}

    def row(self, word: str) -> int:
        """The row of a word: its own, else that of its longest known ending, else the last."""
        w, rows = word.lower(), self.rows
        for key in ("=" + w, *("-" + w[-n:] for n in range(min(ENDING, len(w)), 0, -1))):
            if (found := rows.get(key)) is not None:
                return found
        return len(rows)

    def scores(self, word: str) -> np.ndarray:
        """A score for each tag: that of the word, else that of its longest known ending, else 0."""
        return self.table[self.row(word)]

    def decode(self, sentences: list[list[str]]) -> list[list[str]]:
        """The best tags of each sentence; of equal paths that with the earlier tags in the list, from the last word back."""
        if not self.tags:
            return [[""] * len(s) for s in sentences]
        known: dict[str, int] = {}
        codes = np.array([known.setdefault(w, len(known)) for s in sentences for w in s], dtype=np.int64)
        ends = np.cumsum([0, *map(len, sentences)])
        path = self.paths(codes, ends, np.array([self.row(w) for w in known], dtype=np.int64)).tolist()
        return [[self.tags[t] for t in path[a:b]] for a, b in itertools.pairwise(ends.tolist())]

    def paths(self, codes: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The number of the best tag of each word. codes: the words of all sentences, as places in rows; ends: 0, then where each sentence ends.

        Each number of a step holds a score and, in its low bits, the tag before it, so one maximum finds
        both; the earlier tag has the higher bits. States are taken relative to the best one, so they stay small.
        """
        size = len(self.tags)
        low = 1 << max(1, (size - 1).bit_length())
        order = np.argsort(ends[:-1] - ends[1:], kind="stable")
        first, sizes = ends[:-1][order], np.diff(ends)[order]
        alive = np.searchsorted(-sizes, -np.arange(1, sizes.max(initial=0) + 1), side="right")  # sentences of so many words
        path = np.zeros(len(codes), dtype=np.uint8 if size <= 256 else np.int32)
        if not len(alive):
            return path
        table = np.ascontiguousarray(self.table[rows].T) * low
        step = (self.step * low + (low - 1 - np.arange(size))[:, None]).astype(np.int32)[:, :, None]
        state = (self.start * low).astype(np.int32)[:, None] + table[:, codes[first[: alive[0]]]]
        back: list[np.ndarray] = []
        for at in range(1, len(alive)):
            n = alive[at]
            now = state[:, :n] - state[:, :n].max(0)
            best = now[0] + step[0]
            for p in range(1, size):
                np.maximum(best, now[p] + step[p], out=best)
            back.append((low - 1 - (best & (low - 1))).astype(path.dtype))
            state[:, :n] = (best & -low) + table[:, codes[first[:n] + at]]
        last = state.argmax(0)
        tag = last[:0]
        for at in range(len(alive) - 1, -1, -1):
            n = alive[at]
            # Sentences that go on are led back from their next word, the others begin with their best last tag.
            tag = np.concatenate([back[at][tag, np.arange(len(tag))], last[len(tag) : n]]) if len(tag) else last[:n]
            path[first[:n] + at] = tag
        return path


def train(tagged: DataFrame, most_keys: int = MOST_KEYS, least: int = LEAST) -> Model:
    """The model of rows (sentence, place, token, pos); rows without a pos are gaps over which no succession is counted."""
    placed = F.array_sort(F.collect_list(F.struct("place", "token", "pos")))
    sentences = tagged.groupBy("sentence").agg(placed.alias("x")).select(F.col("x.token").alias("tokens"), F.col("x.pos").alias("tags"))
    return train_sentences(sentences, most_keys, least)


def train_sentences(sentences: DataFrame, most_keys: int = MOST_KEYS, least: int = LEAST) -> Model:
    """The model of sentences (tokens, tags), a tag or null for each token. Two passes, of which each task sends its sums only."""
    before = F.concat(F.array(F.lit(START)), F.slice("tags", 1, F.greatest(F.size("tags") - 1, F.lit(0))))
    pairs = sentences.where(F.size("tags") > 0).select(F.explode(F.arrays_zip(before.alias("before"), F.col("tags").alias("pos"))).alias("x")).select("x.before", "x.pos")
    counted_pairs = pairs.where("pos is not null and before is not null").groupBy("before", "pos").agg(F.count("*").alias("n"))
    words = sentences.select(F.explode(F.arrays_zip(F.col("tokens").alias("token"), F.col("tags").alias("pos"))).alias("x")).select(F.lower("x.token").alias("token"), "x.pos")
    return _counted(counted_pairs, words.where("pos is not null").groupBy("token", "pos").agg(F.count("*").alias("n")), most_keys, least)


def _counted(pairs: DataFrame, words: DataFrame, most_keys: int, least: int) -> Model:
    """The model of counted successions (before, pos, n) and words (token, pos, n)."""
    steps = {(r["before"], r["pos"]): r["n"] for r in pairs.collect()}  # tags x tags
    by_key = words.select(F.explode(keys_of(F.col("token"))).alias("key"), "pos", "n").groupBy("key", "pos").agg(F.sum("n").alias("n"))
    kept = by_key.groupBy("key").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("pos", "n"))).alias("counts"))
    keys = {r["key"]: r["counts"] for r in kept.where(F.col("all") >= least).orderBy(F.desc("all"), "key").limit(most_keys).collect()}
    return Model(sorted({t for _, t in steps}), steps, keys)


def train_seeded(sentences: DataFrame, most_keys: int = MOST_KEYS, least: int = LEAST) -> Model:
    """The model of sentences (tokens) by the sure tags of their own words: train_sentences(seeded(sentences)) in one pass.

    A task looks a word up once a part and sends counts of successions (word: null) and of words (before: null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [START, *L.CLOSED_CLASSES, *(t for t in L.SURE_ENDINGS if t not in L.CLOSED_CLASSES)]
        of = {t: i for i, t in enumerate(names)} | {None: len(names)}  # the last number: no tag
        size, kept = len(of), {}
        for batch in batches:
            for _, words, codes, ends in _coded(batch.column(0)):
                if len(kept) > WORDS_KEPT:
                    kept = {}
                tag_of = np.array([kept[w] if w in kept else kept.setdefault(w, of[seed_of(w)]) for w in words], dtype=np.int64)
                tags = tag_of[codes]
                before = np.concatenate([[0], tags[:-1]])[: len(tags)]
                before[ends[:-1][np.diff(ends) > 0]] = 0
                steps = np.bincount(before * size + tags, minlength=size * size).reshape(size, size)[:-1, :-1]
                b, t = np.nonzero(steps)
                held = np.flatnonzero(tag_of < len(names))
                n = np.bincount(codes, minlength=len(words))[held]
                none = lambda k: pa.nulls(k, pa.string())
                named = lambda xs: pa.array([names[x] for x in xs], pa.string())
                yield pa.RecordBatch.from_arrays([named(b), none(len(b)), named(t), pa.array(steps[b, t], pa.int64())], names=["before", "word", "pos", "n"])
                yield pa.RecordBatch.from_arrays([none(len(held)), pa.array([words[i] for i in held], pa.string()), named(tag_of[held]), pa.array(n, pa.int64())], names=["before", "word", "pos", "n"])

    counts = sentences.select("tokens").mapInArrow(run, "before string, word string, pos string, n long")
    counts = durable(counts.groupBy("before", F.lower("word").alias("token"), "pos").agg(F.sum("n").alias("n")))
    return _counted(counts.where("before is not null").select("before", "pos", "n"), counts.where("token is not null").select("token", "pos", "n"), most_keys, least)


def _coded(sentences: pa.Array, most: int = WORDS_AT_ONCE) -> Iterator[tuple[pa.Array, list[str], np.ndarray, np.ndarray]]:
    """(sentences, distinct words, codes, ends) of parts of an array of sentences, of `most` words or one sentence each; nulls count as empty."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(sentences), 0))
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    a = 0
    while a < len(sentences):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
        part = sentences.slice(a, b - a)
        coded = pc.dictionary_encode(part.flatten())
        yield part, coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64), ends[a : b + 1] - ends[a]
        a = b


class _Rows:
    """Rows of words in a model's table, kept from one part to the next."""

    def __init__(self, model: Model):
        self.model, self.kept = model, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.kept) > WORDS_KEPT:
            self.kept = {}
        kept, row = self.kept, self.model.row
        return np.array([kept[w] if w in kept else kept.setdefault(w, row(w)) for w in words], dtype=np.int64)


def tag(sentences: DataFrame, model: Model, tokens_col: str = "tokens") -> DataFrame:
    """sentences with a column tags, one for each token; null tokens give null tags."""
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    columns = [c for c in sentences.columns if c != "tags"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, names = _Rows(model), pa.array(model.tags or [""])
        for batch in batches:
            at = 0
            for part, words, codes, ends in _coded(batch.column(tokens_col)):
                path = model.paths(codes, ends, rows(words)) if model.tags else np.zeros(len(codes), dtype=np.uint8)
                tags = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(path)), mask=part.is_null())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(part)) for c in columns), tags], names=[*columns, "tags"])
                at += len(part)

    kept = sentences.select(*columns)
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("tags", ArrayType(StringType()))]))


def tag_counts(sentences: DataFrame, model: Model, tokens_col: str = "tokens") -> DataFrame:
    """(word, pos, n) of the tags that tag() gives, words in small letters: tasks send counts, not tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, tags, size = _Rows(model), pa.array(model.tags or [""]), max(1, len(model.tags))
        for batch in batches:
            for _, words, codes, ends in _coded(batch.column(0)):
                path = model.paths(codes, ends, rows(words)) if model.tags else np.zeros(len(codes), dtype=np.uint8)
                n = np.bincount(codes * size + path, minlength=len(words) * size)
                held = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()).take(pa.array(held // size)), tags.take(pa.array(held % size)), pa.array(n[held], pa.int64())], names=["word", "pos", "n"])

    counts = sentences.select(tokens_col).mapInArrow(run, "word string, pos string, n long")
    return counts.groupBy(F.lower("word").alias("word"), "pos").agg(F.sum("n").alias("n"))


def tokens_by_sentence(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, sentence, tokens): sentences with words, numbered from 0 within their document."""
    split = docs.select("doc_id", F.posexplode(F.split(F.coalesce(text_col, F.lit("")), SENTENCE_END)).alias("sentence", "s"))
    # A filter by the size of tokens would be moved below them and cut every sentence twice.
    return split.where(F.col("s").rlike(L.TOKEN_PATTERN)).select("doc_id", "sentence", X.corpus_tokens("s").alias("tokens"))


def seeded(sentences: DataFrame) -> DataFrame:
    """sentences (tokens, ...) with the sure tags of their tokens."""
    return sentences.withColumn("tags", F.transform("tokens", seed_tag))


def word_tags(tagged: DataFrame) -> DataFrame:
    """(word, pos, n): the tag that each word has most often, of equal ones the first by name."""
    pairs = tagged.select(F.explode(F.arrays_zip("tokens", "tags")).alias("x")).groupBy(F.lower("x.tokens").alias("word"), F.col("x.tags").alias("pos")).agg(F.count("*").alias("n"))
    return best_tags(pairs)


def best_tags(pairs: DataFrame) -> DataFrame:
    """(word, pos, n) of counts (word, pos, n) like those of tag_counts(): each word's most frequent tag, and all its occurrences."""
    return pairs.groupBy("word").agg(F.min_by("pos", F.struct(-F.col("n"), "pos")).alias("pos"), F.sum("n").alias("n"))
