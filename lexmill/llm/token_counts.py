"""Token counts: a byte-pair tokenizer compiled to a deterministic transducer.

The tokenizer file (word-end BPE: NFC, white space runs, lower case, a split
pattern, byte alphabet, merges) becomes an automaton over bytes. After any
prefix of a word the merges fix one last token, and that token depends only on
which last tokens ended at the cut points inside the longest suffix that is
still a proper prefix of a vocabulary entry. That suffix with those tokens is
the state: finitely many, deterministic. A transition carries the change of
the number of tokens; word-final transitions lead back to the start state, and
the sum along a path is the count that the merges give. States are made when a
text first reaches them, and kept.

White space puts the automaton into its start state, whatever came before. So a
chunk of a text maps every entry state to an exit state through three parts:
what precedes its first blank (`head`, depends on the entry), the tokens
between (`count`) and what follows its last blank (`tail`, the exit state).
Such maps compose associatively; a text of any length is cut anywhere into
chunks whose maps meet in a balanced scan.

Contract for odd rows: null text counts as empty (0 bytes, 0 tokens, not over
the limit); texts and words of any length are counted whole; repeated rows give
repeated results; ids may be null and of any type; other columns take no part;
strings of special tokens in a text count one each, as the library does by
default; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from lexmill.llm.common import rows_of, table

CHUNK = 1 << 16
#: Memory bounds of a worker: known words, states.
MOST_WORDS, MOST_STATES = 400_000, 200_000


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _State:
    __slots__ = ("suffix", "cuts", "step", "last")

    def __init__(self, suffix: tuple[str, ...], cuts: tuple):
        #: cuts[j]: last token and count (relative to here) of what precedes suffix[j:].
        self.suffix, self.cuts, self.step, self.last = suffix, cuts, {}, {}


class TokenTransducer:
    """Counts tokens of words, chunks and texts as the tokenizer file at `path` splits them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split":
            raise ValueError(f"no transducer for the tokenizer at {path}")
        self.end = model["end_of_word_suffix"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.alphabet = byte_alphabet()
        #: Vocabulary entries as tuples of symbols; proper prefixes of them.
        self.vocabulary = {self._symbols(t) for t in model["vocab"]}
        self.prefixes = {t[:i] for t in self.vocabulary for i in range(len(t))}
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        #: The library's \s is the Unicode property; the regex module's takes four control characters more.
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.pairs: dict[tuple, bool] = {}
        self._clear()

    def _symbols(self, token: str) -> tuple[str, ...]:
        return (*token[: -len(self.end) - 1], token[-len(self.end) - 1 :]) if token.endswith(self.end) and len(token) > len(self.end) else tuple(token)

    def _clear(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.start = self._state((), ((None, 0),))
        self.known: dict[str, int] = {}

    def _state(self, suffix: tuple[str, ...], cuts: tuple) -> _State:
        if (found := self.states.get((suffix, cuts))) is None:
            found = self.states[(suffix, cuts)] = _State(suffix, cuts)
        return found

    def merged(self, symbols: tuple[str, ...]) -> list[tuple[str, ...]]:
        """The merges applied in order of rank, leftmost first among equals."""
        parts = [(s,) for s in symbols]
        names = list(symbols)
        while len(parts) > 1:
            rank, i = min((self.rank.get((names[i], names[i + 1]), len(self.rank)), i) for i in range(len(parts) - 1))
            if rank == len(self.rank):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            names[i : i + 2] = [names[i] + names[i + 1]]
        return parts

    def _adjacent(self, left: tuple[str, ...] | None, right: tuple[str, ...]) -> bool:
        """Whether the merges leave the two tokens as they are when they meet."""
        if (key := (left, right)) not in self.pairs:
            self.pairs[key] = self.merged((left or ()) + right) == ([left, right] if left else [right])
        return self.pairs[key]

    def _compile(self, state: _State, byte: int, final: bool) -> tuple[int, _State]:
        """The transition of a state over a byte: emitted count, next state."""
        symbol = self.alphabet[byte] + (self.end if final else "")
        for j in range(len(state.suffix) + 1):
            token = (*state.suffix[j:], symbol)
            before, n = state.cuts[j]
            if token in self.vocabulary and self._adjacent(before, token):
                break
        else:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        emitted = n + 1
        if final:
            return emitted, self.start
        suffix = (*state.suffix, symbol)
        cuts = (*((t, k - emitted) for t, k in state.cuts), (token, 0))
        while suffix not in self.prefixes:
            suffix, cuts = suffix[1:], cuts[1:]
        return emitted, self._state(suffix, cuts)

    def count_word(self, word: str) -> int:
        """Tokens of one word of the split pattern: a walk from the start state back to it."""
        data, state, n = word.encode("utf-8", "surrogatepass"), self.start, 0
        for byte in data[:-1]:
            if (edge := state.step.get(byte)) is None:
                edge = state.step[byte] = self._compile(state, byte, False)
            n += edge[0]
            state = edge[1]
        if (edge := state.last.get(data[-1])) is None:
            edge = state.last[data[-1]] = self._compile(state, data[-1], True)
        return n + edge[0]

    def count_closed(self, text: str) -> int:
        """Tokens of a text between two places where the automaton is in its start state."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            #: The library folds character by character, so a final capital sigma has no form of its own.
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        known, n = self.known, 0
        for word in self.words.findall(text):
            if (k := known.get(word)) is None:
                k = self.count_word(word)
                if len(word) <= 64:
                    known[word] = k
            n += k
        if len(known) > MOST_WORDS or len(self.states) > MOST_STATES or len(self.pairs) > 4 * MOST_WORDS:
            self.pairs.clear()
            self._clear()
        return n

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """The state map of a chunk: head, count, tail. Count None: no blank, every entry state stays open."""
        first = min((i for i in (chunk.find(" "), chunk.find("\n")) if i >= 0), default=-1)
        if first < 0:
            return chunk, None, ""
        last = max(chunk.rfind(" "), chunk.rfind("\n"))
        return chunk[:first], self.count_closed(chunk[first : last + 1]), chunk[last + 1 :]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two chunks that follow each other; associative, ("", None, "") is neutral."""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.count_closed(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list[tuple]) -> tuple:
        """Neighbours composed in rounds, as a parallel scan does."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0] if maps else ("", None, "")

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text; the size of the chunks doesn't matter to the result."""
        parts = self.special.split(text) if self.special and "<" in text else [text]
        n = len(parts) - 1
        for part in parts:
            if len(part) <= chunk:
                n += self.count_closed(part)
                continue
            head, middle, tail = self.scan([self.chunk_map(part[i : i + chunk]) for i in range(0, len(part), chunk)])
            n += self.count_closed(head) + (middle or 0) + self.count_closed(tail)
        return n


@cache
def transducer(path: str) -> TokenTransducer:
    """One per worker and file."""
    return TokenTransducer(path)


def token_counts(docs: DataFrame, tokenizer: str | Callable[[], str], limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, in one narrow pass without a shuffle.

    tokenizer: the file's path, or a function that gives it on the worker.
    """
    kind = docs.schema[id_col].dataType
    schema = pa.schema([(id_col, to_arrow_type(kind)), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer() if callable(tokenizer) else tokenizer)
        for batch in batches:
            out = [[], [], [], []]
            for key, text in rows_of([batch], id_col, text_col):
                n = machine.count(text or "", chunk)
                for column, value in zip(out, (key, len((text or "").encode("utf-8", "surrogatepass")), n, n > limit), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return docs.select(id_col, text_col).mapInArrow(count, f"{id_col} {kind.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def _word_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), _word_file)
