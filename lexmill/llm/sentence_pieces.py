"""SentencePiece encoding and decoding for vocabularies of merge type.

A text (normalised, blanks as U+2581) begins as single characters. An agenda
holds every adjacent pair of symbols that is a piece, by score and then by place;
the best is merged, its neighbours form new pairs, and entries whose symbols have
changed meanwhile are dropped. Symbols that stay without a piece become their
UTF-8 bytes. Decoding joins the pieces' bytes and drops the blank that the
encoder put in front.

No merge can reach over two adjacent characters that stand together in no
piece. So texts part, by classes of characters that the vocabulary links, and
before blanks where no piece has one behind another character (there whole
words are looked up first); the agenda of
each part is independent of the others. Results of short parts are kept until
they are not met for as many new ones as a table holds, so a frequent word is
merged once in a worker. Longer parts go through the agenda each time, in
n log n steps.

Texts of a batch are decoded together: one take of the bytes of all their ids.
The library says in `agrees` whether ids and text are the same. It decodes the
ids of every text. As no piece has a blank behind another character, it encodes
words with the blanks before them, each once when a worker makes it; from the
first word on that differs it encodes every text whole.

Contract for odd rows: null text counts as empty; an empty text has no ids but
begin and end, and decodes to an empty one; texts and parts of any length are encoded
whole; strings of special tokens in a text are plain text, as in the library;
repeated rows give repeated results; ids may be null and of any type; other
columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexmill.llm.common import blocks_of, table

BLANK = "▁"
#: Of a worker: parts or words whose ids a table keeps (and as many older ones beside), and the characters of the longest of these. Texts (rows, characters) that are worked at a time.
MOST_PARTS, LONGEST_PART = 500_000, 48
ROWS, CHARS = 2048, 2_000_000

codecs.register_error("lexmill.each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Kept(dict[str, bytes]):
    """Packed ids of parts, made where missing; a full table stays as the older one, from which parts that are met again come back."""

    def __init__(self, made: Callable[[str], bytes]):
        super().__init__()
        self.made = made
        self.older: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        found = self.older.get(part) or self.made(part)
        if len(part) <= LONGEST_PART:
            if len(self) >= MOST_PARTS:
                self.older = self.copy()
                self.clear()
            self[part] = found
        return found


class PieceEncoder:
    """Encodes and decodes as the merge-type vocabulary at `path` says."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(library.get_piece_size())
        names = [library.id_to_piece(i) for i in every]
        merged = [i for i in every if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))]
        #: Pieces that merges may make; those marked unused are parted again.
        self.ids = {names[i]: i for i in merged}
        scores = {names[i]: library.get_score(i) for i in merged}
        places = {x: r for r, x in enumerate(sorted(set(scores.values()), reverse=True))}
        #: The best score is 0; equal scores have one rank.
        self.ranks = {name: places[x] for name, x in scores.items()}
        self.unused = {names[i] for i in merged if library.is_unused(i)}
        self.bytes = {int(names[i][3:5], 16): i for i in every if library.is_byte(i)}
        self.byte_ids = set(self.bytes.values())
        self.control = {i for i in every if library.is_control(i)}
        self.begin, self.end, self.unknown = library.bos_id(), library.eos_id(), library.unk_id()
        #: What each id adds to a text; nothing for control ids.
        self.surface = [b"" if library.is_control(i) else bytes([int(names[i][3:5], 16)]) if library.is_byte(i) else names[i].replace(BLANK, " ").encode() for i in every]
        self.surface[self.unknown] = library.decode([self.unknown]).encode()
        #: The same for many ids at once: their bytes, which are control ids, and behind which a text begins with no blank of the encoder's.
        self.surfaces = pa.array(self.surface, pa.large_binary())
        self.is_control = np.isin(np.array(every), list(self.control))
        self.is_bare = np.isin(np.array(every), [self.unknown, *self.byte_ids])
        self.prefixed = library.normalize("a").startswith(BLANK)
        self.plain = library.normalize("a  b\tＡ ﬁ ") == self.prefixed * BLANK + f"a{BLANK * 2}b\tＡ{BLANK}ﬁ{BLANK}"
        self.parts = self.divided()
        #: Packed ids of parts that begin with no blank, and of parts and whole words with the blank before them, by what follows it.
        self.kept = Kept(self.merged)
        self.words = Kept(self.after_blank)
        #: Those among the latter that the library has not encoded yet, and whether it gave the same ids for all others.
        self.new: dict[str, bytes] = {}
        self.same = True

    def divided(self) -> Callable[[str], list[str]]:
        """Cuts a text into parts between which nothing merges.

        Characters that stand side by side in a piece are of one class, and so are
        those that such neighbours link. A part is blanks and then characters of
        one class; a character that stands beside none is a part by itself.
        """
        self.class_of: dict[str, set[str]] = {}
        self.by_word = not any(BLANK in name.lstrip(BLANK) for name in self.ids)
        if not self.by_word:
            return lambda text: [text] if text else []
        class_of = self.class_of
        for name in self.ids:
            for x, y in zip(name, name[1:], strict=False):
                if x != BLANK:
                    mine, other = class_of.setdefault(x, {x}), class_of.setdefault(y, {y})
                    if mine is not other:
                        small, large = sorted((mine, other), key=len)
                        large |= small
                        for c in small:
                            class_of[c] = large
        classes = {id(c): c for c in class_of.values() if len(c) > 1 or next(iter(c)) * 2 in self.ids}
        ranges = "|".join(f"[{''.join(map(regex.escape, sorted(c)))}]++" for c in sorted(classes.values(), key=len, reverse=True))
        return regex.compile(f"(?s){BLANK}*+(?:{ranges}|[^{BLANK}])|{BLANK}+").findall

    def normalised(self, text: str) -> str:
        if not text:
            return ""
        return (BLANK if self.prefixed else "") + text.replace(" ", BLANK) if self.plain else self.library.normalize(text)

    def merge(self, part: str) -> list[int]:
        """Ids of a part, by the agenda: a list of the ranks of all pairs for short parts, a heap for long ones."""
        return self.merge_long(part) if len(part) > LONGEST_PART or self.unused else self.merge_short(part)

    def merge_short(self, part: str) -> list[int]:
        rank_of, none = self.ranks.get, len(self.ranks)
        symbols = list(part)
        #: The rank of each symbol with the one behind it.
        ranks = [rank_of(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)  # the first place of several
            symbols[at] = symbol = symbols[at] + symbols[at + 1]
            del symbols[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of(symbol + symbols[at + 1], none)
            if at:
                ranks[at - 1] = rank_of(symbols[at - 1] + symbol, none)
        return self.named(symbols, {})

    def merge_long(self, part: str) -> list[int]:
        rank_of, unused = self.ranks.get, self.unused
        symbols: list[str] = list(part)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        #: The rank of each symbol with the one behind it, None where they are no piece; how unused pieces came about.
        ranks = [rank_of(a + b) for a, b in zip(symbols, symbols[1:], strict=False)]
        made = {a + b: (a, b) for a, b in zip(symbols, symbols[1:], strict=False) if a + b in unused} if unused else {}
        #: rank * n + place: the best score first, then the first place.
        agenda = [r * n + i for i, r in enumerate(ranks) if r is not None]
        ranks.append(None)
        heapify(agenda)
        while agenda:
            rank, left = divmod(heappop(agenda), n)
            if ranks[left] != rank:
                continue
            right = after[left]
            symbols[left] = symbol = symbols[left] + symbols[right]
            after[left] = onward = after[right]
            symbols[right] = ranks[right] = None
            if onward < n:
                before[onward] = left
                ranks[left] = rank = rank_of(symbol + symbols[onward])
                if rank is not None:
                    heappush(agenda, rank * n + left)
                    if unused and symbol + symbols[onward] in unused:
                        made[symbol + symbols[onward]] = symbol, symbols[onward]
            else:
                ranks[left] = None
            at = before[left]
            if at >= 0:
                ranks[at] = rank = rank_of(symbols[at] + symbol)
                if rank is not None:
                    heappush(agenda, rank * n + at)
                    if unused and symbols[at] + symbol in unused:
                        made[symbols[at] + symbol] = symbols[at], symbol
        return self.named([s for s in symbols if s is not None], made)

    def named(self, symbols: list[str], made: dict[str, tuple[str, str]]) -> list[int]:
        """Ids of symbols: unused pieces part as they were made, symbols that are no piece become bytes."""
        found = list(map(self.ids.get, symbols))
        if None not in found and not made:
            return found
        out: list[int] = []
        todo = symbols[::-1]
        while todo:
            symbol = todo.pop()
            if symbol in made:
                todo += reversed(made[symbol])
            elif symbol in self.ids:
                out.append(self.ids[symbol])
            elif self.bytes:
                out += (self.bytes[b] for b in symbol.encode())
            elif not out or out[-1] != self.unknown:  # the library joins unknown neighbours
                out.append(self.unknown)
        return out

    def merged(self, part: str) -> bytes:
        return array("I", self.merge(part)).tobytes()

    def after_blank(self, word: str) -> bytes:
        """Ids of a blank and the word behind it."""
        text = BLANK + word
        parts = [text] if self.class_of.get(word[:1], frozenset()).issuperset(word) else self.parts(text)
        found = self.packed(parts) if len(parts) > 1 else self.merged(text)
        if word:
            self.new[word] = found
            if len(self.new) >= ROWS:
                self.compare()
        return found

    def compare(self) -> bool:
        """Whether the library encodes all words so far as they were made."""
        expected = self.library.encode([w if self.prefixed else " " + w for w in self.new], num_threads=1)
        self.same = self.same and all(array("I", x).tobytes() == found for x, found in zip(expected, self.new.values(), strict=True))
        self.new.clear()
        return self.same

    def packed(self, parts: list[str]) -> bytes:
        """Ids of the parts of a normalised text."""
        kept, words = self.kept, self.words
        return b"".join([words[part[1:]] if part[0] == BLANK else kept[part] for part in parts])

    def words_of(self, text: str | None) -> list[str] | None:
        """What follows the first blank of each run of blanks, the last word with the blanks behind it; None where the text can't be cut so."""
        first, *words = self.normalised(text or "").split(BLANK)
        if first or not words or not self.by_word:
            return None
        if "" not in words:
            return words
        out, gap = [], 0
        for word in words:
            if word:
                out.append(BLANK * gap + word)
                gap = 0
            else:
                gap += 1
        if gap and out:
            out[-1] += BLANK * gap
        return out or ([BLANK * (gap - 1)] if gap > 1 else None)

    def encode(self, text: str | None) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        words = self.words_of(text)
        return self.encode_whole(text) if words is None else self.encode_words(words)

    def encode_words(self, words: list[str]) -> bytes:
        return self.framed(b"".join(map(self.words.__getitem__, words)))

    def encode_whole(self, text: str | None) -> bytes:
        return self.framed(self.packed(self.parts(self.normalised(text or ""))))

    def framed(self, body: bytes) -> bytes:
        return b"".join((self.begin.to_bytes(4, "little"), body, self.end.to_bytes(4, "little")))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each."""
        surface, control = self.surface.__getitem__, self.control
        while ids and ids[0] in control:
            ids = ids[1:]
        first = ids[0] if ids else self.unknown
        text = lambda some: b"".join(map(surface, some)).decode("utf-8", "lexmill.each_byte")
        while ids and ids[-1] in control:
            ids = ids[:-1]
        if control.isdisjoint(ids):
            out = text(ids)
        else:
            # Bytes on two sides of a control id make no character.
            breaks = [-1, *(i for i, x in enumerate(ids) if x in control), len(ids)]
            out = "".join(text(ids[a + 1 : b]) for a, b in zip(breaks, breaks[1:], strict=False))
        return out[1:] if self.prefixed and first != self.unknown and first not in self.byte_ids and out.startswith(" ") else out


    def decode_packed(self, texts: list[bytes]) -> list[str]:
        """The texts of ids as encode() gives them."""
        if not texts:
            return []
        ids = np.frombuffer(b"".join(texts), "<u4")
        ends = np.cumsum([len(x) // 4 for x in texts])
        starts = np.concatenate(([0], ends[:-1]))
        if np.count_nonzero(self.is_control[ids]) > 2 * len(texts):
            # Control ids beside begin and end.
            return [self.decode(memoryview(x).cast("I").tolist()) for x in texts]
        _, offsets, data = self.surfaces.take(pa.array(ids)).buffers()
        offsets, data = np.frombuffer(offsets, np.int64), memoryview(data or b"")
        blank = (~self.is_bare[ids[starts + 1]]).tolist() if self.prefixed else [False] * len(texts)
        shown = [str(data[a:b], "utf-8", "lexmill.each_byte") for a, b in zip(offsets[starts].tolist(), offsets[ends].tolist(), strict=True)]
        return [out[1:] if strip and out.startswith(" ") else out for out, strip in zip(shown, blank, strict=True)]


@cache
def encoder(path: str) -> PieceEncoder:
    """One for each worker process and model."""
    return PieceEncoder(path)


def encode_texts(texts: list[str | None], path: str) -> list[tuple[bytes, str, bool]]:
    """(ids, decoded text, whether the library says the same of both) of each text."""
    tool = encoder(path)
    words = [tool.words_of(t) for t in texts]
    packed = [tool.encode_whole(t) if w is None else tool.encode_words(w) for t, w in zip(texts, words, strict=True)]
    decoded = tool.decode_packed(packed)
    shown = tool.library.decode([memoryview(x).cast("I").tolist() for x in packed], num_threads=1)
    same = tool.compare()
    whole = [i for i, w in enumerate(words) if w is None or not same]
    expected = tool.library.encode([texts[i] or "" for i in whole], add_bos=True, add_eos=True, num_threads=1)
    differ = {i for i, x in zip(whole, expected, strict=True) if array("I", x).tobytes() != packed[i]}
    return [(ids, text, text == said and i not in differ) for i, (ids, text, said) in enumerate(zip(packed, decoded, shown, strict=True))]


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, ids, decoded, agrees) of each row; with digests (id, n_tokens, ids_sha256, decoded_sha256, agrees)."""
    kind = docs.schema[id_col].dataType
    own = f"id {kind.simpleString()}"
    result = f"{own}, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean" if digests else f"{own}, ids array<long>, decoded string, agrees boolean"
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches, ("id", "text"), ROWS, CHARS, 1):
            keys = pa.array([r[0] for r in block], id_type)
            found = encode_texts([r[1] for r in block], path)
            agrees = pa.array([x[2] for x in found], pa.bool_())
            if digests:
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array([len(x[0]) // 4 for x in found], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in found], pa.string()), pa.array([hashlib.sha256(x[1].encode()).hexdigest() for x in found], pa.string()), agrees],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"],
                )
            else:
                yield pa.RecordBatch.from_arrays([keys, pa.array([memoryview(x[0]).cast("I").tolist() for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.string()), agrees], names=["id", "ids", "decoded", "agrees"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, result).withColumnRenamed("id", id_col)


def decode_pieces(docs: DataFrame, path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """docs with the text of an array of ids; null for null."""
    @F.pandas_udf("string")
    def decoded(ids):
        return ids.map(lambda x: None if x is None else encoder(path).decode([int(i) for i in x]))

    return docs.withColumn(name, decoded(F.col(ids_col)))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)
