"""Lexical retrieval packing: documents that share rare terms fill training sequences together.

Rows stream through each input partition in blocks of bounded rows and tokens.
A block is a shard: it holds a BM25 inverted index over the token ids of its
documents; documents of other shards are not neighbours (README has what that
loses). A document opens a sequence as its seed; when it ends before the
sequence is full, the index returns the shard's unused documents that score
highest for the seed's terms, and these fill the window greedily. A
document that doesn't fit is cut there; its rest opens the next sequence and
becomes its seed. A seed without unused neighbours is followed by the next
unused document, so only a shard's last sequence is padded.

One narrow pass: no shuffle, no key that could be hot, and a worker holds one
block whatever the size of the input. Sequence ids are the partition and a
counter, so a lost task makes the same ids again from the same file split.

Contract for odd rows: null and empty texts are the single end id; repeated
rows are packed as often as they occur; a text of any length is cut into as many
pieces as it needs; documents of equal score follow in the order of the shard;
ids may be null and of any type; other columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from base64 import b64decode
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from lexmill.llm.common import blocks_of, table

WINDOW = 1024
#: Of a shard: documents and characters.
SHARD_ROWS, SHARD_CHARS = 4096, 8_000_000
#: A seed gets this many neighbours at a time.
NEIGHBOURS = 16
#: Terms of this share of a shard's documents are held as rows.
DENSE = 16
K1, B = 1.2, 0.75

FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("seed_doc", pa.bool_())]


@cache
def library(json_path: str):
    """The library's tokenizer, loaded when a first text needs it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


@cache
def byte_pair_encoder(json_path: str, rank_path: str | None, pattern: str | None) -> Callable[[str], np.ndarray]:
    """Text to ids as the library `tokenizers` gives them for json_path, no special tokens added.

    Where the same vocabulary exists as ranks, those encode the texts whose
    characters all Unicode versions class alike (several times as fast, same
    ids); the library itself encodes the rest and texts with special strings.
    """
    slow = lambda text: np.array(library(json_path).encode(text, add_special_tokens=False).ids, dtype="<u4")
    if rank_path is None:
        return slow
    import tiktoken

    with open(rank_path, "rb") as f:
        ranks = {b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rare = regex.compile(r"[^\x00-ɏ‐-‧]|<\|").search
    return lambda text: slow(text) if rare(text) else np.array(fast(text), dtype="<u4")


class Shard:
    """A BM25 index over the distinct token ids of a block of documents.

    Terms of at least a DENSE-th of the documents have a row of weights over
    all of them, the others a posting list. Statistics are those of the whole
    block throughout; documents that are used leave rows and lists whenever a
    quarter of those in them is (keep()), as they can't be neighbours any more.
    """

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        lengths = np.array([len(d) for d in docs])
        vocabulary = 1 + max((int(d.max()) for d in docs if len(d)), default=0)
        kind, bits = (np.uint32, 16) if vocabulary <= 1 << 16 and n <= 1 << 16 else (np.uint64, 32)
        keys = np.concatenate([d.astype(kind) | kind(i << bits) for i, d in enumerate(docs)]) if n else np.zeros(0, kind)
        keys.sort()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
        tf = np.diff(np.r_[first, len(keys)])
        doc, term = (keys[first] >> kind(bits)).astype(np.intp), (keys[first] & kind((1 << bits) - 1)).astype(np.intp)
        df = np.bincount(term, minlength=vocabulary)
        keep = df[term] > 1  # a term of one document finds no other
        doc, term, tf = doc[keep], term[keep], tf[keep]
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / max(1, lengths.mean() if n else 1)))
        self.terms, self.of = term, np.searchsorted(doc, np.arange(n + 1))
        common = np.flatnonzero(df >= max(2, n / DENSE))
        self.row, self.live = np.full(vocabulary, -1, dtype=np.intp), np.arange(n)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), n), dtype=np.float32)
        dense = self.row[term] >= 0
        self.rows[self.row[term[dense]], doc[dense]] = weight[dense]
        rare = np.flatnonzero(~dense)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self._post(doc[rare], term[rare], weight[rare])

    def _post(self, docs: np.ndarray, term: np.ndarray, weights: np.ndarray) -> None:
        """Posting lists in order of terms; docs are numbers in self.live, which holds the documents' own."""
        self.docs, self.term, self.weights = docs, term, weights
        self.postings = np.searchsorted(term, np.arange(len(self.row) + 1))

    def keep(self, unused: np.ndarray) -> None:
        """Take used documents out of rows and lists, if they are many."""
        left = unused[self.live]
        if 4 * left.sum() < 3 * len(self.live):
            number, mine = np.cumsum(left) - 1, left[self.docs]
            self.live, self.rows = self.live[left], np.ascontiguousarray(self.rows[:, left])
            self._post(number[self.docs[mine]], self.term[mine], self.weights[mine])

    def neighbours(self, seed: int, unused: np.ndarray) -> list[int]:
        """The unused documents that score highest for all of the seed's terms, by falling score, ties to the earlier one; only those above zero."""
        self.keep(unused)
        n, terms = len(self.live), self.terms[self.of[seed] : self.of[seed + 1]]
        if not n or not len(terms):
            return []
        rows = self.row[terms]
        rare = terms[rows < 0]
        spans = [slice(a, b) for a, b in zip(self.postings[rare].tolist(), self.postings[rare + 1].tolist(), strict=True)]
        scores = self.rows[rows[rows >= 0]].sum(axis=0, dtype=np.float32).astype(np.float64)
        if spans:
            scores += np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), n)
        scores *= unused[self.live]
        least = np.partition(scores, -NEIGHBOURS)[-NEIGHBOURS] if n > NEIGHBOURS else 0.0
        able = np.flatnonzero((scores >= least) & (scores > 0))
        return self.live[able[np.lexsort((able, -scores[able]))[:NEIGHBOURS]]].tolist()


def pack_shard(docs: list[np.ndarray], window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int, bool]]:
    """(document, start, length, sequence, offset, whether it seeds the sequence), sequences from 0."""
    shard, unused = Shard(docs), np.ones(len(docs), dtype=bool)
    following, queue, seed = iter(range(len(docs))), [], None
    sequence, offset, doc, start = 0, 0, None, 0
    while True:
        if doc is None:
            while queue and not unused[queue[-1]]:
                queue.pop()
            if not queue and offset and seed is not None:
                queue = shard.neighbours(seed, unused)[::-1]
                seed = seed if queue else None
            doc = queue.pop() if queue else next((i for i in following if unused[i]), None)
            if doc is None:
                return
            unused[doc], start = False, 0
        if not offset:
            seed, queue = doc, []
        length = min(len(docs[doc]) - start, window - offset)
        yield doc, start, length, sequence, offset, not offset
        start, offset = start + length, offset + length
        if start == len(docs[doc]):
            doc = None
        if offset == window:
            sequence, offset = sequence + 1, 0


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], window: int = WINDOW, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of a document in a sequence; encoder is called on the worker and gives the text-to-ids function."""
    kind = docs.schema[id_col].dataType
    schema = pa.schema([(id_col, to_arrow_type(kind)), *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(), TaskContext.get().partitionId() << 40
        for block in blocks_of(batches, (id_col, text_col), SHARD_ROWS, SHARD_CHARS, 1):
            ids = [np.append(encode(text) if text else np.zeros(0, "<u4"), np.array([end_id], "<u4")) for _, text in block]
            rows = [(block[d][0], s, n, zlib.crc32(ids[d][s : s + n]), len(ids[d]), base + q, o, seeds) for d, s, n, q, o, seeds in pack_shard(ids, window)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            base = rows[-1][5] + 1

    fields = ", ".join(f"{n} {'boolean' if t == pa.bool_() else 'bigint'}" for n, t in FIELDS)
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, {fields}")


def _encoder() -> Callable[[str], np.ndarray]:
    import public_tokenizers as files

    return byte_pair_encoder(files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(docs, _encoder)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
