"""SimHash near-duplicates through pivot distance tables.

Documents become 64-bit fingerprints; equal ones are merged, so a group of
copies is one row from then on. Fingerprints that differ in at most `radius`
bits are linked, and documents that links reach share a component.

Pairs: of `radius + 1` blocks of bits one is equal in a linked pair, and of
`radius + 1` parts of the other bits one is equal too. Each fingerprint is sent
once for each (block, part) with both values as key: every linked pair meets at
least once, and a key fixes over half of the bits. A key of more than GROUP
fingerprints is split by parts of its other bits in the same way, again and
again, so that no task holds more. Within a key, a table of Hamming distances to
reference fingerprints (the pivots) is computed. Rows stand in order of the
distance to the first pivot, so pairs farther apart there than the radius are
never formed; the others are discarded when any pivot's distances differ by more
(triangle inequality), and the survivors are verified by their own distance. A
task hands on one link from each fingerprint to an earlier one that it is
connected with, not all pairs, so dense groups give rows in proportion to their size.

Components come from alternating large-star and small-star rounds over these
links, in the cluster, each round written to the shared checkpoint folder.

near_duplicate_texts() goes on to the similarity of the texts. The fingerprints
of their 5-word shingles are linked through the same keys and pivot tables, and
the texts of a component of links are one group, which the shingle sets check.
Fingerprints alone are too coarse for all pairs (texts whose shingles overlap by
0.8 differ in about 10 of 64 bits), so bands of minimal shingle hashes add groups
(12 bands of 4: a pair at 0.8 meets with probability 0.998, nearer pairs more
surely). A member of a group is held against every earlier one that it isn't
connected with yet, whatever the size of the group (its shingle sets lie in a
temporary file beyond SPOOL bytes), so links are as complete as all pairs of the
group. Within a group fingerprints only say which partners to try first: no pair
is discarded by its bits, the shingle sets decide. Exact copies are merged first.

Contract for odd rows: null and empty texts have the fingerprint 0, linked like
any other; texts with fewer words than a shingle are one shingle, those of any
length are read whole; repeated rows each get a row; ids of any type that has an
order; a null doc_id is left out of the smallest id unless its component has no
other, then component_id is null; other columns take no part, whatever their
names; an empty table gives no rows. near_duplicate_texts() leaves rows without
an id out, and links texts without words with their copies only.
"""

from __future__ import annotations

from collections.abc import Iterator
from tempfile import SpooledTemporaryFile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import FOLD_BYTES, durable, rows_of, table, unclashed

BITS, PIVOTS = 64, 32
SEED = 42
#: Fingerprints of one key that are paired in one task; more are split by further bits.
GROUP = 4096
#: Pairs that a task holds at once.
PAIRS = 2_000_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the hashes of the shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").translate(FOLD_BYTES).translate(_SPACES).split(b" ") if text else []
    words = [w for w in words if w]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.r_[0, ends[:-1] + 1][: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


#: Blanks of the word rule to a space; other control characters are parts of words.
_SPACES = bytes(32 if c in (9, 10, 11, 12, 13) else c for c in range(256))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) with fp as a signed 64-bit integer."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for (t,) in rows_of([batch], text_col)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, fp bigint")


def _parts(bits: list[int], n: int) -> list[list[int]]:
    return [bits[i * len(bits) // n : (i + 1) * len(bits) // n] for i in range(n)]


def block_masks(radius: int) -> list[int]:
    """Masks of the bits that a key fixes: one of radius + 1 blocks and one of radius + 1 parts of the rest."""
    masks, everything = [], list(range(BITS))
    for block in _parts(everything, radius + 1):
        rest = [b for b in everything if b not in block]
        masks += [sum(1 << b for b in block + part) for part in _parts(rest, radius + 1)]
    return masks


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of the numbers 0 to n - 1."""
    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(n)], dtype=np.uint64)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def key_links(keys: np.ndarray, fps: np.ndarray, refs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect the fingerprints of each key; rows sorted by key.

    Row i is held against row i + s for s = 1, 2, ... while the key is the same
    and the first pivot's distances are within the radius. A row that is already
    connected with its partner needs no link to it.
    """
    far, n = distance_table(fps, refs), len(fps)
    order = np.lexsort((far[:, 0], keys))
    keys, fps, far = keys[order], fps[order], far[order]
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left, right, active, s = [], [], np.arange(n), 0
    while len(active):
        s += 1
        active = active[active + s < n]
        active = active[(keys[active] == keys[active + s]) & (far[active + s, 0] - far[active, 0] <= radius)]
        for i in range(0, len(active), PAIRS // PIVOTS):
            a = active[i : i + PAIRS // PIVOTS]
            for c in range(1, far.shape[1]):
                if not len(a):
                    break
                a = a[np.abs(far[a, c] - far[a + s, c]) <= radius]
            a = a[np.bitwise_count(fps[a] ^ fps[a + s]) <= radius]
            for x in a.tolist():
                p, q = find(x), find(x + s)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    left.append(x)
                    right.append(x + s)
    return fps[left], fps[right]


def finer(mask: int, radius: int) -> list[int]:
    """The masks that fix one more part of the bits that a mask leaves open."""
    return [mask | sum(1 << b for b in part) for part in _parts([b for b in range(BITS) if not mask >> b & 1], radius + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b) links that connect the distinct fingerprints of column fp as all pairs within the radius do."""
    key = F.xxhash64(F.col("mask"), F.col("fp").bitwiseAND(F.col("mask"))).alias("key")
    masks = block_masks(radius)
    keyed = distinct.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask")).select("fp", "mask", key)
    found = None
    while True:
        crowded = durable(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("key"))
        last = crowded.isEmpty()
        paired = _paired(keyed if last else keyed.join(crowded, "key", "left_anti"), radius)
        found = paired if found is None else found.unionAll(paired)
        if last:
            return found
        wider = {m: finer(m, radius) for m in masks}
        nexts = F.create_map(*(x for m, ms in wider.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(c)) for c in ms)))))
        keyed = durable(keyed.join(crowded, "key").select("fp", F.explode(nexts[F.col("mask")]).alias("mask")).select("fp", "mask", key))
        masks = sorted({c for ms in wider.values() for c in ms})


def _paired(keyed: DataFrame, radius: int) -> DataFrame:
    """The links within each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots()
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            k = np.r_[held_k, batch.column("key").to_numpy(zero_copy_only=False)]
            f = np.r_[held_f, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)]
            cut = int(np.searchsorted(k, k[-1], "left")) if len(k) else 0
            held_k, held_f = k[cut:], f[cut:]
            yield emit(k[:cut], f[:cut], refs)
        yield emit(held_k, held_f, refs)

    def emit(k: np.ndarray, f: np.ndarray, refs: np.ndarray) -> pa.RecordBatch:
        same = k[1:] == k[:-1]
        keep = np.r_[False, same] | np.r_[same, False] if len(k) else np.zeros(0, bool)
        a, b = key_links(k[keep], f[keep], refs, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return keyed.select("fp", "key").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's smallest node.

    Alternates large-star and small-star until a round changes nothing.
    """
    state = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = state.unionAll(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        state = durable(small)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id that links reach."""
    marked = durable(fingerprints(docs, id_col, text_col, shingle))
    groups = durable(marked.groupBy("fp").agg(F.min(id_col).alias("first")))
    found = components(links(groups.select("fp"), radius))
    of = groups.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = of.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(of.join(smallest, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


#: Bands and rows of minimal hashes.
BANDS, BAND_ROWS = 12, 4
#: Leaders of a band that distances are kept to; bytes of its shingle sets in memory, the rest lies in a temporary file.
LEADERS, SPOOL = 8, 32_000_000
#: Links that a task hands on at a time.
LINKS = 20_000

_random = np.random.default_rng(SEED)
_FACTORS, _TERMS = (_random.integers(1 << 62, size=BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of all shingles in order, repeats included; none for a text without words."""
    words = text.encode("utf-8", "surrogatepass").translate(FOLD_BYTES).translate(_SPACES).split() if text else []
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)] if words else [], dtype=np.uint64)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed key for each band of minimal hashes; none without shingles."""
    if not len(hashes):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[i : i + 4096, None] * _FACTORS[None, :] + _TERMS[None, :]).min(axis=0))
    rows = least.reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(bytes([i]) + row.tobytes(), SEED) - (1 << 63) for i, row in enumerate(rows)]


def bits_of(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


class Band:
    """The members of one band so far and the components that links of at least `similarity` make of them.

    A member is held against every earlier one that isn't in its component yet,
    so components are those of all pairs. 1 - overlap is a metric: distances to
    the leaders (members that no earlier leader took) rule out partners by the
    triangle inequality, sizes by their ratio. Members with equal sets are one.
    """

    def __init__(self, similarity: float):
        self.similarity, self.parts, self.twins, self.leaders = similarity, 0, {}, []
        self.n, self.sets = 0, SpooledTemporaryFile(SPOOL)  # noqa: SIM115
        self.rows = np.zeros(4, [("id", "i8"), ("fp", "u8"), ("size", "i8"), ("at", "i8"), ("root", "i8")])
        self.far = np.full((4, LEADERS), np.nan, np.float32)

    def hashes(self, i: int) -> np.ndarray:
        self.sets.seek(int(self.rows["at"][i]))
        return np.frombuffer(self.sets.read(8 * int(self.rows["size"][i])), np.int64)

    def candidates(self, root: int, fp: int, size: int, far: np.ndarray) -> np.ndarray:
        """Earlier members outside the component that sizes and distances allow, those with the nearest fingerprints first."""
        at = np.flatnonzero(self.rows["root"][: self.n] != root)
        sizes = self.rows["size"][at]
        at = at[np.minimum(sizes, size) >= (self.similarity - 1e-9) * np.maximum(sizes, size)]
        at = at[~(np.abs(self.far[at] - far) > 1 - self.similarity + 1e-6).any(axis=1)]
        return at[np.argsort(np.bitwise_count(self.rows["fp"][at] ^ np.uint64(fp)), kind="stable")]

    def add(self, key: int, fp: int, hashes: np.ndarray) -> list[int]:
        """The ids of earlier members that link the member with their components, one for each component."""
        digest, fp = xxhash.xxh128_digest(hashes.tobytes()), fp & ((1 << 64) - 1)
        if digest in self.twins:
            return [self.twins[digest]]
        self.twins[digest] = key
        root, found, far = -1, [], np.full(LEADERS, np.nan, np.float32)

        def link(i: int) -> None:
            nonlocal root
            other = int(self.rows["root"][i])
            if root >= 0:
                mine = self.rows["root"][: self.n]
                mine[mine == other] = root
                self.parts -= 1
            else:
                root = other
            found.append(int(self.rows["id"][i]))

        for k, (i, of) in enumerate(self.leaders):
            near = overlap(of, hashes)
            far[k] = 1 - near
            if near >= self.similarity and self.rows["root"][i] != root:
                link(i)
        taken = bool(found)
        if self.parts > (root >= 0):
            for i in self.candidates(root, fp, len(hashes), far).tolist():
                if self.rows["root"][i] != root and overlap(self.hashes(i), hashes) >= self.similarity:
                    link(i)
                    if self.parts == 1:
                        break
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.far = np.concatenate([self.far, np.full_like(self.far, np.nan)])
        if not taken and len(self.leaders) < LEADERS:
            far[len(self.leaders)] = 0
            self.leaders.append((self.n, hashes))
        self.parts += root < 0
        self.rows[self.n] = (key, fp, len(hashes), self.sets.seek(0, 2), self.n if root < 0 else root)
        self.far[self.n] = far
        self.sets.write(hashes.tobytes())
        self.n += 1
        return found


def copy_of(text_col: str):
    """Equal for equal texts."""
    return F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit(""))


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> tuple[DataFrame, DataFrame]:
    """(id, copy, ..) of each row with an id; (copy, rep, node, root) of each text: its smallest id, its number and its component's smallest number.

    Numbers rise with (rep, copy), so the smallest one has the component's smallest id.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t, shingle) for (t,) in rows_of([batch], "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copy"), pa.array([bits_of(np.unique(h)) for h in hashes], pa.int64()), pa.array([band_keys(h) for h in hashes], pa.list_(pa.int64()))], names=["id", "copy", "fp", "bands"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([np.unique(shingle_hashes(t, shingle).view(np.int64)) for (t,) in rows_of([batch], "text")], pa.list_(pa.int64()))], names=["node", "hashes"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), copy_of(text_col).alias("copy"))
    sketches = durable(texts.mapInArrow(sketch, f"id {kind}, copy string, fp long, bands array<long>"))
    least = sketches.groupBy("copy").agg(F.min("id").alias("rep"))
    copies = durable(least.repartitionByRange("rep", "copy").sortWithinPartitions("rep", "copy").withColumn("node", F.monotonically_increasing_id()))
    texts_once = sketches.join(copies, "copy").where("id = rep and size(bands) > 0").select("node", "fp", "bands")
    linked = components(links(durable(texts_once.select("fp").distinct()), radius)).select(F.col("node").alias("fp"), "root")
    of_links = texts_once.select("node", "fp").join(linked, "fp", "left").select("node", "fp", F.xxhash64(F.lit("fingerprints"), F.coalesce("root", "fp")).alias("band"))
    reps = texts_once.select("node", "fp", F.explode("bands").alias("band")).unionAll(of_links)
    crowded = durable(reps.groupBy("band").agg(F.countDistinct("node").alias("n")).where("n > 1").select("band"))
    members = durable(reps.join(crowded, "band").dropDuplicates(["band", "node"]))
    wanted = members.select("node").distinct().join(copies, "node").select("node", "copy", F.col("rep").alias("id"))
    shingles = texts.join(wanted, ["id", "copy"]).mapInArrow(sets, "node long, hashes array<long>").dropDuplicates(["node"])
    grouped = members.join(shingles, "node").repartition("band").sortWithinPartitions("band", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, held, found = None, None, []
        record = lambda: pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
        for batch in batches:
            column = batch.column("hashes")
            values, ends = column.values.to_numpy(), column.offsets.to_numpy()
            for row, (b, key, fp) in enumerate(rows_of([batch], "band", "node", "fp")):
                if b != band:
                    band, held = b, Band(similarity)
                found += [(x, key) for x in held.add(key, fp, values[ends[row] : ends[row + 1]].copy())]
                if len(found) >= LINKS:
                    yield record()
                    found.clear()
        yield record()

    found = components(durable(grouped.mapInArrow(run, "a long, b long").distinct()))
    return sketches, copies.join(found, "node", "left").select("copy", "rep", "node", F.coalesce("root", "node").alias("root"))


def near_duplicate_texts(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of each row with an id: component_id is the smallest id that links of at least `similarity` reach."""
    sketches, copies = near_copies(docs, similarity, shingle, id_col, text_col)
    first = copies.where("node = root").select("root", F.col("rep").alias("component_id"))
    return sketches.join(copies.join(first, "root"), "copy").select(F.col("id").alias(id_col), "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each near-duplicate group, the one with the smallest id; same columns.

    Rows are known by id and text: unlike texts under one id are documents of
    their own. Rows without an id stay; of rows that repeat id and text one stays.
    """
    return unclashed(docs, _first_of_each_group, id_col, text_col)


def _first_of_each_group(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    sketches, copies = near_copies(docs, id_col=id_col, text_col=text_col)
    gone = sketches.join(copies, "copy").where("node <> root or id <> rep").select(F.col("id").alias(id_col), F.col("copy").alias("__copy")).distinct()
    kept = docs.withColumn("__copy", copy_of(text_col)).join(gone, [id_col, "__copy"], "left_anti")
    known = kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, "__copy"])
    return known.unionByName(kept.where(F.col(id_col).isNull())).select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
