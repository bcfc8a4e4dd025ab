"""Clustering, hard negatives and pieces against brute force and the library, odd rows among them."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import clustering, hard_negatives, sentence_pieces, vectors

files = pytest.importorskip("public_tokenizers")
SCHEMA = "vec_id long, embedding array<double>, label string, cluster string, id int, n int, distance string, v string, block int"


def make(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, "c", 1, 2, "d", "v", 3) for i, v, l in rows], SCHEMA)


def some(seed, n, length, labels="abc"):
    rnd = random.Random(seed)
    centre = [[rnd.gauss(0, 1) for _ in range(length)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rnd.choice(centre)
        rows.append((i, [x + rnd.gauss(0, 0.3) for x in c], rnd.choice(labels)))
    rows += [(n + i, rows[7][1], "a") for i in range(40)]  # equal vectors
    return rows


ODD = [(900, None, "a"), (901, [], "a"), (902, [1.0, 2.0], "a"), (903, [None] * 4, "b"), (904, [float("nan")] + [0.0] * 3, "b"), (905, [float("inf")] * 4, "c"), (906, [1e308] * 4, "c"), (907, [1e18, -1e18, 3.0, 0.5], "a"), (908, [1e30, 0.0, 0.0, 2.0], "b"), (None, [0.1, 0.2, 0.3, 0.4], "b"), (910, [0.1, 0.2, 0.3, 0.4], None), (12, [0.4, 0.2, 0.3, 0.4], "b")]


def lloyd(rows, k, rounds, length, scale, seed):
    kept = [(i, [int(np.floor(x * scale)) for x in v]) for i, v, _ in rows if v is not None and len(v) == length and all(x is not None and np.isfinite(x * scale) for x in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(centroids)), key=lambda c: (away(v, centroids[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v), []).append(v)
        centroids = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else old for c, old in enumerate(centroids)]
    hold = lambda x: min(x, 2**63 - 1)
    found = [(i, near(v), away(v, centroids[near(v)])) for i, v in kept]
    per = {}
    for _, c, d in found:
        per[c] = per.get(c, 0) + d
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, hold(d), hold(per[c]), hold(sum(per.values())), text[c]) for i, c, d in found), key=str)


@pytest.mark.parametrize(("odd", "k"), [(False, 8), (True, 8), (True, 200), (False, 1)])
def test_clusters_equal_brute_force(spark, odd, k):
    rows = some(3, 120, 4) + (ODD if odd else [])
    found = clustering.clusters(make(spark, rows), k=k, rounds=4, length=4).drop("centroid").collect()
    assert sorted((tuple(r) for r in found), key=str) == lloyd(rows, k, 4, 4, 1024, 3)


def test_clusters_of_nothing(spark):
    assert clustering.clusters(make(spark, []), length=4).collect() == []
    assert clustering.clusters(make(spark, ODD[:6]), length=4).collect() == []


def test_intervals_hold_the_nearest_and_few_others():
    rnd = np.random.default_rng(5)
    centroids = clustering.Centroids(rnd.integers(-3000, 3000, (300, 64)).tolist())
    v = rnd.integers(-3000, 3000, (500, 64)).astype(float)
    near, distance, again = centroids.assign(v)
    exact = ((v[:, None, :] - centroids.exact[None, :, :]) ** 2).sum(2)
    assert (near == exact.argmin(1)).all()
    assert (distance == exact.min(1)).all()
    assert again < 50


def test_ties_go_to_the_lowest_number_where_float32_cannot_tell():
    # Far from the origin single precision can't tell the two centroids apart; both are one away.
    base = 2**24
    centroids = clustering.Centroids([[base + 2, base], [base, base], [base, base]])
    near, distance, again = centroids.assign(np.array([[base + 1.0, base], [base, base]]))
    assert near.tolist() == [0, 1]
    assert distance.tolist() == [1, 0]
    assert again >= 5


def test_sums_of_any_size_are_exact():
    for total in (0, -1, 2**40, -(2**40), 2**200 + 7, -(2**131) - 5):
        assert sum(x << (vectors.LIMB * place) for place, x in vectors.limbs(total)) == total
        assert all(abs(x) <= 2**40 for _, x in vectors.limbs(total))


def mined(rows, every, positives=5, negatives=10):
    kept = [(i, l, [int(np.floor(x * 256)) for x in v]) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and np.isfinite(x * 256) for x in v)]
    asking = {}
    for i, l, v in kept:
        if i % every == 0 and (i not in asking or (l, v) < asking[i]):
            asking[i] = (l, v)
    hold = lambda x: max(-(2**63), min(2**63 - 1, x))
    out = []
    for a, (label, v) in asking.items():
        scored = [(-hold(sum(x * y for x, y in zip(v, w, strict=True))), i, l) for i, l, w in kept if i != a and len(w) == len(v)]
        scored.sort()
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            window = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p]
            out += [(a, i, r, n, -p, -s) for r, (s, n, _) in enumerate(window[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize(("anchors", "rows", "chunk"), [(256, 2048, 32), (3, 17, 2), (1, 1000, 3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, anchors, rows, chunk):
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "ROWS", rows)
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    given = some(4, 110, 4, "aaaaaabc") + ODD
    found = hard_negatives.hard_negatives(make(spark, given), F.col("id") % 10 == 0, F.col("label"))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == mined(given, 10)


def test_hard_negatives_of_nothing(spark):
    for rows in ([], ODD[:6], [(0, [1.0], "a")], [(0, [1.0], "a"), (1, [2.0], "a")], [(1, [1.0], "a"), (2, [2.0], "b")]):
        assert hard_negatives.hard_negatives(make(spark, rows), F.col("id") % 10 == 0, F.col("label")).collect() == []


def test_partial_tiles_beyond_64_bits_add_up_exactly(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CHUNK", 1)
    big = 2.0**40
    rows = [(0, [big, big, 1.0], "a"), (1, [big, -big, 4.0], "a"), (2, [big, -big, 2.0], "b"), (3, [big, big, 0.0], "b"), (4, [0.0, 0.0, 3.0], "b")]
    found = hard_negatives.hard_negatives(make(spark, rows), F.col("id") == 0, F.col("label")).collect()
    assert sorted(tuple(r) for r in found) == mined(rows, 10) == [(0, 1, 1, 4, 4 * 65536, 3 * 65536), (0, 1, 2, 2, 4 * 65536, 2 * 65536)]


PATH = files.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tool():
    return sentence_pieces.PieceEncoder(PATH)


def test_pieces_equal_the_library_on_all_kinds_of_texts(tool):
    rnd = random.Random(8)
    alphabet = ["a", "b", " ", "  ", "▁", "\t", "\n", "\x00", "é", "ß", "日本", "語", "😀", "́", "ﬁ", "Ａ", "<s>", "</s>", "<unk>", "<0x41>", "the ", "12", ".", ",", "'", "ing", "‍", "𒀀"]
    texts = ["", " ", "   ", "▁", None, *("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(4000))]
    texts += ["ab" * 60_000, " " * 5000, "a" * 5001]
    found = sentence_pieces.encode_texts(texts, PATH)
    for text, (ids, decoded, agrees) in zip(texts, found, strict=True):
        expected = tool.library.encode(text or "", add_bos=True, add_eos=True)
        assert memoryview(ids).cast("I").tolist() == expected, text
        assert decoded == tool.library.decode(expected)
        assert agrees


def test_any_ids_decode_as_the_library_decodes_them(tool):
    rnd = random.Random(9)
    for _ in range(5000):
        ids = [rnd.choice([0, 1, 2, rnd.randint(3, 258), 259, 28705, rnd.randint(259, 31999)]) for _ in range(rnd.randint(0, 9))]
        assert tool.decode(ids) == tool.library.decode(ids), ids


def test_parts_never_cut_a_piece(tool):
    for name in tool.ids:
        assert tool.parts(name) == [name]
    text = "Été 12,5 km▁▁x\n\ny <s> 日本語のテ"
    assert "".join(tool.parts(text)) == text


def test_kept_parts_stay_bounded(monkeypatch, tool):
    monkeypatch.setattr(sentence_pieces, "MOST_PARTS", 3)
    own = sentence_pieces.PieceEncoder(PATH)
    for i in range(50):
        assert own.encode(f"word{i} other{i}") == tool.encode(f"word{i} other{i}")
        assert len(own.kept) <= 3 and len(own.words) <= 3


def test_words_met_again_are_not_merged_again_when_a_table_was_full(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "MOST_PARTS", 3)
    own = sentence_pieces.PieceEncoder(PATH)
    merged, merge = [], own.merge
    monkeypatch.setattr(own, "merge", lambda part: merged.append(part) or merge(part))
    for i in "abcdefghijklmnop":
        own.encode(f"often x{i}")
    assert merged.count("▁often") == 1


class Counted:
    """The library, with the texts that it was given to encode."""

    def __init__(self, library):
        self.library, self.seen = library, []

    def __getattr__(self, name):
        return getattr(self.library, name)

    def encode(self, texts, **options):
        self.seen += texts
        return self.library.encode(texts, **options)


def test_the_library_encodes_a_word_once_with_the_blanks_before_it(monkeypatch):
    own = sentence_pieces.PieceEncoder(PATH)
    own.library = Counted(own.library)
    monkeypatch.setattr(sentence_pieces, "encoder", lambda path: own)
    assert all(x[2] for x in sentence_pieces.encode_texts(["the cat.\nAnd", "cat.\nAnd the"] * 50, PATH) + sentence_pieces.encode_texts(["the the", "two  blanks", "  blanks ", "   ", "", None], PATH))
    assert sorted(x for x in own.library.seen if x in ("the", "cat.\nAnd")) == ["cat.\nAnd", "the"]
    assert sorted(x for x in own.library.seen if "lanks" in x) == ["▁blanks", "▁▁blanks", "▁▁blanks▁"]
    assert not any(" " in x for x in own.library.seen)


def test_words_of_a_text_are_all_of_it(tool):
    for text in ["a b", " a", "  a  b ", "a   ", " ", "    ", "▁", "a▁b ▁", "\n x\n"]:
        words = tool.words_of(text)
        assert "▁" + "▁".join(words) == tool.normalised(text)
        assert all(w.strip("▁") for w in words) or len(words) == 1
    assert tool.words_of("") is None and tool.words_of(None) is None


def test_a_word_that_the_library_encodes_otherwise_is_told_of_every_text_with_it(monkeypatch):
    own = sentence_pieces.PieceEncoder(PATH)
    merge = own.merge
    monkeypatch.setattr(own, "merge", lambda part: [own.ids[c] for c in part] if part == "▁wrong" else merge(part))
    monkeypatch.setattr(sentence_pieces, "encoder", lambda path: own)
    texts = ["a right word", "a wrong word", "wrong  blanks", "right  blanks"]
    for _ in range(2):  # the second time all words are kept
        assert [x[2] for x in sentence_pieces.encode_texts(texts, PATH)] == [True, False, False, True]
    assert [x[2] for x in sentence_pieces.encode_texts(["wrong", "right"], PATH)] == [False, True]


def test_pieces_of_a_table(spark):
    rows = [(1, "the cat"), (1, "the cat"), (None, "Été"), (2, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, ids string, id int")
    found = sentence_pieces.encode_pieces(docs, PATH).collect()
    assert [(r["doc_id"], r["decoded"], r["agrees"]) for r in found] == [(i, t or "", True) for i, t in rows]
    again = sentence_pieces.decode_pieces(sentence_pieces.encode_pieces(docs, PATH).drop("decoded"), PATH).collect()
    assert [r["decoded"] for r in again] == [t or "" for _, t in rows]
    digests = sentence_pieces.encode_pieces(docs, PATH, digests=True).collect()
    for r, d in zip(found, digests, strict=True):
        assert d["n_tokens"] == len(r["ids"])
        assert d["ids_sha256"] == hashlib.sha256(np.array(r["ids"], dtype="<u4").tobytes()).hexdigest()
        assert d["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert sentence_pieces.encode_pieces(docs.limit(0), PATH).collect() == []


def test_clustering_sql_is_the_same_clustering():
    rows = some(3, 60, 4)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [(i, v) for i, v, _ in rows])
    assert sorted(con.execute(clustering.oracle(8, 4, 4)).fetchall(), key=str) == lloyd(rows, 8, 4, 4, 1024, 3)
