"""Operators of the llm subpackage against brute force on small tables with odd rows."""

import collections
import json
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import decontamination, licenses, line_dedup, packing, sharding, simhash, token_counts, toxicity, url_filters, vector_search

files = pytest.importorskip("public_tokenizers")

#: Extra columns clash with names that the operators use.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, size int, key string, n_words string, shard string, label string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", 1, 2, "k", "w", "x", "l") for i, t in rows], SCHEMA)


def texts(seed=1, n=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(80)] + ["Été", "straße", "日本", "it's"]
    line = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    shared = [line(12), line(20) + "\n" + line(3), line(4)]
    out = []
    for i in range(n):
        parts = [line(rnd.randint(1, 25)) for _ in range(rnd.randint(1, 6))]
        if i % 4 == 0:
            parts.insert(rnd.randint(0, len(parts)), rnd.choice(shared))
        out.append("\n".join(parts))
    out += [out[0], out[0], out[3] + " extra", "", "   ", None, "Released under the MIT License. x MIT license", "one", "x" * 5000, line(40_000)]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def rows():
    found = texts()
    return [*found, found[5], (None, "a text without id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1 packing


def test_packing_round_trip(docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    found = packing.pack_documents(docs).collect()
    by_doc = collections.defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
    for key, text in {k: t for k, t in rows if k is not None and k != 5}.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for p in sorted(by_doc[key], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert sum(p.length for p in by_doc[5]) == 2 * by_doc[5][0].doc_tokens
    filled = collections.defaultdict(list)
    for r in found:
        filled[r.sequence_id].append((r.offset, r.length))
    for pieces in filled.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack_documents(empty).count() == 0


def test_packing_prefers_neighbours():
    a, b = [np.arange(1, 301, dtype="<u4")] * 2, [np.arange(1000, 1300, dtype="<u4")] * 2
    order = [d for d, s, *_ in packing.pack_shard([a[0], b[0], a[1], b[1]]) if s == 0]
    assert order == [0, 2, 1, 3]


def test_packing_neighbours_by_brute_force():
    rnd = np.random.default_rng(5)
    docs = [np.minimum(rnd.zipf(1.3, rnd.integers(1, 120)), 3000).astype("<u4") for _ in range(700)]
    shard, unused = packing.Shard(docs), rnd.random(700) < 0.6
    terms = [collections.Counter(d.tolist()) for d in docs]
    df, mean = collections.Counter(t for c in terms for t in c), np.mean([len(d) for d in docs])

    def score(seed, d):
        own, norm = terms[d], packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / mean)
        return sum(np.log1p((700 - df[t] + 0.5) / (df[t] + 0.5)) * own[t] * (packing.K1 + 1) / (own[t] + norm) for t in terms[seed] if df[t] > 1 and t in own)

    for seed in range(0, 700, 7):
        unused[rnd.integers(0, 700, 4)] = False
        scores = sorted((score(seed, d) for d in range(700) if unused[d]), reverse=True)[: packing.NEIGHBOURS]
        found = shard.neighbours(seed, unused)
        assert all(unused[d] for d in found)
        assert np.allclose([score(seed, d) for d in found], [x for x in scores if x > 0])


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    encode = packing._encoder()
    for t in ["", "a b", "x<|endoftext|>y", "日本 語", "it's   \n\n 12ab", "é" * 50, "퟿ \U0001f600"]:
        assert encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


# ---- 2 token counts


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(files.path("word_bpe_49k.json"))
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, token_counts._word_file).collect())
    want = []
    for k, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((-1 if k is None else k, len((t or "").encode()), n, n > 2048))
    assert found == sorted(want)
    assert token_counts.token_counts(empty, token_counts._word_file).count() == 0


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 1 << 16])
def test_transducer_chunks(chunk):
    from tokenizers import Tokenizer

    library, machine = Tokenizer.from_file(files.path("word_bpe_49k.json")), token_counts.transducer(files.path("word_bpe_49k.json"))
    for t in ["Hello WORLD's it's don't  ΑΣ \x1c\x85 x\xa0y <|startoftext|>a<|endoftext|><|end", "İstanbul é 数学 12345 !!!...'''s", "a" * 200, "", " ", "'S 'LL 'Re\n\n?"]:
        assert machine.count(t, chunk) == len(library.encode(t, add_special_tokens=False).ids)


# ---- 3 toxicity


def toxic_rows(spark, n=400):
    rnd = random.Random(3)
    plain = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        ws = [rnd.choice(plain) for _ in range(40)]
        bad = i % 5 == 0
        for _ in range(4 * bad):
            ws[rnd.randrange(40)] = rnd.choice(["Scum", "gruffel" + rnd.choice(["a", "en", "ist"]), "vile"])
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows(spark)
    docs = make(spark, [*rows, (900, None), (901, ""), (None, "scum")])
    table = spark.createDataFrame([*labels, (0, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.fit(docs, table)).collect()
    assert len(found) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    truth = dict(labels)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    assert sum((r.predicted == truth[r.doc_id]) for r in held) >= 0.97 * len(held) and len(held) > 40
    kept = {r.doc_id for r in toxicity.without_toxic(docs, table).collect()}
    assert {900, 901} <= kept and not {i for i, y in labels if y} & kept


def test_toxicity_ignores_held_out_labels(spark):
    rows, labels = toxic_rows(spark, 200)
    docs = make(spark, rows)
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int"))).collect()) for x in (labels, flip))
    assert a == b


def test_toxicity_without_labels(spark, empty):
    model = toxicity.fit(make(spark, [(1, "a")]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.score("a") < 0.5
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_odd_rows(spark):
    """Very long and repeated rows, ids with unlike texts, clashing columns."""
    rows, labels = toxic_rows(spark, 200)
    rows += [(700, "plain " * 200_000), (701, "plain " * 200_000 + "scum gruffelist vile scum vile"), (0, "another text of id 0"), rows[5], rows[5]]
    docs = make(spark, rows).withColumn("y", F.lit("x")).withColumn("score", F.lit("x"))
    found = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([*labels, labels[5]], "doc_id long, toxic int"))).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    assert len(found) == len(rows) and len(by[5]) == 3 and len({r.score for r in by[5]}) == 1 and len(by[0]) == 2
    assert by[700][0].predicted == 0 and by[701][0].predicted == 1


def test_label_model_finds_weak_voter():
    rnd = np.random.default_rng(0)
    y = rnd.random(3000) < 0.2
    votes = np.stack([np.where(y, rnd.random(3000) < p, rnd.random(3000) < q) for p, q in ((0.9, 0.05), (0.8, 0.1), (0.5, 0.5))], axis=1) * 2.0 - 1
    votes = np.hstack([votes, votes[:, :1], np.where(y, 1.0, -1.0)[:, None]])
    posterior, rates, discount = toxicity.label_model(votes, np.ones(3000), 0.2)
    assert abs(rates[1][2][0] - 0.9) < 0.05 and abs(rates[0][2][1] - 0.1) < 0.05 and abs(rates[1][2][2] - rates[0][2][2]) < 0.1
    assert discount[0] < 0.65 and discount[2] > 0.8 and ((posterior > 0.5) == y).mean() > 0.97


def test_label_model_posterior_by_brute_force():
    """Three voters and the given label: the posterior is Bayes' rule over the rates, with each voter's evidence discounted, none from those that abstain."""
    rnd = np.random.default_rng(1)
    y = rnd.random(2000) < 0.3
    votes = np.stack([np.where(y, rnd.choice([1, 0], 2000, p=[0.8, 0.2]), rnd.choice([1, 0], 2000, p=[0.05, 0.95])) for _ in range(3)] + [np.where(y ^ (rnd.random(2000) < 0.1), 1, -1)], axis=1).astype(float)
    posterior, rates, discount = toxicity.label_model(votes, np.ones(2000), 0.3)
    for row in range(0, 2000, 50):
        odds = 0.3 / 0.7
        for v in range(4):
            at = int(votes[row, v]) + 1
            odds *= (rates[1][at][v] / rates[0][at][v]) ** discount[v] if at != 1 else 1
        assert posterior[row] == pytest.approx(odds / (1 + odds), abs=1e-3)


def test_wrong_given_labels_are_outvoted(spark):
    """A tenth of the given labels is flipped; the posterior and the classifier follow the truth."""
    rows, labels = toxic_rows(spark, 1500)
    truth, rnd = dict(labels), random.Random(8)
    noisy = [(i, 1 - y if rnd.random() < 0.1 else y) for i, y in labels]
    docs = make(spark, rows)
    found = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(noisy, "doc_id long, toxic int"))).collect()}
    wrong = [i for i, y in noisy if y != truth[i]]
    assert len(wrong) > 100 and sum(found[i] == truth[i] for i in wrong) >= 0.95 * len(wrong)
    assert sum(found[i] == truth[i] for i in truth) >= 0.97 * len(truth)
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.2
    voters = [np.where(y, rng.random(4000) < 0.7, rng.random(4000) < 0.02) for _ in range(5)]
    given = y ^ (rng.random(4000) < 0.15)
    counter = -1.0 * ~np.any(voters, axis=0)
    posterior, rates, _ = toxicity.label_model(np.stack([*(v * 1.0 for v in voters), counter, np.where(given, 1.0, -1.0)], axis=1), np.ones(4000), 0.2)
    assert ((posterior > 0.5) == y).mean() > 0.9 > 0.87 > (given == y).mean()


# ---- 4 url filters


def test_url_parts_and_rules(spark, empty):
    cases = [
        ("http://www.Example.COM/en/a?x#y", "www.example.com", "/en/a", "www.example.com/en/"),
        ("https://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/"),
        ("https://example.com/de/", "example.com", "/de/", "com/"),
        ("http://badexample.com/en/", "badexample.com", "/en/", "com/"),
        ("ftp://x.net/fr/?q", "x.net", "/fr/", "net/fr/"),
        ("http://com", "com", "", None),
        ("http://a.org?x=://b.com/", "a.org", "", None),
        ("no scheme.com/", "", "", None),
        ("", "", "", None),
        (None, "", "", None),
        ("http://x.com/é\nb#z", "x.com", "/é\nb", "com/"),
    ]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, (u, *_) in enumerate(cases)], "page_id long, url string, host string, row int")
    found = {r.page_id: r for r in url_filters.judge(pages).collect()}
    for i, (_, host, path, rule) in enumerate(cases):
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule)
        assert found[i].verdict in ("allow", "block")
    verdicts = {h + p: v for h, p, v in url_filters.RULES}
    assert all(r.verdict == verdicts[r.rule] for r in found.values() if r.rule)
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_mined_rules_by_brute_force(spark):
    rnd = random.Random(5)
    rows = [(sorted({rnd.choice("abcdef") for _ in range(3)}), "") for _ in range(300)]
    rows = [(t, "block" if {"a", "b"} <= set(t) else "allow") for t, _ in rows]
    mined = {(tuple(r.tokens), r.verdict): (r.confidence, r.support) for r in url_filters.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02, 0.9).collect()}
    assert (("a", "b"), "block") in mined and not any(len(t) > 2 and {"a", "b"} <= set(t) for t, _ in mined)
    for (t, v), (confidence, _) in mined.items():
        having = [x for x in rows if set(t) <= set(x[0])]
        assert confidence == pytest.approx(sum(x[1] == v for x in having) / len(having)) and confidence >= 0.9


def test_tokens_that_come_together_are_one(spark):
    """40 tokens of one site, and a path that grows by a part at a time: sets of either would be 2^40."""
    import time

    site = [f"p:s{i}" for i in range(40)]
    rows = [([*site, "h:a", "h:all"], "block")] * 30 + [(["h:b", "h:all", *(f"p:d{j}" for j in range(i % 30))], "allow" if i % 30 < 20 else "block") for i in range(300)]
    began = time.time()
    mined = url_filters.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02, 0.9).collect()
    assert time.time() - began < 120
    sure = {(tuple(r.tokens), r.verdict): r for r in mined}
    assert sure[("h:a",), "block"].alike == [["h:a", *sorted(site)]]
    # brute force: each single token and each pair, by the same rules
    brute = {}
    tokens = sorted({t for ts, _ in rows for t in ts if t not in site})
    for few in [(t,) for t in tokens] + [(a, b) for a in tokens for b in tokens if a < b]:
        having = [v for ts, v in rows if set(few) <= set(ts)]
        for v in ("allow", "block"):
            share = sum(x == v for _, x in rows) / len(rows)
            if having.count(v) >= 0.02 * len(rows) and having.count(v) / len(having) >= 0.9 and having.count(v) / len(having) > share and len(having) < len(rows):
                brute[few, v] = having.count(v) / len(having)
    best = {k for k, c in brute.items() if len(k[0]) == 1 or not any(brute.get(((t,), k[1]), 0) >= c for t in k[0])}
    assert best == set(sure)
    assert {(("h:a",), "block"), (("p:d18",), "block"), (("p:d19",), "block")} <= best
    urls = ["http://x.net/de/" + "/".join(f"s{i}" for i in range(40)) + f"/{k}" for k in range(40)]
    urls = [u.replace("/de/", "/fr/") if i % 2 else u for i, u in enumerate(urls)] + [f"http://y.com/{i}/t" for i in range(60)]
    judged = url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert all(r.verdict == "block" for r in judged if "s39" in r.path)


def test_judgement_by_brute_force(spark):
    """Every url against every mined rule; urls of one id, long urls, frequent tokens with digits."""
    rnd = random.Random(15)
    urls = [f"http://{rnd.choice(['a', 'b', 'web2'])}.{rnd.choice(['com', 'net', 'org'])}/{rnd.choice(['fr', 'es', 'de', 'v1'])}/{rnd.choice(['x', 'news', 'ads'])}{rnd.choice(['', '?utm=1', '?id=2'])}" for _ in range(800)]
    urls += ["http://web2.org/v1/" + "x" * 50_000, None, urls[0]]
    pages = spark.createDataFrame([(i // 2, u, "r", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, row int")
    found = url_filters.judge(pages).collect()
    assert len(found) == len(urls)

    def tokens(u):
        host, _, rest = u.partition("://")[2].partition("/")
        path, _, q = rest.partition("?")
        return {x for x in [*("h:" + w for w in host.split(".")), *("p:" + w for w in path.split("/")), *("k:" + k.split("=")[0] for k in q.split("&") if q)] if len(x) > 2}

    given = {h + p: v for h, p, v in url_filters.RULES}
    host, path = url_filters.parts(F.col("url"))
    rule, verdict = url_filters.fitting_rule(F.col("host"), F.col("path"), url_filters.RULES)
    labelled = [r for r in pages.select("url", host.alias("host"), path.alias("path")).select("url", verdict.alias("v")).collect() if r.v]
    mined = [(set(r.tokens), r.verdict, r.confidence, r.support, r.rule_id) for r in url_filters.mine(spark.createDataFrame([(sorted(tokens(r.url)), r.v) for r in labelled], "tokens array<string>, verdict string")).collect()]
    assert any("h:web2" in t or "p:v1" in t for t, *_ in mined)
    want = collections.Counter()
    for u in urls:
        fits = [(c, s, -len(t), v == "allow", i, v) for t, v, c, s, i in mined if u and t <= tokens(u)]
        want[u, max(fits)[-1] if fits else "allow"] += 1
    for r in found:
        if r.rule:
            assert r.verdict == given[r.rule]
    by_rule = collections.Counter((r.host, r.path, r.verdict) for r in found if not r.rule)
    brute = collections.Counter()
    ruled = {r.url for r in labelled}
    for (u, v), n in want.items():
        if u not in ruled:
            host, slash, rest = (u or "").partition("://")[2].partition("/")
            brute[host, (slash + rest).partition("?")[0], v] += n
    assert by_rule == brute


# ---- 5 line dedup


def brute_lines(rows, min_words=8):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, gone = collections.defaultdict(set), collections.defaultdict(set)
    at = []
    for d, text in order:
        ls = (text or "").split("\n") if text is not None else []
        full = [(i, x.strip(" ")) for i, x in enumerate(ls) if x.strip(" ")]
        at.append((d, full))
    for size in range(1, max([len(full) for _, full in at], default=0) + 1):
        for d, full in at:
            for j in range(len(full) - size + 1):
                win = full[j : j + size]
                key = (size, tuple(x for _, x in win))
                if seen[key] and sum(max(1, len(x.encode().split()), len(re.findall("[\u3040-\u30ff\u4e00-\u9fff]", x)) // 2) for _, x in win) >= min_words:
                    gone[d] |= {i for i, _ in win}
                seen[key].add((d, j))
    for d, full in at:
        for (a, _), (b, _) in zip(full, full[1:], strict=False):
            if {a, b} <= gone[d]:
                gone[d] |= set(range(a, b))
    return gone


def test_line_dedup(spark, empty):
    rows = [r for r in texts(7) if r[0] < 68]
    rows += [(200, "short\nline"), (201, "short\nline"), (202, "a b c d\n\ne f g h i\nq"), (203, "z\na b c d\n\ne f g h i"), (204, "\n\n")]
    docs = make(spark, [*rows, (205, rows[2][1]), (205, rows[2][1])])
    gone = brute_lines([*rows, (205, rows[2][1])])
    found = line_dedup.dedup_lines(docs).collect()
    assert len(found) == len(rows) + 2
    for r in found:
        text = dict([*rows, (205, rows[2][1])])[r.doc_id]
        want = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[r.doc_id])
        assert (r.text, r["__removed"]) == (want, len(gone[r.doc_id])), r.doc_id
    assert gone[203] == {1, 2, 3} and not gone[201]
    assert line_dedup.dedup_lines(empty).count() == 0
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns and 205 not in {r.doc_id for r in kept.collect()} and all(r.n_chars == len(r.text) for r in kept.collect() if r.text)


def test_line_dedup_of_short_lines_by_brute_force(spark):
    """Every length of run counts, words are runs without blanks, scripts without blanks count by characters."""
    rnd = random.Random(21)
    rows = [(0, "a b c\nd e f\ng h"), (1, "x\na b c\nd e f\ng h\ny"), (2, "a" + " " * 10 + "b"), (3, "a" + " " * 10 + "b"), (4, "日本語の文章はここにありますから"), (5, "日本語の文章はここにありますから")]
    pool = [" ".join(rnd.choice("abcdefg") for _ in range(rnd.choice((1, 1, 2, 3, 9)))) for _ in range(6)]
    rows += [(10 + i, "\n".join(rnd.choice([*pool, "", "\t"]) for _ in range(rnd.randint(1, 25)))) for i in range(60)]
    gone = brute_lines(rows)
    assert gone[1] == {1, 2, 3} and not gone[3] and gone[5] == {0}
    found = line_dedup.dedup_lines(make(spark, rows)).collect()
    for r in found:
        assert r.text == "\n".join(x for i, x in enumerate(dict(rows)[r.doc_id].split("\n")) if i not in gone[r.doc_id]), r.doc_id
    assert {min(20, len(v)) for v in gone.values()} > {1, 3, 5}


def test_maximal_runs(spark):
    lines = [f"line number {i} has quite a few more words" for i in range(40)]
    docs = make(spark, [(1, "\n".join(lines[:20])), (2, "\n".join(["x"] + lines[3:16] + ["y"])), (3, "\n".join(lines[30:33])), (4, "\n".join(lines[30:33]))])
    runs = {(r.id, r.line, r.lines, r.source_id, r.source_line) for r in line_dedup.repeated_runs(docs).collect()}
    assert runs == {(2, 1, 13, 1, 3), (4, 0, 3, 3, 0)}


# ---- 6 sharding


def check_shards(found, rows, shards, near):
    assert len(found) == len(rows)
    by = collections.defaultdict(list)
    for r in found:
        by[r.shard].append(r)
        assert 0 <= r.shard < shards
    sizes = [sum(r.size for r in by[s]) for s in range(shards)]
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    assert max(sizes) - min(sizes) <= near, sizes


def test_sharding(spark, docs, rows, empty):
    small = [r for r in rows if len(r[1] or "") < 3000]
    found = sharding.shard(make(spark, small)).collect()
    largest = max(len((t or "").encode()) + 1 for _, t in small)
    check_shards(found, small, 16, 4 * largest)
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in small)
    assert sorted((r.size, r.text_crc32) for r in found) == want
    assert len(sharding.shard(docs).collect()) == len(rows)
    assert sharding.shard(empty).count() == 0


def test_sharding_hot_group(spark):
    rows = [(i, "the same text " * 5) for i in range(2000)] + [(i, f"text {i} " * (i % 9 + 1)) for i in range(2000, 6000)]
    found = sharding.shard(make(spark, rows)).collect()
    total = sum(r.size for r in found)
    check_shards(found, rows, 16, 0.06 * total / 16)
    groups = collections.defaultdict(set)
    for r in found:
        groups[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in groups.values()) <= 1
    same = [(7, "one row")] * 300
    check_shards(sharding.shard(make(spark, same)).collect(), same, 16, 40)


def test_shards_and_slots_follow_the_key(spark, rows):
    small = [r for r in rows if len(r[1] or "") < 3000]
    docs = make(spark, small)
    found = sharding.shard(docs, 4)
    keys = docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("k0"), F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("k1"))
    at = [(r.shard, r.slot, r.k0, r.k1) for r in found.join(keys.dropDuplicates(), "doc_id").where("doc_id <> 5").collect()]
    assert [x[2:] for x in sorted(at)] == sorted(x[2:] for x in at)


@pytest.mark.parametrize("share", [0.0, 10.0])
def test_groups_are_cut_only_beyond_their_share(spark, share):
    rows = [(i, f"text of group {i % 40}") for i in range(4000)]
    shards = collections.defaultdict(set)
    for r in sharding.shard(make(spark, rows), 7, group_share=share).collect():
        shards[r.text_crc32].add(r.shard)
    cut = sum(len(s) > 1 for s in shards.values())
    assert cut == 0 if share else 0 < cut <= 6


# ---- 7 decontamination


def brute_contamination(text, items, window=10):
    ws, hit, ids = words_of(text), set(), set()
    for key, item in items:
        iw = words_of(item)
        n = min(window, len(iw))
        for j in range(len(iw) - n + 1 if n else 0):
            for i in range(len(ws) - n + 1):
                if ws[i : i + n] == iw[j : j + n]:
                    hit |= set(range(i, i + n))
                    ids.add(key)
    return len(ws), len(hit), sorted(map(str, (i for i in ids if i is not None)))


def test_decontamination(spark, rows, monkeypatch):
    base = [r for r in rows if len(r[1] or "") < 3000]
    items = [(1, " ".join(words_of(base[0][1])[:14])), (2, base[4][1]), (10, "w1 W2"), (11, ""), (12, None), (13, "w3"), (14, "w5 w5 w5"), (None, base[9][1]), (2, base[4][1]), (15, "日本 Été x " + " ".join(words_of(base[8][1])[:12]))]
    base = [*base, (300, "w5 w5 w5 w5"), (301, "w3"), (302, base[4][1].upper())]
    docs, bench = make(spark, base), spark.createDataFrame(items, "item_id long, text string")
    for block in (8_000_000, 40):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
        found = decontamination.contamination(docs.select("doc_id", "text", "row"), bench)
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r.item_ids), r.contaminated) for r in found.collect())
        want = []
        for k, t in base:
            n, h, ids = brute_contamination(t, items)
            want.append((-1 if k is None else k, n, h, len(ids), tuple(ids), h > 0))
        assert got == sorted(want)
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)
    assert decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.contamination(docs.limit(0), bench).count() == 0


def test_longest_matches_and_their_places():
    items = decontamination.Items([(1, " ".join(f"a{i}" for i in range(30))), (2, "b c")], 10)
    out = decontamination.scan_shard(["x " + " ".join(f"a{i}" for i in range(5, 22)) + " y b c", "z", None], [items])
    assert out[0][:4] == (21, 19, 17, ["1", "2"]) and out[1] == (1, 0, 0, [], []) and out[2] == (0, 0, 0, [], [])
    assert [tuple(m.values()) for m in out[0][4]] == [("1", 1, 5, 17), ("2", 19, 0, 2)]


def test_repeated_words_on_both_sides_take_little_time_and_memory():
    """A megabyte of one word against an item of a megabyte of it; pairs of their places would be 2.5e11."""
    import time
    import tracemalloc

    many = "a " * 500_000
    items = decontamination.Items([(1, many), (2, "b " * 30), (3, "a b " * 20_000)], 10)
    tracemalloc.start()
    began = time.time()
    out = decontamination.scan_shard([many + "x", "a b " * 30_000, "c"], [items])
    assert time.time() - began < 60  # some 5 s where nothing else runs
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    assert [r[:4] for r in out] == [(500_001, 500_000, 500_000, ["1"]), (60_000, 60_000, 40_000, ["3"]), (1, 0, 0, [])]
    assert [m["words"] for m in out[0][4]] == [500_000]


def test_longest_matches_by_brute_force():
    rnd = random.Random(12)
    for vocabulary, window in (("ab", 3), ("abcde", 2), ("aab", 4)):
        line = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))  # noqa: E731, B023
        listed = [(i, line(rnd.choice([1, 2, 5, 30]))) for i in range(9)]
        shard = [line(rnd.choice([0, 1, 3, 60])) for _ in range(12)]
        for text, (n, hit, longest, ids, matches) in zip(shard, decontamination.scan_shard(shard, [decontamination.Items(listed[:5], window), decontamination.Items(listed[5:], window)]), strict=True):
            assert (n, hit, ids) == brute_contamination(text, listed, window)
            ws, ends = words_of(text), []
            for a in range(len(ws)):
                best = 0
                for _, item in listed:
                    iw = words_of(item)
                    for p in range(len(iw)):
                        k = 0
                        while a + k < len(ws) and p + k < len(iw) and ws[a + k] == iw[p + k]:
                            k += 1
                        if k >= min(window, len(iw)):
                            best = max(best, k)
                if best and a + best > max((e for _, e in ends), default=0):
                    ends.append((a, a + best))
            assert [(m["first"], m["first"] + m["words"]) for m in matches] == ends
            assert longest == max((e - a for a, e in ends), default=0)
            for m in matches:
                iw = words_of(listed[int(m["item_id"])][1])
                assert iw[m["item_first"] : m["item_first"] + m["words"]] == ws[m["first"] : m["first"] + m["words"]]


def test_intervals_by_brute_force():
    rnd = np.random.default_rng(3)
    suffixes, tests = rnd.integers(1, 4, (400, 5)), rnd.integers(1, 4, (200, 5))
    depth = rnd.integers(1, 6, 200)
    ordered = suffixes[decontamination.suffix_array(suffixes)]
    assert ordered.tolist() == sorted(suffixes.tolist())
    lo, hi = decontamination.intervals(ordered, tests, depth)
    for t, d, a, b in zip(tests, depth, lo, hi, strict=True):
        same = np.flatnonzero((ordered[:, :d] == t[:d]).all(axis=1))
        assert same.tolist() == list(range(a, b))


def test_decontamination_is_one_stage_and_keeps_clashing_columns(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c", "mine", 5), (1, "a b c", "mine", 5), (2, "d " * 100_000, None, 6)], "doc_id long, text string, hit_words string, item_ids long")
    bench = spark.createDataFrame([(i, "a b c" if i == 7 else f"item{i} of them") for i in range(40)], "item_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 40)
    judged = decontamination.contamination(docs, bench)
    assert judged._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("MapInArrow") == 1
    assert sorted((r.doc_id, r.hit_words, r.item_ids, r.n_words) for r in judged.collect()) == [(1, "mine", ["7"], 3), (1, "mine", ["7"], 3), (2, None, [], 100_000)]
    kept = decontamination.decontaminate(docs, bench)
    assert [tuple(r)[0::3] for r in kept.collect()] == [(2, 6)] and kept.columns == docs.columns


# ---- 8 simhash


def brute_fingerprint(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(UPPER)) if w]
    sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(keys, linked):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in keys:
        for b in keys:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash(docs, rows, empty):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    fp = {k: brute_fingerprint(t) for k, t in rows if k is not None}
    want = brute_components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert all((r.fp & (1 << 64) - 1, r.component_id) == (fp[r.doc_id], want[r.doc_id]) for r in found if r.doc_id is not None)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_by_brute_force(spark):
    rnd = random.Random(2)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:60]:
        for _ in range(6):
            fps.add(f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in simhash.components(simhash.links(df, 2)).collect()}
    want = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    groups = lambda of: sorted(tuple(sorted(k for k in fps if of(k) == r)) for r in {of(k) for k in fps})
    assert groups(lambda k: found.get(k, k)) == groups(lambda k: want[k])


def test_crowded_keys_are_split(spark, monkeypatch):
    """Fingerprints that differ in a few low bits share their keys; split keys give the same components."""
    rnd = random.Random(6)
    fps = sorted({sum(1 << b for b in rnd.sample(range(18), rnd.randint(0, 6))) for _ in range(900)} | {rnd.getrandbits(64) for _ in range(100)})
    monkeypatch.setattr(simhash, "GROUP", 20)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in simhash.components(simhash.links(df, 1)).collect()}
    want = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 1)
    groups = lambda of: sorted(tuple(sorted(k for k in fps if of(k) == r)) for r in {of(k) for k in fps})
    assert groups(lambda k: found.get(k, k)) == groups(lambda k: want[k]) and len(set(want.values())) > 101


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)], "a long, b long")
    assert {r.root for r in simhash.components(edges).where("node <= 100").collect()} == {0}


def test_near_duplicate_texts(spark, empty):
    rnd = random.Random(4)
    base = [[f"w{rnd.randrange(5000)}" for _ in range(120)] for _ in range(12)]
    rows = []
    for i, b in enumerate(base):
        rows.append((10 * i, " ".join(b)))
        near = [*b]
        near[rnd.randrange(120)] = "changed"
        rows += [(10 * i + 1, " ".join(near)), (10 * i + 2, " ".join(b)), (10 * i + 3, " ".join(b[:60] + [f"v{i}{j}" for j in range(60)]))]
    rows += [(500, ""), (501, None), (502, "two words"), (503, "Two  words")]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicate_texts(make(spark, [*rows, rows[0], (None, "x")])).collect()}
    sets = {k: {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, t in rows if (w := (t or "").lower().split())}
    want = brute_components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    assert {k: found[k] for k in sets} == want and found[500] == 500 and found[501] == 501
    kept = simhash.one_of_each_group(make(spark, [*rows, rows[0], (None, "x"), (None, "x")]))
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({k for k in [*want, 500, 501] if want.get(k, k) == k})
    assert kept.where("doc_id is null").count() == 2 and simhash.one_of_each_group(empty).count() == 0


def test_band_links_a_large_drifting_group_by_brute_force():
    rnd = random.Random(11)
    words, sets = [rnd.randrange(1 << 40) for _ in range(60)], []
    for i in range(2600):
        words[i % 60] = rnd.randrange(1 << 40)
        sets.append(np.array(sorted(words), dtype=np.int64))
    drifting = [(i, simhash.bits_of(s.view(np.uint64)), s) for i, s in enumerate(sets)]
    for order in (drifting, drifting[::-1], rnd.sample(drifting, len(drifting))):
        band, root = simhash.Band(0.8), list(range(len(sets)))
        for key, fp, s in order:
            for other in band.add(key, fp, s):
                while root[other] != other:
                    other = root[other]
                at = key
                while root[at] != at:
                    at = root[at]
                root[max(at, other)] = min(at, other)
        assert sum(i == r for i, r in enumerate(root)) == 1 == band.parts


def test_near_duplicates_with_a_passage_repeated_inside_a_text(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(0, 120, 2):
        base, passage = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(k)) for k in (200, 30))
        rows += [(i, f"{base} {passage}"), (i + 1, f"{base} {' '.join([passage] * 40)}")]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicate_texts(make(spark, rows)).collect()}
    assert found == {i: i // 2 * 2 for i, _ in rows}


def test_near_duplicate_recall_by_brute_force(spark):
    """Pairs of five-word similarity from 0.8 on, many close to it: at least 0.9 are found, and no others; string ids."""
    rnd = random.Random(14)
    rows = []
    for i in range(150):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(40, 300))]
        near = [*base]
        for _ in range(rnd.randint(0, max(1, len(base) // 45))):
            near[rnd.randrange(len(near))] = "changed"
        rows += [(f"a{i:03}", " ".join(base)), (f"b{i:03}", " ".join(near))]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicate_texts(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    sets = {k: {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, t in rows if (w := t.split())}
    like = [len(sets[f"a{i:03}"] & sets[f"b{i:03}"]) / len(sets[f"a{i:03}"] | sets[f"b{i:03}"]) >= 0.8 for i in range(150)]
    linked = [found[f"b{i:03}"] == f"a{i:03}" for i in range(150)]
    assert 30 < sum(like) < 150 and not any(x and not y for x, y in zip(linked, like, strict=True))
    assert sum(linked) >= 0.9 * sum(like)


def test_unlike_texts_of_one_id_are_documents_of_their_own(spark):
    rnd = random.Random(13)
    a, b, c, d = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(1, a), (2, b), (2, a + " end"), (2, c), (2, c), (3, d), (3, d + " end"), (4, c)]
    kept = sorted((r.doc_id, r.text) for r in simhash.one_of_each_group(make(spark, rows)).collect())
    assert [(i, t) for i, t in kept if i < 3] == sorted([(1, a), (2, b), (2, c)])
    assert [i for i, _ in kept if i > 2] == [3]


# ---- 9 licenses


def test_licenses(spark, empty):
    rows = [(1, "MIT license mit License"), (2, "the GNU General Public License, and Apache-License"), (3, "mit the license"), (4, None), (5, ""), (6, "license"), (1, "MIT license mit License")]
    rows += [(7, "x y Permission is hereby granted, free of charge, to any one person obtaining a copy of this software and its associated documentation files z"), (8, "Licensed under CC BY-NC 4"), (9, "general public general public license " * 500), (10, "mit " * 50 + "license")]
    found = licenses.scan(make(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        ws = words_of(dict(rows)[r.doc_id])
        at = {label: [i for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()] for p, label in licenses.PHRASES.items()}
        every = sorted(i for xs in at.values() for i in xs)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(ws), len(every), every[0] if every else None, every[-1] if every else None), r.doc_id
        assert r.base_labels == ",".join(sorted(label for label, xs in at.items() if xs))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in found}
    assert by[7].labels == "mit" and by[7].n_base == 0 and "cc-by-nc" in by[8].labels and by[4].score == 0
    assert licenses.scan(empty).count() == 0


def brute_licenses(text, passages, k, coverage=licenses.COVERAGE):
    """Labels of passages: diagonals merged, spans aligned and held against each other as the module says."""
    ws, spans = words_of(text), []
    split = [(label, words_of(p)) for label, p in passages]
    sized = [(label, t, min(k, len(t))) for label, t in split]
    grams_of = lambda t, g: [tuple(t[j : j + g]) for j in range(len(t) - g + 1)]
    for label, t, g in sized:
        others = {x for other, u, h in sized if other != label for x in grams_of(u, h)}
        rare = {j for j, x in enumerate(grams_of(t, g)) if x not in others}
        votes = collections.defaultdict(list)
        for i in range(len(ws) - g + 1):
            for j in range(len(t) - g + 1):
                if ws[i : i + g] == t[j : j + g]:
                    votes[i - j].append((i, j))
        bands = []
        for d in sorted(votes):
            if bands and d - bands[-1][0] <= licenses.DRIFT:
                bands[-1] = (d, bands[-1][1] + votes[d])
            else:
                bands.append((d, list(votes[d])))
        for _, at in bands:
            mine, theirs, last = set(), set(), (-1, -1)
            for i, j in sorted(at):
                if i > last[0] and j > last[1]:
                    last = i, j
                    mine |= set(range(i, i + g))
                    theirs |= set(range(j, j + g))
            lo, hi = min(at)[0], max(at)[0] + g - 1
            held = len({j for _, j in at} & rare)
            if len(theirs) / len(t) >= coverage and len(mine) / (hi - lo + 1) >= licenses.OWN and held >= licenses.RARE * len(rare):
                spans.append((lo, hi, len(theirs), len(theirs) / len(t), label))
    labels, island, reached = set(), [], -1
    for s in [*sorted(spans), (10**9, 10**9, 0, 0, None)]:
        if s[0] > reached and island:
            most = max(x[2:4] for x in island)
            labels |= {x[4] for x in island if x[2:4] == most}
            island = []
        island.append(s)
        reached = max(reached, s[1])
    return labels


def test_licenses_that_differ_in_a_word(spark):
    notice = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3 of the License."
    texts = {
        "apple pie. " + notice.format("") + " more words": "gpl",
        "apple pie. " + notice.format("Lesser ") + " more words": "gpl,lgpl",
        "apple pie. " + notice.format("Affero ") + " more words": "agpl,gpl",
        "this is licensed under CC BY NC and so on": "cc-by-nc",
        "Text under CC BY-NC-ND 4.0 it is": "cc-by-nc-nd",
        "Licensed under CC BY 4.0": "cc-by",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Released under the MIT License. " * 3: "mit",
        "the terms of the agreement and the rights to use it": "",
        "x " + " ".join(t for label, t in licenses.PASSAGES if label == "bsd") + " y CC BY-SA 4.0": "bsd,cc-by-sa",
        "CC BY-NC-ND 4.0 " * 5000: "cc-by-nc-nd",
    }
    found = licenses.scan(make(spark, list(enumerate(texts)))).collect()
    assert {r.doc_id: r.labels for r in found} == dict(enumerate(texts.values()))
    for i, (label, text) in enumerate(licenses.PASSAGES):
        assert label in brute_licenses(text, licenses.PASSAGES, licenses.GRAM), i
    whole = licenses.scan(make(spark, [(i, t) for i, (_, t) in enumerate(licenses.PASSAGES)])).collect()
    for r in whole:
        label = licenses.PASSAGES[r.doc_id][0]
        assert set(r.labels.split(",")) == {label, *filter(None, r.base_labels.split(","))}


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_license_labels_by_brute_force(spark, k):
    """Templates of whole licenses, with words changed, put in and left out, k-grams of any size."""
    rnd = random.Random(k)
    long = [rnd.choice([f"l{i}" for i in range(150)]) for _ in range(300)]
    passages = [("long", " ".join(long)), ("abc", "a b c"), ("cc-by", "licensed under cc by"), ("mid", " ".join(f"m{i}" for i in range(30))), ("middle", " ".join(f"m{i}" for i in range(30) if i != 15))]
    rows = []
    for i in range(40):
        body = [rnd.choice(["l1", "l2", "a", "b", "the", "of"]) for _ in range(rnd.randint(0, 60))]
        part = rnd.choice([long, [f"m{j}" for j in range(30)], ["a", "b", "c"]])
        changed = [w for w in part if rnd.random() > 0.02 * (i % 5)]
        for _ in range(i % 4):
            changed.insert(rnd.randint(0, len(changed)), "extra")
        rows.append((i, " ".join([*body, *changed, *body])))
    rows += [(100, None), (101, "the mit license"), (102, " ".join(long[:150])), (101, "the mit license")]
    found = licenses.scan(make(spark, rows), passages=passages, k=k).collect()
    assert len(found) == len(rows)
    for r in found:
        text = dict(rows)[r.doc_id]
        assert set(filter(None, r.labels.split(","))) == brute_licenses(text, passages, k) | set(filter(None, r.base_labels.split(","))), (r.doc_id, r.labels)
        assert all(0 <= s.first <= s.last < r.n_words for s in r.spans) and 0 <= r.score <= 1
    assert {"long", "abc", "mid", "mit"} <= {x for r in found for x in r.labels.split(",")}


# ---- 10 vector search


def test_vector_search(spark):
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(700, 8))
    base[100:350] = base[7]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(base)]
    rows += [(700, None, "x"), (701, [1.0, None] * 4, "x"), (702, [float("nan")] * 8, "x"), (703, [float("inf")] + [0.0] * 7, "x"), (750, [1.0, 2.0], "x"), (800, [2.0, 2.0], "x"), (801, [-1.0, 0.5], "x"), (850, [], "x"), (None, [0.5] * 8, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    got = sorted(tuple(r) for r in vector_search.top_k(df, F.col("id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect())
    ints = {i: np.floor(256 * np.array(v)).astype(int) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in ints:
        if q % 50 == 0:
            ranked = sorted((-int(ints[q] @ ints[i]), i) for i in ints if i != q and len(ints[i]) == len(ints[q]))
            want += [(q, k, i, -s) for k, (s, i) in enumerate(ranked[:5], 1)]
    assert got == sorted(want)
    assert vector_search.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def brute_top(ints, queries, k=5):
    out = []
    for q in queries:
        ranked = sorted((-int(v @ ints[q][0]), i) for i, vs in ints.items() if i != q for v in vs)
        out += [(q, n, i, -s) for n, (s, i) in enumerate(ranked[:k], 1)]
    return sorted(out)


def test_vector_search_in_slices_and_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(300, 4)))], "vec_id long, embedding array<double>")
    run = lambda: sorted(tuple(r) for r in vector_search.top_k(df, F.col("id") % 10 == 0).collect())
    whole = run()
    monkeypatch.setattr(vector_search, "SLICE", 7)
    monkeypatch.setattr(vector_search, "QUERIES", 3)
    assert run() == whole and len(whole) == 150


def test_vector_search_prunes_clusters_and_takes_repeated_ids(spark):
    """Clustered vectors: under a third of the pairs is scored, results are those of all pairs; ids that repeat, equal vectors."""
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(40, 16)) * 20
    base = np.concatenate([c + rnd.normal(size=(50, 16)) for c in centres])
    base[900:1300] = base[10]
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(5, base[77].tolist()), (5, base[5].tolist()), (100, base[1500].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = collections.defaultdict(list)
    for i, v in rows:
        ints[i].append(np.floor(256 * np.array(v)).astype(np.int64))
    for vs in ints.values():
        vs.sort(key=lambda v: v.tolist())
    queries = [i for i in ints if i % 100 == 0]
    found = vector_search.top_k(df, F.col("id") % 100 == 0)
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(ints, queries)
    assert vector_search.scored_share(df, F.col("id") % 100 == 0) < 0.33


def test_registry_names():
    from lexmill.llm import registry

    assert [int(re.match(r"op(\d+)_", n)[1]) for n in sorted(registry.QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1]))] == list(range(1, 14))
    assert json.dumps(sorted(registry.ORACLES))

def test_near_duplicates_come_through_links_of_fingerprints(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    words = [f"w{i}" for i in rnd.integers(10**6, size=4000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:2000], "other", *words[2001:]])), (3, " ".join(f"v{i}" for i in range(3000))), (4, ""), (5, None)]
    before = simhash.links
    seen = []
    monkeypatch.setattr(simhash, "links", lambda fps, radius: seen.append(radius) or before(fps, radius))
    found = {r.doc_id: r.component_id for r in simhash.near_duplicate_texts(make(spark, rows)).collect()}
    assert seen == [2]
    assert found[2] == found[1] == 1 and found[3] == 3
