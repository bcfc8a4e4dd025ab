"""The pipeline's stages one after the other against brute force, and on odd rows."""

import random

import corpus_pipeline
from lexmill.llm import packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, labels, benchmark):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def cases():
    rnd = random.Random(9)
    line = lambda k: " ".join(f"w{rnd.randrange(3000)}" for _ in range(k))
    docs = [(i, "\n".join(line(30) for _ in range(3))) for i in range(200)]
    labels = []
    for i in range(0, 200, 4):
        docs[i] = (i, docs[i][1] + " vile scum vile")
    labels = [(i, 1, int(i % 4 == 0)) for i, _ in docs]
    shared, leak = line(60), line(40)
    docs += [(300, docs[1][1] + "\n" + shared), (301, line(50) + "\n" + shared), (302, docs[2][1]), (304, line(20) + " " + leak + " " + line(20))]
    words = docs[3][1].replace("\n", " ").split()
    docs += [(305, " ".join(words)), (306, " ".join([*words[:40], "other", *words[41:]])), (307, None), (308, ""), (309, "vile scum " * 20)]
    return docs, labels, [(1, leak), (2, "never found in any of these texts at all anywhere here")]


def test_stages(spark, tmp_path):
    docs, labels, benchmark = cases()
    folder = write(spark, tmp_path / "in", docs, labels, benchmark)
    frame, ids = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, folder).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = {r.doc_id for r in frame.select("doc_id").collect()}
        assert name == "packing" or frame.columns == columns
    every = {i for i, _ in docs}
    assert ids["toxicity"] == every - {i for i, _, y in labels if y} - {309}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/line_dedup").collect()}
    assert set(texts) == ids["toxicity"] - {302}
    shared = docs[201][1].split("\n")[1]
    assert shared in texts[300] and shared not in texts[301] and texts[300] == shared and texts[307] is None
    assert ids["simhash_near_dedup"] == ids["line_dedup"] - {305, 306}
    assert ids["benchmark_decontamination"] == ids["simhash_near_dedup"] - {304}
    packed = frame.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    encode = packing._encoder()
    for r in packed:
        assert r["sum(length)"] == r["max(doc_tokens)"] == len(encode(texts[r.doc_id] or "")) + 1
    assert ids["packing"] == ids["benchmark_decontamination"]


def test_run_equals_stages_and_takes_empty_tables(spark, tmp_path):
    docs, labels, benchmark = cases()
    full = write(spark, tmp_path / "full", docs[:60], labels[:60], benchmark)
    first, second = (sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, full).collect()) for _ in range(2))
    assert first == second and first
    none = write(spark, tmp_path / "none", [], [], [])
    assert corpus_pipeline.run(spark, none).count() == 0
    odd = write(spark, tmp_path / "odd", [(None, None), (None, "x"), (1, "x"), (1, "x"), (2, "")], [], [(None, None)])
    assert {r.doc_id for r in corpus_pipeline.run(spark, odd).collect()} == {None, 1, 2}


def test_stages_keep_extra_columns_and_long_texts(spark, tmp_path):
    """Columns whose names the operators use, a very long text, repeated rows and nulls in any column pass every stage."""
    docs, labels, benchmark = cases()
    folder = write(spark, tmp_path / "in", docs, labels, benchmark)
    long = " ".join(f"x{i}" for i in range(150_000))
    rows = [(i, t, None, None, None, "keep", 1, "r", ["h"], 5) for i, t in docs[1:60] if i % 4] + [(900, long, "en", "s", 1, None, None, None, None, None)] * 2
    frame = spark.createDataFrame(rows, DOCS + ", __spans string, id int, copy string, hit_words array<string>, n_hit int")
    kept = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == frame.columns, name
    found = kept.collect()
    assert {r.doc_id for r in found} == {i for i, *_ in rows} and sum(r.doc_id == 900 for r in found) == 1
    assert all(r["__spans"] == "keep" and r.copy == "r" for r in found if r.doc_id != 900) and next(r.text for r in found if r.doc_id == 900) == long
