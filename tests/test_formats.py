"""Data sources: pages and dictionary entries, broken files and lines among them."""

import json
import random
import sys

import pytest
from pyspark.errors import AnalysisException

from lexmill.sources import formats, readers


@pytest.fixture(scope="module")
def installed(spark):
    formats.register(spark)
    return spark


def pages(spark, path, **options):
    return sorted(map(tuple, spark.read.format("lexmill_pages").options(**options).load(str(path)).collect()), key=str)


def test_pages_one_by_one(installed, tmp_path):
    (tmp_path / "a.txt").write_bytes("first é\f\fthird\f".encode())
    (tmp_path / "b.txt").write_bytes("caf\xe9\fx".encode("latin-1"))
    (tmp_path / "empty.txt").write_bytes(b" \f \f")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    base = f"{tmp_path}/"
    for block in (1, 10, 1 << 20):
        found = pages(installed, tmp_path, extractors="plain", blockBytes=block)
        assert found == sorted([(base + "a.txt", 1, "first é", "plain", None), (base + "a.txt", 2, "", "plain", None), (base + "a.txt", 3, "third", "plain", None), (base + "b.txt", 1, "café", "plain", None), (base + "b.txt", 2, "x", "plain", None), (base + "empty.txt", None, None, None, "plain: no text")], key=str)
    assert installed.read.format("lexmill_pages").option("blockBytes", 1).load(f"file://{tmp_path}").rdd.getNumPartitions() == 3


def test_broken_files_and_pages_do_not_stop_the_scan(installed, tmp_path, monkeypatch):
    module = tmp_path / "own_extractors.py"
    module.write_text("def damaged(f):\n    if b'bad' in f.read():\n        yield 'one'\n        yield ValueError('torn page')\n        yield 'three'\n        raise OSError('torn file')\n    else:\n        raise KeyError('not mine')\n")
    installed.sparkContext.addPyFile(str(module))
    monkeypatch.syspath_prepend(str(tmp_path))
    data = tmp_path / "data"
    data.mkdir()
    (data / "a").write_bytes(b"bad file")
    (data / "b").write_bytes(b"good\ffile")
    found = {(r[0][-1], r[1]): r[2:] for r in pages(installed, data, extractors="pypdf, own_extractors:damaged, plain")}
    assert found == {
        ("a", 1): ("one", "own_extractors:damaged", None),
        ("a", 2): ("", "own_extractors:damaged", "ValueError: torn page"),
        ("a", 3): ("three", "own_extractors:damaged", None),
        ("a", 4): ("", "own_extractors:damaged", "own_extractors:damaged: OSError: torn file"),
        ("b", 1): ("good", "plain", None),
        ("b", 2): ("file", "plain", None),
    }
    (nothing,) = pages(installed, data / "b", extractors="pypdf")
    assert nothing[1:4] == (None, None, None) and "pypdf" in nothing[4]
    sys.modules.pop("own_extractors", None)


def test_blocks_of_any_size_give_every_line_once(installed, tmp_path):
    rnd = random.Random(4)
    lines = [";;; comment", "", "HOUSE  HH AW1 S", "HOUSE(2)  HH AW0 S", "broken", *(f"W{i}{'X' * rnd.randint(0, 30)}  AH{i % 3} L" for i in range(300)), "LAST  L AE1"]
    (tmp_path / "cmu").write_text("\n".join(lines))
    want = None
    for block in (1, 7, 64, 1000, 1 << 20):
        rows = installed.read.format("lexmill_dictionary").option("kind", "pronunciations").option("blockBytes", block).load(str(tmp_path / "cmu")) if block > 1 else None
        if block == 1:
            reader = formats.DictionaryReader(str(tmp_path / "cmu"), "pronunciations", 1)
            found = sorted((r for p in reader.partitions() for r in reader.read(p)), key=lambda r: r[3])
        else:
            found = sorted(map(tuple, rows.collect()), key=lambda r: r[3])
        want = want or found
        assert found == want
    assert len(want) == len(lines) - 2
    assert [r[4] for r in want if r[4]] == ["broken"]
    assert [r[0] for r in want][:3] == ["house", "house", None]
    same = {r.word: r.phones for r in readers.pronunciations(installed, str(tmp_path / "cmu")).collect()}
    assert {r.word: r.phones for r in formats.last_entries(rows).collect()} == same


def test_levels_and_entries_as_the_other_readers_read_them(installed, tmp_path):
    (tmp_path / "levels.csv").write_text("headword,pos,CEFR,gloss,example\ndog,noun,a1,an animal,\nshort,line\nDog,noun,a2,again,ex\n")
    entry = {"word": "Dog", "pos": "noun", "etymology_text": "e" * 400, "sounds": [{}, {"ipa": "/d/"}], "senses": [{"glosses": ["g" * 400, "h"], "topics": ["z", "a"]}, {}]}
    (tmp_path / "entries.jsonl").write_text("\n".join([json.dumps(entry), "{broken", "[1]", json.dumps({"word": "x", "senses": []}), json.dumps({**entry, "word": "Cat", "sounds": None})]))
    read = lambda kind, name: installed.read.format("lexmill_dictionary").option("kind", kind).load(str(tmp_path / name))
    levels = formats.last_entries(read("levels", "levels.csv"))
    assert list(map(tuple, levels.collect())) == list(map(tuple, readers.level_list(installed, str(tmp_path / "levels.csv")).select(*levels.columns).collect()))
    entries = read("entries", "entries.jsonl")
    assert entries.where("broken is not null").count() == 3
    kept = formats.last_entries(entries)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, readers.wiktionary(installed, str(tmp_path / "entries.jsonl")).select(*kept.columns).collect()), key=str)


def test_wrong_options(installed, tmp_path):
    (tmp_path / "x").write_text("a")
    with pytest.raises(AnalysisException):
        installed.read.format("lexmill_dictionary").option("kind", "other").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="nothing"):
        installed.read.format("lexmill_pages").load(str(tmp_path / "nothing")).collect()
