"""Spark data sources for paged documents and dictionary files.

    register(spark)
    spark.read.format("lexmill_pages").option("extractors", "pypdf,plain").load(path)
    spark.read.format("lexmill_dictionary").option("kind", "pronunciations").load(path)

lexmill_pages gives (path, page_no, body, extractor, error), a page at a time.
Files are dealt to partitions of about `blockBytes`. Extractors are tried in
order: one that is not installed, fails or finds no text leaves the file to the
next; a page that fails within a file is kept as an empty one with its error; a
file that nothing can read is one row with its error. More extractors are named
as module:function, a function from a binary file to an iterator of page texts.

lexmill_dictionary gives the rows of a format (KINDS) with path, offset and broken. Files are split
into blocks of bytes; a line belongs to the block in which it begins, and is
read by itself. A line that is no entry is kept as a row with nothing but broken (the line);
a file that can't be read is one such row; neither stops the scan.

Paths are those that pyarrow's file systems open (a folder, a file or a URI).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from importlib import import_module
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 32 << 20
#: A page or a line longer than this is cut from the stream in parts of this size.
CHUNK = 1 << 20


def listed(path: str) -> list[tuple[str, int]]:
    """(path as the file system names it, bytes) of a file or of the files below a folder; hidden and marker files are left out."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def opened(path: str) -> BinaryIO:
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def text_of(raw: bytes) -> str:
    """UTF-8, or Latin-1 where it isn't."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


# ---- pages


def plain_pages(stream: BinaryIO) -> Iterator[str]:
    """Pages of a text file, parted by form feeds; the file is read in pieces."""
    held = b""
    while piece := stream.read(CHUNK):
        *pages, held = (held + piece).split(b"\f")
        yield from map(text_of, pages)
    if held.strip():
        yield text_of(held)


def pypdf_pages(stream: BinaryIO) -> Iterator[str | Exception]:
    """Pages of a PDF by pypdf, if it is installed; a page that fails is its error."""
    reader = import_module("pypdf").PdfReader(stream)
    for page in reader.pages:
        try:
            yield page.extract_text() or ""
        except Exception as e:  # noqa: BLE001 - whatever a damaged page raises
            yield e


EXTRACTORS: dict[str, Callable[[BinaryIO], Iterator[str | Exception]]] = {"plain": plain_pages, "pypdf": pypdf_pages}


def extractor(name: str) -> Callable[[BinaryIO], Iterator[str | Exception]]:
    if name in EXTRACTORS:
        return EXTRACTORS[name]
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"no extractor {name}: one of {', '.join(EXTRACTORS)} or module:function")
    return getattr(import_module(module), function)


@dataclass
class Files(InputPartition):
    paths: list[str]


class PageReader(DataSourceReader):
    def __init__(self, path: str, chain: list[str], block: int):
        self.path, self.chain, self.block = path, chain, block

    def partitions(self) -> list[Files]:
        held, size, out = [], 0, []
        for path, n in listed(self.path):
            held.append(path)
            size += n
            if size >= self.block:
                out.append(Files(held))
                held, size = [], 0
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from self.pages(path)

    def pages(self, path: str) -> Iterator[tuple]:
        """The pages of the first extractor that gives a text. What comes before its first text waits, empty pages only."""
        errors = []
        for name in self.chain:
            empty: list[tuple] = []
            given, n = False, 0
            try:
                with opened(path) as stream:
                    for n, page in enumerate(extractor(name)(stream), 1):
                        row = (path, n, "", name, f"{type(page).__name__}: {page}") if isinstance(page, Exception) else (path, n, page, name, None)
                        if not given and not row[2].strip():
                            empty.append(row)
                            continue
                        if not given:
                            yield from empty
                        given = True
                        yield row
            except Exception as e:  # noqa: BLE001 - a broken file must not stop the scan
                errors.append(f"{name}: {type(e).__name__}: {e}")
                if given:  # pages are out already: the rest of the file is one empty page
                    yield path, n + 1, "", name, errors[-1]
            if given:
                return
            if not errors or not errors[-1].startswith(name):
                errors.append(f"{name}: no text")
        yield path, None, None, None, "; ".join(errors)


class Pages(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "lexmill_pages"

    def schema(self) -> str:
        return "path string, page_no int, body string, extractor string, error string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options["path"], [x.strip() for x in self.options.get("extractors", "pypdf,plain").split(",")], int(self.options.get("blockBytes", BLOCK)))


# ---- dictionaries


def _pronunciation(line: str) -> tuple | None:
    word, *phones = line.split()
    if word.endswith(")") and "(" in word:
        word = word[: word.rindex("(")] if word[word.rindex("(") + 1 : -1].isdigit() else word
    return (word.lower(), phones) if phones else None


def _level(line: str) -> tuple | None:
    p = [x.strip() for x in line.split(",")]
    return (p[0].lower(), p[1], p[2].upper(), p[3], p[4] if len(p) > 4 else None) if len(p) >= 4 and p[0] else None


def _entry(line: str) -> tuple | None:
    entry = json.loads(line)
    senses = [s for s in entry.get("senses") or [] if isinstance(s, dict)]
    glosses = [g for s in senses[:5] for g in s.get("glosses") or []]
    topics = sorted({t for s in senses for t in s.get("topics") or []})[:8]
    ipa = next((s["ipa"] for s in entry.get("sounds") or [] if s.get("ipa")), None)
    etymology = entry.get("etymology_text")
    return (entry["word"].lower(), glosses[0][:300], glosses[:3], entry.get("pos"), topics, ipa, etymology and etymology[:300]) if glosses else None


#: Kind to (columns, what makes a row of a line or None, lines that are passed over).
KINDS: dict[str, tuple[str, Callable[[str], tuple | None], Callable[[str], bool]]] = {
    "pronunciations": ("word string, phones array<string>", _pronunciation, lambda x: x.startswith(";;;")),
    "levels": ("word string, pos string, cefr string, gloss_en string, example string", _level, lambda x: x.split(",")[0].strip().lower() in ("headword", "word")),
    "entries": ("word string, gloss_en string, glosses array<string>, pos string, topics array<string>, ipa string, etymology string", _entry, lambda x: False),
}


@dataclass
class Block(InputPartition):
    path: str
    start: int
    end: int


class DictionaryReader(DataSourceReader):
    def __init__(self, path: str, kind: str, block: int):
        self.path, self.kind, self.block = path, kind, block

    def partitions(self) -> list[Block]:
        return [Block(path, at, min(at + self.block, size)) for path, size in listed(self.path) for at in range(0, size, self.block)] or [Block("", 0, 0)]

    def read(self, partition: Block) -> Iterator[tuple]:
        columns, made, passed = KINDS[self.kind]
        nothing = (None,) * (columns.count(" string") + columns.count(" array"))
        if not partition.path:
            return
        try:
            for at, raw in self.lines(partition):
                line = text_of(raw).strip()
                if not line or passed(line):
                    continue
                try:
                    row = made(line)
                except (ValueError, KeyError, TypeError, AttributeError, IndexError):
                    row = None
                yield (*(row or nothing), partition.path, at, None if row else line)
        except OSError as e:
            yield (*nothing, partition.path, partition.start, f"{type(e).__name__}: {e}")

    def lines(self, block: Block) -> Iterator[tuple[int, bytes]]:
        """(offset, line) of the lines that begin in the block; read in pieces."""
        with opened(block.path) as stream:
            # The line over the block's beginning is the block's before, unless it begins just there.
            at = max(0, block.start - 1)
            stream.seek(at)
            held, skip = b"", block.start > 0
            while at < block.end or held:
                piece = stream.read(CHUNK)
                *whole, held = (held + piece).split(b"\n")
                if not piece and held:
                    whole, held = [*whole, held], b""
                for line in whole:
                    if not skip and at < block.end:
                        yield at, line
                    skip = False
                    at += len(line) + 1
                if not piece:
                    return


class Dictionary(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "lexmill_dictionary"

    def schema(self) -> str:
        kind = self.options.get("kind", "")
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        return f"{KINDS[kind][0]}, path string, offset long, broken string"

    def reader(self, schema) -> DataSourceReader:
        return DictionaryReader(self.options["path"], self.options["kind"], int(self.options.get("blockBytes", BLOCK)))


def register(spark: SparkSession) -> None:
    for source in (Pages, Dictionary):
        spark.dataSource.register(source)


def last_entries(rows: DataFrame) -> DataFrame:
    """The last entry of each word, by path and offset; broken lines are left out."""
    order = Window.partitionBy("word").orderBy(F.desc("path"), F.desc("offset"))
    return rows.where("word is not null").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "path", "offset", "broken")
