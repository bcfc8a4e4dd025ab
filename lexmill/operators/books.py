"""Titles and authors from file names; names of report files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import expressions as X


def base_name(path) -> Column:
    """The last part of a path without .pdf."""
    return F.regexp_replace(F.regexp_extract(X.col(path), r"[^/\\]*$", 0), r"(?i)\.pdf$", "")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def title_and_author(path, title=None, author=None) -> Column:
    """(title, author): what the user states, else what the file name holds by the first form that fits."""
    name = base_name(path)
    parts = F.split(name, r"\s*--\s*")
    many = F.size(parts) >= 2
    plain = F.regexp_replace(name, r"^\[[^\]]*\]\s*", "")
    before_year = _found(plain, r"(?s)^(.*?)\(\d{4}[,)]")
    dated = F.trim(_found(before_year, r"[-_]\s*([A-Z][A-Za-z0-9'&, ]{2,80})$"))
    last = F.trim(_found(plain, r"-\s*([A-Z][A-Za-z0-9' ]{2,60})$"))
    pair = r"^([^_\-]+)[_\-]+([^_\-]+)$"
    forms = [
        (many & _found(F.get(parts, F.lit(0)), r"-\s*([A-Z][A-Za-z0-9'& ]{2,60})$").isNotNull(), F.trim(_found(F.get(parts, F.lit(0)), r"-\s*([A-Z][A-Za-z0-9'& ]{2,60})$")), F.lit("")),
        ((F.size(parts) >= 3) & ~F.get(parts, F.lit(1)).rlike(r"\d{4}"), F.trim(F.get(parts, F.lit(1))), F.lit("")),
        (dated.isNotNull() & (F.length(dated) < 60), dated, F.lit("")),
        (last.isNotNull() & ~F.lower(last).isin("archive", "anna s archive"), last, F.lit("")),
        (plain.rlike(pair), F.trim(F.regexp_extract(plain, pair, 2)), F.trim(F.regexp_extract(plain, pair, 1))),
    ]
    made = lambda t, a: F.struct(t.alias("title"), a.alias("author"))
    read = reduce(lambda c, f: F.when(f[0], made(f[1], f[2])).otherwise(c), reversed(forms), made(plain, F.lit("")))
    if title is None:
        return read
    stated = F.nullif(X.col(title), F.lit(""))
    return F.when(stated.isNotNull(), made(stated, F.coalesce(X.col(author), F.lit("")) if author is not None else F.lit(""))).otherwise(read)


def fallback_title(path) -> Column:
    """The file name without its ending and without the name of the collection it came from."""
    return X.stripped(F.regexp_replace(base_name(path), r"(?i)\s*[-_]\s*(Anna'?s Archive|libgen\.[a-z]+)$", ""))


def report_name(title, exam=None, score=None) -> Column:
    """File name of a report: title, level where one is set, ending."""
    stem = F.coalesce(F.nullif(F.nullif(X.col(title), F.lit("")), F.lit("词汇表")), F.lit("vocabulary"))
    level = F.lit("") if exam is None else F.coalesce(F.concat(F.lit("_"), F.nullif(X.col(exam), F.lit("")), F.nullif(X.col(score).cast("string"), F.lit(""))), F.lit(""))
    return F.concat(stem, level, F.lit("_词汇表.html"))


def book_of_report(html_path, file_path) -> Column:
    """The book of a result: the report's name without its ending, else the name of the file."""
    name = lambda p: F.regexp_extract(X.col(p), r"[^/\\]*$", 0)
    stem = F.regexp_replace(name(html_path), r"_词汇表\.(html|pdf)", "")
    return F.when(F.coalesce(X.col(html_path), F.lit("")) != "", stem).otherwise(name(file_path))
