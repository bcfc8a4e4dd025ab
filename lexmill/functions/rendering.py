"""HTML of entries, field by field. Every field is a column; new ones can be registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import expressions as X
from lexmill.functions import lexicon as L
from lexmill.operators.ranking import durable

#: Name of a field to the function that gives its HTML as a column, empty where there is nothing to show.
FIELDS: dict[str, Callable[[], Column]] = {}
#: Order of the fields in an entry.
ORDER = ["headword", "ipa", "gloss", "senses", "etymology", "morpheme", "phenomena", "examples", "collocations"]


def register_field(name: str):
    def add(f: Callable[[], Column]) -> Callable[[], Column]:
        FIELDS[name] = f
        return f

    return add


def field(name: str) -> Column:
    if name not in FIELDS:
        raise KeyError(f"no renderer for field {name}")
    return FIELDS[name]().alias(name)


def _text(c) -> Column:
    return F.coalesce(X.col(c), F.lit(""))


def _tag(kind: str, name: str, body: Column) -> Column:
    return F.concat(F.lit(f'<{kind} class="{name}">'), body, F.lit(f"</{kind}>"))


def _if(body: Column, html: Column) -> Column:
    """The HTML, or nothing where the body is empty."""
    return F.when(body != "", html).otherwise("")


@register_field("headword")
def headword() -> Column:
    level = F.upper(F.trim(_text("level")))
    badge = F.concat(F.lit('<span class="badge-cefr" style="background:'), X.mapping(L.LEVEL_COLOURS, level), F.lit('">'), level, F.lit("</span>"))
    times = F.col("n").cast("string")
    often = F.concat(F.lit('<span class="badge-freq" title="本书出现 '), times, F.lit(' 次">×'), times, F.lit("</span>"))
    pos = _if(_text("pos"), _tag("span", "pos", X.html_escape("pos")))
    return _tag("div", "headword", F.concat(_tag("span", "word", X.html_escape("word")), pos, F.coalesce(badge, F.lit("")), F.when(F.col("n") > 0, often).otherwise("")))


@register_field("ipa")
def ipa() -> Column:
    label = lambda k: F.coalesce(X.mapping(L.ACCENT_LABELS, k), k)
    one = lambda e: F.concat(_tag("span", "ipa-accent", label(e["key"])), F.lit(" "), _tag("span", "ipa-val", X.html_escape(e["value"])))
    return F.when(F.size("ipa") > 0, _tag("div", "ipa-row", F.array_join(F.transform(F.map_entries("ipa"), one), "　"))).otherwise("")


def _lines(c) -> Column:
    return X.html_lines(X.html_escape(c))


@register_field("gloss")
def gloss() -> Column:
    parts = F.concat(*(_if(_text(f"gloss_{lang}"), _tag("span", f"gloss-{lang}", _lines(f"gloss_{lang}"))) for lang in ("zh", "en")))
    return _if(parts, _tag("div", "gloss", parts))


@register_field("senses")
def senses() -> Column:
    one = lambda s: _tag("div", "sense", F.concat(_tag("span", "sense-zh", _lines(s["gloss_zh"])), _tag("span", "sense-en", _lines(s["gloss_en"])), _if(_text(s["book_context"]), _tag("span", "book-context", X.html_escape(s["book_context"])))))
    return F.when(F.size("senses") > 0, _tag("div", "senses", F.array_join(F.transform("senses", one), ""))).otherwise("")


@register_field("etymology")
def etymology() -> Column:
    return _if(_text("etymology"), _tag("div", "etymology", X.html_escape("etymology")))


def morpheme_chain(morpheme) -> Column:
    """p「meaning」 + root(language「meaning」) + s「meaning」 of (prefix, roots, suffix); parts without content are left out."""
    m = X.col(morpheme)
    quoted = lambda x: _if(x, F.concat(F.lit("「"), x, F.lit("」")))
    strip = lambda x: X.stripped(_text(x))
    affix = lambda a: F.concat(strip(a["part"]), quoted(strip(a["meaning"])))
    origin = lambda r: F.concat(strip(r["lang"]), quoted(strip(r["meaning"])))
    root = lambda r: F.concat(strip(r["root"]), _if(origin(r), F.concat(F.lit("("), origin(r), F.lit(")"))))
    of = lambda xs, f: F.coalesce(F.transform(xs, f), F.array().cast("array<string>"))
    return F.array_join(F.filter(F.concat(of(m["prefix"], affix), of(m["roots"], root), of(m["suffix"], affix)), lambda x: x != ""), " + ")


@register_field("morpheme")
def morpheme() -> Column:
    chain = F.coalesce(morpheme_chain("morpheme"), F.lit(""))
    return _if(chain, _tag("div", "morpheme", F.concat(F.lit("构词："), chain)))


@register_field("phenomena")
def phenomena() -> Column:
    held = {"polysemy": F.size("phenomena.polysemy") > 0, "slang": F.size("phenomena.slang") > 0, "collocations": F.size("phenomena.collocations") > 0, "domain_term": _text("phenomena.domain_term") != ""}
    tags = F.concat(*(F.when(held[k], F.lit(f'<span class="phen-tag">{label}</span>')).otherwise("") for k, label in L.PHENOMENON_LABELS.items()))
    return _if(tags, _tag("div", "phenomena", tags))


@register_field("examples")
def examples() -> Column:
    one = lambda e: _tag("div", "example", F.concat(_tag("span", "example-en", X.html_escape(e["en"])), _tag("span", "example-zh", X.html_escape(e["zh"]))))
    return F.coalesce(F.array_join(F.transform(F.slice("examples", 1, 2), one), ""), F.lit(""))


@register_field("collocations")
def collocations() -> Column:
    return F.when(F.size("collocations") > 0, _tag("div", "collocations", F.array_join(F.transform(F.slice("collocations", 1, 4), X.html_escape), " · "))).otherwise("")


def is_complete() -> Column:
    """Whether an entry has what it can't do without: headword, pronunciation, a gloss."""
    return (_text("word") != "") & (F.coalesce(F.size("ipa"), F.lit(0)) > 0) & ((_text("gloss_zh") != "") | (_text("gloss_en") != ""))


def entry_html(entries: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(word, html) of complete entries, the fields in order."""
    fields = F.filter(F.array(*(field(f) for f in order or ORDER if f in FIELDS)), lambda x: x != "")
    html = F.concat(F.lit('<div class="entry">\n  '), F.array_join(fields, "\n  "), F.lit("\n</div>"))
    return entries.where(is_complete()).select("word", html.alias("html"))


def alphabetical_html(entries: DataFrame) -> DataFrame:
    """(word, letter_head, html) of a plain list: article elements, a head where the first letter of the order changes.

    The head stands at each letter's least word, which every task adds up before the
    exchange: nothing is sorted or gathered by letter.
    """
    letter = F.upper(F.substring("word", 1, 1))
    entries = durable(entries.where(_text("word") != "")).withColumns({"__id": F.monotonically_increasing_id(), "__letter": letter})
    least = entries.groupBy("__letter").agg(F.min(F.struct(F.lower("word").alias("l"), "word", "__id")).alias("x"))
    entries = entries.join(least.select(F.col("x.__id").alias("__id"), F.lit(True).alias("__first")), "__id", "left")
    first, letter = F.col("__first"), F.col("__letter")
    line = lambda name, c: _if(_text(c), F.concat(F.lit(f'\n  <div class="{name}">'), X.html_escape(c), F.lit("</div>")))
    html = F.concat(
        F.lit('<article class="entry">\n  <header class="headword">'), _tag("span", "word", X.html_escape("word")), _tag("span", "pos", X.html_escape("pos")), F.lit("</header>"),
        line("zh-def", "gloss_zh"), line("en-def", "gloss_en"), line("etymology", "etymology"), F.lit("\n</article>"),
    )
    head = F.concat(F.lit('<h2 class="alpha-header">'), letter, F.lit("</h2>"))
    return entries.select("word", F.when(first, head).alias("letter_head"), html.alias("html"))


# ---- names and lines of other formats


def report_pos(pos) -> Column:
    """Part of speech as the reports show it."""
    p = F.regexp_replace(F.lower(F.trim(_text(pos))), r"\.+$", "")
    return F.coalesce(X.mapping(L.REPORT_POS, p), F.nullif(_text(pos), F.lit("")), F.lit("其他"))


def document_line(text) -> Column:
    """One paragraph of a word-processor file: line breaks become separators."""
    return F.replace(F.replace(_text(text), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" / "))


def safe_name(text) -> Column:
    kept = X.stripped(F.regexp_replace(_text(text), r"[^\p{L}\p{N} _\-()（）]", ""))
    return F.substring(F.coalesce(F.nullif(kept, F.lit("")), F.lit("vocabulary")), 1, 60)
