"""Column expressions: text cleaning, word tests, difficulty, formats. All stay inside Catalyst."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexmill.functions import lexicon as L


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def mapping(table: dict, key: Column) -> Column:
    """Value of a literal table; null for other keys."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def stripped(c) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


# ---- lines and pages


def is_page_number(line) -> Column:
    return F.coalesce(stripped(line).rlike(L.PAGE_NUMBER), F.lit(False))


def repeat_key(line) -> Column:
    """Lines that differ only in numbers and case share this key."""
    return stripped(F.regexp_replace(F.lower(col(line)), r"\d+", "#"))


@F.pandas_udf(StringType())
def in_composed_form(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@cache
def uncomposed_pattern() -> str:
    """A class of the characters that the composed form changes, joins to the one before or puts in order; texts without them are in that form."""
    joined = {c for i in range(0xC0, 0x110000) for c in unicodedata.normalize("NFD", chr(i))[1:]}
    found = [i for i in range(0xC0, 0x110000) if chr(i) in joined or unicodedata.combining(chr(i)) or unicodedata.normalize("NFC", chr(i)) != chr(i)]
    starts = [i for k, i in enumerate(found) if not k or found[k - 1] != i - 1]
    ends = [i for k, i in enumerate(found) if k + 1 == len(found) or found[k + 1] != i + 1]
    ranges = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True))
    return f"[\\x{{{found[0]:x}}}-\\x{{10ffff}}&&[{ranges}]]"  # one comparison for characters below all of them


def composed(text) -> Column:
    """Unicode's composed form (NFC), which no built-in function gives; only texts that may not be in it are sent to Python."""
    return F.coalesce(in_composed_form(F.when(col(text).rlike(uncomposed_pattern()), col(text))), col(text))


def joined_hyphens(text) -> Column:
    return F.replace(col(text), F.lit("-\n"), F.lit(""))


def clean_example(example) -> Column:
    """An example sentence without references, notes and superscripts; empty for numbers, headings, contents lines."""
    e = stripped(F.coalesce(col(example), F.lit("")))
    junk = e.rlike(r"^\s*\d{1,4}\s*$") | (e.rlike(L.HEADING) & ~e.contains("\n") & (F.length(e) < 40)) | F.regexp_replace(e, r"(?s)\n.*", "").rlike(L.CONTENTS_LINE)
    c = F.regexp_replace(e, L.REFERENCE, " ")
    c = F.regexp_replace(c, L.SUPERSCRIPT, "")
    c = F.regexp_replace(c, L.NOTE, " ")
    c = F.regexp_replace(F.replace(c, F.lit("-\n"), F.lit("")), r"\s{2,}", " ")
    return F.when(junk, "").otherwise(stripped(c))


def clean_examples(examples) -> Column:
    """Cleaned, without empty ones, each once in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(col(examples), clean_example), lambda x: x != ""))


# ---- words


def corpus_tokens(text) -> Column:
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(L.TOKEN_PATTERN), F.lit(0))


def phrase_tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(L.PHRASE_TOKEN_PATTERN), F.lit(0))


def is_noise(word) -> Column:
    """One letter, a letter three times or a pair of letters three times over and over, or two equal characters in three."""
    return F.lower(col(word)).rlike(r"^(?:.?|([a-z])\1{2,}|([a-z]{2})\2{2,}|(.)\3.?|.(.)\4|(.).\5)$")


def more_common(a_rank, b_rank) -> Column:
    """Whether the word of the first rank is more common. Ranks: null or under 1 for none, else 1 for the most common."""
    a, b = F.coalesce(col(a_rank), F.lit(-1)), F.coalesce(col(b_rank), F.lit(-1))
    return (a > 0) & ((b <= 0) | (a < b))


def without_last(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def plural_lemma(w: Column) -> Column:
    """The lemma by the rules that need no ranks; null where -ing and -ed have to be restored."""
    return (
        F.when(w.isin(*L.IRREGULAR_LEMMAS), mapping(L.IRREGULAR_LEMMAS, w))
        .when(w.isin(*L.S_WORDS), w)
        .when(w.endswith("ies") & (F.length(w) > 5), F.concat(without_last(w, 3), F.lit("y")))
        .when(w.isin(*L.ING_WORDS), w)
        .when(w.endswith("ing") & (F.length(w) > 5), F.lit(None))
        .when(w.endswith("ed") & (F.length(w) > 4), F.lit(None))
        .when((F.length(w) > 4) & w.rlike("(ches|shes|xes|zes|sses)$"), without_last(w, 2))
        .when(w.endswith("s") & ~w.endswith("ss") & (F.length(w) > 3), without_last(w, 1))
        .otherwise(w)
    )


def has_derivational_suffix(word) -> Column:
    return F.lower(col(word)).rlike(".{4,}(" + "|".join(L.DERIVATIONAL_SUFFIXES) + ")$")


def is_inflection(word, lemma) -> Column:
    w, m = F.lower(col(word)), F.lower(col(lemma))
    return (w == m) | (w.rlike("(ed|ing|s|es)$") & w.startswith(m))


def term_context(**signals) -> Column:
    """Map of the signals that form_decision() reads; absent and null ones are false or 0."""
    defaults = {"in_definition": "false", "in_heading": "false", "freq": "0", "tfidf": "0", "italic": "false", "capitalized": "false"}
    value = lambda k: F.coalesce(col(signals[k]).cast("string"), F.lit(defaults[k])) if k in signals else F.lit(defaults[k])
    return F.create_map(*(x for k in defaults for x in (F.lit(k), value(k))))


def form_decision(surface, lemma, pos, lemma_pos, context) -> Column:
    """(surface, lemma, independent, term, evidence, reason): whether a form stands on its own, is a term of the book, and why.

    context: map of signals, as term_context() gives.
    """
    s, m, p, of, ctx = stripped(surface), stripped(lemma), col(pos), col(lemma_pos), col(context)
    flag = lambda k: F.coalesce(ctx[k].cast("boolean"), F.lit(False))
    number = lambda k, t: F.coalesce(ctx[k].cast(t), F.lit(0).cast(t))
    inflected, changed = is_inflection(s, m), F.coalesce(p != of, F.lit(False))
    derived = has_derivational_suffix(s) & ~inflected
    often = F.concat(*(F.lit(x) if x else number("freq", "int").cast("string") for x in ("高频(", "", "次)")))
    evidence = F.array_compact(
        F.array(
            F.when(flag("in_definition"), L.TERM_SIGNS["in_definition"]),
            F.when(flag("in_heading"), L.TERM_SIGNS["in_heading"]),
            F.when(number("tfidf", "double") >= L.TERM_TFIDF, L.TERM_SIGNS["tfidf"]),
            F.when(number("freq", "int") >= L.TERM_FREQ, often),
            F.when(flag("italic"), L.TERM_SIGNS["italic"]),
            F.when(flag("capitalized") & (p == "NOUN"), L.TERM_SIGNS["capitalized"]),
        )
    )
    term = F.size(evidence) > 0
    parts = F.concat(F.lit("派生：POS "), F.coalesce(F.nullif(of, F.lit("")), F.lit("?")), F.lit("→"), p)
    first = F.when(changed, parts).when(derived, L.FORM_REASONS["derived"]).when(inflected, L.FORM_REASONS["inflected"])
    reason = F.concat_ws("；", first, F.when(term & ~changed & ~derived, L.FORM_REASONS["term"]))
    return F.struct(s.alias("surface"), m.alias("lemma"), (changed | derived | term).alias("independent"), term.alias("term"), evidence.alias("evidence"), F.coalesce(F.nullif(reason, F.lit("")), F.lit(L.FORM_REASONS["plain"])).alias("reason"))


def entry_key(decision) -> Column:
    """The form that stands for a decision: the surface of an independent form, else the lemma."""
    d = col(decision)
    surface = F.lower(stripped(d["surface"]))
    return F.when(d["independent"], surface).otherwise(F.coalesce(F.nullif(F.lower(stripped(d["lemma"])), F.lit("")), surface))


def _either(words: list[str], least: int) -> str:
    return "(?:" + "|".join(dict.fromkeys(w for w in words if len(w) >= least)) + ")"


#: A function word beside a common word; the first part has two letters at least, the second three.
_COMMON = [*L.JOIN_FUNCTION, *L.JOIN_CONTENT]
_TWO_WORDS = f"^(?:{_either(L.JOIN_FUNCTION, 2)}{_either(_COMMON, 3)}|{_either(_COMMON, 2)}{_either(L.JOIN_FUNCTION, 3)})$"


def is_joined_word(word) -> Column:
    """Two words run together: known ones, or a function word beside a common word, unless the whole is a common word."""
    w = F.lower(stripped(word))
    return (w == "") | w.isin(*L.JOINED) | (~w.isin(*dict.fromkeys(_COMMON)) & w.rlike(_TWO_WORDS))


def is_notable(word, zipf) -> Column:
    w = F.lower(stripped(word))
    compound = (F.length(w) >= 8) & ~w.rlike("^(" + "|".join(L.PLAIN_PREFIXES) + ")") & w.rlike("|".join(L.METAPHOR_ROOTS)) & (F.coalesce(col(zipf), F.lit(0.0)) < 4.5)
    return w.isin(*L.NOTABLE_WORDS) | compound


def phenomena(word, context) -> Column:
    """Special senses by the word; set phrases and idioms by the text of the context."""
    text = F.lower(F.coalesce(col(context), F.lit("")))
    having = lambda xs: F.filter(F.array(*map(F.lit, xs)), lambda p: text.contains(p))
    return F.struct(F.filter(F.array(F.lower(col(word))), lambda x: x.isin(*L.POLYSEMOUS)).alias("polysemy"), having(L.SET_PHRASES).alias("phrases"), having(L.IDIOMS).alias("idioms"))


def morphemes(word) -> Column:
    """(prefix, suffix, roots) of words of five letters or more: the first prefix of the table that leaves over two letters, then suffix and roots of the rest."""
    w = F.lower(col(word))
    prefix = F.nullif(F.regexp_extract(w, "^(" + "|".join(L.PREFIXES) + ")(?=.{3})", 1), F.lit(""))
    rest = F.substring(w, F.length(F.coalesce(prefix, F.lit(""))) + 1, F.length(w))
    suffix = F.nullif(F.regexp_extract(rest, "(?<=.{3})(" + "|".join(L.SUFFIXES) + ")$", 1), F.lit(""))
    roots = F.array_compact(F.array(*(F.when(rest.contains(r), r) for r in L.ROOTS)))
    found = prefix.isNotNull() | suffix.isNotNull() | (F.size(roots) > 0)
    return F.when((F.length(w) >= 5) & found, F.struct(prefix.alias("prefix"), suffix.alias("suffix"), roots.alias("roots")))


# ---- difficulty


def zipf_difficulty(zipf) -> Column:
    z = col(zipf).cast("double")
    return F.when(z > 0, 1 - 1 / (1 + F.exp(-(z - 5.5) / 1.5))).otherwise(0.5)


def family_difficulty(band) -> Column:
    return F.when(col(band).isNotNull(), F.least(F.lit(0.95), 0.05 + (col(band) - 1) * 0.10))


def level_of_zipf(zipf) -> Column:
    z = col(zipf)
    return reduce(lambda c, x: F.when(z >= x[0], x[1]).otherwise(c), reversed(L.ZIPF_LEVELS), F.lit("C2"))


def level_order(level) -> Column:
    """0 for A1 to 5 for C2; null for other labels."""
    return mapping({x: i for i, x in enumerate(L.LEVELS)}, F.upper(F.trim(col(level))))


def difficulty(zipf, band, level) -> Column:
    """0.05 to 0.95 from level, word family and frequency, by what is known."""
    z, fam, lev = zipf_difficulty(zipf), family_difficulty(band), mapping(L.LEVEL_DIFFICULTY, col(level))
    q = F.when(lev.isNotNull(), 0.5 * lev + 0.3 * F.coalesce(fam, z) + 0.2 * z).when(fam.isNotNull(), 0.6 * fam + 0.4 * z).otherwise(z)
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), q))


def vocabulary_level(size) -> Column:
    return F.when(col(size).isNotNull(), F.least(F.lit(0.95), F.greatest(F.lit(0.10), (col(size) - 1500) / 8500)))


def tier(q, n: int = 9) -> Column:
    c = F.when(col(q).isNotNull(), F.least(F.lit(0.95), F.greatest(F.lit(0.05), col(q))))
    return F.when(c.isNotNull(), F.least(F.lit(n), F.greatest(F.lit(1), F.ceil(c / (1.0 / n))))).cast("int")


def tier_colour(q) -> Column:
    return F.format_string("hsl(%s, 65%%, 45%%)", F.rint(220 - (tier(q) - 1) * (220 / 9)).cast("int").cast("string"))


# ---- dictionary text


def pos_code(pos) -> Column:
    p = F.regexp_replace(F.lower(F.trim(col(pos))), r"^\.+|\.+$", "")
    return F.coalesce(mapping(L.POS_CODES, p), F.trim(col(pos)))


def clean_gloss(text) -> Column:
    """Lines without part-of-speech prefixes; [x] becomes 〔x〕; runs of blanks become one."""
    lines = F.split(F.replace(F.coalesce(col(text), F.lit("")), F.lit("\\n"), F.lit("\n")), "\n")
    one = lambda x: stripped(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(stripped(x), L.GLOSS_POS, ""), r"(?i)^[rs]\s+", ""), r"\[([^\]]*)\]", "〔$1〕"), r"[ \t]+", " "))
    return F.array_join(F.filter(F.transform(lines, one), lambda x: x != ""), "\n")


def ipa(phones, keep_adjacent: bool = True) -> Column:
    """IPA of an array of ARPAbet symbols: a vowel with its stress waits for the next consonant.

    keep_adjacent: a vowel that follows a waiting vowel pushes it out; without it the first one is lost.
    """
    symbol = lambda x: F.coalesce(mapping(L.ARPABET, x), x)
    none = F.lit(None).cast("string")

    def step(acc, ph):
        vowel = (F.length(ph) >= 3) & ph.rlike("[0-9]$")
        mark = F.when(ph.endswith("1"), "ˈ").when(ph.endswith("2"), "ˌ").otherwise("")
        waiting = F.concat(mark, symbol(F.substring(ph, F.lit(1), F.length(ph) - 1)))
        flushed = F.concat(acc.out, F.coalesce(acc.wait, F.lit("")))
        return F.when(vowel, F.struct((flushed if keep_adjacent else acc.out).alias("out"), waiting.alias("wait"))).otherwise(F.struct(F.concat(flushed, symbol(ph)).alias("out"), none.alias("wait")))

    start = F.struct(F.lit("").alias("out"), none.alias("wait"))
    return F.aggregate(col(phones), start, step, lambda a: F.concat(F.lit("/"), a.out, F.coalesce(a.wait, F.lit("")), F.lit("/")))


def subjects(file_name) -> Column:
    name = F.lower(F.regexp_extract(col(file_name), r"[^/\\]*$", 0))
    words = lambda xs: F.array(*map(F.lit, xs))
    return reduce(lambda c, s: F.when(name.rlike(s[0]), words(s[1])).otherwise(c), reversed(L.SUBJECTS), words(L.ANY_SUBJECT))


def looks_like_file_name(title) -> Column:
    t = stripped(F.coalesce(col(title), F.lit("")))
    return (t == "") | F.lower(t).rlike("archive|libgen|anna") | t.contains(" -- ") | t.rlike(r"[_-]{2,}") | t.rlike(r"\(\d{4},") | t.rlike(r"(?i)\bISBN\b")


# ---- output


def html_escape(text) -> Column:
    e = F.replace(F.coalesce(col(text), F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(e, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_lines(text) -> Column:
    return F.replace(col(text), F.lit("\n"), F.lit("<br>"))


# ---- spaced repetition


def review_step(ease, interval, reps, quality) -> Column:
    """State after a review of quality 0 to 5: (ease, interval, reps, status)."""
    q = F.least(F.lit(5), F.greatest(F.lit(0), col(quality)))
    good = q >= 3
    longer = col(interval) * col(ease)
    longer = F.when(longer > L.LONGEST_INTERVAL, F.lit(float(L.LONGEST_INTERVAL))).otherwise(longer)
    grown = F.when(col(reps) == 0, L.FIRST_INTERVALS[0]).when(col(reps) == 1, L.FIRST_INTERVALS[1]).otherwise(F.greatest(F.lit(1), F.rint(longer).cast("int")))
    new_ease = F.greatest(F.lit(L.LEAST_EASE), F.round(col(ease) + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02), 2))
    return F.struct(
        new_ease.alias("ease"),
        F.when(good, grown).otherwise(1).cast("int").alias("interval"),
        F.when(good, col(reps) + 1).otherwise(0).cast("int").alias("reps"),
        F.when(q >= 4, "learned").when(q == 3, "reviewing").otherwise("forgot").alias("status"),
    )


def learning_state(reps) -> Column:
    return F.when(col(reps) <= 0, "new").when(col(reps) < 3, "learning").otherwise("mastered")
