"""Queries over entries: rendering, several dictionaries, forms, names, model replies, statistics; each with its SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from lexmill.functions import expressions as X
from lexmill.functions import lexicon as L
from lexmill.functions import rendering
from lexmill.operators import books, corpus, dictionaries, levels, models, ngrams, reports, reviews, senses
from lexmill.operators.ranking import shared_folder
from lexmill.plans import catalog
from lexmill.plans.catalog import CLEAN, COLLOC, DERIVED, LEMMA, SENT, TOKEN_RE, WORDS, case_sql, query, quoted
from lexmill.sources import readers

# ---- rendering: an entry for each turn of a conversation


def entries(spark, d):
    c = readers.table(spark, d, "conversations")
    t, k = F.col("turn"), F.col("conv_id")
    lit = F.lit
    no_text, text_array = lit(None).cast("string"), lambda *xs: F.array(*map(lit, xs))
    sense = lambda ctx, zh, en: F.struct(ctx.alias("book_context"), zh.alias("gloss_zh"), en.alias("gloss_en"))
    affix = lambda part, meaning: F.struct(lit(part).alias("part"), lit(meaning).alias("meaning"))
    root = lambda r, lang, meaning: F.struct(lit(r).alias("root"), lit(lang).alias("lang"), lit(meaning).alias("meaning"))
    chain = lambda p, r, s: F.struct(F.array(*p).cast("array<struct<part:string,meaning:string>>").alias("prefix"), F.array(*r).alias("roots"), F.array(*s).alias("suffix"))
    example = lambda en, zh: F.struct(en.alias("en"), lit(zh).alias("zh"))
    none = F.array().cast("array<string>")
    return c.select(
        "conv_id", "turn", F.concat("role", lit("-"), k.cast("string"), lit("<"), t.cast("string"), lit(">")).alias("word"), t.alias("n"),
        F.when(t % 4 == 0, "noun").when(t % 4 == 1, "v&t").when(t % 4 == 2, "").alias("pos"), F.element_at(text_array("A1", "b2 ", "C2", "x"), (k % 4 + 1).cast("int")).alias("level"),
        F.when(t % 3 == 1, F.create_map(lit("en_us"), lit("/a<b/"))).when(t % 3 == 2, F.create_map(lit("en_uk"), lit("/a/"), lit("xx"), lit("/x&/"))).otherwise(F.create_map().cast("map<string,string>")).alias("ipa"),
        F.when(k % 3 == 0, "").otherwise(F.concat(lit("义\n<"), "role", lit(">"))).alias("gloss_zh"), F.col("text").alias("gloss_en"),
        F.when(t % 3 == 1, F.array(sense(lit("in <book>"), lit("一"), F.col("text")), sense(lit(""), no_text, lit("b")))).otherwise(F.array().cast("array<struct<book_context:string,gloss_zh:string,gloss_en:string>>")).alias("senses"),
        F.when(t % 2 == 1, F.concat(lit("from <Latin> & "), "role")).alias("etymology"),
        F.when(t % 4 == 1, chain([affix("un", "not")], [root("able", "L.", "can"), root("x", "", "")], [affix("", "state")])).when(t % 4 == 2, chain([], [root("act", "", "do")], [affix("ion", "")])).alias("morpheme"),
        F.struct(F.when(t % 2 == 0, text_array("x")).otherwise(none).alias("polysemy"), none.alias("slang"), F.when(k % 2 == 0, text_array("y")).otherwise(none).alias("collocations"), F.when(t % 5 == 0, "physics").otherwise("").alias("domain_term")).alias("phenomena"),
        F.when(t % 2 == 0, F.array(example(F.concat("role", lit("&")), "例"), example(lit("two"), ""), example(lit("three"), ""))).otherwise(F.array().cast("array<struct<en:string,zh:string>>")).alias("examples"),
        F.when(k % 2 == 0, text_array("a<b", "c", "d", "e", "f")).otherwise(none).alias("collocations"),
    )


def esc(x: str) -> str:
    return f"replace(replace(replace(coalesce({x}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_COLOURS = case_sql(L.LEVEL_COLOURS, "lv")
_LINES = f"replace({esc('text')}, chr(10), '<br>')"
HTML = {
    "headword": f"""'<div class="headword"><span class="word">' || {esc("word")} || '</span>'
      || CASE turn % 4 WHEN 0 THEN '<span class="pos">noun</span>' WHEN 1 THEN '<span class="pos">v&amp;t</span>' ELSE '' END
      || coalesce('<span class="badge-cefr" style="background:' || {_COLOURS} || '">' || lv || '</span>', '')
      || CASE WHEN turn > 0 THEN '<span class="badge-freq" title="本书出现 ' || turn || ' 次">×' || turn || '</span>' ELSE '' END || '</div>'""",
    "ipa": """CASE turn % 3 WHEN 0 THEN ''
      WHEN 1 THEN '<div class="ipa-row"><span class="ipa-accent">美</span> <span class="ipa-val">/a&lt;b/</span></div>'
      ELSE '<div class="ipa-row"><span class="ipa-accent">英</span> <span class="ipa-val">/a/</span>　<span class="ipa-accent">xx</span> <span class="ipa-val">/x&amp;/</span></div>' END""",
    "gloss": f"""CASE WHEN conv_id % 3 = 0 AND coalesce(text, '') = '' THEN '' ELSE '<div class="gloss">'
      || CASE WHEN conv_id % 3 = 0 THEN '' ELSE '<span class="gloss-zh">义<br>&lt;' || role || '&gt;</span>' END
      || CASE WHEN coalesce(text, '') = '' THEN '' ELSE '<span class="gloss-en">' || {_LINES} || '</span>' END || '</div>' END""",
    "senses": f"""CASE WHEN turn % 3 <> 1 THEN '' ELSE '<div class="senses"><div class="sense"><span class="sense-zh">一</span><span class="sense-en">'
      || {_LINES} || '</span><span class="book-context">in &lt;book&gt;</span></div>'
      || '<div class="sense"><span class="sense-zh"></span><span class="sense-en">b</span></div></div>' END""",
    "etymology": """CASE WHEN turn % 2 = 1 THEN '<div class="etymology">from &lt;Latin&gt; &amp; ' || role || '</div>' ELSE '' END""",
    "morpheme": """CASE turn % 4 WHEN 1 THEN '<div class="morpheme">构词：un「not」 + able(L.「can」) + x + 「state」</div>'
      WHEN 2 THEN '<div class="morpheme">构词：act(「do」) + ion</div>' ELSE '' END""",
    "phenomena": """CASE WHEN turn % 2 = 1 AND conv_id % 2 = 1 AND turn % 5 <> 0 THEN '' ELSE '<div class="phenomena">'
      || CASE WHEN turn % 2 = 0 THEN '<span class="phen-tag">熟词生义</span>' ELSE '' END
      || CASE WHEN conv_id % 2 = 0 THEN '<span class="phen-tag">固定搭配</span>' ELSE '' END
      || CASE WHEN turn % 5 = 0 THEN '<span class="phen-tag">学科术语</span>' ELSE '' END || '</div>' END""",
    "examples": """CASE WHEN turn % 2 = 1 THEN '' ELSE '<div class="example"><span class="example-en">' || role || '&amp;</span><span class="example-zh">例</span></div>'
      || '<div class="example"><span class="example-en">two</span><span class="example-zh"></span></div>' END""",
    "collocations": """CASE WHEN conv_id % 2 = 0 THEN '<div class="collocations">a&lt;b · c · d · e</div>' ELSE '' END""",
}
ENTRIES = "e AS (SELECT *, role || '-' || conv_id || '<' || turn || '>' AS word, (['A1', 'B2', 'C2', 'X'])[CAST(conv_id % 4 + 1 AS INTEGER)] AS lv FROM conversations)"


def _render(name: str) -> None:
    def run(spark, d):
        return entries(spark, d).select("conv_id", "turn", rendering.field(name).alias("html"))

    run.__name__ = f"render_{name}"
    query(f"WITH {ENTRIES} SELECT conv_id, turn, {HTML[name]} AS html FROM e")(run)


for _name in rendering.ORDER:
    _render(_name)

_JOINED = ", ".join(HTML[n] for n in rendering.ORDER)


@query(
    f"""WITH {ENTRIES} SELECT word, '<div class="entry">' || chr(10) || '  ' || array_to_string(list_filter([{_JOINED}], lambda x: x <> ''), chr(10) || '  ') || chr(10) || '</div>' AS html
  FROM e WHERE turn % 3 <> 0 AND (conv_id % 3 <> 0 OR coalesce(text, '') <> '')"""
)
def rendered_entries(spark, d):
    return rendering.entry_html(entries(spark, d))


@query(
    f"""WITH {ENTRIES} SELECT word, CASE WHEN row_number() OVER (PARTITION BY upper(word[1]) ORDER BY lower(word), word) = 1 THEN '<h2 class="alpha-header">' || upper(word[1]) || '</h2>' END AS letter_head,
  '<article class="entry">' || chr(10) || '  <header class="headword"><span class="word">' || {esc("word")} || '</span><span class="pos">' || CASE turn % 4 WHEN 0 THEN 'noun' WHEN 1 THEN 'v&amp;t' ELSE '' END || '</span></header>'
  || CASE WHEN conv_id % 3 = 0 THEN '' ELSE chr(10) || '  <div class="zh-def">义' || chr(10) || '&lt;' || role || '&gt;</div>' END
  || CASE WHEN coalesce(text, '') = '' THEN '' ELSE chr(10) || '  <div class="en-def">' || {esc("text")} || '</div>' END
  || CASE WHEN turn % 2 = 1 THEN chr(10) || '  <div class="etymology">from &lt;Latin&gt; &amp; ' || role || '</div>' ELSE '' END || chr(10) || '</article>' AS html FROM e"""
)
def alphabetical_list(spark, d):
    return rendering.alphabetical_html(entries(spark, d))


@query(
    f"""WITH {ENTRIES}, p AS (SELECT *, CASE turn % 4 WHEN 0 THEN 'noun' WHEN 1 THEN 'v&t' WHEN 2 THEN '' END AS pos FROM e)
  SELECT conv_id, turn, coalesce({case_sql(L.REPORT_POS, "regexp_replace(lower(trim(pos)), '[.]+$', '')")}, nullif(pos, ''), '其他') AS pos,
    replace(replace(coalesce(text, ''), chr(13), ''), chr(10), ' / ') AS line,
    left(coalesce(nullif(trim(regexp_replace(word || ' (一)/?*', '[^\\p{{L}}\\p{{N}} _\\-()（）]', '', 'g')), ''), 'vocabulary'), 60) AS name FROM p"""
)
def other_formats(spark, d):
    name = rendering.safe_name(F.concat("word", F.lit(" (一)/?*")))
    return entries(spark, d).select("conv_id", "turn", rendering.report_pos("pos").alias("pos"), rendering.document_line("gloss_en").alias("line"), name.alias("name"))


# ---- titles and names

NAMES = ["The phenomenon of life- Toward A Biology {} -- Jonas -- 2001.pdf", "Series -- Real Title {} -- Author -- 1999.pdf", "[Series] Plath, Sylvia - The Bell Jar {}, by Plath (2012, Press) - libgen.li.PDF", "Author Name - Great Book {}.pdf", "author_title {}.pdf", "plain name {} - Anna's Archive.pdf", "x - Archive.pdf"]


@query(
    f"""WITH n AS (SELECT page_id, replace(([{quoted(NAMES)}])[CAST(page_id % {len(NAMES)} + 1 AS INTEGER)], '{{}}', CAST(page_id AS VARCHAR)) AS file FROM pages
  ), b AS (SELECT page_id, regexp_replace(file, '(?i)\\.pdf$', '') AS name FROM n
  ), f AS (SELECT *, regexp_split_to_array(name, '\\s*--\\s*') AS parts, regexp_replace(name, '^\\[[^\\]]*\\]\\s*', '') AS plain FROM b
  ), g AS (SELECT *, regexp_extract(parts[1], '-\\s*([A-Z][A-Za-z0-9''& ]{{2,60}})$', 1) AS a, trim(regexp_extract(regexp_extract(plain, '(?s)^(.*?)\\(\\d{{4}}[,)]', 1), '[-_]\\s*([A-Z][A-Za-z0-9''&, ]{{2,80}})$', 1)) AS y,
    trim(regexp_extract(plain, '-\\s*([A-Z][A-Za-z0-9'' ]{{2,60}})$', 1)) AS z, regexp_matches(plain, '^([^_\\-]+)[_\\-]+([^_\\-]+)$') AS two FROM f)
  SELECT page_id, CASE WHEN len(parts) >= 2 AND a <> '' THEN trim(a) WHEN len(parts) >= 3 AND NOT regexp_matches(parts[2], '\\d{{4}}') THEN trim(parts[2]) WHEN y <> '' AND length(y) < 60 THEN y
      WHEN z <> '' AND lower(z) NOT IN ('archive', 'anna s archive') THEN z WHEN two THEN trim(regexp_extract(plain, '^([^_\\-]+)[_\\-]+([^_\\-]+)$', 2)) ELSE plain END AS title,
    CASE WHEN (len(parts) >= 2 AND a <> '') OR (len(parts) >= 3 AND NOT regexp_matches(parts[2], '\\d{{4}}')) OR (y <> '' AND length(y) < 60) OR (z <> '' AND lower(z) NOT IN ('archive', 'anna s archive')) OR NOT two THEN ''
      ELSE trim(regexp_extract(plain, '^([^_\\-]+)[_\\-]+([^_\\-]+)$', 1)) END AS author,
    trim(regexp_replace(name, '(?i)\\s*[-_]\\s*(Anna''?s Archive|libgen\\.[a-z]+)$', '')) AS fallback, 'T' || page_id % 3 || CASE WHEN page_id % 2 = 0 THEN '_ielts7.5' ELSE '' END || '_词汇表.html' AS report,
    CASE WHEN page_id % 2 = 0 THEN 'T' || page_id % 3 || '_ielts7.5' ELSE name || regexp_extract((SELECT file FROM n WHERE n.page_id = g.page_id), '(?i)\\.pdf$', 0) END AS book FROM g"""
)
def book_titles(spark, d):
    n = readers.table(spark, d, "pages").select("page_id", F.replace(F.element_at(F.array(*map(F.lit, NAMES)), (F.col("page_id") % len(NAMES) + 1).cast("int")), F.lit("{}"), F.col("page_id").cast("string")).alias("file"))
    stem, even = F.concat(F.lit("T"), (F.col("page_id") % 3).cast("string")), F.col("page_id") % 2 == 0
    path, exam = F.concat(F.lit("/books/"), "file"), F.when(even, "ielts").otherwise("")
    read = n.select("page_id", books.title_and_author(path).alias("t"), books.fallback_title(path).alias("fallback"), books.report_name(stem, exam, F.lit("7.5")).alias("report"), path.alias("path"), even.alias("even"))
    html = F.when(F.col("even"), F.concat(F.lit("/out/"), "report")).otherwise("")
    return read.select("page_id", "t.title", "t.author", "fallback", "report", books.book_of_report(html, "path").alias("book"))


# ---- several dictionaries


def wordnet(spark, d):
    w = catalog.words(spark, d)
    return w.where(F.length("word") % 4 == 0).select("word", F.array(F.concat(F.lit("Gloss of "), "word"), F.lit("an entirely different sense"), F.lit("3 third"), F.lit("4 fourth"), F.lit("5 cut")).alias("definitions"))


_L = "length(word)"
MULTI = f"""{WORDS}, m AS (SELECT word,
  CASE WHEN {_L} % 3 <> 0 THEN '/hʌlˈoʊ/' WHEN {_L} % 2 = 0 THEN 'x' END AS ipa,
  list_filter([CASE WHEN {_L} % 5 = 0 THEN 'wiki ' || word END, CASE WHEN {_L} % 2 = 0 THEN '〔law〕 ' || word END, CASE WHEN {_L} % 3 <> 1 THEN 'gloss of ' || word WHEN {_L} % 4 = 0 THEN 'Gloss of ' || word END,
    CASE WHEN {_L} % 4 = 0 THEN 'an entirely different sense' END, CASE WHEN {_L} % 4 = 0 THEN '3 third' END, CASE WHEN {_L} % 4 = 0 THEN '4 fourth' END], lambda x: x IS NOT NULL) AS ss,
  CASE WHEN {_L} % 3 <> 1 AND {_L} % 4 = 0 THEN 'cefr,wordnet' WHEN {_L} % 3 <> 1 THEN 'cefr' WHEN {_L} % 4 = 0 THEN 'wordnet' END AS gs FROM w)"""


@query(f"WITH {MULTI} SELECT word, ipa, CAST(len(ss) AS INTEGER) AS n_senses, array_to_string(ss, '；') AS gloss_en, CASE WHEN {_L} % 2 = 0 THEN '中文' ELSE '' END AS gloss_zh, gs AS gloss_sources FROM m WHERE word NOT IN ('gloss', 'wiki', 'law')")
def multi_dictionary(spark, d):
    w = catalog.words(spark, d).where(~F.col("word").isin("gloss", "wiki", "law"))
    found = dictionaries.query(w.select("word"), catalog.dictionaries(spark, d), wordnet(spark, d))
    of = F.filter("senses_en", lambda s: F.lower(s["text"]).startswith("gloss of "))
    return found.select("word", "ipa", F.size("senses_en").alias("n_senses"), "gloss_en", "gloss_zh", F.array_join(F.get(of, F.lit(0))["sources"], ",").alias("gloss_sources"))


#: Tokens that don't start a sentence.
_CAP_TOK = "capt AS (SELECT unnest(regexp_extract_all(s, '" + TOKEN_RE + "')[2:]) AS token FROM (SELECT unnest(regexp_split_to_array(coalesce(text, ''), '[.!?]\\s*|\\n')) AS s FROM documents WHERE lang = 'en'))"


@query(f"WITH {WORDS}, k AS (SELECT word FROM w WHERE {_L} % 6 = 0) SELECT w.word, (k.word IS NOT NULL OR zipf >= 4.0) AS known FROM w LEFT JOIN k ON w.word = k.word")
def known_words(spark, d):
    w = catalog.words(spark, d)
    few = w.where(F.length("word") % 6 == 0).select("word")
    return dictionaries.known(w, {t: few for t in ("bilingual", "cmu", "cefr", "oxford")}).select("word", "known")


@query(
    f"""WITH {WORDS}, {_CAP_TOK}, cap AS (SELECT lower(token) AS word, count(*) FILTER (WHERE regexp_matches(token, '^[A-Z]')) AS upper, count(*) AS total FROM capt GROUP BY 1 HAVING count(*) >= 2)
  SELECT w.word, w.n, CAST(coalesce(round(upper * 1.0 / total, 2), 0) AS DOUBLE) AS cap_ratio FROM w LEFT JOIN cap ON cap.word = w.word WHERE zipf < 4.0 AND length(w.word) % 6 <> 0 ORDER BY w.n DESC, w.word LIMIT 200"""
)
def suspect_words(spark, d):
    w = catalog.words(spark, d)
    few = w.where(F.length("word") % 6 == 0).select("word")
    return dictionaries.suspects(w, corpus.capital_stats(readers.english(spark, d)), {t: few for t in ("bilingual", "cmu", "cefr", "oxford")})


@query(f"WITH {CLEAN}, c AS (SELECT lemma AS word, count(*) AS n FROM ct GROUP BY lemma) SELECT c.word, c.n FROM c WHERE length(word) > 3 OR word IN (SELECT word FROM w WHERE {_L} % 3 = 2 OR {_L} % 2 = 0)")
def candidates(spark, d):
    counts = catalog.clean_tokens(spark, d).groupBy(F.col("lemma").alias("word")).agg(F.count("*").alias("n"))
    t = {k: v.where((F.length("word") % 3 == 2) | (F.length("word") % 2 == 0)) for k, v in catalog.dictionaries(spark, d).items()}
    looked = levels.look_up(counts.where(F.length("word") <= 3).select("word"), t["cmu"], t["cefr"], t["oxford"], t["bilingual"], t["wiktionary"])
    return dictionaries.candidates(counts, looked)


@query(f"WITH {WORDS} SELECT word, CASE {_L} % 3 WHEN 0 THEN 'cmu ' || word WHEN 1 THEN '/other/' ELSE NULL END AS ipa FROM w")
def pronunciation_conflict(spark, d):
    k = F.length("word") % 3
    m = F.create_map(F.lit("espeak"), F.when(k == 2, " ").otherwise("/other/"), F.lit("cmu"), F.when(k == 0, F.concat(F.lit("cmu "), "word")).otherwise(""))
    return catalog.words(spark, d).select("word", dictionaries.pronunciation_conflict(m).alias("ipa"))


def _csv(c):
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


@query(
    f"""WITH {WORDS}, p AS (SELECT * FROM w WHERE length(word) <= 40)
  SELECT 'cmu' AS source, word, 'HH AH1' AS value FROM p UNION ALL SELECT 'cefr', word, 'noun|' || level || '|of ' || word || '|an example' FROM p
  UNION ALL SELECT 'oxford', word, 'n|B2' FROM p UNION ALL SELECT 'ecdict', word, 'p' || n || '|n. a "' || word || '", quoted|vt. 中文|n.|' || n FROM p
  UNION ALL SELECT 'ecdict zh', word, 'vt. 中文' FROM p
  UNION ALL SELECT 'kaikki', word, 'first ' || word || '|2|noun|a,b|/i/|from Latin' FROM p
  UNION ALL SELECT 'nation', word, CAST(1 + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS VARCHAR) FROM p WHERE n > 1"""
)
def dictionary_files(spark, d):
    """Writes the words as dictionary files of every format to the shared folder and reads them back."""
    w = catalog.words(spark, d).where(F.length("word") <= 40)
    base, word = f"{shared_folder(spark).rstrip('/')}/dictionaries-{uuid.uuid4().hex}", F.col("word")
    n = F.col("n").cast("string")

    def put(name, rows, line):
        rows.select(line.alias("value")).write.text(f"{base}/{name}")
        return f"{base}/{name}"

    cmu = put("cmu", w, F.concat(word, F.lit("  HH AH1")))
    cefr = put("cefr", w, F.concat_ws(",", word, F.lit("noun"), F.lower("level"), F.concat(F.lit("of "), word), F.lit("an example")))
    oxford = put("oxford", w, F.concat_ws("\t", word, F.lit("x"), F.lit("y"), F.lit("n"), F.lit("b2")))
    heads = ["word", "phonetic", "definition", "translation", "pos", "frq"]
    w.select(word, F.concat(F.lit("p"), n).alias("phonetic"), F.concat(F.lit('n. a "'), word, F.lit('", quoted')).alias("definition"), F.lit("vt. 中文").alias("translation"), F.lit("").alias("pos"), n.alias("frq")).select(*heads).write.csv(f"{base}/ecdict", header=True, quote='"', escape='"', quoteAll=True)
    sense = F.struct(F.array(F.concat(F.lit("first "), word), F.lit("second")).alias("glosses"), F.array(F.lit("b"), F.lit("a")).alias("topics"))
    kaikki = put("kaikki", w, F.to_json(F.struct(word, F.lit("noun").alias("pos"), F.lit("from Latin").alias("etymology_text"), F.array(F.struct(F.lit("/i/").alias("ipa"))).alias("sounds"), F.array(sense).alias("senses"))))
    bands = [put("band1", w.where("n > 1"), word), put("band2", w.where("n > 1 and n % 2 = 0"), word)]
    pick = lambda df, source, *cs: df.select(F.lit(source).alias("source"), "word", F.concat_ws("|", *cs).alias("value"))
    joined = lambda c, by: F.array_join(c, by)
    parts = [
        pick(readers.pronunciations(spark, cmu), "cmu", joined("phones", " ")),
        pick(readers.level_list(spark, cefr), "cefr", "pos", "cefr", "gloss_en", "example"),
        pick(readers.tabbed_levels(spark, oxford), "oxford", "pos", "cefr"),
        pick(readers.bilingual(spark, f"{base}/ecdict"), "ecdict", "phonetic", "definition_en", "translation_zh", "pos", F.col("frq").cast("string")),
        pick(readers.translations(spark, f"{base}/ecdict"), "ecdict zh", "translation_zh"),
        pick(readers.wiktionary(spark, kaikki), "kaikki", "gloss_en", F.size("glosses").cast("string"), "pos", joined("topics", ","), "ipa", "etymology"),
        pick(readers.families(spark, bands), "nation", F.col("band").cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


# ---- forms and repairs

_INFL = "(l.word = l.lemma OR (regexp_matches(l.word, '(ed|ing|s|es)$') AND starts_with(l.word, l.lemma)))"
_CAP = _CAP_TOK + ", caps AS (SELECT lower(token) AS word FROM capt GROUP BY 1 HAVING count(*) >= 2 AND count(*) FILTER (WHERE regexp_matches(token, '^[A-Z]')) * 1.0 / count(*) > 0.6)"


@query(
    f"""WITH {LEMMA}, {_CAP}, heads AS (SELECT DISTINCT lower(unnest(regexp_extract_all(string_split(coalesce(text, ''), chr(10))[1], '{TOKEN_RE}'))) AS word FROM documents WHERE lang = 'en'
  ), f AS (SELECT l.word, l.lemma, w.n, h.word IS NOT NULL AS heading, c.word IS NOT NULL AS capital, {_INFL} AS inflected, regexp_matches(l.word, '.{{4,}}({DERIVED})$') AND NOT {_INFL} AS derived, w.n % 4 = 0 AS changed
    FROM lem l JOIN w ON l.word = w.word LEFT JOIN heads h ON h.word = l.word LEFT JOIN caps c ON c.word = l.word
  ), g AS (SELECT *, array_to_string(list_filter([CASE WHEN heading THEN '标题' END, CASE WHEN n >= {L.TERM_FREQ} THEN '高频(' || n || '次)' END, CASE WHEN capital THEN '句中大写（专名）' END], lambda x: x IS NOT NULL), ',') AS evidence FROM f)
  SELECT word, evidence, evidence <> '' AS term, changed OR derived OR evidence <> '' AS independent, CASE WHEN changed OR derived OR evidence <> '' THEN word ELSE lemma END AS key,
    coalesce(nullif(concat_ws('；', CASE WHEN changed THEN '派生：POS VERB→NOUN' WHEN derived THEN '派生后缀' WHEN inflected THEN '屈折变化' END, CASE WHEN evidence <> '' AND NOT changed AND NOT derived THEN '学术术语促进' END), ''), '普通词') AS reason FROM g"""
)
def term_decisions(spark, d):
    w = catalog.words(spark, d)
    rows = corpus.term_signals(readers.english(spark, d), corpus.lemmas(w).join(w.select("word", "n"), "word"))
    ctx = X.term_context(in_heading="in_heading", freq="freq", capitalized="capitalized")
    made = rows.select("word", X.form_decision("word", "lemma", F.lit("NOUN"), F.when(F.col("n") % 4 == 0, "VERB"), ctx).alias("f"))
    return made.select("word", F.array_join("f.evidence", ",").alias("evidence"), "f.term", "f.independent", X.entry_key("f").alias("key"), "f.reason")


_KEY = f"CASE WHEN {_INFL} OR NOT regexp_matches(l.word, '.{{4,}}({DERIVED})$') THEN l.lemma ELSE l.word END"


@query(f"WITH {LEMMA}, q AS (SELECT word, {catalog.Q} AS q FROM w) SELECT l.word, {_KEY} AS key, q.q FROM lem l LEFT JOIN q ON q.word = {_KEY}")
def decision_quantile(spark, d):
    w = catalog.words(spark, d)
    made = corpus.lemmas(w).select("word", X.entry_key(X.form_decision("word", "lemma", F.lit("NOUN"), F.lit("NOUN"), X.term_context())).alias("key"))
    q = w.select(F.col("word").alias("key"), F.round(X.difficulty("zipf", "band", "level"), 6).alias("q"))
    return made.join(q, "key", "left").select("word", "key", "q")


@query("SELECT doc_id, md5(CASE WHEN trim(coalesce(text, ''), E' \\t\\n\\x0B\\f\\r') = '' THEN coalesce(text, '') WHEN lang = 'en' THEN replace(nfc_normalize(text), '-' || chr(10), '') ELSE nfc_normalize(text) END) AS repaired FROM documents")
def text_repair(spark, d):
    docs = readers.table(spark, d, "documents")
    text = F.when(F.col("lang") == "en", corpus.repair()).otherwise(corpus.repair(lang="other"))
    return docs.select("doc_id", F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("repaired"))


@query()
def split_words(spark, d):
    w = catalog.words(spark, d)
    return corpus.split_joined(w, w.where("n >= 3")).select("word", F.array_join("parts", " ").alias("parts"))


@query(f"WITH x AS (SELECT lang, lower(unnest(regexp_extract_all(coalesce(text, ''), '{TOKEN_RE}'))) AS word FROM documents) SELECT lang, word, count(*) AS n FROM x GROUP BY lang, word")
def words_by_language(spark, d):
    t = readers.table(spark, d, "documents").select("lang", F.explode(X.corpus_tokens("text")).alias("token"))
    return t.groupBy("lang", F.lower("token").alias("word")).agg(F.count("*").alias("n"))


# ---- model replies


def _reply(kind: str, prompt: str) -> str:
    words = [x.split("（")[0][2:] for x in prompt.split("\n") if x.startswith("- ")]
    if kind == "terms":
        return "Sure: " + json.dumps({"must_keep": [{"word": w.upper(), "reason": f"about {w}"} for w in words if len(w) % 2 == 0] + [{"word": "unasked", "reason": ""}]})
    rows = [{"word": w, "action": ("repair", "wrong", "noise")[len(w) % 3], "replacement": w + "e", "reason": "r" * 300} for w in words]
    return json.dumps({"decisions": rows}) if len(words) % 2 else "so " + json.dumps({"decisions": rows}) + " done"


def _terms(prompt: str) -> str:
    return _reply("terms", prompt)


def _decisions(prompt: str) -> str:
    return _reply("decisions", prompt)


@query(f"WITH {WORDS}, t AS (SELECT word FROM w ORDER BY n DESC, word LIMIT 150) SELECT word, ['about ' || word] AS reasons FROM t WHERE {_L} % 2 = 0")
def book_terms(spark, d):
    return senses.must_keep(catalog.words(spark, d), _terms, "A book")


@query(f"WITH {WORDS}, t AS (SELECT word FROM w WHERE zipf < 4.0 ORDER BY n DESC, word LIMIT 200) SELECT word, (['repair', 'keep', 'noise'])[CAST({_L} % 3 + 1 AS INTEGER)] AS action, word || 'e' AS replacement, CAST(200 AS INTEGER) AS reason_length FROM t")
def classified_suspects(spark, d):
    s = catalog.words(spark, d).where("zipf < 4.0").orderBy(F.desc("n"), "word").limit(200).withColumn("cap_ratio", F.lit(0.0))
    return senses.classify(s, 30, _decisions).select("word", "action", "replacement", F.length("reason").alias("reason_length"))


@query(
    """SELECT conv_id, turn, role AS word, CASE WHEN turn % 2 = 0 THEN 'noise' ELSE 'keep' END AS action, 'x' || turn AS replacement, left(trim(regexp_replace(coalesce(text, ''), '[\\s"\\\\]+', ' ', 'g')), 200) AS reason
  FROM conversations WHERE turn % 5 <> 0"""
)
def parsed_decisions(spark, d):
    c = readers.table(spark, d, "conversations")
    reason = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r'[\s"\\]+', " "))
    one = lambda action: F.struct(F.concat(F.lit(" "), F.upper("role")).alias("word"), F.lit(action).alias("action"), F.concat(F.lit("X"), F.col("turn").cast("string"), F.lit(" ")).alias("replacement"), reason.alias("reason"))
    made = F.to_json(F.struct(F.array(one("proper"), F.when(F.col("turn") % 2 == 0, one("Noise")).otherwise(one("unknown"))).alias("decisions")))
    reply = F.when(F.col("turn") % 5 == 0, "no json at all").when(F.col("turn") % 3 == 0, F.concat(F.lit("Here: "), made, F.lit(" done"))).otherwise(made)
    return senses.parse_decisions(c.select("conv_id", "turn", reply.alias("reply")), "conv_id", "turn")


@query(
    """WITH x AS (SELECT conv_id, turn, role FROM conversations), g AS (SELECT conv_id, list(role || turn ORDER BY turn, role) AS ws FROM x GROUP BY conv_id)
  SELECT conv_id, '请为以下 ' || len(ws) || ' 个单词批量生成词汇信息' || CASE WHEN conv_id % 2 = 0 THEN '（来源书籍：T' || conv_id || '，作者：A）' ELSE '' END || '：' || chr(10) || chr(10)
    || array_to_string(list_transform(range(1, len(ws) + 1), lambda i: i || '. ' || ws[i]), chr(10)) || chr(10) || chr(10) || '按序号顺序输出 JSON 数组，每个元素 headword 必须与输入一致。' AS prompt,
    '请判别以下候选词（依次给出 decision）：' || chr(10) || chr(10) || array_to_string(list_transform(ws, lambda w: '- ' || w || '（出现 2 次，大写比例 0.5）'), chr(10)) AS suspects FROM g"""
)
def prompts(spark, d):
    c = readers.table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: F.concat(s["role"], s["turn"].cast("string"))).alias("ws"))
    title = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("T"), F.col("conv_id").cast("string"))).otherwise("")
    asked = F.transform("ws", lambda w: F.struct(w.alias("word"), F.lit(2).alias("n"), F.lit(0.5).alias("cap_ratio")))
    return c.select("conv_id", senses.batch_prompt("ws", title, F.lit("A")).alias("prompt"), senses.suspects_prompt(asked).alias("suspects"))


# ---- learning states and statistics


@query(
    """WITH e AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 0 END AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
  ), l AS (SELECT user_id, max(k) FILTER (WHERE s IS NOT NULL) AS last FROM e GROUP BY user_id
  ), f AS (SELECT e.user_id, (coalesce(max(s) FILTER (WHERE k = last), 0) + count(*) FILTER (WHERE last IS NULL OR k > last)) % 3 AS p FROM e JOIN l ON e.user_id = l.user_id GROUP BY e.user_id)
  SELECT user_id, (['new', 'learning', 'mastered'])[CAST(p + 1 AS INTEGER)] AS status, CAST(([0, 1, 3])[CAST(p + 1 AS INTEGER)] AS INTEGER) AS reps FROM f"""
)
def status_cycle(spark, d):
    e = readers.table(spark, d, "events")
    named = e.withColumn("status", F.when(F.col("event_type") == "signup", "learning").when(F.col("event_type") == "purchase", "mastered").when(F.col("event_type") == "error", "new").otherwise("next"))
    return reviews.cycle(named, "user_id", "status", "ts", "event_id")


@query("SELECT CAST(user_id AS VARCHAR) AS word, CAST(2.5 AS DOUBLE) AS ease, CAST(0 AS INTEGER) AS \"interval\", CAST(0 AS INTEGER) AS reps, CAST(3 AS INTEGER) AS due FROM (SELECT DISTINCT user_id FROM events)")
def initial_states(spark, d):
    return reviews.initial(readers.table(spark, d, "events").select(F.col("user_id").cast("string").alias("word")), 3)


@query(f"WITH {WORDS}, t AS (SELECT word, n FROM w ORDER BY n DESC, word LIMIT 10) SELECT '# 《A book》语言学习价值说明' || chr(10) || chr(10) || '- 词汇量：' || (SELECT count(*) FROM w) || chr(10) || '- 高频核心词：' || (SELECT string_agg(word, ', ' ORDER BY n DESC, word) FROM t) AS text")
def value_note(spark, d):
    return reports.value_note(catalog.words(spark, d), "A book")


_POS = "CASE length(word) % 4 WHEN 0 THEN 'n.' WHEN 1 THEN 'v.' WHEN 2 THEN 'adj.' ELSE 'xyz' END"


@query(
    f"""WITH {WORDS}, {SENT}, {COLLOC[COLLOC.index("x AS"):]}, c AS (SELECT * FROM w WHERE word NOT IN ({quoted(L.REPORT_WORDS)})
  ), tw AS (SELECT row_number() OVER (ORDER BY n DESC, word) AS r, word, n FROM c), p AS (SELECT {_POS} AS key, count(*) AS n FROM w GROUP BY 1), v AS (SELECT level AS key, count(*) AS n FROM w GROUP BY 1)
  SELECT 'top_words' AS section, CAST(r AS INTEGER) AS no, word AS key, CAST(n AS DOUBLE) AS n, CAST(NULL AS INTEGER) AS pct FROM tw WHERE r <= 30
  UNION ALL SELECT 'pos', CAST(row_number() OVER (ORDER BY n DESC, key) AS INTEGER), key, n, CAST(round_even(n * 100 / (SELECT count(*) FROM w), 0) AS INTEGER) FROM p
  UNION ALL SELECT 'level', CAST(list_position(['A1', 'A2', 'B1', 'B2', 'C1', 'C2'], key) AS INTEGER), key, n, CAST(round_even(n * 100 / (SELECT count(*) FROM w), 0) AS INTEGER) FROM v
  UNION ALL SELECT 'corpus', 0, 'tokens', (SELECT sum(n) FROM w), NULL UNION ALL SELECT 'corpus', 1, 'unique', (SELECT count(*) FROM w), NULL
  UNION ALL SELECT 'corpus', 2, 'ttr', (SELECT round(count(*) / sum(n), 3) FROM w), NULL UNION ALL SELECT 'corpus', 3, 'avg_sentence', (SELECT round(avg(size), 1) FROM se WHERE size > 0), NULL
  UNION ALL SELECT 'corpus', 4, 'longest_sentence', (SELECT max(size) FROM se WHERE size > 0), NULL
  UNION ALL SELECT 'bands', 0, 'high', (SELECT count(*) FROM c WHERE n >= 10), NULL UNION ALL SELECT 'bands', 1, 'middle', (SELECT count(*) FROM c WHERE n BETWEEN 2 AND 9), NULL
  UNION ALL SELECT 'bands', 2, 'single', (SELECT count(*) FROM c WHERE n = 1), NULL
  UNION ALL SELECT 'phrases', CAST(r AS INTEGER), phrase, n, NULL FROM (SELECT row_number() OVER (ORDER BY round(s, 2) DESC, n DESC, phrase) AS r, phrase, n FROM col WHERE s > 0) WHERE r <= 12
  UNION ALL SELECT 'plan', CAST(day AS INTEGER), 'words', CASE WHEN day IN (0, 1, 7) THEN (SELECT count(*) FROM w) ELSE 0 END, NULL FROM (SELECT unnest(range(0, 14)) AS day)"""
)
def statistics_bundle(spark, d):
    k = F.length("word") % 4
    w = catalog.words(spark, d).withColumn("pos", F.when(k == 0, "noun").when(k == 1, "vt.").when(k == 2, "a").otherwise("xyz"))
    return reports.statistics(w, w, catalog.sentences(spark, d), ngrams.collocations(readers.english(spark, d)))


@query()
def accessory_files(spark, d):
    """(name, text) of the accessory reports."""
    w, docs = catalog.words(spark, d), readers.english(spark, d)
    made = reports.accessories(w, w.select("word", F.concat(F.lit("example of "), "word").alias("example")), ngrams.collocations(docs, 2, 3), ngrams.collocations(docs, 3, 2), "A book")
    out = None
    for name, page in sorted(made.items()):
        part = page.select(F.lit(name).alias("name"), "text")
        out = part if out is None else out.unionAll(part)
    return out


def _title_reply(prompt: str) -> str:
    text = prompt.rsplit("\n", 1)[-1]
    if len(text) % 3 == 0:
        return "no idea"
    return "It is " + json.dumps({"book_title": f"T {len(text)}" if len(text) % 3 == 1 else f"a__b {len(text)}", "book_author": "A"})


@query(
    """WITH f AS (SELECT conv_id, length(string_split(text, chr(10))[-1]) AS n FROM conversations WHERE turn = 1 AND text IS NOT NULL)
  SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'Stated' WHEN n % 3 = 1 THEN 'T ' || n WHEN n % 3 = 2 THEN 'a__b ' || n ELSE 'Book ' || conv_id END AS title,
    CASE WHEN conv_id % 4 = 0 OR n % 3 = 0 THEN '' ELSE 'A' END AS author FROM f WHERE n > 0"""
)
def model_titles(spark, d):
    c = readers.table(spark, d, "conversations").where("turn = 1 and text is not null").where(F.length(F.element_at(F.split("text", "\n"), -1)) > 0)
    path = F.concat(F.lit("/x/Book "), F.col("conv_id").cast("string"), F.lit(" - libgen.li.pdf"))
    rows = c.select("conv_id", path.alias("path"), F.col("text").alias("head"), F.when(F.col("conv_id") % 4 == 0, "Stated").otherwise("").alias("title"), F.lit(None).cast("string").alias("author"))
    return models.titles(rows, _title_reply).select("conv_id", "title", "author")


def _entry_reply(prompt: str) -> str:
    word = prompt.split("\n")[0][4:]
    return "" if len(word) % 4 == 0 else "Here " + json.dumps({"pos": "n." if len(word) % 2 else "", "gloss_en": f"about {word}"})


@query(f"WITH {WORDS} SELECT word, CASE WHEN {_L} % 2 = 1 THEN 'n.' ELSE 'old' END AS pos, '旧' AS gloss_zh, CASE WHEN {_L} % 4 = 0 THEN 'old' ELSE 'about ' || word END AS gloss_en FROM w")
def completed_entries(spark, d):
    e = catalog.words(spark, d).select("word", F.lit("old").alias("pos"), F.lit("旧").alias("gloss_zh"), F.lit("old").alias("gloss_en"))
    return models.complete_each(e, _entry_reply, "A book")


_TRI = catalog.ORACLES["trigram_score"]


@query(
    f"""WITH {COLLOC}, tri3 AS ({_TRI}), b AS (SELECT row_number() OVER (ORDER BY round(s, 2) DESC, n DESC, phrase) AS no, phrase, n, round(s, 2) AS pmi FROM col WHERE s > 0 AND n >= 3
  ), t AS (SELECT row_number() OVER (ORDER BY pmi DESC, n DESC, phrase) AS no, phrase, n, pmi FROM tri3)
  SELECT 2 AS words, CAST(no AS INTEGER) AS no, phrase, n, pmi FROM b WHERE no <= 20 UNION ALL SELECT 3, CAST(no AS INTEGER), phrase, n, pmi FROM t WHERE no <= 10"""
)
def phrase_statistics(spark, d):
    from pyspark.sql import Window

    docs, order = readers.english(spark, d), Window.orderBy(F.desc("pmi"), F.desc("n"), "phrase")
    best = lambda n, least, k: ngrams.top(ngrams.collocations(docs, n, least), k).select(F.lit(n).alias("words"), F.row_number().over(order).alias("no"), "phrase", "n", "pmi")
    return best(2, 3, 20).unionAll(best(3, 2, 10))


@query(
    f"""WITH {WORDS}, c AS (SELECT row_number() OVER (ORDER BY n DESC, word) AS r, word, n FROM w WHERE word NOT IN ({quoted(L.REPORT_WORDS)})), v AS (SELECT level AS key, count(*) AS n FROM w GROUP BY 1)
  SELECT '书名：A book' || chr(10) || '高频实词：' || (SELECT string_agg(word || '×' || n, '、' ORDER BY r) FROM c WHERE r <= 15) || chr(10) || '难度分布：' || (SELECT string_agg(key || '×' || n, '、' ORDER BY key) FROM v)
    || chr(10) || '词性分布：' || 'n.×' || (SELECT count(*) FROM w) AS prompt"""
)
def report_request(spark, d):
    w = catalog.words(spark, d).withColumn("pos", F.lit("noun"))
    return models.report_prompt(reports.statistics(w, w, catalog.sentences(spark, d), ngrams.collocations(readers.english(spark, d))), "A book")
