"""All queries over the driver's tables, with the same results as SQL.

Concepts map to tables as follows: English documents are the corpus, a
document's source is its book, its first and last lines are header and footer;
word frequencies come from the corpus; events give scores and reviews.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import expressions as X
from lexmill.functions import lexicon as L
from lexmill.operators import corpus, enrich, levels, ngrams, reports, reviews, senses
from lexmill.operators.ranking import durable
from lexmill.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def rows_sql(rows, *names: str) -> str:
    body = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, float)) else quoted([v]) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) t({', '.join(names)}))"


def case_sql(table: dict, key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = {quoted([k])} THEN {quoted([v]) if isinstance(v, str) else v}" for k, v in table.items()) + " END"


# ---- shared parts


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = corpus.word_table(readers.tokens(readers.english(spark, sf_dir)))
    return durable(w.withColumn("level", X.level_of_zipf("zipf")))  # read many times over: written once


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sentences(readers.english(spark, sf_dir))


TOKEN_RE = L.TOKEN_PATTERN.replace("'", "''")
PHRASE_RE = L.PHRASE_TOKEN_PATTERN.replace("'", "''")
TOK = f"""tok AS (
  SELECT doc_id, i - 1 AS pos, ts[i] AS token
  FROM (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{TOKEN_RE}') AS ts FROM documents WHERE lang = 'en')))"""
ZLEVEL = "CASE WHEN zipf >= 6.5 THEN 'A1' WHEN zipf >= 5.5 THEN 'A2' WHEN zipf >= 4.5 THEN 'B1' WHEN zipf >= 3.5 THEN 'B2' WHEN zipf >= 2.5 THEN 'C1' ELSE 'C2' END"
WORDS = f"""{TOK}, wn AS (SELECT lower(token) AS word, count(*) AS n FROM tok GROUP BY 1
), wt AS (SELECT sum(n) AS total FROM wn
), wz AS (SELECT word, n, round(log10(n * 1e9 / total), 6) AS zipf, CAST(total - n + 1 AS BIGINT) AS rank FROM wn, wt
), w AS (SELECT *, CAST(least(10, greatest(1, ceil((8 - zipf) * 2))) AS INTEGER) AS band, {ZLEVEL} AS level FROM wz)"""
ZQ = "(CASE WHEN zipf > 0 THEN 1 - 1 / (1 + exp(-(zipf - 5.5) / 1.5)) ELSE 0.5 END)"
FQ = "least(0.95, 0.05 + (band - 1) * 0.10)"
LQ = case_sql(L.LEVEL_DIFFICULTY, "level")
Q = f"round(greatest(0.05, least(0.95, 0.5 * {LQ} + 0.3 * {FQ} + 0.2 * {ZQ})), 6)"
DERIVED = "|".join(L.DERIVATIONAL_SUFFIXES)


# ---- tokens and words


@query(f"WITH {TOK} SELECT lower(token) AS word, count(*) AS n FROM tok WHERE lower(token) NOT IN ({quoted(L.STOP_WORDS)}) GROUP BY 1 ORDER BY n DESC, word LIMIT 50")
def tokens_top50(spark, d):
    w = readers.tokens(readers.english(spark, d)).select(F.lower("token").alias("word")).where(~F.col("word").isin(*L.STOP_WORDS))
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


@query(f"WITH {TOK} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT lower(token)) AS n_types FROM tok GROUP BY doc_id")
def token_counts_by_doc(spark, d):
    return corpus.document_sizes(readers.english(spark, d))


@query(f"WITH {WORDS} SELECT word, n, zipf, rank, band, level FROM w")
def word_table(spark, d):
    return words(spark, d)


NOISE = """(length(word) < 2 OR (regexp_full_match(word, '[a-z]{3,}') AND word = repeat(word[1], length(word)))
  OR (length(word) >= 6 AND length(word) % 2 = 0 AND regexp_full_match(word[1:2], '[a-z]{2}') AND word = repeat(word[1:2], length(word) // 2))
  OR (length(word) <= 3 AND (word[1] = word[2] OR (length(word) = 3 AND (word[1] = word[3] OR word[2] = word[3])))))"""


@query(f"WITH {WORDS} SELECT word FROM w WHERE {NOISE}")
def noise_words(spark, d):
    return words(spark, d).where(X.is_noise("word")).select("word")


@query(f"WITH {WORDS} SELECT word, regexp_matches(word, '.{{4,}}({DERIVED})$') AS derived FROM w")
def derivational_suffix(spark, d):
    return words(spark, d).select("word", X.has_derivational_suffix("word").alias("derived"))


_IRR = case_sql(L.IRREGULAR_LEMMAS, "word")
LEMMA = f"""{WORDS}, rule AS (
  SELECT word, rank, CASE WHEN word IN ({quoted(L.IRREGULAR_LEMMAS)}) THEN {_IRR} WHEN word IN ({quoted(L.S_WORDS)}) THEN word
    WHEN word LIKE '%ies' AND length(word) > 5 THEN left(word, length(word) - 3) || 'y' WHEN word IN ({quoted(L.ING_WORDS)}) THEN word
    WHEN word LIKE '%ing' AND length(word) > 5 THEN NULL WHEN word LIKE '%ed' AND length(word) > 4 THEN NULL
    WHEN length(word) > 4 AND regexp_matches(word, '(ches|shes|xes|zes|sses)$') THEN left(word, length(word) - 2)
    WHEN word LIKE '%s' AND word NOT LIKE '%ss' AND length(word) > 3 THEN left(word, length(word) - 1) ELSE word END AS lemma FROM w
), b AS (SELECT word, rank, CASE WHEN word LIKE '%ing' THEN left(word, length(word) - 3) ELSE left(word, length(word) - 2) END AS base FROM rule WHERE lemma IS NULL
), t AS (SELECT b.word, b.rank AS own, base, r0.rank AS r0, re.rank AS re, rs.rank AS rs
  FROM b LEFT JOIN w r0 ON r0.word = base LEFT JOIN w re ON re.word = base || 'e' AND NOT regexp_matches(base, '[aeiouy]$')
  LEFT JOIN w rs ON rs.word = left(base, length(base) - 1) AND length(base) >= 3 AND right(base, 1) = left(right(base, 2), 1) AND NOT regexp_matches(base, '[aeiouy]$')
), s AS (SELECT word, own,
  CASE WHEN re IS NOT NULL AND (r0 IS NULL OR re < r0) THEN base || 'e' WHEN rs IS NOT NULL AND (r0 IS NULL OR rs < r0) THEN left(base, length(base) - 1) ELSE base END AS stem,
  CASE WHEN re IS NOT NULL AND (r0 IS NULL OR re < r0) THEN re WHEN rs IS NOT NULL AND (r0 IS NULL OR rs < r0) THEN rs ELSE r0 END AS sr FROM t
), lem AS (SELECT word, lemma FROM rule WHERE lemma IS NOT NULL UNION ALL SELECT word, CASE WHEN sr IS NOT NULL AND sr < own THEN stem ELSE word END FROM s)"""


@query(f"WITH {LEMMA} SELECT word, lemma FROM lem")
def lemmas(spark, d):
    return corpus.lemmas(words(spark, d))


CLEAN = f"""{LEMMA}, ct AS (
  SELECT t.doc_id, t.pos, t.token, l.lemma FROM tok t JOIN lem l ON lower(t.token) = l.word
  WHERE l.word NOT IN ({quoted(L.STOP_WORDS)}) AND l.lemma NOT IN ({quoted(L.STOP_WORDS)}) AND length(l.lemma) >= 2
    AND NOT {NOISE.replace("word", "l.word")} AND NOT {NOISE.replace("word", "l.lemma")})"""


def clean_tokens(spark, d):
    ts = readers.tokens(readers.english(spark, d))
    return corpus.clean_tokens(ts, durable(corpus.lemmas(words(spark, d))))


@query(f"WITH {CLEAN} SELECT lemma, count(*) AS n, min(doc_id) AS first_doc FROM ct GROUP BY lemma")
def lemma_counts(spark, d):
    return corpus.lemma_table(readers.tokens(readers.english(spark, d)))


@query(f"WITH {CLEAN} SELECT doc_id, pos, lemma FROM (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY doc_id, pos) AS r FROM ct) WHERE r = 1")
def first_occurrences(spark, d):
    return corpus.first_of_each(clean_tokens(spark, d), "lemma", "doc_id", "pos").select("doc_id", "pos", "lemma")


@query(f"WITH {CLEAN} SELECT doc_id, pos, CAST((row_number() OVER (ORDER BY doc_id, pos) - 1) // 500 + 1 AS BIGINT) AS page_no FROM ct")
def synthetic_pages(spark, d):
    return corpus.paged_places(corpus.clean_places(readers.english(spark, d), durable(corpus.lemmas(words(spark, d)))))


@query(
    f"WITH {WORDS}, k AS (SELECT word FROM w WHERE n >= 5) SELECT w.word, CASE WHEN length(w.word) < 4 OR k.word IS NOT NULL THEN w.word ELSE coalesce(a.word, b.word, c.word, e.word, w.word) END AS recovered "
    "FROM w LEFT JOIN k ON w.word = k.word LEFT JOIN k a ON a.word = w.word || 'e' LEFT JOIN k b ON b.word = w.word || 'es' LEFT JOIN k c ON c.word = w.word || 'ed' LEFT JOIN k e ON e.word = w.word || 'd'"
)
def truncated_words(spark, d):
    w = words(spark, d)
    return corpus.recover_truncated(w, w.where("n >= 5"))


@query(
    f"WITH s AS (SELECT unnest(regexp_split_to_array(coalesce(text, ''), '[.!?]\\s*|\\n')) AS s FROM documents WHERE lang = 'en'), t AS (SELECT unnest(regexp_extract_all(s, '{TOKEN_RE}')[2:]) AS token FROM s) "
    "SELECT lower(token) AS word, count(*) FILTER (WHERE regexp_matches(token, '^[A-Z]')) AS upper, count(*) AS total FROM t GROUP BY 1 HAVING count(*) >= 2"
)
def capital_stats(spark, d):
    return corpus.capital_stats(readers.english(spark, d))


@query(ORACLES["capital_stats"].replace("HAVING count(*) >= 2", "HAVING count(*) >= 2 AND count(*) FILTER (WHERE regexp_matches(token, '^[A-Z]')) * 1.0 / count(*) > 0.6"))
def proper_nouns(spark, d):
    return corpus.proper_nouns(corpus.capital_stats(readers.english(spark, d)))


@query(
    f"WITH {LEMMA} SELECT l.word, l.lemma, l.word = l.lemma OR (regexp_matches(l.word, '(ed|ing|s|es)$') AND starts_with(l.word, l.lemma)) AS inflected, "
    f"w.n >= {L.TERM_FREQ} AS term, (regexp_matches(l.word, '.{{4,}}({DERIVED})$') AND NOT (l.word = l.lemma OR (regexp_matches(l.word, '(ed|ing|s|es)$') AND starts_with(l.word, l.lemma)))) OR w.n >= {L.TERM_FREQ} AS independent "
    "FROM lem l JOIN w ON l.word = w.word"
)
def form_decision(spark, d):
    w = words(spark, d)
    rows = corpus.lemmas(w).join(w.select("word", "n"), "word")
    ctx = F.create_map(F.lit("freq"), F.col("n").cast("string"))
    made = X.form_decision("word", "lemma", F.lit("NOUN"), F.lit("NOUN"), ctx)
    return rows.select("word", "lemma", X.is_inflection("word", "lemma").alias("inflected"), made["term"].alias("term"), made["independent"].alias("independent"))


# ---- pages and lines

LINES = "l AS (SELECT doc_id, source, i - 1 AS line_no, ls[i] AS line, len(ls) AS size FROM (SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE lang = 'en')))"
STRIP = r"regexp_replace({0}, '^[\s\v]+|[\s\v]+$', '', 'g')"
PAGE_NO = r"regexp_full_match(" + STRIP + r", '(?i)\d{{1,4}}|[ivxlcdm]{{1,8}}|\d{{1,4}}\s*/\s*\d{{1,4}}|[-–—]?\s*\d{{1,4}}\s*[-–—]?|page\s+\d{{1,4}}')"
KEY = STRIP.format(r"regexp_replace(lower({0}), '\d+', '#', 'g')")


@query(f"WITH x AS (SELECT DISTINCT unnest(regexp_split_to_array(coalesce(text, ''), '[ \\n]+')) AS piece FROM documents) SELECT piece FROM x WHERE {PAGE_NO.format('piece')}")
def page_numbers(spark, d):
    pieces = readers.table(spark, d, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), r"[ \n]+")).alias("piece")).distinct()
    return pieces.where(X.is_page_number("piece"))


@query(f"WITH {LINES} SELECT {KEY.format('line')} AS key, count(*) AS n FROM l GROUP BY 1 HAVING count(*) > 1")
def repeat_keys(spark, d):
    return readers.lines(readers.english(spark, d)).groupBy(X.repeat_key("line").alias("key")).agg(F.count("*").alias("n")).where("n > 1")


@query(
    f"WITH {LINES}, k AS (SELECT *, {KEY.format('line')} AS key, {STRIP.format('line')} AS s FROM l), c AS (SELECT *, count(*) FILTER (WHERE s <> '' AND length(s) <= 60) OVER (PARTITION BY doc_id, key) AS n FROM k) "
    f"SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM c WHERE NOT (size >= 3 AND s <> '' AND ({PAGE_NO.format('line')} OR (length(s) <= 60 AND n >= 3))) GROUP BY doc_id"
)
def repeated_line_strip(spark, d):
    return corpus.strip_repeated_lines(readers.english(spark, d))


@query(
    "WITH p AS (SELECT source AS book, doc_id AS page_no, ls[1] AS header, ls[-1] AS footer FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE lang = 'en') WHERE len(ls) >= 2), "
    f"k AS (SELECT *, {KEY.format('header')} AS hk, {KEY.format('footer')} AS fk FROM p), c AS (SELECT *, count(*) OVER (PARTITION BY book, hk) AS hn, count(*) OVER (PARTITION BY book, fk) AS fn, count(*) OVER (PARTITION BY book) AS t FROM k) "
    f"SELECT book, page_no, CASE WHEN {PAGE_NO.format('header')} OR hn >= greatest(3, (t + 1) // 2) THEN NULL ELSE header END AS header, CASE WHEN {PAGE_NO.format('footer')} OR fn >= greatest(3, (t + 1) // 2) THEN NULL ELSE footer END AS footer FROM c"
)
def header_footer_strip(spark, d):
    return corpus.strip_headers(readers.pages(readers.english(spark, d))).select("book", "page_no", "header", "footer")


@query("SELECT doc_id, md5(replace(coalesce(text, ''), '-' || chr(10), '')) AS repaired FROM documents")
def hyphen_join(spark, d):
    return readers.table(spark, d, "documents").select("doc_id", F.md5(X.joined_hyphens(F.coalesce("text", F.lit(""))).cast("binary")).alias("repaired"))


SANITIZE = (
    "CASE WHEN regexp_full_match(s, '\\d{1,4}') OR (regexp_matches(s, '(?i)^\\s*(chapter|part|page|contents|index)\\b') AND length(s) < 40) OR regexp_full_match(s, '.*\\.{3,}\\s*\\d+\\s*') THEN '' ELSE "
    + STRIP.format(
        "regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\\s*[\\[(]\\s*\\d+\\s*[\\])]\\s*|\\s*[\\[(][A-Z][A-Za-z]+\\s+\\d{4}[\\])]\\s*', ' ', 'g'), '[¹-¿⁰-₟†*]', '', 'g'), '(?i)\\s*\\((?:see|cf\\.|emphasis|trans\\.|note)[^)]*\\)\\s*', ' ', 'g'), '\\s{2,}', ' ', 'g')"
    )
    + " END"
)


@query(f"WITH {LINES}, t AS (SELECT DISTINCT line, {STRIP.format('line')} AS s FROM l) SELECT line, {SANITIZE} AS clean FROM t")
def example_sanitize(spark, d):
    return readers.lines(readers.english(spark, d)).select("line").distinct().select("line", X.clean_example("line").alias("clean"))


@query(
    f"WITH t AS (SELECT conv_id, {STRIP.format('text')} AS s FROM conversations WHERE text IS NOT NULL), c AS (SELECT conv_id, {SANITIZE} AS clean FROM t) "
    "SELECT conv_id, list_sort(list_distinct(list(clean) FILTER (WHERE clean <> ''))) AS examples FROM c GROUP BY conv_id"
)
def distinct_examples(spark, d):
    c = readers.table(spark, d, "conversations").where("text is not null").groupBy("conv_id").agg(F.collect_list("text").alias("xs"))
    return c.select("conv_id", F.array_sort(X.clean_examples("xs")).alias("examples"))


# ---- collocations

GRAMS = f"""x AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{PHRASE_RE}') AS ws FROM documents WHERE lang = 'en'
), one AS (SELECT w, count(*) AS c FROM (SELECT unnest(ws) AS w FROM x WHERE len(ws) >= 2) GROUP BY w
), tot AS (SELECT sum(c) AS t FROM one
), two AS (SELECT a, b, count(*) AS n FROM (SELECT ws[i] AS a, ws[i + 1] AS b FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM x WHERE len(ws) >= 2)) GROUP BY a, b)"""
COLLOC = f"""{GRAMS}, col AS (SELECT a || ' ' || b AS phrase, a, b, n, log2((n / t) / ((oa.c / t) * (ob.c / t))) AS s FROM two JOIN one oa ON oa.w = a JOIN one ob ON ob.w = b, tot
  WHERE n >= 2 AND a || ' ' || b NOT IN ({quoted(L.BLOCKED_PHRASES)}) AND NOT (a IN ({quoted(L.FUNCTION_WORDS)}) AND b IN ({quoted(L.FUNCTION_WORDS)})))"""


@query(f"WITH {GRAMS} SELECT a || ' ' || b AS phrase, n FROM two WHERE n >= 2")
def bigram_counts(spark, d):
    return ngrams.ngram_counts(readers.english(spark, d), 2).where("n >= 2").select(F.concat_ws(" ", "w1", "w2").alias("phrase"), "n")


@query(f"WITH {COLLOC} SELECT phrase, n, round(s, 2) AS pmi FROM col WHERE s > 0")
def bigram_pmi(spark, d):
    return ngrams.collocations(readers.english(spark, d)).select("phrase", "n", "pmi")


@query(f"WITH {COLLOC} SELECT phrase, n, round(s, 2) AS pmi FROM col WHERE s > 0 ORDER BY round(s, 2) DESC, n DESC, phrase LIMIT 60")
def bigram_pmi_top60(spark, d):
    return ngrams.top(ngrams.collocations(readers.english(spark, d)), 60).select("phrase", "n", "pmi")


@query(
    f"""WITH {GRAMS}, x3 AS (SELECT ws FROM x WHERE len(ws) >= 3), tri AS (SELECT a, b, c, count(*) AS n FROM (SELECT ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT ws, unnest(range(1, len(ws) - 1)) AS i FROM x3)) GROUP BY a, b, c HAVING count(*) >= 2
  ), two3 AS (SELECT a, b, count(*) AS n FROM (SELECT ws[i] AS a, ws[i + 1] AS b FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM x3)) GROUP BY a, b)
  SELECT a || ' ' || b || ' ' || c AS phrase, tri.n, round(log2(tri.n / two3.n * 2), 2) AS pmi FROM tri JOIN two3 USING (a, b)
  WHERE NOT (a IN ({quoted(L.FUNCTION_WORDS)}) AND b IN ({quoted(L.FUNCTION_WORDS)}) AND c IN ({quoted(L.FUNCTION_WORDS)})) AND log2(tri.n / two3.n * 2) > 0"""
)
def trigram_score(spark, d):
    return ngrams.collocations(readers.english(spark, d), 3).select("phrase", "n", "pmi")


@query(f"WITH {COLLOC}, bw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{PHRASE_RE}')) AS word FROM benchmark), m AS (SELECT phrase, a AS word, n, s FROM col UNION SELECT phrase, b, n, s FROM col) SELECT m.word, phrase, n, round(s, 2) AS pmi FROM m JOIN bw ON m.word = bw.word WHERE s > 0")
def collocations_for_word(spark, d):
    wanted = readers.table(spark, d, "benchmark").select(F.explode(X.phrase_tokens("text")).alias("word"))
    return ngrams.phrases_of(ngrams.collocations(readers.english(spark, d)), wanted)


# ---- difficulty and levels


@query(f"WITH {WORDS} SELECT word, round({ZQ}, 6) AS q FROM w")
def zipf_quantile(spark, d):
    return words(spark, d).select("word", F.round(X.zipf_difficulty("zipf"), 6).alias("q"))


@query(f"WITH {WORDS} SELECT level, count(*) AS n FROM w GROUP BY level")
def zipf_level_bridge(spark, d):
    return words(spark, d).groupBy("level").agg(F.count("*").alias("n"))


@query(f"WITH {WORDS} SELECT word, CAST(round({FQ}, 6) AS DOUBLE) AS family_q, CAST({LQ} AS DOUBLE) AS level_q FROM w")
def family_and_level_quantile(spark, d):
    return words(spark, d).select("word", F.round(X.family_difficulty("band"), 6).alias("family_q"), X.mapping(L.LEVEL_DIFFICULTY, F.col("level")).alias("level_q"))


@query(f"WITH {WORDS} SELECT word, {Q} AS q FROM w")
def difficulty_q(spark, d):
    return words(spark, d).select("word", F.round(X.difficulty("zipf", "band", "level"), 6).alias("q"))


@query(f"WITH {WORDS}, t AS (SELECT word, CAST(least(9, greatest(1, ceil({Q} / (1.0 / 9)))) AS INTEGER) AS tier FROM w) SELECT tier, 'hsl(' || CAST(CAST(round_even(220 - (tier - 1) * (220.0 / 9), 0) AS INTEGER) AS VARCHAR) || ', 65%, 45%)' AS colour, count(*) AS n FROM t GROUP BY tier")
def tiers(spark, d):
    q = F.round(X.difficulty("zipf", "band", "level"), 6)
    return words(spark, d).select(q.alias("q")).select(X.tier("q").alias("tier"), X.tier_colour("q").alias("colour")).groupBy("tier", "colour").agg(F.count("*").alias("n"))


def scores(spark, d):
    exams = F.array(*map(F.lit, [*L.EXAM_ZIPF, "other"]))
    e = readers.table(spark, d, "events")
    return e.select("event_id", F.element_at(exams, (F.col("event_id") % 9 + 1).cast("int")).alias("exam"), (F.col("event_id") % 1400 / 2).alias("score"))


SCORES = f"sc AS (SELECT event_id, ([{quoted([*L.EXAM_ZIPF, 'other'])}])[CAST(event_id % 9 + 1 AS INTEGER)] AS exam, (event_id % 1400) / 2.0 AS score FROM events)"
BANDS = rows_sql(L.EXAM_BANDS, "exam", "lo", "hi", "cefr")


def steps_sql(table: dict) -> str:
    return rows_sql([(e, s, v) for e, x in table.items() for s, v in x.items()], "exam", "lo", "value")


@query(f"WITH {SCORES} SELECT event_id, sc.exam, CAST(score AS DOUBLE) AS score, coalesce(b.cefr, 'C2') AS cefr FROM sc LEFT JOIN {BANDS} b ON sc.exam = b.exam AND score BETWEEN lo AND hi")
def exam_band_range_join(spark, d):
    return levels.level_of_score(scores(spark, d)).select("event_id", "exam", "score", "cefr")


_ASOF = "(SELECT max_by(value, lo) FROM {t} s WHERE s.exam = sc.exam AND s.lo <= sc.score)"


@query(f"WITH {SCORES} SELECT event_id, exam, CASE WHEN exam = 'other' THEN 'C2' ELSE coalesce({_ASOF.format(t=steps_sql(L.EXAM_LEVELS))}, 'A1') END AS cefr FROM sc")
def exam_as_of(spark, d):
    return levels.learned_level(scores(spark, d)).select("event_id", "exam", "cefr")


@query(f"WITH {SCORES} SELECT event_id, exam, CAST(CASE WHEN exam = 'other' THEN 4.0 ELSE coalesce({_ASOF.format(t=steps_sql(L.EXAM_ZIPF))}, {case_sql({e: float(min(t.items())[1]) for e, t in L.EXAM_ZIPF.items()}, 'exam')}) END AS DOUBLE) AS zipf_threshold FROM sc")
def exam_zipf_threshold(spark, d):
    return levels.zipf_threshold(scores(spark, d)).select("event_id", "exam", "zipf_threshold")


@query(
    f"WITH {SCORES} SELECT event_id, round(CAST(CASE WHEN exam = 'other' THEN 0.85 ELSE " + case_sql(L.LEVEL_SHARE, f"coalesce({_ASOF.format(t=steps_sql(L.EXAM_LEVELS))}, 'A1')") + " END AS DOUBLE), 6) AS u FROM sc WHERE exam <> 'tem8' "
    "UNION ALL SELECT event_id, round(least(0.95, greatest(0.10, (event_id % 12000 - 1500) / 8500.0)), 6) FROM sc WHERE exam = 'tem8'"
)
def user_level_u(spark, d):
    s = scores(spark, d)
    sized = F.col("exam") == "tem8"  # these users state a vocabulary instead of a score
    asked = s.select("event_id", F.when(~sized, F.col("exam")).alias("exam"), F.when(~sized, F.col("score")).alias("score"), F.when(sized, (F.col("event_id") % 12000).cast("double")).alias("vocabulary"))
    return levels.user_level(asked).select("event_id", F.round("u", 6).alias("u"))


@query(f"WITH p AS {rows_sql([*L.PRESETS, ('none', None, None)], 'preset', 'exam', 'score')} SELECT preset, coalesce(p.exam, 'all') AS exam, CAST(score AS DOUBLE) AS score, coalesce(b.cefr, 'C2') AS cefr FROM p LEFT JOIN {BANDS} b ON p.exam = b.exam AND score BETWEEN lo AND hi")
def preset_lookup(spark, d):
    return levels.preset_levels(levels.literal_table(spark, [(p[0],) for p in L.PRESETS] + [("none",)], ("preset", "string"))).select("preset", "exam", "score", "cefr")


@query(f"SELECT exam, string_agg(printf('%.1f', CAST(lo AS DOUBLE)) || '-' || printf('%.1f', CAST(hi AS DOUBLE)) || '→' || cefr, '；' ORDER BY lo) AS bands FROM {BANDS} GROUP BY exam")
def level_matrix(spark, d):
    return levels.level_matrix(spark)


# ---- filters

_ORD = "list_position(['A1', 'A2', 'B1', 'B2', 'C1', 'C2'], level)"


@query(f"WITH {WORDS} SELECT word FROM w WHERE n BETWEEN 2 AND 100")
def frequency_filter(spark, d):
    return words(spark, d).where(levels.frequency_between(2, 100)).select("word")


@query(f"WITH {WORDS} SELECT word FROM w WHERE {_ORD} BETWEEN 2 AND 4")
def level_range_filter(spark, d):
    return words(spark, d).where(levels.level_between("A2", "B2")).select("word")


@query(f"WITH {WORDS} SELECT word FROM w WHERE {_ORD} >= 4")
def level_filter_learn(spark, d):
    return words(spark, d).where(levels.level_for("B2", "learn")).select("word")


@query(f"WITH {WORDS} SELECT word FROM w WHERE {_ORD} <= 4")
def level_filter_master(spark, d):
    return words(spark, d).where(levels.level_for("B2", "master")).select("word")


@query(f"WITH {WORDS} SELECT word FROM w WHERE {_ORD} <= 4")
def list_level_filter(spark, d):
    return words(spark, d).withColumn("level", F.when(F.col("n") % 2 == 0, F.col("level")).otherwise("")).where(levels.list_level_at_most("B2")).select("word")


@query(f"WITH {WORDS} SELECT word FROM w WHERE zipf >= 4.23")
def zipf_floor_filter(spark, d):
    return words(spark, d).where(levels.zipf_floor(4.23)).select("word")


@query(f"WITH {WORDS} SELECT word FROM w WHERE word NOT IN ({quoted(L.FILTER_WORDS)})")
def function_word_filter(spark, d):
    return words(spark, d).where(levels.no_function_word()).select("word")


_NOTABLE = f"(word IN ({quoted(L.NOTABLE_WORDS)}) OR (length(word) >= 8 AND NOT regexp_matches(word, '^({'|'.join(L.PLAIN_PREFIXES)})') AND regexp_matches(word, '{'|'.join(L.METAPHOR_ROOTS)}') AND zipf < 4.5))"


@query(f"WITH {WORDS} SELECT word FROM w WHERE {_NOTABLE}")
def notable_words(spark, d):
    return words(spark, d).where(X.is_notable("word", "zipf")).select("word")


_JF, _JK = f"[{quoted(L.JOIN_FUNCTION)}]", f"[{quoted(dict.fromkeys([*L.JOIN_FUNCTION, *L.JOIN_CONTENT]))}]"
_JOINED = f"(word IN ({quoted(L.JOINED)}) OR (length(word) >= 5 AND NOT list_contains({_JK}, word) AND len(list_filter(range(2, greatest(2, length(word) - 2)), lambda i: (list_contains({_JF}, word[1:i]) AND list_contains({_JK}, word[i + 1:])) OR (list_contains({_JF}, word[i + 1:]) AND list_contains({_JK}, word[1:i])))) > 0))"


@query(f"WITH {WORDS} SELECT word FROM w WHERE {_JOINED}")
def joined_words(spark, d):
    return words(spark, d).where(X.is_joined_word("word")).select("word")


_CLEAN_WORD = f"(length(word) BETWEEN 3 AND 30 AND NOT regexp_matches(word, '[0-9]') AND (NOT contains(word, '''') OR (ends_with(word, '''s') AND length(word) <= 10)) AND NOT contains(word, '-') AND NOT {_JOINED})"
_CLEAN_WORDS = f"(SELECT * FROM w WHERE {_CLEAN_WORD} UNION ALL SELECT w.* FROM w JOIN w a ON a.word = string_split(w.word, '-')[1] AND a.zipf > 2 JOIN w b ON b.word = string_split(w.word, '-')[2] AND b.zipf > 2 WHERE contains(w.word, '-') AND len(string_split(w.word, '-')) = 2 AND length(w.word) BETWEEN 3 AND 30 AND NOT contains(w.word, ''''))"


@query(f"WITH {WORDS} SELECT word FROM {_CLEAN_WORDS}")
def clean_words(spark, d):
    return levels.clean_words(words(spark, d)).select("word")


@query(f"WITH {WORDS} SELECT word, n FROM w WHERE (word NOT IN ({quoted(L.FILTER_WORDS)}) AND n >= 2 AND zipf >= 0) OR word IN ({quoted(L.POLYSEMOUS)})")
def classic_filter(spark, d):
    return levels.classic_filter(words(spark, d)).select("word", "n")


_IMPORTANT = f"imp AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{PHRASE_RE}')) AS word FROM benchmark)"
_KEPT = f"""{WORDS}, {_IMPORTANT}, pool AS (SELECT c.word, n, {Q} AS q, (i.word IS NOT NULL OR {_NOTABLE.replace("word", "c.word")}) AND n >= 2 AS wanted FROM {_CLEAN_WORDS} c LEFT JOIN imp i ON c.word = i.word WHERE c.word NOT IN ({quoted(L.FILTER_WORDS)})
), kept AS (SELECT word, n, q, CASE WHEN q >= 0.75 AND wanted THEN 'both' WHEN q >= 0.75 THEN 'q' WHEN wanted THEN 'important' END AS kept_by FROM pool)"""


def important(spark, d):
    return readers.table(spark, d, "benchmark").select(F.explode(X.phrase_tokens("text")).alias("word"))


@query(
    f"WITH {_KEPT}, k AS (SELECT * FROM kept WHERE kept_by IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY kept_by ORDER BY q DESC, word) AS r, (SELECT count(*) FROM k) AS t, (SELECT count(*) FROM k WHERE kept_by = 'important') AS i FROM k) "
    "SELECT word, n, q, kept_by FROM r WHERE kept_by <> 'important' OR i <= greatest(1, CAST(floor(t * 0.25) AS BIGINT)) OR r <= greatest(1, CAST(floor(t * 0.25) AS BIGINT))"
)
def quantile_filter(spark, d):
    return levels.quantile_filter(words(spark, d), 0.75, important(spark, d))


@query(
    f"WITH {WORDS}, k AS (SELECT word, n, {Q} AS q, CASE WHEN n % 3 = 0 THEN 'q' ELSE 'important' END AS kept_by FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY kept_by ORDER BY q DESC, word) AS r, (SELECT count(*) FROM k) AS t FROM k) "
    "SELECT word, n, q, kept_by FROM r WHERE kept_by <> 'important' OR r <= CAST(floor(t * 0.25) AS BIGINT)"
)
def ratio_cap(spark, d):
    k = words(spark, d).select("word", "n", F.round(X.difficulty("zipf", "band", "level"), 6).alias("q"), F.when(F.col("n") % 3 == 0, "q").otherwise("important").alias("kept_by"))
    return levels.capped(k, 0.25)


_PHEN = "len(list_filter([{0}], lambda p: contains(lower(text), p)))"


@query(f"SELECT conv_id, turn, {_PHEN.format(quoted(L.SET_PHRASES))} AS phrases, {_PHEN.format(quoted(L.IDIOMS))} AS idioms FROM (SELECT conv_id, turn, coalesce(text, '') || ' we look forward to work out on cloud nine' AS text FROM conversations)".replace("len(", "CAST(len(").replace("p)))", "p))) AS INTEGER)"))
def phenomena(spark, d):
    c = readers.table(spark, d, "conversations").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" we look forward to work out on cloud nine")))
    p = X.phenomena(F.lit("spring"), "text")
    return c.select("conv_id", "turn", F.size(p["phrases"]).alias("phrases"), F.size(p["idioms"]).alias("idioms"))


# ---- dictionaries (made from the corpus, as no dictionary files ship with the tables)


def dictionaries(spark, d, w=None):
    w = words(spark, d) if w is None else w
    pick = lambda k: w.where(F.length("word") % 3 != k)
    return {
        "cmu": pick(0).select("word", F.array(F.lit("HH"), F.lit("AH0"), F.lit("L"), F.lit("OW1")).alias("phones")),
        "cefr": pick(1).select("word", F.lit("noun").alias("pos"), F.col("level").alias("cefr"), F.concat(F.lit("gloss of "), "word").alias("gloss_en"), F.lit("").alias("example")),
        "oxford": pick(2).select("word", F.lit("n").alias("pos"), F.lit("B2").alias("cefr")),
        "bilingual": w.where(F.length("word") % 2 == 0).select("word", F.lit("x").alias("phonetic"), F.concat(F.lit("n. [law]  "), "word").alias("definition_en"), F.lit("vt. 中文").alias("translation_zh"), F.lit("vt").alias("pos")),
        "wiktionary": w.where(F.length("word") % 5 == 0).select("word", F.concat(F.lit("wiki "), "word").alias("gloss_en"), F.lit("noun").alias("pos"), F.lit("root").alias("etymology")),
    }


@query(
    f"""WITH {WORDS} SELECT word, CASE WHEN length(word) % 3 <> 0 THEN '/hʌlˈoʊ/' WHEN length(word) % 2 = 0 THEN 'x' END AS ipa,
  CASE WHEN length(word) % 3 <> 1 THEN 'gloss of ' || word WHEN length(word) % 5 = 0 THEN 'wiki ' || word WHEN length(word) % 2 = 0 THEN '〔law〕 ' || word END AS gloss_en,
  CASE WHEN length(word) % 2 = 0 THEN '中文' END AS gloss_zh, CASE WHEN length(word) % 3 <> 1 OR length(word) % 5 = 0 THEN 'noun' WHEN length(word) % 2 = 0 THEN 'v.' END AS pos,
  CASE WHEN length(word) % 3 <> 2 AND length(word) % 3 <> 1 THEN greatest('B2', level) WHEN length(word) % 3 <> 2 THEN 'B2' ELSE level END AS level,
  CASE WHEN length(word) % 5 = 0 THEN 'root' END AS etymology, CASE WHEN length(word) % 3 <> 1 THEN 'cefr' WHEN length(word) % 5 = 0 THEN 'wiki' WHEN length(word) % 2 = 0 THEN 'bilingual' END AS gloss_source FROM w"""
)
def wordbank_lookup(spark, d):
    t = dictionaries(spark, d)
    return levels.look_up(words(spark, d).select("word"), t["cmu"], t["cefr"], t["oxford"], t["bilingual"], t["wiktionary"])


@query(f"WITH {WORDS} SELECT 'bilingual' AS source, count(*) FILTER (WHERE length(word) % 2 = 0) AS words FROM w UNION ALL SELECT 'cefr', count(*) FILTER (WHERE length(word) % 3 <> 1) FROM w UNION ALL SELECT 'cmu', count(*) FILTER (WHERE length(word) % 3 <> 0) FROM w UNION ALL SELECT 'oxford', count(*) FILTER (WHERE length(word) % 3 <> 2) FROM w UNION ALL SELECT 'wiktionary', count(*) FILTER (WHERE length(word) % 5 = 0) FROM w")
def dictionary_coverage(spark, d):
    return levels.coverage(dictionaries(spark, d))


@query(f"WITH {WORDS} SELECT word, greatest('B1', level) AS hardest, least('B1', level) AS easiest, CASE WHEN level = 'x' THEN '' ELSE level END AS majority FROM w")
def level_conflict(spark, d):
    three = F.array(F.lit("B1"), F.col("level"), F.lit("unknown"))
    return words(spark, d).select("word", levels.level_conflict(three).alias("hardest"), levels.level_conflict(three, "easiest").alias("easiest"), levels.level_conflict(F.array("level", F.lit("B1"), "level"), "majority").alias("majority"))


@query(f"WITH {WORDS} SELECT word, CASE WHEN n > 5 THEN 'bank' ELSE word END AS first, CASE WHEN n > 5 THEN 'bank；本书义：' || word ELSE word END AS both_of FROM w")
def gloss_conflict(spark, d):
    bank = F.when(F.col("n") > 5, "bank").otherwise("")
    return words(spark, d).select("word", levels.gloss_conflict(bank, F.col("word")).alias("first"), levels.gloss_conflict(bank, F.col("word"), "both").alias("both_of"))


@query(
    f"WITH {WORDS}, f AS (SELECT word, band FROM w WHERE n >= 3) SELECT w.word, coalesce(f0.band, "
    + ", ".join(f"f{i}.band" for i in range(1, 7))
    + ") AS band FROM w LEFT JOIN f f0 ON f0.word = w.word "
    + " ".join(f"LEFT JOIN f f{i} ON ends_with(w.word, '{s}') AND length(w.word) > {len(s) + 2} AND f{i}.word = left(w.word, length(w.word) - {len(s)})" for i, s in enumerate(("s", "es", "ed", "ing", "er", "est"), 1))
)
def family_band(spark, d):
    w = words(spark, d)
    return levels.family_bands(w.select("word"), w.where("n >= 3"))


@query(f"SELECT pos, coalesce({case_sql(L.POS_CODES, 'lower(rtrim(pos, chr(46)))')}, pos) AS code FROM {rows_sql([(x,) for x in [*L.POS_CODES, 'n.', 'VT.', 'xyz']], 'pos')}")
def pos_normalize(spark, d):
    return levels.literal_table(spark, [(x,) for x in [*L.POS_CODES, "n.", "VT.", "xyz"]], ("pos", "string")).select("pos", X.pos_code("pos").alias("code"))


@query(f"WITH {WORDS} SELECT word, '〔law〕 ' || word || chr(10) || 'in a way' AS gloss FROM w")
def gloss_clean(spark, d):
    return words(spark, d).select("word", X.clean_gloss(F.concat(F.lit("n. [law]   "), "word", F.lit("\\n\\nr in  a way"))).alias("gloss"))


def _first_affix(names, rest: str, test: str) -> str:
    return "CASE " + " ".join(f"WHEN {test.format(rest=rest, a=quoted([a]))} AND length({rest}) - {len(a)} > 2 THEN {quoted([a])}" for a in names) + " END"


@query(
    f"WITH {WORDS}, p AS (SELECT word, {_first_affix(L.PREFIXES, 'word', 'starts_with({rest}, {a})')} AS prefix FROM w WHERE length(word) >= 5), r AS (SELECT *, word[length(coalesce(prefix, '')) + 1:] AS rest FROM p), "
    f"s AS (SELECT *, {_first_affix(L.SUFFIXES, 'rest', 'ends_with({rest}, {a})')} AS suffix, array_to_string(list_filter([{quoted(L.ROOTS)}], lambda x: contains(rest, x)), ',') AS roots FROM r) SELECT word, prefix, suffix, roots FROM s WHERE prefix IS NOT NULL OR suffix IS NOT NULL OR roots <> ''"
)
def morpheme_split(spark, d):
    m = words(spark, d).select("word", X.morphemes("word").alias("m")).where("m is not null")
    return m.select("word", "m.prefix", "m.suffix", F.array_join("m.roots", ",").alias("roots"))


#: Letters as pronunciation symbols, vowels with stress.
_PHONES = {c: c.upper() for c in "abcdefghijklmnopqrstuvwxyz"} | {"a": "AE1", "e": "EH0", "i": "IH2", "o": "OW1", "u": "UW0"}
_SOUNDS = {c: {"1": "ˈ", "2": "ˌ"}.get(p[-1], "") + L.ARPABET.get(p[:-1], p[:-1]) if p[-1].isdigit() else L.ARPABET.get(p, p) for c, p in _PHONES.items()}
_SOUND = "(" + case_sql(_SOUNDS, "word[i]") + ")"


@query(
    f"WITH {WORDS}, a AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w WHERE regexp_full_match(word, '[a-z]+')) "
    f"SELECT word, '/' || string_agg({_SOUND}, '' ORDER BY i) || '/' AS ipa, '/' || coalesce(string_agg({_SOUND}, '' ORDER BY i) FILTER (WHERE NOT (contains('aeiou', word[i]) AND i < length(word) AND contains('aeiou', word[i + 1]))), '') || '/' AS ipa_lossy FROM a GROUP BY word"
)
def arpabet_ipa(spark, d):
    w = words(spark, d).where(F.col("word").rlike("^[a-z]+$")).select("word", F.transform(F.split("word", ""), lambda c: X.mapping(_PHONES, c)).alias("phones"))
    return w.select("word", X.ipa("phones").alias("ipa"), X.ipa("phones", keep_adjacent=False).alias("ipa_lossy"))


@query(f"WITH t AS (SELECT page_id, regexp_extract(url, '[^/]*$', 0) AS name, CAST(regexp_matches(lower(regexp_extract(url, '[^/]*$', 0)), '{L.SUBJECTS[0][0]}') AS BOOLEAN) AS p FROM pages WHERE url IS NOT NULL) SELECT page_id, name, CASE WHEN p THEN 'philosophy,phenomenology' " + " ".join(f"WHEN regexp_matches(lower(name), '{r}') THEN {quoted([','.join(v)])}" for r, v in L.SUBJECTS[1:]) + " ELSE 'philosophy,biology,physics,chemistry' END AS subjects FROM t")
def subject_guess(spark, d):
    return readers.table(spark, d, "pages").where("url is not null").select("page_id", F.regexp_extract("url", r"[^/]*$", 0).alias("name"), F.array_join(X.subjects("url"), ",").alias("subjects"))


@query("SELECT page_id, regexp_matches(url, '[_-]{2,}') OR contains(url, ' -- ') OR regexp_matches(lower(url), 'archive|libgen|anna') OR regexp_matches(url, '(?i)\\bISBN\\b') OR regexp_matches(url, '\\(\\d{4},') AS file_like FROM pages WHERE url IS NOT NULL")
def file_like_titles(spark, d):
    return readers.table(spark, d, "pages").where("url is not null").select("page_id", X.looks_like_file_name("url").alias("file_like"))


# ---- senses and replies


def sense_items(spark, d):
    """Whole texts; a word is a role within 8 turns of 8 conversations, so its senses stay a handful at any size."""
    c = readers.table(spark, d, "conversations").where("text is not null")
    block = F.concat_ws("_", "role", F.floor(F.col("conv_id") / 8), F.floor(F.col("turn") / 8))
    return c.select(block.alias("word"), "text", F.concat(F.lit("dict"), F.col("turn") % 3).alias("source"), F.lit("en").alias("lang"), (F.col("conv_id") * 100 + F.col("turn")).alias("ord"))


@query()
def merge_senses(spark, d):
    return senses.merge_senses(sense_items(spark, d))


@query(
    "WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS ts FROM benchmark WHERE text IS NOT NULL), g AS (SELECT item_id, unnest(ts) AS x FROM t), "
    "p AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS c FROM g a JOIN g b ON a.x = b.x AND a.item_id < b.item_id GROUP BY 1, 2) SELECT p.a, p.b, round(c / (len(ta.ts) + len(tb.ts) - c), 6) AS jaccard FROM p JOIN t ta ON ta.item_id = p.a JOIN t tb ON tb.item_id = p.b WHERE c / (len(ta.ts) + len(tb.ts) - c) >= 0.2"
)
def jaccard_pairs(spark, d):
    t = readers.table(spark, d, "benchmark").where("text is not null").select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("ts"))
    return senses.similar_pairs(t, 0.2).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(f"WITH {CLEAN} SELECT doc_id, pos, CASE WHEN length(lemma) % 7 = 0 THEN lemma || 'e' ELSE lemma END AS lemma FROM ct WHERE length(lemma) % 7 NOT IN (1, 2)")
def apply_decisions(spark, d):
    w = words(spark, d)
    k = F.length("word") % 7
    made = w.select("word", F.when(k == 0, "repair").when(k == 1, "noise").when(k == 2, "proper").otherwise("none").alias("action"), F.concat("word", F.lit("e")).alias("replacement"))
    lem = corpus.lemmas(w).select(F.col("lemma").alias("word"))
    k2 = F.length("word") % 7
    more = lem.distinct().join(w.select("word"), "word", "left_anti").select("word", F.when(k2 == 0, "repair").when(k2 == 1, "noise").when(k2 == 2, "proper").otherwise("none").alias("action"), F.concat("word", F.lit("e")).alias("replacement"))
    return senses.apply_decisions(clean_tokens(spark, d), made.unionByName(more)).select("doc_id", "pos", "lemma")


@query(f"WITH {WORDS} SELECT word, n FROM w WHERE zipf < 4.0 AND word NOT IN (SELECT unnest(regexp_extract_all(lower(text), '{PHRASE_RE}')) FROM benchmark) ORDER BY n DESC, word LIMIT 200")
def suspects(spark, d):
    return words(spark, d).where("zipf < 4.0").join(important(spark, d).distinct(), "word", "left_anti").orderBy(F.desc("n"), "word").limit(200).select("word", "n")


@query(f"WITH {WORDS}, {_IMPORTANT} SELECT word, n FROM w WHERE word IN (SELECT word FROM imp) OR (n >= 3 AND zipf >= 3) ORDER BY n DESC, word LIMIT 150")
def book_terms_fallback(spark, d):
    w = words(spark, d).join(important(spark, d).distinct().withColumn("__i", F.lit(True)), "word", "left")
    return w.where("__i is not null or (n >= 3 and zipf >= 3)").orderBy(F.desc("n"), "word").limit(150).select("word", "n")


@query(f"WITH {WORDS} SELECT word, CAST((row_number() OVER (ORDER BY word) - 1) // 20 AS BIGINT) AS batch FROM w")
def batch_numbers(spark, d):
    return senses.batches(words(spark, d).select("word"), 20, "word")


def _reply(ws: list[str]) -> str:
    import json

    return "Here: " + json.dumps([{"headword": w, "pos": "n.", "gloss_zh": "", "gloss_en": f"about {w}", "ipa": {}, "cefr_level": "B1"} for w in ws] + [{"headword": "unasked"}]) + " done"


@query()
def batch_enrich(spark, d):
    top = words(spark, d).orderBy(F.desc("n"), "word").limit(150)
    entries = top.select("word", F.lit("").alias("pos"), F.lit("旧").alias("gloss_zh"), F.lit("old").alias("gloss_en"))
    return senses.merge_replies(entries, senses.parse_replies(senses.ask(entries, 20, _reply)))


@query(f"WITH {WORDS} SELECT word, CASE WHEN n % 5 = 0 THEN 'fixed' ELSE 'old' END AS gloss_en FROM w WHERE n % 7 <> 0")
def review_fixes(spark, d):
    w = words(spark, d)
    entries = w.select("word", F.lit("old").alias("gloss_en"))
    fix = w.where("n % 5 = 0").select("word", F.lit("gloss_bilingual.gloss_en").alias("field"), F.lit("fixed").alias("after"), F.lit("set").alias("action"), F.lit(1).alias("ord"))
    gone = w.where("n % 7 = 0").select("word", F.lit("").alias("field"), F.lit("").alias("after"), F.lit("remove").alias("action"), F.lit(2).alias("ord"))
    return senses.apply_fixes(entries, fix.unionByName(gone))


# ---- reports


@query(f"WITH {WORDS} SELECT row_number() OVER (ORDER BY n DESC, word) AS rank, word, n FROM w WHERE word NOT IN ({quoted(L.REPORT_WORDS)}) ORDER BY n DESC, word LIMIT 50".replace("row_number() OVER (ORDER BY n DESC, word)", "CAST(row_number() OVER (ORDER BY n DESC, word) AS INTEGER)"))
def frequency_report(spark, d):
    return reports.top_words(words(spark, d).where(~F.col("word").isin(*L.REPORT_WORDS)))


@query(f"WITH {WORDS} SELECT level, count(*) AS n, CAST(round_even(count(*) * 100 / (SELECT count(*) FROM w), 0) AS INTEGER) AS pct FROM w GROUP BY level")
def level_distribution(spark, d):
    return reports.distribution(words(spark, d), "level")


SENT = f"se AS (SELECT len(regexp_extract_all(s, '{TOKEN_RE}')) AS size FROM (SELECT unnest(regexp_split_to_array(coalesce(text, ''), '[.!?]+\\s*|\\n')) AS s FROM documents WHERE lang = 'en'))"


@query(f"WITH {WORDS}, {SENT} SELECT CAST(sum(n) AS BIGINT) AS tokens, count(*) AS unique, round(count(*) / sum(n), 3) AS ttr, (SELECT round(avg(size), 1) FROM se WHERE size > 0) AS avg_sentence, (SELECT CAST(max(size) AS INTEGER) FROM se WHERE size > 0) AS longest_sentence FROM w")
def corpus_stats(spark, d):
    return reports.corpus_stats(words(spark, d), sentences(spark, d))


@query(f"WITH {WORDS} SELECT count(*) FILTER (WHERE n >= 10) AS high, count(*) FILTER (WHERE n BETWEEN 2 AND 9) AS middle, count(*) FILTER (WHERE n = 1) AS single FROM w")
def frequency_bands(spark, d):
    return reports.frequency_bands(words(spark, d))


@query(f"WITH {WORDS}, e AS (SELECT word, n, CASE WHEN n % 2 = 0 THEN 'mastered' ELSE 'new' END AS status FROM w WHERE contains(word, 'an')) SELECT word, n, status FROM e WHERE status = 'new' ORDER BY word LIMIT 20 OFFSET 20")
def search_page(spark, d):
    w = words(spark, d)
    states = w.where("n % 2 = 0").select("word", F.lit("mastered").alias("status"))
    return reports.search(w.select("word", "n", F.lit(None).cast("string").alias("gloss")), states, "an", "new", page=2).select("word", "n", "status")


@query(f"WITH {WORDS} SELECT word, CASE WHEN n % 2 = 0 THEN 'gloss,' ELSE '' END || 'ipa' AS missing FROM w")
def missing_fields(spark, d):
    e = words(spark, d).select("word", F.when(F.col("n") % 2 == 0, " ").otherwise("g").alias("gloss"), F.lit(None).cast("string").alias("ipa"))
    return reports.missing_fields(e, ["word", "gloss", "ipa"]).select("word", F.array_join("missing", ",").alias("missing"))


@query(f"WITH {WORDS} SELECT word, '<div class=\"entry\"><b>' || word || '</b><span style=\"color:' || {case_sql(L.LEVEL_COLOURS, 'level')} || '\">' || level || '</span> ×' || n || '<p>a &lt;b&gt; &amp; c<br>' || word || '</p></div>' AS html FROM w WHERE n > 1")
def entry_html(spark, d):
    gloss = F.when(F.col("n") > 1, F.concat(F.lit("a <b> & c\n"), "word")).otherwise("")
    return reports.entry_html(words(spark, d).select("word", "n", "level", gloss.alias("gloss")))


@query("SELECT page_id, md5(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages")
def html_escape(spark, d):
    return readers.table(spark, d, "pages").select("page_id", F.md5(X.html_escape("html").cast("binary")).alias("escaped"))


@query(f"WITH {WORDS} SELECT replace(upper(word[1]), 'ẞ', 'SS') AS letter, min(word) AS first_word, count(*) AS words FROM w GROUP BY 1")
def letter_heads(spark, d):
    return reports.letter_heads(words(spark, d))


@query("SELECT conv_id AS book, left(string_agg('[p' || turn || '] ' || left(text, 300), chr(10) ORDER BY turn), 6000) AS head FROM conversations WHERE turn <= 15 AND text IS NOT NULL GROUP BY conv_id")
def first_pages(spark, d):
    c = readers.table(spark, d, "conversations").where("text is not null")
    return readers.first_pages(c.select(F.col("conv_id").alias("book"), F.col("turn").alias("page_no"), F.col("text").alias("body")))


# ---- spaced repetition

_QUALITY = {"purchase": 5, "signup": 4, "click": 3, "view": 2, "error": 1}


def event_reviews(spark, d):
    e = readers.table(spark, d, "events")
    return e.select("user_id", "ts", "event_id", X.mapping(_QUALITY, F.col("event_type")).alias("quality")).where("quality is not null")


@query(
    f"""WITH RECURSIVE r AS (SELECT user_id, {case_sql(_QUALITY, 'event_type')} AS q, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM events WHERE event_type IS NOT NULL
), s AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(2.5 AS DOUBLE) AS ease, 0 AS "interval", 0 AS reps, 'new' AS status FROM (SELECT DISTINCT user_id FROM r)
  UNION ALL SELECT s.user_id, r.k, CAST(greatest(1.3, round(s.ease + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02), 2)) AS DOUBLE),
  CASE WHEN q < 3 THEN 1 WHEN s.reps = 0 THEN 1 WHEN s.reps = 1 THEN 6 ELSE greatest(1, CAST(round_even(least(s."interval" * s.ease, 2147483647), 0) AS INTEGER)) END, CASE WHEN q < 3 THEN 0 ELSE s.reps + 1 END,
  CASE WHEN q >= 4 THEN 'learned' WHEN q = 3 THEN 'reviewing' ELSE 'forgot' END FROM s JOIN r ON r.user_id = s.user_id AND r.k = s.k + 1)
SELECT s.user_id, s.ease, s."interval", s.reps, s.status, s.k AS reviews FROM s JOIN (SELECT user_id, max(c) AS c FROM r GROUP BY user_id) m ON s.user_id = m.user_id AND s.k = m.c"""
)
def review_replay(spark, d):
    return reviews.replay(event_reviews(spark, d), "user_id", "ts", "event_id")


@query(f"WITH e AS (SELECT event_id, {case_sql(_QUALITY, 'event_type')} AS q, event_id % 4 AS reps, event_id % 40 AS iv FROM events) SELECT event_id, CAST(greatest(1.3, round(2.5 + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02), 2)) AS DOUBLE) AS ease, CAST(CASE WHEN q < 3 THEN 1 WHEN reps = 0 THEN 1 WHEN reps = 1 THEN 6 ELSE greatest(1, round_even(iv * 2.5, 0)) END AS INTEGER) AS interval_days, CAST(CASE WHEN q < 3 THEN 0 ELSE reps + 1 END AS INTEGER) AS reps FROM e WHERE q IS NOT NULL")
def review_step(spark, d):
    e = readers.table(spark, d, "events").withColumn("q", X.mapping(_QUALITY, F.col("event_type"))).where("q is not null")
    s = X.review_step(F.lit(2.5), F.col("event_id") % 40, F.col("event_id") % 4, F.col("q"))
    return e.select("event_id", s["ease"].alias("ease"), s["interval"].alias("interval_days"), s["reps"].alias("reps"))


@query("SELECT CAST(user_id AS VARCHAR) AS word, 'day' || (user_id % 30) <= 'day8' AS by_text, user_id % 30 <= 8 AS by_number FROM (SELECT DISTINCT user_id FROM events)")
def due_words(spark, d):
    s = readers.table(spark, d, "events").select(F.col("user_id").cast("string").alias("word"), (F.col("user_id") % 30).alias("due")).distinct()
    t, n = (reviews.due(s, 8, x).withColumn(c, F.lit(True)) for x, c in ((True, "by_text"), (False, "by_number")))
    return s.select("word").join(t, "word", "left").join(n, "word", "left").select("word", F.coalesce("by_text", F.lit(False)).alias("by_text"), F.coalesce("by_number", F.lit(False)).alias("by_number"))


@query(f"WITH {WORDS} SELECT CAST(day AS INTEGER) AS day, CASE WHEN day IN (0, 1, 7) THEN (SELECT count(*) FROM w) ELSE 0 END AS words FROM (SELECT unnest(range(0, 14)) AS day)")
def review_plan(spark, d):
    return reviews.plan(words(spark, d).select("word"), 14)


@query("SELECT user_id, CASE WHEN n <= 0 THEN 'new' WHEN n < 3 THEN 'learning' ELSE 'mastered' END AS state FROM (SELECT user_id, count(*) - 1 AS n FROM events GROUP BY user_id)")
def learning_states(spark, d):
    return readers.table(spark, d, "events").groupBy("user_id").agg((F.count("*") - 1).alias("n")).select("user_id", X.learning_state("n").alias("state"))


@query("SELECT user_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_status(spark, d):
    return reviews.latest(readers.table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


# ---- entries and further reports


@query(f"WITH {WORDS}, t AS (SELECT word, n FROM w ORDER BY n DESC, word LIMIT 5), e AS (SELECT length('example of ' || word) AS l FROM w ORDER BY word LIMIT 100) SELECT (SELECT string_agg(word, ', ' ORDER BY n DESC, word) FROM t) AS core, CAST(round_even(avg(l), 0) AS INTEGER) AS mean_length, avg(l) > 60 AS long FROM e")
def style_stats(spark, d):
    w = words(spark, d)
    return reports.style(w, w.select("word", F.concat(F.lit("example of "), "word").alias("example")))


@query(f"WITH {COLLOC} SELECT phrase, n, round(s, 2) AS pmi FROM col WHERE s > 0 AND n >= 3 ORDER BY round(s, 2) DESC, n DESC, phrase LIMIT 20")
def phrase_report(spark, d):
    return ngrams.top(ngrams.collocations(readers.english(spark, d), 2, 3), 20).select("phrase", "n", "pmi")


@query(f"WITH {WORDS} SELECT CAST(row_number() OVER (ORDER BY n DESC, word) AS INTEGER) AS rank, word, n, level, {case_sql(L.LEVEL_COLOURS, 'level')} AS colour FROM w WHERE word NOT IN ({quoted(L.FILTER_WORDS)}) ORDER BY n DESC, word LIMIT 50")
def high_frequency_page(spark, d):
    return reports.high_frequency(words(spark, d))


@query(f"WITH {WORDS}, h AS (SELECT string_agg(word, ', ' ORDER BY word) AS head FROM (SELECT word FROM w ORDER BY word LIMIT 10)) SELECT CAST(day AS INTEGER) AS day, CASE WHEN day IN (0, 1, 7) THEN (SELECT count(*) FROM w) ELSE 0 END AS words, CASE WHEN day IN (0, 1, 7) THEN head ELSE '' END AS head FROM (SELECT unnest(range(0, 14)) AS day), h")
def review_plan_note(spark, d):
    return reports.plan_note(words(spark, d))


@query(
    f"WITH {WORDS}, p AS {rows_sql([(w, *p) for w, p in L.COMMON_IPA.items()], 'word', 'us', 'uk')} SELECT w.word, us, uk FROM w JOIN p ON w.word = p.word"
)
def common_pronunciations(spark, d):
    ipa = words(spark, d).select("word", enrich.common_ipa("word").alias("m")).where(F.size("m") > 0)
    return ipa.select("word", F.col("m")["en_us"].alias("us"), F.col("m")["en_uk"].alias("uk"))


@query(
    f"WITH s AS (SELECT doc_id, no - 1 AS no, ss[no] AS s FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ss FROM documents WHERE lang = 'en'))), "
    f"t AS (SELECT DISTINCT doc_id, no, s, lower(unnest(regexp_extract_all(s, '{TOKEN_RE}'))) AS word FROM s), {_IMPORTANT}, r AS (SELECT t.*, row_number() OVER (PARTITION BY t.word ORDER BY doc_id, no) AS k FROM t JOIN imp ON t.word = imp.word) SELECT word, doc_id, no FROM r WHERE k = 1"
)
def first_contexts(spark, d):
    rows = readers.lines(readers.english(spark, d)).select("doc_id", F.col("line_no").cast("long").alias("no"), F.explode(F.array_distinct(F.transform(X.corpus_tokens("line"), lambda x: F.lower(x)))).alias("word"))
    return corpus.first_of_each(rows.join(important(spark, d).distinct(), "word"), "word", "doc_id", "no")


_KEPT_ROWS = ORACLES["quantile_filter"].replace("SELECT word, n, q, kept_by FROM r", "SELECT r.word FROM r")
_ENRICHED = rf"""{COLLOC}, {WORDS}, sel AS ({_KEPT_ROWS}), e0 AS (SELECT w.* FROM w JOIN sel USING (word)
), lk AS ({ORACLES["wordbank_lookup"].replace("WITH " + WORDS, "")}
), sent AS (
  SELECT doc_id, unnest(range(0, len(ss))) AS no, unnest(ss) AS sentence
  FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[\s\v]+', '\1' || chr(10), 'g'), chr(10)) AS ss FROM documents WHERE lang = 'en')
), held AS (
  SELECT DISTINCT doc_id, no, sentence, lower(unnest(regexp_extract_all(sentence, '{TOKEN_RE}'))) AS word FROM sent
), c3 AS (
  SELECT held.*, row_number() OVER (PARTITION BY word ORDER BY doc_id, no) AS r FROM held JOIN e0 USING (word) QUALIFY r <= 3
), cleaned AS (
  SELECT word, r, {SANITIZE} AS clean FROM (SELECT word, r, {STRIP.format("sentence")} AS s FROM c3)
), cx AS (
  SELECT word, list_filter(xs, lambda x, i: list_position(xs, x) = i) AS xs FROM (SELECT word, list(clean ORDER BY r) AS xs FROM cleaned WHERE clean <> '' GROUP BY word)
), pairs AS (
  SELECT phrase, a AS word, n, round(s, 2) AS pmi FROM col WHERE s > 0 AND n >= 3 UNION SELECT phrase, b, n, round(s, 2) FROM col WHERE s > 0 AND n >= 3
), p4 AS (
  SELECT word, phrase, row_number() OVER (PARTITION BY word ORDER BY pmi DESC, n DESC, phrase) AS r FROM pairs QUALIFY r <= 4
), px AS (
  SELECT word, list(phrase ORDER BY r) AS phrases FROM p4 GROUP BY word
), enriched AS (
  SELECT e0.word, e0.n, lk.pos, lk.gloss_en, e0.level, coalesce(array_to_string(cx.xs, ' | '), '') AS examples, coalesce(array_to_string(px.phrases, ' | '), '') AS collocations,
         CASE WHEN e0.word IN ({quoted(L.POLYSEMOUS)}) THEN e0.word ELSE '' END AS polysemy
  FROM e0 LEFT JOIN lk ON lk.word = e0.word LEFT JOIN cx ON cx.word = e0.word LEFT JOIN px ON px.word = e0.word
)"""


def enriched(spark, d):
    """Entries of all selected words, every field that can be had offline."""
    docs, w = readers.english(spark, d), words(spark, d)
    kept = durable(levels.quantile_filter(w, 0.75, important(spark, d)).select("word").join(w, "word"))
    t = dictionaries(spark, d, w)
    found = levels.look_up(kept.select("word"), t["cmu"], t["cefr"], t["oxford"], t["bilingual"], t["wiktionary"])
    phrases = ngrams.phrases_of(ngrams.collocations(docs, 2, 3), kept)
    entries = enrich.enrich(kept, found, enrich.contexts(kept, enrich.numbered_sentences(docs)), phrases)
    return entries.select("word", "n", "pos", "gloss_en", "level", F.array_join("examples", " | ").alias("examples"), F.array_join("collocations", " | ").alias("collocations"), F.array_join("phenomena.polysemy", "").alias("polysemy"))


@query(f"WITH {_ENRICHED} SELECT * FROM enriched")
def enriched_entries(spark, d):
    return enriched(spark, d)


_PAGED_GLOSS = "concat_ws(chr(10), gloss_en, nullif(examples, ''), nullif(collocations, ''))"
_ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(
    f"""WITH {_ENRICHED}, h AS (
  SELECT word, '<div class="entry"><b>' || {_ESC.format("word")} || '</b><span style="color:' || {case_sql(L.LEVEL_COLOURS, "level")} || '">' || level || '</span> ×' || n || '<p>' || replace({_ESC.format(_PAGED_GLOSS)}, chr(10), '<br>') || '</p></div>' AS html
  FROM enriched WHERE trim({_PAGED_GLOSS}) <> ''
), pg AS (SELECT word, html, (row_number() OVER (ORDER BY lower(word), html) - 1) // 500 + 1 AS page FROM h)
SELECT CAST(page AS BIGINT) AS page, count(*) AS entries, md5('<!DOCTYPE html><html><head><meta charset=''utf-8''><title>Words</title></head><body>' || chr(10) || string_agg(html, chr(10) ORDER BY lower(word), html) || chr(10) || '</body></html>') AS html
FROM pg GROUP BY page"""
)
def enriched_pages(spark, d):
    """From the corpus to pages of rendered entries: all selected words with gloss, examples and collocations."""
    gloss = F.concat_ws("\n", "gloss_en", F.nullif("examples", F.lit("")), F.nullif("collocations", F.lit("")))
    entries = enriched(spark, d).withColumn("gloss", gloss)
    pages = reports.html_pages(reports.entry_html(entries), "Words")
    return pages.select("page", (F.size(F.split("html", '<div class="entry">')) - 1).cast("long").alias("entries"), F.md5("html").alias("html"))


_ENTRY = (
    f"'<div class=\"entry\"><b>' || word || '</b><span style=\"color:' || {case_sql(L.LEVEL_COLOURS, 'level')} || '\">' || level || '</span> ×' || n || '<p>gloss of ' || word || '</p></div>'"
)


@query(
    f"WITH k AS ({_KEPT_ROWS}), w AS ({ORACLES['word_table']}), h AS (SELECT word, {_ENTRY} AS html FROM w WHERE word IN (SELECT word FROM k)), "
    "p AS (SELECT word, html, (row_number() OVER (ORDER BY lower(word), html) - 1) // 500 + 1 AS page FROM h) "
    "SELECT CAST(page AS BIGINT) AS page, '<!DOCTYPE html><html><head><meta charset=''utf-8''><title>Words &amp; more</title></head><body>' || chr(10) "
    "|| string_agg(html, chr(10) ORDER BY lower(word), html) || chr(10) || '</body></html>' AS html FROM p GROUP BY page"
)
def html_report(spark, d):
    w = words(spark, d)
    kept = levels.quantile_filter(w, 0.75, important(spark, d)).select("word").join(w, "word").withColumn("gloss", F.concat(F.lit("gloss of "), "word"))
    return reports.html_pages(reports.entry_html(kept), "Words & more")


@query(
    f"WITH v AS ({ORACLES['level_distribution']}) SELECT '<script type=''application/json''>[' || string_agg('{{\"level\":\"' || level || '\",\"n\":' || n || ',\"pct\":' || pct || '}}', ',' ORDER BY level) || ']</script>' AS html FROM v"
)
def json_report(spark, d):
    return reports.json_page(reports.distribution(words(spark, d), "level"))
