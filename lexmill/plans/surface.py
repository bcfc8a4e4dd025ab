"""The calls of the programmatic surface as SQL over the tables, with the same results as plain SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexmill import sql
from lexmill.functions import expressions as X
from lexmill.plans import catalog
from lexmill.plans.catalog import CLEAN, ORACLES, PHRASE_RE, WORDS, ZLEVEL, Q, case_sql, query
from lexmill.sources import readers


def session(spark: SparkSession, d: str, *tables: str) -> SparkSession:
    """The session with the functions and the named tables as views."""
    sql.install(spark)
    for name in tables:
        readers.table(spark, d, name).createOrReplaceTempView(name)
    return spark


@query("SELECT coalesce(lang, '') AS lang, count(*) AS documents, coalesce(lang, '') IN ('de', 'en', 'es', 'fr') AS supported FROM documents GROUP BY 1, 3")
def sql_languages(spark, d):
    return session(spark, d, "documents").sql(
        "SELECT coalesce(lang, '') AS lang, count(*) AS documents, coalesce(any_value(l.language) IS NOT NULL, false) AS supported "
        "FROM documents LEFT JOIN (SELECT language FROM lexmill_languages()) l ON l.language = lang GROUP BY 1"
    )


@query("SELECT 'vocabulary' AS generator, count(*) AS books FROM (SELECT DISTINCT source FROM documents)")
def sql_generators(spark, d):
    return session(spark, d, "documents").sql("SELECT generator, books FROM lexmill_generators(), (SELECT count(*) AS books FROM (SELECT DISTINCT source FROM documents)) WHERE generator = 'vocabulary'")


@query("SELECT conv_id, turn, concat_ws(',', CASE WHEN coalesce(trim(role), '') = '' THEN 'word' END, CASE WHEN turn % 2 = 0 THEN 'pos' END, 'ipa', CASE WHEN coalesce(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '') = '' THEN 'gloss' END) AS missing FROM conversations")
def sql_missing_fields(spark, d):
    return session(spark, d, "conversations").sql("SELECT conv_id, turn, array_join(lexmill_missing_fields(role, if(turn % 2 = 0, ' ', 'n.'), null, text), ',') AS missing FROM conversations")


@query(ORACLES["distinct_examples"])
def sql_clean_examples(spark, d):
    return session(spark, d, "conversations").sql("SELECT conv_id, array_sort(xs) AS examples FROM (SELECT conv_id, lexmill_clean_examples(ts) AS xs FROM (SELECT conv_id, collect_list(text) AS ts FROM conversations WHERE text IS NOT NULL GROUP BY conv_id))")


@query(f"WITH {WORDS}, b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{PHRASE_RE}')) AS word FROM benchmark), x AS ({ORACLES['wordbank_lookup'].replace('WITH ' + WORDS, '')}) SELECT x.* FROM x JOIN b ON x.word = b.word")
def sql_lookup(spark, d):
    """Every word of the benchmark, looked up by a correlated table function."""
    sql.install(spark, catalog.dictionaries(spark, d), catalog.words(spark, d).select("word"))
    readers.table(spark, d, "benchmark").select(F.explode(X.phrase_tokens("text")).alias("w")).distinct().createOrReplaceTempView("asked")
    return spark.sql("SELECT b.* FROM asked, LATERAL lexmill_lookup(concat(' ', upper(asked.w))) b")


@query(ORACLES["dictionary_coverage"])
def sql_coverage(spark, d):
    sql.install(spark, catalog.dictionaries(spark, d), catalog.words(spark, d).select("word"))
    return spark.sql("SELECT source, words FROM lexmill_coverage()")


@query(ORACLES["bigram_counts"])
def sql_collocations(spark, d):
    session(spark, d, "documents")
    return spark.sql("SELECT concat_ws(' ', w1, w2) AS phrase, count(*) AS n FROM lexmill_ngrams(TABLE(SELECT text FROM documents WHERE lang = 'en'), 'text', 2) GROUP BY w1, w2 HAVING count(*) >= 2")


@query(ORACLES["difficulty_q"])
def sql_difficulty(spark, d):
    sql.install(spark)
    catalog.words(spark, d).createOrReplaceTempView("words")
    return spark.sql("SELECT word, round(lexmill_difficulty(zipf, band, lexmill_level(zipf)), 6) AS q FROM words")


@query(ORACLES["review_plan"])
def sql_review_plan(spark, d):
    sql.install(spark)
    catalog.words(spark, d).createOrReplaceTempView("words")
    return spark.sql("SELECT d.day, coalesce(p.words, 0L) AS words FROM (SELECT explode(sequence(0, 13)) AS day) d LEFT JOIN (SELECT r.day, count(DISTINCT w.word) AS words FROM words w, LATERAL lexmill_review_days(14) r GROUP BY r.day) p ON p.day = d.day")


@query(ORACLES["review_step"])
def sql_review(spark, d):
    session(spark, d, "events")
    quality = case_sql(catalog._QUALITY, "event_type")
    return spark.sql(f"SELECT event_id, s.ease, s.interval AS interval_days, s.reps FROM (SELECT event_id, lexmill_review(2.5D, CAST(event_id % 40 AS INT), CAST(event_id % 4 AS INT), q) AS s FROM (SELECT event_id, {quality} AS q FROM events) WHERE q IS NOT NULL)")


@query(ORACLES["review_replay"])
def sql_replay(spark, d):
    session(spark, d, "events")
    quality = case_sql(catalog._QUALITY, "event_type")
    return spark.sql(f"SELECT key AS user_id, ease, interval, reps, status, reviews FROM lexmill_replay(TABLE(SELECT user_id AS key, {quality} AS quality, ts, event_id FROM events WHERE event_type IS NOT NULL) PARTITION BY key ORDER BY (ts, event_id))")


_REPAIRED = "replace(nfc_normalize(coalesce(text, '')), '-' || chr(10), '')"


@query(
    f"""WITH {CLEAN.replace("coalesce(text, '')", _REPAIRED)}, cn AS (SELECT lemma AS word, count(*) AS n FROM ct GROUP BY 1), ctot AS (SELECT sum(n) AS total FROM cn
), cz AS (SELECT word, n, round(log10(n * 1e9 / total), 6) AS zipf FROM cn, ctot), cl AS (SELECT *, CAST(least(10, greatest(1, ceil((8 - zipf) * 2))) AS INTEGER) AS band, {ZLEVEL} AS level FROM cz
), cq AS (SELECT word, n, {Q} AS q FROM cl) SELECT word, n, q, CAST(least(9, greatest(1, ceil(q / (1.0 / 9)))) AS INTEGER) AS tier FROM cq WHERE q >= 0.6"""
)
def sql_vocabulary(spark, d):
    sql.install(spark, documents=readers.english(spark, d))
    return spark.sql("SELECT word, n, q, tier FROM lexmill_vocabulary(0.6D)")
