"""Queries over whole documents for tags and phrases, with the same results as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import expressions as X
from lexmill.functions import lexicon as L
from lexmill.operators import corpus, levels, ngrams, phrases, reports, tagging
from lexmill.operators.ranking import durable
from lexmill.plans import catalog
from lexmill.plans.catalog import COLLOC, DERIVED, LEMMA, PHRASE_RE, TOKEN_RE, WORDS, query, quoted, rows_sql
from lexmill.sources import readers

# ---- part-of-speech tags

_SEED = (
    "CASE "
    + " ".join(f"WHEN w IN ({quoted(words.split())}) THEN '{pos}'" for pos, words in L.CLOSED_CLASSES.items())
    + " "
    + " ".join(f"WHEN regexp_full_match(w, '.{{3,}}({'|'.join(endings.split())})') THEN '{pos}'" for pos, endings in L.SURE_ENDINGS.items())
    + " END"
)
_ENDINGS = "\n    ".join(f"UNION ALL SELECT '-' || right(w, {n}), pos, n FROM counted WHERE length(w) >= {n}" for n in range(1, tagging.ENDING + 1))
#: A word's key is the word itself if the model has it, else its longest known ending.
_KEY_JOINS = "\n  ".join(f"LEFT JOIN known k{n} ON k{n}.key = " + ("'=' || v.w" if n == 0 else f"'-' || right(v.w, {n}) AND length(v.w) >= {n}") for n in (0, 4, 3, 2, 1))

#: The model is counted and each sentence decoded as in the operator, in whole numbers: a state is (sentence, tag, score, path so far).
VITERBI = rf"""WITH RECURSIVE sen AS (
  SELECT doc_id, i - 1 AS sentence, ss[i] AS s
  FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[.!?]+\s*|\n') AS ss FROM documents))
), st AS (
  SELECT row_number() OVER () AS id, doc_id, sentence, ts FROM (SELECT doc_id, sentence, regexp_extract_all(s, '{TOKEN_RE}') AS ts FROM sen) WHERE len(ts) > 0
), tk AS MATERIALIZED (
  SELECT id, p, w, {_SEED} AS pos FROM (SELECT id, unnest(range(1, len(ts) + 1)) AS p, lower(unnest(ts)) AS w FROM st)
), prs AS (
  SELECT pos, CASE WHEN p = 1 THEN '^' ELSE lag(pos) OVER (PARTITION BY id ORDER BY p) END AS prev FROM tk
), steps AS (
  SELECT prev, pos, count(*) AS n FROM prs WHERE pos IS NOT NULL AND prev IS NOT NULL GROUP BY prev, pos
), tags AS MATERIALIZED (
  SELECT pos, row_number() OVER (ORDER BY pos) AS t, count(*) OVER () AS size FROM (SELECT DISTINCT pos FROM steps)
), froms AS (
  SELECT prev, sum(n) AS n FROM steps GROUP BY prev
), step AS MATERIALIZED (
  SELECT coalesce(a.t, 0) AS a, b.t AS b, CAST(floor(0.5 + {tagging.UNIT} * ln((coalesce(s.n, 0) + {tagging.STEP_SMOOTH}) / (coalesce(f.n, 0) + {tagging.STEP_SMOOTH} * b.size))) AS BIGINT) AS x
  FROM (SELECT pos AS prev, t FROM tags UNION ALL SELECT '^', 0) a CROSS JOIN tags b
  LEFT JOIN steps s ON s.prev = a.prev AND s.pos = b.pos LEFT JOIN froms f ON f.prev = a.prev
), counted AS (
  SELECT w, pos, count(*) AS n FROM tk WHERE pos IS NOT NULL GROUP BY w, pos
), bykey AS (
  SELECT key, pos, sum(n) AS n FROM (
    SELECT '=' || w AS key, pos, n FROM counted
    {_ENDINGS}
  ) GROUP BY key, pos
), known AS MATERIALIZED (
  SELECT key, sum(n) AS total FROM bykey GROUP BY key HAVING sum(n) >= {tagging.LEAST} ORDER BY total DESC, key LIMIT {tagging.MOST_KEYS}
), share AS (
  SELECT g.pos, (coalesce(sum(b.n), 0) + {tagging.KEY_SMOOTH}) / ((SELECT sum(x.n) FROM bykey x JOIN known USING (key) WHERE x.key LIKE '=%') + {tagging.KEY_SMOOTH} * any_value(g.size)) AS share
  FROM tags g LEFT JOIN (SELECT pos, n FROM bykey JOIN known USING (key) WHERE key LIKE '=%') b ON b.pos = g.pos GROUP BY g.pos
), score AS MATERIALIZED (
  SELECT k.key, g.t, CAST(floor(0.5 + {tagging.UNIT} * (ln((coalesce(b.n, 0) + {tagging.KEY_SMOOTH}) / (k.total + {tagging.KEY_SMOOTH} * g.size)) - ln(s.share))) AS BIGINT) AS x
  FROM known k CROSS JOIN tags g LEFT JOIN bykey b ON b.key = k.key AND b.pos = g.pos JOIN share s ON s.pos = g.pos
  UNION ALL SELECT '', t, 0 FROM tags
), words AS MATERIALIZED (
  SELECT v.w, coalesce(k0.key, k4.key, k3.key, k2.key, k1.key, '') AS key FROM (SELECT DISTINCT w FROM tk) v
  {_KEY_JOINS}
), tx AS MATERIALIZED (
  SELECT tk.id, tk.p, list(score.x ORDER BY score.t) AS xs FROM tk JOIN words USING (w) JOIN score USING (key) GROUP BY tk.id, tk.p
), go(id, p, t, score, path) AS (
  SELECT tx.id, CAST(1 AS BIGINT), CAST(g.t AS BIGINT), CAST(step.x + tx.xs[g.t] AS BIGINT), chr(CAST(64 + g.t AS INTEGER))
  FROM tx, tags g JOIN step ON step.a = 0 AND step.b = g.t WHERE tx.p = 1
  UNION ALL
  SELECT id, p, t, (top + way) // 64 + x, path || chr(CAST(64 + t AS INTEGER)) FROM (
    SELECT go.id, go.p + 1 AS p, step.b AS t, max((go.score + step.x) * 64 - go.t) AS top, arg_max(go.t, (go.score + step.x) * 64 - go.t) AS way,
           arg_max(go.path, (go.score + step.x) * 64 - go.t) AS path, any_value(tx.xs[step.b]) AS x
    FROM go JOIN tx ON tx.id = go.id AND tx.p = go.p + 1 JOIN step ON step.a = go.t GROUP BY go.id, go.p, step.b
  )
), best AS (
  SELECT id, path FROM (SELECT id, path, row_number() OVER (PARTITION BY id ORDER BY p DESC, score DESC, t) AS r FROM go) WHERE r = 1
), tagged AS (
  SELECT st.doc_id, st.sentence, st.ts, list_transform(string_split(best.path, ''), lambda c: names.ns[ascii(c) - 64]) AS path
  FROM st JOIN best ON best.id = st.id, (SELECT list(pos ORDER BY t) AS ns FROM tags) names
)"""


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, sentence, tokens, tags) of all documents, by a model of their own sure words."""
    sentences = tagging.tokens_by_sentence(readers.table(spark, d, "documents"))
    return tagging.tag(sentences, tagging.train_seeded(sentences))


def own_tags(spark: SparkSession, d: str) -> DataFrame:
    """(word, pos, n) of all words of the documents by the same model: words are counted with their tags where they are tagged."""
    sentences = tagging.tokens_by_sentence(readers.table(spark, d, "documents"))
    return tagging.best_tags(tagging.tag_counts(sentences, tagging.train_seeded(sentences)))


@query(VITERBI + " SELECT doc_id, CAST(sentence AS INTEGER) AS sentence, array_to_string(ts, ' ') AS words, array_to_string(path, ' ') AS tags FROM tagged")
def part_of_speech(spark, d):
    return tagged(spark, d).select("doc_id", "sentence", F.array_join("tokens", " ").alias("words"), F.array_join("tags", " ").alias("tags"))


_WORD_TAGS = """wp AS (
  SELECT lower(word) AS word, pos, count(*) AS n FROM (SELECT unnest(ts) AS word, unnest(path) AS pos FROM tagged) GROUP BY 1, 2
), wtag AS (
  SELECT word, arg_min(pos, (-n, pos)) AS pos, CAST(sum(n) AS BIGINT) AS n FROM wp GROUP BY word
)"""


@query(f"{VITERBI}, {_WORD_TAGS} SELECT word, pos, n FROM wtag")
def word_tags(spark, d):
    return own_tags(spark, d)


@query(f"{VITERBI}, {_WORD_TAGS} SELECT pos, count(*) AS n, CAST(round_even(count(*) * 100 / (SELECT count(*) FROM wtag), 0) AS INTEGER) AS pct FROM wtag GROUP BY pos")
def pos_distribution(spark, d):
    return reports.distribution(durable(own_tags(spark, d)), "pos")


@query(
    f"""{VITERBI}, {_WORD_TAGS}, {LEMMA}, f AS (
  SELECT l.word, l.lemma, a.pos, coalesce(b.pos, a.pos) AS lemma_pos, w.n,
         l.word = l.lemma OR (regexp_matches(l.word, '(ed|ing|s|es)$') AND starts_with(l.word, l.lemma)) AS inflected, regexp_matches(l.word, '.{{{{4,}}}}({DERIVED})$') AS ending
  FROM lem l JOIN w ON w.word = l.word JOIN wtag a ON a.word = l.word LEFT JOIN wtag b ON b.word = l.lemma
)
SELECT word, lemma, pos, lemma_pos, pos <> lemma_pos OR (ending AND NOT inflected) OR n >= {L.TERM_FREQ} AS independent,
  CASE WHEN pos <> lemma_pos THEN '派生：POS ' || lemma_pos || '→' || pos
    ELSE coalesce(nullif(concat_ws('；', CASE WHEN ending AND NOT inflected THEN '{L.FORM_REASONS["derived"]}' WHEN inflected THEN '{L.FORM_REASONS["inflected"]}' END,
      CASE WHEN n >= {L.TERM_FREQ} AND NOT (ending AND NOT inflected) THEN '{L.FORM_REASONS["term"]}' END), ''), '{L.FORM_REASONS["plain"]}') END AS reason
FROM f""".replace("{{4,}}", "{4,}")
)
def tagged_forms(spark, d):
    """Every word's form decision with the tags of word and lemma that the model gives."""
    w = catalog.words(spark, d)
    tags = durable(own_tags(spark, d).select("word", "pos"))
    rows = corpus.lemmas(w).join(w.select("word", "n"), "word").join(tags, "word").join(tags.select(F.col("word").alias("lemma"), F.col("pos").alias("lemma_pos")), "lemma", "left")
    rows = rows.withColumn("lemma_pos", F.coalesce("lemma_pos", "pos"))
    made = X.form_decision("word", "lemma", "pos", "lemma_pos", X.term_context(freq="n"))
    return rows.select("word", "lemma", "pos", "lemma_pos", made["independent"].alias("independent"), made["reason"].alias("reason"))


_DECIDED = f"""k5 AS (SELECT word FROM w WHERE n >= 5), rec AS (
  SELECT w.word, CASE WHEN length(w.word) < 4 OR k.word IS NOT NULL THEN w.word ELSE coalesce(a.word, b.word, c.word, e.word, w.word) END AS surface
  FROM w LEFT JOIN k5 k ON w.word = k.word LEFT JOIN k5 a ON a.word = w.word || 'e' LEFT JOIN k5 b ON b.word = w.word || 'es' LEFT JOIN k5 c ON c.word = w.word || 'ed' LEFT JOIN k5 e ON e.word = w.word || 'd'
), dec0 AS (
  SELECT rec.word, surface, l.lemma, p.pos, coalesce(q.pos, p.pos) AS lemma_pos,
    surface = l.lemma OR (regexp_matches(surface, '(ed|ing|s|es)$') AND starts_with(surface, l.lemma)) AS inflected, regexp_matches(surface, '.{{4,}}({DERIVED})$') AS ending
  FROM rec JOIN lem l ON l.word = rec.surface LEFT JOIN wtag p ON p.word = surface LEFT JOIN wtag q ON q.word = l.lemma
  WHERE surface NOT IN ({quoted(L.STOP_WORDS)}) AND l.lemma NOT IN ({quoted(L.STOP_WORDS)}) AND length(l.lemma) >= 2 AND NOT {catalog.NOISE.replace("word", "l.lemma")}
), decided AS (
  SELECT word, surface, lemma, coalesce(pos <> lemma_pos, false) OR (ending AND NOT inflected) AS independent, CASE WHEN pos <> lemma_pos THEN '派生：POS ' || lemma_pos || '→' || pos ELSE '{L.FORM_REASONS["derived"]}' END AS reason
  FROM dec0
), rows_ AS (
  SELECT doc_id, pos, surface, lemma, independent, reason FROM tok JOIN decided d ON lower(tok.token) = d.word
), once AS (
  SELECT doc_id, pos, surface AS token, surface AS lemma, reason AS context FROM rows_ WHERE independent QUALIFY row_number() OVER (PARTITION BY surface ORDER BY doc_id, pos) = 1
  UNION ALL SELECT doc_id, pos, surface, lemma, '' FROM rows_ WHERE NOT independent
)"""


@query(f"{VITERBI}, {_WORD_TAGS}, {LEMMA}, {_DECIDED} SELECT doc_id, pos, token, lemma, context, CAST((row_number() OVER (ORDER BY doc_id, pos) - 1) // 500 + 1 AS BIGINT) AS page_no FROM once")
def clean_corpus(spark, d):
    """The English corpus: cut ends restored, lemmas, words of their own once, numbered pages."""
    tags = durable(own_tags(spark, d).select("word", "pos"))
    decisions = durable(corpus.word_decisions(catalog.words(spark, d), tags))
    return corpus.clean_corpus(readers.tokens(readers.english(spark, d)), decisions)


# ---- phrases


def phrase_table(spark: SparkSession, d: str) -> DataFrame:
    """(phrase, kind): the fixed lists, and the first four words of each benchmark item as slang."""
    opening = F.array_join(F.slice(X.phrase_tokens("text"), 1, 4), " ")
    own = readers.table(spark, d, "benchmark").select(opening.alias("phrase"), F.lit("slang").alias("kind")).where("phrase <> ''")
    return phrases.fixed_phrases(spark).unionAll(own).distinct()


_FIXED = rows_sql([*((p, "collocation") for p in L.SET_PHRASES), *((p, "slang") for p in L.IDIOMS), *((p, "polysemy") for p in L.POLYSEMOUS)], "phrase", "kind")
_PHRASES = f"""ph AS (
  SELECT * FROM {_FIXED} UNION SELECT DISTINCT array_to_string(regexp_extract_all(lower(text), '{PHRASE_RE}')[1:4], ' '), 'slang' FROM benchmark WHERE len(regexp_extract_all(lower(text), '{PHRASE_RE}')) > 0
)"""
_PLACES = f"""sized AS (
  SELECT phrase, kind, len(regexp_extract_all(phrase, '{PHRASE_RE}')) AS n FROM ph
), dw AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(lower(coalesce(text, '')), '{PHRASE_RE}') AS ws FROM documents
), dg AS (
  SELECT doc_id, i - 1 AS place, n, array_to_string(ws[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM sized) WHERE len(ws) >= n)
), places AS (
  SELECT doc_id, phrase, kind, place FROM dg JOIN sized ON sized.n = dg.n AND sized.phrase = dg.gram
)"""


@query(
    f"""WITH {COLLOC}, {_PHRASES.replace("ph AS", "ph0 AS")}, ph AS (SELECT * FROM ph0 UNION SELECT phrase, 'book' FROM col WHERE s > 0 AND n >= 5), {_PLACES}
SELECT doc_id, phrase, kind, place FROM places"""
)
def phrase_places(spark, d):
    """Every place of every set phrase, idiom, special word and frequent collocation of the English texts, in all documents."""
    book = ngrams.collocations(readers.english(spark, d)).where("n >= 5").select("phrase", F.lit("book").alias("kind"))
    return phrases.find(readers.table(spark, d, "documents"), phrase_table(spark, d).unionAll(book))


_KIND = "list_sort(list(DISTINCT phrase) FILTER (WHERE kind = '{0}'))"


@query(
    f"WITH {_PHRASES}, {_PLACES} SELECT doc_id, "
    + ", ".join(f"coalesce(array_to_string({_KIND.format(k)}, ', '), '') AS {c}" for k, c in (("polysemy", "polysemy"), ("collocation", "collocations"), ("slang", "slang")))
    + ", count(*) AS n FROM places GROUP BY doc_id"
)
def phenomena_in_context(spark, d):
    found = durable(phrases.find(readers.table(spark, d, "documents"), phrase_table(spark, d)))
    listed = phrases.phenomena(found).select("doc_id", *(F.array_join(c, ", ").alias(c) for c in ("polysemy", "collocations", "slang")))
    return listed.join(found.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")


@query(
    rf"""WITH {WORDS}, {_PHRASES}, ss AS (
  SELECT doc_id, no, s FROM (SELECT doc_id, unnest(range(0, len(x))) AS no, unnest(x) AS s FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[.!?]+\s*|\n') AS x FROM documents WHERE lang = 'en')) WHERE s <> ''
), sw AS (
  SELECT DISTINCT doc_id, no, s, lower(unnest(regexp_extract_all(s, '{TOKEN_RE}'))) AS word FROM ss
), f3 AS (
  SELECT * FROM sw QUALIFY row_number() OVER (PARTITION BY word ORDER BY doc_id, no) <= 3
), near AS (
  SELECT DISTINCT word FROM f3 JOIN ph ON ph.kind <> 'polysemy' AND contains(lower(f3.s), ph.phrase) UNION SELECT word FROM f3 WHERE word IN ({quoted(L.POLYSEMOUS)})
)
SELECT w.word, n, near.word IS NOT NULL AS in_context FROM w LEFT JOIN near ON near.word = w.word
WHERE (w.word NOT IN ({quoted(L.FILTER_WORDS)}) AND n >= 2 AND zipf >= 0) OR near.word IS NOT NULL OR w.word IN ({quoted(L.POLYSEMOUS)})"""
)
def phenomenon_filter(spark, d):
    """The classic filter, which also keeps words by the phrases, slang and special senses of their contexts."""
    near = phrases.words_in_context(readers.english(spark, d), phrase_table(spark, d)).select("word", F.lit(True).alias("near"))
    rows = catalog.words(spark, d).join(near, "word", "left")
    return levels.classic_filter(rows, must=F.coalesce("near", F.lit(False))).select("word", "n", F.coalesce("near", F.lit(False)).alias("in_context"))
