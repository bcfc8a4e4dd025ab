"""Statistics and entries as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import expressions as X
from lexmill.functions import lexicon as L
from lexmill.operators.ranking import numbered


def top_words(words: DataFrame, k: int = 50) -> DataFrame:
    """(rank, word, n) of the k most frequent; the window runs over k rows."""
    best = words.orderBy(F.desc("n"), "word").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("n"), "word")).alias("rank"), "word", "n")


def distribution(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, pct) with the share of all rows in whole percent."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("t")))).select(key, "n", F.rint(F.col("n") * 100 / F.col("t")).cast("int").alias("pct"))


def corpus_stats(words: DataFrame, sentences: DataFrame) -> DataFrame:
    """One row: tokens, unique, ttr, avg_sentence, longest_sentence (words)."""
    w = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("unique"))
    s = sentences.agg(F.round(F.coalesce(F.avg("size"), F.lit(0.0)), 1).alias("avg_sentence"), F.coalesce(F.max("size"), F.lit(0)).alias("longest_sentence"))
    return w.join(s).select("tokens", "unique", F.when(F.col("tokens") > 0, F.round(F.col("unique") / F.col("tokens"), 3)).otherwise(0.0).alias("ttr"), "avg_sentence", "longest_sentence")


def sentences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, sentence, size) of sentences with words."""
    s = docs.select("doc_id", F.explode(F.split(F.coalesce(text_col, F.lit("")), r"[.!?]+\s*|\n")).alias("sentence"))
    # A filter by size would be moved below it and cut every sentence twice.
    return s.where(F.col("sentence").rlike(L.TOKEN_PATTERN)).withColumn("size", F.size(X.corpus_tokens("sentence")))


def frequency_bands(words: DataFrame) -> DataFrame:
    return words.agg(F.count(F.when(F.col("n") >= 10, 1)).alias("high"), F.count(F.when(F.col("n").between(2, 9), 1)).alias("middle"), F.count(F.when(F.col("n") == 1, 1)).alias("single"))


def search(entries: DataFrame, states: DataFrame, q: str = "", status: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A page of entries whose headword or glosses hold q, with the learning status (new where there is none)."""
    size, page = min(100, max(5, size)), max(1, page)
    found = entries.join(states, "word", "left").withColumn("status", F.coalesce("status", F.lit("new")))
    q = q.lower()
    found = found.where(F.lower("word").contains(q) | F.lower(F.coalesce("gloss", F.lit(""))).contains(q))
    if status:
        found = found.where(F.col("status") == status)
    return numbered(found, "word", name="__r").where(F.col("__r").between((page - 1) * size + 1, page * size)).drop("__r")


def missing_fields(entries: DataFrame, fields: list[str]) -> DataFrame:
    """(word, missing): names of the required fields without a value."""
    empty = F.array_compact(F.array(*(F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", f) for f in fields)))
    return entries.select("word", empty.alias("missing"))


def entry_html(entries: DataFrame) -> DataFrame:
    """(word, html) of entries with a gloss: headword, level badge, count, gloss."""
    badge = F.concat(F.lit('<span style="color:'), X.mapping(L.LEVEL_COLOURS, F.col("level")), F.lit('">'), F.col("level"), F.lit("</span>"))
    head = F.concat(F.lit("<b>"), X.html_escape("word"), F.lit("</b>"))
    html = F.concat_ws("", F.lit('<div class="entry">'), head, badge, F.concat(F.lit(" ×"), F.col("n").cast("string")), F.lit("<p>"), X.html_lines(X.html_escape("gloss")), F.lit("</p></div>"))
    return entries.where(F.coalesce(F.trim("gloss"), F.lit("")) != "").select("word", html.alias("html"))


def letter_heads(words: DataFrame) -> DataFrame:
    """(letter, first_word, words): the groups of an alphabetical list."""
    letter = F.upper(F.substring("word", 1, 1))
    return words.groupBy(letter.alias("letter")).agg(F.min("word").alias("first_word"), F.count("*").alias("words"))


def to_json(entries: DataFrame) -> DataFrame:
    return entries.select("word", F.to_json(F.struct(*entries.columns)).alias("json"))


def style(words: DataFrame, examples: DataFrame, most: int = 100) -> DataFrame:
    """One row: the five most frequent words, the mean length of the first examples (at most `most`) and whether it is long."""
    top = words.orderBy(F.desc("n"), "word").limit(5).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), "word"))).alias("ws"))
    mean = examples.orderBy("word").limit(most).agg(F.coalesce(F.avg(F.length("example")), F.lit(0.0)).alias("m"))
    return top.join(mean).select(F.array_join(F.col("ws.word"), ", ").alias("core"), F.rint("m").cast("int").alias("mean_length"), (F.col("m") > L.LONG_EXAMPLE).alias("long"))


def high_frequency(words: DataFrame, k: int = 50) -> DataFrame:
    """(rank, word, n, level, colour) of the most frequent words that aren't function words."""
    best = words.where(~F.lower("word").isin(*L.FILTER_WORDS)).orderBy(F.desc("n"), "word").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("n"), "word")).alias("rank"), "word", "n", "level", X.mapping(L.LEVEL_COLOURS, F.col("level")).alias("colour"))


def plan_note(words: DataFrame, days: int = 14, shown: int = 10) -> DataFrame:
    """(day, words, head): a review plan with the first words of each day."""
    from lexmill.operators.reviews import plan

    head = words.select("word").distinct().orderBy("word").limit(shown).agg(F.array_join(F.array_sort(F.collect_list("word")), ", ").alias("head"))
    return plan(words, days).join(head).select("day", "words", F.when(F.col("words") > 0, F.col("head")).otherwise("").alias("head"))


def value_note(words: DataFrame, title: str, entries: int | None = None) -> DataFrame:
    """One row (text): a short Markdown note with the number of entries and the ten most frequent words."""
    top = words.orderBy(F.desc("n"), "word").limit(10).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), "word"))), lambda s: s["word"]), ", ").alias("top"))
    count = words.agg(F.count("*").alias("c")) if entries is None else words.sparkSession.range(1).select(F.lit(entries).alias("c"))
    return top.join(count).select(F.concat(F.lit(f"# 《{title}》语言学习价值说明\n\n- 词汇量："), F.col("c").cast("string"), F.lit("\n- 高频核心词："), "top").alias("text"))


def statistics(words: DataFrame, entries: DataFrame, sentences_: DataFrame, phrases: DataFrame, days: int = 14) -> DataFrame:
    """(section, no, key, n, pct): the whole bundle of a report's statistics in long form.

    words: (word, n, pos, level) of all candidates; entries: the selected (word, pos, level); phrases: (phrase, n, pmi).
    Sections: top_words, pos, level, corpus, bands, phrases, plan. Bounded: top lists, six parts of speech and levels, the days.
    """
    from lexmill.functions.rendering import report_pos
    from lexmill.operators.reviews import plan

    content = words.where(~F.col("word").isin(*L.REPORT_WORDS))
    none = F.lit(None).cast("int")
    row = lambda df, section, no, key, n, pct=none: df.select(F.lit(section).alias("section"), no.cast("int").alias("no"), key.cast("string").alias("key"), n.cast("double").alias("n"), pct.cast("int").alias("pct"))
    most = lambda df, k: df.withColumn("no", F.row_number().over(Window.orderBy(F.desc("n"), "key"))).where(F.col("no") <= k)
    pos = distribution(entries.where("pos <> ''").select(report_pos("pos").alias("key")), "key")
    level = distribution(entries.where("level <> ''").select(F.col("level").alias("key")), "key")
    corpus = corpus_stats(words, sentences_).select(F.posexplode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("n")) for c in ("tokens", "unique", "ttr", "avg_sentence", "longest_sentence")))).alias("no", "s"))
    bands = frequency_bands(content).select(F.posexplode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).alias("n")) for c in ("high", "middle", "single")))).alias("no", "s"))
    best = phrases.orderBy(F.desc("pmi"), F.desc("n"), "phrase").limit(12).withColumn("no", F.row_number().over(Window.orderBy(F.desc("pmi"), F.desc("n"), "phrase")))
    parts = [
        row(top_words(content, 30), "top_words", F.col("rank"), F.col("word"), F.col("n")),
        row(most(pos, 6), "pos", F.col("no"), F.col("key"), F.col("n"), F.col("pct")),
        row(level, "level", X.level_order("key") + 1, F.col("key"), F.col("n"), F.col("pct")),
        row(corpus, "corpus", F.col("no"), F.col("s.key"), F.col("s.n")),
        row(bands, "bands", F.col("no"), F.col("s.key"), F.col("s.n")),
        row(best, "phrases", F.col("no"), F.col("phrase"), F.col("n")),
        row(plan(entries, days), "plan", F.col("day"), F.lit("words"), F.col("words")),
    ]
    return reduce(DataFrame.unionAll, parts)


def markdown_table(rows: DataFrame, title: str, *columns: str) -> DataFrame:
    """One row (text): a report's bounded rows as a Markdown table, in the order of the first column."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    body = rows.select(F.col(columns[0]).alias("k"), line.alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda s: s["line"]), "\n").alias("b"))
    head = f"# {title}\n\n| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    return body.select(F.concat(F.lit(head), "b").alias("text"))


def accessories(words: DataFrame, examples: DataFrame, pairs: DataFrame, triples: DataFrame, title: str) -> dict[str, DataFrame]:
    """The accessory reports of a book by file name, one text column each; write_text() writes them.

    words: (word, n, level); examples: (word, example); pairs, triples: collocations (phrase, n, pmi).
    """
    order = Window.orderBy(F.desc("pmi"), F.desc("n"), "phrase")
    ranked = lambda df, k: df.orderBy(F.desc("pmi"), F.desc("n"), "phrase").limit(k).select(F.row_number().over(order).alias("no"), "phrase", "n", "pmi")
    both = ranked(pairs, 20).unionAll(ranked(triples, 10).withColumn("no", F.col("no") + 20))
    page = markdown_table(high_frequency(words), title, "rank", "word", "n", "level")
    return {
        "语言学习价值说明.md": value_note(words, title),
        "词频统计报告.md": markdown_table(top_words(words.where(~F.col("word").isin(*L.REPORT_WORDS))), title, "rank", "word", "n"),
        "作者语言风格分析.md": markdown_table(style(words, examples), title, "core", "mean_length", "long"),
        "短语句式统计.md": markdown_table(both, title, "no", "phrase", "n", "pmi"),
        "SRS复习计划.md": markdown_table(plan_note(words), title, "day", "words", "head"),
        "高明词统计.html": page.select(F.concat(F.lit(html_head(title) + "<pre>"), X.html_escape("text"), F.lit("</pre></body></html>")).alias("text")),
    }


def html_head(title: str) -> str:
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title.replace('&', '&amp;').replace('<', '&lt;')}</title></head><body>"


def html_page(entries: DataFrame, title: str) -> DataFrame:
    """One row (html): a page of the entries' HTML in alphabetical order. Entries are a report's bounded selection."""
    body = entries.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("word").alias("w"), "html"))), lambda s: s.html), "\n").alias("b"))
    return body.select(F.concat(F.lit(html_head(title) + "\n"), "b", F.lit("\n</body></html>")).alias("html"))


def html_pages(entries: DataFrame, title: str, size: int = 500) -> DataFrame:
    """(page, html) of all entries in alphabetical order, `size` on a page, for selections that one page can't hold."""
    placed = numbered(entries.select(F.lower("word").alias("w"), "html"), "w", "html", name="__r").withColumn("page", F.floor((F.col("__r") - 1) / size) + 1)
    body = placed.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "html"))), lambda s: s.html), "\n").alias("b"))
    return body.select("page", F.concat(F.lit(html_head(title) + "\n"), "b", F.lit("\n</body></html>")).alias("html"))


def json_page(stats: DataFrame) -> DataFrame:
    """One row (html): statistics inlined as JSON that can't close its script element."""
    data = stats.agg(F.to_json(F.array_sort(F.collect_list(F.struct("*")))).alias("j"))
    return data.select(F.concat(F.lit("<script type='application/json'>"), F.replace("j", F.lit("</"), F.lit("<\\/")), F.lit("</script>")).alias("html"))


def write_text(page: DataFrame, path: str) -> None:
    """Write a one-column page as text wherever Spark can write."""
    page.write.mode("overwrite").text(path)
