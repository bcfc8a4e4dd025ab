"""Merging of near-identical senses of a word from several dictionaries; merging of model replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import expressions as X
from lexmill.functions import lexicon as L

ALIKE, CONTAINED, LEAST_TOKENS = 0.6, 0.4, 3


def sense_key(text) -> tuple:
    """(key, tokens) columns of a sense: no brackets, no part of speech at the start, lower case, no marks at the ends."""
    t = F.regexp_replace(F.replace(X.col(text), F.lit("\\n"), F.lit("\n")), r"[\[〔].*?[\]〕]", " ")
    t = F.regexp_replace(F.regexp_replace(t, L.GLOSS_POS, ""), r"[ \t]+", " ")
    key = F.regexp_replace(F.lower(X.stripped(t)), r"""^[ .,;:()'"…]+|[ .,;:()'"…]+$""", "")
    return key, F.array_distinct(F.regexp_extract_all(key, F.lit("[a-z]+"), F.lit(0)))


def merge_senses(items: DataFrame) -> DataFrame:
    """(word, lang, sense_no, text, sources) from (word, text, source, lang, ord).

    In order, a sense joins the first earlier one it is close to: same key, token
    overlap of 0.6, or containment; the longer text stands for both. The fold
    needs order, so rows stream sorted by word; only the merged senses of one
    word are held.
    """
    key, tokens = sense_key("text")
    ready = items.where((X.stripped("text") != "") & (X.stripped("source") != "")).select("word", X.stripped("text").alias("text"), X.stripped("source").alias("source"), F.coalesce("lang", F.lit("en")).alias("lang"), "ord", key.alias("key"), tokens.alias("tokens")).where("key <> ''")

    def close(a: str, x: set, b: str, y: set) -> bool:
        if a == b or (x | y and len(x & y) / len(x | y) >= ALIKE):
            return True
        (short, few), (long_, _) = sorted(((a, x), (b, y)), key=lambda p: len(p[0]))
        return short in long_ and len(short) >= CONTAINED * len(long_) and len(few) >= LEAST_TOKENS

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, done = None, [], []
        for batch in batches:
            for word, lang, text, source, name, tokens in zip(*(batch.column(c).to_pylist() for c in ("word", "lang", "text", "source", "key", "tokens")), strict=True):
                if at != (word, lang):
                    done += [(*at, i, h[2], h[3]) for i, h in enumerate(held, 1)] if at else []
                    at, held = (word, lang), []
                own = set(tokens)
                for h in held:
                    if close(name, own, h[0], h[1]):
                        if source not in h[3]:
                            h[3].append(source)
                        if len(name) > len(h[0]):
                            h[0], h[1], h[2] = name, own, text
                        break
                else:
                    held.append([name, own, text, [source]])
            yield merged(done)
            done = []
        yield merged([(*at, i, h[2], h[3]) for i, h in enumerate(held, 1)] if at else [])

    def merged(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["word", "lang", "sense_no", "text", "sources"])

    ordered = ready.repartition("word", "lang").sortWithinPartitions("word", "lang", "ord", "source", "text")
    return ordered.mapInArrow(fold, "word string, lang string, sense_no int, text string, sources array<string>")


def similar_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard) of pairs of sets (item_id, ts) that overlap by `least` or more.

    Two such sets share one of the rarest size - ceil(least * size) + 1 tokens of
    each, so only these are joined: the commonest tokens never meet.
    """
    tokens = sets.select("item_id", F.size("ts").alias("size"), F.explode("ts").alias("x"))
    ranked = tokens.join(tokens.groupBy("x").agg(F.count("*").alias("df")), "x").withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy("df", "x")))
    rare = ranked.where(F.col("r") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1)
    a, b = (rare.select("x", F.col("item_id").alias(n), F.col("size").alias(f"{n}_size")) for n in ("a", "b"))
    alike = (F.col("a") < F.col("b")) & (F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * least - 1e-9)
    met = a.join(b, "x").where(alike).select("a", "b").distinct()
    whole = lambda n: sets.select(F.col("item_id").alias(n), F.col("ts").alias(f"{n}_ts"))
    common = F.size(F.array_intersect("a_ts", "b_ts"))
    scored = met.join(whole("a"), "a").join(whole("b"), "b").withColumn("jaccard", common / (F.size("a_ts") + F.size("b_ts") - common))
    return scored.where(F.col("jaccard") >= least).select("a", "b", "jaccard")


def batches(words: DataFrame, size: int, *order) -> DataFrame:
    """words with a batch number for each `size` rows."""
    from lexmill.operators.ranking import numbered

    return numbered(words, *order, name="__n").withColumn("batch", F.floor((F.col("__n") - 1) / size)).drop("__n")


def ask(words: DataFrame, size: int, call: Callable[[list[str]], str]) -> DataFrame:
    """(batch, words, reply): call (injected, picklable) is given the words of a batch; a call that fails replies null."""
    grouped = batches(words.select("word"), size, "word").groupBy("batch").agg(F.array_sort(F.collect_list("word")).alias("words"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies = []
            for ws in frame["words"]:
                try:
                    replies.append(call(list(ws)))
                except (RuntimeError, ValueError, OSError):
                    replies.append(None)
            yield frame.assign(reply=replies)

    return grouped.mapInPandas(run, "batch long, words array<string>, reply string")


REPLY = "array<struct<headword:string,pos:string,gloss_zh:string,gloss_en:string,ipa:map<string,string>,cefr_level:string>>"


def parse_replies(replies: DataFrame) -> DataFrame:
    """(word, pos, gloss_zh, gloss_en, ipa, cefr_level) of the entries that were asked for; text around the JSON is ignored."""
    found = F.coalesce(F.from_json("reply", REPLY), F.from_json(F.regexp_extract("reply", r"(?s)\[.*\]", 0), REPLY))
    rows = replies.select("words", F.explode(found).alias("e")).withColumn("word", F.lower(F.trim("e.headword")))
    return rows.where(F.array_contains(F.transform("words", lambda w: F.lower(w)), F.col("word"))).select("word", "e.pos", "e.gloss_zh", "e.gloss_en", "e.ipa", "e.cefr_level").dropDuplicates(["word"])


def merge_replies(entries: DataFrame, replies: DataFrame) -> DataFrame:
    """Non-empty fields of a reply replace those of the entry."""
    r = replies.select("word", *(F.col(c).alias(f"__{c}") for c in ("pos", "gloss_zh", "gloss_en", "cefr_level")))
    out = entries.join(r, "word", "left")
    return out.select(*(F.coalesce(F.nullif(F.trim(f"__{c}"), F.lit("")), F.col(c)).alias(c) if f"__{c}" in out.columns else F.col(c) for c in entries.columns))


def batch_prompt(words, title=None, author=None):
    """The request for the entries of an array of words."""
    ws = X.col(words)
    book = F.lit("") if title is None else F.when(X.col(title) != "", F.concat(F.lit("（来源书籍："), X.col(title), F.lit("，作者："), F.coalesce(X.col(author), F.lit("")), F.lit("）"))).otherwise("")
    numbered = F.array_join(F.transform(ws, lambda w, i: F.concat((i + 1).cast("string"), F.lit(". "), w)), "\n")
    return F.concat(F.lit("请为以下 "), F.size(ws).cast("string"), F.lit(" 个单词批量生成词汇信息"), book, F.lit("：\n\n"), numbered, F.lit("\n\n按序号顺序输出 JSON 数组，每个元素 headword 必须与输入一致。"))


def suspects_prompt(suspects):
    """The request to judge an array of (word, n, cap_ratio)."""
    line = lambda s: F.concat(F.lit("- "), s["word"], F.lit("（出现 "), s["n"].cast("string"), F.lit(" 次，大写比例 "), s["cap_ratio"].cast("string"), F.lit("）"))
    return F.concat(F.lit("请判别以下候选词（依次给出 decision）：\n\n"), F.array_join(F.transform(X.col(suspects), line), "\n"))


DECISION = "decisions array<struct<word:string,action:string,replacement:string,reason:string>>"


def parse_decisions(replies: DataFrame, *kept: str) -> DataFrame:
    """(kept.., word, action, replacement, reason) of replies (kept.., reply): text around the JSON is ignored, unknown actions keep, the last of a word holds."""
    read = lambda c: F.from_json(c, DECISION)["decisions"]
    found = F.coalesce(read(F.col("reply")), read(F.regexp_extract("reply", r"(?s)\{.*\}", 0)))
    d = replies.select(*kept, F.posexplode(found).alias("i", "d"))
    tidy = lambda c: X.stripped(F.coalesce(F.col(f"d.{c}"), F.lit("")))
    action = F.lower(tidy("action"))
    rows = d.select(*kept, "i", F.lower(tidy("word")).alias("word"), F.when(action.isin(*L.DECISIONS), action).otherwise("keep").alias("action"), F.lower(tidy("replacement")).alias("replacement"), F.substring(tidy("reason"), 1, 200).alias("reason"))
    last = rows.where("word <> ''").groupBy(*kept, "word").agg(F.max_by(F.struct("action", "replacement", "reason"), "i").alias("d"))
    return last.select(*kept, "word", "d.action", "d.replacement", "d.reason")


def classify(suspects: DataFrame, size: int, call: Callable[[str], str]) -> DataFrame:
    """Decisions (word, action, replacement, reason) of a model on suspects (word, n, cap_ratio), asked in batches; a batch that fails decides nothing."""
    rows = batches(suspects.select("word", "n", "cap_ratio"), size, F.desc("n"), "word")
    order = F.struct((-F.col("n")).alias("r"), "word", "n", "cap_ratio")
    prompts = rows.groupBy("batch").agg(F.array_sort(F.collect_list(order)).alias("ss")).select("batch", suspects_prompt("ss").alias("prompt"))
    return parse_decisions(_answers(prompts, call))


def _answers(prompts: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """(batch, reply) of (batch, prompt); call is injected and picklable."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies = []
            for prompt in frame["prompt"]:
                try:
                    replies.append(call(prompt))
                except (RuntimeError, ValueError, OSError):
                    replies.append(None)
            yield pd.DataFrame({"batch": frame["batch"], "reply": replies})

    return prompts.mapInPandas(run, "batch long, reply string")


def must_keep(words: DataFrame, call: Callable[[str], str], title: str = "", top: int = 150, size: int = 15) -> DataFrame:
    """(word, reasons): the terms of a book that a model names among the most frequent words (word, n), asked in batches."""
    best = words.select("word", "n").orderBy(F.desc("n"), "word").limit(top)
    rows = batches(best, size, F.desc("n"), "word").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), "word", "n"))).alias("ws"))
    listed = F.array_join(F.transform("ws", lambda w: F.concat(F.lit("- "), w["word"], F.lit("（出现 "), w["n"].cast("string"), F.lit(" 次）"))), "\n")
    answers = _answers(rows.select("batch", F.concat(F.lit(f"书名：{title}\n候选词：\n"), listed).alias("prompt")), call)
    read = lambda c: F.from_json(c, "must_keep array<struct<word:string,reason:string>>")["must_keep"]
    found = answers.select("batch", F.posexplode(F.coalesce(read(F.col("reply")), read(F.regexp_extract("reply", r"(?s)\{.*\}", 0)))).alias("i", "k"))
    named = found.select(F.lower(X.stripped("k.word")).alias("word"), F.struct("batch", "i", F.substring(F.coalesce("k.reason", F.lit("")), 1, 200).alias("reason")).alias("r")).where("word <> ''")
    return named.join(best.select("word"), "word", "left_semi").groupBy("word").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["reason"]).alias("reasons"))


def apply_decisions(tokens: DataFrame, decisions: DataFrame) -> DataFrame:
    """tokens (.., lemma) after decisions (word, action, replacement): repaired and respelled ones rewritten, names and noise dropped, others kept."""
    d = decisions.select(F.lower("word").alias("lemma"), F.when(F.col("action").isin("repair", "spelling", "proper", "noise"), F.col("action")).otherwise("keep").alias("action"), "replacement")
    joined = tokens.join(d, "lemma", "left").where(F.coalesce("action", F.lit("keep")).isin("repair", "spelling", "keep"))
    rewritten = F.when(F.col("action").isin("repair", "spelling"), F.coalesce(F.nullif(F.trim("replacement"), F.lit("")), F.col("lemma"))).otherwise(F.col("lemma"))
    return joined.withColumn("lemma", rewritten).select(*tokens.columns)


def apply_fixes(entries: DataFrame, fixes: DataFrame) -> DataFrame:
    """entries (word, pos, gloss_zh, gloss_en) after fixes (word, field, after, action, ord): the last fix of a field holds; removed words go."""
    named = fixes.withColumn("field", F.element_at(F.split("field", "[.]"), -1)).groupBy("word").agg(
        F.max(F.col("action") == "remove").alias("__gone"), *(F.max_by(F.when(F.col("field") == c, F.col("after")), F.when(F.col("field") == c, F.col("ord"))).alias(f"__{c}") for c in entries.columns if c != "word")
    )
    out = entries.join(named, "word", "left").where(~F.coalesce("__gone", F.lit(False)))
    return out.select("word", *(F.coalesce(f"__{c}", c).alias(c) for c in entries.columns if c != "word"))


