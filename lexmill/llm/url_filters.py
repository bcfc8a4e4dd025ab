"""URL filters by association rules.

Hand-written rules (host, path) judge the urls that they fit; these verdicts are
the labels. Each labelled url becomes a set of tokens (words of the host, path
segments, query keys, each marked as such), and Spark's FP-growth mines combinations of
tokens that imply a verdict. Rules under the support or confidence limits are
pruned. An inverted index from token to mined rule finds, for a url without a
hand-written rule, the rules all of whose tokens it has; the most confident one
decides, and without any the url is allowed.

FP-growth lists every set of tokens that occur together, which n tokens that
always come together make 2^n of. Two exact reductions come first. Tokens that stand in
the same labelled urls are one class, of which any token will do; those in all of
them tell nothing and are left out. Classes that imply each other (x stands only
where y does) form chains, and a set with two of a chain says no more than the
set without the implied one, so each url is mined once for every choice of one
class from each of its chains. That finds every set that can make a rule; how
often each holds is counted afterwards, over the distinct sets of frequent
classes. A rule must also be surer than its verdict is among all labelled urls.

DataFrame operations and Spark ML only. Frequent classes and the implications
between them are bounded by the tokens of a url over the support limit; chains are
put together on the driver from these. The index is joined by token, on
whichever side Spark finds small.

Contract for odd rows: null urls and urls without "://" have empty host and
path, fit no rule and are allowed; urls of any length are read whole; repeated
rows, also of one id, each get a row; of rules that are equally sure the one
with more support, then fewer tokens, then a verdict of allow decides; other columns take
no part; an empty table gives no rows; without labelled urls nothing is mined.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import durable, fold, table

#: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
SUPPORT, CONFIDENCE, LIFT = 0.01, 0.9, 1.0


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return fold(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url."""
    words = F.transform(F.split(host, r"[.\-]"), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("k:"), x))
    return F.array_distinct(F.filter(F.concat(words, segments, keys), lambda x: F.length(x) > 2))


def classes_of(rows: DataFrame, least: int, total: int) -> DataFrame:
    """(head, alike, n): frequent tokens that stand in the same rows, the first of them as head; none that stands in all rows."""
    each = rows.select("row", F.explode(F.array_distinct("tokens")).alias("token"))
    found = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("b"))
    return found.where((F.col("n") >= least) & (F.col("n") < total)).groupBy("n", "a", "b").agg(F.sort_array(F.collect_list("token")).alias("alike")).select(F.col("alike")[0].alias("head"), "alike", "n")


def chains_of(patterns: DataFrame, classes: DataFrame) -> list[tuple[str, int]]:
    """(head, chain): in a chain every class implies those before it."""
    pairs = patterns.select("weight", "heads", F.explode("heads").alias("x")).select("x", F.explode("heads").alias("y"), "weight").where("x <> y")
    together = pairs.groupBy("x", "y").agg(F.sum("weight").alias("both"))
    implied: dict[str, set[str]] = {}
    for r in together.join(classes.select(F.col("head").alias("x"), "n"), "x").where("both = n").select("x", "y").collect():
        implied.setdefault(r["x"], set()).add(r["y"])
    last: list[str] = []
    out = []
    for r in classes.select("head", "n").orderBy(F.desc("n"), "head").collect():
        chain = next((i for i, y in enumerate(last) if y in implied.get(r["head"], ())), len(last))
        last[chain : chain + 1] = [r["head"]]
        out.append((r["head"], chain))
    return out


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """(rule_id, tokens, alike, verdict, confidence, support) from rows (tokens, verdict).

    tokens: the head of each class, alike: all tokens of each. A rule goes if
    one with a class less is as confident, or if its confidence isn't more
    than `lift` times the verdict's share.
    """
    spark = labelled.sparkSession
    rows = durable(labelled.select("tokens", "verdict", F.monotonically_increasing_id().alias("row")))
    shares = {r["verdict"]: r["count"] for r in rows.groupBy("verdict").count().collect()}
    total = sum(shares.values())
    least = max(1, math.ceil(support * total - 1e-9))
    classes = durable(classes_of(rows, least, total))
    head_of = classes.select(F.explode("alike").alias("token"), "head")
    heads = rows.select("row", F.explode("tokens").alias("token")).join(head_of, "token").groupBy("row").agg(F.sort_array(F.collect_set("head")).alias("heads"))
    lean = rows.select("row", "verdict").join(heads, "row")
    patterns = durable(lean.groupBy("heads", "verdict").agg(F.count("*").alias("weight")))
    chains = spark.createDataFrame(chains_of(patterns, classes), "head string, chain int")

    # One set for each choice of a class from each chain of a pattern; as often as the pattern stands.
    numbered = patterns.withColumn("pattern", F.monotonically_increasing_id())
    per_chain = numbered.select("pattern", F.explode("heads").alias("head")).join(chains, "head").groupBy("pattern", "chain").agg(F.collect_list("head").alias("some")).groupBy("pattern").agg(F.collect_list("some").alias("choices"))
    product = F.aggregate("choices", F.array(F.array().cast("array<string>")), lambda sets, some: F.flatten(F.transform(sets, lambda x: F.transform(some, lambda y: F.concat(x, F.array(y))))))
    verdict = F.concat(F.lit("v:"), "verdict")
    chosen = numbered.join(per_chain, "pattern").select("verdict", "weight", F.explode(product).alias("set"))
    items = durable(chosen.select(F.concat("set", F.array(verdict)).alias("items"), F.explode(F.sequence(F.lit(1), "weight"))).select("items"))
    several = max(1, items.count())
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / several, minConfidence=1.0).fit(items).freqItemsets if chains.count() else spark.createDataFrame([], "items array<string>, freq long")
    sets = found.where(F.exists("items", lambda x: x.startswith("v:")) & (F.size("items") > 1)).select(F.array_sort(F.filter("items", lambda x: ~x.startswith("v:"))).alias("tokens")).distinct()
    sets = durable(sets.withColumn("set", F.xxhash64("tokens")))

    # Exact counts over the distinct patterns.
    index = sets.select("set", F.size("tokens").alias("needed"), F.explode("tokens").alias("head"))
    within = numbered.select("pattern", F.explode("heads").alias("head")).join(index, "head").groupBy("pattern", "set", "needed").agg(F.count("*").alias("held")).where("held = needed")
    counted = within.join(numbered.select("pattern", "verdict", "weight"), "pattern").groupBy("set", "verdict").agg(F.sum("weight").alias("n"))
    every = counted.groupBy("set").agg(F.sum("n").alias("all"))
    share = F.create_map(*(F.lit(x) for v, n in shares.items() for x in (v, n / total)))[F.col("verdict")] if shares else F.lit(None).cast("double")
    sure = counted.join(every, "set").withColumn("confidence", F.col("n") / F.col("all")).withColumn("support", F.col("n") / F.lit(max(1, total)))
    sure = sure.where((F.col("n") >= least) & (F.col("confidence") >= confidence) & (F.col("confidence") > lift * share)).join(sets, "set")
    rules = durable(sure.select("tokens", "verdict", "confidence", "support", F.xxhash64("tokens", "verdict").alias("rule_id")))
    shorter = rules.select("rule_id", "confidence", F.explode(F.transform("tokens", lambda x: F.xxhash64(F.array_except("tokens", F.array(x)), "verdict"))).alias("part"))
    needless = shorter.alias("a").join(rules.alias("b"), (F.col("a.part") == F.col("b.rule_id")) & (F.col("b.confidence") >= F.col("a.confidence"))).select("a.rule_id")
    kept = rules.join(needless, "rule_id", "left_anti")
    alike = kept.select("rule_id", F.explode("tokens").alias("head")).join(classes.select("head", "alike"), "head").groupBy("rule_id").agg(F.array_sort(F.collect_list("alike")).alias("alike"))
    return kept.join(alike, "rule_id")


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, mined): mined holds the tokens of the mined rule that decided, or null."""
    host, path = parts(F.col(url_col))
    split = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = durable(split.select("id", "host", "path", rule.alias("rule"), verdict.alias("given"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), F.monotonically_increasing_id().alias("row")))
    labelled = judged.where("given is not null").select("tokens", F.col("given").alias("verdict"))
    if labelled.isEmpty():
        return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("given", F.lit("allow")).alias("verdict"), F.lit(None).cast("array<string>").alias("mined"))
    mined = durable(mine(labelled))
    index = mined.select(F.posexplode("alike").alias("part", "any"), "rule_id", F.size("tokens").alias("needed"), "verdict", "confidence", "support", "tokens")
    index = index.select(F.explode("any").alias("token"), *(c for c in index.columns if c != "any"))
    open_ = judged.where("given is null").select("row", F.explode("tokens").alias("token"))
    full = open_.join(index, "token").groupBy("row", "rule_id", "needed", "verdict", "confidence", "support", "tokens").agg(F.size(F.collect_set("part")).alias("n")).where("n = needed")
    strength = F.struct("confidence", "support", -F.col("needed"), F.col("verdict") == "allow", "rule_id")
    decided = full.groupBy("row").agg(F.max_by(F.struct("verdict", "tokens"), strength).alias("decided"))
    return judged.join(decided, "row", "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("given", "decided.verdict", F.lit("allow")).alias("verdict"), F.when(F.col("given").isNull(), F.col("decided.tokens")).alias("mined")
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("mined")
