"""URL filters: fixed host and path rules, then mined association rules.

Every URL is a set of tokens: labels of its host, segments of its path with
digits masked, names of its query. FP-growth finds token sets that are frequent
among labelled pages; those that go with a bad label often enough block. A
mined rule is indexed under its rarest token only, so that a URL meets few
candidates, which are then checked in full. DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtok.llm.common import ascii_lower

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Support as a share and in pages at least, confidence and lift of a mined rule.
SUPPORT, PAGES, CONFIDENCE, LIFT = 0.004, 10, 0.6, 1.5
_BAD = "y:bad"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query; all empty for a null url or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    one = lambda pattern: F.regexp_extract(rest, pattern, 1)
    return ascii_lower(one(r"^([^/?#]*)")), one(r"^[^/?#]*([^?#]*)"), one(r"^[^?#]*\?([^#]*)")


def fixed_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; null where none does."""
    name, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = name.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(v))
    return name, verdict


def tokens(host: Column, path: Column, query: Column) -> Column:
    tag = lambda kind, items: F.transform(F.filter(items, lambda x: F.length(x) > 0), lambda x: F.concat(F.lit(kind), x))
    path = F.regexp_replace(ascii_lower(path), "[0-9]+", "#")
    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_sort(F.array_distinct(F.concat(tag("h:", F.split(host, r"\.")), tag("p:", F.split(path, "/")), tag("q:", names))))


def mine(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """rule_id, items, rarest: token sets whose pages are bad with enough support, confidence and lift, and that hold no smaller such set.

    pages: id and items. A page is bad where a label of its id says toxic or not quality.
    """
    judged = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad"))
    known = pages.where(F.col("id").isNotNull() & (F.size("items") > 0)).join(judged.where("bad is not null"), "id")
    baskets = known.select(F.when(F.col("bad") == 1, F.concat("items", F.array(F.lit(_BAD)))).otherwise(F.col("items")).alias("items"))
    support = min(1.0, max(SUPPORT, PAGES / max(1, baskets.count())))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=CONFIDENCE).fit(baskets)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == _BAD) & (F.col("lift") >= LIFT))
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), F.col("freq"))
    sets = found.select(F.array_sort("antecedent").alias("items")).select(F.xxhash64("items").alias("rule_id"), "items")
    rarest = sets.select("rule_id", "items", F.explode("items").alias("item")).join(single, "item").groupBy("rule_id").agg(F.first("items").alias("items"), F.min_by("item", F.struct("freq", "item")).alias("rarest"))
    rules = rarest.where(F.size("items") > 0)
    # what a smaller rule blocks needs no larger one
    less = rules.select(F.col("rarest").alias("item"), F.col("items").alias("fewer"))
    within = rules.select("rule_id", "items", F.explode("items").alias("item")).join(less, "item").where((F.size("fewer") < F.size("items")) & (F.size(F.array_except("fewer", "items")) == 0))
    return rules.join(within.select("rule_id").distinct(), "rule_id", "left_anti")


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages.

    A null url, or one without ://, has an empty host and path, fits no rule and
    is allowed. Rows with the same or a null id are judged each; no pages give
    no rows, no labels no mined rules; other columns of pages are ignored.
    """
    host, path, query = parts(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"), query.alias("query"))
    seen = seen.select("page_id", "host", "path", tokens(F.col("host"), F.col("path"), F.col("query")).alias("items"))
    mined = mine(seen.select(F.col("page_id").alias("id"), "items"), labels)
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    ruled = seen.select("page_id", "host", "path", "items", name.alias("rule"), verdict.alias("fixed"))

    # each distinct set of tokens meets the index once, however many pages have it
    sets = ruled.where("fixed is null").select("items").groupBy("items").agg(F.lit(1).alias("one")).select("items", F.explode("items").alias("rarest"))
    hit = sets.join(mined.select("rarest", F.col("items").alias("needed")), "rarest").where(F.size(F.array_except("needed", "items")) == 0).select("items").distinct().withColumn("blocked", F.lit(True))
    out = ruled.join(hit, "items", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
