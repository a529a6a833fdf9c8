"""Filtering addresses: given rules first, then rules mined from labelled addresses.

FP-growth finds combinations of address tokens that go along with a label. Rules are kept by support and confidence,
less those that a shorter rule makes needless, and are matched through an index from each rule's rarest token.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from limpid.llm.skew import join_groups
from limpid.storage import materialize

#: A rule table up to this many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_RULES = 10_000
LABEL = "="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path of an address; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls if none fits. ``rules``: (host with path, verdict) pairs."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later and longer ones win
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of an address: every name of the host, the words of the path, and the names in the query."""
    names = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.split(F.lower(path), "[^a-z0-9]+"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    fields = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit("[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    return F.filter(F.array_distinct(F.concat(names, words, fields)), lambda x: F.length(x) > 2)


def mine(labelled: DataFrame, support: float, confidence: float) -> DataFrame:
    """Rules from rows of (tokens, label): rule_id, items, label, confidence, support.

    A rule stays if at least ``support`` of all rows have its tokens and label and at least ``confidence`` of the rows
    with its tokens have the label, unless a rule for the same label with fewer of its tokens is as confident.
    No labelled rows give no rules.
    """
    baskets = labelled.filter(F.col("label").isNotNull() & (F.size("tokens") > 0)).select(
        F.array_append("tokens", F.concat(F.lit(LABEL), "label")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    found = model.associationRules.filter(F.col("consequent")[0].startswith(LABEL)).select(
        F.sort_array("antecedent").alias("items"), F.substring(F.col("consequent")[0], 2, 1000).alias("label"), "confidence", "support")
    found = found.filter(~F.exists("items", lambda x: x.startswith(LABEL)))
    rules = materialize(found.withColumn("rule_id", F.concat_ws(" ", "items", "label")), "mined")
    # A shorter rule that makes another needless shares a token with it and is found under its own first token.
    longer = rules.select("rule_id", "label", "confidence", "items", F.explode("items").alias("token"))
    shorter = rules.select(F.col("items")[0].alias("token"), "label", F.col("items").alias("less"), F.col("confidence").alias("as_sure"))
    needless = longer.join(shorter, ["token", "label"]).filter(
        (F.size("less") < F.size("items")) & (F.col("as_sure") >= F.col("confidence")) & (F.size(F.array_except("less", "items")) == 0))
    return rules.join(needless.select("rule_id").distinct(), "rule_id", "left_anti")


def match(pages: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """The surest rule that fits each row of (key, tokens), for rows that any rule fits: key, label, mined_rule.

    Rules are indexed under their rarest token. Of fitting rules the most confident wins, then the best supported, then
    the last by its text. Rows with equal keys must have equal tokens.
    """
    parts = rules.select("*", F.explode("items").alias("token"))
    often = parts.groupBy("token").agg(F.max("support").alias("often"))
    index = parts.join(often, "token").groupBy("rule_id").agg(
        F.min_by("token", F.struct("often", "token")).alias("token"), F.first("items").alias("items"), F.first("label").alias("label"),
        F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    index = materialize(index, "rule-index")
    if index.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    met = pages.select(key, "tokens", F.explode("tokens").alias("token")).join(index, "token")
    fits = met.filter(F.size(F.array_except("items", "tokens")) == 0)
    best = F.max_by(F.struct("label", "rule_id"), F.struct("confidence", "support", F.col("rule_id")))
    return fits.groupBy(key).agg(best.alias("best")).select(key, F.col("best.label").alias("label"), F.col("best.rule_id").alias("mined_rule"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", support: float = 0.005, confidence: float = 0.8,
          key: str = "page_id", url: str = "url") -> DataFrame:
    """Per row: key, host, path, rule, mined_rule and verdict.

    The given rules decide where one fits, and their verdicts are the labels from which further rules are mined. Rows
    that no rule of either kind fits get ``default``. A null address has no tokens. Rows with equal keys are told apart
    by their address.
    """
    host, path = host_and_path(url)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rule, says = given_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("key", "host", "path", rule.alias("rule"), says.alias("label"), tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"))
    rows = materialize(rows, "addresses")
    # Addresses with the same tokens are judged once, and a common set of tokens is hot.
    decided, left = rows.filter("label is not null"), rows.filter("label is null").withColumn("bag", F.concat_ws(" ", "tokens"))
    bags = left.groupBy("bag").agg(F.first("tokens").alias("tokens"), F.count("*").alias("rows"))
    found = match(bags, mine(rows, support, confidence), "bag").withColumnRenamed("label", "mined")
    groups = materialize(bags.drop("tokens").join(found, "bag"), "judged")
    judged = join_groups(left, groups, "bag", "rows", left.count()).unionByName(decided, allowMissingColumns=True)
    return judged.select(F.col("key").alias(key), "host", "path", "rule", "mined_rule",
                         F.coalesce("label", "mined", F.lit(default)).alias("verdict"))
