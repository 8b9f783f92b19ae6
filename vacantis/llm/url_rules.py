"""URL filters: stated rules first, association rules mined from labelled pages for the rest.

A URL becomes a set of tokens: parts of its host, words of hyphenated parts, path segments that are no
numbers, the file extension, query keys. FP-growth finds token combinations that are frequent among labelled pages;
a rule "combination -> block" or "-> allow" is kept with enough support and confidence, if no part of the
combination already says so as surely. A URL is judged by the surest rule it holds (block among equals),
else by the default. Rules are found by an inverted index: each is filed under its rarest token, and a
URL's tokens look up their files.

Tokens that occur in just the same labelled URLs say the same; they are folded into one item before mining, and
any of them stands for it in matching. So a long URL, however often it is repeated, adds one item of its own
and no 2^k combinations. Mining runs over labelled pages, matching over distinct URLs. Defined cases: a null URL, or one without ``://``, has empty host and path, no tokens,
no rule, and the default verdict. Labels of one page that differ count as block. Pages without labels are
judged but teach nothing; without any labels there are no mined rules. Repeated rows and null ids are
rows like others; other columns are not read.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantis.session import stored


class Rule(NamedTuple):
    """Applies to ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


# The stated rules.
RULES = [
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
]
# A combination must be on so large a share of labelled pages.
MIN_SUPPORT, MIN_CONFIDENCE, DEFAULT = 0.005, 0.8, "allow"
LABEL = "="  # begins the items that are labels, as no token does
# Up to so many mined rules (about 200 bytes each) the index is broadcast, beyond it is joined by shuffle.
BROADCAST_RULES = 50_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def stated(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest stated rule that fits; null without one."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The set of a URL's tokens."""

    def of(kind: str, values: Column) -> Column:
        wanted = F.filter(values, lambda x: (x != "") & ~x.rlike(r"^[0-9]+(\.|$)"))
        return F.transform(wanted, lambda x: F.concat(F.lit(kind + ":"), x))

    labels = F.split(host, r"\.")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    return F.array_distinct(F.concat(
        of("host", labels),
        of("word", F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))),
        of("path", F.split(path, "/")),
        of("type", F.array(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))),
        of("key", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
    ))


def parsed(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = stated(F.col("host"), F.col("path"), rules)
    return rows.select("*", name.alias("rule"), verdict.alias("stated"))


def folded(urls: DataFrame) -> DataFrame:
    """(token, item) of the tokens of distinct (url, tokens) rows: tokens of the same URLs share an item; stored."""
    held = urls.select("url", F.explode("tokens").alias("token"))
    # two hashes of the set of URLs, 128 bits
    of_token = held.groupBy("token").agg(*[F.bit_xor(F.xxhash64("url", F.lit(seed))).alias(f"urls{seed}") for seed in (0, 1)])
    item = of_token.groupBy("urls0", "urls1").agg(F.min("token").alias("item"))
    return stored(of_token.join(item, ["urls0", "urls1"]).select("token", "item"), "items")


def as_items(urls: DataFrame, items: DataFrame) -> DataFrame:
    """(url, tokens) with the items of the tokens; tokens without one are left out, and urls without any."""
    held = urls.select("url", F.explode("tokens").alias("token"))
    return held.join(items, "token").groupBy("url").agg(F.collect_set("item").alias("tokens"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (rule_id, antecedent, verdict, confidence, support, token) from (tokens, verdict) rows.

    ``token`` is the antecedent's rarest, under which the rule is filed.
    """
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items"))
    model = FPGrowth(minSupport=min_support, minConfidence=min_confidence).fit(items)
    is_label = F.col("consequent")[0].startswith(LABEL)
    found = stored(
        model.associationRules.filter(is_label & ~F.exists("antecedent", lambda x: x.startswith(LABEL))).select(
            F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 2, 100).alias("verdict"),
            "confidence", "support",
        ),
        "rules",
    )
    found = found.withColumn("rule_id", F.concat_ws(" ", "verdict", "antecedent"))
    held = F.explode("antecedent").alias("token")
    empty = F.array(F.array().cast("array<string>"))
    subsets = F.aggregate("antecedent", empty, lambda sets, x: F.concat(sets, F.transform(sets, lambda s: F.concat(s, F.array(x)))))
    smaller = F.filter(subsets, lambda s: (F.size(s) > 0) & (F.size(s) < F.size("antecedent")))
    implied = (
        found.select("rule_id", "verdict", F.col("confidence").alias("c"), F.explode(smaller).alias("antecedent"))
        .join(found.select("antecedent", "verdict", "confidence"), ["antecedent", "verdict"])
        .filter(F.col("confidence") >= F.col("c"))
    )
    kept = found.join(implied.select("rule_id").distinct(), "rule_id", "left_anti")
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = kept.select("rule_id", held).join(single, "token").groupBy("rule_id").agg(
        F.min(F.struct("freq", "token"))["token"].alias("token")
    )
    return stored(kept.join(rarest, "rule_id"), "pruned-rules")


def mined_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined, confidence) of the (url, tokens) rows that hold a rule."""
    index = F.broadcast(rules) if rules.count() <= BROADCAST_RULES else rules
    looked_up = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    holds = F.size(F.array_except("antecedent", "tokens")) == 0
    best = F.max(F.struct("confidence", F.col("verdict").alias("mined")))  # "block" comes after "allow"
    return looked_up.filter(holds).groupBy("url").agg(best.alias("best")).select("url", "best.mined", "best.confidence")


def judge(
    pages: DataFrame, labels: DataFrame, rules: list[Rule] = RULES,
    min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """page_id, host, path, rule, verdict (and a mined verdict's confidence) of every page.

    ``labels`` are (page_id, blocked). A page that a stated rule fits is labelled by that rule.
    """
    rows = parsed(pages, rules)
    known = labels.filter(F.col("blocked").isNotNull()).groupBy("page_id").agg(F.max("blocked").alias("blocked"))
    verdict = F.coalesce("stated", F.when(F.col("blocked"), "block").when(~F.col("blocked"), "allow"))
    token_set = tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")
    labelled = stored(rows.join(known, "page_id", "left").select("url", verdict.alias("verdict"), token_set).filter("verdict is not null"), "labelled")
    of_url = labelled.select("url", "tokens").distinct()
    items = folded(of_url)
    taught = labelled.drop("tokens").join(as_items(of_url, items), "url", "left")
    none = F.array().cast("array<string>")
    mined_rules = mine(taught.select(F.coalesce("tokens", none).alias("tokens"), "verdict"), min_support, min_confidence)
    open_urls = rows.filter("rule is null").select("url", "host", "path").distinct().select("url", token_set)
    mined = mined_verdicts(as_items(open_urls, items), mined_rules)
    return rows.join(mined, "url", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("stated", "mined", F.lit(DEFAULT)).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"),
    )
