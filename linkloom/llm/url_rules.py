"""URL filters: list rules, and association rules mined from the URLs they judge.

The list decides what it covers.  The URLs it decides are labelled examples: Spark's
FP-growth mines combinations of their tokens that imply a verdict (tokens that always
come together are one item), rules are pruned by support, confidence and redundancy,
and an inverted index from each rule's rarest item to the rule finds what applies to
the other URLs.  Everything runs in the JVM.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import ascii_lower, written

#: (verdict, host, path); the longest fitting host and path wins
LIST_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
VERDICT = "verdict:"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*+", 0))), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)), F.lit(""))


def list_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``rule, verdict`` of the longest rule that fits, null if none does."""
    choice = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        choice = F.when(fits, value) if choice is None else choice.when(fits, value)
    return choice if choice is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels, words of path and query; numbers count as one token.

    A token says where it stands (``h:``, ``p:``, ``q:``), a query's are its ``name=value`` parts.
    """
    query = F.regexp_extract(url, r"^[^?#]*+\?([^#]*+)", 1)

    def parts(c: Column, pattern: str, prefix: str) -> Column:
        words = F.split(F.regexp_replace(F.lower(c), "[0-9]++", "0"), pattern)
        return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(prefix), w))

    return F.array_sort(
        F.array_distinct(
            F.concat(parts(url_host(url), r"[.:@]", "h:"), parts(url_path(url), r"[/._-]", "p:"), parts(query, "[&;]", "q:"))
        )
    )


def token_classes(examples: DataFrame, support: float) -> DataFrame:
    """``token, item, freq``: frequent tokens, and the least token that stands in the same examples.

    Tokens of one class never part, so a rule needs at most one of them.  A class
    is the examples' number and two sums of their hashes.  Rows are at most the
    mean number of tokens of an example over ``support``.
    """
    least = math.ceil(support * examples.count())
    sums = [F.sum(F.xxhash64(F.lit(seed), "tokens").cast("decimal(38,0)")).alias(f"s{seed}") for seed in (0, 1)]
    seen = examples.select("tokens", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"), *sums)
    classes = seen.where(F.col("freq") >= least).groupBy("freq", "s0", "s1").agg(F.sort_array(F.collect_list("token")).alias("members"))
    return written(classes.select(F.explode("members").alias("token"), F.col("members")[0].alias("item"), "freq"), "token-classes")


def mine_rules(examples: DataFrame, classes: DataFrame, support: float, confidence: float, longest: int) -> DataFrame:
    """``rule_id, tokens, verdict, confidence, support, index`` from ``tokens, verdict`` rows.

    Rules are mined over the items of ``classes`` (:func:`token_classes`): with every
    token, a path of n segments that many examples share would be 2^n itemsets.
    Kept are rules that imply a verdict, have at most ``longest`` items and are more
    confident than every rule for the same verdict on a part of their items.
    ``index`` is the rule's rarest item.
    """
    known = [r.item for r in classes.select("item").distinct().collect()]
    chosen = F.filter("tokens", lambda t: t.isin(known))
    items = examples.select(F.concat(chosen, F.array(F.concat(F.lit(VERDICT), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    head = F.element_at("consequent", 1)
    rules = model.associationRules.where(head.startswith(VERDICT) & (F.size("antecedent") <= longest)).select(
        F.array_sort("antecedent").alias("tokens"),
        F.substring(head, len(VERDICT) + 1, 100).alias("verdict"),
        "confidence",
        "support",
    )
    rules = written(rules, "mined-rules")
    # a rule is redundant if one of its items may go without loss of confidence
    shorter = rules.where(F.size("tokens") > 1).select(
        "tokens", "verdict", "confidence", F.explode("tokens").alias("gone")
    ).select("tokens", "verdict", "confidence", F.array_remove("tokens", F.col("gone")).alias("part"))
    better = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("of_part"))
    redundant = shorter.join(better, ["part", "verdict"]).where("of_part >= confidence").select("tokens", "verdict")
    rules = rules.join(redundant.distinct(), ["tokens", "verdict"], "left_anti")
    tokens = rules.select("tokens", F.explode("tokens").alias("token"))
    rarest = tokens.join(classes.select("token", "freq"), "token").groupBy("tokens").agg(F.min(F.struct("freq", "token")).alias("r"))
    ranked = rules.join(rarest, "tokens").select(
        F.sha1(F.concat_ws("\n", "verdict", "tokens")).alias("rule_id"),
        "tokens", "verdict", "confidence", "support", F.col("r.token").alias("index"),
    )
    return written(ranked, "rules")


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = LIST_RULES,
    support: float = 0.005,
    confidence: float = 0.8,
    longest: int = 4,
    default: str = "allow",
) -> DataFrame:
    """Every row's ``page_id, host, path, rule, verdict``, and ``learned``: the mined rule's items, if one decided.

    A listed rule decides first (``rule`` is its host and path), then the mined rule
    of highest confidence, support and, on ties, least id that fits, else
    ``default``.  Null URLs and those without ``://`` have empty host and path and
    get the default; ids may be null or repeat; other columns are ignored, whatever
    their names.  Equal URLs are matched once.  Very long URLs are read whole; an
    empty table gives none, and one of which the list judges no URL mines nothing.
    """
    url = F.col("url")
    judged = pages.select("page_id", "url", url_host(url).alias("host"), url_path(url).alias("path"))
    judged = judged.withColumn("listed", list_rule(F.col("host"), F.col("path"), rules))
    examples = judged.where("listed is not null").select(url_tokens(url).alias("tokens"), "listed.verdict")
    if examples.isEmpty():
        found = judged.sparkSession.createDataFrame([], "url string, learned string, learned_verdict string")
    else:
        examples = written(examples, "url-examples")
        classes = token_classes(examples, support)
        mined = mine_rules(examples, classes, support, confidence, longest)
        # any token of a class stands for its item
        needed = classes.join(mined.select(F.explode("tokens").alias("item")).distinct(), "item").select("token", "item")
        index = mined.select(F.col("index").alias("token"), F.col("tokens").alias("needs"), "verdict", "confidence", "support", "rule_id")
        open_urls = judged.where("listed is null and host <> ''").select("url").distinct()
        held = (
            open_urls.select("url", F.explode(url_tokens(url)).alias("token"))
            .join(needed, "token")
            .groupBy("url")
            .agg(F.collect_set("item").alias("tokens"))
        )
        matches = (
            held.select("url", "tokens", F.explode("tokens").alias("token"))
            .join(index, "token")
            .where(F.size(F.array_except("needs", "tokens")) == 0)
        )
        order = F.struct(-F.col("confidence"), -F.col("support"), "rule_id", "verdict", F.concat_ws(" ", "needs").alias("needs"))
        best = matches.groupBy("url").agg(F.min(order).alias("b"))
        found = best.select("url", F.col("b.needs").alias("learned"), F.col("b.verdict").alias("learned_verdict"))
    found = written(found, "url-verdicts")
    return judged.join(found, "url", "left").select(
        "page_id",
        "host",
        "path",
        F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", "learned_verdict", F.lit(default)).alias("verdict"),
        "learned",
    )
