"""URL filters: association rules mined from labelled URLs, and an explicit rule list.

URLs become sets of tokens: the host, its parent domains, the words of labels
with hyphens, path segments with digits made uniform, query keys. FP-growth finds
token combinations that are frequent together with the label ``bad``. Rules are
pruned by support (a share and a number of bad URLs), by confidence, and by lift:
even the lower bound of the confidence, at the given number of standard errors,
must be above the share of bad URLs among all, so that few labels don't make
rules by chance. Those that a shorter rule makes needless are taken out; the rest
is indexed by each rule's rarest token. A URL looks up the rules of its tokens
and is blocked if all tokens of one are there.

Explicit rules (host, path) come first: a rule fits its host and all subdomains
if the path starts with the rule's; the longest that fits wins.

Defined results: a null url or one without ``://`` has an empty host and path,
fits no rule and matches no mined rule, and is allowed; labels that are null
don't count; without labels of both kinds nothing is mined; repeated URLs get
equal verdicts; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import pick, stored

BAD = "label=bad"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
#: Bad URLs that a rule must hold for, however few are labelled.
MIN_COUNT = 10
#: Standard errors of the lower bound of a rule's confidence.
ERRORS = 4.0
#: Longest token combination of a rule.
MAX_TOKENS = 4


def _after_scheme(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The (rule, verdict) of the longest (verdict, host, path) in ``rules`` that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL; none without a host."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))),
        lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    joined = F.filter(labels, lambda label: label.rlike("[-_]"))  # words of labels that have several
    words = F.transform(F.flatten(F.transform(joined, lambda label: F.split(label, "[-_]+"))), lambda w: F.concat(F.lit("h:"), w))
    segments = F.transform(
        F.regexp_extract_all(path, F.lit(r"[^/]+"), F.lit(0)), lambda s: F.concat(F.lit("p:"), F.regexp_replace(s, r"[0-9]+", "0"))
    )
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.regexp_extract_all(query, F.lit(r"(?:^|&)([^=&]+)"), F.lit(1)), lambda k: F.concat(F.lit("q:"), k))
    return F.when(host != "", F.array_distinct(F.concat(domains, words, segments, keys))).otherwise(F.array().cast("array<string>"))


RULE_SCHEMA = "tokens array<string>, confidence double, support double"


def lower_bound(successes: Column, trials: Column, errors: float) -> Column:
    """The lower end of the Wilson interval of a share."""
    share, z2 = successes / trials, errors * errors
    middle = share + z2 / (2 * trials)
    return (middle - errors * F.sqrt((share * (1 - share) + z2 / (4 * trials)) / trials)) / (1 + z2 / trials)


def mine_rules(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    max_tokens: int = MAX_TOKENS,
    min_count: int = MIN_COUNT,
    errors: float = ERRORS,
) -> DataFrame:
    """Rules (tokens, confidence, support) for ``bad`` from ``labelled`` (url, bad).

    Tokens that are in too few bad URLs for any rule are taken out first; then
    FP-growth keeps at most 1 / ``min_support`` times the tokens of a URL as
    frequent tokens, and conditional trees are spread over the cluster.
    """
    from pyspark.ml.fpm import FPGrowth

    rows = pick(labelled, url="url", bad="bad").filter("bad IS NOT NULL").select(tokens_of(F.col("url")).alias("tokens"), "bad")
    rows = rows.filter(F.size("tokens") > 0)
    total, n_bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    if not 0 < n_bad < total:
        return labelled.sparkSession.createDataFrame([], RULE_SCHEMA)
    least = max(min_support * total, min_count)
    in_bad = rows.filter("bad").select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    useful = in_bad.filter(F.col("n") >= least).select("token")  # at most n_bad / least times the tokens of a URL
    keyed = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "bad", F.explode("tokens").alias("token")).join(useful, "token")
    items = keyed.groupBy("row").agg(F.collect_set("token").alias("tokens"), F.bool_or("bad").alias("bad"))
    baskets = stored(items.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items")), "baskets")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / max(1, baskets.count()))).fit(baskets)
    sets = stored(model.freqItemsets.filter(F.size("items") <= max_tokens + 1).select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    whole = sets.filter(~F.array_contains("items", BAD)).select(F.col("items").alias("tokens"), F.col("freq").alias("freq_all"))
    bad = sets.filter(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("tokens"), "freq")
    confidence = F.col("freq") / F.col("freq_all")
    rules = bad.join(whole, "tokens").select(
        "tokens", confidence.alias("confidence"), (F.col("freq") / total).alias("support"), lower_bound(F.col("freq"), F.col("freq_all"), errors).alias("bound")
    )
    kept = rules.filter((F.col("confidence") >= min_confidence) & (F.col("bound") > n_bad / total)).drop("bound")
    return stored(shortest(stored(kept, "rules")), "rules")


def shortest(rules: DataFrame) -> DataFrame:
    """``rules`` without those that hold a shorter rule of at least their confidence; an inverted index finds the pairs."""
    longer = rules.select(F.col("tokens").alias("own"), F.col("confidence").alias("own_confidence"), F.explode("tokens").alias("token"))
    indexed = rules.select(F.element_at("tokens", 1).alias("token"), F.col("tokens").alias("part"), F.col("confidence").alias("part_confidence"))
    needless = (
        longer.join(indexed, "token")
        .filter((F.size("part") < F.size("own")) & (F.size(F.array_except("part", "own")) == 0) & (F.col("part_confidence") >= F.col("own_confidence")))
        .select("own")
        .distinct()
    )
    return rules.join(needless, rules["tokens"] == needless["own"], "left_anti")


def rule_index(rules: DataFrame, baskets: DataFrame) -> DataFrame:
    """``rules`` with the column ``key``: of each rule's tokens that which is in the fewest of ``baskets`` (tokens)."""
    counts = baskets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    tokens = rules.select(F.col("tokens").alias("rule"), "confidence", "support", F.explode("tokens").alias("token"))
    return (
        tokens.join(counts, "token", "left")
        .groupBy("rule", "confidence", "support")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).getField("token").alias("key"))
    )


def match_rules(urls: DataFrame, index: DataFrame) -> DataFrame:
    """(url, mined): for each distinct url that has all tokens of a rule, the best rule (confidence, support, rule)."""
    asked = urls.select("url").distinct().select("url", tokens_of(F.col("url")).alias("tokens"))
    return (
        asked.withColumn("key", F.explode("tokens"))
        .join(index, "key")
        .filter(F.size(F.array_except("rule", "tokens")) == 0)
        .groupBy("url")
        .agg(F.max(F.struct("confidence", "support", "rule")).alias("mined"))
    )


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, url, host, path, rule, verdict and mined (the mined rule, if any) of each page (page_id, url)."""
    rows = pick(pages, page_id="page_id", url="url")
    mined = mine_rules(labelled)
    index = rule_index(mined, pick(labelled, url="url").select(tokens_of(F.col("url")).alias("tokens")))
    found = match_rules(rows, index).withColumnRenamed("url", "__url")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("fit", first_rule(F.col("host"), F.col("path"), rules)).join(found, F.col("url") == F.col("__url"), "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.col("mined.rule").alias("mined"))
