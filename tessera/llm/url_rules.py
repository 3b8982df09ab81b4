"""Association-rule URL filter: FP-growth mines token combinations of labelled
URLs; the rules it leaves judge every URL that no curated rule fits.

Curated rules are pairs of a host and a path prefix with a verdict; a rule fits
its host and all subdomains if the path starts with the rule's, and the longest
fitting rule decides.

Mining. A URL becomes a set of tokens: scheme, host labels and their words, path
segments and their words, extension, query keys and pairs, fragment; a run of digits
reads as ``0``. Each distinct labelled URL is one transaction of its frequent tokens
and its label, so copies add no evidence. Two steps keep the itemsets few without
losing a rule: tokens that occur in all labelled URLs are left out, and tokens
that occur in exactly the same URLs count as one, named by the least (their
combinations would repeat each other). All tokens left take part. Where no URL has
more than ``mining_tokens`` of them, Spark's FP-growth counts the itemsets; a longer
URL has too many combinations to list (2^n), so ``level_sets`` then finds, size by
size, the sets that may be rules: exact too, the rules are the same. An antecedent
makes a rule for a label if it is frequent, the label's confidence reaches
``min_confidence``, and no antecedent with one token less is as confident up to
``min_gain`` (the empty one has the label's share).

Match. The inverted index has a row per rule and token. A URL's tokens look up
their postings, and a rule fires where as many postings arrive as it has tokens.
The most confident rule decides, then the one with more URLs behind it, then the
longer, then the least by text. Without one the verdict is ``allow``.

Scale: labelled URLs and tokens are counted by pre-aggregated jobs; the driver
sees the frequent items (at most a URL's tokens / ``min_support``). Index and
frequent tokens are broadcast only after a count. URLs are judged once each and
joined back by digest, so a URL, host or token with a third of all rows is
collapsed before it is shuffled; the join's hot digests are split by AQE.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits
no curated rule and has no tokens; it is allowed. Rules with path ``/`` don't fit
a URL whose path is empty. Labels that are null take no part; a URL labelled both
ways counts as bad. Repeated and null ids stay as they are; extra columns are
ignored. Without labelled URLs there are no mined rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, small_side

BLOCK, ALLOW = "=block", "=allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def curated(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict (both null if none fits).
    ``rules``: a short hand-written list of (verdict, host, path)."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, in order of their text."""
    low = F.regexp_replace(F.translate(url, _UPPER, _LOWER), r"[0-9]+", "0")
    h, p = host(low), path(low)
    query = F.regexp_extract(_rest(low), r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(_rest(low), r"^[^#]*#([^#].*)$", 1)

    def pieces(text: Column, at: str, mark: str) -> Column:
        whole = F.filter(F.split(text, at), lambda x: x != "")
        words = F.filter(F.flatten(F.transform(
            F.filter(whole, lambda x: x.rlike("[-_.+~]")), lambda x: F.split(x, "[-_.+~]"))), lambda x: x != "")
        return F.transform(F.concat(whole, words), lambda x: F.concat(F.lit(mark), x))

    pairs = F.filter(F.split(query, "[&;]"), lambda x: x != "")
    last = F.regexp_extract(p, r"\.([a-z]+)$", 1)
    lone = F.filter(F.array(
        F.concat(F.lit("s:"), F.substring_index(low, "://", 1)),
        F.when(last != "", F.concat(F.lit("x:"), last)),
        F.when(fragment != "", F.concat(F.lit("f:"), fragment))), lambda x: x.isNotNull())
    found = F.concat(lone, pieces(h, r"\.", "h:"), pieces(p, "/", "p:"),
                     F.transform(pairs, lambda x: F.concat(F.lit("q:"), x)),
                     F.transform(pairs, lambda x: F.concat(F.lit("k:"), F.substring_index(x, "=", 1))))
    return F.when(F.instr(url, "://") > 0, F.array_sort(F.array_distinct(found))).otherwise(
        F.array().cast("array<string>"))


def transactions(labelled: DataFrame, min_support: float, min_count: int):
    """``labelled``: url, bad (boolean). Returns (transactions: key, bad and all
    frequent ``items``; their number, the bad ones, the least number of URLs of an
    itemset)."""
    urls = settled(labelled.where("url is not null and bad is not null").groupBy("url").agg(F.max("bad").alias("bad"))
                   .select(F.md5("url").alias("key"), "bad", tokens(F.col("url")).alias("tokens")))
    total, bad = urls.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    least = max(min_count, -int(-min_support * total // 1))
    if not total:
        return None, 0, 0, least
    mix = F.xxhash64("key")
    seen = (urls.select("key", "bad", F.explode("tokens").alias("token"))
            .groupBy("token").agg(
                F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"),
                F.sum(mix.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
                F.sum(F.shiftrightunsigned(mix, 32)).alias("high"))
            .where((F.col("n") >= least) & (F.col("n") < total)))
    # tokens of the same URLs: one item, named by the least of them
    items = seen.groupBy("n", "n_bad", "low", "high").agg(F.min("token").alias("token")).select("token")
    kept = (urls.select("key", F.explode("tokens").alias("token")).join(small_side(settled(items)), "token")
            .groupBy("key").agg(F.collect_list("token").alias("items")))
    return (urls.select("key", "bad").join(kept, "key", "left")
            .select("key", "bad", F.coalesce("items", F.array().cast("array<string>")).alias("items")),
            total, bad, least)


def level_sets(baskets: DataFrame, total: int, bad: int, least: int, min_gain: float) -> DataFrame:
    """The itemsets that may be rules, and all their subsets: antecedent, label
    (null: any), n. Sets grow by one item a round, in each URL from two sets that
    differ in their last item.

    A set may be a rule for a label if ``least`` URLs of the label have it and each
    of its items keeps out URLs of the other label that have all the others: fewer
    than ``min_gain`` * ``least`` of them, or none, can't raise the confidence by
    ``min_gain``. A superset has no more URLs of either kind, so nothing that grows
    from a set dropped here could be a rule."""
    spark = baskets.sparkSession
    # a hair less, so that rounding can't drop a set; without a gain there is nothing to go by
    spared = max(1.0, min_gain * least * (1 - 1e-9)) if min_gain > 1e-9 else 0.0
    found = spark.createDataFrame([], "antecedent array<string>, label string, n long")
    before = spark.createDataFrame([([], BLOCK, total - bad), ([], ALLOW, bad)],
                                   "shorter array<string>, label string, wrong_before long")
    pairs = baskets.select("key", "bad", F.explode("items").alias("item")).select(
        "key", "bad", F.array("item").alias("antecedent"))
    shorter = F.explode(F.expr("transform(antecedent, x -> filter(antecedent, y -> y <> x))")).alias("shorter")
    while True:
        pairs = settled(pairs)
        counts = pairs.groupBy("antecedent").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"))
        good = F.col("n") - F.col("n_bad")
        sides = counts.select("antecedent", "n", F.inline(F.array(
            F.struct(F.lit(BLOCK).alias("label"), F.col("n_bad").alias("right"), good.alias("wrong")),
            F.struct(F.lit(ALLOW).alias("label"), good.alias("right"), F.col("n_bad").alias("wrong")))))
        left = settled(sides.where(F.col("right") >= least).select("*", shorter).join(before, ["shorter", "label"])
                       .where(F.col("wrong_before") - F.col("wrong") >= spared)
                       .groupBy("antecedent", "label", "n", "right", "wrong").agg(F.count(F.lit(1)).alias("held"))
                       .where(F.col("held") == F.size("antecedent")))
        found = (found.unionByName(left.select("antecedent", "label", F.col("right").alias("n")))
                 .unionByName(left.select("antecedent", F.lit(None).cast("string").alias("label"), "n").distinct()))
        grows = left.where(F.col("wrong") >= spared)
        if grows.isEmpty():
            return found
        before = grows.select(F.col("antecedent").alias("shorter"), "label", F.col("wrong").alias("wrong_before"))
        live = pairs.join(small_side(settled(grows.select("antecedent").distinct())), "antecedent").select(
            "key", "bad", "antecedent", F.expr("slice(antecedent, 1, size(antecedent) - 1)").alias("start"),
            F.element_at("antecedent", -1).alias("last"))
        pairs = (live.join(live.select("key", "start", F.col("last").alias("next")), ["key", "start"])
                 .where(F.col("last") < F.col("next"))
                 .select("key", "bad", F.concat("antecedent", F.array("next")).alias("antecedent")))


def mine(labelled: DataFrame, min_support: float = 0.002, min_count: int = 20, min_confidence: float = 0.9,
         min_gain: float = 0.01, mining_tokens: int = 16) -> DataFrame:
    """Rules: antecedent (sorted tokens), verdict, n (URLs with the antecedent),
    confidence. ``min_support`` is a share of the distinct labelled URLs, never
    below ``min_count`` URLs. ``mining_tokens``: the most frequent tokens that a URL
    may have for FP-growth; it chooses the way, not the rules."""
    spark = labelled.sparkSession
    baskets, total, bad, least = transactions(labelled, min_support, min_count)
    schema = "antecedent array<string>, verdict string, n long, confidence double"
    if total < least:
        return spark.createDataFrame([], schema)
    baskets = settled(baskets)
    if baskets.agg(F.max(F.size("items"))).first()[0] <= mining_tokens:
        marked = baskets.select(F.concat(
            "items", F.array(F.when(F.col("bad"), BLOCK).otherwise(ALLOW))).alias("items"))
        # half a URL less, so that rounding can't turn the least number into the next one
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, minConfidence=1.0).fit(marked)
        sets = settled(model.freqItemsets.select(
            F.array_sort(F.filter("items", lambda x: ~x.isin(BLOCK, ALLOW))).alias("antecedent"),
            F.get(F.filter("items", lambda x: x.isin(BLOCK, ALLOW)), F.lit(0)).alias("label"),
            F.col("freq").alias("n")))
    else:
        sets = settled(level_sets(baskets, total, bad, least, min_gain))
    alone = sets.where("label is null and size(antecedent) > 0").select("antecedent", "n")
    sure = (sets.where("label is not null and size(antecedent) > 0")
            .join(alone.withColumnRenamed("n", "n_all"), "antecedent")
            .select("antecedent", F.substring("label", 2, 99).alias("verdict"), F.col("n_all").alias("n"),
                    (F.col("n") / F.col("n_all")).alias("confidence")))
    base = F.when(F.col("verdict") == "block", F.lit(bad / total)).otherwise(F.lit(1 - bad / total))
    shorter = F.explode(F.expr(
        "transform(antecedent, x -> filter(antecedent, y -> y <> x))")).alias("shorter")
    before = sure.select(F.col("antecedent").alias("shorter"), "verdict", F.col("confidence").alias("less"))
    return (sure.where(F.col("confidence") >= min_confidence)
            .select("antecedent", "verdict", "n", "confidence", shorter)
            .join(before, ["shorter", "verdict"], "left")
            .groupBy("antecedent", "verdict", "n", "confidence")
            .agg(F.max(F.when(F.size("shorter") == 0, base).otherwise(F.coalesce("less", F.lit(0.0)))).alias("less"))
            .where(F.col("confidence") >= F.col("less") + min_gain).drop("less"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls``: key, tokens. The deciding rule of each key that has one: key,
    verdict, mined_rule (its tokens), confidence."""
    index = settled(rules.select(
        F.array_join("antecedent", " ").alias("mined_rule"), F.size("antecedent").alias("need"),
        "verdict", "confidence", "n", F.explode("antecedent").alias("token")))
    fired = (urls.select("key", F.explode("tokens").alias("token")).join(small_side(index), "token")
             .groupBy("key", "mined_rule", "need", "verdict", "confidence", "n").agg(F.count(F.lit(1)).alias("got"))
             .where("got = need"))
    best = F.struct((-F.col("confidence")).alias("c"), (-F.col("n")).alias("s"), (-F.col("need")).alias("l"),
                    F.col("mined_rule"), F.col("verdict"))
    return (fired.groupBy("key").agg(F.min(best).alias("best"))
            .select("key", "best.verdict", "best.mined_rule", (-F.col("best.c")).alias("confidence")))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], mined: DataFrame, default: str = ALLOW[1:]) -> DataFrame:
    """Every row of ``pages`` (page_id, url) with host, path, rule, verdict and
    the mined rule that decided, where one did."""
    rows = pages.select("page_id", "url").select(
        "page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = curated(F.col("host"), F.col("path"), rules)
    # rows that a rule judges meet nothing in the join, but have keys of their own, so that they spread
    none = F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn(
        "key", F.when(F.col("rule").isNull() & F.col("url").isNotNull(), F.md5("url")).otherwise(none))
    urls = (rows.where("rule is null and url is not null").groupBy("key").agg(F.first("url").alias("url"))
            .select("key", tokens(F.col("url")).alias("tokens")))
    return rows.join(match(urls, mined), "key", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "verdict", F.lit(default)).alias("verdict"),
        "mined_rule", "confidence")
