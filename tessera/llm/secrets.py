"""Secret scan with corpus-wide ownership frequency. Built-in functions only.

Base kinds, always spans: ``assign`` (a password-like name, ``:`` or ``=``, a value
of six or more characters), ``access`` (AKIA keys) and ``hex`` (24 or more hex
digits). Patterns also propose ``token`` candidates: 20 or more letters, digits and
``_ + / = -`` with a letter, a digit and at least ten different characters, outside
base spans.

Every candidate value is hashed, and for every hash the distinct owners and
repositories that hold it are counted over the whole corpus, in stages (hash,
owner, repository; then hash, owner; then hash), each pre-aggregated before its
shuffle. A value is a widely copied example if ``example_owners`` owners or more hold
it, or more than one owner in ``example_repositories`` repositories or more together;
any other value is owner-specific, also one that a copy of its document has carried to
a second owner. Owner-specific token candidates look live and are added as spans of the
kind ``token``; others aren't. Base spans stay, whatever the counts, which are reported
beside them.

An example that a third of all documents quote makes a hot hash: its counts come
from partial sums, and it meets the documents in a join of two plain exchanges,
which AQE splits. Documents with equal texts are judged once, by a digest of the
text, so copies don't repeat the work.

Defined cases: a null text is an empty one; null owners and repositories count
as one each. Every row gets one result row, repeated rows repeated ones; a null
doc_id is kept. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled
from .spans import SPAN, count_of, earlier, find, joined, later, let, running

ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
TOKEN = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{20,}+"
KINDS = ("assign", "access", "hex")


def _value(m: Column) -> Column:
    return F.regexp_extract(m, ASSIGN, 1)


def _varied(m: Column) -> Column:
    letters = F.size(F.array_distinct(F.split(m, "")))
    return m.rlike("[A-Za-z]") & (letters >= 10)


def base_spans(text: Column) -> Column:
    return F.concat(
        find(text, ASSIGN, "assign", 0, lambda m: F.length(_value(m)) >= 6, _value),
        find(text, ACCESS, "access", 1, lambda m: F.lit(True)),
        find(text, HEX, "hex", 2, lambda m: F.lit(True)))


def _hashed(spans: Column) -> Column:
    """Values leave the row only as hashes."""
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"),
        F.sha2(s["value"], 256).alias("value")).cast(SPAN))


def apart_from(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span. All spans are put in order; a token stands
    apart if no base span before it ends behind its start and none after it starts before
    its end."""
    def entry(s: Column, is_token: int) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(is_token).alias("token"), s["end"].alias("end"), s.alias("span"))

    def kept(spans: Column) -> Column:
        base_end = F.transform(spans, lambda x: F.when(x["token"] == 0, x["end"]).otherwise(0))
        base_start = F.transform(spans, lambda x: F.when(x["token"] == 0, x["start"]).otherwise(2**31 - 1))
        return let(running(base_end, later), lambda before: let(
            F.reverse(running(F.reverse(base_start), earlier)), lambda behind: F.transform(
                F.filter(spans, lambda x, i: (x["token"] == 1) & (F.get(before, i) <= x["start"])
                         & (F.get(behind, i) >= x["end"])), lambda x: x["span"])))

    both = F.concat(F.transform(base, lambda s: entry(s, 0)), F.transform(tokens, lambda s: entry(s, 1)))
    return F.when((F.size(tokens) > 0) & (F.size(base) > 0), let(F.array_sort(both), kept)).otherwise(tokens)


def find_secrets(docs: DataFrame, owner: Column, repository: Column, example_owners: int = 3,
                 example_repositories: int = 8) -> DataFrame:
    """``doc_id``, ``base`` (spans), ``added`` (spans), ``n_live`` and ``n_example``
    (spans and candidates whose value is owner-specific, or widely copied) for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        F.md5(text).alias("copy"), base_spans(text).alias("base"),
        find(text, TOKEN, "token", 3, _varied).alias("tokens"))
    apart = apart_from(F.col("tokens"), F.col("base"))
    rows = settled(rows.withColumn("tokens", _hashed(apart)).withColumn("base", _hashed(F.col("base"))))

    some = rows.where((F.size("base") > 0) | (F.size("tokens") > 0))
    spans = some.select("copy", "owner", "repository", F.explode(F.concat("base", "tokens")).alias("s"))
    held = spans.groupBy(F.col("s.value").alias("value"), "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = held.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    counts = settled(by_owner.groupBy("value").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories")))

    once = spans.select("copy", "s").distinct().withColumn("value", F.col("s.value"))
    example = (F.col("owners") >= example_owners) | (
        (F.col("owners") > 1) & (F.col("repositories") >= example_repositories))
    live = ~example
    judged = settled(once.join(counts, "value").groupBy("copy").agg(
        F.collect_list(F.when(live & (F.col("s.kind") == "token"), F.col("s"))).alias("added"),
        F.sum(live.cast("long")).alias("n_live"), F.sum(example.cast("long")).alias("n_example"),
        F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories")))
    zero = F.lit(0).cast("long")
    return rows.join(judged, "copy", "left").select(
        "doc_id", "base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")).alias("added"),
        *[F.coalesce(c, zero).alias(c) for c in ("n_live", "n_example", "most_owners", "most_repositories")])


def summary(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", *[count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
        "n_live", "n_example", "most_owners", "most_repositories")
