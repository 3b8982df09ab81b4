"""Mixing sources to target weights by Pareto order sampling.

Targets: the mix has ``total_share`` of all words; each source gets a part by
its weight, but at most ``cap`` times its own words, and what the cap cuts off
goes to the others by weight until none is above (one threshold, found over the
table of sources sorted by cap over weight).

Sample: every document has a weight (one, unless given); the copies of a document expected
are its weight times the source's level, ``cap`` at most, the level being such that the
expected words make the target (again one threshold, over the source's weights, sorted).
The whole part of these copies is certain; the rest p is the inclusion probability of one
more copy, different from source to source and from weight to weight. The documents of a
source are ranked by u/(1-u) over p/(1-p), u being uniform and a hash of the doc_id (random
odds over inclusion odds), and are taken in this order until the source's words are reached: the
size is fixed, in words. The document on the boundary gives only the words that are still
missing.

A source may hold any share of all rows: ranks are cut into ``buckets`` equal
slots of q/(1+q), word sums per source and slot say in which slot the target is
reached, and only that slot's documents are sorted. The texts are never shuffled.
Only one row per source and one document per source on the boundary travel to
the rows, broadcast when counted below a limit.

Defined cases: a null text has size 0. A null source is a source of its own,
listed last. Sources without words have target 0. Rows that share doc_id, source
and size rank as one tie and share its missing words evenly (rounded down); a
null doc_id ranks as the text 'null'. Weights are positive, of few different values; a null
one is one. Empty tables give empty results. Extra columns are ignored or, in
``materialise``, repeated with their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, settled, small_side

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5,
            cap: int = 2) -> DataFrame:
    """``sizes``: ``source`` (null allowed, distinct), ``source_size``. Adds
    ``target``. One row per source, so the windows here sort sources, not rows."""
    place = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    index = (F.row_number().over(place) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), index.cast("int") + 1).cast("long")
    listed = (sizes.withColumn("w", weight).withColumn("most", F.col("source_size") * cap)
              .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(total_share))))
    by_room = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(0, Window.unboundedFollowing)
    # the level if every source before this one stops at its cap and no later one does
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("w").over(onward)
    tried = (listed.withColumn("pos", F.row_number().over(by_room)).withColumn("level", level)
             .withColumn("above", F.col("level") * F.col("w") > F.col("most")))
    first_free = F.min(F.when(~F.col("above"), F.struct("pos", "level"))).over(everything)
    return (tried.withColumn("free", first_free)
            .select("source", "source_size",
                    F.when(F.col("free").isNull() | (F.col("pos") < F.col("free.pos")), F.col("most").cast("double"))
                    .otherwise(F.least(F.col("free.level") * F.col("w"), F.col("most").cast("double")))
                    .alias("target")))


def _uniform(doc_id: Column) -> Column:
    """In (0, 1): 48 bits of an md5, which other engines can repeat exactly."""
    key = F.concat(F.lit("pareto:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def _rank(doc_id: Column, chance: Column) -> Column:
    """Random odds over inclusion odds; written so that no step divides by zero."""
    u = _uniform(doc_id)
    return F.when(chance > 0, (u / (1 - u)) * ((1 - chance) / chance))


def _levels(rows: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """``sources`` (source, source_size, target) with ``level`` (null: every document
    stands at ``cap``) and ``missing``, the words that certain copies leave to be drawn.
    The windows sort a source's weights, not its rows."""
    classes = rows.groupBy("source", "w").agg(F.sum("size").alias("words")).withColumnRenamed("source", "cs")
    classes = classes.join(sources, F.col("cs").eqNullSafe(F.col("source"))).drop("cs")
    down = Window.partitionBy("source").orderBy(F.desc("w"))
    before = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("w") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    tried = classes.withColumn("tried", F.when(rest > 0, (F.col("target") - cap * before) / rest))
    # the heaviest weight that isn't cut off at the cap says the level
    level = F.max_by("tried", F.when(F.col("tried") * F.col("w") <= cap, F.col("w"))).over(Window.partitionBy("source"))
    certain = F.floor(_expected(F.col("level"), F.col("w"), cap)).cast("long") * F.col("words")
    return (tried.withColumn("level", level).groupBy("source", "source_size", "target", "level")
            .agg(F.sum(certain).alias("certain_words"))
            .select("source", "source_size", "target", "level",
                    (F.round("target").cast("long") - F.col("certain_words")).alias("missing")))


def _expected(level: Column, weight: Column, cap: int) -> Column:
    """Copies expected of a document."""
    return F.coalesce(F.least(level * weight, F.lit(float(cap))), F.lit(float(cap)))


def _plan(rows: DataFrame, weights, total_share, cap, buckets) -> tuple[DataFrame, DataFrame]:
    """From ``doc_id, size, source, w`` the tables of sources and of boundary documents."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = settled(_levels(rows, targets(sizes, weights, total_share, cap), cap))
    side = small_side(sources.select(F.col("source").alias("s"), "level", "missing").where("missing > 0"))
    ranked = rows.join(side, F.col("source").eqNullSafe(F.col("s"))).select(
        "s", "missing", "doc_id", "size", "w", _rank(F.col("doc_id"), _chance(F.col("level"), F.col("w"), cap)).alias("q")
    ).where("q is not null")
    ranked = ranked.withColumn("slot", _slot(F.col("q"), buckets))
    slots = ranked.groupBy("s", "missing", "slot").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("s").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = (slots.withColumn("upto", F.sum("words").over(upto))
               .where((F.col("upto") >= F.col("missing")) & (F.col("upto") - F.col("words") < F.col("missing")))
               .select(F.col("s").alias("s2"), F.col("slot").alias("edge"),
                       (F.col("upto") - F.col("words")).alias("before")))
    reached = settled(reached)
    inside = ranked.join(small_side(reached), F.col("s").eqNullSafe(F.col("s2")) & (F.col("slot") == F.col("edge")))
    ties = inside.groupBy("s", "missing", "before", "q", "doc_id", "size", "w").agg(F.count(F.lit(1)).alias("rows"))
    order = Window.partitionBy("s").orderBy("q", "doc_id", "size", "w").rowsBetween(Window.unboundedPreceding, -1)
    left = (F.col("missing") - F.col("before")
            - F.coalesce(F.sum(F.col("size") * F.col("rows")).over(order), F.lit(0)))
    edge = settled(ties.withColumn("left", left).select(
        F.col("s").alias("es"), F.col("doc_id").alias("eid"), F.col("size").alias("esize"), F.col("w").alias("ew"),
        F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("left") / F.col("rows")))).cast("long")
        .alias("more")).where("more > 0"))
    plan = settled(sources.join(reached, F.col("source").eqNullSafe(F.col("s2")), "left")
                   .select(F.col("source").alias("ps"), "source_size", "target", "level", "missing", "edge"))
    return plan, edge


def _chance(level: Column, weight: Column, cap: int) -> Column:
    copies = _expected(level, weight, cap)
    return copies - F.floor(copies)


def _slot(q: Column, buckets: int) -> Column:
    """Near 1 the rank is about the boundary, whatever the chance: q/(1+q) is about 1/2 there."""
    return F.floor(F.lit(float(buckets)) * (q / (1 + q))).cast("long")


def _weight(weight: Column | None) -> Column:
    return F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(1.0))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5, cap: int = 2,
        buckets: int = 1 << 16, weight: Column | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, expected, taken`` for every row.
    ``weight``: how likely a document is to be taken, against others of its source."""
    rows = settled(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _weight(weight).alias("w")))
    plan, edge = _plan(rows, weights, total_share, cap, buckets)
    return _taken(rows, plan, edge, buckets, cap).select(
        "doc_id", "source", "size", "source_size", "target", "expected", "taken")


def _taken(rows: DataFrame, plan: DataFrame, edge: DataFrame, buckets: int, cap: int) -> DataFrame:
    """``rows`` with the plan's columns, the copies ``expected`` and ``taken``; needs
    doc_id, source, size, w."""
    planned = rows.join(small_side(plan), F.col("source").eqNullSafe(F.col("ps")))
    planned = planned.withColumn("expected", _expected(F.col("level"), F.col("w"), cap))
    planned = planned.withColumn("chance", _chance(F.col("level"), F.col("w"), cap))
    slot = _slot(_rank(F.col("doc_id"), F.col("chance")), buckets)
    met = planned.withColumn("at", slot).join(
        small_side(edge), F.col("doc_id").eqNullSafe(F.col("eid")) & F.col("source").eqNullSafe(F.col("es"))
        & (F.col("size") == F.col("esize")) & (F.col("w") == F.col("ew")) & (F.col("at") == F.col("edge")), "left")
    # no slot reached: words ran out first, which rounding alone can cause
    whole = ((F.col("chance") > 0) & (F.col("missing") > 0)
             & (F.col("edge").isNull() | (F.col("at") < F.col("edge"))))
    extra = F.when(whole, F.col("size")).otherwise(F.coalesce("more", F.lit(0)))
    return met.withColumn("taken", (F.floor("expected").cast("long") * F.col("size") + extra).cast("long"))


def materialise(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5, cap: int = 2,
                buckets: int = 1 << 16, weight: Column | None = None) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for every whole copy,
    and the boundary documents' leading words as a shorter text (``n_chars``,
    where present, follows it)."""
    own = free_name(docs, "n")
    sized = docs.withColumn(own, word_count(F.col("text")))
    rows = settled(sized.select("doc_id", "source", F.col(own).alias("size"), _weight(weight).alias("w")))
    plan, edge = _plan(rows, weights, total_share, cap, buckets)
    named = sized.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "source",
                         F.col(own).alias("size"), _weight(weight).alias("w"))
    taken = _taken(named, plan, edge, buckets, cap)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    part = F.col("taken") - whole * F.col("size")
    copies = F.concat(F.array_repeat(F.lit(None).cast("long"), whole.cast("int")),
                      F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")))
    out = taken.select("doc", F.explode(copies).alias("part"))
    # the first `part` words and what stands between them
    lead = F.regexp_extract(F.col("doc.text"), r"^[\x20\x09-\x0D]*+", 0)
    words = F.slice(F.regexp_extract_all(F.col("doc.text"), F.lit(WORDS + r"[\x20\x09-\x0D]*"), F.lit(0)),
                    1, F.col("part").cast("int"))
    text = F.when(F.col("part").isNull(), F.col("doc.text")).otherwise(
        F.rtrim(F.concat(lead, F.array_join(words, ""))))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(text.alias("text"))
        elif c == "n_chars":
            kind = docs.schema["n_chars"].dataType
            columns.append(F.when(F.col("part").isNull(), F.col("doc.n_chars"))
                           .otherwise(F.length(text).cast(kind)).alias("n_chars"))
        else:
            columns.append(F.col(f"doc.`{c}`").alias(c))
    return out.select(*columns)
