"""Positions of regular-expression matches with built-in functions only.

Spark extracts matched strings but not where they are. Splitting the text at
the same pattern gives the gaps between the matches, so a match starts after
all gaps and matches before it. Offsets count code points, ends are exclusive.

Java tries a pattern at every position; the patterns used here start with a
look-behind or ``\\G`` (the end of the last match) and use possessive repeats, so
a long run of characters is read once and not again from each of its positions.
They match exactly what the plain leftmost, non-overlapping search does.

A text may hold hundreds of thousands of matches, so nothing here grows with their
square: running sums are built in chunks, and pieces of the text are cut from blocks
of it, not counted off from its start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,place:int,end:int,kind:string,value:string>"
CHUNK, BLOCK = 256, 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` (associative, such as a sum) makes of an integer array's entries
    up to each of them: chunk by chunk, then every chunk with all before it."""
    none = F.array().cast("array<int>")

    def last(xs: Column) -> Column:
        return F.get(xs, F.size(xs) - 1)

    def add(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(F.coalesce(step(last(acc), x), x)))

    def whole(values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(CHUNK))
        parts = F.transform(starts, lambda s: F.aggregate(F.slice(values, s, F.lit(CHUNK)), none, add))
        return let(parts, lambda parts: let(
            F.aggregate(parts, none, lambda acc, p: add(acc, last(p))),
            lambda upto: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(
                let(F.get(upto, i - 1), lambda before: F.transform(p, lambda v: step(before, v))))))))

    return let(values, whole)


def plus(a: Column, b: Column) -> Column:
    return a + b


def later(a: Column, b: Column) -> Column:
    return F.when(a > b, a).otherwise(b)


def earlier(a: Column, b: Column) -> Column:
    return F.when(a < b, a).otherwise(b)


def blocks(text: Column) -> Column:
    """The text in blocks of equally many code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """The text between two offsets."""
    first = F.floor(start / BLOCK).cast("int")
    n = F.floor(end / BLOCK).cast("int") - first + 1
    return F.substr(F.array_join(F.slice(blocks, first + 1, n), ""), (start - first * BLOCK + 1).cast("int"),
                    (end - start).cast("int"))


def find(text: Column, pattern: str, kind: str, place: int, passes: Callable[[Column], Column],
         value: Callable[[Column], Column] = lambda m: m, ahead: bool = False) -> Column:
    """Array of ``SPAN`` of the matches that ``passes`` holds for; ``place``
    orders kinds that start at the same offset. With ``ahead`` the span is the
    pattern's group 1, caught by a look-ahead from the match's start, so that
    a span that doesn't pass hides none that starts inside it."""
    none = F.array().cast(f"array<{SPAN}>")
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(gaps, hits, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m"), m.alias("s")))
    if ahead:
        steps = F.zip_with(steps, F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x, s: F.struct(
            x["gap"].alias("gap"), x["m"].alias("m"), s.alias("s")))

    def span(x: Column, end: Column) -> Column:
        start, m = end - F.length(x["m"]), x["s"]
        whole = F.struct(start.alias("start"), F.lit(place).alias("place"), (start + F.length(m)).alias("end"),
                         F.lit(kind).alias("kind"), value(m).alias("value")).cast(SPAN)
        return F.when(passes(m), whole)

    def placed(steps: Column) -> Column:
        ends = running(F.transform(steps, lambda x: x["gap"] + F.length(x["m"])), plus)
        return F.filter(F.zip_with(steps, ends, span), lambda s: s.isNotNull())

    # the last gap has no match behind it
    found = let(F.filter(steps, lambda x: x["m"].isNotNull()), placed)
    return F.when(text.rlike(pattern), found).otherwise(none)


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    text = F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
