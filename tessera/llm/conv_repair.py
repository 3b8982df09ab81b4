"""Cheapest repair of conversations by a run-length dynamic programme.

A repaired conversation has role initials ``(s?(ua)+)?``. Edits: Keep a row
(free), Rerole it to user or assistant (3), Delete it (4; required for a blank or
repeated row), Insert an empty user or assistant turn anywhere (3); a truncated
row that stays adds 3. Among the cheapest edits the audit (their initials) is the
least by ASCII, which settles which edits are made.

States: nothing yet, after s, after u, after a. A row's symbol is "must go" or its
initial with or without truncation; a symbol's effect on the four states is a 4 x 4
matrix over (min, +) that includes the insertions before the row. Equal symbols
in a row are one run, and a run advances the vector of costs-to-go through cached
binary powers of its matrix, from the end of the conversation to its start. The
unrolling goes forward and takes at each row the least letter that still reaches
the minimum; costs inside a run come from the same powers.

On Spark. Equal rows (same turn, role and text) are merged by a pre-aggregated
count; their copies are one run. A row's first place is the least turn of its role and
text, by a pre-aggregated minimum. Rows are then put in order by a range
partitioning on conversation and turn, so that a conversation with a third of all
rows spreads over many tasks, and written to the shared folder. A task streams
its partition and repairs conversations that lie in it entirely. The few that a
boundary cuts (at most one a boundary) are done by segments: each task gives the
matrix of its segment, the driver combines these small matrices (at most two a
partition) to costs-to-go at the cuts, tasks answer which state each segment leads
to, and a last pass writes every segment's edits; audit and hash are put together
in order by a task that streams the pieces. A task holds the turns of one segment.

Defined cases: a null role or text reads as one space, a null conv_id is a
conversation of its own. Rows come by turn, nulls first, then role, then text.
A row is blank without a character outside \\x20, \\x09-\\x0D; duplicate if its role
and text stand in an earlier row; truncated if its last such character is none of
``.!?``; the first of these counts. A role of another initial, or an empty one, can't
be kept. No rows: zeros, an empty audit, the hash of the empty text. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, settled, small_side

START, AFTER_S, AFTER_U, AFTER_A = range(4)
INF = 1 << 60
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: The next state of an inserted or reroled turn: a user turn but after one, else an assistant turn.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
NEXT_ROLE = ("user", "user", "assistant", "user")
#: Costs-to-go after the last row: the insertions that end the pattern.
DONE = (0, 2 * INSERT, INSERT, 0)
#: Symbols: 0 must go, then 1 + 2 * place of the initial here + truncated.
INITIALS = "sua"
MUST_GO, N_SYMBOLS = 0, 9
_KEEP = ({START: AFTER_S}, {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, {AFTER_U: AFTER_A}, {})
SEGMENT_ROWS, SEGMENT_BYTES = 50_000, 32 << 20
PIECE = 1 << 20


def _kept(symbol: int, state: int):
    return None if symbol == MUST_GO else _KEEP[(symbol - 1) // 2].get(state)


def _extra(symbol: int) -> int:
    return TRUNCATED if symbol and not symbol % 2 else 0


def times(a, b):
    return tuple(tuple(min(min(a[i][k] + b[k][j] for k in range(4)), INF) for j in range(4)) for i in range(4))


def apply(a, v):
    return tuple(min(min(a[i][k] + v[k] for k in range(4)), INF) for i in range(4))


def _matrix(symbol: int):
    """Insertions, then the row: deleted, kept or reroled."""
    row = [[INF] * 4 for _ in range(4)]
    for s in range(4):
        row[s][s] = DELETE
        if symbol != MUST_GO:
            row[s][NEXT[s]] = min(row[s][NEXT[s]], REROLE + _extra(symbol))
            kept = _kept(symbol, s)
            if kept is not None:
                row[s][kept] = min(row[s][kept], _extra(symbol))
    put = [[0 if i == j else INF for j in range(4)] for i in range(4)]
    for s in range(4):
        at, cost = s, 0
        for _ in range(3):
            at, cost = NEXT[at], cost + INSERT
            put[s][at] = min(put[s][at], cost)
    return times(put, row)


_POWERS = [[_matrix(s)] for s in range(N_SYMBOLS)]


def power(symbol: int, bit: int):
    """The symbol's matrix to the power 2**bit."""
    known = _POWERS[symbol]
    while len(known) <= bit:
        known.append(times(known[-1], known[-1]))
    return known[bit]


def advance(symbol: int, length: int, v):
    """Costs-to-go before a run of ``length`` rows, from those behind it."""
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            v = apply(power(symbol, bit), v)
    return v


def product(runs):
    """The matrix of a whole segment."""
    out = tuple(tuple(0 if i == j else INF for j in range(4)) for i in range(4))
    for symbol, length in runs:
        for bit in range(length.bit_length()):
            if length >> bit & 1:
                out = times(out, power(symbol, bit))
    return out


def collapse(symbols, counts) -> list[tuple[int, int]]:
    """Rows to runs: a row's first copy has its symbol, the others must go."""
    runs: list[list[int]] = []
    for symbol, n in zip(symbols, counts):
        for s, k in ((symbol, 1), (MUST_GO, n - 1)):
            if k and runs and runs[-1][0] == s:
                runs[-1][1] += k
            elif k:
                runs.append([s, k])
    return [tuple(r) for r in runs]


def unroll(runs, state: int, after, last: bool) -> Iterator[tuple[str, int, int]]:
    """The edits from ``state`` on as (letter, times, state before). ``after``: the costs-to-go
    behind the runs; ``last``: no rows follow, so the pattern is ended here."""
    behind = [after]
    for symbol, length in reversed(runs):
        behind.append(advance(symbol, length, behind[-1]))
    for r, (symbol, length) in enumerate(runs):
        v = behind[len(runs) - 1 - r]
        if symbol == MUST_GO:  # deleting at once is never dearer, and the least letter
            yield "D", length, state
            continue
        for left in range(length - 1, -1, -1):
            ahead = advance(symbol, left, v)
            here = apply(power(symbol, 0), ahead)
            while True:
                best, kept = here[state], _kept(symbol, state)
                if DELETE + ahead[state] == best:
                    yield "D", 1, state
                elif INSERT + here[NEXT[state]] == best:
                    yield "I", 1, state
                    state = NEXT[state]
                    continue
                elif kept is not None and _extra(symbol) + ahead[kept] == best:
                    yield "K", 1, state
                    state = kept
                else:
                    yield "R", 1, state
                    state = NEXT[state]
                break
    while last and state not in (START, AFTER_A):
        yield "I", 1, state
        state = NEXT[state]
    yield "", 0, state  # where it ends


def lines(edits, rows):
    """The repaired ``role:text`` lines. ``rows``: (copies, role, text) in order."""
    rows = iter(rows)
    copies = 0
    for letter, n, state in edits:
        if letter == "I":
            yield f"{NEXT_ROLE[state]}:"
            continue
        while n:
            if not copies:
                copies, role, text = next(rows)
            step = min(n, copies)
            if letter == "K":
                yield f"{role}:{text}"
            elif letter == "R":
                yield f"{NEXT_ROLE[state]}:{text}"
            copies, n = copies - step, n - step


def illegal_pairs(initials, counts) -> int:
    """Adjacent initials other than su, ua, au."""
    bad = sum(n - 1 for n in counts)
    return bad + sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


# -- the rows and their faults ----------------------------------------------
def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn``: conv_id, turn, role, text
    and ``copies``, how often the row stands there."""
    one = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), one))
    kind = F.col("kind")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", one).alias("role"),
                                F.coalesce("text", one).alias("text"), (F.crc32(key) % 20).alias("kind"))
    return rows.where("kind <> 0").select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def _id(c: str = "conv_id") -> Column:
    """Null conversations included, as text."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _met(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join by conversation, turn, role and digest, where null ids and turns are equal."""
    named = right.withColumnsRenamed({c: f"r_{c}" for c in _PLACE})
    same = F.lit(True)
    for c in _PLACE:
        same = same & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return left.join(named, same, how).drop(*[f"r_{c}" for c in _PLACE])


_PLACE = ["conv_id", "turn", "role", "digest"]


def faults(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """Distinct rows with copies ``n``, their symbol, and how many of the copies
    are blank, duplicate and truncated.

    What has to be known about other rows is found on places (conversation, turn, role and
    digest of the text) alone: few of them hold several rows, or repeat a text of an earlier turn.
    Texts are joined with those few and shuffled only where equal rows have to be merged."""
    one = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"),
                       (F.lit(1).cast("long") if copies is None else copies.cast("long")).alias("copies"))
    rows = rows.withColumn("digest", F.md5("text"))
    places = rows.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("n"))
    # the first of a text's turns; null comes before all
    texts = places.groupBy("conv_id", "role", "digest").agg(
        F.count(F.lit(1)).alias("places"), F.max(F.col("turn").isNull()).alias("from_null"), F.min("turn").alias("first")
    ).where("places > 1").withColumnsRenamed({"conv_id": "t_conv", "role": "t_role", "digest": "t_digest"})
    later = F.coalesce(F.col("turn").isNotNull() & (F.col("from_null") | (F.col("turn") > F.col("first"))), F.lit(False))
    odd = settled(
        places.join(texts, F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("role") == F.col("t_role"))
                    & (F.col("digest") == F.col("t_digest")), "left")
        .withColumn("later", later).where("later or rows > 1").select(*_PLACE, "rows", "n", "later"))
    n_odd, n_many = odd.agg(F.count(F.lit(1)), F.count_if(F.col("rows") > 1)).first()
    out = _met(rows, small_side(odd), "left")
    if n_many:
        merged = (out.where("rows > 1").groupBy(*_PLACE).agg(
            F.first("text").alias("text"), F.max("n").alias("copies"), F.max("later").alias("later")))
        out = out.where("rows is null or rows = 1").select(*_PLACE, "text", "copies", "later").unionByName(merged)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    again = F.coalesce("later", F.lit(False))
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial, n = F.left("role", F.lit(1)), F.col("copies")
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return out.select(
        "conv_id", "turn", "role", "text", n.alias("n"), initial.alias("initial"),
        F.when(blank | again, MUST_GO).otherwise(1 + 2 * place + cut.cast("int")).alias("symbol"),
        F.when(blank, n).otherwise(0).alias("blank"),
        F.when(blank, 0).when(again, n).otherwise(n - 1).alias("duplicate"),
        F.when(blank | again | ~cut, 0).otherwise(1).alias("truncated"))


def in_order(rows: DataFrame, parts: int) -> DataFrame:
    """Rows by conversation, turn, role and text over range partitions, frozen."""
    order = ["conv_id", "turn", "role"]
    ranged = (rows.repartitionByRange(parts, *order, F.left("text", F.lit(64)))
              .sortWithinPartitions(*order, "text"))
    return settled(ranged.select(F.spark_partition_id().alias("part"), _id().alias("conv"), "*"))


# -- streaming over ordered partitions ---------------------------------------
_COLUMNS = ["part", "conv", "symbol", "n", "initial", "role", "text"]


def segments(batches: Iterator[pd.DataFrame]):
    """(part, conv, columns as lists) for each stretch of equal conversations."""
    held = None
    for pdf in batches:
        if not len(pdf):
            continue
        conv = pdf["conv"].to_numpy()
        cuts = [0, *(np.flatnonzero(conv[1:] != conv[:-1]) + 1).tolist(), len(pdf)]
        cols = {c: pdf[c].tolist() for c in _COLUMNS[2:]}
        part = int(pdf["part"].iloc[0])
        for a, b in zip(cuts, cuts[1:]):
            here = {c: v[a:b] for c, v in cols.items()}
            if held is not None and held[0] == part and held[1] == conv[a]:
                for c, v in here.items():
                    held[2][c] += v
                continue
            if held is not None:
                yield held
            held = (part, conv[a], here)
    if held is not None:
        yield held


def _runs(cols):
    return collapse(cols["symbol"], cols["n"])


def _rows(cols):
    return zip(cols["n"], cols["role"], cols["text"])


class _Hash:
    """SHA-256 of lines joined by newlines."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, text: str):
        self.sha.update(("\n" + text if self.any else text).encode())
        self.any = True


def repair_whole(split: set):
    """Conversations that no partition boundary cuts."""
    def run(batches):
        out = []
        for part, conv, cols in segments(batches):
            if (part, conv) in split:
                continue
            runs = _runs(cols)
            v = DONE
            for symbol, length in reversed(runs):
                v = advance(symbol, length, v)
            edits = list(unroll(runs, START, DONE, True))
            text = _Hash()
            for line in lines(edits, _rows(cols)):
                text.add(line)
            out.append((conv, illegal_pairs(cols["initial"], cols["n"]), v[START],
                        "".join(e * n for e, n, _ in edits), text.sha.hexdigest()))
            if len(out) >= 2_000:
                yield pd.DataFrame(out, columns=_RESULT)
                out = []
        yield pd.DataFrame(out, columns=_RESULT)
    return run


_RESULT = ["conv", "illegal", "cost", "audit", "repaired_sha256"]
_RESULT_TYPE = "conv string, illegal long, cost long, audit string, repaired_sha256 string"


def _measure(batches):
    for part, conv, cols in segments(batches):
        m = product(_runs(cols))
        yield pd.DataFrame({"part": [part], "conv": [conv], "matrix": [[x for r in m for x in r]],
                            "illegal": [illegal_pairs(cols["initial"], cols["n"])],
                            "first": [cols["initial"][0]], "last": [cols["initial"][-1]]})


def _lead(after: dict):
    """Where each segment leads from each state."""
    def run(batches):
        for part, conv, cols in segments(batches):
            v, last = after[part, conv]
            runs = _runs(cols)
            ends = []
            for s in range(4):
                for end in unroll(runs, s, v, last):
                    pass
                ends.append(end[2])
            yield pd.DataFrame({"part": [part], "conv": [conv], "ends": [ends]})
    return run


def _write(after: dict, entered: dict):
    """Each segment's audit and repaired lines, in pieces."""
    def run(batches):
        for part, conv, cols in segments(batches):
            v, last = after[part, conv]
            edits = list(unroll(_runs(cols), entered[part, conv], v, last))
            audit = "".join(e * n for e, n, _ in edits)
            held, size, seq = [], 0, 0
            for line in lines(edits, _rows(cols)):
                held.append(line)
                size += len(line)
                if size >= PIECE:
                    yield pd.DataFrame([(part, conv, seq, "", "\n".join(held))], columns=_PIECE)
                    held, size, seq = [], 0, seq + 1
            yield pd.DataFrame([(part, conv, seq, audit, "\n".join(held) if held else None)], columns=_PIECE)
    return run


_PIECE = ["part", "conv", "seq", "audit", "text"]


def _join_pieces(batches):
    """Audit and hash of conversations whose pieces come in order."""
    conv, audit, text = None, [], None
    for pdf in batches:
        for c, a, t in zip(pdf["conv"], pdf["audit"], pdf["text"]):
            if c != conv:
                if conv is not None:
                    yield pd.DataFrame({"conv": [conv], "audit": ["".join(audit)], "repaired_sha256": [text.sha.hexdigest()]})
                conv, audit, text = c, [], _Hash()
            audit.append(a)
            if t is not None:
                text.add(t)
    if conv is not None:
        yield pd.DataFrame({"conv": [conv], "audit": ["".join(audit)], "repaired_sha256": [text.sha.hexdigest()]})


def _cut_conversations(ordered: DataFrame) -> dict[str, list[int]]:
    """Conversations in several partitions and these, in order; at most one for
    each partition boundary. Only the ends of each partition are looked at."""
    at = F.struct(F.col("conv_id").isNotNull().alias("some"), "conv_id", "conv")
    ends = sorted(ordered.groupBy("part").agg(F.min(at).alias("a"), F.max(at).alias("z")).collect())
    found: dict[str, list[int]] = {}
    for left, right in zip(ends, ends[1:]):
        if left.z.conv == right.a.conv:
            parts = found.setdefault(left.z.conv, [left.part])
            parts.append(right.part)
    return found


def _repair_cut(ordered: DataFrame, cut: dict[str, list[int]]) -> DataFrame:
    spark = ordered.sparkSession
    where = [(p, c) for c, parts in cut.items() for p in parts]
    # at most two rows for each partition
    few = F.broadcast(spark.createDataFrame(where, "part int, conv string"))
    rows = ordered.join(few, ["part", "conv"], "left_semi").select(*_COLUMNS)
    told = {(r.part, r.conv): r for r in rows.mapInPandas(
        _measure, "part int, conv string, matrix array<long>, illegal long, first string, last string").collect()}
    after, costs = {}, {}
    for conv, parts in cut.items():
        v = DONE
        for i, part in enumerate(reversed(parts)):
            after[part, conv] = (v, not i)
            m = told[part, conv].matrix
            v = apply([m[4 * s:4 * s + 4] for s in range(4)], v)
        pairs = [told[a, conv].last + told[b, conv].first for a, b in zip(parts, parts[1:])]
        costs[conv] = (sum(told[p, conv].illegal for p in parts)
                       + sum(x not in ("su", "ua", "au") for x in pairs), v[START])
    leads = {(r.part, r.conv): r.ends for r in rows.mapInPandas(
        _lead(after), "part int, conv string, ends array<int>").collect()}
    entered = {}
    for conv, parts in cut.items():
        state = START
        for part in parts:
            entered[part, conv] = state
            state = leads[part, conv][state]
    pieces = rows.mapInPandas(_write(after, entered), "part int, conv string, seq int, audit string, text string")
    joined = (pieces.repartition("conv").sortWithinPartitions("conv", "part", "seq")
              .mapInPandas(_join_pieces, "conv string, audit string, repaired_sha256 string"))
    figures = spark.createDataFrame([(c, *f) for c, f in costs.items()], "conv string, illegal long, cost long")
    return joined.join(F.broadcast(figures), "conv").select(*_RESULT)


def repair(rows: DataFrame, parts: int | None = None, copies: Column | None = None) -> DataFrame:
    """Conversations (conv_id, turn, role, text, each row standing ``copies`` times) and their
    cheapest repair: conv (the id as text, empty for null), illegal, cost, audit,
    repaired_sha256."""
    spark = rows.sparkSession
    if parts is None:
        n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SEGMENT_ROWS),
                    -(-(size or 0) // SEGMENT_BYTES))
    with arrow_rows(spark, 1_000):
        ordered = in_order(faults(rows, copies), parts)
        cut = _cut_conversations(ordered)
        split = {(p, c) for c, held in cut.items() for p in held}
        out = ordered.select(*_COLUMNS).mapInPandas(repair_whole(split), _RESULT_TYPE)
        if cut:
            out = out.unionByName(_repair_cut(ordered, cut))
        out = settled(out)
    return figures(ordered).join(out, "conv")


def figures(ordered: DataFrame) -> DataFrame:
    """Gaps and faults of each conversation."""
    turns = (ordered.groupBy("conv", "turn").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
             .groupBy("conv").agg(
                 F.max("turn").alias("most"), F.min("turn").alias("least"), F.count("turn").alias("distinct"),
                 *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]))
    gaps = F.expr("try_cast(cast(most as decimal(38, 0)) - least + 1 - distinct as bigint)")
    return turns.select("conv", F.when(F.col("most").isNull(), F.lit(0).cast("long")).otherwise(gaps).alias("gaps"),
                        "blank", "duplicate", "truncated")


def report(conversations: DataFrame, rows: DataFrame, parts: int | None = None,
           copies: Column | None = None) -> DataFrame:
    """One row for every conv_id of ``conversations``: the repair of ``rows``,
    zeros where none are left."""
    ids = conversations.select("conv_id").distinct().withColumn("conv", _id())
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c)
            for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(repair(rows, parts, copies), "conv", "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
