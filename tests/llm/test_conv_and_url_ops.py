"""Conversation trie and repair, URL rules, against plain versions."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import conv_repair, conv_trie, queries, url_rules

from . import brute_conv
from .conftest import SMALL

TRIE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
REPAIR = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
#: Extra columns have names that the operators use for their own.
SCHEMA = ("conv_id long, turn long, role string, text string, part int, conv string, n long, symbol int, "
          "rep long, depth long, k1 long, sha string, digest string, first string, copy int, kind long")


def table(rows):
    return [(*r, 7, "x", 9, 9, 5, 5, 5, "s", "d", "f", 3, 3) for r in rows]


def same(frame, cols, want):
    got = sorted((tuple(r[c] for c in cols) for r in frame.collect()), key=repr)
    assert got == sorted(want, key=repr)


LONG = "very long text. " * 20_000
ODD = [
    (0, 0, "system", "Be brief."), (0, 1, "user", "Hi there."), (0, 2, "assistant", "Hello!"),
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hi there."), (1, None, None, None), (1, 5, "tool", "x?"),
    (2, 3, "user", ""), (2, 3, "user", ""), (2, 3, "user", "twice"), (2, 9, "", "no role."), (2, 10, "user", LONG),
    (None, 1, "user", "no id"), (None, 1, "user", "no id"), (None, None, "assistant", "no turn."),
    (-3, 0, "user", "negative."), (-3, 1, "assistant", None), (4, 0, None, "\t\n"), (5, 0, "user", "é ü 😀."),
    (9, 2**62, "user", "far."), (9, -2**62, "assistant", "apart."), (7, 1, "assistant", "a."), (7, 2, "user", "b."),
    *[(20, t, "user" if t % 2 else "assistant", f"turn {t % 7}.") for t in range(300)],
    *[(21, t, "user", "again.") for t in range(60)],
    *[(c, t, "user" if t % 2 == 0 else "assistant", f"copy {t}.") for c in range(100, 160) for t in range(6)],
]


@pytest.fixture(scope="module")
def odd_turns(spark):
    return spark.createDataFrame(table(ODD), SCHEMA).repartition(5).checkpoint()


@pytest.fixture(scope="module")
def no_turns(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.read.parquet(f"{SMALL}/conversations.parquet")


@pytest.mark.parametrize("which", ["conversations", "odd_turns"])
@pytest.mark.parametrize("sizes", [{}, dict(shard_rows=4, task_rows=10, long_list=2), dict(shard_rows=0, task_rows=1)])
def test_trie(request, which, sizes):
    turns = request.getfixturevalue(which)
    want = brute_conv.trie([tuple(r)[:4] for r in turns.collect()])
    same(conv_trie.rebuilt_trie(turns, **sizes), TRIE, want)


@pytest.mark.parametrize("which", ["conversations", "odd_turns"])
@pytest.mark.parametrize("parts", [None, 3, 60])
def test_repair(request, which, parts):
    turns = request.getfixturevalue(which)
    want = brute_conv.repairs([tuple(r)[:4] for r in turns.collect()])
    same(conv_repair.report(turns, conv_repair.damage(turns), parts, F.col("copies")), REPAIR, want)


def test_a_conversation_over_many_partitions(spark):
    """One conversation holds all rows; every partition boundary cuts it."""
    rng = random.Random(5)
    rows = [(3, t // 2, rng.choice(["user", "assistant", "system", "tool"]),
             rng.choice(["yes.", "no", "", f"turn {t}.", f"turn {t}"])) for t in range(400)]
    turns = spark.createDataFrame(table(rows), SCHEMA)
    same(conv_repair.report(turns, conv_repair.damage(turns), 40, F.col("copies")), REPAIR, brute_conv.repairs(rows))


def test_rows_without_damage(spark):
    """The operator by itself: copies given as rows, a column named copies is nothing to it."""
    rows = [r for r in ODD if r[0] is not None and r[0] < 10 for _ in range(1 + (r[1] or 0) % 2)]
    turns = spark.createDataFrame([(*r, 99) for r in rows], "conv_id long, turn long, role string, text string, copies int")
    got = {r.conv: (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in conv_repair.repair(turns, 5).collect()}
    for c, found in brute_conv.by_turn([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]).items():
        faults, illegal, cost, audit, _ = brute_conv.repair(found)
        assert got[str(c)] == (*faults, illegal, cost, audit)


def test_empty_conversations(no_turns):
    assert conv_trie.rebuilt_trie(no_turns).collect() == []
    assert conv_repair.report(no_turns, conv_repair.damage(no_turns)).collect() == []


def test_unrolled_edits_are_the_least():
    rng = random.Random(11)
    for _ in range(300):
        turns = [(i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["", "same.", "cut", f"{i}."]))
                 for i in range(rng.randrange(9))]
        (_, illegal, cost, audit, text) = brute_conv.repair(turns)
        seen, symbols = set(), []
        for _, role, t in turns:
            gone = not t or (role, t) in seen
            seen.add((role, t))
            symbols.append(0 if gone else 1 + 2 * ("sua".find(role[0]) % 4) + (t[-1] != "."))
        runs = conv_repair.collapse(symbols, [1] * len(symbols))
        v = conv_repair.DONE
        for s, k in reversed(runs):
            v = conv_repair.advance(s, k, v)
        edits = list(conv_repair.unroll(runs, 0, conv_repair.DONE, True))
        assert v[0] == cost and "".join(e * n for e, n, _ in edits) == audit
        assert "\n".join(conv_repair.lines(edits, [(1, r, t) for _, r, t in turns])) == text
        assert conv_repair.apply(conv_repair.product(runs), conv_repair.DONE)[0] == cost


def test_powers_equal_single_steps():
    for symbol, n in itertools.product(range(conv_repair.N_SYMBOLS), (1, 2, 7, 300)):
        v = conv_repair.DONE
        for _ in range(n):
            v = conv_repair.apply(conv_repair.power(symbol, 0), v)
        assert conv_repair.advance(symbol, n, conv_repair.DONE) == v


def test_double_array_holds_every_sequence_once():
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 40, rng.integers(1, 12)) for _ in range(500)]
    lengths = np.array([len(s) for s in seqs])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    da, levels = conv_trie.build(starts, lengths, np.concatenate(seqs))
    prefix = {}
    for depth, (live, states) in enumerate(levels):
        for i, s in zip(live.tolist(), states.tolist()):
            assert prefix.setdefault(s, tuple(seqs[i][:depth + 1])) == tuple(seqs[i][:depth + 1])
    want = {tuple(s[:d]) for s in seqs for d in range(1, len(s) + 1)}
    assert set(prefix.values()) == want and len(prefix) == len(want)
    assert da.end < 4 * len(want) + 64


# -- URLs ------------------------------------------------------------------------
URLS = ["http://A.Example.NET/en/1?x=1", "https://example.net/EN/1", "https://example.net/en/", "https://net",
        "http://net/", "https://badnet/en/", "ftp://x.org/fr/2#frag", "http://org/fr", "http://example.com/de/9",
        "http://notexample.com/de/9", "//no.scheme/x", "", None, "http://", "://x.net/y", "http://a.net?u=b://c.org/fr/",
        "http://x.net#/y", "http://Ü.NET/ä", "http://" + "a." * 50_000 + "net/" + "s/" * 50_000, "http://x.net/1", "http://x.net/1"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def listed(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_curated_rules(spark):
    pages = spark.createDataFrame([(i % 19, u, "h", "p", "r", "v", "k") for i, u in enumerate(URLS)],
                                  "page_id long, url string, host string, path string, rule string, verdict string, key string")
    mined = url_rules.mine(spark.createDataFrame([], "url string, bad boolean"))
    got = url_rules.judge(pages, queries.URL_RULES, mined).collect()
    want = [(i % 19, *parts(u), listed(*parts(u))[0], listed(*parts(u))[1] or "allow") for i, u in enumerate(URLS)]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert url_rules.judge(pages.limit(0), queries.URL_RULES, mined).collect() == []


def mined_by_hand(labelled, least, min_confidence, min_gain):
    """Every token combination of every URL, counted."""
    total, bad = len(labelled), sum(b for _, b in labelled)
    where: dict = {}
    for i, (toks, _) in enumerate(labelled):
        for t in toks:
            where.setdefault(t, set()).add(i)
    classes: dict = {}
    for t in sorted(where):
        if least <= len(where[t]) < total:
            classes.setdefault(frozenset(where[t]), t)
    names = set(classes.values())
    count: dict = {}
    for toks, b in labelled:
        kept = sorted(names & set(toks))
        for k in range(len(kept) + 1):
            for c in itertools.combinations(kept, k):
                n = count.setdefault(c, [0, 0])
                n[0] += 1
                n[1] += b
    rules = {}
    for c, (n, n_bad) in count.items():
        for verdict, hits in (("block", n_bad), ("allow", n - n_bad)):
            def share(x):
                return (count[x][1] if verdict == "block" else count[x][0] - count[x][1]) / count[x][0]
            if c and hits >= least and share(c) >= min_confidence:
                if all(share(c) >= share(tuple(t for t in c if t != x)) + min_gain for x in c):
                    rules[c] = (verdict, n, share(c))
    return rules


def test_mined_rules_and_matches(spark):
    rng = random.Random(2)
    urls = {}
    for i in range(400):
        h = rng.choice(["casino.example", "news.example", "pills-cheap.shop", "blog.example"])
        u = f"http://{h}/{rng.choice(['a', 'b', 'c'])}/{i}" + rng.choice(["", ".html", "?ref=x", "#top"])
        urls[u] = rng.random() < (0.97 if "pills" in u or ("casino" in u and "/b/" in u) else 0.05)
    both = next(iter(urls))
    frame = spark.createDataFrame([*urls.items(), *list(urls.items())[:50], (both, True), (None, True), ("http://x/", None)],
                                  "url string, bad boolean")
    urls[both] = True
    rules = url_rules.mine(frame, min_support=0.02, min_count=5)
    toks = {r.url: r.t for r in spark.createDataFrame([(u,) for u in urls], "url string")
            .select("url", url_rules.tokens(F.col("url")).alias("t")).collect()}
    want = mined_by_hand([(toks[u], b) for u, b in urls.items()], 8, 0.9, 0.01)
    got = {tuple(r.antecedent): (r.verdict, r.n, r.confidence) for r in rules.collect()}
    assert got == want
    assert any(v[0] == "block" for v in got.values()) and any(len(k) > 1 for k in got)

    out = url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), (), rules)
    for r in out.collect():
        url = list(urls)[r.page_id]
        fired = [(-c, -n, -len(k), " ".join(k), v) for k, (v, n, c) in want.items() if set(k) <= set(toks[url])]
        assert (r.verdict, r.mined_rule) == ((min(fired)[4], min(fired)[3]) if fired else ("allow", None))


def test_long_copied_urls_stay_cheap(spark):
    """Hundreds of tokens that always occur together are one item."""
    frame = spark.createDataFrame([(f"http://h/{'/'.join(f'seg{j}x' for j in map(chr, range(0x4e00, 0x4e00 + 300)))}?n={chr(97 + i)}", i % 2 == 0)
                                   for i in range(26)] + [(f"http://o/{chr(97 + i)}", False) for i in range(26)],
                                  "url string, bad boolean")
    assert url_rules.mine(frame, min_support=0.1, min_count=5, min_confidence=0.4).count() <= 4


def test_no_token_of_a_long_url_is_left_out(spark):
    """URLs with more frequent tokens than FP-growth takes: the rule that needs the least
    telling of them is found, and both ways give the same rules."""
    rng, urls = random.Random(5), {}
    for i in range(320):
        depth, a, b = i % 20, i // 20 % 2, i // 40 % 2
        path = [f"d{chr(97 + j)}" for j in range(depth + 1)] + ["wa"] * a + ["wb"] * b
        url = f"http://h/{'/'.join(path)}?z={chr(97 + i % 26)}{chr(97 + i // 26)}"
        urls[url] = a == b or rng.random() < depth / 50  # neither word alone tells anything
    frame = spark.createDataFrame([*urls.items()], "url string, bad boolean")
    baskets, total, bad, least = url_rules.transactions(frame, 0.05, 5)
    rows = baskets.collect()
    assert max(len(r["items"]) for r in rows) > 16 and (total, bad, least) == (320, sum(urls.values()), 16)
    got = {tuple(r.antecedent): (r.verdict, r.n, r.confidence) for r in url_rules.mine(frame, 0.05, 5).collect()}
    assert got[("p:wa", "p:wb")] == ("block", 80, 1.0)
    for tokens, (verdict, n, confidence) in got.items():
        having = [r.bad for r in rows if set(tokens) <= set(r["items"])]
        assert n == len(having)
        assert confidence == sum(b == (verdict == "block") for b in having) / n >= 0.9

    few = spark.createDataFrame([(u, b) for i, (u, b) in enumerate(urls.items()) if i % 20 < 8], "url string, bad boolean")
    by_trees, by_level = (sorted(map(tuple, url_rules.mine(few, 0.05, 5, 0.6, 0.02, most).collect())) for most in (16, 0))
    assert by_trees == by_level and any(len(r[0]) > 1 for r in by_level)


def test_url_query_covers_the_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = queries.op11_url_rules(spark, SMALL).collect()
    want = [(r.page_id, *parts(r.url), listed(*parts(r.url))) for r in pages.collect()]
    by_id = {r.page_id: r for r in got}
    assert len(by_id) == len(want) == len(got)
    for i, h, p, (rule, verdict) in want:
        r = by_id[i]
        assert (r.host, r.path, r.rule) == (h, p, rule) and r.verdict in ("block", "allow")
        assert verdict is None or r.verdict == verdict
