"""Toxicity, page text, SimHash, secrets, BPE and PII against plain versions."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, components, layout_text, mixing, pii, secrets, simhash, toxicity
from tessera.llm.queries import tokenizer_path

from . import brute
from .conftest import SMALL, TEXTS


def by_text(frame, *cols):
    return sorted((tuple(r[c] for c in cols) for r in frame.collect()), key=repr)


# -- PII ------------------------------------------------------------------
@pytest.mark.parametrize("which", ["documents", "odd"])
def test_pii_base_spans(request, which):
    docs = request.getfixturevalue(which)
    got = by_text(pii.summary(pii.find_pii(docs)), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = []
    for r in docs.select("doc_id", "text").collect():
        s = brute.pii_spans(r.text)
        want.append((r.doc_id, *[sum(x[3] == k for x in s) for k in pii.BASE], brute.sha(brute.joined(s))))
    assert got == sorted(want, key=repr)


def test_pii_checksums_context_and_added_spans(spark):
    texts = ["bank account GB82 WEST 1234 5698 7654 32.", "GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789",
             "part 123-45-6789", "card 4111111111111111", "4111111111111112"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.scores) for r in pii.summary(pii.find_pii(docs)).collect()}
    assert got[0] == ("iban:13:40", "1.0")
    assert got[1][0] == "" and got[3][0] == "" and got[5][0] == ""
    assert got[2] == ("ssn:4:15", "0.5") and got[4] == ("card:5:21", "0.9")


def test_iban_ends_where_its_country_says(spark):
    own, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    uk, norway = "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"
    texts = {f"{own} Please": [(0, 22)], f"{spaced} BIC COBADEFF": [(0, 27)], f"{uk} 1000 EUR": [(0, 27)],
             f"{own} 1234": [(0, 22)], f"{norway} AND {uk}": [(0, 18), (23, 50)], f"AB12 {spaced} X": [(5, 32)],
             f"ES12 {spaced}.": [(5, 32)], f"{own}0": [], f"x{own}": [], f"{own[:-1]}1 BIC": [],
             f"{spaced} {uk} {own}": [(0, 27), (28, 55), (56, 78)]}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s["start"], s["end"]) for s in r.found if s["kind"] == "iban"]
           for r in pii.find_pii(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "<iban> Please" and clean[1] == "<iban> BIC COBADEFF" and clean[2] == "<iban> 1000 EUR"


def test_pii_redaction_keeps_columns_and_clean_rows(odd, none):
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    before, after = (sorted(f.collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.source or "")) for f in (odd, out))
    for b, a in zip(before, after):
        spans = brute.pii_spans(b.text)
        if not spans and "GB82" not in (b.text or ""):
            assert a == b
        elif b.text:
            assert a.n_chars == len(a.text) and not brute.pii_spans(a.text.replace("<", " ").replace(">", " "))
    assert {r.text for r in after if r.doc_id == 5} == {"repeated row with card <card>"}
    assert pii.redact(none).count() == 0 and pii.find_pii(none).count() == 0


# -- secrets --------------------------------------------------------------
@pytest.mark.parametrize("which", ["documents", "odd"])
def test_secret_base_spans(request, which):
    docs = request.getfixturevalue(which)
    found = secrets.find_secrets(docs, F.col("source"), F.col("lang"))
    got = by_text(secrets.summary(found), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    want = []
    for r in docs.select("doc_id", "text").collect():
        s = brute.secret_spans(r.text)
        want.append((r.doc_id, *[sum(x[3] == k for x in s) for k in secrets.KINDS], brute.sha(brute.joined(s))))
    assert got == sorted(want, key=repr)


def test_secret_ownership(spark, none):
    example, own = "Zx81qwErty7UioPlkj3hGf", "Own3rSpecific9Token7Value"
    texts = [(i, f"see {example} here", f"owner{i % 5}", f"repo{i}") for i in range(200)]
    texts += [(500, f"we use {own} and hex {'0123456789abcdef' * 2}", "owner1", "r"),
              (501, f"we use {own} and hex {'0123456789abcdef' * 2}", "owner1", "r"), (502, None, None, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, who string, repo string")
    got = {r.doc_id: r for r in secrets.summary(secrets.find_secrets(docs, F.col("who"), F.col("repo"))).collect()}
    assert len(got) == 203
    assert got[7].spans == "" and (got[7].n_live, got[7].n_example) == (0, 1)
    assert (got[7].most_owners, got[7].most_repositories) == (5, 200)
    assert got[500].spans == got[501].spans == "token:7:32,hex:41:73"
    assert (got[500].n_live, got[500].n_example, got[502].spans) == (2, 0, "")
    assert secrets.summary(secrets.find_secrets(none, F.col("source"), F.col("lang"))).count() == 0


def test_every_value_is_live_or_an_example(spark, none):
    def token(i):
        return f"Tok{i}nValue{'abcdefgh'[i]}9Zq8Xw7Rt6Yp"
    rows = [(1, token(1), "a", "r1"), (2, token(1), "b", "r2"),                       # a copy in a second place
            *[(10 + i, token(2), "ab"[i % 2], f"r{i}") for i in range(8)],             # two owners, many repositories
            *[(30 + i, token(3), "a", f"r{i}") for i in range(9)],                     # one owner, many repositories
            *[(50 + i, token(4), "abc"[i], "r") for i in range(3)]]                    # three owners
    docs = spark.createDataFrame([(i, f"we use {t} here", o, r) for i, t, o, r in rows],
                                 "doc_id long, text string, who string, repo string")
    got = {r.doc_id: r for r in secrets.summary(secrets.find_secrets(docs, F.col("who"), F.col("repo"))).collect()}
    assert all(r.n_live + r.n_example == 1 and (r.spans != "") == (r.n_live == 1) for r in got.values())
    assert {i: got[i].n_live for i in (1, 2, 10, 30, 50)} == {1: 1, 2: 1, 10: 0, 30: 1, 50: 0}


def test_tokens_apart_from_base_spans(spark):
    rng = random.Random(6)
    for _ in range(5):
        def some(kind, place):
            cuts = sorted(rng.sample(range(3000), 700))
            return [(a, place, b, kind, "v") for a, b in zip(cuts[::2], cuts[1::2])]
        tokens, base = some("token", 3), some("hex", 2) + some("assign", 0)
        df = spark.createDataFrame([(tokens, base)], f"tokens array<{secrets.SPAN}>, base array<{secrets.SPAN}>")
        got = df.select(secrets.apart_from(F.col("tokens"), F.col("base"))).first()[0]
        want = [t for t in tokens if not any(b[0] < t[2] and t[0] < b[2] for b in base)]
        assert sorted(map(tuple, got)) == want and 0 < len(want) < len(tokens)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 70_000])
def test_running_folds(spark, n):
    from tessera.llm import spans
    rng = np.random.default_rng(n)
    v = rng.integers(0, 1000, n).astype(np.int32)
    df = spark.createDataFrame([(v.tolist(),)], "v array<int>")
    got = df.select(spans.running(F.col("v"), spans.plus).alias("s"), spans.running(F.col("v"), spans.later).alias("m")).first()
    assert got.s == np.cumsum(v).tolist() and got.m == np.maximum.accumulate(v).tolist()


def test_a_hundred_thousand_hits_in_one_text(spark):
    """Some megabytes of one text: as plain Python finds them, within seconds."""
    mails = "".join(f"Ünï{i % 7} write to user{i}@host{i % 5}.example or 10.0.{i % 256}.{i % 300}, " for i in range(50_000))
    keys = "".join(f"ü api_key = 'abc{i}def{i}' {i:07d}deadbeefdeadbeef0123 tok Qw{i}eRtyUiOpAsDf9Gh7Jk{i} " for i in range(35_000))
    docs = spark.createDataFrame([(1, mails), (2, keys)], "doc_id long, text string").withColumn("source", F.lit("s"))
    start = time.time()
    told = {r.doc_id: r for r in pii.summary(pii.find_pii(docs)).collect()}
    for i, text in ((1, mails), (2, keys)):
        spans = brute.pii_spans(text)
        assert told[i].base_sha256 == brute.sha(brute.joined(spans))
        assert told[i].spans == brute.joined(spans) or i == 2
    assert told[1].n_email == 50_000 and told[1].n_ip > 30_000
    assert set(told[1].scores.split(",")) <= {"0.5", "0.6", "0.8", "0.9"} and told[1].scores.startswith("0.9")
    clean = {r.doc_id: r.text for r in pii.redact(docs.where("doc_id = 1")).collect()}[1]
    out, at = [], 0
    for s, _, e, kind in brute.pii_spans(mails):
        if s >= at:
            out += [mails[at:s], f"<{kind}>"]
        at = max(at, e)
    assert clean == "".join(out) + mails[at:]
    held = {r.doc_id: r for r in secrets.summary(secrets.find_secrets(docs, F.col("source"), F.col("source"))).collect()}
    for i, text in ((1, mails), (2, keys)):
        assert held[i].base_sha256 == brute.sha(brute.joined(brute.secret_spans(text)))
    assert held[2].n_assign == held[2].n_hex == 35_000 and held[2].spans.count("token:") >= 34_000
    assert time.time() - start < 120


def test_patterns_read_long_runs_once(spark):
    runs = ["a" * 200_000, "1" * 200_000, "a." * 100_000, "0f" * 100_000, "1.1." * 50_000, "a@b" + ".c" * 50_000,
            "1-" * 100_000, "+1" + " " * 100_000, "A" * 100_000, "a1_" * 60_000]
    docs = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string").withColumn("source", F.lit("s"))
    assert pii.find_pii(docs).count() == len(runs)
    got = {r.doc_id: r for r in pii.summary(pii.find_pii(docs)).collect()}
    assert got[5].n_email == 1 and got[4].n_ip == 25_000
    assert secrets.summary(secrets.find_secrets(docs, F.col("source"), F.col("source"))).count() == len(runs)


# -- BPE ------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def plain_bpe(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            brute.sha(library.decode(ids, skip_special_tokens=False)))


@pytest.mark.parametrize("which", ["documents", "odd", "none"])
def test_bpe_equals_the_library(request, library, which):
    docs = request.getfixturevalue(which)
    got = by_text(bpe.digests(bpe.round_trip(docs, tokenizer_path())), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = [(r.doc_id, *plain_bpe(library, r.text)) for r in docs.select("doc_id", "text").collect()]
    assert got == sorted(want, key=repr)


def test_bpe_speculation_on_random_words(library):
    rng, own = random.Random(5), bpe.WordBpe(tokenizer_path(), cache_words=500)
    texts = ["".join(rng.choice("thestionaéü'- 0123Σ") for _ in range(rng.randint(0, 400))) for _ in range(300)]
    texts += ["a" * 20_000, "ab" * 500, "<|startoftext|><|endoftext|>", "x" * (bpe.CHUNK + 5), "a b " * (bpe.CHUNK // 3)]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(own.cache) <= 500 + bpe.CHUNK


def test_bpe_verification_decides_for_each_pair():
    own, rng = bpe.WordBpe(tokenizer_path()), random.Random(3)
    tokens = [w for w in own.inner if len(w) < 6]
    left, right = rng.choices(tokens, k=3000), rng.choices([w for w in own.last if len(w) < 6], k=3000)
    ids = np.array([[own.inner[a], own.last[b]] for a, b in zip(left, right)])
    whole = [own.exact(a + b) == [own.inner[a], own.last[b]] for a, b in zip(left, right)]
    assert own.stay_apart(ids[:, 0], ids[:, 1]).tolist() == whole and 0 < sum(whole) < 3000


# -- SimHash --------------------------------------------------------------
@pytest.mark.parametrize("which", ["documents", "odd"])
def test_near_duplicates(request, which):
    docs = request.getfixturevalue(which)
    rows = [r for r in docs.select("doc_id", "text").collect() if r.doc_id is not None]
    prints = {r.text: brute.fingerprint(r.text) for r in rows}
    want = brute.components([r.doc_id for r in rows], [prints[r.text] for r in rows])
    got = by_text(simhash.near_duplicates(docs).where("doc_id is not null"), "doc_id", "fingerprint", "component_id")
    assert got == sorted(((r.doc_id, prints[r.text], c) for r, c in zip(rows, want)), key=repr)


def test_rows_without_id_link_like_any(odd, none, spark, monkeypatch):
    got = {r.fingerprint: r.component_id for r in simhash.near_duplicates(odd).where("doc_id is null").collect()}
    assert got[brute.fingerprint(TEXTS[0][1])] == 0
    assert got[brute.fingerprint(TEXTS[5][1])] is None
    assert simhash.near_duplicates(none).count() == 0
    # 0, 3 and 15 are two bits apart each; the middle one has no id, and carries the link
    monkeypatch.setattr(simhash, "fingerprint", lambda text, shingle: text.cast("long"))
    docs = spark.createDataFrame([(4, "0"), (None, "3"), (2, "15"), (None, str(1 << 40)), (None, str(7 << 50)),
                                  (9, str(1 << 62))], "doc_id long, text string")
    got = {int(r.fingerprint, 16): (r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {0: 2, 3: 2, 15: 2, 1 << 40: 2, 7 << 50: None, 1 << 62: 2}


@pytest.mark.parametrize("distance,big", [(0, 256), (1, 256), (2, 256), (2, 3), (3, 256), (4, 256)])
def test_links_of_dense_fingerprints(spark, distance, big):
    """Balls of near fingerprints, so that buckets are crowded."""
    rng = random.Random(distance)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        values.update(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(40))
    values = sorted(values)
    prints = spark.createDataFrame([(simhash._signed(v), i) for i, v in enumerate(values)], "fp long, node long")
    links = simhash.near_links(prints, distance, big)
    for r in links.collect():
        assert (values[r.a] ^ values[r.b]).bit_count() <= distance
    roots = {r.node: r.root for r in components.smallest_reachable(links).collect()}
    want = brute.components(list(range(len(values))), [f"{v:016x}" for v in values], distance)
    assert [roots.get(i, i) for i in range(len(values))] == want


def test_components_of_long_chains(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1001)], "a long, b long")
    got = {r.node: r.root for r in components.smallest_reachable(chain).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_one_of_each_group_stays(odd, none):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd).collect() if r.doc_id is not None}
    assert ids == sorted(set(groups.values()))
    assert kept.where("doc_id is null").count() == 2
    assert simhash.one_of_each(none).count() == 0


def test_majority_bits_counts_over_half():
    rng = np.random.default_rng(1)
    for n in (1, 2, 254, 255, 256, 511, 70_000):
        h = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=int)
        assert simhash.majority_bits(h) == sum(1 << b for b in range(64) if 2 * bits[b] > n)


# -- toxicity -------------------------------------------------------------
def toxic_corpus(spark, n=1500):
    """Clean words, and for a fifth of the documents some bad ones."""
    rng = random.Random(7)
    clean, bad = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)], ["vile", "nasty", "awfulness", "awfulest"]
    docs, labels = [], []
    for i in range(n):
        words, toxic = rng.choices(clean, k=rng.randint(5, 80)), rng.random() < 0.2
        if toxic:
            words += rng.choices(bad, k=4)
        rng.shuffle(words)
        docs.append((i, " ".join(words), "en", "s"))
        if rng.random() < 0.5:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_corpus(spark)
    truth = {i: "vile" in t or "nasty" in t or "awful" in t for i, t, _, _ in docs}
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(frame, marks).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right / len(held) > 0.97
    # labels of held-out rows are not read, whatever they say
    turned = marks.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity(frame, turned).collect()}
    assert again == pytest.approx({r.doc_id: r.score for r in got}, abs=1e-6)
    kept = toxicity.drop_toxic(frame, marks)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_toxicity_odd_rows_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (None, 0, 1), (6, None, None), (7, 1, 1), (7, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    no_labels = labels.limit(0)
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == len(TEXTS)
    scores = {}
    for r, t in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(TEXTS, key=lambda t: (t[0] is None, t[0]))):
        if t[0] is not None:
            scores.setdefault(t[1] or "", set()).add(r.score)
    assert all(len(s) == 1 for s in scores.values())  # equal texts, equal scores
    assert {r.predicted for r in toxicity.toxicity(odd, no_labels).collect()} == {0}
    assert toxicity.toxicity(none, labels).count() == 0 and toxicity.drop_toxic(none, no_labels).count() == 0


def test_nnpu_does_not_follow_a_negative_risk():
    rng = np.random.default_rng(0)
    pos, unl = rng.normal(1, 1, (40, 200)), rng.normal(0, 1, (40, 200))  # more weights than rows
    w, bias = toxicity.fit_nnpu(pos, unl, prior=0.3)
    z = unl @ w + bias
    assert (1 / (1 + np.exp(-z))).mean() < 0.6 and np.isfinite(w).all()


# -- pages ----------------------------------------------------------------
PAGES = {
    None: None, "": "", "plain  text\n only": "plain text only",
    "<p>one<p>two <b>bold</b>!": "one\n\ntwo bold!",
    "<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>": "- a\n- b\n  3. c\n  4. d\n- e",
    "<table><tr><th>Name<th>Qty<tr><td>fig<td>3<tr><td>long name<td>12</table>after":
        "Name       Qty\nfig        3\nlong name  12\n\nafter",
    "<table><caption>C</caption><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>": "C\nwide     z\na     b  c",
    "<div>x</div><div hidden>no</div><div style='display:none'>no</div>y": "x\ny",
    "<head><title>t</title><style>p{}</style></head><body>v<script>var a='</p>';</script>w": "vw",
    "a<!-- no --- > <b> -->b<!doctype x>c": "abc",
    "<pre> a\n   b</pre>": " a\n   b",
    "l1<br>l2<br><br>l3": "l1\nl2\n\nl3",
    "<details><summary>S</summary>body</details><details open><summary>T</summary>shown</details>": "S\nT\nshown",
    "&lt;tag&gt; &amp; &eacute; &#x41;&nbsp;b": "<tag> & é A\xa0b",
    "</div></p>x</span>": "x", "a <a href='x>y' title=\"<b>\">link</a> b": "a link b",
    "kept<a href=": "kept", "<p>A<div>B</div>C</p>D": "A\n\nB\nC\n\nD",
    "<dl><dt>T<dd>D1<dd>D2<dt>U</dl>": "T\n  D1\n  D2\nU",
    "<noscript>n</noscript><textarea>t</textarea> <template>x</template>z": "t z",
    "<b>one</b><i>two</i> <u> three </u>four": "onetwo three four",
}


def test_page_text_cases(spark):
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(PAGES)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in layout_text.extract(pages).collect()}
    for i, (html, want) in enumerate(PAGES.items()):
        assert got[i] == want, html
    assert layout_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("html,want", [
    ("<a title=Don't>Hello</a> and it's <b>fine</b>", "Hello and it's fine"),
    ("<p class=\"x\"\">one</p> \"two\"<p>three", 'one\n\n"two"\n\nthree'),
    ("<a href=x=\"y>a</a> \"b\"", 'a "b"'), ("<p 'x>a</p>it's", "a\n\nit's"),
    ("<a title = 'x>y' href=/p/>l</a>", "l"), ("<i title=>a</i>b", "ab"), ("a<b title=\"x>y", "a"),
    ("<p class=\"x\"hidden>no</p><p title=it's hidden>no</p>z", "z"),
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> holds", "x=1 holds"),
    ("a<svg><title>t</title><defs/><g><rect/><text>North <tspan>Sea</tspan></text></g><text>B</text>"
     "<defs><text>no</text></defs></svg>c", "a North Sea B c"),
    ("<input type=submit value='Send it'> <input type=hidden value=h><input value=typed>"
     "<input type=Button value=OK>", "Send it OK"),
])
def test_page_text_of_quotes_math_svg_and_buttons(html, want):
    assert layout_text.text_of(html) == want


@pytest.mark.parametrize("html,want", [
    ("<table><tr><td><p>one</p><p>two</p><ul><li>x<li>y</ul><td>b</table>", "one  b\n\ntwo\n\n- x\n- y"),
    ("<table><tr><td rowspan=2>a<td>b1<tr><td>b2<tr><td>c<td>d</table>", "a  b1\n   b2\nc  d"),
    ("<table><tr><td colspan=2 rowspan=2>wide<td>1<tr><td>2<tr><td>x<td>y<td>z</table>", "wide     1\n         2\nx     y  z"),
    ("<table><tr><td rowspan=0>a<td>1<tr><td>2<tr><td>3</table>", "a  1\n   2\n   3"),
    ("<table><tr><td><pre>x  y\n z</pre><td>b</table>", "x  y  b\n z"),
    ("<table><tr><td>l<br>m<td>r<table><tr><td>in<td>ner<tr><td>2</table></table>", "l  r\nm\n   in  ner\n   2"),
    ("<table><tr><td>a<td style='visibility:hidden'>no<td>c<tr><td>1<td>2<td>3</table>", "a     c\n1  2  3"),
    ("a<pre>\nfoo\n  bar</pre>", "a\n\nfoo\n  bar"), ("a<pre>\n\nfoo</pre>", "a\n\n\nfoo"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<div style='visibility:hidden'>no<p style='visibility: visible'>yes<b style='visibility:collapse'>no</b>!</p>no</div>z",
     "yes!\n\nz"),
    ("<ol><li>a<li value=5>b<li>c</ol>", "1. a\n5. b\n6. c"), ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
    ("<ol reversed start=9><li>a<li>b</ol>", "9. a\n8. b"), ("<ol start=x><li value=y>a</ol>", "1. a"),
    ("<div style='visibility:hidden'><table><tr><td>no<td style='visibility:visible'>yes</table></div>", "yes"),
])
def test_cells_spans_lists_and_visibility(html, want):
    assert layout_text.text_of(html) == want


def test_tables_against_a_slow_grid():
    """Random tables with spans: every cell's lines stand at its column, in its rows."""
    rng = random.Random(8)
    for _ in range(200):
        rows, html = [], "<table>"
        for r in range(rng.randint(1, 5)):
            html += "<tr>"
            cells = []
            for _ in range(rng.randint(1, 4)):
                lines = ["".join(rng.choice("abcxyz") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 3))]
                span = rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3])
                cells.append((lines, *span))
                html += f"<td colspan={span[0]} rowspan={span[1]}>{'<br>'.join(lines)}"
            rows.append(cells)
        got = layout_text.text_of(html + "</table>")
        # the slow way: mark every square, then write the text at its place
        squares, placed, top = {}, [], 0
        for r, cells in enumerate(rows):
            c = 0
            for lines, across, down in cells:
                while (r, c) in squares:
                    c += 1
                squares.update({(r + i, c + j): 1 for i in range(down) for j in range(across)})
                placed.append((r, c, lines))
                c += across
        width = {}
        for _, c, lines in placed:
            width[c] = max([width.get(c, 0), *map(len, lines)])
        left, x = {}, 0
        for c in sorted(width):
            left[c], x = x, x + width[c] + 2
        canvas = []
        for r in range(len(rows)):
            mine = [(c, lines) for q, c, lines in placed if q == r]
            height = max(len(lines) for _, lines in mine)
            block = [[" "] * x for _ in range(height)]
            for c, lines in mine:
                for i, line in enumerate(lines):
                    block[i][left[c]:left[c] + len(line)] = line
            canvas += ["".join(b).rstrip() for b in block]
        assert got == "\n".join(canvas)


def test_page_text_of_the_table(spark):
    """Every visible word of the simple pages is there, in order, no other."""
    import re
    from html import unescape
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r.text for r in layout_text.extract(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->|<!DOCTYPE[^>]*>", "", r.html)
        body = body.split("<a href=")[0] if body.count("<") > body.count(">") and body.endswith("<a href=") else body
        want = re.sub(r"<[a-zA-Z/][^>]*(?:>|$)", " ", body)
        words = [w for line in got[r.page_id].split("\n") for w in re.sub(r"^\s*- ", "", line).split()]
        assert "".join(words) == "".join(unescape(want).split())


@pytest.mark.parametrize("html", ["<b>" * 50_000 + "x", "<div>" * 20_000 + "x", "<table><tr><td>" * 100 + "x",
                                  "<ul><li>" * 500 + "x", "<table><tr><td>" * 3_000 + "x"])
def test_deep_pages(html):
    assert layout_text.text_of(html).strip(" -\n") == "x"


def test_helper_columns_keep_out_of_the_way(odd):
    """Columns named like the helpers come through every stage as they were."""
    names = ["__id", "__n", "__base", "__found", "__more", "__clean"]
    docs = odd.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for out in (simhash.one_of_each(docs), pii.redact(docs), mixing.materialise(docs)):
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for n in names)
