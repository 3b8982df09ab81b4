"""BPE encoding and decoding by speculate and verify.

A word is cut greedily into its longest vocabulary tokens. That guess is the
BPE result exactly when every two neighbours stay apart under the merge rules,
because merges inside a token never depend on what lies beyond its neighbours.
So all neighbouring pairs of all new words of a batch are tested at once: numpy
walks both tokens of every pair back through their merges, from the latest to
the first, and looks up whether the two symbols that met at the border at that
time had a merge that would have been applied before they grew. Words with a
failing pair, and only those, are merged step by step.

Proposals come only from tokens that their own merges reproduce, which is found
once by merging every token's characters.

Words repeat, so each worker keeps the ids of up to ``cache_words`` words and
forgets all when that is full: memory stays bounded, results don't depend on it.

The tokenizer file (its path is a parameter) must be a byte-level BPE without
unknown token whose words are found by a pattern and end in a suffix, as
``word_bpe_49k.json`` is: special tokens are cut out of the raw text first, then
each piece is normalised (NFC, lower case; white space never enters a word).

Defined cases: a null or empty text has no ids and decodes to the empty text.
Every row is encoded on its own, repeated rows alike, whatever their ids or
extra columns. Texts of any length are encoded whole, in pieces of bounded size
between words. Decoding joins token strings by blanks, as the file names no
decoder; special tokens are kept.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import modest_batches

#: Characters of text whose words are held at a time.
CHUNK = 1 << 20
NEVER = np.iinfo(np.int64).max
#: Symbols above which a word is merged with a heap.
LONG_WORD = 100


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable bytes
    stand for themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """Tables of one tokenizer file, and the words encoded so far."""

    def __init__(self, path: str, cache_words: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        suffix = model.get("end_of_word_suffix") or ""
        self.cache_words, self.cache = cache_words, {}
        vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *added.values()])
        self.strings = np.full(size, "", dtype=object)
        for text, i in [*vocab.items(), *added.items()]:
            self.strings[i] = text
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")")
        self.added = added
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # white space by its code points, as the pattern's own engine has it
        space = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", space))

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        ends = {t: i for t, i in vocab.items() if t.endswith(suffix)}
        self.last = {raw(t.removesuffix(suffix)): i for t, i in ends.items()}
        self.inner = {raw(t): i for t, i in vocab.items() if t not in ends}
        self.first_inner = [self.inner[bytes([b])] for b in range(256)]
        self.first_last = [self.last[bytes([b])] for b in range(256)]
        # merges: pair of ids -> (rank, id of the result)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        n = size
        made = np.full(n, -1, np.int64)  # the rank that makes a token; -1: a single letter
        parts = np.full((n, 2), -1, np.int64)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            joint = vocab[a + b]
            self.merges.setdefault((vocab[a], vocab[b]), (rank, joint))
        for (a, b), (rank, joint) in self.merges.items():
            if made[joint] < 0:
                made[joint], parts[joint] = rank, (a, b)
        self.n, self.made, self.parts = n, made, parts
        keys = np.fromiter((a * n + b for a, b in self.merges), np.int64, len(self.merges))
        ranks = np.fromiter((r for r, _ in self.merges.values()), np.int64, len(self.merges))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], ranks[order]
        # tokens to propose: those that their own merges give
        self.inner = {w: i for w, i in self.inner.items() if self.merged([self.first_inner[b] for b in w]) == [i]}
        self.last = {w: i for w, i in self.last.items() if w and self.exact(w) == [i]}
        self.longest_last = max(map(len, self.last))
        self.longest: dict[bytes, int] = {}
        for w in self.inner:
            head = w[:2]
            self.longest[head] = max(self.longest.get(head, 1), len(w))

    # -- one word ---------------------------------------------------------
    def exact(self, word: bytes) -> list[int]:
        return self.merged([self.first_inner[b] for b in word[:-1]] + [self.first_last[word[-1]]])

    def merged(self, symbols: list[int]) -> list[int]:
        """Apply merges, lowest rank first, leftmost first among equal ranks."""
        if len(symbols) > LONG_WORD:
            return self.merged_long(symbols)
        get, none = self.merges.get, (NEVER, -1)
        found = [get(p, none) for p in zip(symbols, symbols[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            symbols[i:i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((symbols[i - 1], symbols[i]), none)
            if i < len(found):
                found[i] = get((symbols[i], symbols[i + 1]), none)
        return symbols

    def merged_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap: words of any length in n log n steps."""
        n, get = len(symbols), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, a, b, m[1]) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (m := get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, joint = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged since
            symbols[i], symbols[j], after[i] = joint, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := get((symbols[x], symbols[y]))):
                    heapq.heappush(heap, (m[0], x, symbols[x], symbols[y], m[1]))
        return [s for s in symbols if s >= 0]

    def proposed(self, word: bytes) -> list[int]:
        inner, last, longest = self.inner, self.last, self.longest
        out, at, n = [], 0, len(word)
        while True:
            rest = last.get(word[at:]) if n - at <= self.longest_last else None
            if rest is not None:
                out.append(rest)
                return out
            end = min(at + longest.get(word[at:at + 2], 1), n - 1)
            while (token := inner.get(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = end

    # -- all neighbouring pairs at once -----------------------------------
    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the border between two tokens survives all merges."""
        good = np.ones(len(left), bool)
        at = np.arange(len(left))
        l, r = left.astype(np.int64), right.astype(np.int64)
        # ranks at which the symbols at the border are merged away from it
        l_until, r_until = np.full(len(l), NEVER), np.full(len(r), NEVER)
        while len(at):
            key = l * self.n + r
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[where] == key, self.ranks[where], NEVER)
            # an equal rank on the left is applied first, being further left
            joins = (rank < l_until) & (rank <= r_until) & (rank != NEVER)
            good[at[joins]] = False
            l_made, r_made = self.made[l], self.made[r]
            go = ~joins & ((l_made >= 0) | (r_made >= 0))
            at, l, r, l_until, r_until, l_made, r_made = (
                x[go] for x in (at, l, r, l_until, r_until, l_made, r_made))
            back = l_made > r_made  # undo the later merge; of equal ranks the right one is later
            l_until, r_until = np.where(back, l_made, l_until), np.where(back, r_until, r_made)
            l, r = np.where(back, self.parts[l, 1], l), np.where(back, r, self.parts[r, 0])
        return good

    def learn(self, words: list[str]) -> None:
        """Put ids of new words into the cache."""
        raw = [w.encode("utf-8") for w in words]
        guess = [self.proposed(w) for w in raw]
        counts = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter(chain.from_iterable(guess), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(guess)), counts)
        inside = owner[:-1] == owner[1:]
        key = (flat[:-1] * self.n + flat[1:])[inside]
        pairs, back = np.unique(key, return_inverse=True)
        fails = ~self.stay_apart(pairs // self.n, pairs % self.n)[back]
        ends = np.cumsum(counts) * 4
        packed = flat.astype("<u4").tobytes()
        self.cache.update((w, packed[e - 4 * n:e]) for w, n, e in zip(words, counts.tolist(), ends.tolist()))
        for k in np.unique(owner[:-1][inside][fails]).tolist():
            self.cache[words[k]] = np.array(self.exact(raw[k]), "<u4").tobytes()

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # letter by letter: a capital sigma becomes the same letter everywhere
        return text.replace("Σ", "σ").lower()

    def pieces(self, text: str) -> Iterator[bytes | list[str]]:
        """A text's special tokens (packed) and lists of words, each list of bounded length."""
        for piece in self.special.split(text):
            if piece in self.added:
                yield np.array([self.added[piece]], "<u4").tobytes()
            elif len(piece) <= CHUNK:
                yield self.words.findall(self.normal(piece))
            else:
                found = (m[0] for m in self.words.finditer(self.normal(piece)))
                while words := list(islice(found, CHUNK // 8)):
                    yield words

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers. New words of several
        texts are proposed and verified together."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, bytes | list[str]]] = []

        def flush() -> None:
            words = set().union(*(x for _, x in held if isinstance(x, list)))
            new = {w for w in words if w not in self.cache}
            if len(self.cache) + len(new) > self.cache_words:
                self.cache.clear()
                new = words
            if new:
                self.learn(list(new))
            for i, x in held:
                out[i].append(x if isinstance(x, bytes) else b"".join(map(self.cache.__getitem__, x)))
            held.clear()

        n = 0
        for i, text in enumerate(texts):
            for x in self.pieces(text):
                held.append((i, x))
                n += len(x)
                if n >= CHUNK // 8:
                    flush()
                    n = 0
        flush()
        return [b"".join(x) for x in out]

    def decode(self, ids: bytes) -> str:
        return " ".join(self.strings[np.frombuffer(ids, "<u4")].tolist())


@lru_cache(maxsize=2)
def tables(path: str) -> WordBpe:
    """One per worker process and file."""
    return WordBpe(path)


def encode(text: Column, path: str) -> Column:
    """Token ids of ``text``, packed as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series(tables(path).encode_all([t or "" for t in texts]), dtype=object)

    return packed(text)


def decode(ids: Column, path: str) -> Column:
    """The text of packed token ids."""

    @F.pandas_udf("string")
    def unpacked(ids: pd.Series) -> pd.Series:
        bpe = tables(path)
        return pd.Series([bpe.decode(b) for b in ids], dtype=object)

    return unpacked(ids)


def encoded_and_decoded(text: Column, path: str) -> Column:
    """A struct of the packed ``ids`` and the ``decoded`` text, made in one pass
    through the workers."""

    @F.pandas_udf("struct<ids:binary,decoded:string>")
    def both(texts: pd.Series) -> pd.DataFrame:
        bpe = tables(path)
        ids = bpe.encode_all([t or "" for t in texts])
        return pd.DataFrame({"ids": ids, "decoded": [bpe.decode(b) for b in ids]})

    return both(text)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, packed ``ids`` and the ``decoded`` text of every row."""
    modest_batches(docs.sparkSession)
    return (docs.select("doc_id", encoded_and_decoded(F.col("text"), path).alias("both"))
            .select("doc_id", "both.ids", "both.decoded"))


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
