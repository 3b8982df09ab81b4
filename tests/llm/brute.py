"""Plain versions of the operators, row by row in Python, for comparison."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash

WORD = re.compile("[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, shingle: int = 3) -> str:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    n = max(1, len(words) - shingle + 1) if words else 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + shingle]).encode(), 42) for i in range(n)]
    out = 0
    for b in range(64):
        if 2 * sum(h >> b & 1 for h in hashes) > len(hashes):
            out |= 1 << b
    return f"{out:016x}"


def components(ids: list[int], prints: list[str], distance: int = 2) -> list[int]:
    values = np.array([int(p, 16) for p in prints], np.uint64)
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= distance) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i in range(len(ids)):
        least[find(i)].append(ids[i])
    return [min(least[find(i)]) for i in range(len(ids))]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _spans(text, kinds):
    out = []
    for place, (kind, pattern, ok) in enumerate(kinds):
        out += [(m.start(), place, m.end(), kind) for m in re.finditer(pattern, text) if ok(m)]
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+",
     lambda m: 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
)
SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
     lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def pii_spans(text):
    return _spans(text or "", PII)


def secret_spans(text):
    return _spans(text or "", SECRETS)


def words(text) -> int:
    return len(WORD.findall(text or ""))


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2) -> dict:
    """Share out by weight, cut what is above the cap, share out again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed: dict = {}
    while True:
        free = [s for s in order if s not in fixed]
        left = share * sum(sizes.values()) - sum(fixed.values())
        level = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if level[s] > cap * sizes[s]]
        if not over:
            return fixed | level
        fixed |= {s: float(cap * sizes[s]) for s in over}


def top_k(ids, vectors, queries, k, score=lambda q, x: x @ q):
    """{query id: [(id, score), ...]}"""
    out = {}
    ids = np.asarray(ids)
    for i, q in zip(ids[queries], vectors[queries]):
        s = score(q, vectors)
        other = ids != i
        order = np.lexsort([ids[other], -s[other]])[:k]
        out[int(i)] = list(zip(ids[other][order].tolist(), s[other][order].tolist()))
    return out


def crc(text) -> int | None:
    return None if text is None else zlib.crc32(text.encode())
