"""Plain versions of the conversation operators."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from functools import lru_cache

ROLES = {"u": "user", "a": "assistant"}
SPACE = "[\x20\x09-\x0D]"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def by_turn(rows):
    """{conv_id: [(turn, role, text), ...]} in order, nulls first."""
    out = defaultdict(list)
    for c, t, r, x in rows:
        out[c].append((t, r, x))
    for c in out:
        out[c].sort(key=lambda row: (row[0] is not None, row[0] or 0, row[1].encode(), row[2].encode()))
    return out


def damage(rows):
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        for _ in range(2 if kind == 3 else 1):
            yield c, t, role, text


def repair(turns):
    """(faults, illegal, cost, audit, lines) by trying every edit from the end."""
    seen, fault = set(), []
    for _, role, text in turns:
        bare = re.sub(SPACE, "", text)
        fault.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, last, inserted):
        """(cost, audit, lines) from row i on, ``last``: the last initial."""
        found = []
        if i == len(turns) and last in ("", "a"):
            found.append((0, "", ()))
        new = "a" if last == "u" else "u"
        if inserted < 3:
            c, a, x = best(i, new, inserted + 1)
            found.append((c + 3, "I" + a, (ROLES[new] + ":", *x)))
        if i < len(turns):
            _, role, text = turns[i]
            c, a, x = best(i + 1, last, 0)
            found.append((c + 4, "D" + a, x))
            if fault[i] not in ("b", "d"):
                more = 3 if fault[i] == "t" else 0
                c, a, x = best(i + 1, new, 0)
                found.append((c + 3 + more, "R" + a, (f"{ROLES[new]}:{text}", *x)))
                if role[:1] and (last + role[0] in ("s", "u", "su", "ua", "au")):
                    c, a, x = best(i + 1, role[0], 0)
                    found.append((c + more, "K" + a, (f"{role}:{text}", *x)))
        return min(found, default=(10**9, "~", ()))

    for i in range(len(turns), 0, -50):  # from the end, so that calls don't nest deeply
        for last in ("", "s", "u", "a"):
            best(i, last, 0)
    cost, audit, lines = best(0, "", 0)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return [fault.count(k) for k in "bdt"], illegal, cost, audit, "\n".join(lines)


def repairs(rows):
    rows = list(rows)
    after = by_turn(damage(rows))
    out = []
    for c in {r[0] for r in rows}:
        turns = after.get(c, [])
        nums = [t for t, _, _ in turns if t is not None]
        gaps = max(nums) - min(nums) + 1 - len(set(nums)) if nums else 0
        (b, d, t), illegal, cost, audit, text = repair(turns)
        out.append((c, gaps, b, d, t, illegal, cost, audit, sha(text)))
    return out


def trie(rows):
    """Every node of the rebuilt conversations, from a dictionary of prefixes."""
    seqs = {}
    for c, t, r, x in rows:
        if c is not None:
            seqs.setdefault(c, []).append((t, r or "", x or ""))

    def order(row):
        return row[0] is not None, row[0] or 0, hashlib.md5(f"{len(row[1])}:{row[1]}{row[2]}".encode()).hexdigest()

    seqs = {c: [(r, x) for _, r, x in sorted(v, key=order)] for c, v in seqs.items()}
    rebuilt = {}
    for c in seqs:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(seqs.get(base, [])[:h] + seqs[c][h:])
    members = defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        below = children[s]
        leaves[s] = sum(leaves[b] for b in below) if below else 1
        saved[s] = sum(saved[b] for b in below) + (len(s) and (len(members[s]) - 1) * len(s[-1][1].encode()))
    return [(min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s],
             sha(",".join(map(str, sorted(c for c in m if rebuilt[c] == s))))) for s, m in members.items()]
