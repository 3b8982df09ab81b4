"""DuckDB SQL for the span queries, written apart from the operators: plain
patterns, window sums for the positions."""

from __future__ import annotations

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
ASSIGN = (r"""((?i)password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
RUN = "[A-Za-z0-9_+/=-]{20,}"

#: kind, own score, words nearby that raise it
CONTEXT = (
    ("email", 0.6, "e-?mail|mail|contact|write|kontakt|courriel|correo"),
    ("ip", 0.5, "ip|address|host|server|login"),
    ("card", 0.6, "card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta"),
    ("phone", 0.5, "phone|call|tel|mobile|fax|telefon|t[ée]l[ée]phone|tel[ée]fono"),
    ("iban", 0.7, "iban|bank|account|konto|compte|cuenta"),
    ("ssn", 0.2, "ssn|social|security|insurance"))


def _matches(kinds) -> str:
    """CTEs from ``d(rid, t)`` to ``s``: each match with its offsets."""
    parts = "\n  UNION ALL ".join(
        f"SELECT rid, t, {place} AS place, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS hits, "
        f"string_split_regex(t, '{p}') AS gaps FROM d WHERE regexp_matches(t, '{p}')"
        for place, (kind, p) in enumerate(kinds))
    return f"""h AS (
  {parts}),
m AS (SELECT rid, t, place, kind, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap,
             generate_subscripts(hits, 1) AS i FROM h),
s AS (SELECT *, (sum(length(gap) + length(hit)) OVER (PARTITION BY rid, place ORDER BY i))::BIGINT AS stop FROM m)"""


_WORDS = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{w}'" for k, _, w in CONTEXT) + " END"
_OWN = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v, _ in CONTEXT) + " END"

PII = fr"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{_matches((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE), ("iban", IBAN), ("ssn", SSN)))},
g AS (SELECT *, stop - length(hit) AS start, regexp_replace(hit, '[^0-9]', '', 'g') AS digits,
             replace(hit, ' ', '') AS plain FROM s),
q AS (
  SELECT * FROM g WHERE CASE kind
    WHEN 'ip' THEN list_max([x::DOUBLE FOR x IN string_split(hit, '.')]) <= 255
    WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum(
      [CASE WHEN (length(digits) - i) % 2 = 0 THEN digits[i]::INT
            ELSE 2 * digits[i]::INT - CASE WHEN digits[i]::INT > 4 THEN 9 ELSE 0 END END
       FOR i IN range(1, length(digits) + 1)]) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'iban' THEN length(plain) BETWEEN 15 AND 34 AND list_reduce(
      [0] || [x::INT FOR x IN string_split(array_to_string(
        [CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END
         FOR c IN string_split(plain[5:] || plain[1:4], '')], ''), '')],
      lambda a, x: (a * 10 + x) % 97) = 1
    ELSE true END),
c AS (
  SELECT *, regexp_matches(substr(t, greatest(start - 40, 0) + 1, start - greatest(start - 40, 0)) || ' ' || chr(10)
              || ' ' || substr(t, stop + 1, 40), '(?i)(?:^|[^a-z])(?:' || {_WORDS} || ')(?:$|[^a-z])') AS near
  FROM q),
f AS (SELECT *, {_OWN} + CASE WHEN near THEN 0.3 ELSE 0 END AS score FROM c),
a AS (
  SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 4) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place)
           FILTER (place < 4 OR score >= 0.5) AS spans,
         string_agg(printf('%.1f', score::DOUBLE), ',' ORDER BY start, place)
           FILTER (place < 4 OR score >= 0.5) AS scores
  FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN a USING (rid)
"""

SECRETS = fr"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner,
         coalesce(source, '') || '/' || coalesce(lang, '') AS repository FROM documents),
{_matches((("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", RUN)))},
g AS (SELECT rid, place, kind, hit, stop - length(hit) AS start, stop,
             CASE WHEN kind = 'assign' THEN regexp_extract(hit, '{ASSIGN}', 2) ELSE hit END AS value FROM s),
b AS (
  SELECT * FROM g WHERE CASE kind WHEN 'assign' THEN length(value) >= 6 WHEN 'access' THEN length(hit) >= 20
    WHEN 'token' THEN regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')
                      AND len(list_distinct(string_split(hit, ''))) >= 10
    ELSE true END),
k AS (
  SELECT * FROM b WHERE kind <> 'token' OR NOT EXISTS (
    SELECT 1 FROM b AS o WHERE o.rid = b.rid AND o.kind <> 'token' AND o.start < b.stop AND b.start < o.stop)),
n AS (SELECT *, owners >= 3 OR owners > 1 AND repositories >= 8 AS example
      FROM (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT owner || chr(0) || repository) AS repositories
            FROM k JOIN d USING (rid) GROUP BY value)),
a AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (kind <> 'token') AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place)
           FILTER (kind <> 'token' OR NOT example) AS spans,
         count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_example,
         max(owners) AS most_owners, max(repositories) AS most_repositories
  FROM k JOIN n USING (value) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_example, 0) AS n_example, coalesce(most_owners, 0) AS most_owners,
       coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN a USING (rid)
"""
