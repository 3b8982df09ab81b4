"""DuckDB SQL for the conversation operators. CRC-32 is linear over bits: a set bit
contributes a power of the shift step on 1, and so do the bits of the start value."""

_CRC = """
steps AS (
  SELECT 0 AS m, 1::BIGINT AS v
  UNION ALL SELECT m + 1, xor(v >> 1, (v & 1) * 3988292384) FROM steps WHERE m < 400),
power AS (
  SELECT m, v FROM steps UNION ALL SELECT -i, 1::BIGINT << i FROM range(1, 32) t(i)),
bits AS (
  SELECT k.key, 8 * (length(k.key) - i + 1) - j AS m
  FROM keys k, range(1, 50) p(i), range(8) b(j)
  WHERE i <= length(k.key) AND (ascii(substr(k.key, i::INTEGER, 1)) >> j::INTEGER) & 1 = 1
  UNION ALL SELECT key, 8 * length(key) - i FROM keys, range(32) t(i)),
crc AS (
  SELECT key, xor(4294967295, bit_xor(v)) AS crc FROM bits JOIN power USING (m) GROUP BY key)"""

TRIE = f"""
WITH RECURSIVE
keys AS (SELECT DISTINCT conv_id::VARCHAR AS key FROM conversations WHERE conv_id IS NOT NULL), {_CRC},
t AS (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         octet_length(encode(coalesce(text, '')))::BIGINT AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos FROM t),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, crc % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t) JOIN crc ON key = conv_id::VARCHAR),
r AS (
  SELECT c.conv_id, 0 AS own, pos, digest, bytes FROM c JOIN n ON n.conv_id = c.base AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, digest, bytes FROM c JOIN n ON n.conv_id = c.conv_id AND pos >= h),
s AS (
  SELECT c.conv_id, coalesce(string_agg(digest, '' ORDER BY own, pos), '') AS seq
  FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
p AS (
  SELECT conv_id, seq, d, seq[1:32 * d] AS prefix FROM s, range(0, (SELECT max(length(seq)) // 32 + 1 FROM s)) t(d)
  WHERE 32 * d <= length(seq)),
b AS (SELECT digest, max(bytes) AS bytes FROM t GROUP BY digest),
node AS (
  SELECT prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (seq = prefix), '')) AS ends_sha256
  FROM p GROUP BY prefix, d),
own AS (
  SELECT node.*, coalesce((n_convs - 1) * bytes, 0) AS saved,
         (SELECT count(*) FROM node c WHERE c.depth = node.depth + 1 AND starts_with(c.prefix, node.prefix)) AS n_children
  FROM node LEFT JOIN b ON digest = right(prefix, 32)),
sums AS (
  SELECT a.prefix, count(*) FILTER (x.n_children = 0) AS n_leaves, sum(x.saved)::BIGINT AS saved_tokens
  FROM own a JOIN own x ON starts_with(x.prefix, a.prefix) GROUP BY a.prefix)
SELECT own.conv_id, own.depth, u.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens,
       own.ends_sha256
FROM own JOIN sums USING (prefix) LEFT JOIN node u ON own.depth > 0 AND u.prefix = own.prefix[1:32 * (own.depth - 1)]
"""


def _then(edit: str, cost: str, behind: str, line: str) -> str:
    """An edit before what is behind it; ``line`` is what it leaves."""
    return (f"{{'c': {behind}.c + {cost}, 'a': '{edit}' || {behind}.a, "
            f"'x': {line if line == 'NULL' else f'[{line}]'} || {behind}.x}}")


def _step(s: int, after: str) -> str:
    """The cheapest way from state ``s`` over a row, without insertions before it."""
    nxt = (2, 2, 3, 2)[s]
    role = "assistant" if s == 2 else "user"
    keep = {0: "CASE WHEN ini = 's' THEN 2 WHEN ini = 'u' THEN 3 END", 1: "CASE WHEN ini = 'u' THEN 3 END",
            2: "CASE WHEN ini = 'a' THEN 4 END", 3: "CASE WHEN ini = 'u' THEN 3 END"}[s]
    gone = f"{{'c': {after}[{s + 1}].c + 4, 'a': 'D' || {after}[{s + 1}].a, 'x': {after}[{s + 1}].x}}"
    change = _then("R", "3 + extra", f"{after}[{nxt + 1}]", f"'{role}:' || text")
    kept = _then("K", "extra", f"{after}[{keep}]", "role || ':' || text")
    return (f"CASE WHEN fault IN ('b', 'd') THEN {gone} WHEN ({keep}) IS NULL THEN least({gone}, {change}) "
            f"ELSE least({gone}, {change}, {kept}) END")


def _insert(s: int, table: str) -> str:
    nxt = (2, 2, 3, 2)[s]
    role = "assistant" if s == 2 else "user"
    return f"least({table}[{s + 1}], {_then('I', '3', f'{table}[{nxt + 1}]', chr(39) + role + ':' + chr(39))})"


_END = ("[{'c': 0, 'a': '', 'x': []::VARCHAR[]}, {'c': 6, 'a': 'II', 'x': ['user:', 'assistant:']}, "
        "{'c': 3, 'a': 'I', 'x': ['assistant:']}, {'c': 0, 'a': '', 'x': []::VARCHAR[]}]")

REPAIR = rf"""
WITH RECURSIVE
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations),
keys AS (SELECT DISTINCT key FROM raw), {_CRC},
d AS (
  SELECT conv_id, turn, CASE WHEN crc % 20 = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN crc % 20 = 1 THEN '' WHEN crc % 20 = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw JOIN crc USING (key), range(2) t(copy) WHERE crc % 20 <> 0 AND (copy = 0 OR crc % 20 = 3)),
n AS (
  SELECT *, coalesce(conv_id::VARCHAR, '') AS conv, left(role, 1) AS ini,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM d),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault,
         lag(ini) OVER (PARTITION BY conv ORDER BY i) || ini AS pair
  FROM n),
e AS (SELECT *, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS extra FROM f),
dp AS (
  SELECT conv, max(i) + 1 AS i, {_END} AS best FROM f GROUP BY conv
  UNION ALL
  SELECT conv, i, [{', '.join(_insert(s, 'two') for s in range(4))}]
  FROM (SELECT conv, i, [{', '.join(_insert(s, 'one') for s in range(4))}] AS two
        FROM (SELECT e.conv, e.i, [{', '.join(_step(s, 'best') for s in range(4))}] AS one
              FROM dp JOIN e ON e.conv = dp.conv AND e.i = dp.i - 1))),
g AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best[1].c, 0)::BIGINT AS cost,
       coalesce(best[1].a, '') AS audit, sha256(coalesce(array_to_string(best[1].x, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS conv FROM conversations) c
LEFT JOIN g USING (conv) LEFT JOIN (SELECT * FROM dp WHERE i = 1) USING (conv)
"""
