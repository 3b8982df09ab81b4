"""DuckDB SQL of the URL query: itemsets by listing every token combination of every
labelled URL, which is all right for small tables."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _pieces(text: str, at: str, mark: str) -> str:
    whole = f"[x for x in string_split({text}, '{at}') if x <> '']"
    words = f"flatten([regexp_split_to_array(x, '[-_.+~]') for x in {whole} if regexp_matches(x, '[-_.+~]')])"
    return f"['{mark}' || x for x in list_concat({whole}, [y for y in {words} if y <> ''])]"


URLS = rf"""
WITH p AS (
  SELECT page_id, url, instr(coalesce(url, ''), '://') > 0 AS fine,
         substr(url, instr(url, '://') + 3) AS rest
  FROM pages),
q AS (
  SELECT page_id, url, fine,
         CASE WHEN fine THEN {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} ELSE '' END AS host,
         CASE WHEN fine THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM p),
r AS (
  SELECT *,
         CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM q),
v AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled
  FROM r),
marks AS (SELECT doc_id, bool_or(toxic = 1 OR quality = 0) AS marked FROM labels GROUP BY doc_id),
lab AS (
  SELECT url, bool_or(coalesce(ruled = 'block', marked)) AS bad
  FROM v LEFT JOIN marks ON doc_id = try_cast(nullif(regexp_extract(path, '^/[^/]+/([0-9]+)', 1), '') AS BIGINT)
  WHERE url IS NOT NULL AND coalesce(ruled = 'block', marked) IS NOT NULL
  GROUP BY url),
low AS (
  SELECT url, low, substr(low, instr(low, '://') + 3) AS rest
  FROM (SELECT DISTINCT url, regexp_replace({_LOWER.format('url')}, '[0-9]+', '0', 'g') AS low FROM v WHERE fine)),
cut AS (
  SELECT *, regexp_extract(rest, '^[^/?#]*') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(rest, '^[^#]*#([^#].*)$', 1) AS fragment
  FROM low),
tokens AS (
  SELECT url, list_sort(list_distinct(flatten([
    ['s:' || substr(low, 1, instr(low, '://') - 1)],
    ['x:' || x for x in [regexp_extract(path, '\.([a-z]+)$', 1)] if x <> ''],
    ['f:' || x for x in [fragment] if x <> ''],
    {_pieces('host', '.', 'h:')}, {_pieces('path', '/', 'p:')},
    ['q:' || x for x in regexp_split_to_array(query, '[&;]') if x <> ''],
    ['k:' || string_split(x, '=')[1] for x in regexp_split_to_array(query, '[&;]') if x <> '']]))) AS tokens
  FROM cut),
total AS (
  SELECT count(*) AS total, count_if(bad) / count(*) AS share,
         greatest(20, ceil(0.002::DOUBLE * count(*)))::BIGINT AS least
  FROM lab),
each AS (SELECT lab.url, bad, unnest(tokens) AS token FROM lab JOIN tokens USING (url)),
seen AS (
  SELECT token, count(*) AS n, count_if(bad) AS n_bad, string_agg(url, ' ' ORDER BY url) AS urls
  FROM each, total GROUP BY token, least, total.total HAVING count(*) >= least AND count(*) < total.total),
items AS (
  SELECT min(token) AS token, abs(any_value(n_bad) - any_value(n) * any_value(share)) / sqrt(any_value(n)) AS telling
  FROM seen, total GROUP BY urls),
kept AS (
  SELECT url, bad, token FROM each JOIN items USING (token)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY -telling, token) <= 16),
basket AS (SELECT url, any_value(bad) AS bad, list(token ORDER BY token) AS items FROM kept GROUP BY url),
sets AS (
  SELECT [items[i + 1] for i in range(0, len(items)) if (mask >> i) & 1 = 1] AS a, bad
  FROM basket, LATERAL (SELECT unnest(range(1, 1 << len(items))) AS mask)),
counts AS (SELECT a, count(*) AS n, count_if(bad) AS n_bad FROM sets GROUP BY a),
sure AS (
  SELECT a, 'block' AS verdict, n, n_bad / n AS confidence FROM counts, total WHERE n_bad >= least
  UNION ALL SELECT a, 'allow', n, (n - n_bad) / n FROM counts, total WHERE n - n_bad >= least),
less AS (
  SELECT a, verdict, n, confidence, unnest(a) AS gone FROM sure WHERE confidence >= 0.9::DOUBLE),
rules AS (
  SELECT l.a, l.verdict, l.n, l.confidence
  FROM less l JOIN total ON true LEFT JOIN sure s ON s.verdict = l.verdict AND s.a = [x for x in l.a if x <> l.gone]
  GROUP BY l.a, l.verdict, l.n, l.confidence
  HAVING l.confidence >= max(CASE WHEN len(l.a) = 1 THEN CASE WHEN l.verdict = 'block' THEN share ELSE 1 - share END
                                  ELSE coalesce(s.confidence, 0) END) + 0.01::DOUBLE),
fired AS (
  SELECT url, verdict, array_to_string(a, ' ') AS mined_rule, confidence
  FROM tokens JOIN rules ON list_has_all(tokens, a)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY confidence DESC, n DESC, len(a) DESC, array_to_string(a, ' ')) = 1)
SELECT page_id, host, path, rule, coalesce(ruled, verdict, 'allow') AS verdict,
       CASE WHEN rule IS NULL THEN mined_rule END AS mined_rule,
       CASE WHEN rule IS NULL THEN confidence END AS confidence
FROM v LEFT JOIN fired USING (url)
"""
