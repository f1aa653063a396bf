"""DuckDB twins of the operators that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = r"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\t\n\x0B\f\r ]+'), lambda x: x <> '') AS words FROM documents
), placed AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS place FROM split WHERE len(words) >= 50
), windows AS (
  SELECT doc_id, place, sha256(array_to_string(words[place:place + 49], ' ')) AS passage FROM placed
), earliest AS (
  SELECT passage, min(doc_id) AS low FROM windows GROUP BY passage
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(place, place + 50)) AS place FROM windows JOIN earliest USING (passage) WHERE low < doc_id
), listed AS (
  SELECT doc_id, list(place) AS places FROM covered GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM split LEFT JOIN listed USING (doc_id)
"""

OP6 = f"""
WITH normal AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY body)
"""


def _level(order: int) -> str:
    """Witten-Bell probabilities of one context length over those of the next shorter one."""
    return f"""
seen{order} AS (SELECT label, right(gram, {order + 1}) AS tail, sum(n) AS n FROM counted GROUP BY ALL),
mass{order} AS (
  SELECT label, tail, n, sum(n) OVER ctx AS whole, sum((n > 0)::INT) OVER ctx AS kinds
  FROM seen{order} WINDOW ctx AS (PARTITION BY label, left(tail, {order}))
),
p{order} AS (
  SELECT m.label, m.tail, CASE WHEN whole > 0 THEN (n + kinds * b.p) / (whole + kinds) ELSE b.p END AS p
  FROM mass{order} m JOIN p{order - 1} b ON b.label = m.label AND b.tail = right(m.tail, {order})
)"""


OP8 = rf"""
WITH parts AS (
  SELECT row_number() OVER () AS row_no, page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         coalesce(url, '') AS url, coalesce(((page_id % 5) + 5) % 5 = 0, FALSE) AS held
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
), signed AS (
  SELECT *, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS given,
         '^^^' || regexp_replace(regexp_replace(translate(url, '{UPPER}', '{LOWER}'), '[0-9]', '0', 'g'), '[^a-z0./-]', '~', 'g') || '$' AS signs
  FROM ruled
), grams AS (
  SELECT row_no, given, held, substr(signs, place, 4) AS gram FROM (SELECT *, unnest(range(1, length(signs) - 2)) AS place FROM signed)
), counted AS (
  SELECT label, gram, sum((NOT held AND coalesce(given, '') = label)::INT)::DOUBLE AS n
  FROM grams, (VALUES ('allow'), ('block')) labels(label) GROUP BY ALL
), seen0 AS (
  SELECT label, right(gram, 1) AS tail, sum(n) AS n FROM counted GROUP BY ALL
), p0 AS (
  SELECT label, tail, (n + 1) / (sum(n) OVER (PARTITION BY label) + 33) AS p FROM seen0
), {_level(1)}, {_level(2)}, {_level(3)},
ratios AS (
  SELECT a.tail AS gram, ln(a.p) - ln(b.p) AS ratio FROM p3 a JOIN p3 b ON a.tail = b.tail AND a.label = 'allow' AND b.label = 'block'
), scored AS (
  SELECT row_no, avg(ratio) AS ratio FROM grams JOIN ratios USING (gram) GROUP BY row_no
), chosen AS (
  SELECT CASE WHEN count(DISTINCT given) FILTER (held) = 2 THEN TRUE ELSE FALSE END AS by_held FROM signed
), stats AS (
  SELECT avg(ratio) FILTER (given = 'allow') AS ma, stddev_pop(ratio) FILTER (given = 'allow') AS da,
         avg(ratio) FILTER (given = 'block') AS mb, stddev_pop(ratio) FILTER (given = 'block') AS db
  FROM signed JOIN scored USING (row_no), chosen WHERE held OR NOT by_held
), threshold AS (
  SELECT CASE WHEN ma IS NULL OR mb IS NULL THEN NULL WHEN da + db > 0 THEN (ma * db + mb * da) / (da + db) ELSE (ma + mb) / 2 END AS t FROM stats
)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN t IS NULL OR ratio >= t THEN 'allow' ELSE 'block' END) AS verdict
FROM signed JOIN scored USING (row_no), threshold
"""

SQL = {"op2_substring": OP2, "op6_exact_dedup": OP6, "op8_url_filter": OP8}
