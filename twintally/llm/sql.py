"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import string

from twintally.llm.lines import NEAR_CHARACTERS, NEAR_WORDS
from twintally.llm.rules import Limits

SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def words(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, '{pattern}')"


OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, {words(lower('text'), SPACED)} AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, (SELECT min(b) FROM r WHERE a = doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id)"""

OP2 = f"""WITH d AS (SELECT doc_id, {words(lower('text'), ALNUM)} AS ws FROM documents),
b AS (SELECT item_id, {words(lower('text'), ALNUM)} AS ws FROM benchmark),
x AS (SELECT item_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 10 THEN [ws]
        ELSE list_transform(range(1, len(ws) - 8), lambda i: ws[i:i + 9]) END) AS phrase FROM b),
k AS (SELECT DISTINCT len(phrase) AS k FROM x),
o AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS i, ws FROM d, k),
f AS (SELECT doc_id, i, k, item_id FROM (SELECT doc_id, i, k, ws[i:i + k - 1] AS phrase FROM o) JOIN x USING (phrase)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM f) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM f) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


def covered(name: str, width: int) -> str:
    """CTE: number of words in windows of ``width`` words that occur twice or more in their document."""
    return f"""{name} AS (SELECT doc_id, count(DISTINCT j) AS n FROM (
    SELECT doc_id, unnest(range(i, i + {width})) AS j FROM (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS times FROM (
            SELECT doc_id, i, md5(array_to_string(ws[i:i + {width - 1}], ' ')) AS h
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {width - 2})) AS i FROM w)))
    WHERE times > 1) GROUP BY 1)"""


def op4(limits: Limits = Limits()) -> str:
    return f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {words("coalesce(text, '')", SPACED)} AS ws FROM documents),
{covered('a', limits.window)}, {covered('c', limits.repeat_words)}, {covered('t', limits.max_repeat_words + 1)},
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
      WHERE regexp_matches(line, '{SPACED}') GROUP BY 1),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             coalesce(l.n, 0) AS n_dup_lines, coalesce(a.n, 0) AS n_repeat_words, coalesce(c.n, 0) AS n_covered_words, t.n AS too_long
      FROM w LEFT JOIN l USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)),
v AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.max_window_percent} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, base_failed,
       NOT base_failed AND 100 * n_covered_words <= {limits.max_covered_percent} * n_words AND too_long IS NULL AS kept FROM v"""


OP10 = f"""WITH a AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
b AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS k FROM a),
l AS (SELECT doc_id, k, {words(lower('line'), SPACED)} AS ws FROM b),
o AS (SELECT doc_id, k, ws, array_to_string(ws, ' ') AS whole, CAST(doc_id AS HUGEINT) * 1099511627776 + k AS place FROM l WHERE len(ws) >= 1),
f AS (SELECT whole, min(place) AS at_first, any_value(ws) AS ws FROM o GROUP BY 1),
g AS (SELECT whole, at_first, units, kind, md5(kind || array_to_string(units, chr(1))) AS h FROM (
      SELECT whole, at_first, 'w' AS kind, ws AS units FROM f WHERE len(ws) >= {NEAR_WORDS}
      UNION ALL
      SELECT whole, at_first, 'c', list_transform(range(1, length(whole) + 1), lambda i: substring(whole, i, 1)) FROM f
      WHERE len(ws) < {NEAR_WORDS} AND length(whole) >= {NEAR_CHARACTERS})),
v AS (SELECT whole, at_first, i, md5(kind || array_to_string(list_concat(units[:i - 1], units[i + 1:]), chr(1))) AS h
      FROM (SELECT *, unnest(range(1, len(units) + 1)) AS i FROM g)),
e AS (SELECT x.whole FROM v x JOIN v y ON x.h = y.h AND x.i = y.i AND y.at_first < x.at_first
      UNION SELECT x.whole FROM v x JOIN g y ON x.h = y.h AND y.at_first < x.at_first
      UNION SELECT y.whole FROM v x JOIN g y ON x.h = y.h AND x.at_first < y.at_first),
z AS (SELECT doc_id, k FROM o JOIN f USING (whole) WHERE place > at_first OR whole IN (SELECT whole FROM e)),
c AS (SELECT doc_id, count(*) AS n FROM o GROUP BY 1),
y AS (SELECT doc_id, list(k) AS gone FROM z GROUP BY 1)
SELECT doc_id, coalesce(c.n, 0) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(
            list_filter(range(len(parts)), lambda i: NOT list_contains(gone, i)), lambda i: parts[i + 1]), chr(10)) END AS text
FROM a LEFT JOIN c USING (doc_id) LEFT JOIN y USING (doc_id)"""


def op12(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds are written out; a part's coordinate is a row."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"d{k} AS (SELECT r, p, e, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM c JOIN b{k} USING (p, k) GROUP BY r, p, e)")
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, p, min(d) AS d, min(d * {entries} + e) % {entries} AS e FROM d{k} GROUP BY r, p)")
        if k < rounds:
            steps.append(f"m{k} AS (SELECT p, e, k, CAST(floor(sum(x) / count(*)) AS BIGINT) AS y FROM c JOIN a{k} USING (r, p) GROUP BY p, e, k)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b{k}.p, b{k}.e, b{k}.k, coalesce(m{k}.y, b{k}.y) AS y FROM b{k} LEFT JOIN m{k} USING (p, e, k))")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
places AS (SELECT r, v, unnest(range(len(v))) AS i FROM kept),
c AS MATERIALIZED (
  SELECT r, i // (len(v) // {parts}) AS p, i % (len(v) // {parts}) AS k, CAST(floor(4096 * CAST(v[i + 1] AS DOUBLE)) AS BIGINT) AS x FROM places),
b0 AS (SELECT p, r - 1 AS e, k, x AS y FROM c WHERE r <= {entries}),
{", ".join(steps)},
books AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, k)) AS codebooks_sha256 FROM b{rounds}),
coded AS (
  SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r) CROSS JOIN books
"""
