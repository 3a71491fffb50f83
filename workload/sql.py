"""SQL side of the registered queries, for DuckDB."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from workload.pairs import Pair, duck_clean, duck_sides, duck_sql

DATES = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "%Y-%m-%d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "%Y/%m/%d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "%d/%m/%Y"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "%d-%m-%Y"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "%d.%m.%Y"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{2}:\d{2}:\d{2}$", "%Y-%m-%d %H:%M:%S"),
]
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(x: str) -> str:
    dotted = f"replace({x}, ',', '.')"
    return f"CASE WHEN regexp_matches({dotted}, '{NUMBER}') THEN TRY_CAST({dotted} AS DOUBLE) END"


def num_diff(a: str, b: str) -> str:
    return f"({number(a)}) - ({number(b)})"


def keyed(pair: Pair) -> str:
    """CTEs a, b and j: the pairs."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in pair.key)
    shown = [f"a.{k}" for k in pair.key] + [f"a.{c} AS {c}__a, b.{c} AS {c}__b" for c in pair.values]
    return f"{duck_sides(pair)},\nj AS (SELECT {', '.join(shown)} FROM a JOIN b ON {on})"


def positional(pair: Pair, order: str) -> str:
    """CTEs a, b and j of rows numbered by ``order``."""
    ctes = []
    for name, select in (("a", pair.a), ("b", pair.b)):
        cleaned = ", ".join(f"{duck_clean(f'CAST({c} AS VARCHAR)')} AS {c}" for c in pair.columns)
        ctes.append(f"{name} AS (SELECT row_number() OVER (ORDER BY {order}) AS _pos, {cleaned} FROM ({duck_sql(select)}))")
    shown = ["a._pos"] + [f"a.{c} AS {c}__a, b.{c} AS {c}__b" for c in pair.columns]
    return f"WITH {', '.join(ctes)},\nj AS (SELECT {', '.join(shown)} FROM a JOIN b USING (_pos))"


def differs(values: Sequence[str]) -> str:
    return "(" + " OR ".join(f"{c}__a <> {c}__b" for c in values) + ")"


def missing(pair: Pair, of: str, other: str) -> str:
    on = " AND ".join(f"x.{k} = y.{k}" for k in pair.key)
    return f"SELECT x.* FROM {of} x WHERE NOT EXISTS (SELECT 1 FROM {other} y WHERE {on})"


def diff_counts(pair: Pair) -> str:
    per_column = "".join(f", count(*) FILTER ({c}__a <> {c}__b) AS diff__{c}" for c in pair.values)
    return f"""{keyed(pair)}
SELECT count(*) AS n_both, (SELECT count(*) FROM ({missing(pair, 'a', 'b')})) AS only_a,
       (SELECT count(*) FROM ({missing(pair, 'b', 'a')})) AS only_b,
       count(*) FILTER ({differs(pair.values)}) AS n_diff{per_column} FROM j"""


def column_summary(ctes: str, values: Sequence[str], is_key: str = "No") -> str:
    counts = ", ".join(f"count(*) FILTER ({c}__a <> {c}__b) AS d{i}" for i, c in enumerate(values))
    parts = [
        f"""SELECT {i + 1} AS position, '{c}' AS "column", '{is_key}' AS is_key, n - d{i} AS n_equal, d{i} AS n_diff, n AS n_total,
       d{i} / n * 100 AS pct_diff, printf('%.1f%%', d{i} / n * 100) AS pct_text,
       CASE WHEN d{i} = 0 THEN 'OK' ELSE 'DIFFERENZE' END AS status FROM s"""
        for i, c in enumerate(values)
    ]
    return f"{ctes},\ns AS MATERIALIZED (SELECT count(*) AS n, {counts} FROM j)\n" + "\nUNION ALL ".join(parts)


def diff_rows(ctes: str, key: Sequence[str], values: Sequence[str], limit: int | None = None) -> str:
    shown = list(key)
    for c in values:
        a, b = f"{c}__a", f"{c}__b"
        shown += [a, b, f"{num_diff(a, b)} AS {c}__num_diff"]
    rows = f"SELECT * FROM j WHERE {differs(values)}"
    if limit is not None:
        order = [*key, *(f"{c}__a" for c in values), *(f"{c}__b" for c in values)]
        rows += f" ORDER BY {', '.join(order)} LIMIT {limit}"
    return f"{ctes}\nSELECT {', '.join(shown)} FROM ({rows})"


def diff_cells(ctes: str, key: Sequence[str], values: Sequence[str]) -> str:
    parts = [
        f"""SELECT {', '.join(key)}, '{c}' AS "column", {c}__a AS a, {c}__b AS b, {num_diff(f'{c}__a', f'{c}__b')} AS num_diff
FROM j WHERE {c}__a <> {c}__b"""
        for c in values
    ]
    return ctes + "\n" + "\nUNION ALL ".join(parts)


def outer(pair: Pair) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in pair.key)
    shown = [f"coalesce(a.{k}, b.{k}) AS {k}" for k in pair.key]
    shown += [f"a.{c} AS {c}__a, b.{c} AS {c}__b" for c in pair.values]
    first = pair.key[0]
    return f"""{duck_sides(pair)}
SELECT {', '.join(shown)},
       CASE WHEN b.{first} IS NULL THEN 'only_a' WHEN a.{first} IS NULL THEN 'only_b' ELSE 'both' END AS side
FROM a FULL OUTER JOIN b ON {on}"""


def repeated(pair: Pair) -> str:
    """Keys repeated on both sides."""
    keys = ", ".join(pair.key)
    return " INTERSECT ".join(f"SELECT {keys} FROM {x} GROUP BY {keys} HAVING count(*) > 1" for x in "ab")


def diff_rows_listed(pair: Pair) -> str:
    """Differing pairs of keys that are unique on one side at least."""
    keys = ", ".join(pair.key)
    return f"SELECT * FROM ({diff_rows(keyed(pair), pair.key, pair.values)}) WHERE ({keys}) NOT IN (SELECT * FROM ({duck_sides(pair)} {repeated(pair)}))"


def groups(pair: Pair, where: str) -> str:
    columns = ", ".join([*pair.key, *pair.values])
    return f"""SELECT {columns}, sum(in_a)::BIGINT AS rows_a, sum(in_b)::BIGINT AS rows_b
FROM (SELECT {columns}, 1 AS in_a, 0 AS in_b FROM a UNION ALL SELECT {columns}, 0, 1 FROM b)
WHERE ({', '.join(pair.key)}) IN ({where}) GROUP BY ALL"""


def diff_groups(pair: Pair) -> str:
    return f"{duck_sides(pair)}\n{groups(pair, repeated(pair))}"


def diff_rows_top_grouped(pair: Pair, limit: int, keys: int = 3) -> str:
    """The first differing rows from distinct rows and their numbers; the first keys have enough of them."""
    key = ", ".join(pair.key)
    on = " AND ".join(f"x.{k} = y.{k}" for k in pair.key)
    shown = [f"x.{k}" for k in pair.key] + [f"x.{c} AS {c}__a, y.{c} AS {c}__b" for c in pair.values]
    order = ", ".join([*pair.key, *(f"{c}__a" for c in pair.values), *(f"{c}__b" for c in pair.values)])
    columns = [*pair.key] + [x for c in pair.values for x in (f"{c}__a", f"{c}__b", f"{num_diff(f'{c}__a', f'{c}__b')} AS {c}__num_diff")]
    return f"""{duck_sides(pair)},
f AS (SELECT {key} FROM ({repeated(pair)}) ORDER BY ALL LIMIT {keys}),
g AS ({groups(pair, f'SELECT {key} FROM f')}),
j AS (SELECT {', '.join(shown)}, x.rows_a * y.rows_b AS n FROM g x JOIN g y ON {on} AND x.rows_a > 0 AND y.rows_b > 0),
d AS (SELECT *, sum(n) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) - n AS start FROM j WHERE {differs(pair.values)}),
e AS (SELECT *, unnest(range(least(n, {limit} - start)::BIGINT)) AS copy FROM d WHERE start < {limit})
SELECT {', '.join(columns)} FROM e"""


def listed(names: Sequence[str]) -> str:
    return "'" + (", ".join(names) or "—") + "'"


def pair_summary(pair: Pair, order: str | None = None) -> str:
    """One-row SELECT, complete with its CTEs."""
    columns_b = pair.columns_b or pair.columns
    only_a = [c for c in pair.columns if c not in columns_b]
    only_b = [c for c in columns_b if c not in pair.columns]
    values = pair.values
    flagged = " || ".join(
        f"CASE WHEN count(*) FILTER ({c}__a <> {c}__b) > 0 THEN '{c}, ' ELSE '' END" for c in values
    )
    if order is None:
        ctes = keyed(pair)
        one_sided = [f"(SELECT count(*) FROM ({missing(pair, x, y)}))" for x, y in ("ab", "ba")]
        keys = ", ".join(pair.key)
        dups = [f"(SELECT count(*) FROM (SELECT {keys} FROM {x} GROUP BY {keys} HAVING count(*) > 1))" for x in "ab"]
        heavy = f"(SELECT count(*) FROM ({repeated(pair)}))"
        key_used = f"'{keys}'"
    else:
        ctes = positional(pair, order)
        one_sided = [f"greatest((SELECT count(*) FROM {x}) - (SELECT count(*) FROM {y}), 0)" for x, y in ("ab", "ba")]
        dups, heavy = ["0", "0"], "0"
        key_used = "'(confronto posizionale)'"
    same_columns = not only_a and not only_b
    return f"""{ctes},
s AS (SELECT count(*) AS matched_rows, count(*) FILTER ({differs(values)}) AS rows_with_diff,
             coalesce(nullif(rtrim({flagged}, ', '), ''), '—') AS cols_with_diff,
             (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b,
             {one_sided[0]} AS rows_only_a, {one_sided[1]} AS rows_only_b,
             {dups[0]} AS dup_keys_a, {dups[1]} AS dup_keys_b FROM j)
SELECT '{pair.label}' AS label, '{pair.label}.a' AS name_a, '{pair.label}.b' AS name_b, rows_a, rows_b,
       rows_a - rows_b AS delta_rows, {listed(only_a)} AS cols_only_a, {listed(only_b)} AS cols_only_b,
       cols_with_diff, rows_with_diff,
       CASE WHEN {str(same_columns).upper()} AND rows_only_a = 0 AND rows_only_b = 0 AND rows_with_diff = 0
            THEN 'OK' ELSE 'DIFFERENZE' END AS outcome,
       {key_used} AS key_used, matched_rows, rows_only_a, rows_only_b,
       CAST(dup_keys_a AS BIGINT) AS dup_keys_a, CAST(dup_keys_b AS BIGINT) AS dup_keys_b,
       CAST({heavy} AS BIGINT) AS heavy_keys, '' AS row_filter, '' AS unfiltered, FALSE AS no_match_warning FROM s"""


# -- keys --------------------------------------------------------------------


def distinct(table: str, combo: Sequence[str]) -> str:
    columns = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in combo)
    return f"(SELECT count(*) FROM (SELECT DISTINCT {columns} FROM {table}))"


def uniqueness(columns: Sequence[str], sizes: Sequence[int]) -> str:
    """CTE ``scores``: every combination of the sizes, in order."""
    combos = [combo for size in sizes for combo in combinations(columns, size)]
    parts = [
        f"SELECT {i} AS ord, '{','.join(combo)}' AS columns, {distinct('a', combo)} AS distinct_a, {distinct('b', combo)} AS distinct_b"
        for i, combo in enumerate(combos)
    ]
    return f"""scores AS (SELECT *, (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b,
       (distinct_a / greatest((SELECT count(*) FROM a), 1) + distinct_b / greatest((SELECT count(*) FROM b), 1)) / 2 AS score
       FROM ({' UNION ALL '.join(parts)}))"""


def best_key(ctes: str, columns: Sequence[str], sizes: Sequence[int]) -> str:
    return f"""{ctes}, {uniqueness(columns, sizes)},
chosen AS (SELECT coalesce(min(ord) FILTER (score >= 0.999),
                  (SELECT min(ord) FROM scores WHERE score = (SELECT max(score) FROM scores))) AS ord FROM scores)
SELECT CASE WHEN score >= 0.5 THEN columns ELSE '' END AS key_columns FROM scores JOIN chosen USING (ord)"""


def first_unique(ctes: str, columns: Sequence[str], sizes: Sequence[int] = (1, 2)) -> str:
    return f"""{ctes}, {uniqueness(columns, sizes)}
SELECT columns AS key_columns FROM scores WHERE distinct_a = rows_a AND distinct_b = rows_b ORDER BY ord LIMIT 1"""


# -- structure ---------------------------------------------------------------


def types(table: str, columns: Sequence[str]) -> str:
    """SELECT position, column, type."""
    parts = []
    for i, c in enumerate(columns):
        v = f"CAST({c} AS VARCHAR)"
        dates = " OR ".join(
            f"count(*) FILTER (regexp_matches({v}, '{p}') AND try_strptime({v}, '{f}') IS NOT NULL)"
            f" + count(*) FILTER (trim({v}) = '') = count({c})"
            for p, f in DATES
        )
        parts.append(
            f"""SELECT {i + 1} AS position, '{c}' AS "column",
       CASE WHEN count({c}) = count(*) FILTER (trim({v}) = '') THEN 'VUOTO'
            WHEN count(*) FILTER (regexp_matches({v}, '{NUMBER}')) / count({c}) > 0.9
                 THEN CASE WHEN count(*) FILTER (contains({v}, '.')) > 0 THEN 'DECIMALE' ELSE 'INTERO' END
            WHEN {dates} THEN 'DATA' ELSE 'TESTO' END AS type FROM {table}"""
        )
    return "\nUNION ALL ".join(parts)


def structure(pair: Pair) -> str:
    a, b = types("a", pair.columns), types("b", pair.columns_b or pair.columns)
    return f"""{duck_sides(pair)}, ta AS ({a}), tb AS ({b})
SELECT coalesce(ta."column", tb."column") AS "column",
       CASE WHEN ta.position IS NULL THEN 'No' ELSE 'Si''' END AS in_a,
       CASE WHEN tb.position IS NULL THEN 'No' ELSE 'Si''' END AS in_b,
       ta.position AS pos_a, tb.position AS pos_b, coalesce(ta.type, '—') AS type_a, coalesce(tb.type, '—') AS type_b,
       CASE WHEN ta.type IS NULL OR tb.type IS NULL THEN '—' WHEN ta.type = tb.type THEN 'Si''' ELSE 'No' END AS type_consistent,
       CASE WHEN tb.type IS NULL THEN 'SOLO AS-IS' WHEN ta.type IS NULL THEN 'SOLO TO-BE' ELSE 'OK' END AS status
FROM ta FULL OUTER JOIN tb ON ta."column" = tb."column\""""
