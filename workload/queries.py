"""Registered queries: the Spark side, and next to it the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twintally.functions.names import logical_name, short_name, stem_key
from twintally.functions.text import clean, col, num_diff
from twintally.operators import sniff
from twintally.operators.columns import prefix_chars
from twintally.operators.compare import KeyedComparison, PositionalComparison
from twintally.operators.filters import filter_rows, parse_row_filter
from twintally.operators.keys import detect_key, detect_key_strict, key_uniqueness
from twintally.operators.pairing import find_families, match_files, match_logical
from twintally.operators.structure import column_structure, infer_types
from twintally.plans import report
from twintally.plans.batch import run
from twintally.sources.delimited import read_delimited
from twintally.sources.staging import new_path, stage
from workload import sql
from workload.pairs import CUSTOMER, EVENTS, LINEITEM, NATION, ORDERS, SUPPLIED, Pair, duck_clean, duck_sides, money, register, sides

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TOP_ROWS = 1000
FIRST_LINES = 30


def add(name: str, query: Query, statement: str | None = None) -> None:
    QUERIES[name] = query
    if statement is not None:
        SQL[name] = statement


# -- comparison by key -------------------------------------------------------


def compared(pair: Pair, use: Callable[[KeyedComparison], DataFrame], **options) -> Query:
    return lambda spark, sf_dir: use(KeyedComparison(*sides(spark, sf_dir, pair), pair.key, **options))


def add_keyed(pair: Pair, suffix: str) -> None:
    ctes, key, values = sql.keyed(pair), pair.key, pair.values
    rows = sql.diff_rows(ctes, key, values)
    a, b = (f"{duck_sides(pair)} {sql.missing(pair, *xy)}" for xy in ("ab", "ba"))
    order = ", ".join([*key, *values])
    add(f"outer_status{suffix}", compared(pair, lambda c: c.outer(), expand=True), sql.outer(pair))
    add(f"diff_counts{suffix}", compared(pair, lambda c: c.counts()), sql.diff_counts(pair))
    add(f"column_summary{suffix}", compared(pair, lambda c: c.column_summary()), sql.column_summary(ctes, values))
    add(f"diff_rows{suffix}", compared(pair, lambda c: c.diff_rows(), expand=True), rows)
    add(f"diff_rows_top{suffix}", compared(pair, lambda c: c.diff_rows_top(TOP_ROWS)), sql.diff_rows(ctes, key, values, TOP_ROWS))
    add(f"diff_cells{suffix}", compared(pair, lambda c: c.diff_cells(), expand=True), sql.diff_cells(ctes, key, values))
    add(f"only_a{suffix}", compared(pair, lambda c: c.only_a()), a)
    add(f"only_b{suffix}", compared(pair, lambda c: c.only_b()), b)
    add(f"only_a_top{suffix}", compared(pair, lambda c: c.only_a_top(100)), f"{a} ORDER BY {order} LIMIT 100")
    add(f"pair_summary{suffix}", summary_of(pair), sql.pair_summary(pair))


def summary_of(pair: Pair) -> Query:
    return compared(pair, lambda c: report.pair_summary(c, pair.label, f"{pair.label}.a", f"{pair.label}.b"))


add_keyed(ORDERS, "")
add_keyed(LINEITEM, "_dup")
add("pair_summary_identical", summary_of(NATION), sql.pair_summary(NATION))
add("pair_summary_columns", summary_of(CUSTOMER), sql.pair_summary(CUSTOMER))

# Few keys hold all rows, one of them two fifths: pairs are counted, not formed.
add("diff_counts_hot", compared(SUPPLIED, lambda c: c.counts()), sql.diff_counts(SUPPLIED))
add(
    "column_summary_hot",
    compared(SUPPLIED, lambda c: c.column_summary()),
    sql.column_summary(sql.keyed(SUPPLIED), SUPPLIED.values),
)
add(
    "diff_groups_hot",
    compared(SUPPLIED, lambda c: c.diff_groups()),
    sql.diff_groups(SUPPLIED),
)
add("diff_rows_top_hot", compared(SUPPLIED, lambda c: c.diff_rows_top(TOP_ROWS)), sql.diff_rows_top_grouped(SUPPLIED, TOP_ROWS))

# What is listed of keys repeated on both sides, and of those that are not.
add("diff_rows_listed", compared(LINEITEM, lambda c: c.diff_rows()), sql.diff_rows_listed(LINEITEM))
add("diff_groups_dup", compared(LINEITEM, lambda c: c.diff_groups()), sql.diff_groups(LINEITEM))


def compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sides(spark, sf_dir, CUSTOMER)
    return KeyedComparison(a, b, CUSTOMER.key, keep_original=True).summary()


add(
    "compare_summary",
    compare_summary,
    f"""{sql.keyed(CUSTOMER)}
SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b, 1::BIGINT AS cols_only_a,
       2::BIGINT AS cols_only_b, 4::BIGINT AS cols_common,
       (SELECT count(*) FROM ({sql.missing(CUSTOMER, 'a', 'b')})) AS rows_only_a,
       (SELECT count(*) FROM ({sql.missing(CUSTOMER, 'b', 'a')})) AS rows_only_b,
       count(*) FILTER ({sql.differs(CUSTOMER.values)}) AS rows_diff, FALSE AS struct_ok FROM j""",
)


def num_diff_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = KeyedComparison(*sides(spark, sf_dir, CUSTOMER), CUSTOMER.key).pairs()
    difference = num_diff(col("c_acctbal__a"), col("c_acctbal__b"))
    return pairs.select("c_custkey", "c_acctbal__a", "c_acctbal__b", difference.alias("num_diff"))


add(
    "num_diff",
    num_diff_query,
    f"""{sql.keyed(CUSTOMER)}
SELECT c_custkey, c_acctbal__a, c_acctbal__b, {sql.num_diff('c_acctbal__a', 'c_acctbal__b')} AS num_diff FROM j""",
)

ROW_FILTER = "O_ORDERSTATUS = F"


def row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    filtered = [filter_rows(side, parse_row_filter(ROW_FILTER))[0] for side in sides(spark, sf_dir, ORDERS)]
    return KeyedComparison(*filtered, ORDERS.key).counts()


add(
    "row_filter",
    row_filter,
    sql.diff_counts(ORDERS).replace("FROM a_raw)", "FROM a_raw WHERE trim(o_orderstatus) = 'F')").replace(
        "FROM b_raw)", "FROM b_raw WHERE trim(o_orderstatus) = 'F')"
    ),
)

# -- comparison by position --------------------------------------------------


def positional(use: Callable[[PositionalComparison], DataFrame]) -> Query:
    return lambda spark, sf_dir: use(PositionalComparison(*sides(spark, sf_dir, EVENTS), ["event_id"]))


BY_POSITION = sql.positional(EVENTS, "event_id")
add("positional_diff", positional(lambda c: c.diff_rows()), sql.diff_rows(BY_POSITION, ["_pos"], EVENTS.columns))
add("positional_cells", positional(lambda c: c.diff_cells()), sql.diff_cells(BY_POSITION, ["_pos"], EVENTS.columns))
add(
    "positional_summary",
    positional(lambda c: c.column_summary()),
    sql.column_summary(BY_POSITION, EVENTS.columns, is_key="—"),
)
add(
    "positional_tail",
    positional(lambda c: c.only_b()),
    f"{BY_POSITION} SELECT b.* FROM b WHERE _pos > (SELECT count(*) FROM a)",
)

# -- cleaning ----------------------------------------------------------------


def clean_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, b = sides(spark, sf_dir, ORDERS)
    return b.select(*[clean(col(c)).alias(c) for c in b.columns])


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.table("documents").select("doc_id", clean(F.col("text")).alias("text"), clean(F.col("source")).alias("source"))


add("clean_strings", clean_strings, f"{duck_sides(ORDERS)} SELECT * FROM b")
add(
    "clean_documents",
    clean_documents,
    "SELECT doc_id, " + ", ".join(
        duck_clean(c).replace("chr(32) ||", "chr(32) || chr(10) || chr(13) ||") + f" AS {c}" for c in ("text", "source")
    ) + " FROM documents",
)


def strip_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The b side of the customer pair read as a delivery separated by ';#'."""
    _, b = sides(spark, sf_dir, CUSTOMER)
    chars = prefix_chars(b.columns, {}, 0, ";#")
    return b.select(*[F.ltrim(clean(col(c)), F.lit(chars)).alias(c) for c in b.columns])


add(
    "strip_prefix",
    strip_prefix,
    f"{duck_sides(CUSTOMER)} SELECT " + ", ".join(f"ltrim({c}, ';#') AS {c}" for c in CUSTOMER.columns_b) + " FROM b",
)

# -- keys --------------------------------------------------------------------


def uniqueness(pair: Pair, combos: Sequence[Sequence[str]]) -> Query:
    return lambda spark, sf_dir: key_uniqueness(*sides(spark, sf_dir, pair), combos)


LINEITEM_COMBOS = [c for n in range(1, 5) for c in sql.combinations(LINEITEM.columns, n)]
RAW_LINEITEM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice".split()
add(
    "key_uniqueness",
    uniqueness(LINEITEM, LINEITEM_COMBOS),
    f"{duck_sides(LINEITEM)}, {sql.uniqueness(LINEITEM.columns, (1, 2, 3, 4))} SELECT columns, distinct_a, distinct_b, rows_a, rows_b, score FROM scores",
)


def key_of(search: Callable[[DataFrame, DataFrame], list[str]], load: Callable) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = ",".join(search(*load(spark, sf_dir)))
        return spark.createDataFrame([(found,)], "key_columns string")

    return query


def pair_sides(pair: Pair):
    return lambda spark, sf_dir: sides(spark, sf_dir, pair)


def table_twice(name: str, columns: Sequence[str]):
    def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
        return df, df

    return load


def twice(name: str) -> str:
    return f"WITH a AS (SELECT * FROM {name}), b AS (SELECT * FROM {name})"


CONVERSATION = ["conv_id", "turn", "role", "text"]
add("detect_key", key_of(detect_key, pair_sides(ORDERS)), sql.best_key(duck_sides(ORDERS), ORDERS.columns, (1, 2)))
add("detect_key_dup", key_of(detect_key, pair_sides(LINEITEM)), sql.best_key(duck_sides(LINEITEM), LINEITEM.columns, (1, 2, 3, 4)))
add("detect_key_lineitem", key_of(detect_key, table_twice("lineitem", RAW_LINEITEM)), sql.best_key(twice("lineitem"), RAW_LINEITEM, (1, 2)))
add("detect_key_text", key_of(detect_key, table_twice("conversations", CONVERSATION)), sql.best_key(twice("conversations"), CONVERSATION, (1, 2)))
add("detect_key_strict", key_of(detect_key_strict, pair_sides(ORDERS)), sql.first_unique(duck_sides(ORDERS), ORDERS.columns))
add(
    "detect_key_strict_lineitem",
    key_of(detect_key_strict, table_twice("lineitem", RAW_LINEITEM)),
    f"""{sql.first_unique(twice("lineitem"), RAW_LINEITEM)}""".replace(
        "SELECT columns AS key_columns FROM scores WHERE distinct_a = rows_a AND distinct_b = rows_b ORDER BY ord LIMIT 1",
        "SELECT coalesce((SELECT columns FROM scores WHERE distinct_a = rows_a AND distinct_b = rows_b ORDER BY ord LIMIT 1), '') AS key_columns",
    ),
)

# -- structure ---------------------------------------------------------------


def types_of(pair: Pair, side: int) -> Query:
    return lambda spark, sf_dir: infer_types(sides(spark, sf_dir, pair)[side])


add("infer_types", types_of(CUSTOMER, 1), f"{duck_sides(CUSTOMER)} {sql.types('b_raw', CUSTOMER.columns_b)}")
add("infer_types_dates", types_of(ORDERS, 0), f"{duck_sides(ORDERS)} {sql.types('a_raw', ORDERS.columns)}")
add("column_structure", lambda spark, sf: column_structure(*sides(spark, sf, CUSTOMER)), sql.structure(CUSTOMER))
add("column_structure_dates", lambda spark, sf: column_structure(*(s.select(*[clean(col(c)).alias(c) for c in s.columns]) for s in sides(spark, sf, ORDERS))), sql.structure(ORDERS))

# -- names and pairing -------------------------------------------------------

SEGMENT = "replace(upper(c_mktsegment), ' ', '-')"
STAMP = "concat('2026', lpad(CAST(c_custkey AS STRING), 10, '0'))"
LISTING_A = f"""SELECT name, concat('/asis/', name) AS path FROM (
SELECT concat('DW.', CASE WHEN c_custkey % 2 = 0 THEN 'D' ELSE 'M' END, '.PLZ', lpad(CAST(c_nationkey AS STRING), 2, 'A'), '.T',
              CAST(c_custkey AS STRING), '-', {SEGMENT}, '.', {STAMP}, '.000L.', {STAMP}, '.csv') AS name FROM customer)"""
# Two customers share a table name, and some names occur on one side only.
LISTING_B = f"""SELECT name, concat('/tobe/', name) AS path FROM (
SELECT concat(CASE WHEN c_custkey % 7 = 0 THEN 'n' WHEN c_custkey % 3 = 0 THEN 'dw.d.plz3a.t' ELSE 'T' END,
              CAST(c_custkey - c_custkey % 2 AS STRING), '__', CASE WHEN c_custkey % 5 = 0 THEN lower({SEGMENT}) ELSE {SEGMENT} END,
              CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('.', {STAMP}) END, '.csv') AS name FROM customer)"""
LISTING_FAMILY = """SELECT concat('DW.M.PLZ', lpad(CAST(s_nationkey AS STRING), 2, 'A'), '.ALL',
       CASE WHEN s_suppkey % 3 = 0 THEN concat('.2026', lpad(CAST(s_suppkey AS STRING), 10, '0'), '.20260326030157') ELSE '' END,
       CASE WHEN s_suppkey % 4 = 0 THEN '.zip' ELSE '' END) AS name, s_suppkey % 4 = 0 AS is_zip FROM supplier"""


def listing(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(select)


def duck(select: str) -> str:
    return select.replace(" AS STRING)", " AS VARCHAR)")


def duck_stem(name: str) -> str:
    return f"regexp_replace({name}, '^(.+)\\.[^.]+$', '\\1')"


def duck_key(name: str) -> str:
    whole = f"upper({duck_stem(name)})"
    key = f"regexp_replace(regexp_replace({whole}, '\\b\\d{{14}}\\b', '', 'g'), '\\b\\d{{3}}L\\b', '', 'g')"
    key = f"trim(regexp_replace({key}, '[._-]+', '_', 'g'), '_')"
    key = f"regexp_replace(regexp_replace({key}, '^(DW_)?[DM]_PLZ\\w{{2}}_', ''), '^(DW_)?[DM]_', '')"
    return f"coalesce(nullif(trim({key}, '_'), ''), {whole})"


def duck_logical(name: str) -> str:
    return f"rtrim(regexp_replace({duck_stem(name)}, '\\.\\d{{14}}.*$', ''), '.')"


def duck_last(key: str, label: str, select: str) -> str:
    """Last file per key by path."""
    return f"""SELECT {label}, max(path) AS path, arg_max(name, path) AS name
FROM (SELECT {key} AS {label}, name, path FROM ({duck(select)})) GROUP BY {label}"""


add(
    "stem_key",
    lambda spark, sf: listing(spark, sf, LISTING_A).select("name", stem_key(F.col("name")).alias("stem_key")),
    f"SELECT name, {duck_key('name')} AS stem_key FROM ({duck(LISTING_A)})",
)
add(
    "logical_name",
    lambda spark, sf: listing(spark, sf, LISTING_A).select(
        "name", logical_name(F.col("name")).alias("logical_name"), short_name(logical_name(F.col("name"))).alias("short_name")
    ),
    f"""SELECT name, logical_name, string_split(logical_name, '.')[-1] AS short_name
FROM (SELECT name, {duck_logical('name')} AS logical_name FROM ({duck(LISTING_A)}))""",
)
for how, join in (("left", "LEFT"), ("full", "FULL")):
    add(
        f"match_files_{how}",
        lambda spark, sf, how=how: match_files(listing(spark, sf, LISTING_A), listing(spark, sf, LISTING_B), how),
        f"""WITH a AS (SELECT {duck_key('name')} AS label, name, path FROM ({duck(LISTING_A)})),
b AS ({duck_last(duck_key('name'), 'label', LISTING_B)})
SELECT coalesce(a.label, b.label) AS label, a.name AS name_a, a.path AS path_a, b.name AS name_b, b.path AS path_b
FROM a {join} JOIN b ON a.label = b.label""",
    )
add(
    "match_logical",
    lambda spark, sf: match_logical(listing(spark, sf, LISTING_A), listing(spark, sf, LISTING_B)),
    f"""WITH a AS ({duck_last(duck_logical('name'), 'logical_name', LISTING_A)}),
b AS ({duck_last(duck_logical('name'), 'logical_name', LISTING_B)})
SELECT coalesce(a.logical_name, b.logical_name) AS logical_name,
       string_split(coalesce(a.logical_name, b.logical_name), '.')[-1] AS short_name,
       a.name AS name_a, a.path AS path_a, b.name AS name_b, b.path AS path_b
FROM a FULL JOIN b ON a.logical_name = b.logical_name""",
)
add(
    "family_pairs",
    lambda spark, sf: find_families(listing(spark, sf, LISTING_FAMILY)),
    f"""WITH f AS (SELECT name, is_zip, rtrim(regexp_replace(regexp_replace(name, '\\.\\d{{14}}.*$', ''), '\\.zip$', ''), '.') AS family,
CASE WHEN regexp_matches(name, CASE WHEN is_zip THEN '\\.\\d{{14}}\\.\\d{{14}}\\.zip$' ELSE '\\.\\d{{14}}\\.\\d{{14}}$' END)
     THEN 'asis' ELSE 'tobe' END AS slot FROM ({duck(LISTING_FAMILY)}) WHERE contains(upper(name), 'PLZ'))
SELECT family,
       coalesce(max(name) FILTER (slot = 'asis' AND is_zip), max(name) FILTER (slot = 'asis')) AS asis,
       coalesce(max(name) FILTER (slot = 'tobe' AND is_zip), max(name) FILTER (slot = 'tobe')) AS tobe
FROM f GROUP BY family""",
)

# -- lines of untidy files ---------------------------------------------------

# One file per nation: a first line from the nation, the others from customers dealt
# out in turn. Some lines have a field too many, blanks, or the separator in quotes.
SEP_OF = "CASE file % 5 WHEN 0 THEN ';' WHEN 1 THEN '|' WHEN 2 THEN ',' WHEN 3 THEN ';|' ELSE ';#' END"
LINES = f"""SELECT CAST(file AS STRING) AS file, line_no, replace(v, '~', {SEP_OF}) AS value FROM (
SELECT n_nationkey AS file, CAST(1 AS BIGINT) AS line_no,
       CASE n_nationkey % 4 WHEN 0 THEN 'C_KEY~C_NAME~C_BALANCE~C_SEGMENT' WHEN 1 THEN 'key~name~balance~segment'
            WHEN 2 THEN concat(CAST(n_nationkey AS STRING), '~', n_name, '~0.00~No segment') ELSE '#KEY~#C_NAME~1~2' END AS v
FROM nation
UNION ALL
SELECT CAST(c_custkey % 25 AS INT), CAST(floor(c_custkey / 25) AS BIGINT) + 2,
       concat(CAST(c_custkey AS STRING), '~', CASE WHEN c_custkey % 23 = 0 THEN concat(' ', c_name, chr(160)) ELSE c_name END, '~',
              {money('c_acctbal')}, '~', CASE WHEN c_custkey % 41 = 0 THEN concat('"', c_mktsegment, '~x"') ELSE c_mktsegment END,
              CASE WHEN c_custkey % 37 = 0 THEN '~extra' WHEN c_custkey % 43 = 0 THEN '~ ' ELSE '' END)
FROM customer) AS t"""
STATIC_SEPARATORS = ", ".join(f"({i + 1}, {'chr(9)' if s == chr(9) else repr(s)})" for i, s in enumerate(sniff.SEPARATORS))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir, LINES)


def sniff_sql(first: int | None = None) -> str:
    where = f" AND line_no <= {first}" if first else ""
    count = "(length(value) - length(replace(value, sep, ''))) / length(sep)"
    return f"""WITH lines AS ({duck(LINES)}),
sniffed AS (SELECT * FROM lines WHERE trim(value) <> ''{where}),
follow AS (SELECT file, unnest(regexp_extract_all(value, ';([^\\pL\\pN; \\n\\r"''])', 1)) AS x FROM sniffed),
per_char AS (SELECT file, x, count(*) AS n_follow FROM follow GROUP BY ALL),
most AS (SELECT file, arg_max(x, (n_follow, x)) AS follower, max(n_follow) AS n_follow FROM per_char GROUP BY file),
totals AS (SELECT file, count(*) AS n_lines, sum(length(value) - length(replace(value, ';', '')))::BIGINT AS n_semicolon
           FROM sniffed GROUP BY file),
dynamic AS (SELECT file, follower, n_follow, n_semicolon, n_lines,
                   n_follow >= greatest(1, n_lines * 0.5) AND n_follow >= n_semicolon AS accepted
            FROM most JOIN totals USING (file)),
fixed(priority, sep) AS (VALUES {STATIC_SEPARATORS}),
cands AS (SELECT f.file, priority, sep FROM (SELECT DISTINCT file FROM lines) f, fixed
          UNION ALL SELECT file, 0, ';' || follower FROM dynamic
          WHERE accepted AND ';' || follower NOT IN (SELECT sep FROM fixed)),
counted AS (SELECT file, priority, sep, {count} AS n FROM sniffed JOIN cands USING (file)),
scores AS (SELECT file, priority, sep, avg(n) / (1 + coalesce(var_samp(n), 0)) AS score
           FROM counted GROUP BY ALL HAVING max(n) > 0),
seps AS (SELECT file, coalesce(arg_max(sep, (round(score, 9), -priority)), ';') AS sep
         FROM (SELECT DISTINCT file FROM lines) LEFT JOIN scores USING (file) GROUP BY file),
firsts AS (SELECT file, arg_min(value, line_no) AS value FROM lines WHERE trim(value) <> '' GROUP BY file),
named AS (SELECT file, list_filter([ltrim(trim(trim(trim(v), '"'), ''''), '£#;|,@~') FOR v IN string_split(value, sep)], lambda v: v <> '') AS names
          FROM firsts JOIN seps USING (file)),
likes AS (SELECT file, len(names) AS n, list_filter(names, lambda v: regexp_matches(v, '^[A-Za-z_][A-Za-z0-9_]*$')) AS ok FROM named),
headers AS (SELECT file, n = 0 OR (len(ok) / n >= 0.5 AND list_bool_or([contains(v, '_') FOR v IN ok])) OR len(ok) / n >= 0.75 AS has_header
            FROM likes)"""


SCORES = "SELECT file, priority, sep, round(score, 6) AS score FROM scores"


def separator_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = sniff.separator_scores(lines(spark, sf_dir), sample_lines=None)
    return scores.withColumn("score", F.round("score", 6)).withColumn("priority", F.col("priority").cast("int"))


add("sep_dynamic", lambda spark, sf: sniff.compound_separators(lines(spark, sf), None), f"{sniff_sql()} SELECT * FROM dynamic")
add("sep_score", separator_scores, f"{sniff_sql()} {SCORES}")
add("sep_detect", lambda spark, sf: sniff.detect_separators(lines(spark, sf), sample_lines=None), f"{sniff_sql()} SELECT * FROM seps")
# The default rule: the first thirty lines of a file decide.
add(
    "sep_detect_first_lines",
    lambda spark, sf: sniff.detect_separators(lines(spark, sf), sample_lines=FIRST_LINES),
    f"{sniff_sql(FIRST_LINES)} SELECT * FROM seps",
)


def header_detect(spark: SparkSession, sf_dir: str, legacy: bool = False) -> DataFrame:
    table = lines(spark, sf_dir)
    return sniff.detect_headers(table, sniff.detect_separators(table, sample_lines=None), legacy)


add("header_detect", header_detect, f"{sniff_sql()} SELECT * FROM headers")
add(
    "header_detect_legacy",
    lambda spark, sf: header_detect(spark, sf, legacy=True),
    f"""{sniff_sql()} SELECT file, len(names) > 0 AND len(list_filter(names, lambda v: regexp_matches(v, '^[A-Za-z_][A-Za-z0-9_\\s]*$')))
    >= greatest(1, len(names) * 0.5) AS has_header
FROM (SELECT file, list_filter([trim(v) FOR v IN string_split(value, ';')], lambda v: v <> '') AS names FROM firsts)""",
)


def bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = lines(spark, sf_dir)
    separators = sniff.detect_separators(table, sample_lines=None)
    widths = sniff.expected_widths(table, separators, sniff.detect_headers(table, separators))
    return sniff.bad_lines(table, separators, widths)


add(
    "bad_lines",
    bad_lines,
    f"""{sniff_sql()},
parts AS (SELECT file, line_no, value, string_split(regexp_replace(value, '"[^"]*"', 'q', 'g'), sep) AS p FROM lines JOIN seps USING (file)),
wide AS (SELECT file, CASE WHEN has_header THEN max(len(p)) ELSE arg_min(len(p), line_no) END AS expected
         FROM parts JOIN headers USING (file) WHERE line_no <= 2 GROUP BY file, has_header)
SELECT file, line_no, len(p)::INT AS n_fields, value FROM parts JOIN wide USING (file)
WHERE len(p) > expected AND len(list_filter(p[expected + 1:], lambda v: trim(v) <> '')) > 0""",
)
add(
    "whitespace_audit",
    lambda spark, sf: sniff.whitespace_audit(lines(spark, sf), sniff.detect_separators(lines(spark, sf), sample_lines=None)),
    f"""{sniff_sql()} SELECT file, sum(len(list_filter([trim(trim(v, '"'), '''') FOR v IN string_split(value, sep)],
    lambda v: v <> trim(v, ' ' || chr(9) || chr(160)) OR contains(v, chr(160)))))::BIGINT AS n_spaced
FROM lines JOIN seps USING (file) WHERE line_no > 1 GROUP BY file""",
)


def scan_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as part files separated by ';#' and read back as a delivery."""
    _, b = sides(spark, sf_dir, ORDERS)
    path = new_path(spark, "scan")
    b.select(F.concat_ws(";#", *b.columns).alias("value")).write.text(path)
    return read_delimited(spark, path).rows


add(
    "scan_delimited",
    scan_delimited,
    f"{duck_sides(ORDERS)} SELECT " + ", ".join(f"{c} AS Col_{i + 1}" for i, c in enumerate(ORDERS.columns)) + " FROM b",
)



def delivery(df: DataFrame, name: str, **options) -> str:
    """The path of ``df`` written as part files that each carry the header."""
    path = new_path(df.sparkSession, name)
    df.write.options(header=True, sep=";", **options).csv(path)
    return path


def scan_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in quotes, with columns that only a stray separator leaves behind."""
    found = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").cast("string").alias("C_KEY"), F.concat("c_name", F.lit('; "n"')).alias("C_NAME"), F.lit(" ").alias("#"), F.lit("x").alias("Unnamed: 3")
    )
    return read_delimited(spark, delivery(found, "headers", quoteAll=True, escape='"')).rows


add("scan_headers", scan_headers, """SELECT CAST(c_custkey AS VARCHAR) AS C_KEY, c_name || '; "n"' AS C_NAME FROM customer""")


def scan_cp1252(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in an encoding that is not UTF-8."""
    name = F.concat(F.col("c_name"), F.lit(" \u00e9\u00a3"))
    found = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("C_KEY"), name.alias("C_NAME"))
    return read_delimited(spark, delivery(found, "cp1252", encoding="ISO-8859-1")).rows


add("scan_cp1252", scan_cp1252, "SELECT CAST(c_custkey AS VARCHAR) AS C_KEY, c_name || ' \u00e9\u00a3' AS C_NAME FROM customer")


def scan_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as part files with line breaks, doubled quotes and separators inside quotes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select("doc_id", "lang", F.concat(F.lit('"'), "source", F.lit('"; ')).alias("SOURCE"), "text", F.lit("end").alias("last"))
    return read_delimited(spark, delivery(found, "quoted", quoteAll=True, escape='"'), sep=";").rows


TRIMMED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
add(
    "scan_quoted",
    scan_quoted,
    f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, '"' || source || '";' AS "SOURCE",
       {TRIMMED.format(f"regexp_replace(replace({TRIMMED.format('text')}, chr(160), ' '), '[ ' || chr(9) || ']+', ' ', 'g')")} AS text, 'end' AS last
FROM documents""",
)


def issue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with too many fields, whole: every 50th customer has two long fields more."""
    found = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("C_KEY"), F.col("c_name").alias("C_NAME"))
    more = F.when(F.col("C_KEY") % 50 == 7, F.concat(F.lit(";"), F.repeat("C_NAME", 100), F.lit(";z"))).otherwise("")
    path = new_path(spark, "lines")
    found.select(F.concat("C_KEY", F.lit(";"), "C_NAME", more).alias("value")).write.text(path)
    rejected = read_delimited(spark, path, header=False).rejected
    return report.issue_lines(rejected, "customer", report.SIDE_A, "customer.a").drop("line_no")


add(
    "issue_lines",
    issue_lines,
    """SELECT 'customer' AS label, 'AS-IS' AS side, 'customer.a' AS name,
       c_custkey || ';' || c_name || ';' || repeat(c_name, 100) || ';z' AS line FROM customer WHERE c_custkey % 50 = 7""",
)

# -- batch and issue log -----------------------------------------------------

BATCH = [ORDERS, CUSTOMER, LINEITEM, EVENTS, NATION]
SEPS = {"customer": (";", ";#")}
FAILED = ("broken", "broken.a", "broken.b", "unreadable")
_records: dict[tuple[str, str], DataFrame] = {}


def comparison_of(spark: SparkSession, sf_dir: str, pair: Pair):
    a, b = sides(spark, sf_dir, pair)
    return KeyedComparison(a, b, pair.key) if pair.key else PositionalComparison(a, b, ["event_id"])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue records of the five pairs and of one that failed, written once per session."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _records:
        parts = []
        for pair in BATCH:
            comparison = comparison_of(spark, sf_dir, pair).materialize()
            names = (pair.label, f"{pair.label}.a", f"{pair.label}.b")
            parts.append(report.issue_record(comparison, *names, SEPS.get(pair.label, (";", ";"))))
        parts.append(report.failed_record(spark, *FAILED))
        _records[known] = stage(report.union_records(parts), "issue-records")
    return _records[known]


def issue_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = records(spark, sf_dir)
    mismatches = F.transform("type_mismatches", lambda m: F.concat_ws(":", m["column"], m.type_a, m.type_b))
    return flat.select(
        *["label", "name_a", "name_b", "sep_a", "sep_b", "sep_ok", "rows_a", "rows_b"],
        F.array_join("cols_only_a", ",").alias("cols_only_a"),
        F.array_join("cols_only_b", ",").alias("cols_only_b"),
        F.array_join(mismatches, ",").alias("type_mismatches"),
        *["n_diff_rows", "n_only_a", "n_only_b", "error"],
    )


def record_sql(pair: Pair) -> str:
    columns_b = pair.columns_b or pair.columns
    only_a = ",".join(c for c in pair.columns if c not in columns_b)
    only_b = ",".join(c for c in columns_b if c not in pair.columns)
    sep_a, sep_b = SEPS.get(pair.label, (";", ";"))
    if pair.key:
        mismatches = f"""(SELECT coalesce(string_agg("column" || ':' || type_a || ':' || type_b, ',' ORDER BY pos_a), '')
            FROM ({sql.structure(pair)}) WHERE status = 'OK' AND type_consistent = 'No')"""
    else:
        mismatches = "''"
    return f"""SELECT label, name_a, name_b, '{sep_a}' AS sep_a, '{sep_b}' AS sep_b, {str(sep_a == sep_b).upper()} AS sep_ok,
       rows_a, rows_b, '{only_a}' AS cols_only_a, '{only_b}' AS cols_only_b, {mismatches} AS type_mismatches,
       rows_with_diff AS n_diff_rows, rows_only_a AS n_only_a, rows_only_b AS n_only_b, NULL AS error
FROM ({summary_sql(pair)})"""


def summary_sql(pair: Pair) -> str:
    return sql.pair_summary(pair) if pair.key else sql.pair_summary(pair, "event_id")


RECORDS = "WITH r AS (" + "\nUNION ALL ".join(map(record_sql, BATCH)) + f"""
UNION ALL SELECT '{FAILED[0]}', '{FAILED[1]}', '{FAILED[2]}', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '{FAILED[3]}')"""
HAS_ISSUE = "(NOT sep_ok OR cols_only_a <> '' OR cols_only_b <> '' OR n_diff_rows > 0 OR n_only_a > 0 OR n_only_b > 0)"


def names_in(column: str) -> str:
    return f"unnest(string_split({column}, ','))"


add("issue_records", issue_records, f"{RECORDS} SELECT * FROM r")
add(
    "issue_summary",
    lambda spark, sf: report.issue_summary(records(spark, sf)),
    f"""{RECORDS} SELECT label, name_a, name_b, sep_a, sep_b,
       CASE WHEN error IS NULL THEN CASE WHEN sep_ok THEN 'No' ELSE 'SI''' END END AS sep_differs,
       rows_a, rows_b, rows_a - rows_b AS delta_rows,
       CASE WHEN error IS NULL THEN len(list_filter(string_split(cols_only_a || ',' || cols_only_b, ','), lambda c: c <> ''))::BIGINT END
           AS n_missing_columns,
       n_diff_rows, n_only_a, n_only_b,
       CASE WHEN error IS NOT NULL THEN 'ERRORE: ' || error WHEN {HAS_ISSUE} THEN 'ANOMALIE' ELSE 'OK' END AS outcome FROM r""",
)
add(
    "issue_totals",
    lambda spark, sf: report.issue_totals(records(spark, sf)),
    f"{RECORDS} SELECT count(*) AS n_pairs, count(*) FILTER (error IS NULL AND {HAS_ISSUE}) AS n_with_issues FROM r",
)
add(
    "issue_separators",
    lambda spark, sf: report.issue_separators(records(spark, sf)),
    f"{RECORDS} SELECT label, name_a, name_b, sep_a, sep_b FROM r WHERE error IS NULL AND NOT sep_ok",
)
add(
    "issue_structure",
    lambda spark, sf: report.issue_structure(records(spark, sf)),
    f"""{RECORDS} SELECT label, {names_in('cols_only_a')} AS "column", 'SOLO AS-IS' AS issue FROM r WHERE error IS NULL AND cols_only_a <> ''
UNION ALL SELECT label, {names_in('cols_only_b')}, 'SOLO TO-BE' FROM r WHERE error IS NULL AND cols_only_b <> ''""",
)
add(
    "issue_types",
    lambda spark, sf: report.issue_types(records(spark, sf)),
    f"""{RECORDS} SELECT label, string_split(m, ':')[1] AS "column", string_split(m, ':')[2] AS type_a, string_split(m, ':')[3] AS type_b
FROM (SELECT label, {names_in('type_mismatches')} AS m FROM r WHERE error IS NULL AND type_mismatches <> '')""",
)


def one_file(header: str, lines: DataFrame, path: str) -> None:
    """A text file of exactly that path: the header, then the lines (at, value) in order."""
    spark, parts = lines.sparkSession, new_path(lines.sparkSession, "one-file")
    first = spark.range(1).select(F.lit(-1).cast("bigint").alias("at"), F.lit(header).alias("value"))
    first.unionByName(lines).coalesce(1).sortWithinPartitions("at").select("value").write.text(parts)
    jvm, configuration = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(configuration)
    files.mkdirs(target.getParent())
    part = next(s.getPath() for s in files.listStatus(jvm.org.apache.hadoop.fs.Path(parts)) if s.getPath().getName().startswith("part-"))
    if not files.rename(part, target):
        raise OSError(f"{path} can't be written")


def run_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a run over two folders: customers with ';' on one side and '|', blanks and long lines on the other; nations."""
    root = new_path(spark, "run")
    customers, nations = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("customer", "nation"))
    name = F.when(F.col("c_custkey") % 23 == 0, F.concat(F.lit(" "), "c_name", F.lit("\u00a0"))).otherwise(F.col("c_name"))
    segment = F.when(F.col("c_custkey") % 17 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    more = F.when(F.col("c_custkey") % 37 == 5, F.lit("|x|y")).otherwise("")
    for side, sep, values in (("old", ";", ["c_name", "c_mktsegment"]), ("new", "|", [name, F.concat(segment, more)])):
        lines = customers.select(F.col("c_custkey").alias("at"), F.concat_ws(sep, F.col("c_custkey").cast("string"), *values).alias("value"))
        one_file(sep.join(["C_KEY", "C_NAME", "C_SEGMENT"]), lines, f"{root}/{side}/CUSTOMER.csv")
        lines = nations.select(F.col("n_nationkey").cast("bigint").alias("at"), F.concat_ws(";", F.col("n_nationkey").cast("string"), "n_name").alias("value"))
        one_file("N_KEY;N_NAME", lines, f"{root}/{side}/NATION.csv")
    return run(spark, f"{root}/old", f"{root}/new", f"{root}/out")


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_of_files(spark, sf_dir).select(
        *["label", "name_a", "name_b", "sep_a", "sep_b", "rows_a", "rows_b", "n_diff_rows", "n_only_a", "n_only_b", "n_spaced_a", "n_spaced_b", "n_rejected_a", "n_rejected_b", "error"]
    )


add(
    "run_records",
    run_records,
    """SELECT 'CUSTOMER' AS label, 'CUSTOMER.csv' AS name_a, 'CUSTOMER.csv' AS name_b, ';' AS sep_a, '|' AS sep_b, count(*) AS rows_a,
       count(*) FILTER (c_custkey % 37 <> 5) AS rows_b, count(*) FILTER (c_custkey % 17 = 0 AND c_custkey % 37 <> 5) AS n_diff_rows,
       count(*) FILTER (c_custkey % 37 = 5) AS n_only_a, 0 AS n_only_b, 0 AS n_spaced_a, count(*) FILTER (c_custkey % 23 = 0) AS n_spaced_b,
       0 AS n_rejected_a, count(*) FILTER (c_custkey % 37 = 5) AS n_rejected_b, NULL AS error FROM customer
UNION ALL SELECT 'NATION', 'NATION.csv', 'NATION.csv', ';', ';', count(*), count(*), 0, 0, 0, 0, 0, 0, 0, NULL FROM nation""",
)
add(
    "issue_spaces",
    lambda spark, sf: report.issue_spaces(run_of_files(spark, sf)),
    "SELECT 'CUSTOMER' AS label, 'TO-BE' AS side, 'CUSTOMER.csv' AS name, count(*) FILTER (c_custkey % 23 = 0) AS n_spaced FROM customer",
)


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.union_records(
        [
            report.pair_summary(comparison_of(spark, sf_dir, pair), pair.label, f"{pair.label}.a", f"{pair.label}.b")
            for pair in BATCH
        ]
    )


add("batch_summary", batch_summary, "\nUNION ALL ".join(f"SELECT * FROM ({summary_sql(pair)})" for pair in BATCH))
