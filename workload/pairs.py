"""AS-IS / TO-BE pairs derived from the given tables.

Each pair is one SELECT per side in a dialect both engines read, after the three
replacements in ``spark_sql`` / ``duck_sql``. Every side takes all rows of its
tables; one-sided rows come from renumbered keys, not from dropped rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@dataclass(frozen=True)
class Pair:
    label: str
    key: tuple[str, ...]
    a: str
    b: str
    columns: tuple[str, ...]
    columns_b: tuple[str, ...] | None = None

    @property
    def values(self) -> list[str]:
        common = [c for c in self.columns if c in (self.columns_b or self.columns)]
        return [c for c in common if c not in self.key]


def money(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(18,2)) AS STRING)"


def day(x: str) -> str:
    return f"CAST(CAST({x} AS DATE) AS STRING)"


# Unique key, value noise and whitespace noise; renumbered keys on both sides.
ORDERS = Pair(
    "orders",
    ("o_orderkey",),
    f"""SELECT CAST(CASE WHEN o_orderkey % 101 = 0 THEN o_orderkey + 2000000000 ELSE o_orderkey END AS STRING) AS o_orderkey,
       CAST(o_custkey AS STRING) AS o_custkey, o_orderstatus, {money('o_totalprice')} AS o_totalprice,
       {day('o_orderdate')} AS o_orderdate, o_orderpriority
FROM orders""",
    f"""SELECT CAST(CASE WHEN o_orderkey % 103 = 0 THEN o_orderkey + 3000000000
                     WHEN o_orderkey % 211 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS STRING) AS o_orderkey,
       CAST(o_custkey AS STRING) AS o_custkey,
       CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       {money("CASE WHEN o_orderkey % 17 = 0 THEN o_totalprice + 1.5 ELSE o_totalprice END")} AS o_totalprice,
       CASE WHEN o_orderkey % 7 = 0 THEN concat('  ', {day('o_orderdate')}, chr(160))
            ELSE {day('o_orderdate')} END AS o_orderdate,
       replace(o_orderpriority, '-', CASE WHEN o_orderkey % 19 = 0 THEN '  ' ELSE '-' END) AS o_orderpriority
FROM orders""",
    ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
)

# Structure, type and decimal-comma differences.
CUSTOMER = Pair(
    "customer",
    ("c_custkey",),
    f"""SELECT CAST(c_custkey AS STRING) AS c_custkey, c_name, CAST(c_nationkey AS STRING) AS c_nationkey,
       {money('c_acctbal')} AS c_acctbal, c_mktsegment FROM customer""",
    f"""SELECT CAST(c_custkey AS STRING) AS c_custkey, CAST(c_nationkey AS STRING) AS c_nationkey,
       replace(c_name, 'Customer#', '#') AS c_name, replace({money('c_acctbal')}, '.', ',') AS c_acctbal,
       c_mktsegment AS c_segment, '' AS c_note FROM customer""",
    ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    ("c_custkey", "c_nationkey", "c_name", "c_acctbal", "c_segment", "c_note"),
)

# Duplicate keys: many to many.
LINEITEM = Pair(
    "lineitem",
    ("l_orderkey", "l_linenumber"),
    f"""SELECT CAST(CASE WHEN l_suppkey % 29 = 0 THEN l_orderkey + 2000000000 ELSE l_orderkey END AS STRING) AS l_orderkey,
       CAST(l_linenumber AS STRING) AS l_linenumber, {money('l_quantity')} AS l_quantity, l_returnflag
FROM lineitem""",
    f"""SELECT CAST(CASE WHEN l_suppkey % 31 = 0 THEN l_orderkey + 3000000000 ELSE l_orderkey END AS STRING) AS l_orderkey,
       CAST(l_linenumber AS STRING) AS l_linenumber,
       {money("CASE WHEN l_partkey % 11 = 0 THEN l_quantity + 1 ELSE l_quantity END")} AS l_quantity, l_returnflag
FROM lineitem""",
    ("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"),
)

# A few keys hold all rows: the key is the supplier, blank for two suppliers in five.
SUPPLIED = Pair(
    "supplied",
    ("l_suppkey",),
    f"""SELECT CASE WHEN l_suppkey % 5 < 2 THEN '' ELSE CAST(l_suppkey AS STRING) END AS l_suppkey,
       CAST(l_linenumber AS STRING) AS l_linenumber, {money('l_quantity')} AS l_quantity, l_returnflag
FROM lineitem""",
    f"""SELECT CASE WHEN l_suppkey % 5 < 2 THEN ' ' ELSE CAST(l_suppkey AS STRING) END AS l_suppkey,
       CAST(l_linenumber AS STRING) AS l_linenumber,
       {money("CASE WHEN l_partkey % 11 = 0 THEN l_quantity + 1 ELSE l_quantity END")} AS l_quantity, l_returnflag
FROM lineitem""",
    ("l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"),
)

# No key: rows are paired by position; trailer rows make b longer.
EVENTS = Pair(
    "events",
    (),
    """SELECT event_id, CAST(user_id AS STRING) AS user_id, event_type, props FROM events
UNION ALL SELECT 1000000000000 + r_regionkey, 'trailer', r_name, '' FROM region""",
    """SELECT event_id, CAST(user_id AS STRING) AS user_id,
       CASE WHEN event_id % 37 = 0 THEN upper(event_type) ELSE event_type END AS event_type, props FROM events
UNION ALL SELECT 1000000000000 + n_nationkey, 'trailer', n_name, '' FROM nation""",
    ("event_id", "user_id", "event_type", "props"),
)

# Equal sides.
NATION = Pair(
    "nation",
    ("n_nationkey",),
    "SELECT CAST(n_nationkey AS STRING) AS n_nationkey, n_name, CAST(n_regionkey AS STRING) AS n_regionkey FROM nation",
    "SELECT CAST(n_nationkey AS STRING) AS n_nationkey, n_name, CAST(n_regionkey AS STRING) AS n_regionkey FROM nation",
    ("n_nationkey", "n_name", "n_regionkey"),
)


_tables: dict[tuple[str, str], dict[str, DataFrame]] = {}


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views over the tables of one scale factor; files are looked up once."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _tables:
        _tables[known] = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}
    for name, df in _tables[known].items():
        df.createOrReplaceTempView(name)


def sides(spark: SparkSession, sf_dir: str, pair: Pair) -> tuple[DataFrame, DataFrame]:
    register(spark, sf_dir)
    return spark.sql(pair.a), spark.sql(pair.b)


def duck_sql(select: str) -> str:
    return select.replace(" AS STRING)", " AS VARCHAR)")


# The cleaning rule for the whitespace that occurs in the tables and pairs.
def duck_clean(x: str) -> str:
    blanks = "chr(32) || chr(9) || chr(160)"
    return (
        f"trim(regexp_replace(replace(trim(coalesce({x}, ''), {blanks}), chr(160), ' '), '[ \\t]+', ' ', 'g'))"
    )


def duck_sides(pair: Pair) -> str:
    """CTEs a and b with cleaned strings."""
    ctes = []
    for name, select, columns in (("a", pair.a, pair.columns), ("b", pair.b, pair.columns_b or pair.columns)):
        cleaned = ", ".join(f"{duck_clean(f'CAST({c} AS VARCHAR)')} AS {c}" for c in columns)
        ctes.append(f"{name}_raw AS ({duck_sql(select)})")
        ctes.append(f"{name} AS (SELECT {cleaned} FROM {name}_raw)")
    return "WITH " + ",\n".join(ctes)
