"""Uniform shuffle of rows into shards of exact sizes.

The numbers of rows that each input partition sends to each shard are drawn first, as one random matrix with the given
row and column sums (the hypergeometric communication matrix of a uniform shuffle). Then every partition orders its rows
at random and deals them out by those numbers, the rows are exchanged, and every shard orders its rows at random again.
Shard sizes differ by one row at most, whatever the data.

The matrix is drawn by halving: the partitions of a node are split in two, and the places of each shard that go to the
first half are drawn shard after shard from the hypergeometric law, by a walk outward from its mode. One number per
partition and shard is all that this handles; rows are only touched by two windows over row numbers, whose groups
are an input partition and a bucket of about ``BUCKET_ROWS`` rows of a shard. All of it is SQL functions.

Defined results: null texts have no bytes; repeated rows are different rows; no row depends on a key, so no key is hot;
columns of ``docs`` named like an added one are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from twintally.llm.frames import numbered
from twintally.sources.staging import stage

BUCKET_ROWS = 100_000
PARTITION_BITS = 17
ROW = "__shard_row"
SPREAD_LEVEL = 6

# Natural logarithm of x!, by Stirling's series beyond 20.
LOG_FACTORIAL = """
    CASE WHEN {x} <= 20 THEN ln(factorial(CAST({x} AS INT)))
         ELSE {x} * ln({x}) - {x} + 0.5 * ln(2 * pi() * {x}) + 1D / (12D * {x}) - 1D / (360D * {x} * {x} * {x}) END"""


def log_factorial(x: str) -> str:
    return LOG_FACTORIAL.format(x=f"({x})")


def draw() -> str:
    """SQL for one hypergeometric number from a struct h: ``n`` of ``total`` places are taken, ``k`` of which are special.

    ``h.mode`` is where the walk begins; ``h.u`` is a uniform number. Probabilities are taken off it, one step to the
    right and one to the left in turn, until it is used up.
    """
    up = "a.pr * (h.k - a.r) * (h.n - a.r) / ((a.r + 1D) * (h.total - h.k - h.n + a.r + 1D))"
    down = "a.pl * a.l * (h.total - h.k - h.n + a.l) / ((h.k - a.l + 1D) * (h.n - a.l + 1D))"
    logs = [
        ("+", "h.k"), ("-", "h.mode"), ("-", "h.k - h.mode"), ("+", "h.total - h.k"), ("-", "h.n - h.mode"),
        ("-", "h.total - h.k - h.n + h.mode"), ("-", "h.total"), ("+", "h.n"), ("+", "h.total - h.n"),
    ]
    first = f"exp({' '.join(sign + log_factorial(x) for sign, x in logs)})"
    return f"""aggregate(
        sequence(0, CAST(12 * sqrt(1D * h.n * h.k / h.total * (1 - h.k / h.total) * (h.total - h.n) / greatest(h.total - 1, 1)) AS INT) + 16),
        CAST(NULL AS STRUCT<u: DOUBLE, x: BIGINT, l: BIGINT, r: BIGINT, pl: DOUBLE, pr: DOUBLE>),
        (b, i) -> transform(array(coalesce(b, named_struct('u', h.u, 'x', -1L, 'l', h.mode, 'r', h.mode, 'pl', {first}, 'pr', -1D))), a -> CASE
            WHEN a.x >= 0 THEN a
            WHEN a.pr < 0 THEN named_struct('u', a.u - a.pl, 'x', IF(a.u < a.pl, h.mode, -1L), 'l', a.l, 'r', a.r, 'pl', a.pl, 'pr', a.pl)
            ELSE transform(array(named_struct('up', {up}, 'down', {down})), p -> named_struct(
                'u', a.u - p.up - p.down,
                'x', CASE WHEN a.u < p.up THEN a.r + 1 WHEN a.u < p.up + p.down THEN a.l - 1 ELSE -1L END,
                'l', a.l - 1, 'r', a.r + 1, 'pl', p.down, 'pr', p.up))[0] END)[0],
        a -> IF(a.x < 0, h.mode, a.x))"""


def split_places(shards: int, seed: int) -> str:
    """SQL for the places of each shard (``caps``) that go to the first half of a node's partitions (``half`` rows)."""
    return f"""aggregate(
        sequence(1, {shards}),
        named_struct('taken', CAST(array() AS ARRAY<BIGINT>), 'total', aggregate(caps, 0L, (t, c) -> t + c), 'n', half),
        (a, s) -> transform(array(named_struct(
            'total', a.total, 'n', a.n, 'k', element_at(caps, s),
            'mode', least(least(a.n, element_at(caps, s)), greatest(greatest(0L, a.n + element_at(caps, s) - a.total),
                          CAST(floor((a.n + 1D) * (element_at(caps, s) + 1D) / (a.total + 2D)) AS BIGINT))),
            'u', pmod(xxhash64({seed}L, node, s), 4503599627370496L) / 4503599627370496D)),
            h -> transform(array(IF(h.total = 0, 0L, {draw()})), x ->
                named_struct('taken', concat(a.taken, array(x)), 'total', h.total - h.k, 'n', h.n - x))[0])[0],
        a -> a.taken)"""


def communication_matrix(counts: DataFrame, shards: int, seed: int, partitions: int) -> DataFrame:
    """For each partition of ``counts`` (part, n) how many rows go to each shard: (part, caps)."""
    total = F.expr("aggregate(parts, 0L, (t, p) -> t + p.n)")
    nodes = counts.agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts")).select(
        F.lit(1).cast("bigint").alias("node"),
        "parts",
        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(total / shards) + (s < total % shards).cast("bigint")).alias("caps"),
    )
    for level in range((partitions - 1).bit_length()):
        if level == SPREAD_LEVEL:
            nodes = nodes.repartition("node")
        nodes = nodes.withColumn("half", F.expr("aggregate(slice(parts, 1, CAST(size(parts) DIV 2 AS INT)), 0L, (t, p) -> t + p.n)"))
        nodes = nodes.withColumn("taken", F.expr(split_places(shards, seed)))
        child = F.expr(
            """explode(IF(size(parts) < 2, array(named_struct('node', node, 'parts', parts, 'caps', caps)), array(
                named_struct('node', 2 * node, 'parts', slice(parts, 1, CAST(size(parts) DIV 2 AS INT)), 'caps', taken),
                named_struct('node', 2 * node + 1, 'parts', slice(parts, CAST(size(parts) DIV 2 AS INT) + 1, size(parts)),
                             'caps', zip_with(caps, taken, (c, t) -> c - t)))))"""
        )
        nodes = nodes.select(child.alias("c")).select("c.*")
    return nodes.select(F.col("parts")[0]["part"].alias("part"), "caps")


def uniform(seed: int, *columns: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed).cast("bigint"), *columns), F.lit(1 << 40))


def shard(docs: DataFrame, shards: int, seed: int = 20, text_col: str = "text", of_files: bool = False) -> DataFrame:
    """``docs`` with ``size`` (bytes of the text plus 8), ``shard`` and ``slot``, its place there.

    ``of_files``: see ``numbered``. A partition is a run of 2 ** ``PARTITION_BITS`` row numbers, however the input is split.
    """
    docs = docs.drop("shard", "slot", "size")
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint") + 8
    rows = numbered(docs, ROW, of_files).withColumn("size", size)
    numbers = rows.select(F.col(ROW).alias("row"), F.shiftright(ROW, PARTITION_BITS).alias("part"))
    counts = stage(numbers.groupBy("part").agg(F.count("*").alias("n")), "shard-counts")
    total, partitions = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if not total:
        return docs.withColumns({"size": size, "shard": F.lit(0), "slot": F.lit(0).cast("bigint")}).limit(0)
    matrix = stage(communication_matrix(counts, shards, seed, partitions), "shard-matrix")

    place = F.row_number().over(W.partitionBy("part").orderBy(uniform(seed + 1, F.col("row")), "row"))
    bounds = F.expr("transform(caps, (c, s) -> aggregate(slice(caps, 1, s + 1), 0L, (t, x) -> t + x))")
    dealt = numbers.withColumn("place", place).join(matrix.select("part", bounds.alias("bounds")), "part")
    buckets = -(-total // (shards * BUCKET_ROWS))
    key = uniform(seed + 2, F.col("row"))
    dealt = dealt.select(
        "row",
        F.size(F.filter("bounds", lambda b: b < F.col("place"))).alias("shard"),
        key.alias("key"),
        F.floor(key / float(1 << 40) * buckets).cast("int").alias("bucket"),
    )
    dealt = stage(dealt, "shard-rows-dealt")
    sizes = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("shard", "bucket", before.alias("before"))
    again = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("key", "row"))
    placed = dealt.withColumn("again", again).join(offsets, ["shard", "bucket"])
    placed = placed.select(F.col("row").alias(ROW), "shard", (F.col("before") + F.col("again") - 1).alias("slot"))
    return rows.join(placed, ROW).drop(ROW)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its files in the order of the slots."""
    part = F.floor(F.col("slot") / BUCKET_ROWS)
    sharded.repartition("shard", part).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
