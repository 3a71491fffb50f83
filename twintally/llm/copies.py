"""N-gram Jaccard join of whole documents by grouped prefixes.

A document is the set of its word shingles. Two documents link when their Jaccard similarity is at least ``PERCENT``;
such sets share a shingle within their prefixes, the first n - ceil(0.75 n) + 1 shingles in one order of all shingles.
The order puts shingles that many documents have last. Their frequencies come from a count sketch of fixed size over the
whole table, which only affects speed: any order gives the same links.

1. Equal sets become one node. Nodes with equal prefix and size become one group.
2. An inverted index of the groups' prefixes keeps shingles that two groups or more share.
3. In each list the most popular group is the hub; the others are compared with it, which is linear. Verified links
   give first components, so that a large family of near copies falls together without all its pairs.
4. Pairs of groups that are not in one component yet are joined in the index. A pair is taken at its first common
   shingle only, and only if sizes and the overlap of the prefixes allow the similarity.
5. Group pairs are expand to members, whose whole sets are compared; components of all links name the classes.

Every pair of documents above the threshold is thus connected by verified links. Texts are read again only for documents
in candidate pairs. Shingles are compared by 64-bit hashes.

Defined results: null, empty and blank texts have no shingles and link with nothing; fewer than five words are one shingle;
repeated rows link; a null id takes part and is not a name of a class unless all its ids are null; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from twintally.llm.components import components
from twintally.llm.frames import numbered
from twintally.llm.shingles import shingle_sets
from twintally.llm.words import map_batches, mix, slices
from twintally.sources.staging import freeing, scratch, stage

PERCENT = 75
SKETCH_BITS = 20
CHUNK = 1 << 12
LOW = np.uint64((1 << 56) - 1)
#: At most so many rows of one to three numbers are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Longer lists of the index are joined with the prefixes at hand.
LONG_LIST = 32
#: Longer lists of the index are not dealt by shingle: what is summed over them is summed where they are read, and broadcast.
SUMMED_LIST = 1 << 10


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def place(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(56 - SKETCH_BITS) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def frequency_levels(texts: DataFrame) -> np.ndarray:
    """For each place of the sketch, the logarithm of how many shingles of all documents fall there.

    Tasks count their shingles, the counts are added up by place, and 2 ** SKETCH_BITS numbers go to the driver.
    """
    chunks = (1 << SKETCH_BITS) // CHUNK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                sets = shingle_sets(data, offsets)
                total += np.bincount(place(np.concatenate(sets)), minlength=len(total))
        if total.any():
            yield counted(dict(enumerate(total.reshape(chunks, CHUNK))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(part.as_buffer(), np.int64)
                sums[chunk] = sums[chunk] + values if chunk in sums else values
        yield counted(sums)

    def counted(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    parts = map_batches(texts, count, "chunk int, counts binary")
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    with freeing(texts.sparkSession):
        sums = map_batches(parts.repartition("chunk"), add, "chunk int, counts binary").collect()
    for chunk, part in sums:
        total[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(part, np.int64)
    return np.minimum(255, 4 * np.log2(total + 1)).astype(np.uint8)


def describe(rows: DataFrame, levels: np.ndarray, percent: int) -> DataFrame:
    """(row, id, n, s1, s2, gid, prefix): size and hash of the set, and its group; a task gives each prefix once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(2)):
                numbers, prefixes = np.zeros((4, b - a), np.int64), []
                for k, shingles in enumerate(shingle_sets(data, offsets)):
                    n = len(shingles)
                    order = np.sort(levels[place(shingles)].astype(np.uint64) << np.uint64(56) | shingles & LOW)
                    prefix = order[: prefix_length(n, percent)] if n else order
                    sums = mix(shingles).sum(), mix(shingles ^ LOW).sum(), mix(prefix).sum() + np.uint64(n)
                    numbers[0, k] = n
                    numbers[1:, k] = mix(np.array(sums, np.uint64)).view(np.int64)
                    gid = int(numbers[3, k])
                    prefixes.append(prefix.view(np.int64) if n and gid not in known else None)
                    known.add(gid)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array(x, pa.int64()) for x in numbers), pa.array(prefixes, pa.list_(pa.int64()))],
                    ["row", "id", "n", "s1", "s2", "gid", "prefix"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"row bigint, id {kind}, n bigint, s1 bigint, s2 bigint, gid bigint, prefix array<bigint>")


def small(table: DataFrame) -> DataFrame:
    """A written table of row or group numbers, to be broadcast if it is small enough; checked by its count."""
    return table if table.count() > BROADCAST_ROWS else F.broadcast(table)


def sets_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the rows in ``wanted`` (node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                sets = [x.view(np.int64) for x in shingle_sets(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    found = rows.join(small(wanted), F.col("row") == F.col("node"), "left_semi")
    return map_batches(found.select("row", "text"), run, "node bigint, shingles array<bigint>")


def verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough. Both sets of a pair meet in one shuffle."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = stage(pairs.select(F.explode(F.array("a", "b")).alias("node"), "a", "b"), "pair-ends")
    wanted = stage(ends.select("node").distinct(), "pair-nodes")
    sets = sets_of(rows, wanted).join(small(ends), "node").groupBy("a", "b").agg(F.collect_list("shingles").alias("sets"))
    x, y = F.col("sets")[0], F.col("sets")[1]
    both = F.size(F.array_intersect(x, y))
    return sets.where(100 * both >= percent * (F.size(x) + F.size(y) - both)).select("a", "b")


def large_enough(overlap, n, m, percent: int):
    """Whether sets of sizes n and m that share at most ``overlap`` can be similar enough."""
    return (100 + percent) * overlap >= percent * (n + m)


def often_level(levels: np.ndarray) -> int:
    """The level from which on a shingle may have a list longer than ``SUMMED_LIST``, and than those of most places."""
    usual = float((2.0 ** (levels / 4)).mean())
    return int(4 * np.log2(max(SUMMED_LIST, 16 * usual)))


def index_of(prefixes: DataFrame, levels: np.ndarray) -> DataFrame:
    """(gid, token, n_groups, other) of the shingles that two groups or more have in their prefixes.

    Only shingles of high levels can have long lists. Those are dealt by group and shingle, and counted in partial sums.
    """
    per_token = W.partitionBy("token")
    sums = {"n_groups": F.count("*"), "other": F.max("gid")}
    level = lambda token: F.shiftrightunsigned(token, 56) >= often_level(levels)
    lists = lambda rows: rows.select("gid", F.explode("prefix").alias("token"))
    # A prefix has its shingles by level.
    often = lists(prefixes.where(level(F.element_at("prefix", -1)))).where(level(F.col("token")))
    often = stage(often.distinct(), "frequent-shingles")
    long = often.groupBy("token").agg(*(x.alias(k) for k, x in sums.items())).where(F.col("n_groups") > SUMMED_LIST)
    long = small(stage(long, "long-list-sums"))
    rest = lists(prefixes).where(~level(F.col("token"))).unionByName(often.join(long, "token", "left_anti"))
    rest = rest.repartition("token").distinct().withColumns({k: x.over(per_token) for k, x in sums.items()})
    # The pair of a list of two is one row.
    rest = rest.where("n_groups > 2 OR (n_groups = 2 AND gid <> other)")
    return rest.unionByName(often.join(long, "token"))


def with_sums(entries: DataFrame, **sums: Column) -> DataFrame:
    """Entries of the index (token, n_groups, ...) with sums over all entries of their token."""
    long = entries.where(F.col("n_groups") > SUMMED_LIST)
    of_long = stage(long.groupBy("token").agg(*(x.alias(k) for k, x in sums.items())), "long-list-sums")
    rest = entries.where(F.col("n_groups") <= SUMMED_LIST)
    return rest.withColumns({k: x.over(W.partitionBy("token")) for k, x in sums.items()}).unionByName(long.join(small(of_long), "token"))


def close_groups(shared: DataFrame, placed: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs (g, h) of groups that are not all in one component and whose prefixes allow the similarity.

    Pairs from short lists are counted first; those with enough are then compared by their prefixes. The entries of long
    lists carry their prefixes, so that a pair of a large family is compared within the join, at the first such list.
    """
    spans = stage(placed.groupBy("gid").agg(F.min("n").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")), "spans")
    entries = with_sums(shared.where("n_groups > 2").drop("other").join(spans, "gid"), least=F.min("low"), most=F.max("high"))
    entries = stage(entries.where("least <> most").drop("least", "most"), "open-lists")

    def prefixes_of(gids: DataFrame) -> DataFrame:
        gids = stage(gids.distinct(), "wanted-groups")
        return prefixes.join(small(gids), "gid", "left_semi").groupBy("gid").agg(F.first("prefix").alias("prefix"))

    x, y, n, m = F.col("x"), F.col("y"), F.col("x.n"), F.col("y.n")
    both = F.array_intersect("x.prefix", "y.prefix")
    last = F.element_at(both, -1)
    overlap = F.size(both) + F.least(n - F.array_position("x.prefix", last), m - F.array_position("y.prefix", last))
    apart = (x["low"] != y["low"]) | (x["high"] != y["high"]) | (x["low"] != x["high"])
    able = (F.col("x.gid") < F.col("y.gid")) & apart & large_enough(F.least(n, m), n, m, percent)

    # Pairs of short lists with the number of shingles they share there. With those they may share in long lists, and
    # all beyond the prefix that ends first, these must be enough.
    one = F.struct("gid", "n", "low", "high")
    twos = shared.where("n_groups = 2").groupBy(F.col("gid").alias("g"), F.col("other").alias("h")).agg(F.count("*").alias("common"))
    short = entries.where(F.col("n_groups") <= LONG_LIST).select("token", one.alias("x"))
    others = short.join(short.withColumnRenamed("x", "y"), "token").where(able)
    others = others.groupBy(F.col("x.gid").alias("g"), F.col("y.gid").alias("h")).agg(F.count("*").alias("common"))
    pairs = twos.unionByName(others).groupBy("g", "h").agg(F.sum("common").alias("common"))
    in_long = entries.where(F.col("n_groups") > LONG_LIST).groupBy("gid").agg(F.count("*").alias("in_long"))
    sides = spans.join(in_long, "gid", "left").select("gid", "n", "low", "high", F.coalesce("in_long", F.lit(0)).alias("in_long"))
    sides = stage(sides, "sides")
    for name, side in (("g", "x"), ("h", "y")):
        pairs = pairs.join(sides.select(F.col("gid").alias(name), F.struct("gid", "n", "low", "high", "in_long").alias(side)), name)
    beyond = [F.floor((percent * size + 99) / 100) - 1 for size in (n, m)]
    most = F.col("common") + F.least("x.in_long", "y.in_long") + F.greatest(*beyond)
    pairs = pairs.where(able & large_enough(most, n, m, percent)).select("g", "h", n.alias("n"), m.alias("m"))
    pairs = stage(pairs, "short-list-pairs")
    wanted = stage(prefixes_of(pairs.select(F.explode(F.array("g", "h")).alias("gid"))), "short-list-prefixes")
    pairs = pairs.join(wanted.select(F.col("gid").alias("g"), F.struct("prefix").alias("p")), "g").join(wanted.select(F.col("gid").alias("h"), F.struct("prefix").alias("q")), "h")
    pairs = pairs.select("g", "h", F.struct("n", "p.prefix").alias("x"), F.struct(F.col("m").alias("n"), "q.prefix").alias("y"))
    pairs = pairs.where(large_enough(overlap, n, m, percent)).select("g", "h")

    long = entries.where(F.col("n_groups") > LONG_LIST)
    tokens = long.groupBy("gid").agg(F.collect_set("token").alias("tokens"))
    carried = tokens.join(prefixes_of(long.select("gid")), "gid").withColumn("long", F.array_intersect("prefix", "tokens")).drop("tokens")
    carried = stage(long.join(carried, "gid").select("token", F.struct("gid", "n", "low", "high", "prefix", "long").alias("x")), "long-lists")
    at_first = F.element_at(F.array_intersect("x.long", "y.long"), 1) == F.col("token")
    more = carried.join(carried.withColumnRenamed("x", "y"), "token").where(able & at_first & large_enough(overlap, n, m, percent))
    return pairs.unionByName(more.select(F.col("x.gid").alias("g"), F.col("y.gid").alias("h"))).distinct()


def classes(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", of_files: bool = False, row_col: str | None = None) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (the least id of its class), and ``row`` and ``node``.

    ``node`` names the class by one of its rows, ``row`` the row itself: exactly one row of each class has them equal.
    ``of_files``: see ``numbered``. ``row_col``: a column of such numbers that ``docs`` has already.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *([F.col(row_col).alias("row")] if row_col else []))
    rows = (rows if row_col else numbered(rows, "row", of_files)).select("row", "id", "text")
    with scratch(docs.sparkSession):
        levels = frequency_levels(rows.select("text"))
        described = stage(describe(rows, levels, percent), "described", keep=True)
        nodes = described.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("row").alias("node"), F.min("id").alias("least_id"), F.min("gid").alias("gid"))
        nodes = stage(nodes, "nodes")
        prefixes = described.where("prefix IS NOT NULL")

        shared = stage(index_of(prefixes, levels), "shared")
        sizes = nodes.groupBy("gid").agg(F.min("n").alias("n"))
        longer = shared.where("n_groups > 2").drop("other")
        popular = stage(longer.groupBy("gid").agg(F.sum("n_groups").alias("popular")), "popular")
        ranked = with_sums(longer.join(popular, "gid"), hub=F.max(F.struct("popular", "gid")))
        stars = ranked.where("gid <> hub.gid").select(F.col("hub.gid").alias("g"), F.col("gid").alias("h"))
        stars = stars.unionByName(shared.where("n_groups = 2").select(F.col("gid").alias("g"), F.col("other").alias("h")))
        stars = stars.groupBy("g", "h").agg(F.count("*").alias("common"))
        stars = stars.join(sizes.withColumnRenamed("gid", "g"), "g").join(sizes.select(F.col("gid").alias("h"), F.col("n").alias("m")), "h")
        # Which pairs are tried first is free. Similar sets have most of their prefixes in common; of these, a third will do.
        stars = stars.where(large_enough(F.least("n", "m"), F.col("n"), F.col("m"), percent) & (3 * F.col("common") >= (1 - percent / 100) * F.least("n", "m")))
        first = nodes.groupBy("gid").agg(F.min("node").alias("a"))
        members = nodes.select("gid", F.col("node").alias("b"))
        tried = stars.select(F.col("g").alias("gid"), "h").join(first, "gid").select("a", F.col("h").alias("gid")).unionByName(first.select("a", "gid"))
        links = stage(verified(tried.join(members, "gid").select("a", "b"), rows, percent), "links-of-hubs")
        named = stage(components(links, rounds=4), "first-components")

        placed = nodes.join(named, "node", "left").select("gid", "n", "node", F.coalesce("component", "node").alias("component"))
        placed = stage(placed, "placed")
        close = stage(close_groups(shared, placed, prefixes, percent), "close-groups")
        several = placed.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select(F.col("gid").alias("g"), F.col("gid").alias("h"))
        left = placed.select(F.col("gid").alias("g"), F.col("node").alias("a"), F.col("component").alias("c"))
        right = placed.select(F.col("gid").alias("h"), F.col("node").alias("b"), F.col("component").alias("d"))
        rest = close.unionByName(several).join(left, "g").join(right, "h").where("c <> d")
        more = stage(verified(rest.select("a", "b"), rows, percent), "links-of-the-rest")
        named = components(links.unionByName(more))
        named = nodes.join(named, "node", "left").withColumn("class", F.coalesce("component", "node"))
        named = stage(named.select("n", "s1", "s2", "class", "least_id"), "classes", keep=True)
    least = named.groupBy("class").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "class").select("n", "s1", "s2", "class", "component_id")
    out = described.where("n > 0").select("row", "id", "n", "s1", "s2").join(named, ["n", "s1", "s2"]).select("row", "id", "n", "component_id", "class")
    alone = described.where("n = 0").select("row", "id", "n", F.col("id").alias("component_id"), F.col("row").alias("class"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "row", F.col("class").alias("node"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", of_files: bool = False) -> DataFrame:
    """``docs`` without all but one row of each class: its first row stays. ``of_files``: see ``numbered``."""
    name = "__copy_row"
    rows = numbered(docs, name, of_files)
    with scratch(docs.sparkSession):
        gone = classes(rows, percent, id_col, text_col, row_col=name).where("row <> node").select(F.col("row").alias(name))
        gone = stage(gone, "copies", keep=True)
    return rows.join(small(gone), name, "left_anti").select(*docs.columns)
