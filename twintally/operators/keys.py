"""Search for the columns that identify a row.

Counts of distinct tuples are exact. Disk is bounded by the way they are taken, not by taking fewer:

* Values are written once, compressed, and removed with the search.
* Combinations that have a column in common which nearly tells rows apart share one shuffle by that column, and their
  tuples meet within its tasks. Its few popular values, and combinations with few tuples, are summed where they are read.
* What one shuffle would hold beyond ``PASS_ROWS`` is dealt to passes by hash, and each pass's shuffle goes with it.
* A tuple that occurs twice shows that its combination is no strict key, so a slice of all tuples rules most of
  them out; one that has no double there is counted in full.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import combinations, islice
from math import prod
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintally.functions.text import col
from twintally.operators.compare import column_sets
from twintally.sources.staging import freeing, scratch, stage

# Sizes and scores that decide on a key.
MAX_KEY_COLUMNS = 4
UNIQUE_ENOUGH = 0.999
TOO_AMBIGUOUS = 0.5

# Combinations counted in one job; every row becomes that many short rows. The
# first jobs of a search are small, since an early combination often ends it.
FIRST_COMBINATIONS = 2
COMBINATIONS_PER_JOB = 16


# Short rows, of about 25 bytes, that a shuffle holds at once; more are dealt to
# passes, of which there are so many at most, as each reads the values again.
PASS_ROWS = 1 << 26
MOST_PASSES = 8
# Short rows of the slice in which doubles are looked for.
SLICE_ROWS = 1 << 22
# Rows that a task may read before it writes a shuffle, and tuples in a task after it.
TASK_ROWS = 1 << 20
TASK_TUPLES = 1 << 22
# A column's values are told by so many buckets. One that has more than a share of
# 1 / POPULAR of all rows has a popular value, which must not meet in one task.
BUCKETS = 4096
POPULAR = 1024


def _hash(values: Sequence[Column], salt: int) -> Column:
    return F.xxhash64(F.lit(salt), *values)


def tagged_sides(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both sides in one table: whether the row is of ``b``, and the values of ``columns`` as strings ``c0``, ``c1``, ..."""
    sides = [
        df.select(F.lit(k).cast("tinyint").alias("side"), *[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
        for k, df in enumerate((a, b))
    ]
    return sides[0].unionByName(sides[1])


def _hashed(values: DataFrame, places: Iterable[int], keep: Sequence[str] = ()) -> DataFrame:
    """Two 64-bit hashes for each value, null where the value is null. Tuples are told apart by 128 bits."""
    shown = []
    for i in places:
        value = F.col(f"c{i}")
        shown.append(F.when(value.isNotNull(), F.struct(*[_hash([value], salt).alias(f"h{salt}") for salt in (1, 2)])).alias(f"c{i}"))
    return values.select("side", *keep, *shown)


def _tuple_hash(places: Sequence[int], skip_null: bool, salt: int) -> Column:
    parts = []
    for i in places:
        own = F.col(f"c{i}.h{salt}")
        parts.append(own if skip_null else F.coalesce(own, _hash([F.lit("")], salt)))
    whole = parts[0] if len(parts) == 1 else _hash(parts, salt)
    # The hash of several columns passes over nulls.
    return whole if not skip_null else F.when(reduce(and_, [p.isNotNull() for p in parts]), whole)


Combo = tuple[int, ...]


def _short_rows(hashed: DataFrame, combos: Sequence[Combo], skip_null: bool, keep: Sequence[str] = ()) -> DataFrame:
    """(slot, h1, h2) for every row and combination; the slot is twice the combination's place, and one more on side b."""
    tuples = F.array(
        *[
            F.struct((F.lit(2 * k) + F.col("side")).alias("slot"), *[_tuple_hash(combo, skip_null, salt).alias(f"h{salt}") for salt in (1, 2)])
            for k, combo in enumerate(combos)
        ]
    )
    return hashed.select(*keep, F.inline(tuples)).where("h1 IS NOT NULL")


def _tuples(values: DataFrame, combos: Sequence[Combo], skip_null: bool = False, passes: int = 1, which: int = 0) -> dict[int, tuple[int, int]]:
    """For each slot the number of distinct tuples and how often the most frequent one occurs, of those that fall in a pass."""
    places = sorted({i for combo in combos for i in combo})
    with freeing(values.sparkSession):
        rows = _short_rows(_hashed(values, places), combos, skip_null)
        if passes > 1:
            rows = rows.where(F.pmod("h1", F.lit(passes)) == which)
        counted = rows.groupBy("slot", "h1", "h2").agg(F.count("*").alias("n"))
        return {r["slot"]: (r["n_tuples"], r["most"]) for r in counted.groupBy("slot").agg(F.count("*").alias("n_tuples"), F.max("n").alias("most")).collect()}


def _passes(rows: float) -> int:
    return min(MOST_PASSES, max(1, int(-(-rows // PASS_ROWS))))


def _shared(values: DataFrame, combos: Sequence[Combo], anchor: int, skip_null: bool, rows: int, weight: float) -> dict[int, int]:
    """Distinct tuples of combinations that all have the column ``anchor``, for each slot.

    Rows are dealt by that column, so that equal tuples of any combination meet in a task; those of popular values aren't.
    """
    at = _hash([F.coalesce(F.col(f"c{anchor}"), F.lit(""))], 1)
    bucket = F.pmod(at, F.lit(BUCKETS))
    found: dict[int, int] = defaultdict(int)
    with freeing(values.sparkSession):
        sizes = {r["bucket"]: r["count"] for r in values.groupBy(bucket.alias("bucket")).count().collect()}
    popular = [k for k, n in sizes.items() if n * POPULAR > rows]
    of_popular = sum(sizes[k] for k in popular)
    if popular:
        own = values.where(bucket.isin(popular))
        for slot, n in _summed(own, combos, skip_null, _passes(of_popular * len(combos))).items():
            found[slot] += n
        values = values.where(~bucket.isin(popular))
    passes = _passes((rows - of_popular) * weight)
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, (rows - of_popular) * len(combos) // (passes * TASK_TUPLES))
    places = sorted({i for combo in combos for i in combo})
    for k in range(passes if of_popular < rows else 0):
        with freeing(values.sparkSession):
            own = values.where(bucket % passes == k) if passes > 1 else values
            dealt = _hashed(own.withColumn("at", at), places, ["at"]).repartition(tasks, "at")
            tuples = _short_rows(dealt, combos, skip_null, ["at"]).select("at", "slot", "h1", "h2").distinct()
            for r in tuples.groupBy("slot").count().collect():
                found[r["slot"]] += r["count"]
    return found


def _summed(values: DataFrame, combos: Sequence[Combo], skip_null: bool, passes: int) -> dict[int, int]:
    """Distinct tuples for each slot; equal ones are dropped before and after a shuffle of all combinations."""
    found: dict[int, int] = defaultdict(int)
    for k in range(passes):
        for slot, (n, _) in _tuples(values, combos, skip_null, passes, k).items():
            found[slot] += n
    return found


def _counts(values: DataFrame, combos: Sequence[Combo], rows: int, skip_null: bool = False, several: Sequence[int] | None = None) -> list[tuple[int, int]]:
    """Distinct tuples on both sides for each combination. ``several``: about how many values each column has, which only affects speed."""
    counts: dict[int, int] = defaultdict(int)

    def add(found: dict[int, int], places: Sequence[int]) -> None:
        for slot, n in found.items():
            counts[2 * places[slot // 2] + slot % 2] += n

    if several is None or rows * len(combos) <= PASS_ROWS:
        add(_summed(values, combos, skip_null, 1), range(len(combos)))
    else:
        # Short rows that leave the tasks which read them, and those of a shuffle by a column, for which a column of few values hardly counts.
        left = lambda combo: rows * min(1, prod(several[i] for i in combo) / TASK_ROWS)
        families: dict[int, list[int]] = defaultdict(list)
        for k, combo in enumerate(combos):
            families[max(combo, key=lambda i: several[i])].append(k)
        rest = []
        for anchor, own in families.items():
            weight = sum(1 if several[i] > TASK_ROWS >> 4 else 0.25 for i in {i for k in own for i in combos[k]})
            if sum(left(combos[k]) for k in own) > rows * weight:
                add(_shared(values, [combos[k] for k in own], anchor, skip_null, rows, weight), own)
            else:
                rest += own
        if rest:
            own = [combos[k] for k in rest]
            add(_summed(values, own, skip_null, _passes(sum(map(left, own)))), rest)
    return [(counts[2 * k], counts[2 * k + 1]) for k in range(len(combos))]


def _several(values: DataFrame) -> list[int]:
    return list(values.agg(*[F.approx_count_distinct(c) for c in values.columns if c != "side"]).first())


def distinct_counts(a: DataFrame, b: DataFrame, combos: Sequence[Sequence[str]], skip_null: bool = False) -> DataFrame:
    """Number of distinct value tuples per combination and side: (combo, distinct_a, distinct_b).

    With ``skip_null`` a tuple with a null is not counted; else null counts as ''.
    """
    columns = list(dict.fromkeys(c for combo in combos for c in combo))
    places = [tuple(columns.index(c) for c in combo) for combo in combos]
    with freeing(a.sparkSession):
        rows, several = a.count() + b.count(), None
    values = tagged_sides(a, b, columns)
    with scratch(a.sparkSession):
        if rows * len(combos) > PASS_ROWS:
            values = stage(values, "key-columns", compression="zstd")
            several = _several(values)
        counts = _counts(values, places, rows, skip_null, several) if rows else []
    found = [(k, *n) for k, n in enumerate(counts) if any(n)]
    return a.sparkSession.createDataFrame(found, "combo int, distinct_a bigint, distinct_b bigint")


def _growing(combos: Iterable[tuple[str, ...]], start: int = FIRST_COMBINATIONS) -> Iterator[list[tuple[str, ...]]]:
    """Slices of 2, 4, 8, ... combinations up to the number per job, taken as they come."""
    waiting, size = iter(combos), start
    while batch := list(islice(waiting, size)):
        yield batch
        size = min(size * 2, COMBINATIONS_PER_JOB)


def key_uniqueness(a: DataFrame, b: DataFrame, combos: Sequence[Sequence[str]]) -> DataFrame:
    """Uniqueness of column combinations: distinct share per side and their mean."""
    with freeing(a.sparkSession):
        rows_a, rows_b = a.count(), b.count()
    names = F.element_at(F.array(*[F.lit(",".join(c)) for c in combos]), F.col("combo") + 1)
    shares = [F.col(f"distinct_{s}") / F.lit(max(n, 1)) for s, n in (("a", rows_a), ("b", rows_b))]
    return distinct_counts(a, b, combos).select(
        names.alias("columns"),
        "distinct_a",
        "distinct_b",
        F.lit(rows_a).cast("bigint").alias("rows_a"),
        F.lit(rows_b).cast("bigint").alias("rows_b"),
        ((shares[0] + shares[1]) / 2).alias("score"),
    )


class _Counter:
    """Distinct counts of combinations met so far, and bounds they imply for others. Use it within a block of ``scratch``."""

    def __init__(self, a: DataFrame, b: DataFrame, columns: Sequence[str]):
        self.columns = list(columns)
        # Read once; every job of the search reads only the columns it counts.
        self.values = stage(tagged_sides(a, b, columns), "key-columns", compression="zstd")
        filled = [F.count(f"c{i}").alias(f"c{i}") for i in range(len(self.columns))]
        sizes = {r["side"]: r for r in self.values.groupBy("side").agg(F.count("*").alias("n"), *filled).collect()}
        self.rows = tuple(sizes[side]["n"] if side in sizes else 0 for side in (0, 1))
        self.with_null = {c for i, c in enumerate(self.columns) if any(r[f"c{i}"] < r["n"] for r in sizes.values())}
        self.known: dict[tuple[str, ...], tuple[int, int]] = {}
        self.several: list[int] | None = None

    def places(self, combos: Sequence[tuple[str, ...]]) -> list[Combo]:
        return [tuple(self.columns.index(c) for c in combo) for combo in combos]

    def count(self, combos: Sequence[tuple[str, ...]], skip_null: bool = False) -> None:
        rows = sum(self.rows)
        if self.several is None and rows * len(combos) > PASS_ROWS:
            self.several = _several(self.values)
        self.known |= zip(combos, _counts(self.values, self.places(combos), rows, skip_null, self.several))

    def without_doubles(self, combos: Sequence[tuple[str, ...]], skip_null: bool = False) -> Iterator[tuple[str, ...]]:
        """Those combinations that have no tuple twice, in turn. A slice of all tuples rules out most of the others."""
        rows, places = sum(self.rows), self.places(combos)
        slices = max(1, -(-rows * len(combos) // SLICE_ROWS))
        found = _tuples(self.values, places, skip_null, slices)
        if slices == 1:
            self.known |= {combo: tuple(found.get(2 * k + side, (0, 0))[0] for side in (0, 1)) for k, combo in enumerate(combos)}
        for k, combo in enumerate(combos):
            if all(found.get(2 * k + side, (0, 0))[1] < 2 for side in (0, 1)) and (slices == 1 or self.is_single(places[k], skip_null)):
                yield combo

    def is_single(self, place: Combo, skip_null: bool) -> bool:
        """Whether no tuple of the combination occurs twice, by passes over all of them."""
        passes = _passes(sum(self.rows))
        return all(most < 2 for k in range(passes) for _, most in _tuples(self.values, [place], skip_null, passes, k).values())

    def at_most(self, combo: tuple[str, ...], side: int) -> int:
        """No combination has more tuples than the product over parts that are known."""
        best = min(self.rows[side], prod(self.known[(c,)][side] for c in combo))
        for i, c in enumerate(combo):
            rest = combo[:i] + combo[i + 1 :]
            if rest in self.known:
                best = min(best, self.known[(c,)][side] * self.known[rest][side])
        return best

    def score(self, distinct: Sequence[int]) -> float:
        return sum(d / max(n, 1) for d, n in zip(distinct, self.rows)) / 2


def detect_key(
    a: DataFrame, b: DataFrame, max_columns: int = MAX_KEY_COLUMNS, sample_rows: int | None = None
) -> list[str]:
    """Smallest, leftmost combination of common columns that is nearly unique on
    both sides, else the most unique one; [] when even that is too ambiguous.

    Combinations are visited by size and position and a later one must be strictly
    better. One that cannot be better, by the exact counts of its parts, is skipped,
    and the search ends once nothing can beat the best: no combination has more
    distinct tuples than all common columns together.
    """
    common = column_sets(a.columns, b.columns)[2]
    if not common:
        return []
    a, b = (df.select(*map(col, common)) for df in (a, b))
    if sample_rows is not None:
        a, b = a.limit(sample_rows), b.limit(sample_rows)
    with scratch(a.sparkSession):
        return _best_key(_Counter(a, b, common), common, max_columns)


def _best_key(counter: _Counter, common: Sequence[str], max_columns: int) -> list[str]:
    best, best_score, ceiling = (), -1.0, 1.0
    for size in range(1, min(max_columns, len(common)) + 1):
        if size == 2:
            counter.count([tuple(common)])
            ceiling = counter.score(counter.known[tuple(common)])
        for batch in _growing(combinations(common, size)):
            if size > 1:
                batch = [c for c in batch if best_score < counter.score([counter.at_most(c, s) for s in (0, 1)])]
            fresh = [c for c in batch if c not in counter.known]
            if best_score >= ceiling:
                break
            if fresh:
                counter.count(fresh)
            for combo in batch:
                score = counter.score(counter.known[combo])
                if score > best_score:
                    best, best_score = combo, score
                if best_score >= UNIQUE_ENOUGH:
                    return list(best)
    return list(best) if best_score >= TOO_AMBIGUOUS else []


def detect_key_strict(a: DataFrame, b: DataFrame) -> list[str]:
    """First single column, then first pair, without any duplicate on either side.

    A single column with a null is no key; in a pair null counts as a value.
    """
    common = column_sets(a.columns, b.columns)[2]
    if not common:
        return []
    a, b = (df.select(*map(col, common)) for df in (a, b))
    with scratch(a.sparkSession):
        return _strict_key(_Counter(a, b, common), common)


def _strict_key(counter: _Counter, common: Sequence[str]) -> list[str]:
    for batch in _growing((c,) for c in common):
        for combo in counter.without_doubles(batch, skip_null=True):
            if combo[0] not in counter.with_null:
                return list(combo)
    unknown = [(c,) for c in common if (c,) not in counter.known]
    if len(unknown) * (len(common) - 1) // 2 > COMBINATIONS_PER_JOB:
        # Columns of few values rule out many pairs.
        counter.several = counter.several or _several(counter.values)
        few = [c for c in unknown if counter.several[counter.columns.index(c[0])] <= TASK_ROWS >> 4]
        for batch in _growing(few, COMBINATIONS_PER_JOB):
            counter.count(batch, skip_null=True)
    # Nulls, left out above, may add one tuple per column.
    pairs = (
        pair
        for pair in combinations(common, 2)
        if all(prod(counter.known.get((c,), counter.rows)[side] + 1 for c in pair) >= counter.rows[side] for side in (0, 1))
    )
    for batch in _growing(pairs):
        for pair in counter.without_doubles(batch):
            return list(pair)
    return []
