"""Comparison of two sides: paired rows, differences, one-sided rows, counts."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from twintally.functions.text import clean, col, num_diff, percent_text, text
from twintally.operators.positions import POSITION, running_totals, with_block_position, with_position
from twintally.sources.staging import stage

# Beyond this many value columns the per-column counts use one row per differing cell.
WIDE_COLUMNS = 60
# Fixed values of the report.
STATUS_OK, STATUS_DIFF = "OK", "DIFFERENZE"
DIFF_ROW_LIMIT = 10_000
ONLY_ROW_LIMIT = 5_000

_ROW = -1  # position under which the whole row is counted
_PAIRS = "decimal(38,0)"


@dataclass(frozen=True)
class KeyProfile:
    """What the keys alone tell about the two sides."""

    rows_a: int
    rows_b: int
    matched: int
    only_a: int
    only_b: int
    dup_keys_a: int = 0
    dup_keys_b: int = 0
    heavy_keys: int = 0
    heavy_pairs: int = 0


class Comparison:
    """What follows once rows are paired; subclasses say how they are paired."""

    key: list[str]
    values: list[str]
    a: DataFrame
    b: DataFrame
    profile: KeyProfile
    _same: Callable[[Column], Column]
    _staged: DataFrame | None = None

    def pairs(self) -> DataFrame:
        """Paired rows: key, then ``c__a`` and ``c__b`` per value column."""
        raise NotImplementedError

    def only_a(self) -> DataFrame:
        """Rows of a without a partner, all columns of a."""
        raise NotImplementedError

    def only_b(self) -> DataFrame:
        """Rows of b without a partner, all columns of b."""
        raise NotImplementedError

    # -- differences -------------------------------------------------------

    def _differs(self, name: str) -> Column:
        return self._same(col(f"{name}__a")) != self._same(col(f"{name}__b"))

    def _row_differs(self) -> Column:
        if len(self.values) > WIDE_COLUMNS:
            sides = [F.array(*[self._same(col(f"{c}__{s}")) for c in self.values]) for s in "ab"]
            return sides[0] != sides[1]
        return reduce(operator.or_, map(self._differs, self.values), F.lit(False))

    def differing(self) -> DataFrame:
        """The pairs that differ; every report on differences starts from these."""
        return self.pairs().where(self._row_differs()) if self._staged is None else self._staged

    def materialize(self) -> Comparison:
        """Write the differing pairs once, for use by several reports."""
        if self._staged is None:
            self._staged = stage(self.differing(), "differing")
        return self

    def _wide(self, pairs: DataFrame) -> DataFrame:
        shown = [col(k) for k in self.key]
        for c in self.values:
            a, b = col(f"{c}__a"), col(f"{c}__b")
            shown += [a, b, num_diff(a, b).alias(f"{c}__num_diff")]
        return pairs.select(*shown)

    def diff_rows(self) -> DataFrame:
        """Paired rows that differ, with the numeric difference per column."""
        return self._wide(self.differing())

    def diff_cells(self) -> DataFrame:
        """One row per differing cell: key, column, a, b, num_diff; a name the key has gets a ``_`` more."""
        taken = {c.lower() for c in self.key}
        column, a, b, difference = (free_name(c, taken) for c in ("column", "a", "b", "num_diff"))
        cells = F.array(
            *[
                F.struct(F.lit(c).alias(column), col(f"{c}__a").alias(a), col(f"{c}__b").alias(b))
                for c in self.values
            ]
        )
        if not self.values:
            cells = F.array().cast(f"array<struct<{column}:string,{a}:string,{b}:string>>")
        differing = F.filter(cells, lambda x: self._same(x[a]) != self._same(x[b]))
        return self.differing().select(*map(col, self.key), F.inline(differing)).withColumn(
            difference, num_diff(F.col(a), F.col(b))
        )

    def _order(self) -> list[Column]:
        sides = [[col(f"{c}__{s}") for c in self.values] for s in "ab"]
        return [col(k) for k in self.key] + sides[0] + sides[1]

    def diff_rows_top(self, limit: int = DIFF_ROW_LIMIT) -> DataFrame:
        """The first ``limit`` differing rows by key, then by the values of a and b."""
        return self._wide(self.differing().orderBy(*self._order()).limit(limit))

    def only_a_top(self, limit: int = ONLY_ROW_LIMIT) -> DataFrame:
        return _first_rows(self.only_a(), self.key, limit)

    def only_b_top(self, limit: int = ONLY_ROW_LIMIT) -> DataFrame:
        return _first_rows(self.only_b(), self.key, limit)

    # -- counts ------------------------------------------------------------

    def _totals(self) -> DataFrame:
        """Differing pairs per value column position, and per row under -1."""
        rows = self.differing()
        if len(self.values) <= WIDE_COLUMNS:
            counted = rows.agg(
                F.count("*").alias("d_row"),
                *[F.count_if(self._differs(c)).alias(f"d_{i}") for i, c in enumerate(self.values)],
            )
            positions = [(_ROW, "d_row")] + [(i, f"d_{i}") for i in range(len(self.values))]
            per_position = F.array(
                *[F.struct(F.lit(i).alias("pos"), F.col(d).cast(_PAIRS).alias("n")) for i, d in positions]
            )
            return counted.select(F.inline(per_position))
        flags = F.array(*[F.when(self._differs(c), i) for i, c in enumerate(self.values)])
        differing = F.concat(F.array(F.lit(_ROW)), F.array_compact(flags))
        cells = rows.select(F.explode(differing).alias("pos"))
        return cells.groupBy("pos").agg(F.count("*").cast(_PAIRS).alias("n"))

    def counts(self) -> DataFrame:
        """One row: n_both, only_a, only_b, n_diff and ``diff__c`` per value column."""
        p = self.profile

        def total(pos: int) -> Column:
            return F.coalesce(F.sum(F.when(F.col("pos") == pos, F.col("n"))), F.lit(0)).cast("bigint")

        return self._totals().agg(
            F.lit(p.matched).cast("bigint").alias("n_both"),
            F.lit(p.only_a).cast("bigint").alias("only_a"),
            F.lit(p.only_b).cast("bigint").alias("only_b"),
            total(_ROW).alias("n_diff"),
            *[total(i).alias(f"diff__{c}") for i, c in enumerate(self.values)],
        )

    def column_summary(self, counts: DataFrame | None = None) -> DataFrame:
        """Equal and differing pairs per value column."""
        counts = self.counts() if counts is None else counts
        per_column = F.array(
            *[
                F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("column"), col(f"diff__{c}").alias("n_diff"))
                for i, c in enumerate(self.values)
            ]
        )
        if not self.values:
            per_column = F.array().cast("array<struct<position:int,column:string,n_diff:bigint>>")
        n_diff, total = F.col("n_diff"), F.lit(self.profile.matched).cast("bigint")
        return counts.select(F.inline(per_column)).select(
            "position",
            "column",
            F.lit("No" if self.key != [POSITION] else "—").alias("is_key"),
            (total - n_diff).alias("n_equal"),
            n_diff.alias("n_diff"),
            total.alias("n_total"),
            F.when(total > 0, n_diff / total * 100).otherwise(0.0).alias("pct_diff"),
            percent_text(n_diff, total).alias("pct_text"),
            F.when(n_diff == 0, STATUS_OK).otherwise(STATUS_DIFF).alias("status"),
        )

    def summary(self) -> DataFrame:
        """One row of counters without regard to a label: rows, columns, one-sided, differing."""
        p = self.profile
        only_a, only_b, common = column_sets(self.a.columns, self.b.columns)
        numbers = {
            "rows_a": p.rows_a,
            "rows_b": p.rows_b,
            "cols_only_a": len(only_a),
            "cols_only_b": len(only_b),
            "cols_common": len(common),
            "rows_only_a": p.only_a,
            "rows_only_b": p.only_b,
        }
        return self.counts().select(
            *[F.lit(n).cast("bigint").alias(name) for name, n in numbers.items()],
            F.col("n_diff").alias("rows_diff"),
            F.lit(not only_a and not only_b).alias("struct_ok"),
        )


class KeyedComparison(Comparison):
    """Rows are paired by equal keys; equal keys pair many to many.

    One aggregate over the keys (no values, combined before the shuffle) gives all
    row counts and tells how each key occurs. A key that is unique on one side at
    least is paired row by row: its pairs are no more than the rows of the other
    side, and adaptive execution can split the join. A key repeated on both sides
    (heavy) would give the product of its rows, so its pairs are counted from the
    rows per key and per key and value, and ``diff_groups`` lists its distinct rows
    with multiplicities. ``expand`` lists those pairs, too, whatever their number.
    """

    def __init__(
        self,
        a: DataFrame,
        b: DataFrame,
        key: Sequence[str],
        *,
        cleaned: bool = False,
        keep_original: bool = False,
        expand: bool = False,
    ):
        self.key = list(key)
        self.expand = expand
        self.values = [c for c in a.columns if c in set(b.columns) and c not in self.key]
        self.a, self.b, self._same = _prepare(a, b, self.key, cleaned, keep_original)
        taken = {c.lower() for c in [*self.a.columns, *self.b.columns]}
        self._rows = [free_name(f"rows_{s}", taken) for s in "ab"]

    # -- keys --------------------------------------------------------------

    def key_counts(self) -> DataFrame:
        """Rows per key and side."""
        return count_sides(self.a.select(*self._keys), self.b.select(*self._keys), self.key, self._rows)

    @property
    def _keys(self) -> list[Column]:
        return [col(k) for k in self.key]

    def _is_heavy(self) -> Column:
        return F.lit(False) if self.expand else F.least(*map(col, self._rows)) > 1

    @cached_property
    def _keys_once(self) -> tuple[KeyProfile, DataFrame]:
        """The profile and the heavy keys from one pass: what is written is observed on the way.

        Heavy keys are written, so that Spark knows the size: it broadcasts few and shuffles many.
        """
        a, b, heavy = *map(col, self._rows), self._is_heavy()
        pairs = a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
        metrics = [
            F.sum(a).alias("rows_a"),
            F.sum(b).alias("rows_b"),
            F.sum(F.when(~heavy, pairs)).alias("light_pairs"),
            F.sum(F.when(heavy, pairs)).alias("heavy_pairs"),
            F.sum(F.when(b == 0, a)).alias("only_a"),
            F.sum(F.when(a == 0, b)).alias("only_b"),
            F.count_if(a > 1).alias("dup_keys_a"),
            F.count_if(b > 1).alias("dup_keys_b"),
            F.count_if(heavy).alias("heavy_keys"),
        ]
        if self.expand:
            keys, found = self.a.select(*self._keys).limit(0), self.key_counts().agg(*metrics).first().asDict()
        else:
            seen = Observation()
            keys = stage(self.key_counts().observe(seen, *metrics).where(heavy).select(*self._keys), "heavy-keys")
            found = seen.get
        numbers = {name: int(n or 0) for name, n in found.items()}
        matched = numbers.pop("light_pairs") + numbers["heavy_pairs"]
        return KeyProfile(matched=matched, **numbers), keys

    @property
    def profile(self) -> KeyProfile:
        return self._keys_once[0]

    @property
    def _heavy_keys(self) -> DataFrame:
        return self._keys_once[1]

    def _light(self, side: DataFrame) -> DataFrame:
        if not self.profile.heavy_keys:
            return side
        return side.join(self._heavy_keys, self.key, "left_anti")

    # -- rows --------------------------------------------------------------

    def _suffixed(self, side: DataFrame, suffix: str) -> DataFrame:
        return side.select(*self._keys, *[col(c).alias(f"{c}__{suffix}") for c in self.values])

    def pairs(self) -> DataFrame:
        """Paired rows of all keys but the heavy ones."""
        a = self._suffixed(self._light(self.a), "a")
        b = self._suffixed(self._light(self.b), "b")
        return a.join(b, self.key)

    def only_a(self) -> DataFrame:
        return self.a.join(self.b.select(*self._keys).distinct(), self.key, "left_anti")

    def only_b(self) -> DataFrame:
        return self.b.join(self.a.select(*self._keys).distinct(), self.key, "left_anti")

    def outer(self) -> DataFrame:
        """Pairs and one-sided rows with ``side`` = both / only_a / only_b.

        The parts are united, since a full outer join can't be split by adaptive execution.
        """
        side = free_name("side", {c.lower() for c in self.key})
        found = self.pairs().withColumn(side, F.lit("both"))
        for rows, suffix, name in ((self.only_a(), "a", "only_a"), (self.only_b(), "b", "only_b")):
            found = found.unionByName(self._suffixed(rows, suffix).withColumn(side, F.lit(name)), allowMissingColumns=True)
        return found

    # -- heavy keys --------------------------------------------------------

    def _heavy_rows(self) -> DataFrame:
        """Rows of both sides under heavy keys, compared values, side as 0/1 columns."""
        sides = []
        for side, marks in ((self.a, (1, 0)), (self.b, (0, 1))):
            rows = side.join(self._heavy_keys, self.key, "left_semi")
            sides.append(
                rows.select(
                    *self._keys,
                    *[self._same(col(c)).alias(c) for c in self.values],
                    *[F.lit(n).cast("bigint").alias(name) for n, name in zip(marks, self._rows)],
                )
            )
        return sides[0].unionByName(sides[1])

    def diff_groups(self) -> DataFrame:
        """Distinct rows under heavy keys with their number on either side.

        The pairs of a heavy key are the products of its a rows and b rows; this
        form lists the same facts in linear size.
        """
        return self._heavy_rows().groupBy(*self._keys, *map(col, self.values)).agg(*self._row_sums)

    @property
    def _row_sums(self) -> list[Column]:
        return [F.sum(col(r)).alias(r) for r in self._rows]

    @property
    def _row_product(self) -> Column:
        a, b = (col(r).cast("decimal(19,0)") for r in self._rows)
        return a * b

    def _totals(self) -> DataFrame:
        light = super()._totals()
        if not self.profile.heavy_keys or not self.values:
            return light
        spark = self.a.sparkSession
        taken = {c.lower() for c in [*self.key, *self._rows]}
        pos, value = free_name("pos", taken), free_name("v", taken)
        cells = F.array(
            F.struct(F.lit(_ROW).alias(pos), F.array(*map(col, self.values)).alias(value)),
            *[F.struct(F.lit(i).alias(pos), F.array(col(c)).alias(value)) for i, c in enumerate(self.values)],
        )
        matching = (
            self._heavy_rows()
            .select(*self._keys, *map(col, self._rows), F.inline(cells))
            .groupBy(*self._keys, pos, value)
            .agg(*self._row_sums)
            .where(F.least(*map(col, self._rows)) > 0)
        )
        equal = matching.groupBy(F.col(pos).alias("pos")).agg((-F.sum(self._row_product)).cast(_PAIRS).alias("n"))
        every = spark.range(_ROW, len(self.values)).select(
            F.col("id").cast("int").alias("pos"),
            F.lit(Decimal(self.profile.heavy_pairs)).cast(_PAIRS).alias("n"),
        )
        return light.unionByName(every).unionByName(equal)

    def diff_rows_top(self, limit: int = DIFF_ROW_LIMIT) -> DataFrame:
        light = self.differing()
        if self.profile.heavy_keys and self.values:
            light = light.orderBy(*self._order()).limit(limit).unionByName(self._heavy_top(limit))
        return self._wide(light.orderBy(*self._order()).limit(limit))

    def _heavy_top(self, limit: int) -> DataFrame:
        """The first ``limit`` differing pairs of the heavy keys.

        Running totals of differing pairs, first over the keys, then over the distinct
        rows of a within a key, then over pairs, say which can matter; at each step
        that is a small multiple of ``limit`` rows. Only pairs that are shown are copied.
        """
        rows_a, rows_b = self._rows
        groups = stage(self.diff_groups(), "heavy-groups")
        keys, values = self._keys, [col(c) for c in self.values]
        taken = {c.lower() for c in [*self.key, *(f"{c}__{s}" for c in self.values for s in "ab"), *self.values, *self._rows]}
        n, start, all_b, part, rank, below = (free_name(c, taken) for c in ("_n", "_start", "_all_b", "_part", "_rank", "_below"))
        totals = [F.sum(col(r)).cast("decimal(19,0)") for r in self._rows]

        def started(df: DataFrame, order: Sequence[Column]) -> DataFrame:
            return running_totals(df, order, n, start, limit)

        # Each of these keys has a differing pair, so the first ``limit`` of them are enough.
        of_key = groups.groupBy(*keys).agg((totals[0] * totals[1] - F.sum(self._row_product)).alias(n), totals[1].alias(all_b))
        first_keys = stage(started(of_key.where(F.col(n) > 0).orderBy(*keys).limit(limit), keys).drop(n, start), "first-keys")

        def ranked(rows: str) -> DataFrame:
            """The first rows of each key; in two steps, so that those of one key are cut down in parallel."""
            side = groups.where(col(rows) > 0).withColumn(part, F.pmod(F.xxhash64(*values), F.lit(64)))
            side = side.join(first_keys, self.key)
            for by in ([*keys, F.col(part)], keys):
                window = Window.partitionBy(*by).orderBy(*values)
                side = side.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= limit + 1)
            return side

        # Of a row of a, all rows of b but its equal ones differ.
        a = ranked(rows_a).withColumn(n, col(rows_a).cast("decimal(19,0)") * (F.col(all_b) - col(rows_b)))
        a = started(a.where(F.col(n) > 0), [*keys, *values])
        a = self._suffixed_heavy(a.withColumn(below, limit - F.col(start) + 1), "a", rows_a, below)
        b = self._suffixed_heavy(ranked(rows_b), "b", rows_b, rank)
        pairs = a.join(b, self.key).where((F.col(rank) <= F.col(below)) & self._row_differs()).withColumn(n, self._row_product)
        shown = started(pairs, self._order())
        copies = F.least(F.col(n), limit - F.col(start)).cast("int")
        return shown.withColumn(rank, F.explode(F.sequence(F.lit(1), copies))).drop(rows_a, rows_b, n, start, rank, below)

    def _suffixed_heavy(self, side: DataFrame, suffix: str, *more: str) -> DataFrame:
        return side.select(*self._keys, *[col(c).alias(f"{c}__{suffix}") for c in self.values], *map(col, more))


class PositionalComparison(Comparison):
    """Row i of a is paired with row i of b; the tail of the longer side is one-sided."""

    def __init__(
        self,
        a: DataFrame,
        b: DataFrame,
        order_by: Sequence[str],
        *,
        cleaned: bool = False,
        keep_original: bool = False,
        unique_order: bool = False,
        helpers: Sequence[str] = (),
        file_order: bool = False,
    ):
        """``helpers`` are columns that give the order only and are not compared. ``file_order``: ``order_by`` is the file,
        block and place of lines that were read from files."""
        helper = set(helpers)
        self.key = [POSITION]
        self.values = [c for c in a.columns if c in set(b.columns) and c not in helper]
        placed = (with_block_position(side, *order_by) if file_order else with_position(side, order_by, unique_order) for side in (a, b))
        a, b = (side.drop(*helper) for side in placed)
        self.a, self.b, self._same = _prepare(a, b, [], cleaned, keep_original, untouched=POSITION)

    @cached_property
    def profile(self) -> KeyProfile:
        rows_a, rows_b = self.a.count(), self.b.count()
        matched = min(rows_a, rows_b)
        return KeyProfile(rows_a, rows_b, matched, rows_a - matched, rows_b - matched)

    def pairs(self) -> DataFrame:
        sides = [
            side.select(POSITION, *[col(c).alias(f"{c}__{suffix}") for c in self.values])
            for side, suffix in ((self.a, "a"), (self.b, "b"))
        ]
        return sides[0].join(sides[1], POSITION)

    def only_a(self) -> DataFrame:
        return self.a.where(F.col(POSITION) > self.profile.matched)

    def only_b(self) -> DataFrame:
        return self.b.where(F.col(POSITION) > self.profile.matched)

    def summary(self) -> DataFrame:
        both_have_it = 1
        return super().summary().withColumn("cols_common", F.col("cols_common") - both_have_it)


def compare(
    a: DataFrame,
    b: DataFrame,
    key: Sequence[str] = (),
    order_by: Sequence[str] = (),
    **options,
) -> Comparison:
    """Compare by key, or by position along ``order_by`` when there is no key.

    The search for a key is ``detect_key(a, b)``. Options: ``cleaned`` when the
    values are normalised already, ``keep_original`` to report values as they came
    while comparing them normalised, ``expand`` to list every pair of keys repeated on
    both sides, ``unique_order`` when ``order_by`` has no ties, ``helpers`` for columns
    that give the order but are not compared, ``file_order`` for lines of files.
    """
    if key:
        return KeyedComparison(a, b, key, **options)
    if not order_by:
        raise ValueError("without a key the order of the rows has to be given")
    return PositionalComparison(a, b, order_by, **options)


def free_name(name: str, taken: set[str]) -> str:
    """A column name that none of ``taken`` (in lower case) has; it is taken from then on."""
    while name.lower() in taken:
        name += "_"
    taken.add(name.lower())
    return name


def count_sides(a: DataFrame, b: DataFrame, by: Sequence[str], names: Sequence[str] = ("rows_a", "rows_b")) -> DataFrame:
    """Rows per group on either side, without a join: tag, union, count."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    tagged = a.withColumns({names[0]: one, names[1]: none}).unionByName(b.withColumns({names[0]: none, names[1]: one}))
    return tagged.groupBy(*map(col, by)).agg(*[F.sum(col(n)).alias(n) for n in names])


def column_sets(a: Sequence[str], b: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
    """Columns only in a, only in b, in both; in the order of their side."""
    in_a, in_b = set(a), set(b)
    return [c for c in a if c not in in_b], [c for c in b if c not in in_a], [c for c in a if c in in_b]


def _prepare(a, b, key, cleaned, keep_original, untouched=None):
    """Both sides as strings, and the expression under which two values are the same."""
    plain = (lambda c: c) if cleaned else (text if keep_original else clean)
    same = clean if keep_original and not cleaned else (lambda c: c)

    def shaped(c: str) -> Column:
        if c == untouched:
            return col(c)
        return (plain if cleaned or c not in key else clean)(col(c)).alias(c)

    return a.select(*map(shaped, a.columns)), b.select(*map(shaped, b.columns)), same


def _first_rows(df: DataFrame, key: Sequence[str], limit: int) -> DataFrame:
    others = [c for c in df.columns if c not in key]
    return df.orderBy(*map(col, [*key, *others])).limit(limit)
