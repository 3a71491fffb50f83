"""Runs over all pairs of two deliveries, or over all families of a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from twintally.operators.compare import Comparison, compare
from twintally.operators.keys import detect_key, detect_key_strict
from twintally.operators.pairing import find_families, match_files, match_logical
from twintally.plans.report import (
    ERROR,
    MISSING_FILE,
    RECORD_SCHEMA,
    SIDE_A,
    SIDE_B,
    failed_record,
    issue_lines,
    issue_log,
    issue_record,
    pair_reports,
    write_reports,
)
from twintally.sources.delimited import LINE_ORDER, Delivery, read_deliveries, read_delimited
from twintally.sources.listing import list_deliveries, list_sources
from twintally.sources.staging import new_path

Progress = Callable[[str, int, int], None]
PARALLEL_PAIRS = 4


@dataclass(frozen=True)
class PairResult:
    """What one pair left behind besides its written reports."""

    label: str
    summary: Row | None = None
    error: str | None = None


def compare_deliveries(
    a: Delivery,
    b: Delivery,
    key: Sequence[str] | None = None,
    strict: bool = False,
    key_sample_rows: int | None = None,
) -> Comparison:
    """Compare two parsed files by the given or detected key, else line by line."""
    rows = [side.rows for side in (a, b)]
    if key is None:
        key = detect_key_strict(*rows) if strict else detect_key(*rows, sample_rows=key_sample_rows)
    if key:
        return compare(*rows, key=key, cleaned=True)
    return compare(a.ordered, b.ordered, order_by=LINE_ORDER, helpers=LINE_ORDER, cleaned=True, file_order=True)


class _Run:
    """Where the pairs of one run put their reports and records.

    Each pair writes its record into its own partition of one staged table (pairs
    finish at the same time), so the issue log over thousands of pairs is one scan.
    """

    def __init__(self, spark: SparkSession, out: str, format: str):
        self.spark, self.out, self.format = spark, out, format
        self._records = new_path(spark, "records")

    def record(self, df: DataFrame) -> None:
        df.write.parquet(f"{self._records}/pair={uuid.uuid4().hex}")

    def records(self) -> DataFrame:
        return self.spark.read.schema(RECORD_SCHEMA).parquet(self._records).drop("pair")

    def write(self, reports: Mapping[str, DataFrame], label: str | None = None) -> None:
        write_reports(reports, self.out, label, self.format)

    def pair(
        self,
        label: str,
        a: Delivery,
        b: Delivery,
        row_filter: Mapping[str, str] | None = None,
        **search,
    ) -> PairResult:
        comparison = compare_deliveries(a, b, **search)
        unfiltered = [f"{side.name}: {name}" for side in (a, b) for name in side.unfiltered]
        reports = pair_reports(comparison, label, a.name, b.name, row_filter=row_filter, unfiltered=unfiltered)
        lines = [issue_lines(d.rejected, label, side, d.name) for d, side in ((a, SIDE_A), (b, SIDE_B))]
        self.write({**reports, "issue_lines": lines[0].unionByName(lines[1])}, label)
        summary = reports["pair_summary"].first()
        self.record(
            issue_record(
                comparison,
                label,
                a.name,
                b.name,
                (a.sep, b.sep),
                spaced=(a.n_spaced, b.n_spaced),
                rejected=(a.n_rejected, b.n_rejected),
                counts=reports["pair_summary"].select(F.col("rows_with_diff").alias("n_diff")),
                structure=reports["column_structure"],
            )
        )
        return PairResult(label, summary)

    def failed(self, label: str, name_a: str | None, name_b: str | None, error: Exception) -> PairResult:
        self.record(failed_record(self.spark, label, name_a, name_b, str(error)))
        return PairResult(label, error=str(error))


def _read_all(spark: SparkSession, paths: Sequence[str], **options) -> dict[str, Delivery | Exception]:
    """All files at once; if that fails, the ones that can be read, each by itself, and the others' errors."""
    paths = sorted(set(paths))
    try:
        return dict(zip(paths, read_deliveries(spark, paths, **options)))
    except Exception:  # one of the files; its pair is the one to fail
        pass
    found: dict[str, Delivery | Exception] = {}
    for path in paths:
        try:
            found[path] = read_delimited(spark, path, **options)
        except Exception as error:
            found[path] = error
    return found


def _good(delivery: Delivery | Exception) -> Delivery:
    if isinstance(delivery, Exception):
        raise delivery
    return delivery


def _each(pairs, work, parallel: int, on_progress: Progress | None) -> list[PairResult]:
    """Run the pairs side by side; their Spark jobs share the executors."""
    results = []
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        for result in pool.map(work, pairs):
            results.append(result)
            if on_progress:
                on_progress(result.label, len(results), len(pairs))
    return results


def _unique_labels(labels: Sequence[str]) -> list[str]:
    """Labels that name their output folder: the second ``X`` becomes ``X_2``."""
    taken: set[str] = set()
    for label in labels:
        name, n = label, 1
        while name in taken:
            n += 1
            name = f"{label}_{n}"
        taken.add(name)
        yield name


def run(
    spark: SparkSession,
    a_path: str,
    b_path: str,
    out: str,
    sep: str | None = None,
    key: Sequence[str] | None = None,
    row_filter: Mapping[str, str] | None = None,
    how: str = "full",
    key_sample_rows: int | None = None,
    format: str = "parquet",
    parallel: int = PARALLEL_PAIRS,
    on_progress: Progress | None = None,
) -> DataFrame:
    """Compare all pairs of files under two paths, write every report below ``out``
    and return the issue records.

    ``how`` is "full" to list files without a partner on either side as unpaired, or
    "left" for those of the first path only. A pair that fails is recorded with its error and does not stop the others. The
    key is searched on whole files unless ``key_sample_rows`` limits the search.
    """
    listed = match_files(list_sources(spark, a_path), list_sources(spark, b_path), how)
    rows = listed.orderBy("label", "path_a", "path_b").collect()
    pairs = list(zip(_unique_labels([r["label"] for r in rows]), rows))
    this = _Run(spark, out, format)
    paired = [(label, r) for label, r in pairs if r["path_a"] and r["path_b"]]
    deliveries = _read_all(spark, [r[f"path_{s}"] for _, r in paired for s in "ab"], sep=sep, row_filter=row_filter)

    def work(pair: tuple[str, Row]) -> PairResult:
        label, row = pair
        try:
            a, b = (_good(deliveries[row[f"path_{s}"]]) for s in "ab")
            return this.pair(label, a, b, row_filter, key=key, key_sample_rows=key_sample_rows)
        except Exception as error:  # any failure belongs to its pair
            return this.failed(label, row["name_a"], row["name_b"], error)

    _each(paired, work, parallel, on_progress)
    unpaired = [(r["label"], r["name_a"], r["name_b"]) for _, r in pairs if not (r["path_a"] and r["path_b"])]
    this.write({"unpaired": spark.createDataFrame(unpaired, "label string, name_a string, name_b string")})
    if not paired:
        return spark.createDataFrame([], RECORD_SCHEMA)
    this.write(issue_log(this.records()))
    return this.records()


def _empty(spark: SparkSession, name: str) -> Delivery:
    """The side a pair lacks: no columns, no rows."""
    return Delivery(
        name=name,
        path="",
        sep=";",
        encoding="utf-8",
        has_header=False,
        columns=[],
        ordered=spark.createDataFrame([], "_file string, _block bigint, _at bigint"),
        rejected=spark.createDataFrame([], "line_no bigint, line string"),
        n_rows=0,
        n_rejected=0,
        n_spaced=0,
    )


def _flattened(sources: DataFrame) -> DataFrame:
    """Files of an archive without their folders; of equal names the first counts."""
    return sources.groupBy("name").agg(F.min(F.struct("path", "size")).alias("file")).select("name", "file.*")


def run_families(
    spark: SparkSession,
    out: str,
    base_dir: str | None = None,
    asis: str | None = None,
    tobe: str | None = None,
    prefix: str | None = None,
    format: str = "parquet",
    parallel: int = PARALLEL_PAIRS,
    on_progress: Progress | None = None,
) -> DataFrame:
    """Compare old and new deliveries family by family with the older rules.

    Files pair by logical name; a side that is missing or empty counts as a table
    without columns. Returns the summary over all families.
    """
    if base_dir is not None:
        deliveries = list_deliveries(spark, base_dir)
        found = find_families(deliveries, prefix).orderBy("family").collect()
        root = base_dir.rstrip("/") + "/"
        families = [(f["family"], *(root + f[s] if f[s] else None for s in ("asis", "tobe"))) for f in found]
    else:
        families = [("explicit", asis, tobe)]

    pairs = []
    for family, old, new in families:
        nothing = "name string, path string, size bigint"
        sides = [
            _flattened(list_sources(spark, path)) if path else spark.createDataFrame([], nothing) for path in (old, new)
        ]
        filled = [side.where("size > 0") for side in sides]
        matched = match_logical(*sides).orderBy("logical_name").collect()
        usable = {r["path"] for side in filled for r in side.select("path").collect()}
        pairs += [(family, row, usable) for row in matched]
    labels = list(_unique_labels([f"{family}.{row['logical_name']}" for family, row, _ in pairs]))

    this = _Run(spark, out, format)
    filled = [row[f"path_{s}"] for _, row, usable in pairs for s in "ab" if row[f"path_{s}"] in usable]
    deliveries = _read_all(spark, filled, legacy=True)

    def work(job) -> PairResult:
        label, (_, row, usable) = job
        names = {s: row[f"name_{s}"] or MISSING_FILE for s in "ab"}
        try:
            a, b = (
                _good(deliveries[row[f"path_{s}"]])
                if row[f"path_{s}"] in usable
                else _empty(spark, names[s])
                for s in "ab"
            )
            return this.pair(label, a, b, strict=True)
        except Exception as error:  # any failure belongs to its pair
            return this.failed(label, names["a"], names["b"], error)

    results = _each(list(zip(labels, pairs)), work, parallel, on_progress)
    summaries = []
    for result, (family, row, _) in zip(results, pairs):
        s = result.summary.asDict() if result.summary else {}
        summaries.append(
            {
                "family": family,
                "logical_name": row["logical_name"],
                "name_a": row["name_a"] or MISSING_FILE,
                "name_b": row["name_b"] or MISSING_FILE,
                **{c: s.get(c) for c in _SUMMARY_COLUMNS},
                "outcome": f"{ERROR}: {result.error}" if result.error else s.get("outcome"),
            }
        )
    summary = spark.createDataFrame(summaries, _BATCH_SCHEMA)
    this.write({"batch_summary": summary})
    return summary


_SUMMARY_COLUMNS = ["rows_a", "rows_b", "delta_rows", "cols_only_a", "cols_only_b", "cols_with_diff", "rows_with_diff"]
_BATCH_SCHEMA = """
    family string, logical_name string, name_a string, name_b string, rows_a bigint, rows_b bigint,
    delta_rows bigint, cols_only_a string, cols_only_b string, cols_with_diff string, rows_with_diff bigint,
    outcome string
"""
