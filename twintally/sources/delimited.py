"""Untidy delimited files as tables of strings.

Any number of deliveries is read at once: one scan of all files, decisions as one row per delivery, and one parse whose
rows have as many columns as the widest delivery. The number of jobs doesn't depend on the number of deliveries.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twintally.functions.text import VALUE_PREFIXES, clean, col, strip, text
from twintally.operators.columns import dedup_columns, generated_names, is_artifact, prefix_chars
from twintally.operators.filters import resolve_column
from twintally.operators.quoted import FILE, join_records, open_files
from twintally.operators.sniff import (
    DEFAULT_SEPARATOR,
    detect_separators,
    fields,
    is_blank,
    is_header,
    spaced_fields,
    too_long,
)
from twintally.sources.archive import entry_lines
from twintally.sources.listing import ENTRY_MARK
from twintally.sources.staging import stage

UTF8, CP1252 = "utf-8", "cp1252"
LINE_ORDER = ["_file", "_block", "_at"]
#: Rows of one delivery each are broadcast below this many deliveries.
MOST_NAMES = 50_000

# Separators a user can pick by name.
SEPARATOR_PRESETS = {
    "semicolon": ";",
    "comma": ",",
    "tab": "\t",
    "pipe": "|",
    "semicolon-pipe": ";|",
    "semicolon-pound": ";£",
}

# The bytes 0x80-0x9F of cp1252; those it leaves open become the replacement character.
_C1_BYTES = bytes(range(0x80, 0xA0))
_C1_TEXT = _C1_BYTES.decode("cp1252", errors="replace")
_C1_LATIN = _C1_BYTES.decode("latin-1")


@dataclass(frozen=True)
class Delivery:
    """One parsed file.

    ``ordered`` has the line order in ``LINE_ORDER`` besides the columns, ``rows``
    only the columns; ``rejected`` lists lines with too many fields. The numbers count
    rows, rejected lines and fields with stray blanks; ``unfiltered`` are the names of
    a row filter that the file lacks.
    """

    name: str
    path: str
    sep: str
    encoding: str
    has_header: bool
    columns: list[str]
    ordered: DataFrame
    rejected: DataFrame
    n_rows: int
    n_rejected: int
    n_spaced: int
    strip_chars: str = field(default="")
    unfiltered: tuple[str, ...] = ()

    @property
    def rows(self) -> DataFrame:
        return self.ordered.select(*map(col, self.columns))


def decode(value: Column, encoding: str) -> Column:
    """Raw line bytes as text; undecodable bytes become the replacement character."""
    if encoding == UTF8:
        return F.make_valid_utf8(value.cast("string"))
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    return F.translate(latin, _C1_LATIN, _C1_TEXT)


def decode(value: Column, encoding: str) -> Column:
    """Raw line bytes as text; undecodable bytes become the replacement character."""
    if encoding == UTF8:
        return F.make_valid_utf8(value.cast("string"))
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    return F.translate(latin, _C1_LATIN, _C1_TEXT)


def _bare_path(path: str) -> str:
    """A path without scheme, authority and escapes, as lines and given paths are matched."""
    return re.sub("^[A-Za-z][A-Za-z0-9+.-]+:(//[^/]*)?/*", "/", path).rstrip("/")


def raw_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Undecoded lines ``(delivery, _file, _block, _at, value)`` of all paths, which are numbered.

    Both other numbers grow along a file. A path is a file, a folder of part files, or an archive entry.
    """
    inside = [(k, *p.split(ENTRY_MARK, 1)) for k, p in enumerate(paths) if ENTRY_MARK in p]
    plain = [(k, p) for k, p in enumerate(paths) if ENTRY_MARK not in p]
    parts = []
    if plain:
        lines = spark.read.text([p for _, p in plain]).select(
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_at"),
            "value",
        )
        if len(plain) == 1:
            lines = lines.withColumn("delivery", F.lit(plain[0][0]))
        else:
            # A file belongs to the delivery of its own path or to that of its folder.
            names = spark.createDataFrame([(k, _bare_path(p)) for k, p in plain], "delivery int, _path string")
            written = F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B")))
            bare = F.regexp_replace(written, "^[A-Za-z][A-Za-z0-9+.-]+:(//[^/]*)?/*", "/")
            files = lines.select("_file").distinct().select("_file", F.explode(F.array(bare, F.regexp_replace(bare, "/[^/]*$", ""))).alias("_path"))
            lines = lines.join(stage(files.join(names, "_path").select("_file", "delivery"), "files"), "_file")
        parts.append(lines.select("delivery", "_file", "_block", "_at", F.col("value").cast("binary").alias("value")))
    if inside:
        lines = entry_lines(spark, sorted({(a, e) for _, a, e in inside}))
        names = spark.createDataFrame(inside, "delivery int, path string, entry string")
        lines = lines.join(F.broadcast(names) if len(inside) < MOST_NAMES else names, ["path", "entry"])
        file = F.concat("path", F.lit(ENTRY_MARK), "entry")
        parts.append(lines.select("delivery", file.alias("_file"), F.lit(0).cast("bigint").alias("_block"), F.col("at").alias("_at"), "value"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


@dataclass(frozen=True)
class _Layout:
    """What was decided about one delivery."""

    sep: str
    encoding: str
    has_header: bool
    names: list[str]
    kept: list[int]
    expected: int
    chars: str
    head: str | None

    @property
    def columns(self) -> list[str]:
        return [self.names[i] for i in self.kept]


def _separators(lines: DataFrame, sep: str | None, legacy: bool) -> DataFrame:
    """``(delivery, sep)`` of the deliveries with lines, from all lines that aren't blank."""
    if sep or legacy:
        return lines.select("delivery").distinct().withColumn("sep", F.lit(sep or DEFAULT_SEPARATOR))
    numbered = lines.select(F.col("delivery").alias("file"), F.lit(1).cast("bigint").alias("line_no"), "value")
    return detect_separators(numbered).withColumnRenamed("file", "delivery")


def _heads(filled: DataFrame, firsts: DataFrame) -> DataFrame:
    """The first two lines with content of each delivery; ``firsts`` has where each file's begin."""
    at = F.struct("_file", "_block", "_at")
    first = firsts.groupBy("delivery").agg(F.min(F.struct("_file", F.col("_begin._block").alias("_block"), F.col("_begin._at").alias("_at"))).alias("_one"))
    first = stage(first, "first-records")
    second = filled.join(first, "delivery").where(at > F.col("_one")).groupBy("delivery").agg(F.min(at).alias("_two"))
    both = stage(first.join(second, "delivery", "left"), "heads")
    return filled.join(both, "delivery").where((at == F.col("_one")) | (at == F.col("_two"))).withColumn("_second", at == F.col("_two"))


def _marked_values(filled: DataFrame, heads: DataFrame, quote: str | None) -> DataFrame:
    """How many values of the first column begin with each known prefix (null: none), per delivery, but for the header's lines."""
    data = filled.join(heads, "delivery", "left").where(F.col("_head").isNull() | (F.col("value") != F.col("_head")))
    first = F.ltrim(F.get(fields(F.col("value"), F.col("sep"), quote), F.lit(0)))
    mark = F.when((F.length("v") > 1) & F.lit(VALUE_PREFIXES).contains(F.substring("v", 1, 1)), F.substring("v", 1, 1))
    return data.select("delivery", first.alias("v")).groupBy("delivery", mark.alias("mark")).agg(F.count("*").alias("n"))


def _layout(sep: str, encoding: str, parts: list[list[str]], head: str | None, has_header: bool, marks: dict, legacy: bool) -> _Layout:
    """Names and columns from the fields of the first two lines and the counts of value prefixes."""
    expected = max((len(p) for p in parts[: 2 if has_header else 1]), default=0)
    names = [n.strip() for n in parts[0]] if has_header and parts else generated_names(expected)
    if legacy and not has_header:
        names = [str(i) for i in range(expected)]
    names = dedup_columns(names + [""] * (expected - len(names)))
    chars = "" if legacy else prefix_chars(names, {m: n for m, n in marks.items() if m}, sum(marks.values()), sep)
    if chars:
        names = dedup_columns(n.lstrip(chars) for n in names)
    kept = [i for i, n in enumerate(names) if n and (legacy or not is_artifact(n))]
    return _Layout(sep, encoding, has_header, names, kept, expected, chars, head if has_header else None)


_LAYOUT = "delivery int, sep string, _expected int, _kept array<int>, _chars string, _head string, _filters array<struct<at: int, value: string>>"


def read_deliveries(
    spark: SparkSession,
    paths: Sequence[str],
    sep: str | None = None,
    header: bool | None = None,
    encoding: str | None = None,
    quote: str | None = '"',
    legacy: bool = False,
    multi_line: bool = True,
    row_filter: Mapping[str, str] | None = None,
) -> list[Delivery]:
    """Read files, folders of part files or archive entries (``archive.zip::entry``), as strings.

    A folder of part files counts as one file; each part may carry the header.

    Separator, header, encoding and prefixes of each are found out from all its lines
    unless given. The raw lines are staged, and so is their parse: decisions, rows,
    rejected lines and the line order all come from written tables. ``legacy`` is the
    older rule set: ';', UTF-8, its own header test, only unnamed columns dropped,
    values only stripped. A line break inside quotes belongs to the value, unless
    ``multi_line`` is off. Only rows that pass ``row_filter`` are written; the values
    are compared as they are written, without blanks at the edges.
    """
    paths = list(paths)
    if not paths:
        return []
    raw = raw_lines(spark, paths).withColumn("_valid", F.is_valid_utf8(F.col("value").cast("string")))
    raw = stage(raw, "raw-lines")
    blocks = stage(raw.groupBy("delivery", "_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), F.bool_and("_valid").alias("_valid")), "blocks")
    if encoding is None:
        broken = set() if legacy else {r[0] for r in blocks.where("NOT _valid").select("delivery").distinct().collect()}
        encodings = [CP1252 if k in broken else UTF8 for k in range(len(paths))]
    else:
        encodings = [encoding] * len(paths)
    lines = _decoded(raw, blocks, encodings)
    separators = stage(_separators(lines.where(~is_blank(F.col("value"))), sep, legacy), "separators")
    lines = lines.join(separators, "delivery", "left").withColumn("sep", F.coalesce("sep", F.lit(DEFAULT_SEPARATOR)))
    if quote and multi_line:
        lines = _with_records(lines, quote)
    filled = lines.where(~is_blank(F.col("value")))

    begin = F.struct("_block", "_at")
    firsts = stage(filled.groupBy(*FILE).agg(F.min(begin).alias("_begin")), "first-filled-lines")
    value, by = F.col("value"), F.col("sep")
    tested = _heads(filled, firsts).select("delivery", "_second", "value", "sep", fields(value, by, quote).alias("parts"), is_header(value, F.lit(";") if legacy else by, legacy).alias("header"))
    heads: dict[int, list] = {}
    for r in tested.orderBy("delivery", F.col("_second").asc_nulls_first()).collect():
        heads.setdefault(r["delivery"], []).append(r)
    has = {k: header if header is not None else h[0]["header"] for k, h in heads.items()}
    marks: dict[int, dict] = {}
    if not legacy:
        named = spark.createDataFrame([(k, h[0]["value"]) for k, h in heads.items() if has[k]], "delivery int, _head string")
        for r in _marked_values(filled, named, quote).collect():
            marks.setdefault(r["delivery"], {})[r["mark"]] = r["n"]
    layouts, filters, missing = [], [], []
    for k in range(len(paths)):
        own = heads.get(k, [])
        parts = [[v.lstrip(" ") for v in r["parts"]] for r in own]
        layouts.append(_layout(own[0]["sep"] if own else sep or DEFAULT_SEPARATOR, encodings[k], parts, own[0]["value"] if own else None, has.get(k, True), marks.get(k, {}), legacy))
        found = {name: resolve_column(layouts[-1].columns, name) for name in row_filter or {}}
        filters.append([(layouts[-1].columns.index(c), row_filter[name].strip()) for name, c in found.items() if c is not None])
        missing.append(tuple(name for name, c in found.items() if c is None))

    parsed = _parsed(spark, lines, firsts, layouts, filters, quote, legacy)
    staged = stage(parsed, "deliveries", partition_by=["delivery"])
    counted = staged.groupBy("delivery", "_kind").agg(F.count("*").alias("n"), F.sum("_spaced").alias("spaced")).collect()
    counts = {(r["delivery"], r["_kind"]): r for r in counted}
    out = []
    for k, (path, layout) in enumerate(zip(paths, layouts)):
        number = lambda kind, what="n", k=k: (counts[k, kind][what] or 0) if (k, kind) in counts else 0
        mine = staged.where(F.col("delivery") == k)
        out.append(
            Delivery(
                name=path.rsplit("/", 1)[-1],
                path=path,
                sep=layout.sep,
                encoding=layout.encoding,
                has_header=layout.has_header,
                columns=layout.columns,
                ordered=mine.where("_kind = 'row'").select(*LINE_ORDER, *[F.col(f"_c{i}").alias(n) for i, n in enumerate(layout.columns)]),
                rejected=_rejected(mine, blocks.where(F.col("delivery") == k)),
                n_rows=number("row"),
                n_rejected=number("rejected"),
                n_spaced=sum(number(kind, "spaced") for kind in ("row", "rejected", "filtered")),
                strip_chars=layout.chars,
                unfiltered=missing[k],
            )
        )
    return out


def read_delimited(spark: SparkSession, path: str, **options) -> Delivery:
    """Read one file, folder or archive entry; see ``read_deliveries``."""
    return read_deliveries(spark, [path], **options)[0]


def _decoded(raw: DataFrame, blocks: DataFrame, encodings: list[str]) -> DataFrame:
    """Text lines, without the byte-order mark before the first line of a file."""
    at = F.struct("_block", "_at")
    top = stage(blocks.groupBy(*FILE).agg(F.min(F.struct("_block", F.col("_first").alias("_at"))).alias("_top")), "first-lines")
    lines = raw.join(top, FILE)
    utf8 = decode(F.col("value"), UTF8)
    utf8 = F.when(at == F.col("_top"), F.ltrim(utf8, F.lit("\ufeff"))).otherwise(utf8)
    if CP1252 not in encodings:
        value = utf8
    else:
        other = F.array(*[F.lit(k) for k, e in enumerate(encodings) if e != UTF8])
        value = F.when(F.array_contains(other, F.col("delivery")), decode(F.col("value"), CP1252)).otherwise(utf8)
    return lines.select("delivery", *LINE_ORDER, value.alias("value"))


def _with_records(lines: DataFrame, quote: str) -> DataFrame:
    """The lines, with those of one record joined in files where a quote is open at the end of a line."""
    files = stage(open_files(lines, quote), "files-with-open-quotes")
    if files.isEmpty():
        return lines
    joined = join_records(lines.join(files, FILE, "left_semi"), quote)
    return stage(lines.join(files, FILE, "left_anti").unionByName(joined), "records")


def _parsed(spark: SparkSession, lines: DataFrame, firsts: DataFrame, layouts: list[_Layout], filters: list, quote: str | None, legacy: bool) -> DataFrame:
    """All lines with their kind and values; a delivery's own columns are the first ones of ``_c0``, ``_c1`` ..."""
    line, at, parts = F.col("value"), F.struct("_block", "_at"), F.col("_parts")
    layout = spark.createDataFrame([(k, x.sep, x.expected, x.kept, x.chars, x.head, filters[k]) for k, x in enumerate(layouts)], _LAYOUT)
    layout = F.broadcast(layout.drop("sep")) if len(layouts) < MOST_NAMES else layout.drop("sep")
    # The header stands in the first line with content of a file; a data row may repeat its text.
    is_head = F.coalesce((line == F.col("_head")) & (at == F.col("_begin")), F.lit(False))
    bare = lambda i: F.ltrim(F.ltrim(text(F.get(parts, F.get("_kept", i)))), F.col("_chars"))
    value = lambda i: strip(bare(i)) if legacy else clean(bare(i))
    width = max(len(x.kept) for x in layouts)
    table = lines.join(firsts, FILE, "left").join(layout, "delivery").withColumn("_parts", fields(line, F.col("sep"), quote))
    kind = (
        F.when(is_blank(line), "blank")
        .when(is_head, "header")
        .when(too_long(parts, F.col("_expected")), "rejected")
        .otherwise("row")
    )
    if any(filters):
        passes = F.forall("_filters", lambda f: strip(value(f["at"])) == f["value"])
        kind = F.when((kind == "row") & ~passes, "filtered").otherwise(kind)
    table = table.withColumn("_kind", kind)
    shown = F.col("_kind") == "row"
    return table.select(
        "delivery",
        *LINE_ORDER,
        "_kind",
        F.when(F.col("_kind") == "rejected", line).alias("_line"),
        spaced_fields(line, F.col("sep")).alias("_spaced"),
        *[F.when(shown & (F.size("_kept") > i), value(F.lit(i))).alias(f"_c{i}") for i in range(width)],
    ).where("_kind IN ('row', 'rejected') OR (_kind = 'filtered' AND _spaced > 0)")


def _rejected(staged: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(line_no, line)`` with the number of the line, or of its first one, in the file.

    Lines are numbered within their block when scanned; the lines of the blocks
    before are added from one row per block.
    """
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    line_no = F.col("_before") + F.col("_at") - F.col("_first") + 1
    rejected = staged.where("_kind = 'rejected'").select(*LINE_ORDER, "_line")
    return rejected.join(starts, ["_file", "_block"]).select(line_no.alias("line_no"), F.col("_line").alias("line"))
