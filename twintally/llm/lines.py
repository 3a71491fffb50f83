"""Near-duplicate lines by a deletion-neighbourhood join.

Lines are compared by their words, lower-cased in ASCII, whatever white space is between them. A line with a word goes if an
earlier line is equal. The edit bound of other pairs grows with their length: lines of ``NEAR_WORDS`` words or more also go
if an earlier such line is within one word edit (a word inserted, deleted or replaced), and lines of fewer words, but at
least ``NEAR_CHARACTERS`` characters (with one space between words), if an earlier such line is within one character edit;
that covers scripts without spaces. What is counted, words or characters, are a line's *units*. Below these lengths the
bound is zero. Earlier means: lower document id (null last), then row, then line.

1. Equal lines are aggregated to their first place.
2. Two lines within one edit have the first or the last half of the units in common. Lines that share a half with no other
   line have no neighbour and emit nothing.
3. The others emit a hashed key for every variant with one unit deleted, with the place of the deletion, and one for
   the whole line. Lines with an equal variant at an equal place differ in that unit; a variant equal to a whole line is
   one unit longer. The earliest line of each key is a plain aggregate, so no pairs within a key are formed.
4. The edit distance of each line to the earliest neighbour found is verified on the units.
5. Tasks cut the lines out of the texts, in one pass over each text.

Defined results: null and empty texts stay; a repeated row counts as a later document; white space of kept lines is kept;
columns of ``docs`` named ``n_lines`` or ``n_dropped`` are replaced, others may have any name; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintally.llm.frames import numbered
from twintally.llm.words import LINES, LOWER, LOWER_VALUES, SPACED, hash_runs, map_batches, mix, runs, slices
from twintally.sources.staging import scratch, stage

NEAR_WORDS = 10
NEAR_CHARACTERS = 32
#: Keeps the hashes of characters apart from those of words.
BY_CHARACTER = np.uint64(1 << 40)
STEP = np.uint64(0xD1342543DE82EF95)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
#: At most so many rows with at most so many lines together are broadcast, about 40 MB; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_LINES = 1_000_000
ROW, GONE, COUNT = "__line_row", "__lines_gone", "__lines"


def powers(n: int, base: np.uint64 = STEP) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text and number of each line with a word, its first word, the word after its last, and all word hashes.

    A line's number counts every line of the text from 0, empty ones too.
    """
    breaks = np.concatenate(([0], np.cumsum(~LINES[data])))
    first, end, _ = runs(data, offsets, SPACED)
    line_first, _, line_doc = runs(data, offsets, LINES)
    number = breaks[line_first] - breaks[offsets[line_doc]]
    begin = np.searchsorted(first, line_first)
    after = np.append(begin[1:], len(first))
    some = np.flatnonzero(after > begin)
    return line_doc[some], number[some], begin[some], after[some], hash_runs(data, first, end, LOWER_VALUES), first, end


def characters(lower: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points of the words with one space between them."""
    text = b" ".join(lower[x:y].tobytes() for x, y in zip(first, end)).decode(errors="replace")
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def spelled(lower: np.ndarray, begin: np.ndarray, after: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which lines are compared by characters, and the code points of each."""
    few = (after - begin) < NEAR_WORDS
    # A character has four bytes at most, so shorter lines can be left out by their bytes, and none has more characters than bytes.
    few &= end[after - 1] - first[begin] >= NEAR_CHARACTERS
    own = np.flatnonzero(few)
    points = [characters(lower, first[begin[j] : after[j]], end[begin[j] : after[j]]) for j in own.tolist()]
    enough = [len(x) >= NEAR_CHARACTERS for x in points]
    return own[np.array(enough, bool)], [x for x, good in zip(points, enough) if good]


def character_hashes(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + BY_CHARACTER)


def halves(sums: np.ndarray, begin: np.ndarray, after: np.ndarray, inverse: np.ndarray, salt: int = 7) -> list[np.ndarray]:
    """Four keys of each line: its first and last half, as the shorter and as the longer one of a pair.

    If the shorter line has n units, the pair shares its first n // 2 units or its last n - n // 2.
    """
    keys = []
    for less in (0, 1):
        n = after - begin - less
        head = n // 2
        for kind, lo, hi in ((0, begin, begin + head), (1, after - (n - head), after)):
            part = (sums[hi] - sums[lo]) * inverse[lo]
            keys.append(mix(part + (2 * n + kind).astype(np.uint64) * LOWER_VALUES[salt]))
    return keys


def running(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of hashes times powers, and the inverse powers; from both the hash of any run follows."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes) + 1)[: len(hashes)], out=sums[1:])
    return sums, powers(len(hashes) + 1, BACK)


def find_lines(rows: DataFrame) -> DataFrame:
    """(row, id, line, hash, keys) of every line with a word; those with an edit bound above zero have keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(2)):
                doc, number, begin, after, hashes, first, end = lines_of(data, offsets)
                sums, inverse = running(hashes)
                whole = mix((sums[after] - sums[begin]) * inverse[begin])
                keys = np.stack(halves(sums, begin, after, inverse), axis=1).view(np.int64)
                near = (after - begin) >= NEAR_WORDS
                own, points = spelled(LOWER[data], begin, after, first, end)
                if len(own):
                    length = np.array([len(x) for x in points])
                    sums, inverse = running(character_hashes(np.concatenate(points)))
                    stop = np.cumsum(length)
                    keys[own] = np.stack(halves(sums, stop - length, stop, inverse, 8), axis=1).view(np.int64)
                    near[own] = True
                at = np.concatenate(([0], np.cumsum(4 * near)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(doc)),
                        batch.column(1).slice(a, b - a).take(pa.array(doc)),
                        pa.array(number, pa.int32()),
                        pa.array(whole.view(np.int64), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys[near].ravel(), pa.int64())),
                    ],
                    ["row", "id", "line", "hash", "keys"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"row bigint, id {kind}, line int, hash bigint, keys array<bigint>")


def variants(wanted: DataFrame) -> DataFrame:
    """(hash, units, keys) of the wanted lines of rows (text, lines: (line, hash)).

    The first key is that of the whole line, the k-th one after it that without the k-th unit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(0)):
                doc, number, begin, after, hashes, first, end = lines_of(data, offsets)
                place = {key: k for k, key in enumerate(zip(doc.tolist(), number.tolist()))}
                lower = LOWER[data]
                out: dict[str, list] = {"hash": [], "units": [], "keys": []}
                for k, lines in enumerate(batch.column(1).slice(a, b - a).to_pylist()):
                    for line in lines:
                        j = place[k, line["line"]]
                        own = slice(begin[j], after[j])
                        if after[j] - begin[j] >= NEAR_WORDS:
                            units = hashes[own]
                            out["units"].append([lower[x:y].tobytes().decode(errors="replace") for x, y in zip(first[own], end[own])])
                        else:
                            points = characters(lower, first[own], end[own])
                            units = character_hashes(points)
                            out["units"].append(list(points.tobytes().decode("utf-32-le")))
                        terms = units * powers(len(units))
                        before = np.cumsum(terms) - terms
                        total = terms.sum()
                        keys = np.concatenate(([total], before + (total - before - terms) * BACK))
                        out["hash"].append(line["hash"])
                        out["keys"].append(mix(keys).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["hash"], pa.int64()), pa.array(out["units"], pa.list_(pa.string())), pa.array(out["keys"], pa.list_(pa.int64()))], ["hash", "units", "keys"]
                )

    return map_batches(wanted, run, "hash bigint, units array<string>, keys array<bigint>")


def one_edit(x: Column, y: Column) -> Column:
    """Whether two arrays of units differ by at most one inserted, deleted or replaced unit."""
    shorter = F.when(F.size(x) <= F.size(y), x).otherwise(y)
    longer = F.when(F.size(x) <= F.size(y), y).otherwise(x)
    n, more = F.size(shorter), F.size(longer) - F.size(shorter)
    differs = F.array_position(F.zip_with(shorter, F.slice(longer, F.lit(1), n), lambda a, b: a != b), True).cast("int")
    rest = F.slice(longer, differs + 1, F.size(longer)) == F.slice(shorter, differs + F.when(more == 0, 1).otherwise(0), F.size(longer))
    return (more <= 1) & ((differs == 0) | F.coalesce(F.when(differs > 0, rest), F.lit(False)))


def order(id_col: str = "id") -> Column:
    """What is earlier is less; a null id is last."""
    return F.struct(F.col(id_col).isNull().alias("last"), id_col, "row", "line")


def near_lines(lines: DataFrame, first: DataFrame, rows: DataFrame) -> DataFrame:
    """(hash) of the distinct lines that have an earlier line within one edit."""
    keys = first.select("hash", F.explode("keys").alias("key"))
    repeated = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    lonely_not = keys.join(repeated, "key", "left_semi").select("hash").distinct()
    places = first.join(lonely_not, "hash", "left_semi").select("hash", "first")
    places = stage(places, "lines-with-a-half-in-common")
    wanted = places.groupBy(F.col("first.row").alias("own")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "hash")).alias("lines"))
    wanted = stage(wanted, "wanted-lines")
    n_rows, n_lines = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()
    wanted = F.broadcast(wanted) if n_rows <= BROADCAST_ROWS and n_lines <= BROADCAST_LINES else wanted
    found = stage(variants(rows.join(wanted, F.col("row") == F.col("own")).select("text", "lines")), "variants")
    emitted = found.join(places, "hash").select("hash", "first", F.posexplode("keys").alias("place", "key"))
    line = F.struct("first", "hash")
    earliest = emitted.groupBy("key", "place").agg(F.min(line).alias("same"))
    earliest = stage(earliest, "earliest")
    by_key = earliest.groupBy("key").agg(F.min(F.when(F.col("place") > 0, F.col("same"))).alias("cut"), F.min(F.when(F.col("place") == 0, F.col("same"))).alias("whole"))
    by_key = by_key.where("cut IS NOT NULL")
    met = emitted.join(earliest, ["key", "place"]).join(by_key, "key")
    partner = F.when(F.col("place") == 0, F.col("cut")).otherwise(F.least("same", F.coalesce("whole", "same")))
    met = met.withColumn("partner", partner).where(F.col("partner.first") < F.col("first"))
    pairs = stage(met.groupBy("hash").agg(F.min("partner").alias("partner")), "line-pairs")
    x = found.select("hash", F.col("units").alias("x"))
    y = found.select(F.col("hash").alias("other"), F.col("units").alias("y"))
    pairs = pairs.select("hash", F.col("partner.hash").alias("other")).join(x, "hash").join(y, "other")
    return pairs.where(one_edit(F.col("x"), F.col("y"))).select("hash")


def cut_lines(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` whose texts lose the lines with the numbers in ``GONE``, in one pass over each text."""
    place, gone = rows.columns.index(text_col), rows.columns.index(GONE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(gone)
            changed = np.flatnonzero(numbers.is_valid().to_numpy(zero_copy_only=False))
            if len(changed):
                texts = batch.column(place).to_pylist()
                for k in changed.tolist():
                    out = set(numbers[k].as_py())
                    texts[k] = "\n".join(line for j, line in enumerate(texts[k].split("\n")) if j not in out)
                columns = list(batch.columns)
                columns[place] = pa.array(texts, batch.schema.field(place).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return map_batches(rows, run, rows.schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", of_files: bool = False) -> DataFrame:
    """``docs`` with shortened texts, ``n_lines`` (with a word, before) and ``n_dropped``. ``of_files``: see ``numbered``."""
    docs = docs.drop("n_lines", "n_dropped")
    numbers = numbered(docs, ROW, of_files)
    rows = numbers.select(F.col(ROW).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    with scratch(docs.sparkSession):
        lines = stage(find_lines(rows), "lines")
        # The keys of equal lines are equal.
        first = lines.groupBy("hash").agg(F.min(order()).alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys"))
        first = stage(first, "first-lines")
        with scratch(docs.sparkSession):
            near = stage(near_lines(lines, first, rows), "near-lines", keep=True).withColumn("near", F.lit(True))
        changed = first.join(near, "hash", "left").where("n > 1 OR near").select("hash", "first", F.coalesce("near", F.lit(False)).alias("near"))
        gone = lines.drop("keys").join(changed, "hash").where(F.col("near") | (order() != F.col("first")))
        gone = gone.groupBy(F.col("row").alias(ROW)).agg(F.collect_list("line").alias(GONE))
        counts = lines.groupBy(F.col("row").alias(ROW)).agg(F.count("*").alias(COUNT))
        # All that the result needs of the lines.
        found = stage(counts.join(gone, ROW, "left"), "lines-of-rows", keep=True)
    found = numbers.join(found, ROW, "left").withColumn(text_col, F.col(text_col).cast("string"))
    out = cut_lines(found.select(*docs.columns, COUNT, GONE), text_col)
    return out.select(*docs.columns, F.coalesce(COUNT, F.lit(0)).cast("bigint").alias("n_lines"), F.greatest(F.size(GONE), F.lit(0)).cast("bigint").alias("n_dropped"))
