"""Pairing of deliveries by name. Input is a listing ``(name, path, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintally.functions.names import FAMILY_MARK, family_prefix, family_slot, logical_name, short_name, stem_key


def _last_file() -> Column:
    """Of several files with one key the last in listing order counts."""
    return F.max(F.struct("path", "name"))


def _file_columns() -> list[Column]:
    return [F.col(f"{side}.{part}").alias(f"{part}_{side}") for side in "ab" for part in ("name", "path")]


def match_files(a: DataFrame, b: DataFrame, how: str = "left") -> DataFrame:
    """Pairs by stem key: ``(label, name_a, path_a, name_b, path_b)``.

    Every file of a is listed, of b the last one per key. With ``how="full"`` files
    that only b has are listed too.
    """
    left = a.select(stem_key(F.col("name")).alias("label"), F.struct("name", "path").alias("a"))
    right = b.groupBy(stem_key(F.col("name")).alias("label")).agg(_last_file().alias("b"))
    joined = left.join(right, "label", "full_outer" if how == "full" else "left")
    return joined.select("label", *_file_columns())


def match_logical(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs by logical name, files of one side only included."""
    sides = [
        df.groupBy(logical_name(F.col("name")).alias("logical_name")).agg(_last_file().alias(s))
        for df, s in ((a, "a"), (b, "b"))
    ]
    return sides[0].join(sides[1], "logical_name", "full_outer").select(
        "logical_name",
        short_name(F.col("logical_name")).alias("short_name"),
        *_file_columns(),
    )


def find_families(listing: DataFrame, prefix: str | None = None) -> DataFrame:
    """Old and new delivery per family from a listing ``(name, is_zip)`` of folders
    and archives. An archive is preferred to a folder, then the last name counts."""
    upper = F.upper("name")
    listing = listing.where(F.contains(upper, F.lit(FAMILY_MARK)))
    if prefix:
        listing = listing.where(F.contains(upper, F.lit(prefix.upper())))
    slots = listing.select(
        family_prefix(F.col("name")).alias("family"),
        family_slot(F.col("name"), F.col("is_zip")).alias("slot"),
        F.struct("is_zip", "name").alias("rank"),
    )
    best = slots.groupBy("family").pivot("slot", ["asis", "tobe"]).agg(F.max("rank"))
    return best.select("family", F.col("asis.name").alias("asis"), F.col("tobe.name").alias("tobe"))
