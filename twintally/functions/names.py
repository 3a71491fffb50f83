"""File-name expressions: the keys by which deliveries are paired."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The technical parts of delivery names.
EXTENSION = r"^(.+)\.[^.]+$"
STAMP_WORD = r"\b\d{14}\b"
BLOCK_WORD = r"\b\d{3}L\b"
FAMILY_PREFIX = r"^(DW_)?[DM]_PLZ\w{2}_"
AREA_PREFIX = r"^(DW_)?[DM]_"
STAMP_TAIL = r"\.\d{14}.*$"
DELIVERY_FOLDER = r"\.\d{14}\.\d{14}$"
DELIVERY_ZIP = r"(?i)\.\d{14}\.\d{14}\.zip$"
FAMILY_MARK = "PLZ"


def base_name(path: Column) -> Column:
    """Last component of a path."""
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(base_name(name), EXTENSION, "$1")


def stem_key(name: Column) -> Column:
    """Pairing key: the table name inside a delivery name, without stamps,
    block numbers and area prefixes; the whole stem when nothing is left."""
    whole = F.upper(stem(name))
    key = whole
    for technical in (STAMP_WORD, BLOCK_WORD):
        key = F.regexp_replace(key, technical, "")
    key = F.btrim(F.regexp_replace(key, "[._-]+", "_"), F.lit("_"))
    for prefix in (FAMILY_PREFIX, AREA_PREFIX):
        key = F.regexp_replace(key, prefix, "")
    key = F.btrim(key, F.lit("_"))
    return F.coalesce(F.nullif(key, F.lit("")), whole)


def logical_name(name: Column) -> Column:
    """Stem without the first delivery stamp and all that follows it."""
    return F.rtrim(F.regexp_replace(stem(name), STAMP_TAIL, ""), F.lit("."))


def short_name(logical: Column) -> Column:
    """Last dotted part of a logical name."""
    return F.element_at(F.split(logical, r"\."), -1)


def family_prefix(name: Column) -> Column:
    """Family of a delivery folder or archive."""
    unstamped = F.regexp_replace(name, STAMP_TAIL, "")
    return F.rtrim(F.regexp_replace(unstamped, r"(?i)\.zip$", ""), F.lit("."))


def family_slot(name: Column, is_zip: Column) -> Column:
    """'asis' for a stamped delivery, 'tobe' otherwise."""
    stamped = F.when(is_zip, name.rlike(DELIVERY_ZIP)).otherwise(name.rlike(DELIVERY_FOLDER))
    return F.when(stamped, F.lit("asis")).otherwise(F.lit("tobe"))
