"""Small text functions of the catalog and the store."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Structure types.
STRUCTURE_TYPES = ("APARTMENT", "DAM", "FACTORY")


def masked_name(name: Column) -> Column:
    """The first two characters, stars for the rest."""
    return F.when(F.length(name) <= 2, F.rpad(F.substring(name, 1, 1), 2, "*")).otherwise(F.rpad(F.substring(name, 1, 2), F.length(name), F.lit("*")))


def structure_type(value: Column) -> Column:
    clean = F.upper(F.trim(value))
    return F.when(clean.isin(*STRUCTURE_TYPES), clean).otherwise("APARTMENT")


def exif_datetime(value: Column) -> Column:
    """2024:01:31 10:20:30 with dashes and a T; other texts pass unchanged."""
    return F.regexp_replace(value, r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}:\d{2}:\d{2})$", "$1-$2-$3T$4")


def facade_parts(facade_id: Column) -> tuple[Column, Column]:
    """(direction, sub-index) of FRONT_2; no index gives null."""
    parts = F.split(facade_id, "_")
    return F.upper(parts[0]), F.try_element_at(parts, F.lit(2)).try_cast("int")


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^\ufeff", "")
