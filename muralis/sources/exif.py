"""Photo metadata: the EXIF directories of a JPEG or TIFF header, merged with the XMP attributes, nested or flat."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralis.functions.geo import dms_to_degrees
from muralis.functions.text import exif_datetime
from muralis.sources.readers import xmp

# Tags of the image's, the camera's and the position's directory, and those that lead from the first to the others.
IMAGE_TAGS = {0x010F: "Make", 0x0110: "Model", 0x0132: "DateTime"}
CAMERA_TAGS = {0x9003: "DateTimeOriginal", 0x920A: "FocalLength", 0xA405: "FocalLengthIn35mmFilm", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension"}
GPS_TAGS = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 6: "GPSAltitude"}
CAMERA_IFD, GPS_IFD = 0x8769, 0x8825
# Bytes of a value by its kind.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
#: Entries of a directory that are read at most; a damaged count says more.
ENTRIES = 512


def _value(data: bytes, order: str, kind: int, count: int, at: int) -> str | None:
    """A value as text: numbers joined by blanks, fractions as decimals; None where it is damaged."""
    size = SIZES.get(kind, 0) * count
    if not size or at < 0 or at + size > len(data):
        return None
    raw = data[at : at + size]
    if kind == 2:
        return raw.split(b"\0")[0].decode("utf-8", "replace").strip()
    if kind in (5, 10):
        numbers = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
        pairs = list(zip(numbers[::2], numbers[1::2], strict=True))
        return None if any(b == 0 for _, b in pairs) else " ".join(repr(a / b) for a, b in pairs)
    letter = {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}[kind]
    return " ".join(repr(v) for v in struct.unpack(f"{order}{count}{letter}", raw))


def _directory(data: bytes, order: str, at: int, tags: dict[int, str]) -> dict[str, str]:
    found: dict[str, str] = {}
    if not 0 < at <= len(data) - 2:
        return found
    (n,) = struct.unpack_from(f"{order}H", data, at)
    for k in range(min(n, ENTRIES)):
        entry = at + 2 + 12 * k
        if entry + 12 > len(data):
            break
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, entry)
        if tag in tags:
            size = SIZES.get(kind, 0) * count
            place = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", data, entry + 8)[0]
            value = _value(data, order, kind, count, place)
            if value is not None:
                found[tags[tag]] = value
    return found


def tiff_tags(data: bytes) -> dict[str, str]:
    """The known tags of a TIFF header, either byte order; damaged ones are left out."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if not order or len(data) < 8:
        return {}
    (first,) = struct.unpack_from(f"{order}I", data, 4)
    leads = {CAMERA_IFD: "camera", GPS_IFD: "gps"}
    found = _directory(data, order, first, IMAGE_TAGS | leads)
    for lead, tags in (("camera", CAMERA_TAGS), ("gps", GPS_TAGS)):
        at = found.pop(lead, None)
        if at is not None and at.isdigit():
            found |= _directory(data, order, int(at), tags)
    return found


def jpeg_tags(data: bytes) -> dict[str, str]:
    """The tags of a JPEG's EXIF segment and its Width and Height, or the tags of a bare TIFF header."""
    if data[:2] != b"\xff\xd8":
        return tiff_tags(data)
    found: dict[str, str] = {}
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:  # filling
            at += 1
            continue
        if marker in (0xD9, 0xDA):
            break
        if marker in (0x01, *range(0xD0, 0xD9)):
            at += 2
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            found = tiff_tags(body[6:]) | found
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            height, width = struct.unpack_from(">HH", body, 1)
            found |= {"Width": str(width), "Height": str(height)}
        at += 2 + size
    return found


def _tags(content: pd.Series) -> pd.Series:
    return pd.Series([jpeg_tags(bytes(c)) if c is not None else {} for c in content])


def exif(content: Column) -> Column:
    """map<string,string> of the EXIF tags in a file's head; fractions are decimals, lists joined by blanks."""
    return F.pandas_udf(_tags, "map<string,string>")(content)


def photo_metadata(photos: DataFrame) -> DataFrame:
    """One nested row per photo (path, content): XMP values win over EXIF ones, and its position wins as a whole where either of its
    coordinates is there; times are the camera's own. Missing fields are null; nothing is guessed."""
    m = photos.select("path", xmp(F.col("content")).alias("x"), exif(F.col("content")).alias("e"))
    x = lambda k: F.col("x")[k]
    e = lambda k: F.col("e")[k]
    number = lambda v: v.try_cast("double")
    by_xmp = F.map_contains_key("x", F.lit("GpsLatitude")) | F.map_contains_key("x", F.lit("GpsLongtitude"))
    dms = lambda k: dms_to_degrees(*(F.get(F.split(e(k), " "), F.lit(i)).try_cast("double") for i in range(3)), e(f"{k}Ref"))
    either = lambda a, b: F.when(by_xmp, a).otherwise(b)
    pose = lambda who: F.struct(*(number(x(f"{who}{axis}Degree")).alias(f"{axis.lower()}_deg") for axis in ("Yaw", "Pitch", "Roll")))
    parts = F.split("path", "/")
    return m.select(
        F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("image_id"),
        F.col("path").alias("file_path"),
        exif_datetime(F.coalesce(F.nullif(e("DateTimeOriginal"), F.lit("")), F.nullif(e("DateTime"), F.lit("")))).alias("timestamp"),
        F.coalesce(F.nullif(x("Make"), F.lit("")), e("Make")).alias("drone_model"),
        F.coalesce(F.nullif(x("Model"), F.lit("")), e("Model")).alias("camera_model"),
        F.coalesce(e("Width"), e("PixelXDimension")).try_cast("int").alias("width"),
        F.coalesce(e("Height"), e("PixelYDimension")).try_cast("int").alias("height"),
        F.struct(either(number(x("GpsLatitude")), dms("GPSLatitude")).alias("latitude"), either(number(x("GpsLongtitude")), dms("GPSLongitude")).alias("longitude"), either(number(x("AbsoluteAltitude")), number(e("GPSAltitude"))).alias("altitude_m")).alias("gps"),
        pose("Flight").alias("drone_pose"),
        pose("Gimbal").alias("gimbal_pose"),
        F.struct(
            number(e("FocalLength")).alias("focal_length_mm"), number(e("FocalLengthIn35mmFilm")).alias("equivalent_focal_length_mm"), number(x("CalibratedFocalLength")).alias("calibrated_focal_length_px"),
            number(x("CalibratedOpticalCenterX")).alias("calibrated_optical_center_x_px"), number(x("CalibratedOpticalCenterY")).alias("calibrated_optical_center_y_px"), F.lit(False).alias("calibrated"),
        ).alias("camera"),
        F.struct(F.when(F.size(parts) > 1, F.element_at(parts, -2)).alias("flight_id")).alias("mission"),
    )


def flattened(df: DataFrame) -> DataFrame:
    """Every leaf of nested structs as a column of its dotted name."""

    def leaves(kind, at: Column, name: str) -> list[Column]:
        if kind.typeName() != "struct":
            return [at.alias(name)]
        return [leaf for f in kind.fields for leaf in leaves(f.dataType, at[f.name], f"{name}.{f.name}")]

    return df.select(*(leaf for f in df.schema.fields for leaf in leaves(f.dataType, F.col(f"`{f.name}`"), f.name)))
