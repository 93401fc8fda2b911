"""Readers and writers for the files of an inspection: photos, JSON documents, footprints, depth arrays, labels."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys of a capture session that count.
SESSION_KEYS = ("capture_session", "capture_distance_m", "distance_measurement_method", "battery_sequence", "precision_zone_of", "capture_date", "building_block", "building_side", "weather", "lighting_condition", "notes", "image_original_preserved", "reference_scale_available")


def photo_files(spark: SparkSession, folder: str, *, content: bool = False) -> DataFrame:
    """JPEG files below ``folder``, but not below its output folder, with length and, if asked for, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = files.filter(F.col("path").rlike(r"(?i)\.jpe?g$") & ~F.col("path").contains("/output/"))
    return found.select("path", "modificationTime", "length", *(["content"] if content else []))


def xmp_attributes(content: pd.Series) -> pd.Series:
    """Attributes of the XMP packet by local name; none if there is no packet or it is damaged."""
    from xml.etree import ElementTree

    out = []
    for raw in content:
        found: dict[str, str] = {}
        start, end = bytes(raw or b"").find(b"<x:xmpmeta"), bytes(raw or b"").find(b"</x:xmpmeta>")
        if 0 <= start < end:
            try:
                for node in ElementTree.fromstring(bytes(raw)[start : end + 12]).iter():
                    found.update({k.rpartition("}")[2]: v for k, v in node.attrib.items()})
            except ElementTree.ParseError:
                found = {}
        out.append(found)
    return pd.Series(out)


def xmp(content: Column) -> Column:
    return F.pandas_udf(xmp_attributes, "map<string,string>")(content)


def location(attributes: Column) -> Column:
    """struct<lat, lon, alt> of XMP attributes; the longitude is known by two spellings."""
    number = lambda *names: F.coalesce(*(attributes[n].try_cast("double") for n in names))
    return F.struct(number("GpsLatitude").alias("lat"), number("GpsLongitude", "GpsLongtitude").alias("lon"), number("AbsoluteAltitude").alias("alt"))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document per file, path and document; damaged ones and a byte order mark do no harm: the former are null."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.from_json(F.regexp_replace("value", "^\ufeff", ""), schema).alias("document"))


def session_columns(spark: SparkSession, path: str) -> dict[str, str]:
    """The accepted keys of a session file of ``key: value`` lines."""
    pairs = [re.match(r"\s*([\w-]+)\s*:\s*(.*?)\s*$", r.value) for r in spark.read.text(path).collect()]  # a file of a few lines
    return {m[1]: m[2].strip("'\"") for m in pairs if m and m[1] in SESSION_KEYS}


def footprint(spark: SparkSession, path: str) -> DataFrame:
    """ring, ord, x, y of a footprint file: a header naming UTM, then per ring its number of vertices and their lines. Rings come
    out counter-clockwise."""
    lines = [r.value for r in spark.read.text(path).collect()]  # a building's outline
    if not lines or "UTM" not in lines[0].upper().split():
        raise ValueError("a footprint must be in UTM")
    rows, at, ring = [], 1, 0
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        n = int(lines[at].split()[0])
        points = np.array([list(map(float, x.split()[:2])) for x in lines[at + 1 : at + 1 + n]])
        turned = (points[:, 0] * np.roll(points[:, 1], -1) - np.roll(points[:, 0], -1) * points[:, 1]).sum() < 0
        rows += [(ring, k, float(x), float(y)) for k, (x, y) in enumerate(points[::-1] if turned else points)]
        at, ring = at + 1 + n, ring + 1
    return spark.createDataFrame(rows, "ring int, ord int, x double, y double")


def depth_samples(files: DataFrame) -> DataFrame:
    """path, v, u, z of dense depth arrays (path, content): a header width&height&channels&, then floats by column; 0 is unknown."""

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                head = re.match(rb"(\d+)&(\d+)&(\d+)&", content)
                if not head:
                    continue
                w, h = int(head[1]), int(head[2])
                z = np.frombuffer(content, "<f4", count=w * h, offset=head.end()).reshape(h, w)
                v, u = np.nonzero(z > 0)
                yield pd.DataFrame({"path": path, "v": v.astype("int32"), "u": u.astype("int32"), "z": z[v, u]})

    return files.select("path", "content").mapInPandas(read, "path string, v int, u int, z float")


def point_cloud(files: DataFrame) -> DataFrame:
    """path, x, y, z of binary or text PLY files (path, content)."""
    kinds = {"float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8", "uchar": "u1", "uint8": "u1", "char": "i1", "int": "<i4", "int32": "<i4", "uint": "<u4", "short": "<i2", "ushort": "<u2"}

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                end = content.find(b"end_header")
                if end < 0:
                    continue
                head = content[:end].decode("ascii", "replace")
                count = re.search(r"element vertex (\d+)", head)
                fields = re.findall(r"property (\w+) (\w+)", head.partition("element vertex")[2].partition("element")[0])
                body = content[content.index(b"\n", end) + 1 :]
                if not count or not fields:
                    continue
                if "format ascii" in head:
                    table = np.loadtxt(body.decode().splitlines()[: int(count[1])], ndmin=2)
                    columns = {name: table[:, k] for k, (_, name) in enumerate(fields)}
                else:
                    table = np.frombuffer(body, np.dtype([(name, kinds[kind]) for kind, name in fields]), count=int(count[1]))
                    columns = {name: table[name] for _, name in fields}
                yield pd.DataFrame({"path": path, **{k: np.asarray(columns[k], float) for k in "xyz"}})

    return files.select("path", "content").mapInPandas(read, "path string, x double, y double, z double")


def write_catalog(photos: DataFrame, path: str) -> None:
    """Flat Parquet; Spark's commit keeps the former table until the new one is whole."""
    photos.write.mode("overwrite").parquet(path)


def write_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_labels(lines: DataFrame, path: str) -> None:
    """Label text (split, image, lines) in a folder per split."""
    lines.write.mode("overwrite").partitionBy("split").json(path)
