"""The result store: upserts, merges, retention, contracts, file lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Labels of building faces.
FACES = {"FRONT": "정면", "BACK": "후면", "LEFT": "좌측면", "RIGHT": "우측면"}

# Result files as (kind, pattern of the name after the face's prefix, keep); the first match counts, and a null kind is
# skipped.
FILE_KINDS = (
    ("report_pdf", r"^report\.pdf$", True),
    ("report_cards", r"^report_cards.*\.json$", False),
    ("mosaic_visual", r"^visual.*\.tif$", False),
    ("mosaic_analysis", r"^analysis.*\.tif$", False),
    ("crack_json", r"^cracks.*\.json$", False),
    ("crack_mask", r"^crack_mask.*\.tif$", False),
    ("crack_review", r"^crack_review\.json$", False),
    ("manual_region", r"^manual_region\.json$", False),
    ("measurement_json", r"^(scale|depth_mapping|structure_type).*\.json$", False),
    ("quality_json", r"^(quality|colmap_report).*\.json$", False),
    (None, r"\.(pdf|tmp|partial)$", False),
    ("other", r"", False),
)


def last_of_key(rows: DataFrame, keys: list[str], ord: str | None = None) -> DataFrame:
    """One row a key: the last by the column ``ord``, or else the greatest by all other columns; in one statement a key is written once."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.col(ord)) if ord else F.max(F.struct(*rest))
    return rows.groupBy(*keys).agg(best.alias("last")).select(*keys, *(F.col("last")[c].alias(c) for c in rest)) if rest else rows.select(*keys).distinct()


def upserted(stored: DataFrame, incoming: DataFrame, keys: list[str], ord: str | None = None) -> DataFrame:
    """Incoming rows replace stored ones of the same key, others are added; of several of a key the last one (by ``ord``) counts."""
    fresh = last_of_key(incoming, keys, ord).select(*stored.columns)
    return stored.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def coalesce_updated(stored: DataFrame, change: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Stored rows with the change's values where those are known."""
    new = change.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    return stored.join(new, key, "left").select(key, *(F.coalesce(f"new_{c}", c).alias(c) for c in columns))


def merged_map(a: Column, b: Column) -> Column:
    """Map concatenation in which the right side wins, whatever the session's rule for duplicate keys is."""
    a, b = F.coalesce(a, F.create_map().cast("map<string,string>")), F.coalesce(b, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def report_state(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """A report generated anew becomes a draft; one of the same time keeps its state; new ones are drafts."""
    old = stored.select(key, F.col("generated_at").alias("old_at"), F.col("state").alias("old_state"), F.lit(True).alias("known"))
    joined = incoming.join(old, key, "full")
    same = F.col("generated_at").eqNullSafe(F.col("old_at"))
    return joined.select(
        key,
        F.when(F.col("fresh"), F.col("generated_at")).otherwise(F.col("old_at")).alias("generated_at"),
        F.when(~F.coalesce("fresh", F.lit(False)), F.col("old_state")).when(F.coalesce("known", F.lit(False)) & same, F.col("old_state")).otherwise("draft").alias("state"),
    )


def retention_due(archives: DataFrame, now: Column) -> DataFrame:
    """Archives whose files may go: cleaned ones, and pending ones past their date."""
    return archives.filter((F.col("status") == "cleaned") | ((F.col("status") == "cleanup_pending") & F.coalesce(F.col("due_at") <= now, F.lit(False))))


def latest_contracts(contracts: DataFrame, requests: DataFrame, faces: DataFrame, key: str) -> DataFrame:
    """Per building the latest contract with its request, and the mapped face where there is one."""
    joined = contracts.join(requests, "request_id").join(faces, "request_id", "left")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("contract_id")))
    return joined.withColumn("rank", rank).filter("rank = 1").drop("rank")


def face_label(mapped: Column, direction: Column) -> Column:
    """The mapped face, else the standard name of the direction."""
    named = F.upper(F.trim(direction))
    standard = reduce(lambda c, kv: c.when(named == kv[0], kv[1]), list(FACES.items())[1:], F.when(named == "FRONT", FACES["FRONT"]))
    return F.coalesce(mapped, standard)


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"([^/\\]*)[/\\]?$", 1)


def file_kind(name: Column, facade: Column) -> tuple[Column, Column]:
    """(kind, keep) of a result file of a face, by its name in lower case; null for files of other faces and for those to skip."""
    prefix = F.concat(F.lower(facade), F.lit("_"))
    rest = F.substr(F.lower(name), F.length(prefix) + 1)
    kind = keep = F
    for k, pattern, kept in FILE_KINDS:
        test = rest.rlike(pattern)
        kind, keep = kind.when(test, F.lit(k).cast("string")), keep.when(test, F.lit(kept if k else None).cast("boolean"))
    own = F.startswith(F.lower(name), prefix)
    return F.when(own, kind), F.when(own, keep)


def next_version(names: DataFrame, group: str, name: str) -> DataFrame:
    """The number after the greatest of V001, V002 ... per group; other names don't count."""
    n = F.nullif(F.regexp_extract(name, r"^V(\d{3,})$", 1), F.lit("")).cast("int")
    return names.groupBy(group).agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next"))


def resolved_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """The file of each wanted name (ignoring case), the candidate of least precedence, then the first path."""
    best = files.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("precedence", "path")).alias("m"))
    return wanted.join(best, F.lower(wanted.name) == best.key, "left").select("name", F.col("m.path").alias("path"))
