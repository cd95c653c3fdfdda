"""Scopes of entities, their catalogue tables, extra data, and a text sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import arcs

# Kinds of the scans, names of extra data, and flags.
CURVES = ("LINE", "POLYLINE", "POLYLINE2D", "ARC")
POLYLINES = ("POLYLINE", "POLYLINE2D")
LINEAR = ("LINE", "POLYLINE")
ISLAND, PARCEL, FLAG = "340099", "300000", "SOUTH"


def shown(layers: DataFrame) -> DataFrame:
    """Layers neither off nor frozen."""
    return layers.where("NOT is_off AND NOT is_frozen")


def by_layers(entities: DataFrame, layers: DataFrame, names: str = "*") -> DataFrame:
    """Entities on shown layers, of comma-separated names if any are given."""
    seen = shown(layers)
    if names not in ("", "*"):
        seen = seen.where(F.col("layer").isin([n.strip() for n in names.split(",")]))
    return entities.join(seen.select("layer_id"), "layer_id", "left_semi")


def visible(entities: DataFrame, layers: DataFrame, kinds: tuple[str, ...] | None = POLYLINES) -> DataFrame:
    """Visible entities of some kinds on shown layers; without a column ``visible`` all are."""
    out = by_layers(entities, layers)
    if "visible" in entities.columns:
        out = out.where(F.coalesce("visible", F.lit(True)))
    return out if kinds is None else out.where(F.col("kind").isin(*kinds))


def scope(
    entities: DataFrame, layers: DataFrame, selected: DataFrame | None = None, kinds: tuple[str, ...] = POLYLINES, fixed: DataFrame | None = None
) -> DataFrame:
    """What a check looks at: the selected ids if there are any, else all visible entities of the kinds; never the ``fixed`` ids."""
    if selected is not None and not selected.isEmpty():
        out = entities.join(selected.select("id").distinct(), "id", "left_semi")
    else:
        out = visible(entities, layers, kinds)
    return out if fixed is None else out.join(fixed.select("id").distinct(), "id", "left_anti")


def wkt(v: Column, closed: Column | bool, digits: int = 3) -> Column:
    """The chords as well-known text; a closed curve of three points or more is a polygon."""
    text = lambda p: F.format_string(f"%.{digits}f %.{digits}f", p["x"] + 0.0, p["y"] + 0.0)
    shut = (F.lit(closed) if isinstance(closed, bool) else closed) & (F.size(v) >= 3)
    points = F.transform(v, text)
    ring = F.concat(F.lit("POLYGON (("), F.array_join(F.concat(points, F.slice(points, 1, 1)), ", "), F.lit("))"))
    line = F.concat(F.lit("LINESTRING ("), F.array_join(points, ", "), F.lit(")"))
    return F.when(F.size(v) == 1, F.concat(F.lit("POINT ("), points[0], F.lit(")"))).when(shut, ring).otherwise(line)


def write_wkt(entities: DataFrame, path: str, digits: int = 3, step_degrees: float = 15.0) -> None:
    """Entities as Parquet of id, layer_id, kind and wkt, arcs as chords of at most so many degrees."""
    chords = arcs.tessellated(F.col("vertices"), F.col("closed"), step_degrees, digits)
    entities.select("id", "layer_id", "kind", wkt(chords, F.col("closed"), digits).alias("wkt")).write.mode("overwrite").parquet(path)


def with_flag(data: Column, app: str, values: Column) -> Column:
    """Extra data (a map from application to a list of values) with one entry set anew; null data is empty."""
    held = F.coalesce(data, F.create_map().cast("map<string,array<string>>"))
    return F.map_concat(F.map_filter(held, lambda k, _: k != F.lit(app)), F.create_map(F.lit(app), values))


def has_flag(data: Column, value: str, app: str = FLAG) -> Column:
    """Whether the application's list holds the value, whatever its case."""
    held = F.transform(F.try_element_at(data, F.lit(app)), lambda s: F.lower(s))
    return F.coalesce(F.array_contains(held, value.lower()), F.lit(False))


def is_island(data: Column) -> Column:
    return has_flag(data, ISLAND)


def is_parcel(data: Column) -> Column:
    return has_flag(data, PARCEL)


def is_survey_point(data: Column) -> Column:
    """Whether both a name and a code are there."""
    return F.coalesce(F.map_contains_key(data, F.lit("NAME")) & F.map_contains_key(data, F.lit("CODE")), F.lit(False))


def upserted(table: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those with equal keys; of several changes the last by ``at``, if it has that column."""
    if "at" in changes.columns:
        last = Window.partitionBy(*keys).orderBy(F.desc("at"))
        changes = changes.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "at")
    return table.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes.select(*table.columns))


def without(table: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def group_of(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, group_id, member): the other members of each id's groups."""
    own = groups.join(ids.select("id"), "id")
    return own.join(groups.withColumnRenamed("id", "member"), "group_id").where("id <> member").select("id", "group_id", "member")


def setting(config: DataFrame, key: str, default: str) -> Column:
    """A stored setting as a scalar; one row by key."""
    found = config.where(F.col("key") == key).limit(1).select("value").first()
    return F.lit(found[0] if found and found[0] is not None else default)
