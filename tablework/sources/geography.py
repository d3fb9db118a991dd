"""GeoJSON features as tables with well-known text, and joins with them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e16 else repr(float(x))


def _points(coordinates, depth: int) -> str:
    """Nested coordinates of that depth: 0 is a point."""
    if depth == 0:
        return " ".join(map(_number, coordinates))
    return ", ".join(_points(c, 0) if depth == 1 else f"({_points(c, depth - 1)})" for c in coordinates)


#: How deep the coordinates of each kind are nested.
DEPTH = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def well_known_text(geometry: dict | None) -> str | None:
    """A GeoJSON geometry as well-known text; null stays null, an unknown kind is an error."""
    if geometry is None:
        return None
    kind = geometry["type"]
    if kind == "GeometryCollection":
        parts = [well_known_text(g) for g in geometry["geometries"]]
        return f"GEOMETRYCOLLECTION ({', '.join(parts)})" if parts else "GEOMETRYCOLLECTION EMPTY"
    if kind not in DEPTH:
        raise ValueError(f"unknown geometry {kind!r}")
    coordinates = geometry["coordinates"]
    if not coordinates:
        return f"{kind.upper()} EMPTY"
    third = coordinates
    for _ in range(DEPTH[kind]):
        third = third[0] if third else []
    name = kind.upper() + (" Z" if len(third) == 3 else "")
    if kind == "MultiPoint":
        return f"{name} ({', '.join(f'({_points(c, 0)})' for c in coordinates)})"
    return f"{name} ({_points(coordinates, DEPTH[kind])})"


def read_geojson(spark: SparkSession, path: str, rename: str = "", keep: list[str] | None = None) -> DataFrame:
    """The features of GeoJSON files, one row each: a column for each property, with types, and geometry as well-known text.

    rename: what the property name is called instead. keep: which properties to keep; unknown ones are passed over. A feature
    without geometry has null there. A file is parsed by one task; features are converted where they lie. A table without
    features has the geometry alone.
    """
    features = spark.read.schema("features array<struct<properties string, geometry string>>").json(path, multiLine=True)
    each = features.select(F.explode("features").alias("f")).select("f.*")
    kind = each.agg(F.schema_of_variant_agg(F.try_parse_json("properties"))).first()[0] or ""
    has = kind.startswith("OBJECT<") and kind != "OBJECT<>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if g is None else well_known_text(json.loads(g)) for g in batch["geometry"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["properties"], pa.array(texts, pa.string())], ["properties", "geometry"])

    rows = each.mapInArrow(run, "properties string, geometry string")
    if not has:
        return rows.select("geometry")
    # a variant's schema is a type but for the name of objects and of what is always null
    known = kind.replace("OBJECT<", "STRUCT<").replace(": VOID", ": STRING")
    rows = rows.select(F.from_json("properties", known).alias("p"), "geometry").select("p.*", "geometry")
    if rename and "name" in rows.columns:
        rows = rows.withColumnRenamed("name", rename)
    return rows.select(*(c for c in keep if c in rows.columns and c != "geometry"), "geometry") if keep else rows


def enrich(df: DataFrame, geo: DataFrame, key: str, geo_key: str) -> DataFrame:
    """df with the columns of geo where the texts of both keys are equal; rows of df without a match have nulls there.

    Null keys match nothing. A feature's key that occurs several times repeats rows of df. Columns of both but the keys get _x
    and _y; a geo key of another name stays as a column.
    """
    for name, table in ((key, df), (geo_key, geo)):
        if name not in table.columns:
            raise ValueError(f"no column {name!r}; there are {', '.join(table.columns)}")
    same = key == geo_key
    clash = {c for c in df.columns if c in geo.columns and not (same and c == key)}
    left = [F.col(f"l.`{c}`").alias(f"{c}_x" if c in clash else c) for c in df.columns]
    right = [F.col(f"r.`{c}`").alias(f"{c}_y" if c in clash else c) for c in geo.columns if not (same and c == key)]
    # columns are packed, so that no name is taken twice before it is told apart
    a = df.select(F.struct(*(f"`{c}`" for c in df.columns)).alias("l"), F.col(f"`{key}`").cast("string").alias("lk"))
    b = geo.select(F.struct(*(f"`{c}`" for c in geo.columns)).alias("r"), F.col(f"`{geo_key}`").cast("string").alias("rk"))
    return a.join(b, F.col("lk") == F.col("rk"), "left").select(*left, *right)


def match_report(df: DataFrame, geo: DataFrame, key: str, geo_key: str) -> DataFrame:
    """(side, value): distinct keys of df that geo lacks (side main), and the other way round (side geo)."""
    a, b = (t.select(F.col(f"`{k}`").cast("string").alias("value")).where("value is not null").distinct() for t, k in ((df, key), (geo, geo_key)))
    return a.join(b, "value", "left_anti").select(F.lit("main").alias("side"), "value").unionByName(b.join(a, "value", "left_anti").select(F.lit("geo").alias("side"), "value"))


def region_totals(df: DataFrame, geo: DataFrame, key: str, geo_key: str, value: str, agg: str = "sum") -> DataFrame:
    """(region, geometry, value): what a map of shaded regions shows; df is aggregated before it meets the features.

    agg: sum, mean, count, min or max. Regions without rows have null, rows without a region don't count.
    """
    how = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}
    if agg not in how:
        raise ValueError(f"unknown aggregate {agg!r}; known: {', '.join(how)}")
    totals = df.groupBy(F.col(f"`{key}`").cast("string").alias("region")).agg(how[agg](f"`{value}`").alias("value"))
    return geo.select(F.col(f"`{geo_key}`").cast("string").alias("region"), "geometry").join(totals, "region", "left")
