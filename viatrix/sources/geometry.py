"""Geometry texts as arrays of points, in column expressions."""

from pyspark.sql import Column, functions as F

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def wkt_kind(text: Column) -> Column:
    """POINT, LINESTRING, POLYGON and so on; null if there is no such word."""
    return F.nullif(F.upper(F.regexp_extract(text, r"^\s*(?:SRID=\d+;)?\s*([A-Za-z]+)", 1)), F.lit(""))


def _points(text: Column) -> Column:
    pairs = F.regexp_extract_all(text, F.lit(f"({NUMBER})\\s+({NUMBER})"), F.lit(0))
    point = lambda p: F.struct(F.element_at(F.split(p, r"\s+"), 1).try_cast("double").alias("x"), F.element_at(F.split(p, r"\s+"), 2).try_cast("double").alias("y"))
    return F.transform(pairs, point)


def wkt_points(text: Column) -> Column:
    """Points of a WKT geometry in order, all parts after each other; heights are left out. EMPTY gives none, null null."""
    flat = F.regexp_replace(text, f"({NUMBER})[ \\t]+({NUMBER})(?:[ \\t]+{NUMBER})+", "$1 $2")
    return _points(flat)


def wkt_parts(text: Column) -> Column:
    """An array of points for each ring or line of a WKT geometry."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1)), lambda p: wkt_points(p))


def geojson_points(text: Column) -> Column:
    """Points of a GeoJSON Point or LineString; other kinds and unreadable texts give null."""
    kind = F.get_json_object(text, "$.type")
    at = F.get_json_object(text, "$.coordinates")
    many = F.when(kind == "LineString", at).when(kind == "Point", F.concat(F.lit("["), at, F.lit("]")))
    return F.transform(F.from_json(many, "array<array<double>>"), lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
