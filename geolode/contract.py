"""What a schema says about its fields: geometry encoding, dimensions, SRID and CRS, checked for agreement."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolode.errors import EngineError

PREFIX = "geolode."
VERSION = "1"
TYPES = (
    "Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection", "CircularString", "CompoundCurve", "CurvePolygon", "MultiCurve", "MultiSurface",
    "PolyhedralSurface", "Tin", "Triangle", "Geometry",
)
CHOICES = {
    "encoding": {"wkb", "ewkb"},
    "dimensions": {"xy", "xyz", "xym", "xyzm", "unknown"},
    "types_declaration": {"exact", "mixed", "unresolved"},
    "spatial_semantics": {"geometry", "geography"},
    "precision": {"float64", "float32", "native"},
    "axis_order": {"easting_northing", "northing_easting", "longitude_latitude", "latitude_longitude", "other", "unknown"},
    "crs_definition_format": {"wkt", "wkt2", "projjson"},
    "crs_resolution": {"resolved", "declared_unresolved", "missing"},
}
NEEDED = ("encoding", "dimensions", "types_declaration", "crs_resolution", "spatial_semantics", "precision")
#: Authority codes that transformations and checks know.
KNOWN_SRIDS = {4326, 3857, 4258, 3003, 3004, *range(32601, 32661), *range(32701, 32761)}


def _bad(message: str, category: str = "schema") -> EngineError:
    return EngineError(category, message)


def geometry(srid: int | None = None, dimensions: str = "xy", types: tuple[str, ...] = (), semantics: str = "geometry", encoding: str = "ewkb") -> dict:
    """A geometry field's metadata; an unknown SRID stays unknown."""
    out = {"encoding": encoding, "dimensions": dimensions, "types_declaration": "exact" if types else "unresolved", "spatial_semantics": semantics, "precision": "float64"}
    if types:
        out["types"] = ",".join(sorted(types, key=TYPES.index))
    if srid is None:
        out["crs_resolution"] = "missing"
    else:
        out |= {"srid": str(srid), "crs_resolution": "resolved" if srid in KNOWN_SRIDS else "declared_unresolved"}
        if srid in KNOWN_SRIDS:
            out |= {"crs_id": f"EPSG:{srid}", "axis_order": "longitude_latitude" if srid in (4326, 4258) else "easting_northing"}
    return {PREFIX + "contract.version": VERSION, "ARROW:extension:name": "geoarrow.wkb"} | {f"{PREFIX}geometry.{k}": v for k, v in out.items()}


def keys(field: T.StructField) -> dict[str, str]:
    lead = PREFIX + "geometry."
    return {k.removeprefix(lead): v for k, v in field.metadata.items() if k.startswith(lead)}


def is_spatial(field: T.StructField) -> bool:
    return bool(keys(field)) or field.metadata.get("ARROW:extension:name") == "geoarrow.wkb"


def check_field(field: T.StructField) -> None:
    """Raises where a field's metadata is unknown, incomplete or at odds with itself."""
    own = keys(field)
    if not own:
        return
    if field.metadata.get(PREFIX + "contract.version") != VERSION:
        raise _bad(f"{field.name}: geometry keys without this contract's version")
    if not isinstance(field.dataType, T.BinaryType):
        raise _bad(f"{field.name}: a geometry must be binary")
    for k, v in own.items():
        if k in CHOICES and v not in CHOICES[k]:
            raise _bad(f"{field.name}: unknown {k}")
    if missing := [k for k in NEEDED if k not in own]:
        raise _bad(f"{field.name}: {missing[0]} is missing")
    types = own.get("types", "").split(",") if own.get("types") else []
    if any(t not in TYPES for t in types) or sorted(set(types), key=TYPES.index) != types:
        raise _bad(f"{field.name}: types must be known, in order and once each")
    if own["types_declaration"] == "exact" and not types or own["types_declaration"] == "unresolved" and types:
        raise _bad(f"{field.name}: types at odds with their declaration")
    if ("crs_definition" in own) != ("crs_definition_format" in own):
        raise _bad(f"{field.name}: a CRS definition goes with its format", "crs")
    if ("crs_id" in own or "crs_definition" in own) and "axis_order" not in own:
        raise _bad(f"{field.name}: a CRS without an axis order", "crs")
    if own["crs_resolution"] == "missing" and any(k in own for k in ("crs_id", "crs_definition", "axis_order")):
        raise _bad(f"{field.name}: a missing CRS with CRS keys", "crs")
    if own["crs_resolution"] == "resolved" and not ("crs_id" in own or "crs_definition" in own):
        raise _bad(f"{field.name}: a resolved CRS without an id or definition", "crs")
    srid = own.get("srid")
    if srid is not None and not srid.isdigit():
        raise _bad(f"{field.name}: an SRID must be a number", "crs")
    if own.get("crs_id", "").startswith("EPSG:") and srid is not None and own["crs_id"] != f"EPSG:{srid}":
        raise _bad(f"{field.name}: SRID and CRS id differ", "crs")


def check_schema(schema: T.StructType) -> None:
    seen = set()
    for f in schema.fields:
        if not f.name:
            raise _bad("a result column without a name")
        if f.name in seen:
            raise _bad(f"two result columns named {f.name}")
        seen.add(f.name)
        check_field(f)


def fingerprint(schema: T.StructType) -> str:
    return hashlib.sha256(schema.json().encode()).hexdigest()


def mark(df: DataFrame, column: str, **declared) -> DataFrame:
    """``df`` with a geometry column's metadata, in place of what an earlier contract said."""
    other = {k: v for k, v in df.schema[column].metadata.items() if not k.startswith(PREFIX + "geometry.")}
    return df.withMetadata(column, other | geometry(**declared))


def arrow_schema(schema: T.StructType):
    """Spark's Arrow schema with each field's metadata, which Spark's own conversion drops."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    plain = to_arrow_schema(schema)
    text = lambda m: {k.encode(): str(v).encode() for k, v in m.items()}
    return pa.schema([f.with_metadata(text(s.metadata)) if s.metadata else f for f, s in zip(plain, schema.fields, strict=True)])


def profile(df: DataFrame, column: str) -> dict:
    """One pass over a geometry column: its SRIDs, dimensions and types, and whether each is uniform."""
    from geolode.functions import spatial

    spark, c = df.sparkSession, F.col(f"`{column}`")
    facts = df.select(*[spatial.call(spark, f, c).alias(f) for f in ("srid", "dimensions", "geometry_type")])
    r = facts.agg(
        F.count("srid").alias("n"), F.min("srid").alias("least"), F.max("srid").alias("most"), F.min("dimensions").alias("flat"), F.max("dimensions").alias("deep"), F.collect_set("geometry_type").alias("types")
    ).first()
    if r.n and r.least != r.most:
        raise _bad(f"{column}: several SRIDs", "crs")
    if r.n and r.flat != r.deep:
        raise _bad(f"{column}: several dimensions")
    return {"cells": r.n, "srid": r.least or None, "dimensions": r.flat, "types": sorted(t.removeprefix("ST_") for t in r.types)}
