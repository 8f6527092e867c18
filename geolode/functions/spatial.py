"""The spatial functions as SQL functions of a session, over EWKB cells, and as column expressions."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from geolode import jvm
from geolode.functions.catalog import FUNCTIONS, RETURNS, WINDOWED

PACKAGE = "geolode.geo"
BOX = RETURNS["box"]
OPERATORS = {
    "bounding_box_intersects": "boolean",
    "bounding_box_contains": "boolean",
    "bounding_box_contained_by": "boolean",
    "knn_distance": "double",
    "knn_centroid_distance": "double",
}
_ready: set[tuple[str, int]] = set()


def sql_name(function: str, count: int) -> str:
    return f"geolode_{function}_{count}"


def register(spark: SparkSession) -> None:
    """Registers every function of the catalogue, one SQL function for each number of arguments; a repeat does nothing."""
    key = (spark.sparkContext.applicationId, id(spark))
    if key in _ready:
        return
    jvm.load(spark, Path(__file__).parent / "java", PACKAGE)
    own = [("bbox", (1,), BOX), ("is_box", (1,), "boolean"), ("collect_agg", (1,), "binary"), ("union_agg", (1,), "binary"), ("make_point", (3,), "binary"), ("make_box", (5,), "binary"), ("from_text", (2,), "binary")]
    own += [(k, (2,), v) for k, v in OPERATORS.items()]
    for f in FUNCTIONS.values():
        if f.id in WINDOWED or f.id in ("extent", "as_mvt", "as_geobuf"):
            continue
        counts = tuple(c for c in f.arity if not (f.id in ("collect", "union") and c == 1))
        kind = "array<binary>" if f.id == "subdivide" else RETURNS[f.returns]
        own += [(f.id, (c,), "boolean" if f.id == "relate" and c == 3 else kind) for c in counts]
    for name, counts, kind in own:
        for c in counts:
            jvm.register(spark, sql_name(name, c), f"{PACKAGE}.Geo{c}", kind, name=name)
    _ready.add(key)


def encoder(spark: SparkSession, function: str, layer: str | None = None, extent: int | None = None, geometry: str | None = None, id: str | None = None) -> str:
    """The name of a SQL function from a list of rows to a vector tile or a Geobuf collection."""
    register(spark)
    conf = {k: v for k, v in (("layer", layer), ("extent", extent), ("geometry", geometry), ("id", id)) if v is not None}
    name = f"geolode_{function}_{abs(hash(tuple(sorted(conf.items()))))}"
    jvm.register(spark, name, f"{PACKAGE}.GeoEncode", "binary", name=function, **conf)
    return name


def call(spark: SparkSession, function: str, *args: Column | str) -> Column:
    """A spatial function, operator or ``bbox`` over columns of EWKB cells and numbers."""
    register(spark)
    return F.call_udf(sql_name(function, len(args)), *args)


def point(spark: SparkSession, x: Column | str, y: Column | str, srid: int = 4326) -> Column:
    """EWKB points from two numeric columns."""
    return call(spark, "make_point", x, y, F.lit(srid))


def rectangle(spark: SparkSession, xmin: Column | str, ymin: Column | str, xmax: Column | str, ymax: Column | str, srid: int = 4326) -> Column:
    """EWKB rectangles from four numeric columns."""
    return call(spark, "make_box", xmin, ymin, xmax, ymax, F.lit(srid))


def from_text(spark: SparkSession, text: Column | str, srid: int = 0) -> Column:
    """EWKB from well-known text."""
    return call(spark, "from_text", text, F.lit(srid))
