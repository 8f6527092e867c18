"""The closed catalogue of spatial functions: category, how many arguments, what they return."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SpatialFunction:
    id: str
    category: str
    arity: tuple[int, ...]
    returns: str

    def boolean(self, count: int) -> bool:
        return self.returns == "boolean" or (self.id == "relate" and count == 3)


#: Each function with its category, the numbers of arguments that it takes, and what it returns.
_ALL = (
    SpatialFunction("geometry_type", "accessor", (1,), "text"),
    SpatialFunction("srid", "accessor", (1,), "integer"),
    SpatialFunction("dimensions", "accessor", (1,), "integer"),
    SpatialFunction("x", "accessor", (1,), "number"),
    SpatialFunction("y", "accessor", (1,), "number"),
    SpatialFunction("z", "accessor", (1,), "number"),
    SpatialFunction("m", "accessor", (1,), "number"),
    SpatialFunction("n_points", "accessor", (1,), "integer"),
    SpatialFunction("n_rings", "accessor", (1,), "integer"),
    SpatialFunction("start_point", "accessor", (1,), "geometry"),
    SpatialFunction("end_point", "accessor", (1,), "geometry"),
    SpatialFunction("point_n", "accessor", (2,), "geometry"),
    SpatialFunction("is_empty", "accessor", (1,), "boolean"),
    SpatialFunction("is_valid", "validation", (1, 2), "boolean"),
    SpatialFunction("is_simple", "validation", (1,), "boolean"),
    SpatialFunction("is_closed", "validation", (1,), "boolean"),
    SpatialFunction("make_valid", "validation", (1, 2), "geometry"),
    SpatialFunction("intersects", "predicate", (2,), "boolean"),
    SpatialFunction("contains", "predicate", (2,), "boolean"),
    SpatialFunction("contains_properly", "predicate", (2,), "boolean"),
    SpatialFunction("within", "predicate", (2,), "boolean"),
    SpatialFunction("covers", "predicate", (2,), "boolean"),
    SpatialFunction("covered_by", "predicate", (2,), "boolean"),
    SpatialFunction("touches", "predicate", (2,), "boolean"),
    SpatialFunction("crosses", "predicate", (2,), "boolean"),
    SpatialFunction("overlaps", "predicate", (2,), "boolean"),
    SpatialFunction("disjoint", "predicate", (2,), "boolean"),
    SpatialFunction("equals", "predicate", (2,), "boolean"),
    SpatialFunction("relate", "predicate", (2, 3), "text"),
    SpatialFunction("d_within", "predicate", (3, 4), "boolean"),
    SpatialFunction("set_srid", "processing", (2,), "geometry"),
    SpatialFunction("transform", "processing", (2, 3), "geometry"),
    SpatialFunction("force_2d", "processing", (1,), "geometry"),
    SpatialFunction("force_3d", "processing", (1, 2), "geometry"),
    SpatialFunction("force_3dm", "processing", (1, 2), "geometry"),
    SpatialFunction("force_4d", "processing", (1, 2, 3), "geometry"),
    SpatialFunction("buffer", "processing", (2, 3), "geometry"),
    SpatialFunction("offset_curve", "processing", (2, 3), "geometry"),
    SpatialFunction("intersection", "processing", (2, 3), "geometry"),
    SpatialFunction("difference", "processing", (2, 3), "geometry"),
    SpatialFunction("sym_difference", "processing", (2, 3), "geometry"),
    SpatialFunction("union", "processing", (1, 2, 3), "geometry"),
    SpatialFunction("unary_union", "processing", (1, 2), "geometry"),
    SpatialFunction("simplify", "processing", (2, 3), "geometry"),
    SpatialFunction("simplify_preserve_topology", "processing", (2,), "geometry"),
    SpatialFunction("centroid", "processing", (1,), "geometry"),
    SpatialFunction("point_on_surface", "processing", (1,), "geometry"),
    SpatialFunction("envelope", "processing", (1,), "geometry"),
    SpatialFunction("convex_hull", "processing", (1,), "geometry"),
    SpatialFunction("oriented_envelope", "processing", (1,), "geometry"),
    SpatialFunction("boundary", "processing", (1,), "geometry"),
    SpatialFunction("line_merge", "processing", (1,), "geometry"),
    SpatialFunction("reverse", "processing", (1,), "geometry"),
    SpatialFunction("subdivide", "processing", (1, 2, 3), "geometry"),
    SpatialFunction("snap_to_grid", "processing", (2, 3, 5), "geometry"),
    SpatialFunction("distance", "measurement", (2, 3), "number"),
    SpatialFunction("distance_3d", "measurement", (2,), "number"),
    SpatialFunction("max_distance", "measurement", (2,), "number"),
    SpatialFunction("hausdorff_distance", "measurement", (2, 3), "number"),
    SpatialFunction("frechet_distance", "measurement", (2, 3), "number"),
    SpatialFunction("azimuth", "measurement", (2,), "number"),
    SpatialFunction("area", "measurement", (1, 2), "number"),
    SpatialFunction("length", "measurement", (1, 2), "number"),
    SpatialFunction("perimeter", "measurement", (1, 2), "number"),
    SpatialFunction("collect", "aggregate", (1, 2), "geometry"),
    SpatialFunction("extent", "aggregate", (1,), "box"),
    SpatialFunction("as_geo_json", "output", (1, 2, 3), "text"),
    SpatialFunction("as_mvt_geom", "output", (2, 3, 4, 5), "geometry"),
    SpatialFunction("as_mvt", "output", (1, 2, 3, 4, 5), "binary"),
    SpatialFunction("as_geobuf", "output", (1, 2), "binary"),
    SpatialFunction("cluster_dbscan", "clustering", (3,), "integer"),
    SpatialFunction("cluster_k_means", "clustering", (2, 3), "integer"),
)
FUNCTIONS = {f.id: f for f in _ALL}

UNARY_PREDICATES = {"is_empty", "is_valid", "is_simple", "is_closed"}
BINARY_PREDICATES = {"intersects", "contains", "contains_properly", "within", "covers", "covered_by", "touches", "crosses", "overlaps", "disjoint", "equals"}
WINDOWED = {"cluster_dbscan", "cluster_k_means"}
#: What a strict profile in the manner of SQL Server accepts.
METHODS = (
    "geometry_type srid dimensions n_points start_point end_point point_n is_empty is_valid is_closed intersects contains within disjoint equals buffer intersection difference "
    "sym_difference union convex_hull distance area length"
).split()


def aggregate(function: str, count: int) -> bool:
    """Whether the function gathers rows with so many arguments."""
    return function in ("extent", "as_mvt", "as_geobuf") or (function in ("collect", "union") and count == 1)


RETURNS = {"text": "string", "integer": "int", "number": "double", "boolean": "boolean", "geometry": "binary", "box": "struct<xmin:double,ymin:double,xmax:double,ymax:double>", "binary": "binary"}
