"""Queries for the spatial functions that ``queries`` has none for, over lines, bow ties and rectangles whose results have closed forms."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolode.functions import spatial
from geolode.plans import model as m
from geolode.plans.build import all_of, box, cluster, cmp, fn, over, p, q, st, sub
from geolode.plans.parameters import Value
from geolode.queries import _P, _R, SHAPES, X, Y, add_spatial, box_cell, f64, i32, point_cell, query, rects, text


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select("event_id", "event_type", F.expr(X).alias("x"), F.expr(Y).alias("y"))


def _text(spark: SparkSession, kind: str, *points: tuple[str, str]) -> Column:
    """Well-known text of points that are sums over x and y."""
    cells = ", ', ', ".join(f"CAST({a} AS STRING), ' ', CAST({b} AS STRING)" for a, b in points)
    opening, closing = kind.split("*")
    return spatial.from_text(spark, F.expr(f"concat('{opening}', {cells}, '{closing}')"), 3857)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each event, three east and four north, one with a point in its middle that simplifying takes out, and the same moved north."""
    flat = [("x", "y"), ("x + 1", "y"), ("x + 5", "y")]
    line = lambda *c: _text(spark, "LINESTRING (*)", *c)
    return _events(spark, sf_dir).select(
        "event_id",
        line(("x", "y"), ("x + 3", "y"), ("x + 3", "y + 4")).alias("geom"),
        line(*flat).alias("flat"),
        line(*[(a, f"{b} + event_id % 7") for a, b in flat]).alias("moved"),
        _text(spark, "MULTILINESTRING ((*))", ("x", "y"), ("x + 1", "y")).alias("part"),
        spatial.from_text(spark, F.expr("concat('MULTILINESTRING ((', x, ' ', y, ', ', x + 1, ' ', y, '), (', x + 1, ' ', y, ', ', x + 2, ' ', y, '))')"), 3857).alias("parts"),
        _text(spark, "MULTIPOINT (*)", ("x", "y"), ("x", "y"), ("x + 1", "y")).alias("dots"),
        _text(spark, "POLYGON ((*))", ("x", "y"), ("x + 2", "y + 2"), ("x", "y + 2"), ("x + 2", "y"), ("x", "y")).alias("tie"),
    )


def corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in four heaps, far from each other."""
    at = lambda by: F.expr(f"CAST(({by}) % 2 * 1000 AS DOUBLE) + CAST(event_id % 13 AS DOUBLE) / 8")
    return _events(spark, sf_dir).select("event_id", "event_type", spatial.point(spark, at("event_id"), at("event_id DIV 2"), 3857).alias("geom"))


SHAPES |= {"tracks": tracks, "corners": corners}


def solid_cell(x: float, y: float, z: float, srid: int = 4326) -> Value:
    return Value("wkb", b"\x01" + struct.pack("<Iddd", 1001, x, y, z), srid)


add_spatial(
    "spatial_line_points",
    q("tracks", "event_id", (st("x", st("start_point", "geom")), "sx"), (st("y", st("end_point", "geom")), "ey"), (st("x", st("point_n", "geom", p("two"))), "px"), (st("is_closed", "geom"), "closed"), (st("x", st("start_point", st("reverse", "geom"))), "rx"), (st("length", "geom"), "length")),
    f"SELECT event_id, x sx, y + 4 ey, x + 3 px, false AS closed, x + 3 rx, 7.0::DOUBLE length FROM {_P}",
    {"two": i32(2)},
)
add_spatial(
    "spatial_predicates_box",
    q("rects", "p_partkey", (st("within", "geom", p("g")), "inside"), (st("covered_by", "geom", p("g")), "covered"), (st("overlaps", "geom", p("g")), "partly"), (st("contains_properly", "geom", p("c")), "proper")),
    f"SELECT p_partkey, i inside, i covered, o AND NOT i partly, (x < 50 AND x + w > 50 AND y < 5 AND y + h > 5) proper FROM (SELECT *, (x >= 20 AND x + w <= 60 AND y >= -5 AND y + h <= 950) i, (x < 60 AND x + w > 20 AND y < 950 AND y + h > -5) o FROM {_R})",
    {"g": box_cell(20, -5, 60, 950, 3857), "c": point_cell(50, 5, 3857)},
)
add_spatial(
    "spatial_crosses",
    q("tracks", "event_id", where=st("crosses", "geom", p("g"))),
    f"SELECT event_id FROM {_P} WHERE (y > -10.5 AND y < 40.5 AND x < 30.5 AND x + 3 > -20.5 OR x + 3 > -20.5 AND x + 3 < 30.5 AND y < 40.5 AND y + 4 > -10.5) AND NOT (x > -20.5 AND x + 3 < 30.5 AND y > -10.5 AND y + 4 < 40.5)",
    {"g": box_cell(-20.5, -10.5, 30.5, 40.5, 3857)},
)
add_spatial(
    "spatial_simplify",
    q("tracks", "event_id", (st("n_points", "flat"), "before"), (st("n_points", st("simplify", "flat", p("t"))), "plain"), (st("n_points", st("simplify_preserve_topology", "flat", p("t"))), "kept"), (st("x", st("end_point", st("simplify", "flat", p("t")))), "ex")),
    f"SELECT event_id, 3 before, 2 plain, 2 kept, x + 5 ex FROM {_P}",
    {"t": f64(0.1)},
)
add_spatial(
    "spatial_line_work",
    q("tracks", "event_id", (st("y", st("start_point", st("offset_curve", "flat", p("d")))), "oy"), (st("geometry_type", st("line_merge", "parts")), "kind"), (st("n_points", st("line_merge", "parts")), "n"), (st("n_points", st("unary_union", "dots")), "dots")),
    f"SELECT event_id, y + 2 oy, 'ST_LineString' kind, 3 n, 2 dots FROM {_P}",
    {"d": f64(2)},
)
add_spatial(
    "spatial_make_valid",
    q("tracks", "event_id", (st("is_valid", "tie"), "before"), (st("is_valid", st("make_valid", "tie")), "after"), (st("area", st("make_valid", "tie")), "area")),
    f"SELECT event_id, false AS before, true AS after, 2.0::DOUBLE area FROM {_P}",
)
add_spatial(
    "spatial_inner_point",
    q("rects", "p_partkey", (st("contains_properly", "geom", st("point_on_surface", "geom")), "inside"), (st("n_points", st("oriented_envelope", "geom")), "n"), where=cmp(st("area", st("oriented_envelope", "geom")), "gt", p("a"))),
    f"SELECT p_partkey, true AS inside, 5 n FROM {_R} WHERE w * h > 20000.123",
    {"a": f64(20000.123)},
)
add_spatial("spatial_snap_to_grid", q("places", "event_id", where=all_of(cmp(st("x", st("snap_to_grid", "geom", p("s"))), "gt", p("x")), cmp(st("y", st("snap_to_grid", "geom", p("s"))), "lte", p("y")))), f"SELECT event_id FROM {_P} WHERE round(x / 3) * 3 > 31 AND round(y / 3) * 3 <= 20", {"s": f64(3), "x": f64(31), "y": f64(20)})
add_spatial("spatial_distance_3d", q("places", "event_id", (st("distance_3d", st("force_3d", "geom", p("z")), p("g")), "d")), f"SELECT event_id, sqrt((x - 10) * (x - 10) + (y - 20) * (y - 20) + 36) d FROM {_P}", {"g": solid_cell(10, 20, 1), "z": f64(7)})
_FAR = "(greatest(abs(x - 50), abs(x + w - 50)) ** 2 + greatest(abs(y - 5), abs(y + h - 5)) ** 2)"
add_spatial("spatial_max_distance", q("rects", "p_partkey", where=cmp(st("max_distance", "geom", p("g")), "gt", p("d"))), f"SELECT p_partkey FROM {_R} WHERE {_FAR} > 950.123 ** 2", {"g": point_cell(50, 5, 3857), "d": f64(950.123)})
add_spatial("spatial_line_distances", q("tracks", "event_id", (st("hausdorff_distance", "flat", "moved"), "h"), (st("frechet_distance", "flat", "moved"), "f")), f"SELECT event_id, (event_id % 7)::DOUBLE h, (event_id % 7)::DOUBLE f FROM {_P}")
add_spatial("spatial_knn_centroid", q("rects", "p_partkey", where=cmp(box("knn_centroid_distance", "geom", p("g")), "lt", p("d"))), f"SELECT p_partkey FROM {_R} WHERE (x + w / 2 - 50) ** 2 + (y + h / 2 - 5) ** 2 < 480.123 ** 2", {"g": point_cell(50, 5, 3857), "d": f64(480.123)})
add_spatial(
    "spatial_tile_geometry",
    q("places", "event_id", (st("x", st("as_mvt_geom", "geom", p("b"), p("e"))), "tx"), (st("y", st("as_mvt_geom", "geom", p("b"), p("e"))), "ty")),
    f"SELECT event_id, x + 180 tx, 2 * (90 - y) ty FROM {_P}",
    {"b": box_cell(-180, -90, 180, 90), "e": i32(360)},
)
_HEAPS = sub(q("corners", "event_id", (cluster("cluster_k_means", "geom", p("k")), "k")), "r")
add_spatial("spatial_k_means_members", q(_HEAPS, "r.event_id", (over("minimum", "r.event_id", by=["r.k"]), "heap")), "SELECT event_id, min(event_id) OVER (PARTITION BY event_id % 4) heap FROM events", {"k": i32(4)})
_DENSE = sub(q("corners", "event_id", "event_type", (cluster("cluster_dbscan", "geom", p("eps"), p("least"), by=["event_type"]), "k")), "r")
add_spatial(
    "spatial_dbscan_members",
    q(_DENSE, "r.event_id", (over("minimum", "r.event_id", by=["r.event_type", "r.k"]), "heap")),
    "SELECT event_id, min(event_id) OVER (PARTITION BY event_type, event_id % 4) heap FROM events",
    {"eps": f64(3), "least": i32(2)},
)


@query("spatial_subdivide", "SELECT p_partkey, true AS same, true AS small FROM part")
def _subdivide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each rectangle's buffer have its area, and few points each."""
    from geolode.operators.spatial_join import partitions

    # a small file is one task's, but its buffers and cuts are long work: rows are shared out first, by the key that they are summed by
    whole = rects(spark, sf_dir).repartition(partitions(spark), "p_partkey").select("p_partkey", spatial.call(spark, "buffer", "geom", F.lit(5.0)).alias("g"))
    parts = whole.select("p_partkey", spatial.call(spark, "area", "g").alias("a"), F.explode(spatial.call(spark, "subdivide", "g", F.lit(12))).alias("part"))
    sums = parts.groupBy("p_partkey").agg(F.first("a").alias("a"), F.sum(spatial.call(spark, "area", "part")).alias("b"), F.max(spatial.call(spark, "n_points", "part")).alias("n"))
    return sums.select("p_partkey", (F.abs(F.col("a") - F.col("b")) < F.col("a") * 1e-9).alias("same"), (F.col("n") <= 12).alias("small"))


def _encoded(function: str, bag: dict, *args) -> m.Query:
    """One binary for each type of event, and how many shapes went into it."""
    inner = q("places", "event_type", (st("as_mvt_geom", "geom", p("b"), p("e")), "geom"))
    return q(sub(inner, "s"), "s.event_type", (st(function, m.Wildcard(), *args), "data"), (fn("count", m.Wildcard()), "n"), group=["s.event_type"])


@query("spatial_tiles", "SELECT event_type, count(*) n, true AS named, count(*) shapes FROM events GROUP BY 1")
def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector tiles: each begins with a layer (field 3) that holds its name, and has a feature of a known shape for each point."""
    from geolode.engine import Engine
    from geolode.queries import places

    bag = {"b": box_cell(-180, -90, 180, 90), "e": i32(8192), "layer": text("places"), "extent": i32(8192)}
    out = Engine(spark, {"places": places(spark, sf_dir)}).query(_encoded("as_mvt", bag, p("layer"), p("extent")), bag)
    h = F.hex("data")
    # a point feature: type 1 (18 01), then geometry (22), its length, and MoveTo once (09)
    shapes = F.regexp_count(h, F.lit("1801220[3-7]09"))
    return out.select("event_type", "n", (h.startswith("1A") & F.contains(h, F.hex(F.lit("places")))).alias("named"), F.least(shapes.cast("bigint"), F.col("n")).alias("shapes"))


@query("spatial_geobuf", "SELECT event_type, count(*) n, true AS named FROM events GROUP BY 1")
def _geobuf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geobuf: its keys (field 1) come first."""
    from geolode.engine import Engine
    from geolode.queries import places

    bag = {"b": box_cell(-180, -90, 180, 90), "e": i32(8192)}
    out = Engine(spark, {"places": places(spark, sf_dir)}).query(_encoded("as_geobuf", bag), bag)
    return out.select("event_type", "n", (F.hex("data").startswith("0A") & F.contains(F.hex("data"), F.hex(F.lit("event_type")))).alias("named"))
