"""Queries, reads, streams, writes and inspections through the engine."""

import datetime as dt
import decimal
import json
import threading
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geolode import cli, contract, ewkb
from geolode.cancel import Token
from geolode.engine import Engine
from geolode.errors import CATEGORIES, EngineError, from_spark
from geolode.functions import spatial
from geolode.limits import Budget, ResourceLimits
from geolode.operators import losses, writes
from geolode.operators.clusters import dbscan_labels, k_means_labels
from geolode.operators.spatial_join import spatial_join
from geolode.plans import model as m
from geolode.plans.build import asc, box, c, cmp, desc, eq, fn, join, over, p, preceding, q, setop, st, star, sub, t
from geolode.plans.parameters import Value, decode
from geolode.sources import tables


@pytest.fixture(scope="module")
def events(spark):
    """Ten thousand rows whose values follow from their number."""
    n = F.col("id")
    return spark.range(1, 10_001).select(
        n.alias("event_id"), (n % 20).cast("int").alias("region_id"), F.concat(F.lit("evento-"), n.cast("string")).alias("name"), (n / 1e6).cast("decimal(38,18)").alias("amount"), (n % 2 == 0).alias("active"),
        (F.lit("2025-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n)).alias("occurred_at"), F.date_add(F.lit("2025-01-01").cast("date"), (n % 365).cast("int")).alias("local_date"),
        F.concat(F.lit('{"id":'), n.cast("string"), F.lit(',"kind":"fixture"}')).alias("payload"), F.unhex(F.lpad(F.hex(n), 16, "0")).alias("raw_bytes"), spatial.point(spark, 9 + (n % 100) / 1000, 45 + (n % 100) / 1000).alias("geom"),
    )


@pytest.fixture(scope="module")
def engine(spark, events):
    odd = spark.createDataFrame([(1, "caffè 🗺️", "quoted")], ["select", "spaced column", 'a"b`c'])
    small = spark.createDataFrame([(1, "x", 10), (2, "x", 20), (3, "y", None), (4, None, 5), (5, "y", 5)], "id int, k string, v int")
    made = Engine(spark, {"events": contract.mark(events, "geom", srid=4326, types=("Point",)), "Quoted; Table": odd, "small": small, "none": small.limit(0)})
    yield made
    made.close()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_names_with_quotes_and_semicolons(engine):
    assert rows(engine.query(q("Quoted; Table", "select", "spaced column", 'a"b`c'))) == [(1, "caffè 🗺️", "quoted")]
    assert rows(engine.read(m.Read(m.ObjectRef("Quoted; Table"), ('a"b`c',)))) == [("quoted",)]


def test_values_never_reach_the_text(engine):
    evil = "x' OR 1=1 --"
    assert rows(engine.query(q("small", "id", where=eq("k", p(evil))), {evil: Value("string", evil)})) == []
    assert "1=1" not in repr(Value("string", evil))


@pytest.mark.parametrize(
    ("value", "kind", "want"),
    [
        (Value("bool", True), "boolean", True), (Value("i32", -5), "int", -5), (Value("i64", 1 << 40), "bigint", 1 << 40), (Value("f64", 0.5), "double", 0.5), (Value("string", "é"), "string", "é"), (Value("bytes", b"\0\1"), "binary", bytearray(b"\0\1")),
        (Value("date", "2024-02-29"), "date", dt.date(2024, 2, 29)), (Value("timestamp", "2024-01-02T03:04:05.000006"), "timestamp_ntz", dt.datetime(2024, 1, 2, 3, 4, 5, 6)), (Value("decimal", "-12.50"), "decimal(4,2)", decimal.Decimal("-12.50")),
        (Value("uuid", "00000000-0000-0000-0000-00000000000A"), "string", "00000000-0000-0000-0000-00000000000a"), (Value("json", "{}"), "string", "{}"), (Value("null", "i64"), "bigint", None),
    ],
)
def test_parameter_types(engine, value, kind, want):
    df = engine.query(q("small", (p("x"), "x"), order=["id"], limit=1), {"x": value})
    assert df.dtypes == [("x", kind)] and df.first().x == want


@pytest.mark.parametrize("value", [Value("i32", 1 << 31), Value("i64", True), Value("decimal", "1e5"), Value("uuid", "x"), Value("date", "2024-13-01"), Value("timestamp", "2024-01-01T00:00:00+00:00"), Value("timestamp_tz", "2024-01-01T00:00:00"), Value("what", 1), Value("null", "what")])
def test_bad_parameters(engine, value):
    with pytest.raises(EngineError) as e:
        engine.query(q("small", (p("x"), "x")), {"x": value})
    assert e.value.category == "data_mapping"


def test_missing_parameter_and_unknown_names(engine):
    with pytest.raises(EngineError):
        engine.query(q("small", (p("x"), "x")))
    for query, category in ((q("small", "nope"), "not_found"), (q("nope", "a"), "not_found"), (q("small", "id", fn("count", star)), "invalid_plan")):
        with pytest.raises(EngineError) as e:
            engine.query(query)
        assert e.value.category == category
    with pytest.raises(EngineError) as e:
        engine.read(m.Read(m.ObjectRef("small"), ("nope",)))
    assert e.value.category == "not_found"


def test_filters_may_name_columns_that_are_not_read(engine):
    assert rows(engine.read(m.Read(m.ObjectRef("small"), ("id",), filter=m.FieldEq("v", "x")), {"x": Value("i32", 20)})) == [(2,)]


def test_null_order_by_profile(spark, engine):
    small = engine.table(m.ObjectRef("small"))
    order = lambda profile, o: [r.id for r in Engine(spark, {"small": small}, profile).query(q("small", "id", order=[o, asc("id")])).collect()]
    assert order("postgres", asc("v")) == [4, 5, 1, 2, 3] and order("postgres", desc("v")) == [3, 2, 1, 4, 5]
    assert order("sqlserver", asc("v")) == [3, 4, 5, 1, 2] and order("sqlserver", desc("v")) == [2, 1, 4, 5, 3]
    read = lambda profile, d: [r.id for r in Engine(spark, {"small": small}, profile).read(m.Read(m.ObjectRef("small"), ("id",), (m.FieldOrder("v", d), m.FieldOrder("id")))).collect()]
    assert read("postgres", "asc") == [4, 5, 1, 2, 3] and read("sqlserver", "desc") == [2, 1, 4, 5, 3]


def test_window_rewrites(engine):
    got = engine.query(q("small", "id", (over("row_number"), "n"), (over("rank", order=["v"], frame=("rows", preceding(), m.Bound("current_row"))), "r")))
    assert sorted(r.n for r in got.collect()) == [1, 2, 3, 4, 5]
    groups = engine.query(q("small", "id", (over("sum", "v", order=["v"], frame=("groups", preceding(1), m.Bound("current_row"))), "s"), (fn("lower", "k"), "k"), order=["id"]))
    assert [(r.id, r.s, r.k) for r in groups.collect()] == [(1, 20, "x"), (2, 30, "x"), (3, 20, "y"), (4, 10, None), (5, 10, "y")]
    grouped = engine.query(q("small", "k", (over("sum", fn("count", star), order=["k"], frame=("groups", preceding())), "s"), group=["k"], order=["k"]))
    assert [(r.k, r.s) for r in grouped.collect()] == [("x", 2), ("y", 4), (None, 5)]


def test_distinct_on_with_limit_and_hidden_columns(engine):
    df = engine.query(q("small", "id", distinct_on=["k"], order=[asc("k"), desc("id")], limit=2, offset=1))
    assert df.columns == ["id"] and rows(df) == [(5,), (4,)]


def test_set_precedence_and_outer_order(engine):
    one = lambda i: q("small", "id", where=eq("id", p(f"p{i}")))
    bag = {f"p{i}": Value("i32", i) for i in range(6)}
    df = engine.query(q("small", "id", where=eq("id", p("p1")), sets=[setop("union", one(2)), setop("intersect", one(3))], order=[desc("id")]), bag)
    assert rows(df) == [(1,)]


def test_recursion_without_duplicates_sees_earlier_tables_and_ends(engine):
    step = q("walk", ("s.id", "n"), joins=[join("inner", t("some", "s"), cmp("s.v", "gt", "walk.n"))])
    walk = m.CommonTable("walk", q("some", ("id", "n"), where=eq("id", p("one")), sets=[setop("union", step)]), True)
    some = m.CommonTable("some", q("small", "id", "v"))
    df = engine.query(q("walk", "n", ctes=[some, walk], order=["n"]), {"one": Value("i32", 4)})
    assert rows(df) == [(1,), (2,), (4,), (5,)]


def test_scalar_subquery_of_many_rows_fails(engine):
    with pytest.raises(EngineError) as e:
        engine.run(engine.query(q("small", (m.ScalarSubquery(q("small", "id")), "x"))), Token())
    assert e.value.category == "execution"


def test_row_locks_are_refused(engine):
    with pytest.raises(EngineError) as e:
        engine.query(q("small", "id", locking=m.Lock("update", "wait")))
    assert e.value.category == "unsupported"


def test_filters_and_columns_reach_the_scan(spark):
    eng = Engine(spark, {"lineitem": spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")})
    text = eng.explain(q("lineitem", "l_orderkey", where=cmp("l_quantity", "gt", p("x"))), {"x": Value("f64", 45.0)})
    assert "GreaterThan(l_quantity,45.0)" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
    top = eng.explain(q("lineitem", "l_orderkey", order=[desc("l_extendedprice")], limit=5))
    assert "TakeOrderedAndProject" in top


# spatial


def wkt(spark, *texts, srid=0):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    return df.select("i", spatial.from_text(spark, "t", srid).alias("g"))


def value(spark, function, text, *args, srid=0):
    cols = [F.lit(a) if not isinstance(a, str) or a.startswith("quad") or set(a) <= set("012TF*") else spatial.from_text(spark, F.lit(a), srid) for a in args]
    return wkt(spark, text, srid=srid).select(spatial.call(spark, function, "g", *cols).alias("x")).first().x


SQUARE, HOLE = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"


@pytest.mark.parametrize(
    ("function", "args", "want"),
    [
        ("geometry_type", (HOLE,), "ST_Polygon"), ("n_rings", (HOLE,), 2), ("n_points", (HOLE,), 10), ("area", (HOLE,), 15.0), ("perimeter", (HOLE,), 20.0), ("length", (HOLE,), 0.0), ("length", ("LINESTRING (0 0, 3 4)",), 5.0), ("dimensions", ("POINT Z (1 2 3)",), 3),
        ("z", ("POINT Z (1 2 3)",), 3.0), ("m", ("POINT M (1 2 3)",), 3.0), ("z", ("POINT (1 2)",), None), ("x", ("POINT EMPTY",), None), ("is_empty", ("POINT EMPTY",), True), ("is_closed", ("LINESTRING (0 0, 1 0, 0 0)",), True),
        ("is_simple", ("LINESTRING (0 0, 2 2, 0 2, 2 0)",), False), ("is_valid", ("POLYGON ((0 0, 2 2, 0 2, 2 0, 0 0))",), False), ("intersects", (SQUARE, "POINT (4 4)"), True), ("contains", (SQUARE, "POINT (4 4)"), False), ("covers", (SQUARE, "POINT (4 4)"), True),
        ("contains_properly", (SQUARE, "POINT (2 2)"), True), ("within", ("POINT (2 2)", SQUARE), True), ("covered_by", ("POINT (0 0)", SQUARE), True), ("touches", (SQUARE, "POINT (4 4)"), True), ("crosses", ("LINESTRING (-1 2, 5 2)", SQUARE), True),
        ("overlaps", (SQUARE, "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))"), True), ("disjoint", (SQUARE, "POINT (9 9)"), True), ("equals", (SQUARE, "POLYGON ((4 4, 0 4, 0 0, 4 0, 4 4))"), True), ("relate", (SQUARE, "POINT (2 2)"), "0F2FF1FF2"), ("relate", (SQUARE, "POINT (2 2)", "0********"), True),
        ("d_within", ("POINT (0 0)", "POINT (3 4)", 5.0), True), ("distance", ("POINT (0 0)", "POINT (3 4)"), 5.0), ("distance_3d", ("POINT Z (0 0 0)", "POINT Z (2 3 6)"), 7.0), ("max_distance", (SQUARE, "POINT (0 0)"), 32**0.5), ("hausdorff_distance", ("LINESTRING (0 0, 2 0)", "LINESTRING (0 1, 2 1)"), 1.0),
        ("frechet_distance", ("LINESTRING (0 0, 2 0)", "LINESTRING (0 1, 2 1)"), 1.0), ("azimuth", ("POINT (0 0)", "POINT (1 0)"), 1.5707963267948966), ("azimuth", ("POINT (0 0)", "POINT (0 0)"), None), ("as_geo_json", ("POINT (1.23456 2)", 2), '{"type":"Point","coordinates":[1.23,2]}'),
        ("bounding_box_contains", (SQUARE, "POINT (4 4)"), True), ("knn_centroid_distance", (SQUARE, "POINT (2 5)"), 3.0),
    ],
)
def test_spatial_values(spark, function, args, want):
    got = value(spark, function, *args)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


@pytest.mark.parametrize(
    ("function", "args", "want"),
    [
        ("start_point", ("LINESTRING (1 2, 3 4)",), "POINT (1 2)"), ("end_point", ("LINESTRING (1 2, 3 4)",), "POINT (3 4)"), ("point_n", ("LINESTRING (1 2, 3 4)", 2), "POINT (3 4)"), ("force_2d", ("POINT Z (1 2 3)",), "POINT (1 2)"), ("buffer", ("POINT (0 0)", 1.0, "quad_segs=1"), "POLYGON ((1 0, 0 -1, -1 0, 0 1, 1 0))"),
        ("intersection", (SQUARE, "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))"), "POLYGON ((2 2, 4 2, 4 4, 2 4, 2 2))"), ("difference", ("LINESTRING (0 0, 4 0)", "POLYGON ((1 -1, 2 -1, 2 1, 1 1, 1 -1))"), "MULTILINESTRING ((0 0, 1 0), (2 0, 4 0))"), ("union", ("POINT (0 0)", "POINT (1 1)"), "MULTIPOINT ((0 0), (1 1))"),
        ("sym_difference", ("LINESTRING (0 0, 2 0)", "LINESTRING (1 0, 3 0)"), "MULTILINESTRING ((0 0, 1 0), (2 0, 3 0))"), ("unary_union", ("MULTIPOINT ((0 0), (0 0))",), "POINT (0 0)"), ("simplify", ("LINESTRING (0 0, 1 0.1, 2 0)", 0.5), "LINESTRING (0 0, 2 0)"), ("simplify_preserve_topology", ("LINESTRING (0 0, 1 0.1, 2 0)", 0.5), "LINESTRING (0 0, 2 0)"),
        ("make_valid", ("POLYGON ((0 0, 2 2, 0 2, 2 0, 0 0))",), "MULTIPOLYGON (((1 1, 0 0, 2 0, 1 1)), ((1 1, 2 2, 0 2, 1 1)))"), ("centroid", (SQUARE,), "POINT (2 2)"), ("point_on_surface", (SQUARE,), "POINT (2 2)"), ("envelope", ("LINESTRING (0 0, 2 3)",), "POLYGON ((0 0, 2 0, 2 3, 0 3, 0 0))"),
        ("convex_hull", ("MULTIPOINT ((0 0), (2 0), (1 1), (0 2), (2 2))",), "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"), ("oriented_envelope", ("LINESTRING (0 0, 4 0, 4 1, 0 1)",), "POLYGON ((0 0, 4 0, 4 1, 0 1, 0 0))"), ("boundary", ("LINESTRING (0 0, 2 3)",), "MULTIPOINT ((0 0), (2 3))"),
        ("line_merge", ("MULTILINESTRING ((0 0, 1 0), (1 0, 2 0))",), "LINESTRING (0 0, 1 0, 2 0)"), ("reverse", ("LINESTRING (0 0, 2 3)",), "LINESTRING (2 3, 0 0)"), ("snap_to_grid", ("LINESTRING (0.2 0.1, 0.3 0.2, 2.1 3.2)", 1.0), "LINESTRING (0 0, 2 3)"), ("offset_curve", ("LINESTRING (0 0, 4 0)", 1.0), "LINESTRING (0 1, 4 1)"),
        ("collect", ("POINT (0 0)", "POINT (1 1)"), "MULTIPOINT ((0 0), (1 1))"), ("as_mvt_geom", ("POINT (1 1)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", 8), "POINT (2 6)"),
    ],
)
def test_spatial_shapes(spark, function, args, want):
    got = value(spark, function, *args)
    one = spark.createDataFrame([(got, want)], "a binary, t string").select("a", spatial.from_text(spark, "t").alias("b"))
    same = one.select(spatial.call(spark, "equals", "a", "b").alias("same"), spatial.call(spark, "as_geo_json", "a").alias("a"), spatial.call(spark, "as_geo_json", "b").alias("b")).first()
    assert same.same, same


def test_srids_dimensions_and_nulls(spark):
    cell = value(spark, "force_4d", "POINT (1 2)", 3.0, 4.0, srid=4326)
    assert ewkb.inspect(bytes(cell)) == ewkb.Cell("Point", "xyzm", 4326, 1, 1)
    assert value(spark, "srid", "POINT (1 2)") == 0
    assert value(spark, "set_srid", "POINT (1 2)", 3857)[5:9] == (3857).to_bytes(4, "little")
    null = spark.createDataFrame([(None,)], "g binary").select(spatial.call(spark, "area", "g").alias("a"), spatial.call(spark, "intersects", "g", "g").alias("b")).first()
    assert tuple(null) == (None, None)
    for a, b, want in ((4326, 3857, (1113194.9079, 2273030.9270)), (4326, 32633, (-46155.1945, 2234243.9)), (3857, 4326, (10.0, 20.0))):
        x, y = (1113194.9079, 2273030.9270) if a == 3857 else (10.0, 20.0)
        moved = spark.range(1).select(spatial.call(spark, "transform", spatial.point(spark, F.lit(x), F.lit(y), a), F.lit(b)).alias("g"))
        back = moved.select(spatial.call(spark, "transform", "g", F.lit(a)).alias("h"), "g").select(*[spatial.call(spark, f, c).alias(f + c) for c in "gh" for f in "xy"]).first()
        assert (back.xh, back.yh) == pytest.approx((x, y), abs=1e-6)
        if b != 32633:
            assert (back.xg, back.yg) == pytest.approx(want, rel=1e-7)
    with pytest.raises(Exception, match="UNSUPPORTED_CRS|FAILED_EXECUTE_UDF"):
        value(spark, "transform", "POINT (1 2)", 9999, srid=4326)
    with pytest.raises(Exception, match="CRS_MISMATCH|FAILED_EXECUTE_UDF"):
        spark.range(1).select(spatial.call(spark, "intersects", spatial.point(spark, F.lit(1), F.lit(1), 4326), spatial.point(spark, F.lit(1), F.lit(1), 3857))).collect()


def test_earth_distances(spark):
    paris, berlin = (spatial.point(spark, F.lit(x), F.lit(y)) for x, y in ((2.3522, 48.8566), (13.4050, 52.5200)))
    d = spark.range(1).select(spatial.call(spark, "distance", paris, berlin, F.lit(True)).alias("a"), spatial.call(spark, "distance", paris, berlin, F.lit(False)).alias("b")).first()
    assert d.a == pytest.approx(879_700, abs=600) and d.b == pytest.approx(877_500, abs=600)


def test_subdivide_keeps_the_area(spark):
    circle = value(spark, "buffer", "POINT (0 0)", 10.0, 64)
    parts = spark.createDataFrame([(circle,)], "g binary").select(F.explode(spatial.call(spark, "subdivide", "g", F.lit(20))).alias("p"))
    r = parts.agg(F.sum(spatial.call(spark, "area", "p")).alias("a"), F.max(spatial.call(spark, "n_points", "p")).alias("n")).first()
    whole = spark.createDataFrame([(circle,)], "g binary").select(spatial.call(spark, "area", "g")).first()[0]
    assert r.a == pytest.approx(whole) and r.n <= 20


def varint(data, at):
    v = shift = 0
    while True:
        b = data[at]
        at, v, shift = at + 1, v | (b & 127) << shift, shift + 7
        if b < 128:
            return v, at


def fields(data):
    at, out = 0, []
    while at < len(data):
        tag, at = varint(data, at)
        if tag & 7 == 2:
            n, at = varint(data, at)
            out.append((tag >> 3, data[at : at + n]))
            at += n
        elif tag & 7 == 1:
            out.append((tag >> 3, data[at : at + 8]))
            at += 8
        else:
            v, at = varint(data, at)
            out.append((tag >> 3, v))
    return out


def test_tiles_and_geobuf(spark):
    shapes = spark.createDataFrame([(1, "a", "POINT (25 17)"), (2, None, "LINESTRING (2 2, 2 10, 10 10)"), (3, "b", "POLYGON ((3 6, 8 12, 20 34, 3 6))")], "id int, name string, t string").select("id", "name", spatial.from_text(spark, "t").alias("geom"))
    eng = Engine(spark, {"shapes": shapes})
    bag = {"layer": Value("string", "places"), "extent": Value("i32", 100)}
    tile = bytes(eng.query(q("shapes", (st("as_mvt", m.Wildcard(), p("layer"), p("extent")), "tile")), bag).first().tile)
    layer = fields(fields(tile)[0][1])
    assert (1, b"places") in layer and (5, 100) in layer and (15, 2) in layer
    drawn = sorted(bytes(dict(fields(f))[4]) for k, f in layer if k == 2)
    assert drawn == sorted([bytes([9, 50, 34]), bytes([9, 4, 4, 18, 0, 16, 16, 0]), bytes([9, 6, 12, 18, 10, 12, 24, 44, 15])])
    bag |= {"geometry": Value("string", "geom"), "id": Value("string", "id")}
    named = bytes(eng.query(q("shapes", (st("as_mvt", m.Wildcard(), p("layer"), p("extent"), p("geometry"), p("id")), "tile")), bag).first().tile)
    layer = fields(fields(named)[0][1])
    assert sorted(dict(fields(f))[1] for k, f in layer if k == 2) == [1, 2, 3] and [v for k, v in layer if k == 3] == [b"name"]
    data = fields(bytes(eng.query(q("shapes", (st("as_geobuf", m.Wildcard()), "data"))).first().data))
    assert [v for k, v in data if k == 1] == [b"id", b"name"] and len(fields(dict(data)[4])) == 3


def test_spatial_join_is_the_nested_loop(spark):
    pts = spark.range(300).select("id", spatial.point(spark, (F.col("id") * 37) % 101 / 3.0 - 15, (F.col("id") * 53) % 97 / 3.0 - 15, 0).alias("g"))
    boxes = spark.range(60).select(F.col("id").alias("id"), spatial.rectangle(spark, F.col("id") % 8 * 4 - 16, F.col("id") % 7 * 4 - 14, F.col("id") % 8 * 4 - 16 + F.col("id") % 5, F.col("id") % 7 * 4 - 14 + F.col("id") % 11, 0).alias("g"))
    for predicate, distance in (("intersects", None), ("covers", None), ("d_within", 1.5)):
        got = sorted(rows(spatial_join(boxes, pts, "g", "g", predicate, distance).select("id", "id_right")))
        args = [F.col("b.g"), F.col("p.g")] + ([F.lit(distance)] if distance else [])
        want = sorted(rows(boxes.alias("b").crossJoin(pts.alias("p")).filter(spatial.call(spark, predicate, *args)).select("b.id", "p.id")))
        assert got == want and want
    odd = spark.createDataFrame([(i, x) for i, x in enumerate(("POLYGON ((0 0, 3 3, 6 0, 0 0))", "LINESTRING (-3 -3, 5 5)", "MULTIPOINT ((1 1), (4 1))", "POINT EMPTY", "POLYGON ((-1 -1, 9 -1, 9 9, -1 9, -1 -1))"))], "id int, t string").select("id", spatial.from_text(spark, "t", 0).alias("g"))
    for predicate in ("intersects", "covers", "covered_by", "touches"):
        got = sorted(rows(spatial_join(boxes, odd, "g", "g", predicate).select("id", "id_right")))
        assert got == sorted(rows(boxes.alias("b").crossJoin(odd.alias("p")).filter(spatial.call(spark, predicate, F.col("b.g"), F.col("p.g"))).select("b.id", "p.id")))
    with pytest.raises(Exception, match="CRS_MISMATCH|FAILED_EXECUTE_UDF"):
        spatial_join(*[df.select("id", spatial.call(spark, "set_srid", "g", F.lit(srid)).alias("g")) for df, srid in ((boxes, 4326), (pts, 3857))], "g", "g").collect()


def pairs(spark):
    pts = spark.range(300).select("id", spatial.point(spark, (F.col("id") * 37) % 101 / 3.0 - 15, (F.col("id") * 53) % 97 / 3.0 - 15, 0).alias("g"))
    boxes = spark.range(60).select(F.col("id").alias("id"), (F.col("id") % 3).alias("k"), spatial.rectangle(spark, F.col("id") % 8 * 4 - 16, F.col("id") % 7 * 4 - 14, F.col("id") % 8 * 4 - 16 + F.col("id") % 5, F.col("id") % 7 * 4 - 14 + F.col("id") % 11, 0).alias("g"))
    return pts, boxes


def test_spatial_tests_of_queries_are_joins_on_cells(spark):
    pts, boxes = pairs(spark)
    eng = Engine(spark, {"pts": pts, "boxes": boxes, "kinds": spark.range(3).select(F.col("id").alias("k"), F.concat(F.lit("k"), "id").alias("name"))})
    meet, near = st("intersects", "b.g", "p.g"), st("d_within", "p.g", "b.g", p("d"))
    bag = {"d": Value("f64", 1.5), "x": Value("i64", 40)}
    both = boxes.alias("b").crossJoin(pts.alias("p"))
    hit, close = spatial.call(spark, "intersects", F.col("b.g"), F.col("p.g")), spatial.call(spark, "d_within", F.col("p.g"), F.col("b.g"), F.lit(1.5))
    for made, want in (
        (q(t("boxes", "b"), "b.id", ("p.id", "other"), joins=[join("inner", t("pts", "p"), m.And((cmp("p.id", "lt", p("x")), meet)))]), both.filter(hit & (F.col("p.id") < 40)).select("b.id", "p.id")),
        (q(t("boxes", "b"), "b.id", ("p.id", "other"), joins=[join("cross", t("pts", "p"))], where=m.And((near, cmp("p.id", "lt", p("x"))))), both.filter(close & (F.col("p.id") < 40)).select("b.id", "p.id")),
        (q(t("boxes", "b"), "b.id", "p.id", "c.name", joins=[join("left", t("kinds", "c"), eq("b.k", "c.k")), join("inner", sub(q("pts", "id", "g", where=cmp("id", "lt", p("x"))), "p"), meet)]), both.filter(hit & (F.col("p.id") < 40)).select("b.id", "p.id", F.concat(F.lit("k"), "b.k"))),
        (q(t("boxes", "b"), "b.id", ("p.id", "other"), ("o.id", "third"), joins=[join("inner", t("pts", "p"), meet), join("inner", t("boxes", "o"), st("covers", "o.g", "p.g"))]), both.filter(hit).crossJoin(boxes.alias("o")).filter(spatial.call(spark, "covers", F.col("o.g"), F.col("p.g"))).select("b.id", "p.id", "o.id")),
        (q(t("boxes", "b"), "b.id", ("p.id", "other"), joins=[join("inner", t("pts", "p"), box("bounding_box_contains", "b.g", "p.g"))]), both.filter(spatial.call(spark, "bounding_box_contains", F.col("b.g"), F.col("p.g"))).select("b.id", "p.id")),
    ):
        got = eng.query(made, bag)
        text = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text
        assert sorted(rows(got)) == sorted(rows(want)) and got.count()
    every = eng.query(q(t("boxes", "b"), m.Wildcard("b"), ("p.id", "other"), joins=[join("inner", t("pts", "p"), meet)]))
    assert every.columns == ["id", "k", "g", "other"] and eng.query(q(t("boxes", "b"), star, joins=[join("inner", t("pts", "p"), meet)])).columns == ["id", "k", "g", "id", "g"]
    left = eng.query(q(t("pts", "p"), "p.id", ("b.id", "box"), joins=[join("left", t("boxes", "b"), meet)]))
    assert left.filter("box IS NULL").count() == 300 - both.filter(hit).select("p.id").distinct().count()
    counted = eng.query(q(t("boxes", "b"), (fn("count", star), "n"), joins=[join("inner", t("pts", "p"), meet)]))
    assert counted.first().n == both.filter(hit).count()


def test_indexed_reads_push_ranges(spark, events):
    name = m.ObjectRef("indexed", None, "default")
    spark.sql("DROP TABLE IF EXISTS default.indexed")
    eng = Engine(spark)
    df = contract.mark(events.select("event_id", "geom"), "geom", srid=4326, types=("Point",))
    eng.write(m.Write(name, "create", create_spatial_index=True), df.filter("event_id <= 9000"))
    eng.write(m.Write(name, "append"), df.filter("event_id > 9000"))
    eng.write(m.Write(name, "upsert", keys=("event_id",)), df.filter("event_id = 50").withColumn("geom", spatial.point(spark, F.lit(1.0), F.lit(2.0))).transform(lambda d: contract.mark(d, "geom", srid=4326, types=("Point",))))
    around = Value("wkb", bytes(spark.range(1).select(spatial.rectangle(spark, F.lit(9.0105), F.lit(45.0), F.lit(9.0205), F.lit(46.0)).alias("g")).first().g), 4326)
    got = eng.read(m.Read(name, ("event_id",), filter=m.FieldSpatial("intersects", "geom", "g")), {"g": around})
    text = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = text[text.index("PushedFilters") :]
    assert "LessThanOrEqual(geom_xmin,9.0205)" in pushed and "GreaterThanOrEqual(geom_xmax,9.0105)" in pushed
    assert got.count() == df.filter("event_id % 100 BETWEEN 11 AND 20").count()
    moved = eng.read(m.Read(name, ("event_id",), filter=m.FieldSpatial("d_within", "geom", "g", "d")), {"g": Value("wkb", bytes(spark.range(1).select(spatial.point(spark, F.lit(1.0), F.lit(2.5)).alias("g")).first().g), 4326), "d": Value("f64", 0.5)})
    assert rows(moved) == [(50,)]
    assert spark.table("default.indexed").filter("geom_xmin IS NULL").count() == 0
    spark.sql("DROP TABLE default.indexed")


def test_clusters():
    x, y = [0, 1, 2, 10, 11, 50, None], [0.0] * 6 + [None]
    assert dbscan_labels(x, y, 1.5, 2) == [0, 0, 0, 1, 1, None, None]
    assert k_means_labels([0, 1, 10, 11], [0, 0, 0, 0], 2) == [0, 0, 1, 1] and k_means_labels([3, 3], [1, 1], 5) == [0, 0] and k_means_labels([], [], 2) == []


# EWKB, contracts


def test_ewkb_scanner():
    import struct

    point = b"\x01\x01\x00\x00\x00" + struct.pack("<dd", 1, 2)
    assert ewkb.inspect(point) == ewkb.Cell("Point", "xy", None, 1, 1)
    big = b"\x00" + struct.pack(">IIddd", 0xA0000001, 4326, 1, 2, 3)
    assert ewkb.inspect(big) == ewkb.Cell("Point", "xyz", 4326, 1, 1)
    assert ewkb.inspect(b"\x01" + struct.pack("<Iddd", 2001, 1, 2, 3)).dimensions == "xym"
    nested = point
    for _ in range(70):
        nested = b"\x01" + struct.pack("<II", 7, 1) + nested
    for bad in (b"", point[:-1], point + b"\0", b"\x02" + point[1:], b"\x01" + struct.pack("<I", 13), b"\x01" + struct.pack("<II", 2, 1 << 31), b"\x01" + struct.pack("<I", 0x10000001), nested, b"\x01" + struct.pack("<II", 7, 1) + b"\x01" + struct.pack("<Iddd", 1001, 1, 2, 3)):
        with pytest.raises(EngineError):
            ewkb.inspect(bad)
    assert ewkb.inspect(ewkb.with_srid(point, 3857)).srid == 3857 and ewkb.with_srid(ewkb.with_srid(point, 1), None) == point


def test_contracts(spark, events):
    from pyspark.sql import types as T

    good = contract.geometry(4326, types=("Point",))
    contract.check_field(T.StructField("g", T.BinaryType(), True, good))
    lead = contract.PREFIX + "geometry."
    for change in ({lead + "dimensions": "xyq"}, {lead + "types": "Polygon,Point"}, {lead + "types": ""}, {lead + "crs_id": "EPSG:3857"}, {lead + "crs_resolution": "missing"}, {lead + "crs_definition": "x"}, {lead + "srid": "a"}, {contract.PREFIX + "contract.version": "2"}):
        with pytest.raises(EngineError):
            contract.check_field(T.StructField("g", T.BinaryType(), True, good | change))
    for gone in ("encoding", "axis_order", "precision"):
        with pytest.raises(EngineError):
            contract.check_field(T.StructField("g", T.BinaryType(), True, {k: v for k, v in good.items() if k != lead + gone}))
    with pytest.raises(EngineError):
        contract.check_field(T.StructField("g", T.StringType(), True, good))
    assert contract.profile(events, "geom") == {"cells": 10_000, "srid": 4326, "dimensions": 2, "types": ["Point"]}
    mixed = events.select("geom").limit(1).union(events.limit(1).select(spatial.call(spark, "set_srid", "geom", F.lit(3857))))
    with pytest.raises(EngineError):
        contract.profile(mixed, "geom")
    with pytest.raises(EngineError):
        contract.check_schema(spark.sql("SELECT 1 AS a, 2 AS a").schema)


# streams


def test_streams_are_bounded_and_keep_the_contract(engine):
    df = engine.read(m.Read(m.ObjectRef("events"), ("event_id", "geom", "name")))
    stream = engine.stream(df, size="low_latency")
    total = sum(b.num_rows for b in stream)
    assert total == 10_000 and stream.metrics.rows == 10_000 and stream.metrics.batches >= 10
    assert stream.schema.field("geom").metadata[b"ARROW:extension:name"] == b"geoarrow.wkb"
    empty = engine.stream(engine.query(q("none", "id", "k")))
    assert list(empty) == [] and empty.schema.names == ["id", "k"]


def test_budgets_and_bad_cells(spark, engine):
    df = engine.read(m.Read(m.ObjectRef("events"), ("event_id",)))
    with pytest.raises(EngineError) as e:
        list(engine.stream(df, Budget(ResourceLimits(rows=100))))
    assert e.value.category == "resource_limit"
    with pytest.raises(EngineError):
        engine.stream(df, Budget(ResourceLimits(columns=0)))
    bad = contract.mark(spark.createDataFrame([(bytearray(b"\1\2"),)], "g binary"), "g")
    with pytest.raises(EngineError, match="row 0"):
        list(engine.stream(bad))


def test_cancellation(engine, spark):
    parent = Token()
    child = parent.child(timeout_s=60)
    parent.cancel()
    assert child.reason == "parent" and parent.reason == "requested"
    with pytest.raises(EngineError) as e:
        child.check()
    assert e.value.category == "cancelled"
    with pytest.raises(EngineError) as e:
        Token(timeout_s=0).check()
    assert e.value.category == "timeout"
    slow = spark.range(0, 10**12, 1, 4).filter("sha2(cast(id AS string), 512) = 'x'")
    for token, category in ((Token(timeout_s=1.5), "timeout"), (Token(), "cancelled")):
        if category == "cancelled":
            threading.Timer(1.5, token.cancel).start()
        began = time.time()
        with pytest.raises(EngineError) as e:
            engine.run(slow, token)
        assert e.value.category == category and time.time() - began < 30


def test_error_envelope():
    error = EngineError("transient", "x", "read", "none", "after", 50)
    assert error.document()["retry"] == {"kind": "after", "delay_ms": 50} and len(CATEGORIES) == 18
    with pytest.raises(ValueError, match="unknown"):
        EngineError("nope", "x")
    assert from_spark(ValueError("secret"), "read").message == "ValueError"


# catalog, files, command line


def test_inspections(spark, engine):
    spark.sql("CREATE TABLE IF NOT EXISTS default.described (a INT, b STRING) USING parquet")
    ask = lambda op, ref=None: engine.inspect(m.Operation(op, ref))["document"]
    assert ask("database.test_connection")["ok"] and "spark_catalog" in ask("database.list_catalogs") and "default" in ask("database.list_schemas")
    assert {"name": "described", "kind": "table", "is_partition": False} in ask("database.list_objects", m.ObjectRef("", None, "default"))
    one = ask("database.describe_object", m.ObjectRef("described", None, "default"))
    assert [c["type"] for c in one["columns"]] == ["int", "string"] and one["relation"]["format"] == "parquet"
    spark.sql("ALTER TABLE default.described ADD COLUMN c INT")
    assert ask("database.describe_object", m.ObjectRef("described", None, "default"))["token"] != one["token"]
    spark.sql("DROP TABLE default.described")
    for op, category in (("arcgis.list_folders", "unsupported"), ("database.describe_object", "not_found")):
        with pytest.raises(EngineError) as e:
            ask(op, m.ObjectRef("no_such_table"))
        assert e.value.category == category


def test_arrow_files(spark, engine, tmp_path):
    df = engine.read(m.Read(m.ObjectRef("events"), ("event_id", "geom")))
    path = str(tmp_path / "out.arrow")
    assert tables.write_ipc(engine.stream(df), path)["rows"] == 10_000
    with pytest.raises(EngineError) as e:
        tables.write_ipc(engine.stream(df), path)
    assert e.value.category == "conflict" and [x.name for x in tmp_path.iterdir()] == ["out.arrow"]
    with pytest.raises(EngineError):
        tables.write_ipc(engine.stream(df), str(tmp_path / "small"), max_bytes=10)
    facts = tables.inspect_ipc(path)
    assert facts["rows"] == 10_000 and facts["geometries"][0]["srids"] == [4326] and facts["geometries"][0]["cells"] == 10_000
    back = tables.from_ipc(spark, path)
    assert back.count() == 10_000 and contract.keys(back.schema["geom"])["srid"] == "4326"
    (tmp_path / "bad").write_bytes(b"nothing")
    for name, category in (("bad", "protocol"), ("missing", "not_found")):
        with pytest.raises(EngineError) as e:
            tables.inspect_ipc(str(tmp_path / name))
        assert e.value.category == category


def test_command_line(capsys, tmp_path, spark):
    def run(*args):
        code = cli.main(list(args))
        return code, json.loads(capsys.readouterr().out)

    nation = "nation=/root/testdata/sf0.001/nation.parquet"
    file = tmp_path / "plan.json"
    file.write_text(json.dumps({"schema_version": 1, "connection_ref": "env:X", "provider": "postgres", "operation": {"id": "database.list_catalogs"}}))
    assert run("validate-plan", str(file))[1]["result"]["operation"] == "database.list_catalogs"
    assert run("read-summary", "nation", "--table", nation)[1]["result"]["rows"] == 25
    code, out = run("read-ipc", "nation", str(tmp_path / "n.arrow"), "--table", nation, "--order-by", "n_name:desc", "--max-rows", "3")
    assert code == 0 and out["result"]["rows"] == 3
    assert run("inspect-dataset", str(tmp_path / "n.arrow"))[1]["result"]["rows"] == 3
    assert len(run("database-probe")[1]["result"]["functions"]) == 72
    for args, category in ((("validate-plan", str(tmp_path / "none")), "io"), (("nothing",), "invalid_configuration"), (("describe", "a.b.c.d"), "invalid_configuration"), (("read-summary", "no_such"), "not_found")):
        code, out = run(*args)
        assert code == 1 and out["error"]["category"] == category and out["protocol_version"] == 1


def test_secrets_do_not_show(monkeypatch):
    monkeypatch.setenv("SOME_DSN", "password=hunter2")
    secret = tables.resolve_secret("env:SOME_DSN")
    assert "hunter2" not in f"{secret} {secret!r} {[secret]}" and secret.reveal() == "password=hunter2"
    with pytest.raises(EngineError):
        tables.resolve_secret("env:NOT_SET_AT_ALL")


def test_jdbc(spark, tmp_path):
    url = tables.Secret(f"jdbc:derby:{tmp_path}/db;create=true")
    source = tables.Jdbc("derby", url)
    df = spark.createDataFrame([(1, 2.5), (2, 3.5)], "a int, b double")
    try:
        source.write(df, "t")
    except Exception as e:
        if "ClassNotFound" in str(e) or "derby" in str(e).lower() and "driver" in str(e).lower():
            pytest.skip("no Derby driver here")
        raise
    assert sorted(rows(source.read(spark, "t", ("a", 1, 2, 2)))) == [(1, 2.5), (2, 3.5)]
    with pytest.raises(EngineError):
        tables.Jdbc("oracle", url).read(spark, "t")


# writes


@pytest.fixture
def target(spark):
    spark.sql("DROP TABLE IF EXISTS default.target")
    spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "id int, k string, v double").write.saveAsTable("default.target")
    yield m.ObjectRef("target", None, "default")
    spark.sql("DROP TABLE IF EXISTS default.target")


def content(spark):
    return sorted(rows(spark.table("default.target")))


def test_write_modes(spark, engine, target):
    more = spark.createDataFrame([(3, "C", 30.0), (4, "d", 4.0)], "id int, k string, v double")
    assert engine.write(m.Write(target, "upsert", keys=("id",)), more).__dict__ | {} == writes.Outcome("committed", 2, 2, 1, 1).__dict__
    assert content(spark) == [(1, "a", 1.0), (2, "b", 2.0), (3, "C", 30.0), (4, "d", 4.0)]
    out = engine.write(m.Write(target, "update", keys=("id",), update_columns=("v",)), spark.createDataFrame([(1, "?", 9.0), (8, "?", 8.0)], "id int, k string, v double"))
    assert (out.updated, out.skipped) == (1, 1) and content(spark)[0] == (1, "a", 9.0)
    out = engine.write(m.Write(target, "delete_by_keys", keys=("id",)), spark.createDataFrame([(1,), (9,)], "id int"))
    assert out.deleted == 1 and len(content(spark)) == 3
    engine.write(m.Write(target, "append"), more)
    assert len(content(spark)) == 5
    engine.write(m.Write(target, "truncate_insert"), more)
    assert len(content(spark)) == 2
    engine.write(m.Write(target, "replace", transaction_profile="staged_swap"), spark.createDataFrame([(1,)], "other int"))
    assert spark.table("default.target").columns == ["other"]
    with pytest.raises(EngineError) as e:
        engine.write(m.Write(target, "create"), more)
    assert e.value.category == "conflict"
    with pytest.raises(EngineError) as e:
        engine.write(m.Write(m.ObjectRef("not_there", None, "default"), "append"), more)
    assert e.value.category == "not_found"


def test_key_rules_and_losses(spark, engine, target):
    make = lambda data: spark.createDataFrame(data, "id int, k string, v double")
    for data, category in (([(None, "x", 1.0)], "data_mapping"), ([(1, "x", 1.0), (1, "y", 2.0)], "conflict")):
        with pytest.raises(EngineError) as e:
            engine.write(m.Write(target, "upsert", keys=("id",)), make(data))
        assert (e.value.category, e.value.effect) == (category, "rolled_back")
    assert content(spark) == [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)]
    wide = spark.createDataFrame([(5_000_000_000, "x", 1.0)], "id bigint, k string, v double")
    with pytest.raises(EngineError):
        engine.prepare_write(m.Write(target, "append"), wide)
    assert engine.prepare_write(m.Write(target, "append", "lossy"), wide).report.severity == "data_loss"
    extra = make([(7, "z", 1.0)]).withColumn("new", F.lit(1))
    with pytest.raises(EngineError):
        engine.write(m.Write(target, "append"), extra)
    engine.write(m.Write(target, "append"), extra, evolve=True)
    assert spark.table("default.target").columns == ["id", "k", "v", "new"] and spark.table("default.target").filter("new IS NULL").count() == 3
    with pytest.raises(ValueError, match="nope"):
        losses.LossReport().add("nope", "warning", "c", "m")


@pytest.mark.parametrize(("step", "status"), [("staged", "raised"), ("before_publish", "raised"), ("publishing", "raised"), ("published", "unknown")])
def test_faults(spark, engine, target, step, status):
    def fault(at):
        if at == step:
            raise RuntimeError(at)

    new = spark.createDataFrame([(9, "z", 9.0)], "id int, k string, v double")
    op = m.Write(target, "truncate_insert")
    if status == "raised":
        with pytest.raises(EngineError) as e:
            engine.write(op, new, fault=fault)
        assert e.value.effect == "rolled_back" and content(spark) == [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)]
    else:
        out = engine.write(op, new, fault=fault)
        assert out.status == "unknown" and out.recovery and out.confirmed == 0 and content(spark) == [(9, "z", 9.0)]
    for tb in spark.catalog.listTables("default"):
        if "__geolode" in tb.name:
            spark.sql(f"DROP TABLE default.`{tb.name}`")


def test_a_changed_target_is_refused(spark, engine, target):
    p = engine.prepare_write(m.Write(target, "append"), spark.createDataFrame([(9, "z", 9.0)], "id int, k string, v double"))
    spark.sql("ALTER TABLE default.target ADD COLUMN later INT")
    with pytest.raises(EngineError) as e:
        writes.write(spark, p)
    assert e.value.category == "conflict"


def test_geometry_writes(spark, engine, events, target):
    places = contract.mark(events.select("event_id", "geom").limit(50), "geom", srid=4326, types=("Point",))
    engine.write(m.Write(target, "replace", create_spatial_index=True), places)
    assert spark.table("default.target").columns == ["event_id", "geom", "geom_xmin", "geom_ymin", "geom_xmax", "geom_ymax"]
    assert contract.keys(spark.table("default.target").schema["geom"])["srid"] == "4326"
    wrong = contract.mark(events.select("event_id", "geom").limit(5), "geom", srid=4326, types=("Polygon",))
    with pytest.raises(EngineError) as e:
        engine.write(m.Write(target, "replace"), wrong)
    assert e.value.category == "data_mapping"
    other = contract.mark(events.select("event_id", spatial.call(spark, "set_srid", "geom", F.lit(3857)).alias("geom")).limit(5), "geom", srid=4326)
    with pytest.raises(EngineError) as e:
        engine.write(m.Write(target, "replace"), other)
    assert e.value.category == "crs"
    with pytest.raises(EngineError):
        engine.prepare_write(m.Write(target, "replace", srid_policy="reject_spatial"), places)


def test_outcome_rules():
    for bad in (writes.Outcome("unknown", 1), writes.Outcome("committed", 1, 2), writes.Outcome("rolled_back", 1, 1), writes.Outcome("committed", 5, 2, inserted=3), writes.Outcome("what", 1), writes.Outcome("unknown", 1, 0, recovery={}, retry="safe")):
        with pytest.raises(EngineError):
            bad.checked()


def test_diagnostics(spark):
    df = spark.range(0, 1000, 1, 7).select(F.when(F.col("id") % 400 == 399, None).otherwise(F.col("id")).alias("v"))
    out = writes.diagnose(df, {"not_null": "v IS NOT NULL", "small": "v < 990"})
    assert (out.total, out.rejected) == (1000, 12)
    assert [x["source_row_zero_based"] for x in out.examples] == [399, 799, *range(990, 998)] and out.examples[0]["rules"] == ["not_null", "small"]


def test_execute_and_decoded_parameters(engine):
    document = {"schema_version": 1, "connection_ref": "env:X", "provider": "postgres", "operation": {"id": "database.read", "source": {"object": "small"}, "projection": ["id"], "filter": {"op": "gt", "field": "v", "parameter": "x"}}}
    assert sorted(rows(engine.execute(json.dumps(document), decode({"x": {"type": "i32", "value": 5}})))) == [(1,), (2,)]


_ = (box, c, pa, sub)


# larger tables


def test_near_pairs_are_shared_among_tasks(spark):
    """A distance join is dealt to many tasks, whatever the files' sizes say, and finds what comparing every pair finds, at the limit too."""
    a = spark.range(300).select(F.col("id").alias("i"), spatial.rectangle(spark, F.expr("id % 17 * 1.0"), F.expr("id % 5 * 1.0"), F.expr("id % 17 + 1 + id % 9 * 1.0"), F.expr("id % 5 + 40.5"), 3857).alias("g"))
    b = spark.range(400).select(F.col("id").alias("j"), spatial.point(spark, F.expr("id % 31 * 1.0"), F.expr("id % 53 - 2.0"), 3857).alias("h"))
    want = sorted(rows(a.crossJoin(b).filter(spatial.call(spark, "d_within", "g", "h", F.lit(1.5))).select("i", "j")))
    joined = spatial_join(a, b, "g", "h", "d_within", 1.5)
    eng = Engine(spark, {"a": a, "b": b})
    made = eng.query(q(t("a", "a"), "a.i", "b.j", joins=[join("inner", t("b", "b"), st("d_within", "a.g", "b.h", p("d")))]), {"d": Value("f64", 1.5)})
    for df in (joined.select("i", "j"), made):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "REPARTITION_BY_NUM" in plan and "BroadcastHashJoin" not in plan
        assert sorted(rows(df)) == want
    assert want


def test_long_work_on_a_small_file_is_shared(spark):
    from geolode import spatial_queries  # noqa: F401  it adds to QUERIES
    from geolode.queries import QUERIES

    plan = QUERIES["spatial_subdivide"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan[plan.index("geolode_subdivide") :]


def test_diagnostics_of_a_long_read(spark, monkeypatch):
    """A read of the whole table that outlasts the default deadline still names the bad cell's place."""
    import types

    from geolode import limits
    from geolode import service_queries  # noqa: F401  it adds to QUERIES
    from geolode.queries import QUERIES

    ticks = iter(range(0, 1_000_000, 20))
    monkeypatch.setattr(limits, "time", types.SimpleNamespace(monotonic=lambda: next(ticks)))
    assert rows(QUERIES["read_diagnostics"](spark, "/root/testdata/sf0.001")) == [(998, "geom")]


def test_bad_points_are_found_among_good_ones():
    import struct

    from geolode.streaming.batches import _encode

    point = lambda x: b"\x01\x01\x00\x00\x00" + struct.pack("<dd", x, 1)
    line = b"\x01\x02\x00\x00\x00" + struct.pack("<Idddd", 2, 0, 0, 1, 1)
    run = lambda cells: list(_encode(4, 1 << 20, pa.schema([("g", pa.binary())]), [0], 1 << 20, 64)(iter([pa.RecordBatch.from_arrays([pa.array(cells, pa.binary())], names=["g"]).slice(1)])))
    assert sum(b.column(2)[0].as_py() for b in run([None, None, point(1), line, point(2), None, point(3)])) == 6
    for bad in (point(1)[:-1], b"\x02" + point(1)[1:], b"\x01\x02" + point(1)[2:], point(1) + b"\0"):
        with pytest.raises(EngineError, match=r"\[cell 0 3 "):
            run([None, None, point(1), line, bad, point(2)])


def test_dense_clusters_take_no_pairs(spark):
    """40,000 rows at two places and 90,000 places within reach of each other; and through a query: repeated rows, null groups, null shapes."""
    from geolode.operators.clusters import dbscan_places

    began = time.monotonic()
    assert dbscan_labels([0.0] * 20_000 + [1.0] * 20_000 + [9.0], [0.0] * 40_001, 2.0, 3) == [0] * 40_000 + [None]
    side = np.arange(300.0)
    x, y = np.repeat(side, 300), np.tile(side, 300)
    assert not dbscan_places(x, y, np.ones(90_000, int), 400.0, 5).any()
    assert time.monotonic() - began < 30
    df = spark.range(240).select("id", F.expr("CASE WHEN id % 3 > 0 THEN id % 3 END").alias("k"), F.when(F.col("id") % 40 != 7, spatial.point(spark, F.expr("id % 8 DIV 4 * 10.0 + id % 2"), F.lit(0.0))).alias("g"))
    window = lambda *a: (m.SpatialWindow("cluster_dbscan", tuple(a), (m.Column(m.ColumnRef("k")),)), "c")
    got = Engine(spark, {"d": df}).query(q("d", "id", "k", window(m.Column(m.ColumnRef("g")), p("e"), p("n"))), {"e": Value("f64", 1.0), "n": Value("i32", 4)})
    assert {(r.id, r.k, r.c) for r in got.collect()} == {(i, i % 3 or None, None if i % 40 == 7 else i % 8 // 4) for i in range(240)}


def test_k_means_tasks_get_distinct_places(spark, monkeypatch):
    """What a task clusters are the places and how many rows each has, not rows."""
    from geolode.operators import clusters

    seen = []
    stored = clusters.stored
    monkeypatch.setattr(clusters, "stored", lambda df: seen.append(stored(df)) or seen[-1])
    df = spark.range(10_000).select("id", F.when(F.col("id") > 0, spatial.point(spark, F.expr("id % 4 * 100.0 + id % 3"), F.lit(0.0))).alias("g"))
    w = m.SpatialWindow("cluster_k_means", (m.Column(m.ColumnRef("g")), p("n")))
    got = {r.id: r.c for r in Engine(spark, {"d": df}).query(q("d", "id", (w, "c")), {"n": Value("i32", 4)}).collect()}
    assert seen[0].count() == 12 and len(got) == 10_000 and got[0] is None
    assert len({(i % 4, c) for i, c in got.items() if i}) == 4
    assert k_means_labels([5.0] * 300_000, [1.0] * 300_000, 3) == [0] * 300_000
    seen.clear()
    limited = Engine(spark, {"d": df.limit(500)}).query(q("d", "id", (w, "c")), {"n": Value("i32", 4)})
    assert len(seen) == 2 and limited.count() == 500


def test_pairs_are_counted_without_being_made(spark):
    """Points in rectangles by ranks, other shapes by pairs, repeated and null shapes: as comparing every pair counts them."""
    from geolode.operators import spatial_join as joins

    odd = spatial.from_text(spark, F.expr("concat('POLYGON ((', id % 7, ' 0, ', id % 7 + 3, ' 1, ', id % 7, ' 4, ', id % 7, ' 0))')"), 3857)
    box = spatial.rectangle(spark, F.expr("id % 11 * 0.5"), F.expr("id % 5 * 1.0"), F.expr("id % 11 * 0.5 + id % 4 + 0.5"), F.expr("id % 5 + id % 3 + 1.0"), 3857)
    a = spark.range(200).select((F.col("id") % 60).alias("k"), F.when(F.col("id") % 50 == 3, F.lit(None)).when(F.col("id") % 9 == 0, odd).otherwise(box).alias("g"))
    dot = spatial.point(spark, F.expr("id % 19 * 0.5"), F.expr("id % 8 * 1.0"), 3857)
    b = spark.range(300).select(F.when(F.col("id") % 70 == 5, F.lit(None)).when(F.col("id") % 37 == 0, odd).otherwise(dot).alias("h"))
    want = sorted(rows(a.crossJoin(b).filter(spatial.call(spark, "intersects", "g", "h")).groupBy("k").count()))
    assert want and sorted(rows(joins.counted(a, b, "g", "h", ["k"]))) == want
