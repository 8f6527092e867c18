"""One query for each operator family, and the SQL that each is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolode.engine import Engine
from geolode.functions import spatial
from geolode.plans import model as m
from geolode.plans.build import (
    all_of, any_of, asc, box, c, cluster, cmp, desc, eq, fn, following, join, null, over, p, preceding, q, setop, st, star, sub, t,
)
from geolode.plans.parameters import Bag, Value

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, *names: str, profile: str = "open") -> Engine:
    return Engine(spark, {n: spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names}, profile)


def i32(v: int) -> Value:
    return Value("i32", v)


def i64(v: int) -> Value:
    return Value("i64", v)


def f64(v: float) -> Value:
    return Value("f64", v)


def text(v: str) -> Value:
    return Value("string", v)


def _tables(x, out: set[str]) -> set[str]:
    """Names of the tables that a query or read reads."""
    if isinstance(x, m.ObjectRef):
        out.add(x.object)
    elif isinstance(x, tuple):
        for y in x:
            _tables(y, out)
    elif hasattr(x, "__dataclass_fields__"):
        for k in x.__dataclass_fields__:
            _tables(getattr(x, k), out)
    return out


def _closed(eng: Engine, run: Callable[[Engine], DataFrame]) -> DataFrame:
    """A result is analysed when it is made; the names of its tables are not needed any more."""
    try:
        return run(eng)
    finally:
        eng.close()


def add(name: str, query: m.Query, oracle: str | None = None, bag: Bag | None = None) -> None:
    own = sorted(_tables(query, set()) & set(TABLES))
    QUERIES[name] = lambda spark, sf_dir: _closed(engine(spark, sf_dir, *own), lambda eng: eng.query(query, bag))
    if oracle:
        ORACLE[name] = oracle


def add_read(name: str, read: m.Read, oracle: str, bag: Bag | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: _closed(engine(spark, sf_dir, read.source.object), lambda eng: eng.read(read, bag))
    ORACLE[name] = oracle


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return keep


# table reads

def _r(table: str, *projection: str, where=None, order=(), limit=None) -> m.Read:
    return m.Read(m.ObjectRef(table), projection, tuple(m.FieldOrder(*((o, "asc") if isinstance(o, str) else o)) for o in order), limit, where)


add_read("scan_projection", _r("lineitem", "l_orderkey", "l_linenumber", "l_quantity"), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
add_read("scan_all_columns", _r("nation"), "SELECT * FROM nation")
add_read(
    "filter_compare_and_or",
    _r("lineitem", "l_orderkey", "l_linenumber", where=m.AllOf((m.FieldGte("l_quantity", "q"), m.AnyOf((m.FieldLt("l_discount", "d"), m.FieldEq("l_returnflag", "f"))), m.FieldNe("l_linestatus", "s"), m.FieldLte("l_tax", "x"), m.FieldGt("l_extendedprice", "e")))),
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 20 AND (l_discount < 0.03 OR l_returnflag = 'R') AND l_linestatus <> 'F' AND l_tax <= 0.05 AND l_extendedprice > 1000",
    {"q": f64(20), "d": f64(0.03), "f": text("R"), "s": text("F"), "x": f64(0.05), "e": f64(1000)},
)
add_read("filter_is_null", _r("documents", "doc_id", where=m.AnyOf((m.FieldIsNull("lang"), m.FieldIsNotNull("source")))), "SELECT doc_id FROM documents WHERE lang IS NULL OR source IS NOT NULL")
add_read("filter_in", _r("part", "p_partkey", "p_size", where=m.FieldIn("p_size", ("a", "b", "c"))), "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 15, 40)", {"a": i32(1), "b": i32(15), "c": i32(40)})
add_read("filter_between", _r("orders", "o_orderkey", where=m.FieldBetween("o_totalprice", "a", "b")), "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 120000", {"a": f64(50000), "b": f64(120000)})
add_read("filter_like", _r("part", "p_partkey", "p_name", where=m.FieldLike("p_name", "x")), "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'part%_0'", {"x": text("part%_0")})
add_read("filter_ilike", _r("customer", "c_custkey", where=m.FieldLike("c_mktsegment", "x", True)), "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'build%'", {"x": text("build%")})
add_read("filter_timestamp", _r("orders", "o_orderkey", where=m.FieldGte("o_orderdate", "d")), "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'", {"d": Value("timestamp", "1996-01-01T00:00:00")})
add_read("read_top", _r("orders", "o_orderkey", "o_totalprice", order=(("o_totalprice", "desc"), "o_orderkey"), limit=50), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")

# scalars, joins

add("scalar_lower_upper_coalesce", q("customer", "c_custkey", (fn("lower", "c_mktsegment"), "low"), (fn("upper", "c_name"), "up"), (fn("coalesce", p("none"), "c_mktsegment"), "seg")),
    "SELECT c_custkey, lower(c_mktsegment) low, upper(c_name) up, c_mktsegment seg FROM customer", {"none": Value("null", "text")})
add("filter_query_is_null", q("documents", "doc_id", where=any_of(null("lang"), all_of(null("text", True), cmp("n_chars", "gt", p("n"))))), "SELECT doc_id FROM documents WHERE lang IS NULL OR (text IS NOT NULL AND n_chars > 2000)", {"n": i64(2000)})
_ON = eq("o.o_custkey", "c.c_custkey")
add("join_inner", q(t("orders", "o"), "o.o_orderkey", "c.c_name", joins=[join("inner", t("customer", "c"), _ON)], where=cmp("o.o_totalprice", "gt", p("x"))),
    "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000", {"x": f64(100000)})
add("join_left", q(t("customer", "c"), "c.c_custkey", "o.o_orderkey", joins=[join("left", t("orders", "o"), all_of(_ON, eq("o.o_orderstatus", p("s"))))]),
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'", {"s": text("F")})
add("join_right", q(t("orders", "o"), "c.c_custkey", "o.o_orderkey", joins=[join("right", t("customer", "c"), all_of(_ON, cmp("o.o_totalprice", "lt", p("x"))))]),
    "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice < 20000", {"x": f64(20000)})
add("join_full", q(t("supplier", "s"), "s.s_suppkey", "c.c_custkey", joins=[join("full", t("customer", "c"), all_of(eq("s.s_suppkey", "c.c_custkey"), cmp("c.c_acctbal", "gt", p("x"))))]),
    "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND c_acctbal > 1000", {"x": f64(1000)})
add("join_cross", q(t("region", "r"), "r.r_name", "n.n_name", joins=[join("cross", t("nation", "n"))]), "SELECT r_name, n_name FROM region CROSS JOIN nation")
add("join_theta", q(t("region", "r"), "r.r_regionkey", "n.n_nationkey", joins=[join("inner", t("nation", "n"), cmp("r.r_regionkey", "lt", "n.n_regionkey"))]), "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON r_regionkey < n_regionkey")
add("join_derived", q(sub(q("orders", "o_custkey", (fn("sum", "o_totalprice"), "total"), group=["o_custkey"]), "o"), "c.c_name", "c.c_custkey", joins=[join("inner", t("customer", "c"), _ON)], where=cmp("o.total", "gt", p("x"))),
    "SELECT c_name, c_custkey FROM (SELECT o_custkey, sum(o_totalprice) total FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey WHERE total > 500000.5", {"x": f64(500000.5)})
add("join_multiway", q(t("lineitem", "l"), "n.n_name", (fn("count", star), "n"), joins=[join("inner", t("orders", "o"), eq("l.l_orderkey", "o.o_orderkey")), join("inner", t("customer", "c"), _ON), join("inner", t("nation", "n"), eq("c.c_nationkey", "n.n_nationkey"))], group=["n.n_name"]),
    "SELECT n_name, count(*) n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
_TOP = q(t("orders", "o"), ("o.o_orderkey", "k"), ("o.o_totalprice", "price"), where=_ON, order=[desc("o.o_totalprice"), asc("o.o_orderkey")], limit=2)
add("join_lateral_topk", q(t("customer", "c"), "c.c_custkey", "x.k", "x.price", joins=[join("inner", sub(_TOP, "x"), eq("c.c_custkey", "c.c_custkey"), lateral=True)]),
    "SELECT c_custkey, o_orderkey k, o_totalprice price FROM customer JOIN orders ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
add("join_lateral_left", q(t("nation", "n"), "n.n_nationkey", "x.s", joins=[join("left", sub(q(t("supplier", "s"), ("s.s_suppkey", "s"), where=eq("s.s_nationkey", "n.n_nationkey"), order=[asc("s.s_suppkey")], limit=1), "x"), eq("n.n_nationkey", "n.n_nationkey"), lateral=True)]),
    "SELECT n_nationkey, min(s_suppkey) s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")

# subqueries

add("subq_scalar", q("orders", "o_orderkey", where=cmp("o_totalprice", "gt", m.ScalarSubquery(q("orders", fn("average", "o_totalprice"))))), "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
add("subq_scalar_projected", q("nation", "n_name", (m.ScalarSubquery(q(t("customer", "c"), fn("count", star), where=eq("c.c_nationkey", "nation.n_nationkey"))), "customers")),
    "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) customers FROM nation")
_ORDERS_OF = q(t("orders", "o"), "o.o_orderkey", where=all_of(eq("o.o_custkey", "customer.c_custkey"), cmp("o.o_totalprice", "gt", p("x"))))
add("subq_exists", q("customer", "c_custkey", where=m.Exists(_ORDERS_OF)), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)", {"x": f64(150000)})
add("subq_not_exists", q("customer", "c_custkey", where=m.Exists(_ORDERS_OF, True)), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)", {"x": f64(150000)})
_IN = q("customer", "c_custkey", where=eq("c_mktsegment", p("s")))
add("subq_in", q("orders", "o_orderkey", where=m.InSubquery(c("o_custkey"), _IN)), "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", {"s": text("BUILDING")})
add("subq_not_in", q("orders", "o_orderkey", where=m.InSubquery(c("o_custkey"), _IN, True)), "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", {"s": text("BUILDING")})

# groups

add("agg_group_having", q("lineitem", "l_returnflag", "l_linestatus", (fn("count", star), "n"), (fn("minimum", "l_quantity"), "low"), (fn("maximum", "l_extendedprice"), "high"), (fn("average", "l_quantity"), "mean"), group=["l_returnflag", "l_linestatus"], having=cmp(fn("count", star), "gt", p("n"))),
    "SELECT l_returnflag, l_linestatus, count(*) n, min(l_quantity) low, max(l_extendedprice) high, avg(l_quantity) mean FROM lineitem GROUP BY ALL HAVING count(*) > 10", {"n": i64(10)})
add("agg_global", q("part", (fn("count", "p_size"), "n"), (fn("sum", "p_size"), "total"), (fn("average", "p_size"), "mean")), "SELECT count(p_size) n, CAST(sum(p_size) AS BIGINT) total, avg(p_size) mean FROM part")
add("agg_global_having", q("part", (fn("count", star), "n"), having=cmp(fn("count", star), "gt", p("n"))), "SELECT count(*) n FROM part HAVING count(*) > 5", {"n": i64(5)})
add("distinct", q("lineitem", "l_returnflag", "l_linestatus", distinct=True), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
add("distinct_on", q("orders", "o_custkey", "o_orderkey", "o_totalprice", distinct_on=["o_custkey"], order=[asc("o_custkey"), desc("o_totalprice"), asc("o_orderkey")]),
    "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")

# windows

_W = {"by": ["o_custkey"], "order": ["o_orderdate", "o_orderkey"]}
_SQL_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
add("win_row_number", q("orders", "o_orderkey", (over("row_number", **_W), "n")), f"SELECT o_orderkey, row_number() OVER ({_SQL_W}) n FROM orders")
add("win_rank", q("part", "p_partkey", (over("rank", by=["p_brand"], order=[desc("p_size")]), "r")), "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) r FROM part")
add("win_dense_rank", q("part", "p_partkey", (over("dense_rank", by=["p_brand"], order=["p_size"]), "r")), "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) r FROM part")
add("win_lag_lead", q("orders", "o_orderkey", (over("lag", "o_totalprice", **_W), "before"), (over("lead", "o_totalprice", p("two"), p("none"), **_W), "after")),
    f"SELECT o_orderkey, lag(o_totalprice) OVER ({_SQL_W}) before, lead(o_totalprice, 2, -1.0) OVER ({_SQL_W}) after FROM orders", {"two": i32(2), "none": f64(-1.0)})
add("win_agg_rows", q("orders", "o_orderkey", (over("maximum", "o_totalprice", frame=("rows", preceding(2), following(1)), **_W), "high"), (over("count", star, frame=("rows", preceding()), **_W), "n")),
    f"SELECT o_orderkey, max(o_totalprice) OVER ({_SQL_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) high, count(*) OVER ({_SQL_W} ROWS UNBOUNDED PRECEDING) n FROM orders")
add("win_agg_range", q("part", "p_partkey", (over("count", star, by=["p_brand"], order=["p_size"], frame=("range", preceding(3), following(2))), "n")),
    "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) n FROM part")
add("win_agg_groups", q("part", "p_partkey", (over("sum", "p_size", by=["p_brand"], order=["p_size"], frame=("groups", preceding(1), following(1))), "total")),
    "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) total FROM part")
add("win_agg_no_frame", q("part", "p_partkey", (over("sum", "p_size", by=["p_brand"]), "total"), (over("minimum", "p_size", by=["p_brand"]), "low")), "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand) AS BIGINT) total, min(p_size) OVER (PARTITION BY p_brand) low FROM part")
add("win_over_groups", q("orders", "o_custkey", (over("rank", order=[desc(fn("count", star)), asc("o_custkey")]), "r"), group=["o_custkey"]), "SELECT o_custkey, rank() OVER (ORDER BY count(*) DESC, o_custkey) r FROM orders GROUP BY 1")

# sets, common tables, order

_A, _B = q("customer", ("c_nationkey", "k"), where=cmp("c_acctbal", "gt", p("a"))), q("supplier", ("s_nationkey", "k"), where=cmp("s_acctbal", "gt", p("b")))
_SA, _SB = "SELECT c_nationkey k FROM customer WHERE c_acctbal > 9000", "SELECT s_nationkey k FROM supplier WHERE s_acctbal > 5000"
_BAG = {"a": f64(9000), "b": f64(5000)}
for _op in ("union", "intersect", "except"):
    for _every in (False, True):
        add(f"set_{_op}{'_all' * _every}", q("customer", ("c_nationkey", "k"), where=cmp("c_acctbal", "gt", p("a")), sets=[setop(_op, _B, _every)]), f"{_SA} {_op.upper()}{' ALL' * _every} ({_SB})", _BAG)
add("set_precedence", q("region", ("r_regionkey", "k"), sets=[setop("union", q("nation", ("n_nationkey", "k"))), setop("intersect", q("supplier", ("s_nationkey", "k")))], order=[asc("k")]),
    "SELECT r_regionkey k FROM region UNION (SELECT n_nationkey FROM nation) INTERSECT (SELECT s_nationkey FROM supplier) ORDER BY k")
_BIG = m.CommonTable("big", q("orders", "o_custkey", (fn("sum", "o_totalprice"), "total"), group=["o_custkey"]))
add("cte", q("top", "c_name", ctes=[_BIG, m.CommonTable("top", q("big", "c.c_name", joins=[join("inner", t("customer", "c"), eq("big.o_custkey", "c.c_custkey"))], where=cmp("big.total", "gt", p("x"))))]),
    "WITH big AS (SELECT o_custkey, sum(o_totalprice) total FROM orders GROUP BY 1) SELECT c_name FROM big JOIN customer ON o_custkey = c_custkey WHERE total > 400000.5", {"x": f64(400000.5)})
_STEP = q("walk", ("n.n_nationkey", "k"), joins=[join("inner", t("nation", "n"), all_of(eq("n.n_regionkey", "walk.k"), cmp("n.n_nationkey", "gt", "walk.k")))])
_START = {"where": eq("r_regionkey", p("z"))}
add("cte_recursive", q("walk", "k", ctes=[m.CommonTable("walk", q("region", ("r_regionkey", "k"), sets=[setop("union", _STEP, True)], **_START), True)]),
    "WITH RECURSIVE walk AS (SELECT r_regionkey k FROM region WHERE r_regionkey = 0 UNION ALL SELECT n_nationkey FROM walk JOIN nation ON n_regionkey = k AND n_nationkey > k) SELECT k FROM walk", {"z": i32(0)})
_LOOP = q("walk", ("n.n_regionkey", "k"), joins=[join("inner", t("nation", "n"), any_of(eq("n.n_nationkey", "walk.k"), eq("n.n_regionkey", "walk.k")))])
add("cte_recursive_distinct", q("walk", "k", ctes=[m.CommonTable("walk", q("nation", ("n_nationkey", "k"), where=eq("n_nationkey", p("z")), sets=[setop("union", _LOOP)]), True)]),
    "WITH RECURSIVE walk AS (SELECT n_nationkey k FROM nation WHERE n_nationkey = 17 UNION SELECT n_regionkey FROM walk JOIN nation ON n_nationkey = k OR n_regionkey = k) SELECT k FROM walk", {"z": i32(17)})
add("order_limit_offset", q("customer", "c_custkey", "c_acctbal", order=[desc("c_acctbal"), asc("c_custkey")], limit=25, offset=10), "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 10")
add("topk", q("lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", order=[desc("l_extendedprice"), asc("l_orderkey"), asc("l_linenumber")], limit=100),
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
FLAGSHIP = q(
    t("orders", "o"), "n.n_name", (fn("sum", "o.o_totalprice"), "revenue"), (fn("count", star), "orders"),
    joins=[join("inner", t("customer", "c"), _ON), join("inner", t("nation", "n"), eq("c.c_nationkey", "n.n_nationkey"))], group=["n.n_name"], order=[desc("revenue"), asc("n.n_name")], limit=10,
)
add("flagship_revenue", q(sub(FLAGSHIP, "f"), "f.n_name", "f.orders"), "SELECT n_name, orders FROM (SELECT n_name, sum(o_totalprice) revenue, count(*) orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY revenue DESC, n_name LIMIT 10)")

# spatial

X, Y = "CAST((user_id * 7 + event_id) % 360 AS DOUBLE) - 180", "CAST(event_id % 180 AS DOUBLE) - 90"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each event."""
    ev = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    return ev.select("event_id", "user_id", "event_type", spatial.point(spark, F.expr(X), F.expr(Y)).alias("geom"))


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle for each part: p_size wide, p_retailprice high, its corner at (p_partkey % 100, p_partkey % 7)."""
    pt = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet")
    x, y = F.col("p_partkey") % 100, F.col("p_partkey") % 7
    return pt.select("p_partkey", "p_brand", spatial.rectangle(spark, x, y, x + F.col("p_size"), y + F.col("p_retailprice"), 3857).alias("geom"))


SHAPES = {"places": places, "rects": rects}


def add_spatial(name: str, made: m.Query, oracle: str | None = None, bag: Bag | None = None) -> None:
    own = _tables(made, set())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        eng = Engine(spark)
        for key, build in SHAPES.items():
            if key in own:
                eng.add(key, build(spark, sf_dir))
        return _closed(eng, lambda eng: eng.query(made, bag))

    QUERIES[name] = run
    if oracle:
        ORACLE[name] = oracle


def point_cell(x: float, y: float, srid: int = 4326) -> Value:
    import struct

    return Value("wkb", b"\x01\x01\x00\x00\x00" + struct.pack("<dd", x, y), srid)


_P = f"(SELECT event_id, user_id, event_type, {X} AS x, {Y} AS y FROM events)"
_R = "(SELECT p_partkey, p_brand, CAST(p_partkey % 100 AS DOUBLE) x, CAST(p_partkey % 7 AS DOUBLE) y, CAST(p_size AS DOUBLE) w, p_retailprice h FROM part)"
add_spatial("spatial_point_accessors", q("places", "event_id", (st("x", "geom"), "x"), (st("y", "geom"), "y"), (st("srid", "geom"), "srid"), (st("dimensions", "geom"), "dims"), (st("n_points", "geom"), "n"), (st("geometry_type", "geom"), "kind"), (st("is_empty", "geom"), "void"), (st("is_valid", "geom"), "valid")),
    f"SELECT event_id, x, y, 4326 srid, 2 dims, 1 n, 'ST_Point' kind, false AS void, true AS valid FROM {_P}")
add_spatial("spatial_distance", q("places", "event_id", (st("distance", "geom", p("g")), "d")), f"SELECT event_id, sqrt((x - 10) * (x - 10) + (y - 20) * (y - 20)) d FROM {_P}", {"g": point_cell(10, 20)})
add_spatial("spatial_azimuth", q("places", "event_id", where=all_of(cmp(st("azimuth", p("g"), "geom"), "lt", p("a")))), f"SELECT event_id FROM {_P} WHERE x > 10.5 AND y > 20.5 AND (x - 10.5) < (y - 20.5) OR x = 10.5 AND y > 20.5", {"g": point_cell(10.5, 20.5), "a": f64(0.7853981633)})
add_spatial("spatial_dwithin", q("places", "event_id", where=st("d_within", "geom", p("g"), p("r"))), f"SELECT event_id FROM {_P} WHERE (x - 10) * (x - 10) + (y - 20) * (y - 20) <= 400", {"g": point_cell(10, 20), "r": f64(20)})
add_spatial("spatial_bbox_ops", q("rects", "p_partkey", (box("bounding_box_intersects", "geom", p("g")), "hits"), (box("bounding_box_contains", "geom", p("g")), "has"), (box("bounding_box_contained_by", "geom", p("g")), "inside")),
    f"SELECT p_partkey, (x <= 50 AND x + w >= 50 AND y <= 5 AND y + h >= 5) hits, (x <= 50 AND x + w >= 50 AND y <= 5 AND y + h >= 5) has, false AS inside FROM {_R}", {"g": point_cell(50, 5, 3857)})
add_spatial("spatial_knn", q("places", "event_id", order=[asc(box("knn_distance", "geom", p("g"))), asc("event_id")], limit=20), f"SELECT event_id FROM {_P} ORDER BY (x - 1.25) * (x - 1.25) + (y - 2.5) * (y - 2.5), event_id LIMIT 20", {"g": point_cell(1.25, 2.5)})
add_spatial("spatial_area_length", q("rects", "p_partkey", (st("n_rings", "geom"), "rings"), (st("n_points", "geom"), "points"), (st("length", "geom"), "length"), where=all_of(cmp(st("area", "geom"), "gt", p("a")), cmp(st("perimeter", "geom"), "gt", p("b")))),
    f"SELECT p_partkey, 1 rings, 5 points, CAST(0 AS DOUBLE) length FROM {_R} WHERE w * h > 20000.123 AND 2 * (w + h) > 1500.123", {"a": f64(20000.123), "b": f64(1500.123)})
add_spatial("spatial_predicates_rect", q("rects", "p_partkey", (st("intersects", "geom", p("g")), "hits"), (st("contains", "geom", p("g")), "has"), (st("covers", "geom", p("g")), "covers"), (st("disjoint", "geom", p("g")), "apart"), (st("touches", "geom", p("g")), "touches"), (st("relate", "geom", p("g"), p("m")), "inner")),
    f"SELECT p_partkey, i hits, s has, i covers, NOT i apart, i AND NOT s touches, s AS inner FROM (SELECT *, (x <= 50 AND x + w >= 50 AND y <= 5 AND y + h >= 5) i, (x < 50 AND x + w > 50 AND y < 5 AND y + h > 5) s FROM {_R})",
    {"g": point_cell(50, 5, 3857), "m": text("0********")})
add_spatial("spatial_extent_agg", q(sub(q("rects", "p_brand", (st("extent", "geom"), "b"), group=["p_brand"]), "r"), "r.p_brand", (m.Column(m.ColumnRef("xmin", "b")), "xmin"), (m.Column(m.ColumnRef("ymax", "b")), "ymax")), f"SELECT p_brand, min(x) xmin, max(y + h) ymax FROM {_R} GROUP BY 1")
add_spatial("spatial_collect_agg", q(sub(q("places", "event_type", (st("collect", "geom"), "g"), group=["event_type"]), "r"), "r.event_type", (st("n_points", "r.g"), "n"), (st("geometry_type", "r.g"), "kind")), f"SELECT event_type, CAST(count(*) AS INTEGER) n, 'ST_MultiPoint' kind FROM {_P} GROUP BY 1")
add_spatial("spatial_union_agg", q(sub(q("places", "event_type", (st("union", "geom"), "g"), group=["event_type"]), "r"), "r.event_type", (st("n_points", "r.g"), "n")), f"SELECT event_type, CAST(count(DISTINCT (x, y)) AS INTEGER) n FROM {_P} GROUP BY 1")
add_spatial("spatial_geojson", q("places", "event_id", (st("as_geo_json", "geom"), "j")), "SELECT event_id, '{\"type\":\"Point\",\"coordinates\":[' || CAST(CAST(x AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(y AS BIGINT) AS VARCHAR) || ']}' j FROM " + _P)
add_spatial("spatial_processing", q("rects", "p_partkey", (st("n_points", st("buffer", "geom", p("zero"))), "n"), (st("n_points", st("convex_hull", "geom")), "hull"), (st("equals", st("envelope", "geom"), "geom"), "same"), (st("is_simple", st("boundary", "geom")), "simple"), (st("srid", st("set_srid", "geom", p("s"))), "srid"), where=cmp(st("x", st("centroid", "geom")), "gt", p("c"))),
    f"SELECT p_partkey, 5 n, 5 hull, true same, true simple, 4326 srid FROM {_R} WHERE x + w / 2 > 30.123", {"zero": f64(0), "s": i32(4326), "c": f64(30.123)})
add_spatial("spatial_overlay", q("rects", "p_partkey", (st("n_points", st("intersection", "geom", st("envelope", "geom"))), "n"), (st("is_empty", st("difference", "geom", "geom")), "void"), (st("is_empty", st("sym_difference", "geom", "geom")), "none"), (st("n_rings", st("union", "geom", "geom")), "rings")),
    f"SELECT p_partkey, 5 n, true AS void, true AS none, 1 rings FROM {_R}")
add_spatial("spatial_force_dims", q("places", "event_id", (st("dimensions", st("force_4d", "geom", p("z"), p("w"))), "d4"), (st("z", st("force_3d", "geom", p("z"))), "z"), (st("m", st("force_3dm", "geom", p("w"))), "m"), (st("dimensions", st("force_2d", st("force_3d", "geom"))), "d2")),
    f"SELECT event_id, 4 d4, CAST(7 AS DOUBLE) z, CAST(9 AS DOUBLE) m, 2 d2 FROM {_P}", {"z": f64(7), "w": f64(9)})
add_spatial("spatial_transform", q("places", "event_id", where=cmp(st("x", st("transform", "geom", p("s"))), "gt", p("x"))), f"SELECT event_id FROM {_P} WHERE x * pi() * 6378137 / 180 > 1000000", {"s": i32(3857), "x": f64(1_000_000)})
_NEAR = "(SELECT a.event_id i, b.event_id j FROM p a JOIN p b ON a.event_type = b.event_type AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 16)"
add_spatial("spatial_cluster_dbscan", q(sub(q("places", "event_id", (cluster("cluster_dbscan", "geom", p("eps"), p("least"), by=["event_type"]), "k")), "r"), "r.event_id", where=null("r.k")),
    f"WITH p AS {_P}, near AS {_NEAR}, core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 4) SELECT event_id FROM p WHERE event_id NOT IN (SELECT near.i FROM near JOIN core ON near.j = core.i)", {"eps": f64(4), "least": i32(4)})
add_spatial("spatial_cluster_k_means", q(sub(q("places", "event_id", "event_type", (cluster("cluster_k_means", "geom", p("k"), by=["event_type"]), "k")), "r"), "r.event_type", (fn("maximum", "r.k"), "most"), (fn("count", "r.event_id"), "n"), group=["r.event_type"]),
    f"SELECT event_type, 3 AS most, count(*) n FROM {_P} GROUP BY 1", {"k": i32(4)})

def box_cell(xmin: float, ymin: float, xmax: float, ymax: float, srid: int = 4326) -> Value:
    import struct

    ring = [xmin, ymin, xmin, ymax, xmax, ymax, xmax, ymin, xmin, ymin]
    return Value("wkb", b"\x01\x03\x00\x00\x00" + struct.pack("<II10d", 1, 5, *ring), srid)


@query("spatial_filter_read", f"SELECT event_id FROM {_P} WHERE x BETWEEN -40 AND 15 AND y BETWEEN 3 AND 25")
def _spatial_filter_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    eng = Engine(spark, {"places": places(spark, sf_dir)})
    return eng.read(m.Read(m.ObjectRef("places"), ("event_id",), filter=m.FieldSpatial("intersects", "geom", "g")), {"g": box_cell(-40, 3, 15, 25)})


@query("spatial_filter_intersects", f"SELECT event_id FROM {_P} WHERE x BETWEEN -40 AND 15 AND y BETWEEN 3 AND 25")
def _spatial_filter_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    eng = Engine(spark, {"places": places(spark, sf_dir)})
    return eng.read(m.Read(m.ObjectRef("places"), ("event_id",), filter=m.FieldIntersects("geom", "g")), {"g": Value("wkb", box_cell(-40, 3, 15, 25).value)})


@query("spatial_join_points_rects", f"SELECT r.p_partkey, count(*) n FROM {_R} r JOIN {_P} p ON p.x BETWEEN r.x AND r.x + r.w AND p.y BETWEEN r.y AND r.y + r.h GROUP BY 1")
def _spatial_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geolode.operators.spatial_join import counted

    cells = places(spark, sf_dir).select("event_id", spatial.call(spark, "set_srid", "geom", F.lit(3857)).alias("geom"))
    return counted(rects(spark, sf_dir), cells, "geom", "geom", ["p_partkey"])


_HITS = q(t("rects", "r"), "r.p_partkey", (fn("count", star), "n"), joins=[join("inner", t("flat", "p"), st("intersects", "r.geom", "p.geom"))], group=["r.p_partkey"])


def _flat(spark: SparkSession, sf_dir: str, where: str = "true") -> Engine:
    """Rectangles, and places in the same system."""
    cells = places(spark, sf_dir).filter(where).select("event_id", spatial.call(spark, "set_srid", "geom", F.lit(3857)).alias("geom"))
    return Engine(spark, {"rects": rects(spark, sf_dir), "flat": cells})


@query("spatial_join_query", f"SELECT r.p_partkey, count(*) n FROM {_R} r JOIN {_P} p ON p.x BETWEEN r.x AND r.x + r.w AND p.y BETWEEN r.y AND r.y + r.h GROUP BY 1")
def _spatial_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).query(_HITS)


@query("spatial_join_where", f"SELECT r.p_partkey, p.event_id FROM {_R} r JOIN {_P} p ON (p.x - greatest(r.x, least(p.x, r.x + r.w))) ** 2 + (p.y - greatest(r.y, least(p.y, r.y + r.h))) ** 2 <= 2.25 WHERE p.event_id % 50 = 0 AND r.p_partkey > 5")
def _spatial_join_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = q(t("rects", "r"), "r.p_partkey", "p.event_id", joins=[join("cross", t("flat", "p"))], where=all_of(st("d_within", "p.geom", "r.geom", p("d")), cmp("r.p_partkey", "gt", p("k"))))
    return _flat(spark, sf_dir, "event_id % 50 = 0").query(made, {"d": f64(1.5), "k": i64(5)})


# writes: each into a table of its own, read back

def _written(mode: str, oracle: str, keys: tuple[str, ...] = (), updates: tuple[str, ...] = ()) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = spark.read.parquet(f"{sf_dir.rstrip('/')}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal")
        eng, name = Engine(spark), f"geolode_w_{uuid.uuid4().hex}"
        ref = m.ObjectRef(name, None, "default")
        if mode not in ("create",):
            eng.write(m.Write(ref, "create"), base)
        rows = base.filter("s_suppkey % 2 = 0").select((F.col("s_suppkey") + F.when(F.col("s_suppkey") % 4 == 0, 1_000_000).otherwise(0)).alias("s_suppkey"), F.concat("s_name", F.lit("*")).alias("s_name"), (F.col("s_acctbal") + 1).alias("s_acctbal"))
        if mode == "create":
            rows = base
        eng.write(m.Write(ref, mode, "strict", "staged_swap" if mode == "replace" else "single_transaction", keys, updates), rows.select("s_suppkey") if mode == "delete_by_keys" else rows)
        from geolode.shared import stored

        out = stored(spark.table(f"default.{name}"))
        spark.sql(f"DROP TABLE default.{name}")
        return out

    QUERIES[f"write_roundtrip_{mode}"] = run
    ORACLE[f"write_roundtrip_{mode}"] = oracle


_BASE = "SELECT s_suppkey, s_name, s_acctbal FROM supplier"
_NEW = "SELECT s_suppkey + CASE WHEN s_suppkey % 4 = 0 THEN 1000000 ELSE 0 END s_suppkey, s_name || '*' s_name, s_acctbal + 1 s_acctbal FROM supplier WHERE s_suppkey % 2 = 0"
_written("create", _BASE)
_written("append", f"{_BASE} UNION ALL {_NEW}")
_written("replace", _NEW)
_written("truncate_insert", _NEW)
_written("update", f"SELECT b.s_suppkey, coalesce(n.s_name, b.s_name) s_name, b.s_acctbal FROM ({_BASE}) b LEFT JOIN ({_NEW}) n USING (s_suppkey)", ("s_suppkey",), ("s_name",))
_written("upsert", f"SELECT s_suppkey, coalesce(n.s_name, b.s_name) s_name, coalesce(n.s_acctbal, b.s_acctbal) s_acctbal FROM ({_BASE}) b FULL JOIN ({_NEW}) n USING (s_suppkey)", ("s_suppkey",))
_written("delete_by_keys", f"{_BASE} WHERE s_suppkey NOT IN (SELECT s_suppkey FROM ({_NEW}))", ("s_suppkey",))
