"""The query model: JSON, validation, profiles, fingerprints; properties over random trees."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as s

from geolode.errors import EngineError
from geolode.functions.catalog import FUNCTIONS
from geolode.limits import Limits
from geolode.plans import model as m
from geolode.plans import plan, validate, wire
from geolode.plans.build import all_of, any_of, asc, box, c, cluster, cmp, desc, eq, fn, following, join, null, over, p, preceding, q, setop, st, star, sub, t
from geolode.queries import FLAGSHIP


def refused(query, category="invalid_plan", **kw):
    with pytest.raises(EngineError) as e:
        validate.query(query, **kw)
    assert e.value.category == category


def test_catalogue_has_72_functions():
    assert len(FUNCTIONS) == 72
    assert sum(f.returns == "geometry" for f in FUNCTIONS.values()) == 31


def test_round_trip_of_the_flagship():
    assert wire.parse(m.Query, wire.canonical(FLAGSHIP)) == FLAGSHIP
    assert plan.fingerprint(FLAGSHIP) == plan.fingerprint(wire.parse(m.Query, json.dumps(wire.encode(FLAGSHIP))))


names = s.text("abcxyz `\"'éß-", min_size=1, max_size=6)
columns = s.builds(lambda f, r: m.Column(m.ColumnRef(f, r)), names, s.none() | names)
values = s.recursive(columns | s.builds(m.Parameter, names), lambda x: s.builds(lambda a: m.Scalar("coalesce", tuple(a)), s.lists(x, min_size=1, max_size=3)) | s.builds(lambda a: m.Scalar("lower", (a,)), x), max_leaves=6)
tests = s.recursive(
    s.builds(m.Compare, values, s.sampled_from(["eq", "ne", "lt", "lte", "gt", "gte"]), values) | s.builds(m.IsNull, values, s.booleans()),
    lambda x: s.builds(lambda a: m.And(tuple(a)), s.lists(x, min_size=1, max_size=3)) | s.builds(lambda a: m.Or(tuple(a)), s.lists(x, min_size=1, max_size=3)), max_leaves=6,
)
frames = s.builds(m.Frame, s.sampled_from(["rows", "range", "groups"]), s.builds(m.Bound, s.just("preceding"), s.integers(0, 9)), s.builds(m.Bound, s.just("following"), s.integers(0, 9)))
windows = s.builds(lambda a, f: m.Window("sum", (a,), (), (m.Ordering(a),), f), columns, s.none() | frames)
queries = s.builds(
    lambda pr, w, o, n, d: m.Query(tuple(m.Projection(x) for x in pr), m.Source(m.ObjectRef("t")), filter=w, order_by=tuple(map(m.Ordering, o)), row_limit=n, distinct=d),
    s.lists(values | windows, min_size=1, max_size=3), s.none() | tests, s.lists(columns, max_size=2), s.none() | s.integers(0, 10**6), s.booleans(),
)


@settings(max_examples=150, deadline=None)
@given(queries)
def test_json_round_trip_validity_and_fingerprints(query):
    validate.query(query)
    again = wire.parse(m.Query, wire.canonical(query))
    assert again == query and plan.fingerprint(again) == plan.fingerprint(query)


@settings(max_examples=60, deadline=None)
@given(queries, s.sampled_from(["extra", "Projection", "limit"]))
def test_unknown_keys_are_refused(query, key):
    document = wire.encode(query) | {key: 1}
    with pytest.raises(EngineError):
        wire.parse(m.Query, json.dumps(document))


def test_json_is_strict():
    good = wire.encode(q("t", "a"))
    for change in ({"row_limit": -1}, {"row_limit": True}, {"distinct": 1}, {"projection": {}}, {"source": None, "projection": []}, {"order_by": [{"expression": {"kind": "what"}, "direction": "asc"}]}):
        with pytest.raises(EngineError):
            validate.query(wire.parse(m.Query, json.dumps(good | change)))
    with pytest.raises(EngineError):
        wire.parse(m.Query, '{"projection": [], "projection": []}')
    with pytest.raises(EngineError):
        wire.parse(m.Query, "[" * 100_000)
    with pytest.raises(EngineError):
        wire.parse(m.Query, " " * 5_000_000)


def test_depth_and_node_limits():
    e = null("a")
    for _ in range(70):
        e = m.And((e,))
    refused(q("t", "a", where=e))
    refused(q("t", *["a"] * 5000))
    inner = q("t", "a")
    for k in range(70):
        inner = q(sub(inner, f"s{k}"), "a")
    refused(inner)
    validate.query(q("t", *["a"] * 100), Limits(max_nodes=300))


@pytest.mark.parametrize(
    "query",
    [
        q("t"), q("t", "a", where=c("a")), q("t", "a", where=fn("lower", "a")), q("t", "a", where=m.And(())), q("t", "a", joins=[join("inner", "u")]), q("t", "a", joins=[join("cross", "u", eq("t.a", "u.a"))]),
        q("t", "a", offset=3), q("t", "a", distinct=True, distinct_on=["a"], order=["a"]), q("t", "a", distinct_on=["a"], order=["b", "a"]), q("t", "a", sets=[setop("union", q("u", "a", "b"))]), q("t", fn("lower")),
        q("t", fn("rank")), q("t", fn("count", m.Wildcard("t"))), q("t", fn("sum", fn("sum", "a"))), q("t", "a", where=cmp(fn("sum", "a"), "gt", p("x"))), q("t", "a", group=[fn("sum", "a")]), q("t", over("lower", "a")),
        q("t", over("sum", "a", order=["a"], frame=("rows", following(2), preceding(1)))), q("t", over("sum", "a", order=["a"], frame=("rows", following(1)))), q("t", over("lag", "a", "b", "c", "d")), q("t", ""), q("t", "a\0"), q("t", c("x" * 300)),
        q("t", st("buffer", "a")), q("t", st("no_such", "a")), q("t", st("cluster_dbscan", "g", p("e"), p("n"))), q("t", cluster("area", "g")), q("t", "a", where=st("relate", "g", "h")), q("t", "a", where=box("knn_distance", "g", "h")),
        q("t", "a", joins=[join("inner", t("u", "t"), eq("a", "b"))]), m.Query((m.Projection(c("a")),)), q("t", "a", joins=[m.Join("inner", source=m.Source(m.ObjectRef("u")), lateral=True, on=eq("a", "b"))]), q("t", m.ScalarSubquery(q("u", "a", "b"))),
        q("t", "a", locking=m.Lock("update", "wait"), distinct=True), q("t", "a", locking=m.Lock("update", "wait", ("u",))), q("t", "a", joins=[join("inner", "u", eq("t.a", "v.a")), join("inner", "v", eq("u.a", "v.a"))]),
    ],
)
def test_refused_queries(query):
    refused(query)


@pytest.mark.parametrize(
    ("profile", "query"),
    [
        ("mysql", q("t", "a", joins=[join("full", "u", eq("t.a", "u.a"))])), ("mysql", q("t", "a", limit=1)), ("mysql", q(sub(q("t", "a"), "s"), "a")), ("mysql", q("t", "a", sets=[setop("union", q("u", "a"))])),
        ("mysql", q("t", "a", where=m.Exists(q("u", "a")))), ("mysql", q("t", st("area", "g"))), ("mysql", q("t", over("row_number", order=["a"]))), ("mysql", q("t", over("rank"))), ("mysql", q("t", over("sum", "a", order=["a"], frame=("rows", preceding())))),
        ("mysql", q("t", over("rank", order=["a"]), group=["a"])), ("mysql", q("t", fn("sum", "a"), group=[p("x")])), ("sqlserver", q("t", "a", distinct_on=["a"], order=["a"])), ("sqlserver", q("t", st("simplify", "g", p("x")))),
        ("sqlserver", q("t", box("knn_distance", "g", "h"))), ("sqlserver", q("t", "a", joins=[join("left", sub(q("u", "a"), "x"), eq("t.a", "x.a"), lateral=True)])), ("open", q("t", "a", joins=[join("right", sub(q("u", "a"), "x"), eq("t.a", "x.a"), lateral=True)])),
    ],
)
def test_profiles_refuse_what_their_servers_lack(profile, query):
    refused(query, "unsupported", profile=profile)


def test_strict_groups():
    refused(q("t", "a", fn("count", star)), profile="mysql")
    refused(q("t", "a", "b", fn("count", star), group=["a"]), profile="mysql")
    validate.query(q("t", "a", fn("count", star), group=["a"], order=[desc(fn("count", star)), asc("a")]), profile="mysql")
    validate.query(q("t", over("rank", order=["a"]), where=any_of(null("a"), all_of(eq("a", p("x"))))), profile="mysql")


def test_reads_and_writes():
    ref = m.ObjectRef("t")
    validate.read(m.Read(ref, ("a",), filter=m.FieldIn("a", ("x",) * 1024)))
    for bad in (m.FieldIn("a", ()), m.FieldIn("a", ("x",) * 1025), m.AllOf(()), m.FieldSpatial("relate", "g", "x"), m.FieldSpatial("intersects", "g"), m.FieldSpatial("d_within", "g", "x"), m.FieldSpatial("is_valid", "g", "x")):
        with pytest.raises(EngineError):
            validate.read(m.Read(ref, filter=bad))
    for w in (
        m.Write(ref, "append", keys=("a",)), m.Write(ref, "update", keys=("a",)), m.Write(ref, "upsert"), m.Write(ref, "delete_by_keys"), m.Write(ref, "update", keys=("a",), update_columns=("a",)), m.Write(ref, "create", update_columns=("a",)),
        m.Write(ref, "append", transaction_profile="read_only"), m.Write(ref, "append", transaction_profile="staged_swap"), m.Write(ref, "append", transaction_profile="chunk_committed"), m.Write(ref, "append", allow_partial=True),
    ):
        with pytest.raises(EngineError):
            validate.write(w)
    with pytest.raises(EngineError):
        validate.write(m.Write(ref, "replace"), profile="mysql")


def test_plans():
    def doc(**change):
        base = {"schema_version": 1, "connection_ref": "env:DB", "provider": "postgres", "operation": {"id": "database.read", "source": {"object": "t", "schema": None}, "projection": ["a"], "row_limit": 5}}
        return json.dumps(base | change)

    valid = plan.parse(doc())
    assert valid.fingerprint == plan.parse(json.dumps(json.loads(doc()), indent=3)).fingerprint != plan.parse(doc(connection_ref="env:X")).fingerprint
    able = plan.capabilities("4.1.2")
    assert plan.prepare(valid, able) is valid
    for bad in (doc(schema_version=2), doc(connection_ref="DB"), doc(connection_ref="env:"), doc(provider="arcgis"), doc(provider="nothing"), doc(extra=1), doc(operation={"id": "database.list_catalogs", "source": {"object": "t"}}), doc(limits={"memory_bytes": 0}), doc(limits={"batch_bytes": 1 << 40})):
        with pytest.raises(EngineError):
            plan.parse(bad)
    layers = plan.parse(doc(provider="arcgis", operation={"id": "arcgis.list_folders"}))
    with pytest.raises(EngineError) as e:
        plan.prepare(layers, able)
    assert e.value.category == "unsupported"
    write = plan.parse(doc(operation={"id": "database.write", "target": {"object": "t"}, "mode": "truncate_insert"}))
    plan.prepare(write, able)
    with pytest.raises(EngineError):
        plan.prepare(plan.parse(doc(operation={"id": "database.write", "target": {"object": "t"}, "mode": "replace"})), plan.capabilities("4.1.2", "mysql"))
