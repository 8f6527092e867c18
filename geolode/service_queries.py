"""Queries that show what surrounds a query: validation, profiles, plans, catalogs, streams, Arrow files, write outcomes, contracts.

Each runs the feature over the tables and returns what it says as rows; the SQL states the same from the tables alone.
"""

from __future__ import annotations

import contextlib
import io
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolode import contract, ewkb
from geolode.cancel import Token
from geolode.engine import Engine
from geolode.errors import EngineError
from geolode.functions import spatial
from geolode.limits import Budget, Limits, ResourceLimits
from geolode.operators import writes
from geolode.plans import model as m
from geolode.plans import plan, validate
from geolode.plans.build import box, c, cmp, desc, eq, fn, following, join, null, over, p, preceding, q, setop, st, star, sub, t
from geolode.plans.parameters import Value
from geolode.queries import _P, FLAGSHIP, box_cell, engine, f64, i32, places, point_cell, query
from geolode.shared import stored
from geolode.sources import catalog, tables


def said(run: Callable[[], object]) -> str:
    """``accepted``, or the category of the error that a call ends in."""
    try:
        run()
    except EngineError as e:
        return e.category
    return "accepted"


def rows(spark: SparkSession, found: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(found, schema)


def values(found: dict[str, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in found.items()) + ") AS v(rule, answer)"


def answers(name: str, cases: dict[str, tuple[str, Callable[[SparkSession, str], object]]]) -> None:
    """A query of rows (rule, answer), one for each case."""

    @query(name, values({k: v[0] for k, v in cases.items()}))
    def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, [(k, said(lambda run=run: run(spark, sf_dir))) for k, (_, run) in cases.items()], "rule string, answer string")


def checked(made: m.Query, **options) -> Callable[[SparkSession, str], object]:
    return lambda spark, sf_dir: validate.query(made, **options)


@contextlib.contextmanager
def target(spark: SparkSession, df: DataFrame | None = None, spatial_index: bool = False) -> Iterator[tuple[Engine, m.ObjectRef]]:
    """A table of its own, gone afterwards."""
    eng, name = Engine(spark), f"geolode_s_{uuid.uuid4().hex}"
    ref = m.ObjectRef(name, None, "default")
    try:
        if df is not None:
            eng.write(m.Write(ref, "create", create_spatial_index=spatial_index), df)
        yield eng, ref
    finally:
        spark.sql(f"DROP TABLE IF EXISTS default.{name}")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal")


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.mark(places(spark, sf_dir).select("event_id", "geom"), "geom", srid=4326, types=("Point",))


# validation and profiles

_DEEP = null("a")
for _ in range(70):
    _DEEP = m.And((_DEEP,))
_TO = eq("t.a", "u.a")
answers("validation_rules", {
    "empty projection": ("invalid_plan", checked(q("t"))),
    "empty identifier": ("invalid_plan", checked(q("t", ""))),
    "identifier with a NUL": ("invalid_plan", checked(q("t", "a\0"))),
    "identifier too long": ("invalid_plan", checked(q("t", c("x" * 300)))),
    "filter is no condition": ("invalid_plan", checked(q("t", "a", where=c("a")))),
    "nothing in AND": ("invalid_plan", checked(q("t", "a", where=m.And(())))),
    "join without a condition": ("invalid_plan", checked(q("t", "a", joins=[join("inner", "u")]))),
    "cross join with a condition": ("invalid_plan", checked(q("t", "a", joins=[join("cross", "u", _TO)]))),
    "one alias twice": ("invalid_plan", checked(q("t", "a", joins=[join("inner", t("u", "t"), eq("a", "b"))]))),
    "condition sees a later join": ("invalid_plan", checked(q("t", "a", joins=[join("inner", "u", eq("t.a", "v.a")), join("inner", "v", eq("u.a", "v.a"))]))),
    "aggregate in an aggregate": ("invalid_plan", checked(q("t", fn("sum", fn("sum", "a"))))),
    "aggregate in a filter": ("invalid_plan", checked(q("t", "a", where=cmp(fn("sum", "a"), "gt", p("x"))))),
    "aggregate in a group": ("invalid_plan", checked(q("t", "a", group=[fn("sum", "a")]))),
    "offset without a limit": ("invalid_plan", checked(q("t", "a", offset=3))),
    "DISTINCT beside DISTINCT ON": ("invalid_plan", checked(q("t", "a", distinct=True, distinct_on=["a"], order=["a"]))),
    "DISTINCT ON before its order": ("invalid_plan", checked(q("t", "a", distinct_on=["a"], order=["b", "a"]))),
    "sides of a set differ in columns": ("invalid_plan", checked(q("t", "a", sets=[setop("union", q("u", "a", "b"))]))),
    "frame from later to earlier": ("invalid_plan", checked(q("t", over("sum", "a", order=["a"], frame=("rows", following(2), preceding(1)))))),
    "rank without OVER": ("invalid_plan", checked(q("t", fn("rank")))),
    "lower over a window": ("invalid_plan", checked(q("t", over("lower", "a")))),
    "distance as a condition": ("invalid_plan", checked(q("t", "a", where=box("knn_distance", "g", "h")))),
    "function with too few arguments": ("invalid_plan", checked(q("t", st("buffer", "a")))),
    "nested too deeply": ("invalid_plan", checked(q("t", "a", where=_DEEP))),
    "too many nodes": ("invalid_plan", checked(q("t", *["a"] * 5000))),
    "the flagship": ("accepted", checked(FLAGSHIP)),
    "read of a missing column": ("not_found", lambda spark, d: engine(spark, d, "nation").read(m.Read(m.ObjectRef("nation"), ("no_such",)))),
    "filter on a missing column": ("not_found", lambda spark, d: engine(spark, d, "nation").read(m.Read(m.ObjectRef("nation"), filter=m.FieldIsNull("no_such")))),
})
_CASES = {
    "full join": q("t", "t.a", joins=[join("full", "u", _TO)]),
    "limit without order": q("t", "a", limit=1),
    "derived table": q(sub(q("t", "a"), "s"), "a"),
    "set operation": q("t", "a", sets=[setop("union", q("u", "a"))]),
    "EXISTS": q("t", "a", where=m.Exists(q("u", "a"))),
    "spatial function": q("t", st("area", "g")),
    "simplify": q("t", st("simplify", "g", p("x"))),
    "box operator": q("t", box("knn_distance", "g", "h")),
    "DISTINCT ON": q("t", "a", distinct_on=["a"], order=["a"]),
    "lateral left join": q("t", "t.a", joins=[join("left", sub(q("u", "a"), "x"), eq("t.a", "x.a"), lateral=True)]),
    "ungrouped column": q("t", "a", fn("count", star)),
    "order by a window": q("t", "a", (over("rank", order=["a"]), "r"), order=[desc("a")], limit=5),
}
_LACKS = {
    "mysql": {k: "unsupported" for k in _CASES} | {"ungrouped column": "invalid_plan", "order by a window": "accepted"},
    "sqlserver": {"simplify": "unsupported", "box operator": "unsupported", "DISTINCT ON": "unsupported", "lateral left join": "unsupported"},
}


@query("profile_matrix", "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{k}', '{_LACKS.get(f, {}).get(k, 'accepted')}')" for f in ("open", "postgres", "mysql", "sqlserver") for k in _CASES) + ") AS v(profile, feature, answer)")
def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each profile accepts before anything runs."""
    found = [(f, k, said(lambda f=f, made=made: validate.query(made, profile=f))) for f in ("open", "postgres", "mysql", "sqlserver") for k, made in _CASES.items()]
    return rows(spark, found, "profile string, feature string, answer string")


answers("spatial_preflight", {
    "same SRIDs": ("accepted", lambda spark, d: Engine(spark, {"e": marked(spark, d)}).query(q("e", "event_id", where=st("intersects", "geom", p("g"))), {"g": point_cell(1, 2)})),
    "different SRIDs": ("crs", lambda spark, d: Engine(spark, {"e": marked(spark, d)}).query(q("e", "event_id", where=st("intersects", "geom", p("g"))), {"g": point_cell(1, 2, 3857)})),
    "SRIDs made equal": ("accepted", lambda spark, d: Engine(spark, {"e": marked(spark, d)}).query(q("e", "event_id", where=st("intersects", st("transform", "geom", p("s")), p("g"))), {"g": point_cell(1, 2, 3857), "s": i32(3857)})),
    "different SRIDs in a join": ("crs", lambda spark, d: Engine(spark, {"e": marked(spark, d), "f": contract.mark(marked(spark, d), "geom", srid=3857)}).query(q(t("e", "e"), "e.event_id", joins=[join("inner", t("f", "f"), st("intersects", "e.geom", "f.geom"))]))),
    "operator with different SRIDs": ("crs", lambda spark, d: Engine(spark, {"e": marked(spark, d)}).query(q("e", "event_id", order=[box("knn_distance", "geom", p("g"))], limit=1), {"g": point_cell(1, 2, 3857)})),
    "shape of a number": ("schema", lambda spark, d: Engine(spark, {"e": marked(spark, d)}).query(q("e", st("area", "event_id")))),
})


# plans

def _document(**change) -> str:
    base = {"schema_version": 1, "connection_ref": "env:DB", "provider": "postgres", "operation": {"id": "database.read", "source": {"object": "nation"}, "projection": ["n_name"], "filter": {"op": "gte", "field": "n_nationkey", "parameter": "least"}}}
    return json.dumps(base | change)


@query("plan_document", "SELECT n_name FROM nation WHERE n_nationkey >= 20")
def _plan_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan parsed, validated, matched with what the engine can do, and run."""
    return engine(spark, sf_dir, "nation").execute(_document(), {"least": i32(20)})


_ABLE = plan.capabilities("4.1.2")
answers("plan_rules", {
    "good": ("accepted", lambda *_: plan.prepare(plan.parse(_document()), _ABLE)),
    "fingerprint follows content, not layout": ("accepted", lambda *_: said(lambda: None) if plan.parse(_document()).fingerprint == plan.parse(json.dumps(json.loads(_document()), indent=2)).fingerprint != plan.parse(_document(connection_ref="env:X")).fingerprint else 1 / 0),
    "unknown version": ("invalid_plan", lambda *_: plan.parse(_document(schema_version=2))),
    "connection without a prefix": ("invalid_plan", lambda *_: plan.parse(_document(connection_ref="DB"))),
    "connection without a name": ("invalid_plan", lambda *_: plan.parse(_document(connection_ref="secret:"))),
    "unknown key": ("invalid_plan", lambda *_: plan.parse(_document(extra=1))),
    "no memory": ("invalid_plan", lambda *_: plan.parse(_document(limits={"memory_bytes": 0}))),
    "operation without an adapter": ("unsupported", lambda *_: plan.prepare(plan.parse(_document(provider="arcgis", operation={"id": "arcgis.list_folders"})), _ABLE)),
    "replace where only appends are": ("unsupported", lambda *_: plan.prepare(plan.parse(_document(operation={"id": "database.write", "target": {"object": "t"}, "mode": "replace"})), plan.capabilities("4.1.2", "mysql"))),
    "chunks are no transaction of this engine": ("unsupported", lambda *_: validate.write(m.Write(m.ObjectRef("t"), "append", transaction_profile="chunk_committed"))),
    "read-only writes": ("invalid_plan", lambda *_: validate.write(m.Write(m.ObjectRef("t"), "append", transaction_profile="read_only"))),
    "keys on an append": ("invalid_plan", lambda *_: validate.write(m.Write(m.ObjectRef("t"), "append", keys=("a",)))),
    "an upsert without keys": ("invalid_plan", lambda *_: validate.write(m.Write(m.ObjectRef("t"), "upsert"))),
})


# catalogs

@query("connection_probe", "SELECT true AS ok")
def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, [(bool(Engine(spark).inspect(m.Operation("database.test_connection"))["document"]["ok"]),)], "ok boolean")


@query("catalog_lists", "SELECT * FROM (VALUES ('catalog', 'spark_catalog'), ('object', 'table'), ('schema', 'default')) AS v(level, name)")
def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session's catalog, its schema, and the kind of a table that was just written."""
    with target(spark, suppliers(spark, sf_dir)) as (eng, ref):
        ask = lambda op, body=None: eng.inspect(m.Operation(op, body))["document"]
        found = [("catalog", n) for n in ask("database.list_catalogs") if n == "spark_catalog"] + [("schema", n) for n in ask("database.list_schemas") if n == "default"]
        found += [("object", o["kind"]) for o in ask("database.list_objects", m.ObjectRef("", None, "default")) if o["name"] == ref.object]
    return rows(spark, found, "level string, name string")


@query("catalog_describe", "SELECT * FROM (VALUES (0, 's_suppkey', 'bigint'), (1, 's_name', 'string'), (2, 's_acctbal', 'double')) AS v(ordinal, name, type)")
def _describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with target(spark, suppliers(spark, sf_dir)) as (eng, ref):
        document = eng.inspect(m.Operation("database.describe_object", ref))["document"]
    return rows(spark, [(x["ordinal"], x["name"], x["type"]) for x in document["columns"]], "ordinal int, name string, type string")


answers("catalog_rules", {
    "catalog that is served": ("accepted", lambda spark, d: Engine(spark, catalogs={"spark_catalog"}).inspect(m.Operation("database.list_schemas"))),
    "catalog that is not served": ("not_found", lambda spark, d: Engine(spark, catalogs={"spark_catalog"}).query(q(m.Source(m.ObjectRef("t", "elsewhere", "default")), "a"))),
    "object that is not there": ("not_found", lambda spark, d: catalog.describe(spark, m.ObjectRef("geolode_no_such_table", None, "default"))),
    "layers have no adapter": ("unsupported", lambda spark, d: Engine(spark).inspect(m.Operation("arcgis.list_folders"))),
    "secret that is not set": ("invalid_configuration", lambda spark, d: tables.resolve_secret("env:GEOLODE_NO_SUCH_SECRET")),
})


@query("secrets_redacted", "SELECT false AS shown")
def _redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a connection string or a bound value shows where it is printed."""
    secret, value = tables.Secret("password=hidden"), Value("string", "hidden")
    return rows(spark, [("hidden" in f"{secret} {secret!r} {value} {value!r} {tables.Jdbc('derby', secret)!r}",)], "shown boolean")


# batches, Arrow files, budgets

@query("stream_batches", "SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total, true AS bounded FROM events")
def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a read, pulled as Arrow batches of bounded size, and summed from them."""
    eng = engine(spark, sf_dir, "events")
    stream, total = eng.stream(eng.read(m.Read(m.ObjectRef("events"), ("event_id", "user_id"))), size="low_latency"), 0
    bounded = True
    for batch in stream:
        bounded &= batch.num_rows <= 1024
        total += sum(batch.column(0).to_pylist())
    return rows(spark, [(stream.metrics.rows, total, bounded)], "n bigint, total bigint, bounded boolean")


@query("arrow_round_trip", "SELECT * FROM nation")
def _arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table through an Arrow file."""
    eng = engine(spark, sf_dir, "nation")
    with tempfile.TemporaryDirectory() as folder:
        tables.write_ipc(eng.stream(eng.read(m.Read(m.ObjectRef("nation")))), path := os.path.join(folder, "nation.arrow"))
        return stored(tables.from_ipc(spark, path))


@query("arrow_inspect", f"SELECT count(*) AS n, count(*) AS cells, 'Point' AS kinds, 4326 AS srid FROM {_P} WHERE event_id % 10 = 0")
def _arrow_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An Arrow file's contract, and every geometry in it, checked."""
    df = marked(spark, sf_dir).filter("event_id % 10 = 0")
    with tempfile.TemporaryDirectory() as folder:
        tables.write_ipc(Engine(spark).stream(df), path := os.path.join(folder, "places.arrow"))
        facts = tables.inspect_ipc(path)
    one = facts["geometries"][0]
    return rows(spark, [(facts["rows"], one["cells"], ",".join(one["types"]), one["srids"][0])], "n bigint, cells bigint, kinds string, srid int")


def _read_all(spark: SparkSession, sf_dir: str, budget: Budget | None = None, token: Token | None = None, limits: Limits | None = None) -> None:
    eng = Engine(spark, {"nation": spark.read.parquet(f"{sf_dir.rstrip('/')}/nation.parquet")}, limits=limits)
    list(eng.stream(eng.read(m.Read(m.ObjectRef("nation"))), budget, token))


def _cancelled() -> Token:
    token = Token()
    token.cancel()
    return token.child()


answers("budget_rules", {
    "within the budget": ("accepted", lambda spark, d: _read_all(spark, d)),
    "too many rows": ("resource_limit", lambda spark, d: _read_all(spark, d, Budget(ResourceLimits(rows=5)))),
    "too many bytes": ("resource_limit", lambda spark, d: _read_all(spark, d, Budget(ResourceLimits(output_bytes=50)))),
    "too many columns": ("resource_limit", lambda spark, d: _read_all(spark, d, Budget(ResourceLimits(columns=1)))),
    "no operation allowed": ("resource_limit", lambda spark, d: _read_all(spark, d, Budget(ResourceLimits(concurrent_operations=0)))),
    "cancelled by its parent": ("cancelled", lambda spark, d: _read_all(spark, d, token=_cancelled())),
    "deadline passed": ("timeout", lambda spark, d: _read_all(spark, d, token=Token(timeout_s=0))),
    "batch larger than memory": ("invalid_plan", lambda spark, d: Limits(memory_bytes=10, batch_bytes=20).check()),
    "cell that is no geometry": ("data_mapping", lambda spark, d: ewkb.inspect(b"\1\2")),
})


@query("read_diagnostics", "SELECT max(event_id) - 1 AS source_row, 'geom' AS field FROM events")
def _read_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place in the whole result of the one cell that is no geometry: the last. The table is read to its end, so neither a deadline nor a count of shapes may stop the read."""
    n = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").agg(F.max("event_id")).first()[0]
    good = spatial.point(spark, F.lit(1), F.lit(2))
    df = contract.mark(spark.range(1, n + 1, 1, max(5, n // 500_000)).select("id", F.when(F.col("id") == n, F.lit(b"\1\2")).otherwise(good).alias("geom")), "geom")
    try:
        for _ in Engine(spark).stream(df, Budget(ResourceLimits(duration_s=None, geometry_components=None))):
            pass
    except EngineError as e:
        return rows(spark, [(e.source_row, e.field)], "source_row bigint, field string")
    raise AssertionError("the cell went unnoticed")


@query("error_envelope", "SELECT 'not_found' AS category, 'prepare' AS phase, 'none' AS effect, 'never' AS retry, 1 AS exit_code")
def _envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line prints of an error."""
    from geolode import cli

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        code = cli.main(["read-summary", "geolode_no_such_table"])
    e = json.loads(out.getvalue())["error"]
    return rows(spark, [(e["category"], e["phase"], e["effect"], e["retry"]["kind"], code)], "category string, phase string, effect string, retry string, exit_code int")


@query("command_line_summary", "SELECT count(*) AS n FROM nation")
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geolode import cli

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        cli.main(["read-summary", "nation", "--table", f"nation={sf_dir.rstrip('/')}/nation.parquet"])
    return rows(spark, [(json.loads(out.getvalue())["result"]["rows"],)], "n bigint")


# writes

def _changed(base: DataFrame) -> DataFrame:
    return base.filter("s_suppkey % 2 = 0").select((F.col("s_suppkey") + F.when(F.col("s_suppkey") % 4 == 0, 1_000_000).otherwise(0)).alias("s_suppkey"), F.concat("s_name", F.lit("*")).alias("s_name"), "s_acctbal")


@query(
    "write_outcomes",
    """SELECT mode, 'committed' AS status, received, inserted, updated, deleted FROM (
    SELECT 1 AS o, 'append' AS mode, count(*) AS received, count(*) AS inserted, NULL::BIGINT AS updated, NULL::BIGINT AS deleted FROM supplier WHERE s_suppkey % 2 = 0
    UNION ALL SELECT 2, 'upsert', count(*), count(*) FILTER (s_suppkey % 4 = 0), count(*) FILTER (s_suppkey % 4 <> 0), NULL FROM supplier WHERE s_suppkey % 2 = 0
    UNION ALL SELECT 3, 'update', count(*), NULL, count(*) FILTER (s_suppkey % 4 <> 0), NULL FROM supplier WHERE s_suppkey % 2 = 0
    UNION ALL SELECT 4, 'delete_by_keys', count(*), NULL, NULL, count(*) FILTER (s_suppkey % 4 <> 0) FROM supplier WHERE s_suppkey % 2 = 0)""",
)
def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that each kind of write reports."""
    base, found = suppliers(spark, sf_dir), []
    new = _changed(base)
    for mode in ("append", "upsert", "update", "delete_by_keys"):
        with target(spark, base) as (eng, ref):
            keys = () if mode == "append" else ("s_suppkey",)
            out = eng.write(m.Write(ref, mode, keys=keys, update_columns=("s_name",) if mode == "update" else ()), new.select("s_suppkey") if mode == "delete_by_keys" else new)
            found.append((mode, out.status, out.received, out.inserted, out.updated, out.deleted))
    return rows(spark, found, "mode string, status string, received bigint, inserted bigint, updated bigint, deleted bigint")


@query("write_schema_evolution", "SELECT s_suppkey, s_name, s_acctbal, NULL::INTEGER AS grade FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name, s_acctbal, 7 FROM supplier WHERE s_suppkey % 2 = 0")
def _evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that the target lacks is added to it; rows from before have none."""
    base = suppliers(spark, sf_dir)
    with target(spark, base) as (eng, ref):
        new = base.filter("s_suppkey % 2 = 0").withColumns({"s_suppkey": F.col("s_suppkey") + 1_000_000, "grade": F.lit(7)})
        eng.write(m.Write(ref, "append"), new, evolve=True)
        return stored(spark.table(f"default.{ref.object}"))


@query("write_loss_report", "SELECT * FROM (VALUES ('extra', 'missing_column', 'data_loss'), ('s_acctbal', 'native_type', 'warning') , ('s_suppkey', 'type_widened', 'information')) AS v(field, category, severity)")
def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an append would lose, before anything is written."""
    base = suppliers(spark, sf_dir)
    with target(spark, base.withColumn("s_acctbal", F.col("s_acctbal").cast("string"))) as (eng, ref):
        other = base.select(F.col("s_suppkey").cast("int").alias("s_suppkey"), "s_name", "s_acctbal", F.lit(1).alias("extra"))
        report = eng.prepare_write(m.Write(ref, "append", "lossy"), other).report
    return rows(spark, [(x.column, x.category, x.severity) for x in report.losses], "field string, category string, severity string")


@query("write_diagnostics", "SELECT 'data_mapping' AS category, 'rolled_back' AS effect, count(*) AS total, count(*) FILTER (s_suppkey % 40 = 7) AS rejected, min(s_suppkey) FILTER (s_suppkey % 40 = 7) AS first_key FROM supplier")
def _refused_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a target refuses: how many, and where the first of them stands in the input."""
    base = suppliers(spark, sf_dir)
    bad = base.withColumn("k", F.when(F.col("s_suppkey") % 40 != 7, F.col("s_suppkey"))).select(F.col("k").alias("s_suppkey"), "s_name", "s_acctbal")
    with target(spark, base) as (eng, ref):
        try:
            eng.write(m.Write(ref, "upsert", keys=("s_suppkey",)), bad)
        except EngineError as e:
            at = e.diagnostics.examples[0]["source_row_zero_based"]
            first = [r.s_suppkey for r in base.select("s_suppkey").limit(at + 1).collect()][at]
            return rows(spark, [(e.category, e.effect, e.diagnostics.total, e.diagnostics.rejected, first)], "category string, effect string, total bigint, rejected bigint, first_key bigint")
    raise AssertionError("the rows went unnoticed")


@query("write_faults", "SELECT step, answer, count(*) AS n FROM supplier, (VALUES ('before_publish', 'rolled_back'), ('publishing', 'rolled_back'), ('staged', 'rolled_back')) AS v(step, answer) GROUP BY 1, 2")
def _faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write that breaks at a step leaves the target as it was."""
    base, found = suppliers(spark, sf_dir), []
    for step in ("staged", "before_publish", "publishing"):
        with target(spark, base) as (eng, ref):

            def fault(at: str, step: str = step) -> None:
                if at == step:
                    raise RuntimeError(at)

            try:
                eng.write(m.Write(ref, "truncate_insert"), base.limit(1), fault=fault)
                found.append((step, "committed", 0))
            except EngineError as e:
                found.append((step, e.effect, spark.table(f"default.{ref.object}").count()))
    return rows(spark, found, "step string, answer string, n bigint")


def _write(spark: SparkSession, base: DataFrame, op: Callable[[m.ObjectRef], m.Write], source: DataFrame) -> None:
    with target(spark, base) as (eng, ref):
        eng.write(op(ref), source)


_KEY = ("s_suppkey",)
answers("write_rules", {
    "good keys": ("accepted", lambda spark, d: _write(spark, suppliers(spark, d), lambda r: m.Write(r, "upsert", keys=_KEY), suppliers(spark, d))),
    "key that is null": ("data_mapping", lambda spark, d: _write(spark, suppliers(spark, d), lambda r: m.Write(r, "upsert", keys=_KEY), suppliers(spark, d).limit(1).withColumn("s_suppkey", F.lit(None).cast("bigint")))),
    "key that stands twice": ("conflict", lambda spark, d: _write(spark, suppliers(spark, d), lambda r: m.Write(r, "upsert", keys=_KEY), suppliers(spark, d).union(suppliers(spark, d)))),
    "target that exists": ("conflict", lambda spark, d: _write(spark, suppliers(spark, d), lambda r: m.Write(r, "create"), suppliers(spark, d))),
    "target that is not there": ("not_found", lambda spark, d: Engine(spark).write(m.Write(m.ObjectRef("geolode_no_such_table", None, "default"), "append"), suppliers(spark, d))),
    "type that does not fit": ("data_mapping", lambda spark, d: _write(spark, suppliers(spark, d), lambda r: m.Write(r, "append"), suppliers(spark, d).withColumn("s_acctbal", F.lit("x")))),
    "shape of another type": ("data_mapping", lambda spark, d: _write(spark, marked(spark, d), lambda r: m.Write(r, "replace", transaction_profile="staged_swap"), contract.mark(marked(spark, d), "geom", srid=4326, types=("Polygon",)))),
    "shape with another SRID": ("crs", lambda spark, d: _write(spark, marked(spark, d), lambda r: m.Write(r, "replace", transaction_profile="staged_swap"), contract.mark(marked(spark, d), "geom", srid=3857, types=("Point",)))),
    "CRS that is not in the catalogue": ("crs", lambda spark, d: _write(spark, marked(spark, d), lambda r: m.Write(r, "replace", transaction_profile="staged_swap"), marked(spark, d).withMetadata("geom", marked(spark, d).schema["geom"].metadata | {"geolode.geometry.crs_id": "EPSG:9999", "geolode.geometry.srid": "9999"}))),
    "outcome at odds with itself": ("internal", lambda spark, d: writes.Outcome("rolled_back", 1, 1).checked()),
})


@query("spatial_index_read", f"SELECT event_id FROM {_P} WHERE x BETWEEN -40 AND 15 AND y BETWEEN 3 AND 25")
def _index_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read of a table whose writes keep the boxes of its shapes: ranges over them prune files and row groups."""
    df = marked(spark, sf_dir)
    with target(spark, df.filter("event_id % 2 = 0"), spatial_index=True) as (eng, ref):
        eng.write(m.Write(ref, "append"), df.filter("event_id % 2 = 1"))
        return stored(eng.read(m.Read(ref, ("event_id",), filter=m.FieldSpatial("intersects", "geom", "g")), {"g": box_cell(-40, 3, 15, 25)}))


# contracts

@query("column_profile", f"SELECT count(*) AS cells, 4326 AS srid, 2 AS dims, 'Point' AS kinds FROM {_P}")
def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over a geometry column."""
    found = Engine(spark).profile_geometry(marked(spark, sf_dir), "geom")
    return rows(spark, [(found["cells"], found["srid"], found["dimensions"], ",".join(found["types"]))], "cells bigint, srid int, dims int, kinds string")


@query("output_profile", "SELECT * FROM (VALUES ('centre', NULL, 'unknown'), ('deep', '4326', 'xyz'), ('geom', '4326', 'xy'), ('moved', '3857', 'xy')) AS v(field, srid, dims)")
def _output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract that a result's geometry columns carry."""
    made = q("e", "geom", (st("transform", "geom", p("s")), "moved"), (st("force_3d", "geom", p("z")), "deep"), (st("centroid", st("collect", "u", "u")), "centre"))
    e = marked(spark, sf_dir).withColumn("u", spatial.point(spark, F.lit(1), F.lit(2), 0))
    out = Engine(spark, {"e": e}).query(made, {"s": i32(3857), "z": f64(0)})
    found = [(f.name, contract.keys(f).get("srid"), contract.keys(f)["dimensions"]) for f in out.schema.fields]
    return rows(spark, found, "field string, srid string, dims string")


@query("result_schema", "SELECT * FROM (VALUES (0, 'n_name', 'string'), (1, 'revenue', 'double'), (2, 'orders', 'bigint')) AS v(ordinal, name, type)")
def _schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's columns and types, known before it runs."""
    out = engine(spark, sf_dir, "orders", "customer", "nation").query(FLAGSHIP)
    return rows(spark, [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(out.schema.fields)], "ordinal int, name string, type string")


answers("crs_catalogue", {
    **{f"EPSG:{k}": ("accepted", lambda spark, d, k=k: contract.check_field(contract.mark(marked(spark, d), "geom", srid=k).schema["geom"])) for k in (4326, 3857, 32633)},
    "id and SRID differ": ("crs", lambda spark, d: contract.check_field((x := marked(spark, d)).withMetadata("geom", x.schema["geom"].metadata | {"geolode.geometry.crs_id": "EPSG:3857"}).schema["geom"])),
    "missing CRS with an id": ("crs", lambda spark, d: contract.check_field((x := marked(spark, d)).withMetadata("geom", x.schema["geom"].metadata | {"geolode.geometry.crs_resolution": "missing"}).schema["geom"])),
    "unknown dimensions": ("schema", lambda spark, d: contract.check_field((x := marked(spark, d)).withMetadata("geom", x.schema["geom"].metadata | {"geolode.geometry.dimensions": "xyq"}).schema["geom"])),
})
