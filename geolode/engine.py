"""The engine: queries, table reads, writes and inspections over one Spark session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from geolode import contract
from geolode.cancel import Token, running
from geolode.errors import EngineError, from_spark, unsupported
from geolode.functions import spatial
from geolode.functions.catalog import FUNCTIONS
from geolode.limits import Budget, Limits
from geolode.operators import writes
from geolode.plans import model as m
from geolode.plans import plan as plans
from geolode.plans import validate
from geolode.plans.lower import Lowering, quoted, read_frame
from geolode.plans.operands import Operands
from geolode.plans.parameters import Bag
from geolode.sources import catalog
from geolode.streaming.batches import BatchStream


class Engine:
    """``tables`` (name: DataFrame) are seen by their bare names, all other tables by their names in Spark's catalog."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, profile: str = "open", limits: Limits | None = None, catalogs: set[str] | None = None):
        self.spark, self.limits = spark, (limits or Limits()).check()
        self.profile = validate.PROFILES[profile]
        self.catalogs = catalogs
        self._views: dict[str, str] = {}
        self._frames: dict[str, DataFrame] = {}
        for name, df in (tables or {}).items():
            self.add(name, df)

    def add(self, name: str, df: DataFrame) -> None:
        view = f"geolode_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        self._views[name.lower()], self._frames[name.lower()] = view, df

    def close(self) -> None:
        for view in self._views.values():
            self.spark.catalog.dropTempView(view)
        self._views.clear()

    def _resolve(self, ref: m.ObjectRef) -> str:
        if ref.catalog is None and ref.schema is None:
            if ref.object.startswith("geolode_"):
                return quoted(ref.object)
            if ref.object.lower() in self._views:
                return quoted(self._views[ref.object.lower()])
        if ref.catalog is not None and self.catalogs is not None and ref.catalog not in self.catalogs:
            raise EngineError("not_found", "a catalog that this engine does not serve", "prepare")
        if ref.layer_id is not None:
            raise unsupported("layers")
        return catalog.full_name(ref)

    def table(self, ref: m.ObjectRef) -> DataFrame:
        if ref.catalog is None and ref.schema is None and ref.object.lower() in self._frames:
            return self._frames[ref.object.lower()]
        try:
            return self.spark.table(self._resolve(ref))
        except EngineError:
            raise
        except Exception as e:
            raise from_spark(e, "prepare") from e

    def query(self, q: m.Query, bag: Bag | None = None) -> DataFrame:
        """The query's result, lazily; geometry columns carry a contract."""
        validate.query(q, self.limits, self.profile)
        operands = Operands(q, self._schema, bag or {})
        operands.check()
        try:
            df = Lowering(self.spark, self._resolve, bag or {}, self.profile, self.limits).run(q)
        except EngineError:
            raise
        except Exception as e:
            raise from_spark(e, "prepare") from e
        return self._marked(df, q, operands)

    def _schema(self, ref: m.ObjectRef):
        try:
            return self.table(ref).schema
        except EngineError:
            return None

    def _marked(self, df: DataFrame, q: m.Query, operands: Operands) -> DataFrame:
        """Geometry that a function returns gets a contract of its own: encoded, with the SRID and the dimensions that follow from its operands'."""
        if len(df.columns) != len(q.projection) or len(set(df.columns)) < len(df.columns):
            return df
        for name, v in zip(df.columns, q.projection, strict=True):
            if isinstance(v.expression, m.Spatial) and FUNCTIONS[v.expression.function].returns == "geometry" and dict(df.dtypes)[name] == "binary":
                df = contract.mark(df, name, **operands.declared(v.expression))
        return df

    def explain(self, q: m.Query, bag: Bag | None = None) -> str:
        return self.query(q, bag)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def read(self, r: m.Read, bag: Bag | None = None) -> DataFrame:
        validate.read(r, self.limits, self.profile)
        try:
            return read_frame(self.table(r.source), r, bag or {}, self.profile)
        except EngineError:
            raise
        except Exception as e:
            raise from_spark(e, "prepare") from e

    def stream(self, df: DataFrame, budget: Budget | None = None, token: Token | None = None, size: str = "balanced_bulk") -> BatchStream:
        return BatchStream(df, self.limits, budget, token, size)

    def run(self, df: DataFrame, token: Token) -> list:
        with running(self.spark, token):
            try:
                return df.collect()
            except Exception as e:
                token.check()
                raise from_spark(e, "read") from e

    def prepare_write(self, op: m.Write, source: DataFrame, evolve: bool = False) -> writes.Prepared:
        return writes.prepare(self.spark, op, source, self.profile, evolve)

    def write(self, op: m.Write, source: DataFrame, evolve: bool = False, fault=None) -> writes.Outcome:
        return writes.write(self.spark, self.prepare_write(op, source, evolve), evolve, fault)

    def capabilities(self) -> dict:
        return plans.capabilities(self.spark.version, self.profile.name)

    def inspect(self, op: m.Operation) -> dict:
        """Listings and descriptions, as documents."""
        ref = op.body if isinstance(op.body, m.ObjectRef) else None
        if op.id == "database.test_connection":
            return {"operation": op.id, "document": {"ok": self.spark.range(1).count() == 1, "version": self.spark.version}}
        if op.id == "database.list_catalogs":
            return {"operation": op.id, "document": catalog.catalogs(self.spark)}
        if op.id == "database.list_schemas":
            return {"operation": op.id, "document": catalog.schemas(self.spark, ref.catalog if ref else None)}
        if op.id == "database.list_objects":
            return {"operation": op.id, "document": catalog.objects(self.spark, ref.catalog if ref else None, ref.schema if ref else None)}
        if op.id == "database.describe_object":
            return {"operation": op.id, "document": catalog.describe(self.spark, ref)}
        raise unsupported(f"{op.id} is no inspection, or has no adapter")

    def execute(self, document: bytes | str, bag: Bag | None = None, source: DataFrame | None = None):
        """A plan document: an inspection's document, a read's DataFrame, or a write's outcome."""
        valid = plans.prepare(plans.parse(document), self.capabilities())
        body = valid.plan.operation.body
        if isinstance(body, m.Read):
            return self.read(body, bag)
        if isinstance(body, m.Write):
            if source is None:
                raise EngineError("invalid_configuration", "a write needs rows", "prepare")
            return self.write(body, source)
        return self.inspect(valid.plan.operation)

    def profile_geometry(self, df: DataFrame, column: str) -> dict:
        spatial.register(self.spark)
        return contract.profile(df, column)
