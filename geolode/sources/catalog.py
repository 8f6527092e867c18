"""What a session's catalog holds, as documents."""

from __future__ import annotations

import contextlib
import json

from pyspark.sql import SparkSession

from geolode import contract
from geolode.errors import EngineError, from_spark
from geolode.plans.lower import quoted
from geolode.plans.model import ObjectRef

KINDS = {"MANAGED": "table", "EXTERNAL": "external_table", "VIEW": "view", "TEMPORARY": "view"}


def full_name(ref: ObjectRef) -> str:
    return ".".join(quoted(p) for p in (ref.catalog, ref.schema, ref.object) if p is not None)


def catalogs(spark: SparkSession) -> list[str]:
    return sorted(c.name for c in spark.catalog.listCatalogs())


@contextlib.contextmanager
def _inside(spark: SparkSession, catalog: str | None):
    before = spark.catalog.currentCatalog()
    try:
        if catalog and catalog != before:
            spark.catalog.setCurrentCatalog(catalog)
        yield
    except EngineError:
        raise
    except Exception as e:
        raise from_spark(e, "probe") from e
    finally:
        if spark.catalog.currentCatalog() != before:
            spark.catalog.setCurrentCatalog(before)


def schemas(spark: SparkSession, catalog: str | None = None) -> list[str]:
    with _inside(spark, catalog):
        return sorted(d.name for d in spark.catalog.listDatabases())


def objects(spark: SparkSession, catalog: str | None = None, schema: str | None = None) -> list[dict]:
    with _inside(spark, catalog):
        found = spark.catalog.listTables(schema) if schema else spark.catalog.listTables()
        return [{"name": t.name, "kind": KINDS.get(t.tableType, "table"), "is_partition": False} for t in sorted(found, key=lambda t: t.name)]


def describe(spark: SparkSession, ref: ObjectRef) -> dict:
    """Columns with types and contracts, and a token that changes with the structure. Spark keeps no keys, indexes or row policies."""
    try:
        df = spark.table(full_name(ref))
    except Exception as e:
        raise from_spark(e, "probe") from e
    columns = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable, "ordinal": i, "metadata": dict(f.metadata)} for i, f in enumerate(df.schema.fields)]
    extended: dict = {}
    with contextlib.suppress(Exception):
        extended = json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {full_name(ref)} AS JSON").first()[0])
    relation = {"kind": str(extended.get("type", "view")).lower(), "format": extended.get("provider"), "partition_columns": extended.get("partition_columns", []), "view_text": extended.get("view_text")}
    return {"object": {"catalog": ref.catalog, "schema": ref.schema, "object": ref.object}, "columns": columns, "relation": relation, "constraints": [], "indexes": [], "policies": [], "privileges": [], "token": contract.fingerprint(df.schema)}
