"""Where tables come from: files, other databases over JDBC, Arrow files; and Arrow files as a sink."""

from __future__ import annotations

import contextlib
import os
import tempfile
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from geolode import contract, ewkb
from geolode.errors import EngineError
from geolode.limits import Limits
from geolode.streaming.batches import BatchStream

FORMATS = {"parquet", "orc", "csv", "json", "text"}
DRIVERS = {"postgres": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "derby": "org.apache.derby.jdbc.EmbeddedDriver"}


class Secret:
    """A connection string that never shows in text."""

    def __init__(self, value: str):
        self._value = value

    def reveal(self) -> str:
        return self._value

    def __repr__(self) -> str:
        return "Secret(***)"

    __str__ = __repr__


def resolve_secret(ref: str) -> Secret:
    """``env:NAME``; other kinds of reference have to be resolved by the caller."""
    if ref.startswith("env:") and (value := os.environ.get(ref[4:])):
        return Secret(value)
    raise EngineError("invalid_configuration", "the connection reference cannot be resolved", "connect")


def files(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    if form not in FORMATS:
        raise EngineError("unsupported", f"files of {form}", "connect")
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


@dataclass(frozen=True)
class Jdbc:
    """A database over JDBC. ``partition`` (column, lower, upper, count) makes the read parallel."""

    kind: str
    url: Secret
    options: tuple[tuple[str, str], ...] = ()

    def read(self, spark: SparkSession, table: str, partition: tuple[str, int, int, int] | None = None, fetch: int = 10_000) -> DataFrame:
        if self.kind not in DRIVERS:
            raise EngineError("unsupported", f"{self.kind} has no adapter", "connect")
        given = dict(self.options) | {"url": self.url.reveal(), "dbtable": table, "driver": DRIVERS[self.kind], "fetchsize": str(fetch)}
        if partition:
            column, low, high, count = partition
            given |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(count)}
        return spark.read.format("jdbc").options(**given).load()

    def write(self, df: DataFrame, table: str, mode: str = "append", batch: int = 10_000) -> None:
        given = dict(self.options) | {"url": self.url.reveal(), "dbtable": table, "driver": DRIVERS[self.kind], "batchsize": str(batch)}
        df.write.format("jdbc").options(**given).mode(mode).save()


def write_ipc(stream: BatchStream, path: str, max_bytes: int | None = None) -> dict:
    """A new Arrow file: written beside its place and linked there when whole, never over another file, never in part."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, part = tempfile.mkstemp(prefix=".part-", dir=folder)
    os.close(handle)
    try:
        rows = 0
        with pa.OSFile(part, "wb") as sink, pa.ipc.new_file(sink, stream.schema) as out:
            for batch in stream:
                out.write_batch(batch.replace_schema_metadata(stream.schema.metadata) if stream.schema.metadata else batch)
                rows += batch.num_rows
                if max_bytes is not None and sink.tell() > max_bytes:
                    raise EngineError("resource_limit", "over the limit of output bytes", "write")
        try:
            os.link(part, path)
        except FileExistsError as e:
            raise EngineError("conflict", "the output exists", "write") from e
        return {"rows": rows, "batches": stream.metrics.batches, "bytes": os.path.getsize(path)}
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(part)


def inspect_ipc(path: str, limits: Limits | None = None, most_bytes: int = 512 << 20, most_rows: int = 1_000_000) -> dict:
    """Checks an Arrow file's contract and every geometry in it."""
    limits = limits or Limits()
    try:
        if os.path.getsize(path) > most_bytes:
            raise EngineError("resource_limit", "the file is larger than its limit", "read")
        with pa.memory_map(path) as source, pa.ipc.open_file(source) as reader:
            if reader.num_record_batches > limits.max_batches:
                raise EngineError("resource_limit", "over the limit of batches", "read")
            spatial = {}
            for i, f in enumerate(reader.schema):
                meta = {k.decode(): v.decode() for k, v in (f.metadata or {}).items()}
                if meta.get("ARROW:extension:name") == "geoarrow.wkb" or any(k.startswith(contract.PREFIX + "geometry.") for k in meta):
                    from pyspark.sql import types as T

                    contract.check_field(T.StructField(f.name, T.BinaryType() if pa.types.is_binary(f.type) or pa.types.is_large_binary(f.type) else T.StringType(), f.nullable, meta))
                    spatial[i] = {"field": f.name, "cells": 0, "components": 0, "types": set(), "srids": set()}
            rows = 0
            for b in range(reader.num_record_batches):
                batch = reader.get_batch(b)
                rows += batch.num_rows
                if rows > most_rows:
                    raise EngineError("resource_limit", "over the limit of rows", "read")
                for i, facts in spatial.items():
                    for cell in batch.column(i):
                        if cell.is_valid:
                            c = ewkb.inspect(cell.as_py(), most_bytes=limits.cell_bytes)
                            facts["cells"] += 1
                            facts["components"] += c.components
                            facts["types"].add(c.geometry_type)
                            facts["srids"].add(c.srid)
            shown = [f | {"types": sorted(f["types"]), "srids": sorted(s for s in f["srids"] if s is not None)} for f in spatial.values()]
            return {"rows": rows, "batches": reader.num_record_batches, "fields": reader.schema.names, "geometries": shown}
    except FileNotFoundError as e:
        raise EngineError("not_found", "no such file", "read") from e
    except pa.ArrowException as e:
        raise EngineError("protocol", "not an Arrow file", "read") from e


def from_ipc(spark: SparkSession, path: str, most_bytes: int = 512 << 20) -> DataFrame:
    """An Arrow file as a DataFrame, its geometry contract kept. It is read by the driver, so its size is limited."""
    if os.path.getsize(path) > most_bytes:
        raise EngineError("resource_limit", "the file is larger than its limit", "read")
    with pa.memory_map(path) as source, pa.ipc.open_file(source) as reader:
        table = reader.read_all()
    df = spark.createDataFrame(table)
    for f in table.schema:
        if f.metadata:
            df = df.withMetadata(f.name, {k.decode(): v.decode() for k, v in f.metadata.items()})
    return df
