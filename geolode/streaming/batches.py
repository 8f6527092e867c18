"""Results as a stream of Arrow batches of bounded size, encoded on the executors and pulled one at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geolode import contract, ewkb
from geolode.cancel import Token
from geolode.errors import EngineError
from geolode.limits import Budget, Limits

SIZES = {"low_latency": (1_024, 1 << 20), "balanced_bulk": (8_192, 4 << 20)}


@dataclass
class Metrics:
    batches: int = 0
    rows: int = 0
    bytes: int = 0
    largest_batch: int = 0


def _like_points(cells: pa.Array, cell_bytes: int, nesting: int) -> np.ndarray:
    """Which cells have the first one's length and header, where that is a good point: these are good points too."""
    good = np.zeros(len(cells), bool)
    valid = np.ones(len(cells), bool) if not cells.null_count else cells.is_valid().to_numpy(zero_copy_only=False)
    if not valid.any():
        return good
    first = cells[int(valid.argmax())].as_py()
    try:
        cell = ewkb.inspect(first, most_bytes=cell_bytes, most_depth=nesting)
    except EngineError:
        return good
    if cell.geometry_type != "Point":
        return good
    cells = cells.cast(pa.large_binary())
    _, ends, data = cells.buffers()
    ends = np.frombuffer(ends, np.int64, len(cells) + 1, cells.offset * 8)
    at = np.flatnonzero(valid & (np.diff(ends) == len(first)))
    head, data = len(first) - 8 * len(cell.dimensions), np.frombuffer(data, np.uint8)
    good[at] = (data[ends[at][:, None] + np.arange(head)] == np.frombuffer(first, np.uint8, head)).all(axis=1)
    return good


def _encode(rows: int, size: int, schema: pa.Schema, geometry: list[int], cell_bytes: int, nesting: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = 0
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, schema=schema)
            parts = {}
            for g in geometry:
                good = _like_points(batch.column(g), cell_bytes, nesting)
                parts[g] = int(good.sum())
                for k in np.flatnonzero(~good):
                    if (value := batch.column(g)[k].as_py()) is not None:
                        try:
                            parts[g] = parts.get(g, 0) + ewkb.inspect(value, most_bytes=cell_bytes, most_depth=nesting).components
                        except EngineError as e:
                            raise EngineError(e.category, f"[cell {g} {index + k} {e.category}] {e.message}", "read") from e
            index += batch.num_rows
            at = 0
            while at < batch.num_rows:
                n = min(rows, batch.num_rows - at)
                while n > 1 and batch.slice(at, n).nbytes > size:
                    n = -(-n // 2)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, schema) as out:
                    out.write_batch(batch.slice(at, n))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([n], pa.int64()), pa.array([sum(parts.values()) if at == 0 else 0], pa.int64())], names=["data", "n", "components"])
                at += n

    return run


class BatchStream:
    """Pulls a DataFrame batch by batch; ``schema`` holds the fields' contract, also when there are no rows."""

    def __init__(self, df: DataFrame, limits: Limits | None = None, budget: Budget | None = None, token: Token | None = None, size: str = "balanced_bulk"):
        contract.check_schema(df.schema)
        self.limits, self.budget, self.token, self.metrics = limits or Limits(), budget or Budget(), token or Token(), Metrics()
        self.schema = contract.arrow_schema(df.schema)
        self.budget.used(columns=len(self.schema))
        rows, most = SIZES[size]
        geometry = [i for i, f in enumerate(df.schema.fields) if contract.is_spatial(f)]
        code = _encode(rows, min(most, self.limits.batch_bytes), self.schema, geometry, self.limits.cell_bytes, self.budget.limits.nesting)
        self._rows = df.mapInArrow(code, "data binary, n bigint, components bigint")

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        with self.budget.operation():
            for row in self._pulled():
                self.token.check()
                data = bytes(row.data)
                if len(data) > self.limits.batch_bytes + (1 << 16):
                    raise EngineError("resource_limit", "a row is larger than a batch may be", "read")
                with self.budget.lease(len(data)):
                    self.budget.used(rows=row.n, output_bytes=len(data), components=row.components)
                    self.metrics.batches += 1
                    self.metrics.rows += row.n
                    self.metrics.bytes += len(data)
                    self.metrics.largest_batch = max(self.metrics.largest_batch, len(data))
                    if self.metrics.batches > self.limits.max_batches:
                        raise EngineError("resource_limit", "over the limit of batches", "read")
                    with pa.ipc.open_stream(data) as reader:
                        yield reader.read_next_batch()

    def _pulled(self):
        """The encoded batches. Partitions come one after another, and whole, so a bad cell's place in its partition gives its place in all rows."""
        try:
            yield from self._rows.toLocalIterator(prefetchPartitions=False)
        except Exception as e:
            found = re.search(r"\[cell (\d+) (\d+) (\w+)\]", str(e))
            if not found:
                raise
            error = EngineError(found[3], f"{self.schema.names[int(found[1])]}, row {self.metrics.rows + int(found[2])}: a bad cell", "read")
            error.source_row, error.field = self.metrics.rows + int(found[2]), self.schema.names[int(found[1])]
            raise error from e
