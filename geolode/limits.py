"""Limits on plans and on what a call may hold, and the budget that keeps count of it."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, fields

from geolode.errors import EngineError, invalid

MIB = 1 << 20


@dataclass(frozen=True)
class Limits:
    max_batches: int = 65_536
    memory_bytes: int = 512 * MIB
    batch_bytes: int = 16 * MIB
    cell_bytes: int = 64 * MIB
    timeout_ms: int = 30_000
    plan_bytes: int = 4 * MIB
    identifier_bytes: int = 256
    max_depth: int = 64
    max_nodes: int = 4_096

    def check(self) -> Limits:
        for f in fields(self):
            value = getattr(self, f.name)
            if not isinstance(value, int) or isinstance(value, bool) or value <= 0:
                raise invalid(f"limit {f.name} must be a positive integer")
        if self.batch_bytes > self.memory_bytes:
            raise invalid("a batch may not be larger than the memory limit")
        return self


@dataclass(frozen=True)
class ResourceLimits:
    memory_bytes: int = 512 * MIB
    rows: int | None = None
    output_bytes: int | None = None
    columns: int = 65_536
    geometry_components: int | None = 16_777_216
    nesting: int = 64
    concurrent_operations: int = 64
    duration_s: float | None = 30.0
    spill_bytes: int = 4 << 30
    cell_bytes: int = 64 * MIB


class Budget:
    """Counts what a result has used; a lease gives its memory back when it is closed."""

    def __init__(self, limits: ResourceLimits | None = None):
        self.limits = limits or ResourceLimits()
        self._lock = threading.Lock()
        self._began = time.monotonic()
        self.memory = self.rows = self.output_bytes = self.components = self.operations = 0

    def _over(self, what: str) -> EngineError:
        return EngineError("resource_limit", f"over the limit of {what}", "read")

    def lease(self, size: int) -> Lease:
        with self._lock:
            if self.memory + size > self.limits.memory_bytes:
                raise self._over("memory")
            self.memory += size
        return Lease(self, size)

    def operation(self) -> Lease:
        with self._lock:
            if self.operations + 1 > self.limits.concurrent_operations:
                raise self._over("concurrent operations")
            self.operations += 1
        return Lease(self, 0, 1)

    def used(self, rows: int = 0, output_bytes: int = 0, components: int = 0, columns: int = 0) -> None:
        with self._lock:
            self.rows += rows
            self.output_bytes += output_bytes
            self.components += components
            for what, now, most in (
                ("rows", self.rows, self.limits.rows),
                ("output bytes", self.output_bytes, self.limits.output_bytes),
                ("geometry components", self.components, self.limits.geometry_components),
                ("columns", columns, self.limits.columns),
                ("duration", time.monotonic() - self._began, self.limits.duration_s),
            ):
                if most is not None and now > most:
                    raise self._over(what)


class Lease:
    def __init__(self, budget: Budget, size: int, operations: int = 0):
        self._budget, self._size, self._operations = budget, size, operations

    def close(self) -> None:
        with self._budget._lock:
            self._budget.memory -= self._size
            self._budget.operations -= self._operations
        self._size = self._operations = 0

    def __enter__(self) -> Lease:
        return self

    def __exit__(self, *_) -> None:
        self.close()
