"""Cancellation: a tree of tokens with deadlines, and Spark jobs that stop with them."""

from __future__ import annotations

import contextlib
import threading
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

from geolode.errors import EngineError


class Token:
    """Cancelled by request, by its deadline, or with its parent."""

    def __init__(self, parent: Token | None = None, timeout_s: float | None = None):
        self._event, self._reason, self._lock = threading.Event(), None, threading.Lock()
        self._parent, self._calls = parent, []
        self.deadline = None if timeout_s is None else time.monotonic() + timeout_s
        if parent:
            if parent.deadline is not None and (self.deadline is None or parent.deadline < self.deadline):
                self.deadline = parent.deadline
            parent.on_cancel(lambda: self._cancel("parent"))

    def child(self, timeout_s: float | None = None) -> Token:
        return Token(self, timeout_s)

    def _cancel(self, reason: str) -> None:
        with self._lock:
            if self._reason:
                return
            self._reason = reason
            calls, self._calls = self._calls, []
        self._event.set()
        for call in calls:
            call()

    def cancel(self) -> None:
        self._cancel("requested")

    def on_cancel(self, call) -> None:
        with self._lock:
            if not self._reason:
                self._calls.append(call)
                return
        call()

    @property
    def reason(self) -> str | None:
        if not self._reason and self.deadline is not None and time.monotonic() >= self.deadline:
            self._cancel("deadline")
        return self._reason

    def check(self, phase: str = "read") -> None:
        if reason := self.reason:
            raise EngineError("timeout" if reason == "deadline" else "cancelled", f"stopped: {reason}", phase)


@contextlib.contextmanager
def running(spark: SparkSession, token: Token, phase: str = "read") -> Iterator[None]:
    """Jobs started inside are interrupted when the token is cancelled or its deadline passes."""
    token.check(phase)
    tag = f"geolode-{uuid.uuid4().hex}"
    context = spark.sparkContext
    kept = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    context.setJobGroup(tag, "geolode", True)
    token.on_cancel(lambda: context.cancelJobGroup(tag))
    timer = None
    if token.deadline is not None:
        timer = threading.Timer(max(0.0, token.deadline - time.monotonic()), lambda: token.reason)
        timer.daemon = True
        timer.start()
    try:
        yield
    except EngineError:
        raise
    except Exception:
        token.check(phase)
        raise
    finally:
        if timer:
            timer.cancel()
        for k, v in kept.items():
            context.setLocalProperty(k, v)
