"""One error envelope: a category, the phase it arose in, what it left behind, and whether to try again."""

from __future__ import annotations

CATEGORIES = (
    "invalid_plan invalid_configuration schema data_mapping crs unsupported not_found conflict authentication authorization timeout cancelled "
    "resource_limit io protocol transient execution internal"
).split()
PHASES = "validate connect probe prepare read write finalize commit rollback cleanup".split()
EFFECTS = "none rolled_back partial committed unknown".split()
RETRIES = "never quarantine safe requires_idempotency_key requires_recovery after".split()


class EngineError(Exception):
    def __init__(self, category: str, message: str, phase: str = "validate", effect: str = "none", retry: str = "never", delay_ms: int | None = None):
        for value, known in ((category, CATEGORIES), (phase, PHASES), (effect, EFFECTS), (retry, RETRIES)):
            if value not in known:
                raise ValueError(f"unknown {value!r}")
        super().__init__(message)
        self.category, self.message, self.phase, self.effect, self.retry, self.delay_ms = category, message, phase, effect, retry, delay_ms
        #: Rows that a write's target refused, where they were looked for.
        self.diagnostics = None
        #: Where a read found a bad cell: the row in the whole result, from 0, and the column.
        self.source_row, self.field = None, None

    def document(self) -> dict:
        retry = {"kind": self.retry} | ({"delay_ms": self.delay_ms} if self.retry == "after" else {})
        return {"category": self.category, "phase": self.phase, "effect": self.effect, "retry": retry, "message": self.message}


def invalid(message: str) -> EngineError:
    return EngineError("invalid_plan", message)


def unsupported(message: str, phase: str = "validate") -> EngineError:
    return EngineError("unsupported", message, phase)


#: By the leading part of Spark's error condition.
CONDITIONS = {
    "TABLE_OR_VIEW_NOT_FOUND": "not_found",
    "UNRESOLVED_COLUMN": "not_found",
    "SCHEMA_NOT_FOUND": "not_found",
    "PATH_NOT_FOUND": "not_found",
    "TABLE_OR_VIEW_ALREADY_EXISTS": "conflict",
    "PATH_ALREADY_EXISTS": "conflict",
    "RECURSION_LEVEL_LIMIT_EXCEEDED": "resource_limit",
    "RECURSION_ROW_LIMIT_EXCEEDED": "resource_limit",
    "SCALAR_SUBQUERY_TOO_MANY_ROWS": "execution",
    "DATATYPE_MISMATCH": "schema",
    "CAST_INVALID_INPUT": "data_mapping",
    "ARITHMETIC_OVERFLOW": "data_mapping",
    "DIVIDE_BY_ZERO": "data_mapping",
    "NUMERIC_VALUE_OUT_OF_RANGE": "data_mapping",
    "UNSUPPORTED": "unsupported",
    "INVALID_LATERAL_JOIN_TYPE": "unsupported",
    "MISSING_AGGREGATION": "invalid_plan",
    "MISSING_GROUP_BY": "invalid_plan",
    "PARSE_SYNTAX_ERROR": "internal",
    "OPERATION_CANCELED": "cancelled",
}


def from_spark(error: Exception, phase: str) -> EngineError:
    """Spark's own exception in this envelope; values never reach the message, only the condition's name."""
    if isinstance(error, EngineError):
        return error
    condition = getattr(error, "getCondition", lambda: None)() or ""
    category = next((c for k, c in CONDITIONS.items() if condition.startswith(k)), "execution")
    if not condition and "cancel" in str(error).lower():
        category = "cancelled"
    return EngineError(category, condition or type(error).__name__, phase)
