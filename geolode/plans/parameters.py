"""Bound values: kept apart from queries, checked, and handed to Spark as named parameters."""

from __future__ import annotations

import datetime as dt
import decimal
import re
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from geolode import ewkb
from geolode.errors import EngineError, invalid

NULL_TYPES = {
    "bool": "boolean", "boolean": "boolean", "i32": "int", "int4": "int", "integer": "int", "int": "int", "i64": "bigint", "int8": "bigint", "bigint": "bigint", "f64": "double", "float8": "double",
    "double": "double", "string": "string", "text": "string", "varchar": "string", "uuid": "string", "json": "string", "jsonb": "string", "bytes": "binary", "bytea": "binary", "wkb": "binary",
    "geometry": "binary", "geography": "binary", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "decimal": "decimal(38,18)", "numeric": "decimal(38,18)",
}
_DECIMAL = re.compile(r"[+-]?\d+(\.\d+)?")
I32, I64 = range(-(1 << 31), 1 << 31), range(-(1 << 63), 1 << 63)


@dataclass(frozen=True)
class Value:
    """A typed value: bool, i32, i64, f64, string, bytes, date, timestamp, timestamp_tz, decimal, uuid, json, wkb or null."""

    type: str
    value: Any = None
    srid: int | None = None

    def __repr__(self) -> str:
        return f"Value({self.type}, ...)"

    def sql(self) -> tuple[Any, str]:
        """A plain value for a named parameter, and the type it is cast to in the text ("": none)."""
        t, v = self.type, self.value
        try:
            if t == "null":
                return None, NULL_TYPES[str(v).lower()]
            if t == "bool" and isinstance(v, bool):
                return v, ""
            if t in ("i32", "i64") and type(v) is int and v in (I32 if t == "i32" else I64):
                return v, "INT" if t == "i32" else "BIGINT"
            if t == "f64" and isinstance(v, float | int) and not isinstance(v, bool):
                return float(v), ""
            if t in ("string", "json") and isinstance(v, str):
                return v, ""
            if t == "bytes" and isinstance(v, bytes | bytearray):
                return bytearray(v), ""
            if t == "date":
                return dt.date.fromisoformat(v), ""
            if t == "timestamp" and (stamp := dt.datetime.fromisoformat(v)).tzinfo is None:
                return stamp.isoformat(sep=" "), "TIMESTAMP_NTZ"
            if t == "timestamp_tz" and (stamp := dt.datetime.fromisoformat(v)).tzinfo is not None:
                return stamp.isoformat(sep=" "), "TIMESTAMP"
            if t == "decimal" and _DECIMAL.fullmatch(v):
                number = decimal.Decimal(v).as_tuple()
                scale = max(0, -number.exponent)
                digits = max(len(number.digits), scale + 1)
                if digits <= 38:
                    return v, f"DECIMAL({digits},{scale})"
            if t == "uuid":
                return str(uuid.UUID(v)), ""
            if t == "wkb" and isinstance(v, bytes | bytearray):
                return bytearray(ewkb.with_srid(bytes(v), self.srid)), ""
        except (KeyError, TypeError, ValueError) as e:
            raise EngineError("data_mapping", f"a parameter is no {t}") from e
        raise EngineError("data_mapping", f"a parameter is no {t}")

    def column(self) -> Column:
        value, cast = self.sql()
        return F.lit(value).cast(cast.lower()) if cast else F.lit(value)


Bag = dict[str, Value]


def needed(bag: Bag, name: str) -> Column:
    if name not in bag:
        raise invalid("a parameter has no value")
    return bag[name].column()


def decode(document: dict) -> Bag:
    """Parameters from JSON: {"name": {"type": "i64", "value": 5}}."""
    out = {}
    for name, x in document.items():
        if not isinstance(x, dict) or not isinstance(x.get("type"), str):
            raise invalid("a parameter needs a type")
        kind, value = x["type"], x.get("value")
        if kind == "wkb":
            out[name] = Value("wkb", bytes(value["bytes"]), value.get("srid"))
        elif kind == "bytes":
            out[name] = Value("bytes", bytes(value))
        elif kind == "null":
            out[name] = Value("null", value["type_name"])
        else:
            out[name] = Value(kind, value)
    return out
