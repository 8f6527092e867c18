"""Strict JSON for the query model: tagged variants, no unknown keys, no missing ones, nothing converted."""

from __future__ import annotations

import functools
import json
import types
import typing
from dataclasses import MISSING, fields, is_dataclass

from geolode.errors import invalid
from geolode.limits import Limits
from geolode.plans import model

_SKIP_WHEN_EMPTY = {"derived_source", "lateral", "distinct_on", "set_operations", "row_offset", "locking", "all", "recursive"}


@functools.cache
def _hints(cls: type) -> dict:
    return typing.get_type_hints(cls, vars(model))


@functools.cache
def _variants(base: type) -> dict[str, type]:
    found, open_ = {}, [base]
    while open_:
        cls = open_.pop()
        open_ += cls.__subclasses__()
        if is_dataclass(cls) and "TAG" in vars(cls):
            found[cls.TAG[1]] = cls
    return found


def decode(kind, value, at: str = "$"):
    """A JSON value as the model type ``kind``; anything that does not fit exactly is an invalid plan."""
    origin = typing.get_origin(kind)
    if origin in (typing.Union, types.UnionType):
        options = typing.get_args(kind)
        if value is None and type(None) in options:
            return None
        for option in (o for o in options if o is not type(None)):
            if option in (int, str) and type(value) is not option:
                continue
            return decode(option, value, at)
        raise invalid(f"{at}: wrong type")
    if origin is typing.Literal:
        if not isinstance(value, str) or value not in typing.get_args(kind):
            raise invalid(f"{at}: unknown value")
        return value
    if origin is tuple:
        if not isinstance(value, list):
            raise invalid(f"{at}: a list is needed")
        inner = typing.get_args(kind)[0]
        return tuple(decode(inner, v, f"{at}[{i}]") for i, v in enumerate(value))
    if kind in (str, int, bool, float):
        if type(value) is not kind:
            raise invalid(f"{at}: {kind.__name__} is needed")
        if kind is int and value < 0:
            raise invalid(f"{at}: a negative number")
        return value
    if kind is model.Operation:
        return _operation(value, at)
    if not isinstance(value, dict):
        raise invalid(f"{at}: an object is needed")
    value = dict(value)
    if kind in (model.Expression, model.Filter):
        key = "kind" if kind is model.Expression else "op"
        name = value.pop(key, None)
        chosen = _variants(kind).get(name) if isinstance(name, str) else None
        if chosen is None:
            raise invalid(f"{at}: unknown {key}")
        kind = chosen
    if kind is model.Bound and (value.get("kind") in ("preceding", "following")) != ("offset" in value):
        raise invalid(f"{at}: an offset goes with preceding and following only")
    return _fields(kind, value, at)


def _fields(kind: type, value: dict, at: str):
    hints, given = _hints(kind), {}
    for f in fields(kind):
        if f.name in value:
            given[f.name] = decode(hints[f.name], value.pop(f.name), f"{at}.{f.name}")
        elif f.default is MISSING and f.default_factory is MISSING:
            raise invalid(f"{at}: {f.name} is missing")
    if value:
        raise invalid(f"{at}: unknown field {sorted(value)[0]!r}")
    return kind(**given)


def _operation(value, at: str) -> model.Operation:
    if not isinstance(value, dict) or not isinstance(value.get("id"), str) or value["id"] not in model.OPERATIONS:
        raise invalid(f"{at}: unknown operation")
    value = dict(value)
    name = value.pop("id")
    body = model.OPERATIONS[name]
    if body in (model.Read, model.Write):
        return model.Operation(name, _fields(body, value, at))
    source = value.pop("source", None)
    if value or (body is None and source is not None) or (body == "source" and source is None):
        raise invalid(f"{at}: fields that {name} does not take, or lacks")
    return model.Operation(name, None if source is None else decode(model.ObjectRef, source, f"{at}.source"))


def encode(value):
    """The JSON value of a model object; keys that may be left out are, when empty."""
    if isinstance(value, tuple):
        return [encode(v) for v in value]
    if isinstance(value, model.Operation):
        body = encode(value.body) if value.body is not None else {}
        return {"id": value.id} | (body if isinstance(value.body, model.Read | model.Write) else {"source": body} if body else {})
    if isinstance(value, model.Bound):
        return {"kind": value.kind} | ({} if value.offset is None else {"offset": value.offset})
    if is_dataclass(value):
        out = dict([type(value).TAG]) if hasattr(type(value), "TAG") else {}
        for f in fields(value):
            inner = getattr(value, f.name)
            if f.name in _SKIP_WHEN_EMPTY and not inner and inner != 0:
                continue
            if f.name in _SKIP_WHEN_EMPTY and inner is False:
                continue
            out[f.name] = encode(inner)
        return out
    return value


def canonical(value) -> bytes:
    return json.dumps(encode(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def _no_duplicates(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise invalid("a key stands twice in an object")
    return out


def parse(kind: type, data: bytes | str, limits: Limits | None = None):
    limits = limits or Limits()
    raw = data.encode() if isinstance(data, str) else data
    if len(raw) > limits.plan_bytes:
        raise invalid("the document is larger than its limit")
    try:
        value = json.loads(raw, object_pairs_hook=_no_duplicates)
    except (ValueError, RecursionError) as e:
        raise invalid("not a JSON document") from e
    try:
        return decode(kind, value)
    except RecursionError as e:
        raise invalid("the document is nested too deeply") from e
