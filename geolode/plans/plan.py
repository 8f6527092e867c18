"""Plans as documents: parsed, validated, fingerprinted, and matched with what an engine can do."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from geolode.errors import EngineError, invalid, unsupported
from geolode.functions.catalog import FUNCTIONS
from geolode.functions.spatial import OPERATORS
from geolode.limits import Limits
from geolode.plans import model as m
from geolode.plans import validate, wire

REFERENCES = ("env:", "secret:", "connection:")


@dataclass(frozen=True)
class Valid:
    plan: m.Plan
    fingerprint: str


def parse(data: bytes | str, limits: Limits | None = None) -> Valid:
    return check(wire.parse(m.Plan, data, limits))


def check(plan: m.Plan) -> Valid:
    if plan.schema_version != 1:
        raise invalid("unknown schema version")
    limits = plan.limits.check()
    if not plan.connection_ref.startswith(REFERENCES) or plan.connection_ref in REFERENCES:
        raise invalid("a connection is named by env:, secret: or connection:")
    family = plan.operation.id.split(".")[0]
    if (family == "arcgis") != (plan.provider == "arcgis"):
        raise invalid("the operation is not of the provider's kind")
    body = plan.operation.body
    if isinstance(body, m.Read):
        validate.read(body, limits)
    elif isinstance(body, m.Write):
        validate.write(body, limits)
    if family != "arcgis" and getattr(body, "layer_id", None) is not None:
        raise invalid("a layer belongs to ArcGIS only")
    return Valid(plan, hashlib.sha256(wire.canonical(plan)).hexdigest())


def fingerprint(q: m.Query) -> str:
    """A query's own fingerprint: of its structure, as no value is in it."""
    return hashlib.sha256(wire.canonical(q)).hexdigest()


def capabilities(version: str, profile: str = "open") -> dict:
    p = validate.PROFILES[profile]
    return {
        "engine": "spark",
        "version": version,
        "profile": profile,
        "operations": [k for k in m.OPERATIONS if k.startswith("database.")],
        "write_modes": sorted(p.modes),
        "transaction_profiles": ["single_transaction"] + ["staged_swap"] * bool(p.staged),
        "joins": ["inner", "left", "right", "cross"] + ["full"] * p.full_join,
        "lateral": sorted(p.lateral),
        "recursive": p.tables,
        "distinct_on": p.distinct_on,
        "row_locks": [],
        "functions": [asdict(FUNCTIONS[f]) for f in FUNCTIONS if f in p.spatial],
        "operators": list(OPERATORS) if p.box_operators else [],
        "limits": {"binds": p.binds, "identifier_chars": p.identifier_chars},
        "constraints": False,
        "indexes": False,
        "row_policies": False,
    }


def prepare(valid: Valid, able: dict) -> Valid:
    """Raises where the engine lacks what the plan needs."""
    op = valid.plan.operation
    if op.id not in able["operations"]:
        raise unsupported(f"{op.id} has no adapter", "prepare")
    if isinstance(op.body, m.Write):
        need = "append" if op.body.mode == "truncate_insert" else op.body.mode
        if need not in able["write_modes"]:
            raise unsupported(f"{op.body.mode} writes", "prepare")
        if op.body.transaction_profile not in able["transaction_profiles"]:
            raise unsupported(f"{op.body.transaction_profile} transactions", "prepare")
    return valid


def document(valid: Valid) -> str:
    return json.dumps({"fingerprint": valid.fingerprint, "plan": wire.encode(valid.plan)}, ensure_ascii=False)


__all__ = ["EngineError", "Valid", "capabilities", "check", "document", "fingerprint", "parse", "prepare"]
