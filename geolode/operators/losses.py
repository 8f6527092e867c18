"""What a write would lose: input schema against target schema, before anything is written."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from geolode import contract
from geolode.errors import EngineError

CATEGORIES = (
    "type_widened type_narrowed nullability missing_column extra_column srid crs dimensions geometry_type precision collation native_type default_value index"
).split()
SEVERITIES = ("information", "warning", "data_loss")
_WIDER = ["tinyint", "smallint", "int", "bigint"]


@dataclass(frozen=True)
class Loss:
    category: str
    severity: str
    column: str
    message: str


@dataclass
class LossReport:
    losses: list[Loss] = field(default_factory=list)

    def add(self, category: str, severity: str, column: str, message: str) -> None:
        if category not in CATEGORIES or severity not in SEVERITIES:
            raise ValueError(category, severity)
        self.losses.append(Loss(category, severity, column, message))

    @property
    def severity(self) -> str | None:
        return max((x.severity for x in self.losses), key=SEVERITIES.index, default=None)

    def enforce(self, policy: str) -> None:
        """Strict and native stop at a loss of data, compatible at data and meaning, lossy at nothing."""
        stop = {"strict": ("data_loss",), "native": ("data_loss", "warning"), "compatible": ("data_loss",), "lossy": ()}[policy]
        for x in self.losses:
            if x.severity in stop:
                raise EngineError("crs" if x.category in ("srid", "crs") else "data_mapping", f"{x.column}: {x.message}", "prepare")

    def document(self) -> dict:
        return {"severity": self.severity, "losses": [vars(x) for x in self.losses]}


def _types(name: str, have: T.DataType, want: T.DataType, report: LossReport) -> None:
    a, b = have.simpleString(), want.simpleString()
    if a == b:
        return
    if a in _WIDER and b in _WIDER:
        wider = _WIDER.index(b) > _WIDER.index(a)
        report.add("type_widened" if wider else "type_narrowed", "information" if wider else "data_loss", name, f"{a} to {b}")
    elif (a, b) in (("float", "double"), ("date", "timestamp_ntz")):
        report.add("type_widened", "information", name, f"{a} to {b}")
    elif isinstance(have, T.DecimalType) and isinstance(want, T.DecimalType):
        fits = want.scale >= have.scale and want.precision - want.scale >= have.precision - have.scale
        report.add("type_widened" if fits else "precision", "information" if fits else "data_loss", name, f"{a} to {b}")
    elif a in _WIDER and isinstance(want, T.DecimalType | T.DoubleType | T.FloatType):
        digits = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}[a]
        room = want.precision - want.scale if isinstance(want, T.DecimalType) else 15 if isinstance(want, T.DoubleType) else 7
        report.add("type_widened" if digits <= room else "precision", "information" if digits <= room else "data_loss", name, f"{a} to {b}")
    elif isinstance(want, T.StringType):
        report.add("native_type", "warning", name, f"{a} to text")
    else:
        report.add("type_narrowed", "data_loss", name, f"{a} to {b}")


def compare(source: T.StructType, target: T.StructType | None, mode: str, keys: tuple[str, ...], updates: tuple[str, ...], srid_policy: str | None, evolve: bool) -> LossReport:
    report = LossReport()
    for f in source.fields:
        own = contract.keys(f)
        if not contract.is_spatial(f):
            continue
        if srid_policy == "reject_spatial":
            raise EngineError("unsupported", f"{f.name}: geometries are refused by policy", "prepare")
        if "srid" not in own and srid_policy != "allow_unknown":
            report.add("srid", "warning", f.name, "no SRID is known")
        if own.get("crs_id", "").startswith("EPSG:") and int(own["crs_id"][5:]) not in contract.KNOWN_SRIDS:
            raise EngineError("crs", f"{f.name}: the CRS is not in the catalogue", "prepare")
    if target is None:
        return report
    have, want = {f.name: f for f in source.fields}, {f.name: f for f in target.fields}
    for name in (*keys, *updates):
        if name not in want or name not in have:
            raise EngineError("schema", f"{name}: not a column of both sides", "prepare")
    used = {*keys, *updates} if mode in ("update", "delete_by_keys") else set(have)
    for name in used:
        f = have[name]
        if name not in want:
            if evolve and mode in ("append", "truncate_insert", "update", "upsert"):
                if not f.nullable:
                    report.add("nullability", "warning", name, "added as nullable")
                report.add("extra_column", "information", name, "added to the target")
            else:
                report.add("missing_column", "data_loss", name, "the target lacks it")
            continue
        t = want[name]
        _types(name, f.dataType, t.dataType, report)
        if f.nullable and not t.nullable:
            report.add("nullability", "warning", name, "nulls would be refused")
        a, b = contract.keys(f), contract.keys(t)
        if a and b:
            if a.get("srid") != b.get("srid"):
                open_ = srid_policy == "allow_unknown" and (a.get("srid") is None or b.get("srid") is None)
                report.add("srid", "warning" if open_ else "data_loss", name, "the SRIDs differ")
            if a["dimensions"] != b["dimensions"] and b["dimensions"] != "unknown":
                report.add("dimensions", "data_loss", name, "the dimensions differ")
            if a["spatial_semantics"] != b["spatial_semantics"]:
                report.add("geometry_type", "data_loss", name, "geometry and geography differ")
    for name, t in want.items():
        if name not in have and mode in ("append", "truncate_insert", "upsert") and not t.nullable:
            report.add("missing_column", "data_loss", name, "the input lacks a column that takes no nulls")
    return report
