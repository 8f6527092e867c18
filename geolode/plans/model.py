"""The query model: a relational and spatial syntax tree without values, table reads, keyed writes, and plans."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import ClassVar, Literal

from geolode.limits import Limits

Comparison = Literal["eq", "ne", "lt", "lte", "gt", "gte"]
Direction = Literal["asc", "desc"]
ScalarName = Literal["lower", "upper", "coalesce", "count", "sum", "average", "minimum", "maximum", "row_number", "rank", "dense_rank", "lag", "lead"]
BoxOperator = Literal["bounding_box_intersects", "bounding_box_contains", "bounding_box_contained_by", "knn_distance", "knn_centroid_distance"]
Provider = Literal["postgres", "mysql", "mariadb", "sqlserver", "oracle", "db2", "sqlite", "duckdb", "arcgis"]
Mode = Literal["create", "append", "replace", "truncate_insert", "update", "upsert", "delete_by_keys"]
Transaction = Literal["read_only", "single_transaction", "staged_swap", "chunk_committed", "best_effort_ddl", "arcgis_apply_edits"]
Mapping = Literal["strict", "compatible", "lossy", "native"]
SridRule = Literal["require_match", "allow_unknown", "reject_spatial"]

#: least and most arguments; None: no upper bound
SCALAR_ARITY: dict[str, tuple[int, int | None]] = {
    **dict.fromkeys(("lower", "upper", "count", "sum", "average", "minimum", "maximum"), (1, 1)),
    "coalesce": (1, None),
    **dict.fromkeys(("row_number", "rank", "dense_rank"), (0, 0)),
    **dict.fromkeys(("lag", "lead"), (1, 3)),
}
AGGREGATES = {"count", "sum", "average", "minimum", "maximum"}
WINDOW_ONLY = {"row_number", "rank", "dense_rank", "lag", "lead"}
BOX_PREDICATES = {"bounding_box_intersects", "bounding_box_contains", "bounding_box_contained_by"}


class Expression:
    """Any node that stands for a value."""

    TAG: ClassVar[tuple[str, str]]


@dataclass(frozen=True)
class ColumnRef:
    field: str
    relation: str | None = None


@dataclass(frozen=True)
class Wildcard(Expression):
    TAG: ClassVar = ("kind", "wildcard")
    relation: str | None = None


@dataclass(frozen=True)
class Column(Expression):
    TAG: ClassVar = ("kind", "column")
    column: ColumnRef


@dataclass(frozen=True)
class Parameter(Expression):
    TAG: ClassVar = ("kind", "parameter")
    name: str


@dataclass(frozen=True)
class Scalar(Expression):
    TAG: ClassVar = ("kind", "scalar")
    function: ScalarName
    arguments: tuple[Expression, ...]


@dataclass(frozen=True)
class Spatial(Expression):
    TAG: ClassVar = ("kind", "spatial")
    function: str
    arguments: tuple[Expression, ...]


@dataclass(frozen=True)
class SpatialOperator(Expression):
    TAG: ClassVar = ("kind", "spatial_operator")
    operator: BoxOperator
    left: Expression
    right: Expression


@dataclass(frozen=True)
class Bound:
    kind: Literal["unbounded_preceding", "preceding", "current_row", "following", "unbounded_following"]
    offset: int | None = None

    @property
    def place(self) -> float:
        ends = {"unbounded_preceding": float("-inf"), "current_row": 0, "unbounded_following": float("inf")}
        return ends[self.kind] if self.kind in ends else (-(self.offset or 0) if self.kind == "preceding" else self.offset or 0)


@dataclass(frozen=True)
class Frame:
    units: Literal["rows", "range", "groups"]
    start: Bound
    end: Bound | None = None


@dataclass(frozen=True)
class Ordering:
    expression: Expression
    direction: Direction = "asc"


@dataclass(frozen=True)
class Window(Expression):
    TAG: ClassVar = ("kind", "window")
    function: ScalarName
    arguments: tuple[Expression, ...]
    partition_by: tuple[Expression, ...] = ()
    order_by: tuple[Ordering, ...] = ()
    frame: Frame | None = None


@dataclass(frozen=True)
class SpatialWindow(Expression):
    TAG: ClassVar = ("kind", "spatial_window")
    function: str
    arguments: tuple[Expression, ...]
    partition_by: tuple[Expression, ...] = ()
    order_by: tuple[Ordering, ...] = ()
    frame: Frame | None = None


@dataclass(frozen=True)
class ScalarSubquery(Expression):
    TAG: ClassVar = ("kind", "scalar_subquery")
    query: Query


@dataclass(frozen=True)
class Exists(Expression):
    TAG: ClassVar = ("kind", "exists")
    query: Query
    negated: bool = False


@dataclass(frozen=True)
class InSubquery(Expression):
    TAG: ClassVar = ("kind", "in_subquery")
    expression: Expression
    query: Query
    negated: bool = False


@dataclass(frozen=True)
class Compare(Expression):
    TAG: ClassVar = ("kind", "compare")
    left: Expression
    operator: Comparison
    right: Expression


@dataclass(frozen=True)
class And(Expression):
    TAG: ClassVar = ("kind", "and")
    arguments: tuple[Expression, ...]


@dataclass(frozen=True)
class Or(Expression):
    TAG: ClassVar = ("kind", "or")
    arguments: tuple[Expression, ...]


@dataclass(frozen=True)
class IsNull(Expression):
    TAG: ClassVar = ("kind", "is_null")
    expression: Expression
    negated: bool = False


@dataclass(frozen=True)
class ObjectRef:
    object: str
    catalog: str | None = None
    schema: str | None = None
    layer_id: int | str | None = None


@dataclass(frozen=True)
class Projection:
    expression: Expression
    alias: str | None = None


@dataclass(frozen=True)
class Source:
    object: ObjectRef
    alias: str | None = None


@dataclass(frozen=True)
class Derived:
    query: Query
    alias: str


@dataclass(frozen=True)
class Join:
    kind: Literal["inner", "left", "right", "full", "cross"]
    source: Source | None = None
    derived_source: Derived | None = None
    lateral: bool = False
    on: Expression | None = None


@dataclass(frozen=True)
class SetOperation:
    operator: Literal["union", "intersect", "except"]
    query: Query
    all: bool = False


@dataclass(frozen=True)
class Lock:
    strength: Literal["update", "no_key_update", "share", "key_share"]
    wait: Literal["wait", "no_wait", "skip_locked"]
    relations: tuple[str, ...] = ()


@dataclass(frozen=True)
class CommonTable:
    name: str
    query: Query
    recursive: bool = False


@dataclass(frozen=True)
class Query:
    projection: tuple[Projection, ...]
    source: Source | None = None
    derived_source: Derived | None = None
    common_table_expressions: tuple[CommonTable, ...] = ()
    joins: tuple[Join, ...] = ()
    filter: Expression | None = None
    group_by: tuple[Expression, ...] = ()
    having: Expression | None = None
    order_by: tuple[Ordering, ...] = ()
    distinct: bool = False
    distinct_on: tuple[Expression, ...] = ()
    set_operations: tuple[SetOperation, ...] = ()
    row_limit: int | None = None
    row_offset: int | None = None
    locking: Lock | None = None


class Filter:
    """A node of a table read's filter."""

    TAG: ClassVar[tuple[str, str]]


@dataclass(frozen=True)
class AllOf(Filter):
    TAG: ClassVar = ("op", "and")
    args: tuple[Filter, ...]


@dataclass(frozen=True)
class AnyOf(Filter):
    TAG: ClassVar = ("op", "or")
    args: tuple[Filter, ...]


@dataclass(frozen=True)
class FieldEq(Filter):
    TAG: ClassVar = ("op", "eq")
    field: str
    parameter: str


@dataclass(frozen=True)
class FieldNe(FieldEq):
    TAG: ClassVar = ("op", "ne")


@dataclass(frozen=True)
class FieldLt(FieldEq):
    TAG: ClassVar = ("op", "lt")


@dataclass(frozen=True)
class FieldLte(FieldEq):
    TAG: ClassVar = ("op", "lte")


@dataclass(frozen=True)
class FieldGt(FieldEq):
    TAG: ClassVar = ("op", "gt")


@dataclass(frozen=True)
class FieldGte(FieldEq):
    TAG: ClassVar = ("op", "gte")


@dataclass(frozen=True)
class FieldIsNull(Filter):
    TAG: ClassVar = ("op", "is_null")
    field: str


@dataclass(frozen=True)
class FieldIsNotNull(Filter):
    TAG: ClassVar = ("op", "is_not_null")
    field: str


@dataclass(frozen=True)
class FieldIn(Filter):
    TAG: ClassVar = ("op", "in")
    field: str
    parameters: tuple[str, ...]


@dataclass(frozen=True)
class FieldBetween(Filter):
    TAG: ClassVar = ("op", "between")
    field: str
    lower_parameter: str
    upper_parameter: str


@dataclass(frozen=True)
class FieldLike(Filter):
    TAG: ClassVar = ("op", "like")
    field: str
    parameter: str
    case_insensitive: bool = False


@dataclass(frozen=True)
class FieldSpatial(Filter):
    TAG: ClassVar = ("op", "spatial")
    function: str
    field: str
    geometry_parameter: str | None = None
    distance_parameter: str | None = None


@dataclass(frozen=True)
class FieldIntersects(Filter):
    """The older form of an intersection: a shape without an SRID of its own, taken to be in the column's. For programs; plan documents have no name for it."""

    field: str
    wkb_parameter: str


@dataclass(frozen=True)
class FieldOrder:
    field: str
    direction: Direction = "asc"


@dataclass(frozen=True)
class Read:
    source: ObjectRef
    projection: tuple[str, ...] = ()
    order_by: tuple[FieldOrder, ...] = ()
    row_limit: int | None = None
    filter: Filter | None = None


@dataclass(frozen=True)
class Write:
    target: ObjectRef
    mode: Mode
    mapping_policy: Mapping = "strict"
    transaction_profile: Transaction = "single_transaction"
    keys: tuple[str, ...] = ()
    update_columns: tuple[str, ...] = ()
    srid_policy: SridRule | None = None
    create_spatial_index: bool = False
    allow_partial: bool = False


#: Operations of a plan: what follows the id. None: nothing; a type: its fields, beside the id.
OPERATIONS: dict[str, type | None | str] = {
    "database.test_connection": None,
    "database.list_catalogs": None,
    "database.list_schemas": "source?",
    "database.list_objects": "source?",
    "database.describe_object": "source",
    "database.read": Read,
    "database.write": Write,
    "arcgis.test_connection": None,
    "arcgis.list_folders": None,
    "arcgis.list_items": "source?",
    "arcgis.list_services": "source?",
    "arcgis.list_layers": "source",
    "arcgis.describe_layer": "source",
    "arcgis.read": Read,
    "arcgis.write": Write,
}


@dataclass(frozen=True)
class Operation:
    id: str
    body: Read | Write | ObjectRef | None = None


@dataclass(frozen=True)
class Plan:
    schema_version: int
    connection_ref: str
    provider: Provider
    operation: Operation
    limits: Limits = field(default_factory=Limits)
