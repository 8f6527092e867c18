"""Checks a query or a table read before anything runs: structure, limits, and what a profile accepts.

Walks with its own stack, so a hostile tree is refused without deep recursion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from geolode.errors import invalid, unsupported
from geolode.functions.catalog import BINARY_PREDICATES, FUNCTIONS, METHODS, UNARY_PREDICATES, WINDOWED, aggregate
from geolode.limits import Limits
from geolode.plans import model as m

IN_LIST_MOST = 1024


@dataclass(frozen=True)
class Profile:
    """What queries may use. The open profile takes all; the others refuse what servers of their kind would."""

    name: str = "open"
    tables: bool = True  # common tables, set operations, derived tables and subqueries
    lateral: frozenset[str] = frozenset({"inner", "left", "cross"})
    full_join: bool = True
    distinct_on: bool = True
    limit_needs_order: bool = False
    strict_windows: bool = False
    strict_groups: bool = False
    spatial: frozenset[str] = frozenset(FUNCTIONS)
    box_operators: bool = True
    read_spatial: bool = True
    ilike: bool = True
    nulls: str = "high"  # where nulls sort: "high" after all values, "low" before
    binds: int = 65_535
    identifier_chars: int = 256
    modes: frozenset[str] = frozenset({"create", "append", "replace", "truncate_insert", "update", "upsert", "delete_by_keys"})
    staged: frozenset[str] = frozenset({"replace"})
    mapping: frozenset[str] = frozenset({"strict", "compatible", "lossy", "native"})
    spatial_index: bool = True
    locks: frozenset[str] = field(default=frozenset({"update", "no_key_update", "share", "key_share"}))


PROFILES = {
    "open": Profile(),
    "postgres": Profile("postgres", identifier_chars=63),
    "mysql": Profile(
        "mysql", tables=False, lateral=frozenset(), full_join=False, distinct_on=False, limit_needs_order=True, strict_windows=True, strict_groups=True, spatial=frozenset(), box_operators=False,
        read_spatial=False, ilike=False, nulls="low", identifier_chars=64, modes=frozenset({"append"}), staged=frozenset(), mapping=frozenset({"strict"}), spatial_index=False, locks=frozenset(),
    ),
    "sqlserver": Profile(
        "sqlserver", lateral=frozenset({"cross"}), distinct_on=False, spatial=frozenset(METHODS), box_operators=False, read_spatial=False, ilike=False, nulls="low", binds=2_100, identifier_chars=128,
        locks=frozenset({"update", "share"}),
    ),
}


def identifier(name: str, limits: Limits, profile: Profile) -> None:
    if not name or "\0" in name or len(name.encode()) > limits.identifier_bytes or len(name) > profile.identifier_chars:
        raise invalid("an identifier is empty, has a NUL, or is too long")


def children(e: m.Expression) -> Iterator[m.Expression]:
    """The expressions directly below one, subqueries left out."""
    if isinstance(e, m.Scalar | m.Spatial | m.And | m.Or):
        yield from e.arguments
    elif isinstance(e, m.Compare | m.SpatialOperator):
        yield from (e.left, e.right)
    elif isinstance(e, m.Window | m.SpatialWindow):
        yield from (*e.arguments, *e.partition_by, *(o.expression for o in e.order_by))
    elif isinstance(e, m.IsNull | m.InSubquery):
        yield e.expression


def walk(e: m.Expression) -> Iterator[m.Expression]:
    stack = [e]
    while stack:
        x = stack.pop()
        yield x
        stack += list(children(x))[::-1]


def is_aggregate(e: m.Expression) -> bool:
    return isinstance(e, m.Scalar) and e.function in m.AGGREGATES or isinstance(e, m.Spatial) and aggregate(e.function, len(e.arguments))


def has_aggregate(e: m.Expression) -> bool:
    return any(is_aggregate(x) for x in walk(e))


def _predicate(e: m.Expression) -> None:
    stack = [e]
    while stack:
        x = stack.pop()
        if isinstance(x, m.And | m.Or):
            stack += x.arguments
        elif not (
            isinstance(x, m.Compare | m.IsNull | m.Exists | m.InSubquery)
            or (isinstance(x, m.Spatial) and x.function in FUNCTIONS and FUNCTIONS[x.function].boolean(len(x.arguments)))
            or (isinstance(x, m.SpatialOperator) and x.operator in m.BOX_PREDICATES)
        ):
            raise invalid("a condition must be a comparison, a null test, a subquery test or a spatial predicate")


def _arity(function: str, count: int) -> None:
    low, high = m.SCALAR_ARITY[function]
    if count < low or (high is not None and count > high):
        raise invalid(f"{function} does not take {count} arguments")


def _frame(frame: m.Frame | None) -> None:
    if frame is None:
        return
    end = frame.end.place if frame.end else 0
    if frame.start.place > end or frame.start.kind == "unbounded_following" or (frame.end and frame.end.kind == "unbounded_preceding"):
        raise invalid("a window frame starts after its end")


def relation_name(source: m.Source | None, derived: m.Derived | None) -> str:
    return derived.alias if derived else source.alias or source.object.object


def _operation(q: m.Query, limits: Limits, p: Profile) -> None:
    if not q.projection:
        raise invalid("a query without a projection")
    if q.distinct and q.distinct_on:
        raise invalid("DISTINCT with DISTINCT ON")
    if q.row_offset is not None and not q.order_by:
        raise invalid("an offset needs an order")
    if q.distinct_on and tuple(o.expression for o in q.order_by[: len(q.distinct_on)]) != q.distinct_on:
        raise invalid("DISTINCT ON must be how the order begins")
    if any(len(s.query.projection) != len(q.projection) for s in q.set_operations):
        raise invalid("set operations over different numbers of columns")
    if (q.source is None) == (q.derived_source is None):
        raise invalid("a query needs one source, a table or a subquery")
    names: list[str] = []
    for source, derived in [(q.source, q.derived_source), *((j.source, j.derived_source) for j in q.joins)]:
        if (source is None) == (derived is None):
            raise invalid("a join needs one source, a table or a subquery")
        if source:
            for part in (source.object.catalog, source.object.schema, source.object.object, source.alias):
                if part is not None:
                    identifier(part, limits, p)
        else:
            identifier(derived.alias, limits, p)
            if not p.tables:
                raise unsupported("derived tables")
        names.append(relation_name(source, derived))
    if len({n.lower() for n in names}) < len(names):
        raise invalid("two relations of one name")
    for k, j in enumerate(q.joins):
        if j.lateral and not j.derived_source:
            raise invalid("LATERAL needs a subquery")
        if j.lateral and j.kind not in p.lateral:
            raise unsupported(f"LATERAL with {j.kind} join")
        if j.kind == "full" and not p.full_join:
            raise unsupported("full joins")
        if (j.kind == "cross") != (j.on is None):
            raise invalid("a condition goes with every join but a cross join")
        if j.on is not None:
            _predicate(j.on)
            seen = {n.lower() for n in names[: k + 2]}
            for x in walk(j.on):
                if isinstance(x, m.Column) and x.column.relation and x.column.relation.lower() not in seen and x.column.relation.lower() in {n.lower() for n in names}:
                    raise invalid("a join's condition names a later relation")
                if is_aggregate(x) or isinstance(x, m.Window | m.SpatialWindow):
                    raise invalid("an aggregate or window in a join's condition")
    for e in (q.filter, q.having):
        if e is not None:
            _predicate(e)
    if q.filter is not None and any(is_aggregate(x) or isinstance(x, m.Window | m.SpatialWindow) for x in walk(q.filter)):
        raise invalid("an aggregate or window in a filter")
    if any(has_aggregate(g) or any(isinstance(x, m.Window | m.SpatialWindow) for x in walk(g)) for g in q.group_by):
        raise invalid("an aggregate or window among the groups")
    if not p.tables and (q.common_table_expressions or q.set_operations):
        raise unsupported("common tables and set operations")
    if q.distinct_on and not p.distinct_on:
        raise unsupported("DISTINCT ON")
    if q.row_limit is not None and not q.order_by and p.limit_needs_order:
        raise unsupported("a limit without an order")
    for c in q.common_table_expressions:
        identifier(c.name, limits, p)
    for x in q.projection:
        if x.alias is not None:
            identifier(x.alias, limits, p)
    windows = [x for proj in q.projection for x in walk(proj.expression) if isinstance(x, m.Window | m.SpatialWindow)]
    if p.strict_windows:
        _strict_windows(q, windows)
    if p.strict_groups and (q.group_by or q.having is not None or any(has_aggregate(x.expression) for x in q.projection)):
        _strict_groups(q)
    if q.locking:
        _locking(q, p, limits, bool(windows))


def _strict_windows(q: m.Query, windows: list) -> None:
    if windows and (q.group_by or q.distinct):
        raise unsupported("windows with groups or DISTINCT")
    if any(isinstance(x, m.Window | m.SpatialWindow) for o in q.order_by for x in walk(o.expression)):
        raise unsupported("windows outside the projection")
    for w in windows:
        if w.function in ("rank", "dense_rank"):
            if not w.order_by or w.frame:
                raise unsupported("rank without an order, or with a frame")
        elif w.function in m.AGGREGATES:
            if w.frame and (w.frame.units != "range" or any(b and b.offset is not None for b in (w.frame.start, w.frame.end))):
                raise unsupported("frames of rows, groups or offsets")
        else:
            raise unsupported(f"{w.function}: the order of its rows is not known to be total")


def _strict_groups(q: m.Query) -> None:
    if any(isinstance(x, m.Parameter) for g in q.group_by for x in walk(g)):
        raise unsupported("parameters among the groups")
    open_ = [x.expression for x in q.projection] + [o.expression for o in q.order_by] + ([q.having] if q.having is not None else [])
    while open_:
        e = open_.pop()
        if e in q.group_by or is_aggregate(e):
            continue
        if isinstance(e, m.Column | m.Wildcard):
            raise invalid("a column that is neither grouped nor aggregated")
        open_ += list(children(e))


def _locking(q: m.Query, p: Profile, limits: Limits, windows: bool) -> None:
    if q.set_operations or q.distinct or q.distinct_on or q.group_by or q.having is not None or windows or any(has_aggregate(x.expression) for x in q.projection):
        raise invalid("row locks with sets, groups, aggregates, windows or DISTINCT")
    own = {relation_name(s, None) for s in (q.source, *(j.source for j in q.joins)) if s}
    for r in q.locking.relations:
        identifier(r, limits, p)
        if r not in own:
            raise invalid("a row lock names a relation that cannot be locked")
    if q.locking.strength not in p.locks:
        raise unsupported(f"{q.locking.strength} locks")


def _expression(e: m.Expression, limits: Limits, p: Profile) -> None:
    if isinstance(e, m.Wildcard):
        if e.relation is not None:
            identifier(e.relation, limits, p)
    elif isinstance(e, m.Column):
        for part in (e.column.relation, e.column.field):
            if part is not None:
                identifier(part, limits, p)
    elif isinstance(e, m.Parameter):
        identifier(e.name, limits, Profile())
    elif isinstance(e, m.Scalar):
        if e.function in m.WINDOW_ONLY:
            raise invalid(f"{e.function} needs a window")
        _arity(e.function, len(e.arguments))
        if e.function in m.AGGREGATES and any(has_aggregate(a) for a in e.arguments):
            raise invalid("an aggregate of an aggregate")
        if e.function == "count" and isinstance(e.arguments[0], m.Wildcard) and e.arguments[0].relation:
            raise invalid("count of a relation's wildcard")
        if any(isinstance(a, m.Wildcard) for a in e.arguments) and e.function != "count":
            raise invalid(f"{e.function} of a wildcard")
    elif isinstance(e, m.Spatial):
        _spatial(e.function, len(e.arguments), p)
        if e.function in WINDOWED:
            raise invalid(f"{e.function} needs a window")
    elif isinstance(e, m.SpatialOperator):
        if not p.box_operators:
            raise unsupported("bounding-box and nearest-neighbour operators")
    elif isinstance(e, m.Window):
        if e.function not in m.AGGREGATES | m.WINDOW_ONLY:
            raise invalid(f"{e.function} is no window function")
        _arity(e.function, len(e.arguments))
        _frame(e.frame)
    elif isinstance(e, m.SpatialWindow):
        if e.function not in WINDOWED:
            raise invalid(f"{e.function} is no spatial window function")
        _spatial(e.function, len(e.arguments), p)
        _frame(e.frame)
    elif isinstance(e, m.And | m.Or):
        if not e.arguments:
            raise invalid("AND or OR of nothing")
    elif isinstance(e, m.ScalarSubquery | m.Exists | m.InSubquery):
        if not p.tables:
            raise unsupported("subqueries")
        if isinstance(e, m.ScalarSubquery | m.InSubquery) and len(e.query.projection) != 1:
            raise invalid("a subquery of one column is needed")


def _spatial(function: str, count: int, p: Profile) -> None:
    known = FUNCTIONS.get(function)
    if known is None:
        raise invalid("unknown spatial function")
    if count not in known.arity:
        raise invalid(f"{function} does not take {count} arguments")
    if function not in p.spatial:
        raise unsupported(f"{function} in this profile")


def query(q: m.Query, limits: Limits | None = None, profile: Profile | str = "open") -> None:
    """Raises where the query is not well formed, over a limit, or beyond its profile."""
    limits, p = (limits or Limits()).check(), PROFILES[profile] if isinstance(profile, str) else profile
    stack: list[tuple[m.Query | m.Expression, int]] = [(q, 1)]
    nodes, binds = 0, 0
    while stack:
        x, depth = stack.pop()
        if isinstance(x, m.Query):
            nodes += 1 + sum(map(len, (x.common_table_expressions, x.projection, x.joins, x.group_by, x.order_by, x.distinct_on, x.set_operations)))
            below = [c.query for c in x.common_table_expressions] + [s.query for s in x.set_operations] + [d.query for d in (x.derived_source, *(j.derived_source for j in x.joins)) if d]
            below += [j.on for j in x.joins if j.on is not None] + [o.expression for o in x.order_by] + [v.expression for v in x.projection]
            below += [*x.group_by, *x.distinct_on, *(e for e in (x.filter, x.having) if e is not None)]
        else:
            nodes += 1
            binds += isinstance(x, m.Parameter)
            below = list(children(x)) + ([x.query] if isinstance(x, m.ScalarSubquery | m.Exists | m.InSubquery) else [])
        if depth > limits.max_depth or nodes > limits.max_nodes:
            raise invalid("the query is nested too deeply or too large")
        if binds > p.binds:
            raise invalid("too many parameters")
        stack += [(b, depth + 1) for b in below]
        if isinstance(x, m.Query):
            _operation(x, limits, p)
        else:
            _expression(x, limits, p)


def read(r: m.Read, limits: Limits | None = None, profile: Profile | str = "open") -> None:
    limits, p = (limits or Limits()).check(), PROFILES[profile] if isinstance(profile, str) else profile
    for name in (r.source.catalog, r.source.schema, r.source.object, *r.projection, *(o.field for o in r.order_by)):
        if name is not None:
            identifier(name, limits, p)
    if len(set(r.projection)) < len(r.projection):
        raise invalid("a column is projected twice")
    if r.row_limit is not None and not r.order_by and p.limit_needs_order:
        raise unsupported("a limit without an order")
    stack = [(r.filter, 1)] if r.filter is not None else []
    nodes = 0
    while stack:
        f, depth = stack.pop()
        nodes += 1
        if depth > limits.max_depth or nodes > limits.max_nodes:
            raise invalid("the filter is nested too deeply or too large")
        if isinstance(f, m.AllOf | m.AnyOf):
            if not f.args:
                raise invalid("AND or OR of nothing")
            stack += [(x, depth + 1) for x in f.args]
            continue
        identifier(f.field, limits, p)
        if isinstance(f, m.FieldIn) and not 1 <= len(f.parameters) <= IN_LIST_MOST:
            raise invalid(f"an IN list takes 1 to {IN_LIST_MOST} parameters")
        if isinstance(f, m.FieldLike) and f.case_insensitive and not p.ilike:
            raise unsupported("LIKE without regard to case")
        if isinstance(f, m.FieldSpatial | m.FieldIntersects) and not p.read_spatial:
            raise unsupported("spatial filters of table reads")
        if isinstance(f, m.FieldSpatial):
            needs = {"geometry_parameter": f.function in BINARY_PREDICATES | {"d_within"}, "distance_parameter": f.function == "d_within"}
            if f.function not in UNARY_PREDICATES | BINARY_PREDICATES | {"d_within"} or any((getattr(f, k) is not None) != v for k, v in needs.items()):
                raise invalid("a spatial filter takes a predicate, and just the parameters that it needs")


def write(w: m.Write, limits: Limits | None = None, profile: Profile | str = "open") -> None:
    limits, p = (limits or Limits()).check(), PROFILES[profile] if isinstance(profile, str) else profile
    for name in (w.target.catalog, w.target.schema, w.target.object, *w.keys, *w.update_columns):
        if name is not None:
            identifier(name, limits, p)
    for names in (w.keys, w.update_columns):
        if len(set(names)) < len(names):
            raise invalid("a column is named twice")
    if set(w.keys) & set(w.update_columns):
        raise invalid("a key among the columns to update")
    if w.mode in ("append", "truncate_insert") and (w.keys or w.update_columns):
        raise invalid(f"{w.mode} takes no keys and no columns to update")
    if w.mode in ("create", "replace", "delete_by_keys") and w.update_columns:
        raise invalid(f"{w.mode} takes no columns to update")
    if w.mode in ("update", "upsert", "delete_by_keys") and not w.keys:
        raise invalid(f"{w.mode} needs keys")
    if w.mode == "update" and not w.update_columns:
        raise invalid("update needs columns to update")
    if w.mode not in p.modes:
        raise unsupported(f"{w.mode} in this profile")
    if w.mapping_policy not in p.mapping:
        raise unsupported(f"{w.mapping_policy} mapping in this profile")
    if w.create_spatial_index and not p.spatial_index:
        raise unsupported("spatial indexes in this profile")
    if w.transaction_profile == "read_only":
        raise invalid("a write in a read-only transaction")
    if w.transaction_profile == "staged_swap" and w.mode not in p.staged:
        raise unsupported("a staged swap goes with replace")
    if w.transaction_profile not in ("single_transaction", "staged_swap"):
        raise unsupported(f"{w.transaction_profile} transactions")
    if w.allow_partial:
        raise unsupported("partial writes")
