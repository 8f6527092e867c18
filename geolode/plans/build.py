"""Short forms for writing queries in Python."""

from __future__ import annotations

from geolode.plans import model as m


def c(name: str) -> m.Column:
    """``field`` or ``relation.field``."""
    relation, _, field = name.rpartition(".")
    return m.Column(m.ColumnRef(field, relation or None))


def p(name: str) -> m.Parameter:
    return m.Parameter(name)


def e(x) -> m.Expression:
    return c(x) if isinstance(x, str) else x


star = m.Wildcard()


def fn(function: str, *args) -> m.Scalar:
    return m.Scalar(function, tuple(map(e, args)))


def st(function: str, *args) -> m.Spatial:
    return m.Spatial(function, tuple(map(e, args)))


def box(operator: str, left, right) -> m.SpatialOperator:
    return m.SpatialOperator(operator, e(left), e(right))


def cmp(left, operator: str, right) -> m.Compare:
    return m.Compare(e(left), operator, e(right))


def eq(left, right) -> m.Compare:
    return cmp(left, "eq", right)


def all_of(*args) -> m.And:
    return m.And(tuple(args))


def any_of(*args) -> m.Or:
    return m.Or(tuple(args))


def null(x, negated: bool = False) -> m.IsNull:
    return m.IsNull(e(x), negated)


def asc(x) -> m.Ordering:
    return m.Ordering(e(x))


def desc(x) -> m.Ordering:
    return m.Ordering(e(x), "desc")


def preceding(n: int | None = None) -> m.Bound:
    return m.Bound("unbounded_preceding") if n is None else m.Bound("preceding", n)


def following(n: int | None = None) -> m.Bound:
    return m.Bound("unbounded_following") if n is None else m.Bound("following", n)


current = m.Bound("current_row")


def over(function: str, *args, by=(), order=(), frame: tuple | None = None) -> m.Window:
    f = m.Frame(frame[0], frame[1], frame[2] if len(frame) > 2 else None) if frame else None
    return m.Window(function, tuple(map(e, args)), tuple(map(e, by)), tuple(o if isinstance(o, m.Ordering) else asc(o) for o in order), f)


def cluster(function: str, *args, by=()) -> m.SpatialWindow:
    return m.SpatialWindow(function, tuple(map(e, args)), tuple(map(e, by)))


def t(name: str, alias: str | None = None) -> m.Source:
    return m.Source(m.ObjectRef(name), alias)


def join(kind: str, source, on=None, lateral: bool = False) -> m.Join:
    if isinstance(source, m.Derived):
        return m.Join(kind, derived_source=source, lateral=lateral, on=on)
    return m.Join(kind, t(source) if isinstance(source, str) else source, on=on)


def sub(query: m.Query, alias: str) -> m.Derived:
    return m.Derived(query, alias)


def setop(operator: str, query: m.Query, every: bool = False) -> m.SetOperation:
    return m.SetOperation(operator, query, every)


def q(source, *projection, **rest) -> m.Query:
    """``projection``: names, expressions, or (expression, alias)."""
    items = tuple(m.Projection(e(x[0]), x[1]) if isinstance(x, tuple) else m.Projection(e(x)) for x in projection)
    where, group, having, order = rest.pop("where", None), rest.pop("group", ()), rest.pop("having", None), rest.pop("order", ())
    given = {
        "filter": where, "group_by": tuple(map(e, group)), "having": having, "order_by": tuple(o if isinstance(o, m.Ordering) else asc(o) for o in order), "joins": tuple(rest.pop("joins", ())),
        "distinct_on": tuple(map(e, rest.pop("distinct_on", ()))), "set_operations": tuple(rest.pop("sets", ())), "common_table_expressions": tuple(rest.pop("ctes", ())),
        "row_limit": rest.pop("limit", None), "row_offset": rest.pop("offset", None),
    }
    place = {"derived_source": source} if isinstance(source, m.Derived) else {"source": t(source) if isinstance(source, str) else source}
    return m.Query(items, **place, **given, **rest)
