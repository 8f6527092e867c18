"""Queries to Spark SQL with named parameters, and table reads to DataFrame operations.

What Spark lacks is rewritten before: DISTINCT ON to a row number, GROUPS frames to a RANGE over dense ranks, clusters over windows
to a grouped step, recursion without duplicates to rounds that add only new rows, an inner join on a spatial predicate to an equality
on grid cells. Everything else is left to Catalyst.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolode.errors import EngineError, invalid, unsupported
from geolode.functions import spatial
from geolode.functions.catalog import BINARY_PREDICATES, aggregate
from geolode.limits import Limits
from geolode.operators.clusters import dbscan, k_means
from geolode.plans import model as m
from geolode.plans import validate
from geolode.plans.parameters import Bag, needed
from geolode.shared import release, stored

if TYPE_CHECKING:
    from geolode.operators.spatial_join import Cells

COMPARE = {"eq": "=", "ne": "<>", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}
SCALAR = {"average": "avg", "minimum": "min", "maximum": "max"}
ROUNDS = 1_000
#: Metadata of a column that holds a side of a geometry's box: the geometry's name.
INDEX = "geolode.index"


#: Tests of two shapes that hold only if their boxes meet.
MEETING = (BINARY_PREDICATES - {"disjoint"}) | {"d_within", "bounding_box_intersects", "bounding_box_contains", "bounding_box_contained_by"}


@dataclass(frozen=True)
class Meeting:
    """A spatial test in the ON of join number ``join``: one column of each of two relations, whose shapes meet in cells of a size."""

    join: int
    test: m.Expression
    left: m.ColumnRef
    right: m.ColumnRef
    grow: float
    cells: Cells
    partitions: int

    def hidden(self, relation: str) -> list[str]:
        side = {self.left.relation: "l", self.right.relation: "r"}.get(relation)
        return [f"__{k}{side}{self.join}" for k in ("box", "plain", "part", "x0", "x1", "y0", "y1", "x", "y", "fx", "fy")] if side else []


def conjuncts(e: m.Expression | None) -> list[m.Expression]:
    return [] if e is None else [y for x in e.arguments for y in conjuncts(x)] if isinstance(e, m.And) else [e]


def joined(parts: list[m.Expression]) -> m.Expression | None:
    return None if not parts else parts[0] if len(parts) == 1 else m.And(tuple(parts))


def box_distance(gaps: list[str], distance: float) -> tuple[str, str]:
    """Tests of two boxes' squared distance that say within and beyond ``distance``, clear of it by more than rounding."""
    square, limit = "({0} * {0} + {1} * {1})".format(*gaps), distance * distance
    return f"{square} < {limit * (1 - 1e-9)!r}D", f"{square} > {limit * (1 + 1e-9)!r}D"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Lowering:
    """One query on its way to a DataFrame. ``resolve`` gives the quoted name under which Spark knows a table."""

    def __init__(self, spark: SparkSession, resolve: Callable[[m.ObjectRef], str], bag: Bag, profile: validate.Profile, limits: Limits | None = None):
        self.spark, self.resolve, self.bag, self.profile, self.limits = spark, resolve, bag, profile, limits or Limits()
        self.args: dict[str, object] = {}
        self.names: dict[str, tuple[str, str]] = {}
        self.views: list[str] = []
        self.meetings: list[Meeting] = []

    def run(self, q: m.Query) -> DataFrame:
        try:
            text = self.query(q, {})
            return self.spark.sql(text, args=self.args or None)
        finally:
            self.dropped()

    def dropped(self) -> None:
        for v in self.views:
            self.spark.catalog.dropTempView(v)

    # queries

    def query(self, q: m.Query, scope: dict[str, str]) -> str:
        """``scope``: the common tables that can be seen, by name: a view's name, or the text that defines them ("")."""
        scope = dict(scope)
        heads, recursive = [], False
        for c in q.common_table_expressions:
            if c.recursive and self._distinct_step(c):
                scope[c.name] = self._rounds(c, heads, recursive, scope)
                continue
            inner = dict(scope)
            if c.recursive:
                if not c.query.set_operations:
                    raise invalid("a recursive table needs a first part and a step")
                inner[c.name] = ""
                recursive = True
            heads.append(f"{quoted(c.name)}{f' MAX RECURSION LEVEL {ROUNDS}' * c.recursive} AS ({self.query(c.query, inner)})")
            scope[c.name] = ""
        head = f"WITH {'RECURSIVE ' * recursive}{', '.join(heads)} " if heads else ""
        return head + self._body(q, scope, head)

    def _body(self, q: m.Query, scope: dict[str, str], head: str) -> str:
        if q.locking:
            raise unsupported("row locks: reads are of snapshots")
        if any(isinstance(x, m.SpatialWindow) or (isinstance(x, m.Window) and x.frame and x.frame.units == "groups") for v in q.projection for x in validate.walk(v.expression)):
            q = self._staged(q, scope, head)
        q = self._counted(q, scope, head)
        outer = self.meetings
        q, self.meetings = self._meet(q, scope, head)
        try:
            return self._selected(q, scope)
        finally:
            self.meetings = outer

    def _selected(self, q: m.Query, scope: dict[str, str]) -> str:
        select = ", ".join(self._projected(v, scope) for v in q.projection)
        tail = self._from(q, scope)
        if q.distinct_on:
            core, order = self._distinct_on(q, scope, select, tail)
        else:
            core = f"SELECT {self._merged()}{'DISTINCT ' * q.distinct}{select} {tail}"
            order = ", ".join(self.order(o, scope) for o in q.order_by)
        words = {"union": "UNION", "intersect": "INTERSECT", "except": "EXCEPT"}
        for s in q.set_operations:
            core += f" {words[s.operator]}{' ALL' * s.all} ({self.query(s.query, scope)})"
        if order:
            core += f" ORDER BY {order}"
        if q.row_limit is not None:
            core += f" LIMIT {int(q.row_limit)}"
        if q.row_offset is not None:
            core += f" OFFSET {int(q.row_offset)}"
        return core

    def _merged(self) -> str:
        """Sizes of files say nothing of rows that are dealt to cells, so none of these joins may broadcast a side."""
        names = sorted({c.relation for x in self.meetings for c in (x.left, x.right)})
        return f"/*+ MERGE({', '.join(map(quoted, names))}) */ " if names else ""

    def _projected(self, v: m.Projection, scope: dict[str, str]) -> str:
        if isinstance(v.expression, m.Wildcard) and self.meetings:
            own = [v.expression.relation] if v.expression.relation else sorted({r for x in self.meetings for r in (x.left.relation, x.right.relation)})
            if hidden := [quoted(c) for x in self.meetings for r in own for c in x.hidden(r)]:
                return f"{self.expression(v.expression, scope)} EXCEPT ({', '.join(hidden)})"
        return self.expression(v.expression, scope) + (f" AS {quoted(v.alias)}" if v.alias is not None else "")

    def _from(self, q: m.Query, scope: dict[str, str]) -> str:
        out = "FROM " + self._celled(q.source, q.derived_source, scope)
        for i, j in enumerate(q.joins):
            lateral = "LATERAL " * j.lateral
            if j.lateral and j.kind not in ("inner", "left", "cross"):
                raise unsupported(f"LATERAL with {j.kind} join")
            out += f" {j.kind.upper()} JOIN {lateral}{self._celled(j.source, j.derived_source, scope)}"
            if j.on is not None:
                out += f" ON {self._on(i, j.on, scope)}"
        if q.filter is not None:
            out += f" WHERE {self.expression(q.filter, scope)}"
        if q.group_by:
            out += " GROUP BY " + ", ".join(self.expression(g, scope) for g in q.group_by)
        if q.having is not None:
            out += f" HAVING {self.expression(q.having, scope)}"
        return out

    def _source(self, source: m.Source | None, derived: m.Derived | None, scope: dict[str, str]) -> str:
        if derived:
            return f"({self.query(derived.query, scope)}) AS {quoted(derived.alias)}"
        ref = source.object
        own = next((k for k in scope if k.lower() == ref.object.lower()), None) if ref.schema is None and ref.catalog is None else None
        name = (scope[own] or quoted(own)) if own is not None else self.resolve(ref)
        return f"{name} AS {quoted(source.alias or ref.object)}"

    # spatial joins

    def _meet(self, q: m.Query, scope: dict[str, str], head: str) -> tuple[m.Query, list[Meeting]]:
        """The query with spatial tests of WHERE in the joins that they belong to, and those tests of inner joins that become an equality on cells.

        One test of a join is taken; the cells' sizes come from one aggregation of each side. Outer, lateral and recursive joins stay as they are.
        """
        sides = [(q.source, q.derived_source), *((j.source, j.derived_source) for j in q.joins)]
        names = [d.alias if d else s.alias or s.object.object if s else None for s, d in sides]
        if not q.joins or any(n is None for n in names) or len({n.lower() for n in names}) < len(names):
            return q, []

        def of(e: m.Expression) -> tuple[int, int] | None:
            """Which relations a spatial test of two columns reads."""
            if isinstance(e, m.Spatial) and e.function in MEETING and len(e.arguments) == 2 + (e.function == "d_within"):
                two = e.arguments[:2]
                if e.function == "d_within" and not (isinstance(e.arguments[2], m.Parameter) and e.arguments[2].name in self.bag):
                    return None
            elif isinstance(e, m.SpatialOperator) and e.operator in MEETING:
                two = (e.left, e.right)
            else:
                return None
            if not all(isinstance(x, m.Column) and x.column.relation in names for x in two):
                return None
            return names.index(two[0].column.relation), names.index(two[1].column.relation)

        joins, rest = list(q.joins), []
        if all(j.kind in ("inner", "cross") and not j.lateral for j in joins):
            for e in conjuncts(q.filter):
                at = of(e)
                if at is None or at[0] == at[1]:
                    rest.append(e)
                    continue
                k = max(at) - 1
                joins[k] = replace(joins[k], kind="inner", on=joined([*conjuncts(joins[k].on), e]))
            q = replace(q, joins=tuple(joins), filter=joined(rest))
        from geolode.operators.spatial_join import partitions

        found = []
        for i, j in enumerate(joins):
            tests = [(e, at) for e in conjuncts(j.on) if (at := of(e)) and max(at) == i + 1 and min(at) <= i]
            if j.kind != "inner" or j.lateral or not tests:
                continue
            e, at = tests[0]
            if at[0] > 0 and joins[at[0] - 1].lateral or at[1] > 0 and joins[at[1] - 1].lateral:
                continue
            two = e.arguments[:2] if isinstance(e, m.Spatial) else (e.left, e.right)
            grow = float(self.bag[e.arguments[2].name].value) if isinstance(e, m.Spatial) and e.function == "d_within" else 0.0
            try:
                cells = self._cells([(sides[k], x.column) for k, x in zip(at, two, strict=True)], grow, scope, head)
            except AnalysisException:  # a side that cannot be read by itself
                continue
            found.append(Meeting(i, e, two[0].column, two[1].column, grow, cells, partitions(self.spark)))
        return q, found

    def _counted(self, q: m.Query, scope: dict[str, str], head: str) -> m.Query:
        """A query that only counts the intersecting pairs of one side's groups, over a step that counts them without making them; any other query as it is."""
        from geolode.operators.spatial_join import counted

        e = q.joins[0].on if len(q.joins) == 1 else None
        if not isinstance(e, m.Spatial) or e.function != "intersects" or len(e.arguments) != 2 or q.joins[0].kind != "inner" or q.joins[0].lateral:
            return q
        if q.filter is not None or q.having is not None or q.distinct or q.distinct_on or q.order_by or q.set_operations or not q.group_by:
            return q
        sides = [(q.source, q.derived_source), (q.joins[0].source, q.joins[0].derived_source)]
        names = [d.alias if d else s.alias or s.object.object if s else None for s, d in sides]
        number = m.Scalar("count", (m.Wildcard(),))
        if not all(isinstance(x, m.Column) for x in (*e.arguments, *q.group_by)) or {x.column.relation for x in e.arguments} != set(names) or None in names or len(set(names)) < 2:
            return q
        grouped = {x.column.relation for x in q.group_by}
        if len(grouped) != 1 or not grouped <= set(names) or not all(v.expression in q.group_by or v.expression == number and v.alias for v in q.projection) or all(v.expression != number for v in q.projection):
            return q
        at = names.index(grouped.pop())
        shape = {x.column.relation: x.column.field for x in e.arguments}
        try:
            frames = [self.spark.sql(f"{head}SELECT * FROM {self._source(*sides[i], scope)}", args=self.args or None) for i in (at, 1 - at)]
            found = counted(*frames, shape[names[at]], shape[names[1 - at]], list(dict.fromkeys(x.column.field for x in q.group_by)), "__n")
        except AnalysisException:  # a side that cannot be read by itself
            return q
        field = lambda v: "__n" if v.expression == number else v.expression.column.field
        projection = tuple(m.Projection(m.Column(m.ColumnRef(field(v), "__s")), v.alias or field(v)) for v in q.projection)
        return replace(q, projection=projection, source=m.Source(m.ObjectRef(self._view(found)), "__s"), derived_source=None, joins=(), group_by=())

    def _cells(self, sides, grow: float, scope: dict[str, str], head: str) -> Cells:
        from geolode.operators.spatial_join import cell_sizes

        frames = [self.spark.sql(f"{head}SELECT {quoted(c.field)} AS g FROM {self._source(source, derived, scope)}", args=self.args or None) for (source, derived), c in sides]
        return cell_sizes(*frames, "g", "g", grow)

    def _celled(self, source: m.Source | None, derived: m.Derived | None, scope: dict[str, str]) -> str:
        """A source whose rows are dealt to the cells that their boxes touch, for each spatial join that it is part of."""
        out = self._source(source, derived, scope)
        name = derived.alias if derived else source.alias or source.object.object
        for x in self.meetings:
            if name not in (x.left.relation, x.right.relation):
                continue
            column, grow = (x.left, x.grow) if name == x.left.relation else (x.right, 0.0)
            cell = x.cells
            box, plain, part, *axes, cx, cy, fx, fy = map(quoted, x.hidden(name))
            call = lambda f, c=column: f"{spatial.sql_name(f, 1)}({quoted(c.field)})"
            place = lambda end, k, size, sign, b=box, g=grow: f"floor(({b}.{k}{end} {sign} {g!r}D) / {size!r}D)"
            steps = lambda k, size: f"explode(sequence({place('min', k, size, '-')}, {place('max', k, size, '+')}))"  # noqa: E731, B023
            side = "l" if name == x.left.relation else "r"
            dealt = "0L" if cell.parts == 1 else f"pmod(monotonically_increasing_id(), {cell.parts}L)" if side == cell.deals else f"explode(sequence(0L, {cell.parts - 1}L))"
            ends = ", ".join(f"{box}.{end} AS {c}" for end, c in zip(("xmin", "xmax", "ymin", "ymax"), axes, strict=True))
            firsts = ", ".join(f"{c} = {place('min', k, size, '-')} AS {f}" for k, c, f, size in zip("xy", (cx, cy), (fx, fy), cell.sizes, strict=True))
            out = f"(SELECT *, {call('bbox')} AS {box}, CASE WHEN {call('is_box')} THEN {call('srid')} END AS {plain} FROM {out})"
            out = f"(SELECT *, {steps('x', cell.sizes[0])} AS {cx} FROM {out} WHERE {box} IS NOT NULL)"
            out = f"(SELECT *, {steps('y', cell.sizes[1])} AS {cy} FROM {out})"
            out = f"(SELECT *, {dealt} AS {part} FROM {out})"
            out = f"(SELECT /*+ REPARTITION({x.partitions}, {cx}, {cy}, {part}) */ *, {ends}, {firsts} FROM {out}) AS {quoted(name)}"
        return out

    def _on(self, i: int, on: m.Expression, scope: dict[str, str]) -> str:
        """ON; with cells, rows meet by an equality, boxes come next, and a pair is kept in the cell of its larger lower corners."""
        x = next((x for x in self.meetings if x.join == i), None)
        if x is None:
            return self.expression(on, scope)
        side = lambda c: [f"{quoted(c.relation)}.{quoted(h)}" for h in x.hidden(c.relation)]
        (_, lp, ld, *le, lx, ly, lfx, lfy), (_, rp, rd, *re, rx, ry, rfx, rfy) = side(x.left), side(x.right)
        g = f"{x.grow!r}D"
        ends = [(le[0], le[1], re[0], re[1]), (le[2], le[3], re[2], re[3])]
        parts = [f"{lx} = {rx}", f"{ly} = {ry}", f"{ld} = {rd}"]
        parts += [f"{a} - {g} <= {d} AND {c} <= {b} + {g}" for a, b, c, d in ends]
        parts += [f"({lfx} OR {rfx})", f"({lfy} OR {rfy})"]
        parts += [self.expression(e, scope) for e in conjuncts(on) if e is not x.test]
        exact = self.expression(x.test, scope)
        if isinstance(x.test, m.Spatial) and x.test.function == "intersects":
            exact = f"({lp} = {rp} OR {exact})"
        elif isinstance(x.test, m.Spatial) and x.test.function == "d_within" and x.grow > 0:
            within, beyond = box_distance([f"greatest({a} - {d}, {c} - {b}, 0D)" for a, b, c, d in ends], x.grow)
            exact = f"CASE WHEN {lp} = {rp} AND {within} THEN true WHEN {lp} = {rp} AND {beyond} THEN false ELSE {exact} END"
        return " AND ".join([*parts, exact])

    def _distinct_on(self, q: m.Query, scope: dict[str, str], select: str, tail: str) -> tuple[str, str]:
        keys = ", ".join(self.expression(e, scope) for e in q.distinct_on)
        order = ", ".join(self.order(o, scope) for o in q.order_by)
        extra = [f"{self.expression(o.expression, scope)} AS `__o{i}`" for i, o in enumerate(q.order_by)]
        inner = f"SELECT {self._merged()}{select}, {', '.join(extra)}, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS `__r` {tail}"
        hidden = ", ".join(["`__r`", *(f"`__o{i}`" for i in range(len(extra)))])
        outer = f"SELECT * EXCEPT ({hidden}) FROM ({inner}) WHERE `__r` = 1"
        if q.set_operations:
            return outer, order
        return outer, ", ".join(f"`__o{i}` {self._direction(o.direction)}" for i, o in enumerate(q.order_by))

    # expressions

    def parameter(self, name: str) -> str:
        if name not in self.names:
            if name not in self.bag:
                raise invalid("a parameter has no value")
            key = f"p{len(self.names)}"
            value, cast = self.bag[name].sql()
            self.args[key] = value
            self.names[name] = (key, cast)
        key, cast = self.names[name]
        return f"CAST(:{key} AS {cast})" if cast else f":{key}"

    def expression(self, e: m.Expression, scope: dict[str, str]) -> str:
        x = lambda y: self.expression(y, scope)
        if isinstance(e, m.Wildcard):
            return f"{quoted(e.relation)}.*" if e.relation else "*"
        if isinstance(e, m.Column):
            return f"{quoted(e.column.relation)}.{quoted(e.column.field)}" if e.column.relation else quoted(e.column.field)
        if isinstance(e, m.Parameter):
            return self.parameter(e.name)
        if isinstance(e, m.Scalar):
            return f"{SCALAR.get(e.function, e.function)}({', '.join(map(x, e.arguments))})"
        if isinstance(e, m.Spatial):
            return self._spatial(e, scope)
        if isinstance(e, m.SpatialOperator):
            spatial.register(self.spark)
            return f"{spatial.sql_name(e.operator, 2)}({x(e.left)}, {x(e.right)})"
        if isinstance(e, m.Window):
            return self._window(e, scope)
        if isinstance(e, m.ScalarSubquery):
            return f"({self.query(e.query, scope)})"
        if isinstance(e, m.Exists):
            return f"{'NOT ' * e.negated}EXISTS ({self.query(e.query, scope)})"
        if isinstance(e, m.InSubquery):
            return f"({x(e.expression)} {'NOT ' * e.negated}IN ({self.query(e.query, scope)}))"
        if isinstance(e, m.Compare):
            return f"({x(e.left)} {COMPARE[e.operator]} {x(e.right)})"
        if isinstance(e, m.And | m.Or):
            return "(" + (" AND " if isinstance(e, m.And) else " OR ").join(map(x, e.arguments)) + ")"
        if isinstance(e, m.IsNull):
            return f"({x(e.expression)} IS {'NOT ' * e.negated}NULL)"
        raise unsupported("this expression")

    def _direction(self, direction: str) -> str:
        high = self.profile.nulls == "high"
        return ("ASC NULLS " if direction == "asc" else "DESC NULLS ") + ("LAST" if (direction == "asc") == high else "FIRST")

    def order(self, o: m.Ordering, scope: dict[str, str]) -> str:
        return f"{self.expression(o.expression, scope)} {self._direction(o.direction)}"

    def _window(self, w: m.Window, scope: dict[str, str]) -> str:
        parts = []
        if w.partition_by:
            parts.append("PARTITION BY " + ", ".join(self.expression(e, scope) for e in w.partition_by))
        if w.order_by:
            parts.append("ORDER BY " + ", ".join(self.order(o, scope) for o in w.order_by))
        elif w.function in m.WINDOW_ONLY:
            parts.append("ORDER BY (SELECT NULL)")
        if w.frame and w.function not in m.WINDOW_ONLY:
            bound = lambda b: b.kind.replace("_", " ").upper() if b.offset is None else f"{int(b.offset)} {b.kind.upper()}"
            parts.append(f"{w.frame.units.upper()} BETWEEN {bound(w.frame.start)} AND {bound(w.frame.end or m.Bound('current_row'))}")
        args = ", ".join(self.expression(a, scope) for a in w.arguments)
        return f"{SCALAR.get(w.function, w.function)}({args}) OVER ({' '.join(parts)})"

    def _spatial(self, e: m.Spatial, scope: dict[str, str]) -> str:
        spatial.register(self.spark)
        n = len(e.arguments)
        if not aggregate(e.function, n):
            return f"{spatial.sql_name(e.function, n)}({', '.join(self.expression(a, scope) for a in e.arguments)})"
        if e.function in ("as_mvt", "as_geobuf"):
            keys = ("layer", "extent", "geometry", "id") if e.function == "as_mvt" else ("geometry",)
            given = {}
            for key, a in zip(keys, e.arguments[1:], strict=False):
                if not isinstance(a, m.Parameter) or a.name not in self.bag:
                    raise invalid(f"{e.function} takes parameters after its rows")
                given[key] = self.bag[a.name].value
            name = spatial.encoder(self.spark, e.function, **given)
            first = e.arguments[0]
            return f"{name}(collect_list(struct({self.expression(first, scope)})))"
        cell = self.expression(e.arguments[0], scope)
        if e.function == "extent":
            box = f"{spatial.sql_name('bbox', 1)}({cell})"
            fields = ", ".join(f"'{k}', {k[1:]}({box}.{k})" for k in ("xmin", "ymin", "xmax", "ymax"))
            return f"CASE WHEN count({box}.xmin) > 0 THEN named_struct({fields}) END"
        return f"{spatial.sql_name(e.function + '_agg', 1)}(collect_list({cell}))"

    # rewrites

    def _staged(self, q: m.Query, scope: dict[str, str], head: str) -> m.Query:
        """The query over a step that computes what its windows need: dense ranks for GROUPS frames, clusters."""
        units: dict[m.Expression, str] = {}
        ranks: dict[tuple, str] = {}
        clusters: dict[m.SpatialWindow, str] = {}

        def unit(e: m.Expression) -> m.Expression:
            units.setdefault(e, f"__c{len(units)}")
            return m.Column(m.ColumnRef(units[e]))

        def over(e: m.Expression) -> m.Expression:
            if isinstance(e, m.Wildcard):
                raise unsupported("a wildcard beside a GROUPS frame or clusters")
            if isinstance(e, m.Parameter):
                return e
            if isinstance(e, m.Column | m.ScalarSubquery | m.Exists | m.InSubquery) or validate.is_aggregate(e) or e in q.group_by:
                return unit(e)
            if isinstance(e, m.SpatialWindow):
                clusters.setdefault(e, f"__k{len(clusters)}")
                for a in (e.arguments[0], *e.partition_by):
                    unit(a)
                return m.Column(m.ColumnRef(clusters[e]))
            if isinstance(e, m.Window):
                order, frame = tuple(m.Ordering(over(o.expression), o.direction) for o in e.order_by), e.frame
                if frame and frame.units == "groups":
                    key = (e.partition_by, e.order_by)
                    ranks.setdefault(key, f"__g{len(ranks)}")
                    order, frame = (m.Ordering(m.Column(m.ColumnRef(ranks[key]))),), replace(frame, units="range")
                return replace(e, arguments=tuple(a if isinstance(a, m.Wildcard) else over(a) for a in e.arguments), partition_by=tuple(map(over, e.partition_by)), order_by=order, frame=frame)
            if isinstance(e, m.Scalar | m.Spatial | m.And | m.Or):
                return replace(e, arguments=tuple(map(over, e.arguments)))
            if isinstance(e, m.Compare | m.SpatialOperator):
                return replace(e, left=over(e.left), right=over(e.right))
            if isinstance(e, m.IsNull):
                return replace(e, expression=over(e.expression))
            raise unsupported("this expression beside a GROUPS frame or clusters")

        aliases = {v.alias for v in q.projection if v.alias}
        named = lambda e: isinstance(e, m.Column) and e.column.relation is None and e.column.field in aliases
        projection = tuple(m.Projection(over(v.expression), v.alias or (v.expression.column.field if isinstance(v.expression, m.Column) else None)) for v in q.projection)
        keep = lambda e: e if named(e) else over(e)
        order = tuple(m.Ordering(keep(o.expression), o.direction) for o in q.order_by)
        distinct_on = tuple(map(keep, q.distinct_on))
        inner_projection = [m.Projection(e, name) for e, name in units.items()]
        inner_projection += [m.Projection(m.Window("dense_rank", (), p, o), name) for (p, o), name in ranks.items()]
        inner = m.Query(
            tuple(inner_projection) or (m.Projection(m.Scalar("count", (m.Wildcard(),)), "__n"),),
            source=q.source, derived_source=q.derived_source, joins=q.joins, filter=q.filter, group_by=q.group_by, having=q.having,
        )
        outer = m.Query(projection, derived_source=m.Derived(inner, "__s"), order_by=order, distinct=q.distinct, distinct_on=distinct_on, set_operations=q.set_operations, row_limit=q.row_limit, row_offset=q.row_offset)
        if not clusters:
            return outer
        rows = self.spark.sql(head + self.query(inner, scope), args=self.args or None)
        for w, name in clusters.items():
            keys = [units[p] for p in w.partition_by]
            given = []
            for a in w.arguments[1:]:
                if not isinstance(a, m.Parameter) or a.name not in self.bag:
                    raise invalid(f"{w.function} takes parameters after its geometry")
                given.append(self.bag[a.name].value)
            cell = units[w.arguments[0]]
            if w.function == "cluster_dbscan":
                rows = dbscan(rows, cell, float(given[0]), int(given[1]), keys, name)
            else:
                rows = k_means(rows, cell, int(given[0]), keys, name)
        view = self._view(rows)
        return replace(outer, derived_source=None, source=m.Source(m.ObjectRef(view), "__s"))

    def _view(self, df: DataFrame) -> str:
        name = f"geolode_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        self.views.append(name)
        return name

    @staticmethod
    def _distinct_step(c: m.CommonTable) -> bool:
        return any(s.operator == "union" and not s.all for s in c.query.set_operations)

    def _rounds(self, c: m.CommonTable, heads: list[str], recursive: bool, scope: dict[str, str]) -> str:
        """Recursion without duplicates: each round runs the step over the rows that the last one added, and keeps those not met before."""
        q = c.query
        if len(q.set_operations) != 1 or q.order_by or q.row_limit is not None or q.row_offset is not None:
            raise unsupported("a recursive UNION of more than a first part and a step")
        prefix = f"WITH {'RECURSIVE ' * recursive}{', '.join(heads)} " if heads else ""
        first = replace(q, set_operations=())
        run = lambda text: self.spark.sql(prefix + text, args=self.args or None)
        fresh = stored(run(self.query(first, scope)).distinct())
        parts, names = [fresh], fresh.columns
        for _ in range(ROUNDS):
            if not fresh.limit(1).count():
                break
            view = self._view(fresh)
            step = run(self.query(q.set_operations[0].query, scope | {c.name: quoted(view)})).toDF(*names)
            before = parts[0]
            for p in parts[1:]:
                before = before.unionByName(p)
            fresh = stored(step.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in before.dtypes]).subtract(before))
            parts.append(fresh)
            if len(parts) > 16:
                merged = parts[0]
                for p in parts[1:]:
                    merged = merged.unionByName(p)
                merged = stored(merged)
                for p in parts[:-1]:
                    release(p)
                parts = [merged]
        else:
            raise EngineError("resource_limit", f"recursion beyond {ROUNDS} rounds", "read")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return quoted(self._view(out))


def within_index(table: DataFrame, field: str, shape: Column, grow: float) -> Column:
    """The rows whose box, in the columns that an indexed write keeps beside a geometry, meets the shape's: ranges that files and row groups are pruned by.

    Rows without a box, as a write of other tools leaves them, stay for the exact test.
    """
    names = {k: f"{field}_{k}" for k in ("xmin", "ymin", "xmax", "ymax")}
    if any(n not in table.columns or table.schema[n].metadata.get(INDEX) != field for n in names.values()):
        return F.lit(True)
    box = table.sparkSession.range(1).select(spatial.call(table.sparkSession, "bbox", shape).alias("b")).first().b
    if box is None:
        return F.lit(True)
    c = {k: F.col(quoted(n)) for k, n in names.items()}
    low, high = (lambda k, to: c[k].isNull() | (c[k] >= to)), (lambda k, to: c[k].isNull() | (c[k] <= to))
    return high("xmin", box.xmax + grow) & low("xmax", box.xmin - grow) & high("ymin", box.ymax + grow) & low("ymax", box.ymin - grow)


def read_frame(table: DataFrame, r: m.Read, bag: Bag, profile: validate.Profile) -> DataFrame:
    """A table read as DataFrame operations, which Catalyst pushes into the scan."""
    spark = table.sparkSession

    def col(name: str) -> Column:
        if name not in table.columns:
            raise EngineError("not_found", "a read names a column that the table lacks", "prepare")
        return table[quoted(name)]

    def condition(f: m.Filter) -> Column:
        if isinstance(f, m.AllOf | m.AnyOf):
            out = condition(f.args[0])
            for x in f.args[1:]:
                out = out & condition(x) if isinstance(f, m.AllOf) else out | condition(x)
            return out
        c = col(f.field)
        if isinstance(f, m.FieldIsNull):
            return c.isNull()
        if isinstance(f, m.FieldIsNotNull):
            return c.isNotNull()
        if isinstance(f, m.FieldIn):
            return c.isin([needed(bag, p) for p in f.parameters])
        if isinstance(f, m.FieldBetween):
            return c.between(needed(bag, f.lower_parameter), needed(bag, f.upper_parameter))
        if isinstance(f, m.FieldLike):
            pattern = needed(bag, f.parameter)
            return F.call_function("ilike" if f.case_insensitive else "like", c, pattern)
        if isinstance(f, m.FieldIntersects):
            shape = needed(bag, f.wkb_parameter)
            own = spatial.call(spark, "set_srid", shape, spatial.call(spark, "srid", c))
            return within_index(table, f.field, shape, 0.0) & spatial.call(spark, "bounding_box_intersects", c, own) & spatial.call(spark, "intersects", c, own)
        if isinstance(f, m.FieldSpatial):
            args = [c] + [needed(bag, p) for p in (f.geometry_parameter, f.distance_parameter) if p is not None]
            exact = spatial.call(spark, f.function, *args)
            if f.geometry_parameter is None or f.function == "disjoint":
                return exact
            grow = float(bag[f.distance_parameter].value) if f.function == "d_within" else 0.0
            if f.function != "d_within":
                exact = spatial.call(spark, "bounding_box_intersects", args[0], args[1]) & exact
            return within_index(table, f.field, args[1], grow) & exact
        value = needed(bag, f.parameter)
        kind = f.TAG[1]
        return {"eq": c == value, "ne": c != value, "lt": c < value, "lte": c <= value, "gt": c > value, "gte": c >= value}[kind]

    out = table.filter(condition(r.filter)) if r.filter is not None else table
    if r.order_by:
        keys = []
        for o in r.order_by:
            c, high = col(o.field), profile.nulls == "high"
            keys.append((c.asc_nulls_last() if high else c.asc_nulls_first()) if o.direction == "asc" else (c.desc_nulls_first() if high else c.desc_nulls_last()))
        out = out.orderBy(*keys)
    if r.projection:
        out = out.select(*[col(n) for n in r.projection])
    return out.limit(r.row_limit) if r.row_limit is not None else out
