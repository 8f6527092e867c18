"""What is known of a query's shapes before it runs: SRIDs and dimensions by contract, and operands that do not go together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import types as T

from geolode import contract
from geolode.errors import EngineError
from geolode.functions.catalog import BINARY_PREDICATES, FUNCTIONS
from geolode.functions.spatial import OPERATORS
from geolode.plans import model as m
from geolode.plans import validate
from geolode.plans.parameters import Bag

PAIRS = BINARY_PREDICATES | {"relate", "d_within", "distance", "distance_3d", "max_distance", "hausdorff_distance", "frechet_distance", "azimuth", "intersection", "difference", "sym_difference"} | set(OPERATORS)
FORCED = {"force_2d": "xy", "force_3d": "xyz", "force_3dm": "xym", "force_4d": "xyzm"}
SAME = {"set_srid", "transform", "reverse", "start_point", "end_point", "point_n"}


class Operands:
    """``schema`` gives a table's schema, or None where it is not known."""

    def __init__(self, q: m.Query, schema: Callable[[m.ObjectRef], T.StructType | None], bag: Bag):
        self.query, self.bag = q, bag
        self.fields: dict[str, dict[str, T.StructField]] = {}
        tables = {c.name.lower() for c in q.common_table_expressions}
        for s in (q.source, *(j.source for j in q.joins)):
            if s and not (s.object.schema is None and s.object.object.lower() in tables) and (found := schema(s.object)) is not None:
                self.fields[s.alias or s.object.object] = {f.name: f for f in found.fields}

    def field(self, e: m.Expression) -> T.StructField | None:
        if not isinstance(e, m.Column):
            return None
        own = [f[e.column.field] for r, f in self.fields.items() if e.column.relation in (None, r) and e.column.field in f]
        return own[0] if len(own) == 1 else None

    def srid(self, e: m.Expression) -> int | None:
        """The SRID of a shape where it is declared, None where only its cells know."""
        if isinstance(e, m.Parameter):
            return getattr(self.bag.get(e.name), "srid", None)
        if isinstance(e, m.Spatial):
            if e.function in ("set_srid", "transform"):
                to = e.arguments[-1]
                value = self.bag[to.name].value if isinstance(to, m.Parameter) and to.name in self.bag else None
                return value if isinstance(value, int) else None
            return self.srid(e.arguments[0]) if e.arguments and FUNCTIONS[e.function].returns == "geometry" else None
        f = self.field(e)
        known = contract.keys(f).get("srid") if f else None
        return int(known) if known else None

    def dimensions(self, e: m.Expression) -> str:
        if isinstance(e, m.Spatial):
            return FORCED.get(e.function) or (self.dimensions(e.arguments[0]) if e.function in SAME else "unknown")
        f = self.field(e)
        return contract.keys(f).get("dimensions", "unknown") if f else "unknown"

    def declared(self, e: m.Spatial) -> dict:
        return {"srid": self.srid(e), "dimensions": self.dimensions(e)}

    def check(self) -> None:
        """Raises where two shapes of a test have different SRIDs by contract, or a shape is asked of a column that holds none."""
        q = self.query
        places = [*(v.expression for v in q.projection), *(j.on for j in q.joins), q.filter, *q.group_by, q.having, *(o.expression for o in q.order_by)]
        for place in places:
            for e in () if place is None else validate.walk(place):
                if isinstance(e, m.Spatial):
                    name, args = e.function, e.arguments
                elif isinstance(e, m.SpatialOperator):
                    name, args = e.operator, (e.left, e.right)
                else:
                    continue
                two = args[:2] if name in PAIRS else args[:1]
                for a in two:
                    f = self.field(a)
                    if f is not None and not isinstance(f.dataType, T.BinaryType) and name not in ("collect", "as_mvt", "as_geobuf"):
                        raise EngineError("schema", f"{name} of {f.name}, which holds no geometry", "prepare")
                known = {s for a in two if (s := self.srid(a))} if len(two) == 2 else set()
                if len(known) > 1:
                    raise EngineError("crs", f"{name} of shapes with different SRIDs", "prepare")
