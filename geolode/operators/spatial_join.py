"""Spatial joins without comparing every pair: both sides meet in grid cells, and each pair is tested once."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolode.functions import spatial
from geolode.functions.catalog import BINARY_PREDICATES
from geolode.plans.lower import box_distance, quoted
from geolode.shared import stored

CELLS_A_SIDE = 4096
#: Cells for each shuffle partition, over the region that both sides share, as long as a mean shape touches no more than COPIES of them in a row.
CELLS_A_PARTITION, COPIES = 8, 16
#: A cell of fewer pairs than these is not dealt into parts.
PAIRS_A_PART = 1 << 20


@dataclass(frozen=True)
class Cells:
    """The cells' sizes by axis, and into how many parts each cell's pairs are dealt: ``deals`` says which side's rows go to one part (l or r); those of the other go to all."""

    sizes: tuple[float, float]
    parts: int = 1
    deals: str = "l"


def partitions(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def cell_sizes(left: DataFrame, right: DataFrame, a: str, b: str, grow: float = 0.0) -> Cells:
    """For each axis the larger mean extent of the two sides' boxes, and no finer than a 4,096th of all: one aggregation of each side.

    Where that leaves few cells to share the work among, as with shapes that are large against the region where the sides overlap, the axis with more cells is cut finer,
    and if that is not enough, each cell's pairs are dealt into parts: the smaller side is copied to each.
    """
    spark, most, span, low, high, rows = left.sparkSession, [0.0, 0.0], [0.0, 0.0], [-math.inf] * 2, [math.inf] * 2, []
    for df, c in ((left, a), (right, b)):
        box = df.select(spatial.call(spark, "bbox", F.col(quoted(c))).alias("b")).filter("b IS NOT NULL").select("b.*")
        got = box.agg(*[f for k in "xy" for f in (F.avg(F.col(f"{k}max") - F.col(f"{k}min")), F.min(f"{k}min"), F.max(f"{k}max"))], F.count("*")).first()
        rows.append([got[6], [got[0], got[3]]])
        for i in (0, 1):
            mean, least, top = got[3 * i : 3 * i + 3]
            if mean is None:
                return Cells((1.0 + grow, 1.0 + grow))
            most[i], span[i], low[i], high[i] = max(most[i], mean), max(span[i], top - least), max(low[i], least), min(high[i], top)
    sizes = [max(m, s / CELLS_A_SIDE) or 1.0 for m, s in zip(most, span, strict=True)]
    shared = [max(h - x, 0.0) for h, x in zip(high, low, strict=True)]
    wanted = CELLS_A_PARTITION * partitions(spark)
    cells = lambda: math.prod(s / z + 1 for s, z in zip(shared, sizes, strict=True))
    while cells() < wanted:
        i = max((0, 1), key=lambda k: shared[k] / sizes[k])
        if not shared[i] or most[i] > COPIES / 2 * sizes[i] or sizes[i] <= span[i] / CELLS_A_SIDE:
            break
        sizes[i] /= 2
    sent = [n * math.prod(m / z + 1 for m, z in zip(mean, sizes, strict=True)) for n, mean in rows]
    parts = min(math.ceil(wanted / cells()), math.ceil(max(sent) / max(min(sent), 1.0)), math.ceil(sent[0] * sent[1] / cells() / PAIRS_A_PART))
    return Cells((sizes[0] + grow, sizes[1] + grow), max(parts, 1), "l" if sent[0] >= sent[1] else "r")


def spatial_join(left: DataFrame, right: DataFrame, a: str, b: str, predicate: str = "intersects", distance: float | None = None, sizes: tuple[float, float] | None = None) -> DataFrame:
    """Inner join of rows whose geometries ``a`` and ``b`` meet the predicate, or lie within ``distance`` (d_within).

    Each side's boxes (the left grown by the distance) go to the cells they touch; rows meet by an equality on the cell, which Spark
    shuffles and splits where it is skewed. A pair that shares several cells is kept in the one that holds the larger of their lower
    corners, so no later step has to remove repeats. Boxes are compared next; points and upright rectangles are their boxes, so that their
    pairs are decided there. All other pairs are tested exactly. Null and empty geometries join nothing.
    Columns of the right side that clash get the suffix ``_right``.
    """
    if predicate == "disjoint" or (predicate not in BINARY_PREDICATES and predicate != "d_within"):
        raise ValueError("a predicate that needs the boxes to meet")
    if (predicate == "d_within") != (distance is not None):
        raise ValueError("a distance goes with d_within")
    spark = left.sparkSession
    grow = float(distance or 0.0)
    cells = Cells(sizes) if sizes else cell_sizes(left, right, a, b, grow)
    call = lambda f, *args: spatial.call(spark, f, *args)
    names = {c: c if c not in left.columns else f"{c}_right" for c in right.columns}

    def dealt(df: DataFrame, c: str, by: float, tag: str) -> DataFrame:
        """Flat columns, so that Catalyst drops those that nobody reads; the geometry is sent once."""
        g = F.col(quoted(c))
        row = df.select(*[F.col(quoted(x)).alias(f"{tag}{i}") for i, x in enumerate(df.columns)], call("bbox", g).alias("box"), call("srid", g).alias(f"{tag}_srid"), F.when(call("is_box", g), call("srid", g)).alias(f"{tag}_plain"))
        row = row.filter("box IS NOT NULL").select("*", *[F.col(f"box.{k}{end}").alias(f"{tag}_{k}{end}") for k in "xy" for end in ("min", "max")])
        for k, size in zip("xy", cells.sizes, strict=True):
            place = lambda end, k=k, size=size: F.floor((F.col(f"{tag}_{k}{end}") + F.lit(by if end == "max" else -by)) / F.lit(size))
            row = row.withColumn(f"c{k}", F.explode(F.sequence(place("min"), place("max")))).withColumn(f"{tag}_{k}", F.col(f"c{k}") == place("min"))
        part = F.pmod(F.monotonically_increasing_id(), F.lit(cells.parts)) if tag == cells.deals else F.explode(F.sequence(F.lit(0), F.lit(cells.parts - 1))).cast("bigint")
        return row.drop("box").withColumn("part", part if cells.parts > 1 else F.lit(0).cast("bigint")).repartition(partitions(spark), "cx", "cy", "part")

    both = dealt(left, a, grow, "l").hint("merge").join(dealt(right, b, 0.0, "r"), ["cx", "cy", "part"])
    home = [F.col(f"l_{k}") | F.col(f"r_{k}") for k in "xy"]
    meet = [(F.col(f"l_{k}min") - F.lit(grow) <= F.col(f"r_{k}max")) & (F.col(f"r_{k}min") <= F.col(f"l_{k}max") + F.lit(grow)) for k in "xy"]
    exact = call(predicate, F.col(f"l{left.columns.index(a)}"), F.col(f"r{right.columns.index(b)}"), *([F.lit(distance)] if distance is not None else []))
    plain = F.col("l_plain") == F.col("r_plain")
    if predicate == "intersects":
        exact = plain | exact
    elif predicate == "d_within" and grow > 0:
        within, beyond = box_distance([f"greatest(l_{k}min - r_{k}max, r_{k}min - l_{k}max, 0D)" for k in "xy"], grow)
        exact = F.when(plain & F.expr(within), True).when(plain & F.expr(beyond), False).otherwise(exact)
    elif predicate in ("covers", "covered_by"):
        out, own = ("l", "r") if predicate == "covers" else ("r", "l")
        meet += [(F.col(f"{out}_{k}min") <= F.col(f"{own}_{k}min")) & (F.col(f"{own}_{k}max") <= F.col(f"{out}_{k}max")) for k in "xy"]
        exact = (F.col(f"{out}_plain") == F.col(f"{own}_srid")) | exact
    kept = both
    for test in (*meet, *home, exact):
        kept = kept.filter(test)
    return kept.select(*[F.col(f"l{i}").alias(c) for i, c in enumerate(left.columns)], *[F.col(f"r{i}").alias(n) for i, n in enumerate(names.values())])


def counted(left: DataFrame, right: DataFrame, a: str, b: str, keys: list[str], name: str = "n") -> DataFrame:
    """How many pairs of intersecting shapes each value of the left side's ``keys`` has, where it has any, without making the pairs.

    Equal shapes are one, with the number of their rows as weight. Points in upright rectangles of one SRID are counted between ranks of the points'
    coordinates: rectangles between the same ranks are one, and each takes the running counts of the columns it spans. Other shapes' pairs are made and weighed.
    """
    spark = left.sparkSession
    call = lambda f, c: spatial.call(spark, f, F.col(c))

    def side(df: DataFrame, c: str, by: list[str]) -> DataFrame:
        some = df.select(*[F.col(quoted(k)).alias(f"k{i}") for i, k in enumerate(by)], F.col(quoted(c)).alias("g"))
        some = some.groupBy(*[f"k{i}" for i in range(len(by))], "g").agg(F.count("*").alias("w"))
        some = some.select("*", call("bbox", "g").alias("box"), call("srid", "g").alias("srid"), call("is_box", "g").alias("plain")).filter("box IS NOT NULL").select("*", "box.*").drop("box")
        return stored(some.withColumn("point", F.expr("plain AND xmin = xmax AND ymin = ymax")))

    rows, cells = side(left, a, keys), side(right, b, [])
    own = [f"k{i}" for i in range(len(keys))]
    srids = [df.agg(F.min("srid"), F.max("srid")).first() for df in (rows, cells)]
    pairs = lambda l, r: spatial_join(l.select(*own, "g", "w"), r.select("g", F.col("w").alias("v")), "g", "g").select(*own, (F.col("w") * F.col("v")).alias("n"))
    plain, points = rows.filter("plain"), cells.filter("point")
    found = []
    if len({*srids[0], *srids[1]}) == 1:
        found.append(_in_ranks(plain, points, own))
        rest = [(rows.filter("NOT plain"), points), (rows, cells.filter("NOT point"))]
    else:
        rest = [(rows, cells)]
    found += [pairs(l, r) for l, r in rest if l.limit(1).count() and r.limit(1).count()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy(*own).agg(F.sum("n").alias("n")).select(*[F.col(k).alias(n) for k, n in zip(own, keys, strict=True)], F.col("n").alias(name))


def _running(df: DataFrame, order: list[str], weight: str) -> DataFrame:
    """``df`` with the sum of ``weight`` up to each row in an order, as ``upto``: parts of the order are summed apart, and the sums before each part added."""
    n = partitions(df.sparkSession)
    df = stored(df.repartitionByRange(n, *order).withColumn("slice", F.spark_partition_id()))
    sums = df.groupBy("slice").agg(F.sum(weight).alias("s")).withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    return df.join(F.broadcast(sums), "slice").withColumn("upto", F.col("before") + F.sum(weight).over(Window.partitionBy("slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).drop("slice", "before")


def _in_ranks(rects: DataFrame, points: DataFrame, own: list[str]) -> DataFrame:
    """The weighed counts of points in each rectangle."""
    rects = rects.select(*own, "w", "xmin", "xmax", "ymin", "ymax")
    points = points.select(F.col("xmin").alias("x"), F.col("ymin").alias("y"), "w")
    ranks = {}
    for k in "xy":
        # values of one coordinate; a rectangle's lower end stands before points at the same place (0), its upper end after them (2)
        marks = points.select(F.col(k).alias("v"), F.lit(1).alias("at")).distinct().withColumn("one", F.lit(1))
        for end, at in (("min", 0), ("max", 2)):
            marks = marks.unionByName(rects.select(F.col(f"{k}{end}").alias("v"), F.lit(at).alias("at")).distinct().withColumn("one", F.lit(0)))
        ranks[k] = stored(_running(marks, ["v", "at"], "one").select("v", "at", F.col("upto").alias("r")))
    rank = lambda k, at, c, to: ranks[k].filter(f"at = {at}").select(F.col("v").alias(c), F.col("r").alias(to))
    for k in "xy":
        rects = rects.join(rank(k, 0, f"{k}min", f"{k}0"), f"{k}min").join(rank(k, 2, f"{k}max", f"{k}1"), f"{k}max")
        points = points.join(rank(k, 1, k, f"{k}r"), k)
    # ranks from x0 + 1 to x1 and y0 + 1 to y1: nodes of a binary tree over x ranks cover a range by two a level at most
    rects = stored(rects.filter("x0 < x1 AND y0 < y1").select(*own, "w", "x0", "x1", "y0", "y1"))
    spans = stored(rects.select("x0", "x1").distinct())
    top = spans.agg(F.max("x1")).first()[0] or 0
    levels = max(int(top).bit_length() + 1, 1)
    # at level h, whole nodes of 2^h ranks are lo to hi - 1: an odd lower end and an odd upper end are taken, the rest goes up a level
    step = spans.select("x0", "x1", F.explode(F.expr(f"sequence(0, {levels - 1})")).alias("h"))
    step = step.select("x0", "x1", "h", F.expr("shiftright(x0 + shiftleft(1L, h), h)").alias("lo"), F.expr("shiftright(x1 + 1, h)").alias("hi")).filter("lo < hi")
    nodes = step.select("x0", "x1", "h", F.explode(F.expr("array_distinct(array_compact(array(IF(lo % 2 = 1, lo, NULL), IF(hi % 2 = 1, hi - 1, NULL))))")).alias("node"))
    asked = rects.select("x0", "x1", "y0", "y1").distinct()
    ends = asked.select("x0", "x1", F.explode(F.array("y0", "y1")).alias("y")).distinct().join(nodes, ["x0", "x1"]).select("h", "node", "y").distinct()
    held = points.groupBy("xr", "yr").agg(F.sum("w").alias("w")).select("yr", "w", F.explode(F.expr(f"transform(sequence(0, {levels - 1}), h -> struct(h, shiftright(xr, h) AS node))")).alias("n")).select("n.*", F.col("yr").alias("y"), "w")
    held = held.groupBy("h", "node", "y").agg(F.sum("w").alias("w")).withColumn("at", F.lit(0))
    sums = stored(_running(held.unionByName(ends.select("h", "node", "y", F.lit(0).cast("bigint").alias("w"), F.lit(1).alias("at"))), ["h", "node", "y", "at"], "w").filter("at = 1").select("h", "node", "y", "upto"))
    both = asked.join(nodes, ["x0", "x1"]).join(sums.select("h", "node", F.col("y").alias("y0"), F.col("upto").alias("u0")), ["h", "node", "y0"]).join(sums.select("h", "node", F.col("y").alias("y1"), F.col("upto").alias("u1")), ["h", "node", "y1"])
    inside = both.groupBy("x0", "x1", "y0", "y1").agg(F.sum(F.col("u1") - F.col("u0")).alias("inside")).filter("inside > 0")
    return rects.join(inside, ["x0", "x1", "y0", "y1"]).select(*own, (F.col("w") * F.col("inside")).alias("n"))
