"""Clusters of geometries within partitions: DBSCAN and k-means.

Both depend on a row's place only, so each partition's distinct places are clustered, with the number of their rows as weights, and rows get their
place's cluster by a join. What a task holds is a partition's distinct places, 24 bytes each, not its rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.functions import spatial
from geolode.shared import stored

#: Distances that are held at a time.
BLOCK = 1 << 22


def _with_centres(df: DataFrame, cell: str) -> DataFrame:
    box = spatial.call(df.sparkSession, "bbox", spatial.call(df.sparkSession, "centroid", F.col(f"`{cell}`")))
    return df.withColumn("__b", box).withColumn("__x", F.col("__b.xmin")).withColumn("__y", F.col("__b.ymin")).drop("__b")


def _settled(df: DataFrame) -> DataFrame:
    """The rows are read twice; where a second reading might find others, they are written first."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return df if plan.deterministic() and not re.search("Limit|Sample|Offset", plan.toString()) else stored(df)


def _grouped(df: DataFrame, cell: str, keys: list[str], name: str, label) -> DataFrame:
    """``label`` over the distinct places of each partition, in (x, y) order, and their weights: it returns numbers from 0, or -1."""
    df = _with_centres(_settled(df), cell)
    own = list(dict.fromkeys(keys))
    places = df.filter("__x IS NOT NULL AND NOT isnan(__x)").groupBy(*[F.col(f"`{k}`").alias(f"__p{i}") for i, k in enumerate(own)], F.col("__x").alias("__px"), F.col("__y").alias("__py")).agg(F.count("*").alias("__w"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("__px", "ascending"), ("__py", "ascending")])
        found = label(*[table[c].to_numpy() for c in ("__px", "__py", "__w")])
        return table.drop_columns("__w").append_column("__label", pa.array(found.astype(np.int32), mask=found < 0))

    kinds = dict(places.dtypes)
    fields = ", ".join(f"{c} {kinds[c]}" for c in places.columns if c != "__w")
    labels = stored(places.groupBy(*[f"__p{i}" for i in range(len(own))]).applyInArrow(run, f"{fields}, __label int"))
    same = [F.col(f"`{a}`").eqNullSafe(F.col(b)) for a, b in [*((k, f"__p{i}") for i, k in enumerate(own)), ("__x", "__px"), ("__y", "__py")]]
    on = same[0]
    for test in same[1:]:
        on = on & test
    return df.join(labels, on, "left").select(*[F.col(f"`{c}`") for c in df.columns if c not in ("__x", "__y")], F.col("__label").alias(name))


def _places(x: list, y: list) -> tuple[np.ndarray, ...]:
    """Distinct places in order, their weights, and each row's place, or -1."""
    own = [i for i in range(len(x)) if x[i] is not None and x[i] == x[i]]
    places, at, w = np.unique(np.array([(x[i], y[i]) for i in own], float).reshape(-1, 2), axis=0, return_inverse=True, return_counts=True)
    row = np.full(len(x), -1)
    row[own] = at.ravel()
    return places[:, 0], places[:, 1], w, row


def _of_rows(row: np.ndarray, found: np.ndarray) -> list[int | None]:
    return [None if i < 0 or found[i] < 0 else int(found[i]) for i in row]


def dbscan_labels(x: list, y: list, eps: float, least: int) -> list[int | None]:
    """Clusters numbered by their first core point in (x, y) order; None: noise or no place. A point between clusters is in the first of them."""
    a, b, w, row = _places(x, y)
    return _of_rows(row, dbscan_places(a, b, w, eps, least))


def k_means_labels(x: list, y: list, k: int, rounds: int = 100) -> list[int | None]:
    """Lloyd's rounds from centres that lie farthest apart, the first being the first point in (x, y) order."""
    a, b, w, row = _places(x, y)
    return _of_rows(row, k_means_places(a, b, w, k, rounds))


def dbscan_places(x: np.ndarray, y: np.ndarray, w: np.ndarray, eps: float, least: int) -> np.ndarray:
    """A grid whose squares are narrower than eps across: where a square has ``least`` rows, its places are core without a comparison, and the
    core places of a square are one cluster. Only places of sparser squares are compared with all around them, and squares until two places meet.
    """
    n, out = len(x), np.full(len(x), -1)
    if not n:
        return out
    if not eps > 0:
        core = w >= least if eps == 0 else np.full(n, least <= 0)
        out[core] = np.arange(core.sum())
        return out
    side, most = eps / 1.5, eps * eps
    squares, of = np.unique(np.column_stack([np.floor(x / side), np.floor(y / side)]), axis=0, return_inverse=True)
    of = of.ravel()
    members = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[members], np.arange(len(squares) + 1))
    own = [members[starts[s] : starts[s + 1]] for s in range(len(squares))]
    index = {(p, q): s for s, (p, q) in enumerate(squares.tolist())}
    steps = [(p, q) for p in range(-2, 3) for q in range(-2, 3) if abs(p) + abs(q) < 4]

    def around(s: int, later: bool = False) -> list[int]:
        p, q = squares[s].tolist()
        return [t for d in steps if (not later or d > (0, 0)) and (t := index.get((p + d[0], q + d[1]))) is not None]

    def near(some: np.ndarray, others: np.ndarray):
        """Blocks of ``some``, and which of ``others`` are near each of them."""
        step = max(1, BLOCK // max(len(others), 1))
        for i in range(0, len(some), step):
            part = some[i : i + step]
            yield part, (x[part][:, None] - x[others]) ** 2 + (y[part][:, None] - y[others]) ** 2 <= most

    core = np.bincount(of, w)[of] >= least
    sparse = [s for s in range(len(squares)) if not core[own[s][0]]]
    for s in sparse:
        others = np.concatenate([own[t] for t in around(s)])
        for part, hit in near(own[s], others):
            core[part] = hit @ w[others] >= least
    cores = [i[core[i]] for i in own]
    root = list(range(len(squares)))

    def find(s: int) -> int:
        while root[s] != s:
            root[s] = root[root[s]]
            s = root[s]
        return s

    for s in range(len(squares)):
        if not len(cores[s]):
            continue
        for t in around(s, True):
            if len(cores[t]) and find(s) != find(t):
                # only places that reach the other square's box can meet one of its places
                reach = lambda some, other: some[np.maximum(np.maximum(x[other].min() - x[some], x[some] - x[other].max()), 0) ** 2 + np.maximum(np.maximum(y[other].min() - y[some], y[some] - y[other].max()), 0) ** 2 <= most * (1 + 1e-9)]
                a, b = reach(cores[s], cores[t]), reach(cores[t], cores[s])
                if len(a) and len(b) and any(hit.any() for _, hit in near(a, b)):
                    root[find(t)] = find(s)
    roots = np.array([find(s) for s in range(len(squares))])[of]
    at = np.flatnonzero(core)
    names, first, which = np.unique(roots[at], return_index=True, return_inverse=True)
    number = np.empty(len(names), int)
    number[np.argsort(first)] = np.arange(len(names))
    out[at] = number[which.ravel()]
    for s in sparse:
        lone = own[s][~core[own[s]]]
        others = np.concatenate([cores[t] for t in around(s)])
        if len(lone) and len(others):
            for part, hit in near(lone, others):
                best = np.where(hit, out[others], n).min(axis=1)
                out[part] = np.where(best < n, best, -1)
    return out


def k_means_places(x: np.ndarray, y: np.ndarray, w: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    pick = np.full(len(x), -1)
    if not len(x):
        return pick
    square = lambda c: (x - c[0]) ** 2 + (y - c[1]) ** 2
    centres = [(x[0], y[0])]
    away = square(centres[0])
    while len(centres) < min(k, len(x)):
        best = int(away.argmax())
        centres.append((x[best], y[best]))
        away = np.minimum(away, square(centres[-1]))
    for _ in range(rounds):
        least, pick = square(centres[0]), np.zeros(len(x), int)
        for c in range(1, len(centres)):
            own = square(centres[c])
            pick[own < least] = c
            least = np.minimum(least, own)
        a, b, n = (np.bincount(pick, v, len(centres)) for v in (w * x, w * y, w))
        new = [(a[c] / n[c], b[c] / n[c]) if n[c] else centres[c] for c in range(len(centres))]
        if new == centres:
            break
        centres = new
    return pick


def dbscan(df: DataFrame, cell: str, eps: float, least: int, keys: list[str], name: str) -> DataFrame:
    """``df`` with a column of cluster numbers from 0 within each partition of ``keys``; null for noise."""
    return _grouped(df, cell, keys, name, lambda x, y, w: dbscan_places(x, y, w, eps, least))


def k_means(df: DataFrame, cell: str, k: int, keys: list[str], name: str) -> DataFrame:
    return _grouped(df, cell, keys, name, lambda x, y, w: k_means_places(x, y, w, k))
