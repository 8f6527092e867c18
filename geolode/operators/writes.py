"""Seven ways to write a DataFrame to a table, each a staged result and one publishing step, with a checked outcome.

The new content is computed as one DataFrame, written to a staging table, and swapped in. Until the swap nothing has happened to the
target; what fails before rolls back by dropping the stage. A failure within the swap is reported as an unknown outcome with a way to recover.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolode import contract, ewkb
from geolode.errors import EngineError, from_spark
from geolode.operators.losses import LossReport, compare
from geolode.plans import model as m
from geolode.plans import validate
from geolode.plans.lower import INDEX, quoted
from geolode.shared import release, stored
from geolode.sources.catalog import full_name

EXAMPLES = 10
SIDES = ("xmin", "ymin", "xmax", "ymax")


@dataclass
class Outcome:
    """committed, rolled_back, partially_committed or unknown; counts that are not known stay None."""

    status: str
    received: int
    confirmed: int | None = 0
    inserted: int | None = None
    updated: int | None = None
    deleted: int | None = None
    failed: int = 0
    skipped: int = 0
    recovery: dict | None = None
    retry: str = "never"

    def checked(self) -> Outcome:
        known = [x for x in (self.inserted, self.updated, self.deleted) if x is not None]
        rules = (
            self.status in ("committed", "rolled_back", "partially_committed", "unknown"),
            (self.recovery is not None) == (self.status in ("partially_committed", "unknown")),
            self.status != "unknown" or self.retry in ("never", "requires_recovery"),
            self.status not in ("rolled_back", "unknown") or not self.confirmed,
            (self.confirmed or 0) + self.failed + self.skipped <= self.received,
            sum(known) <= (self.confirmed or 0),
        )
        if not all(rules):
            raise EngineError("internal", "an outcome at odds with itself", "finalize", "unknown", "requires_recovery")
        return self


@dataclass
class Prepared:
    operation: m.Write
    source: DataFrame
    report: LossReport
    token: str
    target: str
    exists: bool


@dataclass
class Diagnostics:
    """Rows that a target would refuse: how many, and the places of the first few in the input, from 0."""

    total: int = 0
    rejected: int = 0
    examples: list[dict] = field(default_factory=list)


def prepare(spark: SparkSession, op: m.Write, source: DataFrame, profile: validate.Profile | str = "open", evolve: bool = False) -> Prepared:
    validate.write(op, profile=profile)
    contract.check_schema(source.schema)
    target = full_name(op.target)
    exists = spark.catalog.tableExists(target)
    if op.mode == "create" and exists:
        raise EngineError("conflict", "the target exists", "prepare")
    if op.mode not in ("create", "replace") and not exists:
        raise EngineError("not_found", "no such target", "prepare")
    known = spark.table(target).schema if exists and op.mode not in ("create", "replace") else None
    report = compare(source.schema, known, op.mode, op.keys, op.update_columns, op.srid_policy, evolve)
    report.enforce(op.mapping_policy)
    return Prepared(op, source, report, contract.fingerprint(known) if known else "", target, exists)


def _refused(category: str, message: str, rows: Diagnostics | None) -> EngineError:
    """An error that says which rows the target refused."""
    error = EngineError(category, message, "write", "rolled_back")
    error.diagnostics = rows
    return error


def _key_rules(rows: DataFrame, keys: tuple[str, ...], source: DataFrame) -> None:
    bad = rows.filter(" OR ".join(f"{quoted(k)} IS NULL" for k in keys)).limit(1).count()
    if bad:
        raise _refused("data_mapping", "a key is null", diagnose(source, {k: f"{quoted(k)} IS NOT NULL" for k in keys}))
    if rows.groupBy(*[F.col(quoted(k)) for k in keys]).count().filter("count > 1").limit(1).count():
        raise EngineError("conflict", "a key stands twice in the input", "write", "rolled_back")


def _shaped(rows: DataFrame, like: DataFrame, evolve: bool) -> DataFrame:
    """The rows with the target's columns, in its order and types; columns that the input lacks are null."""
    have = set(rows.columns)
    cols = [(F.col(quoted(f.name)) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields]
    if evolve:
        cols += [F.col(quoted(c)) for c in rows.columns if c not in like.columns]
    return rows.select(*cols)


def _content(op: m.Write, rows: DataFrame, target: DataFrame | None, evolve: bool) -> tuple[DataFrame, dict]:
    """The table's content after the write, and a count query for each kind of change."""
    if op.mode in ("create", "replace"):
        return rows, {"inserted": rows}
    if op.mode == "truncate_insert":
        return _shaped(rows, target, evolve), {"inserted": rows}
    if op.mode == "append":
        return target.unionByName(_shaped(rows, target, evolve), allowMissingColumns=evolve), {"inserted": rows}
    keys = list(op.keys)
    if op.mode == "delete_by_keys":
        own = rows.select(*map(quoted, keys))
        return target.join(own, keys, "left_anti"), {"deleted": target.join(own, keys, "left_semi")}
    changed = op.update_columns or tuple(c for c in rows.columns if c not in keys)
    base = target
    if evolve:
        for c in changed:
            if c not in base.columns:
                base = base.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
    own = rows.select(*map(quoted, keys), *[F.col(quoted(c)).alias(f"__new_{c}") for c in changed], F.lit(True).alias("__hit"))
    both = base.join(own, keys, "left")
    merged = both.select(*[(F.when(F.col("__hit"), F.col(quoted(f"__new_{c}"))).otherwise(F.col(quoted(c))).cast(base.schema[c].dataType) if c in changed else F.col(quoted(c))).alias(c) for c in base.columns])
    hits = rows.join(target.select(*map(quoted, keys)).distinct(), keys, "left_semi")
    if op.mode == "update":
        return merged, {"updated": hits}
    fresh = rows.join(target.select(*map(quoted, keys)), keys, "left_anti")
    return merged.unionByName(_shaped(fresh, base, False)), {"updated": hits, "inserted": fresh}


def indexed(df: DataFrame) -> list[str]:
    """Geometries beside which an indexed write has put the columns of their boxes."""
    return [f.name for f in df.schema.fields if contract.is_spatial(f) and all(f"{f.name}_{k}" in df.columns and df.schema[f"{f.name}_{k}"].metadata.get(INDEX) == f.name for k in SIDES)]


def boxed(df: DataFrame) -> DataFrame:
    """Bounding-box columns beside each geometry, rows ordered by the place of its box: what a spatial index is to files."""
    from geolode.functions import spatial

    own = [f.name for f in df.schema.fields if contract.is_spatial(f)]
    for c in own:
        box = spatial.call(df.sparkSession, "bbox", F.col(quoted(c)))
        df = df.withColumn("__b", box).withColumns({f"{c}_{k}": F.col(f"__b.{k}") for k in SIDES}).drop("__b")
        for k in SIDES:
            df = df.withMetadata(f"{c}_{k}", {INDEX: c})
    if not own:
        raise EngineError("schema", "a spatial index without a geometry", "prepare")
    return df.repartitionByRange(F.col(quoted(f"{own[0]}_xmin")), F.col(quoted(f"{own[0]}_ymin"))).sortWithinPartitions(f"{own[0]}_xmin", f"{own[0]}_ymin")


def write(spark: SparkSession, p: Prepared, evolve: bool = False, fault: Callable[[str], None] | None = None, form: str = "parquet") -> Outcome:
    """Runs a prepared write. ``fault`` is called at "staged", "before_publish", "publishing" and "published", for tests."""
    op, hook = p.operation, fault or (lambda _: None)
    target = spark.table(p.target) if p.exists else None
    if p.token and contract.fingerprint(target.schema) != p.token:
        raise EngineError("conflict", "the target changed since the write was prepared", "write", "rolled_back", "safe")
    stage = f"{p.target.rsplit('`', 2)[0]}`__geolode_{uuid.uuid4().hex}`"
    rows = None
    try:
        rows = stored(p.source)
        for f in p.source.schema.fields:
            if f.metadata:
                rows = rows.withMetadata(f.name, f.metadata)
        received = rows.count()
        index = op.create_spatial_index or (target is not None and op.mode not in ("create", "replace") and bool(indexed(target)))
        if op.keys:
            _key_rules(rows, op.keys, p.source)
        check_cells(rows)
        content, counted = _content(op, rows, target, evolve)
        if target is not None and op.mode not in ("create", "replace"):
            for f in target.schema.fields:
                if not f.nullable and content.filter(F.col(quoted(f.name)).isNull()).limit(1).count():
                    broken = diagnose(p.source, {f.name: f"{quoted(f.name)} IS NOT NULL"}) if f.name in rows.columns else None
                    raise _refused("data_mapping", f"{f.name}: a null where the target takes none", broken)
                if f.metadata:
                    content = content.withMetadata(f.name, f.metadata)
        counts = {k: v.count() for k, v in counted.items()}
        if op.mode == "append" and not evolve and not index:
            hook("staged")
            hook("before_publish")
            _shaped(rows, target, False).write.insertInto(p.target)
            hook("published")
        else:
            (boxed(content) if index else content).write.format(form).saveAsTable(stage)
            hook("staged")
            hook("before_publish")
            _swap(spark, stage, p.target, p.exists, hook)
    except EngineError as e:
        _drop(spark, stage)
        if e.effect == "unknown":
            return Outcome("unknown", received, 0, recovery={"stage": stage, "target": p.target, "step": e.message}, retry="requires_recovery").checked()
        raise
    except Exception as e:
        _drop(spark, stage)
        error = from_spark(e, "write")
        raise EngineError(error.category, error.message, "write", "rolled_back", "safe") from e
    finally:
        if rows is not None:
            release(rows)
    confirmed = sum(counts.values()) if op.mode != "delete_by_keys" else min(received, counts["deleted"])
    counts = {k: min(v, confirmed) for k, v in counts.items()}
    return Outcome("committed", received, min(confirmed, received), **counts, skipped=received - min(confirmed, received)).checked()


def _drop(spark: SparkSession, stage: str) -> None:
    with contextlib.suppress(Exception):
        spark.sql(f"DROP TABLE IF EXISTS {stage}")


def _swap(spark: SparkSession, stage: str, target: str, exists: bool, hook: Callable[[str], None]) -> None:
    """The old table is kept under another name until the new one stands in its place."""
    old = stage[:-1] + "_old`"
    try:
        if exists:
            spark.sql(f"ALTER TABLE {target} RENAME TO {old}")
    except Exception as e:
        raise EngineError("execution", "the target could not be set aside", "commit", "rolled_back", "safe") from e
    try:
        hook("publishing")
        spark.sql(f"ALTER TABLE {stage} RENAME TO {target}")
        hook("published")
    except Exception as e:
        try:
            if exists and not spark.catalog.tableExists(target):
                spark.sql(f"ALTER TABLE {old} RENAME TO {target}")
            elif not exists and spark.catalog.tableExists(target):
                raise RuntimeError from e
        except Exception as again:
            raise EngineError("execution", f"publishing broke off; the former content is {old}" if exists else "publishing broke off", "commit", "unknown", "requires_recovery") from again
        if spark.catalog.tableExists(old):
            raise EngineError("execution", f"publishing broke off after the swap; the former content is {old}", "commit", "unknown", "requires_recovery") from e
        raise EngineError("execution", "publishing failed", "commit", "rolled_back", "safe") from e
    _drop(spark, old)
    spark.catalog.refreshTable(target.replace("`", ""))


def check_cells(rows: DataFrame) -> None:
    """Every geometry's header against its field's contract: dimensions, type and SRID."""
    own = [(f.name, contract.keys(f)) for f in rows.schema.fields if contract.keys(f)]
    if not own:
        return
    names = [n for n, _ in own]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for (name, c), column in zip(own, batch.columns, strict=True):
                for cell in column:
                    if (value := cell.as_py()) is None:
                        continue
                    found = ewkb.inspect(value)
                    types = c.get("types", "").split(",") if c["types_declaration"] == "exact" else []
                    if c["dimensions"] not in ("unknown", found.dimensions) or (types and found.geometry_type not in types):
                        raise EngineError("data_mapping", f"{name}: a geometry at odds with its contract", "write")
                    if "srid" in c and found.srid is not None and str(found.srid) != c["srid"]:
                        raise EngineError("crs", f"{name}: a geometry of another SRID", "write")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    try:
        rows.select(*map(quoted, names)).mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
    except Exception as e:
        category = "crs" if "another SRID" in str(e) else "data_mapping"
        raise EngineError(category, "a geometry at odds with its contract", "write", "rolled_back") from e


def diagnose(source: DataFrame, rules: dict[str, str], examples: int = EXAMPLES) -> Diagnostics:
    """Rows that break a rule (name: SQL condition that must not be false or null), by their place in the input.

    Places are partition offsets from one count per partition, plus the place within it; no row leaves its partition to be numbered.
    """
    numbered = source.withColumn("__at", F.monotonically_increasing_id())
    counts = {r.p: r.n for r in numbered.groupBy(F.shiftright("__at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    start, offsets = 0, {}
    for p in sorted(counts):
        offsets[p] = start
        start += counts[p]
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    bad = numbered.withColumn("__rules", broken).filter(F.size("__rules") > 0)
    first = bad.select("__at", "__rules").orderBy("__at").limit(examples).collect()
    shown = [{"source_row_zero_based": offsets[r["__at"] >> 33] + (r["__at"] & (1 << 33) - 1), "rules": list(r["__rules"]), "cause": "database.constraint_violation"} for r in first]
    return Diagnostics(start, bad.count() if first else 0, shown)
