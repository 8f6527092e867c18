"""Tables that an operator writes and reads again, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}
_scratch: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset (tests, local runs), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _roots:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        _roots[app] = "file://" + tempfile.mkdtemp(prefix="geolode-")
        spark.sparkContext.setCheckpointDir(_roots[app])
    return _roots[app]


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, keep: bool = True) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/geolode-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if keep:
        atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _scratch:
        _scratch[-1].append(out)
    return out


def release(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote for ``df``, once nothing reads it any more."""
    if path := getattr(df, "_stored_at", None):
        _remove(df.sparkSession, path)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """What ``stored`` writes within is deleted at the end, so no result may read it; a result that is handed out is stored within by ``kept``."""
    _scratch.append([])
    try:
        yield
    finally:
        for df in _scratch.pop():
            release(df)


def kept(df: DataFrame) -> DataFrame:
    """``stored``, but it outlives the innermost ``scratch``."""
    out = stored(df)
    if _scratch:
        _scratch[-1].pop()
        if len(_scratch) > 1:
            _scratch[-2].append(out)
    return out
