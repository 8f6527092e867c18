"""Compiles small Java kernels with the Janino compiler that Spark bundles, and hands them to executors.

A kernel is Java source kept in this repository. It is compiled once per session on the driver, packed
into a jar, and registered with ``ADD JAR``: the driver serves the jar to every executor, and again to an
executor that replaces a lost one. Nothing has to be installed on the cluster.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_jars: dict[tuple[str, str], str] = {}
_registered: set[tuple[str, str, str]] = set()


def _session_key(spark: SparkSession) -> str:
    return f"{spark.sparkContext.applicationId}/{id(spark.sparkContext)}"


def _unit(folder: Path, package: str) -> str:
    """One compilation unit of all files in ``folder``; imports are merged, package lines are dropped."""
    imports: dict[str, None] = {}
    bodies = []
    for file in sorted(folder.glob("*.java")):
        body = []
        for line in file.read_text().splitlines():
            if re.match(r"\s*import\s", line):
                imports[line.strip()] = None
            elif not re.match(r"\s*package\s", line):
                body.append(line)
        bodies.append("\n".join(body))
    return "\n".join([f"package {package};", *imports, *bodies])


def load(spark: SparkSession, folder: Path, package: str) -> None:
    """Compiles the Java files of ``folder`` as ``package`` and adds them to the session; a repeat does nothing."""
    key = (_session_key(spark), package)
    if key in _jars:
        return
    unit = _unit(folder, package)
    jvm = spark.sparkContext._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(spark._jsparkSession.sharedState().jarClassLoader())
    compiler.cook(unit)
    digest = hashlib.sha256(unit.encode()).hexdigest()[:16]
    path = os.path.join(tempfile.mkdtemp(prefix="kernels"), f"{package}-{digest}.jar")
    path = os.path.realpath(path)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as jar:
        for entry in compiler.getBytecodes().entrySet():
            jar.writestr(entry.getKey().replace(".", "/") + ".class", bytes(entry.getValue()))
    spark._jsparkSession.sharedState().jarClassLoader().addURL(jvm.java.io.File(path).toURI().toURL())
    spark.sparkContext._jsc.addJar(path)
    _jars[key] = path


def instance(spark: SparkSession, name: str, /, **conf):
    """A new kernel object of class ``name``; keyword arguments reach its ``put`` method."""
    loader = spark._jsparkSession.sharedState().jarClassLoader()
    gateway = spark.sparkContext._gateway
    made = loader.loadClass(name).getDeclaredConstructor(
        gateway.new_array(gateway.jvm.java.lang.Class, 0)
    ).newInstance(gateway.new_array(gateway.jvm.java.lang.Object, 0))
    for k, v in conf.items():
        made.put(k, v)
    return made


def _java_type(spark: SparkSession, kind: T.DataType | str):
    if isinstance(kind, str):
        kind = T._parse_datatype_string(kind)
    return spark._jsparkSession.parseDataType(kind.json())


def register(spark: SparkSession, sql_name: str, class_name: str, returns: str, /, **conf) -> None:
    """Registers a kernel that implements one of Spark's Java UDF interfaces as SQL function ``sql_name``."""
    key = (_session_key(spark), f"{id(spark)}:{sql_name}", repr((class_name, returns, sorted(conf.items(), key=str))))
    if key not in _registered:
        made = instance(spark, class_name, **conf)
        spark._jsparkSession.udf().register(sql_name, made, _java_type(spark, returns))
        _registered.add(key)


def call(sql_name: str, *cols: Column | str) -> Column:
    return F.call_udf(sql_name, *cols)


def map_partitions(df: DataFrame, class_name: str, schema: str, /, **conf) -> DataFrame:
    """``df`` through a kernel that implements ``MapPartitionsFunction`` over rows."""
    spark = df.sparkSession
    encoder = spark.sparkContext._jvm.org.apache.spark.sql.Encoders.row(_java_type(spark, schema))
    return DataFrame(df._jdf.mapPartitions(instance(spark, class_name, **conf), encoder), spark)
