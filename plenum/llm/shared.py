"""Folders that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_own: dict[str, str] = {}
_shipped: set[str] = set()
_passing: list[list[str]] = []


def mapped(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """`df.mapInArrow(run, schema)`; the first time in an application, this package is sent to the executors."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="plenum-package-")) / "plenum.zip"
        with zipfile.ZipFile(path, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)
    return df.mapInArrow(run, schema)


def shared_root(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; only where that is unset and Spark runs in one process (tests) a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="plenum-shared-")
    return _own[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/plenum/{name}-{uuid.uuid4().hex}"


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that `written` makes inside are removed at the end, but for those it is told to keep: what comes out must not read the others."""
    own: list[str] = []
    _passing.append(own)
    try:
        yield
    finally:
        _passing.pop()
        for path in own:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str, compression: str = "zstd", keep: bool = False) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, and kept when executors are lost. With `keep` it outlives `passing`."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    if _passing and not keep:
        _passing[-1].append(path)
    return spark.read.schema(T.StructType.fromJson(df.schema.jsonValue())).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
