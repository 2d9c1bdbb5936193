"""Tables that a session keeps in the shared folder."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple[str, str], tuple[str, object]] = {}
#: Seconds that each stage took to build, without the stages it needed first.
BUILT: dict[str, float] = {}
_INSIDE: list[float] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; without it, on a single machine alone, a folder of the session's own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("latchkey.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="latchkey-")
        spark.conf.set("latchkey.shared.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder and read again: cuts the lineage, survives lost executors."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _state(spark: SparkSession, paths: tuple[str, ...]) -> str:
    """What tells the files at ``paths`` from later ones: names, sizes and times."""
    out = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found = fs.globStatus(path)
        out += [f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}" for f in found or []]
    return "\n".join(out)


def kept(spark: SparkSession, name: str, build: Callable[[], DataFrame], of: tuple[str, ...] = ()) -> DataFrame:
    """The table ``name`` of this application, built and written as Parquet the first time it is asked for,
    and again when a file in ``of`` has changed."""
    key = (spark.sparkContext.applicationId, name + "\n" + _state(spark, of))
    if key not in _KEPT:
        began = time.time()
        _INSIDE.append(0.0)
        at, df = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}", build()
        df.write.parquet(at)
        took = time.time() - began
        BUILT[name.rsplit("/", 1)[-1]] = took - _INSIDE.pop()
        if _INSIDE:
            _INSIDE[-1] += took
        _KEPT[key] = (at, df.schema)
    at, schema = _KEPT[key]
    return spark.read.schema(schema).parquet(at)
