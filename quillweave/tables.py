"""Tables in the folder that driver and executors share: written to cut lineage, or as a query's working space."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a query go when it has ended; else they stay until a JVM happens to collect its frames.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: What workers on this machine import the package from.
ROOT = str(Path(__file__).resolve().parents[1])


#: Bytes of an Arrow batch.
BATCH = 4 << 20


def ship(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package; on a cluster it is installed or sent by --py-files.

    Rows hold whole texts and pages, so that the session's Arrow batches are bounded by bytes too.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.fullmatch(r"(\d+)([kmgtp]?)(?:i?b)?", spark.conf.get(name).strip().lower())
    if held is None or int(held[1]) << 10 * " kmgtp".index(held[2] or " ") > BATCH:
        spark.conf.set(name, str(BATCH))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir.

    Where that is unset it is set: on one machine, as in tests, to a temporary folder that goes when Python ends, on a
    cluster to one in the warehouse, which its machines share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] == "local":
            base = tempfile.mkdtemp(prefix="quillweave-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        else:
            base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quillweave/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet and reads it again; what was shuffled for it is freed."""
    with setting(df.sparkSession, CLEAN, "true"):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that no frame in use reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


#: Schemes of Spark that pyarrow knows by other names.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def located(uri: str) -> str:
    """A folder's uri as pyarrow takes it; folders of a mounted store are files of the machine."""
    scheme, _, rest = uri.partition(":")
    if scheme == "dbfs":
        return "/dbfs/" + rest.lstrip("/")
    if scheme == "file":
        return "/" + rest.lstrip("/")
    return f"{SCHEMES.get(scheme, scheme)}:{rest}" if rest.startswith("//") else os.path.abspath(uri)


def filesystem(uri: str):
    """(file system, path) for a folder that executors share: local, mounted, s3, gs, abfs, or hdfs and viewfs.

    The last two need libhdfs and CLASSPATH on every worker, as pyarrow documents.
    """
    from pyarrow import fs

    where = located(uri)
    return fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)
