"""Session helpers shared by the whole library."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and make sure that a checkpoint folder exists.

    The checkpoint folder is the one the cluster names in ``spark.checkpoint.dir``; a folder of our own is set only
    where none is named (a single-machine session, as in tests).
    """
    sc = spark.sparkContext
    paths = sc.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, paths) if p)
        # Workers are reused: let them give batches' memory back to the system.
        sc.environment.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
        sc.environment.setdefault("MALLOC_ARENA_MAX", "2")
        sc.environment.setdefault("MALLOC_TRIM_THRESHOLD_", "1048576")
        if not sc.master.startswith("local"):  # executors elsewhere don't have this folder
            sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "bitextile"), "zip", ROOT, "bitextile"))
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "/tmp/bitextile-checkpoints")
    return spark


_tables: list[tuple[object, str]] = []


def _remove(context, path: str) -> None:
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Delete the tables that materialize() has written: what was read from them must be done."""
    while _tables:
        context, path = _tables.pop()
        try:
            _remove(context, path)
        except Exception:  # noqa: BLE001  the session has ended: the cluster's cleaning is left
            break


atexit.register(release)


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table under the shared checkpoint folder and read it again.

    This cuts the lineage: a lost executor costs no more than the tasks that read from it. Files live in the folder of
    ``spark.checkpoint.dir`` and so outlast executors; release(), called at the driver's end too, removes them.
    """
    spark = df.sparkSession
    prepare(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{base}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append((spark.sparkContext, path))
    return spark.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, removed with the tables."""
    prepare(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    _tables.append((spark.sparkContext, path))
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
