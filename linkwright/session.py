"""What a session needs: the library's sources on executors, and tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_HOME = Path(__file__).resolve().parent
_shipped: set[str] = set()
_made: list[str] = []
#: Rows of an Arrow batch, where the session has Spark's default of 10,000: with long texts that many fill a worker.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Prepare a session, once per application: smaller Arrow batches, and the package's sources for the executors.

    Sources are not sent where PYTHONPATH already leads workers to them. Their
    archive stands in the shared folder, as executors that join later fetch it too.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size, "10000") == "10000":
        spark.conf.set(size, str(BATCH_ROWS))
    if str(_HOME.parent) in map(os.path.realpath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return
    with tempfile.TemporaryDirectory() as folder:
        archive = f"{folder}/{_HOME.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(_HOME.rglob("*.py")):
                z.write(f, f.relative_to(_HOME.parent))
        hadoop = spark._jvm.org.apache.hadoop.fs
        shared = hadoop.Path(scratch_path(spark, _HOME.name) + ".zip")
        shared.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(hadoop.Path(archive), shared)
        spark.sparkContext.addPyFile(shared.toString())


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    It is set here only for a local master that names none (tests); a cluster
    without the setting is an error, because a machine-local folder would not
    be seen by other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="linkwright-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under <spark.checkpoint.dir>/linkwright/<application id>/.

    The folder of an application may be removed as soon as it has ended.
    """
    return f"{scratch_root(spark)}/linkwright/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage; unlike a cached block the files outlive executors.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(schema).parquet(path)


def at_once(*jobs: Callable) -> list:
    """What the jobs return, run at a time: cores that one job's last tasks leave idle serve the others."""
    own = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(own(job)) for job in jobs]]


def made_since(n: int = 0) -> list[str]:
    """Paths of the tables that `materialize` has written, from the n-th on."""
    return _made[n:]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables in the shared folder that nothing reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
