"""What operators need of the session: the shared folder for cut lineage and size checks before a broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was measured to hold at most this many bytes.
BROADCAST_BYTES = 64 << 20
_own: dict[str, str] = {}
_written: dict[str, set[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder serves on a local master (tests); on a cluster that is an error, as no
    machine-local folder outlives an executor.
    """
    context = spark.sparkContext
    there = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = context.applicationId
    if key not in _own:
        folder = tempfile.mkdtemp(prefix="odolith-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[key] = "file://" + folder
    return _own[key]


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: lineage is cut, nothing is computed twice, and
    a lost executor costs at most a task. Column pruning and filters reach the written table."""
    spark = df.sparkSession
    path = table_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._odolith_path = path
    return out


def table_path(spark: SparkSession) -> str:
    """A new place in the shared folder, known to ``clear``."""
    path = f"{shared_folder(spark)}/odolith-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.get(spark.sparkContext.applicationId, set()).discard(path)


def release(*tables: DataFrame | None) -> None:
    """Delete tables of ``settled`` that nothing reads any more: a round's input once its output is written."""
    for t in tables:
        path = getattr(t, "_odolith_path", None)
        if path is not None:
            _delete(t.sparkSession, path)
            t._odolith_path = None


def clear(spark: SparkSession) -> None:
    """Delete all tables this application has left in the shared folder. For the end of a job or between jobs: results not
    yet written can no longer be computed afterwards."""
    for path in sorted(_written.get(spark.sparkContext.applicationId, set())):
        _delete(spark, path)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size of ``df``: exact file sizes for a written table, an upper estimate otherwise."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if a measured size allows it, else as it is (Spark then shuffles both sides)."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shipped: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once an application, for operators that run Python there."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="odolith-code-")) / f"{root.name}.zip"  # the driver serves it to the executors
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark
