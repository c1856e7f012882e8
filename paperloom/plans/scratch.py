"""Cutting lineage through tables written to the shared checkpoint folder.

Iterative operators write what the next round needs and read it back, so a
lost executor costs one round at most.  The folder is ``spark.checkpoint.dir``.
Only where that is unset and Spark runs in this process (tests) is a temporary
folder used; on a cluster a machine-local folder would lose data, so that is
an error.

A result may read its run's tables as long as the session lives, so they are
deleted when the driver ends; operators drop sooner what no result reads.
``sweep`` removes what failed drivers left behind.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_ROOTS: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, root in _ROOTS:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, root)
        except Exception:  # noqa: BLE001 - the JVM is gone; sweep() will find the folder
            pass


def sweep(spark: SparkSession, hours: float = 48.0) -> int:
    """Deletes the runs in the shared folder that were not changed for so long; returns their number."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/paperloom")
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(top):
        return 0
    old = [s.getPath() for s in files.listStatus(top) if s.getModificationTime() < (time.time() - 3600 * hours) * 1000]
    for path in old:
        files.delete(path, True)
    return len(old)


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="paperloom-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


class Scratch:
    """Tables of one run of an operator, each under its own name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/paperloom/{uuid.uuid4().hex}"
        _ROOTS.append((spark, self.root))
        self._n = 0

    def put(self, df: DataFrame) -> DataFrame:
        """``df`` written and read again."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path  # type: ignore[attr-defined]
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                _delete(self.spark, path)
