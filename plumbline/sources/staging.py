"""Tables written once to the folder that the whole cluster shares.

A staged table cuts lineage the way ``checkpoint()`` does, but columnar: later
reads prune columns, and a lost executor costs only a re-read.  The folder is
the session's ``spark.checkpoint.dir``; only a local master without that
setting gets a temporary folder of its own.  What a run has not dropped goes when
the driver ends, since results are read from it until then.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Shuffle files of a staged table go once it is written; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return _own[app]


class Workspace:
    """Staged tables of one operator run; ``drop`` frees those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/plumbline-{name}-{uuid.uuid4().hex}"
        self._n = 0
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def stage(self, df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
        """``df`` as a table; ``rows`` bounds the Arrow batches that its Python functions take while it is written."""
        path = self.path(label)
        conf = self.spark.conf
        held, before = int(conf.get(ARROW_ROWS)), conf.get(CLEANUP, "false")
        bound = rows is not None and (held <= 0 or held > rows)
        if bound:
            conf.set(ARROW_ROWS, rows)
        conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.set(CLEANUP, before)
            if bound:
                conf.set(ARROW_ROWS, held)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._staged_at)
            path.getFileSystem(conf).delete(path, True)
