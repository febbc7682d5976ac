"""Shared scratch tables.

Long lineages are cut by writing a Parquet table under ``spark.checkpoint.dir``
(the folder that a cluster shares between the driver and all executors) and
reading it back: a lost executor then costs a re-read, never a recomputation of
a whole iterative job.  A temporary folder is made only where a local session
names no checkpoint folder, as in tests; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    root = root or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


class Workspace:
    """A folder of intermediate tables of one operator call."""

    live: list[Workspace] = []
    owner: str | None = None

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.owned_by = spark, Workspace.owner
        self.path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        Workspace.live.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return the frame that reads it back."""
        self.made += 1
        path = f"{self.path}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._gleaner_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete saved tables that nothing lazy reads any more."""
        for df in frames:
            self._delete(df._gleaner_path)

    def clear(self) -> None:
        """Delete all tables of this workspace."""
        self._delete(self.path)
        if self in Workspace.live:
            Workspace.live.remove(self)

    def _delete(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Workspaces made inside are ``owner``'s, and go when it releases them."""
    before, Workspace.owner = Workspace.owner, owner
    try:
        yield
    finally:
        Workspace.owner = before


def release(spark: SparkSession, owner: str) -> None:
    """Delete the workspaces of ``owner``, whose results were written elsewhere; no others."""
    for ws in list(Workspace.live):
        if ws.spark is spark and ws.owned_by == owner:
            ws.clear()
