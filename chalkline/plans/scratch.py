"""Tables written once and read again, in the folder that the cluster shares, and their removal."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

ROWS_A_FILE = 250_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """The paths that stored() has written since the workspace was opened."""

    def __init__(self) -> None:
        self.paths: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        """Hands a stored frame on to the workspace around this one, or to the caller, who may call dropped()."""
        self.paths.discard(df._chalkline_path)
        if outer := _OUTER[self]:
            outer.paths.add(df._chalkline_path)
        return df


_CURRENT: ContextVar[Workspace | None] = ContextVar("workspace", default=None)
_OUTER: dict[Workspace, Workspace | None] = {}
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a local session (driver and executors in one process, as in tests) gets one temporary folder for the
    whole process; on a cluster that is an error, since other machines could not read it.
    """
    if top := spark.conf.get("spark.checkpoint.dir", None):
        return top
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="chalkline-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def stored(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """df, written to the shared folder and read again: computed once, and no lineage that a lost executor could break.

    rows: about how many narrow rows df has, if known; so many files are written as these need. The shuffles of the write
    go with it, instead of when the driver happens to collect garbage; the session's setting is put back.
    """
    df = df if rows is None else df.coalesce(1 + rows // ROWS_A_FILE)
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if here := _CURRENT.get():
        here.paths.add(path)
    conf = df.sparkSession.conf
    was = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, was) if was is not None else conf.unset(CLEANUP)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._chalkline_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dropped(df: DataFrame) -> None:
    """Deletes what stored() has written for df; no frame may depend on it any more."""
    if here := _CURRENT.get():
        here.paths.discard(df._chalkline_path)
    delete(df.sparkSession, df._chalkline_path)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Workspace]:
    """Deletes, at its end, what stored() has written inside it and nothing else: for a caller that has its results elsewhere."""
    here = Workspace()
    _OUTER[here] = _CURRENT.get()
    token = _CURRENT.set(here)
    try:
        yield here
    finally:
        _CURRENT.reset(token)
        del _OUTER[here]
        for path in here.paths:
            delete(spark, path)
