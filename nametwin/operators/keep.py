"""Intermediates that are read more than once."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)
_told: set[str] = set()

_files: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # where settled frames lie
_scope: ContextVar[list[Callable[[], object]] | None] = ContextVar("kept", default=None)
_local: list[tempfile.TemporaryDirectory] = []  # removed when the process ends


def shared_folder(spark: SparkSession) -> str | None:
    """The folder of spark.checkpoint.dir, or the one the context checkpoints to; in a
    local session without either a temporary one.

    None on a cluster that names no folder: a machine's own disk is not shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        _tell(f"intermediates are written to {named}")
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        _tell("no spark.checkpoint.dir: intermediates are persisted, lost ones are computed again")
        return None
    _tell("no spark.checkpoint.dir: a local session writes intermediates to a temporary folder")
    if not _local:
        _local.append(tempfile.TemporaryDirectory(prefix="nametwin-", ignore_cleanup_errors=True))
    return _local[0].name


def _tell(mode: str) -> None:
    if mode not in _told:
        _told.add(mode)
        log.info(mode)


def scratch_folder(spark: SparkSession) -> str:
    """A fresh path that driver and executors share."""
    shared = shared_folder(spark)
    if shared is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{shared}/nametwin-{uuid.uuid4().hex}"


def use_checkpoint_folder(spark: SparkSession) -> None:
    """Let iterative fits cut their lineage in the shared folder, if there is one."""
    shared = shared_folder(spark)
    if shared and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)


def _on_release(action: Callable[[], object]) -> None:
    scope = _scope.get()
    if scope is not None:
        scope.append(action)


def keep(frame: DataFrame) -> DataFrame:
    """Persist a frame; it spills to disk, and lost blocks are computed again."""
    kept = frame.persist(StorageLevel.MEMORY_AND_DISK)
    _on_release(kept.unpersist)
    return kept


def settle(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Losing executors then loses none of the work, later plans start at a file
    scan with known sizes, and each reader fetches only the columns it needs.
    Without a shared folder the frame is persisted instead.
    """
    spark = frame.sparkSession
    if shared_folder(spark) is None:
        return keep(frame)
    path = scratch_folder(spark)
    frame.write.parquet(path)
    _on_release(lambda: _delete(spark, path))
    settled = spark.read.schema(frame.schema).parquet(path)
    _files[settled] = path
    return settled


def release(*frames: DataFrame) -> None:
    """Drop settled or kept frames that nothing will read again.

    What was made from them must itself be settled, or be done with.
    """
    for frame in frames:
        path = _files.pop(frame, None)
        if path is None:
            frame.unpersist()
        else:
            _delete(frame.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def releasing() -> Iterator[None]:
    """Drop on exit whatever was kept or settled inside, as a long-running stream must."""
    scope: list[Callable[[], object]] = []
    token = _scope.set(scope)
    try:
        yield
    finally:
        _scope.reset(token)
        for action in scope:
            action()
