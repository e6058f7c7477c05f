"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from barloom.sources import files

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Spark's own setting for dropping the shuffle files of a query at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Scratch paths handed out inside the innermost open scope of this thread; None where no scope is open.
_OPEN: ContextVar[list[str] | None] = ContextVar("open_scratch", default=None)


def get_session(app_name: str = "barloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans are written for.

    All of them are Spark defaults or safe on any cluster; the operators also run on a session made
    elsewhere. ``conf`` keys use ``__`` for dots.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a machine-local folder: on a cluster other machines could
    not read it.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set(CHECKPOINT_CONF, root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if (handed_out := _OPEN.get()) is not None:
        handed_out.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch folders handed out inside it when it ends, also when it ends in an error.

    For work whose results are stored before it returns: frames that still read a scratch folder must not leave the
    scope. Scopes nest, each removing its own folders, and hold for the thread that opened them; folders made by other
    threads, such as a stream's batches, stay.
    """
    token = _OPEN.set([])
    try:
        yield
    finally:
        paths = _OPEN.get()
        _OPEN.reset(token)
        for path in paths:
            files.remove(spark, path)


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Unlike a cached frame the written table survives the loss of executors, is read with column
    pruning, and carries a size Spark can plan joins with.

    The shuffle files behind it go with the write. Nothing reads them any more, but they would stay until the driver
    happens to collect its garbage, and a query of many steps would hold those of all its steps at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
