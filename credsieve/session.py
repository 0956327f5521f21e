"""Session helpers."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "credsieve", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tuned for; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# The intermediate folders of the scratch blocks a task of the driver is in, the innermost last; below them those made
# outside any block. Each thread and each block has its own list, so none removes what another made.
_OUTSIDE: list[str] = []
_BLOCKS: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scratch", default=())


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared one the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent (a local run) a temporary folder takes its place. Intermediate
    folders stay until the end of the ``scratch`` block they were made in, or else until ``release``.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="credsieve-")
    path = f"{root.rstrip('/')}/credsieve-{uuid.uuid4().hex}"
    blocks = _BLOCKS.get()
    (blocks[-1] if blocks else _OUTSIDE).append(path)
    return path


def _remove(spark: SparkSession, made: list[str]) -> None:
    while made:
        path = spark._jvm.org.apache.hadoop.fs.Path(made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Remove the intermediate folders that were made outside of ``scratch`` blocks."""
    _remove(spark, _OUTSIDE)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Removes what this thread writes for intermediate use inside the block; write results before its end."""
    made: list[str] = []
    before = _BLOCKS.set((*_BLOCKS.get(), made))
    try:
        yield
    finally:
        _BLOCKS.reset(before)
        _remove(spark, made)


def materialize(frame: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back.

    Used where several results need one expensive input: it is computed once, its lineage ends, and
    it survives the loss of executors.
    """
    path = shared_dir(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
