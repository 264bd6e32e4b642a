"""Session settings and the checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}
_WRITTEN: dict[tuple, str] = {}
# Open writes and the setting they found, so that writes of several threads restore it once.
_OPEN: dict[str, tuple[int, str | None]] = {}
_OPEN_LOCK = threading.Lock()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "pagelattice", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; anything in ``conf`` wins."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        # Call-site capture costs several JVM calls per column expression.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own that goes when the program ends; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="pagelattice-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries planned inside drop their shuffle files when they end; otherwise those stay until the driver happens to collect garbage."""
    app = spark.sparkContext.applicationId
    with _OPEN_LOCK:
        n, before = _OPEN.get(app) or (0, spark.conf.get(_CLEANUP, None))
        _OPEN[app] = n + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _OPEN_LOCK:
            n, before = _OPEN.pop(app)
            if n > 1:
                _OPEN[app] = n - 1, before
            elif before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder; survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    with shuffles_end(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def write_rows(df: DataFrame, path: str, **options: str) -> None:
    """Writes Parquet; the shuffle files of the write go with its end."""
    with shuffles_end(df.sparkSession):
        df.write.options(**options).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back, so that joins are planned with their true size."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    write_rows(df, path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _state(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of the tables in a folder, so that changed inputs are noticed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in path.getFileSystem(conf).listStatus(path))


def written_path(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> str:
    """Where the table ``make`` plans is written, once per application and state of the input folder ``key[0]``."""
    full = (spark.sparkContext.applicationId, *key, _state(spark, str(key[0])))
    if full not in _WRITTEN:
        path = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        # Most bytes are hexadecimal ids, which the default codec leaves as they are.
        write_rows(make(), path, compression="zstd")
        _WRITTEN[full] = path
    return _WRITTEN[full]


def written(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``make`` plans, written once to the shared folder and read back.

    Later steps read the Parquet files, so they prune columns, push filters down and do
    not repeat the work behind the table.
    """
    return spark.read.parquet(written_path(spark, key, make))
