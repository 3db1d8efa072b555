"""Session defaults and the one place that decides where lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE)."""
    builder = (
        SparkSession.builder.master(master)
        .appName("geoweft")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    In local mode, as in tests, a temporary folder of this machine is set for
    the session where none is named. A cluster must name one: on it, every
    executor would write to a disk of its own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="geoweft-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: The folders made inside the innermost open temporary() of this thread or task.
_temporary: ContextVar[list[str] | None] = ContextVar("temporary", default=None)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the folders that staged() makes inside, but for those it is told to keep.

    For intermediate tables that a stored result has used up; nothing lazy over
    them may leave. What other threads stage meanwhile stays.
    """
    folders: list[str] = []
    outer = _temporary.set(folders)
    try:
        yield
    finally:
        _temporary.reset(outer)
        for path in folders:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def staged(df: DataFrame, name: str, keep: bool = False, **options: object) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    Cuts lineage so that a lost executor costs a re-read, and lets several
    later jobs use what one expensive pass made. The folder belongs to the
    session's shared directory and is cleared with it, or by temporary().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not keep and (folders := _temporary.get()) is not None:
        folders.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.parquet(path)


def counted(df: DataFrame, name: str, **options: object) -> tuple[DataFrame, int]:
    """staged(), and the number of rows, which the files' footers tell."""
    done = staged(df, name, **options)
    return done, done.count()


def gathered(df: DataFrame, rows: int, each: int) -> DataFrame:
    """df, of at most so many rows, in partitions of about ``each`` where these are fewer than a shuffle makes.

    A small table is written by few tasks into few files, however many
    partitions the session's shuffles have.
    """
    parts = -(-rows // each)
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(1, parts)) if parts < most else df


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
