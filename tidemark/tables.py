"""Tables that a plan writes once and goes on from, in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only on a single machine (a local master, as in tests) may it be unset: a temporary folder then takes its place for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share; the master is {master}")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables saved in this process and not deleted yet, with the thread that saved them; oldest first.
_SAVED: list[tuple[int, SparkSession, str]] = []


def _mine() -> list[tuple[int, SparkSession, str]]:
    return [x for x in _SAVED if x[0] == threading.get_ident()]


def save(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df once and goes on from there: a lost executor costs no more than a read. See release()."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    _SAVED.append((threading.get_ident(), spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved = path
    return out


def drop_saved(*frames: DataFrame) -> None:
    """Deletes saved tables that nothing lazy reads any more."""
    for df in frames:
        if path := getattr(df, "_saved", None):
            _forget({path})
            remove(df.sparkSession, path)


def _forget(paths: set[str]) -> None:
    _SAVED[:] = [x for x in _SAVED if x[2] not in paths]


def saved_count() -> int:
    return len(_mine())


def release(since: int = 0, *keep: DataFrame) -> None:
    """Deletes what this thread saved after so many tables, but for keep: to be called when the results that read it have been consumed. It happens anyway when the process ends."""
    stay = {getattr(df, "_saved", None) for df in keep}
    gone = [x for x in _mine()[since:] if x[2] not in stay]
    _forget({x[2] for x in gone})
    for _, spark, path in gone:
        remove(spark, path)


@contextlib.contextmanager
def scope(*keep: DataFrame):
    """What is saved within goes when the block ends: results are to be consumed, or written, in it."""
    mark = saved_count()
    try:
        yield
    finally:
        release(mark, *keep)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone first
        for _, spark, path in _SAVED:
            remove(spark, path)
