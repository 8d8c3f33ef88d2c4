"""What several operators share: the shared folder, staged tables, words, unsigned hashes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of bytes other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of rows that go to a Python worker at once, at most (Spark's default is 64 MB, which JVM and worker hold several times).
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's ``spark.sql.execution.arrow.maxBytesPerBatch`` to ``BATCH_BYTES``, so that memory does not depend on how long texts are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.sub(r"\D", "", spark.conf.get(name, None) or "0") or 0)
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Hand the memory that a task has freed back to the system; Python workers live on after a task."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where none is set and Spark runs in one process (tests) a local one is made and set."""
    bound_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table; nothing that reads it may run after."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: The folder, by application, that tables are staged in when it is not the application's own.
_FOLDER: dict[str, str] = {}
#: Folders whose users have returned; their tables are read until the result is written.
_LEFT: dict[str, str] = {}


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_FOLDER.get(spark.sparkContext.applicationId) or _home(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def own_folder(spark: SparkSession, *read: DataFrame) -> Iterator[None]:
    """What is staged inside stands in a new folder. That of the use before is deleted first, unless one of the frames ``read`` reads from it."""
    app = spark.sparkContext.applicationId
    before = _LEFT.pop(app, None)
    if before and not any(before in file for df in read for file in df.inputFiles()):
        discard(spark, before)
    outside, _FOLDER[app] = _FOLDER.get(app), f"{_home(spark)}/stage-{uuid.uuid4().hex}"
    try:
        yield
    finally:
        _LEFT[app] = _FOLDER.pop(app)
        if outside:
            _FOLDER[app] = outside


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the application's folder, outside any stage's, and read back."""
    path = f"{_home(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that are broadcast at most.
MAX_BROADCAST = 1 << 20


def sized(df: DataFrame) -> DataFrame:
    """A staged frame of slim rows, to be broadcast if they are few."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 5, is 0; rows with a null id are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def packed(df: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` and beside them ``row``, a struct of all columns of ``df``: no extra column can clash, and ``row.*`` gives them back."""
    return df.select(*columns, F.struct("*").alias("row"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
