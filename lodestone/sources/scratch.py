"""The folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager, suppress
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for cut lineage; one of our own only where none is set."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


#: How tables that are kept for long are written.
DENSE = {"compression": "zstd"}
#: How postings are: a file's dictionary of chunks stays one, however short the chunks are.
POSTINGS = DENSE | {"parquet.dictionary.page.size": str(4 << 20)}
#: Bytes of compressed texts for a task that sorts their postings, some forty times as large, in memory.
TEXTS = 2 << 20
#: What Spark is set to while postings are written: tasks small enough to sort without spilling, few words in Python
#: at once, and no shuffle files left after a query has ended.
SMALL_TASKS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 * TEXTS), "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(2 * TEXTS), "spark.sql.files.maxPartitionBytes": str(TEXTS), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: What it is set to for other writes of whole tables.
NO_LEFTOVERS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, conf: Mapping[str, str]) -> Iterator[None]:
    """Settings of a session for what is run in the block, and those from before after it."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


_stored: dict[tuple[str, str], DataFrame] = {}


def stored(spark: SparkSession, name: str, make: Callable[[], DataFrame], options: Mapping[str, str] = MappingProxyType({}), conf: Mapping[str, str] = MappingProxyType({})) -> DataFrame:
    """A table that is made once for an application and name, written, and read from then on. options: of the
    writer; conf: settings while it is written."""
    app = spark.sparkContext.applicationId
    if (app, name) not in _stored:
        root = f"{shared_dir(spark)}/lodestone-stored-{app}"
        df = make()
        path = f"{root}/{len(_stored)}-{uuid.uuid4().hex[:8]}"
        with settings(df.sparkSession, conf):
            df.write.options(**options).parquet(path)
        forget_at_exit(spark, root)
        _stored[app, name] = spark.read.schema(df.schema).parquet(path)
    return _stored[app, name]


def stored_once(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again; removed when the process ends."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/lodestone-once-{spark.sparkContext.applicationId}"
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_at_exit(spark, root)
    return spark.read.schema(df.schema).parquet(path)


_roots: set[str] = set()


def forget_at_exit(spark: SparkSession, root: str) -> None:
    """Removes a folder when the process ends, also if its Spark has been stopped before."""
    if root in _roots:
        return
    _roots.add(root)
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(sc._jsc.hadoopConfiguration())

    def remove() -> None:
        with suppress(Exception):  # without a JVM nothing can be done any more
            store.delete(path, True)

    atexit.register(remove)
