"""Session factory and shared-storage helpers.

Nothing here assumes a local file system: intermediate tables go to the folder that the session names in
``spark.checkpoint.dir``, which every executor shares. Only where that setting is absent and the master is local
(tests, a laptop) is a temporary folder made.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch for Python (Spark's default is 64 MB, which each task holds in the JVM and in its worker).
_BATCH_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Paths of the tables of the open scopes, innermost last.
_scopes: contextvars.ContextVar[tuple[set[str], ...]] = contextvars.ContextVar("scopes", default=())


def build_session(name: str = "textaxis", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ANSI SQL, UTC, AQE and skew-join handling on; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(name).config(map=settings)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, else, with a local master, one of our own.

    On a cluster without that setting it raises: a folder of the driver's machine can't be shared.
    """
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="textaxis-")
        sc.setCheckpointDir(known)
    return known.rstrip("/")


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str, codec: str = "snappy", by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    ``codec`` is Parquet's; tables of text or ids are worth a denser one than the default. ``by``: columns whose values have a
    folder each. The shuffles of the write
    are freed as soon as it ends, and its Python functions get batches of ``BATCH_BYTES``; the files go with the innermost ``scratch`` scope, at the latest with the driver's JVM.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target, fs = _path(spark, path)
    fs.deleteOnExit(target)
    if scopes := _scopes.get():
        scopes[-1].add(path)
    before = {_FREE_SHUFFLES: spark.conf.get(_FREE_SHUFFLES, "false"), _BATCH_BYTES: spark.conf.get(_BATCH_BYTES)}
    spark.conf.set(_FREE_SHUFFLES, "true")
    spark.conf.set(_BATCH_BYTES, BATCH_BYTES)
    try:
        df.write.option("compression", codec).parquet(path, partitionBy=by)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no later step reads."""
    for table in tables:
        path = table._scratch_path
        target, fs = _path(table.sparkSession, path)
        fs.delete(target, True)
        for scope in _scopes.get():
            scope.discard(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope whose materialized tables are deleted when it ends, also on an error.

    It yields ``keep``: a table passed to it outlives the scope and belongs to the enclosing one, if there is one.
    """
    own: set[str] = set()
    outer = _scopes.get()
    token = _scopes.set((*outer, own))

    def keep(table: DataFrame) -> DataFrame:
        own.discard(table._scratch_path)
        if outer:
            outer[-1].add(table._scratch_path)
        return table

    try:
        yield keep
    finally:
        _scopes.reset(token)
        for path in own:
            target, fs = _path(spark, path)
            fs.delete(target, True)
