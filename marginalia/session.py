"""Session helpers: builder, shared work folder, durable lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "marginalia", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session with adaptive execution; what spark-submit, its arguments or the defaults file set wins over these.

    Without a master from there it is local, with ``cores`` and ``shuffle_partitions``; on a cluster the number of
    shuffle partitions is left to its settings.
    """
    os.environ.setdefault("SPARK_DRIVER_MEMORY", "8g")  # weaker than any other setting of it
    SparkContext._ensure_initialized()
    known = SparkConf()
    builder = SparkSession.builder
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ or known.get("spark.master", "local[*]") != "local[*]"
    wanted = {"spark.app.name": app, "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    if not submitted:
        builder = builder.master(f"local[{cores}]")
    if not submitted or known.get("spark.master", "").startswith("local"):
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for name, value in wanted.items():
        if not known.contains(name) or not submitted and name in ("spark.app.name", "spark.ui.showConsoleProgress"):
            builder = builder.config(name, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local master without that setting (tests) gets a temporary folder; a cluster without it is an error,
    because a machine-local folder would be lost with its machine.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.marginalia.localDir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="marginalia-")
    spark.conf.set("spark.marginalia.localDir", made)
    return made


_WRITTEN: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a lineage cut that outlives executors.

    The table goes with ``written_tables`` or ``drop_written``, at the latest when the driver ends. What was shuffled to
    make it goes at once: otherwise it stays until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _WRITTEN.append(path)
    where, system = _file_system(spark, path)
    system.deleteOnExit(where)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_table(table: DataFrame) -> None:
    """Delete one table that ``materialize`` gave, once nothing is left to be computed from it."""
    where, system = _file_system(table.sparkSession, table._written)
    system.delete(where, True)
    _WRITTEN.remove(table._written)


def drop_written(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables this driver wrote by ``materialize``, once no result that reads them is needed; how many."""
    n = 0
    while len(_WRITTEN) > since:
        where, system = _file_system(spark, _WRITTEN.pop())
        n += bool(system.delete(where, True))
    return n


@contextmanager
def written_tables(spark: SparkSession) -> Iterator[None]:
    """Run and store a query inside: the tables it wrote on the way are deleted at the end."""
    since = len(_WRITTEN)
    try:
        yield
    finally:
        drop_written(spark, since)


def bounded_rows(df: DataFrame, max_rows: int, what: str) -> list:
    """Collect metadata of a stated bound; more rows than that are an error, not a cut."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows; this must not go to the driver")
    return rows


def broadcast_if_small(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only after counting at most so many rows and bytes; beyond that the planner chooses."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(8 * len(df.columns)))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df
