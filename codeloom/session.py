"""Session helpers: building a session for tests/bench, the shared checkpoint folder
and size-checked broadcasting."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, NumericType, StringType, StructType

# Largest side, in bytes, that we broadcast.  Above it the caller's shuffle (or salted)
# join is used instead.
DEFAULT_BROADCAST_BYTES = 8 << 20
BATCH_ROWS = 2000          # of an Arrow batch that a Python worker holds
BATCH_BYTES = 8 << 20


def build_session(master: str | None = None, app: str = "codeloom",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Local session with AQE on and the UI off (tests, bench, examples)."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "16g")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the platform and only read here.  When it is unset
    under a local master (tests) a fresh scratch folder is created and registered; under
    any other master a folder of the driver's disk would not be shared, so it is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="codeloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/codeloom/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing(spark: SparkSession):
    """What ``materialize`` writes inside is deleted at the end: for work whose results are all written by then."""
    paths: list[str] = []
    token = _passing.set(paths)
    try:
        yield
    finally:
        _passing.reset(token)
        for path in paths:
            remove(spark, path)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back."""
    path = scratch(df.sparkSession, name)
    if (paths := _passing.get()) is not None:
        paths.append(path)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """Approximate size of a row: the bytes of its strings, binaries and arrays, 16 for
    any other value and for the row itself."""
    total = F.lit(16 * (1 + len(df.columns)))
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, NumericType):
            total = total + F.coalesce(F.size(c), F.lit(0)) * 8
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return total


def checked_broadcast(df: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, bool]:
    """Broadcast-hint ``df`` only if its rows have at most ``max_bytes`` bytes together.

    The check is an aggregate over ``df``, which is therefore run twice: pass a written
    table (``materialize``) or something as cheap.  Returns ``(df, hinted)``; an unhinted
    side is joined by a shuffle (salted where the caller expects hot keys).  It asks for a merge
    join, as Spark goes by the size of files otherwise, and a written table of few distinct values
    takes a hundredth of its rows' bytes."""
    most = DEFAULT_BROADCAST_BYTES if max_bytes is None else max_bytes
    size = df.agg(F.sum(row_bytes(df))).first()[0] or 0
    if size <= most:
        return F.broadcast(df), True
    return df.hint("merge"), False


SALTS = 32


def spread_join(large: DataFrame, few: DataFrame, hinted: bool, on: list[str], by: Column, salts: int = SALTS) -> DataFrame:
    """Join on keys of which one may hold most rows of ``large``.  ``few`` is as ``checked_broadcast``
    returned it; unhinted, each of its rows is repeated per salt, and a key of ``large`` is spread over
    ``salts`` tasks by the hash of ``by``."""
    if hinted:
        return large.join(few, on)
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return large.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts))).join(salted.hint("merge"), [*on, "_salt"]).drop("_salt")


def limit_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes from now on in this session, so
    that what a Python worker holds does not depend on the length of texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@contextmanager
def small_splits(spark: SparkSession, most: int, files: int = 16):
    """Scans that run inside take at most ``most`` bytes of files, and at most ``files`` small ones, to a task: for
    packed rows that become many."""
    keys = {"spark.sql.files.maxPartitionBytes": str(most), "spark.sql.files.openCostInBytes": str(most // files)}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition when the input has fewer partitions than the cluster
    has task slots (a few large row groups feeding CPU-heavy per-row work).  A no-op
    for inputs that already span the cluster, so it never reshuffles a large scan."""
    # Only the layout depends on the partition count; the rows are the same either way.
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots)
    return df
