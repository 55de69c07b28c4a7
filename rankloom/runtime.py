"""Session helpers: session settings, scratch tables and size checks.

Nothing here does query work.  It decides *where* intermediate tables live and
*whether* a side is small enough to broadcast; Spark does the rest.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a side may have before we stop broadcasting it.
BROADCAST_ROWS = 1_000_000
# Keys up to which a list is compared with the statistics of row groups and pages (Spark pushes it as one nested
# condition, which must not grow deep), and keys up to which it still names the buckets to open.
PUSHED_KEYS = 500
LISTED_KEYS = 8_192
ROW_GROUP_BYTES = 4 << 20

_local_scratch: dict[str, str] = {}
_buckets: WeakKeyDictionary[DataFrame, tuple[str, int]] = WeakKeyDictionary()


@dataclass
class ScratchScope:
    """A folder for the intermediate tables of one piece of work, and the catalog entries made with them."""

    folder: str
    tables: list[str] = field(default_factory=list)


_scope: ContextVar[ScratchScope | None] = ContextVar("rankloom_scratch", default=None)


def build_session(app_name: str = "rankloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed around."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, shared by every executor.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session,
    where one machine is the whole cluster, may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if configured:
        return f"{configured.rstrip('/')}/rankloom-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "Set spark.checkpoint.dir to a folder that every executor can reach."
        )
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="rankloom-")
    return _local_scratch[app]


def new_table_path(spark: SparkSession, label: str) -> str:
    scope = _scope.get()
    return f"{scope.folder if scope else scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove_table(spark: SparkSession, path: str) -> None:
    """Remove the files of a written table or of a folder of them, wherever they lie."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table_exists(spark: SparkSession, path: str) -> bool:
    """True when *path* holds a table that was written to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[ScratchScope]:
    """Intermediate tables written inside go when the block ends, also by an error.

    What the block makes is lazy and may read those tables: write or fetch it before the end.
    """
    scope = ScratchScope(new_table_path(spark, "scope"))
    token = _scope.set(scope)
    try:
        yield scope
    finally:
        _scope.reset(token)
        for table in scope.tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove_table(spark, scope.folder)


def current_scope() -> ScratchScope | None:
    return _scope.get()


@contextmanager
def writing_to(scope: ScratchScope | None) -> Iterator[None]:
    """Intermediate tables written inside belong to *scope*, None for the application's own folder."""
    token = _scope.set(scope)
    try:
        yield
    finally:
        _scope.reset(token)


def write_alone(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> tuple[str, DataFrame]:
    """Write what *build* returns, drop every table it wrote on the way, and return the path and the written rows."""
    path = new_table_path(spark, label)
    with scratch_scope(spark):
        df = build()
        schema = df.schema
        df.write.parquet(path)
    return path, spark.read.schema(schema).parquet(path)


def _new_entry() -> str:
    """A name for a table of the session's catalog, dropped with the scope it is made in."""
    name = f"rankloom_{uuid.uuid4().hex}"
    scope = _scope.get()
    if scope:
        scope.tables.append(name)
    return name


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write *df* once as a columnar table and continue from that table.

    Unlike a cache it survives the loss of executors, and unlike a checkpoint
    of rows each reader fetches only the columns it uses.
    """
    spark = df.sparkSession
    path = new_table_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def write_bucketed(df: DataFrame, path: str, bucket: str, n_buckets: int, sort: list[str],
                   row_group_bytes: int = ROW_GROUP_BYTES) -> DataFrame:
    """Write *df* hash-bucketed by a column and return it as a table.

    Joins and aggregations on that column later need no shuffle of this side.  A *df*
    already hashed by the column into as many partitions is written as it lies, one file a bucket.
    Rows are sorted within a bucket, in small row groups, so that a filter on the sorted column
    skips most of the file by its statistics.  These tables stay with their index and hold whole texts, so they are packed tightly.
    """
    spark = df.sparkSession
    table = _new_entry()
    (df.write.format("parquet").option("path", path).option("parquet.block.size", str(row_group_bytes)).option("compression", "zstd")
     .bucketBy(n_buckets, bucket).sortBy(*sort).saveAsTable(table))
    written = spark.table(table)
    _buckets[written] = (bucket, n_buckets)
    return written


def buckets_of(df: DataFrame, column: str) -> int | None:
    """The number of buckets by *column* when *df* is what :func:`write_bucketed` returned."""
    bucket, n_buckets = _buckets.get(df, (None, None))
    return n_buckets if bucket == column else None


@contextmanager
def bucketed_scans(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark reads a bucketed table by its buckets even where no join or aggregation asks for it, so that a repartition
    into these buckets needs no shuffle."""
    name = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_bucketed(spark: SparkSession, path: str, schema: str, bucket: str, n_buckets: int, sort: list[str]) -> DataFrame:
    """Open a table written by :func:`write_bucketed`, maybe in an earlier session."""
    table = _new_entry()
    spark.sql(
        f"CREATE TABLE {table} ({schema}) USING parquet "
        f"CLUSTERED BY ({bucket}) SORTED BY ({', '.join(sort)}) INTO {n_buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer takes *df* to hold; the size of its files for a plain scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """True when both are known to hold the same rows, as their optimized plans do the same to the same written tables."""
    plans = [df._jdf.queryExecution().optimizedPlan() for df in (a, b)]
    return plans[0].deterministic() and plans[0].sameResult(plans[1])


def rows_with(table: DataFrame, column: str, keys: DataFrame, limit: int = PUSHED_KEYS) -> DataFrame | None:
    """The rows of *table* whose string *column* is among the *keys* (one column), by a list in the scan's filter.

    On a bucketed column the list names the buckets to open; up to ``PUSHED_KEYS`` keys it also names the row groups
    to read.  None when there are more than *limit* keys; then a join is the better plan.  Pass written keys, as
    they are read here.
    """
    found = [r[0] for r in keys.distinct().limit(limit + 1).collect()]  # bounded by the limit
    if len(found) > limit:
        return None
    spark, threshold = table.sparkSession, "spark.sql.parquet.pushdown.inFilterThreshold"
    if int(spark.conf.get(threshold)) < PUSHED_KEYS:
        spark.conf.set(threshold, str(PUSHED_KEYS))
    # One expression as text: a list of literals would be one call into the JVM each.
    quoted = ", ".join("'" + k.replace("\\", "\\\\").replace("'", "\\'") + "'" for k in found if k is not None)
    return table.where(f"{column} IN ({quoted})") if quoted else table.where("false")


def spread_small_input(df: DataFrame) -> DataFrame:
    """Shuffle rows only when the input has fewer files than the cluster has cores.

    A large table already comes in many splits and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if len(df.inputFiles()) < cores else df


def at_most(df: DataFrame, rows: int) -> bool:
    """True when *df* has no more than *rows* rows; stops counting beyond that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; otherwise leave the join to AQE."""
    return F.broadcast(df) if at_most(df, max_rows) else df


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()
