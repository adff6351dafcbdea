"""What the operators of this subpackage share: batch plumbing and the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Rows and bytes that an Arrow batch for a Python worker holds at most (one row may be larger).
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch holds, so that workers need memory for a batch and not for a partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What Python workers keep between tasks, by the operator that keeps it.
WORKER_CACHES: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """An operator's memory in this worker process."""
    return WORKER_CACHES.setdefault(owner, {})


def _drop_others(owner: str | None) -> None:
    """Free what other operators keep here, and hand the memory back."""
    others = [c for name, c in WORKER_CACHES.items() if name != owner and c]
    for cache in others:
        cache.clear()
    if others:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # another C library: it keeps the memory for later
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, rows: int = BATCH_ROWS, cache: str | None = None) -> DataFrame:
    """mapInArrow with bounded batches (pass fewer `rows` where each is large; `cache`: the operator whose worker_cache fn uses). fn finds columns by place: names may hold dots or differ in case only."""
    small_batches(df.sparkSession, rows)

    def task(batches):
        _drop_others(cache)
        yield from fn(batches)

    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(task, schema)


def extended(schema: StructType, *added: tuple[str, str]) -> StructType:
    """A schema of the same fields and (name, DDL type) ones behind them."""
    return StructType([*schema.fields, *(StructField(name, _parse_datatype_string(kind)) for name, kind in added)])


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, one of our own, in local mode only."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidelog-")
    return _own_dirs[context.applicationId]


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tidelog-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clean(spark: SparkSession) -> None:
    """Delete all that this process has written to the shared folder. DataFrames that came of it can't be read any more."""
    while _made:
        remove(spark, _made.pop())


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a compressed table in the shared folder and read back: its lineage is cut and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, by exact name, whatever others there are (also ones that differ in case only)."""
    columns = df.columns
    missing = [n for n in names if n not in columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {columns}")
    numbered = df.toDF(*(f"c{i}" for i in range(len(columns))))
    return numbered.select(*(F.col(f"c{columns.index(n)}").alias(n) for n in names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key of more than a MOST_HOT-th of the rows is hot; so there are fewer than MOST_HOT hot keys, whatever the data.
MOST_HOT = 10_000


def join_split(rows: DataFrame, found: DataFrame, key: str, n: str, total: int, value: str) -> DataFrame:
    """rows with `value` of the row of `found` (key, n, value; a row a key, n of the `rows` each) that has their key, else null.

    Hot keys, fewer than MOST_HOT, come by broadcast and their rows stay where they are as long as there is no other key to join;
    in the shuffle for all others they are dealt evenly. So no task gets more than its share of rows, however many of them have one key.
    """
    hot = found.where(F.col(n) > F.lit(total / MOST_HOT)).select(F.col(key).alias("hot_key"), F.col(value).alias("hot_value"))
    cold = found.where(F.col(n) <= F.lit(total / MOST_HOT)).select(F.col(key).alias("cold_key"), F.col(value).alias("cold_value"))
    near = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    # a key that no row of `found` has, another for each row
    spread = F.when(F.col("hot_key").isNull(), F.col(key)).otherwise(F.concat(F.lit(b"\0"), F.monotonically_increasing_id().cast("string").cast("binary")))
    both = near.withColumn("join_key", spread).join(cold, F.col("join_key") == F.col("cold_key"), "left")
    return both.select(*rows.columns, F.coalesce("hot_value", "cold_value").alias(value))
