"""What the operators of this subpackage share: the shared folder, sizes and packed arrays."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, as in tests, one is set where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let the session send rows to Python by some BATCH_BYTES at once, unless it has a bound of its own: Spark's is 64 MiB, for each task in the executor and again in its Python."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if bound not in spark.conf.getAll:
        spark.conf.set(bound, str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unsave(df: DataFrame) -> None:
    """Delete what save() wrote, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


def fresh(name: str, columns: list[str]) -> str:
    """name, or name with as many _ as none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a long column that keeps doc_id's order (nulls first, then texts) and is each row's own: doc_id itself, unless rows repeat one or have none."""
    strange = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not strange:
        return docs.withColumn(name, docs["doc_id"].cast("long"))
    rank = F.monotonically_increasing_id()
    return save(docs.orderBy("doc_id", "text").withColumn(name, rank), "numbered")


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate from file sizes; reads no data."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def blocks_for(df: DataFrame, target_bytes: int, least: int = 8, most: int = 1 << 20) -> int:
    """How many blocks of about target_bytes of df's files there are."""
    return int(min(most, max(least, -(-size_in_bytes(df) // target_bytes))))


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64's finaliser on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def trim() -> None:
    """Give memory that Python and Arrow have freed back to the machine: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run):
    """A mapInArrow function that trims its worker when its partition ends."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped
