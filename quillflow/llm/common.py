"""Helpers that the text operators share: shared-folder tables, Arrow text access, exact prefix sums."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillflow.session import ship_package

#: A word: a longest run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a table that one Arrow batch carries; documents can be long, so rows alone don't bound it.
BATCH_BYTES = 4 << 20


def arrow_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Lets Arrow batches carry about `size` bytes at most, which bounds a worker's memory, and ships this package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    ship_package(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in a session without one (tests), a new local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._own_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by `written` or `bucketed`, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._own_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if name := getattr(table, "_own_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def bucketed(df: DataFrame, key: str, least: int = 1) -> DataFrame:
    """One row of df for each value of a key, as a table in the shared folder that is bucketed and sorted by it.

    Joins on the key don't shuffle it. It has as many buckets as shuffles have partitions, and `least` at least.
    """
    spark = df.sparkSession
    name, parts = f"quillflow_{uuid.uuid4().hex}", max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    writer = df.repartition(parts, key).dropDuplicates([key]).write.bucketBy(parts, key).sortBy(key).format("parquet")
    path = shared_path(spark, "bucketed")
    writer.option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._own_path, out._own_table = path, name
    return out


def own_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column of a batch; nulls become empty texts."""
    return pc.fill_null(batch.column(column), "")


def raw_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the n + 1 offsets of the texts in them."""
    array = array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    values = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(array: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, and for each word the number of its text."""
    lists = pc.ascii_split_whitespace(array)
    flat = lists.flatten()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    parent = np.repeat(np.arange(len(array), dtype=np.int64), lengths)
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), parent[full.to_numpy(zero_copy_only=False)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix): every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def labelled_ids(labels: DataFrame, condition, rows: int) -> np.ndarray:
    """At most `rows` ids of the labels that meet a condition, by a fixed hash order; sorted."""
    key = F.crc32(F.col("doc_id").cast("string"))
    picked = labels.where(condition & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    found = picked.orderBy(key, "doc_id").limit(rows).toPandas()["doc_id"].to_numpy(np.int64)
    return np.sort(found)


def running_total(df: DataFrame, part: str, order: str, value: str, out: str) -> DataFrame:
    """Adds the exclusive running sum of `value` in (part, order) order.

    Each part is a range of the order that one task sums; the parts' totals, one row each, are
    summed first. Nothing but that small table meets in one task.
    """
    totals = df.groupBy(part).agg(F.sum(value).alias("_sum"))
    base = totals.select(part, (F.sum("_sum").over(Window.orderBy(part)) - F.col("_sum")).alias("_base"))
    within = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(base, part).withColumn(out, F.col("_base") + F.col("_in")).drop("_base", "_in")
