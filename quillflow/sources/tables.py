"""Parquet tables of a folder, and the ledger entities that stand on them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Status code, name, display order; X has no rows, so that counts are zero-filled.
STATUSES = (("F", "FINISHED", 1), ("O", "OPEN", 2), ("P", "PENDING", 3), ("X", "EXCLUDED", 4))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_or_empty(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    """A table of the folder, or an empty one of the schema where there is none yet."""
    try:
        return table(spark, sf_dir, name)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True, content: bool = False) -> DataFrame:
    """Files below a folder by name pattern: path, modification time, length and, if wanted, content."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(folder)
    return found if content else found.drop("content")


def json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Nested documents, one JSON object a file or a line array."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def statuses(spark: SparkSession) -> DataFrame:
    """The status dimension."""
    return spark.createDataFrame(list(STATUSES), "status string, status_name string, display_order int")


def batch_of(date: Column) -> Column:
    """A batch name that sorts as its month."""
    return F.concat(F.lit("B_"), F.date_format(date, "yyyyMM"))


def trackers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Life-cycle facts: id, buyer, status, batch, excluded flag (null means false), created time, amount."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("buyer"),
        F.col("o_orderstatus").alias("status"),
        batch_of(F.col("o_orderdate")).alias("batch"),
        F.when(F.col("o_orderpriority").startswith("5"), True).alias("excluded"),
        F.col("o_orderdate").alias("created"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("priority"),
    )


def stage_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First time per user of each stage: created, loaded, posted, completed."""
    stages = {"created": "signup", "loaded": "view", "posted": "click", "completed": "purchase"}
    firsts = [F.min(F.when(F.col("event_type") == kind, F.col("ts"))).alias(name) for name, kind in stages.items()]
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*firsts)


def profile(df: DataFrame) -> DataFrame:
    """(col, position, type, n_values, least, most) of each column: the catalogue's names and types, and one aggregate."""
    stats = F.array(*(
        F.struct(F.lit(c).alias("col"), F.lit(k).alias("position"), F.lit(t).alias("type"), F.count(c).alias("n_values"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("most"))
        for k, (c, t) in enumerate(df.dtypes, 1)
    ))
    return df.agg(stats.alias("s")).select(F.inline("s"))
