"""Running bounded streams: everything there is, in micro-batches, to tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import checkpoint_dir


def file_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table's files as a stream; the path is a pattern, as a table may be one file or a folder of them."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{name}.parque[t]")


def shared_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"


def to_table(stream: DataFrame, mode: str, key: list[str] | None = None) -> DataFrame:
    """Runs the stream over all that is there and reads back what it wrote.

    append: all batches; update: of each ``key`` the row of the last batch that has it, so state that the watermark has
    closed can be dropped; complete: the last batch. Each batch owns a folder and overwrites it when it is run again, so a
    lost driver or executor leaves no double rows."""
    spark = stream.sparkSession
    folder = shared_folder(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={0 if mode == 'complete' else batch_id}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(f"{folder}/out/batch=*")
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    rest = [c for c in stream.columns if c not in key]
    rows = spark.read.schema(schema).parquet(f"{folder}/out")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")
