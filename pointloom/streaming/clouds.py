"""Segmentation of clouds as their files arrive: one file, one cloud, no state across them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointloom.params import SegmentationParams
from pointloom.plans.segmentation import segment
from pointloom.plans.storage import written


def segment_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, schema: str, params: SegmentationParams | None = None) -> StreamingQuery:
    """Reads new Parquet files of points (cloud_id, point_id, x, y, z, ...), and writes every cloud with its labels below ``out``.

    All files there are taken, then the query ends; started again with the same checkpoint it takes the new ones only. The clouds of a batch are labelled in one
    plan. A batch's output folder is named for the batch, so that a batch run again overwrites it, and holds a folder for each cloud.
    """

    def run(batch: DataFrame, number: int) -> None:
        labelled = segment(written(batch), params).withColumn("cloud", F.col("cloud_id"))
        labelled.write.mode("overwrite").partitionBy("cloud").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
