"""Depth of regions that arrive in a stream: exact, since the depths of batches of distinct regions add up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.plans.commands import depth_by_root, merged_roots
from strandline.plans.model import Annotation
from strandline.session import shared_folder


def depth_sink(found: Annotation, regions: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Writes each batch's depth table, with the place of each id's first line, under ``path``/batch=N. A batch that runs again replaces its own table, so none counts twice."""

    def each(batch: DataFrame, number: int) -> None:
        merged_roots(depth_by_root(found, batch), "depth").write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = regions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def depth_so_far(tables: DataFrame) -> DataFrame:
    """One table of the batches' tables: the sequence of the first line, the widest bounds, the sum of depths."""
    return merged_roots(tables, "depth").drop("first")


def replayed_depth(found: Annotation, regions: DataFrame, files: int = 3) -> DataFrame:
    """The depth of stored regions by way of the stream: they are written as ``files`` files, a batch each. ``found`` should be a saved index."""
    spark = regions.sparkSession
    root = f"{shared_folder(spark)}/depth-{uuid.uuid4().hex}"
    regions.repartition(files).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(regions.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    query = depth_sink(found, stream, f"{root}/out", f"{root}/state", available_now=True)
    query.awaitTermination()
    return depth_so_far(spark.read.parquet(f"{root}/out"))
