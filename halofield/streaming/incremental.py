"""Fields kept up to date while cells arrive: only receivers near a new cell are computed again.

Cells and fields are folders of batches, one written whole for each micro-batch under its number, so a
batch that runs again writes the same folder. Of several fields of a cell the latest batch counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import fields, spatial
from ..plans.analysis import Analysis


def affected(new: DataFrame, cells: DataFrame, radius: float, dims: int = 2) -> DataFrame:
    """The new cells and the cells within the radius of one."""
    near = spatial.radius_join(cells, new, radius, dims).select(F.col("receiver").alias("cell"))
    return near.union(new.select("cell")).distinct()


def fields_of(receivers: DataFrame, cells: DataFrame, expression: DataFrame, a: Analysis) -> DataFrame:
    """(cell, gene, field) of the receivers only."""
    wanted = cells.join(receivers, "cell", "left_semi")
    e = fields.weigh(spatial.radius_join(wanted, cells, a.radius, a.dims), a.kernel)
    return fields.source_field(e, expression)


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The current field of every cell that has one: all genes of its latest batch."""
    every = spark.read.parquet(f"{folder}/fields")
    last = every.groupBy("cell").agg(F.max("batch").alias("batch"))
    return every.join(last, ["cell", "batch"]).where("gene is not null").drop("batch")


def follow(stream: DataFrame, folder: str, a: Analysis, checkpoint: str) -> StreamingQuery:
    """Start a query over a stream of (cell, x, y[, z], gene, value) rows, each cell within one batch."""
    axes = spatial.AXES[: a.dims]

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/cells/batch={number}")
        rows = spark.read.parquet(f"{folder}/cells").where(F.col("batch") <= number)
        cells = rows.select("cell", *axes).distinct()
        new = rows.where(F.col("batch") == number).select("cell", *axes).distinct()
        receivers = affected(new, cells, a.radius, a.dims)
        made = fields_of(receivers, cells, rows.select("cell", "gene", "value"), a)
        # a receiver without any sender gets one row without a gene, so that its older fields don't count
        whole = receivers.join(made, "cell", "left")
        whole.write.mode("overwrite").parquet(f"{folder}/fields/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
