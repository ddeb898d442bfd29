"""Writers: text formats of matrices and lists, tables, metadata, checkpoints."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_matrix(df: DataFrame, path: str, decimals: int = 7, once: bool = False) -> None:
    """df(cell, v) as comma-separated lines in the order of cells; the part files are ranges. once: keep what is there."""
    line = F.array_join(F.transform("v", lambda x: F.format_string(f"%.{decimals}f", x.cast("double"))), ",")
    ordered = df.repartitionByRange("cell").sortWithinPartitions("cell").select(line.alias("value"))
    ordered.write.mode("ignore" if once else "overwrite").text(path)


def write_ids(df: DataFrame, path: str, key: str | list, name: str) -> None:
    order = key if isinstance(key, list) else [key]
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(name).alias("value")).write.mode("overwrite").text(path)


def write_matrix_market(df: DataFrame, path: str, n_rows: int, n_columns: int) -> None:
    """df(cell, gene, value) as a coordinate file in parts; the header is the first line of the first part."""
    n = df.count()
    head = df.sparkSession.createDataFrame([(-2, f"%%MatrixMarket matrix coordinate real general\n{n_rows} {n_columns} {n}")], "cell long, value string").withColumn("gene", F.lit(0).cast("long"))
    body = df.select(F.col("cell").cast("long").alias("cell"), F.concat_ws(" ", F.col("cell") + 1, F.col("gene") + 1, F.col("value").cast("string")).alias("value"), F.col("gene").cast("long").alias("gene"))
    head.unionByName(body).repartitionByRange("cell", "gene").sortWithinPartitions("cell", "gene").select("value").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, decimals: dict[str, int] | None = None, form: str = "parquet", by: list[str] | None = None) -> None:
    """A result table; columns in `decimals` are rounded; csv is quoted and headed."""
    for c, d in (decimals or {}).items():
        df = df.withColumn(c, F.round(c, d))
    w = df.write.mode("overwrite")
    if by:
        w = w.partitionBy(*by)
    (w.option("header", True).option("escape", '"') if form == "csv" else w).format(form).save(path)


def write_edges(kept: DataFrame, summary: DataFrame, path: str, by: str = "receiver_group") -> None:
    """Edges as a table partitioned by group, so that one group is read without the others, and their summary beside it."""
    write_table(kept, f"{path}/edges", by=[by])
    write_table(summary, f"{path}/summary")


def write_bytes(path: str, content: bytes) -> None:
    """A small file from the driver, in any store that Arrow opens."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(at, compression=None) as out:
        out.write(content)


def write_metadata(spark: SparkSession, path: str, values: dict) -> None:
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=False).first()["value"])


def save_checkpoint(spark: SparkSession, path: str, tables: dict[str, DataFrame], metadata: dict) -> None:
    """A model directory: a Parquet table for each name and metadata.json, written last."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    write_metadata(spark, f"{path}/metadata.json", metadata | {"tables": sorted(tables)})


def load_checkpoint(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    metadata = read_metadata(spark, f"{path}/metadata.json")
    return {n: spark.read.parquet(f"{path}/{n}") for n in metadata["tables"]}, metadata


def same_ids(a: DataFrame, b: DataFrame) -> bool:
    """Whether two (index, id) tables hold the same rows."""
    return not a.exceptAll(b).take(1) and not b.exceptAll(a).take(1)
