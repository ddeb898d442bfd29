"""Readers. Files carry row identity in their order, so every row gets its index at ingest.

Line numbers come from a range of each file's partitions: counts of partitions are added up on the
driver (one number each), and a row's index is its partition's base plus its place inside.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import split_list
from .store import written


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """df with row numbers from 0 in the given order; a range exchange, no single task."""
    # a written table, so that the counts and the rows come from the same ranges, whatever is lost meanwhile
    placed = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    base = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return placed.join(F.broadcast(base), "_p").withColumn(out, (F.col("_b") + inside - 1).cast("long")).drop("_p", "_b")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file in its order, from 0; part files of a folder follow each other by name."""
    return numbered(placed_lines(spark, path), PLACE, "line").select("line", "value")


PLACE = ["_file", "_split", "_at"]


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and its place: file, start of the split, and a number that rises with the lines of the split."""
    text = spark.read.text(path)
    return text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"))


def read_ids(spark: SparkSession, path: str, key: str = "cell", name: str = "cell_id") -> DataFrame:
    """(key, name): the text before the first comma or tab of each line that isn't blank."""
    rows = lines(spark, path).select("line", F.trim(F.split("value", "[,\t]")[0]).alias(name)).where(F.length(name) > 0)
    out = numbered(rows, ["line"], key).select(key, name)
    if not out.take(1):
        raise ValueError(f"no ids in {path}")
    return out


def read_dense(spark: SparkSession, path: str, n_rows: int | None = None, n_columns: int | None = None) -> DataFrame:
    """(cell, v array<float>) from lines of numbers between commas, tabs or spaces; sizes are checked."""
    rows = lines(spark, path).where(F.length(F.trim("value")) > 0)
    v = F.transform(F.filter(F.split("value", "[,\t ]+"), lambda s: s != ""), lambda s: s.cast("float"))
    out = numbered(rows.select("line", v.alias("v")), ["line"], "cell").select("cell", "v")
    seen = out.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    if n_rows is not None and seen["n"] != n_rows:
        raise ValueError(f"{seen['n']} rows, not {n_rows}, in {path}")
    if n_columns is not None and (seen["lo"], seen["hi"]) != (n_columns, n_columns):
        raise ValueError(f"{seen['lo']} to {seen['hi']} columns, not {n_columns}, in {path}")
    return out


def read_matrix_market(spark: SparkSession, path: str, n_cells: int, n_genes: int, orientation: str = "auto", strict: bool = True) -> DataFrame:
    """(cell, gene, value) from a coordinate MatrixMarket file.

    Indices become 0-based; of repeated entries the last wins; symmetric storage isn't expanded. auto:
    genes x cells is recognized first, so a square file counts as genes x cells; or say `cells` or
    `genes` for what the rows are. Entries without three fields are an error, or skipped if not strict.
    """
    body = lines(spark, path).where(~F.col("value").startswith("%") & (F.length(F.trim("value")) > 0)).withColumn("f", F.split(F.trim("value"), r"\s+"))
    head = body.orderBy("line").first()
    if head is None:
        raise ValueError(f"no size line in {path}")
    rows, columns = int(head["f"][0]), int(head["f"][1])
    if orientation == "auto":
        orientation = "genes" if (rows, columns) == (n_genes, n_cells) else "cells"
    if (rows, columns) != ((n_genes, n_cells) if orientation == "genes" else (n_cells, n_genes)):
        raise ValueError(f"{rows} x {columns} doesn't fit {n_cells} cells and {n_genes} genes")
    entry = body.where(F.col("line") > head["line"])
    if strict:
        entry = entry.withColumn("f", F.when(F.size("f") != 3, F.raise_error(F.concat(F.lit("broken entry: "), F.col("value"))).cast("array<string>")).otherwise(F.col("f")))
    entry = entry.where(F.size("f") == 3).select("line", (F.col("f")[0].cast("long") - 1).alias("i"), (F.col("f")[1].cast("long") - 1).alias("j"), F.col("f")[2].cast("float").alias("value"))
    cell, gene = ("j", "i") if orientation == "genes" else ("i", "j")
    return entry.groupBy(F.col(cell).alias("cell"), F.col(gene).alias("gene")).agg(F.max_by("value", "line").alias("value"))


def read_positive_genes(spark: SparkSession, path: str, genes: list[int], threshold: float = 0.0, rows: str = "cells") -> DataFrame:
    """(cell, genes): the sorted, distinct listed genes of each cell above the threshold, from a MatrixMarket file.

    One scan: entries of other genes or below the threshold go before anything is exchanged. genes are
    0-based and few, as a panel is; rows says what the file's rows are. A cell without any is left out.
    """
    body = placed_lines(spark, path).where(~F.col("value").startswith("%") & (F.length(F.trim("value")) > 0))
    head = body.agg(F.min(F.struct(*PLACE)).alias("h")).first()["h"]
    f = F.split(F.trim("value"), r"\s+")
    size_line = (F.col("_file") == head["_file"]) & (F.col("_split") == head["_split"]) & (F.col("_at") == head["_at"])
    i, j = (f[k].cast("long") - 1 for k in (0, 1))
    cell, gene = (i, j) if rows == "cells" else (j, i)
    entries = body.where(~size_line & (F.size(f) == 3)).select(cell.alias("cell"), gene.alias("gene"), f[2].cast("float").alias("value"))
    kept = entries.where(F.col("gene").isin(list(genes)) & (F.col("value") > F.lit(threshold)))
    return kept.groupBy("cell").agg(F.array_sort(F.collect_set("gene")).alias("genes"))


def is_matrix_market(spark: SparkSession, path: str) -> bool:
    if path.endswith(".mtx"):
        return True
    # the first line of a folder is that of its first file, wherever Spark begins to read
    first = placed_lines(spark, path).agg(F.min(F.struct(*PLACE, "value")).alias("f")).first()["f"]
    return first is not None and first["value"].startswith("%%MatrixMarket")


def read_expression(spark: SparkSession, path: str, n_cells: int, n_genes: int) -> DataFrame:
    """(cell, gene, value) from either format; a dense file gives its zeros too."""
    if is_matrix_market(spark, path):
        return read_matrix_market(spark, path, n_cells, n_genes)
    return read_dense(spark, path, n_cells, n_genes).select("cell", F.posexplode("v").alias("gene", "value")).withColumn("gene", F.col("gene").cast("long"))


def read_coordinates(spark: SparkSession, path: str, n_cells: int | None = None, dims: int = 2) -> DataFrame:
    """(cell, x, y[, z]) in double, from 32-bit numbers, so that their rounding stays."""
    rows = read_dense(spark, path, n_cells)
    return rows.select("cell", *(F.get("v", F.lit(i)).cast("float").cast("double").alias(a) for i, a in enumerate("xyz"[:dims])))


def read_labels(spark: SparkSession, path: str, n: int | None = None, kind: str = "string") -> DataFrame:
    out = lines(spark, path).select(F.col("line").alias("cell"), F.trim("value").cast(kind).alias("label"))
    if n is not None and (have := out.count()) != n:
        raise ValueError(f"{have} labels, not {n}, in {path}")
    return out


def read_headed(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    """A CSV table with a header by the names in schema; a missing column is an error, others are left out."""
    have = spark.read.option("header", True).option("sep", separator).option("escape", '"').option("multiLine", True).csv(path)
    fields = [f.strip().split()[:2] for f in schema.split(",")]
    for name, _ in fields:
        if name not in have.columns:
            raise ValueError(f"missing column {name} in {path}")
    return have.select(*(F.col(f"`{n}`").cast(t).alias(n) for n, t in fields))


def read_edges(spark: SparkSession, path: str, cells: DataFrame) -> DataFrame:
    """(cluster, source, target, sender, receiver, distance) of a headed edge table, its cell ids resolved.

    cells(cell, cell_id); an id that it lacks is an error where the row is read.
    """
    from ..operators.ranking import looked_up

    e = read_headed(spark, path, "cluster int, source_gene string, target_gene string, source_cell_id string, receiver_cell_id string, distance double")
    e = looked_up(e.withColumnRenamed("source_cell_id", "cell_id"), cells.select("cell_id", F.col("cell").alias("sender")), "cell_id").drop("cell_id")
    e = looked_up(e.withColumnRenamed("receiver_cell_id", "cell_id"), cells.select("cell_id", F.col("cell").alias("receiver")), "cell_id").drop("cell_id")
    return e.select("cluster", F.col("source_gene").alias("source"), F.col("target_gene").alias("target"), "sender", "receiver", "distance")


def read_ligand_receptors(spark: SparkSession, path: str, measured: DataFrame, columns: tuple[str, str] = ("ligand", "receptor"), joiner: str = "_") -> DataFrame:
    """(ligand, receptor array) of a tab-separated list whose parts are all measured(gene), whatever their case.

    A receptor is its parts with the joiner between them; names become the measured ones, of several
    that differ in case only the smallest.
    """
    t = read_headed(spark, path, f"{columns[0]} string, {columns[1]} string", "\t").toDF("l", "r").where("l is not null and r is not null").distinct()
    names = measured.groupBy(F.lower("gene").alias("folded")).agg(F.min("gene").alias("gene"))
    parts = t.select("l", "r", F.posexplode(F.concat(F.array("l"), F.split("r", joiner))).alias("position", "part"), (F.size(F.split("r", joiner)) + 1).alias("n"))
    met = parts.join(names, F.lower(F.trim("part")) == F.col("folded"))
    whole = met.groupBy("l", "r", "n").agg(F.array_sort(F.collect_list(F.struct("position", "gene"))).alias("p")).where(F.size("p") == F.col("n"))
    return whole.select(F.col("p")[0]["gene"].alias("ligand"), F.transform(F.slice("p", F.lit(2), F.size("p")), lambda x: x["gene"]).alias("receptor")).distinct()


def read_selected_betas(spark: SparkSession, path: str) -> DataFrame:
    """(receiver_group, source, target, signed_beta) of the selected rows; of repeated keys the last line wins."""
    rows = lines(spark, path)
    head = [c.strip() for c in rows.orderBy("line").first()["value"].split(",")]
    names = {"receiver_group": "receiver_group", "source_gene": "source", "target_gene": "target", "signed_beta": "signed_beta", "selected": "selected"}
    if missing := [n for n in names if n not in head]:
        raise ValueError(f"missing column {missing[0]}")
    cells = rows.where("line > 0").select("line", *(F.trim(F.split("value", ",")[head.index(n)]).alias(o) for n, o in names.items()))
    on = cells.where(F.lower("selected").isin("true", "1"))
    key = [F.col("receiver_group").cast("int").alias("receiver_group"), "source", "target"]
    return on.groupBy(*key).agg(F.max_by(F.col("signed_beta").cast("double"), "line").alias("signed_beta"))


def relations(table: DataFrame, measured: DataFrame, separator: str = ";") -> DataFrame:
    """(ligand, receptor, databases): relations whose parts are all measured(gene); equal ones merged.

    table(database, ligand_components, receptor_components), lists in strings.
    """
    t = table.select("database", F.array_sort(F.array_distinct(split_list(F.col("ligand_components"), separator))).alias("ligand"), F.array_sort(F.array_distinct(split_list(F.col("receptor_components"), separator))).alias("receptor")).where("size(ligand) > 0 and size(receptor) > 0")
    merged = t.groupBy("ligand", "receptor").agg(F.array_sort(F.collect_set("database")).alias("databases"))
    parts = merged.select("ligand", "receptor", F.explode(F.array_distinct(F.concat("ligand", "receptor"))).alias("gene"))
    lacking = parts.join(measured.select("gene").distinct(), "gene", "left_anti").select("ligand", "receptor").distinct()
    return merged.join(lacking, ["ligand", "receptor"], "left_anti")


def paths(table: DataFrame, column: str, separator: str = " -> ") -> DataFrame:
    """table with position and node of each step of a path string; blank paths give none."""
    nodes = F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), separator), lambda s: F.trim(s)), lambda s: s != "")
    return table.select("*", F.posexplode(nodes).alias("position", "node"))


def gene_sets(spark: SparkSession, sets: dict[str, list[str]]) -> DataFrame:
    """(gene, categories): a dictionary of lists, inverted."""
    rows = [(c, g) for c, genes in sets.items() for g in genes]
    return spark.createDataFrame(rows, "category string, gene string").groupBy("gene").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def tagged(frames: list[tuple[dict[str, object], DataFrame]]) -> DataFrame:
    """All frames, each with its constant tag columns."""
    out = None
    for tags, df in frames:
        df = df.select("*", *(F.lit(v).alias(k) for k, v in tags.items()))
        out = df if out is None else out.unionByName(df)
    return out


def aligned(tables: dict[str, DataFrame], key: str = "cell") -> DataFrame:
    """All tables joined by key; a key that one of them lacks is an error."""
    items = list(tables.items())
    sizes = {n: t.count() for n, t in items}
    out = items[0][1]
    for _, t in items[1:]:
        out = out.join(t, key)
    if len({*sizes.values(), out.count()}) > 1:
        raise ValueError(f"tables don't hold the same {key}: {sizes}")
    return out


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(cell, v) from NumPy .npy files of two dimensions; a file is read by one task."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for f in frames:
            for content in f["content"]:
                m = np.load(io.BytesIO(content))
                for a in range(0, len(m), 4096):
                    yield pd.DataFrame({"cell": np.arange(a, min(a + 4096, len(m))), "v": list(m[a : a + 4096].astype(float))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "cell long, v array<double>")


def read_npz_sparse(spark: SparkSession, path: str) -> DataFrame:
    """(cell, gene, value) from a compressed sparse row matrix in an .npz file; a file is read by one task."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for f in frames:
            for content in f["content"]:
                m = np.load(io.BytesIO(content), allow_pickle=False)
                row = np.repeat(np.arange(len(m["indptr"]) - 1), np.diff(m["indptr"]))
                for a in range(0, len(row), 1 << 18):
                    s = slice(a, a + (1 << 18))
                    yield pd.DataFrame({"cell": row[s], "gene": m["indices"][s].astype("int64"), "value": m["data"][s].astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "cell long, gene long, value double")


def from_zip(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(line, value) of a text member of zip archives, its checksum verified by the unpacking."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for f in frames:
            for content in f["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    text = z.read(member).decode().splitlines()
                yield pd.DataFrame({"line": range(len(text)), "value": text})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "line long, value string")


def checked_finite(df: DataFrame, columns: list[str], positive: bool = False) -> DataFrame:
    """df; a value that is null, NaN, infinite (or negative, with positive) is an error where the row is read."""
    for c in columns:
        v = F.col(c).cast("double")
        bad: Column = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        if positive:
            bad = bad | (v < 0)
        df = df.withColumn(c, F.when(bad, F.raise_error(F.lit(f"bad value in {c}")).cast(df.schema[c].dataType)).otherwise(F.col(c)))
    return df
