"""Fields that follow a stream are those of all cells at once."""

import numpy as np
from pyspark.sql import functions as F

from halofield.operators import fields, spatial
from halofield.plans.analysis import Analysis
from halofield.streaming import incremental


def test_followed_fields_are_the_whole_ones(spark, tmp_path):
    rng, a = np.random.default_rng(1), Analysis(length_scale=1.0, radius=2.0, min_distance=0.05)
    rows = [(i, float(x), float(y), g, float(rng.random())) for i, (x, y) in enumerate(rng.uniform(0, 10, (60, 2))) for g in range(2)]
    schema = "cell long, x double, y double, gene int, value double"
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : (k + 1) * 40], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    incremental.follow(stream, f"{tmp_path}/out", a, f"{tmp_path}/check").awaitTermination(120)
    every = spark.createDataFrame(rows, schema)
    cells = every.select("cell", "x", "y").distinct()
    want = fields.source_field(fields.weigh(spatial.radius_join(cells, cells, a.radius), a.kernel), every.select("cell", "gene", "value"))
    get = lambda df: {(r.cell, r.gene): r.field for r in df.select("cell", "gene", F.round("field", 9).alias("field")).collect()}
    assert get(incremental.latest(spark, f"{tmp_path}/out")) == get(want)
    assert spark.read.parquet(f"{tmp_path}/out/cells").select("batch").distinct().count() == 3
