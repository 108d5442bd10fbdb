"""Tables that cut a lineage: written to the folder in spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or getattr(spark, "_strandline_scratch", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
        root = spark._strandline_scratch = "file://" + tempfile.mkdtemp(prefix="strandline-")
    path = f"{root.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)  # the session's end deletes it
    return spark.read.schema(df.schema).parquet(path)
