"""What jobs share beyond a plan: tables in the shared folder, and this package's code on Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch on its way to a Python worker, so that long texts do not add up to large batches.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one, but only with a
    local master, whose executors have the driver's disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallysheaf-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to Python workers, once a context, as --py-files would, and bound Arrow batches by bytes."""
    if spark.conf.get(BATCH_SETTING) == "67108864b":  # the default; a setting of the session's own stays
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_tallysheaf_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tallysheaf-zip-"), "tallysheaf_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for x in names:
                if x.endswith(".py"):
                    full = os.path.join(d, x)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._tallysheaf_shipped = True
