"""Relations that several plans read: written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where the session has none and runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that executors share")
    return "file://" + tempfile.mkdtemp(prefix="tessera-stored-")


def stored(df: DataFrame, by: str) -> DataFrame:
    """``df`` as a Parquet table whose files hold ranges of ``by``, in order, so that a reader of few values skips the others.

    The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.repartitionByRange(by).sortWithinPartitions(by).write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
