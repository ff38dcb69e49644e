"""What the corpus operators share: the shared folder, written tables and connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null document id: it sorts after every real id.
NULL_ID = 2**63 - 1

#: Folder of the written tables within the shared one.
TABLES = "tessera-tables"

#: Rows of a batch that a task's Python takes at once: texts, and what is made of them, are several times as large there as in Arrow.
PIECE_ROWS = 512

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent (single-machine tests) a temporary folder stands in."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError(f"spark.checkpoint.dir isn't set: executors of {master} share no temporary folder")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tessera-"))
    return f"file://{_own_dir[0]}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage like ``checkpoint()``: a lost executor costs a re-read, not a recomputation. The
    columnar files are several times smaller than a checkpoint's serialised rows. The table goes when the
    application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{TABLES}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batches: Iterable[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """``batches`` in slices of ``rows`` rows at most, so that neither what is made of a batch nor what is sent back for it is held whole."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def drop(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that nothing reads any more, and let Spark remove shuffle files without a user."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"/{TABLES}/" in path:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    free(spark)


def free(spark: SparkSession) -> None:
    """Shuffle files go when nothing on the driver refers to them: collect its garbage now instead of some time."""
    for _ in range(2):  # the listeners of the last query hold it for a moment
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    ``edges`` has two long columns, in any order and with repeats. Alternates large-star and
    small-star steps; each round's edge list is a written table. Every step is a partially
    aggregated minimum joined back on the node, so that a hub's edges may be split among tasks.
    No edge list ever reaches the driver, only its count and checksum."""
    a, b = edges.columns[:2]
    directed = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    current = materialize(directed)
    state = _fingerprint(current)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        current = materialize(small)
        before, state = state, _fingerprint(current)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
