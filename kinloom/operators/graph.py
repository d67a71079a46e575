"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is a grouped minimum and a join, so a node with very many neighbours is split by partial aggregation and by
adaptive skew joins; nothing is gathered in one place.  The edges shrink to stars whose centres are the least nodes.  Each
round is written to the shared checkpoint folder, so lost executors cost at most one round.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir.

    Where that is unset a temporary folder is set, but only if driver and executors are one process; else it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="kinloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: a cut of the lineage that outlives executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """The table with the hint that a join with it sorts both sides.

    Tables of many equal values are small as files and large in memory, and a broadcast that is decided by the size of files
    goes through the driver whole.
    """
    return df.hint("merge")


def discard(*spent: DataFrame) -> None:
    """Deletes tables that materialised() wrote, once nothing that is still to be computed reads them."""
    for df in spent:
        spark = df.sparkSession
        root = (spark.conf.get("spark.checkpoint.dir", None) or "").rstrip("/")
        name = root.partition("://")[2] if "://" in root else root
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            # Only folders that shared_folder() named, right below the root.
            if name and folder.rpartition("/")[0].endswith(name.rstrip("/")) and len(folder.rpartition("/")[2]) == 32:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) of distinct nodes, in one direction each; gives the edges after one star operation."""
    # from each centre to its neighbours: both directions for the large star, from the larger node for the small one
    down = edges.select(F.greatest("u", "v").alias("c"), F.least("u", "v").alias("n"))
    out = down.unionByName(down.select(F.col("n").alias("c"), F.col("c").alias("n"))) if large else down
    least = out.groupBy("c").agg(F.min("n").alias("m")).withColumn("m", F.least("m", "c"))
    joined = out.join(unsent(least), "c")
    if large:
        moved = joined.where("n > c").select(F.col("n").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where("n <> m").select(F.col("n").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: each leaf u has one centre, and no centre is a leaf."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("leaf")))
    leaves = ends.groupBy("node").agg(F.sum("leaf").alias("centres"), F.min("leaf").alias("leaf"))
    return leaves.where("centres > 1 or centres = 1 and leaf = 0").isEmpty()


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """The component of each node that has an edge: node, component (its least node).

    Null ends and loops are ignored, repeated edges count once.
    """
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    now = materialised(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(now):
        now = materialised(_star(_star(now, large=True), large=False))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
