"""Packing of files into batches without a group in one task.

Files go by descending size.  One above alone is a batch of its own; the others fill a batch until its sum exceeds full.  So from each file
on that begins a batch, the next batch begins behind the first file at which the running sum exceeds what it was before by more than
full.  Running sums go over ranges of a global sort, the place where the sum is exceeded comes from one sort of sums and wanted
sums together, and the files that do begin a batch are reached from each group's first by steps that double.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators.graph import discard, materialised
from kinloom.operators.intervals import running
from kinloom.operators.proteins import numbered


def pack_batches(files: DataFrame, group: str, size: str, tie: str, alone: int, full: int) -> DataFrame:
    """group, size, tie and batch (from 0, in each group).  A null size is an empty file; ties of size go by tie, which tells files apart."""
    slim = files.select(group, size, tie, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_n"), F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("")).alias("_g"))
    placed = numbered(slim.withColumn("_less", -F.col("_n")), "_g", "_less", tie)
    sums = materialised(running(placed.select("_g", group, size, tie, "_n", "number"), ["number"], sums={"upto": "_n"}))
    # All above alone come first.  The others: where does a batch end that begins here?
    rest = sums.where(F.col("_n") <= alone)
    none = F.lit(None).cast("long")
    ends = rest.select("_g", F.col("upto").alias("value"), F.lit(1).alias("side"), "number", F.col("number").alias("end"))
    asked = rest.select("_g", (F.col("upto") - F.col("_n") + full).alias("value"), F.lit(0).alias("side"), "number", none.alias("end"))
    # From the greatest sum down, the last end passed is the first one that is greater; of equal sums the first file is passed last.
    order = asked.unionByName(ends).select("_g", (-F.col("value")).alias("down"), "side", (-F.col("number")).alias("back"), "end", F.struct("_g", "end").alias("e"))
    order = order.withColumn("e", F.when(F.col("end").isNotNull(), F.col("e")))
    met = running(order, ["_g", "down", "side", "back"], lasts={"passed": "e"}).where("side = 0")
    follow = F.when(F.col("passed._g") == F.col("_g"), F.col("passed.end") + 1)
    last = sums.groupBy("_g").agg(F.max("number").alias("_last"))
    steps = met.select("_g", (-F.col("back")).alias("number"), follow.alias("to")).join(last, "_g")
    steps = materialised(steps.select("number", F.when(F.col("to") <= F.col("_last"), F.col("to")).alias("to")))
    begins = materialised(rest.groupBy("_g").agg(F.min("number").alias("number")).select("number"))
    while True:
        # What is reached so far, and one step further from all of it; then steps of twice the length.
        further = begins.join(steps, "number").where("`to` is not null").select(F.col("to").alias("number"))
        if further.isEmpty():
            break
        old, begins = begins, materialised(begins.unionByName(further).distinct())
        twice = steps.select(F.col("number").alias("to"), F.col("to").alias("to2"))
        spent, steps = steps, materialised(steps.where("`to` is not null").join(twice, "to").select("number", F.col("to2").alias("to")))
        discard(old, spent)
    # A file above alone begins a batch too.
    marked = sums.join(begins.withColumn("begins", F.lit(1)), "number", "left").withColumn("begins", F.when(F.col("_n") > alone, 1).otherwise(F.coalesce("begins", F.lit(0))))
    told = materialised(running(marked, ["number"], sums={"batches": "begins"}))
    first = told.groupBy("_g").agg(F.min("batches").alias("first"))
    return told.join(first, "_g").select(group, size, tie, (F.col("batches") - F.col("first")).cast("long").alias("batch"))
