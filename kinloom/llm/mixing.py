"""Operator 5: mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

A source's target is its weight's share of all words.  Sources whose target exceeds most_epochs times their size are clamped
there, and what they leave is shared out again by weight among the others, until none is above.  A document is then taken
as often as its source's target holds the source whole, and once more if it is among the documents that fill the rest:
those with the least seeded hash.  The last hash that still belongs is found per source by sums over the leading bits of the
hash and then by a running sum over the one range of hashes that holds the end of the rest, so no task sorts a whole source and
texts are not moved at all.

Sources are ordered by code point, null last as a source of its own.  Null texts have size 0.  A source without words has
target 0 and nothing of it is taken.  Rows with equal id and text have equal hashes; they are told apart by a running number within
these, so that a source of repeated rows comes near its target too, and which of such rows is taken does not matter.
Added columns take names that the input does not have.  An empty table gives an empty result.

Only one row for each source meets in one place: its size, weight and target.  A source's weight follows from its rank, which is
counted per range of names, and a round of the filling is one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm import common

#: Leading bits of the place by which each source is summed up first.
BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD_PATTERN)), F.lit(0)).cast("long")


def cyclic_weights(n: int) -> Callable[[Column], Column]:
    """Weights 1 to n, repeating, by the rank of a source from 1."""
    return lambda rank: ((rank - 1) % n + 1).cast("double")


def water_fill(sources: DataFrame, most_epochs: float) -> DataFrame:
    """Adds target to a table of sources (weight, source_size): each round clamps the sources above their cap.

    A round is one aggregate; a clamped source stays clamped, so there are at most as many rounds as sources.
    """
    cap = F.col("source_size") * most_epochs
    clamped, before = F.lit(False), -1
    while True:
        total, taken, weight, n = sources.agg(F.sum("source_size"), F.sum(F.when(clamped, cap).otherwise(0.0)), F.sum(F.when(~clamped, F.col("weight"))), F.count(F.when(clamped, 1))).first()
        level = (total - taken) / weight if total and weight else 0.0
        if n == before or not weight:
            break
        # The level only rises, so what it clamps once it clamps for good.
        clamped, before = F.col("weight") * F.lit(level) > cap, n
    return sources.withColumn("target", F.when(clamped, cap).otherwise(F.col("weight") * F.lit(level)))


def _numbered(slim: DataFrame) -> DataFrame:
    """Adds copy, a running number from 0 among rows of equal hash (part and hash in): by part, then within the part.

    A hash that a third of all rows share is numbered in as many tasks as it has parts.
    """
    counts = slim.groupBy("hash", "part").agg(F.count("*").alias("n"))
    repeated = counts.groupBy("hash").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("hash")
    earlier = Window.partitionBy("hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(repeated, "hash").select("hash", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    offsets = common.stored(offsets)
    if offsets.isEmpty():
        return slim.withColumn("copy", F.lit(0).cast("long"))
    again = slim.join(offsets, ["hash", "part"])
    again = again.withColumn("copy", F.col("offset") + F.row_number().over(Window.partitionBy("hash", "part").orderBy("row")) - 1).drop("offset")
    return slim.join(offsets.select("hash").distinct(), "hash", "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(again)


def plan_mix(docs: DataFrame, doc_id: str, text: str, source: str, weights: Callable[[Column], Column], most_epochs: float = 3.0, seed: int = 17, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A slim table of all documents (id, source, size, hash, part, row, copy, place), and one row for each source: source, weight,
    source_size, target, whole (repetitions of every document) and last (the greatest place of those taken once more; null: none).

    A document's place is its hash, or for the second of equal hashes and on a hash of it and the running number.  row names a column
    with a number for each row, by which the caller finds repeated rows again.
    """
    number = common.col(docs, row) if row else F.monotonically_increasing_id()
    slim = docs.select(common.col(docs, doc_id).alias("id"), common.col(docs, source).alias("source"), word_count(common.col(docs, text)).alias("size"), mix_hash(docs, doc_id, text, seed).alias("hash"), number.alias("row"))
    slim = common.stored(slim.withColumn("part", F.spark_partition_id()))
    slim = common.stored(_numbered(slim).withColumn("place", place_of(F.col("hash"), F.col("copy"))))
    cells = common.stored(slim.groupBy("source", F.shiftrightunsigned("place", 63 - BITS).alias("cell")).agg(F.sum("size").alias("words")))
    sizes = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    sources = common.stored(_ranked(sizes).select("source", "source_size", weights(F.col("rank")).alias("weight")))
    sources = water_fill(sources, most_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = common.stored(sources.withColumn("whole", F.floor(epochs).cast("int")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    # The cell in which a source's rest ends, then the document in it.
    running = Window.partitionBy("source").orderBy("cell")
    upto = cells.withColumn("upto", F.sum("words").over(running))
    met = upto.alias("c").join(sources.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
    edge = met.where("upto - words < rest and rest <= upto").select(F.col("c.source").alias("source"), "cell", (F.col("rest") - F.col("upto") + F.col("words")).alias("need"))
    inside = slim.withColumn("cell", F.shiftrightunsigned("place", 63 - BITS)).alias("d")
    inside = inside.join(edge.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.cell") == F.col("e.cell")))
    inside = inside.select(F.col("d.source").alias("source"), "place", "size", "need", F.col("d.cell").alias("cell"))
    in_order = Window.partitionBy("source", "cell").orderBy("place")
    # A document belongs if the rest ends beyond its middle, so that a source misses by half a document at most.
    stops = inside.groupBy("source", "cell", "place", "need").agg(F.sum("size").alias("size"))
    stops = stops.withColumn("middle", F.sum("size").over(in_order) - F.col("size") / 2).groupBy("source", "cell").agg(F.max(F.when(F.col("middle") <= F.col("need"), F.col("place"))).alias("place"))
    floor = F.shiftleft(F.col("cell").cast("long"), 63 - BITS) - 1
    last = stops.select("source", F.coalesce("place", floor).alias("last"))
    out = sources.alias("s").join(last.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source")), "left")
    return slim, common.stored(out.select("s.source", "weight", "source_size", "target", "whole", "last"))


def _ranked(sizes: DataFrame) -> DataFrame:
    """Adds rank, from 1, by code point with null last, counted per range of sources."""
    dealt = common.stored(sizes.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("rank", within).join(offsets, "part").select("source", "source_size", (F.col("rank") + F.col("offset")).alias("rank"))


def mix_hash(docs: DataFrame, doc_id: str, text: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), common.col(docs, doc_id), common.col(docs, text))


def place_of(hash_: Column, copy: Column) -> Column:
    """63 bits that order the documents of a source."""
    return F.shiftrightunsigned(F.when(copy > 0, F.xxhash64(hash_, copy)).otherwise(hash_), 1)


def mix(docs: DataFrame, doc_id: str, text: str, source: str, weights: Callable[[Column], Column], most_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """The mix: every row of docs as many times as it is taken, with docs' columns."""
    row, hash_, copy, again, whole, last, times, repeat = common.free_names(docs, "row", "hash", "copy", "source again", "whole", "last", "times", "repeat")
    held = docs.withColumn(copy, F.lit(0).cast("long"))
    slim, plan = plan_mix(docs, doc_id, text, source, weights, most_epochs, seed)
    if not slim.where("copy > 0").isEmpty():
        # Stored with a number for each row, by which repeated rows are found again.
        held = common.stored(docs.withColumn(row, F.monotonically_increasing_id()))
        slim, plan = plan_mix(held, doc_id, text, source, weights, most_epochs, seed, row)
        held = held.join(slim.where("copy > 0").select(F.col("row").alias(row), F.col("copy").alias(copy)), row, "left")
    mine = plan.select(F.col("source").alias(again), F.col("whole").alias(whole), F.col("last").alias(last))
    joined = held.withColumn(hash_, mix_hash(held, doc_id, text, seed)).join(mine, common.col(held, source).eqNullSafe(F.col(again)))
    extra = F.coalesce(place_of(F.col(hash_), F.coalesce(copy, F.lit(0))) <= F.col(last), F.lit(False)).cast("int")
    taken = joined.withColumn(times, F.col(whole) + extra).where(F.col(times) > 0)
    return taken.withColumn(repeat, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[common.col(docs, c) for c in docs.columns])


def mix_report(docs: DataFrame, doc_id: str, text: str, source: str, weights: Callable[[Column], Column], most_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """A row for each document: id, size, source_size, target, taken (words the mix takes of it)."""
    slim, plan = plan_mix(docs, doc_id, text, source, weights, most_epochs, seed)
    joined = slim.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    times = F.col("whole") + F.coalesce(F.col("place") <= F.col("last"), F.lit(False)).cast("int")
    size, total, target, taken = common.free_names(docs.select(common.col(docs, doc_id)), "size", "source_size", "target", "taken")
    return joined.select(F.col("id").alias(doc_id), F.col("size").alias(size), F.col("source_size").alias(total), F.col("target").alias(target), (F.col("size") * times).cast("long").alias(taken))
