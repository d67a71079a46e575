"""Operator 11: exact duplicates by a minimal perfect hash over the digests of earlier documents.

Two texts are equal when they are identical after deleting every character of ``[\\x20\\x09-\\x0D]``; a null text counts as empty.
What stands for a text is the SHA-256 of what is left.  Of equal texts the row with the most code points in its original
text stays, then the one with the least key (null last), then one of the rows that are equal in all of this.

Documents are history or arrivals, as a predicate says.  The distinct digests of the history are dealt to shards; a task gives one
shard its minimal perfect hash and its slots.  A slot holds the whole digest, the number of copies, and the locator of the winner
(key, code points, number of the row).  Arrivals are added up by digest first, so that a text with any number of copies is
one row, and meet the index of their shard: a perfect hash gives every digest some slot, so the 32 bytes there are compared.  Members
add to their slot, and take it over if they win; the others are groups of their own.

The text is read once, by the JVM; what is kept, shuffled and joined is about 60 bytes a row.  Groups go back to their rows by a
join on the digest; those with more than one row in ``HOT`` of the table (fewer than HOT groups, whatever the table) by broadcast,
so no key of that join holds more than that share.  Empty tables give no rows.  Further columns, whatever their names, take no part.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.llm import common
from kinloom.llm.token_file import PerfectHash

#: Digests of a shard, about; and the share of a table from which a group is hot.
SHARD_DIGESTS, HOT = 1 << 17, 1000
#: Fixed value: what is deleted before texts are compared.
BLANKS = " \t\n\x0b\x0c\r"


def digests(df: DataFrame, key: str, text: str, number: Column | None = None) -> DataFrame:
    """key, digest, points (code points of the whole text) and row (a number of its own, or as given) of each row, stored."""
    whole = F.coalesce(common.col(df, text), F.lit(""))
    digest = F.unhex(F.sha2(F.translate(whole, BLANKS, "").cast("binary"), 256))
    number = F.monotonically_increasing_id() if number is None else number
    return common.stored(df.select(common.col(df, key).alias("key"), digest.alias("digest"), F.length(whole).cast("long").alias("points"), number.alias("row")))


def _added_up(rows: DataFrame, shards: int) -> DataFrame:
    """A row for each digest: shard, digest, copies, points, key, row (of the winner)."""
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("key").isNull().alias("u"), "key", "row"))
    sums = rows.groupBy("digest").agg(F.count("*").alias("copies"), best.alias("b"))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")
    return sums.select(shard.alias("shard"), "digest", "copies", (-F.col("b.p")).alias("points"), F.col("b.key").alias("key"), F.col("b.row").alias("row"))


def _names(found: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit name of each digest."""
    words = np.frombuffer(b"".join(found.to_pylist()), "<u8").reshape(-1, 4)
    return common.mix(words[:, seed % 4] ^ common.mix(words[:, (seed + 1) % 4] + np.uint64(seed)))


class DigestIndex:
    """The perfect hash of a shard and its slots: a table of digest, copies, points, key, row, in the order of the slots."""

    def __init__(self, seed: int, hash_: PerfectHash, slots: pa.Table):
        self.seed, self.hash, self.slots = seed, hash_, slots

    @classmethod
    def build(cls, rows: pa.Table) -> DigestIndex:
        """rows: a row for each distinct digest."""
        found, seed = rows["digest"].combine_chunks(), 0
        while len(np.unique(names := _names(found, seed))) < len(names):
            seed += 1
        hash_ = PerfectHash.build(names)
        order = np.empty(len(names), np.int64)
        order[hash_.find(names)] = np.arange(len(names))
        return cls(seed, hash_, rows.take(pa.array(order)))

    def find(self, wanted: pa.Array) -> np.ndarray:
        """The slot of each digest, -1 where the slot's bytes are other ones."""
        if not len(wanted) or not self.slots.num_rows:
            return np.full(len(wanted), -1, np.int64)
        slot = self.hash.find(_names(wanted, self.seed))
        held = self.slots["digest"].take(pa.array(np.maximum(slot, 0))).combine_chunks()
        return np.where((slot >= 0) & np.asarray(pc.equal(held, wanted)), slot, -1)

    def dump(self) -> dict[str, bytes | int]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.slots.schema) as out:
            out.write_table(self.slots)
        h = self.hash
        return {"seed": self.seed, "sizes": h.sizes.tobytes(), "bits": h.bits.tobytes(), "rest": h.rest.tobytes(), "slots": sink.getvalue().to_pybytes()}

    @classmethod
    def load(cls, row: dict) -> DigestIndex:
        hash_ = PerfectHash(np.frombuffer(row["bits"], np.uint64), np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["rest"], np.uint64))
        return cls(row["seed"], hash_, pa.ipc.open_stream(row["slots"]).read_all())


_INDEX = "shard int, seed int, sizes binary, bits binary, rest binary, slots binary"
_SLOT = ("digest", "copies", "points", "key", "row")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index of rows as digests() gives them, a row for each shard that holds any; stored."""

    def build(rows: pa.Table) -> pa.Table:
        made = DigestIndex.build(rows.select(_SLOT)).dump()
        return pa.table({"shard": rows["shard"].slice(0, 1).cast(pa.int32()), **{k: pa.array([v], pa.int32() if k == "seed" else pa.binary()) for k, v in made.items()}})

    return common.stored(_added_up(history, shards).groupBy("shard").applyInArrow(build, _INDEX))


def match(index: DataFrame, arrivals: DataFrame, shards: int) -> DataFrame:
    """All groups of history and arrivals: digest, copies, points, key, row (of the winner), known (in the history)."""
    added = _added_up(arrivals, shards)
    schema = T.StructType([*(added.schema[c] for c in _SLOT), T.StructField("known", T.BooleanType())])

    def meet(held: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.select(_SLOT)
        if not held.num_rows:
            return rows.append_column("known", pa.array(np.zeros(rows.num_rows, bool)))
        index = DigestIndex.load(held.to_pylist()[0])
        slot = index.find(rows["digest"].combine_chunks()) if rows.num_rows else np.zeros(0, np.int64)
        new, old = rows.filter(pa.array(slot < 0)), rows.filter(pa.array(slot >= 0))
        both = pa.concat_tables([index.slots.cast(old.schema), old]).append_column("slot", pa.array(np.concatenate([np.arange(index.slots.num_rows), slot[slot >= 0]])))
        order = pc.sort_indices(both, sort_keys=[("slot", "ascending"), ("points", "descending"), ("key", "ascending"), ("row", "ascending")], null_placement="at_end")
        both = both.take(order)
        at = np.asarray(both["slot"])
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        sums = np.add.reduceat(np.asarray(both["copies"]), first)
        won = both.take(pa.array(first)).drop_columns("slot")
        won = won.set_column(won.schema.get_field_index("copies"), "copies", pa.array(sums, pa.int64())).cast(new.schema)
        out = pa.concat_tables([won, new])
        return out.append_column("known", pa.array(np.arange(out.num_rows) < won.num_rows))

    return index.groupBy("shard").cogroup(added.groupBy("shard")).applyInArrow(meet, schema)


def groups_of(rows: DataFrame, historical: Column | None = None) -> DataFrame:
    """The groups of rows as digests() gives them, stored; historical: a predicate on key, by default the lower half of the range of keys."""
    spark = rows.sparkSession
    if historical is None:
        ends = rows.agg(F.min("key"), F.max("key")).first()
        historical = F.col("key") <= F.lit(ends[0]) + (F.lit(ends[1]) - F.lit(ends[0])) / 2
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // SHARD_DIGESTS + 1)
    old = F.coalesce(historical, F.lit(False))
    return common.stored(match(build_index(rows.where(old), shards), rows.where(~old), shards))


def exact_groups(df: DataFrame, key: str, text: str, historical: Column | None = None) -> DataFrame:
    """A row for each row: key, keep (key of the row that stays), copies (rows of the group), kept, digest.

    historical: a predicate on the key (named key); by default, for numbers, the lower half of their range.
    """
    rows = digests(df, key, text)
    groups = groups_of(rows, historical)
    least = max(1, rows.count() // HOT)
    many = groups.where("copies > 1").select("digest", "copies", F.col("key").alias("keep"), F.col("row").alias("winner"))
    hot, cold = many.where(F.col("copies") > least), many.where(F.col("copies") <= least)
    # Each hot group has more than a HOT-th of the rows, so there are at most HOT of them.
    few = F.broadcast(hot)
    parts = [rows.join(few, "digest"), rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest", "left")]
    alone = F.col("copies").isNull()
    return reduce(DataFrame.unionByName, parts).select(
        "key", F.when(alone, F.col("key")).otherwise(F.col("keep")).alias("keep"), F.coalesce("copies", F.lit(1)).alias("copies"), (alone | (F.col("winner") == F.col("row"))).alias("kept"), "digest",
    )


def drop_repeats(df: DataFrame, key: str, text: str, historical: Column | None = None) -> DataFrame:
    """The rows that stay, with all their columns: one of each group."""
    (mark,) = common.free_names(df, "row")
    held = common.stored(df.withColumn(mark, F.monotonically_increasing_id()))
    rows = digests(held, key, text, common.col(held, mark))
    winners = groups_of(rows, historical).select(F.col("row").alias(mark))
    return held.join(winners, mark, "left_semi").drop(mark)
