"""Placement of sequences into nested groups by words: an index from words to groups, and a descent from each family's root.

Words are made by the caller's expression (an array of values that can be compared), as runs of letters or of words.  The index has,
for each word and family, the lowest group that holds all of the family's sequences with that word.  A sequence's score for a family is
the share of its distinct words that the family's index has; below the family's root it goes to the child that most of these words
lead to, as long as that is a share of what leads to the group itself.

Words that very many families or sequences hold are dealt out: a word with more index rows than one in HOT of the index gets as many
parts as it needs, and its rows on the other side go to each part.  At most HOT words are such, so the list of them is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators import hierarchy
from kinloom.operators.graph import materialised

#: Placements of a sequence; the least share of a group's words that lead to one child; index rows over those of a word that is dealt out.
HITS, DESCENT, HOT = 10, 0.5, 1000


def letter_words(sequence: Column, size: int = 6) -> Column:
    """The distinct runs of size letters, as 64-bit hashes."""
    starts = F.sequence(F.lit(1), F.length(sequence) - size + 1)
    return F.when(F.length(sequence) >= size, F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substring(sequence, i, F.lit(size)))))).otherwise(F.array())


def text_words(text: Column, size: int = 5) -> Column:
    """The distinct runs of size words of a text; give it the words as a value, as exploded does."""
    return F.when(F.size(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(text) - size + 1), lambda i: F.array_join(F.slice(text, i, size), " "))))


def _common(a: Column, b: Column) -> Column:
    """The longest beginning that two paths share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    n = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct(F.when(s["on"] & x, s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & x).alias("on")))["n"]
    return F.slice(a, F.lit(1), n)


def word_index(references: DataFrame, groups: DataFrame, words: Column) -> DataFrame:
    """word, fam, path: the lowest group of a family that holds all of its sequences with the word, as its path; stored.

    references: node (the group that a sequence belongs to), and what words is made of.  groups: fam, node, parent.  The lowest common
    group of many is that of the two whose paths are first and last in order.
    """
    paths = hierarchy.paths(groups).join(groups.select("node", "fam"), "node")
    each = references.select("node", F.explode(words).alias("word")).distinct().join(paths, "node")
    ends = each.groupBy("word", "fam").agg(F.min("path").alias("a"), F.max("path").alias("b"))
    return materialised(ends.select("word", "fam", _common(F.col("a"), F.col("b")).alias("path")))


def dealt_join(left: DataFrame, index: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """left joined with index on a key, keys with more than one in hot of the index's rows dealt over parts."""
    least = max(1, index.count() // hot)
    frequent = index.groupBy(key).count().where(F.col("count") > least).select(key, F.ceil(F.col("count") / least).cast("int").alias("_parts"))
    frequent = F.broadcast(frequent)  # fewer than hot rows
    part = F.coalesce("_parts", F.lit(1))
    other = [c for c in index.columns if c != key]
    right = index.join(frequent, key, "left").withColumn("_part", F.pmod(F.xxhash64(*other), part).cast("int")).drop("_parts")
    sent = left.join(frequent, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), part - 1))).drop("_parts")
    return sent.join(right, [key, "_part"]).drop("_part")


def placements(sequences: DataFrame, seq_id: str, index: DataFrame, words: Column, most: int = HITS, descent: float = DESCENT) -> DataFrame:
    """Up to most families of each sequence and the group in each: seq_id, hit_rank (from 1), fam, node, path, n_words, family_count,
    family_score, subfamily_count, subfamily_score.

    Families rank by their count of the sequence's distinct words, then by fam.  family_score is that count over the sequence's words,
    subfamily_score that of the words that lead to the group over the family's.  Ties between children go to the first by path.
    """
    held = sequences.select(seq_id, F.explode(F.array(words)).alias("_w")).where("_w is not null")
    each = held.select(seq_id, F.size("_w").cast("long").alias("n_words"), F.explode("_w").alias("word"))
    met = dealt_join(each, index, "word")
    # How many words lead to each group of each family, whatever is below.
    counts = materialised(met.groupBy(seq_id, "fam", "path").agg(F.count("*").alias("n"), F.max("n_words").alias("n_words")))
    families = counts.groupBy(seq_id, "fam").agg(F.sum("n").alias("family_count"), F.max("n_words").alias("n_words"))
    rank = F.row_number().over(Window.partitionBy(seq_id).orderBy(F.desc("family_count"), "fam"))
    best = families.withColumn("hit_rank", rank).where(F.col("hit_rank") <= most)
    begin = F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i)))
    under = counts.join(best.select(seq_id, "fam"), [seq_id, "fam"]).select(seq_id, "fam", begin.alias("path"), "n").groupBy(seq_id, "fam", "path").agg(F.sum("n").alias("n"))
    # A sequence's groups in one family, at most its words times the depth: from the top down, the largest child first.
    steps = F.array_sort(F.collect_list(F.struct(F.size("path").alias("depth"), (-F.col("n")).alias("less"), "path", "n")))
    walk = F.aggregate(
        F.slice("steps", 2, F.size("steps")), F.get("steps", F.lit(0)),
        lambda at, x: F.when((x["depth"] == at["depth"] + 1) & (F.slice(x["path"], F.lit(1), at["depth"]) == at["path"]) & (x["n"] >= F.lit(descent) * at["n"]), x).otherwise(at),
    )
    found = under.groupBy(seq_id, "fam").agg(steps.alias("steps")).select(seq_id, "fam", walk.alias("at"))
    out = best.join(found, [seq_id, "fam"])
    return out.select(
        seq_id, "hit_rank", "fam", F.element_at("at.path", -1).alias("node"), F.col("at.path").alias("path"), "n_words", "family_count", F.round(F.col("family_count") / F.col("n_words"), 6).alias("family_score"),
        F.col("at.n").alias("subfamily_count"), F.round(F.col("at.n") / F.col("family_count"), 6).alias("subfamily_score"),
    )
