"""Operator 12: how the sources of each language differ in their terms, by DuckDB over shards of terms.

Terms are the runs ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a text, with A-Z (only) lower-cased.  Null texts, languages and sources
count as ''.  A language keeps the V terms that occur in at least ``least`` of its documents.  Every group (language, source), even one
without terms, and each language gives each kept term p = 1 + floor(SCALE (count + 5) / (N + 5 V)), with N the sum of its counts over
kept terms.  Two groups differ in a term by the difference of their p.

1. Each task counts the terms of its documents with DuckDB, some megabytes of text at a time, and sends on one row for each
   language, source and term: a frequent term is a row of a task, however often it occurs.
2. Spark adds these up and deals them by the hash of language and term to shards of about SHARD_ROWS rows, as many as the table
   needs, and DuckDB picks the kept terms of a shard.
3. Spark adds up N and V.  Each shard gets these few rows for every group, and DuckDB computes its part of the sum of
   each pair of groups, and its best terms of each group.
4. Spark adds up the parts of the pairs and ranks.

Groups and terms do not meet all with all: if p0 is the p of a term that a group does not have, a pair's sum is V |p0 - p0'|, plus
corrections for the terms that one of them has (by distinct p of a group), plus corrections for those that both have (a join
on the term).  All numbers are integers; products are computed with 128 bits.  The result has a row for every two sources of a language
by its meaning.  An empty table gives no rows; further columns, whatever their names, take no part.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm import common
from kinloom.llm.bpe import slices

#: The pattern of terms, the scale of shares, and what is added to each count.
TERM_PATTERN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, ADDED = 1_000_000_000, 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text counted at a time, rows held by a counting task, and memory of a task's DuckDB.
TEXT_BYTES, HELD_ROWS, MEMORY = 4 << 20, 1_000_000, "1GB"
#: Rows of language, source and term in a shard, about.
SHARD_ROWS = 100_000

COUNT_SQL = f"""
    INSERT INTO counts
    SELECT lang, source, term, sum(n) AS n, count(*) AS docs FROM (
        SELECT doc, lang, source, term, count(*) AS n FROM (
            SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{TERM_PATTERN}')) AS term FROM texts)
        GROUP BY ALL)
    GROUP BY lang, source, term"""

KEPT_SQL = """
    SELECT lang, source, term, n, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS first FROM (
        SELECT *, sum(docs) OVER (PARTITION BY lang, term) AS all_docs FROM counts)
    WHERE all_docs >= $least"""

#: Of a shard: k (lang, source, term, n), groups and langs (total: the N of each; v: the V of the language).
SHARD_SQL = f"""
    WITH g AS (
        SELECT lang, source, total, v, 1 + {SCALE}::HUGEINT * {ADDED} // (total + {ADDED} * v) AS p0 FROM groups WHERE v > 0
    ), w AS (
        SELECT lang, source, term, n, p0, 1 + {SCALE}::HUGEINT * (n + {ADDED}) // (total + {ADDED} * v::HUGEINT) AS p FROM k JOIN g USING (lang, source)
    ), shared AS (
        SELECT a.lang, a.source AS a, b.source AS b, sum(abs(a.p - b.p) - abs(a.p - b.p0) - abs(b.p - a.p0) + abs(a.p0 - b.p0)) AS value
        FROM w a JOIN w b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
    ), one AS (
        SELECT h.lang, least(h.source, g.source) AS a, greatest(h.source, g.source) AS b, sum(m * (abs(h.p - g.p0) - abs(h.p0 - g.p0))) AS value
        FROM (SELECT lang, source, p0, p, count(*) AS m FROM w GROUP BY ALL) h JOIN g ON h.lang = g.lang AND h.source <> g.source GROUP BY ALL
    ), q AS (
        SELECT lang, term, 1 + {SCALE}::HUGEINT * (s + {ADDED}) // (total + {ADDED} * v::HUGEINT) AS q
        FROM (SELECT lang, term, sum(n) AS s FROM k GROUP BY ALL) JOIN langs USING (lang)
    ), best AS (
        SELECT lang, source, term, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS r FROM w JOIN q USING (lang, term) WHERE p > q
    )
    SELECT 'pair' AS part, lang, a, b, sum(value)::BIGINT AS value FROM (SELECT * FROM shared UNION ALL SELECT * FROM one) GROUP BY ALL
    UNION ALL SELECT 'term', lang, source, term, value::BIGINT FROM best WHERE r <= $most"""


def _duck():
    import duckdb

    return duckdb.connect(config={"threads": "1", "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": "false"})


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents), one row or more for each, to be added up."""
    blank = lambda c, name: F.coalesce(common.col(docs, c), F.lit("")).alias(name)
    held = docs.select(blank(text, "text"), blank(lang, "lang"), blank(source, "source"))

    def count(batches):
        db, at, held_rows = _duck(), 0, 0
        table = "CREATE OR REPLACE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)"
        added = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM counts GROUP BY ALL"
        db.execute(table).fetchall()
        for whole in batches:
            for part in slices(whole, 0, TEXT_BYTES):
                texts = pa.table({**{c: part.column(i) for i, c in enumerate(("text", "lang", "source"))}, "doc": pa.array(range(at, at + part.num_rows))})
                at += part.num_rows
                db.register("texts", texts)
                held_rows += db.execute(COUNT_SQL).fetchall()[0][0]
                if held_rows > HELD_ROWS:
                    yield from db.sql(added).to_arrow_table().to_batches(100_000)
                    db.execute(table).fetchall()
                    held_rows = 0
        yield from db.sql(added).to_arrow_table().to_batches(100_000)
        db.close()

    return held.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def kept_terms(counts: DataFrame, least: int) -> tuple[DataFrame, int]:
    """The kept terms of each group, stored, and the number of shards: shard, lang, source, term, n, first (once for each language and term)."""
    added = common.stored(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    shards = added.count() // SHARD_ROWS + 1
    dealt = added.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))

    def pick(rows: pa.Table) -> pa.Table:
        db = _duck()
        db.register("counts", rows)
        out = db.sql(KEPT_SQL, params={"least": least}).to_arrow_table()
        db.close()
        return out.add_column(0, "shard", pa.repeat(rows["shard"][0], out.num_rows).cast(pa.int32()))

    return common.stored(dealt.groupBy("shard").applyInArrow(pick, "shard int, lang string, source string, term string, n long, first boolean")), shards


def source_divergence(docs: DataFrame, text: str, lang: str, source: str, least: int = 30, most: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: part pair has the other sources of the language by the sum of differences over all
    kept terms, part term the terms that the group has and gives a greater p than its language, by that difference, up to most.

    Ranks run from 1 for each group and part, greatest value first, then by item.
    """
    kept, shards = kept_terms(term_counts(docs, text, lang, source), least)
    blank = lambda c, name: F.coalesce(common.col(docs, c), F.lit("")).alias(name)
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("total"), F.count_if("first").alias("v"))
    groups = docs.select(blank(lang, "lang"), blank(source, "source")).distinct().join(sums, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left")
    groups = common.stored(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v")]))
    sent = groups.unionByName(langs.select("lang", F.lit(None).cast("string").alias("source"), "total", "v"))
    sent = sent.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "*")

    def part(rows: pa.Table, about: pa.Table) -> pa.Table:
        db = _duck()
        db.register("k", rows)
        db.register("about", about)
        db.execute("CREATE TABLE groups AS SELECT * FROM about WHERE source IS NOT NULL").fetchall()
        db.execute("CREATE TABLE langs AS SELECT * FROM about WHERE source IS NULL").fetchall()
        out = db.sql(SHARD_SQL, params={"most": most}).to_arrow_table()
        db.close()
        return out

    parts = common.stored(kept.groupBy("shard").cogroup(sent.groupBy("shard")).applyInArrow(part, "part string, lang string, a string, b string, value long"))
    # The p of a term that a group does not have.
    none = F.expr(f"CASE WHEN v > 0 THEN 1 + {SCALE * ADDED} div (total + {ADDED} * v) ELSE 0 END")
    one = groups.select("lang", F.col("source").alias("a"), "v", none.alias("pa"))
    other = groups.select("lang", F.col("source").alias("b"), none.alias("pb"))
    base = one.join(other, "lang").where("a < b").select("lang", "a", "b", (F.col("v") * F.abs(F.col("pa") - F.col("pb"))).alias("value"))
    pairs = base.unionByName(parts.where("part = 'pair'").drop("part")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", ways.alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    terms = parts.where("part = 'term'").select("lang", F.col("a").alias("source"), F.lit("term").alias("part"), F.col("b").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= most))
