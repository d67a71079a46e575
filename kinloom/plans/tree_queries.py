"""Registered queries of alignment scores, placement and clustering of sequences, and of groups over the levels of a species tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators import aligner, ancestry, clustering, fold, hierarchy, placement
from kinloom.operators.graph import unsent
from kinloom.plans import domain
from kinloom.plans.domain import TREE_SQL, table
from kinloom.plans.queries import query


@query("""WITH RECURSIVE s AS (SELECT c_custkey AS k, c_custkey // 10 AS g, c_mktsegment || c_nationkey AS t FROM customer),
    p AS (SELECT a.k AS gene_a, b.k AS gene_b, a.t AS x, b.t AS y FROM s a JOIN s b ON a.g = b.g AND a.k < b.k),
    r AS (SELECT gene_a, gene_b, x, y, 0 AS i, [CASE WHEN j = 0 THEN 0 ELSE -8 - j END FOR j IN range(0, length(y) + 1)] AS h, [-1000000::BIGINT FOR j IN range(0, length(y) + 1)] AS f FROM p UNION ALL
        SELECT gene_a, gene_b, x, y, i + 1, [CASE WHEN j = 1 THEN c[1] ELSE greatest(c[j], list_max([c[k] + k FOR k IN range(1, j)]) - 8 - j) END FOR j IN range(1, length(y) + 2)], f FROM (
            SELECT *, [CASE WHEN j = 1 THEN f[1] ELSE greatest(f[j], o[j - 1] + CASE WHEN x[i + 1] = y[j - 1] THEN 5
                WHEN translate(x[i + 1], 'AGSTILMVFWYHKRDENQ', 'aaaabbbbcccdddeeee') = translate(y[j - 1], 'AGSTILMVFWYHKRDENQ', 'aaaabbbbcccdddeeee') THEN 1 ELSE -2 END) END FOR j IN range(1, length(y) + 2)] AS c FROM (
                SELECT gene_a, gene_b, x, y, i, h AS o, [greatest(h[j] - 8, f[j]) - 1 FOR j IN range(1, length(y) + 2)] AS f FROM r WHERE i < length(x))))
    SELECT gene_a, gene_b, CAST(h[length(y) + 1] AS BIGINT) AS score FROM r WHERE i = length(x)""")
def alignment_scores(spark: SparkSession, d: str) -> DataFrame:
    """The best score of each two sequences of a group of ten customers."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.floor(F.col("c_custkey") / 10).alias("g"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("t"))
    met = rows.alias("a").join(unsent(rows.alias("b")), (F.col("a.g") == F.col("b.g")) & (F.col("a.k") < F.col("b.k")))
    pairs = met.select(F.col("a.k").alias("gene_a"), F.col("b.k").alias("gene_b"), F.col("a.t").alias("x"), F.col("b.t").alias("y"))
    return aligner.with_scores(pairs, "x", "y").select("gene_a", "gene_b", F.col("score").cast("long").alias("score"))


_RUNS = r"""regexp_extract_all(text, '[^\x20\x09-\x0D]+')"""


@query(f"""WITH w AS (SELECT doc_id, {_RUNS} AS w FROM documents), b AS (SELECT item_id AS i, {_RUNS} AS w FROM benchmark),
    x AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS k FROM w)), q AS (SELECT doc_id, count(*) AS n_words FROM x GROUP BY 1),
    y AS (SELECT DISTINCT i, array_to_string(w[k:k + 1], ' ') AS g FROM (SELECT i, w, unnest(range(1, len(w))) AS k FROM b)),
    idx AS (SELECT g, i // 8 AS fam, CASE WHEN count(DISTINCT i) = 1 THEN min(i) END AS leaf, CASE WHEN count(DISTINCT i // 2) = 1 THEN min(i) // 2 END AS sub FROM y GROUP BY 1, 2),
    m AS (SELECT doc_id, fam, sub, leaf, count(*) AS n FROM x JOIN idx USING (g) GROUP BY ALL),
    f AS (SELECT doc_id, fam, sum(n) AS family_count FROM m GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY family_count DESC, fam) AS hit_rank FROM f),
    s2 AS (SELECT doc_id, fam, arg_max(sub, (n, -sub)) AS sub, max(n) AS n FROM (SELECT doc_id, fam, sub, sum(n) AS n FROM m WHERE sub IS NOT NULL GROUP BY ALL) GROUP BY 1, 2),
    p2 AS (SELECT r.*, CASE WHEN s2.n >= 0.5 * family_count THEN sub END AS sub, CASE WHEN s2.n >= 0.5 * family_count THEN s2.n ELSE family_count END AS n2 FROM r LEFT JOIN s2 USING (doc_id, fam) WHERE hit_rank <= 10),
    s3 AS (SELECT doc_id, fam, sub, arg_max(leaf, (n, -leaf)) AS leaf, max(n) AS n FROM (SELECT doc_id, fam, sub, leaf, sum(n) AS n FROM m WHERE leaf IS NOT NULL GROUP BY ALL) GROUP BY 1, 2, 3),
    p3 AS (SELECT p2.*, CASE WHEN s3.n >= 0.5 * n2 THEN leaf END AS leaf, CASE WHEN s3.n >= 0.5 * n2 THEN s3.n ELSE n2 END AS n3 FROM p2 LEFT JOIN s3 ON s3.doc_id = p2.doc_id AND s3.fam = p2.fam AND s3.sub = p2.sub)
    SELECT doc_id, CAST(hit_rank AS INTEGER) AS hit_rank, fam, CASE WHEN leaf IS NOT NULL THEN printf('i%06d', leaf) WHEN sub IS NOT NULL THEN printf('s%06d', sub) ELSE printf('f%06d', fam) END AS node, n_words,
        CAST(family_count AS BIGINT) AS family_count, round(family_count / n_words, 6) AS family_score, CAST(n3 AS BIGINT) AS subfamily_count, round(n3 / family_count, 6) AS subfamily_score FROM p3 JOIN q USING (doc_id)""")
def group_placements(spark: SparkSession, d: str) -> DataFrame:
    """Documents placed into groups of benchmark items: families of eight over groups of two over items; words are pairs of words."""
    items = table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("i"), "text")
    name = lambda kind, by: F.format_string(f"{kind}%06d", F.floor(F.col("i") / by).cast("long"))
    fam = F.floor(F.col("i") / 8).cast("long").alias("fam")
    levels = [("f", 8, None), ("s", 2, name("f", 8)), ("i", 1, name("s", 2))]
    groups = None
    for kind, by, parent in levels:
        more = items.select(fam, name(kind, by).alias("node"), (F.lit(None).cast("string") if parent is None else parent).alias("parent")).distinct()
        groups = more if groups is None else groups.unionByName(more)
    tokens = lambda df, *c: df.select(*c, F.explode(F.array(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).alias("tokens"))
    runs = placement.text_words(F.col("tokens"), 2)
    index = placement.word_index(tokens(items, name("i", 1).alias("node")), groups, runs)
    return placement.placements(tokens(table(spark, d, "documents"), "doc_id"), "doc_id", index, runs).drop("path")


@query("""WITH RECURSIVE s AS (SELECT p_partkey AS id, p_name || ' ' || p_brand || ' ' || p_type AS t FROM part),
    w AS (SELECT id, length(t) AS n, CASE WHEN length(t) >= 6 THEN list_distinct([md5(substring(t, k, 6)) FOR k IN range(1, length(t) - 4)]) ELSE [md5(t)] END AS w FROM s), e AS (SELECT id, n, unnest(list_sort(w)[1:8]) AS word FROM w),
    c AS (SELECT word, arg_max(id, (n, -id)) AS centre, max(n) AS size FROM e GROUP BY word), p AS (SELECT DISTINCT e.id AS member, centre, size FROM e JOIN c USING (word) WHERE e.id <> centre),
    l AS (SELECT member, centre, size FROM p JOIN s a ON a.id = member JOIN s b ON b.id = centre WHERE levenshtein(a.t, b.t) <= floor((1 - 0.8) * size + 0.000000001)),
    o AS (SELECT id, row_number() OVER (ORDER BY length(t) DESC, id) AS k FROM s WHERE id IN (SELECT member FROM l UNION SELECT centre FROM l)),
    q AS (SELECT o.k, list(c.k ORDER BY c.k) FILTER (c.k IS NOT NULL) AS up FROM o LEFT JOIN l ON l.member = o.id LEFT JOIN o c ON c.id = l.centre GROUP BY o.k),
    h AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS heads UNION ALL SELECT q.k, CASE WHEN up IS NULL OR NOT list_has_any(heads, up) THEN list_append(heads, q.k) ELSE heads END FROM h JOIN q ON q.k = h.k + 1),
    z AS (SELECT heads FROM h ORDER BY k DESC LIMIT 1), g AS (SELECT q.k, CASE WHEN list_contains(heads, q.k) THEN q.k ELSE list_min(list_intersect(up, heads)) END AS head FROM q, z),
    t AS (SELECT a.id, b.id AS cluster FROM g JOIN o a ON a.k = g.k JOIN o b ON b.k = g.head)
    SELECT id, cluster FROM t WHERE cluster IN (SELECT cluster FROM t GROUP BY cluster HAVING count(*) > 1)""")
def verified_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of parts that are at least 80 % alike to the longest one of their cluster."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("t"))
    return clustering.verified_clusters(parts, "id", "t", size=6, words=8, identity=0.8, order=F.md5)


@query(f"""WITH {TREE_SQL}, c AS (SELECT DISTINCT c_custkey // 12 AS f, c_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey),
    t AS (SELECT f, count(DISTINCT r) AS k, min(r) AS only FROM c GROUP BY f HAVING count(*) > 1), e AS (SELECT node, parent FROM tree WHERE parent IS NOT NULL),
    m AS (SELECT 'WORLD' AS level, f FROM t WHERE k > 1 UNION ALL SELECT DISTINCT 'R' || r, f FROM c JOIN t USING (f) UNION ALL SELECT 'N' || n, f FROM c JOIN t USING (f))
    SELECT node, parent, (SELECT count(*) FROM m a JOIN m b ON a.f = b.f WHERE a.level = node AND b.level = e.parent) AS retained, CAST(0 AS BIGINT) AS duplicated, CAST(0 AS BIGINT) AS copies,
        (SELECT count(*) FROM m b WHERE b.level = e.parent AND b.f NOT IN (SELECT f FROM m a WHERE a.level = node)) AS lost,
        (SELECT count(*) FROM m a WHERE a.level = node AND a.f NOT IN (SELECT f FROM m b WHERE b.level = e.parent)) AS gained FROM e""")
def ancestral_events(spark: SparkSession, d: str) -> DataFrame:
    """Families of one customer a nation through the fold, their ancestral groups at every taxon, and the events on the tree's edges."""
    nation = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    one = table(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 12).alias("fam"), nation.alias("species")).agg(F.min("c_custkey").alias("c"), F.min_by("c_mktsegment", "c_custkey").alias("seq"))
    genes = one.select("fam", F.concat(F.lit("C"), F.col("c").cast("string")).alias("gene"), "species", F.concat("seq", F.col("c").cast("string")).alias("seq"))
    tree = domain.species_tree(spark, d)
    groups, members = fold.group_tree(*fold.fold(genes, tree), genes, tree)
    ancestral = ancestry.ancestral_groups(groups, members.join(genes.select("gene", "species"), "gene"), hierarchy.closure(tree))
    return ancestry.taxon_events(ancestral, tree)


@query("""WITH j AS (SELECT o_orderkey AS gene, o_orderstatus AS s, o_orderpriority AS p, n_regionkey AS r, c_nationkey AS n, o_custkey AS c FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    a AS (SELECT DISTINCT r || '/' || s AS g, gene FROM j WHERE s <> 'P'), b AS (SELECT DISTINCT n || '/' || s AS g, gene FROM j WHERE p < '4'), c AS (SELECT DISTINCT n || '/' || s || '/' || c % 5 AS g, gene FROM j WHERE c % 3 <> 0 AND p > '2'),
    ab AS (SELECT DISTINCT a.g AS u, b.g AS w FROM a JOIN b USING (gene)), bc AS (SELECT DISTINCT b.g AS u, c.g AS w FROM b JOIN c USING (gene)),
    h(i, u, w, k) AS (SELECT 0, u, w, count(*) OVER (PARTITION BY u) FROM ab UNION ALL SELECT 1, u, w, count(*) OVER (PARTITION BY u) FROM bc),
    s AS (SELECT 0 AS i, g, 'present' AS word FROM (SELECT DISTINCT g FROM a) UNION ALL SELECT 1, g, CASE WHEN count(*) = 1 THEN 'singleton' ELSE 'novel' END FROM b WHERE g NOT IN (SELECT w FROM ab) GROUP BY g
        UNION ALL SELECT 2, g, CASE WHEN count(*) = 1 THEN 'singleton' ELSE 'novel' END FROM c WHERE g NOT IN (SELECT w FROM bc) GROUP BY g),
    t AS (SELECT i AS start_level, g AS start_group, i AS pos, g, word AS history FROM s UNION ALL SELECT start_level, start_group, pos + 1, h.w, history || CASE WHEN h.w IS NULL THEN ' lost' WHEN h.k = 1 THEN ' identical' ELSE ' duplicated' END
        FROM t LEFT JOIN h ON h.i = t.pos AND h.u = t.g WHERE t.pos < 2 AND t.g IS NOT NULL)
    SELECT start_level, start_group, pos AS end_level, g AS end_group, history FROM t WHERE g IS NULL OR pos = 2""".replace("WITH j", "WITH RECURSIVE j", 1))
def level_histories(spark: SparkSession, d: str) -> DataFrame:
    """Orders in groups of regions, nations and parts of nations, with members missing on each level."""
    who = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    each = table(spark, d, "orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
    group = lambda *c: F.concat_ws("/", *c).alias("group")
    gene, nation = F.col("o_orderkey").alias("gene"), F.col("c_nationkey").cast("string")
    top = each.where("o_orderstatus <> 'P'").select(group(F.col("n_regionkey").cast("string"), "o_orderstatus"), gene)
    middle = each.where("o_orderpriority < '4'").select(group(nation, "o_orderstatus"), gene)
    low = each.where("o_custkey % 3 <> 0 and o_orderpriority > '2'").select(group(nation, "o_orderstatus", (F.col("o_custkey") % 5).cast("string")), gene)
    return ancestry.level_histories([top, middle, low])
