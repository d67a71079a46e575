"""The registered queries: each calls an operator with the relational tables in the place of biological data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import ids
from kinloom.operators import alignment, clustering, families, hierarchy, intervals, packing, proteins, report
from kinloom.plans import domain
from kinloom.plans.domain import CELLS_SQL, HITS_SQL, PARTS_SQL, TREE_SQL, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Parameters that suit these tables; families there share far fewer proteins than in biology.
SHARED, RATIO, BIG = 3, 0.015, 150


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


FIRST = f"WITH {HITS_SQL}, firsts AS (SELECT * FROM hits WHERE hit_rank = 1)"
PAIRS = f"""WITH RECURSIVE {HITS_SQL}, good AS (
    SELECT * FROM hits WHERE score > 70 AND root_s IN (SELECT root_s FROM hits WHERE hit_rank = 1)), pairs AS (
    SELECT a.root_s AS family_a, b.root_s AS family_b, count(*) AS shared FROM good a JOIN good b ON a.prot = b.prot
        AND (a.root_s < b.root_s OR a.root_s = b.root_s AND (a.score < b.score OR a.score = b.score AND a.hit_rank < b.hit_rank)) GROUP BY 1, 2), sizes AS (
    SELECT root_s, count(*) AS n_hits FROM hits WHERE score > 70 GROUP BY root_s), edges AS (
    SELECT family_a, family_b, shared, a.n_hits AS size_a, b.n_hits AS size_b FROM pairs JOIN sizes a ON a.root_s = family_a JOIN sizes b ON b.root_s = family_b
    WHERE shared > {SHARED} AND greatest(a.n_hits, b.n_hits) < 50000 / 6.0 AND (shared / greatest(a.n_hits, b.n_hits) > {RATIO} OR shared / least(a.n_hits, b.n_hits) > {RATIO}))"""
SINGLE = f"""WITH RECURSIVE {HITS_SQL}, firsts AS (SELECT prot, root_f FROM hits WHERE hit_rank = 1), sizes AS (SELECT root_f, count(*) AS n FROM firsts GROUP BY root_f),
    single AS (SELECT prot, root_f FROM firsts JOIN sizes USING (root_f) WHERE n = 1), moved AS (
    SELECT s.prot, s.root_f, arg_min(h.root_f, h.hit_rank) AS new_family FROM single s JOIN hits h ON h.prot = s.prot
    JOIN sizes t ON t.root_f = h.root_f AND t.n > 1 WHERE h.hit_rank >= 2 AND h.score >= 70 GROUP BY 1, 2)"""


@query(f"{FIRST} SELECT root_f, count(*) AS n_members, count(DISTINCT species) AS n_species FROM firsts GROUP BY root_f")
def first_hit_families(spark: SparkSession, d: str) -> DataFrame:
    return families.family_members(domain.hits(spark, d), "prot", "root_f", "species")


@query(f"""{FIRST} SELECT root_f, count(*) AS n_members, count(DISTINCT species) AS n_species,
    round(count(DISTINCT species) / (SELECT CAST(count(*) AS DOUBLE) FROM nation), 4) AS completeness FROM firsts GROUP BY root_f""")
def family_completeness(spark: SparkSession, d: str) -> DataFrame:
    return families.completeness(first_hit_families(spark, d), table(spark, d, "nation").agg(F.count("*").alias("n_leaves")))


@query(f"WITH {HITS_SQL} SELECT root_s, count(*) AS n_hits FROM hits WHERE score > 70 GROUP BY root_s")
def hit_family_sizes(spark: SparkSession, d: str) -> DataFrame:
    return families.hit_family_sizes(domain.hits(spark, d), "root_s", "score")


@query(f"{PAIRS} SELECT family_a, family_b, shared FROM pairs")
def family_pairs(spark: SparkSession, d: str) -> DataFrame:
    return families.candidate_pairs(domain.hits(spark, d), "prot", "root_s", "score")


@query(f"{PAIRS} SELECT family_a, family_b, shared, size_a, size_b FROM edges")
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    return families.merge_edges(family_pairs(spark, d), hit_family_sizes(spark, d), "root_s", shared=SHARED, ratio_max=RATIO, ratio_min=RATIO)


COMPONENTS = f"""{PAIRS}, e AS (SELECT family_a AS u, family_b AS v FROM edges WHERE family_a <> family_b UNION SELECT family_b, family_a FROM edges WHERE family_a <> family_b),
    t AS (SELECT u AS node, u AS m FROM e UNION SELECT e.v, t.m FROM t JOIN e ON e.u = t.node WHERE t.m < e.v), parts AS (SELECT node, min(m) AS component FROM t GROUP BY node)"""


@query(f"{COMPONENTS} SELECT node, component FROM parts")
def family_components(spark: SparkSession, d: str) -> DataFrame:
    return families.family_components(merge_candidates(spark, d))


@query()
def hcs_clusters(spark: SparkSession, d: str) -> DataFrame:
    edges = merge_candidates(spark, d)
    return clustering.connected_clusters(edges, families.family_components(edges))


@query(f"""{COMPONENTS}, n AS (SELECT root_s, count(*) AS n FROM hits WHERE hit_rank = 1 GROUP BY root_s), put AS (
    SELECT root_s, component, coalesce(sum(n) OVER (PARTITION BY component ORDER BY root_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n JOIN parts ON node = root_s)
    SELECT root_s, CASE WHEN b < 300 THEN component ELSE root_s END AS host FROM put""")
def capped_merge(spark: SparkSession, d: str) -> DataFrame:
    firsts = families.first_hits(domain.hits(spark, d)).select("prot", "root_s")
    return families.capped_merge(firsts, family_components(spark, d), "root_s", cap=300)


@query(f"{SINGLE} SELECT prot, root_f, new_family FROM moved")
def singleton_rescue(spark: SparkSession, d: str) -> DataFrame:
    return families.rescue_singletons(domain.hits(spark, d), "prot", "root_f", "score")


@query(f"""{SINGLE}, left_ AS (SELECT * FROM single WHERE prot NOT IN (SELECT prot FROM moved)), links AS (
    SELECT DISTINCT l.prot, h.root_f AS alt FROM left_ l JOIN hits h ON h.prot = l.prot WHERE h.hit_rank >= 2 AND h.score >= 70), e AS (
    SELECT DISTINCT a.prot AS u, b.prot AS v FROM links a JOIN links b ON a.alt = b.alt AND a.prot <> b.prot), t AS (
    SELECT u AS node, u AS m FROM e UNION SELECT e.v, t.m FROM t JOIN e ON e.u = t.node WHERE t.m < e.v), parts AS (SELECT node, min(m) AS c FROM t GROUP BY node)
    SELECT prot, root_f, min(root_f) OVER (PARTITION BY c) AS cluster FROM parts JOIN left_ ON prot = node""")
def singleton_clusters(spark: SparkSession, d: str) -> DataFrame:
    return families.cluster_singletons(domain.hits(spark, d), "prot", "root_f", "score")


@query(f"""{FIRST}, n AS (SELECT root_s, count(*) AS n FROM firsts GROUP BY root_s)
    SELECT prot, root_s, score FROM firsts JOIN n USING (root_s) WHERE n <= {BIG} OR score > 95""")
def big_family_filter(spark: SparkSession, d: str) -> DataFrame:
    return families.big_family_filter(domain.hits(spark, d), "root_s", "score", big=BIG).select("prot", "root_s", "score")


@query(f"""WITH {HITS_SQL}, a AS (SELECT prot, part, score, row_number() OVER (PARTITION BY prot ORDER BY score, part) AS r FROM hits), b AS (
    SELECT prot, part, score, row_number() OVER (PARTITION BY part ORDER BY score, prot) AS s FROM a WHERE r = 1) SELECT part, prot, score FROM b WHERE s = 1""")
def dedup_best(spark: SparkSession, d: str) -> DataFrame:
    return families.best_per_item_then_target(domain.hits(spark, d), "prot", "part", "score", "hit_rank").select("part", "prot", "score")


@query(f"""{FIRST}, p AS (SELECT prot, species, root_s, part FROM firsts), a AS (SELECT prot, species, 'S' || root_s AS g FROM p UNION ALL SELECT prot, species, 'S' || root_s || '/' || part FROM p)
    SELECT DISTINCT a.prot AS item_a, b.prot AS item_b, a.g AS "group" FROM a JOIN p b ON a.g = 'S' || b.root_s || '/' || b.part AND a.species <> b.species""")
def ancestor_pairs(spark: SparkSession, d: str) -> DataFrame:
    top = F.concat(F.lit("S"), F.col("root_s").cast("string"))
    path = F.array(top, F.concat_ws("/", top, F.col("part").cast("string")))
    return families.ancestor_pairs(families.first_hits(domain.hits(spark, d)).withColumn("path", path), "prot", "species", "path")


ISOFORMS = f"""WITH {HITS_SQL}, s AS (SELECT prot, max(score) AS score FROM hits GROUP BY prot), i AS (
    SELECT o_custkey AS gene, o_orderkey AS prot, score FROM orders LEFT JOIN s ON prot = o_orderkey), r AS (
    SELECT *, row_number() OVER (PARTITION BY gene ORDER BY score IS NULL, score DESC, CASE WHEN score IS NULL THEN prot ELSE -prot END) AS r FROM i)"""


@query(f"{ISOFORMS} SELECT gene, prot FROM r WHERE r = 1")
def best_isoform(spark: SparkSession, d: str) -> DataFrame:
    scores = domain.hits(spark, d).groupBy("prot").agg(F.max("score").alias("score"))
    forms = table(spark, d, "orders").select(F.col("o_custkey").alias("gene"), F.col("o_orderkey").alias("prot"), F.col("o_orderkey").alias("iso_rank"))
    return proteins.best_isoforms(forms, scores, "gene", "prot", "iso_rank")


@query(f"{ISOFORMS} SELECT prot, hit_rank FROM hits WHERE prot NOT IN (SELECT prot FROM r WHERE r > 1)")
def isoform_filter(spark: SparkSession, d: str) -> DataFrame:
    forms = table(spark, d, "orders").select(F.col("o_orderkey").alias("prot"))
    return proteins.drop_minor_isoforms(domain.hits(spark, d), forms, best_isoform(spark, d), "prot").select("prot", "hit_rank")


@query(f"""{SINGLE} SELECT o_orderkey AS prot, 'unmapped' AS reason FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT prot, 'singleton' FROM single""")
def unmapped_union_singletons(spark: SparkSession, d: str) -> DataFrame:
    firsts = families.first_hits(domain.hits(spark, d))
    single = firsts.groupBy("root_f").agg(F.count("*").alias("n"), F.min("prot").alias("prot")).where("n = 1")
    return proteins.unmapped_and_single(table(spark, d, "orders").withColumnRenamed("o_orderkey", "prot"), firsts, single, "prot")


@query("SELECT c_custkey, 1000000000 + c_nationkey * 1000000 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS numeric_id FROM customer")
def numeric_ids(spark: SparkSession, d: str) -> DataFrame:
    return proteins.numeric_ids(table(spark, d, "customer"), "c_nationkey", "c_nationkey", "c_custkey").select("c_custkey", "numeric_id")


@query("SELECT lang, residue, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '(?s).')) AS residue FROM documents) GROUP BY lang, residue")
def residue_histogram(spark: SparkSession, d: str) -> DataFrame:
    return proteins.residue_histogram(table(spark, d, "documents"), "lang", "text")


@query("""SELECT lang, CAST(sum(length(text)) AS BIGINT) AS n_chars, round(sum(length(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g'))) / sum(length(text)), 4) AS share,
    sum(length(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g'))) / sum(length(text)) >= 0.2 AS passes FROM documents GROUP BY lang""")
def composition_check(spark: SparkSession, d: str) -> DataFrame:
    return proteins.composition(table(spark, d, "documents"), "lang", "text")


@query("SELECT source, count(*) AS n, CAST(max(length(text)) AS BIGINT) AS longest FROM documents WHERE length(text) >= 50 GROUP BY source")
def length_filter_stats(spark: SparkSession, d: str) -> DataFrame:
    kept = proteins.length_filter(table(spark, d, "documents"), "text", 50)
    return kept.groupBy("source").agg(F.count("*").alias("n"), F.max(F.length("text")).cast("long").alias("longest"))


@query("""SELECT c_nationkey, count(*) AS n, count(*) - count(DISTINCT c_mktsegment) AS n_duplicates, CAST(max(length(c_mktsegment)) AS INTEGER) AS longest_id,
    count(*) > 2 AND count(*) = count(DISTINCT c_mktsegment) AND max(length(c_mktsegment)) <= 60 AS passes FROM customer GROUP BY c_nationkey""")
def id_checks(spark: SparkSession, d: str) -> DataFrame:
    return proteins.id_checks(table(spark, d, "customer"), "c_nationkey", "c_mktsegment")


@query("""SELECT o_orderkey AS prot, 'left' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT DISTINCT l_orderkey, 'right' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def set_differences(spark: SparkSession, d: str) -> DataFrame:
    return proteins.set_differences(table(spark, d, "orders").withColumnRenamed("o_orderkey", "prot"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "prot"), "prot")


@query("SELECT p_partkey, 'P' || p_partkey AS accession, CAST(p_size AS VARCHAR) AS root FROM part")
def header_and_root(spark: SparkSession, d: str) -> DataFrame:
    header = F.concat(F.lit("sp|P"), F.col("p_partkey").cast("string"), F.lit("|"), F.col("p_name"))
    placed = F.concat(F.lit("HOG:"), F.col("p_size").cast("string"), F.lit(".1a.2b"))
    return table(spark, d, "part").select("p_partkey", ids.header_transformer("accession")(header).alias("accession"), ids.root_id(placed).alias("root"))


@query("""WITH RECURSIVE d AS (SELECT source, coalesce(n_chars, 0) AS n, doc_id, row_number() OVER (PARTITION BY source ORDER BY coalesce(n_chars, 0) DESC, doc_id) AS i FROM documents), t AS (
    SELECT source, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS batch, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS total FROM d GROUP BY source UNION ALL
    SELECT source, i, doc_id, n, b0, CASE WHEN n > 40000 OR t0 + n > 200000 THEN b0 + 1 ELSE b0 END, CASE WHEN n > 40000 OR t0 + n > 200000 THEN 0 ELSE t0 + n END FROM (
        SELECT d.source, d.i, d.doc_id, d.n, CASE WHEN d.n > 40000 AND total > 0 THEN b + 1 ELSE b END AS b0, CASE WHEN d.n > 40000 AND total > 0 THEN 0 ELSE total END AS t0 FROM t JOIN d ON d.source IS NOT DISTINCT FROM t.source AND d.i = t.i + 1))
    SELECT source, n AS n_chars, doc_id, batch FROM t WHERE i > 0""")
def batch_packing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("n_chars", F.coalesce("n_chars", F.lit(0)))
    return packing.pack_batches(docs, "source", "n_chars", "doc_id", alone=40_000, full=200_000)


CLOSURE = f"""WITH RECURSIVE {TREE_SQL}, up AS (SELECT node, node AS ancestor, 0 AS distance FROM tree
    UNION ALL SELECT up.node, tree.parent, distance + 1 FROM up JOIN tree ON tree.node = up.ancestor WHERE tree.parent IS NOT NULL)"""


@query(f"{CLOSURE} SELECT node, ancestor, distance FROM up")
def taxon_closure(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.closure(domain.species_tree(spark, d))


@query(f"{CLOSURE} SELECT ancestor AS node, count(*) AS n_leaves FROM up WHERE node NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL) GROUP BY ancestor")
def taxon_sizes(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.leaf_counts(domain.species_tree(spark, d), taxon_closure(spark, d))


@query(f"""{FIRST}, m AS (SELECT part, count(DISTINCT species) AS n, count(DISTINCT n_regionkey) AS r, min(species) AS s, min(n_regionkey) AS g
    FROM firsts JOIN nation ON n_nationkey = species GROUP BY part) SELECT part, CASE WHEN n = 1 THEN 'N' || s WHEN r = 1 THEN 'R' || g ELSE 'WORLD' END AS mrca FROM m""")
def mrca_of_part(spark: SparkSession, d: str) -> DataFrame:
    members = families.first_hits(domain.hits(spark, d)).select("part", F.concat(F.lit("N"), F.col("species").cast("string")).alias("leaf"))
    return hierarchy.common_ancestor(members, "part", "leaf", taxon_closure(spark, d))


@query(f"""WITH {HITS_SQL}, c AS (SELECT DISTINCT part, root_s % 3 AS child, species FROM hits), k AS (SELECT part, count(DISTINCT child) AS k FROM c GROUP BY part), e AS (
    SELECT part, species, count(*) AS m FROM c GROUP BY part, species), s AS (
    SELECT part, sum(CASE WHEN m = k THEN 1 ELSE 0 END) AS i, count(*) AS u FROM e JOIN k USING (part) WHERE k > 1 GROUP BY part)
    SELECT part, CAST(i AS BIGINT) AS n_inter, u AS n_union, round(i / u, 4) AS overlap, CASE WHEN i / u > 0.1 THEN 'D' ELSE 'S' END AS kind FROM s""")
def species_overlap(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.species_overlap(domain.hits(spark, d).withColumn("child", F.col("root_s") % 3), "part", "child", "species", threshold=0.1)


def encoded_parts(spark, d):
    groups, genes = domain.part_groups(spark, d)
    return intervals.encode(groups), genes


@query(f"""WITH {PARTS_SQL}, w5 AS (SELECT n1, n2, n3, n4, n5, count(*) AS w FROM p GROUP BY ALL), k5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n4 ORDER BY w DESC, n5) AS r FROM w5) WHERE r = 1),
    w3 AS (SELECT n2, n3, sum(w) AS w FROM k5 GROUP BY ALL), k3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n2 ORDER BY w DESC, n3) AS r FROM w3) WHERE r = 1),
    kept AS (SELECT p.n1, gene FROM p JOIN k5 USING (n5) JOIN k3 ON k3.n3 = p.n3)
    SELECT n1 AS root, gene FROM kept WHERE n1 IN (SELECT n1 FROM kept GROUP BY n1 HAVING count(*) > 1)""")
def marker_groups(spark: SparkSession, d: str) -> DataFrame:
    return intervals.marker_groups(*encoded_parts(spark, d))


@query(f"""WITH {PARTS_SQL}, d1 AS (SELECT node, row_number() OVER (PARTITION BY fam ORDER BY ord) AS n FROM g WHERE kind = 'D' AND parent NOT IN (SELECT node FROM g WHERE level = 'type')),
    d2 AS (SELECT node, row_number() OVER (PARTITION BY fam ORDER BY ord) AS n FROM g WHERE kind = 'D' AND parent IN (SELECT node FROM g WHERE level = 'type')),
    l3 AS (SELECT g.node, printf('HOG:%07d', fam) || '.' || n || chr(CAST(97 + place AS INTEGER)) AS id FROM g JOIN d1 ON g.parent = d1.node),
    l5 AS (SELECT g.node, l3.id || '.' || n || chr(CAST(97 + g.place AS INTEGER)) AS id FROM g JOIN d2 ON g.parent = d2.node JOIN g h ON h.node = g.parent JOIN l3 ON l3.node = h.parent)
    SELECT node, printf('HOG:%07d', fam) AS hog_id FROM g WHERE level = 'brand' UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l5""")
def duplication_ids(spark: SparkSession, d: str) -> DataFrame:
    return intervals.duplication_ids(encoded_parts(spark, d)[0])


@query(f"""WITH {PARTS_SQL}, n AS (SELECT unnest([n1, n2, n3, n4, n5]) AS node, gene FROM p)
    SELECT node, count(*) AS n_genes, any_value(parent IS NULL) AS is_root, any_value(level) AS level FROM n JOIN g USING (node) GROUP BY node""")
def group_statistics(spark: SparkSession, d: str) -> DataFrame:
    return intervals.group_statistics(*encoded_parts(spark, d), "level")


@query("SELECT p_brand AS root, p_partkey AS gene FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) > 1)")
def root_groups(spark: SparkSession, d: str) -> DataFrame:
    return intervals.root_groups(*encoded_parts(spark, d))


@query(f"WITH {PARTS_SQL} SELECT n3 AS node, gene FROM p")
def level_slice(spark: SparkSession, d: str) -> DataFrame:
    return intervals.groups_at_level(*encoded_parts(spark, d), F.col("level") == "type")


@query(f"""WITH {PARTS_SQL}, n AS (SELECT unnest([n1, n2, n3, n4, n5]) AS node, gene FROM p), v AS (SELECT node, any_value(parent) AS parent, any_value(kind) AS kind FROM n JOIN g USING (node) GROUP BY node HAVING count(*) >= 2),
    k5 AS (SELECT n5 AS node FROM p JOIN v ON node = n5 GROUP BY n5), k4 AS (SELECT node FROM v WHERE node IN (SELECT parent FROM v WHERE node IN (SELECT node FROM k5))),
    k3 AS (SELECT node FROM v WHERE node IN (SELECT parent FROM v WHERE node IN (SELECT node FROM k4))), k2 AS (SELECT node FROM v WHERE node IN (SELECT parent FROM v WHERE node IN (SELECT node FROM k3))),
    k1 AS (SELECT node FROM v WHERE node IN (SELECT parent FROM v WHERE node IN (SELECT node FROM k2)))
    SELECT node FROM k5 UNION ALL SELECT node FROM k4 UNION ALL SELECT node FROM k3 UNION ALL SELECT node FROM k2 UNION ALL SELECT node FROM k1""")
def filter_cascade(spark: SparkSession, d: str) -> DataFrame:
    valued = intervals.group_sizes(*encoded_parts(spark, d)).withColumn("value", F.col("n_genes").cast("double"))
    return hierarchy.filter_cascade(valued, "value", 2.0).select("node")


CUSTOMERS = "WITH c AS (SELECT c_custkey AS g, c_custkey // 30 AS f, n_regionkey AS r, c_nationkey AS n FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(f"{CUSTOMERS} SELECT a.g AS gene_a, b.g AS gene_b FROM c a JOIN c b ON a.f = b.f AND a.g < b.g AND (a.r <> b.r OR a.n = b.n)")
def pairwise_orthologs(spark: SparkSession, d: str) -> DataFrame:
    groups, genes = domain.customer_groups(spark, d)
    return intervals.pairwise_relations(intervals.encode(groups), genes, "S")


@query(f"{CUSTOMERS} SELECT a.g AS gene_a, b.g AS gene_b FROM c a JOIN c b ON a.f = b.f AND a.g < b.g AND a.r = b.r AND a.n <> b.n")
def pairwise_paralogs(spark: SparkSession, d: str) -> DataFrame:
    groups, genes = domain.customer_groups(spark, d)
    return intervals.pairwise_relations(intervals.encode(groups), genes, "D")


@query("""WITH j AS (SELECT o_orderkey AS gene, o_orderstatus <> 'P' AS upper, o_orderpriority < '4' AS lower, n_regionkey || '/' || o_orderstatus AS u,
        c_nationkey || '/' || o_orderstatus || CASE WHEN o_orderstatus = 'P' THEN '/' || o_custkey % 40 ELSE '' END AS w FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    m AS (SELECT DISTINCT CASE WHEN upper THEN u END AS u, CASE WHEN lower THEN w END AS w FROM j WHERE upper OR lower), k AS (SELECT u, count(w) AS n FROM m WHERE u IS NOT NULL GROUP BY u),
    f AS (SELECT w, count(u) AS n FROM m WHERE w IS NOT NULL GROUP BY w HAVING count(u) = 0), z AS (SELECT w, count(*) AS size FROM j WHERE lower GROUP BY w)
    SELECT u AS "group", n AS n_children, CASE WHEN n = 0 THEN 'lost' WHEN n = 1 THEN 'identical' ELSE 'duplicated' END AS event FROM k
    UNION ALL SELECT w, 0, CASE WHEN size = 1 THEN 'singleton' ELSE 'novel' END FROM f JOIN z USING (w)""")
def level_comparison(spark: SparkSession, d: str) -> DataFrame:
    who = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    each = table(spark, d, "orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
    upper = F.concat_ws("/", F.col("n_regionkey").cast("string"), "o_orderstatus").alias("group")
    fine = F.when(F.col("o_orderstatus") == "P", (F.col("o_custkey") % 40).cast("string"))
    lower = F.concat_ws("/", F.col("c_nationkey").cast("string"), "o_orderstatus", fine).alias("group")
    gene = F.col("o_orderkey").alias("gene")
    return hierarchy.level_comparison(each.where("o_orderstatus <> 'P'").select(upper, gene), each.where("o_orderpriority < '4'").select(lower, gene))


@query(f'WITH {CELLS_SQL} SELECT "group", place, round(avg(CAST(is_gap AS INTEGER)), 6) AS gap_ratio FROM cells GROUP BY 1, 2')
def gap_ratio_columns(spark: SparkSession, d: str) -> DataFrame:
    return alignment.column_gaps(domain.cells(spark, d)).withColumn("gap_ratio", F.round("gap_ratio", 6)).withColumn("place", F.col("place").cast("long"))


@query(f'WITH {CELLS_SQL} SELECT "group", member, round(avg(1 - CAST(is_gap AS INTEGER)), 6) AS residue_ratio FROM cells GROUP BY 1, 2')
def residue_ratio_rows(spark: SparkSession, d: str) -> DataFrame:
    return alignment.row_residues(domain.cells(spark, d)).withColumn("residue_ratio", F.round("residue_ratio", 6))


@query(f"""WITH {CELLS_SQL}, c AS (SELECT "group", place, avg(CAST(is_gap AS INTEGER)) AS g FROM cells GROUP BY 1, 2), one AS (
    SELECT cells.* FROM cells JOIN c USING ("group", place) WHERE g < 0.5), r AS (SELECT "group", member, avg(1 - CAST(is_gap AS INTEGER)) AS v FROM one GROUP BY 1, 2), two AS (
    SELECT one.* FROM one JOIN r USING ("group", member) WHERE v >= 0.45), w AS (SELECT "group", bool_and(v >= 0.45) AS w FROM r GROUP BY 1), e AS (
    SELECT "group", place, bool_and(is_gap) AS e FROM two GROUP BY 1, 2)
    SELECT "group", member, place FROM two JOIN w USING ("group") JOIN e USING ("group", place) WHERE w OR NOT e""")
def alignment_filter(spark: SparkSession, d: str) -> DataFrame:
    return alignment.filter_alignment(domain.cells(spark, d), residue_ratio_row=0.45).select("group", "member", F.col("place").cast("long").alias("place"))


@query(f"""WITH {CELLS_SQL}, c AS (SELECT "group", place, avg(CAST(is_gap AS INTEGER)) AS g FROM cells GROUP BY 1, 2), a AS (
    SELECT "group", g, round(abs(g - (rank() OVER (PARTITION BY "group" ORDER BY g) - 1) / count(*) OVER (PARTITION BY "group")), 9) AS away FROM c), r AS (
    SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY away DESC, g) AS r FROM a) SELECT "group", round(g, 6) AS elbow FROM r WHERE r = 1""")
def elbow_threshold(spark: SparkSession, d: str) -> DataFrame:
    return alignment.elbow(alignment.column_gaps(domain.cells(spark, d))).withColumn("elbow", F.round("elbow", 6))


@query(f"""WITH {CELLS_SQL} SELECT "group", place, CASE WHEN bool_and(is_gap) THEN '-' ELSE 'A' END AS residue FROM cells GROUP BY 1, 2""")
def consensus(spark: SparkSession, d: str) -> DataFrame:
    return alignment.consensus(domain.cells(spark, d)).withColumn("place", F.col("place").cast("long"))


@query("""SELECT user_id, event_id, next_member, overlap FROM (SELECT user_id, event_id, lead(event_id) OVER w AS next_member, floor(epoch(ts))::BIGINT + 3600 - lead(floor(epoch(ts))::BIGINT) OVER w AS overlap
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT, event_id)) WHERE next_member IS NOT NULL""")
def fragment_adjacency(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("start"))
    return alignment.fragment_neighbours(ev.withColumn("end", F.col("start") + 3600), "user_id", "event_id", "start", "end")


@query("""WITH w AS (SELECT DISTINCT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents), b AS (
    SELECT item_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark), x AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)), y AS (
    SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)), m AS (
    SELECT doc_id, item_id, count(*) AS shared FROM x JOIN y USING (g) GROUP BY 1, 2)
    SELECT doc_id, item_id, shared, CAST(r AS INTEGER) AS hit_rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, item_id) AS r FROM m) WHERE r <= 10""")
def word_placements(spark: SparkSession, d: str) -> DataFrame:
    return clustering.word_placements(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", "text")


@query("""SELECT c_nationkey, count(*) AS n_proteins, count(o) AS n_in_group, count(*) - count(o) AS n_not_in_group, round(count(o) / count(*), 4) AS fraction
    FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON o = c_custkey GROUP BY c_nationkey""")
def species_report(spark: SparkSession, d: str) -> DataFrame:
    has = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    return report.species_summary(table(spark, d, "customer").join(has, "c_custkey", "left"), "c_nationkey", F.col("has").isNotNull())


@query(f"""{FIRST}, n AS (SELECT root_f, CAST(count(*) AS DOUBLE) AS n FROM firsts GROUP BY root_f) SELECT count(*) AS n, round(avg(n), 4) AS mean, round(stddev(n), 4) AS stddev, min(n) AS least,
    round(quantile_cont(n, 0.25), 4) AS q25, round(quantile_cont(n, 0.5), 4) AS q50, round(quantile_cont(n, 0.75), 4) AS q75, max(n) AS greatest FROM n""".replace("AS n, round(avg(n)", "AS n, round(avg(n.n)"))
def describe_sizes(spark: SparkSession, d: str) -> DataFrame:
    return report.describe(first_hit_families(spark, d), "n_members")


@query(f"""{FIRST}, c AS (SELECT root_f, round(count(DISTINCT species) / (SELECT CAST(count(*) AS DOUBLE) FROM nation), 4) AS value FROM firsts GROUP BY root_f)
    SELECT DISTINCT value, round(cume_dist() OVER (ORDER BY value), 6) AS share FROM c""")
def completeness_ecdf(spark: SparkSession, d: str) -> DataFrame:
    return report.cumulative_share(family_completeness(spark, d), "completeness")


@query(f"""{FIRST} SELECT root_s, {", ".join(f"count(*) FILTER (n_regionkey = {i}) AS n_{i}" for i in range(5))} FROM firsts JOIN nation ON n_nationkey = species GROUP BY root_s""")
def composition_pivot(spark: SparkSession, d: str) -> DataFrame:
    firsts = families.first_hits(domain.hits(spark, d)).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("species"))
    return report.composition_counts(firsts, "root_s", "n_regionkey", list(range(5)))
