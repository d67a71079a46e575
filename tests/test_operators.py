"""Small cases with known answers, brute-force versions, and a round trip for the file formats."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kinloom.functions import ids
from kinloom.operators import alignment, clustering, families, graph, hierarchy, packing, proteins
from kinloom.sources import text, trees


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda r: [(v is None, v) for v in r])


def test_components_match_a_search(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(None, 1), (5, 5)]
    got = dict(rows(graph.connected_components(spark.createDataFrame(edges, "u int, v int"), "u", "v")))
    near = {}
    for u, v in edges:
        if u is not None and u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    for n in near:
        seen, todo = set(), [n]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        assert got[n] == min(seen)
    assert got.keys() == near.keys()


def test_components_of_nothing(spark):
    assert rows(graph.connected_components(spark.createDataFrame([], "u int, v int"), "u", "v")) == []


def test_pairs_count_a_family_hit_twice_with_itself(spark):
    hits = [("p", 1, "A", 80.0), ("p", 2, "A", 90.0), ("p", 3, "B", 75.0), ("q", 1, "B", 70.0), ("q", 2, "C", 99.0)]
    got = families.candidate_pairs(spark.createDataFrame(hits, "prot string, hit_rank int, root string, score double"), "prot", "root", "score")
    assert rows(got) == [("A", "A", 1), ("A", "B", 2)]  # C is nobody's first hit


def test_rescue_goes_to_the_first_family_with_members(spark):
    hits = [("p", 1, "A", 90.0), ("p", 2, "X", 90.0), ("p", 3, "B", 70.0), ("q", 1, "B", 90.0), ("r", 1, "B", 90.0), ("s", 1, "C", 90.0), ("s", 2, "B", 69.9)]
    df = spark.createDataFrame(hits, "prot string, hit_rank int, root string, score double")
    assert rows(families.rescue_singletons(df, "prot", "root", "score"), "prot", "new_family") == [("p", "B")]


def test_isoform_ties_and_unmapped_genes(spark):
    forms = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "d", 0), (2, "e", 1)], "gene int, prot string, iso_rank int")
    scores = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 1.0)], "prot string, score double")
    assert rows(proteins.best_isoforms(forms, scores, "gene", "prot", "iso_rank")) == [(1, "b"), (2, "d")]


@pytest.mark.parametrize(("n", "want"), [(0, "a"), (25, "z"), (26, "aa"), (27, "ab"), (52, "ba"), (701, "zz"), (702, "aaa"), (18277, "zzz"), (18278, "aaaa")])
def test_letters(spark, n, want):
    assert spark.range(1).select(ids.letters(F.lit(n))).first()[0] == want


def test_numbers_run_on_over_ranges_and_stop_at_the_next_species(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("protein"), F.when(F.col("id") % 10 == 0, 2).otherwise(1).alias("species")).repartition(5)
    numbered = proteins.numeric_ids(df, "species", "species", "protein")
    got = {(r["species"], r["protein"]): r["numeric_id"] for r in numbered.collect()}
    want, seen = {}, {}
    for s, p in sorted(got):
        seen[s] = seen.get(s, 0) + 1
        want[s, p] = 1_000_000_000 + s * 1_000_000 + seen[s]
    assert len(got) == 1000 and got == want and numbered.columns == ["protein", "species", "numeric_id"]
    monkeypatch.setattr(proteins, "PER_SPECIES", 900)
    assert proteins.numeric_ids(df, "species", "species", "protein").count() == 1000
    monkeypatch.setattr(proteins, "PER_SPECIES", 899)
    with pytest.raises(Exception, match="more than 899 proteins in species 1"):
        proteins.numeric_ids(df, "species", "species", "protein").collect()


def test_placements_are_ranked_up_to_ten(spark):
    words = [f"w{i}" for i in range(20)]
    sequences = spark.createDataFrame([("s", " ".join(words)), ("none", "a b c d e f")], "seq string, text string")
    refs = spark.createDataFrame([(k, " ".join(words[: 5 + min(k, 10)])) for k in range(13)], "ref long, text string")
    got = rows(clustering.word_placements(sequences, refs, "seq", "ref", "text"), "hit_rank", "seq", "ref", "shared")
    order = sorted(range(13), key=lambda k: (-min(k, 10), k))[:10]
    assert got == [(n, "s", k, 1 + min(k, 10)) for n, k in enumerate(order, 1)]
    assert len(rows(clustering.word_placements(sequences, refs, "seq", "ref", "text", most=2))) == 2


def test_batches(spark):
    files = spark.createDataFrame([("s", n, i) for i, n in enumerate([500, 30, 40, 50, 10])], "g string, size long, id int")
    assert rows(packing.pack_batches(files, "g", "size", "id", alone=400, full=80), "size", "batch") == [(10, 2), (30, 2), (40, 1), (50, 1), (500, 0)]


def test_highly_connected_parts():
    triangle, path = {("a", "b"), ("b", "c"), ("a", "c")}, {("a", "b"), ("b", "c")}
    assert clustering.highly_connected(set("abc"), triangle) == [set("abc")]
    assert [len(p) for p in clustering.highly_connected(set("abc"), path)] == [2]
    two = triangle | {("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")}
    assert sorted(map(sorted, clustering.highly_connected(set("abcxyz"), two))) == [list("abc"), list("xyz")]


def test_minimum_cut_is_least():
    r = random.Random(5)
    for _ in range(20):
        nodes = list("abcdef")
        edges = {p for p in itertools.combinations(nodes, 2) if r.random() < 0.6}
        sides = [set(s) for k in (1, 2, 3) for s in itertools.combinations(nodes, k)]
        assert clustering.minimum_cut(nodes, edges)[0] == min(sum((a in s) != (b in s) for a, b in edges) for s in sides)


def groups(spark):
    """(1,(2,(3,4)D),(5,6)): one duplication."""
    tree = [("r", None, "S", 0), ("x", "r", "S", 1), ("d", "x", "D", 2), ("y", "r", "S", 3)]
    genes = [("r", 1), ("x", 2), ("d", 3), ("d", 4), ("y", 5), ("y", 6)]
    return spark.createDataFrame(tree, "node string, parent string, kind string, ord int"), spark.createDataFrame(genes, "node string, gene int")


def test_pairs_at_duplications(spark):
    tree, genes = groups(spark)
    up = hierarchy.closure(tree)
    assert rows(hierarchy.pairwise_relations(tree, genes, up, "D")) == [(3, 4)]
    assert len(rows(hierarchy.pairwise_relations(tree, genes, up, "S"))) == 14


def test_markers_keep_the_first_heaviest_child(spark):
    tree = spark.createDataFrame([("r", None, "D", 0), ("a", "r", "S", 1), ("b", "r", "S", 2)], "node string, parent string, kind string, ord int")
    genes = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4)], "node string, gene int")
    assert rows(hierarchy.marker_groups(tree, genes, hierarchy.closure(tree)), "gene") == [(1,), (2,)]


def test_newick_round_trip_and_ancestors(spark):
    newick = "((AQUAE:1,CHLTR:1)inter1:1,MYCGE:1)inter2:0;"
    table = trees.newick_rows(newick)
    assert [r[2] for r in table] == ["inter2", "inter1", "AQUAE", "CHLTR", "MYCGE"]
    assert trees.write_newick(table) == newick
    up = hierarchy.closure(spark.createDataFrame(table, trees.TREE))
    members = spark.createDataFrame([("f", 3), ("f", 4), ("g", 3), ("g", 5)], "fam string, leaf int")
    assert rows(hierarchy.common_ancestor(members, "fam", "leaf", up)) == [("f", 2), ("g", 1)]
    kept = hierarchy.prune(spark.createDataFrame(table, trees.TREE), up, spark.createDataFrame([(3,), (5,)], "node int"))
    assert sorted((r["node"], r["parent"] or 0) for r in kept.collect()) == [(1, 0), (3, 1), (5, 1)]


def test_group_xml_round_trip(spark, tmp_path):
    xml = (
        '<orthoXML><species name="s"><database><genes><gene id="1" protId="p1"/><gene id="2" protId="p2"/><gene id="3" protId="p3"/></genes></database></species><groups>'
        '<orthologGroup><score id="CompletenessScore" value="0.5"/><property name="TaxRange" value="top"/><paralogGroup><geneRef id="1"/><geneRef id="2"/></paralogGroup><geneRef id="3"/></orthologGroup></groups></orthoXML>'
    )
    (tmp_path / "a.xml").write_text(xml)
    got = trees.read_groups(spark, str(tmp_path))
    assert sorted(r["gene"] for r in got.where("kind = 'L'").collect()) == ["p1", "p2", "p3"]
    out = trees.group_xml(got).first()["xml"]
    assert out.count("geneRef") == 3 and out.startswith("<orthologGroup><score") and "<paralogGroup><geneRef" in out


def test_files(spark, tmp_path):
    (tmp_path / "X.fa").write_text(">sp|A|x one\nMKV\nAA\n>b\nMK\n")
    assert rows(text.read_fasta(spark, str(tmp_path / "X.fa"), 3), "species", "prot_id", "seq") == [("X", "sp|A|x", "MKVAA")]
    (tmp_path / "X.fa.hogmap").write_text("!a: b\nqseqid\thogid\nb\tHOG:E1.2a\tL\t80\t1\t2\tN/A\tN/A\t9\t9\t1\nb\tN/A\tN/A\tN/A\tN/A\tN/A\tN/A\tN/A\t9\tN/A\tN/A\n")
    assert rows(text.read_placements(spark, str(tmp_path / "X.fa.hogmap")), "species", "prot_id", "root_id", "hit_rank") == [("X", "b", "E1", 1), ("X", "b", None, 2)]
    (tmp_path / "X.splice").write_text("a;b;\nc\n")
    assert rows(text.read_splice(spark, str(tmp_path / "X.splice")), "gene", "prot_id") == [(0, "a"), (0, "b"), (1, "c")]


def test_identity_and_fragments(spark):
    got = spark.createDataFrame([("AC-T", "A-GT")], "a string, b string").select(*alignment.identity(F.col("a"), F.col("b"))).first()
    assert got[0] == pytest.approx(2 / 3) and got[1] == pytest.approx(2 / 3)
    msa = spark.createDataFrame([("s", "x", "ACGT----"), ("s", "y", "---TACGT"), ("t", "z", "ACGTACGT"), ("t", "w", "ACGTACGT")], "g string, m string, a string")
    assert rows(alignment.fragment_groups(alignment.spans(msa, "g", "m", "a"), "g", "m", 0.3)) == [("s",)]


def test_concatenation_fills_what_is_absent(spark):
    blocks = spark.createDataFrame([(1, "x", "AC"), (2, "x", "GGG"), (2, "y", "TTT")], "part int, m string, a string")
    assert rows(alignment.concatenate(blocks, "part", "m", "a")) == [("x", "ACGGG"), ("y", "XXTTT")]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_have_queries():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_set_differences_need_no_join(spark):
    """F8: keys of both sides in one aggregation; a null equals nothing."""
    left, right = (spark.createDataFrame([(k,) for k in keys], "k long") for keys in ([1, 1, 2, None, 3], [2, 4, 4, None]))
    got = proteins.set_differences(left, right, "k")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "left"), (3, "left"), (None, "left"), (4, "right"), (None, "right")], key=str)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_overlapping_groups_are_dealt(spark):
    """tasks follow the number of pairs, and an item in many groups is dealt; the pairs are those of a plain count."""
    r = random.Random(11)
    data = [(r.randrange(40), r.randrange(25)) for _ in range(400)] + [(g, 99) for g in range(40)] + [(None, 1), (1, None)]
    held = {}
    for g, i in data:
        if g is not None and i is not None:
            held.setdefault(i, set()).add(g)
    want = {}
    for gs in held.values():
        for p in itertools.combinations(sorted(gs), 2):
            want[p] = want.get(p, 0) + 1
    got = families.overlapping_groups(spark.createDataFrame(data, "g long, i long"), "g", "i", pairs=100, most=7)
    assert {(x["group_a"], x["group_b"]): x["shared"] for x in got.collect()} == want
    assert families.overlapping_groups(spark.createDataFrame([], "g long, i long"), "g", "i").count() == 0


def test_word_clusters_shuffle_digests_once(spark, monkeypatch):
    """runs go by digests and are made once; the clusters are as planted."""
    seen, plain = [], graph.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda links, *c: (seen.append(links), plain(links, *c))[1])
    data = [(1, "a b c d e"), (2, "x a b c"), (3, "x y z"), (4, "q x y z x y z"), (5, "a b"), (6, None)]
    got = clustering.word_clusters(spark.createDataFrame(data, "id long, t string"), "id", "t", size=3)
    assert rows(got, "id", "cluster") == [(1, 1), (2, 1), (3, 3), (4, 3)]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex" in plan and "size(array_distinct" not in plan


def test_common_ancestors_of_random_groups_and_of_several_trees(spark):
    r = random.Random(3)
    parent = {0: None, 1: None} | {n: r.randrange(n) for n in range(2, 40)}
    above = lambda n: [] if n is None else [n, *above(parent[n])]
    members = [(g, r.randrange(40)) for g in range(200) for _ in range(r.choice([1, 2, 3, 9]))] + [(None, 7), (5, None), (5, 99), (500, 99)]
    groups = {}
    for g, n in members:
        if n in parent:
            groups.setdefault(g, []).append(above(n))
    want = {g: next((n for n in lines[0] if all(n in line for line in lines)), None) for g, lines in groups.items()}
    assert None in want.values()
    up = hierarchy.closure(spark.createDataFrame(list(parent.items()), "node int, parent int"))
    got = hierarchy.common_ancestor(spark.createDataFrame(members, "fam int, leaf int"), "fam", "leaf", up)
    assert {x["fam"]: x["mrca"] for x in got.collect()} == want and got.count() == len(want)


def test_placements_carry_only_what_their_order_or_columns_need(spark):
    from kinloom.plans import domain

    made = domain._hits(spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" in plan and "l_shipdate" not in plan and "l_quantity" not in plan
    assert "root_f" not in made.columns
    kept = domain.hits(spark, "/root/testdata/sf0.001")
    assert kept.columns == ["prot", "species", "hit_rank", "part", "root_s", "root_f", "score"]
    assert kept.where("root_f <> part * 5 + root_s % 5").isEmpty() and kept.count() == made.count()


def test_pairs_of_families_carry_only_the_families(spark):
    hits = spark.createDataFrame([(1, 1, 7, 80.0), (1, 2, 7, 90.0), (1, 3, 5, 75.0), (1, 4, 9, 99.0), (2, 1, 5, 71.0), (2, 2, 7, 71.0), (2, 3, 5, 70.0)], "prot int, hit_rank int, fam int, score double")
    made = families.candidate_pairs(hits, "prot", "fam", "score")
    assert "collect_list(fam" in made._jdf.queryExecution().optimizedPlan().toString()
    assert rows(made) == [(5, 7, 3), (7, 7, 1)]
