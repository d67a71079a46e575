"""Selections from documents of groups against plain searches, documents of several files, merged members."""

import random

import pytest

from kinloom.operators import families, hierarchy, intervals, proteins, selections
from kinloom.sources import trees

GROUPS = "fam long, node string, parent string, kind string, level string, score double, gene string, ord long"


def forest(seed):
    """Random families: rows, and the parent of each node."""
    rng, rows = random.Random(seed), []
    for fam in range(1, 5):
        inner = [f"{fam}"]
        rows.append((fam, inner[0], None, "S", "root", 0.5, None, 0))
        for k in range(12):
            up = rng.choice(inner)
            node, kind = f"{up}/{k}", rng.choice("SD")
            inner.append(node)
            rows.append((fam, node, up, kind, rng.choice(["a", "b", None]) if kind == "S" else None, rng.choice([None, 0.25, 1.0]), None, k))
        for k in range(15):
            up = rng.choice(inner)
            rows.append((fam, f"{up}/g{k}", up, "L", None, None, rng.choice([f"{fam * 100 + k}", "7", None]), 50 + k))
    return rows, {r[1]: r[2] for r in rows}


def above(node, parents):
    out = []
    while parents[node] is not None:
        node = parents[node]
        out.append(node)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_below_and_groups_around(spark, seed):
    rows, parents = forest(seed)
    groups = spark.createDataFrame(rows, GROUPS).repartition(3)
    kind, level = {r[1]: r[3] for r in rows}, {r[1]: r[4] for r in rows}
    wanted = selections.groups_at_levels(groups, spark.createDataFrame([("a",), ("a",), (None,), ("x",)], "level string"))
    tops = {n for n in kind if level[n] == "a"}
    assert {r["node"] for r in wanted.collect()} == tops and wanted.count() == len(tops)
    for kinds in ("SDL", "L"):
        got = [(r["holder"], r["node"]) for r in selections.below(groups, wanted, kinds).collect()]
        assert sorted(got) == sorted((t, n) for n in kind if kind[n] in kinds for t in above(n, parents) if t in tops)
    near = {(r["holder"], r["node"]) for r in selections.below(groups, wanted, direct=True).collect()}
    assert near == {(p, n) for n, p in parents.items() if p in tops}
    asked = spark.createDataFrame([("7",), ("7",), ("101",), ("none",), (None,)], "gene string")
    got = sorted((r["gene"], r["rank"], r["node"], r["kind"], r["level"] or "") for r in selections.groups_of_genes(groups, asked).collect())
    want = [(r[6], k, n, kind[n], level[n] or "") for r in rows if r[6] in ("7", "101") for k, n in enumerate(reversed(above(r[1], parents)), 1)]
    assert got == sorted(want)
    assert {r["node"] for r in selections.top_groups(groups).collect()} == {"1", "2", "3", "4"}
    counts = {r["level"]: r["n_groups"] for r in selections.level_counts(groups).collect()}
    assert counts == {x: sum(level[n] == x for n in kind) for x in set(level.values()) - {None}}
    assert {r["node"] for r in selections.scored_groups(groups, 0.5).collect()} == {r[1] for r in rows if r[5] is not None and r[5] >= 0.5}


def test_genes_of_documents(spark):
    rows, _ = forest(3)
    groups = spark.createDataFrame(rows, GROUPS)
    genes = spark.createDataFrame([(f"s{i % 3}", i, f"p{i}") for i in range(95, 420)] + [("s1", 7, "often"), (None, 8, None)], "species string, id long, prot string")
    uses = {}
    for r in rows:
        if r[3] == "L" and r[6]:
            uses.setdefault(r[6], []).append(r[0])
    got = {r["id"]: (r["n_places"], r["n_families"]) for r in selections.gene_uses(groups, genes).collect()}
    assert len(got) == genes.count() and all(v == (len(uses.get(str(k), [])), len(set(uses.get(str(k), [])))) for k, v in got.items())
    one = {r["id"] for r in selections.grouped_genes(groups, genes, "s1").collect()}
    assert one == {i for i in got if got[i][0] and (i == 7 or i % 3 == 1)}
    none = {r["id"] for r in selections.ungrouped_genes(groups, genes).collect()}
    assert none == {i for i in got if not got[i][0]}
    asked = spark.createDataFrame([("s0",), ("s1",), ("s1",), (None,)], "species string")
    some, every = (selections.families_of_species(groups, genes, asked, e).collect() for e in (False, True))
    of = {str(r["id"]): r["species"] for r in genes.collect()}
    want = {f: {of[g] for g, fs in uses.items() if f in fs and of.get(g) in ("s0", "s1")} for f in range(1, 5)}
    assert {r["fam"]: r["n_species"] for r in some} == {f: len(w) for f, w in want.items() if w}
    assert {r["fam"] for r in every} == {f for f, w in want.items() if len(w) == 2}
    assert [r["prot"] for r in selections.genes_by_id(genes, spark.createDataFrame([(7,), (7,), (None,)], "id long")).collect()] == ["often"]
    with pytest.raises(Exception, match="several genes have the id 7"):
        selections.genes_by_id(genes.union(genes), spark.createDataFrame([(7,)], "id long")).collect()


def test_selections_of_nothing(spark):
    groups, genes = spark.createDataFrame([], GROUPS), spark.createDataFrame([("s", 1, "p")], "species string, id long, prot string")
    assert selections.below(groups, groups).count() == selections.groups_of_genes(groups, groups).count() == 0
    assert selections.ungrouped_genes(groups, genes).count() == 1
    assert selections.families_of_species(groups, genes, genes, every=True).count() == 0


@pytest.mark.parametrize("part", ["150", "1m"])
def test_documents_of_several_files_are_read_whole(spark, tmp_path, part):
    rows, _ = forest(4)
    rows = [r for r in rows if r[6] != "7" and not (r[3] == "L" and r[6] is None)]
    groups = spark.createDataFrame(rows, GROUPS)
    genes = spark.createDataFrame([("s<1>", int(r[6]), f"p&{r[6]}") for r in rows if r[6]], "species string, id long, prot string")
    lines = trees.group_document(genes, trees.group_xml(groups), "<taxonomy></taxonomy>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small files would be put together
    try:
        trees.write_document(lines, str(tmp_path / "doc"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(list((tmp_path / "doc").glob("part-*"))) > 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", part)
    try:
        back = trees.read_groups(spark, str(tmp_path / "doc"), whole=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["fam"], r["kind"], r["level"] or "", r["score"] or 0, r["gene"] or "") for r in back) == sorted((r[0], r[3], r[4] or "", r[5] or 0, f"p&{r[6]}" if r[6] else "") for r in rows)
    assert len({r["node"] for r in back}) == len(rows)


def test_members_of_merged_families_are_counted_once(spark):
    members = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", 3), (None, 4), ("a", None)], "fam string, item int")
    hosts = spark.createDataFrame([("a", "a"), ("b", "a"), ("z", "z")], "fam string, host string")
    got = {(r["host"], r["item"]): r["is_new"] for r in families.merged_members(members, hosts, "fam", "item").collect()}
    assert got == {("a", 1): False, ("a", 2): True, ("c", 3): False}


def test_species_are_numbered_by_name(spark):
    rows = [("b", 2), ("a", 9), ("b", 1), (None, 3), ("c", 4)]
    placed = proteins.species_index(spark.createDataFrame(rows, "sp string, p int"), "sp")
    assert sorted((r["sp"], r["p"], r["species_index"]) for r in placed.collect()) == [("a", 9, 0), ("b", 1, 1), ("b", 2, 1), ("c", 4, 2)]
    ids = proteins.numeric_ids(placed, "sp", "species_index", "p")
    assert {(r["sp"], r["p"]): r["numeric_id"] % 10**9 for r in ids.collect()} == {("a", 9): 1, ("b", 1): 10**6 + 1, ("b", 2): 10**6 + 2, ("c", 4): 2 * 10**6 + 1}


def test_levels_take_ids_by_name(spark):
    groups = spark.createDataFrame([(1, "r", None, "S", "root", 1, 0), (1, "x", "r", "S", "low", 2, 0), (1, "y", "r", "S", None, 3, 1)], "fam long, node string, parent string, kind string, level string, ord long, place int")
    taxa = spark.createDataFrame([("root", 40), ("root", 40), (None, 1)], "name string, id int")
    told = hierarchy.with_taxon_ids(groups, taxa)
    assert {r["node"]: r["taxon"] for r in told.collect()} == {"r": 40, "x": None, "y": None}
    # A group whose level has no id is named without one.
    assert {r["node"]: r["hog_id"] for r in intervals.duplication_ids(intervals.encode(told), "taxon").collect()} == {"r": "HOG:0000001_40", "x": "HOG:0000001", "y": "HOG:0000001"}
    with pytest.raises(Exception, match="several ids for the taxon root"):
        hierarchy.with_taxon_ids(groups, taxa.union(spark.createDataFrame([("root", 41)], taxa.schema))).collect()
