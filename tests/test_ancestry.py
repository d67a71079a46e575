"""Ancestral groups, histories over levels, packing by doubling, and changes of members through all levels."""

import random

import pytest
from pyspark.sql import functions as F

from kinloom.operators import ancestry, fold, hierarchy, packing, revision

AMINO = "ACDEFGHIKLMNPQRSTVWY"
#: r over x over (A, B) and y over (C, D), and E.
SPECIES = [("r", None), ("x", "r"), ("y", "r"), ("E", "r"), ("A", "x"), ("B", "x"), ("C", "y"), ("D", "y")]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns or df.columns).collect()), key=repr)


@pytest.fixture(scope="module")
def ancestral(spark):
    """One family: a root group of r, a duplication below it with copies of x, one of which has A alone; C; a gene of E.  And one that begins at y."""
    groups = [("t", None, "S", "r"), ("d", "t", "D", None), ("x1", "d", "S", "x"), ("u", None, "S", "y")]
    genes = [("x1", "a1", "A"), ("x1", "b1", "B"), ("d", "a2", "A"), ("t", "c1", "C"), ("t", "e1", "E"), ("u", "c2", "C"), ("u", "d2", "D"), ("u", "d3", "D")]
    tree = table(spark, SPECIES, "node string, parent string")
    g = table(spark, groups, "node string, parent string, kind string, level string")
    m = table(spark, genes, "node string, gene string, species string")
    return tree, g, m, ancestry.ancestral_groups(g, m, hierarchy.closure(tree))


def test_skipped_taxa_are_completed(ancestral):
    _, _, _, found = ancestral
    want = [
        ("r", "t", None, None), ("x", "x1", "r", "t"), ("A", "a1", "x", "x1"), ("B", "b1", "x", "x1"), ("A", "a2", "x", "a2"), ("x", "a2", "r", "t"), ("C", "c1", "y", "c1"), ("y", "c1", "r", "t"), ("E", "e1", "r", "t"),
        ("y", "u", None, None), ("C", "c2", "y", "u"), ("D", "d2", "y", "u"), ("D", "d3", "y", "u"),
    ]
    assert rows_of(found, "level", "group", "parent_level", "parent_group") == sorted(want, key=repr)


def test_events_add_up_and_are_those_of_memberships(ancestral):
    tree, groups, genes, found = ancestral
    events = {r["node"]: r for r in ancestry.taxon_events(found, tree).collect()}
    sizes = {r["level"]: r["n_groups"] for r in ancestry.genome_sizes(found).collect()}
    for e in events.values():
        assert e["retained"] + e["copies"] + e["gained"] == sizes.get(e["node"], 0)
        assert e["retained"] + e["duplicated"] + e["lost"] == sizes.get(e["parent"], 0)
    assert tuple(events["x"])[2:] == (0, 1, 2, 0, 0) and tuple(events["y"])[2:] == (1, 0, 0, 0, 1) and tuple(events["D"])[2:] == (0, 1, 2, 1, 0)
    below = genes.join(hierarchy.closure(groups), "node").select(F.col("ancestor").alias("group"), "gene").unionByName(genes.select(F.col("gene").alias("group"), "gene"))
    plain = {r["node"]: r for r in hierarchy.edge_events(ancestry.memberships(found, below), tree).collect()}
    for node, e in events.items():
        assert [plain[node][c] for c in ("retained", "duplicated", "lost", "gained")] == [e[c] for c in ("retained", "duplicated", "lost", "gained")]


def test_lateral_comparison(spark, ancestral):
    tree, _, _, found = ancestral
    assert rows_of(ancestry.lateral(found, "A", "C", "r", hierarchy.closure(tree))) == [("t", 2, 1)]
    assert rows_of(ancestry.lateral(found, "x", "E", "r", hierarchy.closure(tree))) == [("t", 2, 1)]


def plain_histories(levels):
    out = []

    def go(start, group, at, words):
        if at == len(levels) - 1:
            out.append((*start, at, group, " ".join(words)))
            return
        below = sorted(g for g, genes in levels[at + 1].items() if genes & levels[at][group])
        word = "lost" if not below else "identical" if len(below) == 1 else "duplicated"
        if not below:
            out.append((*start, at + 1, None, " ".join([*words, word])))
        for g in below:
            go(start, g, at + 1, [*words, word])

    for at, level in enumerate(levels):
        for g, genes in level.items():
            if at == 0:
                go((0, g), g, 0, ["present"])
            elif not any(genes & other for other in levels[at - 1].values()):
                go((at, g), g, at, ["singleton" if len(genes) == 1 else "novel"])
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_histories_over_four_levels(spark, seed):
    r = random.Random(seed)
    levels = []
    for at in range(4):
        groups = {}
        for gene in range(40):
            if r.random() < 0.7:
                groups.setdefault(f"l{at}g{gene // (16 >> at) if r.random() < 0.9 else r.randrange(6)}", set()).add(gene)
        levels.append(groups)
    frames = [table(spark, [(g, x) for g, genes in level.items() for x in genes], "`group` string, gene int") for level in levels]
    assert rows_of(ancestry.level_histories(frames)) == plain_histories(levels)
    assert rows_of(ancestry.level_histories(frames[:1])) == plain_histories(levels[:1])


def plain_packing(sizes, alone, full):
    batch, total, out = 0, 0, []
    for n in sizes:
        if n > alone and total:
            batch, total = batch + 1, 0
        out.append(batch)
        total += n
        if n > alone or total > full:
            batch, total = batch + 1, 0
    return out


def test_packing_against_the_sequential_rule(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", "c", None]), r.choice([None, 0, 0, 1, 5, 20, 60, 200]), i) for i in range(400)] + [("one", 7, 1000), ("zero", 0, 1001), ("zero", None, 1002), ("big", 900, 1003), ("big", 900, 1004)]
    df = table(spark, rows, "g string, size long, id int").repartition(5)
    for alone, full in ((100, 80), (50, 0), (10**6, 10**6)):
        want = []
        for g in {x[0] for x in rows}:
            own = sorted((x for x in rows if x[0] == g), key=lambda x: (-(x[1] or 0), x[2]))
            want += [(*x, b) for x, b in zip(own, plain_packing([x[1] or 0 for x in own], alone, full), strict=True)]
        got = packing.pack_batches(df, "g", "size", "id", alone=alone, full=full)
        assert got.columns == ["g", "size", "id", "batch"] and rows_of(got) == sorted(want, key=repr)
    assert packing.pack_batches(df.limit(0), "g", "size", "id", alone=1, full=1).count() == 0


def mutate(r, seq, share):
    return "".join(r.choice(AMINO) if r.random() < share else c for c in seq)


def test_fragments_become_one_member_and_strays_leave_all_levels(spark):
    r = random.Random(4)
    base = "".join(r.choice(AMINO) for _ in range(160))
    rows = [(1, s + "1", s, mutate(r, base, 0.1)) for s in "BCDE"]
    whole = mutate(r, base, 0.1)
    rows += [(1, "A1", "A", whole[:78]), (1, "A2", "A", whole[82:]), (1, "Z9", "B", "".join(r.choice(AMINO) for _ in range(150)))]
    genes = table(spark, rows, "fam long, gene string, species string, seq string")
    tree = table(spark, SPECIES, "node string, parent string")
    groups, links = fold.fold(genes, tree, column_filter=None)
    found = revision.find_fragments(genes)
    assert {(x["kept"], x["gene"]) for x in found.collect()} == {("A1", "A1"), ("A1", "A2")}
    groups, links, genes, done = revision.merge_fragments(groups, links, genes, found)
    assert rows_of(done) == [(1, "A2", "merged", "A1")]
    after = {x["gene"]: x["seq"] for x in genes.collect()}
    assert "A2" not in after and after["A1"].startswith(whole[:70]) and after["A1"].endswith(whole[90:]) and len(after) == 6
    assert "A2" not in {x["sub"] for x in links.collect()} | {x["hog"] for x in groups.collect()}
    strays = table(spark, [(1, "Z9"), (1, "unknown")], "fam long, gene string")
    groups, links, genes, done = revision.remove_members(groups, links, genes, strays)
    assert rows_of(done) == [(1, "Z9", "removed", None)]
    names = {x["hog"] for x in groups.collect()}
    assert "Z9" not in names | {x["sub"] for x in links.collect()} and {x["sub"] for x in links.collect()} <= names and {x["hog"] for x in links.collect()} <= names
    out, members = fold.group_tree(*fold.fold(genes, tree), genes, tree)
    assert sorted(x["gene"] for x in members.collect()) == ["A1", "B1", "C1", "D1", "E1"]
    assert [x["level"] for x in out.where("parent is null").collect()] == ["r"]


def test_groups_that_lose_everything_go_up_to_the_top(spark):
    groups = table(spark, [(1, "a", "A", False), (1, "x:a", "x", False), (1, "r:a", "r", False), (2, "a", "A", False), (2, "x:a", "x", False)], "fam long, hog string, level string, frozen boolean")
    links = table(spark, [(1, "x:a", "a"), (1, "r:a", "x:a"), (2, "x:a", "a")], "fam long, hog string, sub string")
    genes = table(spark, [(1, "a", "A", "AC"), (2, "a", "A", "AC")], "fam long, gene string, species string, seq string")
    g, k, left, _ = revision.remove_members(groups, links, genes, table(spark, [(1, "a")], "fam long, gene string"))
    assert rows_of(g, "fam", "hog") == [(2, "a"), (2, "x:a")] and rows_of(k, "fam", "hog", "sub") == [(2, "x:a", "a")] and rows_of(left, "fam", "gene") == [(2, "a")]
