"""Species trees in Newick form and nested groups in XML form, as tables."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.operators.graph import materialised
from kinloom.operators.proteins import numbered

_TOKEN = re.compile(r"\s*('(?:[^']|'')*'|\[[^\]]*\]|[(),:;]|[^\s(),:;\[\]]+)")
TREE = "node int, parent int, name string, length double, ord int"
#: Fixed value: names of the properties that give a group's level, in lower case.
LEVEL_NAMES = ("taxid", "taxrange", "taxonomic_range", "taxon_id", "ncbitaxid")
GROUPS = "fam long, node string, parent string, kind string, level string, score double, gene string, ord int"


def newick_rows(text: str, notes: dict[int, dict[str, str]] | None = None) -> list[tuple]:
    """Nodes in pre-order from 1: node, parent, name, branch length, place among siblings.

    Comments of the form [&&NHX:key=value:...] go to notes, by node, if that is given; other comments are skipped.
    """
    rows: list[list] = [[1, None, None, None, 0]]
    stack, now, children, length = [], 0, {1: 0}, False

    def add(parent: int) -> int:
        rows.append([len(rows) + 1, parent, None, None, children[parent]])
        children[parent] += 1
        children[len(rows)] = 0
        return len(rows) - 1

    for token in _TOKEN.findall(text):
        if token == "(":
            stack.append(now)
            now = add(rows[now][0])
        elif token == ",":
            now = add(rows[stack[-1]][0])
        elif token == ")":
            now = stack.pop()
        elif token == ":":
            length = True
            continue
        elif token == ";":
            break
        elif token.startswith("["):
            if notes is not None and token.startswith("[&&NHX"):
                notes[rows[now][0]] = dict(part.partition("=")[::2] for part in token[6:-1].split(":") if part)
        else:
            if length:
                rows[now][3] = float(token)
            else:
                rows[now][2] = token[1:-1].replace("''", "'") if token.startswith("'") else token
        length = False
    if stack:
        raise ValueError("brackets of the tree do not match")
    return [tuple(r) for r in rows]


def phyloxml_rows(xml: bytes) -> list[tuple]:
    """The same of the first tree of a phyloxml document; a clade without a name takes its taxonomy's code or scientific name."""
    local = lambda e: e.tag.rpartition("}")[2]
    top = next(e for e in ET.fromstring(xml).iter() if local(e) == "clade")
    rows: list[tuple] = []
    stack: list[tuple] = [(top, None, 0)]
    while stack:
        e, parent, place = stack.pop()
        said = {local(x): (x.text or "").strip() for x in e}
        taxon = next(({local(x): (x.text or "").strip() for x in t} for t in e if local(t) == "taxonomy"), {})
        length = said.get("branch_length") or e.get("branch_length")
        name = said.get("name") or taxon.get("code") or taxon.get("scientific_name")
        rows.append((len(rows) + 1, parent, name or None, float(length) if length else None, place))
        number = len(rows)
        stack += [(c, number, i) for i, c in reversed(list(enumerate(x for x in e if local(x) == "clade")))]
    return rows


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """A species tree (thousands of nodes at most), in Newick form or as phyloxml, as a table."""
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame(phyloxml_rows(text.encode()) if text.lstrip().startswith("<") else newick_rows(text), TREE)


def write_newick(rows: list[tuple], notes: dict | None = None) -> str:
    """The inverse of newick_rows, with a comment for some nodes; trees may be as deep as they like."""
    below: dict = {}
    for r in sorted(rows, key=lambda r: r[4], reverse=True):
        below.setdefault(r[1], []).append(r)
    out: list[str] = []
    stack: list[tuple] = [("node", below[None][0], True)]
    while stack:
        what, r, last = stack.pop()
        if what == "node" and r[0] in below:
            out.append("(")
            stack.append(("end", r, last))
            stack += [("node", c, i == 0) for i, c in enumerate(below[r[0]])]
            continue
        out.append((")" if what == "end" else "") + (r[2] or "") + (f":{r[3]:g}" if r[3] is not None else "") + (notes or {}).get(r[0], "") + ("" if last else ","))
    return "".join(out) + ";"


def checked_names(rows: list[tuple]) -> list[tuple]:
    """A tree (as newick_rows gives it) with usable names of inner nodes: short or repeated ones become internal_ and a number, and
    characters but letters, digits, _ and - go."""
    inner = {r[1] for r in rows}
    children: dict = {}
    for r in sorted(rows, key=lambda r: r[4]):
        children.setdefault(r[1], []).append(r[0])
    by, named, seen, counter = {r[0]: list(r) for r in rows}, [], set(), 0
    stack = [(n, False) for n in reversed(children[None])]
    while stack:  # children first
        n, done = stack.pop()
        if not done and n in inner:
            stack.append((n, True))
            stack += [(c, False) for c in reversed(children[n])]
        elif n in inner:
            named.append(n)
    for n in named:
        name = by[n][2] or ""
        clean = "".join(c for c in name if c.isalnum() or c in "_-")
        if len(name) < 3 or name in seen:
            clean, counter = f"internal_{counter}", counter + 1
        elif clean != name and clean in seen:
            clean, counter = f"{clean}_{counter}", counter + 1
        by[n][2] = clean
        seen.add(clean)
    return [tuple(by[r[0]]) for r in rows]


def pruned(rows: list[tuple], leaves: set[str]) -> list[tuple]:
    """A small tree with some leaves only; nodes with one child go and lengths add up."""
    from kinloom.operators.genetree import from_rows, without

    tree = from_rows(rows)
    kept = without(tree, {n.name for n in tree.leaves()} - leaves)
    if kept is None:
        return []
    # Names of inner nodes are found again by what lies below, the lowest node first.
    names: dict = {}
    for n in tree.postorder():
        if n.children:
            names.setdefault(frozenset(m.name for m in n.leaves()) & leaves, n.name)
    out: list[tuple] = []
    stack = [(kept, None, 0)]
    while stack:
        n, parent, place = stack.pop()
        number = len(out) + 1
        out.append((number, parent, names.get(frozenset(m.name for m in n.leaves())) if n.children else n.name, n.length, place))
        stack += [(c, number, i) for i, c in reversed(list(enumerate(n.children)))]
    return out


def taxonomy_xml(rows: list[tuple]) -> str:
    """A small species tree as nested taxon elements, numbered in pre-order from 1."""
    from xml.sax.saxutils import quoteattr

    below: dict = {}
    for r in sorted(rows, key=lambda r: r[4], reverse=True):
        below.setdefault(r[1], []).append(r)
    out, number, stack = ["<taxonomy>"], 0, [(r, False) for r in below[None]]
    while stack:
        r, closing = stack.pop()
        if closing:
            out.append("</taxon>")
            continue
        number += 1
        out.append(f'<taxon id="{number}" name={quoteattr(r[2] or "")}>')
        stack.append((r, True))
        stack += [(c, False) for c in below.get(r[0], [])]
    return "".join(out) + "</taxonomy>"


_ATTRIBUTE = re.compile(r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_KINDS = {"orthologGroup": "S", "paralogGroup": "D"}


def _attributes(tag: str) -> dict[str, str]:
    return {k: html.unescape(a or b) for k, a, b in _ATTRIBUTE.findall(tag)}


def group_rows(fam: int, tags: Iterator[str]) -> Iterator[tuple]:
    """The rows of a family out of its tags: a row for each group (kind S or D) and each gene (kind L), as in document order."""
    stack: list[list] = []
    for tag in tags:
        name = re.match(r"</?(?:\w+:)?(\w+)", tag)[1]
        said = _attributes(tag)
        if tag.startswith("</"):
            yield tuple(stack.pop()[0])
        elif name in _KINDS:
            if stack:
                place, parent = stack[-1][1], stack[-1][0][1]
                stack[-1][1] += 1
            else:
                place, parent = fam, None
            stack.append([[fam, f"{parent}/{place}" if parent else str(fam), parent, _KINDS[name], None, None, None, place], 0])
        elif name == "geneRef":
            top = stack[-1]
            yield fam, f"{top[0][1]}/g{top[1]}", top[0][1], "L", None, None, said.get("id"), top[1]
            top[1] += 1
        elif name == "property" and said.get("name", "").lower() in LEVEL_NAMES and stack[-1][0][4] is None:
            stack[-1][0][4] = said.get("value")
        elif name == "score" and stack[-1][0][5] is None:
            stack[-1][0][5] = float(said["value"])


def read_groups(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Nested groups of XML files, families numbered from 1 in each file; a gene is given by its protein's id.

    With whole the files are the parts of one document, which follow each other by name, as write_document leaves them.

    A row is read for each tag, so that large files are split and no row holds more than a tag.  Depths and numbers of families
    are running sums inside a part of a file, with what the parts before it add up to; then each family's tags are parsed together.
    A ">" inside an attribute must be written as an entity.  Genes that the document does not describe have no id.
    """
    at_file, at_block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    place = [F.lit(path).alias("file"), F.concat_ws(" ", at_file, F.lpad(at_block.cast("string"), 20, "0")).alias("block")] if whole else [at_file.alias("file"), at_block.alias("block")]
    tags = spark.read.option("lineSep", ">").text(path).select(*place, F.regexp_replace("value", "^[^<]*", "").alias("tag"))
    tags = tags.withColumn("at", F.monotonically_increasing_id()).withColumn("name", F.regexp_extract("tag", r"^</?(?:\w+:)?(\w+)", 1))
    wanted = ("orthoXML", "gene", "orthologGroup", "paralogGroup", "geneRef", "property", "score")
    tags = materialised(tags.where(F.col("name").isin(*wanted)))
    version = F.regexp_extract("tag", r"""\sversion\s*=\s*["']([^"']*)""", 1)
    other = tags.where("name = 'orthoXML' and tag not like '</%'").select(version.alias("v")).where("v not in ('', '0.5')").first()
    if other:
        raise ValueError(f"version {other['v']} of the format is not known")
    attribute = lambda name: F.nullif(F.regexp_extract("tag", rf"""\s{name}\s*=\s*["']([^"']*)""", 1), F.lit(""))
    plain = F.coalesce(attribute("protId"), attribute("geneId"))
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(character))
    genes = tags.where("name = 'gene'").select("file", attribute("id").alias("id"), plain.alias("prot"))
    group = F.col("name").isin(*_KINDS)
    step = F.when(group & F.startswith("tag", F.lit("</")), -1).when(group & ~F.endswith("tag", F.lit("/")), 1).otherwise(0)
    parts = tags.where("name not in ('gene', 'orthoXML')").withColumn("step", step)
    # A family begins where the depth becomes 1.
    sums = parts.groupBy("file", "block").agg(F.sum("step").alias("sum"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of a file
    sums = sums.select("file", "block", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file", "block").orderBy("at")
    deep = parts.join(sums, ["file", "block"]).withColumn("depth", F.col("before") + F.sum("step").over(inside))
    deep = materialised(deep.withColumn("begins", ((F.col("step") == 1) & (F.col("depth") == 1)).cast("int")).where("depth > 0 or step = -1"))
    counts = deep.groupBy("file", "block").agg(F.sum("begins").alias("sum"))
    counts = counts.select("file", "block", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("first"))
    numbered = deep.join(counts, ["file", "block"]).withColumn("fam", (F.col("first") + F.sum("begins").over(inside)).cast("long"))

    def parse(rows):
        import pandas as pd

        rows = rows.sort_values(["block", "at"])
        found = pd.DataFrame(list(group_rows(int(rows["fam"].iloc[0]), rows["tag"])), columns=[f.split(" ")[0] for f in GROUPS.split(", ")])
        return found.assign(file=rows["file"].iloc[0])

    out = numbered.select("file", "fam", "block", "at", "tag").groupBy("file", "fam").applyInPandas(parse, GROUPS + ", file string")
    return out.join(genes.withColumnRenamed("id", "gene"), ["file", "gene"], "left").select("fam", "node", "parent", "kind", "level", "score", F.col("prot").alias("gene"), "ord")


def group_xml(groups: DataFrame) -> DataFrame:
    """The XML element of each family (fam, xml), out of rows as read_groups gives them.  A family is one group of rows."""

    def build(rows):
        import pandas as pd
        from xml.sax.saxutils import quoteattr

        below: dict = {}
        for r in rows.sort_values("ord").itertuples():
            below.setdefault(r.parent if isinstance(r.parent, str) else None, []).append(r)

        # What is still to be written, last first: a group, or the end of one.
        out, todo = [], list(reversed(below.get(None, [])))
        while todo:
            r = todo.pop()
            if isinstance(r, str):
                out.append(r)
                continue
            if r.kind == "L":
                out.append(f"<geneRef id={quoteattr(r.gene)}/>")
                continue
            tag = "orthologGroup" if r.kind == "S" else "paralogGroup"
            score = f'<score id="CompletenessScore" value="{r.score:g}"/>' if r.score == r.score and r.score is not None else ""
            level = f'<property name="TaxRange" value={quoteattr(r.level)}/>' if isinstance(r.level, str) else ""
            out.append(f"<{tag}>{score}{level}")
            todo += [f"</{tag}>", *reversed(below.get(r.node, []))]
        return pd.DataFrame({"fam": [rows["fam"].iloc[0]], "xml": ["".join(out)]})

    return groups.groupBy("fam").applyInPandas(build, "fam long, xml string")


def group_newick(groups: DataFrame, notes: bool = True) -> DataFrame:
    """Each family (fam, newick) out of rows as read_groups gives them, with the kind and level of groups as comments (NHX)."""

    def build(rows):
        import pandas as pd

        number = {n: i for i, n in enumerate(rows["node"], 1)}
        tree = [(number[r.node], number.get(r.parent), r.gene if r.kind == "L" else None, None, r.ord) for r in rows.itertuples()]
        texts = {}
        for r in rows.itertuples():
            tags = ":Ev=duplication" * (r.kind == "D") + (f":S={r.level}" if isinstance(r.level, str) else "")
            if notes and tags:
                texts[number[r.node]] = f"[&&NHX{tags}]"
        return pd.DataFrame({"fam": [rows["fam"].iloc[0]], "newick": [write_newick(tree, texts)]})

    return groups.groupBy("fam").applyInPandas(build, "fam long, newick string")


def group_document(genes: DataFrame, families: DataFrame, taxonomy: str) -> DataFrame:
    """A whole document as lines (part, name, at, line), to be written in their order: genes by species, taxonomy, scores, families.

    genes: species, id, prot.  families: fam, xml, as group_xml gives them.  taxonomy: the element as text.
    """
    spark, quoted = genes.sparkSession, lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;")), F.lit('"'))
    name = F.col("species")
    each = genes.select(F.lit(1).alias("part"), name.alias("name"), F.col("id").cast("long").alias("at"), F.concat(F.lit('<gene id="'), F.col("id").cast("string"), F.lit('" protId='), quoted(F.col("prot")), F.lit("/>")).alias("line"))
    species = genes.select("species").distinct()
    opening = species.select(F.lit(1).alias("part"), name.alias("name"), F.lit(-1).cast("long").alias("at"), F.concat(F.lit("<species name="), quoted(name), F.lit("><database name="), quoted(name), F.lit("><genes>")).alias("line"))
    closing = species.select(F.lit(1).alias("part"), name.alias("name"), F.lit((1 << 63) - 1).alias("at"), F.lit("</genes></database></species>").alias("line"))
    groups = families.select(F.lit(3).alias("part"), F.lit("").alias("name"), F.col("fam").cast("long").alias("at"), F.col("xml").alias("line"))
    scores = '<scores><scoreDef id="CompletenessScore" desc="share of the species below a level that a group covers"/></scores>'
    rest = [(0, "", 0, '<?xml version="1.0" encoding="UTF-8"?><orthoXML xmlns="http://orthoXML.org/2011/" version="0.5" origin="kinloom" originVersion="1">'), (2, "", 0, taxonomy + scores + "<groups>"), (4, "", 0, "</groups></orthoXML>")]
    return spark.createDataFrame(rest, "part int, name string, at long, line string").unionByName(opening).unionByName(each).unionByName(closing).unionByName(groups)


def write_document(lines: DataFrame, path: str) -> None:
    """Lines of a document in the order of part, name and at, over as many files as there are partitions, which follow each other by name."""
    lines.repartitionByRange("part", "name", "at").sortWithinPartitions("part", "name", "at").select("line").write.text(path)


def select_families(groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of some families (fam)."""
    return groups.join(wanted.select("fam").distinct(), "fam", "left_semi")


def write_families(groups: DataFrame, path: str) -> None:
    """A folder for each family, with its element."""
    group_xml(groups).write.partitionBy("fam").text(path)


def genes_of(groups: DataFrame, genes: DataFrame) -> DataFrame:
    """The genes (id) that some families hold, as a document of these alone lists them."""
    held = groups.where("kind = 'L'").select(F.col("gene").alias("id")).distinct()
    return genes.join(held, genes["id"].cast("string") == held["id"], "left_semi")


def merge_genes(files: list[DataFrame]) -> DataFrame:
    """Genes (id, prot) of several files under ids that do not collide: file, id, prot, new_id.

    An id that two files use for different proteins is given anew where a file uses it after the first: the numbers behind the
    greatest id, in the order of file and protein, so that no two fall together.
    """
    all_ = None
    for k, df in enumerate(files):
        named = df.select(F.lit(k).alias("file"), F.col("id").cast("long"), "prot")
        all_ = named if all_ is None else all_.unionByName(named)
    first = all_.groupBy("id").agg(F.min_by("prot", F.struct("file", "prot")).alias("owner"))
    told = all_.join(first, "id").withColumn("kept", F.col("prot").eqNullSafe(F.col("owner")))
    number = numbered(told.where("not kept").select(F.col("file").alias("_file"), F.col("prot").alias("_prot")).distinct(), "_file", "_prot")
    met = told.join(number, ~F.col("kept") & (F.col("file") == F.col("_file")) & F.col("prot").eqNullSafe(F.col("_prot")), "left")
    greatest = all_.agg(F.coalesce(F.max("id"), F.lit(0)).alias("greatest"))  # one row
    return met.crossJoin(F.broadcast(greatest)).select("file", "id", "prot", F.when(F.col("kept"), F.col("id")).otherwise(F.col("greatest") + F.col("number")).alias("new_id"))


def merge_groups(files: list[DataFrame], ids: DataFrame | None = None) -> DataFrame:
    """Groups of several files under family numbers of their own, in the order of files and families.

    ids, as merge_genes gives them (file, prot, new_id): a gene of a file, given by its protein, is put under its new id.
    """
    out = None
    for k, df in enumerate(files):
        named = df.withColumn("file", F.lit(k)).withColumns({c: F.concat(F.lit(f"{k}:"), c) for c in ("node", "parent")})
        out = named if out is None else out.unionByName(named)
    number = numbered(out.select("file", F.col("fam").alias("old")).distinct(), "file", "old").withColumn("fam", F.col("number")).drop("number")
    out = out.withColumnRenamed("fam", "old").join(number, ["file", "old"])
    if ids is not None:
        fresh = ids.select("file", F.col("prot").alias("gene"), F.col("new_id").cast("string").alias("new_id")).distinct()
        out = out.join(fresh, ["file", "gene"], "left").withColumn("gene", F.coalesce("new_id", "gene"))
    return out.select(*files[0].columns)
