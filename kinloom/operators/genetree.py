"""Gene trees of a few sequences: joining, rooting, labels and representatives.

These are helpers inside one task.  They see the representatives of one family at one taxon, never a family's members, so the
number of leaves is that of the child groups times the representatives of each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np

#: Deviations of the outlier rule, in widths of the middle half.
FAR = 1.5


class Node:
    """A node of a rooted tree: name (of a leaf), length of the branch above, children."""

    __slots__ = ("children", "inter", "kind", "length", "name", "species", "union")

    def __init__(self, name: str | None = None, length: float = 0.0, children: list[Node] | None = None):
        self.name, self.length, self.children = name, length, children or []
        self.kind: str | None = None
        self.species: frozenset = frozenset()
        self.inter = self.union = 0

    def postorder(self) -> Iterator[Node]:
        stack: list[tuple[Node, bool]] = [(self, False)]
        while stack:
            node, seen = stack.pop()
            if seen or not node.children:
                yield node
            else:
                stack.append((node, True))
                stack += [(c, False) for c in reversed(node.children)]

    def leaves(self) -> list[Node]:
        return [n for n in self.postorder() if not n.children]

    def depths(self) -> dict[Node, float]:
        """Distance of each node from above the root."""
        out, stack = {}, [(self, 0.0)]
        while stack:
            node, above = stack.pop()
            out[node] = above + node.length
            stack += [(c, out[node]) for c in node.children]
        return out


def from_rows(rows: list[tuple]) -> Node:
    """A tree out of rows as sources.trees.newick_rows gives them: node, parent, name, length, place."""
    nodes = {r[0]: Node(r[2], r[3] or 0.0) for r in rows}
    for r in sorted(rows, key=lambda r: r[4]):
        if r[1] is not None:
            nodes[r[1]].children.append(nodes[r[0]])
    return nodes[next(r[0] for r in rows if r[1] is None)]


def to_rows(root: Node) -> list[tuple]:
    """The tree as rows: node (from 1), parent, name, length, place."""
    out, stack = [], [(root, None, 0)]
    while stack:
        node, parent, place = stack.pop()
        out.append((len(out) + 1, parent, node.name, node.length, place))
        stack += [(c, out[-1][0], k) for k, c in reversed(list(enumerate(node.children)))]
    return out


def without(root: Node, gone: set[str]) -> Node | None:
    """A copy without some leaves; nodes with one child are contracted, lengths added up. None if nothing is left."""
    made: dict[Node, Node | None] = {}
    for n in root.postorder():
        if not n.children:
            made[n] = None if n.name in gone else Node(n.name, n.length)
        else:
            below = [made[c] for c in n.children if made[c] is not None]
            if len(below) == 1:
                below[0].length += n.length
            made[n] = below[0] if len(below) == 1 else Node(None, n.length, below) if below else None
            if made[n] is not None and len(below) > 1:
                made[n].kind, made[n].inter, made[n].union = n.kind, n.inter, n.union
    return made[root]


# Unrooted trees: names of nodes (None inside) and the branches of each node with their lengths.
Graph = tuple[list[str | None], list[dict[int, float]]]


def neighbour_joining(names: list[str], distance: np.ndarray) -> Graph:
    """The unrooted tree by neighbour joining; negative branches become 0, ties go to the earlier node.

    Each node keeps a lower bound of its least distance, so of most nodes it is known without a look at their row that they are in
    no better pair.  One matrix is kept, in which a joined pair takes the place of its first node.
    """
    label: list[str | None] = list(names)
    near: list[dict[int, float]] = [{} for _ in names]

    def join(a: int, b: int, length: float) -> None:
        near[a][b] = near[b][a] = max(float(length), 0.0)

    d, at = np.array(distance, float), np.arange(len(names))
    live, sums = np.arange(len(names)), d.sum(1)
    np.fill_diagonal(d, np.inf)
    low = d.min(1, initial=np.inf)
    while len(live) > 2:
        n = len(live)
        bound = (n - 2) * low[live] - sums[live] - sums[live].max()
        best, pair = np.inf, (0, 0)
        for k in np.argsort(bound, kind="stable").tolist():
            if bound[k] >= best - 1e-12:
                break
            row = d[live[k], live]
            q = (n - 2) * row - sums[live[k]] - sums[live]
            other = int(q.argmin())
            low[live[k]] = row.min()
            if q[other] < best - 1e-12:
                best, pair = q[other], (live[k], live[other])
        i, j = min(pair), max(pair)
        gap = d[i, j]
        half = gap / 2 + (sums[i] - sums[j]) / (2 * (n - 2))
        label.append(None)
        near.append({})
        join(len(near) - 1, int(at[i]), half)
        join(len(near) - 1, int(at[j]), gap - half)
        rest = live[(live != i) & (live != j)]
        row = (d[i, rest] + d[j, rest] - gap) / 2
        sums[rest] += row - d[i, rest] - d[j, rest]
        d[i, rest] = d[rest, i] = row
        sums[i], low[i], at[i] = row.sum(), row.min(), len(near) - 1
        low[rest] = np.minimum(low[rest], row)
        live = live[live != j]
    if len(live) == 2:
        join(int(at[live[0]]), int(at[live[1]]), d[live[0], live[1]])
    return label, near


def unrooted(root: Node) -> Graph:
    """The tree without its root, if that has two children."""
    number, label, near = {}, [], []
    for n in root.postorder():
        if n is root and len(n.children) == 2:
            a, b = (number[c] for c in n.children)
            near[a][b] = near[b][a] = n.children[0].length + n.children[1].length
            break
        number[n] = len(label)
        label.append(n.name if not n.children else None)
        near.append({})
        for c in n.children:
            near[number[n]][number[c]] = near[number[c]][number[n]] = c.length
    return label, near


def rooted(graph: Graph, u: int, v: int, x: float) -> Node:
    """The tree with its root on the branch from u to v, x away from u."""
    label, near = graph
    root = Node()
    stack = [(u, v, root, x), (v, u, root, near[u][v] - x)]
    while stack:
        at, back, parent, length = stack.pop(0)
        node = Node(label[at], length)
        parent.children.append(node)
        stack += [(m, at, node, w) for m, w in sorted(near[at].items()) if m != back]
    return root


def _away(graph: Graph, start: int) -> tuple[dict[int, float], dict[int, int]]:
    """Distance of each node from one, and the node before it on the way."""
    far, back, stack = {start: 0.0}, {start: -1}, [start]
    while stack:
        at = stack.pop()
        for m, w in graph[1][at].items():
            if m not in far:
                far[m], back[m] = far[at] + w, at
                stack.append(m)
    return far, back


def midpoint(graph: Graph, left_out: frozenset[str] | set[str] = frozenset()) -> Node:
    """Rooted halfway between the two leaves that are farthest apart, some leaves left out; the start leaf is the first one."""
    leaves = [i for i, n in enumerate(graph[0]) if n is not None and n not in left_out]
    far, _ = _away(graph, leaves[0])
    one = max(leaves, key=far.__getitem__)
    far, back = _away(graph, one)
    at = max((i for i in leaves if i != one), key=far.__getitem__)
    half = far[at] / 2
    while far[back[at]] > half:
        at = back[at]
    return rooted(graph, at, back[at], far[at] - half)


def distances(graph: Graph) -> tuple[list[int], np.ndarray]:
    """Nodes that are leaves, and the distance of every two nodes."""
    n = len(graph[0])
    d = np.array([[far[j] for j in range(n)] for far in (_away(graph, i)[0] for i in range(n))])
    return [i for i, name in enumerate(graph[0]) if name is not None], d


def outliers(graph: Graph) -> set[str]:
    """Leaves whose sum of distances lies FAR widths of the middle half above it."""
    leaves, d = distances(graph)
    sums = d[np.ix_(leaves, leaves)].sum(1)
    low, high = np.percentile(sums, [25, 75])
    return {graph[0][i] for i, s in zip(leaves, sums, strict=True) if s > high + FAR * (high - low)}


def trimmed_midpoint(graph: Graph) -> Node:
    """Midpoint between leaves that are no outliers, if two of them are left."""
    gone = outliers(graph)
    return midpoint(graph, gone if sum(n is not None and n not in gone for n in graph[0]) >= 2 else frozenset())


def _branches(graph: Graph) -> list[tuple[int, int]]:
    return [(u, v) for u, near in enumerate(graph[1]) for v in sorted(near) if u < v]


def lineage_score(root: Node, lineages: dict[str, frozenset]) -> int:
    """Over all nodes the number of taxa that all leaves below have in their lineages."""
    shared, total = {}, 0
    for n in root.postorder():
        shared[n] = lineages[n.name] if not n.children else frozenset.intersection(*(shared[c] for c in n.children))
        total += len(shared[n])
    return total


def by_lineage(lineages: dict[str, frozenset]) -> Callable[[Graph], Node]:
    """Rooted on the branch with the best lineage score; ties to the more balanced sides, then to the first branch."""

    def choose(graph: Graph) -> Node:
        best, out = None, None
        for u, v in _branches(graph):
            tree = rooted(graph, u, v, graph[1][u][v] / 2)
            depth = [max(c.depths()[n] for n in c.leaves()) for c in tree.children]
            score = (lineage_score(tree, lineages), min(depth) / max(depth) if max(depth) else 1.0)
            if best is None or score > best:
                best, out = score, tree
        return out

    return choose


def least_deviation(graph: Graph) -> Node:
    """Rooted where the mean relative deviation of all pairs of leaves from a molecular clock is least."""
    leaves, d = distances(graph)
    best, out = math.inf, None
    pairs = d[np.ix_(leaves, leaves)]
    for u, v in _branches(graph):
        side = np.array([d[i, u] < d[i, v] or d[i, u] == d[i, v] and i <= u for i in leaves])
        length, a, b = graph[1][u][v], d[leaves, u][side], d[leaves, v][~side]
        across = np.maximum(a[:, None] + length + b[None], 1e-12)
        weight = 1 / across**2
        place = ((across - 2 * a[:, None]) * weight).sum() / (2 * length * weight.sum()) if length > 0 else 0.0
        x = min(max(place, 0.0), 1.0) * length
        tree = rooted(graph, u, v, x)
        deep = tree.depths()
        total, below = 0.0, {}
        for n in tree.postorder():
            below[n] = [n] if not n.children else [m for c in n.children for m in below[c]]
            for i, c in enumerate(n.children):
                for other in n.children[i + 1 :]:
                    p = np.array([deep[m] - deep[n] for m in below[c]])[:, None]
                    r = np.array([deep[m] - deep[n] for m in below[other]])[None]
                    total += (((p - r) / np.maximum(p + r, 1e-12)) ** 2).sum()
        if total < best - 1e-12:
            best, out = total, tree
    return out if pairs.size > 1 else midpoint(graph)


def species_overlap(root: Node, species: dict[str, frozenset], threshold: float) -> None:
    """Labels each inner node: D if the species of all children over the species of any exceed the threshold, else S."""
    for n in root.postorder():
        if not n.children:
            n.species = species[n.name]
            continue
        sets = [c.species for c in n.children]
        n.species = frozenset.union(*sets)
        n.inter, n.union = len(frozenset.intersection(*sets)), len(n.species)
        n.kind = "D" if n.union and n.inter / n.union > threshold else "S"


def by_common_ancestor(root: Node, species: dict[str, str], parents: dict[str, str | None]) -> dict[Node, str]:
    """Labels by the least common ancestor: each node stands for the lowest taxon above its leaves; D if a child stands for the same."""

    def lineage(t: str | None) -> list[str]:
        out = []
        while t is not None:
            out.append(t)
            t = parents[t]
        return out

    stands: dict[Node, str] = {}
    for n in root.postorder():
        if not n.children:
            stands[n] = species[n.name]
            continue
        above = [lineage(stands[c]) for c in n.children]
        shared = set(above[0]).intersection(*above[1:])
        stands[n] = next(t for t in above[0] if t in shared)
        n.kind = "D" if any(stands[c] == stands[n] for c in n.children) else "S"
    return stands


def candidates(root: Node) -> list[Node]:
    """What stays together: from the root down through duplications, the first speciations or leaves."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.children and n.kind == "D":
            stack += reversed(n.children)
        else:
            out.append(n)
    return out


def representatives(root: Node, most: int) -> list[tuple[str, list[str]]]:
    """Up to most leaves that stand for a tree, each with the leaves of its part.

    The tree is cut at the depth of its most-th highest inner node; of each part the leaf at the middle of the leaves by depth stands.
    """
    leaves = root.leaves()
    if len(leaves) <= most:
        return [(n.name, [n.name]) for n in leaves]
    depth = root.depths()
    inner = sorted(depth[n] for n in depth if n.children)
    cut = inner[min(len(inner), most) - 1]
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.children and depth[n] < cut:
            stack += reversed(n.children)
        else:
            part = sorted(n.leaves(), key=lambda m: depth[m])
            out.append((part[len(part) // 2].name, [m.name for m in part]))
    return out


def with_copies(root: Node, copies: dict[str, list[str]]) -> Node:
    """The tree with further leaves at the places of some: each of these becomes a node over itself and its copies."""
    for n in [n for n in root.postorder() if not n.children and copies.get(n.name)]:
        n.children, n.name = [Node(m) for m in [n.name, *copies[n.name]]], None
    return root


def word_distance(sequences: list[str], size: int = 3, most: float = 5.0) -> np.ndarray:
    """Distances by shared runs of size letters: -ln(2 j / (1 + j)) / size for their Jaccard similarity j, most where none is shared."""
    number: dict[str, int] = {}
    words = [{number.setdefault(s[i : i + size], len(number)) for i in range(max(len(s) - size + 1, 1))} for s in sequences]
    of = np.repeat(np.arange(len(words)), [len(w) for w in words])
    ids = np.fromiter((i for w in words for i in w), np.int64, len(of))
    order = np.argsort(ids, kind="stable")
    of, ids = of[order], ids[order]
    shared = np.zeros((len(words), len(words)), np.float32)
    step = 4096  # words at a time, for bounded memory
    for first in range(0, len(number), step):
        a, z = np.searchsorted(ids, [first, first + step])
        has = np.zeros((len(words), min(step, len(number) - first)), np.float32)
        has[of[a:z], ids[a:z] - first] = 1
        shared += has @ has.T
    count = np.array([len(w) for w in words], np.float64)
    j = shared / np.maximum(count[:, None] + count[None] - shared, 1)
    out = np.full(j.shape, most)
    out[j > 0] = np.minimum(most, -np.log(2 * j[j > 0] / (1 + j[j > 0])) / size)
    np.fill_diagonal(out, 0.0)
    return np.maximum(out, 0.0)
