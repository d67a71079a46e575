"""Operator 7: near-duplicate vectors by cosine, through spherical-cap filters of structured random product codes.

Distinct vectors, each with the number of its copies, are turned by a random rotation and cut into SLICES parts.  Each part has
its own small code of random directions; a filter is one direction from each part, so a few hundred directions make as
many filters as the table needs.  A vector is listed under every filter whose inner product with it exceeds a threshold
(list decoding: partial sums that cannot reach it are dropped on the way).  Spark groups the vectors by filter, and
each group compares its members in double precision.  A pair that meets under several filters counts under the least
filter that both have, so counts need no pairs to be sent on: a group gives link counts and the edges of a spanning forest.
Components come from those edges.

A vector always has its LEAST best filters, whatever the threshold, so none is left out and scaled copies meet.

The code grows with the table, so groups stay near GROUP vectors (a PART of a small table); a group beyond SPLIT is dealt into blocks
and compared block against block.  Every code is turned at random, so the chance that a pair of some cosine shares a filter is the same
for all pairs, whatever the table holds; plan measures it for pairs at the threshold and takes as many independent codes as find RECALL
of them, for a table of any size.  Links found are exact, none is below the threshold.  Vectors of fewer than four dimensions, and
thresholds of 0 or less, have no such filters (a fixed share of all pairs links there): all are compared.

Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, and so do rows with a null id, whose
component is null.  Vectors of unequal length are compared as if the shorter ended in zeros.  Repeated rows are
vectors of their own that link with each other.  Further columns take no part, whatever their names.  An empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm import common
from kinloom.llm.vectors import matrix
from kinloom.operators.graph import connected_components

#: Share of the pairs at the threshold that is found; mean filters of a vector to choose from, and the fewest; parts; vectors of a filter, and of a block.
RECALL, LISTED, LEAST, SLICES, GROUP, SPLIT = 0.999, (2, 8, 32), 2, 2, 512, 1024
#: Share of a table in one filter at most.
PART = 1 / 16
#: Pairs and codes by which plan measures, and deviations that it allows for.
PAIRS, CODES, MARGIN = 512, 4, 2.0


def cap_level(share: float, width: int) -> float:
    """The inner product with a fixed unit vector that a share (up to a half) of all unit vectors of a width exceeds."""
    angle = np.linspace(0, np.pi / 2, 1 << 16)
    with np.errstate(divide="ignore"):
        density = np.exp((width - 2) * np.log(np.sin(angle))) if width > 2 else np.ones(len(angle))
    area = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
    return float(np.cos(np.interp(share, area / area[-1] / 2, angle)))


class ProductCode:
    """One random product code over vectors of a width, with about listed filters a vector and group vectors a filter."""

    def __init__(self, width: int, rows: int, seed: int, listed: int = LISTED[0], group: int = GROUP):
        rng = np.random.default_rng(seed)
        # A part of one dimension would have two directions only.
        self.parts = min(SLICES if rows < 1 << 27 else SLICES + 1, width // 2)
        want = max(listed * rows / max(1, min(group, rows * PART)), 4 * listed)
        self.size = max(2, int(np.ceil(want ** (1 / self.parts))))
        turn, upper = np.linalg.qr(rng.standard_normal((width, width)))
        self.turn = turn * np.sign(np.diag(upper))
        self.cuts = np.linspace(0, width, self.parts + 1).astype(int)
        self.codes = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            c = rng.standard_normal((self.size, b - a))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) * np.sqrt((b - a) / width))
        # A filter is a unit vector, so its share of all vectors is that of a spherical cap.
        self.level = cap_level(listed / self.size**self.parts, width)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and filter numbers of all filters above the level, and of each row's LEAST best."""
        turned = unit @ self.turn
        scores = [turned[:, a:b] @ c.T for a, b, c in zip(self.cuts[:-1], self.cuts[1:], self.codes, strict=True)]
        few, best = min(self.size, LEAST), np.zeros((len(unit), 1))
        for s in scores:
            top = np.partition(s, self.size - few, axis=1)[:, self.size - few :]
            best = (best[:, :, None] + top[:, None]).reshape(len(unit), -1)
            best = np.sort(best, axis=1)[:, -LEAST:]
        level = np.minimum(self.level, best[:, 0])
        rest = [sum(s.max(1) for s in scores[i + 1 :]) + np.zeros(len(unit)) for i in range(self.parts)]
        row, total, name = np.arange(len(unit)), np.zeros(len(unit)), np.zeros(len(unit), np.int64)
        for at, (s, more) in enumerate(zip(scores, rest, strict=True)):
            sums = total[:, None] + s[row]
            slack = 1e-12 if at + 1 < self.parts else 0.0
            i, j = np.nonzero(sums >= (level - more - slack)[row][:, None])
            row, total, name = row[i], sums[i, j], name[i] * self.size + j
        return row, name

    def slice(self) -> int:
        """Vectors to decode at once, for bounded memory."""
        return max(16, min(2048, (1 << 22) // self.size))


def pairs_at(width: int, cosine: float, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors at a cosine."""
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal((2, n, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + math.sqrt(1 - cosine * cosine) * b


def meeting(code: ProductCode, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """Which of the pairs share a filter of a code, and how many filters the first ones have."""
    met, n = np.zeros(len(a), bool), 0
    for at in range(0, len(a), code.slice()):
        end = min(len(a), at + code.slice())
        (i, f), (j, g) = code.decode(a[at:end]), code.decode(b[at:end])
        both = np.intersect1d(f * (end - at) + i, g * (end - at) + j)
        met[at + both % (end - at)] = True
        n += len(i)
    return met, n


def plan(width: int, rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Listed filters of a vector, and codes, that find the share recall of the pairs at the threshold with fewest filters.

    No codes (compare all) only for narrow vectors and thresholds of 0 or less.
    """
    # In fewer than four dimensions a fixed share of all pairs links, whatever the table.
    if width < 4 or not 0 < threshold:
        return LISTED[0], 0
    best, least = None, math.inf
    for listed in LISTED:
        met, n = 0, 0
        for seed in range(CODES):
            a, b = pairs_at(width, min(threshold, 1.0), PAIRS, seed)
            found, filters = meeting(ProductCode(width, rows, 1_000_000 + seed, listed), a, b)
            met, n = met + int(found.sum()), n + filters
        share = met / (CODES * PAIRS)
        share -= MARGIN * math.sqrt(share * (1 - share) / (CODES * PAIRS))
        if share <= 0:
            continue
        tables = 1 if share >= recall else math.ceil(math.log(1 - recall) / math.log(1 - share))
        if tables * n / (CODES * PAIRS) < least:
            best, least = (listed, tables), tables * n / (CODES * PAIRS)
    if best is None:
        raise ValueError(f"no filters find pairs at cosine {threshold}")
    return best


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's component, for the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _least_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value that row pairs of two sorted matrices share."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for c in range(a.shape[1]):
        hit = ((b == a[:, c : c + 1]) & (a[:, c : c + 1] >= 0)).any(1)
        out = np.where(hit, np.minimum(out, a[:, c]), out)
    return out


def _links(rows: pd.DataFrame, filter_: int, threshold: float, cross: bool) -> pd.DataFrame:
    """Weighted link counts and forest edges of one group; with cross, only links between its two blocks."""
    rows = rows.drop_duplicates("key").reset_index(drop=True)
    x = [np.frombuffer(v, "<f8") for v in rows["x"]]
    width = max(map(len, x))
    x = np.vstack([v if len(v) == width else np.pad(v, (0, width - len(v))) for v in x])
    lists = [np.frombuffer(v, np.int64) for v in rows["filters"]]
    held = np.full((len(rows), max(map(len, lists))), -1, np.int64)
    for r, v in enumerate(lists):
        held[r, : len(v)] = v
    length = np.sqrt((x * x).sum(1))
    weight, block = rows["copies"].to_numpy(np.int64), rows["block"].to_numpy(np.int64)
    count, ii, jj = np.zeros(len(rows), np.int64), [], []
    for at in range(0, len(rows), 256):
        # a first product with a margin, then the links proper one by one
        near = (x[at : at + 256] @ x.T) / (length[at : at + 256, None] * length[None]) >= threshold - 1e-9
        i, j = np.nonzero(near)
        i = i + at
        keep = i < j
        if cross:
            keep &= block[i] != block[j]
        i, j = i[keep], j[keep]
        cos = np.einsum("ij,ij->i", x[i], x[j]) / (length[i] * length[j])
        i, j = i[cos >= threshold], j[cos >= threshold]
        own = np.concatenate([_least_common(held[i[c : c + 65536]], held[j[c : c + 65536]]) for c in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
        i, j = i[own == filter_], j[own == filter_]
        np.add.at(count, i, weight[j])
        np.add.at(count, j, weight[i])
        ii.append(i)
        jj.append(j)
    root = _roots(len(rows), np.concatenate(ii), np.concatenate(jj))
    some = count > 0
    keys = rows["key"].to_numpy(object)
    return pd.DataFrame({"key": keys[some], "links": count[some], "root": keys[root[some]]})


def near_duplicate_vectors(vectors: DataFrame, vec_id: str, embedding: str, threshold: float = 0.95) -> DataFrame:
    """One row for each input row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    raw = vectors.select(common.col(vectors, vec_id).cast("long").alias("vec_id"), common.col(vectors, embedding).alias("x"))

    def prepare(batches):
        for b in batches:
            x, whole = matrix(b.column(1))
            with np.errstate(over="ignore", invalid="ignore"):
                length = np.sqrt((x * x).sum(1))
            ok = whole & (length > 0) & np.isfinite(length) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
            packed = [np.trim_zeros(r + 0.0, "b").tobytes() if good else None for r, good in zip(x, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["vec_id", "x"])

    rows = common.stored(raw.mapInArrow(prepare, "vec_id long, x binary").withColumn("key", F.unhex(F.md5("x"))))
    distinct = common.stored(rows.where("x is not null").groupBy("key").agg(F.first("x").alias("x"), F.count("*").alias("copies"), F.min("vec_id").alias("least")))
    n, width = distinct.agg(F.count("*"), F.max(F.length("x")) / 8).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    width = int(width)
    mean, tables = plan(width, n, threshold)

    def listed(batches):
        codes = [ProductCode(width, n, seed, mean) for seed in range(tables)]
        step = min([2048, *(code.slice() for code in codes)])
        for b in batches:
            for s in (b.slice(at, step) for at in range(0, b.num_rows, step)):
                x = np.zeros((s.num_rows, width))
                for r, v in enumerate(s.column(1).to_pylist()):
                    x[r, : len(v) // 8] = np.frombuffer(v, "<f8")
                x /= np.sqrt((x * x).sum(1))[:, None]
                found = [(row, name * tables + t) for t, code in enumerate(codes) for row, name in [code.decode(x)]]
                found = found or [(np.arange(s.num_rows), np.zeros(s.num_rows, np.int64))]
                row, name = (np.concatenate(v) for v in zip(*found, strict=True))
                order = np.lexsort((name, row))
                row, name = row[order], name[order]
                cuts = np.searchsorted(row, np.arange(s.num_rows + 1))
                lists = [name[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), s.column(2), pa.array(lists, pa.list_(pa.int64())), pa.array([v.tobytes() for v in lists], pa.binary())], ["key", "x", "copies", "each", "filters"])

    under = common.stored(distinct.select("key", "x", "copies").mapInArrow(listed, "key binary, x binary, copies long, each array<long>, filters binary"))
    sizes = under.select(F.explode("each").alias("filter")).groupBy("filter").count().where("count > 1")
    sizes = common.stored(sizes.select("filter", F.ceil(F.col("count") / SPLIT).alias("blocks")))
    exploded = under.select("key", "x", "copies", "filters", F.explode("each").alias("filter"))
    dealt = exploded.join(sizes, "filter").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    # Each block meets itself and every other block of its filter once.
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))
    dealt = dealt.withColumn("pair", F.explode(meets)).select("filter", "pair.low", "pair.high", "key", "x", "copies", "filters", "block")

    def compare(group: tuple, members: pd.DataFrame) -> pd.DataFrame:
        return _links(members, group[0], threshold, group[1] != group[2])

    links = common.stored(dealt.groupBy("filter", "low", "high").applyInPandas(compare, "key binary, links long, root binary"))
    parts = connected_components(links.select("key", "root"), "key", "root")
    counted = distinct.join(links.groupBy("key").agg(F.sum("links").alias("links")), "key", "left").join(parts.withColumnRenamed("node", "key"), "key", "left")
    counted = counted.select("key", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "key").alias("component"))
    heads = counted.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = counted.join(heads, "component").select("key", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(classes, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
