"""Operator 1: exact top-k inner products of integer vectors, in norm-sorted blocks with rotated partial sums.

Components become floor(scale * x).  Spark sorts all vectors by descending length into blocks of at most BLOCK rows and
deals the blocks over groups, at least as many as keep all cores busy; the queries form blocks of their own by a hash of their
id.  A first pass of the queries over the longest block gives each a k-th score, the floor from which its search
starts, and pairs of a query block and a vector block whose lengths cannot reach any floor are not sent.  Each other pair of a
query block and a group of vector blocks meets in one task, which takes the group's blocks by descending length and keeps the k best scores
of each query.  With t a query's k-th best score so far, a block is left as soon as length times length falls below t.  Inside
a block both sides are rotated to the block's singular directions, which carry most of the length in the first
coordinates; the inner product over these plus the product of the remaining lengths bounds the score from above
(Cauchy-Schwarz), and only pairs whose bound reaches t get their exact integer score.  A last window takes the k best over the
groups.  Bounds only skip pairs that cannot enter, so results are exact, ties to the smaller id included.

Every task holds one query block and one group of vector blocks, whatever the input's size.  Vectors that are null or hold a
null or non-finite component, and rows with a null id, take no part.  Vectors of unequal length are compared as if the
shorter ended in zeros; an empty vector is all zeros.  Rows that repeat an id count once, with their best score; a vector is
never its own query's candidate, by id.  Fewer candidates than k give fewer rows; an empty table gives none.  Scores beyond
the long range are clamped.  Further columns take no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm import common
from kinloom.llm.vectors import matrix

#: Rows of a vector block, blocks of a group, rows of a query block.
BLOCK, GROUP, QUERIES = 2048, 32, 2048
_EXACT = float(1 << 53)


def _scaled(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    x, whole = matrix(column)
    x = np.floor(np.where(whole[:, None], x, 0.0) * scale)
    return x, whole & np.isfinite(x).all(axis=1)


def _pack(x: np.ndarray) -> bytes:
    """A matrix as 32-bit integers where they hold it, else as doubles, behind a byte that says which."""
    small = not x.size or np.abs(x).max() < 1 << 31
    return (b"i" if small else b"d") + x.astype("<i4" if small else "<f8").tobytes()


def _unpack(data: bytes, rows: int) -> np.ndarray:
    x = np.frombuffer(data, "<i4" if data[:1] == b"i" else "<f8", offset=1).astype(np.float64)
    return x.reshape(rows, len(x) // rows if rows else 0)


def _widen(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of row pairs, clamped to the long range."""
    if not q.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < _EXACT:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(q, x, strict=True)]
    return np.array([min(max(v, -(1 << 63)), (1 << 63) - 1) for v in exact], np.int64)


class _Best:
    """The k best candidates of each query of a block."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k, self.floor = ids, k, floor
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.filled = np.zeros((len(ids), k), bool)

    def bound(self) -> np.ndarray:
        """A score below this cannot enter."""
        return np.maximum(np.where(self.filled[:, -1], self.score[:, -1].astype(np.float64), -np.inf), self.floor)

    def add(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(query)
        old = np.repeat(touched, self.k)
        keep = self.filled[touched].ravel()
        q = np.concatenate([old[keep], query])
        v = np.concatenate([self.vec[touched].ravel()[keep], vec])
        s = np.concatenate([self.score[touched].ravel()[keep], score])
        order = np.lexsort((~s, v, q))  # ~s descends where s ascends, over the whole long range
        q, v, s = q[order], v[order], s[order]
        one = np.concatenate([[True], (q[1:] != q[:-1]) | (v[1:] != v[:-1])])  # an id's best score
        q, v, s = q[one], v[one], s[one]
        order = np.lexsort((v, ~s, q))
        q, v, s = q[order], v[order], s[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1])
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        top = rank < self.k
        self.filled[touched] = False
        self.score[q[top], rank[top]], self.vec[q[top], rank[top]], self.filled[q[top], rank[top]] = s[top], v[top], True


def _search(best: _Best, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
    """Offers the vectors of a block to the queries; x descends in length."""
    width = max(q.shape[1], x.shape[1])
    q, x = _widen(q, width), _widen(x, width)
    q_len, x_len = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    slack = 1e-9
    bound = best.bound()
    use = np.flatnonzero(q_len * x_len[0] * (1 + slack) >= bound)
    if not len(use):
        return
    _, turn = np.linalg.eigh(x.T @ x) if width else (None, np.zeros((0, 0)))
    turn = turn[:, ::-1]
    xr, qr = x @ turn, q[use] @ turn
    head = max(1, width // 4)
    x_rest = np.sqrt(np.maximum((xr[:, head:] ** 2).sum(1), 0))
    q_rest = np.sqrt(np.maximum((qr[:, head:] ** 2).sum(1), 0))
    small = not q.size or np.abs(q).max() * np.abs(x).max() * width < _EXACT
    step = 512  # of the block, by descending length, so that the bound tightens on the way
    for at in range(0, len(x), step):
        part = slice(at, at + step)
        bound = best.bound()[use]
        live = np.flatnonzero(q_len[use] * x_len[at] * (1 + slack) >= bound)
        if not len(live):
            return
        upper = qr[live, :head] @ xr[part, :head].T + np.outer(q_rest[live], x_rest[part])
        room = slack * np.outer(q_len[use[live]], x_len[part]) + slack
        i, j = np.nonzero((upper + room >= bound[live][:, None]) & (best.ids[use[live]][:, None] != ids[part][None, :]))
        if not len(i):
            continue
        row, vec = use[live][i], at + j
        # Where many pairs are left a whole product is cheaper than one by one; sums of small integers are exact in any order.
        found = (q[use[live]] @ x[part].T)[i, j].astype(np.int64) if small and 50 * len(i) > upper.size else _scores(q[row], x[vec])
        enter = found >= best.bound()[row]
        if enter.any():
            best.add(row[enter], ids[vec[enter]], found[enter])


def top_k(vectors: DataFrame, vec_id: str, embedding: str, is_query: Column, k: int, scale: float) -> DataFrame:
    """The k best rows for each query row: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = vectors.select(common.col(vectors, vec_id).cast("long").alias("id"), common.col(vectors, embedding).alias("x"), is_query.alias("q")).where("id is not null and x is not null")

    def lengths(batches):
        for b in batches:
            x, whole = _scaled(b.column(1), scale)
            keep = pa.array(whole)
            packed = pa.array([_pack(r[None]) for r in x[whole]], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), pa.array((x[whole] ** 2).sum(1)), packed, b.column(2).filter(keep)], ["id", "length", "x", "q"])

    ready = common.stored(rows.mapInArrow(lengths, "id long, length double, x binary, q boolean"))
    n, n_query = ready.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    if not n_query:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts, query_blocks = -(-n // BLOCK), -(-n_query // QUERIES)
    groups = max(-(-parts // GROUP), min(parts, -(-2 * spark.sparkContext.defaultParallelism // query_blocks)))

    def blocks(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seq = 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                s = b.slice(at, BLOCK)
                x = [_unpack(v, 1) for v in s.column(2).to_pylist()]
                width = max(v.shape[1] for v in x)
                x = np.vstack([_widen(v, width) for v in x])
                row = [[(part + seq) % groups], [float(s.column(1)[0].as_py())], [s.num_rows], [np.asarray(s.column(0)).tobytes()], [_pack(x)]]
                types = [pa.int32(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["group", "length", "n", "ids", "x"])
                seq += 1

    order = [F.col("length").desc(), F.col("id")]
    sorted_blocks = ready.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "length", "x")
    sorted_blocks = common.stored(sorted_blocks.mapInArrow(blocks, "group int, length double, n int, ids binary, x binary"))
    queries = ready.where("q").select("id", "length", "x", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("block"))
    every = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))

    def search(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or found.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        q = [_unpack(v, 1) for v in queries["x"]]
        width = max(v.shape[1] for v in q)
        q = np.vstack([_widen(v, width) for v in q])
        best = _Best(queries["id"].to_numpy(np.int64), k, queries["floor"].fillna(-np.inf).to_numpy(np.float64))
        for r in found.sort_values(["length", "ids"], ascending=[False, True]).itertuples():
            _search(best, q, np.frombuffer(r.ids, np.int64), _unpack(r.x, r.n))
        i, j = np.nonzero(best.filled)
        return pd.DataFrame({"query_id": best.ids[i], "vec_id": best.vec[i, j], "score": best.score[i, j]})

    def searched(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(search, "query_id long, vec_id long, score long")

    # The longest block alone gives each query a floor, where it has k candidates there.
    longest = sorted_blocks.orderBy(F.desc("length"), "ids").limit(1).drop("group").select("*", F.lit(0).alias("group"), every.alias("block"))
    first = searched(queries.select("*", F.lit(0).alias("group"), F.lit(None).cast("double").alias("floor")), longest)
    # Rows that repeat an id are one query, with one vector's floor and another's length; such queries get none.
    alone = queries.groupBy(F.col("id").alias("query_id")).count().where("count = 1").select("query_id")
    floors = first.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") == k).join(alone, "query_id")
    asked = common.stored(queries.join(floors.select(F.col("query_id").alias("id"), "floor"), "id", "left"))
    # The length from which a block can reach the floor of one of a query block's queries.
    reach = F.when(F.col("floor") > 0, F.col("floor") / F.sqrt("length")).otherwise(0.0)
    needs = asked.groupBy("block").agg(F.min(reach).alias("need"))
    right = sorted_blocks.select("*", every.alias("block")).join(needs, "block").where(F.sqrt("length") * (1 + 1e-9) >= F.col("need")).drop("need")
    left = asked.select("id", "x", "floor", "block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    part = searched(left, right)
    once = part.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
