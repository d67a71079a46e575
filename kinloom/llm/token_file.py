"""Operator 8: token ids of documents in raw binary shards with a minimal perfect hash index.

Format of a shard, two files in one folder:

* ``shard-PPPPP-NNNNN.bin`` (task, shard of it): the ids of its documents, one document behind another in ascending key order, each followed by the end
  id, as little-endian unsigned 16-bit integers where the vocabulary fits, else 32-bit.  Nothing else is in the file.
* ``shard-PPPPP-NNNNN.idx``: little-endian arrays, one behind another, after their eight lengths as 64-bit integers.  First the perfect
  hash of the distinct keys, ``sizes``, ``bits`` and ``rest`` of its levels, about three bits a key; then for each of its slots ``marks``,
  a 32-bit fingerprint of the key, and ``first``, the number of the key's first document; then of the documents in file order
  ``offsets`` (positions in ids, one more than documents), ``keys`` and ``known`` (0: the key is null).

Looking a key up takes the hash part of the index, one hash a level, one bit rank, and four reads of a few bytes: the
fingerprint, the document's number, its two offsets and its ids.  Keys and offsets of other documents are not read.  A table
``manifest`` (Parquet) holds a row for each shard: documents, ids, first id of the shard in the whole sequence, key range.

Spark deals documents to tasks by key range; a task encodes its range and writes it as one shard behind another.  A shard ends with
the document that fills SHARD_IDS ids or SHARD_DOCS documents, so files, indexes and the memory of a task are bounded however much a
task is dealt, and what is dealt decides how many shards there are.  Each is written under a name of the task's attempt and then
moved into place, so that a task that runs again replaces its shards with the same bytes; files of attempts that failed are deleted
when all tasks are done.  Files go to a folder that driver and executors share, through pyarrow's file systems.

Null texts are empty: their documents hold the end id alone.  Documents with a null key come first; they are stored and read
back but have no entry in the index.  Repeated keys keep all their documents, in the order of a hash of the text; the index
points to the first in each shard.  An empty table gives an empty manifest.  Only the key and the text are stored; further columns,
whatever their names, take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.llm import common
from kinloom.llm.bpe import AT_ONCE, WordBpe, file_broadcast, loaded, slices

#: Rows of a manifest that is broadcast.
BROADCAST = 100_000
#: Ids and documents with which a shard is full.
SHARD_IDS, SHARD_DOCS = 1 << 26, 1 << 20
_WRITTEN = "part int, piece int, n_docs long, n_ids long, min_key long, max_key long, path string, width int"
_MANIFEST = "shard int, n_docs long, n_ids long, min_key long, max_key long, path string, width int"


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: levels of bits that a key alone sets, numbered by rank."""

    LEVELS = 40

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, rest: np.ndarray):
        self.bits, self.sizes, self.rest = bits, sizes, rest
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.total = int(ones.sum())
        self.starts = np.cumsum(sizes) - sizes

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (common.mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, sizes, left = [], [], keys
        while len(left) and len(sizes) < cls.LEVELS:
            size = max(64, -(-2 * len(left) // 64) * 64)
            at = cls._place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
        bits = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        return cls(bits, np.array(sizes, np.int64), np.sort(left))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that was not built in, any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = self._place(keys[open_], level, size) + self.starts[level]
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (self.before[at >> 6] + below)[hit]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.total + at[hit]
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (common.mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


class ShardIndex:
    """What a shard's index file holds, in memory."""

    def __init__(self, keys: np.ndarray, known: np.ndarray, offsets: np.ndarray, hash_: PerfectHash, marks: np.ndarray, first: np.ndarray):
        self.keys, self.known, self.offsets, self.hash, self.marks, self.first = keys, known, offsets, hash_, marks, first

    @classmethod
    def build(cls, keys: np.ndarray, known: np.ndarray, offsets: np.ndarray) -> ShardIndex:
        """keys ascend where known."""
        new = known.copy()
        new[1:] &= (keys[1:] != keys[:-1]) | ~known[:-1]
        at = np.flatnonzero(new)
        distinct = keys[at].view(np.uint64)
        hash_ = PerfectHash.build(distinct)
        marks, first, slot = np.zeros(len(at), np.uint32), np.zeros(len(at), np.int64), hash_.find(distinct)
        marks[slot], first[slot] = _fingerprint(distinct), at
        return cls(keys, known, offsets, hash_, marks, first)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The number of the first document of each key, -1 where the fingerprint says that the shard lacks it."""
        keys = keys.view(np.uint64)
        slot = self.hash.find(keys)
        ok = slot >= 0
        ok[ok] = self.marks[slot[ok]] == _fingerprint(keys[ok])
        out = np.full(len(keys), -1, np.int64)
        out[ok] = self.first[slot[ok]]
        return out

    def dump(self) -> bytes:
        h = self.hash
        arrays = [h.sizes, h.bits, h.rest, self.marks, self.first, self.offsets, self.keys, self.known]
        packed = [np.asarray(a).astype(k) for a, k in zip(arrays, _SECTIONS.values(), strict=True)]
        return np.array([len(a) for a in packed], "<i8").tobytes() + b"".join(a.tobytes() for a in packed)

    @classmethod
    def load(cls, data: bytes) -> ShardIndex:
        parts = {k: np.frombuffer(data, kind, n, at) for k, (kind, n, at) in _sections(data).items()}
        return cls(parts["keys"], parts["known"].astype(bool), parts["offsets"], PerfectHash(parts["bits"], parts["sizes"], parts["rest"]), parts["marks"], parts["first"])


#: The arrays of an index file and their types, in file order.
_SECTIONS = {"sizes": "<i8", "bits": "<u8", "rest": "<u8", "marks": "<u4", "first": "<i8", "offsets": "<i8", "keys": "<i8", "known": "<u1"}
_HEAD = 8 * len(_SECTIONS)


def _sections(head: bytes) -> dict[str, tuple[str, int, int]]:
    """Type, length and place of each array of an index file, from its first bytes."""
    out, at = {}, _HEAD
    for (name, kind), n in zip(_SECTIONS.items(), np.frombuffer(head, "<i8", len(_SECTIONS)).tolist(), strict=True):
        out[name] = (kind, n, at)
        at += n * np.dtype(kind).itemsize
    return out


class IndexFile:
    """An index file that is asked for single keys: only its hash part is held in memory."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.parts = file, _sections(file.read_at(_HEAD, 0))
        sizes, bits, rest = (self._read(k) for k in ("sizes", "bits", "rest"))
        self.hash = PerfectHash(bits, sizes, rest)

    def _read(self, name: str, first: int = 0, n: int | None = None) -> np.ndarray:
        kind, size, at = self.parts[name]
        step = np.dtype(kind).itemsize
        return np.frombuffer(self.file.read_at((size if n is None else n) * step, at + first * step), kind)

    def find(self, key: int) -> tuple[int, int] | None:
        """The first and the last offset of a key's first document; None where the fingerprint says that the shard lacks it."""
        name = np.array([key], np.int64).view(np.uint64)
        slot = int(self.hash.find(name)[0])
        if slot < 0 or self._read("marks", slot, 1)[0] != _fingerprint(name)[0]:
            return None
        start, stop = self._read("offsets", int(self._read("first", slot, 1)[0]), 2).tolist()
        return start, stop


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class _ShardWriter:
    """One shard that a task writes: its ids go to the file as they come, keys and sizes stay until it is full."""

    def __init__(self, fs: pa.fs.FileSystem, attempt: str, kind: np.dtype):
        self.fs, self.attempt, self.kind = fs, attempt, kind
        self.out = fs.open_output_stream(f"{attempt}.bin")
        self.keys, self.known, self.sizes, self.n_ids = [], [], [], 0

    def add(self, keys: np.ndarray, known: np.ndarray, ids: list[bytes], sizes: np.ndarray, end: bytes) -> None:
        self.keys.append(keys)
        self.known.append(known)
        self.sizes += sizes.tolist()
        self.n_ids += int(sizes.sum())
        for one in ids:
            self.out.write(np.frombuffer(one, "<u4").astype(self.kind).tobytes() + end)

    def close(self, place: str) -> tuple[int, int, int | None, int | None]:
        """Moves the shard to its place: documents, ids, least and greatest key."""
        self.out.close()
        keys, known = np.concatenate(self.keys), np.concatenate(self.known)
        offsets = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        with self.fs.open_output_stream(f"{self.attempt}.idx") as f:
            f.write(ShardIndex.build(keys, known, offsets).dump())
        for suffix in ("bin", "idx"):
            self.fs.move(f"{self.attempt}.{suffix}", f"{place}.{suffix}")
        held = keys[known]
        return len(keys), self.n_ids, int(held[0]) if len(held) else None, int(held[-1]) if len(held) else None


def _filled(sizes: np.ndarray, n_docs: int, n_ids: int, shard_docs: int, shard_ids: int) -> int:
    """How many of the next documents, of these sizes, go to a shard that holds n_docs and n_ids; one at least, and the one that fills it is the last."""
    full = np.flatnonzero(n_ids + np.cumsum(sizes) >= shard_ids)
    return min(len(sizes), int(full[0]) + 1 if len(full) else len(sizes), max(1, shard_docs - n_docs))


def write_token_files(docs: DataFrame, key: str, text: str, path: str, end_id: int, folder: str, shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encodes docs with the tokenizer at path, writes their shards and manifest below folder and gives the manifest back."""
    spark = docs.sparkSession
    file = file_broadcast(spark, path)
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(common.col(docs, key).cast("long").alias("key"), common.col(docs, text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key").asc_nulls_first(), F.col("tie")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", "text")

    def write(batches):
        fs, root = _open(folder)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        bpe = loaded(WordBpe, file.value)
        kind = np.dtype("<u2" if max(len(bpe.tokens) - 1, end_id) < 1 << 16 else "<u4")
        end = np.array([end_id], kind).tobytes()
        shard, done = None, []

        def finish():
            name = f"shard-{part:05d}-{len(done):05d}"
            n_docs, n_ids, least, most = shard.close(f"{root}/{name}")
            done.append({"part": part, "piece": len(done), "n_docs": n_docs, "n_ids": n_ids, "min_key": least, "max_key": most, "path": f"{folder}/{name}", "width": kind.itemsize})

        for whole in batches:
            for batch in slices(whole, 1, 8 * AT_ONCE):
                column = batch.column(0)
                keys, known = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
                ids = bpe.encode_batch(batch.column(1).to_pylist())
                sizes, at = np.array([len(i) // 4 + 1 for i in ids], np.int64), 0
                while at < len(ids):
                    if shard is None:
                        shard = _ShardWriter(fs, f"{root}/attempt-{part}-{attempt}-{len(done)}", kind)
                    stop = at + _filled(sizes[at:], len(shard.sizes), shard.n_ids, shard_docs, shard_ids)
                    shard.add(keys[at:stop], known[at:stop], ids[at:stop], sizes[at:stop], end)
                    at = stop
                    if shard.n_ids >= shard_ids or len(shard.sizes) >= shard_docs:
                        finish()
                        shard = None
        if shard is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_pylist(done, _written_schema())

    dealt.mapInArrow(write, _WRITTEN).write.parquet(f"{folder}/shards")
    for left in fs.get_file_info(pa.fs.FileSelector(root)):
        if left.base_name.startswith("attempt-"):
            fs.delete_file(left.path)
    shards = spark.read.schema(_WRITTEN).parquet(f"{folder}/shards")
    # A row for each shard; shards ascend with keys.
    order = Window.orderBy("part", "piece")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("shard", F.row_number().over(order) - 1).withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))
    placed.drop("part", "piece").write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def _written_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in _WRITTEN.split(", "))])


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST + ", start long").parquet(f"{folder}/manifest")


def _payload(fs, path: str, first: int, stop: int, width: int) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at((stop - first) * width, first * width)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """All documents from the files: key, start (in the whole sequence), ids (binary, unsigned 32-bit), by way of the index.

    Each known key is looked up in its shard's hash; the documents that repeat it follow the one that the index points to.
    """

    def read(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                fs, base = _open(shard["path"])
                with fs.open_input_stream(f"{base}.idx") as f:
                    index = ShardIndex.load(f.read())
                found = index.lookup(index.keys)
                runs = np.arange(len(found)) - found
                if (found[index.known] < 0).any() or (runs[index.known] < 0).any() or (index.keys[found] != index.keys)[index.known].any():
                    raise ValueError(f"the index of {shard['path']} does not fit its keys")
                kind = np.dtype(f"<u{shard['width']}")
                for at in range(0, len(found), 4096):
                    stop = min(at + 4096, len(found))
                    cuts = index.offsets[at : stop + 1]
                    ids = np.frombuffer(_payload(fs, f"{base}.bin", int(cuts[0]), int(cuts[-1]), kind.itemsize), kind).astype("<u4").tobytes()
                    ends = (4 * (cuts - cuts[0])).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(index.keys[at:stop], pa.int64(), mask=~index.known[at:stop]), pa.array(cuts[:-1] + shard["start"], pa.int64()), pa.array([ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())],
                        ["key", "start", "ids"],
                    )

    # A number of partitions that is asked for is kept: a task for each shard or two, not one for all.
    return manifest.repartition(max(1, manifest.count()), "shard").mapInArrow(read, "key long, start long, ids binary")


def lookup_token_files(manifest: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Keyed access: the first document of each asked key in each shard that may hold it, as key, shard, start, ids.

    Keys meet shards by range.  The manifest has a row for each shard; up to BROADCAST of them it is broadcast, else
    Spark chooses the join.  A shard's keys are looked up together, in parts of bounded size.
    """
    wanted = keys.select(common.col(keys, key).cast("long").alias("key")).where("key is not null").distinct()
    small = manifest.count() <= BROADCAST
    routed = wanted.join(F.broadcast(manifest) if small else manifest, (wanted["key"] >= manifest["min_key"]) & (wanted["key"] <= manifest["max_key"]))

    def read(key_, rows):
        fs, base = _open(rows["path"].iloc[0])
        kind = np.dtype(f"<u{rows['width'].iloc[0]}")
        with fs.open_input_file(f"{base}.idx") as file:
            index = IndexFile(file)
            found = [index.find(k) for k in rows["key"].tolist()]
        have = [i for i, f in enumerate(found) if f is not None]
        rows, found = rows.iloc[have], [found[i] for i in have]
        with fs.open_input_file(f"{base}.bin") as file:
            ids = [np.frombuffer(file.read_at((b - a) * kind.itemsize, a * kind.itemsize), kind).astype("<u4").tobytes() for a, b in found]
        return rows.assign(start=rows["start"] + np.array([a for a, _ in found], np.int64), ids=ids)[["key", "shard", "start", "ids"]]

    part = F.pmod(F.xxhash64("key"), F.greatest(F.lit(1), (F.col("n_docs") / 50_000).cast("int")))
    return routed.groupBy("shard", part.alias("part")).applyInPandas(read, "key long, shard int, start long, ids binary")


