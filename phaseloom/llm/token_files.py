"""Token-ID files (operator 10).

Documents go to shards by ascending doc_id.  A shard file holds, one after the
other: the raw ids of its documents, the documents' keys, a perfect-hash index
over the keys, and a fixed footer.  The index has, for each key, a 32-bit
fingerprint, the document's number and the id offset and length, so a document is
read with one hash and one ranged read; a hit is compared with the stored key.
Files are written into a folder of their own and moved, and go to the shared folder
by its URI (any file system that pyarrow can reach).  A directory file lists the
shards with their least and greatest keys, so a key is looked up in one shard.

Footer, little-endian: 8 bytes magic, then eight unsigned 64-bit numbers: bytes
per id, ids, documents, and the places of keys, null flags, perfect hash, entries
and footer.
"""

from __future__ import annotations

import bisect
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseloom.llm.common import fresh_path, released, text_or_empty
from phaseloom.llm.library_ids import byte_ids, vocabulary_size
from phaseloom.llm.mph import PerfectHash, fingerprint, mix

MAGIC = b"idshard2"
FOOTER = struct.Struct("<8s8Q")
ENTRY = np.dtype([("fingerprint", "<u4"), ("doc", "<u4"), ("n", "<u8"), ("start", "<u8")])
DIRECTORY, UNFINISHED = "directory.json", "_unfinished"
READ_IDS = 1 << 20


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def key_hash(keys: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Distinct for repeated keys of one shard: the k-th row of a key has its own hash."""
    order = np.lexsort((keys, null))
    k, z = keys[order], null[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (z[1:] != z[:-1])
    at = np.arange(len(k))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty(len(keys), np.uint64)
    out[order] = mix(mix(k.astype(np.uint64), 11) ^ mix(nth.astype(np.uint64) * np.uint64(2) + z.astype(np.uint64), 12), 13)
    return out


class ShardWriter:
    def __init__(self, uri: str, id_bytes: int):
        self.fs, self.final = _place(uri)
        folder, _, name = self.final.rpartition("/")
        self.fs.create_dir(f"{folder}/{UNFINISHED}")
        self.temporary = f"{folder}/{UNFINISHED}/{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.dtype = np.dtype("<u2" if id_bytes == 2 else "<u4")
        self.keys: list[int | None] = []
        self.counts: list[int] = []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > np.iinfo(self.dtype).max:
            raise ValueError(f"id {int(ids.max())} doesn't fit {self.dtype.itemsize} bytes")
        self.out.write(ids.astype(self.dtype).tobytes())
        self.keys.append(key)
        self.counts.append(len(ids))

    def close(self) -> tuple[int, int]:
        """(documents, ids)"""
        null = np.array([k is None for k in self.keys], bool)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        counts = np.array(self.counts, np.int64)
        h = key_hash(keys, null)
        mph = PerfectHash.build(h)
        at = mph.index(h)
        entries = np.zeros(len(keys), ENTRY)
        entries["fingerprint"][at], entries["doc"][at], entries["n"][at], entries["start"][at] = fingerprint(h), np.arange(len(keys)), counts, np.cumsum(counts) - counts
        total = int(counts.sum())
        place = total * self.dtype.itemsize
        places = []
        for part in (keys.tobytes(), null.tobytes(), mph.to_bytes(), entries.tobytes()):
            places.append(place)
            self.out.write(part)
            place += len(part)
        self.out.write(FOOTER.pack(MAGIC, self.dtype.itemsize, total, len(keys), *places, place))
        self.out.close()
        self.fs.move(self.temporary, self.final)
        return len(keys), total


class ShardReader:
    def __init__(self, uri: str):
        fs, path = _place(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, width, self.n_ids, self.n_docs, keys, null, mph, entries, end = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a shard file: {uri}")
        self.dtype = np.dtype("<u2" if width == 2 else "<u4")
        read = lambda a, b: self.file.read_at(b - a, a)
        self.keys = np.frombuffer(read(keys, null), "<i8")
        self.null = np.frombuffer(read(null, mph), bool)
        self.mph = PerfectHash.from_bytes(read(mph, entries))
        self.entries = np.frombuffer(read(entries, end), ENTRY)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry numbers of key hashes; -1 where the fingerprint says it isn't here."""
        at = self.mph.index(h)
        ok = (at >= 0) & (self.entries["fingerprint"][at] == fingerprint(h))
        return np.where(ok, at, -1)

    def ids(self, start: int, n: int) -> np.ndarray:
        w = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(n * w, start * w), self.dtype)

    def get(self, key: int, nth: int = 0) -> np.ndarray | None:
        """The ids of a document by its key, or None."""
        h = mix(mix(np.array([key], "<i8").astype(np.uint64), 11) ^ mix(np.array([nth * 2], np.uint64), 12), 13)
        (at,) = self.find(h)
        if at < 0 or self.keys[self.entries["doc"][at]] != key or self.null[self.entries["doc"][at]]:
            return None
        return self.ids(int(self.entries["start"][at]), int(self.entries["n"][at]))


class TokenStore:
    """Documents of a folder of shards, by key.  Shards are ranges of keys, so the
    directory tells which may hold one; readers stay open."""

    def __init__(self, folder: str):
        fs, place = _place(folder)
        with fs.open_input_stream(f"{place}/{DIRECTORY}") as f:
            self.shards = [x for x in json.loads(f.read()) if x["greatest"] is not None]
        self.folder = folder
        self.firsts = [x["greatest"] for x in self.shards]
        self.readers: dict[str, ShardReader] = {}

    def get(self, key: int) -> np.ndarray | None:
        """The ids of the first document with this key, or None."""
        i = bisect.bisect_left(self.firsts, key)
        if i == len(self.shards) or key < self.shards[i]["least"]:
            return None
        name = self.shards[i]["name"]
        if name not in self.readers:
            self.readers[name] = ShardReader(f"{self.folder}/{name}")
        return self.readers[name].get(key)


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int) -> DataFrame:
    """Encodes docs into shard files under folder; a row per file: shard, uri,
    n_docs, n_ids, least, greatest (keys).  Shards are ranges of (doc_id, text hash,
    row), so rows that share a doc_id may be split over shards.  An id takes as many
    bytes as the vocabulary's greatest id and end_id need."""
    id_bytes = 2 if max(vocabulary_size(path), end_id + 1) <= 1 << 16 else 4

    @released
    def run(batches):
        shard = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{shard:06d}.ids"
        writer = None
        end = np.array([end_id], np.uint32)
        for b in batches:
            if b.num_rows and writer is None:
                writer = ShardWriter(uri, id_bytes)
            for key, ids in zip(b.column("doc_id").to_pylist(), byte_ids(path, b.column("text").to_pylist()), strict=True):
                writer.add(key, np.concatenate((ids, end)))
        if writer:
            n_docs, n_ids = writer.close()
            known = [k for k in writer.keys if k is not None]
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "uri": [uri], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64()), "least": pa.array([min(known, default=None)], pa.int64()), "greatest": pa.array([max(known, default=None)], pa.int64())})

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = rows.select("*", keys[1].alias("h"), keys[2].alias("row")).repartitionByRange(keys[0], "h", "row").sortWithinPartitions(keys[0], "h", "row")
    return ordered.mapInArrow(run, "shard int, uri string, n_docs long, n_ids long, least long, greatest long")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.
    shards: uri and base, the ids of all shards before."""

    @released
    def run(batches):
        for b in batches:
            for uri, base in zip(b.column("uri").to_pylist(), b.column("base").to_pylist(), strict=True):
                r = ShardReader(uri)
                at = r.find(key_hash(r.keys, r.null))
                if (at < 0).any():
                    raise ValueError(f"a key isn't in the index of {uri}")
                start, n = r.entries["start"][at].astype(np.int64), r.entries["n"][at].astype(np.int64)
                i = 0
                while i < len(at):
                    j = max(i + 1, int(np.searchsorted(start, start[i] + READ_IDS)))
                    ids = r.ids(int(start[i]), int(start[j - 1] + n[j - 1] - start[i])).astype("<u4")
                    crc = [zlib.crc32(ids[s : s + k].tobytes()) for s, k in zip((start[i:j] - start[i]).tolist(), n[i:j].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(r.keys[i:j], mask=r.null[i:j]), pa.array(start[i:j] + base), pa.array(n[i:j]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    i = j

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Writes docs as shard files in ascending doc_id order and reads them back.

    Null text counts as empty: such a document is its end id alone.  Repeated
    doc_ids are kept, in the order of their texts' hashes; null doc_id comes
    first.  Empty table: no files, no rows.  The driver holds a row per file.
    """
    folder = folder or fresh_path(spark, "ids")
    fs, place = _place(folder)
    fs.create_dir(place)
    files = sorted(write_shards(docs, path, folder, end_id).collect(), key=lambda f: f["shard"])
    if files:
        fs.delete_dir(f"{place}/{UNFINISHED}")  # what failed tasks have left
    with fs.open_output_stream(f"{place}/{DIRECTORY}") as out:
        out.write(json.dumps([{"name": f["uri"].rpartition("/")[2], **{c: f[c] for c in ("n_docs", "n_ids", "least", "greatest")}} for f in files]).encode())
    base, rows = 0, []
    for f in files:
        rows.append((f["uri"], base))
        base += f["n_ids"]
    listed = spark.createDataFrame(rows, "uri string, base long")
    return read_shards(listed.repartition(max(1, len(rows))))
