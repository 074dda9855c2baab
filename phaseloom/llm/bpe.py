"""Byte-level BPE encoding and decoding (operator 5).

Two tiers: a minimal perfect hash resolves a pre-token that is itself in the
vocabulary; any other is merged by rank with a heap over linked bytes.  A
worker remembers what it has merged.  Both look-ups compare bytes on a hit.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from phaseloom.llm.common import released, text_or_empty
from phaseloom.llm.mph import PerfectHash
from phaseloom.llm.pretokens import PretokenEncoder, equal_spans, hash_spans, padded


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always join the adjacent pair of lowest rank, the
    leftmost first.  Live parts form a linked list; heap entries that no longer
    describe two neighbours are skipped."""
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that begins here
    prev = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        right = end[i]
        alive[right] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class BytePairCodec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        self.of = {r: t for t, r in self.ranks.items()}
        blob = b"".join(tokens)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(sizes)
        keys = hash_spans(blob, ends - sizes, ends)
        self.mph = PerfectHash.build(keys)
        at = self.mph.index(keys)
        self.held = np.zeros(len(keys), np.uint64)
        self.held[at] = keys
        self.id = np.zeros(len(keys), np.int64)
        self.id[at] = [self.ranks[t] for t in tokens]
        self.bytes, self.start, self.size = padded(blob), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        self.start[at], self.size[at] = ends - sizes, sizes
        self.decimal = np.array([b"%d," % i for i in range(max(self.of) + 1)])
        self.encoder = PretokenEncoder("spaced", pattern, self._merged, self._whole)

    def _whole(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = self.mph.index(h)
        known = (at >= 0) & (self.held[at] == h) & (self.size[at] == size)
        known[known] = equal_spans(self.bytes, self.start[at[known]], data, starts[known], size[known])
        return np.where(known, self.id[at], -1)

    def _merged(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        runs = [merge(p, self.ranks) for p in parts]
        return np.array([i for r in runs for i in r], np.uint32), np.fromiter(map(len, runs), np.int64, len(runs))

    def encode(self, texts: list[str]):
        """(index, ids) of each text."""
        return self.encoder.batch(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.of.__getitem__, ids.tolist()))


@functools.cache
def codec(path: str, pattern: str) -> BytePairCodec:
    return BytePairCodec(path, pattern)


def encode_table(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text.  Null and empty texts give
    an empty array; repeated rows give repeated rows; other columns go."""

    @released
    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            got = [ids for _, ids in c.encode(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.astype(np.int32) for x in got], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of encoding and of decoding again, per row of docs.

    Null text counts as empty (no ids; the digests of the empty string).  Rows
    are independent: ties, repeated rows and null doc_id pass through.  Texts of
    any length are cut at pre-token boundaries only, to bound memory.
    """

    @released
    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for _, ids in c.encode(b.column("text").to_pylist()):
                n.append(len(ids))
                decimal = c.decimal[ids].tobytes().translate(None, b"\0")[:-1]
                ids_sha.append(hashlib.sha256(decimal).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
